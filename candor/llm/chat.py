"""Preference formatting of chosen and rejected conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def pair_neighbours(turns: DataFrame) -> DataFrame:
    """Pairs from a plain table of conversations: an even id is the chosen one, the odd id after it the rejected one.

    Turns of a null id are of no pair and left out. All ids that are long integers pair exactly.
    """
    conv = F.col("conv_id").cast("long")
    return turns.where(conv.isNotNull()).select(F.shiftright(conv, 1).alias("pair_id"), F.when(F.pmod(conv, F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")


def preference_format(turns: DataFrame) -> DataFrame:
    """``pair_id, part, turn, n_common, rendered, loss_from, loss_to`` from ``turns(pair_id, side, turn, role, text)``.

    The prompt is the longest run of turns, from the first, that both sides have alike (role and text); it is rendered once. What
    follows is rendered for each side as its completion. A row is one rendered turn; strings joined in order of ``turn`` give the
    prompt and the completions, and no conversation has to fit into one task. The loss is taken on characters ``loss_from`` up to
    ``loss_to`` of a row: what an assistant says in a completion and the closing mark; elsewhere both are 0. ``n_common`` counts
    the turns of the prompt.

    Texts and roles are rendered as they are: one that holds the marks ``<|im_start|>`` or ``<|im_end|>`` looks like further turns to
    who reads only the joined string. Rows are turns whatever they hold, and ``loss_from`` and ``loss_to`` are of whole rows, so a mark
    in a text moves no loss.

    Rows that repeat are one; different rows of one turn are alike only if all are, and follow each other by role and text. A side
    that is missing has no turns, so nothing is common. Identical sides are all prompt. Null turns come first, as -1; null roles
    and texts are empty; rows with a null pair or another side than chosen or rejected are of no pair and left out.
    """
    clean = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    clean = clean.select("pair_id", "side", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).distinct()

    def side(name: str, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == name, what)), F.lit(0).cast("decimal(38,0)"))

    marks = [F.lit(1).cast("decimal(38,0)"), F.xxhash64("role", "text").cast("decimal(38,0)"), F.xxhash64("text", "role", F.lit(7)).cast("decimal(38,0)")]
    alike = F.lit(True)
    for mark in marks:
        alike = alike & (side("chosen", mark) == side("rejected", mark))
    by_turn = clean.groupBy("pair_id", "turn").agg(alike.alias("alike"))
    split = by_turn.groupBy("pair_id").agg(F.min(F.when(~F.col("alike"), F.col("turn"))).alias("split"))
    split = split.join(by_turn, "pair_id").groupBy("pair_id", "split").agg(F.count(F.when(F.col("split").isNull() | (F.col("turn") < F.col("split")), 1)).alias("n_common"))
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    rows = clean.join(split, "pair_id").where(~common | (F.col("side") == "chosen"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"))
    spoken = ~common & (F.col("role") == "assistant")
    begin = F.when(spoken, F.length(head)).otherwise(0)
    return rows.select(
        "pair_id",
        F.when(common, "prompt").otherwise(F.col("side")).alias("part"),
        "turn",
        "n_common",
        F.concat(head, F.col("text"), F.lit(f"{CLOSE}\n")).alias("rendered"),
        begin.cast("long").alias("loss_from"),
        F.when(spoken, begin + F.length("text") + len(CLOSE)).otherwise(0).cast("long").alias("loss_to"),
    )


CHAT_SQL = """
with t as (select distinct conv_id // 2 as pair_id, case when conv_id % 2 = 0 then 'chosen' else 'rejected' end as side, coalesce(turn, -1) as turn,
  coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
b as (select pair_id, turn, list([role, text] order by role, text) filter (side = 'chosen') is not distinct from
  list([role, text] order by role, text) filter (side = 'rejected') as alike from t group by all),
s as (select pair_id, min(turn) filter (not alike) as split from b group by all),
n as (select pair_id, split, count(*) filter (split is null or turn < split) as n_common from s join b using (pair_id) group by all),
r as (select *, split is null or turn < split as common from t join n using (pair_id))
select pair_id, case when common then 'prompt' else side end as part, turn, n_common,
  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as rendered,
  case when not common and role = 'assistant' then 13 + length(role) else 0 end::bigint as loss_from,
  case when not common and role = 'assistant' then 23 + length(role) + length(text) else 0 end::bigint as loss_to
from r where not common or side = 'chosen'
"""
