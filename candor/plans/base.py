"""Registration of queries, the question-answer view of the test tables, and pieces of SQL that their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.functions.lexicon import EN
from candor.functions.text import PUNCTUATION
from candor.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that gives the same rows (None where SQL can't)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent user and assistant turns as question and answer; the document of the conversation's number is the context.

    One shuffle by conversation for the pairing. The golds are the answer's first five words and the question.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("model_answer"))
    pairs = t.where("role = 'user' and next_role = 'assistant'")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"), F.col("source").alias("title"))
    return pairs.join(docs, "conv_id", "left").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id",
        "turn",
        F.when(F.col("conv_id") % 5 == 0, "validation").otherwise("train").alias("split_name"),
        "title",
        F.col("text").alias("question"),
        "model_answer",
        "context",
        F.array(F.array_join(F.slice(F.split("model_answer", r"(?U)\s+"), 1, 5), " "), F.col("text")).alias("gold_answers_text"),
    )


QA = r"""t as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as model_answer from conversations
  window w as (partition by conv_id order by turn)),
qa as (select t.conv_id || '-' || t.turn as id, t.conv_id, t.turn, case when t.conv_id % 5 = 0 then 'validation' else 'train' end as split_name,
  d.source as title, t.text as question, t.model_answer, d.text as context,
  [array_to_string(list_slice(string_split_regex(t.model_answer, '\s+'), 1, 5), ' '), t.text] as gold_answers_text
  from t left join documents d on d.doc_id = t.conv_id where t.role = 'user' and t.next_role = 'assistant')"""


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def items(words: tuple[str, ...]) -> str:
    return ", ".join(lit(w) for w in words)


def norm(x: str) -> str:
    return rf"trim(translate(regexp_replace(translate(regexp_replace(lower(coalesce({x}, '')), '^\s+|\s+$', '', 'g'), 'ё', 'е'), '\s+', ' ', 'g'), {lit(PUNCTUATION)}, ''))"


def words(n: str) -> str:
    """Tokens of a normalised text."""
    return f"list_filter(string_split({n}, ' '), lambda w: w <> '')"


def toks(x: str) -> str:
    return words(norm(x))


def content(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: not list_contains([{items(EN.function_words)}], w))"


def f1(a: str, b: str) -> str:
    """Multiset F1 of two lists (of columns, as they are repeated)."""
    common = f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda w: least(len(list_filter({a}, lambda v: v = w)), len(list_filter({b}, lambda v: v = w))))), 0)"
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0::double else 2.0::double * {common} / (len({a}) + len({b})) end"


def phrase(n: str, phrases: tuple[str, ...], stems: tuple[str, ...] = (), anchored: bool = False) -> str:
    r"""Whole-word search in normalised text; engines differ on \b beyond ASCII, so borders are spelled out."""
    parts = [rf"(?:{'|'.join(phrases)})(?:$|[^\p{{L}}\p{{N}}_])"] * bool(phrases) + [rf"(?:{'|'.join(stems)})"] * bool(stems)
    start = "^" if anchored else r"(?:^|[^\p{L}\p{N}_])"
    return f"regexp_matches({n}, {lit(start + '(?:' + '|'.join(parts) + ')')})" if parts else "false"


def strip_words(n: str) -> str:
    """Normalised text without the function words it begins with."""
    return rf"regexp_replace(regexp_replace({n}, '\s+', ' ', 'g'), {lit('^(?:(?:' + '|'.join(EN.function_words) + ')(?: |$))+')}, '')"


def supported(n: str, ctx: str) -> str:
    core = strip_words(n)
    long = f"list_filter({words(core)}, lambda w: len(w) >= 4)"
    hits = f"len(list_filter({long}, lambda w: contains({ctx}, w)))"
    return f"case when {core} = '' or {ctx} = '' then false else contains({ctx}, {core}) or (len({long}) > 0 and {hits} >= greatest(1, len({long}) - 1)) end"


def numbers(x: str) -> str:
    return rf"regexp_extract_all(replace(coalesce({x}, ''), ',', '.'), '\d+(?:\.\d+)?')"


def years(x: str) -> str:
    return rf"regexp_extract_all(coalesce({x}, ''), '\b(1[0-9]{{3}}|20[0-9]{{2}}|21[0-9]{{2}})\b', 1)"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def sentences(x: str) -> str:
    return rf"len(list_filter(string_split_regex(coalesce({x}, ''), '[.!?]+'), lambda s: regexp_matches(s, '\S')))"


def first_sentence(x: str) -> str:
    s = strip(x)
    found = rf"case when regexp_matches({s}, '[.!?]\s') then regexp_extract({s}, '^((?s:.*?)[.!?])\s', 1) else {s} end"
    return strip(found)


def core(x: str) -> str:
    cut = r"(?is)(?:[ \t\r\n]*[,:;—-][ \t\r\n]+|[ \t\r\n]+(?:" + "|".join(EN.clause_words) + r")[ \t\r\n]+).*$"
    return strip(f"regexp_replace({first_sentence(x)}, {lit(cut)}, '')")


def jaccard(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"case when {both} = 0 then 0.0::double else len(list_intersect({a}, {b}))::double / {both} end"


def flag(x: str) -> str:
    return f"coalesce(({x})::int::double, 0)"
