"""Dataset assembly: filters, joins, deduplication, exact samples, splits, allocation. Order is always an explicit column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.operators.coerce import flag_of


def union_widening(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.withColumn(column, F.lit(value))


def keep_split(df: DataFrame, split: str, column: str = "split_name") -> DataFrame:
    return df.where(F.col(column) == split)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def base_negatives(df: DataFrame, manual: str = "is_hallucination_manual") -> DataFrame:
    """Weakly labelled 0 and not overruled by hand."""
    overruled = F.coalesce(flag_of(F.col(manual)) == 1, F.lit(False)) if manual in df.columns else F.lit(False)
    return df.where((F.col("weak_label") == 0) & ~overruled)


def manual_rows(df: DataFrame, positive: bool, manual: str = "is_hallucination_manual") -> DataFrame:
    return df.where(flag_of(F.col(manual)) == int(positive))


def generation_candidates(df: DataFrame, split: str | None, order: list[str], limit: int) -> DataFrame:
    """The first rows, by an explicit order, that may get generated errors: of the split, weakly 0, not labelled 1 by hand."""
    out = df.where(F.col("split_name") == split) if split and "split_name" in df.columns else df
    if "weak_label" in df.columns:
        out = out.where(F.col("weak_label") == 0)
    if "is_hallucination_manual" in df.columns:
        out = out.where(F.col("is_hallucination_manual").isNull() | (flag_of(F.col("is_hallucination_manual")) == 0))
    return out.orderBy(*order).limit(limit)


def negatives_by_reason(df: DataFrame, reasons: list[str]) -> DataFrame:
    return df.where((F.col("effective_label") == 0) & F.coalesce(F.col("weak_label_reason"), F.lit("")).isin(reasons))


def base_negative_labels(df: DataFrame) -> DataFrame:
    """Rows labelled 0 by whichever label column there is."""
    for c in ("weak_label", "is_hallucination"):
        if c in df.columns:
            return df.where(F.col(c).cast("string").try_cast("double") == 0)
    raise ValueError("neither weak_label nor is_hallucination")


def short_answer(c: Column, characters: int = 40, words: int = 5) -> Column:
    return (F.length(c) <= characters) & (F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")) <= words)


def hard_row(df: DataFrame, lex) -> Column:  # noqa: ANN001
    """Whether golds hold years, decimals, quantities or two capitalised names, the question asks for such, or the context has long numbers."""
    golds = F.array_join(F.filter("gold_answers_text", lambda g: F.trim(g) != ""), " | ")
    units = "|".join(lex.units)
    quantity = golds.rlike(rf"(?iuU)\d{{4}}|\d+[.,]\d+|\d+ (?:{units})")
    asked = F.coalesce(F.col("question"), F.lit("")).rlike(f"(?iu)(?:{'|'.join(lex.hard_questions)})")
    long = F.coalesce(F.col("context"), F.lit("")).rlike(r"(?U)\d{4,}")
    return quantity | asked | long | golds.rlike("[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+")


def excluding(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key isn't in ``other``. Null keys are kept, and null keys of ``other`` exclude nothing.

    No hint: adaptive execution broadcasts the exclusions when they turn out small and splits hot keys when not.
    """
    return df.join(other.select(*keys).dropna().distinct(), keys, "left_anti")


def with_types(df: DataFrame, types: list[str], column: str = "hallucination_type") -> DataFrame:
    """Every row with every type."""
    return df.withColumn(column, F.explode(F.array(*map(F.lit, types))))


def row_ids(df: DataFrame, order: list[str], start: int = 0, name: str = "_row_id") -> DataFrame:
    """Consecutive numbers in the given order, without sorting everything into one task.

    Rows are range-partitioned by the order and written, with the number of their partition; each partition numbers its own after
    the counts of those before it, which are few. Counts and numbers are read from what was written, so they agree even when
    rows tie or an executor is lost.
    """
    from candor.sources.io import staged

    cols = [F.col(c) for c in order]
    spread = df.repartitionByRange(*cols).withColumn("_p", F.spark_partition_id()).withColumn("_u", F.monotonically_increasing_id())
    spread = staged(spread, "row-ids")
    counts = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_p", (F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*cols, "_u"))
    out = spread.withColumn("_k", local).join(F.broadcast(base), "_p")
    return out.withColumn(name, F.col("_k") + F.col("_base") - 1 + start).drop("_u", "_p", "_k", "_base")


def first_per_key(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; null is a key like any other.

    An aggregate with partial minima, not a window: a hot key doesn't gather in one task.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rank = [f"_o{i}" for i in range(len(order))]
    d = df.select(*[(k if isinstance(k, Column) else F.col(k)).alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*[(o if isinstance(o, Column) else F.col(o)).alias(n) for o, n in zip(order, rank, strict=True)]).alias("_o"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_r"))
    return d.groupBy(*names).agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def head_per_group(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def draw(key: str, seed: int) -> Column:
    """A hash of the key and the seed: the same order everywhere, in any engine with MD5."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def mark_least(df: DataFrame, key: str, wanted: dict, group: str | None = None, seed: int = 42, name: str = "_chosen") -> DataFrame:
    """``df`` and whether a row is among the ``wanted`` least, by hash then key, of its group (of all rows: ``{None: n}``).

    Rows are counted per group and first four digits of the hash; a prefix sum over these at most 65,536 counts a group finds the
    digits at which the wanted number is reached. Rows below are chosen and rows above not, without a shuffle; only those with
    just these digits are ranked. Groups are few and known to the caller.
    """
    hashed = draw(key, seed)
    digits = F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    d = df.withColumn("_h", hashed).withColumn("_d", digits).withColumn("_g", F.col(group) if group else F.lit(None).cast("string"))
    want = F.lit(0).cast("long")
    for g, n in wanted.items():
        want = F.when(F.col("_g").eqNullSafe(F.lit(g)), F.lit(int(n))).otherwise(want)
    counts = d.groupBy("_g", "_d").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = counts.withColumn("_upto", upto).withColumn("_w", want).where((F.col("_upto") >= F.col("_w")) & (F.col("_upto") - F.col("_n") < F.col("_w")))
    cut = cut.select(F.col("_g").alias("_cg"), F.col("_d").alias("_cd"), (F.col("_w") - F.col("_upto") + F.col("_n")).alias("_need"))
    d = d.withColumn("_w", want).join(F.broadcast(cut), F.col("_g").eqNullSafe(F.col("_cg")), "left")
    rank = F.row_number().over(Window.partitionBy("_g").orderBy("_h", key))
    edge = F.coalesce(F.col("_d") == F.col("_cd"), F.lit(False))
    clear = d.where(~edge).withColumn(name, (F.col("_w") > 0) & (F.col("_cd").isNull() | (F.col("_d") < F.col("_cd"))))
    tied = d.where(edge).withColumn(name, rank <= F.col("_need"))
    return clear.unionByName(tied).select(*[F.col(f"`{c}`") for c in df.columns], name)


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42, strict: bool = True) -> DataFrame:
    """Exactly ``n`` rows, the least by hash; an error if there are fewer, unless not strict. No sort of the table, whatever ``n``."""
    if strict and (have := df.count()) < n:
        raise ValueError(f"{n} rows asked for, {have} there")
    return mark_least(df, key, {None: n}, seed=seed).where("_chosen").drop("_chosen")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(key, seed), key)


def half_even(x: float) -> int:
    return int(round(x))


def _split(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col("_chosen"), "validation").otherwise("train")).drop("_chosen")


def random_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42, column: str = "split_name") -> DataFrame:
    """``round(n share)`` rows (half to even, at least one of two or more) are validation, by hash."""
    total = df.count()
    n = max(1, half_even(total * share)) if total > 1 else 0
    return _split(mark_least(df, key, {None: n}, seed=seed), column)


def apportion(counts: dict, total: int) -> dict:
    """Shares of ``total`` in proportion to counts: floors, then the largest remainders, ties by greater name, never above a count."""
    everything = sum(counts.values())
    if total <= 0 or not everything:
        return dict.fromkeys(counts, 0)
    if total >= everything:
        return dict(counts)
    raw = {k: total * c / everything for k, c in counts.items()}
    out = {k: min(int(raw[k]), counts[k]) for k in counts}
    for _, k in sorted(((raw[k] - out[k], k) for k in counts), reverse=True):
        if sum(out.values()) >= total:
            break
        if out[k] < counts[k]:
            out[k] += 1
    return out


def sample_by_group(df: DataFrame, group: str, key: str, wanted: dict, seed: int = 42) -> DataFrame:
    """The least rows by hash of each group, as many as wanted, in one pass; groups are few and known to the caller."""
    return mark_least(df, key, wanted, group, seed).where("_chosen").drop("_chosen")


def proportional_sample(df: DataFrame, group: str, key: str, total: int, seed: int = 42) -> DataFrame:
    counts = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    return df if total >= sum(counts.values()) else sample_by_group(df, group, key, apportion(counts, total), seed)


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42, column: str = "split_name") -> DataFrame:
    """Validation rows in proportion to labels, ``ceil(n share)`` in all; a null label is an error."""
    from math import ceil

    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if None in counts:
        raise ValueError(f"null in {label}")
    return _split(mark_least(df, key, apportion(counts, ceil(sum(counts.values()) * share)), label, seed), column)


def synthetic_ids(df: DataFrame, base_numeric: bool, order: list[str]) -> DataFrame:
    """Ids of synthetic rows: -1, -2, ... beside numeric ids (the old one in ``source_id_original``), else a text with the source id."""
    d = row_ids(df, order, start=1, name="_i")
    if base_numeric:
        return d.withColumn("source_id_original", F.col("source_id")).withColumn("id", -F.col("_i")).drop("_i")
    return d.withColumn("id", F.concat_ws("_", F.lit("synthetic"), F.col("source_id").cast("string"), F.col("_i").cast("string"))).drop("_i")


def target_counts(positives: int, ratio: float = 4.0) -> int:
    return half_even(positives * ratio)
