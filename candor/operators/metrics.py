"""Ranking metrics and counts. Only grouped sums cross the network; tied scores are one threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Distinct scores per bucket of the running sums.
BUCKETS = 1024


def value_counts(df: DataFrame, *columns: str, keep_nulls: bool = True, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties by value; null is a value unless dropped."""
    d = df if keep_nulls else df.dropna(subset=list(columns))
    out = d.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *[F.asc_nulls_first(c) for c in columns])
    return out.limit(top) if top else out


def label_counts(df: DataFrame, label: str) -> DataFrame:
    x = F.col(label)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(x == 1).alias("positives"), F.count_if(x == 0).alias("negatives"), F.count(x).alias("labelled"))


def _bucket(score: Column, bounds: Column) -> Column:
    """How many of the ascending ``bounds`` are below ``score``, by bisection."""
    step = F.sequence(F.lit(1), F.lit(BUCKETS.bit_length()))
    whole = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def halve(r: Column, _: Column) -> Column:
        mid = F.floor((r["lo"] + r["hi"]) / 2).cast("int")
        right = F.get(bounds, mid) < score
        return F.when(r["lo"] >= r["hi"], r).otherwise(F.struct(F.when(right, mid + 1).otherwise(r["lo"]).alias("lo"), F.when(right, r["hi"]).otherwise(mid).alias("hi")))

    return F.coalesce(F.aggregate(step, whole, halve, lambda r: r["lo"]), F.lit(0))


def _thresholds(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """Per distinct score: positives and rows at it, and at and above it.

    Running sums go over (bucket, score): a window within each bucket, and a window over one row per bucket, so the sort isn't
    done in a single task. Bucket bounds are approximate quantiles of the distinct scores, so buckets hold about as many distinct
    scores each however the scores lie.
    """
    by = df.select(label.cast("long").alias("y"), score.cast("double").alias("s")).groupBy("s").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    at = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    ends = by.agg(F.array_sort(F.array_distinct(F.percentile_approx("s", at, 10 * BUCKETS))).alias("bounds"))
    spread = by.crossJoin(F.broadcast(ends)).withColumn("b", _bucket(F.col("s"), F.col("bounds"))).drop("bounds")
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    base = sums.select("b", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"))
    within = Window.partitionBy("b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = spread.withColumn("cp", F.sum("pos").over(within)).withColumn("cn", F.sum("n").over(within))
    return inside.join(F.broadcast(base), "b").select("s", "pos", "n", (F.col("cp") + F.col("p0")).alias("cum_pos"), (F.col("cn") + F.col("n0")).alias("cum_n"))


def ranking_metrics(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row: ``pr_auc`` (average precision over distinct thresholds) and ``roc_auc`` (tied pairs count one half).

    Null where they are undefined: without positives, and for the second also without negatives.
    """
    t = _thresholds(df, label, score)
    pos, neg, cum_neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos")), F.col("cum_n") - F.col("cum_pos")
    # positives at a threshold outrank the negatives strictly below it; those at it count half
    wins = F.sum(F.col("pos") * (F.col("cum_pos") * 0 - cum_neg + (F.col("n") - F.col("pos")) / 2.0))
    ap = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    got = t.agg(pos.alias("p"), neg.alias("q"), ap.alias("ap"), wins.alias("w"))
    p, q = F.col("p"), F.col("q")
    return got.select(F.when(p > 0, F.col("ap") / p).alias("pr_auc"), F.when((p > 0) & (q > 0), (p * q + F.col("w")) / (p * q)).alias("roc_auc"))


def threshold_metrics(df: DataFrame, label: Column, score: Column, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 of ``score >= threshold``; a zero denominator gives 0."""
    d = df.select(label.cast("int").alias("y"), (score >= threshold).cast("int").alias("p"))
    got = d.agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"), F.sum("p").alias("called"), F.sum("y").alias("true"), F.count_if(F.col("y") == F.col("p")).alias("right"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, called, true = F.col("tp"), F.col("called"), F.col("true")
    return got.select("rows", F.lit(threshold).alias("threshold"), ratio(F.col("right"), F.col("rows")).alias("accuracy_at_threshold"), ratio(tp, called).alias("precision_at_threshold"), ratio(tp, true).alias("recall_at_threshold"), ratio(2 * tp, called + true).alias("f1_at_threshold"))


def evaluate(df: DataFrame, label: Column, score: Column, threshold: float = 0.5) -> DataFrame:
    """All six metrics in one row."""
    return threshold_metrics(df, label, score, threshold).crossJoin(ranking_metrics(df, label, score))
