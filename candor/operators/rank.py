"""Percentile ranks, rank averages, blends, and features of component scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions import arrays as A
from candor.operators.metrics import _thresholds


def percentile_rank(df: DataFrame, score: str, name: str | None = None) -> DataFrame:
    """Add the average rank of ties over the number of non-null scores; null stays null.

    Ranks come from running counts per distinct score, computed in buckets, and are joined back by score.
    """
    name = name or f"{score}_rank"
    given = df.where(F.col(score).isNotNull())
    t = _thresholds(given, F.lit(0), F.col(score))
    total = given.agg(F.count(F.lit(1)).alias("_all"))
    rank = t.crossJoin(F.broadcast(total)).select(F.col("s").alias("_s"), ((F.col("_all") - F.col("cum_n") + (F.col("n") + 1) / 2.0) / F.col("_all")).alias(name))
    return df.join(rank, F.col(score).cast("double") == F.col("_s"), "left").drop("_s")


def rank_average(frames: list[DataFrame], key: str, score: str, weights: list[float] | None = None, name: str = "ensemble_score") -> DataFrame:
    """Weighted mean of percentile ranks of the same rows scored by several models, joined by key."""
    weights = parse_weights(weights, len(frames))
    ranked = [percentile_rank(f.select(key, F.col(score).alias(f"_s{i}")), f"_s{i}", f"rank_{i}").select(key, f"rank_{i}") for i, f in enumerate(frames)]
    joined = reduce(lambda a, b: a.join(b, key), ranked)
    total = reduce(lambda a, b: a + b, (F.col(f"rank_{i}") * w for i, w in enumerate(weights)))
    return joined.withColumn(name, total / sum(weights))


def parse_weights(weights: str | list[float] | None, n: int) -> list[float]:
    """Weights from a comma list, all 1 by default; their number must be that of the inputs."""
    if weights is None or weights == "":
        return [1.0] * n
    out = [float(w) for w in (weights.split(",") if isinstance(weights, str) else weights)]
    if len(out) != n:
        raise ValueError(f"{len(out)} weights for {n} inputs")
    return out


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The i-th row of one with the i-th of the other, by explicit orders; an error if they differ in length."""
    from candor.operators.assemble import row_ids

    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows against {b}")
    return row_ids(left, left_order, name="_at").join(row_ids(right, right_order, name="_at"), "_at").drop("_at")


def blend(scores: dict[str, Column], spec: list[dict]) -> Column:
    """Weighted mean of named scores, each turned around where the spec says ``invert``; 0 for an empty spec."""
    parts = [(float(s["weight"]), 1.0 - scores[s["name"]] if s.get("invert") else scores[s["name"]]) for s in spec]
    total = sum(w for w, _ in parts)
    return reduce(lambda a, b: a + b, (F.lit(w) * x for w, x in parts)) / total if total else F.lit(0.0)


def meta_features(scores: dict[str, Column]) -> dict[str, Column]:
    """The component scores and their mean, population deviation, extremes, range, and gaps of two known pairs."""
    out = {f"score::{k}": v.cast("double") for k, v in scores.items()}
    arr = F.array(*out.values()) if out else F.array().cast("array<double>")
    out |= {"meta::mean": A.mean(arr), "meta::std": A.std(arr), "meta::min": A.low(arr), "meta::max": A.high(arr), "meta::range": A.high(arr) - A.low(arr)}
    for name, a, b in (("meta::qa_gap_v1_v2", "qa_consistency_v1", "qa_consistency_v2"), ("meta::mid3_realv1_gap", "internal_mid_v3", "internal_real_v1_nocontext")):
        if a in scores and b in scores:
            out[name] = scores[a].cast("double") - scores[b].cast("double")
    return out
