"""Reductions over token series and vectors held in arrays: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<double>")).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def or_zero(a: Column, value: Column) -> Column:
    return F.when(F.size(_d(a)) == 0, 0.0).otherwise(value)


def mean(a: Column) -> Column:
    return or_zero(a, total(_d(a)) / F.size(a))


def variance(a: Column) -> Column:
    """Population variance by Welford's recurrence, as SQL engines have it: one pass, with the mean carried along."""

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        m = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), m.alias("mean"), (s["squares"] + (x - m) * (x - s["mean"])).alias("squares"))

    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "mean", "squares")))
    return or_zero(a, F.aggregate(_d(a), zero, step, lambda s: s["squares"] / s["n"]))


def std(a: Column) -> Column:
    return F.sqrt(variance(a))


def low(a: Column) -> Column:
    return or_zero(a, F.array_min(_d(a)))


def high(a: Column) -> Column:
    return or_zero(a, F.array_max(_d(a)))


def percentile(a: Column, q: float) -> Column:
    """Linear interpolation between the two nearest ranks; ``q`` in 0..100."""
    s = F.array_sort(_d(a))
    at = (F.size(a) - 1) * F.lit(q / 100.0)
    lo = F.floor(at).cast("int")
    x, y = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(a) - 1))
    return or_zero(a, x + (y - x) * (at - lo))


def window_means(a: Column, n: int) -> Column:
    """Means of all windows of ``n``; of the whole array where it is shorter."""
    k = F.greatest(F.size(a) - n + 1, F.lit(1))
    width = F.least(F.size(a), F.lit(n))
    return F.transform(F.sequence(F.lit(1), k), lambda i: total(F.slice(_d(a), i, width)) / width)


def max_window_mean(a: Column, n: int) -> Column:
    return or_zero(a, F.array_max(window_means(a, n)))


def min_window_mean(a: Column, n: int) -> Column:
    return or_zero(a, F.array_min(window_means(a, n)))


def max_drop(a: Column) -> Column:
    """The largest fall from one element to the next; 0 if there is none."""
    n = F.size(a) - 1
    falls = F.zip_with(F.slice(_d(a), F.lit(1), F.greatest(n, F.lit(0))), F.slice(_d(a), F.lit(2), F.greatest(n, F.lit(0))), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    return F.when(n < 1, 0.0).otherwise(F.array_max(falls))


def tail_degradation(a: Column, share: float = 0.3) -> Column:
    """Mean of the first part minus mean of the last part; each is ``share`` of the array, at least one element."""
    k = F.greatest(F.lit(1), F.ceil(F.size(a) * F.lit(share)).cast("int"))
    return or_zero(a, total(F.slice(_d(a), F.lit(1), k)) / k - total(F.slice(_d(a), F.size(a) - k + 1, k)) / k)


def first_mean(a: Column, n: int) -> Column:
    return mean(F.slice(_d(a), 1, n))


def series_statistics(a: Column, prefix: str) -> dict[str, Column]:
    """Mean, deviation, least and greatest of a series, named after it; 0 where it is empty."""
    return {f"{prefix}_mean": mean(a), f"{prefix}_std": std(a), f"{prefix}_min": low(a), f"{prefix}_max": high(a)}


def response_statistics(logprobs: Column, entropies: Column, top1_match: Column, top1_prob: Column) -> dict[str, Column]:
    """What the log-probabilities, entropies and top-1 data of a response's tokens amount to; all 0 for an empty response."""
    return (
        series_statistics(logprobs, "token_logprob")
        | series_statistics(entropies, "token_entropy")
        | {
            "logprob_min": low(logprobs),
            "logprob_p05": percentile(logprobs, 5),
            "logprob_p10": percentile(logprobs, 10),
            "logprob_max_drop": or_zero(logprobs, max_drop(logprobs)),
            "logprob_tail_degradation": tail_degradation(logprobs),
            "worst_span_logprob_mean": min_window_mean(logprobs, 5),
            "entropy_max_window_3": max_window_mean(entropies, 3),
            "entropy_max_window_5": max_window_mean(entropies, 5),
            "entropy_variance": variance(entropies),
            "worst_span_entropy_mean": max_window_mean(entropies, 5),
            "first_5_tokens_entropy": first_mean(entropies, 5),
            "top1_match_rate": mean(top1_match),
            "top1_prob_mean": mean(top1_prob),
        }
    )


def layer_agreement(last: Column, mid: Column, early: Column) -> dict[str, Column]:
    """Cosines between the mean vectors of three layers, their spread, and one minus their mean."""
    pairs = {"last_mid_cos": cosine(last, mid), "last_early_cos": cosine(last, early), "mid_early_cos": cosine(mid, early)}
    values = list(pairs.values())
    return pairs | {"hidden_state_cosine_diff": F.greatest(*values) - F.least(*values), "layer_disagreement_score": 1 - (values[0] + values[1] + values[2]) / 3}


def question_part(vectors: Column, response_start: Column, most: int = 50) -> Column:
    """The vectors of the first prompt tokens, at most ``most`` and none of the response's: what stands for the question."""
    return F.slice(vectors, F.lit(1), F.least(F.lit(most), F.greatest(response_start, F.lit(0))).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or of norm 0."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(_d(a)) == 0) | (F.size(_d(b)) == 0) | (size == 0), 0.0).otherwise(dot(a, b) / size), F.lit(0.0))


def kl_divergence(later: Column, earlier: Column) -> Column:
    """Sum of q (log q - log p), with q the later of two probability arrays; terms with q = 0 are 0."""
    return total(F.zip_with(_d(later), _d(earlier), lambda q, p: F.when(q == 0, 0.0).otherwise(q * (F.log(q) - F.log(p)))))


def entropy(p: Column) -> Column:
    return total(F.transform(_d(p), lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(_d(logits))
    norm_ = F.log(total(F.transform(_d(logits), lambda x: F.exp(x - top)))) + top
    return F.transform(_d(logits), lambda x: x - norm_)


def find_subsequence(ids: Column, part: Column) -> Column:
    """0-based position of the first occurrence of ``part`` in ``ids``; -1 where there is none or ``part`` is empty."""
    n = F.size(part)
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - n, F.lit(0)))
    hit = F.filter(starts, lambda i: F.slice(ids, i + 1, n) == part)
    return F.when((n < 1) | (n > F.size(ids)), -1).otherwise(F.coalesce(F.get(hit, 0), F.lit(-1)))


def token_statistics(logits: Column, labels: Column) -> Column:
    """Per position of an array of logit arrays: log-probability of the label, entropy, whether the label is top, top probability."""

    def one(row: Column, i: Column) -> Column:
        lp = log_softmax(row)
        y = F.get(labels, i)
        return F.struct(F.get(lp, y).alias("logprob"), entropy(F.transform(lp, F.exp)).alias("entropy"), (F.array_position(_d(row), F.array_max(_d(row))) - 1 == y).cast("double").alias("top1_match"), F.exp(F.array_max(lp)).alias("top1_prob"))

    return F.transform(logits, one)


def response_slice(series: Column, total_tokens: Column, response_tokens: Column) -> Column:
    """The part of a series of next-token predictions that belongs to the response: it begins one before the response does.

    The response begins at ``max(1, total - response)``, as the first token of all is never predicted.
    """
    start = F.greatest(F.lit(1), total_tokens - response_tokens)
    return F.slice(series, start.cast("int"), F.greatest(F.size(series) - start.cast("int") + 1, F.lit(0)))


def layer_picks(n_states: Column) -> Column:
    """Which of the hidden states are looked at: early, middle, three lens layers, last; never beyond the last."""
    last = n_states - 1
    at = lambda k: F.greatest(F.lit(0), F.least(F.lit(k), last)).cast("int")
    return F.struct(at(8).alias("early"), F.floor(n_states / 2).cast("int").alias("mid"), at(10).alias("l10"), at(20).alias("l20"), at(30).alias("l30"), last.cast("int").alias("last"))


def lens_summary(entropies: Column, top1: Column) -> dict[str, Column]:
    """Fall of the mean entropy from the first lens layer to the last, and deviation of the mean top probabilities."""
    return {"logit_lens_early_late_entropy_gap": F.get(entropies, 0) - F.element_at(entropies, -1), "logit_lens_top1_prob_trajectory_std": std(top1)}


def logit_lens(head):  # noqa: ANN001, ANN201
    """An Arrow function from hidden vectors of the tokens of a response to mean entropy and mean top probability under ``head``.

    ``head`` is the output matrix (vocabulary times width), applied without a final norm; it is shipped once per worker.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import DoubleType, StructField, StructType

    kind = StructType([StructField("entropy", DoubleType()), StructField("top1_prob", DoubleType())])

    def lens(hidden: pd.Series) -> pd.DataFrame:
        def one(states) -> tuple[float, float]:  # noqa: ANN001
            if states is None or not len(states):
                return 0.0, 0.0
            z = np.stack(states).astype(float) @ np.asarray(head, float).T
            lp = z - z.max(axis=1, keepdims=True)
            lp -= np.log(np.exp(lp).sum(axis=1, keepdims=True))
            p = np.exp(lp)
            return float(-(p * lp).sum(axis=1).mean()), float(p.max(axis=1).mean())

        return pd.DataFrame([one(h) for h in hidden], columns=["entropy", "top1_prob"])

    lens.__annotations__ = {"hidden": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(lens, kind)
