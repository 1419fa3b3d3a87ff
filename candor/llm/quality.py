"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.features import BITS, fit_in_one_task, in_pieces, quality_features, row_sums, training_sample
from candor.llm.runtime import lean, text_of
from candor.llm.textkit import pieces


def ftrl_fit(rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, epochs: int = 4) -> np.ndarray:
    """Weights of a logistic regression after per-coordinate FTRL-proximal updates, one example at a time.

    ``rows`` are (columns, values, label); the last weight is the intercept, which is not regularised by ``l1``.
    """
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)

    def weights(i: np.ndarray, zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        penalty = np.where(i == dims, 0.0, l1)
        w = -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= penalty, 0.0, w)

    for _ in range(epochs):
        for cols, values, y in rows:
            i, x = np.append(cols, dims), np.append(values, 1.0)
            zi, ni = z[i], n[i]
            w = weights(i, zi, ni)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - sigma * w
            n[i] = ni + g * g
    return weights(np.arange(dims + 1), z, n)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 8192, bits: int = BITS) -> np.ndarray:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold. Without labels all weights are 0 and scores 0.5."""

    def fit(table: pa.Table | None) -> bytes:
        rows = []
        for texts, y in in_pieces(table) if table is not None else ():
            starts, cols, values = quality_features(texts, bits)
            rows += [(cols[a:b], values[a:b], int(k)) for a, b, k in zip(starts[:-1], starts[1:], y, strict=True)]
        return ftrl_fit(rows, 1 << bits).astype("<f8").tobytes()

    return np.frombuffer(fit_in_one_task(training_sample(docs, labels, "quality", max_rows), fit), "<f8")


def score_quality(docs: DataFrame, weights: np.ndarray, bits: int = BITS, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``quality_score``, between 0 and 1. Null and empty texts get the score of no features."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    name = "quality_score"
    kept = [c for c in docs.columns if c != name]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], text_of(f"`{text}`").alias("_scored_text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in pieces(texts):
                margin = row_sums(w, quality_features(texts.slice(a, b - a), bits)) + w[-1]
                score = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(score)], names=[*kept, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return source.mapInArrow(run, StructType([*(docs.schema[c] for c in kept), StructField(name, DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 8192) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; only the text is an input of the score.

    A null id is not held out. Repeated rows are scored each; other columns are ignored; no rows give no rows.
    """
    weights = fit_quality(docs, labels, max_rows)
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), weights)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
