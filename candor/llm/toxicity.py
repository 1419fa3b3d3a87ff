"""Toxicity: cumulative-link ordinal regression on sparse lexical features, giving expected severity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.features import BITS, fit_in_one_task, in_pieces, lexical_features, row_sums, training_sample
from candor.llm.runtime import lean, text_of
from candor.llm.textkit import pieces

#: Severity grades 0 (clean) to GRADES - 1.
GRADES = 4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def telling(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, dims: int, z: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each feature for the toxic label, and whether they are more than ``z`` standard errors above 0.

    Only these features enter the model: the many words of a long clean text then can't add up to a score of either sign.
    """
    seen = np.zeros((2, dims))
    for (cols, _), y in zip(rows, toxic, strict=True):
        seen[int(y), cols] += 1
    n = np.array([[(toxic == 0).sum()], [(toxic == 1).sum()]])
    a, b = seen + 0.5, n - seen + 0.5
    odds = np.log(a[1] / b[1]) - np.log(a[0] / b[0])
    return odds, odds > z * np.sqrt((1 / a + 1 / b).sum(axis=0))


def severity_grades(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, kept: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades for rows that only carry a yes-or-no label: 0 if not toxic, else 1 and up by terciles of marker density.

    The markers are the kept features. A toxic row without any is of grade 1. A limit of labels that only say yes or no: grades
    above 1 rank toxic documents by how dense in telling words they are, which the labels themselves don't judge; only the step
    from 0 to 1 is a human decision. Give ``ordinal_fit`` graded labels where there are any.
    """
    density = np.array([values[kept[cols]].sum() / max(values.sum(), 1.0) for cols, values in rows])
    found = density[(toxic == 1) & (density > 0)]
    cuts = np.quantile(found, np.arange(1, grades - 1) / (grades - 1)) if len(found) else np.full(grades - 2, np.inf)
    return np.where(toxic == 0, 0, 1 + np.searchsorted(cuts, density, side="left")).astype(int)


def ordinal_fit(rows: list[np.ndarray], grade: np.ndarray, dims: int, grades: int = GRADES, alpha: float = 0.3, l1: float = 0.5, l2: float = 0.02, epochs: int = 10) -> np.ndarray:
    """Weights shared by all thresholds, then the thresholds in increasing order: P(grade > k) = sigmoid(w.x - threshold k).

    Maximum likelihood of the cumulative-link model by online updates per coordinate; ``l1`` leaves features that say nothing at 0.
    """
    z, n = np.zeros(dims), np.zeros(dims)
    cuts, pace = np.linspace(1.0, 3.0, grades - 1), np.full(grades - 1, 1.0)
    for _ in range(epochs):
        for i, y in zip(rows, grade, strict=True):
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(ni)) / alpha + l2))
            above = np.concatenate([[1.0], _sigmoid(w.sum() - cuts), [0.0]])
            slope = above * (1 - above)
            p = max(above[y] - above[y + 1], 1e-9)
            # d(-log p): the margin moves both bounds of the observed grade, a threshold only its own
            g = -(slope[y] - slope[y + 1]) / p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - sigma * w
            n[i] = ni + g * g
            for k, gk in ((y - 1, slope[y] / p), (y, -slope[y + 1] / p)):
                if 0 <= k < grades - 1:
                    pace[k] += gk * gk
                    cuts[k] -= 0.3 * gk / np.sqrt(pace[k])
            cuts = np.maximum.accumulate(cuts + np.arange(grades - 1) * 1e-6)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / alpha + l2))
    return np.concatenate([w, cuts])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8192, bits: int = BITS) -> np.ndarray:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold. Without labels every document is of grade 0."""
    dims = 1 << bits

    def fit(table: pa.Table | None) -> bytes:
        rows, toxic = [], []
        for texts, y in in_pieces(table) if table is not None else ():
            starts, cols, counts = lexical_features(texts, bits)
            rows += [(cols[a:b], counts[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            toxic.append(y)
        if not rows:
            return np.concatenate([np.zeros(dims), np.full(GRADES - 1, 35.0)]).astype("<f8").tobytes()
        _, kept = telling(rows, y := np.concatenate(toxic), dims)
        return ordinal_fit([cols[kept[cols]] for cols, _ in rows], severity_grades(rows, y, kept), dims).astype("<f8").tobytes()

    return np.frombuffer(fit_in_one_task(training_sample(docs, labels, "toxic", max_rows), fit), "<f8")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 8192, bits: int = BITS) -> DataFrame:
    """``doc_id, held_out, expected_severity, severity, p_toxic, toxic`` for every row of ``docs``.

    ``expected_severity`` is the mean grade (0 to 3; see ``severity_grades`` for what grades mean), ``severity`` the likeliest, ``p_toxic`` the chance of a grade above 0 and
    ``toxic`` whether that reaches ``threshold``. Null and empty texts have no features and get the base rate. Repeated rows are
    scored each; other columns are ignored; no rows give no rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, max_rows, bits))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = weights.value[: 1 << bits], weights.value[1 << bits :]
        for batch in batches:
            texts = batch.column(1)
            for a, b in pieces(texts):
                above = _sigmoid(row_sums(w, lexical_features(texts.slice(a, b - a), bits), binary=True)[:, None] - cuts)
                each = -np.diff(np.hstack([np.ones((b - a, 1)), above, np.zeros((b - a, 1))]), axis=1)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0])], ["doc_id", "expected_severity", "severity", "p_toxic"])

    scored = docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, "doc_id long, expected_severity double, severity int, p_toxic double")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "expected_severity", "severity", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic"))
