"""Sparse hashed features of whole texts: word n-grams for quality, words and word beginnings for toxicity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.runtime import lean, text_of
from candor.llm.textkit import KIND, LOWER, joined, mix, pieces, powers, run_hashes

#: Feature spaces are of 2**BITS hashed dimensions.
BITS = 18
Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mix(h + np.uint64(salt * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))


def _pooled(doc: np.ndarray, hashes: np.ndarray, n_docs: int, bits: int) -> Sparse:
    """Row starts, column indices and counts of the matrix with a row per document."""
    key = (doc.astype(np.uint64) << np.uint64(bits)) | (hashes >> np.uint64(64 - bits))
    key, counts = np.unique(key, return_counts=True)
    rows = np.searchsorted(key, np.arange(n_docs + 1, dtype=np.uint64) << np.uint64(bits))
    return rows, (key & np.uint64((1 << bits) - 1)).astype(np.int64), counts.astype(np.float64)


def quality_features(texts: pa.Array, bits: int = BITS) -> Sparse:
    """Hashed unigrams and bigrams of words and of punctuation runs, and trigrams of their forms; counts in unit length.

    The form of a word is its case (lower, capitalised, all capitals) or "the same as one of the two tokens before", so copied
    words look alike whatever they are. A run of punctuation is its own form.
    """
    data, offsets = joined(texts)
    kind = KIND[data]
    starts, lengths, h = run_hashes(data, kind)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    if not len(h):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    upper = ((data >= 65) & (data <= 90)).view(np.uint8)
    # every text ends in a line feed, so no run reaches the end of the data
    capitals = np.add.reduceat(upper, np.stack([starts, starts + lengths], axis=1).ravel(), dtype=np.int64)[::2]
    form = np.where(capitals == 0, 1, np.where((capitals == lengths) & (lengths > 1), 3, 2)).astype(np.uint64)
    again = np.zeros(len(h), bool)
    two = doc[1:] == doc[:-1]
    three = doc[2:] == doc[:-2]
    again[1:] |= (h[1:] == h[:-1]) & two
    again[2:] |= (h[2:] == h[:-2]) & three
    form[again] = 4
    marks = kind[starts] == 2
    form[marks] = h[marks]
    parts = [(doc, _salted(h, 1)), (doc[1:][two], _salted(h[:-1] * np.uint64(3) + h[1:], 2)[two]), (doc, _salted(form, 3)), (doc[2:][three], _salted(mix(mix(form[:-2]) + form[1:-1]) + form[2:], 4)[three])]
    rows, cols, values = _pooled(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), len(texts), bits)
    size = np.diff(rows)
    norm = np.sqrt(np.add.reduceat(np.append(values**2, 0), rows)[:-1])
    return rows, cols, values / np.repeat(np.where(size > 0, norm, 1), size)


def lexical_features(texts: pa.Array, bits: int = BITS) -> Sparse:
    """Hashed presence of words and of word beginnings of 4 to 9 bytes, which inflected forms share; counts of occurrence."""
    data, offsets = joined(texts)
    kind = (KIND[data] == 1).astype(np.uint8)
    starts, lengths, h = run_hashes(data, kind)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    parts = [(doc, _salted(h, 5))]
    pw = powers(16)
    for n in range(4, 10):
        long = lengths >= n
        at = starts[long]
        begin = sum((LOWER[data[at + k]].astype(np.uint64) + np.uint64(1)) * pw[k] for k in range(n)) if len(at) else np.zeros(0, np.uint64)
        parts.append((doc[long], _salted(mix(begin), 5 + n)))
    return _pooled(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), len(texts), bits)


def row_sums(weights: np.ndarray, m: Sparse, binary: bool = False) -> np.ndarray:
    """The sparse dot product of each row with ``weights``; a row's sum doesn't depend on the rows beside it."""
    rows, cols, values = m
    terms = np.append(weights[cols] if binary else weights[cols] * values, 0.0)
    return np.where(np.diff(rows) > 0, np.add.reduceat(terms, rows)[:-1], 0.0)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int = 1) -> DataFrame:
    """``doc_id, text, y`` of at most ``max_rows`` labelled documents outside the held-out fold, chosen and ordered by a hash of the id.

    An id with several labels takes the majority (a tie is 1); one with several texts takes the least text. Null ids and labels
    are left out. The bound keeps training in one task; everything else covers all rows.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("_y")).where(F.col("doc_id").isNotNull() & F.col("_y").isNotNull() & (fold != 0))
    known = known.groupBy("doc_id").agg((F.avg("_y") >= 0.5).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit_in_one_task(sample: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes:
    """Run ``fit`` over the whole bounded sample in one task and fetch the model, whose size the feature space fixes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        yield pa.record_batch([pa.array([fit(pa.Table.from_batches(held) if held else None)], pa.binary())], ["model"])

    rows = sample.select("doc_id", "y", "text").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else fit(None)


def in_pieces(table: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray]]:
    texts, y = table.column("text").combine_chunks(), table.column("y").to_numpy()
    for a, b in pieces(texts):
        yield texts.slice(a, b - a), y[a:b]
