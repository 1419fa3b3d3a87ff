"""Hashed counts of character n-grams inside words, cut and hashed together in numpy: the vectors that HashingTF makes of ``char_wb_ngrams``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that goes to Python; its vectors are at most some 36 times as large.
BATCH_BYTES = 1 << 20
#: Grams that are counted together.
_GRAMS = 1 << 20
_VECTOR = pa.struct(
    [
        pa.field("type", pa.int8(), nullable=False),
        pa.field("size", pa.int32()),
        pa.field("indices", pa.list_(pa.field("element", pa.int32(), nullable=False))),
        pa.field("values", pa.list_(pa.field("element", pa.float64(), nullable=False))),
    ]
)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of what runs inside are bounded by bytes, not by 10,000 rows alone."""
    before = spark.conf.get(_BATCH, None)
    if before is None or not before.isdigit() or int(before) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``starts[k], starts[k] + 1, ...``, ``sizes[k]`` of them, for all k one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _mixed(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(0xCC9E2D51)
    return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)


def murmur3(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """32-bit MurmurHash3 of runs of bytes, as signed numbers like those of HashingTF. ``data`` ends in three bytes more."""
    h = np.full(len(starts), seed, np.uint32)
    at = lambda p, n: sum(data[p + i].astype(np.uint32) << np.uint32(8 * i) for i in range(n))
    whole = sizes // 4
    for k in range(int(whole.max(initial=0))):
        on = np.flatnonzero(whole > k)
        x = h[on] ^ _mixed(at(starts[on] + 4 * k, 4))
        h[on] = (x << np.uint32(13) | x >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    rest = sizes % 4
    tail = at(starts + 4 * whole, 3) & ((np.uint32(1) << (8 * rest).astype(np.uint32)) - np.uint32(1))
    h ^= _mixed(tail) ^ sizes.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def gram_features(words: pa.Array, n_features: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's features begin, and the hashed grams of ``low`` to ``high`` characters of the words, padded with blanks."""
    blank, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    padded = pc.binary_join_element_wise(blank, words.cast(pa.large_string()), blank, nothing)
    offsets = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data = np.concatenate([np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.zeros(3, np.uint8)])
    offsets = offsets - offsets[0]
    # places where characters begin, and the end; characters of a word are at first[k] to first[k + 1]
    begins = np.append(np.flatnonzero(data[: offsets[-1]] & 0xC0 != 0x80), offsets[-1])
    first = np.searchsorted(begins, offsets)
    length = np.diff(first)
    word, start, end = [], [], []
    for n in range(low, high + 1):
        cuts = np.maximum(length - n + 1, 0)
        at = _ragged(first[:-1], cuts)
        # the first n that exceeds the word gives the whole of it, once
        short = np.flatnonzero(length < n if n == low else length == n - 1)
        word += [np.repeat(np.arange(len(length)), cuts), short]
        start += [begins[at], begins[first[short]]]
        end += [begins[at + n], begins[first[short + 1]]]
    word, start, end = map(np.concatenate, (word, start, end))
    order = np.argsort(word, kind="stable")
    features = murmur3(data, start, end - start) % np.int32(n_features)
    return np.append(0, np.cumsum(np.bincount(word, minlength=len(length)))), features[order]


def vectors(lists: pa.Array, n_features: int, low: int, high: int) -> pa.Array:
    """Lists of words as sparse vectors: how often each feature occurs. Each different word is cut and hashed once."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    begin, features = gram_features(coded.dictionary, n_features, low, high)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    grams = np.diff(begin)[codes]
    upto = np.append(0, np.cumsum(grams))[np.append(0, ends)]
    counts, indices, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
    a = 0
    while a < len(lists):
        b = max(int(np.searchsorted(upto, upto[a] + _GRAMS, side="right")) - 1, a + 1)
        part = slice(ends[a] - sizes[a], ends[b - 1])
        found = features[_ragged(begin[codes[part]], grams[part])].astype(np.int64)
        key, n = np.unique(np.repeat(np.arange(b - a), np.diff(upto[a : b + 1])) * n_features + found, return_counts=True)
        counts.append(np.diff(np.searchsorted(key, np.arange(b - a + 1) * n_features)))
        indices.append((key % n_features).astype(np.int32))
        values.append(n.astype(np.float64))
        a = b
    rows = pa.array(np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int32))
    lists_of = lambda parts, name: pa.ListArray.from_arrays(rows, pa.array(np.concatenate(parts)), type=_VECTOR.field(name).type)
    n = len(lists)
    return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, n_features, np.int32)), lists_of(indices, "indices"), lists_of(values, "values")], fields=list(_VECTOR))


class HashedWordGrams(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Words (an array of texts) as the sparse vector of their hashed grams of 3 to 5 characters."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, numFeatures: int = 1 << 18) -> None:  # noqa: N803
        super().__init__()
        self._setDefault(numFeatures=1 << 18)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size = self.getNumFeatures()

        def hashed(words: pa.Array) -> pa.Array:
            return vectors(words, size, 3, 5)

        group = {"ml_attr": {"num_attrs": size}}
        return dataset.withColumn(self.getOutputCol(), F.arrow_udf(hashed, VectorUDT())(F.col(self.getInputCol())).alias(self.getOutputCol(), metadata=group))
