"""Best-fit-decreasing packing of documents into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.llm.runtime import lean, materialize, text_of
from candor.llm.textkit import pieces as chunks
from candor.llm.tokens import VOCABULARY, encode, encoder


class CapacityTree:
    """Segment tree over remaining capacities 0..limit; a leaf counts open bins with that much room."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest room >= ``need`` that an open bin has, in O(log limit)."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1 and (i & 1 or not self.count[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i *= 2
            if not self.count[i]:
                i += 1
        return i - self.size


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing for ``counts[length]`` items of each length, as rows ``length, rank, bin, offset, per_bin``.

    Items of one length are interchangeable, and so are bins with equal room. What best fit does with the next items of a
    length is therefore the same step over and over: fill the tightest open bins, ``room // length`` items each. The plan holds
    one row per run of such steps, in order of ``rank`` (the item's number within its length). Item ``rank + i`` of a row goes
    to bin ``bin + i // per_bin`` at ``offset + i % per_bin * length``. The result is that of the item-by-item method; the work
    and the plan depend on the capacity (lengths times rooms), not on the number of items.
    """
    tree, rooms, plan, opened = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            rooms.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, fit = capacity, capacity // length
                first, n = opened, -(-left // fit)
                opened += n
            else:
                fit = room // length
                first, n = rooms[room].pop()
                tree.add(room, -n)
            took = min(left, n * fit)
            full, rest = divmod(took, fit)
            plan.append((length, rank, first, capacity - room, fit))
            put(room - fit * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + took, left - took
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def id_type(separator: int, vocabulary: str) -> str:
    """The numpy type that ids are moved in."""
    return "<u2" if max(separator, encoder(vocabulary).n_vocab - 1) <= 0xFFFF else "<u4"


def token_pieces(docs: DataFrame, capacity: int, separator: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, salt``: a document's ids and a separator, cut where they exceed ``capacity``.

    The ids are those of the tokenizer file, so the string of an added token in a text is that token. ``salt`` differs between
    pieces that are otherwise alike.
    All pieces of a cut document but the first are full. ``ids`` are little-endian bytes, two to an id where the vocabulary allows.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        narrow = id_type(separator, vocabulary)
        salt = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in chunks(texts):
                doc, rows, held = [], [], []
                for key, text in zip(keys.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True):
                    ids = np.append(encode(text, vocabulary, added=True), np.uint32(separator)).astype("<u4", copy=False)
                    cut = len(ids) % capacity or capacity
                    for k, at in enumerate([0, *range(cut, len(ids), capacity)]):
                        part = ids[at : cut + k * capacity]
                        doc.append(key)
                        rows.append((k, at, len(part), zlib.crc32(part)))
                        held.append(part.astype(narrow).tobytes())
                cols = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, j]) for j in (1, 2, 3)), pa.array(held, pa.binary()), pa.array(np.arange(salt, salt + len(doc)))], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "salt"])
                salt += len(doc)

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, salt long")


def pack(parts: DataFrame, capacity: int, bucket_rows: int = 256) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``parts(doc_id, piece, start, length, ids_crc32, ids, salt)``, best-fit decreasing over all rows.

    ``parts`` is read more than once, so it must be a written table.

    ``ids`` go where their row goes, in one shuffle, and come out as an array; ``ids_crc32`` is taken again from the ids placed.

    The driver sees the number of items of each length: at most ``capacity`` rows. Items get their rank within their length from
    hashed buckets of about ``max(bucket_rows, 4 sqrt(n))`` rows and a prefix sum over buckets, so a length that most rows share
    (full pieces) is spread like any other. The plan that is broadcast has a number of rows bounded by the capacity.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, capacity))
    most = max(counts.values(), default=1)
    n_buckets = -(-most // max(bucket_rows, 4 * isqrt(most)))
    keyed = parts.withColumn("_bucket", F.pmod(F.xxhash64("salt"), F.lit(n_buckets)).cast("int"))
    base = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy("salt")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(base, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("_rank") + F.col("_base")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = rows[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            parts = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4") for x, n in zip(batch.column(4).to_pylist(), length.tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(np.append(0, np.cumsum(length)).astype(np.int32), np.concatenate([*parts, np.zeros(0, "<u4")]).astype(np.int32))
            sums = pa.array([zlib.crc32(x) for x in parts], pa.int64())
            yield pa.record_batch([*batch.columns[:4], sums, pa.array(row[:, 2] + nth // row[:, 4]), pa.array(row[:, 3] + nth % row[:, 4] * length), ids], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the ids of each sequence's pieces in order of their offsets."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = 1024, separator: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document of ``docs(doc_id, text)`` as pieces with their ids, placed in sequences of ``capacity`` ids.

    Null and empty texts are a lone separator. Repeated rows are packed as often as they occur. Documents that share an id are
    packed one by one. Columns other than these two are ignored; an empty table gives no rows.
    """
    return pack(materialize(token_pieces(docs, capacity, separator, vocabulary), "pieces"), capacity)
