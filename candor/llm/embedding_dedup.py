"""Near duplicates among embeddings: random-hyperplane buckets, exact cosines inside them, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2, acos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.runtime import connected_components, grouped, lean, materialize

#: Vectors of a block; a bucket with more is compared block by block.
BLOCK = 256


def table_shape(n: int, threshold: float, recall: float = 0.9999) -> tuple[int, int]:
    """Bits of a signature, about log2 of the number of vectors, and how many tables find a pair at ``threshold`` with that chance."""
    bits = max(12, ceil(log2(max(n, 2))))
    together = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - together))


def _signs(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    positive = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return positive @ (1 << np.arange(bits, dtype=np.int64))


def packed(signs: np.ndarray, bits: int) -> list[bytes]:
    """A row's signature of every table as bytes, four to a table unless it has more bits than that."""
    return [x.tobytes() for x in signs.astype("<u4" if bits <= 32 else "<u8")]


def unpacked(rows: list[bytes], tables: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, f"<u{len(x) // tables}") for x in rows])


def hashed(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``vec_id, label, dims, vector, signs`` of every row: the components in bytes, as given, and a signature per table.

    ``vector`` is null where the row can link with nothing.
    """
    width = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(width)
            begin = np.concatenate([[0], np.cumsum(size)])[:-1]
            left = np.ones(batch.num_rows, bool)
            for dims in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero((size == dims) & known)
                v = flat[begin[rows][:, None] + np.arange(dims)]
                # scaled by the largest component, so no norm over- or underflows; a missing component is not a number here
                most = np.abs(v).max(axis=1)
                good = np.isfinite(most) & (most > 0)
                rows, v = rows[good], v[good]
                left[rows] = False
                for a in range(0, len(rows), 1024):
                    r, part = rows[a : a + 1024], v[a : a + 1024] + 0  # -0 becomes 0, so equal vectors have equal bytes
                    at = pa.array(r)
                    signs = _signs(scaled(part), bits, tables, seed)
                    yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(r), dims)), pa.array([x.tobytes() for x in part], pa.binary()), pa.array(packed(signs, bits), pa.binary())], ["vec_id", "label", "dims", "vector", "signs"])
            at = pa.array(np.flatnonzero(left))
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(size[left].astype(np.int64)), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary())], ["vec_id", "label", "dims", "vector", "signs"])

    return vectors.select("vec_id", F.col("label").cast("string"), "embedding").mapInArrow(run, "vec_id long, label string, dims long, vector binary, signs binary")


def scaled(v: np.ndarray) -> np.ndarray:
    """In double precision, divided by the largest component."""
    v = v.astype(np.float64)
    return v / np.abs(v).max(axis=1)[:, None]


def compare_block(t: pa.Table, threshold: float, tables: int) -> pa.RecordBatch | None:
    """For each vector of a pair of blocks: how many vectors it links with, and the least id of its component in here.

    Of pairs that share several buckets only the one in the first such table counts.
    """
    ids, copies, block = (t.column(c).to_numpy() for c in ("id", "copies", "block"))
    i, j, table = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("t")[0].as_py()
    held = t.column("vector").to_pylist()
    v = scaled(np.stack([np.frombuffer(b, f"<f{len(b) // t.column('dims')[0].as_py()}") for b in held]))
    v = v / np.sqrt((v * v).sum(axis=1))[:, None]
    if i == j:
        left = right = np.arange(len(ids))
        a, b = np.nonzero(np.triu(v @ v.T >= threshold, 1))
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.nonzero(v[left] @ v[right].T >= threshold)
    a, b = left[a], right[b]
    signs = unpacked(t.column("signs").to_pylist(), tables)
    new = ~(signs[a, :table] == signs[b, :table]).any(axis=1)
    a, b = a[new], b[new]
    if not len(a):
        return None
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    some = links > 0
    return pa.record_batch([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], ["id", "links", "root"])


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.98, seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors with equal labels link when their cosine, in double precision, reaches ``threshold``; pairs come from buckets of equal
    signs in any of several tables (a pair at the threshold is missed with a chance of 1 in 10,000, closer pairs less), and each
    is checked exactly. A vector crosses the network once per bucket that others share, in the width it came in. Equal vectors are one class, so copies are never paired. A bucket of many is compared in pairs of blocks
    that return counts and a spanning forest, not pairs.

    A row is a vector: ``n_links`` counts the other rows that it links with, those of its own id among them. For components, rows
    that share an id are one vertex, so they get one ``component_id`` through whichever of them links. Null labels, null, empty or
    zero vectors and those with null or non-finite components link with nothing and are kept; so do vectors of different lengths
    with each other. Labels are compared as text and may be of any type; ids are read as long integers, and a null id links with
    nothing, gets a null component and is kept. An empty table gives no rows; other columns are ignored.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    bits, tables = table_shape(vectors.count(), threshold)
    rows = materialize(hashed(vectors, bits, tables, seed), "hashed-vectors")
    key = ["label", "dims", "vector"]
    usable = rows.where(F.col("vector").isNotNull())
    classes = usable.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("signs").alias("signs"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    bucket = ["label", "dims", "t", "sign"]
    width = 4 if bits <= 32 else 8
    each = F.array(*[F.substring("signs", t * width + 1, width) for t in range(tables)])
    spread = classes.select("class", "label", "dims", F.posexplode(each).alias("t", "sign"))
    full = spread.groupBy(*bucket).agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).drop("c")
    held = spread.join(full, bucket).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("long"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    held = held.select("class", *bucket, "block", "i", "j").join(classes.select("class", "copies", "vector", "signs"), "class").withColumnRenamed("class", "id")
    found = grouped(held, [*bucket, "i", "j"], ["id"], lambda t: compare_block(t, threshold, tables), "id long, links long, root long")
    found = materialize(found, "vector-links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    names = classes.select("class", "id", "copies", *key)
    ids = names.select(F.col("class"), F.col("id").alias("vec"))
    edges = found.where("id != root").select("id", "root").join(ids, F.col("id") == ids["class"]).select("root", F.col("vec").alias("a"))
    edges = edges.join(ids, F.col("root") == ids["class"]).select("a", F.col("vec").alias("b"))
    degrees = names.join(linked, names["class"] == linked["id"], "left").select(*key, names["id"].alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    # a class of very many copies is a hot key of a join that Spark can split; rows without a vector match nothing
    each = materialize(rows.select("vec_id", *key).join(degrees, key, "left").select("vec_id", "first", "n"), "vector-degrees")
    edges = edges.union(each.where("vec_id != first").select("vec_id", "first")).distinct()
    component = connected_components(materialize(edges, "vector-edges"), "a", "b")
    out = each.join(component, F.col("vec_id") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
