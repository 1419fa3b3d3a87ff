"""What the operators share on a cluster: written intermediate tables, grouped streams, connected components."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_open = threading.local()
#: Bytes of an Arrow batch that goes to Python. Spark's own bound is 10,000 rows, which long texts make many times larger.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='candor-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nothing else uses; the innermost open scope removes it at its end."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once and read back. This cuts the lineage, and a lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is written inside is removed at the end. Write results outside it, or by way of ``tidy``.

    Inside, Arrow batches are bounded by bytes too, unless the session has a smaller bound; a row that is longer is a batch of its own.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    before = spark.conf.get(_BATCH, None)
    if before is None or not before.isdigit() or int(before) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
        remove(spark, scopes.pop())


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written before it returns; what it wrote on the way is then removed.

    The result itself belongs to the scope around the call, if there is one, and else stays.
    """

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:  # noqa: ANN002, ANN003
        spark = SparkSession.active()
        path = fresh_path(spark, operator.__name__.replace("_", "-"))
        with scope(spark):
            out = operator(*args, **options)
            out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path)

    return run


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives the memory it has freed back to the system at its end; workers wait for further tasks meanwhile."""

    @functools.wraps(run)
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
                trim(0)

    return freed


def grouped(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``kernel`` to the rows of each key, one key at a time.

    Rows are dealt by key and sorted, so a task streams over its keys and holds one of them (plus an Arrow batch); callers
    bound the rows of a key by splitting it first.
    """
    out = pa.schema(_arrow_fields(df.sparkSession, schema))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                made = kernel(pa.concat_tables(held).combine_chunks())
                held.clear()
                if made is not None and made.num_rows:
                    yield made.cast(out) if made.schema != out else made

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            cols = [part.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(part.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), part.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(c[a] for c in cols)
                if key != last:
                    yield from flush()
                    last = key
                held.append(part.slice(a, b - a))
        yield from flush()

    dealt = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def _arrow_fields(spark: SparkSession, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(schema)))


@tidy
def connected_components(edges: DataFrame, a: str, b: str, tag: str = "components") -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the smallest node that can be reached.

    Alternating large-star and small-star rounds: each joins an edge list with per-node minima, written between rounds. A node
    with very many neighbours is only the hot key of an aggregate with partial sums and of a join that Spark can split. No
    links reach the driver; it only learns whether a round left nothing but stars.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, tag)
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, tag)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.where("u != v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, tag)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined_components(component: DataFrame, links: DataFrame) -> DataFrame:
    """``component(node, component)`` after further ``links(a, b)``: only components that a link touches are worked on again."""
    of = lambda end, name: component.select(F.col("node").alias(f"_{end}"), F.col("component").alias(name))
    ends = links.join(of("a", "u"), F.col("a") == F.col("_a"), "left").join(of("b", "v"), F.col("b") == F.col("_b"), "left")
    merged = connected_components(ends.select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v")), "u", "v")
    new = merged.join(component, "node", "left_anti")
    merged = broadcast_if_small(merged.select(F.col("node").alias("_n"), F.col("component").alias("_c")))
    return component.join(merged, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component")).union(new)


def _stars(e: DataFrame) -> bool:
    """Whether every ``u`` has a single ``v`` and no ``v`` is a ``u``: then each ``v`` is the root of its component."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(e.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("root").alias("r")).where("c > 1 or (c > 0 and r > 0)").isEmpty()


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named ``c0, c1, ...``, which meet no name that an operator uses, and which is which."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()]), names


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Mark a narrow table for broadcast only after counting that it is small; beyond that Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
