"""Tables from and to files: format by suffix, discovery, provenance, checkpoints, small JSON artefacts."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = {"train": "train", "validation": "validation", "valid": "validation", "val": "validation", "test": "test"}


def suffix(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, formats: tuple[str, ...] = ("csv", "parquet", "jsonl", "json")) -> DataFrame:
    """A table by its suffix. Give a schema for text formats at scale: without, each file is read twice to infer it."""
    kind = suffix(path)
    if kind not in formats:
        raise ValueError(f"unsupported format: {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=True, escape='"')
    if kind == "json":
        return reader.json(path, multiLine=True)
    return reader.json(path)


def read_many(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Several tables one after the other, widened by name; a missing file is an error."""
    names = [p.strip() for p in paths.split(",")] if isinstance(paths, str) else list(paths)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (read_table(spark, p, **options) for p in names if p))


def split_of(path: Column) -> Column:
    """The split that a path names: by a folder, or by a file name that begins with it and a hyphen; first match in a fixed order."""
    found = F.lit("unspecified")
    for word, split in reversed(SPLITS.items()):
        found = F.when(path.rlike(rf"(?i)(?:^|/){word}(?:/|-)"), split).otherwise(found)
    return found


def find_tables(spark: SparkSession, folder: str, glob: str = "*.parquet", split: str | None = None) -> list[str]:
    """Files and table folders below ``folder`` whose name fits ``glob``, in order of their paths; what fits is not searched further.

    ``split`` keeps those below a folder of that name, so others aren't even listed by a reader.
    """
    fs_of = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found, folders = [], [(folder, split is None)]
    while folders:
        at, inside = folders.pop()
        for status in fs_of.listStatus(spark._jvm.org.apache.hadoop.fs.Path(at)):
            path = status.getPath()
            if fnmatchcase(path.getName(), glob):
                found += [path.toString()] if inside else []
            elif status.isDirectory():
                folders.append((path.toString(), inside or path.getName() == split))
    return sorted(found)


def discover(spark: SparkSession, folder: str, glob: str = "*.parquet", split: str | None = None, provenance: str = "generated_file", schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of :func:`find_tables`, with the path of the table each is from, its place in the order, and the split it names.

    A folder without such tables is an error. Columns that only some have are widened when no schema is given.
    """
    paths = find_tables(spark, folder, glob, split)
    if not paths:
        raise FileNotFoundError(f"no {glob} below {folder}")
    df = (spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")).parquet(*paths)
    plain = lambda p: p.partition(":")[2].lstrip("/") if ":" in p else p.lstrip("/")
    file = F.col("_metadata.file_path")
    at = F.lit(None).cast("int")
    for k, p in enumerate(paths):
        at = F.when(F.endswith(file, F.lit(plain(p))) | F.contains(file, F.lit(f"{plain(p)}/")), k).otherwise(at)
    df = df.select("*", at.alias("table_order"))
    names = F.element_at(F.array(*map(F.lit, paths)), F.col("table_order") + 1)
    return df.withColumn(provenance, names).withColumn("path_split", split_of(F.col(provenance)))


def scratch(spark: SparkSession, tag: str = "files") -> str:
    """A fresh path for intermediate files under ``spark.checkpoint.dir``; where it is unset, in local mode only, one of our own.

    What a session wrote there is removed when its Python process ends.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='candor-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have ended before; its folder is the cluster's to clear
        return


def staged(df: DataFrame, tag: str = "staged") -> DataFrame:
    """Written once and read back, so that several readers see the same rows even if an executor is lost in between."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def excluded_ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct non-null ``id`` texts of several tables; those that can't be read or have no such column are skipped."""
    parts = []
    for p in paths:
        try:
            df = read_table(spark, p)
        except Exception as e:  # noqa: BLE001 - a missing table is skipped whatever the file system calls it
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
            continue
        if "id" in df.columns:
            parts.append(df.select(F.col("id").cast("string").alias("id")).dropna())
    return reduce(DataFrame.union, parts).distinct() if parts else spark.createDataFrame([], "id string")


def renamed_source(df: DataFrame, columns: dict[str, str], source: str, split: str | None = None) -> DataFrame:
    """A public question set as question, gold answer and source id, tagged."""
    out = df.select(*(F.col(a).alias(b) for a, b in columns.items())).withColumn("source_dataset", F.lit(source))
    return out.withColumn("source_split", F.lit(split)) if split else out


def pending(df: DataFrame, cached: DataFrame, key: str = "_row_id") -> DataFrame:
    """Rows that a cache doesn't hold yet."""
    return df.join(cached.select(key).dropna().distinct(), key, "left_anti")


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, since CSV has no nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    kind = suffix(path)
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "csv":
        flat_for_csv(df).write.mode(mode).csv(path, header=True, escape='"')
    elif kind in ("json", "jsonl"):
        df.write.mode(mode).json(path)
    else:
        raise ValueError(f"unsupported format: {path}")


def write_labelled(df: DataFrame, base: str, name: str = "labeling_dataset") -> None:
    """The labelled table and its part for manual review, each as Parquet and CSV; computed once."""
    write_table(df, f"{base}/{name}.parquet")
    done = df.sparkSession.read.parquet(f"{base}/{name}.parquet")
    review = done.where("needs_manual_review")
    write_table(done, f"{base}/{name}.csv")
    write_table(review, f"{base}/{name}_manual_review.parquet")
    write_table(review, f"{base}/{name}_manual_review.csv")


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small artefact (metrics, feature names) as indented JSON, through Spark's file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False).encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file (manifest, feature names), through Spark's file system."""
    return spark.read.text(path, wholetext=True).first()["value"]


def row_as_dict(df: DataFrame) -> dict:
    """The one row of a metrics frame, for :func:`write_json`."""
    return df.first().asDict(recursive=True)
