"""Corpus pipeline: quality, near duplicates, personal data, mixture, packing; each stage works on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each as Parquet into the shared folder and reads it
again, so a lost executor costs tasks and a failed stage doesn't repeat the ones before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.llm import mixing, ngram_join, packing, pii, quality
from candor.llm.runtime import broadcast_if_small, fresh_path, materialize, own_names, remove, scope
from candor.session import table


def _restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(c) for c, a in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3; labels come from the input tables, the classifier sees texts only.

    Null and empty texts get the score of no features. Repeated rows are judged alike. Other columns are left as they are, under
    whatever name; no rows give no rows.
    """
    weights = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    own, names = own_names(docs)
    return _restored(quality.score_quality(own, weights, text=names["text"]).where("quality_score >= 0.3"), names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, of several the first.

    Groups are of rows, so rows that share an id (or have none) are told apart by their texts, and a row goes only if its own text
    is linked with that of a row that stays. Texts without words (null, empty) link with nothing and all stay. Ids that are null
    come after all others. Other columns may have any name; no rows give no rows.

    Rows get numbers in a written table. Texts are not shuffled unless so many rows go that their numbers can't be broadcast.
    """
    own, names = own_names(docs)
    rows = materialize(own.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    found = ngram_join.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(names["text"]).alias("text")), n=5, percent=80)
    linked = found.where("n_shingles > 0").groupBy("component_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("component_id")
    members = found.join(linked, "component_id").select(F.col("doc_id").alias("row"), "component_id")
    members = materialize(rows.select("row", F.col(names["doc_id"]).cast("long").alias("doc_id")).join(broadcast_if_small(members), "row"), "duplicate-rows")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    gone = broadcast_if_small(members.join(first, ["component_id", "row"], "left_anti").select("row"))
    return _restored(rows.join(gone, "row", "left_anti"), names)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; null and empty texts as they are."""
    return pii.redact(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that all sources have equal weight, shuffled. A null source is a source of its own.

    Null and empty texts weigh one character. The columns of ``docs`` come back as they were; no rows give no rows.
    """
    own, names = own_names(docs)
    return _restored(mixing.mix_sources(own, seed=17, key=names["source"], ident=names["doc_id"], text=names["text"]), names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as pieces placed in sequences of 1024 tokens; a null or empty text is a lone separator, no rows give no rows."""
    return packing.pack_documents(spark, docs, capacity=1024, separator=2)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("source mixing", mixture_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way, and the rows it read, are removed once its own are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{k}")
        with scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before:
            remove(spark, [before])
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return docs
