"""Models: boosted trees and logistic regression of MLlib, scorers named by a manifest, and generators."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterator
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.operators import rank
from candor.operators.coerce import model_matrix
from candor.operators.hashing import HashedWordGrams


def fit_boosted(df: DataFrame, features: list[str], label: str = "label", validation: str | None = None, iterations: int = 700, rate: float = 0.05, depth: int = 6, seed: int = 42):
    """Gradient-boosted trees on log loss; with ``validation`` (a boolean column) training stops when that set gets no better."""
    d = model_matrix(df, features, keep=[F.col(label).cast("double").alias("label"), *([F.col(validation).alias("_valid")] if validation else [])])
    gbt = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=iterations, stepSize=rate, maxDepth=depth, seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol("_valid")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), gbt]).fit(d)


def balanced_weights(df: DataFrame, label: str = "label", name: str = "_weight") -> DataFrame:
    """Weights n / (2 n_class), so that both classes weigh alike and all weights sum to n."""
    n, n1 = df.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long"))).first()
    return df.withColumn(name, F.when(F.col(label) == 1, n / (2.0 * max(n1 or 0, 1))).otherwise(n / (2.0 * max(n - (n1 or 0), 1))))


def fit_logistic(df: DataFrame, features: list[str] | str, label: str = "label", c: float = 3.0, iterations: int = 3000):
    """Balanced L2 logistic regression; ``c`` is the inverse strength over summed losses, as MLlib's averaged form needs 1 / (c n)."""
    n = df.count()
    d = balanced_weights(df, label)
    lr = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=iterations)
    if isinstance(features, str):
        return lr.setFeaturesCol(features).fit(d)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), lr]).fit(d)


def probability(model, df: DataFrame, name: str = "hallucination_prob") -> DataFrame:  # noqa: ANN001
    """The columns of ``df`` and the probability of label 1."""
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def hashed_text_block(views: dict[str, Callable[[Column], Column]], bits: int = 18, in_words: Collection[str] = ()) -> Pipeline:
    """Sparse blocks for several gram arrays, put side by side: counts hashed to a fixed size, weighted by idf, one vector.

    Views named in ``in_words`` are arrays of words (``tfidf.wb_words``), cut to character grams while they are hashed.
    """
    stages, blocks = [], []
    for view in views:
        counts = HashedWordGrams if view in in_words else HashingTF
        stages += [counts(inputCol=view, outputCol=f"_tf_{view}", numFeatures=1 << bits), IDF(inputCol=f"_tf_{view}", outputCol=f"_idf_{view}")]
        blocks.append(f"_idf_{view}")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=blocks, outputCol="_features")])


def n_nonzero(vector: str) -> Column:
    """Number of nonzero entries of a vector, counted over those it stores; an array of all entries has half a million for two blocks."""
    return F.size(F.filter(F.unwrap_udt(vector)["values"], lambda x: x != 0))


def importances(model, features: list[str], spark) -> DataFrame:  # noqa: ANN001
    """Feature importances of a boosted model, greatest first; as many rows as there are features."""
    got = model.stages[-1].featureImportances
    return spark.createDataFrame([(f, float(got[i])) for i, f in enumerate(features)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


#: Scorers by name: functions from a frame with features to a column.
REGISTRY: dict[str, Callable[[DataFrame], Column]] = {}


def scorer(name: str) -> Callable:
    def add(f: Callable[[DataFrame], Column]) -> Callable[[DataFrame], Column]:
        REGISTRY[name] = f
        return f

    return add


def save_model(model, path: str, features: list[str] | None = None) -> None:  # noqa: ANN001
    """A fitted pipeline, and the order of its features beside it."""
    from pyspark.sql import SparkSession

    from candor.sources.io import write_json

    model.write().overwrite().save(path)
    if features is not None:
        write_json(SparkSession.active(), features, f"{path.rstrip('/')}.features.json")


def load_model(spec: dict, name: str = "hallucination_prob") -> Callable[[DataFrame], DataFrame]:
    """A scorer of rows from a manifest entry: the pipeline at ``model_path``, on the features that ``feature_columns_path`` lists.

    Features that a frame lacks are 0, others are left out, and all are numbers, null as 0.
    """
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    from candor.sources.io import read_text

    model = PipelineModel.load(spec["model_path"])
    columns = json.loads(read_text(SparkSession.active(), spec["feature_columns_path"])) if "feature_columns_path" in spec else None

    def score(df: DataFrame) -> DataFrame:
        own = [f"_own{k}" for k in range(len(df.columns))]
        kept = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(df.columns, own, strict=True)], *[F.col(f"`{c}`") for c in df.columns])
        matrix = model_matrix(kept, columns, keep=own) if columns is not None else kept
        made = model.transform(matrix).withColumn("_prob", vector_to_array("probability")[1])
        return made.select(*[F.col(a).alias(c) for c, a in zip(df.columns, own, strict=True)], F.col("_prob").alias(name))

    return score


def read_manifest(text: str) -> dict:
    """The parts of a manifest, empty where absent; an error for a blend of names it doesn't define."""
    raw = json.loads(text)
    out = {"atomic": raw.get("atomic_catboost_models", []), "qa": raw.get("qa_models", []), "meta": raw.get("meta_model"), "blend": raw.get("solid_batch_independent_blend", [])}
    known = {m["name"] for m in [*out["atomic"], *out["qa"]]}
    if missing := [b["name"] for b in out["blend"] if b["name"] not in known]:
        raise ValueError(f"blend names unknown models: {missing}")
    return out


def manifest_at(spark, path: str) -> dict:  # noqa: ANN001
    """:func:`read_manifest` of a file that Spark's file system can open."""
    from candor.sources.io import read_text

    return read_manifest(read_text(spark, path))


def score_manifest(df: DataFrame, manifest: dict, meta: Callable[[DataFrame], Column] | None = None, name: str = "hallucination_prob") -> DataFrame:
    """All component scores (``score::<name>``) and their blend, or a meta model's output, in one pass over the rows.

    A model with a ``model_path`` is loaded from there; another is a scorer registered under its name.
    """
    specs = [*manifest["atomic"], *manifest["qa"]]
    names = [m["name"] for m in specs]
    out = df
    for m in specs:
        column = f"score::{m['name']}"
        out = load_model(m, column)(out) if "model_path" in m else out.withColumn(column, REGISTRY[m["name"]](df))
    if meta is None and manifest["meta"] and "model_path" in manifest["meta"]:
        parts = {n: F.col(f"`score::{n}`") for n in names}
        fed = reduce(lambda d, kv: d.withColumn(*kv), rank.meta_features(parts).items(), out)
        return load_model(manifest["meta"], name)(fed)
    scores = {n: F.col(f"`score::{n}`") for n in names}
    if meta is not None:
        for k, v in rank.meta_features(scores).items():
            if k.startswith("meta::"):
                out = out.withColumn(k, v)
        return out.withColumn(name, meta(out))
    return out.withColumn(name, rank.blend(scores, manifest["blend"]))


def generate(df: DataFrame, prompt: str, make: Callable, name: str = "model_answer", batch: int = 32, **sampling: float) -> DataFrame:
    """Add a generated text per prompt. ``make`` loads the generator, once per task and only where there are rows.

    ``sampling`` (``temperature``, ``top_p``, ``max_new_tokens``, ``seed``) is handed to each call of the generator; without any the
    generator is called with the prompts alone, which stands for greedy decoding.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    def run(frames: Iterator) -> Iterator:
        model = None
        for pdf in frames:
            if not len(pdf):
                continue
            model = model or make()
            texts: list[str] = []
            for i in range(0, len(pdf), batch):
                texts += model([p or "" for p in pdf[prompt].iloc[i : i + batch]], **sampling)
            yield pdf.assign(**{name: texts})

    schema = StructType([*(f for f in df.schema if f.name != name), StructField(name, StringType())])
    return df.drop(name).mapInPandas(run, schema)
