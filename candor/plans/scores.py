"""Queries over labels, scores, series and vectors, models, and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from candor.functions import arrays as R
from candor.functions import text as T
from candor.functions.lexicon import EN
from candor.operators import assemble as A
from candor.operators import labels as L
from candor.operators import metrics as M
from candor.operators import models, rank
from candor.plans import base as B
from candor.plans.base import QA, query
from candor.plans.relational import LABELLED, MANUAL, labelled
from candor.session import table
from candor.sources import io

_BEST = f"""with {QA}, s as (select id, model_answer, context, unnest(gold_answers_text) as g, unnest(range(1, len(gold_answers_text) + 1)) as k, gold_answers_text as golds from qa),
p as (select *, {B.toks('model_answer')} as a, {B.toks('g')} as b, {B.norm('model_answer')} as an, {B.norm('context')} as cn from s), q as (select *, {B.content('a')} as ac, {B.content('b')} as bc from p),
f as (select *, {B.f1('a', 'b')} as f1, {B.f1('ac', 'bc')} as cf1 from q), best as (select * from f qualify row_number() over (partition by id order by f1 desc, cf1 desc, k) = 1)"""
_ANY = f"list_contains(list_transform(golds, lambda g: {B.norm('g')}), an)"
_SUB = f"len(list_filter(list_transform(golds, lambda g: {B.norm('g')}), lambda x: x <> '' and (contains(an, x) or contains(x, an)))) > 0"


@query(_BEST + " select id, g as best_gold_answer, round(f1, 9) as token_f1_max, round(cf1, 9) as content_token_f1_max from best")
def agg10_best_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.best_gold(B.qa(spark, sf_dir), EN, similarity=False)
    return d.select("id", "best_gold_answer", F.round("token_f1_max", 9).alias("token_f1_max"), F.round("content_token_f1_max", 9).alias("content_token_f1_max"))


_LEXICAL = _BEST + f""" select id, case when {B.phrase('an', EN.uncertainty)} then 1 when len({B.numbers('model_answer')}) > 0 and len({B.numbers('g')}) > 0 and {B.numbers('model_answer')} <> {B.numbers('g')} then 1
when {_ANY} then 0 when {_SUB} then 0 when f1 >= 0.85 then 0 when cf1 >= 0.9 then 0 when f1 <= 0.15 and cf1 <= 0.2 and not ({B.supported('an', 'cn')}) then 1 end as weak_label,
case when {B.phrase('an', EN.uncertainty)} then 'uncertainty_marker' when len({B.numbers('model_answer')}) > 0 and len({B.numbers('g')}) > 0 and {B.numbers('model_answer')} <> {B.numbers('g')} then 'numeric_mismatch'
when {_ANY} then 'exact_match' when {_SUB} then 'substring_match' when f1 >= 0.85 then 'high_token_f1' when cf1 >= 0.9 then 'high_content_f1'
when f1 <= 0.15 and cf1 <= 0.2 and not ({B.supported('an', 'cn')}) then 'low_similarity_unsupported' else 'manual_review' end as weak_label_reason from best"""


@query(_LEXICAL)
def lab1_lexical_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade without character similarity, which SQL can't compute."""
    return L.weak_labels(B.qa(spark, sf_dir), EN, similarity=False).select("id", "weak_label", "weak_label_reason")


@query(f"""with l as ({_LEXICAL}), a as (select *, weak_label is null as needs_manual_review, coalesce(weak_label, 0) = 1 as is_hallucination_heuristic, '' as reviewer_comment from l)
select 'labeling_dataset.parquet' as file, * from a union all select 'labeling_dataset.csv', * from a
union all select 'labeling_dataset_manual_review.parquet', * from a where weak_label is null union all select 'labeling_dataset_manual_review.csv', * from a where weak_label is null""")
def snk2_labelled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four labelled files read back. Labels are those of the cascade without character similarity, so that SQL can check them."""
    base = io.scratch(spark)
    io.write_labelled(L.weak_labels(B.qa(spark, sf_dir), EN, similarity=False), base)
    kind = {"id": "string", "weak_label": "int", "weak_label_reason": "string", "needs_manual_review": "boolean", "is_hallucination_heuristic": "boolean", "reviewer_comment": "string"}
    parts = []
    for name in ("labeling_dataset.parquet", "labeling_dataset.csv", "labeling_dataset_manual_review.parquet", "labeling_dataset_manual_review.csv"):
        d = spark.read.csv(f"{base}/{name}", header=True, multiLine=True, escape='"') if name.endswith("csv") else io.read_table(spark, f"{base}/{name}")
        parts.append(d.select(F.lit(name).alias("file"), *((F.coalesce(c, F.lit("")) if c == "reviewer_comment" else F.col(c).cast(t)).alias(c) for c, t in kind.items())))
    return A.union_widening(*parts)


@query()
def weak_label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the whole labelling of all answers, counted by reason and label."""
    return M.value_counts(L.weak_labels(B.qa(spark, sf_dir), EN), "weak_label_reason", "weak_label")


@query()
def lab1_2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.weak_labels(B.qa(spark, sf_dir), EN)
    return d.select("id", "weak_label", "weak_label_reason", "needs_manual_review", "is_hallucination_heuristic", F.round("char_similarity_max", 9).alias("char_similarity_max"))


_GEN = f"""with {QA}, p as (select id, model_answer, {B.toks('model_answer')} as a, {B.toks('question')} as b, {B.norm('model_answer')} as an, {B.norm('question')} as qn, {B.norm('context')} as cn from qa),
f as (select *, {B.f1('a', 'b')} as f1, {B.supported('an', 'cn')} as sup, len({B.strip('model_answer')}) as n from p),
l as (select id, case when f1 < 0.25 and not sup and n > 10 then 1 when f1 > 0.7 or an = qn then 0 end as real_label, case when f1 < 0.25 and n > 5 then 1 when f1 > 0.7 or an = qn then 0 end as factual_label from f)
select * from l where real_label is not null or factual_label is not null"""


@query(_GEN)
def lab3_4_fil19_generation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.qa(spark, sf_dir).withColumns({"an": T.normalize(F.col("model_answer")), "qn": T.normalize(F.col("question")), "cn": T.normalize(F.col("context"))})
    f1 = T.multiset_f1(T.split_words(F.col("an")), T.split_words(F.col("qn")))
    exact, answer = F.col("an") == F.col("qn"), F.col("model_answer")
    real = L.generation_label(f1, exact, answer, T.supported_by_context(F.col("an"), F.col("cn"), EN))
    return d.select("id", real.alias("real_label"), L.generation_label(f1, exact, answer).alias("factual_label")).where("real_label is not null or factual_label is not null")


@query(f"with {LABELLED} select doc_id, case when weak_label is not null or is_hallucination_manual is not null then coalesce({MANUAL}, weak_label, 0) end as label, case {MANUAL} when 1 then 'positive' when 0 then 'negative' else 'null' end as proxy from lab")
def lab6_7_training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candor.operators.coerce import flag_of

    d = labelled(spark, sf_dir)
    return d.select("doc_id", L.training_label(F.col("weak_label"), F.col("is_hallucination_manual")).alias("label"), L.label_proxy(flag_of(F.col("is_hallucination_manual"))).alias("proxy"))


@query(f"with {LABELLED}, x as (select doc_id, quality = 0 as h, score_a >= 0.95 as e, score_b as f, {MANUAL} as m, is_hallucination_manual from lab) select doc_id, coalesce(m, case when h then 1 when e or f >= 0.9 then 0 end, 0) as label from x where is_hallucination_manual is not null or h or e or f >= 0.9")
def fil18_heuristic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir).select("doc_id", (F.col("quality") == 0).alias("is_hallucination_heuristic"), (F.col("score_a") >= 0.95).alias("exact_match_any"), F.lit(False).alias("substring_match_any"), F.col("score_b").alias("token_f1_max"), "is_hallucination_manual")
    return d.select("doc_id", L.heuristic_training_label(d).alias("label")).where("label is not null")


@query(f"with {LABELLED} select doc_id, round((score_a * 1.0 + (1 - score_b) * 3.0) / 4.0, 9) as blend from lab")
def sco1_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = [{"name": "a", "weight": 1.0}, {"name": "b", "weight": 3.0, "invert": True}]
    return labelled(spark, sf_dir).select("doc_id", F.round(rank.blend({"a": F.col("score_a"), "b": F.col("score_b")}, spec), 9).alias("blend"))


@query(f'with {LABELLED} select doc_id, round((score_a + score_b) / 2, 9) as "meta::mean", round(abs(score_a - score_b) / 2, 9) as "meta::std", round(least(score_a, score_b), 9) as "meta::min", round(greatest(score_a, score_b), 9) as "meta::max", round(abs(score_a - score_b), 9) as "meta::range", round(score_a - score_b, 9) as "meta::qa_gap_v1_v2" from lab')
def sco2_agg8_9_meta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rank.meta_features({"qa_consistency_v1": F.col("score_a"), "qa_consistency_v2": F.col("score_b")})
    return labelled(spark, sf_dir).select("doc_id", *(F.round(c, 9).alias(n) for n, c in got.items() if n.startswith("meta::")))


_RANK = "(rank() over (order by {s}) + (count(*) over (partition by {s}) - 1) / 2.0::double) / count(*) over ()"


@query(f"with {LABELLED} select doc_id, round({_RANK.format(s='score_a')}, 9) as score_a_rank from lab")
def win1_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.percentile_rank(labelled(spark, sf_dir).select("doc_id", "score_a"), "score_a").select("doc_id", F.round("score_a_rank", 9).alias("score_a_rank"))


@query(f"with {LABELLED} select doc_id, round(({_RANK.format(s='score_a')} * 2 + {_RANK.format(s='score_b')}) / 3, 9) as ensemble_score from lab")
def sco3_4_rank_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir)
    frames = [d.select("doc_id", F.col("score_a").alias("s")), d.select("doc_id", F.col("score_b").alias("s"))]
    return rank.rank_average(frames, "doc_id", "s", [2.0, 1.0]).select("doc_id", F.round("ensemble_score", 9).alias("ensemble_score"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array of event values per user, in order of time: a stand-in for a token series.

    A row holds a whole series, as the array functions need it: right for responses of some thousand tokens, not for unbounded keys.
    """
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", "value").alias("e"))
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: F.coalesce(x["value"], F.lit(0.0)).cast("double")).alias("v"))


_SERIES = "v as (select user_id, list(coalesce(value, 0)::double order by ts, event_id) as v, count(*) as n from events group by user_id)"
_WIN = "list_transform(range(1, greatest(n - {w} + 1, 1) + 1), lambda i: list_avg(list_slice(v, i, i + least({w}, n) - 1)))"


@query(f"with {_SERIES} select user_id, round(list_avg(v), 6) as mean, round(list_stddev_pop(v), 6) as std, round(list_min(v), 6) as low, round(list_max(v), 6) as high, round(list_var_pop(v), 5) as variance, round(quantile_cont(x, 0.05), 6) as p05, round(quantile_cont(x, 0.1), 6) as p10 from v, lateral (select unnest(v) as x) group by user_id, v, n")
def arr1_2_3_series_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return series(spark, sf_dir).select("user_id", F.round(R.mean(v), 6).alias("mean"), F.round(R.std(v), 6).alias("std"), F.round(R.low(v), 6).alias("low"), F.round(R.high(v), 6).alias("high"), F.round(R.variance(v), 5).alias("variance"), F.round(R.percentile(v, 5), 6).alias("p05"), F.round(R.percentile(v, 10), 6).alias("p10"))


@query(f"with {_SERIES}, k as (select *, greatest(1, ceil(n * 0.3))::bigint as s from v) select user_id, round(list_max({_WIN.format(w=3)}), 6) as max_window_3, round(list_max({_WIN.format(w=5)}), 6) as max_window_5, round(list_min({_WIN.format(w=5)}), 6) as min_window_5, round(case when n < 2 then 0 else list_max(list_transform(range(1, n), lambda i: greatest(v[i] - v[i + 1], 0))) end, 6) as max_drop, round(list_avg(list_slice(v, 1, s)) - list_avg(list_slice(v, n - s + 1, n)), 6) as tail_degradation, round(list_avg(list_slice(v, 1, 5)), 6) as first_5 from k")
def win11_12_13_14_15_arr6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return series(spark, sf_dir).select("user_id", F.round(R.max_window_mean(v, 3), 6).alias("max_window_3"), F.round(R.max_window_mean(v, 5), 6).alias("max_window_5"), F.round(R.min_window_mean(v, 5), 6).alias("min_window_5"), F.round(R.max_drop(v), 6).alias("max_drop"), F.round(R.tail_degradation(v), 6).alias("tail_degradation"), F.round(R.first_mean(v, 5), 6).alias("first_5"))


_BUNDLE = f"""with {_SERIES.replace('v as', 'w as', 1)}, f as (select user_id, list_filter(v, lambda x: x < 40) as v from w), v as (select *, len(v) as n from f), k as (select *, greatest(1, ceil(n * 0.3))::bigint as s, list_transform(v, lambda x: x / 10.0::double) as e from v),
m as (select *, {_WIN.format(w=5)} as w5, {_WIN.format(w=3)} as w3 from k)
select user_id, {', '.join(f"round(coalesce({x}, 0), 5) as {n}" for n, x in {
    "token_logprob_mean": "list_avg(v)", "token_logprob_std": "list_stddev_pop(v)", "token_logprob_min": "list_min(v)", "token_logprob_max": "list_max(v)",
    "token_entropy_mean": "list_avg(v) / 10", "token_entropy_std": "list_stddev_pop(v) / 10", "token_entropy_min": "list_min(v) / 10", "token_entropy_max": "list_max(v) / 10",
    "logprob_min": "list_min(v)", "logprob_p05": "list_aggregate(v, 'quantile_cont', 0.05)", "logprob_p10": "list_aggregate(v, 'quantile_cont', 0.1)",
    "logprob_max_drop": "case when n < 2 then 0 else list_max(list_transform(range(1, n), lambda i: greatest(v[i] - v[i + 1], 0))) end",
    "logprob_tail_degradation": "list_avg(list_slice(v, 1, s)) - list_avg(list_slice(v, n - s + 1, n))", "worst_span_logprob_mean": "list_min(w5)",
    "entropy_max_window_3": "list_max(w3) / 10", "entropy_max_window_5": "list_max(w5) / 10", "entropy_variance": "list_var_pop(v) / 100", "worst_span_entropy_mean": "list_max(w5) / 10",
    "first_5_tokens_entropy": "list_avg(list_slice(v, 1, 5)) / 10", "top1_match_rate": "list_avg(list_transform(v, lambda x: (x < 20)::int))", "top1_prob_mean": "list_avg(list_transform(v, lambda x: x / 40.0::double))",
}.items())} from m"""


def _rounded(c: Column, digits: int) -> Column:
    """Half away from zero in binary, as DuckDB rounds; ``F.round`` rounds the shortest decimal form, so the two part at ties."""
    return F.round(c * 10.0**digits) / 10.0**digits


@query(_BUNDLE)
def arr6_17_response_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bundle over each user's values under 40, for users without any too: an empty response is all zeros.

    Entropies are the values in tenths. Their statistics are converted, not each value, so that no value is rounded on the way to a tie.
    """
    d = series(spark, sf_dir).withColumn("v", F.filter("v", lambda x: x < 40))
    got = R.response_statistics(F.col("v"), F.col("v"), F.col("m"), F.col("p"))
    got |= {n: c / (100 if n == "entropy_variance" else 10) for n, c in got.items() if "entropy" in n}
    d = d.withColumns({"m": F.transform("v", lambda x: (x < 20).cast("double")), "p": F.transform("v", lambda x: x / 40.0)})
    return d.select("user_id", *(_rounded(c, 5).alias(n) for n, c in got.items()))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select vec_id, list_slice(v, 1, 16) as l, list_slice(v, 17, 32) as m, list_slice(v, 33, 48) as y from e),
c as (select vec_id, list_cosine_similarity(l, m) as a, list_cosine_similarity(l, y) as b, list_cosine_similarity(m, y) as d from p)
select vec_id, round(a, 5) as last_mid_cos, round(b, 5) as last_early_cos, round(d, 5) as mid_early_cos, round(greatest(a, b, d) - least(a, b, d), 5) as hidden_state_cosine_diff, round(1 - (a + b + d) / 3, 5) as layer_disagreement_score from c""")
def arr13_layer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of an embedding stand in for the mean vectors of three layers."""
    v = F.col("embedding").cast("array<double>")
    got = R.layer_agreement(F.slice(v, 1, 16), F.slice(v, 17, 16), F.slice(v, 33, 16))
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(c, 5).alias(n) for n, c in got.items()))


@query("""with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v, row_number() over (partition by label order by vec_id) as k, count(*) over (partition by label) as n from embeddings),
b as (select r.label, r.vec_id, max(list_cosine_similarity(r.v, c.v)) as cos from e r join e c on r.label = c.label and r.k > r.n - 10 and c.k <= least(50, c.n - 10) group by all)
select label, round(avg(cos), 5) as q_align_maxcos_mean, round(stddev_pop(cos), 5) as q_align_maxcos_std, round(min(cos), 5) as q_align_maxcos_min, round(quantile_cont(cos, 0.1), 5) as q_align_maxcos_p10, round(avg((cos < 0.3)::int), 5) as q_align_low_support_rate from b group by label""")
def arr15_question_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors as a token sequence whose last ten are the response; the question is the first 50 of the prompt at most."""
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")))).alias("t"))
    e = e.select("label", F.transform("t", lambda x: x["v"]).alias("t"), (F.size("t") - 10).alias("start"))
    question = e.select("label", F.explode(R.question_part(F.col("t"), F.col("start"))).alias("v"))
    response = e.select("label", F.explode(F.slice("t", F.greatest(F.col("start"), F.lit(0)) + 1, F.lit(10))).alias("v"))
    d = alignment(response, question, "label", "v")
    names = {"mean": "maxcos_mean", "std": "maxcos_std", "least": "maxcos_min", "p10": "maxcos_p10", "low_support": "low_support_rate"}
    return d.select("label", *(F.round(c, 5).alias(f"q_align_{n}") for c, n in names.items()))


@query("with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), m as (select label, i, avg(v[i]) as x from e, (select unnest(range(1, 65)) as i) group by all), c as (select label, list(x order by i) as c from m group by label) select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) as norm, round(list_cosine_similarity(v, c), 5) as cosine_to_mean from e join c using (label)")
def arr11_12_13_norms_and_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    m = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    c = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return e.join(c, "label").select("vec_id", F.round(R.norm(F.col("v")), 5).alias("norm"), F.round(R.cosine(F.col("v"), F.col("c")), 5).alias("cosine_to_mean"))


@F.pandas_udf(ArrayType(DoubleType()))
def greatest_cosines(vectors: pd.Series, others: pd.Series) -> pd.Series:
    """For each of several vectors, its greatest cosine to any of some others."""

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), 1e-12, None)

    return pd.Series([(unit(np.stack(v).astype(float)) @ unit(np.stack(c).astype(float)).T).max(axis=1) for v, c in zip(vectors, others, strict=True)])


def alignment(responses: DataFrame, contexts: DataFrame, key: str, vector: str, block: int = 512) -> DataFrame:
    """Per group: mean, deviation, least, tenth percentile and share below .3 of each response vector's greatest cosine to a context vector.

    Contexts of a group come in blocks of bounded size; each response vector meets each block as a matrix product in an Arrow
    function, and only maxima leave it. Groups without contexts are left out, as they have nothing to align with. A group is one
    record's tokens, so its pairs of blocks are few; the work is quadratic in a record's length and linear in their number.
    """

    def blocked(d: DataFrame, name: str, rows) -> DataFrame:  # noqa: ANN001
        """Vectors of a group in arrays of about ``block``, dealt by hash."""
        n = d.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
        return d.join(n, key).groupBy(key, F.pmod(F.xxhash64(vector), F.col("_n")).alias("_b")).agg(F.collect_list(rows).alias(name)).drop("_b")

    blocks = blocked(contexts, "_ctx", F.col(vector))

    r = blocked(responses.withColumn("_id", F.monotonically_increasing_id()), "_rows", F.struct("_id", vector))
    best = r.join(blocks, key).select(key, F.explode(F.arrays_zip(F.col("_rows._id").alias("id"), greatest_cosines(F.col(f"_rows.{vector}"), F.col("_ctx")).alias("cos"))).alias("m"))
    best = best.groupBy(key, F.col("m.id").alias("id")).agg(F.max("m.cos").alias("cos"))
    return best.groupBy(key).agg(F.avg("cos").alias("mean"), F.stddev_pop("cos").alias("std"), F.min("cos").alias("least"), F.percentile("cos", F.lit(0.1)).alias("p10"), F.avg((F.col("cos") < 0.3).cast("double")).alias("low_support"))


@query("with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), b as (select r.label, r.vec_id, max(list_cosine_similarity(r.v, c.v)) as cos from e r join e c on r.label = c.label and r.vec_id % 2 = 1 and c.vec_id % 2 = 0 group by all) select label, round(avg(cos), 5) as mean, round(stddev_pop(cos), 5) as std, round(min(cos), 5) as least, round(quantile_cont(cos, 0.1), 5) as p10, round(avg((cos < 0.3)::int), 5) as low_support from b group by label")
def arr14_15_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    d = alignment(e.where("vec_id % 2 = 1").select("label", "v"), e.where("vec_id % 2 = 0").select("label", "v"), "label", "v")
    return d.select("label", *(F.round(c, 5).alias(c) for c in ("mean", "std", "least", "p10", "low_support")))


@query("with e as (select vec_id, list_transform(embedding, lambda x: abs(x::double) + 0.001) as v from embeddings), p as (select vec_id, list_transform(v, lambda x: x / list_sum(v)) as p, list_transform(list_reverse(v), lambda x: x / list_sum(v)) as q from e) select vec_id, round(list_sum(list_transform(p, lambda x: -x * ln(x))), 6) as entropy, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: q[i] * (ln(q[i]) - ln(p[i])))), 6) as kl from p")
def arr9_10_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x) + 0.001).alias("v"))
    p = e.select("vec_id", F.transform("v", lambda x: x / R.total(F.col("v"))).alias("p")).withColumn("q", F.reverse("p"))
    return p.select("vec_id", F.round(R.entropy(F.col("p")), 6).alias("entropy"), F.round(R.kl_divergence(F.col("q"), F.col("p")), 6).alias("kl"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select vec_id, v, unnest(range(0, 4)) as i from e),
r as (select vec_id, list_slice(v, i * 16 + 1, i * 16 + 16) as z, (vec_id + i) % 16 as y from p), m as (select *, list_max(z) as mx from r),
s as (select *, ln(list_sum(list_transform(z, lambda x: exp(x - mx)))) + mx as lse from m)
select vec_id, round(avg(z[y + 1] - lse), 6) as logprob, round(avg(list_sum(list_transform(z, lambda x: -exp(x - lse) * (x - lse)))), 6) as entropy, round(avg((list_position(z, mx) - 1 = y)::int), 6) as top1_match, round(avg(exp(mx - lse)), 6) as top1_prob from s group by vec_id""")
def arr4_5_7_8_token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities, entropies and top-1 data from logits; embeddings cut into four positions of 16 stand in for logits."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    logits = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * 16 + 1, F.lit(16)))
    labels = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("vec_id") + i) % 16).cast("int"))
    s = e.select("vec_id", R.token_statistics(logits, labels).alias("s"))
    return s.select("vec_id", *(F.round(R.mean(F.col(f"s.{c}")), 6).alias(c) for c in ("logprob", "entropy", "top1_match", "top1_prob")))


@query(f"with {QA}, k as (select id, {B.toks('question')} as q from qa), p as (select id, q, list_slice(q, 3, 4) as part from k), h as (select id, part, q, list_filter(range(0, greatest(len(q) - len(part), 0) + 1), lambda i: list_slice(q, i + 1, i + len(part)) = part) as h from p) select id, case when len(part) < 1 then -1 else coalesce(h[1], -1) end as position from h")
def arr16_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.qa(spark, sf_dir).select("id", T.tokens(F.col("question")).alias("q"))
    return d.select("id", R.find_subsequence(F.col("q"), F.slice("q", 3, 2)).cast("long").alias("position"))


_FEATURES = ["n_chars", "score_a", "score_b"]


@query()
def mod1_snk6_srt1_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with the operator's own settings; rounds end when the validation rows get no better."""
    d = io.staged(labelled(spark, sf_dir).select(*_FEATURES, F.col("quality").alias("label"), (F.col("split_name") == "validation").alias("valid")))
    model = models.fit_boosted(d, _FEATURES, validation="valid")
    return models.importances(model, _FEATURES, spark)


@query()
def mod2_3_snk7_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows with their probabilities, as the written predictions have them."""
    d = io.staged(labelled(spark, sf_dir).select("doc_id", "split_name", F.col("source").alias("question"), F.col("text").alias("model_answer"), *(F.col(c).cast("double").alias(c) for c in _FEATURES), F.col("quality").alias("label")))
    model = models.fit_logistic(d.where("split_name = 'train'"), _FEATURES)
    path = f"{io.scratch(spark)}/validation_predictions.parquet"
    made = models.probability(model, d.where("split_name = 'validation'"))
    io.write_table(made.select(F.col("doc_id").alias("id"), "split_name", "question", "model_answer", "label", "hallucination_prob"), path)
    return io.read_table(spark, path).withColumn("hallucination_prob", F.round("hallucination_prob", 6))


@models.scorer("score_a")
def _score_a(df: DataFrame):  # noqa: ANN202
    return F.col("score_a")


@models.scorer("score_b")
def _score_b(df: DataFrame):  # noqa: ANN202
    return F.col("score_b")


@query(f"with {LABELLED} select doc_id, round((score_a + (1 - score_b)) / 2, 9) as hallucination_prob from lab")
def mod4_5_src13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest is a file; its components are registered scorers."""
    path = f"{io.scratch(spark)}/manifest.json"
    blend = [{"name": "score_a", "weight": 1}, {"name": "score_b", "weight": 1, "invert": True}]
    io.write_json(spark, {"atomic_catboost_models": [{"name": "score_a"}], "qa_models": [{"name": "score_b"}], "solid_batch_independent_blend": blend}, path)
    d = models.score_manifest(labelled(spark, sf_dir), models.manifest_at(spark, path))
    return d.select("doc_id", F.round("hallucination_prob", 9).alias("hallucination_prob"))


@query()
def mod4_fitted_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fitted models saved, named by a manifest file, loaded from it and blended."""
    d = io.staged(labelled(spark, sf_dir).select("doc_id", *(F.col(c).cast("double").alias(c) for c in _FEATURES), F.col("quality").alias("label")))
    base, entries = io.scratch(spark), []
    for name, features in (("all", _FEATURES), ("scores", _FEATURES[1:])):
        models.save_model(models.fit_logistic(d, features), f"{base}/{name}", features)
        entries.append({"name": name, "model_path": f"{base}/{name}", "feature_columns_path": f"{base}/{name}.features.json"})
    io.write_json(spark, {"atomic_catboost_models": entries, "solid_batch_independent_blend": [{"name": "all", "weight": 3}, {"name": "scores", "weight": 1}]}, f"{base}/manifest.json")
    out = models.score_manifest(d, models.manifest_at(spark, f"{base}/manifest.json"))
    return out.select("doc_id", *(F.round(f"`{c}`", 6).alias(c) for c in ("score::all", "score::scores", "hallucination_prob")))


@query(f"with {QA} select id, 'greedy' as mode, 'echo: ' || substr(question, 1, 20) as model_answer from qa union all select id, 'sampled', substr(question, 1, 7) || '@0.7/0.9' from qa")
def mod6_7_8_udf1_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator interface with a stand-in that echoes its prompt, greedily and with sampling parameters."""

    def make():  # noqa: ANN202
        def echo(prompts: list[str], temperature: float = 0.0, top_p: float = 1.0, max_new_tokens: int = 20) -> list[str]:
            return [f"{p[:max_new_tokens]}@{temperature}/{top_p}" if temperature else f"echo: {p[:max_new_tokens]}" for p in prompts]

        return echo

    d = B.qa(spark, sf_dir).select("id", "question")
    parts = {"greedy": models.generate(d, "question", make), "sampled": models.generate(d, "question", make, temperature=0.7, top_p=0.9, max_new_tokens=7)}
    return A.union_widening(*(A.tagged(p.select("id", "model_answer"), "mode", k) for k, p in parts.items()))


@query("select event_id, user_id, value from events where event_id % 3 <> 0 union all select event_id, user_id, value from events where event_id % 3 = 0")
def inc1_2_4_snk4_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candor.streaming.incremental import resume

    path = f"{io.scratch(spark)}/cache"
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    resume(e.where("event_id % 3 <> 0"), path, ["event_id"], lambda d: d)
    return resume(e, path, ["event_id"], lambda d: d)


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(avg((value > 50)::int), 9) as rate from events group by all")
def stream_windowed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candor.streaming.incremental import windowed_rate

    d = windowed_rate(table(spark, sf_dir, "events"), "ts", F.col("value") > 50, by=["event_type"])
    return d.withColumn("rate", F.round("rate", 9))


@query(f"with {_SERIES}, s as (select user_id, v, greatest(1, n + 1 - 5) as a from v) select user_id, round(list_avg(list_slice(v, a, len(v))), 6) as mean, len(list_slice(v, a, len(v))) as n_tokens from s")
def arr5_response_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five predictions of each series, as a response of five tokens would have them."""
    d = series(spark, sf_dir).withColumn("r", R.response_slice(F.col("v"), F.size("v") + 1, F.lit(5)))
    return d.select("user_id", F.round(R.mean(F.col("r")), 6).alias("mean"), F.size("r").cast("long").alias("n_tokens"))


@query("select n_nationkey + 1 as n, least(8, n_nationkey)::int as early, ((n_nationkey + 1) // 2)::int as mid, least(10, n_nationkey)::int as l10, least(20, n_nationkey)::int as l20, least(30, n_nationkey)::int as l30, n_nationkey::int as last from nation")
def arr7_layer_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") + 1
    return table(spark, sf_dir, "nation").select(n.alias("n"), R.layer_picks(n).alias("p")).select("n", "p.*")


_LENS = "e{k} as (select vec_id, i, list_transform(z, lambda x: x * {scale}::double) as z from z), l{k} as (select *, list_max(z) as mx, ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) as lse from e{k}), s{k} as (select vec_id, avg(-list_sum(list_transform(z, lambda x: exp(x - lse) * (x - lse)))) as entropy, avg(exp(mx - lse)) as top1 from l{k} group by vec_id)"


@query(f"""with h as (select vec_id, i, list_transform(list_slice(embedding, i * 16 + 1, i * 16 + 16), lambda x: x::double) as h from embeddings, (select unnest(range(0, 4)) as i)),
z as (select vec_id, i, list_transform(range(0, 32), lambda k: list_sum(list_transform(range(0, 16), lambda j: sin((16 * k + j)::double) * h[j + 1]))) as z from h), {_LENS.format(k=1, scale=1)}, {_LENS.format(k=2, scale=0.5)}
select vec_id, round(s1.entropy, 5) as entropy, round(s1.top1, 5) as top1_prob, round(s1.entropy - s2.entropy, 5) as logit_lens_early_late_entropy_gap, round(abs(s1.top1 - s2.top1) / 2, 5) as logit_lens_top1_prob_trajectory_std from s1 join s2 using (vec_id)""")
def arr8_10_logit_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as hidden states of four tokens of width 16, under a fixed output matrix, and the summary over two layers."""
    head = np.sin(np.arange(32 * 16, dtype=float)).reshape(32, 16)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    states = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * 16 + 1, F.lit(16)))
    e = e.withColumn("h", states).withColumn("a", R.logit_lens(head)("h")).withColumn("b", R.logit_lens(head * 0.5)("h"))
    got = R.lens_summary(F.array("a.entropy", "b.entropy"), F.array("a.top1_prob", "b.top1_prob"))
    return e.select("vec_id", F.round("a.entropy", 5).alias("entropy"), F.round("a.top1_prob", 5).alias("top1_prob"), *(F.round(c, 5).alias(k) for k, c in got.items()))
