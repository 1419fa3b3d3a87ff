"""Micro-cases of the label cascade and of single functions, with the Russian word lists."""

import pytest
from pyspark.sql import functions as F

from candor.functions import arrays as R
from candor.functions import features as FE
from candor.functions import text as T
from candor.functions.lexicon import RU_V1, RU_V2, RU_V3
from candor.operators import assemble, coerce, labels, metrics, rank

CASES = [
    ("Не знаю.", ["1927"], "", 1, "uncertainty_marker"),
    ("в 1928 году", ["1927", "в 1927 году"], "", 1, "numeric_mismatch"),
    ("5", ["5.0"], "", 1, "numeric_mismatch"),
    ("«Москва»", ["москва"], "", 0, "exact_match"),
    ("1,5 млн", ["1.5 млн"], "", 0, "exact_match"),
    ("в 1927", ["1927", "в 1927 году"], "", 0, "substring_match"),
    ("", ["Москва"], "", 0, "substring_match"),
    ("большой красный дом у реки", ["красный большой дом у реки"], "", 0, "high_token_f1"),
    ("из Москвы и Казани", ["Казани, Москвы"], "", 0, "high_content_f1"),
    ("железнодорожниками", ["железнодорожникам и"], "", 0, "high_char_similarity"),
    ("Москве", ["Москва"], "", 0, "single_token_inflection"),
    ("великий князь Иван третий", ["великий князь Василий третий"], "", 0, "paraphrase_or_inflection"),
    ("железный и стальной мост", ["железный для стальная мост"], "", 0, "content_overlap_paraphrase"),
    ("слон", ["тройка"], "река и дом", 1, "low_similarity_unsupported"),
    ("ответ", [], "", 1, "low_similarity_unsupported"),
    ("слон", ["тройка"], "слон и дом", None, "manual_review"),
    ("князя Ивана Грозного", ["князь Иван Грозный"], "", None, "manual_review"),
]


def test_cascade(spark):
    d = spark.createDataFrame([(str(i), a, g, c) for i, (a, g, c, _, _) in enumerate(CASES)], "id string, model_answer string, gold_answers_text array<string>, context string")
    got = {r["id"]: (r["weak_label"], r["weak_label_reason"]) for r in labels.weak_labels(d, RU_V3).collect()}
    assert [got[str(i)] for i in range(len(CASES))] == [(label, reason) for *_, label, reason in CASES]


def one(spark, c, **cols):
    d = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()))
    return d.select(c).first()[0]


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, T.normalize(x), x="А-б: «Ёж», x_y — 3.14!") == "аб еж xy — 314"
    assert one(spark, T.tokens(x), x="") == []
    assert one(spark, T.number_tokens(x), x="10, 20 и 1,5") == ["10", "20", "1.5"]
    assert one(spark, T.char_similarity(x, F.col("y")), x="tide", y="diet") == 0.25
    assert one(spark, T.char_similarity(x, F.col("y")), x="diet", y="tide") == 0.5
    assert one(spark, T.first_sentence(x), x=" Раз. Два! Три") == "Раз."
    assert one(spark, T.core_span(x, RU_V3), x="Москва, потому что так. Да.") == "Москва"


def test_array_functions(spark):
    v = F.col("v")
    d = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],)], "v array<double>")
    assert d.select(R.percentile(v, 10)).first()[0] == pytest.approx(1.3)
    assert d.select(R.max_drop(v)).first()[0] == 2.0
    assert d.select(R.max_window_mean(v, 3)).first()[0] == pytest.approx(13 / 3)
    empty = spark.createDataFrame([([],)], "v array<double>")
    assert empty.select(R.mean(v), R.max_drop(v), R.tail_degradation(v)).first()[:] == (0.0, 0.0, 0.0)


def test_metrics(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1)], "y int, s double")
    r = metrics.evaluate(d, F.col("y"), F.col("s")).first()
    assert r["pr_auc"] == pytest.approx(0.75) and r["roc_auc"] == pytest.approx(0.75)
    assert (r["accuracy_at_threshold"], r["precision_at_threshold"], r["recall_at_threshold"]) == (0.6, 0.5, 1.0)
    assert r["f1_at_threshold"] == pytest.approx(2 / 3)
    single = metrics.ranking_metrics(d.where("y = 0"), F.col("y"), F.col("s")).first()
    assert single["pr_auc"] is None and single["roc_auc"] is None


def test_percentile_rank(spark):
    d = spark.createDataFrame([(0, 0.1), (1, 0.5), (2, 0.5), (3, None), (4, 0.9)], "i int, s double")
    got = {r["i"]: r["s_rank"] for r in rank.percentile_rank(d, "s").collect()}
    assert got == {0: 0.25, 1: 0.625, 2: 0.625, 3: None, 4: 1.0}


def test_apportion_and_splits(spark):
    assert assemble.apportion({"train": 7, "validation": 3}, 5) == {"train": 3, "validation": 2}
    for n, share, want in ((0, 0.2, 0), (1, 0.2, 0), (2, 0.2, 1), (5, 0.2, 1), (10, 0.2, 2), (5, 0.5, 2)):
        d = assemble.random_split(spark.range(n), "id", share)
        assert d.where("split_name = 'validation'").count() == want and d.count() == n
    with pytest.raises(ValueError):
        assemble.exact_sample(spark.range(3), 4, "id")


def test_question_flags(spark):
    d = spark.createDataFrame([("В каком году ...",), ("Сколько ...",), ("никто",)], "question string").withColumn("model_answer", F.lit("да"))
    got = {r["question"]: r for r in FE.select_bundle(FE.prepare(d, RU_V3), ["question"], FE.question_flags(RU_V3)).collect()}
    assert got["В каком году ..."]["expects_date"] == 1 and got["Сколько ..."]["expects_number"] == 1 and got["никто"]["expects_person"] == 0


def test_dense_bundles(spark):
    g = F.array(F.lit("x"))
    assert (len(FE.dense_v1(g, RU_V1)), len(FE.dense_v2(RU_V2)), len(FE.dense_v3(RU_V3)), len(FE.surface())) == (30, 60, 73, 14)
    assert len(FE.dense_v1(g, RU_V1, leaky=False)) == 27


def test_lists(spark):
    d = spark.createDataFrame([('["a", "b"]',), ("('c', 'd')",), ("plain",), ("",), (None,), ('{"text": ["e"]}',)], "x string")
    assert [r[0] for r in d.select(coerce.as_list(d, "x")).collect()] == [["a", "b"], ["c", "d"], ["plain"], [], [], ["e"]]


def test_blend_and_weights(spark):
    d = spark.createDataFrame([(0.8, 0.3)], "a double, b double")
    spec = [{"name": "a", "weight": 1}, {"name": "b", "weight": 3, "invert": True}]
    assert d.select(rank.blend({"a": F.col("a"), "b": F.col("b")}, spec)).first()[0] == pytest.approx(0.725)
    assert rank.parse_weights("1, 2", 2) == [1.0, 2.0] and rank.parse_weights(None, 3) == [1.0] * 3
    with pytest.raises(ValueError):
        rank.parse_weights("1", 2)
