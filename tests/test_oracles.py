"""Every registered query with SQL gives the same rows in Spark and in DuckDB on the smallest tables."""

import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from candor import registry
from candor.operators import models, tfidf
from candor.plans import base

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def canon(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str([canon(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = registry.queries()[name](spark, SF)
    mine = sorted(tuple(canon(r[c]) for c in sorted(df.columns)) for r in df.collect())
    got = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    theirs = sorted(tuple(canon(r[i]) for i in order) for r in got.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_bundle_at_ties_of_rounding(spark, tmp_path):
    """Series of 2 to 32 values of two digits, many of whose means and variances lie halfway between two numbers of five digits."""
    rng = random.Random(1)
    values = [(u, round(rng.random() * 40, 1 + u % 2)) for u in range(400) for _ in range(2 ** (1 + u % 5))]
    rows = [(k, u, datetime(2024, 1, 1) + timedelta(seconds=k), "view", v) for k, (u, v) in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"file://{tmp_path}/events.parquet")
    mine = {r["user_id"]: r.asDict() for r in registry.queries()["arr6_17_response_statistics"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = c.execute(registry.oracle_sql()["arr6_17_response_statistics"])
    columns = [d[0] for d in got.description]
    theirs = {r["user_id"]: r for r in (dict(zip(columns, row, strict=True)) for row in got.fetchall())}
    assert len(theirs) == 400 and mine == theirs


def test_cleanups_of_odd_texts(spark, tmp_path):
    """Empty and null texts, labels, refusals, line ends and blanks of every kind, in random order."""
    rng = random.Random(2)
    pieces = ["", "a", "b c", "Answer:", "answer - ", "Cannot answer", "cannot answer.", "i do not know", " ", "\t", "\n", "\n\n", "\r\n", "\r\n\r\n", "\r", "\f", *"\v\x00\x1c\x1f\x85\xa0\u1680\u2003\u2028\u2029\u3000\ufeff", "ſ", "К", "😀", "."]
    texts = [None, "", " ", "\n", "\r\n", *pieces, *("".join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(20000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    mine = {r["doc_id"]: r[1:] for r in registry.queries()["txt24_25_26_cleanups"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    theirs = {r[0]: r[1:] for r in c.execute(registry.oracle_sql()["txt24_25_26_cleanups"]).fetchall()}
    differ = {k: (texts[k], mine.get(k), v) for k, v in theirs.items() if mine.get(k) != v}
    assert len(mine) == len(theirs) == len(texts) and not differ, f"{len(differ)} differ, as {list(differ.values())[:3]}"


def test_sparse_blocks_are_those_of_hashed_grams(spark):
    """Words cut and hashed in numpy give the vectors that HashingTF gives for the grams as texts, row by row."""
    out = registry.queries()["txt31_sparse_blocks"](spark, SF)
    d = base.qa(spark, SF).select("id", tfidf.word_ngrams(F.col("question")).alias("question"), tfidf.char_wb_ngrams(F.col("model_answer")).alias("answer"))
    vectors = models.hashed_text_block(["question", "answer"]).fit(d).transform(d).select("id", "_features").collect()
    assert {v.size for _, v in vectors} == {2 << 18}
    assert dict(map(tuple, out.collect())) == {k: v.numNonzeros() for k, v in vectors}
