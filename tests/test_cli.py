"""The command line writes what the operators give."""

import json

from candor.__main__ import main


def test_commands(spark, tmp_path, capsys):
    rows = [(str(i), "Сколько их?", f"их {i}", ["5"], "их 5", i % 3 == 0, i / 10) for i in range(10)]
    spark.createDataFrame(rows, "id string, question string, model_answer string, gold_answers_text array<string>, context string, is_hallucination boolean, hallucination_prob double").write.parquet(f"{tmp_path}/a.parquet")
    src = f"{tmp_path}/a.parquet"
    main(["label", "--input", src, "--output", f"{tmp_path}/lab"])
    assert spark.read.parquet(f"{tmp_path}/lab/labeling_dataset.parquet").count() == 10
    main(["features", "--input", src, "--output", f"{tmp_path}/f.parquet"])
    assert len(spark.read.parquet(f"{tmp_path}/f.parquet").columns) == 74
    main(["evaluate", "--input", src, "--output", f"file://{tmp_path}/m.json"])
    assert json.loads((tmp_path / "m.json").read_text())["rows"] == 10 and "pr_auc" in capsys.readouterr().out
    main(["rank-average", "--inputs", f"{src},{src}", "--output", f"{tmp_path}/r.parquet"])
    assert spark.read.parquet(f"{tmp_path}/r.parquet").agg({"hallucination_prob": "max"}).first()[0] == 1.0
    main(["split", "--input", src, "--output", f"{tmp_path}/s.parquet"])
    assert spark.read.parquet(f"{tmp_path}/s.parquet").where("split_name = 'validation'").count() == 2
