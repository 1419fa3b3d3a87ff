"""Command line: label answers, build features, evaluate predictions, average ranks, split and sample tables.

python -m candor label --input answers.parquet --output labelled
python -m candor features --input answers.parquet --output features.parquet --bundle v3
python -m candor evaluate --input predictions.parquet --label is_hallucination --score hallucination_prob [--output metrics.json]
python -m candor rank-average --inputs a.parquet,b.parquet --key id --score hallucination_prob --weights 2,1 --output out.parquet
python -m candor split --input all.parquet --key id --share 0.2 [--label label] --output out.parquet
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from candor.functions import features as FE
from candor.functions.lexicon import PACKS
from candor.operators import assemble, coerce, labels, metrics, rank
from candor.session import build_session
from candor.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="candor", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [sub.choices[name].add_argument(*o[0], **o[1]) for o in options] if name in sub.choices else None
    text = lambda name, **kw: ((f"--{name}",), kw)
    for name, options in {
        "label": [text("input", required=True), text("output", required=True), text("lexicon", default="ru", choices=sorted(PACKS)), text("split")],
        "features": [text("input", required=True), text("output", required=True), text("bundle", default="v3", choices=["surface", "v1", "v2", "v3"]), text("key", default="id")],
        "evaluate": [text("input", required=True), text("label", default="is_hallucination"), text("score", default="hallucination_prob"), text("threshold", type=float, default=0.5), text("output")],
        "rank-average": [text("inputs", required=True), text("key", default="id"), text("score", default="hallucination_prob"), text("weights", default=""), text("output", required=True)],
        "split": [text("input", required=True), text("key", default="id"), text("share", type=float, default=0.2), text("label"), text("seed", type=int, default=42), text("output", required=True)],
    }.items():
        sub.add_parser(name)
        add(name, *options)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session(f"candor {a.command}")
    if a.command == "label":
        d = io.read_table(spark, a.input)
        d = assemble.keep_split(d, a.split) if a.split else d
        golds = coerce.gold_column(d)
        d = d.withColumn("gold_answers_text", coerce.as_list(d, golds))
        io.write_labelled(labels.weak_labels(d, PACKS[a.lexicon]), a.output)
    elif a.command == "features":
        d = FE.prepare(io.read_table(spark, a.input), PACKS["ru_v3" if a.bundle == "surface" else f"ru_{a.bundle}"])
        made = {"surface": FE.surface, "v1": lambda: FE.dense_v1(F.array(), leaky=False), "v2": FE.dense_v2, "v3": FE.dense_v3}[a.bundle]()
        io.write_table(FE.select_bundle(d, [a.key], made), a.output)
    elif a.command == "evaluate":
        d = io.read_table(spark, a.input)
        got = io.row_as_dict(metrics.evaluate(d, coerce.to_binary(d, a.label), coerce.number_or_zero(F.col(a.score).cast("string")), a.threshold))
        got |= {"label_column": a.label, "score_column": a.score}
        print(json.dumps(got, indent=2))
        if a.output:
            io.write_json(spark, got, a.output)
    elif a.command == "rank-average":
        frames = [io.read_table(spark, p) for p in coerce.comma_set(a.inputs)]
        scored = rank.rank_average([f.select(a.key, a.score) for f in frames], a.key, a.score, a.weights or None, name="hallucination_prob")
        io.write_table(frames[0].drop("hallucination_prob").join(scored.select(a.key, "hallucination_prob"), a.key), a.output)
    else:
        d = io.read_table(spark, a.input)
        out = assemble.stratified_split(d, a.label, a.key, a.share, a.seed) if a.label else assemble.random_split(d, a.key, a.share, a.seed)
        io.write_table(out, a.output)


if __name__ == "__main__":
    main()
