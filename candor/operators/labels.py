"""Weak labels: match flags, the best gold, the rule cascade, and what is derived from labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from candor.functions import text as T
from candor.functions.lexicon import RU_V3, Lexicon
from candor.operators.coerce import flag_of


def match_flags(df: DataFrame, lex: Lexicon = RU_V3, answer: str = "model_answer", golds: str = "gold_answers_text", context: str = "context") -> DataFrame:
    """Add normalised answer and golds, exact and substring matches, uncertainty and support by the context."""
    out = df.withColumns({"normalized_model_answer": T.normalize(F.col(answer)), "normalized_gold_answers": F.transform(F.coalesce(F.col(golds), F.array().cast("array<string>")), T.normalize)})
    a, g = F.col("normalized_model_answer"), F.col("normalized_gold_answers")
    return out.withColumns({
        "exact_match_any": T.exact_match_any(a, g),
        "substring_match_any": T.substring_match_any(a, g),
        "has_uncertainty_marker": T.has_phrase(a, lex.uncertainty),
        "model_answer_supported_by_context": T.supported_by_context(a, T.normalize(F.col(context)), lex) if context in df.columns else F.lit(False),
    })


def best_gold(df: DataFrame, lex: Lexicon = RU_V3, key: str = "id", answer: str = "model_answer", golds: str = "gold_answers_text", similarity: bool = True) -> DataFrame:
    """Add the best gold by token F1, content F1 and character similarity (first wins ties), its scores, and number tokens.

    Both F1s stay in the JVM. Character similarity needs a Python function; it is called for one gold per row, or, where golds tie
    on both F1s, for those, since only then does it decide. ``similarity=False`` leaves it out (0) and ties to the first gold.
    """
    mine = F.col("_mine")
    none = F.array().cast("array<string>")
    d = df.withColumn("_mine", T.tokens(F.col(answer))).withColumn("_mine_content", T.content_tokens(F.col("_mine"), lex))
    d = d.withColumn("_golds", F.coalesce(F.col(golds), none))
    d = d.withColumn("_toks", F.transform("_golds", T.tokens))
    scored = F.transform(
        F.arrays_zip("_golds", "_toks"),
        lambda z, i: F.struct(
            T.multiset_f1(mine, z["_toks"]).alias("f1"),
            T.multiset_f1(F.col("_mine_content"), T.content_tokens(z["_toks"], lex)).alias("cf1"),
            (-i).alias("order"),
            z["_golds"].alias("gold"),
        ),
    )
    d = d.withColumn("_scored", scored).withColumn("_top", F.array_max("_scored"))
    d = d.withColumn("_tied", F.filter("_scored", lambda s: (s["f1"] == F.col("_top")["f1"]) & (s["cf1"] == F.col("_top")["cf1"])))
    if similarity:
        core = T.strip_leading_function_words(T.normalize(F.col(answer)), lex)
        d = d.withColumn("_sims", similarities(core, F.transform("_tied", lambda s: T.strip_leading_function_words(T.normalize(s["gold"]), lex))))
        best = F.array_max(F.transform(F.arrays_zip("_tied", "_sims"), lambda z: F.struct(z["_sims"].alias("sim"), z["_tied"]["order"].alias("order"), z["_tied"]["gold"].alias("gold"))))
        d = d.withColumn("_best", best)
    else:
        d = d.withColumn("_best", F.struct(F.lit(0.0).alias("sim"), F.col("_top")["order"].alias("order"), F.col("_top")["gold"].alias("gold")))
    d = d.withColumns({
        "best_gold_answer": F.coalesce(F.col("_best")["gold"], F.lit("")),
        "token_f1_max": F.coalesce(F.col("_top")["f1"], F.lit(0.0)),
        "content_token_f1_max": F.coalesce(F.col("_top")["cf1"], F.lit(0.0)),
        "char_similarity_max": F.coalesce(F.col("_best")["sim"], F.lit(0.0)),
        "answer_numbers": T.number_tokens(F.col(answer)),
    })
    d = d.withColumn("gold_numbers_best", T.number_tokens(F.col("best_gold_answer")))
    return d.drop("_mine", "_mine_content", "_golds", "_toks", "_scored", "_top", "_tied", "_sims", "_best")


@F.pandas_udf(ArrayType(DoubleType()))
def similarities(a: pd.Series, many: pd.Series) -> pd.Series:
    """Character similarity of each text to each of several; 0 where either is empty."""
    from difflib import SequenceMatcher

    def ratio(x: str, y: str) -> float:
        return SequenceMatcher(None, x, y).ratio() if x and y else 0.0

    return pd.Series([[ratio(x or "", y or "") for y in (ys if ys is not None else [])] for x, ys in zip(a, many, strict=True)])


def cascade(df: DataFrame, lex: Lexicon = RU_V3) -> DataFrame:
    """Add ``weak_label`` and ``weak_label_reason``: the first rule that holds decides, the last sends a row to review."""
    f1, cf1, sim = (F.col(c) for c in ("token_f1_max", "content_token_f1_max", "char_similarity_max"))
    words = lambda c: F.size(T.split_words(T.strip_leading_function_words(T.normalize(F.col(c)), lex)))
    a, g = F.col("answer_numbers"), F.col("gold_numbers_best")
    rules = [
        (F.col("has_uncertainty_marker"), 1, "uncertainty_marker"),
        ((F.size(a) > 0) & (F.size(g) > 0) & (a != g), 1, "numeric_mismatch"),
        (F.col("exact_match_any"), 0, "exact_match"),
        (F.col("substring_match_any"), 0, "substring_match"),
        (f1 >= 0.85, 0, "high_token_f1"),
        (cf1 >= 0.9, 0, "high_content_f1"),
        (sim >= 0.92, 0, "high_char_similarity"),
        ((words("model_answer") == 1) & (words("best_gold_answer") == 1) & (sim >= 0.78), 0, "single_token_inflection"),
        ((f1 >= 0.55) & (sim >= 0.72), 0, "paraphrase_or_inflection"),
        ((cf1 >= 0.6) & (sim >= 0.72), 0, "content_overlap_paraphrase"),
        ((f1 <= 0.15) & (cf1 <= 0.2) & (sim <= 0.35) & ~F.col("model_answer_supported_by_context"), 1, "low_similarity_unsupported"),
    ]
    verdict = F.struct(F.lit(None).cast("int").alias("label"), F.lit("manual_review").alias("reason"))
    for holds, label, reason in reversed(rules):
        verdict = F.when(holds, F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))).otherwise(verdict)
    return df.withColumn("_v", verdict).withColumns({"weak_label": F.col("_v")["label"], "weak_label_reason": F.col("_v")["reason"]}).drop("_v")


def review_flags(df: DataFrame) -> DataFrame:
    none = F.lit(None)
    return df.withColumns({
        "needs_manual_review": F.col("weak_label").isNull(),
        "is_hallucination_heuristic": F.coalesce(F.col("weak_label"), F.lit(0)) == 1,
        "is_hallucination_manual": none.cast("boolean"),
        "reviewer_comment": F.lit(""),
    })


def weak_labels(df: DataFrame, lex: Lexicon = RU_V3, similarity: bool = True) -> DataFrame:
    """The whole labelling of ``(model_answer, gold_answers_text, context)`` rows: one narrow stage, no shuffle."""
    return review_flags(cascade(best_gold(match_flags(df, lex), lex, similarity=similarity), lex))


def generation_label(f1: Column, exact: Column, answer: Column, supported: Column | None = None) -> Column:
    """Automatic label of a generated answer, null where it is ambiguous.

    With a context: 1 if F1 is under .25, unsupported and longer than 10 characters; without: longer than 5. 0 if F1 is above .7
    or exact.
    """
    length = F.length(T.strip(T.text(answer)))
    wrong = (f1 < 0.25) & ((~supported & (length > 10)) if supported is not None else (length > 5))
    return F.when(wrong, 1).when((f1 > 0.7) | exact, 0)


def effective_label(weak: Column, manual: Column) -> Column:
    """A manual label that can be read, else a weak one of 0 or 1, else null."""
    w = weak.cast("string").try_cast("double")
    return F.coalesce(flag_of(manual), F.when(w == 0, 0).when(w == 1, 1))


def training_label(weak: Column, manual: Column) -> Column:
    """Manual overrides weak; null where there is neither. A manual text that can't be read leaves weak, or 0."""
    label = F.coalesce(flag_of(manual), F.coalesce(weak.cast("int"), F.lit(0)))
    return F.when(weak.isNotNull() | manual.isNotNull(), label)


def heuristic_training_label(df: DataFrame, threshold: float = 0.9) -> Column:
    """Label of tables without weak labels: manual, else heuristic positives, else clear negatives; null for the rest."""
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    positive = yes("is_hallucination_heuristic")
    negative = yes("exact_match_any") | yes("substring_match_any") | (F.coalesce(F.col("token_f1_max"), F.lit(0.0)) >= threshold)
    manual = F.col("is_hallucination_manual") if "is_hallucination_manual" in df.columns else F.lit(None).cast("string")
    weak = F.when(positive, 1).when(negative, 0)
    return F.when(manual.isNotNull() | weak.isNotNull(), F.coalesce(flag_of(manual), weak, F.lit(0)))


def label_proxy(label: Column) -> Column:
    return F.when(label == 1, "positive").when(label == 0, "negative").otherwise("null")
