"""Feature bundles over question, answer and context. All outputs are doubles, named as in the feature tables.

Normalised texts and token arrays are computed once per row (``prepare``) and shared by all bundles, as Catalyst doesn't share what
is inside lambda bodies. Every bundle is a dict of columns, so a caller selects all it wants in one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions import text as T
from candor.functions.lexicon import RU_V1, RU_V2, RU_V3, Lexicon

Bundle = dict[str, Column]
QUESTION_KINDS = ("person", "date", "number", "location", "yesno", "reason")
SHORT_FACT_KINDS = QUESTION_KINDS[:5]


def question_text(df: DataFrame) -> Column:
    """``question``, else ``prompt``, else empty: whichever columns there are."""
    found = [F.col(c).cast("string") for c in ("question", "prompt") if c in df.columns]
    return F.coalesce(*found, F.lit(""))


def answer_text(df: DataFrame) -> Column:
    return F.coalesce(F.col("model_answer").cast("string"), F.lit("")) if "model_answer" in df.columns else F.lit("")


def prepare(df: DataFrame, lex: Lexicon = RU_V3) -> DataFrame:
    """Add the shared columns (leading underscore): raw and normalised texts, tokens, numbers, years, core span."""
    out = df.withColumns({"_q": question_text(df), "_raw_a": answer_text(df)})
    if "context" in df.columns:
        out = out.withColumn("_c", T.text(F.col("context")))
    out = out.withColumn("_a", T.strip(F.col("_raw_a")))
    out = out.withColumns({"_qn": T.normalize(F.col("_q")), "_an": T.normalize(F.col("_a")), "_core": T.core_span(F.col("_raw_a"), lex), "_first": T.first_sentence(F.col("_raw_a"))})
    out = out.withColumns({
        "_qt": T.split_words(F.col("_qn")),
        "_at": T.split_words(F.col("_an")),
        "_coren": T.normalize(F.col("_core")),
        "_qnum": T.number_tokens(F.col("_q")),
        "_anum": T.number_tokens(F.col("_raw_a")),
        "_qyear": T.year_tokens(F.col("_q")),
        "_ayear": T.year_tokens(F.col("_a")),
    })
    return out.withColumns({"_coret": T.split_words(F.col("_coren")), "_corenum": T.number_tokens(F.col("_core")), "_coreyear": T.year_tokens(F.col("_core"))})


def num(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _some(arr: str) -> Column:
    return F.size(arr) > 0


def _has_digit(c: str) -> Column:
    return F.col(c).rlike(r"(?U)\d")


def _yes_in(arr: str, n: int, lex: Lexicon) -> Column:
    return F.exists(F.slice(arr, 1, n), lambda t: t.isin(*lex.yes_no))


def _months(c: str, lex: Lexicon) -> Column:
    return T.has_phrase(F.col(c), lex.months, lex.month_stems)


def _expects(kind: str, lex: Lexicon) -> Column:
    if kind == "yesno":
        return T.has_phrase(F.col("_qn"), lex.yesno_openers, anchored=True)
    return T.has_phrase(F.col("_qn"), getattr(lex, kind))


def question_flags(lex: Lexicon, extended: bool = True) -> Bundle:
    """What a question asks for; ``extended`` adds reasons, short facts and hints inside the question."""
    kinds = QUESTION_KINDS if extended else SHORT_FACT_KINDS
    out = {f"expects_{k}": num(_expects(k, lex)) for k in kinds}
    if extended:
        short = F.lit(False)
        for k in SHORT_FACT_KINDS:
            short = short | _expects(k, lex)
        out |= {
            "expects_short_fact": num(short),
            "question_has_year": num(_some("_qyear")),
            "question_has_digit": num(_has_digit("_q")),
            "question_has_month_name": num(_months("_qn", lex)),
            "question_has_ordinal_hint": num(T.has_phrase(F.col("_qn"), lex.ordinals, lex.ordinal_stems)),
        }
    return out


def answer_shape(lex: Lexicon, version: int) -> Bundle:
    a, n = F.col("_a"), F.size("_at")
    ratios = {"answer_upper_ratio": num(T.upper_ratio(a)), "answer_punct_ratio": num(T.punctuation_ratio(a))}
    out = {
        "answer_char_len": num(F.length(a)),
        "answer_word_len": num(n),
        "answer_digit_count": num(T.digit_count(a)),
        "answer_has_digit": num(_has_digit("_a")),
        "answer_has_year_like": num(_some("_ayear")),
        "answer_has_yes_token": num(_yes_in("_at", 2 if version == 1 else 4, lex)),
        "answer_is_short": num(n <= 3),
        "answer_is_long": num(n >= 12),
    }
    if version == 1:
        return out | ratios
    out |= {
        "answer_sentence_count": num(T.sentence_count(a)),
        "answer_numeric_token_count": num(F.size(T.number_tokens(a))),
        "answer_year_token_count": num(F.size("_ayear")),
        "answer_has_month_name": num(_months("_an", lex)),
        "answer_is_very_short": num(n <= 1),
        "answer_is_very_long": num(n >= 24),
        "answer_has_hedging": num(T.has_phrase(F.col("_an"), lex.hedging)),
        "answer_has_explanation_marker": num(T.has_phrase(F.col("_an"), lex.explanation)),
    }
    if version == 2:
        out |= ratios | {
            "answer_has_parentheses": num(a.rlike("[()]")),
            "answer_has_colon": num(F.contains(a, F.lit(":"))),
            "answer_has_comma": num(F.contains(a, F.lit(","))),
            "answer_starts_with_namecase": num(T.starts_capitalised(a)),
        }
    return out


def type_mismatch(lex: Lexicon, version: int) -> Bundle:
    """Flags, shape, and their crosses: where the shape of an answer fits or misses what the question asks for."""
    q, a = question_flags(lex, version > 1), answer_shape(lex, version)
    both = lambda x, y: num((x > 0) & y)
    digit, year = a["answer_has_digit"] > 0, a["answer_has_year_like"] > 0
    out = q | a
    out |= {
        "mismatch_person_but_has_digit": both(q["expects_person"], digit),
        "mismatch_date_but_no_digit": both(q["expects_date"], ~digit),
        "mismatch_number_but_no_digit": both(q["expects_number"], ~digit),
        "mismatch_location_but_has_year": both(q["expects_location"], year),
        "mismatch_yesno_but_not_yesno": both(q["expects_yesno"], a["answer_has_yes_token"] == 0),
        "match_number_expected_and_present": both(q["expects_number"], _some("_anum")),
        "match_date_expected_and_present": both(q["expects_date"], year if version == 1 else year | (a["answer_has_month_name"] > 0)),
    }
    if version > 1:
        out |= {
            "mismatch_shortfact_but_very_long": both(q["expects_short_fact"], a["answer_is_very_long"] > 0),
            "mismatch_shortfact_but_multisentence": both(q["expects_short_fact"], a["answer_sentence_count"] >= 2),
            "mismatch_reason_but_too_short": both(q["expects_reason"], a["answer_is_short"] > 0),
        }
    if version < 3:
        out["match_person_expected_and_titlecase"] = both(q["expects_person"], T.starts_capitalised(F.col("_raw_a" if version == 1 else "_a")))
    return out


def lexical_pair(version: int) -> Bundle:
    out = {"qa_token_overlap_count": num(F.size(F.array_intersect("_qt", "_at"))), "qa_token_jaccard": num(T.jaccard(F.col("_qt"), F.col("_at")))}
    if version < 3:
        name, n = ("qa_question_in_answer", 20) if version == 1 else ("qa_question_prefix_in_answer", 25)
        out |= {
            "qa_answer_in_question": num((F.col("_an") != "") & F.contains("_qn", F.col("_an"))),
            name: num((F.col("_qn") != "") & F.contains("_an", F.substring("_qn", 1, n))),
        }
    return out


def numeric_consistency() -> Bundle:
    year_a = T.year_tokens(F.col("_raw_a"))
    size = lambda c: num(F.size(c))
    return {
        "qa_shared_number_count": size(F.array_intersect("_qnum", "_anum")),
        "qa_new_answer_number_count": size(F.array_except("_anum", "_qnum")),
        "qa_missing_question_number_count": size(F.array_except("_qnum", "_anum")),
        "qa_shared_year_count": size(F.array_intersect(F.col("_qyear"), year_a)),
        "qa_new_answer_year_count": size(F.array_except(year_a, F.col("_qyear"))),
        "answer_has_more_numbers_than_question": num(F.size("_anum") > F.size("_qnum")),
        "answer_introduces_year_without_question_year": num((F.size(year_a) > 0) & ~_some("_qyear")),
        "question_has_year_but_answer_not": num(_some("_qyear") & (F.size(year_a) == 0)),
    }


def verbosity(version: int) -> Bundle:
    out = {
        "answer_to_question_word_ratio": num(F.size("_at") / F.greatest(F.size("_qt"), F.lit(1))),
        "answer_longer_than_question": num(F.size("_at") > F.size("_qt")),
        "answer_has_multiple_sentences": num(T.sentence_count(F.col("_raw_a")) >= 2),
    }
    if version == 2:
        out["answer_starts_with_repeat_of_question"] = num(_some("_at") & F.contains("_qn", F.array_join(F.slice("_at", 1, 3), " ")))
    return out


def first_span(lex: Lexicon) -> Bundle:
    """The core of the answer against what follows it and against the question."""
    core, tail = F.size("_coret"), F.greatest(F.size("_at") - F.size("_coret"), F.lit(0))
    q = {k: v > 0 for k, v in question_flags(lex).items()}
    short, month = q["expects_short_fact"], _months("_coren", lex)
    both_empty = (core == 0) | (F.size("_qt") == 0)
    return {
        "core_word_len": num(core),
        "core_is_short": num(core <= 5),
        "core_sentence_overlap_jaccard": F.when(both_empty, 0.0).otherwise(T.jaccard(F.col("_coret"), F.col("_qt"))),
        "core_has_digit": num(_some("_corenum")),
        "core_has_year_like": num(_some("_coreyear")),
        "core_has_month_name": num(month),
        "core_has_yes_token": num(_yes_in("_coret", 3, lex)),
        "core_number_count": num(F.size("_corenum")),
        "core_year_count": num(F.size("_coreyear")),
        "core_shared_question_number_count": num(F.size(F.array_intersect("_corenum", "_qnum"))),
        "core_shared_question_year_count": num(F.size(F.array_intersect("_coreyear", "_qyear"))),
        "tail_word_len": num(tail),
        "tail_to_core_ratio": num(tail / F.greatest(core, F.lit(1))),
        "answer_has_long_tail_after_short_core": num((core <= 5) & (tail >= 8)),
        "shortfact_core_good_shape": num(short & (core <= 6)),
        "shortfact_but_first_sentence_long": num(short & (F.size(T.tokens(F.col("_first"))) >= 12)),
        "shortfact_but_long_tail": num(short & (core <= 6) & (tail >= 10)),
        "date_question_core_missing_date": num(q["expects_date"] & ~(_some("_coreyear") | month)),
        "number_question_core_missing_number": num(q["expects_number"] & ~_some("_corenum")),
        "yesno_question_core_missing_yesno": num(q["expects_yesno"] & ~_yes_in("_coret", 2, lex)),
        "location_question_core_has_year": num(q["expects_location"] & _some("_coreyear")),
        "person_question_core_has_digit": num(q["expects_person"] & _some("_corenum")),
        "ordinal_question_core_missing_number": num(q["question_has_ordinal_hint"] & ~_some("_corenum")),
    }


def gold_comparison(golds: Column, lex: Lexicon) -> Bundle:
    """Maxima over golds, each on its own. They look at the gold, so a model that has them has seen the label."""
    mine = F.col("_at")
    best = lambda f: F.coalesce(F.array_max(F.transform(golds, f)), F.lit(0.0))
    return {
        "gold_token_f1_max": best(lambda g: T.multiset_f1(mine, T.tokens(g))),
        "gold_content_f1_max": best(lambda g: T.multiset_f1(T.content_tokens(mine, lex), T.content_tokens(T.tokens(g), lex))),
        "gold_char_match_hint": best(lambda g: (T.normalize(g) == F.col("_an")).cast("double")),
    }


def surface() -> Bundle:
    """The 14 surface features of question, context and answer."""
    ct = T.tokens(F.col("_c"))
    a, c, at, qt = F.col("_raw_a"), F.col("_c"), F.col("_at"), F.col("_qt")
    lines = F.length(a) - F.length(F.replace(a, F.lit("\n"), F.lit(""))) + 1
    return {
        "answer_char_len": num(F.length(a)),
        "answer_word_len": num(F.size(at)),
        "answer_line_count": num(F.when(a == "", 0).otherwise(lines)),
        "answer_digit_count": num(T.digit_run_count(a)),
        "answer_upper_token_count": num(T.capitalised_count(a)),
        "question_digit_count": num(T.digit_run_count(F.col("_q"))),
        "context_digit_count": num(T.digit_run_count(c)),
        "question_answer_overlap": num(T.overlap_ratio(at, qt)),
        "context_answer_overlap": num(T.overlap_ratio(at, ct)),
        "question_answer_jaccard": num(T.jaccard(at, qt)),
        "context_answer_jaccard": num(T.jaccard(at, ct)),
        "answer_in_context": num((a != "") & (c != "") & F.contains(T.normalize(c), F.col("_an"))),
        "context_len_chars": num(F.length(c)),
        "question_len_chars": num(F.length(F.col("_q"))),
    }


def dense_v1(golds: Column, lex: Lexicon = RU_V1, leaky: bool = True) -> Bundle:
    """30 columns; without ``leaky`` the three that look at the gold are left out."""
    return type_mismatch(lex, 1) | lexical_pair(1) | (gold_comparison(golds, lex) if leaky else {})


def dense_v2(lex: Lexicon = RU_V2) -> Bundle:
    """60 columns."""
    return type_mismatch(lex, 2) | lexical_pair(2) | numeric_consistency() | verbosity(2)


def dense_v3(lex: Lexicon = RU_V3) -> Bundle:
    """73 columns."""
    return type_mismatch(lex, 3) | lexical_pair(3) | numeric_consistency() | verbosity(3) | first_span(lex)


def select_bundle(df: DataFrame, keep: list[str], bundle: Bundle) -> DataFrame:
    return df.select(*keep, *(c.alias(name) for name, c in bundle.items()))


def text_views(df: DataFrame, version: int, lex: Lexicon = RU_V3) -> Bundle:
    """The texts that are vectorised: question, answer, both, and by version the first line or core span and first sentence."""
    q, a = question_text(df), answer_text(df)
    out = {"question": q, "answer": a, "qa_concat": F.concat(F.lit("Q: "), q, F.lit("\nA: "), a)}
    if version == 2:
        out["answer_firstline"] = T.first_line(a)
    if version == 3:
        core = T.core_span(a, lex)
        out |= {"answer_core": core, "answer_first_sentence": T.first_sentence(a), "qa_core": F.concat(F.lit("Q: "), q, F.lit("\nA_CORE: "), core)}
    return out
