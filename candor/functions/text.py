"""Text functions as column expressions. They stay inside the JVM except ``char_similarity``, which needs difflib's matcher."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from candor.functions.lexicon import Lexicon

#: ASCII punctuation and the quotation marks that normalising deletes; the long dash is not among them.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„…"
_SPACE = r"(?U)\s+"
_YEAR = r"(?U)\b(1[0-9]{3}|20[0-9]{2}|21[0-9]{2})\b"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, wherever ``use`` mentions it.

    An expression that is mentioned inside a lambda is otherwise computed anew for every element, even if it was a column of its
    own before: Catalyst merges projections when a column is mentioned once.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def text(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_ascii(c: Column) -> Column:
    """Without blanks, tabs, form feeds and line ends around it, which is what RE2 calls a space; others stay."""
    return F.regexp_replace(c, r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z", "")


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), _SPACE, " "))


def normalize(c: Column) -> Column:
    """Lower case, one blank between words, no punctuation, one letter for e and yo."""
    plain = F.regexp_replace(F.translate(strip(F.lower(text(c))), "ё", "е"), _SPACE, " ")
    return F.trim(F.translate(plain, PUNCTUATION, ""))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, _SPACE), lambda w: w != "")


def tokens(c: Column) -> Column:
    return split_words(normalize(c))


def first_tokens(toks: Column, n: int) -> Column:
    return F.slice(toks, 1, n)


def content_tokens(toks: Column, lex: Lexicon) -> Column:
    stop = F.array(*map(F.lit, lex.function_words))
    return F.filter(toks, lambda t: ~F.array_contains(stop, t))


def strip_leading_function_words(normal: Column, lex: Lexicon) -> Column:
    """Normalised text, single blanks, without the function words it begins with."""
    words = "|".join(map(re.escape, lex.function_words))
    return F.regexp_replace(F.regexp_replace(normal, _SPACE, " "), f"^(?:(?:{words})(?: |$))++", "")


def multiset_overlap(a: Column, b: Column) -> Column:
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def multiset_f1(a: Column, b: Column) -> Column:
    """F1 of the multiset overlap of two token arrays; 0 where either is empty or nothing is shared."""

    def f1(z: Column) -> Column:
        x, y = z["a"], z["b"]
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.lit(2.0) * multiset_overlap(x, y) / (F.size(x) + F.size(y)))

    return bind(F.struct(a.alias("a"), b.alias("b")), f1)


def number_tokens(c: Column) -> Column:
    """Numbers as written, in order, with a decimal point for a decimal comma."""
    return F.regexp_extract_all(F.translate(text(c), ",", "."), F.lit(r"(?U)(\d+(?:\.\d+)?)"), F.lit(1))


def year_tokens(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(_YEAR), F.lit(1))


def digit_run_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(text(c), F.lit(r"(?U)(\d+)"), F.lit(1)))


def digit_count(c: Column) -> Column:
    return F.length(F.regexp_replace(text(c), r"(?U)\D", ""))


def phrase_pattern(phrases: tuple[str, ...], stems: tuple[str, ...] = (), anchored: bool = False) -> str:
    """One alternation for all phrases, as whole words (or at the beginning of a word, for stems)."""
    parts = [rf"(?:{'|'.join(map(re.escape, phrases))})\b"] * bool(phrases) + [rf"(?:{'|'.join(map(re.escape, stems))})"] * bool(stems)
    return rf"(?U){'^' if anchored else chr(92) + 'b'}(?:{'|'.join(parts)})" if parts else r"(?!)"


def has_phrase(normal: Column, phrases: tuple[str, ...], stems: tuple[str, ...] = (), anchored: bool = False) -> Column:
    return normal.rlike(phrase_pattern(phrases, stems, anchored))


def supported_by_context(answer_normal: Column, context_normal: Column, lex: Lexicon) -> Column:
    """Whether the answer, without leading function words, is part of the context, or all but one of its longer tokens are."""

    def judge(z: Column) -> Column:
        core, context = z["core"], z["context"]
        long = F.filter(split_words(core), lambda t: F.length(t) >= 4)
        hits = F.size(F.filter(long, lambda t: F.contains(context, t)))
        enough = (F.size(long) > 0) & (hits >= F.greatest(F.lit(1), F.size(long) - 1))
        return F.when((core == "") | (context == ""), False).otherwise(F.contains(context, core) | enough)

    return bind(F.struct(strip_leading_function_words(answer_normal, lex).alias("core"), context_normal.alias("context")), judge)


def exact_match_any(answer_normal: Column, golds_normal: Column) -> Column:
    return F.coalesce(F.array_contains(golds_normal, answer_normal), F.lit(False))


def substring_match_any(answer_normal: Column, golds_normal: Column) -> Column:
    return F.coalesce(F.exists(golds_normal, lambda g: (g != "") & (F.contains(answer_normal, g) | F.contains(g, answer_normal))), F.lit(False))


def sentence_count(c: Column) -> Column:
    return F.size(F.filter(F.split(text(c), "[.!?]+"), lambda s: strip(s) != ""))


def first_sentence(c: Column) -> Column:
    return strip(F.element_at(F.split(strip(text(c)), r"(?U)(?<=[.!?])\s+", 2), 1))


def first_line(c: Column) -> Column:
    return F.element_at(F.split(text(c), r"\R", 2), 1)


def core_span(c: Column, lex: Lexicon) -> Column:
    """The first clause of the first sentence; a long one is cut to its first eight normalised tokens."""
    clause = rf"(?iuU)\s*[,:;—-]\s+|\s+\b(?:{'|'.join(lex.clause_words)})\b\s+"
    raw = strip(F.element_at(F.split(first_sentence(c), clause, 2), 1))
    toks = tokens(raw)
    return F.when(F.size(toks) > 8, F.array_join(F.slice(toks, 1, 8), " ")).otherwise(raw)


def capitalised_count(c: Column) -> Column:
    return F.size(F.filter(F.regexp_extract_all(text(c), F.lit(r"(?U)(\b\w+\b)"), F.lit(1)), lambda t: t.rlike(r"^\p{Lu}")))


def starts_capitalised(c: Column) -> Column:
    return text(c).rlike(r"^\p{Lu}")


def upper_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{Lu}", "")) / F.greatest(F.length(c), F.lit(1))


def punctuation_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)[\p{L}\p{N}\s]", "")) / F.greatest(F.length(c), F.lit(1))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of ``a`` that ``b`` has; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def repeated_ratio(ids: Column) -> Column:
    """1 - distinct / all of an array; 0 where it is empty."""
    return F.when(F.size(ids) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(ids)) / F.size(ids))


def bigrams(ids: Column) -> Column:
    """Adjacent pairs as texts, since only arrays of plain values are made distinct by hashing."""
    n = F.size(ids) - 1
    pairs = F.zip_with(F.slice(ids, F.lit(1), F.greatest(n, F.lit(0))), F.slice(ids, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string")))
    return F.when(n >= 1, pairs).otherwise(F.array().cast("array<string>"))


def without_tail(c: Column, tail: str) -> Column:
    """Without ``tail`` on a last line of its own, and the line ends before it."""
    return F.regexp_replace(c, rf"(?iu)\n+{re.escape(tail)}\.?\n?\z", "")


def first_paragraph_line(c: Column, trim: Callable[[Column], Column] = strip) -> Column:
    """The first line of the first paragraph, both trimmed."""
    return trim(F.element_at(F.split(trim(F.element_at(F.split(c, "\n\n", 2), 1)), "\n", 2), 1))


def clean_refusal_tail(c: Column, lex: Lexicon) -> Column:
    """Unix line ends, and no refusal on a last line of its own."""
    out = F.replace(strip(text(c)), F.lit("\r\n"), F.lit("\n"))
    for tail in lex.refusal_tails:
        out = strip(without_tail(out, tail))
    return out


def clean_to_first_line(c: Column, lex: Lexicon, quotes: bool = False) -> Column:
    """Without an answer label (and outer quotes), the first line of the first paragraph."""
    out = F.replace(strip(text(c)), F.lit("\r\n"), F.lit("\n"))
    out = strip(F.regexp_replace(out, rf"(?iuU)^{re.escape(lex.answer_prefix)}\s*[:\-]\s*", ""))
    if quotes:
        out = strip(F.regexp_replace(F.regexp_replace(out, '^"+|"+$', ""), "^'+|'+$", ""))
    return first_paragraph_line(out)


@F.pandas_udf(DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, in this order; difflib defines it, and no built-in function equals it."""
    from difflib import SequenceMatcher

    return pd.Series([0.0 if not x or not y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
