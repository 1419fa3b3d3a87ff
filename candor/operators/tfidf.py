"""Term weights: word and in-word character n-grams, sublinear counts, smooth inverse document frequencies, unit length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions.text import bind

def word_ngrams(c: Column, low: int = 1, high: int = 2) -> Column:
    """Runs of ``low`` to ``high`` tokens of two or more word characters, lower-cased."""

    def grams(toks: Column) -> Column:
        return F.concat(*(toks if n == 1 else _runs(toks, n, lambda part: F.array_join(part, " ")) for n in range(low, high + 1)))

    return bind(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1)), grams)


def _runs(arr: Column, n: int, join) -> Column:  # noqa: ANN001
    starts = F.sequence(F.lit(1), F.greatest(F.size(arr) - n + 1, F.lit(1)))
    return F.when(F.size(arr) < n, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: join(F.slice(arr, i, n))))


def wb_words(c: Column) -> Column:
    """The words that :func:`char_wb_ngrams` cuts."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def char_wb_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded with a blank on either side; a word shorter than n is one gram, once."""
    words = wb_words(c)

    def grams(padded: Column) -> Column:
        size = F.length(padded)

        def of(n: int) -> Column:
            # a function of the start alone: a second parameter would get the position in the array
            cut = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
            # the first n that exceeds the word gives the whole of it, once
            whole = size < n if n == low else size == n - 1
            return F.when(size >= n, cut).when(whole, F.array(padded)).otherwise(F.array().cast("array<string>"))

        return F.concat(*map(of, range(low, high + 1)))

    return F.flatten(F.transform(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), grams))


@dataclass
class TermWeights:
    """A fitted vocabulary: ``terms(term, df)`` and the number of documents."""

    terms: DataFrame
    n: int
    grams: object

    def transform(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """``key, term, weight``: terms of the vocabulary in each document, sublinear tf times idf, of unit length per document.

        The vocabulary grows with the corpus, so it is joined by shuffle; adaptive execution may broadcast a small one.
        """
        tf = docs.select(key, F.explode(self.grams(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
        idf = F.log((1.0 + self.n) / (1.0 + F.col("df"))) + 1.0
        w = tf.join(self.terms, "term").select(key, "term", ((1.0 + F.log("tf")) * idf).alias("w"))
        norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))

    def names(self, view: str) -> DataFrame:
        return self.terms.select(F.concat(F.lit(f"{view}::"), "term").alias("name"))


def fit(docs: DataFrame, text: str, grams=word_ngrams, min_df: int = 1) -> TermWeights:  # noqa: ANN001
    """Document frequencies of all n-grams; per-document distinct grams are reduced on the map side."""
    seen = docs.select(F.explode(F.array_distinct(grams(F.col(text)))).alias("term"))
    return TermWeights(seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df), docs.count(), grams)
