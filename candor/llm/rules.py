"""Quality rules over DataFrame functions only: text measures, and lines that recur across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.runtime import broadcast_if_small, materialize, own_names, text_of

#: White space as the rules see it.
BLANK = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
#: What names a text of a host; 128 bits of hashes, so different texts don't meet.
TEXT = ["_host", "_content", "_check"]
DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more; ``hashes`` are those of the windows in order.

    Hashes are sorted with their places, neighbours with an equal hash give the places that recur, and each place covers up to
    three words not covered before: n log n for a text of n words, and nothing where no window recurs.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def recurring(s: Column) -> Column:
        near = lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])
        return F.sort_array(F.filter(F.transform(s, near), lambda i: i.isNotNull()))

    # a one-element transform names the sorted array, so it is sorted once
    places = F.element_at(F.transform(F.array(placed), recurring), 1)
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0).cast("long"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


def line_hash(line: Column) -> Column:
    """Lines are compared in lower case with single blanks."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), f"[{BLANK}]+", " ")))


def identified(docs: DataFrame, host: str, text: str = "text") -> DataFrame:
    """``docs`` and the three columns that say which text of which host a row holds."""
    whole = text_of(text)
    return docs.withColumns({"_host": F.coalesce(F.col(host).cast("string"), F.lit("")), "_content": F.xxhash64(whole), "_check": F.xxhash64(F.lit(1), whole)})


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """A narrow row per different text of a host: the base measures, and the hash of each of its different lines with a word."""
    d = identified(docs, host).select(*TEXT, text_of().alias("text"))
    d = d.withColumn("words", words_of(F.col("text")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANK}]")))
    window = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    d = d.withColumn("windows", F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), window))
    return d.select(
        *TEXT,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{BLANK}]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("windows")).alias("n_repeat_words"),
        F.array_distinct(F.transform("lines", line_hash)).alias("hashes"),
    ).dropDuplicates(TEXT)


def clean_documents(docs: DataFrame, host: str = "source", max_documents: int = 30, max_share: float = 0.0, least_left: float = 0.3, least_words: int = 20) -> DataFrame:
    """Every row of ``docs`` with the boilerplate lines of its host taken out of ``text``, and the columns ``DIGEST`` but the id.

    Base: under 50 words, or more than half of the words in repeated 3-word windows. Beyond that a line (lower case, single
    blanks) is boilerplate of its host if more than ``max_documents`` different documents of the host hold it, however large
    the host is (a ``max_share`` above 0 asks for more than that share of them besides); such lines are removed, and a document is depleted if fewer than ``least_words`` words or less
    than ``least_left`` of its words are left. Exact copies of a text are one document here: finding copies is another
    operator's task, and a text isn't boilerplate for having been copied whole.

    The other lines stay as they are, in order; ``n_chars`` (if there) is set to the new length where a text changed. What
    was removed, and whether a document is depleted, is counted on the text that is returned.

    Null and empty texts have no words and fail the base; a null text stays null. A null host is the host "". Repeated rows are
    returned each. Columns named as in ``DIGEST`` are replaced; others may have any name. No rows give no rows. ``docs`` is read twice, for measures and for the texts; the texts are shuffled once.
    Each text of a host is measured and counted once, so a host or a line that most documents share is spread by text; the
    joins are ones that Spark splits when a key is hot.
    """
    texts = materialize(measures(docs, host), "measures")
    lines = texts.select(*TEXT, F.explode("hashes").alias("hash"))
    often = lines.groupBy("_host", "hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_documents)
    if max_share > 0:
        of_host = texts.groupBy("_host").agg(F.count(F.lit(1)).alias("of_host"))
        often = often.join(of_host, "_host").where(F.col("n_docs") > max_share * F.col("of_host"))
    often = broadcast_if_small(materialize(often.select("_host", "hash"), "frequent-lines"))
    above = lines.join(often, ["_host", "hash"]).groupBy(*TEXT).agg(F.collect_set("hash").alias("_above"))
    judged = materialize(texts.drop("hashes").join(above, TEXT, "left"), "lines-above")

    own, names = own_names(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in DIGEST[1:])))
    text = names["text"]
    d = identified(own, names[host], text).join(judged, TEXT, "left")
    stays = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_above", line_hash(x)))
    d = d.withColumn(text, F.when(F.col("_above").isNull(), F.col(text)).otherwise(F.array_join(stays, "\n")))
    if size := names.get("n_chars"):
        d = d.withColumn(size, F.when(F.col("_above").isNull(), F.col(size)).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    d = d.withColumn("_left", F.when(F.col("_above").isNull(), F.col("n_words")).otherwise(F.size(words_of(text_of(text))).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("_left") >= least_words) & (F.col("_left") >= least_left * F.col("n_words"))
    d = d.withColumns({"base_failed": failed, "kept": kept, "n_removed_words": F.col("n_words") - F.col("_left")})
    return d.select(*(F.col(a).alias(c) for c, a in names.items()), *DIGEST[1:])


def quality_rules(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """The columns ``DIGEST`` of ``clean_documents`` for every row."""
    return clean_documents(docs, host, **limits).select(F.col("doc_id").cast("long").alias("doc_id"), *DIGEST[1:])
