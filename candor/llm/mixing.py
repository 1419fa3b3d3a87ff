"""Mixing of sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.runtime import broadcast_if_small, materialize, own_names, text_of


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 sum."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose Poisson distribution function with this mean reaches ``u``.

    Terms are added up from 0; for means above 500, whose first term underflows, from 12 standard deviations and 30 below the
    mean, where the first term comes from Stirling's series.
    """
    far = F.lit(12.0) * F.sqrt(mean) + 30
    low = F.when(mean > 500, F.greatest(F.lit(0.0), F.ceil(mean - far).cast("double"))).otherwise(0.0)
    log_factorial = F.when(low < 1, 0.0).otherwise(low * F.log(low) - low + F.log(low * (2 * 3.141592653589793)) / 2 + 1 / (low * 12) - 1 / (F.pow(low, F.lit(3.0)) * 360))
    first = F.exp(F.when(low < 1, -mean).otherwise(low * F.log(mean) - mean - log_factorial))
    start = F.struct(first.alias("p"), first.alias("c"), low.alias("k"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.when(acc["c"] >= u, acc).otherwise(F.struct(p.alias("p"), (acc["c"] + p).alias("c"), k.alias("k")))

    return F.aggregate(F.sequence(low.cast("long") + 1, F.ceil(mean + far).cast("long")), start, lambda acc, k: step(acc, k.cast("double")), lambda acc: acc["k"].cast("long"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, size: float = 1.0, seed: int = 17, key: str = "source", ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Replicate documents so that each source's characters come to its share of ``weights``; all columns, and ``copy``, ``shuffle_key``.

    ``weights`` are relative (None: all sources alike; a source without a weight gets none); ``size`` is the mixture's expected
    number of characters over that of ``docs``. A document of a source with repetition rate r occurs k times, where k inverts the
    Poisson distribution of mean r at a hash of its id, its text and the seed: repeatable, independent of partitioning, and right
    on average for rates below and above 1. Copies are dealt and sorted by such a hash, which is a global shuffle.

    A null source is a source of its own. Null and empty texts weigh one character, so they are kept in step with the rest. A
    null id draws as an empty one. Rows with equal ids draw by their texts; only rows equal in both draw alike, and these too are
    dealt to different partitions, by a number of the row (so ``docs`` should be a scan: its tasks number alike when repeated). Existing columns ``copy`` and ``shuffle_key`` are replaced; others
    may have any name. Rates are broadcast only if counted to be few; otherwise the join with them is one that Spark can split.
    """
    docs, names = own_names(docs.drop("copy", "shuffle_key"))
    key, ident, text = names[key], names[ident], text_of(names[text])
    volume = F.greatest(F.length(text), F.lit(1)).cast("long")
    sums = docs.groupBy(F.col(key).alias("_key")).agg(F.sum(volume).alias("_chars"))
    if weights is None:
        sums = sums.withColumn("_w", F.lit(1.0))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("_key").eqNullSafe(F.lit(name)), float(w)).otherwise(share)
        sums = sums.withColumn("_w", share)
    sums = materialize(sums, "source-sizes")
    total = sums.agg(F.sum("_chars").alias("chars"), F.sum("_w").alias("w")).first()
    goal, every = float(size) * float(total["chars"] or 0), float(total["w"] or 1)
    rates = sums.select("_key", (F.col("_w") * goal / every / F.col("_chars")).alias("_rate"))
    who = F.concat_ws("|", F.coalesce(F.col(ident).cast("string"), F.lit("")), F.md5(text))
    drawn = docs.withColumns({"_who": who, "_row": F.monotonically_increasing_id()})
    drawn = drawn.join(broadcast_if_small(rates), drawn[key].eqNullSafe(rates["_key"]))
    drawn = drawn.withColumn("_n", poisson_inverse(unit_hash(F.col("_who"), F.lit(str(seed))), F.col("_rate"))).where("_n > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", "_who", F.col("copy").cast("string"), F.lit(str(seed)))))
    copies = copies.withColumn("_deal", F.xxhash64("shuffle_key", "_row")).repartition("_deal").sortWithinPartitions("shuffle_key")
    return copies.select(*[F.col(a).alias(c) for c, a in names.items()], "copy", "shuffle_key")


#: DuckDB: the same draws for equal weights; ``{seed}`` is the seed.
MIX_SQL = """
with recursive w as (select *, coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, '')) as who from documents),
d as (select *, greatest(length(coalesce(text, '')), 1) as chars, cast('0x' || substr(md5(who || '|{seed}'), 1, 13) as bigint) / 4503599627370496.0::double as u from w),
s as (select source, sum(chars)::bigint as chars from d group by source),
r as (select source, 1.0::double * (select sum(chars) from s)::double / (select count(*) from s)::double / chars as rate from s),
c as (select source, rate, 0::bigint as k, exp(-rate) as p, exp(-rate) as c from r
  union all select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from c where k < ceil(rate + 12 * sqrt(rate) + 30)),
n as (select d.*, (select count(*) from c where c.source is not distinct from d.source and c.c < d.u) as n from d)
select doc_id, text, lang, source, n_chars, cast(i as integer) as copy, md5(who || '|' || i || '|{seed}') as shuffle_key
from n, lateral (select unnest(range(n)) as i) where n > 0
"""
