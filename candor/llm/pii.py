"""Personal data over DataFrame functions only: base patterns, and bootstrapped contextual extraction beyond them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.runtime import broadcast_if_small, materialize, text_of

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
_WS = "\\x20\\x09-\\x0D"
_LOCAL = "A-Za-z0-9._%+-"
# The forms of the kinds, written so that Java's matcher neither backtracks nor recurses: quantifiers are possessive where what
# follows can't match what they took, and a match only begins where a run of its first characters begins (or where the last
# match ended), as no later start in such a run can succeed when the first fails.
FORMS = {
    "email": f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?+[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Runs of digit groups, and other words with a digit or an at sign: what may be an identifier.
CANDIDATE = f"(?<![^{_WS}])(?:[(]?+[0-9]++(?:[\\x20().-]{{1,2}}+[0-9]++)++|[^{_WS}0-9@]*+[0-9@][^{_WS}]*+)"


#: Spans that contexts added are broadcast to the rows they are in up to this number.
MOST_BROADCAST = 100_000


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(m, "\\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(m, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: str, possible: Column) -> Column:
    """Valid leftmost matches as structs of start, end (code points), kind, value, and the text just before and after."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        v, g = both["v"], both["g"]

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(g, i))
            return F.struct((start + F.length(F.get(v, i))).alias("at"), F.array_append(acc["starts"], start).alias("starts"))

        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), empty, step, lambda acc: acc["starts"])
        named = F.transform(F.array(starts), lambda s: F.transform(v, lambda x, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"), F.lit(kind).alias("kind"), x.alias("value"), F.right(F.get(g, i), F.lit(80)).alias("before"), F.substring(F.get(g, i + 1), 1, 40).alias("after"))))
        return F.filter(F.element_at(named, 1), lambda x: _valid(kind, x["value"]))

    found = F.element_at(F.transform(F.array(F.struct(values.alias("v"), gaps.alias("g"))), lambda b: F.when(F.size(b["v"]) > 0, placed(b))), 1)
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string,before:string,after:string>>")
    return F.coalesce(F.when(possible, found), none)


def _order(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        out = F.when(kind == name, k).otherwise(out)
    return out


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, then end, joined by commas."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _order(s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_matches(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row``, the carried columns, ``base`` matches and ``loose`` ones: candidates that overlap no base match."""
    d = docs.select(*[F.col(f"`{c}`") for c in carry], text_of().alias("_text"))
    digit, at = F.col("_text").rlike("[0-9]"), F.contains("_text", F.lit("@"))
    possible = {"email": at, "phone": digit & F.contains("_text", F.lit("+"))}
    d = d.select("*", *(matches(F.col("_text"), FORMS[k], k, possible.get(k, digit)).alias(f"_{k}") for k in KINDS), matches(F.col("_text"), CANDIDATE, "", digit | at).alias("_loose"))
    base = F.concat(*(F.col(f"_{k}") for k in KINDS))
    d = d.withColumn("base", base).drop(*(f"_{k}" for k in KINDS))
    loose = F.filter("_loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return d.select(F.monotonically_increasing_id().alias("row"), *carry, "base", loose.alias("loose"))


def occurrences(found: DataFrame) -> DataFrame:
    """A row per match: where it is, the kinds it may be of, whether it is a seed, and its lexical patterns.

    Patterns are the two words before, the word before with the word after, and a label that ends in a colon or an equals sign.
    A label may be part of the candidate (``id=4711``). Quotes and closing punctuation are no part of a candidate.
    """
    each = found.select("row", F.explode(F.concat("base", "loose")).alias("m")).select("row", "m.*")
    seed = F.col("kind") != ""
    label = F.when(seed, "").otherwise(F.regexp_extract("value", "^([^=:]*[=:])[^=:]", 1))
    each = each.withColumn("label", label).withColumn("bare", F.expr("substring(value, length(label) + 1)"))
    lead = F.when(seed, "").otherwise(F.regexp_extract("bare", "^([\"'(\\[<{]*)", 1))
    each = each.withColumn("lead", lead).withColumn("bare", F.when(seed, F.col("bare")).otherwise(F.regexp_replace(F.expr("substring(bare, length(lead) + 1)"), "[.,;:!?\"')\\]>}]+$", "")))
    each = each.where(F.length("bare") > 0)
    start = F.col("start") + F.length("label") + F.length("lead")
    each = each.withColumns({"start": start, "end": F.when(seed, F.col("end")).otherwise(start + F.length("bare"))})
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "before", "label")), f"[{_WS}]+"), lambda w: w != "")
    each = each.withColumn("words", words).withColumn("next", F.lower(F.regexp_extract("after", f"^[{_WS}]*([^{_WS}]+)", 1)))
    last, second = F.element_at("words", F.lit(-1)), F.element_at("words", F.lit(-2))
    n = F.size("words")
    patterns = F.array(
        F.when(n > 1, F.concat(second, F.lit(" "), last, F.lit(" _"))),
        F.when((n > 0) & (F.col("next") != ""), F.concat(last, F.lit(" _ "), F.col("next"))),
        F.when((n > 0) & last.rlike("[:=]$"), F.concat(last, F.lit(" _"))),
    )
    digits = F.length(F.regexp_replace("bare", "[^0-9]", ""))
    fits = F.array(
        F.when(F.contains("bare", F.lit("@")), "email"),
        F.when(F.col("bare").rlike("^[0-9a-fA-F]+(?:[.:][0-9a-fA-F]*){3,7}$"), "ip"),
        F.when((digits >= 12) & (digits * 2 > F.length("bare")), "card"),
        F.when(digits.between(7, 15) & (digits * 2 > F.length("bare")), "phone"),
    )
    kinds = F.when(seed, F.array("kind")).otherwise(F.filter(fits, lambda k: k.isNotNull()))
    return each.select("row", "start", "end", seed.alias("seed"), F.lower("bare").alias("value"), kinds.alias("kinds"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns")).where(F.size("kinds") > 0)


def trusted_patterns(seen: DataFrame, rounds: int = 3, least_seeds: int = 3, least_trust: float = 0.6) -> DataFrame:
    """``pattern, kind`` of the patterns that iterated scoring of the pattern-instance graph trusts.

    Instances are distinct values per kind; seeds have score 1, others begin at 0. A pattern's trust is the summed score of its
    instances over their number plus one; another instance's score is the chance that not all of its patterns are wrong. Both are
    recomputed ``rounds`` times. Trusted patterns reach ``least_trust`` and were induced by ``least_seeds`` different seeds.
    """
    edge = seen.select(F.explode("kinds").alias("kind"), "value", "seed", "patterns").select("kind", "value", "seed", F.explode("patterns").alias("pattern"))
    edge = materialize(edge.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "pattern-graph")
    score = edge.withColumn("score", F.col("seed").cast("double"))
    for k in range(rounds):
        trust = score.groupBy("kind", "pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("trust"), F.count_if("seed").alias("seeds"))
        trust = materialize(trust.where(F.col("seeds") > 0), "pattern-trust")
        if k + 1 < rounds:
            others = edge.where(~F.col("seed")).join(trust, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("got"))
            others = materialize(others, "instance-scores")
            score = edge.join(others, ["kind", "value"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("got", F.lit(0.0))))
    return trust.where((F.col("seeds") >= least_seeds) & (F.col("trust") >= least_trust)).select("pattern", "kind")


def find_personal_data(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of every row of ``docs`` with ``base`` and ``spans``, arrays of (start, end, kind).

    ``base`` holds what the forms of the four kinds match and their checks accept. ``spans`` adds identifiers that no form
    matches but that trusted contexts of seeds surround and whose make-up fits the kind (an at sign, enough digits, dotted or
    coloned groups). Two reads of narrow rows; texts are read once. Carried columns are not shuffled while the added spans are few
    enough to broadcast (``MOST_BROADCAST``); beyond that, those of rows with a candidate are.

    Null and empty texts have no spans; repeated rows are treated alike; an empty table gives no rows. A carried column may have
    any name but ``row``, ``base``, ``loose``, ``spans``.
    """
    carry = list(carry if carry is not None else ["doc_id"])
    found = materialize(base_matches(docs, carry), "personal-data")
    seen = materialize(occurrences(found.select("row", "base", "loose")), "occurrences")
    trusted = trusted_patterns(seen)
    loose = seen.where(~F.col("seed")).select("row", "start", "end", F.explode("kinds").alias("kind"), "patterns").select("row", "start", "end", "kind", F.explode("patterns").alias("pattern"))
    added = loose.join(broadcast_if_small(trusted), ["pattern", "kind"]).groupBy("row", "start", "end").agg(F.min_by("kind", _order(F.col("kind"))).alias("kind"))
    added = materialize(added, "added-spans")
    few = added.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    added = added.groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("added"))
    thin = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    rows = found.withColumn("base", thin)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    # only rows with a candidate can gain a span: if there are too many spans to broadcast, no other row is shuffled
    able = F.size("loose") > 0
    joined = rows.join(F.broadcast(added), "row", "left") if few else rows.where(able).join(added, "row", "left").unionByName(rows.where(~able).withColumn("added", none))
    return joined.select(*carry, "base", F.concat("base", F.coalesce("added", none)).alias("spans"))


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row; counts and digest are of base spans."""
    found = find_personal_data(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets, and ``n_chars`` (if there) set to the new length.

    Spans that overlap become one replacement, named after the first. Null texts stay null, empty ones empty. Repeated rows come
    back each; columns may have any name; no rows give no rows.
    """
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()], F.col("text"))
    found = find_personal_data(plain, carry=list(names.values()))
    text = F.col(names["text"])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), _order(s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(gap, mark))).otherwise(acc["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    found = found.withColumn("_clean", F.when(text.isNotNull() & (F.size("spans") > 0), clean).otherwise(text))
    out = {c: F.col(a) for c, a in names.items()} | {"text": F.col("_clean")}
    if "n_chars" in out:
        out["n_chars"] = F.length("_clean").cast(docs.schema["n_chars"].dataType)
    return found.select(*(out[c].alias(c) for c in docs.columns))
