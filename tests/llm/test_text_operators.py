"""Classifier, toxicity, personal data, rules, mixing and chat formatting against brute force, with odd rows."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from candor.llm import chat, mixing, pii, quality, queries, rules, toxicity
from candor.llm.runtime import shared_dir

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
WS = "\x20\x09-\x0d"
KINDS = ("email", "ip", "card", "phone")
FORMS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        x = int(ch) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (kind, form) in enumerate(zip(KINDS, FORMS, strict=True)) for m in re.finditer(form, text or "") if valid(kind, m.group()))


def digest(text):
    spans = base_spans(text)
    n = Counter(k for _, k, _ in spans)
    return (*(n[k] for k in range(4)), hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest())


TRICKY = [
    "a@b.cc_d@e.f", "..x@y-z.co.uk. a@b a@b@c.d @@ x@.y", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 1.2.3", "4539 1488 0343 6467, 4539-1488-0343-6467 4539148803436468", "+1 (132) 555-1352. +12 +1((((", "😀 me@x.org 漢 +49 170 1234567890 +1 23",
    "a" * 5000, "9" * 5000, "a." * 4000, "1 " * 4000, "+" + "1(" * 3000, "x@" + "a." * 4000 + "b", None, "", "0" * 300 + ".1.2.3 card 0000000000000000",
]


def brute_spans(rows):
    """Base and added spans of every text, by rules written anew over Python strings."""
    kinds_of = {}
    seen = []
    for doc, text in rows:
        text = text or ""
        base = [(a, e, KINDS[k]) for a, k, e in base_spans(text)]
        found = [(a, e, True, kind) for a, e, kind in base]
        group = r"(?<![^\x20\x09-\x0d])(?:\(?[0-9]+(?:[\x20().-]{1,2}[0-9]+)+|[^\x20\x09-\x0d0-9@]*[0-9@][^\x20\x09-\x0d]*)"
        found += [(m.start(), m.end(), False, None) for m in re.finditer(group, text) if not any(a < m.end() and m.start() < e for a, e, _ in base)]
        for a, e, seed, kind in found:
            before, value, label = text[max(0, a - 80) : a], text[a:e], ""
            after = text[e : e + 40]
            if not seed:
                label = (re.match("([^=:]*[=:])[^=:]", value) or [None, ""])[1]
                rest = value[len(label) :]
                lead = re.match("[\"'(\\[<{]*", rest)[0]
                value = re.sub("[.,;:!?\"')\\]>}]+$", "", rest[len(lead) :])
                a += len(label) + len(lead)
                e = a + len(value)
            if not value:
                continue
            w = (before + " " + label).lower().split()
            nxt = (after.split() or [""])[0].lower()
            patterns = {f"{w[-2]} {w[-1]} _"} if len(w) > 1 else set()
            if w and nxt:
                patterns.add(f"{w[-1]} _ {nxt}")
            if w and w[-1][-1] in ":=":
                patterns.add(f"{w[-1]} _")
            digits = sum(c in "0123456789" for c in value)
            fits = [("email", "@" in value), ("ip", bool(re.fullmatch("[0-9a-fA-F]+(?:[.:][0-9a-fA-F]*){3,7}", value))), ("card", digits >= 12 and 2 * digits > len(value)), ("phone", 7 <= digits <= 15 and 2 * digits > len(value))]
            for k in [kind] if seed else [k for k, ok in fits if ok]:
                seen.append((doc, a, e, seed, k, value.lower(), patterns))
                kinds_of.setdefault((k, value.lower()), False)
                kinds_of[k, value.lower()] |= seed
    edges = {(k, p, v) for _, _, _, _, k, v, ps in seen for p in ps}
    score = {kv: float(s) for kv, s in kinds_of.items()}
    for step in range(3):
        trust = {}
        for key in {(k, p) for k, p, _ in edges}:
            values = [v for k, p, v in edges if (k, p) == key]
            seeds = sum(kinds_of[key[0], v] for v in values)
            if seeds:
                trust[key] = (sum(score[key[0], v] for v in values) / (len(values) + 1), seeds)
        for kv, seed in kinds_of.items():
            if not seed and step < 2:
                score[kv] = 1 - float(np.prod([1 - trust[k, p][0] for k, p, v in edges if (k, v) == kv and (k, p) in trust]))
    trusted = {key for key, (t, n) in trust.items() if n >= 3 and t >= 0.6}
    out = {doc: [(a, k, e) for a, k, e in base_spans(text)] for doc, text in rows}
    added = {}
    for doc, a, e, seed, k, _, ps in seen:
        if not seed and any((k, p) in trusted for p in ps):
            added.setdefault((doc, a, e), []).append(KINDS.index(k))
    for (doc, a, e), ks in added.items():
        out[doc].append((a, min(ks), e))
    return {doc: ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in sorted(x)) for doc, x in out.items()}


def contexts(seed, n=300):
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(str(rng.integers(10)) for _ in range(k))
    rows = []
    for i in range(n):
        value = pick([f"u{rng.integers(40)}@mail.org", f"h{rng.integers(9)}@local", f"10.0.{rng.integers(9)}.{rng.integers(300)}", f"fe80:{digits(2)}::{digits(2)}:1", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", digits(16), digits(3), "v2"])
        lead = pick(["write to", "Call:", "ip=", "reach us at", "on host", "version", "card no:"])
        rows.append((i, f"text {lead}{pick([' ', '', '  '])}{pick(['', '(', chr(34)])}{value}{pick(['.', ',', ')', '', ' now', ' for help'])} and more {pick(['', digits(8)])}"))
    return rows


@pytest.mark.parametrize("seed", [1, 8])
@pytest.mark.parametrize("few", [0, 100_000])
def test_added_spans(spark, monkeypatch, seed, few):
    monkeypatch.setattr(pii, "MOST_BROADCAST", few)
    rows = [*contexts(seed), *((1000 + i, t) for i, t in enumerate(TRICKY[:7]))]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_spans(rows)
    assert got == want and any(len(want[d].split(",")) > len(base_spans(t)) for d, t in rows if want[d])


def test_base_personal_data(spark):
    d = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in pii.personal_data_digest(d).collect()}
    assert got == {i: digest(t) for i, t in enumerate(TRICKY)}


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [(i, f"please write to user{i}@mail.example.com for help") for i in range(6)]
    rows = [*seeds, (50, "please write to odd@localhost for help"), (51, "a lone handle@home stays")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "email:16:29" and got[51] == "" and got[0] == "email:16:38"


def test_redaction(spark, odd_documents):
    d = spark.createDataFrame([(1, "Mail a@b.cc or +1 (132) 555-1352 now", 36), (2, None, None), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(d).collect()}
    assert got == {1: ("Mail <EMAIL> or <PHONE> now", 27), 2: (None, None), 3: ("plain", 5)}
    same = pii.redact(odd_documents)
    assert same.columns == odd_documents.columns and same.count() == odd_documents.count()


def test_personal_data_odd_rows(spark, odd_documents, no_documents):
    assert pii.personal_data_digest(odd_documents).count() == odd_documents.count()
    assert pii.personal_data_digest(no_documents).count() == 0


def measures(text):
    w = re.findall(f"[^{WS}]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(f"[^{WS}]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_rules_base(spark, odd_documents, no_documents):
    extra = spark.createDataFrame([(20, "a b c a b c a b", "s"), (21, "x " * 60, "s"), (22, "l1\nl1\n \nl2\r\nl2\x0b\n", "s"), (23, " ".join(f"u{i}" for i in range(60)) + " #$%&|<>*", "s")], "doc_id long, text string, source string")
    d = odd_documents.select("doc_id", "text", "source").union(extra)
    got = sorted(((r[0] is None, r[0] or 0), tuple(r)[1:7]) for r in rules.quality_rules(d).collect())
    assert got == sorted(((r["doc_id"] is None, r["doc_id"] or 0), measures(r["text"])) for r in d.collect())
    assert rules.quality_rules(no_documents).count() == 0 and rules.quality_rules(odd_documents).count() == odd_documents.count()


def test_rules_remove_lines_of_a_host(spark):
    own = lambda i, n: " ".join(f"d{i}x{j}" for j in range(n))
    banner = " ".join(f"banner{j}" for j in range(60))
    rows = [(i, f"{banner}\n{own(i, 60)}", "h") for i in range(8)] + [(10, f"  {banner.upper()}\n{own(10, 3)}", "h"), (11, f"{banner}\n{own(11, 3)}", "other")]
    rows += [(20 + i, f"{own(99, 60)}", "h") for i in range(9)]
    got = {r["doc_id"]: (r["n_removed_words"], r["kept"]) for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_documents=3, max_share=0.2).collect()}
    assert all(got[i] == (60, True) for i in range(8)), "half of the words are left"
    assert got[10] == (60, False) and got[11] == (0, True)
    assert all(got[20 + i] == (0, True) for i in range(9)), "exact copies are one document"


def test_rules_return_texts_without_lines_above_limits(spark, odd_documents):
    own = lambda i: " ".join(f"d{i}x{j}" for j in range(60))
    rows = [(i, f" Read  MORE\there\n{own(i)}\n\nread more here\n  Tail {i} ", 7, "h") for i in range(8)] + [(9, f"read more here\n{own(9)}", 75, "other"), (10, None, None, "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, source string")
    out = rules.clean_documents(d, max_documents=3, max_share=0.2)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns[:4] == d.columns and all(got[i]["text"] == f"{own(i)}\n\n  Tail {i} " for i in range(8))
    assert all(got[i]["n_chars"] == len(got[i]["text"]) and got[i]["n_removed_words"] == 6 for i in range(8))
    assert got[9]["text"] == rows[8][1] and got[9]["n_chars"] == 75 and got[10]["text"] is None and got[10]["n_removed_words"] == 0
    same = rules.clean_documents(odd_documents)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, same.collect())) == sorted(map(key, odd_documents.collect())) and set(odd_documents.columns) <= set(same.columns)


def test_rules_against_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + rng.integers(26)) for _ in range(4))
    common = [" ".join(word() for _ in range(rng.integers(1, 40))) for _ in range(12)]
    rows = []
    for i in range(250):
        lines = [common[rng.integers(12)] if rng.random() < 0.8 else " ".join(word() for _ in range(rng.integers(0, 50))) for _ in range(rng.integers(1, 5))]
        lines = [x.upper() if rng.random() < 0.2 else x.replace(" ", "  ") if rng.random() < 0.2 else x for x in lines]
        rows.append((i, rows[-1][1] if i and rng.random() < 0.1 else "\n".join(lines), f"h{rng.integers(3)}"))
    norm = lambda x: " ".join(x.lower().split())
    holders = {}
    for host, text in {(h, t) for _, t, h in rows}:
        for x in {norm(x) for x in text.split("\n") if x.split()}:
            holders[host, x] = holders.get((host, x), 0) + 1
    want = {}
    for i, text, host in rows:
        left = "\n".join(x for x in text.split("\n") if holders.get((host, norm(x)), 0) <= 8)
        n, m = len(text.split()), len(left.split())
        failed = measures(text)[5]
        want[i] = (left if m < n else text, failed, not failed and m >= 20 and m >= 0.3 * n, n - m)
    out = rules.clean_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_documents=8)
    got = {r["doc_id"]: (r["text"], r["base_failed"], r["kept"], r["n_removed_words"]) for r in out.collect()}
    assert got == want and len({w[1:3] for w in want.values()}) == 3


def test_rules_limit_is_the_same_for_every_size_of_host(spark):
    own = lambda i: " ".join(f"d{i}x{j}" for j in range(60))
    for size in (40, 4000):
        rows = [(i, f"read more here\n{own(i)}" if i < 35 else own(i), "h") for i in range(size)]
        got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        assert got.where("n_removed_words = 3 and kept").count() == 35 and got.where("n_removed_words = 0").count() == size - 35


def test_mixing(spark, odd_documents, no_documents):
    d = spark.createDataFrame([(i, "x" * 10, "big" if i % 10 else "small") for i in range(4000)], "doc_id long, text string, source string")
    out = mixing.mix_sources(d, {"big": 1.0, "small": 3.0}, size=1.0)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] - 3000) < 250 and abs(n["big"] - 1000) < 150
    copies = out.groupBy("doc_id").count().where("count > 1").count()
    assert copies > 100 and out.select("doc_id", "copy").distinct().count() == out.count()
    again = mixing.mix_sources(d.repartition(7), {"big": 1.0, "small": 3.0}, size=1.0)
    assert sorted(map(tuple, again.select("doc_id", "copy").collect())) == sorted(map(tuple, out.select("doc_id", "copy").collect()))
    order = [r["doc_id"] for r in out.collect()]
    assert order != sorted(order)
    assert mixing.mix_sources(no_documents).count() == 0
    assert set(mixing.mix_sources(odd_documents, size=20.0).columns) == set(odd_documents.columns)
    assert mixing.mix_sources(d, {"big": 1.0}).where("source = 'small'").count() == 0


@needs_tables
def test_mixture_is_written_with_its_texts(spark):
    rows = queries.op7_source_mixing(spark, SF)
    written = spark.read.parquet(*{f.rpartition("/")[0] for f in rows.inputFiles()})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(written.columns) == {*docs.columns, "copy", "shuffle_key"} and written.count() == rows.count()
    assert written.select(docs.columns).distinct().exceptAll(docs.distinct()).count() == 0


@pytest.mark.parametrize("mean", [0.01, 0.9, 5.0, 80.0, 700.0, 5000.0])
def test_poisson_inverse(spark, mean):
    from pyspark.sql import functions as F

    d = spark.range(2000).select(mixing.poisson_inverse((F.col("id") + 0.5) / 2000, F.lit(mean)).alias("k"))
    k = np.array([r["k"] for r in d.collect()])
    assert abs(k.mean() - mean) < 0.02 * mean + 0.01 and abs(k.var() - mean) < 0.1 * mean + 0.01 and (np.diff(k) >= 0).all()


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    got = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, got.fetchall())) and sorted(names) == sorted(df.columns)


def test_preferences(spark):
    turns = [(1, "chosen", 0, "system", "s"), (1, "chosen", 1, "user", "q"), (1, "chosen", 2, "assistant", "good"), (1, "rejected", 0, "system", "s"), (1, "rejected", 1, "user", "q"), (1, "rejected", 1, "user", "q"), (1, "rejected", 2, "assistant", "bad"), (1, "rejected", 3, "user", None)]
    turns += [(2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", None, None, "alone"), (None, "chosen", 0, "user", "x"), (4, "neither", 0, "user", "x")]
    d = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").selectExpr("*", "1 as split", "2 as alike")
    got = sorted(tuple(r) for r in chat.preference_format(d).collect())
    a, b = "<|im_start|>", "<|im_end|>\n"
    assert got == sorted([
        (1, "prompt", 0, 2, f"{a}system\ns{b}", 0, 0), (1, "prompt", 1, 2, f"{a}user\nq{b}", 0, 0), (1, "chosen", 2, 2, f"{a}assistant\ngood{b}", 22, 36), (1, "rejected", 2, 2, f"{a}assistant\nbad{b}", 22, 35), (1, "rejected", 3, 2, f"{a}user\n{b}", 0, 0),
        (2, "prompt", 0, 1, f"{a}user\nsame{b}", 0, 0), (3, "chosen", -1, 0, f"{a}\nalone{b}", 0, 0),
    ])
    assert got[0][4][got[0][5] : got[0][6]] == "good<|im_end|>"
    assert chat.preference_format(d.limit(0)).count() == 0


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


@needs_tables
def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op2_quality_classifier(spark, SF).collect()
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert len(rows) == 1000 and np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, "/root/testdata/sf0.1").collect()
    held = [(labels[r["doc_id"]], r["toxic"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([t for y, t in held if y]) > 0.8 and np.mean([t for y, t in held if not y]) < 0.03
    assert all(0 <= r["expected_severity"] <= 3 for r in rows)


def naive_quality_features(text, bits):
    """A dictionary of unit length from hashed column to value, token by token."""
    from candor.llm.features import _salted
    from candor.llm.textkit import mix

    raw = (text or "").encode()
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~\x7f]+", raw)

    def hashed(token):
        low, p, total = bytes(c + 32 if 65 <= c <= 90 else c for c in token), 1, 0
        for c in low:
            total, p = (total + (c + 1) * p) % 2**64, p * 0x9E3779B97F4A7C15 % 2**64
        return int(mix(np.array([(total + len(token) * 0xD6E8FEB86659FD93) % 2**64], np.uint64))[0])

    one = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0])
    column = lambda x, salt: int(_salted(np.array([x % 2**64], np.uint64), salt)[0]) >> (64 - bits)
    h = [hashed(t) for t in tokens]
    forms = []
    for i, t in enumerate(tokens):
        capitals = sum(65 <= c <= 90 for c in t)
        if not re.match(rb"[0-9A-Za-z\x80-\xff]", t):
            forms.append(h[i])
        elif h[i] in h[max(0, i - 2) : i]:
            forms.append(4)
        else:
            forms.append(1 if not capitals else 3 if capitals == len(t) > 1 else 2)
    found = Counter(column(x, 1) for x in h) + Counter(column(a * 3 + b, 2) for a, b in zip(h, h[1:]))
    found += Counter(column(x, 3) for x in forms) + Counter(column(one(one(a) + b) + c, 4) for a, b, c in zip(forms, forms[1:], forms[2:]))
    norm = sum(v * v for v in found.values()) ** 0.5
    return {c: v / norm for c, v in found.items()}


def test_quality_features_and_updates_by_brute_force(spark):
    import pyarrow as pa

    from candor.llm.features import quality_features, row_sums

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["One", "two", "THREE", "two", "x", "Ünï", "a-b", "!!", "3.14", "#"], rng.integers(0, 30))) for _ in range(60)] + ["", None, "!!! !!! a A a"]
    starts, cols, values = quality_features(pa.array(texts), 10)
    naive = [naive_quality_features(t, 10) for t in texts]
    for a, b, want in zip(starts[:-1], starts[1:], naive, strict=True):
        assert cols[a:b].tolist() == sorted(want) and np.allclose(values[a:b], [want[c] for c in sorted(want)])
    labels = rng.integers(0, 2, len(texts))
    alpha, beta, l1, l2, bias = 0.3, 1.0, 0.05, 0.5, 1 << 10
    z, n = Counter(), Counter()

    def weight(c):
        penalty = 0.0 if c == bias else l1
        return 0.0 if abs(z[c]) <= penalty else -(z[c] - np.sign(z[c]) * penalty) / ((beta + n[c] ** 0.5) / alpha + l2)

    for _ in range(4):
        for x, y in zip(naive, labels, strict=True):
            x = x | {bias: 1.0}
            w = {c: weight(c) for c in x}
            p = 1 / (1 + np.exp(-sum(w[c] * v for c, v in x.items())))
            for c, v in x.items():
                g = (p - y) * v
                z[c] += g - ((n[c] + g * g) ** 0.5 - n[c] ** 0.5) / alpha * w[c]
                n[c] += g * g
    fitted = quality.ftrl_fit([(cols[a:b], values[a:b], int(y)) for a, b, y in zip(starts[:-1], starts[1:], labels, strict=True)], 1 << 10)
    assert np.allclose(fitted, [weight(c) for c in range(bias + 1)], atol=1e-9)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(d, fitted, bits=10).collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(-sum(weight(c) * v for c, v in (x | {bias: 1.0}).items())))) < 1e-9 for i, x in enumerate(naive))
    alone = [row_sums(fitted, quality_features(pa.array([t]), 10))[0] for t in texts]
    assert alone == row_sums(fitted, (starts, cols, values)).tolist(), "a row's score is the same whatever is beside it"


def test_ordinal_updates_by_brute_force():
    rng = np.random.default_rng(9)
    rows = [np.flatnonzero(rng.random(20) < 0.2) for _ in range(80)]
    grade = rng.integers(0, 4, 80)
    z, n, cuts, pace = [0.0] * 20, [0.0] * 20, [1.0, 2.0, 3.0], [1.0] * 3
    link = lambda x: 1 / (1 + np.exp(-x))
    weight = lambda c: 0.0 if abs(z[c]) <= 0.5 else -(z[c] - np.sign(z[c]) * 0.5) / ((1 + n[c] ** 0.5) / 0.3 + 0.02)
    loss = lambda m, cuts, y: -np.log(([1.0, *(link(m - c) for c in cuts)][y]) - [*(link(m - c) for c in cuts), 0.0][y])
    for _ in range(10):
        for x, y in zip(rows, grade, strict=True):
            w = [weight(c) for c in x]
            m, e = sum(w), 1e-5
            g = (loss(m + e, cuts, y) - loss(m - e, cuts, y)) / (2 * e)
            steps = []
            for k in range(3):
                up, down = ([c + s * (j == k) for j, c in enumerate(cuts)] for s in (e, -e))
                steps.append((loss(m, up, y) - loss(m, down, y)) / (2 * e))
            for c, wc in zip(x, w, strict=True):
                z[c] += g - ((n[c] + g * g) ** 0.5 - n[c] ** 0.5) / 0.3 * wc
                n[c] += g * g
            for k, gk in enumerate(steps):
                if gk:
                    pace[k] += gk * gk
                    cuts[k] -= 0.3 * gk / pace[k] ** 0.5
            for k in range(1, 3):
                cuts[k] = max(cuts[k] + k * 1e-6, cuts[k - 1])
    assert np.allclose(toxicity.ordinal_fit(rows, grade, 20), [*(weight(c) for c in range(20)), *cuts], atol=1e-3)


def test_severity_rises_with_planted_severity(spark):
    rng = np.random.default_rng(10)
    words, insults = [f"plain{i}" for i in range(80)], ["scumbag", "vermin", "cretin"]
    text = lambda k: " ".join(rng.permutation([*rng.choice(words, 30 - k), *rng.choice(insults, k)]))
    planted = [int(k) for k in rng.choice([0, 1, 4, 12], 600)]
    docs = spark.createDataFrame([(i, text(k)) for i, k in enumerate(planted)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(k > 0)) for i, k in enumerate(planted)], "doc_id long, quality int, toxic int")
    rows = [(planted[r["doc_id"]], r["expected_severity"], r["toxic"]) for r in toxicity.toxicity(docs, labels).where("held_out").collect()]
    mean = [np.mean([s for k, s, _ in rows if k == want]) for want in (0, 1, 4, 12)]
    assert mean[0] < 0.3 and mean[1] > mean[0] + 0.3 and all(np.diff(mean) > 0)
    assert all(t == (k > 0) for k, _, t in rows)


def test_models_odd_rows(spark, odd_documents, no_documents, some_labels):
    for f in (quality.quality, toxicity.toxicity):
        out = f(odd_documents, some_labels)
        assert out.count() == odd_documents.count() and f(no_documents, some_labels).count() == 0
        assert f(odd_documents, some_labels.limit(0)).count() == odd_documents.count()
        assert out.where("doc_id is null and not held_out").count() == 1
    scored = quality.score_quality(odd_documents, quality.fit_quality(odd_documents, some_labels))
    assert scored.columns == [c for c in odd_documents.columns if c != "quality_score"] + ["quality_score"]


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    x = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(1500)]
    score = np.array([np.isin(r, [1, 2]).sum() * 2 + np.isin(r, [3]).sum() for r in x])
    grade = np.digitize(score, [1, 2, 4])
    m = toxicity.ordinal_fit(x, grade, 30, grades=4)
    margin = np.array([m[:30][r].sum() for r in x])
    assert (np.diff(m[30:]) > 0).all() and m[1] > m[3] > max(m[4:30].max(), 0)
    assert np.corrcoef(margin, score)[0, 1] > 0.9


@pytest.fixture(scope="module")
def labelled_dir(spark, some_labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels"))
    some_labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_on_odd_rows(spark, odd_documents, no_documents, labelled_dir):
    import corpus_pipeline as P
    from candor.llm.runtime import materialize

    clash = {c: k for k, c in enumerate(("_id", "_n", "_key", "_rate", "_chars", "_component", "_row", "_who", "_deal", "node", "component", "c0", "c1", "base", "spans", "loose"))}
    for d in (odd_documents, no_documents):
        d = materialize(d.selectExpr("*", *(f"{v} as {c}" for c, v in clash.items())), "odd")
        for name, stage in P.STAGES[:-1]:
            out = materialize(stage(spark, d, labelled_dir), "odd")
            assert out.columns == d.columns, name
            rows = out.collect()
            assert all(r[c] == v for r in rows for c, v in clash.items()) and all(r["copy"] == 3 and r["quality_score"] == 0.5 for r in rows), name
            assert len(rows) == {"n-gram jaccard join": d.count() - 1, "personal data": d.count()}.get(name, len(rows)) if rows else not d.count(), name
        assert (P.STAGES[-1][1](spark, d, labelled_dir).count() > 0) == (d.count() > 0)


def test_different_texts_of_one_id_stay(spark, labelled_dir):
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (1, a, "again"), (3, f"{b} end", "near"), (None, c, "no id"), (5, c, "id"), (6, "", "e"), (7, None, "n"), (6, "", "e2")]
    d = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = dict(P.STAGES)["n-gram jaccard join"](spark, d, labelled_dir)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(1, a), (1, b), (5, c), (6, ""), (6, ""), (7, None)])


def test_equal_rows_are_dealt_apart(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "same", "s")] * 400 + [(None, f"t{i}", "s") for i in range(400)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = mixing.mix_sources(d, size=3.0)
    assert out.where("doc_id is null").groupBy("text").count().select("count").distinct().count() > 2, "texts without an id draw apart"
    parts = out.where("text = 'same'").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1


def test_scopes_remove_what_is_not_the_result(spark, odd_documents):
    import glob

    from candor.llm import ngram_join
    from candor.llm.runtime import materialize, scope

    folder = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    out = ngram_join.near_duplicates(odd_documents)
    assert len(set(glob.glob(f"{folder}/*")) - before) == 1 and out.count() == odd_documents.count()
    with scope(spark):
        materialize(odd_documents, "gone")
        assert len(set(glob.glob(f"{folder}/gone-*"))) == 1
    assert not glob.glob(f"{folder}/gone-*")


@needs_tables
def test_run_leaves_only_its_result(spark):
    import glob

    import corpus_pipeline as P

    folder = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    out = P.run(spark, "/root/testdata/sf0.001")
    assert len(set(glob.glob(f"{folder}/*")) - before) == 1 and out.count() > 0


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline as P
    from candor.llm.runtime import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in P.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF), "t"))
    assert all(d.columns == docs.columns for d in seen[:-1]) and len(P.STAGES) == 5
    good, unique, clean, mixed, packed = seen[1:]
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in good.collect()} == {d for d, p in scores.items() if p}
    from tests.llm.test_near_duplicates import brute

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    alone = {d for d, (n, c) in brute(rows).items() if c == d or not n}
    assert {r["doc_id"] for r in unique.collect()} == alone and unique.count() == len(alone)
    assert clean.count() == unique.count() and not any(base_spans(r["text"]) for r in clean.collect())
    assert set(r["doc_id"] for r in mixed.collect()) <= alone
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}
    assert packed.where("piece = 0").count() == mixed.count()
    assert shared_dir(spark)
