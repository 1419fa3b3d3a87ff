"""The n-gram join and the embedding operator against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from candor.llm import embedding_dedup, ngram_join
from candor.llm.runtime import connected_components


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    c = components(ids, links)
    return {d: (len(sets[d]), c[d]) for d in ids}


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(9))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice((3, 5, 6, 30, 80, 200)))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w + passage
        text = " ".join(w)
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = [*corpus(seed), (900, ""), (901, None), (902, " \n"), (903, "One"), (904, "oNE"), (905, "One two")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_shingles_of_many_unlike_documents(spark, monkeypatch):
    """A passage that is not ranked: hundreds of documents meet at its shingles, so several rounds of pivots are needed."""
    monkeypatch.setattr(ngram_join, "hot_shingles", lambda rows: np.zeros((0, 2), np.int64))
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(420):
        own = rows[rng.randrange(len(rows))][1].split()[40:] if rows and rng.random() < 0.3 else [f"w{rng.randrange(10**6)}" for _ in range(60)]
        if rng.random() < 0.7:
            own[rng.randrange(60)] = "changed"
        rows.append((i, f"{passage} {' '.join(own)}"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and 50 < len({c for _, c in want.values()}) < 400


def test_ngram_join_odd_rows(spark, odd_documents, no_documents):
    got = [tuple(r) for r in ngram_join.near_duplicates(odd_documents).collect()]
    assert len(got) == odd_documents.count()
    assert got.count((1, 3, 1)) == 2 and (2, 0, 2) in got and (3, 0, 3) in got and [r for r in got if r[0] is None][0][2] is None
    assert ngram_join.near_duplicates(no_documents).count() == 0


def test_rows_that_share_an_id(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, "x y z x y z")]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_trie_finds_all_and_only_similar_sets():
    rng = np.random.default_rng(3)
    base = np.arange(40)
    sets = [np.sort(np.unique(np.concatenate([rng.permutation(base)[: rng.integers(25, 41)], rng.integers(100, 140, rng.integers(0, 12))]))) for _ in range(60)]
    trie = ngram_join.Trie(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
        assert sorted(trie.similar(q, 80, np.zeros(len(sets), bool))) == want


def test_bitmap_bound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 400))) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: rng.integers(0, len(a) + 1)]]))
        assert ngram_join.least_difference(ngram_join.bitmap(a), ngram_join.bitmap(b)) <= len(np.setxor1d(a, b))


def test_shared_groups_stream(spark):
    rows = [(s, d, 10, s % 3) for s in range(40) for d in range(50) if (d * 7 + s) % (s + 1) == 0]
    index = spark.createDataFrame(rows, "shingle long, doc long, n long, at long")
    want = defaultdict(set)
    for s, d, _, _ in rows:
        want[s].add(d)
    sets = {frozenset(v) for v in want.values() if len(v) > 1}
    for most in (1 << 20, 4):
        got = defaultdict(set)
        for r in ngram_join.shared_groups(index, most=most).collect():
            got[r["group"]].add(r["doc"])
            assert r["pivot"] <= r["doc"]
        assert {frozenset(v) for v in got.values()} == sets


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(700, 700 + i) for i in range(1, 90)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert got == components(nodes, [p for p in links if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((6, 16))
    rows, vectors = [], {}
    for i in range(400):
        v = centres[rng.integers(6)] + rng.standard_normal(16) * rng.choice([0.02, 0.12, 1.0])
        if i % 20 == 0:
            v = centres[0]
        rows.append((i, [float(x) for x in v], int(rng.integers(2))))
        vectors[i] = (np.array(rows[-1][1]), rows[-1][2])
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] * 16, 1), (905, [1e300] * 16, 1), (906, [1e-300] * 16, 1), (907, [1.0] * 16, None), (908, [1.0, 1.0], 1)]
    d = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as i", "3 as links")
    links = [(a, b) for a in vectors for b in vectors if a < b and vectors[a][1] == vectors[b][1] and vectors[a][0] @ vectors[b][0] / np.linalg.norm(vectors[a][0]) / np.linalg.norm(vectors[b][0]) >= 0.98]
    c = components(vectors, links)
    degree = {i: 0 for i in vectors}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_duplicates(d).collect()}
    assert {i: got[i] for i in vectors} == {i: (degree[i], c[i], c[i] == i) for i in vectors}
    assert got[905] == (1, 905, True) and got[906] == (1, 905, False)
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 907, 908))
    assert embedding_dedup.embedding_duplicates(d.limit(0)).count() == 0


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(1)
    v = rng.standard_normal(16) + rng.standard_normal((60, 16)) * 0.01
    d = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    assert {(r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_duplicates(d).collect()} == {(59, 0)}


def test_rows_of_one_id_are_vectors_of_one_vertex(spark):
    e1, e2, near = [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]
    rows = [(1, e1, "x"), (1, e1, "x"), (1, e2, "x"), (3, near, "x"), (4, e2, "x"), (5, e2, "y"), (6, [-0.0, 1.0], "y"), (None, e1, "x")]
    got = sorted(tuple(r) for r in embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).where("vec_id is not null").collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (3, 2, 1, False), (4, 1, 1, False), (5, 1, 5, True), (6, 1, 5, False)]


def test_embeddings_with_repeated_ids(spark):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((5, 12))
    rows = [(int(rng.integers(90)), (centres[rng.integers(5)] + rng.standard_normal(12) * rng.choice([0.0, 0.03, 0.8])).astype(np.float32), int(rng.integers(2))) for _ in range(200)]
    d = spark.createDataFrame([(i, v.tolist(), k) for i, v, k in rows], "vec_id long, embedding array<float>, label int")
    unit = [v.astype(float) / np.linalg.norm(v.astype(float)) for _, v, _ in rows]
    links = [(a, b) for a in range(200) for b in range(a) if rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98]
    c = components({i for i, _, _ in rows}, [(rows[a][0], rows[b][0]) for a, b in links])
    want = sorted((rows[k][0], sum(k in p for p in links), c[rows[k][0]]) for k in range(200))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_duplicates(d).collect()) == want


def test_links_join_components(spark):
    from candor.llm.runtime import joined_components

    rng = random.Random(6)
    old, new = ([(rng.randrange(120), rng.randrange(120)) for _ in range(40)] for _ in range(2))
    first = connected_components(spark.createDataFrame(old, "a long, b long"), "a", "b")
    got = {r["node"]: r["component"] for r in joined_components(first, spark.createDataFrame(new, "a long, b long")).collect()}
    links = [p for p in old + new if p[0] != p[1]]
    assert got == components({x for p in links for x in p}, links)


def test_shingle_sets_of_pieces():
    texts = pa.array(["a b c d e f", None, "", "A  b\tc d E f", "x y", "x  Y"])
    values, begin = ngram_join.shingle_sets(texts, 5)
    parts = [values[i:j].tolist() for i, j in zip(begin[:-1], begin[1:], strict=True)]
    assert [len(p) for p in parts] == [2, 0, 0, 2, 1, 1] and parts[0] == parts[3] and parts[4] == parts[5]
