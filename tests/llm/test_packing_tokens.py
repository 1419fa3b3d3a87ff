"""Packing against a per-item reference and an exact round trip; token files against the tokenizer."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candor.llm import packing, tokens
from candor.llm.runtime import fresh_path, materialize


def best_fit(lengths, capacity):
    """Item by item: the tightest bin that has room, else a new one. Sorted rooms left over."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_equals_item_by_item(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_plan(counts, 40)
    taken = {}
    for length in counts:
        rows = [r for r in plan if r[0] == length]
        for rank in range(counts[length]):
            row = max((r for r in rows if r[1] <= rank), key=lambda r: r[1])
            k = rank - row[1]
            taken.setdefault(int(row[2] + k // row[4]), []).append((int(row[3] + k % row[4] * length), length))
    left = []
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
        left.append(40 - at)
    assert sorted(left) == best_fit(lengths, 40)


def test_capacity_tree():
    t = packing.CapacityTree(10)
    assert t.tightest(1) is None
    t.add(7, 1)
    t.add(4, 2)
    assert (t.tightest(1), t.tightest(4), t.tightest(5), t.tightest(8)) == (4, 4, 7, None)
    t.add(7, -1)
    assert t.tightest(5) is None


def test_same_ids_as_the_tokenizer_file():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    alphabet = "abc XYZ  \n\t'sll09.,;:!?-_é 　漢字😀ßẞ́<|endoftext|>\x85 "
    texts = ["", " ", "don't we'LL", "<|endoftext|>", "a" * 3000, "\n\n \n", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000))]
    texts += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", " \n<|endoftext|>  \n", "<|endoftext|", *("<|endoftext|>".join(rng.sample(texts, 3)) for _ in range(500))]
    assert [tokens.encode(x, added=True).tolist() for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    t.encode_special_tokens = True
    assert [tokens.encode(x).tolist() for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pack_documents(spark, odd_documents, no_documents):
    rows = packing.pack_documents(spark, odd_documents).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    want = []
    for doc, text in texts:
        ids = [*tokens.encode(text, added=True).tolist(), 2]
        first = len(ids) % 1024 or 1024
        for k, at in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[at : first + k * 1024]
            want.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(spark, no_documents).count() == 0


def test_sequences_hold_the_ids(spark, odd_documents):
    packed = materialize(packing.pack_documents(spark, odd_documents), "p")
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    found = {}
    for r in packed.collect():
        assert got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        found.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert sum(map(len, got.values())) == sum(r["length"] for r in packed.collect()) and max(map(len, got.values())) <= 1024
    for r in odd_documents.where("doc_id > 1").collect():
        assert [i for _, ids in sorted(found[r["doc_id"]]) for i in ids] == [*tokens.encode(r["text"], added=True).tolist(), 2]
    wide = packing.pack_documents(spark, odd_documents.where("doc_id = 6"), separator=70_000).collect()
    assert [r["ids"] for r in wide] == [[*tokens.encode("Ünïcode 漢字 😀 <|endoftext|> end", added=True).tolist(), 70_000]]


def test_added_token_in_a_text(spark):
    d = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    (row,) = packing.pack_documents(spark, d).collect()
    assert row["ids"] == [64, 220, 50256, 275, 2] and row["length"] == 5
    assert tokens.token_counts(spark, d).first()["n_tokens"] == 9


def test_pieces_that_are_alike_are_spread(spark):
    parts = packing.token_pieces(spark.createDataFrame([(None, None)] * 3000, "doc_id long, text string"), 1024, 2)
    packed = packing.pack(materialize(parts, "p"), 1024, bucket_rows=16)
    assert packed.select("sequence_id", "offset").distinct().count() == 3000 and packed.agg({"sequence_id": "max"}).first()[0] == 2


def test_files_refuse_ids_that_do_not_fit(spark, odd_documents, monkeypatch):
    with pytest.raises(ValueError):
        tokens.write_token_files(odd_documents, fresh_path(spark, "t"), separator=70_000)
    monkeypatch.setattr(tokens, "encoder", lambda v: type("wide", (), {"n_vocab": 100_000}))
    with pytest.raises(ValueError):
        tokens.write_token_files(odd_documents, fresh_path(spark, "t"))


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    lists = {"a": [[], [1], [1, 2, 3, 4, 5, 6, 7], [], [9]], "b": [], "c": [[5] * 130]}
    open_end = {"a": False, "b": False, "c": True}
    for name, docs in lists.items():
        ids = [i for d in docs for i in [*d, 0]]
        np.array(ids[:-1] if open_end[name] else ids, "<u2").tofile(tmp_path / name)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in lists], "path string")
    got = sorted((r["path"][-1], r["ordinal"], r["n_tokens"], r["terminated"]) for r in tokens.scan_token_files(paths, separator=0, block_ids=block).collect())
    assert got == sorted((n, k, len(d), not open_end[n]) for n, docs in lists.items() for k, d in enumerate(docs))


def test_token_counts(spark, odd_documents, no_documents):
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    want = sorted(((r["doc_id"], len(tokens.encode(r["text"]))) for r in odd_documents.collect()), key=key)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(spark, odd_documents).collect()), key=key) == want
    assert tokens.token_counts(spark, no_documents).count() == 0


def test_files_hold_the_ids(spark, odd_documents):
    index = materialize(tokens.write_token_files(odd_documents, fresh_path(spark, "t")), "i")
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    by_path = {}
    for r in index.collect():
        by_path.setdefault(r["path"], []).append((r["ordinal"], r["doc_id"]))
    for path, docs in by_path.items():
        ids = np.fromfile(path.removeprefix("file://"), "<u2").tolist()
        assert ids == [i for _, d in sorted(docs) for i in [*tokens.encode(texts[d]).tolist(), tokens.END_OF_DOCUMENT]]
