"""Near duplicates by word n-gram sets: a prefix index finds candidates, tries of ordered sets decide them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.runtime import broadcast_if_small, connected_components, grouped, joined_components, lean, materialize, text_of, tidy
from candor.llm.textkit import mix, pieces, words

#: Documents of a trie; a pivot with more candidates gets several tries.
BLOCK = 128
#: Shingles held at a time when a task looks for widely shared ones.
LOOKED_AT = 1 << 21
#: Ids are broadcast up to this number, and beyond it joined by shuffle.
FEW = 200_000


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the word n-grams of each text, ascending, and where each text's begin.

    A text with fewer words is one sequence; one without words has none.
    """
    h, begin = words(texts)
    size = np.diff(begin)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), size)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    left = begin[doc + 1] - np.arange(len(h))
    whole = np.minimum(left, n)
    roll = np.zeros(len(h), np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        roll = np.where(k < whole, mix(roll * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(h)] + np.uint64(k + 1)), roll)
    first = np.arange(len(h)) == begin[doc]
    keep = (left >= n) | (first & (size[doc] < n))
    doc, roll = doc[keep], roll[keep].view(np.int64)
    order = np.lexsort((roll, doc))
    doc, roll = doc[order], roll[order]
    new = np.ones(len(roll), bool)
    new[1:] = (roll[1:] != roll[:-1]) | (doc[1:] != doc[:-1])
    doc, roll = doc[new], roll[new]
    return roll, np.searchsorted(doc, np.arange(len(texts) + 1))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first elements of a set of ``n`` hold one that any set similar enough shares: n - ceil(percent n / 100) + 1."""
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def globally_ordered(values: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A set in the global order: shingles that few documents share first (by hash), then the widely shared, rarest first."""
    if not len(hot) or not len(values):
        return values
    where = np.minimum(np.searchsorted(hot[:, 0], values), len(hot) - 1)
    rank = np.where(hot[where, 0] == values, hot[where, 1], 0)
    return values[np.argsort(rank, kind="stable")]


def signatures(docs: DataFrame, n: int, local: int = 3) -> DataFrame:
    """``doc_id, n_shingles, digest, bitmap, wide``: per row the size, a 128-bit digest and a bitmap of its set.

    The bitmap has a bit for each hash modulo a power of two of about twice the set's size: two sets differ in at least as many
    elements as their bitmaps do. ``wide``, on some rows, lists shingles that ``local`` different sets share out of as many rows of a
    task as hold ``LOOKED_AT`` shingles.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        seen: set[bytes] = set()
        different: list[np.ndarray] = []
        waiting: list[pa.Array] | None = None

        def shared() -> list[dict[str, int]]:
            """What several of the sets looked at so far share; they are forgotten."""
            value, count = np.unique(np.concatenate(different) if different else np.zeros(0, np.int64), return_counts=True)
            seen.clear()
            different.clear()
            return [{"shingle": s, "n": c} for s, c in zip(value[count >= local].tolist(), count[count >= local].tolist(), strict=True)]

        def listed(columns: list[pa.Array], wide: list[dict[str, int]] | None) -> pa.RecordBatch:
            lists = pa.array([wide, *[None] * (len(columns[0]) - 1)], pa.list_(pa.struct([("shingle", pa.int64()), ("n", pa.int64())])))
            return pa.record_batch([*columns, lists], ["doc_id", "n_shingles", "digest", "bitmap", "wide"])

        for batch in batches:
            for a, b in pieces(batch.column(1)):
                if waiting:
                    yield listed(waiting, shared() if sum(map(len, different)) > LOOKED_AT else None)
                values, begin = shingle_sets(batch.column(1).slice(a, b - a), n)
                own = [values[i:j] for i, j in zip(begin[:-1], begin[1:], strict=True)]
                digests = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in own]
                for v, d in zip(own, digests, strict=True):
                    if d not in seen:
                        seen.add(d)
                        different.append(v.copy())
                maps = pa.array([bitmap(v).tobytes() for v in own], pa.binary())
                waiting = [batch.column(0).slice(a, b - a), pa.array(np.diff(begin).astype(np.int64)), pa.array(digests, pa.binary()), maps]
        if waiting:
            yield listed(waiting, shared())

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bitmap binary, wide array<struct<shingle:long,n:long>>")


def bitmap(values: np.ndarray) -> np.ndarray:
    size = max(64, 1 << int(2 * len(values) - 1).bit_length()) if len(values) else 64
    bits = np.zeros(size, bool)
    bits[values & (size - 1)] = True
    return np.packbits(bits, bitorder="little")


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets from their bitmaps; the longer is folded to the shorter."""
    while len(a) != len(b):
        if len(a) > len(b):
            a = a[: len(a) // 2] | a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] | b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def hot_shingles(rows: DataFrame, most: int = 1 << 17) -> np.ndarray:
    """Hashes and ranks of widely shared shingles, from the lists of the tasks summed up.

    Any order of shingles gives the same links, so this need not be complete: it only keeps passages that very many documents
    share out of the prefixes. At most ``most`` shingles (the most frequent) are ranked, which bounds what is broadcast.
    """
    each = rows.where(F.size("wide") > 0).select(F.explode("wide").alias("w"))
    top = each.groupBy("w.shingle").agg(F.sum("w.n").alias("n")).orderBy(F.desc("n"), "shingle").limit(most).collect()
    by_count = sorted((r["n"], r["shingle"]) for r in top)
    ranked = np.array([(s, k + 1) for k, (_, s) in enumerate(by_count)], np.int64).reshape(-1, 2)
    return ranked[np.argsort(ranked[:, 0])]


class Trie:
    """Path-compressed trie of ordered sets; every node knows the least and greatest size of the sets below it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        # a node: (depth where its edge begins, depth where it ends, a set that runs through it, children, sets that end in it, least size, greatest size)
        self.root = self._build(list(range(len(sets))), 0)

    def _build(self, members: list[int], depth: int) -> list[tuple]:
        nodes, groups = [], {}
        for m in members:
            if self.sizes[m] > depth:
                groups.setdefault(int(self.sets[m][depth]), []).append(m)
        for group in groups.values():
            end = self._shared(group, depth)
            done = [m for m in group if self.sizes[m] == end]
            sizes = self.sizes[group]
            children = self._build([m for m in group if self.sizes[m] > end], end) if len(done) < len(group) else []
            nodes.append((depth, end, group[0], children, done, int(sizes.min()), int(sizes.max())))
        return nodes

    def _shared(self, group: list[int], depth: int) -> int:
        one, end = self.sets[group[0]], int(self.sizes[group].min())
        for m in group[1:]:
            differ = np.flatnonzero(one[depth:end] != self.sets[m][depth:end])
            if len(differ):
                end = depth + int(differ[0])
        return end

    def similar(self, query: np.ndarray, percent: int, skip: np.ndarray) -> list[int]:
        """Sets whose Jaccard similarity to ``query`` reaches ``percent``, but for those in ``skip``.

        The overlap of a path is counted once for all sets below it. A subtree ends when even the greatest overlap that the rest
        of its sets allows falls short of what the least similar size needs.
        """
        inside = np.sort(query)
        found, stack = [], [(node, 0) for node in self.root]
        while stack:
            (start, end, through, children, done, least, greatest), overlap = stack.pop()
            edge = self.sets[through][start:end]
            at = np.minimum(np.searchsorted(inside, edge), len(inside) - 1)
            overlap += int((inside[at] == edge).sum())
            for m in done:
                if not skip[m] and 100 * overlap >= percent * (len(query) + end - overlap):
                    found.append(m)
            # the most similar size: just large enough to hold all of the query that the path has not
            size = min(max(len(query) - overlap + end, least), greatest)
            reach = min(len(query), overlap + size - end)
            if children and 100 * reach >= percent * (len(query) + size - reach):
                stack.extend((child, overlap) for child in children)
        return found


def link_block(table: pa.Table, percent: int) -> pa.RecordBatch:
    """Links that connect the similar sets of one block: for each set the first of its component inside the block.

    Sets known to be connected are not compared again, which leaves the components as they are.
    """
    rows = sorted(set(zip(table.column("doc").to_pylist(), table.column("shingles").to_pylist(), strict=True)))
    ids = np.array([doc for doc, _ in rows])
    sets = [np.frombuffer(b, "<i8") for _, b in rows]
    trie = Trie(sets)
    group = np.searchsorted(ids, ids)
    for i in range(len(ids)):
        skip = group == group[i]
        if skip.all():
            break
        for m in trie.similar(sets[i], percent, skip):
            if group[m] != group[i]:
                low, high = sorted((group[m], group[i]))
                group[group == high] = low
    far = ids != ids[group]
    return pa.record_batch([pa.array(ids[far]), pa.array(ids[group[far]])], ["a", "b"])


def prefixes(docs: DataFrame, hot: np.ndarray, n: int, percent: int) -> DataFrame:
    """``doc, n, prefix``: the first elements of each set in the global order, for texts with words."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                values, begin = shingle_sets(batch.column(1).slice(a, b - a), n)
                size = np.diff(begin)
                first = prefix_size(size, percent)
                parts = [globally_ordered(values[i:j], shared.value)[:k] for i, j, k in zip(begin[:-1], begin[1:], first, strict=True)]
                offsets = np.concatenate([[0], np.cumsum(first)]).astype(np.int32)
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc", "n", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, "doc long, n long, prefix array<long>").where("n > 0")


def shared_groups(index: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``group, pivot, doc, n, at`` of the shingles that several documents have in their prefixes.

    One shuffle, by shingle; a task then streams over sorted shingles and drops those of a single document, which are nearly all.
    Shingles of the same documents get the same group, the hash of their list; ``pivot`` is the least document. A shingle with
    more than ``most`` documents isn't held to be hashed but is a group by itself.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pivot, running = 0, None

        def flush(rows: np.ndarray, open_end: bool) -> Iterator[pa.RecordBatch]:
            """Rows (shingle, doc, n, at) of whole runs; of an open last run only if it has grown too long."""
            nonlocal pivot, running
            cut = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] ^ 1))
            ends = np.append(cut[1:], len(rows))
            first = rows[cut, 1].copy()
            many = rows[ends - 1, 1] != first
            mark = np.bitwise_xor.reduceat(mix(rows[:, 1].copy().view(np.uint64)), cut) ^ mix((ends - cut).astype(np.uint64))
            if rows[0, 0] == running:
                first[0], many[0], mark[0] = pivot, True, mix(rows[:1, 0].copy().view(np.uint64))[0]
            if open_end:
                mark[-1], many[-1] = mix(rows[-1:, 0].copy().view(np.uint64))[0], True
            size = ends - cut
            keep = np.repeat(many, size)
            pivot, running = int(first[-1]), rows[-1, 0] if open_end else None
            if keep.any():
                cols = [np.repeat(mark, size).view(np.int64)[keep], np.repeat(first, size)[keep], rows[keep, 1], rows[keep, 2], rows[keep, 3]]
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], ["group", "pivot", "doc", "n", "at"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            rows = np.concatenate([*held, rows])
            tail = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if tail:
                yield from flush(rows[:tail], False)
            held = [rows[tail:]]
            if len(held[0]) > most:
                yield from flush(held[0], True)
                held = []
        if held and len(held[0]):
            yield from flush(held[0], False)

    dealt = index.repartition("shingle").sortWithinPartitions("shingle", "doc").select("shingle", "doc", "n", "at")
    made = dealt.mapInArrow(run, "group long, pivot long, doc long, n long, at long")
    # of the shingles of a group, each document keeps the place that allows most
    return made.groupBy("group", "pivot", "doc", "n").agg(F.min("at").alias("at"))


def ordered_sets(docs: DataFrame, hot: np.ndarray, n: int) -> DataFrame:
    """``doc, digest, shingles``: the sets themselves as bytes, widely shared shingles first, as the tries hold them."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for a, b in pieces(batch.column(1)):
                values, begin = shingle_sets(batch.column(1).slice(a, b - a), n)
                own = [values[i:j] for i, j in zip(begin[:-1], begin[1:], strict=True)]
                sets = pa.array([globally_ordered(v, shared.value)[::-1].tobytes() for v in own], pa.binary())
                digests = pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in own], pa.binary())
                yield pa.record_batch([batch.column(0).slice(a, b - a), digests, sets], ["doc", "digest", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, "doc long, digest binary, shingles binary")


def candidate_sets(docs: DataFrame, pairs: DataFrame, known: DataFrame | None, hot: np.ndarray, n: int) -> DataFrame:
    """``doc, shingles`` of the documents in ``pairs(pivot, doc)``, added to those ``known``; one row per different text of an id.

    Only documents that are compared get here. Ids that are counted to be few are broadcast, so texts aren't shuffled; beyond that
    it is a join by shuffle.
    """
    wanted = pairs.select("doc").union(pairs.select("pivot")).distinct()
    wanted = materialize(wanted if known is None else wanted.join(known.select("doc").distinct(), "doc", "left_anti"), "candidates")
    texts = docs.join(broadcast_if_small(wanted.withColumnRenamed("doc", "doc_id"), FEW), "doc_id", "left_semi")
    sets = ordered_sets(texts, hot, n)
    sets = materialize(sets.groupBy("doc", "digest").agg(F.min("shingles").alias("shingles")).drop("digest"), "sets")
    return sets if known is None else known.union(sets)


def in_blocks(pairs: DataFrame, size: int) -> DataFrame:
    """``pivot, block, doc``: a pivot and about ``size`` of its candidates to a block; the pivot is in each.

    Few enough, they are broadcast to the sets or bitmaps that they name, so of these only the ones compared are shuffled.
    """
    often = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("c"))
    blocks = pairs.join(often, "pivot").withColumn("block", F.pmod(F.xxhash64("doc"), F.ceil(F.col("c") / size)).cast("int")).select("pivot", "block", "doc")
    blocks = materialize(blocks, "blocks")
    return broadcast_if_small(blocks.union(blocks.select("pivot", "block", F.col("pivot").alias("doc")).distinct()), FEW)


def plausible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(pivot, doc)`` whose bitmaps leave room for enough overlap; no pair that links is lost.

    A bitmap is a thirtieth of its set, so most candidates are settled here and few sets have to travel.
    """

    def kernel(t: pa.Table) -> pa.RecordBatch | None:
        pivot, doc = t.column("pivot")[0].as_py(), t.column("doc").to_pylist()
        rows = list(zip(doc, t.column("n").to_pylist(), (np.frombuffer(b, np.uint8) for b in t.column("bitmap").to_pylist()), strict=True))
        base = [(n, m) for d, n, m in rows if d == pivot]
        good = {d for d, n, m in rows if d != pivot for pn, pm in base if (100 + percent) * (n + pn - least_difference(m, pm)) >= 2 * percent * (n + pn)}
        return pa.record_batch([pa.array([pivot] * len(good), pa.int64()), pa.array(sorted(good), pa.int64())], ["pivot", "doc"])

    held = in_blocks(pairs, BLOCK // 2).join(maps, "doc").select("pivot", "block", "doc", "n", "bitmap")
    return grouped(held, ["pivot", "block"], ["doc"], kernel, "pivot long, doc long")


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` among candidate ``pairs(pivot, doc)``, decided by tries over blocks of a pivot and its candidates."""
    held = in_blocks(pairs, BLOCK).join(sets, "doc").select("pivot", "block", "doc", "shingles")
    return grouped(held, ["pivot", "block"], ["doc"], lambda t: link_block(t, percent), "a long, b long")


@tidy
def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: components of documents whose n-gram sets overlap enough.

    Two documents link when 100 times the intersection is at least ``percent`` times the union. Equal sets are one class, found
    by digest. Of each class one document enters an index of prefixes: in a global order of shingles, similar sets share one of
    their first elements. The documents at a shingle are compared with the least of them, the pivot, by tries. What is left are
    shingles whose other documents are not all of one component; these go on with more pivots at a time (about 8, 64, 512, ..., chosen by
    hash, until all are), and only between components, until every shingle's documents have been compared or are connected. No pair that could link is lost and
    none inside a component is made twice; the answer does not depend on blocks, order of rows or the hot list.

    Texts without words (null, empty) have no shingles and link with nothing. Rows that share an id are one document for links,
    and each is returned. A null id gives a null component. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(signatures(docs, n), "signatures")
    hot = hot_shingles(rows)
    usable = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).select("doc_id", F.col("n_shingles").alias("n"), "digest")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # both sides of the join are shuffled for it alone, so Spark can split a class that very many documents are in
    same = usable.join(materialize(classes, "classes"), "digest").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).where("a != b")
    same = materialize(same, "copies")
    # only the first document of a class enters the index
    one_text = usable.groupBy("doc_id").agg((F.min("digest") == F.max("digest")).alias("one")).where("one").select(F.col("doc_id").alias("a"))
    copies = broadcast_if_small(materialize(same.select("a").distinct().join(one_text, "a").select(F.col("a").alias("doc")), "later-copies"), FEW)
    index = prefixes(docs.where(F.col("doc_id").isNotNull()), hot, n, percent).join(copies, "doc", "left_anti").select("doc", "n", F.posexplode("prefix").alias("at", "shingle")).withColumn("at", F.col("at").cast("long"))
    members = materialize(shared_groups(index), "members")
    several = members.select("doc").distinct()
    maps = rows.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "digest", "bitmap").where("n > 0").join(several, "doc", "left_semi")
    maps = maps.groupBy("doc", "digest").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap")).drop("digest")
    maps = materialize(maps, "bitmaps")
    pivot = members.where("doc = pivot").select("group", F.col("n").alias("pn"), F.col("at").alias("pat"))
    others = members.where("doc != pivot")
    pairs = others.join(pivot, "group").where(may_link("n", "at", "pn", "pat", percent)).select("pivot", "doc").distinct()
    pairs = materialize(plausible(pairs, maps, percent), "pairs")
    sets = candidate_sets(docs, pairs, None, hot, n)
    links = materialize(same.union(verified_links(pairs, sets, percent)), "links")
    component = connected_components(links, "a", "b")
    left, pivots = others.select("group", "doc", "n", "at"), 8
    while True:
        tagged = left.join(component, left["doc"] == component["node"], "left").select("group", "doc", "n", "at", F.coalesce("component", "doc").alias("of"))
        mixed = tagged.groupBy("group").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count(F.lit(1)).alias("c")).where("low != high").select("group", "c")
        # written, so a group that very many documents are in can be split in the join
        tagged = tagged.join(broadcast_if_small(materialize(mixed, "mixed-groups"), FEW), "group")
        chosen = F.pmod(F.xxhash64("doc", F.lit(pivots)), F.ceil(F.col("c") / pivots)) == 0
        tagged = materialize(tagged.withColumn("chosen", chosen).drop("c"), "undecided")
        if tagged.isEmpty():
            break
        first = tagged.where("chosen").select("group", F.col("doc").alias("pivot"), F.col("n").alias("pn"), F.col("at").alias("pat"), F.col("of").alias("pof"))
        # two pivots meet once, at the lesser
        once = (F.col("doc") > F.col("pivot")) | ((F.col("doc") != F.col("pivot")) & ~F.col("chosen"))
        pairs = tagged.join(first, "group").where(once & (F.col("of") != F.col("pof")) & may_link("n", "at", "pn", "pat", percent)).select("pivot", "doc").distinct()
        pairs = materialize(plausible(pairs, maps, percent), "pairs")
        if not pairs.isEmpty():
            sets = candidate_sets(docs, pairs, sets, hot, n)
            more = materialize(verified_links(pairs, sets, percent), "links")
            if not more.isEmpty():
                component = materialize(joined_components(component, more), "components")
        left = tagged.where(~F.col("chosen")).select("group", "doc", "n", "at")
        pivots *= 8
    return rows.select("doc_id", "n_shingles").join(component, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def may_link(n: str, at: str, pn: str, pat: str, percent: int):
    """Whether two sets that share an element at these places of the global order, and none before, can be similar enough.

    By size, and by what is left of both from there on. If they share one before, the pair is judged there, where more is left.
    """
    reach = F.least(F.col(n) - F.col(at), F.col(pn) - F.col(pat))
    return (100 + percent) * reach >= percent * (F.col(n) + F.col(pn))
