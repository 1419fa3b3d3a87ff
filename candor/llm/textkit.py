"""Vectorised splitting and hashing of texts: numpy over UTF-8 bytes, a bounded piece of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together.
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0 white space, 1 letters, digits and bytes of other scripts, 2 ASCII punctuation.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[SPACE] = 0
KIND[:9] = KIND[14:32] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def pieces(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold about ``size`` bytes each; a longer text is a range of its own."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, k in enumerate(n.tolist()):
        if i > start and held + k > size:
            yield start, i
            start, held = i, 0
        held += k
    if start < len(n):
        yield start, len(n)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with a line feed after each, and the offset of each text."""
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=offsets[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), offsets


def _parts(kind: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``limit`` bytes, each cut where a run ends, unless a single run is longer."""
    a = 0
    while a < len(kind):
        b = min(a + limit, len(kind))
        while 0 < b < len(kind):
            end = min(b + limit, len(kind))
            cut = np.flatnonzero(kind[b - 1 : end - 1] != kind[b:end])
            if len(cut):
                b += int(cut[0])
                break
            b = end
        yield a, b
        a = b


def run_hashes(data: np.ndarray, kind: np.ndarray, limit: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and 64-bit hash (letters A-Z lowered) of each run of bytes of one kind other than 0.

    Long data are worked on in parts cut between runs, so beside the runs found the working set stays bounded except for a
    single run longer than ``limit``.
    """
    found = [_run_hashes(data[a:b], kind[a:b], a) for a, b in _parts(kind, limit)]
    if len(found) == 1:
        return found[0]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, none.view(np.uint64))


def _run_hashes(data: np.ndarray, kind: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    starts, ends = edge[:-1], edge[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    n = ends - starts
    part = (LOWER[data].astype(np.uint64) + np.uint64(1)) * (kind > 0)
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    at = np.arange(len(data), dtype=np.int64) - np.maximum.accumulate(first)
    part *= powers(int(n.max()))[np.minimum(at, int(n.max()) - 1)]
    return starts + base, n, mix(np.add.reduceat(part, starts) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, lower-cased in A-Z, of all texts, and where each text's words begin."""
    data, offsets = joined(texts)
    starts, _, hashes = run_hashes(data, (~SPACE[data]).astype(np.uint8))
    return hashes, np.searchsorted(starts, offsets)
