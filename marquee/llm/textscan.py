"""Vectorised scans over Arrow text columns: words, hashes, sliding-window anchors.

Everything here runs inside one Spark task on one Arrow batch. Texts are read as
UTF-8 bytes straight from the Arrow buffer; no per-word Python objects are made.

Hashes are polynomial sums modulo 2**64 over a random byte table, finished with a
mixing step; they do not depend on where in a batch a word or window stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20            # bytes (or words) handled by one round of array operations
_BASE = 0xD1342543DE82EF95
_M64 = (1 << 64) - 1
_cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def seeded(values: np.ndarray, seed: int) -> np.ndarray:
    """Second, independent hash of 64-bit values."""
    return mix(values + U((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & _M64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j < n (kept per worker)."""
    have = _cache.get("p")
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 1)
        inv = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inv):
            p = np.full(size, U(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _cache["p"] = (out[0], out[1])
    return have


_BYTE_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: white space of the word rule [^\x20\x09-\x0D]+
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column), type=pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def doc_groups(offsets: np.ndarray, limit: int = PIECE):
    """Consecutive rows whose texts together stay near ``limit`` bytes (a longer text stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit symbols, one longer than the input."""
    out = np.zeros(len(symbols) + 1, dtype=U)
    np.cumsum(symbols * _powers(len(symbols))[0][:len(symbols)], out=out[1:])
    return out


def range_hash(acc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] from running sums; equal content, equal hash."""
    inv = _powers(len(acc))[1]
    return mix((acc[end] - acc[start]) * inv[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False):
    """Words of concatenated texts: (start, end, hash) in bytes, in order.

    ``bounds`` are the offsets where texts begin (and the end); a word never
    crosses one. With ``lower`` the hash sees A-Z as a-z.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    table = _BYTE_TABLE[_LOWER] if lower else _BYTE_TABLE
    hashes = np.empty(len(start), dtype=U)
    i = 0
    while i < len(start):        # whole words, about PIECE bytes at a time
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, side="right")))
        base = start[i]
        acc = prefix_hash(table[data[base:end[j - 1]]])
        hashes[i:j] = range_hash(acc, start[i:j] - base, end[i:j] - base)
        i = j
    return start, end, hashes


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by doubling."""
    span, m = 1, a
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


_POS_BITS = 22
_POS_MASK = U((1 << _POS_BITS) - 1)


def anchored_runs(symbols: np.ndarray, window: int, gram: int):
    """Runs of consecutive windows that share their anchor, for one text.

    A window is ``window`` consecutive symbols. Its anchor is the gram of ``gram``
    symbols inside it with the least hash (the leftmost of equal ones), so equal
    windows have equal anchors at equal offsets. Consecutive windows with one
    anchor form a run that covers ``window + n - 1`` symbols.

    Returns (key, full, start, n): the hash of the anchor with its offset rule,
    the hash of all symbols that the run covers, its first window and the number
    of windows. Long texts are worked through in pieces; a run may end at a piece.
    """
    total = len(symbols) - window + 1
    if total <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(0, U), z, z
    keys, fulls, starts, counts = [], [], [], []
    for a in range(0, total, PIECE):
        b = min(total, a + PIECE)
        part = symbols[a:b + window - 1]
        acc = prefix_hash(part)
        i = np.arange(len(part) - gram + 1, dtype=np.int64)
        g = range_hash(acc, i, i + gram)
        packed = (g & ~_POS_MASK) | i.astype(U)
        owner = (sliding_min(packed, window - gram + 1) & _POS_MASK).astype(np.int64)
        s = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        e = np.concatenate((s[1:], [len(owner)]))
        keys.append(seeded(g[owner[s]], 1))
        # the anchor's place in the run is part of what the run is
        fulls.append(seeded(range_hash(acc, s, e + window - 1) + (owner[s] - s).astype(U), 2))
        starts.append(s + a)
        counts.append(e - s)
    return np.concatenate(keys), np.concatenate(fulls), np.concatenate(starts), np.concatenate(counts)


def window_hashes(symbols: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window of one (short) run."""
    acc = prefix_hash(symbols)
    i = np.arange(len(symbols) - window + 1, dtype=np.int64)
    h = range_hash(acc, i, i + window)
    acc2 = prefix_hash(seeded(symbols, 7))
    return h, range_hash(acc2, i, i + window)


def merge_spans(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [start, start+length) as sorted, disjoint, non-touching spans (start, end)."""
    if len(start) == 0:
        z = np.zeros(0, np.int64)
        return z, z
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate((start + length)[o])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    i = np.flatnonzero(new)
    return s[i], np.concatenate((e[i[1:] - 1], e[-1:]))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
