"""Size-aware heavy-light Jaccard join on word shingles, and the groups that its links make.

Two documents link when their shingle sets have |A n B| / |A u B| of at least num/den.

1. Documents with the same set collapse to the one with the smallest id (their class).
2. Small sets (up to a boundary x) enumerate fixed-size subsets: linked sets of sizes
   n <= m share at least ceil(t*m) shingles, so every subset of that size is emitted and
   linked small sets meet in one of them. Large sets are posted to inverted lists: in the
   order of shingle hashes, linked sets share a shingle among their first
   n - ceil(t*n) + 1; only those are posted. Small sets that a large one may link with are
   posted too. The boundary is the x of least cost: emitted subsets against posted
   shingles and the list lengths that they meet, all counted over the documents.
3. A posting stays only if its list holds a partner that its size and place let link: at
   the first shingle that two sets share, no more is shared than what follows in either.
   Lists are scanned in order of size. A scan compares with smaller sets down to t times
   the size only, and only by places and by a bound: shingles fall into cells by hash (64 to 512, more for
   larger sets, as chance differences of few cells stay below the bound there), and the cell
   counts of two sets differ by at most the size of their symmetric difference, so a pair
   whose counts differ by more cannot link. Pairs that pass are not written out: a list
   yields one edge per document at most (a spanning forest), so a list of thousands of
   near copies gives thousands of edges and not millions; sets that a document is connected
   to already are not compared with it. A list longer than ``BAND`` is cut into bands of
   sizes, and every two bands whose sizes admit a link are scanned by some task.
4. Blocks are the components of those edges. No link crosses blocks. In a block the
   whole sets are compared exactly, within tiles of bounded size: tiles are cut from
   the block in order of size, and every two tiles whose sizes admit a link meet in some
   task. Pairs without a common first shingle cannot link, and pairs that are connected
   already are skipped, as only the groups are asked for.
5. Verified edges give the groups, by rounds of large-star and small-star steps over
   written tables.

Documents, lists and blocks are spread by shuffles; hot lists are split in bands, hot
blocks in tiles, both by counted buckets (``common.ranked``), so no group is sorted whole.

Defined cases: null or empty text has an empty set and links with nothing (also not with
another empty text); a text of fewer words than a shingle is one shingle, its whole
sequence; equal sets of texts link; rows that repeat an id are documents of their own and
get the component of their own text; rows with null ids come before others; a very long text
is one set of all its shingles, and alone in its tile if it exceeds one; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import Workspace, identified, partitions, ranked, read_table, small, with_ids
from .suffix_dedup import key_chunks
from .textscan import U

CELLS = 64                 # cells of a set's summary at least
MOST_CELLS = 512           # and at most; between, one for 16 shingles
SMALL_MOST = 20            # the largest boundary that is weighed
TILE_SHINGLES = 2_000_000  # shingles of a tile, one document at least
LIST_CHUNK = 50_000        # postings that a list scan holds besides those of one size band
BAND = 8_192               # postings of a list that are scanned by one task; more for lists beyond 16 bands
MOST_BAND = 100_000        # but no more than this
PARTNERS = 16              # postings of a list that are compared by place before they are kept
PLACE = 1 << 32            # a posting holds size * PLACE + place


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, offs = ts.text_bytes(texts)
    out = []
    for i, j in ts.doc_groups(offs):
        bounds = offs[i:j + 1] - offs[i]
        start, _, h = ts.words(data[offs[i]:offs[j]], bounds, lower=True)
        at = np.searchsorted(start, bounds)
        acc = ts.prefix_hash(h)
        for k in range(j - i):
            a, b = int(at[k]), int(at[k + 1])
            if a == b:
                out.append(np.zeros(0, dtype=U))
                continue
            w = min(width, b - a)
            s = np.arange(a, b - w + 1)
            out.append(np.unique(ts.range_hash(acc, s, s + w)))
    return out


def cell_number(n: int) -> int:
    """Cells of a set of n shingles: a power of two."""
    return min(MOST_CELLS, max(CELLS, 1 << (max(1, n) // 16).bit_length()))


def cell_counts(s: np.ndarray, cells: int) -> np.ndarray:
    """How many shingles fall into each cell by their leading bits, 255 standing for more."""
    at = (s >> U(65 - cells.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=cells), 255).astype(np.uint8)


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    """The same set's counts in fewer cells."""
    while len(counts) > cells:
        counts = np.minimum(counts[0::2].astype(np.uint16) + counts[1::2], 255).astype(np.uint8)
    return counts


def least_overlap(n: np.ndarray | int, num: int, den: int):
    """ceil(t * n): what a set of n shares at least with any set it links with that is not smaller."""
    return -(-num * n // den)


def subset_sizes(n: int, most: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a small set of n emits: one for every partner size m, n <= m <= most."""
    return sorted({least_overlap(m, num, den) for m in range(n, most + 1)
                   if num * m <= den * n and least_overlap(m, num, den) <= n}
                  | {least_overlap(n, num, den)})


def _subsets(s: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all subsets of the given size, each a sum over its members (order does not matter)."""
    member = ts.seeded(s, 11)
    whole = member.sum(dtype=U)
    # a subset of ``size`` is the whole set less some members
    out = [whole - member[list(c)].sum(dtype=U) for c in combinations(range(len(s)), len(s) - size)]
    return ts.seeded(np.array(out, dtype=U) + U(size * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), 12)


def boundary(sizes: dict[int, int], list_cost: float, num: int, den: int) -> int:
    """The boundary x of least cost: subsets of sets up to x, postings and list scans of the others."""
    def subsets(n: int, x: int) -> int:
        return sum(comb(n, c) for c in subset_sizes(n, x, num, den))

    def postings(n: int) -> float:
        return (n - least_overlap(n, num, den) + 1) * (1 + list_cost)

    def cost(x: int) -> float:
        small = sum(c * subsets(n, x) for n, c in sizes.items() if 0 < n <= x)
        large = sum(c * postings(n) for n, c in sizes.items() if den * n >= num * (x + 1))
        return small + large

    return min(range(0, SMALL_MOST + 1), key=cost)


_DOCS = "uid long, n long, s1 long, s2 long, head array<long>, cells binary"


def describe(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per document: set size, two hashes of the set, its first shingles and its cell counts."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, head, cells = [], [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                k = len(s)
                n.append(k)
                s1.append(int(s.sum(dtype=U).astype(np.int64)))
                s2.append(int(ts.seeded(s, 3).sum(dtype=U).astype(np.int64)))
                first = k if k <= SMALL_MOST else k - least_overlap(k, num, den) + 1
                head.append(ts.as_long(s[:first]))
                cells.append(cell_counts(s, cell_number(k)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(head, pa.list_(pa.int64())), pa.array(cells, pa.binary())],
                names=["uid", "n", "s1", "s2", "head", "cells"])
    return rows.select("uid", "text").mapInArrow(scan, _DOCS)


_POSTED = "key long, at long, uid long"


def postings(classes: DataFrame, x: int, num: int, den: int) -> DataFrame:
    """(key, at, uid): subsets of small sets, first shingles of large sets and of small ones that large ones may link with.

    ``at`` is the size and, for a first shingle, its place in the set's order (0 for a subset).
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offs, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy().view(np.uint64)
            keys, who, places = [], [], []
            for i, n in enumerate(sizes.tolist()):
                head = flat[offs[i]:offs[i + 1]]
                parts = []
                if n <= x:
                    parts += [(q, np.zeros(len(q), np.int64)) for q in (_subsets(head, c) for c in subset_sizes(n, x, num, den))]
                if den * n >= num * (x + 1):
                    first = head[:n - least_overlap(n, num, den) + 1]
                    parts.append((first, np.arange(len(first))))
                for q, place in parts:
                    keys.append(q)
                    places.append(place)
                    who.append(np.full(len(q), i))
            if keys:
                w = np.concatenate(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ts.as_long(np.concatenate(keys))), pa.array(sizes[w] * PLACE + np.concatenate(places)), pa.array(uids[w])],
                    names=["key", "at", "uid"])
    return classes.select("uid", "n", "head").mapInArrow(scan, _POSTED)


def places_admit(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes n and m may link whose first common shingle has places p and q.

    They share that one and at most all that follows it in either; linked sets share at
    least num / (num + den) of both sizes together.
    """
    return np.minimum(n - p, m - q) * (num + den) >= num * (n + m)


def has_partner(key: np.ndarray, at: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which postings, sorted by (key, at), meet a set in their list that size and place let link.

    Lists of up to ``PARTNERS`` postings are compared by places, longer ones by sizes: if any size
    in the list admits a link, the nearest one does.
    """
    n, p = at // PLACE, at % PLACE
    keep = np.zeros(len(key), dtype=bool)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    length = np.repeat(np.diff(edge), np.diff(edge))
    for d in range(1, PARTNERS):
        i = np.flatnonzero((key[d:] == key[:-d]) & (length[d:] <= PARTNERS))
        if not len(i):
            break
        i = i[(n[i + d] * num <= n[i] * den) & places_admit(n[i], p[i], n[i + d], p[i + d], num, den)]
        keep[i] = keep[i + d] = True
    i = np.flatnonzero((key[1:] == key[:-1]) & (length[1:] > PARTNERS) & (n[1:] * num <= n[:-1] * den))
    keep[i] = keep[i + 1] = True
    return keep


def shared(posted: DataFrame, num: int, den: int) -> DataFrame:
    """Postings that have a possible partner in their list, from postings sorted by key and size."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, parted in key_chunks(batches, 200_000):
            key = t.column("key").to_numpy()
            many = has_partner(key, t.column("at").to_numpy(), num, den)
            for k in parted:      # a list that is longer than a chunk
                many |= key == k
            yield from t.filter(pa.array(many)).combine_chunks().to_batches()
    return posted.mapInArrow(scan, _POSTED)


def _pairs_of_parts(rows: DataFrame, group: str, part: str, num: int, den: int) -> DataFrame:
    """(group, i, j, part): every two parts of a group, a part with itself too, whose sizes ``n`` admit a link."""
    spans = rows.groupBy(group, part).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    a, b = spans.alias("a"), spans.alias("b")
    meet = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{part}") <= F.col(f"b.{part}"))
                  & (F.col("b.lo") * num <= F.col("a.hi") * den))
    pairs = meet.select(F.col(f"a.{group}").alias(group), F.col(f"a.{part}").alias("i"), F.col(f"b.{part}").alias("j"))
    return pairs.select(group, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias(part))


def _by_size(rows: DataFrame, group: str, out: str, size: Column | None = None) -> DataFrame:
    """Rank, or running sum of ``size``, by set size within each group; equal sizes are spread by a hash of the id."""
    h = F.pmod(F.xxhash64("uid"), F.lit(256))
    return ranked(rows.withColumn("_h", h), [group], F.col("n") * 256 + F.col("_h"), [F.col("n"), F.col("_h"), F.col("uid")], out, size).drop("_h")


def banded(ws: Workspace, lists: DataFrame, num: int, den: int) -> DataFrame:
    """(key, at, uid, band): lists as they are (band -1), and every two bands of a long list under a key of their own."""
    size = F.least(F.lit(MOST_BAND), F.greatest(F.lit(BAND), F.ceil(F.col("c") / 16)))
    long = lists.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BAND).select("key", size.alias("_size"))
    if long.isEmpty():
        return lists.withColumn("band", F.lit(-1))
    long = small(long)
    rest = lists.join(long, "key", "left_anti").withColumn("band", F.lit(-1))
    hot = ws.save(lists.join(long, "key").withColumn("n", F.expr(f"at div {PLACE}L")), "hot")
    hot = ws.save(_by_size(hot, "key", "_rank").withColumn("band", F.expr("int(_rank div _size)")), "bands")
    sides = _pairs_of_parts(hot, "key", "band", num, den)
    met = hot.join(sides, ["key", "band"]).select(F.xxhash64("key", "i", "j").alias("key"), "at", "uid", "band")
    return rest.select("key", "at", "uid", "band").unionByName(met)


def list_chunks(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[tuple[pa.Table, int]]:
    """Whole lists, sorted by size; a list longer than a chunk goes on with the sets that later ones may link with.

    Yields a table and how many of its first rows were seen before.
    """
    held: list[pa.Table] = []
    rows = old = 0
    for batch in batches:
        for a in range(0, batch.num_rows, LIST_CHUNK):
            held.append(pa.Table.from_batches([batch.slice(a, LIST_CHUNK)]))
            rows += held[-1].num_rows
            if rows - old < LIST_CHUNK:
                continue
            t = pa.concat_tables(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield t.slice(0, cut), old
                held, rows, old = [t.slice(cut)], t.num_rows - cut, 0
            else:
                yield t, old
                n = t.column("at").to_numpy() // PLACE
                keep = int(np.searchsorted(n * den, n[-1] * num, "left"))
                held, rows, old = [t.slice(keep)], len(n) - keep, len(n) - keep
    if rows > old:
        yield pa.concat_tables(held), old


class Forest:
    """Union by label over 0..n-1; labels are the smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = sorted((int(self.label[a]), int(self.label[b])))
        if x != y:
            self.label[self.label == y] = x


class Summaries:
    """Cell counts of many sets, as one matrix for each number of cells."""

    def __init__(self, counts: pa.ChunkedArray):
        raw = [np.frombuffer(c, dtype=np.uint8) for c in counts.to_pylist()]
        self.cells = np.array([len(c) for c in raw], dtype=np.int64)
        self.at = np.zeros(len(raw), dtype=np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.cells).tolist():
            i = np.flatnonzero(self.cells == w)
            self.at[i] = np.arange(len(i))
            self.rows[w] = np.stack([raw[k] for k in i.tolist()])

    def near(self, sizes: np.ndarray, i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which of the other sets, none larger, the cell counts let link with set i."""
        apart = np.zeros(len(others), dtype=np.int64)
        mine = self.rows[int(self.cells[i])][self.at[i]]
        for w in np.unique(self.cells[others]).tolist():
            of = np.flatnonzero(self.cells[others] == w)
            theirs = self.rows[w][self.at[others[of]]].astype(np.int16)
            apart[of] = np.abs(theirs - folded(mine, w)).sum(axis=1)
        return others[may_link(apart, sizes[others] + sizes[i], num, den)]


def may_link(apart: np.ndarray, both: np.ndarray, num: int, den: int) -> np.ndarray:
    """|A - B| + |B - A| <= (1 - t) / (1 + t) * (|A| + |B|) for linked sets."""
    return apart * (den + num) <= (den - num) * both


def near(cells: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the other sets the cell counts let link with set i."""
    apart = np.abs(cells[others].astype(np.int16) - cells[i].astype(np.int16)).sum(axis=1)
    return others[may_link(apart, sizes[others] + sizes[i], num, den)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared members of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def list_edges(lists: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a spanning forest, for each list, of the pairs that sizes and cell counts let link."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, old in list_chunks(batches, num, den):
            yield from spanning(t, old)

    def spanning(t: pa.Table, old: int) -> Iterator[pa.RecordBatch]:
        key, uid, at = (t.column(c).to_numpy() for c in ("key", "uid", "at"))
        band = t.column("band").to_numpy()
        sizes, place = at // PLACE, at % PLACE
        cells = Summaries(t.column("cells"))
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        left, right = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            forest = Forest(b - a)
            two = b - a > 1 and bool((band[a:b] != band[a]).any())       # bands of one list: pairs inside either are another task's
            low = a + np.searchsorted(sizes[a:b] * den, sizes[a:b] * num, "left")
            for i in range(max(a + 1, old), b):
                others = np.arange(int(low[i - a]), i)
                others = others[places_admit(sizes[i], place[i], sizes[others], place[others], num, den)]
                if two:
                    others = others[band[others] != band[i]]
                # the nearest sizes first: whoever is connected through them need not be compared
                step = 32
                while len(others):
                    label = forest.label
                    some, others = others[-step:], others[:-step]
                    for j in cells.near(sizes, i, some, num, den).tolist():
                        if label[j - a] != label[i - a]:
                            forest.join(i - a, j - a)
                            left.append(uid[j])
                            right.append(uid[i])
                    others = others[label[others - a] != label[i - a]]
                    step = 1024
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return lists.mapInArrow(scan, "a long, b long")


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(uid, root): the smallest member of each vertex's component, by large-star and small-star rounds."""
    def pairs(df: DataFrame) -> DataFrame:   # (u, v), u > v
        return df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()

    now = ws.save(pairs(edges), "star")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(least, "u").filter("v > u")
                 .select(F.col("v").alias("a"), F.least("u", "m").alias("b")))
        large = pairs(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = ws.save(pairs(small), "star")
        ws.drop(now)
        now = after
    roots = now.select(F.col("v").alias("uid")).distinct()
    return now.select(F.col("u").alias("uid"), F.col("v").alias("root")).unionByName(
        roots.select("uid", F.col("uid").alias("root")))


def verified(rows: DataFrame, placed: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b, block): exact links that span the groups inside each pair of tiles."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tables(batches, "pair"):
            uid, tile = t.column("uid").to_numpy(), t.column("tile").to_numpy()
            sets = shingle_sets(t.column("text"), width)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            order = np.lexsort((uid, sizes))
            uid, tile, sizes = uid[order], tile[order], sizes[order]
            sets = [sets[i] for i in order.tolist()]
            cells = np.stack([cell_counts(s, CELLS) for s in sets])
            both = len(np.unique(tile)) > 1
            forest = Forest(len(uid))
            low = np.searchsorted(sizes * den, sizes * num, "left")
            lists: dict[int, list[int]] = {}      # inverted lists of first shingles, inside the tiles
            left, right = [], []
            for i in range(len(uid)):
                met: list[int] = []
                n = int(sizes[i])
                for k in sets[i][:n - least_overlap(n, num, den) + 1].tolist():
                    have = lists.setdefault(k, [])
                    met += have
                    have.append(i)
                if not met:
                    continue
                others = np.unique(np.array(met))
                others = others[(others >= low[i]) & (forest.label[others] != forest.label[i])]
                if both:
                    others = others[tile[others] != tile[i]]
                for j in near(cells, sizes, i, others, num, den).tolist():
                    if forest.label[i] == forest.label[j]:
                        continue
                    common = overlap(sets[i], sets[j])
                    if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                        forest.join(i, j)
                        left.append(uid[i])
                        right.append(uid[j])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    texts = rows.select("uid", "text").join(placed, "uid")
    dealt = texts.repartition(partitions(rows.sparkSession), "pair").sortWithinPartitions("pair")
    return dealt.select("pair", "uid", "tile", "text").mapInArrow(scan, "a long, b long")


def _tables(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows of one value of a column at a time, from sorted batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for a, b in zip(cut[:-1], cut[1:]):
            if held and v[a] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = v[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """(uid, tile, pair): every pair of tiles of a block whose sizes admit a link."""
    cut = (_by_size(members, "block", "_run", F.col("n"))
           .withColumn("tile", F.expr(f"int(_run div {TILE_SHINGLES}L)")).drop("_run"))
    sides = _pairs_of_parts(cut, "block", "tile", num, den)
    return (cut.join(sides, ["block", "tile"])
            .select("uid", "tile", F.xxhash64("block", "i", "j").alias("pair")))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                   num: int = 4, den: int = 5) -> DataFrame:
    """Every document: (_id, n_shingles, component_id), by links of Jaccard similarity num/den or more."""
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    rows, rekeyed = identified(ws, docs, id_col, {"text": F.col(text_col)})
    known = ws.save(describe(rows, width, num, den), "sets")
    keys = known.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("uid").alias("class"))
    of_class = ws.save(known.select("uid", "n", "s1", "s2").join(keys, ["n", "s1", "s2"], "left")
                       .select("uid", "n", F.coalesce("class", "uid").alias("class")), "classes")
    own = of_class.filter("uid = class and n > 0").select("uid")
    classes = ws.save(known.select("uid", "n", "head", "cells").join(own, "uid", "left_semi"), "classes")
    ws.drop(known)

    few = classes.filter(F.col("n") <= SMALL_MOST + 1)
    sizes = {r.n: r.c for r in few.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    heads = few.select(F.explode("head").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    met = heads.agg(F.sum(F.col("c") * F.col("c")), F.sum("c")).first()
    x = boundary(sizes, (met[0] or 0) / max(1, met[1] or 0), num, den)

    n_parts = partitions(spark)
    posted = postings(classes, x, num, den).repartition(n_parts, "key").sortWithinPartitions("key", "at")
    lists = ws.save(shared(posted, num, den), "lists")
    lists = banded(ws, lists, num, den).join(classes.select("uid", "cells"), "uid").select("key", "at", "uid", "band", "cells")
    lists = lists.repartition(n_parts, "key").sortWithinPartitions("key", "at", "uid")
    blocks = ws.save(components(ws, list_edges(lists, num, den)), "blocks")
    members = blocks.join(classes.select("uid", "n"), "uid").select("uid", "n", F.col("root").alias("block"))
    links = verified(rows, ws.save(tiles(members, num, den), "tiles"), width, num, den)
    groups = ws.save(components(ws, links), "groups")

    g = groups.select(F.col("uid").alias("class"), "root")
    out = of_class.join(g, "class", "left").select("uid", F.col("n").alias("n_shingles"),
                                                   F.coalesce("root", "class").alias("root"))
    if not rekeyed:
        return with_ids(out.withColumnRenamed("root", "component_id"), rows, rekeyed)
    names = rows.select(F.col("uid").alias("root"), F.col("_id").alias("component_id"))
    return with_ids(out.join(names, "root").drop("root"), rows, rekeyed)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: 4-word shingles, similarity of 0.85 or more."""
    out = jaccard_groups(read_table(spark, sf_dir, "documents"), width=4, num=85, den=100)
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")
