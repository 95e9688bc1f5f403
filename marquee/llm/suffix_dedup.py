"""Suffix-array deduplication of bytes: sampled splitters, local multikey quicksort, boundary comparison.

A 100-byte string that starts somewhere is the head of the suffix that starts there. All
suffixes of a corpus would be a row per byte, so they are sampled consistently: every
100-byte window is owned by its anchor, the 24-byte gram of least hash inside it. Equal
windows own equal anchors at equal places, so it is enough to sort, among the suffixes,
those that share an anchor. Consecutive windows with one anchor travel as one run.

1. Splitters: the runs of a bounded sample of documents, sorted by (leading gram's
   fingerprint, document), give splitters; they cut the runs of the whole corpus into
   as many buckets as there are partitions. A frequent gram falls on several splitters
   and is spread over several buckets. (The sample serves the balance only.)
2. Buckets sort their runs. Of runs with the same leading gram and the same bytes, the
   first keeps its bytes and the others lose all of theirs. Where runs share the gram but
   differ in bytes, their first occurrences go on to step 4.
3. Boundaries: a gram that a splitter names may lie in several buckets. Each of them
   sends its local firsts, and firsts of equal runs are compared across the buckets.
4. The bytes of the runs that go on are fetched, dealt by the same splitters (only a heavy
   gram is cut by them now, as its distinct runs are far fewer than its runs), and in each
   bucket their windows are sorted by multikey quicksort (eight bytes a step; runs that are
   equal to the end are set aside at once). Among equal windows the earliest start stays. For
   grams at a boundary the local firsts are compared across buckets by their window hashes.
5. Spans are joined to the texts, merged and cut.

A bucket is worked through in chunks of bounded size; a gram with more runs than a
chunk is treated as if a splitter had cut it, so no list grows with a group of copies.

Equality of whole runs, and of windows across a boundary, rests on 128 hash bits;
windows inside a bucket are compared byte by byte.

Defined cases: null text is empty; texts of fewer than 100 bytes lose nothing; rows that
repeat an id are documents of their own, ordered by the hash of their text, as are rows with
null ids, which come first; an empty table gives an empty result; extra columns are not
read; very long texts are scanned in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .common import Workspace, identified, partitions, read_table, with_ids

WINDOW = 100
GRAM = 24
SAMPLE_DOCS = 2_000       # documents whose runs give the splitters
SAMPLE_RUNS = 20_000      # and the most runs of them that the driver sorts
CHUNK_RUNS = 400_000      # runs that a bucket looks at together in step 2
CHUNK_TEXTS = 10_000      # runs whose windows are sorted together in step 4
HEAVY_RUNS = 100_000      # estimated runs from which step 4 deals a gram to several buckets

_RUNS = "bucket int, key long, full long, uid long, at long"
_SPAN, _REP, _EDGE = 0, 1, 2


def runs(rows: DataFrame, window: int, gram: int, split: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Runs of windows of every text: (bucket, key, full, uid, at = first start * 256 + windows)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            data, offs = ts.text_bytes(batch.column(1))
            for i, j in ts.doc_groups(offs):
                parts, who = [], []
                for k in range(i, j):
                    if offs[k + 1] - offs[k] >= window:
                        parts.append(ts.anchored_runs(ts._BYTE_TABLE[data[offs[k]:offs[k + 1]]], window, gram))
                        who.append(np.full(len(parts[-1][0]), uids[k]))
                if parts:
                    key, full, pos, n = (np.concatenate(x) for x in zip(*parts))
                    key, uid = ts.as_long(key), np.concatenate(who)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(split(key, uid)), pa.array(key), pa.array(ts.as_long(full)), pa.array(uid),
                         pa.array(pos * 256 + n)], names=["bucket", "key", "full", "uid", "at"])
    assert window - gram < 256
    return rows.select("uid", "text").mapInArrow(scan, _RUNS)


def splitters(rows: DataFrame, buckets: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, uid) pairs that cut a bounded sample of runs into equal parts, and the keys estimated to be heavy."""
    n = rows.count()
    one_in = max(1, n // SAMPLE_DOCS)
    some = rows.filter(F.pmod(F.xxhash64("uid"), F.lit(one_in)) == 0)
    sample = runs(some, window, gram, lambda key, uid: np.zeros(len(key), np.int32)).select("key", "uid", "at")
    # the sampled documents are few, but may be long: a hash of the run's place thins their runs
    thin = max(1, -(-sample.count() // SAMPLE_RUNS))
    got = sample.filter(F.pmod(F.xxhash64("key", "uid", "at"), F.lit(thin)) == 0).limit(2 * SAMPLE_RUNS).collect()
    pairs = sorted((r.key, r.uid) for r in got)
    cuts = [pairs[len(pairs) * i // buckets] for i in range(1, buckets)] if pairs else []
    keys, times = np.unique(np.array([k for k, _ in pairs], dtype=np.int64), return_counts=True)
    heavy = keys[times * one_in * thin >= HEAVY_RUNS]
    return np.array([k for k, _ in cuts], dtype=np.int64), np.array([u for _, u in cuts], dtype=np.int64), heavy


def splitting(cut_key: np.ndarray, cut_uid: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Bucket of each (key, uid) under the splitters."""
    return _splitting(cut_key, cut_uid, None)


def splitting_heavy(cut_key: np.ndarray, cut_uid: np.ndarray, heavy: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The same, but only heavy keys are dealt to several buckets; the others stay whole."""
    return _splitting(cut_key, cut_uid, heavy)


def _splitting(cut_key: np.ndarray, cut_uid: np.ndarray, only: np.ndarray | None):
    def split(key: np.ndarray, uid: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(cut_key, key, "left"), np.searchsorted(cut_key, key, "right")
        out = lo.copy()
        for i in np.flatnonzero((lo < hi) if only is None else (lo < hi) & np.isin(key, only)):
            out[i] = lo[i] + np.searchsorted(cut_uid[lo[i]:hi[i]], uid[i], "right")
        return out.astype(np.int32)
    return split


def key_chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, set[int]]]:
    """Sorted rows in chunks of whole keys; a key of more than ``limit`` rows comes in parts and is named as such."""
    held: list[pa.Table] = []
    rows, parted = 0, set()
    for batch in batches:
        for a in range(0, batch.num_rows, limit):
            held.append(pa.Table.from_batches([batch.slice(a, limit)]))
            rows += held[-1].num_rows
            if rows < limit:
                continue
            t = pa.concat_tables(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut == 0:
                parted, cut = {int(key[-1])}, len(key)
            yield t.slice(0, cut), parted
            held, rows = [t.slice(cut)], t.num_rows - cut
    if rows:
        yield pa.concat_tables(held), parted


def _boundary(key: np.ndarray, cut_key: np.ndarray, parted: set[int]) -> np.ndarray:
    """Which rows' keys may have rows elsewhere."""
    out = np.isin(key, cut_key)
    for k in parted:
        out |= key == k
    return out


def sorted_runs(found: DataFrame, buckets: int, cut_key: np.ndarray, window: int) -> DataFrame:
    """Steps 2 and 3a: repeats of whole runs, firsts that go on, local firsts at boundaries."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, parted in key_chunks(batches, CHUNK_RUNS):
            key, full, uid, at = (t.column(c).to_numpy() for c in ("key", "full", "uid", "at"))
            new_key = np.concatenate(([True], key[1:] != key[:-1]))
            first = new_key | np.concatenate(([True], full[1:] != full[:-1]))
            kid = np.cumsum(new_key) - 1
            several = (np.bincount(kid, first) >= 2)[kid]
            edge = _boundary(key, cut_key, parted)
            head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            again = ~first & ((uid != uid[head]) | (at != at[head]))
            kind = np.where(again, _SPAN, np.where(first & edge, _EDGE, np.where(first & several, _REP, -1)))
            take = np.flatnonzero(kind >= 0)
            if len(take):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[take]) for x in (kind.astype(np.int8), key, full, uid, at)],
                    names=["kind", "key", "full", "uid", "at"])

    dealt = found.repartitionById(buckets, "bucket").sortWithinPartitions("key", "full", "uid", "at")
    return dealt.select("key", "full", "uid", "at").mapInArrow(scan, "kind byte, key long, full long, uid long, at long")


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of 64-bit words, and where runs of equal rows begin in it.

    Stable. Step d sorts, inside every run that is still mixed, by word d; runs whose rows
    agree in all further words are set aside.
    """
    n, width = words.shape
    order = np.arange(n)
    begins = np.zeros(n, dtype=bool)
    if n:
        begins[0] = True
    for d in range(width):
        run = np.cumsum(begins) - 1
        head = np.flatnonzero(begins)
        rest = words[order, d:] != words[order[head[run]], d:]
        mixed = np.bincount(run, rest.any(axis=1)) > 0
        live = np.flatnonzero(mixed[run])
        if not len(live):
            break
        o = order[live]
        w, r = words[o, d], run[live]
        by = np.lexsort((w, r))
        order[live] = o[by]
        w, r = w[by], r[by]
        begins[live[1:][(r[1:] == r[:-1]) & (w[1:] != w[:-1])]] = True
    return order, begins


def _window_words(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Matrix of the windows at ``starts``, eight bytes a word, zero-filled at the end."""
    width = -(-window // 8)
    out = np.zeros((len(starts), width * 8), dtype=np.uint8)
    out[:, :window] = np.lib.stride_tricks.sliding_window_view(data, window)[starts]
    return out.view(">u8").astype(np.uint64)


def fetch(dealt: DataFrame, wanted: DataFrame, window: int, split: Callable) -> DataFrame:
    """Bytes of the wanted runs (uid, key, at), with their bucket."""
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("key", "at")).alias("want"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            if not batch.num_rows:
                continue
            uids, want = batch.column(0).to_numpy(), batch.column(2)
            data, offs = ts.text_bytes(batch.column(1))
            lo, flat = want.offsets.to_numpy(), want.values
            key, at = flat.field(0).to_numpy()[lo[0]:lo[-1]], flat.field(1).to_numpy()[lo[0]:lo[-1]]
            row = np.repeat(np.arange(batch.num_rows), np.diff(lo))
            begin = offs[row] + at // 256
            end = begin + at % 256 + window - 1
            uid = uids[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(split(key, uid)), pa.array(key), pa.array(uid), pa.array(at),
                 pa.array([data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())], pa.binary())],
                names=["bucket", "key", "uid", "at", "part"])

    return (dealt.join(lists, "uid", "left").select("uid", "text", "want")
            .mapInArrow(scan, "bucket int, key long, uid long, at long, part binary"))


def sorted_windows(parts: DataFrame, buckets: int, cut_key: np.ndarray, window: int) -> DataFrame:
    """Step 4: (h1, h2, uid, start, len, sure): spans of repeated windows, and firsts at boundaries (not sure)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, parted in key_chunks(batches, CHUNK_TEXTS):
            key, uid, at = (t.column(c).to_numpy() for c in ("key", "uid", "at"))
            data, offs = ts.text_bytes(t.column("part"))
            n = at % 256
            row = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            words = _window_words(data, offs[row] + inner, window)
            # rows come sorted by (key, uid, start): a stable sort leaves the earliest first in each run
            order, begins = multikey_sort(np.column_stack((key[row].view(np.uint64), words)))
            first = np.zeros(len(row), dtype=bool)
            first[order[begins]] = True
            starts = at[row] // 256 + inner
            again = np.flatnonzero(~first)
            # neighbouring repeated windows of one run become one span
            new = np.concatenate(([True], (again[1:] != again[:-1] + 1) | (row[again[1:]] != row[again[:-1]])))[:len(again)]
            head = again[new]
            count = np.diff(np.concatenate((np.flatnonzero(new), [len(again)])))
            if len(head):
                yield _span_batch(uid[row[head]], starts[head], count + window - 1)
            edge = np.flatnonzero(first & _boundary(key, cut_key, parted)[row])
            if len(edge):
                acc = ts.prefix_hash(ts._BYTE_TABLE[data])
                acc2 = ts.prefix_hash(ts.seeded(ts._BYTE_TABLE[data], 7))
                a = offs[row[edge]] + inner[edge]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ts.as_long(ts.range_hash(acc, a, a + window))),
                     pa.array(ts.as_long(ts.range_hash(acc2, a, a + window))),
                     pa.array(uid[row[edge]]), pa.array(starts[edge]), pa.array(np.full(len(edge), window, np.int64)),
                     pa.array(np.zeros(len(edge), dtype=bool))], names=_WINDOW_NAMES)

    dealt = parts.repartitionById(buckets, "bucket").sortWithinPartitions("key", "uid", "at")
    return dealt.select("key", "uid", "at", "part").mapInArrow(
        scan, "h1 long, h2 long, uid long, start long, len long, sure boolean")


_WINDOW_NAMES = ["h1", "h2", "uid", "start", "len", "sure"]


def _span_batch(uid: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(uid), pa.array(start), pa.array(uid), pa.array(start), pa.array(length),
         pa.array(np.ones(len(uid), dtype=bool))], names=_WINDOW_NAMES)


def repeated_spans(ws: Workspace, rows: DataFrame, dealt: DataFrame, window: int, gram: int) -> DataFrame:
    """(uid, start, len): bytes covered by a window that also starts earlier."""
    buckets = partitions(ws.spark)
    cut_key, cut_uid, heavy = splitters(rows, buckets, window, gram)
    split, split_heavy = splitting(cut_key, cut_uid), splitting_heavy(cut_key, cut_uid, heavy)
    cut_key = np.unique(cut_key)
    seen = ws.save(sorted_runs(runs(rows, window, gram, split), buckets, cut_key, window), "runs")
    start, length = F.expr("at div 256"), F.expr(f"at % 256 + {window - 1}")
    whole = seen.filter(F.col("kind") == _SPAN).select("uid", start.alias("start"), length.alias("len"))
    # step 3: firsts of equal runs at boundaries, compared across buckets
    same = Window.partitionBy("key", "full").orderBy("uid", "at")
    edges = ws.save(seen.filter(F.col("kind") == _EDGE).withColumn("_r", F.rank().over(same)), "edges")
    later = edges.filter("_r > 1").select("uid", start.alias("start"), length.alias("len"))
    wanted = (seen.filter(F.col("kind") == _REP).select("uid", "key", "at")
              .unionByName(edges.filter("_r = 1").select("uid", "key", "at")))
    found = sorted_windows(fetch(dealt, wanted, window, split_heavy), buckets, heavy, window)
    # sure rows are alone in their group by design; the others stay only where they are first
    across = Window.partitionBy("h1", "h2").orderBy("uid", "start")
    branched = (found.withColumn("_r", F.rank().over(across)).filter("sure or _r > 1").select("uid", "start", "len"))
    return whole.unionByName(later).unionByName(branched)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 gram: int = GRAM, texts: bool = True) -> DataFrame:
    """Every document: (_id, n_bytes, n_removed, spans of removed bytes, kept_sha256[, kept bytes])."""
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix")
    rows, rekeyed = identified(ws, docs, id_col, {"text": F.col(text_col)})
    # one dealing of the texts by document serves both joins (Spark reuses the exchange)
    dealt = rows.select("uid", "text").repartition(partitions(spark), "uid")
    spans = repeated_spans(ws, rows, dealt, window, gram)
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "len")).alias("want"))
    schema = ("uid long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"
              + (", kept binary" if texts else ""))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = ts.text_bytes(batch.column(1))
            lo, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values
            start, length = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            removed, ranges, shas, kept = [], [], [], []
            for row in range(batch.num_rows):
                text = data[offs[row]:offs[row + 1]]
                s, e = ts.merge_spans(start[lo[row]:lo[row + 1]], length[lo[row]:lo[row + 1]])
                inner = np.concatenate(([0], e)), np.concatenate((s, [len(text)]))
                left = b"".join([text[x:y].tobytes() for x, y in zip(inner[0].tolist(), inner[1].tolist())])
                removed.append(len(text) - len(left))
                ranges.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
                shas.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(left)
            cols = [batch.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()),
                    pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if texts else []), names=names)

    names = ["uid", "n_bytes", "n_removed", "spans", "kept_sha256"] + (["kept"] if texts else [])
    return with_ids(dealt.join(spans, "uid", "left").select("uid", "text", "want").mapInArrow(cut, schema), rows, rekeyed)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the bytes of 100-byte strings that also start earlier."""
    out = suffix_dedup(read_table(spark, sf_dir, "documents"), texts=False)
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed",
                      F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
