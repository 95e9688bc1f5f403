"""Substring deduplication on a De Bruijn graph of word windows.

An edge of the graph is a window of 50 consecutive words (its nodes are the 49-word
ends). Writing one row per window would multiply the corpus, so edges come compacted
from the start: consecutive windows that share their minimizer (the 10-word gram of least
hash inside the window) form one nonbranching piece, known by its minimizer (``key``)
and by a hash of all its words (``full``). Equal windows have equal minimizers at equal
places, so all occurrences of a window lie in pieces of one key.

1. Pieces of all documents are grouped by (key, full): the first document that holds a
   piece is its source. Where a piece occurs again, all its windows are repeats.
2. A key with several different pieces is a branching place of the graph. Only there are
   windows written out, once per distinct piece, and brought together by two 64-bit window
   hashes with the first document that holds them. The verdict on a piece's windows then goes
   to every place of that piece in its source, where it may stand again or in periods.
3. Compaction: repeated pieces that follow one another in a document are joined through
   the graph's adjacency: where a piece has one successor among all its occurrences and
   that successor one predecessor, they belong to one nonbranching path, and rows of a
   path merge into one long span. Spans carry source coordinates; a span is verified by
   coordinates: it counts only where its source document is smaller than its own.
4. Spans cover the words that are removed.

Pieces are grouped with partial aggregation and joined by key; a passage that a third of
all documents share is one row per task in the groups, and joins on it are split by Spark.
Nothing is collected, and no list grows beyond one document's spans.

Equality of windows rests on 128 hash bits (two independent 64-bit hashes).

Defined cases: null text has no words; documents of fewer than 50 words lose nothing;
rows that repeat an id are documents of their own, ordered by the hash of their text, as
are rows with null ids, which come first; an empty table gives an empty result; extra
columns are not read; very long texts are scanned in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .common import Workspace, identified, partitions, read_table, with_ids

WINDOW = 50
GRAM = 10

_PIECES = "key long, full long, uid long, pos int, n int, times int"
_WINDOWS = "h1 long, h2 long, uid long, key long, full long, off int"


def _texts(batch: pa.RecordBatch, text: str = "text"):
    """(row, word starts, word ends, word hashes, bytes) of each text in a batch."""
    data, offs = ts.text_bytes(batch.column(batch.schema.get_field_index(text)))
    for i, j in ts.doc_groups(offs):
        sub, bounds = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        start, end, h = ts.words(sub, bounds)
        at = np.searchsorted(start, bounds)
        for k in range(j - i):
            a, b = at[k], at[k + 1]
            yield i + k, start[a:b], end[a:b], h[a:b], sub


def _folded(key: np.ndarray, full: np.ndarray, pos: np.ndarray, n: np.ndarray):
    """Equal pieces in a row as one, with their number."""
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (full[1:] != full[:-1]) | (n[1:] != n[:-1])))
    i = np.flatnonzero(new)
    return key[i], full[i], pos[i], n[i], np.diff(np.append(i, len(key)))


def pieces(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Compacted edges of every document: (key, full, uid, pos, n windows from pos, times).

    A piece that follows itself (periodic text) is one row; ``times`` says how often it stands there.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            parts, who = [], []
            for row, _, _, h, _ in _texts(batch):
                if len(h) >= window:
                    parts.append(_folded(*ts.anchored_runs(h, window, gram)))
                    who.append(np.full(len(parts[-1][0]), uids[row]))
            if parts:
                key, full, pos, n, times = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ts.as_long(key)), pa.array(ts.as_long(full)), pa.array(np.concatenate(who)),
                     pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(times.astype(np.int32))],
                    names=["key", "full", "uid", "pos", "n", "times"])
    return rows.select("uid", "text").mapInArrow(scan, _PIECES)


def branch_windows(dealt: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of the wanted pieces (key, full, uid, pos, n): two hashes each, and their place in the piece."""
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("pos", "n", "key", "full")).alias("want"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(2)
            batch = batch.filter(want.is_valid())
            if not batch.num_rows:
                continue
            uids, want = batch.column(0).to_numpy(), batch.column(2)
            offs, flat = want.offsets.to_numpy(), want.values
            fields = [flat.field(k).to_numpy() for k in range(4)]
            out: list[list] = [[], [], [], [], [], []]
            for row, _, _, h, _ in _texts(batch):
                for p, m, key, full in zip(*(x[offs[row]:offs[row + 1]].tolist() for x in fields)):
                    a, b = ts.window_hashes(h[p:p + m + window - 1], window)
                    for to, x in zip(out, (a, b, np.full(m, uids[row]), np.full(m, key), np.full(m, full), np.arange(m, dtype=np.int32))):
                        to.append(x)
            h1, h2, *rest = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ts.as_long(h1), ts.as_long(h2), *rest)],
                                             names=["h1", "h2", "uid", "key", "full", "off"])

    return dealt.join(lists, "uid", "left").select("uid", "text", "want").mapInArrow(scan, _WINDOWS)


def compact(repeats: DataFrame) -> DataFrame:
    """Merge pieces that follow one another on one nonbranching path: (uid, pos, n, src)."""
    in_doc = Window.partitionBy("uid").orderBy("pos")
    follows = F.lead("pos").over(in_doc) == F.col("pos") + F.col("n")
    steps = repeats.withColumn("_next", F.when(follows, F.lead("piece").over(in_doc)))
    steps = steps.withColumn("_joined", F.lag("_next").over(in_doc).isNotNull())
    pairs = steps.filter("_next is not null").groupBy(F.col("piece").alias("_u"), F.col("_next").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    out = pairs.groupBy("_u").agg(F.count(F.lit(1)).alias("_out"), F.min("_v").alias("_v")).filter("_out = 1")
    into = pairs.groupBy("_v").agg(F.count(F.lit(1)).alias("_in")).filter("_in = 1").select("_v")
    unbranched = out.join(into, "_v").select(F.col("_v").alias("piece"), F.lit(True).alias("_path"))
    marked = steps.join(unbranched, "piece", "left")
    starts = (~F.col("_joined")) | F.col("_path").isNull()
    path = F.sum(starts.cast("int")).over(in_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (marked.withColumn("_p", path).groupBy("uid", "_p")
            .agg(F.min("pos").alias("pos"), F.sum("n").alias("n"), F.max("src").alias("src")).drop("_p"))


def repeated_spans(ws: Workspace, rows: DataFrame, dealt: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(uid, pos, n): runs of n windows from word ``pos`` that also start in a smaller document."""
    found = ws.save(pieces(rows, window, gram), "pieces")
    groups = found.groupBy("key", "full").agg(
        F.min(F.struct("uid", "pos", "n")).alias("src"), F.max("uid").alias("last"))
    groups = ws.save(groups.select("key", "full", "src.uid", "src.pos", "src.n", "last"), "groups")
    again = groups.filter("uid < last").select("key", "full", F.col("uid").alias("src"))
    repeats = ws.save(found.join(again, ["key", "full"]).filter("src < uid")
                      .select(F.xxhash64("key", "full").alias("piece"), "uid", "pos", (F.col("n") * F.col("times").cast("long")).alias("n"),
                              "src"), "repeats")
    paths = ws.save(compact(repeats), "paths")
    ws.drop(repeats)
    # branching places: several pieces of one key, held by different documents first
    several = (groups.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("uid").alias("_a"), F.max("uid").alias("_b"))
               .filter("_n > 1 and _a < _b").select("key"))
    wanted = ws.save(groups.join(several, "key", "left_semi").select("key", "full", "uid", "pos", "n"), "wanted")
    ws.drop(groups)
    same = Window.partitionBy("h1", "h2").orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = (branch_windows(dealt, wanted, window).withColumn("src", F.first("uid").over(same)).filter("src < uid")
            .groupBy("key", "full", "uid").agg(F.collect_set("off").alias("offs")))
    # a piece is one minimizer's windows, so its list is short; a source may hold the piece at many places
    places = found.join(gone, ["key", "full", "uid"])
    whole = places.filter("size(offs) = n").select("uid", "pos", (F.col("n") * F.col("times").cast("long")).alias("n"))
    parts = (places.filter("size(offs) < n").withColumn("_period", F.explode(F.expr("sequence(0, times - 1)")))
             .select("uid", (F.col("pos") + F.col("_period") * F.col("n")).alias("_at"), F.explode("offs").alias("_off"))
             .select("uid", (F.col("_at") + F.col("_off")).alias("pos"), F.lit(1).cast("long").alias("n")))
    return paths.filter("src < uid").select("uid", "pos", "n").unionByName(whole).unionByName(parts)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    gram: int = GRAM, texts: bool = True) -> DataFrame:
    """Every document: (_id, n_words, n_removed, spans of removed words, kept_sha256[, kept text]).

    ``spans`` lists (start, end) word ranges that are removed. With ``texts`` the kept words,
    joined by one space, come along as ``kept``.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "substring")
    rows, rekeyed = identified(ws, docs, id_col, {"text": F.col(text_col)})
    # one dealing of the texts by document serves both joins (Spark reuses the exchange)
    dealt = rows.select("uid", "text").repartition(partitions(spark), "uid")
    spans = repeated_spans(ws, rows, dealt, window, gram)
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("pos", "n")).alias("want"))
    schema = ("uid long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string"
              + (", kept string" if texts else ""))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values
            pos, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            total, removed, ranges, shas, kept = [], [], [], [], []
            for row, start, end, _, data in _texts(batch):
                a, b = offs[row], offs[row + 1]
                s, e = ts.merge_spans(pos[a:b].astype(np.int64), n[a:b] + (window - 1))
                keep = np.ones(len(start), dtype=bool)
                for x, y in zip(s.tolist(), e.tolist()):
                    keep[x:y] = False
                base = int(start[0]) if len(start) else 0
                raw = data[base:end[-1]].tobytes() if len(start) else b""
                left = b" ".join([raw[x:y] for x, y in zip((start[keep] - base).tolist(), (end[keep] - base).tolist())])
                total.append(len(start))
                removed.append(len(start) - int(keep.sum()))
                ranges.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
                shas.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(left.decode("utf-8", "replace"))
            cols = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.string())] if texts else []), names=names)

    names = ["uid", "n_words", "n_removed", "spans", "kept_sha256"] + (["kept"] if texts else [])
    return with_ids(dealt.join(spans, "uid", "left").select("uid", "text", "want").mapInArrow(cut, schema), rows, rekeyed)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the words of windows that start in a smaller document."""
    out = substring_dedup(read_table(spark, sf_dir, "documents"), texts=False)
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
