"""Exact deduplication against a minimal perfect hash over historical distinct digests.

The history is a set of distinct text digests (SHA-256), each with the locator of its
winner. It is split into buckets by digest; in each bucket a cascade of bit arrays
places every digest alone in some array at some level, and its rank among all set bits
is its slot: n digests, n slots, no gaps. A slot holds the full digest and the winner's
locator, so a lookup ends in a comparison of all 32 bytes and a digest that is not in
the history is never taken for one that is.

New documents are first grouped by digest (partial aggregation: a group of copies of any
size becomes one row per task). Their digests look up the slots of their bucket: members
are repeats of the history and join its group; nonmembers form groups among themselves.
Documents then get their group's decision by a join on the digest, which Spark splits
where one digest has many rows.

Buckets hold about ``BUCKET`` distinct digests each, whatever the size of the corpus, as
digests spread evenly; no bucket grows with a group of copies.

Defined cases: null counts as empty text; rows of equal text, the empty one included,
form one group; of them the largest id wins (a null id counts as smaller than any other);
rows that repeat the winning id and text are ``kept`` only once (one of the repeated rows,
which are equal in all that is returned); ids that are no whole numbers (strings, say) win
in their own order; a very long text counts whole, by its digest; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, identified, partitions, read_table
from .textscan import U, seeded

BUCKET = 50_000
GAMMA = 2          # bits of a level for each key that is left
_EMPTY = np.zeros(0, dtype=U)


def _halves(digests: list[bytes]) -> np.ndarray:
    """First 16 bytes of each digest as two 64-bit words (they are uniform already)."""
    if not digests:
        return np.zeros((0, 2), dtype=U)
    return np.frombuffer(b"".join(d[:16] for d in digests), dtype=">u8").astype(U).reshape(-1, 2)


def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (seeded(keys[:, 0] ^ seeded(keys[:, 1], 1000 + level), level) % U(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of a minimal perfect hash: at each, keys alone in their cell set its bit, the others go on."""
    levels, left = [], keys
    while len(left):
        size = max(8, GAMMA * len(left))
        cell = _cell(left, len(levels), size)
        bits = np.bincount(cell, minlength=size) == 1
        levels.append(bits)
        left = left[~bits[cell]]
    return levels


def slot_of(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 where no level has it (some keys outside the set get a slot, too)."""
    out = np.full(len(keys), -1, dtype=np.int64)
    todo, before = np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        if not len(todo):
            break
        cell = _cell(keys[todo], level, len(bits))
        rank = np.cumsum(bits) - 1
        hit = bits[cell]
        out[todo[hit]] = before + rank[cell[hit]]
        todo = todo[~hit]
        before += int(bits.sum())
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, digest binary) of every row; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _bucket(n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(n)).cast("int")


def winners(rows: DataFrame) -> DataFrame:
    """(digest, winner, copies): one row per distinct digest; the largest id wins."""
    return rows.groupBy("digest").agg(F.max("_id").alias("winner"), F.count(F.lit(1)).alias("copies"))


_SLOTS = "bucket int, slot int, digest binary, winner long, copies long"
_LEVELS = "bucket int, level int, bits binary, n_bits int"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole buckets from batches that are sorted by bucket."""
    parts: list[pa.Table] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if current is not None and ids[a] != current:
                yield int(current), pa.concat_tables(parts)
                parts = []
            current = ids[a]
            parts.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if parts:
        yield int(current), pa.concat_tables(parts)


def build_history(ws: Workspace, groups: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Slots and levels of the minimal perfect hash over distinct digests, as written tables."""
    buckets = max(1, -(-groups.count() // BUCKET))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, t in _by_bucket(batches):
            d = t.column("digest").to_pylist()
            keys = _halves(d)
            levels = build_mph(keys)
            slots = slot_of(levels, keys)
            n = len(d)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, bucket, np.int32)), pa.array(slots.astype(np.int32)),
                pa.array(d, pa.binary()), t.column("winner").combine_chunks(), t.column("copies").combine_chunks(),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], names=names)
            k = len(levels)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(k, bucket, np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
                pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.arange(k, dtype=np.int32)),
                pa.array([np.packbits(x).tobytes() for x in levels], pa.binary()),
                pa.array([len(x) for x in levels], pa.int32())], names=names)

    names = ["bucket", "slot", "digest", "winner", "copies", "level", "bits", "n_bits"]
    rows = (groups.select(_bucket(buckets).alias("bucket"), "digest", "winner", "copies")
            .repartition(partitions(ws.spark), "bucket").sortWithinPartitions("bucket"))
    both = ws.save(rows.mapInArrow(place, _SLOTS + ", level int, bits binary, n_bits int"), "mph")
    return (both.filter("level is null").select("bucket", "slot", "digest", "winner", "copies"),
            both.filter("level is not null").select("bucket", "level", "bits", "n_bits"), buckets)


def lookup(ws: Workspace, new: DataFrame, slots: DataFrame, levels: DataFrame, buckets: int) -> DataFrame:
    """(digest, member, old_winner, old_copies) of distinct new digests, byte-checked in their slots."""
    out = "digest binary, winner long, copies long, member boolean, old_winner long, old_copies long"
    names = ["digest", "winner", "copies", "member", "old_winner", "old_copies"]
    none32, none64, nonebin = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("binary")
    a = levels.select("bucket", F.lit(0).alias("kind"), F.col("level").alias("at"), F.col("bits").alias("data"),
                      none64.alias("winner"), F.col("n_bits").cast("long").alias("copies"))
    b = slots.select("bucket", F.lit(1).alias("kind"), F.col("slot").alias("at"), F.col("digest").alias("data"),
                     "winner", "copies")
    c = new.select(_bucket(buckets).alias("bucket"), F.lit(2).alias("kind"), none32.alias("at"),
                   F.col("digest").alias("data"), "winner", "copies")
    rows = (a.unionByName(b).unionByName(c).repartition(partitions(ws.spark), "bucket")
            .sortWithinPartitions("bucket", "kind", "at"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_bucket(batches):
            kind = t.column("kind").to_numpy()
            n0, n1 = int((kind == 0).sum()), int((kind == 1).sum())
            lv, sl, ask = t.slice(0, n0), t.slice(n0, n1), t.slice(n0 + n1)
            if not ask.num_rows:
                continue
            bits = [np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool)
                    for x, n in zip(lv.column("data").to_pylist(), lv.column("copies").to_pylist())]
            held, asked = sl.column("data").to_pylist(), ask.column("data").to_pylist()
            slot = slot_of(bits, _halves(asked))
            member = np.array([s >= 0 and held[s] == d for s, d in zip(slot.tolist(), asked)], dtype=bool)
            take = pa.array(np.where(member, slot, 0), mask=~member)
            yield pa.RecordBatch.from_arrays([
                pa.array(asked, pa.binary()), ask.column("winner").combine_chunks(),
                ask.column("copies").combine_chunks(), pa.array(member),
                _taken(sl.column("winner"), take), _taken(sl.column("copies"), take)], names=names)

    return rows.mapInArrow(probe, out)


def _taken(column: pa.ChunkedArray, at: pa.Array) -> pa.Array:
    got = column.take(at) if len(column) else pa.nulls(len(at), pa.int64())
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def exact_dedup(docs: DataFrame, history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's decision: (_id, digest, keep_id, group_size, kept).

    ``history`` says which rows are historical: their distinct digests build the
    minimal perfect hash; the other rows look it up. Groups span both; the largest id wins.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        # numbers in the order of the ids stand for them
        numbered, _ = identified(ws, docs, id_col, {"text": F.col(text_col), "old": F.coalesce(history, F.lit(False))})
        got = exact_dedup(numbered.select("uid", "text", "old"), F.col("old"), "uid", "text")
        ids = numbered.select(F.col("uid").alias("_uid"), F.col("_id").alias("_name"))
        named = got.join(ids, F.col("_id") == F.col("_uid")).drop("_id", "_uid").withColumnRenamed("_name", "_id")
        keep = ids.select(F.col("_uid").alias("_k"), F.col("_name").alias("_keep"))
        # rows that repeat the winning id and text are one row of it
        out = named.join(keep, F.col("keep_id") == F.col("_k")).select("_id", "digest", F.col("_keep").alias("keep_id"), "group_size", "kept")
        return out
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = ws.save(docs.select(F.col(id_col).cast("long").alias("_id"), F.unhex(F.sha2(text, 256)).alias("digest"),
                               F.coalesce(history, F.lit(False)).alias("old")), "digests")
    old = winners(rows.filter("old"))
    slots, levels, buckets = build_history(ws, old)
    new = winners(rows.filter("not old"))
    seen = ws.save(lookup(ws, new, slots, levels, buckets), "lookups")
    # members join the history's group; nonmembers are groups of their own; the rest of the history is unchanged
    fresh = seen.select("digest", F.greatest("winner", "old_winner").alias("winner"),
                        (F.col("copies") + F.coalesce("old_copies", F.lit(0))).alias("copies"))
    unchanged = (slots.join(seen.filter("member").select("digest"), "digest", "left_anti")
                 .select("digest", "winner", "copies"))
    groups = fresh.unionByName(unchanged)
    joined = rows.join(groups, "digest")
    once = joined.withColumn("_best", F.col("_id").eqNullSafe(F.col("winner")))
    # repeated rows of the winning id: keep one (rare; only rows of winning ids are looked at)
    repeated = (once.filter("_best").groupBy("digest", "winner").agg(F.count(F.lit(1)).alias("_n"))
                .filter("_n > 1").select("digest"))
    if not repeated.limit(1).count():
        return once.select("_id", "digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"),
                           F.col("_best").alias("kept"))
    singles = once.join(repeated, "digest", "left_anti").select(
        "_id", "digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), F.col("_best").alias("kept"))
    multi = once.join(repeated, "digest", "left_semi")
    losers = multi.filter("not _best").select(
        "_id", "digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(False).alias("kept"))
    equal = (multi.filter("_best").groupBy("_id", "digest", "winner", "copies").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
             .select("_id", "digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"),
                     (F.col("_k") == 1).alias("kept")))
    return singles.unionByName(losers).unionByName(equal)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; the older half of the id range is the history, the newer half looks it up."""
    docs = read_table(spark, sf_dir, "documents")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        older = F.col("doc_id") <= F.lit(((lo or 0) + (hi or 0)) // 2)
    else:      # ids without a middle: half of them by hash
        older = F.xxhash64("doc_id") < 0
    out = exact_dedup(docs, older)
    return out.select(F.col("_id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))
