"""Prefix trie of conversations: sorted shards, and a skeleton of splitter paths.

A conversation is the path of its turns. Paths are sorted and dealt to shards by splitters,
prefixes (of at most ``SPLITTER_TURNS`` turns) of sampled paths. The members of a node are
contiguous in that order, so a node whose members lie in two shards is a prefix of the
splitter between them. The trie of all splitters, the skeleton, is broadcast:
* every node outside the skeleton has all its members in one shard. The shard's task reads
  its sorted paths once, with a stack of the open nodes, and finishes such nodes there;
* for a skeleton node each shard that meets it sends one partial aggregate. Partial
  aggregates are summed by node, and a node's subtree is added up over the skeleton, whose
  nodes all know their ancestors.

Before that, equal paths are brought together: (path digest, conv_id) pairs are range-sorted,
so that copies of one conversation are spread over many tasks, and written as blocks of ids;
a group's blocks are then read in order for its size, smallest id and SHA-256. Only one row
for each distinct path enters the shards.

Turns travel as 128-bit digests (the first half of SHA-256 over length-marked role and
text) and code-point counts; texts stay where they are. A skeleton has at most
``MAX_SHARDS * SPLITTER_TURNS`` nodes, and the driver holds at most ``OVERSAMPLE`` prefixes a
shard. A shard's task buffers the finished nodes of one subtree outside the skeleton.

Defined cases: null role and text are empty; turns of one conversation with the same number
(or none, which come first) are ordered by their digest; rows that repeat are turns of their
own; rows without conv_id belong to no conversation; a rebuilt conversation without turns is
a member of the root and ends there; a very long text counts whole; an empty table gives no
nodes; extra columns are not read. One conversation's turns are one row, 50 bytes a turn.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, read_table, small

FAMILY, HEADS = 100, 6           # conversations of a hundred share up to five first turns
SYMBOL = 16                      # bytes of a turn's digest
SPLITTER_TURNS = 64
PATHS_PER_SHARD, MAX_SHARDS, OVERSAMPLE = 20_000, 16_384, 4
ID_BLOCK = 8_192
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, t): every conversation's turns in order, each a struct of number, digest ``d`` and code points ``n``."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * SYMBOL)
    turn = F.struct(F.col(turn_col).alias("turn"), digest.alias("d"), F.char_length(text).alias("n"))
    return (turns.filter(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).cast("long").alias("conv_id"))
            .agg(F.sort_array(F.collect_list(turn)).alias("t")))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations whose first turns (0 to 5, by the id's checksum) are those of their family's first conversation."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_base"), F.slice("t", 1, HEADS - 1).alias("_t"))
    rows = own.withColumn("_h", h).withColumn("_base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "_base", "left")
    none = F.slice("t", 1, 0)
    first = F.when(F.col("_h") > 0, F.slice(F.coalesce("_t", none), F.lit(1), F.greatest("_h", F.lit(1)))).otherwise(none)
    rest = F.slice("t", F.col("_h") + 1, F.greatest(F.size("t"), F.lit(1)))
    return rows.select("conv_id", F.concat(first, rest).alias("t"))


def _as_path(rows: DataFrame) -> DataFrame:
    """(conv_id, path binary, n array): digests joined, so that paths compare as bytes."""
    path = F.unhex(F.array_join(F.transform("t", lambda x: x["d"]), ""))
    return rows.select("conv_id", path.alias("path"), F.transform("t", lambda x: x["n"]).alias("n"))


# ---------------------------------------------------------------- equal paths

_BLOCK = "key binary, first long, copies long, ids string"


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) -> blocks of up to ``ID_BLOCK`` ids of one key."""
    out = {"key": [], "first": [], "copies": [], "ids": []}

    def close(key, ids):
        for c, v in (("key", key), ("first", ids[0]), ("copies", len(ids)), ("ids", ",".join(map(str, ids)))):
            out[c].append(v)

    def batch():
        b = pa.RecordBatch.from_arrays([pa.array(out["key"], pa.binary()), pa.array(out["first"], pa.int64()),
                                        pa.array(out["copies"], pa.int64()), pa.array(out["ids"], pa.string())], list(out))
        for v in out.values():
            v.clear()
        return b

    key, ids = None, []
    for b in batches:
        for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and (k != key or len(ids) == ID_BLOCK):
                close(key, ids)
                ids = []
            key = k
            ids.append(i)
        if out["key"]:
            yield batch()
    if ids:
        close(key, ids)
        yield batch()


_GROUP = "winner long, copies long, ends string"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by (key, first) -> one row a key: smallest id, number of ids, SHA-256 of them all."""
    key, winner, copies, sha = None, None, 0, None
    for b in batches:
        rows = {"winner": [], "copies": [], "ends": []}
        for k, first, n, ids in zip(*(c.to_pylist() for c in b.columns)):
            if k == key:
                sha.update(b"," + ids.encode())
                copies += n
                continue
            if key is not None:
                for c, v in zip(rows.values(), (winner, copies, sha.hexdigest())):
                    c.append(v)
            key, winner, copies, sha = k, first, n, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(rows["winner"], pa.int64()), pa.array(rows["copies"], pa.int64()),
                                          pa.array(rows["ends"], pa.string())], list(rows))
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([winner], pa.int64()), pa.array([copies], pa.int64()),
                                          pa.array([sha.hexdigest()], pa.string())], ["winner", "copies", "ends"])


def distinct_paths(ws: Workspace, paths: DataFrame) -> DataFrame:
    """(path, n, winner, copies, ends): one row for each distinct path."""
    n = partitions(ws.spark)
    pairs = paths.select(F.unhex(F.sha2("path", 256)).alias("key"), "conv_id")
    blocks = pairs.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_id_blocks, _BLOCK)
    groups = blocks.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(_groups, _GROUP)
    return paths.join(groups, F.col("conv_id") == F.col("winner")).select("path", "n", "winner", "copies", "ends")


# ---------------------------------------------------------------- skeleton

def pick_splitters(sample: list[bytes], shards: int) -> list[bytes]:
    """Evenly spaced prefixes of sorted sample paths."""
    sample = sorted(sample)
    return sorted({sample[i * len(sample) // shards] for i in range(1, shards)} - {b""}) if sample else []


def skeleton(splitters: list[bytes]):
    """(nested trie: symbol -> [number, children], list of (sid, parent, children, ancestors))."""
    root, info = [0, {}], [[0, None, 0, [0]]]
    for s in splitters:
        node = root
        for i in range(0, len(s), SYMBOL):
            sym = s[i:i + SYMBOL]
            if sym not in node[1]:
                sid = len(info)
                info.append([sid, node[0], 0, [*info[node[0]][3], sid]])
                info[node[0]][2] += 1
                node[1][sym] = [sid, {}]
            node = node[1][sym]
    return root, info


def _deal(splitters: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [bisect_right(splitters, p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], ["shard", *b.schema.names])
    return run


# ---------------------------------------------------------------- shards

_NODE = ("sid int, parent_sid int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved long, ends string, last int")


class _Shard:
    """Open nodes of the sorted paths of one shard, and the finished nodes not yet handed out."""

    def __init__(self, trie):
        self.trie = trie
        self.out: list[tuple] = []
        self.start()

    def start(self):
        self.prev, self.depth = b"", 0
        self.kept: list[list] = []       # finished nodes of the open subtree outside the skeleton
        self.stack = [self._open(0, None, 0)]
        self.seen = False

    def _open(self, depth, skel, last):
        """[skeleton node, smallest id, members, children, leaves, saved, ends, last text's length, place in kept]"""
        skel = self.trie if depth == 0 else skel
        place = -1
        if skel is None:
            place = len(self.kept)
            self.kept.append([None, depth, self.stack[-1][8]])
        return [skel, None, 0, 0, 0, 0, None, last, place]

    def _close(self):
        skel, conv, n, children, leaves, saved, ends, last, place = self.stack.pop()
        depth = len(self.stack)
        up = self.stack[-1] if self.stack else None
        if up is not None:
            up[1] = conv if up[1] is None else min(up[1], conv)
            up[2] += n
        if skel is not None:             # leaves and savings of skeleton nodes are added up later
            self.out.append((skel[0], None, conv, depth, None, n, children, leaves, saved, ends, last))
            return
        leaves = leaves or 1
        saved += (n - 1) * last
        up[3] += 1
        up[4] += leaves
        up[5] += saved
        self.kept[place] = [conv, depth, self.kept[place][2], n, children, leaves, saved, ends]
        if up[0] is not None:            # a whole subtree is finished: its parents' ids are known
            for c, d, parent, *rest in self.kept:
                over = self.kept[parent][0] if parent >= 0 else None
                self.out.append((None, None if parent >= 0 else up[0][0], c, d, over, *rest, None))
            self.kept.clear()

    def add(self, path: bytes, lengths: list[int], conv: int, n: int, ends: str):
        same, most = 0, min(len(path), len(self.prev))
        while same < most and path[same:same + SYMBOL] == self.prev[same:same + SYMBOL]:
            same += SYMBOL
        same //= SYMBOL
        while len(self.stack) - 1 > same:
            self._close()
        for d in range(same, len(path) // SYMBOL):
            above = self.stack[-1][0]
            skel = above[1].get(path[d * SYMBOL:(d + 1) * SYMBOL]) if above is not None else None
            self.stack.append(self._open(d + 1, skel, lengths[d]))
        top = self.stack[-1]
        top[1] = conv if top[1] is None else min(top[1], conv)
        top[2] += n
        top[6] = ends
        self.prev, self.seen = path, True

    def finish(self):
        if self.seen:
            while self.stack:
                self._close()
        self.start()

    def batch(self) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
        names = [f.split()[0] for f in _NODE.split(", ")]
        columns = list(zip(*self.out)) or [()] * len(types)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _nodes(trie):
    """Sorted (shard, path, n, winner, copies, ends) -> finished nodes, and parts of skeleton nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, at = _Shard(trie), None
        for b in batches:
            for shard, path, lengths, conv, n, ends in zip(*(c.to_pylist() for c in b.columns)):
                if shard != at:
                    work.finish()
                    at = shard
                work.add(path, lengths, conv, n, ends)
                if len(work.out) >= 8192:
                    yield work.batch()
        work.finish()
        yield work.batch()
    return run


def trie_nodes(turns: DataFrame, rebuild: bool = True, shards: int | None = None, splitter_turns: int = SPLITTER_TURNS, **columns) -> DataFrame:
    """All nodes of the trie of the conversations (``rebuild``: with the heads of their families)."""
    spark = turns.sparkSession
    ws = Workspace(spark, "trie")
    own = turn_paths(turns, **columns)
    if rebuild:
        own = rebuilt(ws.save(own, "own"))
    paths = ws.save(_as_path(own), "paths")
    distinct = ws.save(distinct_paths(ws, paths), "distinct")
    ws.drop(paths)
    n = distinct.count()
    shards = shards or min(MAX_SHARDS, max(partitions(spark), -(-n // PATHS_PER_SHARD)))
    one_in = max(1, n // (OVERSAMPLE * shards))
    prefix = F.substring("path", 1, SYMBOL * splitter_turns)
    sample = distinct.filter(F.pmod(F.xxhash64("path", F.lit(7)), F.lit(one_in)) == 0).select(prefix.alias("p"))
    splitters = pick_splitters([bytes(r.p) for r in sample.collect()], shards)
    trie, info = skeleton(splitters)
    dealt = distinct.mapInArrow(_deal(splitters), "shard int, path binary, n array<int>, winner long, copies long, ends string")
    dealt = dealt.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path")
    rows = ws.save(dealt.mapInArrow(_nodes(trie), _NODE), "nodes")
    return _joined(spark, rows, info)


def _joined(spark: SparkSession, rows: DataFrame, info: list) -> DataFrame:
    """Finished nodes and skeleton nodes, whose parts are summed and added up over the skeleton."""
    known = spark.createDataFrame([(i, p, c, a) for i, p, c, a in info], "sid int, up int, inner int, anc array<int>")
    parts = (rows.filter("sid is not null").groupBy("sid")
             .agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
                  F.sum("n_children").alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved").alias("_s"),
                  F.max("ends").alias("ends"), F.max("last").alias("last"))
             .join(known, "sid")
             .withColumn("n_children", F.col("_c") + F.col("inner"))
             .withColumn("_l", F.col("_l") + F.when(F.col("n_children") == 0, 1).otherwise(0))
             .withColumn("_s", F.col("_s") + (F.col("n_convs") - 1) * F.col("last")))
    sums = (parts.select(F.explode("anc").alias("sid"), "_l", "_s").groupBy("sid")
            .agg(F.sum("_l").alias("n_leaves"), F.sum("_s").alias("saved")))
    ids = parts.select(F.col("sid").alias("parent_sid"), F.col("conv_id").alias("_up"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    skel = (parts.drop("_l", "_s").join(sums, "sid").withColumn("parent_sid", F.col("up")).join(ids, "parent_sid", "left")
            .withColumn("parent_conv_id", F.col("_up")).select(*columns))
    done = rows.filter("sid is null and parent_sid is null").select(*columns)
    below = (rows.filter("sid is null and parent_sid is not null").join(small(ids), "parent_sid")
             .withColumn("parent_conv_id", F.col("_up")).select(*columns))
    out = done.unionByName(below).unionByName(skel)
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id",
                      *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves")],
                      F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt ``conversations``."""
    return trie_nodes(read_table(spark, sf_dir, "conversations"))
