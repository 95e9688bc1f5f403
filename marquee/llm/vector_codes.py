"""Vector code compression: codebooks by part, assigned through anchors-hierarchy metric trees.

Vectors are cut into ``parts`` equal parts; each part position has a codebook of up to
``entries`` integer vectors, refined in ``rounds`` rounds (assign every part to its nearest
entry, replace each entry by the floor of its parts' mean), and a vector's code names its
parts' nearest entries. All arithmetic that decides is on integers, so the result does not
depend on how rows are dealt to tasks.

Trees. Rows are packed into blocks of up to ``block`` vectors, one row each in a written
table; a block holds one metric tree for each part position, over the distinct parts with
their multiplicities. A tree is built middle-out: about sqrt(n) anchors (each new one is the
point farthest from its anchor and takes over the points that are nearer to it; points
within half the distance of two anchors are not looked at), then pairs of anchors merge
upwards, the pair of least joint radius first, and each anchor's points are divided by
anchors again downwards. Every ball caches its centre, radius, number of points and their sum.

Assignment. A ball gets its parent's list of candidate entries and strikes those that are
farther than the centre's nearest candidate at every point of the ball: with nearest e*, the
difference of squared distances to e* and to e is linear in the point, so it changes by at
most 2 r |e - e*| over the ball. A ball with one candidate left is wholly owned: its cached
sum and count go to the entry, and no point is looked at. What is left at the leaves is
compared point by point in integers. Strikes keep a margin for rounding; ties are never
struck, so the lower index wins. Balls of one level are worked on together.

What travels: sums and counts by (part, entry, component), combined in each task and then by
Spark; the codebooks, parts x entries x components integers, go through the driver. Vectors
do not move after they are packed.

Defined cases: rows whose vector is null, or holds a null, NaN or infinite component, are
dropped, and so are those of another length than the first kept row (by id) or whose length
is no multiple of ``parts``, as they have no code. The first kept rows are taken in order of
id (null last), then of the vector; fewer kept rows than ``entries`` give as many entries. Rows
that repeat, by id or wholly, are rows of their own; of equal entries the lower index wins;
null labels form one label; an empty table gives an empty result; extra columns are not read.
Components must be below 2**18 in size, so that all sums of squares are exact; a larger one
is an error.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read_table, small

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK, LEAF = 4096, 24
SCALE = 256
LARGEST = 1 << 26        # of a scaled component: 2**54 for a square of a difference, 2**63 for 512 of them
_FAR = np.iinfo(np.int64).max


def scaled(vector: Column) -> Column:
    """floor(256 x) of every component; null where a component is missing or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    big = F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more")).cast("long")
    up = F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * SCALE < LARGEST, F.floor(x.cast("double") * SCALE).cast("long")).otherwise(big))
    return F.when(vector.isNotNull() & whole, up)


# ---------------------------------------------------------------- trees

def _far(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - pivot) ** 2).sum(axis=1).astype(np.float64))


def anchors(points: np.ndarray, k: int) -> list[np.ndarray]:
    """Up to k groups of points, each around an anchor nearer than any other anchor."""
    d = _far(points, points[0])
    order = np.argsort(-d, kind="stable")
    pivots, owned, dist = [0], [order], [d[order]]
    radius = np.array([dist[0][0]])
    while len(owned) < k:
        wide = int(np.argmax(radius))
        if radius[wide] == 0:
            break
        new = int(owned[wide][0])
        gap = _far(points[pivots], points[new])
        taken, at = [], []
        for i in np.flatnonzero(radius > gap / 2):
            m = int(np.searchsorted(-dist[i], -gap[i] / 2))      # the others are nearer to their anchor for sure
            there = _far(points[owned[i][:m]], points[new])
            moves = there < dist[i][:m]
            if i == wide:
                moves[0] = True
            if moves.any():
                taken.append(owned[i][:m][moves])
                at.append(there[moves])
                stays = np.concatenate((~moves, np.ones(len(owned[i]) - m, dtype=bool)))
                owned[i], dist[i] = owned[i][stays], dist[i][stays]
                radius[i] = dist[i][0] if len(dist[i]) else -1.0
        t, a = np.concatenate(taken), np.concatenate(at)
        order = np.argsort(-a, kind="stable")
        pivots.append(new)
        owned.append(t[order])
        dist.append(a[order])
        radius = np.append(radius, dist[-1][0])
    return [o for o in owned if len(o)]


def _merged(points: np.ndarray, groups: list):
    """Groups (subtree, centre, radius) merged in pairs into one tree, least joint radius first."""
    nodes = [g[0] for g in groups]
    centre = np.array([g[1] for g in groups])
    radius = np.array([g[2] for g in groups])
    joint = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(-1)) + radius[:, None] + radius[None]
    np.fill_diagonal(joint, np.inf)
    alive = len(nodes)
    while alive > 1:
        i, j = divmod(int(np.argmin(joint)), len(nodes))
        nodes[i], nodes[j] = (nodes[i], nodes[j]), None
        r = joint[i, j] / 2
        gap = np.sqrt(((centre[j] - centre[i]) ** 2).sum())
        if gap > 0:      # centre of the ball around both
            centre[i] = centre[i] + (centre[j] - centre[i]) * min(1.0, max(0.0, (r - radius[i]) / gap))
        radius[i] = max(r, radius[i], radius[j])
        joint[j, :] = joint[:, j] = np.inf
        open_ = np.isfinite(joint[i])
        row = np.sqrt(((centre - centre[i]) ** 2).sum(-1)) + radius + radius[i]
        joint[i, open_] = joint[open_, i] = row[open_]
        alive -= 1
    return next(n for n in nodes if n is not None)


def _divide(points: np.ndarray, idx: np.ndarray):
    """Tree over points[idx]: an index array is a leaf, a pair an inner ball."""
    if len(idx) <= LEAF:
        return idx
    groups = anchors(points[idx], int(np.ceil(np.sqrt(len(idx)))))
    if len(groups) == 1:
        return idx
    found = []
    for g in groups:
        part = points[idx[g]]
        centre = part.mean(axis=0)
        found.append((_divide(points, idx[g]), centre, _far(part, centre).max()))
    return _merged(points, found)


def build_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """Metric tree of integer points (rows), flattened: balls in preorder, their points contiguous."""
    uniq, place, times = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    root = _divide(uniq, np.arange(len(uniq)))
    lo, hi, left, right, order = [], [], [], [], []
    size, stack = 0, [(root, -1, 0)]
    while stack:
        node, parent, side = stack.pop()
        if node is None:                   # all below ball ``parent`` is placed
            hi[parent] = size
            continue
        me = len(lo)
        if parent >= 0:
            (left, right)[side][parent] = me
        lo.append(size)
        hi.append(size)
        left.append(-1)
        right.append(-1)
        if isinstance(node, tuple):
            stack += [(None, me, 0), (node[1], me, 1), (node[0], me, 0)]
        else:
            order.append(node)
            size += len(node)
            hi[me] = size
    order = np.concatenate(order)
    p, w = uniq[order], times[order]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    lo, hi = np.array(lo), np.array(hi)
    run = np.concatenate((np.zeros((1, p.shape[1]), np.int64), np.cumsum(p * w[:, None], axis=0)))
    n = np.concatenate(([0], np.cumsum(w)))
    centre = np.array([p[a:b].mean(axis=0) for a, b in zip(lo, hi)])
    radius = np.array([_far(p[a:b], c).max() for a, b, c in zip(lo, hi, centre)])
    return {"points": p, "times": w, "at": rank[place.reshape(-1)], "lo": lo, "hi": hi, "left": np.array(left), "right": np.array(right),
            "centre": centre, "radius": radius, "sum": run[hi] - run[lo], "count": n[hi] - n[lo]}


def pack(tree: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def owners(tree: dict[str, np.ndarray], book: np.ndarray):
    """Walk the tree: (balls, entries) of wholly owned balls and (points, entries) of the points left at leaves."""
    first = np.zeros(len(book), dtype=bool)
    first[np.unique(book, axis=0, return_index=True)[1]] = True       # a repeated entry never wins
    between = np.sqrt(((book[:, None] - book[None]) ** 2).sum(-1).astype(np.float64))
    fbook = book.astype(np.float64)
    ball, mask = np.zeros(1, dtype=np.int64), first[None]
    balls, ball_owner, rest, rest_mask = [], [], [], []
    while len(ball):
        d = ((tree["centre"][ball][:, None] - fbook[None]) ** 2).sum(-1)
        best = np.argmin(np.where(mask, d, np.inf), axis=1)
        nearest = d[np.arange(len(ball)), best][:, None]
        slack = 2 * tree["radius"][ball][:, None] * between[best] + 1e-9 * (d + nearest + 1)
        mask = mask & (d - nearest <= slack)
        mask[np.arange(len(ball)), best] = True
        owned = mask.sum(axis=1) == 1
        balls.append(ball[owned])
        ball_owner.append(best[owned])
        ball, mask = ball[~owned], mask[~owned]
        leaf = tree["left"][ball] < 0
        for b, m in zip(ball[leaf], mask[leaf]):
            rest.append(np.arange(tree["lo"][b], tree["hi"][b]))
            rest_mask.append(np.broadcast_to(m, (len(rest[-1]), len(m))))
        ball, mask = ball[~leaf], mask[~leaf]
        ball, mask = np.concatenate((tree["left"][ball], tree["right"][ball])), np.concatenate((mask, mask))
    point_owner = [np.zeros(0, np.int64)]
    for p, m in zip(rest, rest_mask):
        d = ((tree["points"][p][:, None] - book[None]) ** 2).sum(-1)
        point_owner.append(np.argmin(np.where(m, d, _FAR), axis=1))
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(balls), np.concatenate(ball_owner), np.concatenate(empty + rest), np.concatenate(point_owner)


def tree_sums(tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the parts that each entry owns."""
    ball, who, point, whose = owners(tree, book)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    np.add.at(sums, who, tree["sum"][ball])
    np.add.at(counts, who, tree["count"][ball])
    np.add.at(sums, whose, tree["points"][point] * tree["times"][point][:, None])
    np.add.at(counts, whose, tree["times"][point])
    return sums, counts


def tree_codes(tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part, in the order of the block's rows."""
    ball, who, point, whose = owners(tree, book)
    code = np.empty(len(tree["points"]), dtype=np.int64)
    for b, e in zip(ball, who):
        code[tree["lo"][b]:tree["hi"][b]] = e
    code[point] = whose
    error = ((tree["points"] - book[code]) ** 2).sum(axis=1)
    return code[tree["at"]], error[tree["at"]]


# ---------------------------------------------------------------- tasks

def _blocks(block: int, parts: int):
    """Rows (id, label, vector) -> one row a block: ids, labels and a tree for each part position."""
    def one(ids, labels, vectors):
        v = np.concatenate(vectors)
        trees = [pack(build_tree(x)) for x in np.split(v, parts, axis=1)]
        ends = pa.array([0, len(v)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.concat_arrays(ids)),
                                           pa.ListArray.from_arrays(ends, pa.concat_arrays(labels)),
                                           pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, have = [], [], [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                s = b.slice(at, block - have)
                at += s.num_rows
                have += s.num_rows
                ids.append(s.column(0))
                labels.append(s.column(1))
                vectors.append(np.asarray(s.column(2).flatten(), dtype=np.int64).reshape(s.num_rows, -1))
                if have == block:
                    yield one(ids, labels, vectors)
                    ids, labels, vectors, have = [], [], [], 0
        if have:
            yield one(ids, labels, vectors)
    return run


_SUMS = "part int, entry int, component int, total long, n long"


def _sums(books: np.ndarray):
    """Blocks -> the sums and counts of every entry over a task's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            for r in range(b.num_rows):
                for p, data in enumerate(b.column(0)[r]):
                    s, n = tree_sums(unpack(data.as_py()), books[p])
                    sums[p] += s
                    counts[p] += n
        part, entry = np.nonzero(counts)
        width = books.shape[2]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(part, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()),
            pa.array(np.tile(np.arange(width), len(part)), pa.int32()), pa.array(sums[part, entry].reshape(-1), pa.int64()),
            pa.array(np.repeat(counts[part, entry], width), pa.int64())], ["part", "entry", "component", "total", "n"])
    return run


def _codes(books: np.ndarray):
    """Blocks -> (id, label, code, error) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, labels = (b.column(c).slice(r, 1).flatten() for c in (0, 1))
                got = [tree_codes(unpack(data.as_py()), books[p]) for p, data in enumerate(b.column(2)[r])]
                code = np.stack([c for c, _ in got], axis=1).astype(np.uint8)
                error = np.sum([e for _, e in got], axis=0)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in code], pa.string()),
                                                  pa.array(error, pa.int64())], ["_id", "_label", "code", "error"])
    return run


# ---------------------------------------------------------------- operator

def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray | None]:
    """(rows, codebooks): every kept row's id, label, code and error; codebooks[part, entry, component].

    ``entries`` is at most 256. The codebooks are None where no row is kept.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries: a code has two hex digits a part")
    spark = vectors.sparkSession
    ws = Workspace(spark, "codes")
    named = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), scaled(F.col(vector_col)).alias("_v"))
    named = named.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & (F.size("_v") % parts == 0))
    order = [F.col("_id").asc_nulls_last(), F.col("_v")]
    start = named.orderBy(*order).limit(1).collect()
    result = f"_id {named.schema['_id'].dataType.simpleString()}, _label {named.schema['_label'].dataType.simpleString()}, code string, error long"
    if not start:
        return spark.createDataFrame([], result), None
    named = named.filter(F.size("_v") == len(start[0]["_v"]))
    seeds = np.array([r["_v"] for r in named.orderBy(*order).limit(entries).collect()], dtype=np.int64)
    books = np.stack(np.split(seeds, parts, axis=1))
    kind = {c: named.schema[c].dataType.simpleString() for c in ("_id", "_label")}
    blocks = ws.save(named.mapInArrow(_blocks(block, parts), f"ids array<{kind['_id']}>, labels array<{kind['_label']}>, trees array<binary>"), "trees")
    for _ in range(rounds):
        got = (blocks.select("trees").mapInArrow(_sums(books), _SUMS).groupBy("part", "entry", "component")
               .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())       # as many rows as the codebooks have numbers
        books = books.copy()
        for r in got:
            books[r.part, r.entry, r.component] = r.total // r.n
    return ws.save(blocks.mapInArrow(_codes(books), result), "codes"), books


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``, with errors by row and by label."""
    rows, books = compress(read_table(spark, sf_dir, "embeddings"))
    by_label = small(rows.groupBy(F.col("_label").alias("_l")).agg(F.sum("error").alias("label_error")))
    digest = "" if books is None else book_digest(books)
    return (rows.join(by_label, F.col("_label").eqNullSafe(F.col("_l")))
            .select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), F.col("_label").alias("label")))
