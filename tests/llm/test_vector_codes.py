import hashlib
import math
import random

import numpy as np
import pytest

from marquee.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def brute(rows, parts, entries, rounds=2):
    """The contract in plain Python: (vec_id, label) -> codes, and the codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w:(p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for i, v, y in kept:
        got = [near(p, cut(v)[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), y))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return out, digest


def vectors(seed, n, dim, grid):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.4) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        v = [float(np.float32(round(x + r.gauss(0, 0.1), grid))) for x in c]
        rows.append((i * 7 % n, v, None if i % 5 == 0 else i % 4))
    same = rows[3][1]
    rows += [(n + i, same, 2) for i in range(n // 2)]            # a hot vector
    rows += [(n + 1, rows[5][1], 1), rows[7], rows[7], (None, rows[9][1], 0), (None, rows[9][1], None)]
    rows += [(-4, None, 1), (-3, [None] + same[1:], 1), (-2, [math.nan] + same[1:], 1), (-1, [math.inf] + same[1:], None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,dim,parts,entries,block,grid", [(150, 8, 4, 16, 64, 1), (300, 32, 16, 64, 4096, 3), (40, 6, 2, 64, 7, 2), (10, 4, 4, 64, 10, 3)])
def test_codes_are_brute_force(spark, n, dim, parts, entries, block, grid):
    rows = vectors(n, n, dim, grid)
    df = spark.createDataFrame([(*r, "c", 5) for r in rows], SCHEMA).repartition(3)
    got, books = vc.compress(df, parts=parts, entries=entries, block=block)
    want, digest = brute(rows, parts, entries)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x["_id"], x["code"], x["error"], x["_label"]) for x in got.collect()), key=key) == sorted(want, key=key)
    assert vc.book_digest(books) == digest


def test_trees_prune_and_stay_exact():
    r = np.random.default_rng(2)
    points = np.concatenate((r.integers(-200, 200, (3000, 4)), np.tile([[5, 5, 5, 5]], (1500, 1))))
    tree = vc.build_tree(points)
    assert (tree["points"][tree["at"]] == points).all()
    assert tree["count"][0] == len(points) and (tree["sum"][0] == points.sum(axis=0)).all()
    book = np.concatenate((points[:30], points[:3]))
    d = ((points[:, None] - book[None]) ** 2).sum(-1)
    code, error = vc.tree_codes(tree, book)
    assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    sums, counts = vc.tree_sums(tree, book)
    assert (counts == np.bincount(code, minlength=len(book))).all()
    assert all((sums[k] == points[code == k].sum(axis=0)).all() for k in range(len(book)))
    far = r.integers(-200, 200, (4000, 4)) + np.repeat([[0] * 4, [50_000] * 4], 2000, axis=0)
    ball, who, point, _ = vc.owners(vc.build_tree(far), np.array([[0] * 4, [50_000] * 4]))
    assert len(point) == 0 and len(ball) <= 4          # wholly owned high up: no point is looked at


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rows, books = vc.compress(empty)
    assert rows.collect() == [] and books is None
    odd = [(1, [0.1] * 16, 1), (2, [0.1] * 32, 1), (3, [0.1] * 5, 1), (4, [], 1)]       # other lengths have no code
    rows, _ = vc.compress(spark.createDataFrame([(*r, "c", 5) for r in odd], SCHEMA))
    assert [(x["_id"], x["code"], x["error"]) for x in rows.collect()] == [(1, "00" * 16, 0)]
    with pytest.raises(Exception, match="a component of 262144 or more"):
        vc.compress(spark.createDataFrame([(1, [3e5] * 16, 1, "", 0)], SCHEMA))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = brute(rows, 16, 64)
    by_label = {}
    for _, _, e, y in want:
        by_label[y] = by_label.get(y, 0) + e
    got = sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.op12_vector_codes(spark, sf).collect())
    assert got == sorted((i, c, e, by_label[y], digest) for i, c, e, y in want)
