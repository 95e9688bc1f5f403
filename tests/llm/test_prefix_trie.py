import hashlib
import random
import zlib

import pytest

from marquee.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth long, path string"


def brute(rows):
    """The contract in plain Python: one tuple a node."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + t[h:])
    members, ends = {}, {}
    for c, t in full.items():
        ends.setdefault(t, []).append(c)
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids.get(k, [])), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items())


def talk(seed, n, width=3, longest=9, hot=0):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        turns = r.randrange(1, longest)
        for t in range(turns):
            text = r.choice(["hé", "yes", "", None, "🙂 ok", "no"][:width]) if t % 3 else "hello"
            rows.append((c * 3 if c % 2 else c * 50, t, r.choice(["user", None, "bot"][:width]), text))
    for c in range(hot):                                   # copies of one conversation
        rows += [(10_001 + c * 7, t, "user", f"turn {t}") for t in range(4)]
    rows += [(77_777, t % 40 if t % 5 else None, "user", f"x{t // 3}") for t in range(150)]    # long, repeated and missing numbers
    rows += [(None, 1, "user", "of no conversation"), (88_888, 0, None, None), (88_889, 0, "", "")]
    r.shuffle(rows)
    # repeated numbers are ordered by digest; keep only those whose order brute force knows
    seen, out = set(), []
    for x in rows:
        if x[:2] not in seen or x[0] is None:
            seen.add(x[:2])
            out.append(x)
    return out


def nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("seed,n,width,shards,turns,hot", [(1, 60, 2, None, 64, 0), (2, 150, 3, 40, 64, 40), (3, 200, 1, 25, 3, 90), (4, 120, 2, 1, 64, 5), (5, 90, 2, 300, 1, 60)])
def test_nodes_are_brute_force(spark, monkeypatch, seed, n, width, shards, turns, hot):
    rows = talk(seed, n, width, hot=hot)
    df = spark.createDataFrame([(*r, 9, "p") for r in rows], SCHEMA).repartition(3)
    assert nodes(pt.trie_nodes(df, shards=shards, splitter_turns=turns)) == brute(rows)


def test_id_blocks_cross_tasks():
    import pyarrow as pa
    rows = [(b"a", i) for i in range(20_000)] + [(b"b", 5)] + [(b"c", i) for i in (7, 9)]
    cut = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([i for _, i in part], pa.int64())], ["key", "conv_id"])
           for part in (rows[:3000], rows[3000:17_000], rows[17_000:])]
    blocks = list(pt._id_blocks(iter(cut)))
    assert max(n for b in blocks for n in b.column(2).to_pylist()) == pt.ID_BLOCK
    got = [r for b in pt._groups(iter(blocks)) for r in b.to_pylist()]
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == [{"winner": 0, "copies": 20_000, "ends": sha(range(20_000))}, {"winner": 5, "copies": 1, "ends": sha([5])},
                   {"winner": 7, "copies": 2, "ends": sha([7, 9])}]


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pt.trie_nodes(empty).collect() == []
    # ties are ordered by digest, the same for every copy; a very long text counts whole
    rows = [(100, 1, "a", "x"), (100, 1, "b", "y"), (100, 1, "b", "y"), (200, 1, "b", "y"), (200, 1, "a", "x"), (200, 1, "b", "y"), (300, 0, "u", "é" * 2_000_000)]
    got = nodes(pt.trie_nodes(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA), rebuild=False))
    assert len(got) == 5 and got[0][3:7] == (3, 2, 2, 3)
    twice = [(300, 0, "u", "é" * 2_000_000), (400, 0, "u", "é" * 2_000_000)]
    got = nodes(pt.trie_nodes(spark.createDataFrame([(*r, 0, "") for r in twice], SCHEMA), rebuild=False))
    assert [x[6] for x in got] == [2_000_000, 2_000_000]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(pt.op13_prefix_trie(spark, sf)) == brute(rows)
