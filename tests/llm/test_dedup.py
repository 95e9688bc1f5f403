import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.llm import exact_dedup, jaccard_join, substring_dedup, suffix_dedup
from marquee.llm import textscan as ts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def windows_removed(rows, window):
    seen, out = {}, {}
    for i, t in sorted((r[0], r[1] or "") for r in rows):
        w = WORD.findall(t)
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[a:a + window]), i) < i:
                keep[a:a + window] = [False] * window
        out[i] = (len(w), len(w) - sum(keep), hashlib.sha256(" ".join(x for x, k in zip(w, keep) if k).encode()).hexdigest())
    return out


def bytes_removed(rows, window):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1] or "") for r in rows):
        b = t.encode()
        keep = np.ones(len(b), bool)
        for a in range(len(b) - window + 1):
            s = b[a:a + window]
            if s in seen:
                keep[a:a + window] = False
            seen.add(s)
        edge = np.diff(np.concatenate(([0], (~keep).astype(int))))
        left = bytes(x for x, k in zip(b, keep) if k)
        out[i] = (len(b), int((~keep).sum()), int((edge == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def groups(rows, width, num, den):
    sets = {}
    for i, t in ((r[0], r[1] or "") for r in rows):
        w = WORD.findall(t.translate(LOW))
        sets[i] = {tuple(w[a:a + width]) for a in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_substring_dedup_is_brute_force(docs, rows):
    got = {r._id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == windows_removed(rows, 50)
    assert sum(v[1] for v in got.values()) > 0


def test_substring_dedup_returns_texts_and_spans(docs):
    for r in substring_dedup.substring_dedup(docs, window=30, gram=6).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substring_dedup_of_documents_that_repeat_themselves(spark):
    """Windows that start in a smaller document go at every place of their piece in the piece's first document."""
    for seed in range(4):
        r = random.Random(seed)
        say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))  # noqa: E731, B023
        shared, line = say(60), say(30)
        section = say(40) + " " + shared + " " + say(40)
        rows = [(1, f"{say(20)} {shared} {say(20)} {line} {line} {say(20)}"),
                (2, " ".join([section, say(30), section, say(5), section])),
                (3, f"{say(9)} " + f"{line} " * 12 + say(9)),
                (4, " ".join([section, say(3), line, line, line]))]
        out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {x._id: (x.n_words, x.n_removed, x.kept_sha256) for x in out.collect()} == windows_removed(rows, 50)


def test_suffix_dedup_is_brute_force(docs, rows):
    got = {r._id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == bytes_removed(rows, 100)


def test_suffix_dedup_across_boundaries(docs, rows, monkeypatch):
    """Tiny chunks and heavy keys: every comparison goes across a boundary."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_RUNS", 7)
    monkeypatch.setattr(suffix_dedup, "CHUNK_TEXTS", 3)
    monkeypatch.setattr(suffix_dedup, "HEAVY_RUNS", 1)
    got = {r._id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == bytes_removed(rows, 100)


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard_groups_are_brute_force(docs, rows, width, num, den):
    out = jaccard_join.jaccard_groups(docs, width=width, num=num, den=den)
    assert {r._id: (r.n_shingles, r.component_id) for r in out.collect()} == groups(rows, width, num, den)


def test_jaccard_tiles_and_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", 60)
    monkeypatch.setattr(jaccard_join, "LIST_CHUNK", 2)
    out = jaccard_join.jaccard_groups(docs, width=3, num=1, den=2)
    assert {r._id: (r.n_shingles, r.component_id) for r in out.collect()} == groups(rows, 3, 1, 2)


@pytest.mark.parametrize("num,den,partners", [(1, 2, 16), (4, 5, 2)])
def test_jaccard_bands_of_hot_lists(spark, monkeypatch, num, den, partners):
    """Many near copies of one text, and many texts with one passage: long lists meet band by band."""
    monkeypatch.setattr(jaccard_join, "BAND", 3)
    monkeypatch.setattr(jaccard_join, "MOST_BAND", 7)
    monkeypatch.setattr(jaccard_join, "PARTNERS", partners)
    r = random.Random(num)
    word = lambda: f"w{r.randrange(400)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(25)]
    rows = []
    for i in range(60):
        w = list(base[:r.randrange(40, 61)])
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(passage + [word() for _ in range(r.randrange(5, 40))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard_join.jaccard_groups(docs, width=2, num=num, den=den)
    assert {x._id: (x.n_shingles, x.component_id) for x in out.collect()} == groups(rows, 2, num, den)


def test_kept_postings_have_a_partner():
    r = np.random.default_rng(4)
    key = np.sort(r.integers(0, 300, 900))
    at = r.integers(20, 80, 900) * jaccard_join.PLACE + r.integers(0, 12, 900)
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    n, p = at // jaccard_join.PLACE, at % jaccard_join.PLACE

    def links(i, j):      # at most 1 + what follows is shared; num / (num + den) of both sizes is needed
        small, big = sorted((n[i], n[j]))
        return key[i] == key[j] and 85 * big <= 100 * small and 185 * min(n[i] - p[i], n[j] - p[j]) >= 85 * (n[i] + n[j])
    want = [any(links(i, j) for j in range(900) if j != i) for i in range(900)]
    assert jaccard_join.has_partner(key, at, 85, 100).tolist() == want and 50 < sum(want) < 850


def test_small_sets_by_subsets(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(12) if j != i)) for i in range(10)] + [(50, " ".join(f"w{j}" for j in range(12)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.jaccard_groups(docs, width=1, num=4, den=5)
    assert {r._id: (r.n_shingles, r.component_id) for r in out.collect()} == groups(rows, 1, 4, 5)


def test_components_of_a_path(spark):
    ws = jaccard_join.Workspace(spark, "test")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.uid, r.root) for r in jaccard_join.components(ws, edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("middle", [-1, 100, 10_000])
def test_exact_dedup(docs, rows, middle):
    text = {r[0]: r[1] or "" for r in rows}
    got = exact_dedup.exact_dedup(docs, F.col("doc_id") <= middle).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [i for i, t in text.items() if t == text[r._id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r._id == max(same))
        assert bytes(r.digest) == hashlib.sha256(text[r._id].encode()).digest()


@given(st.sets(st.binary(min_size=32, max_size=32), max_size=300))
@settings(max_examples=30, deadline=None)
def test_perfect_hash_has_no_gaps(digests):
    keys = exact_dedup._halves(sorted(digests))
    levels = exact_dedup.build_mph(keys)
    assert sorted(exact_dedup.slot_of(levels, keys).tolist()) == list(range(len(digests)))


@given(st.lists(st.binary(min_size=1, max_size=12), min_size=1, max_size=60), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_multikey_sort(strings, width):
    data = np.frombuffer(b"".join(s.ljust(16, b"\0")[:16] for s in strings), np.uint8).reshape(-1, 16)
    words = np.ascontiguousarray(data).view(">u8").astype(np.uint64)
    order, begins = suffix_dedup.multikey_sort(words)
    rows = [tuple(words[i]) for i in order]
    equal = [b != a for a, b in zip(rows, rows[1:])]
    assert sorted(order.tolist()) == list(range(len(strings))) and begins[1:].tolist() == equal
    assert len(set(rows)) == int(begins.sum())


@given(st.text(max_size=200), st.text(max_size=50))
@settings(max_examples=100, deadline=None)
def test_words_and_hashes(a, b):
    import pyarrow as pa
    data, offs = ts.text_bytes(pa.array([a, None, b]))
    start, end, h = ts.words(data, offs)
    got = [data[x:y].tobytes().decode("utf-8", "surrogatepass") for x, y in zip(start, end)]
    assert got == WORD.findall(a) + WORD.findall(b)
    assert len({w: x for w, x in zip(got, h.tolist())}.values()) == len(set(h.tolist()))


@pytest.mark.parametrize("run", [
    lambda d: substring_dedup.substring_dedup(d), lambda d: suffix_dedup.suffix_dedup(d),
    lambda d: jaccard_join.jaccard_groups(d), lambda d: exact_dedup.exact_dedup(d, F.col("doc_id") < 9)])
def test_empty_and_odd_tables(empty, odd, run):
    assert run(empty).collect() == []
    assert len(run(odd).collect()) == odd.count()
    assert sorted(str(r._id) for r in run(odd).collect()) == sorted(str(r.doc_id) for r in odd.collect())


def test_repeated_rows_keep_one(odd, spark):
    got = exact_dedup.exact_dedup(odd, F.lit(False)).collect()
    by = {}
    for r in got:
        by.setdefault(bytes(r.digest), []).append(r.kept)
    assert all(sum(k) == 1 for k in by.values())


def test_jaccard_summaries_reject_no_link():
    r = np.random.default_rng(7)
    for n in (3, 900, 1100, 2100, 4200, 9000, 40000):
        whole = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        keep = np.sort(r.choice(whole, int(0.8 * len(whole)) + 1, replace=False))
        sets = sorted([keep, whole, np.unique(r.integers(0, 2**64, len(whole), dtype=np.uint64))], key=len)
        at = [i for i, s in enumerate(sets) if s is whole or s is keep]
        counts = [jaccard_join.cell_counts(s, jaccard_join.cell_number(len(s))).tobytes() for s in sets]
        sizes = np.array([len(s) for s in sets])
        i, others = at[1], np.arange(at[1])
        got = jaccard_join.Summaries(pa.chunked_array([pa.array(counts, pa.binary())])).near(sizes, i, others, 4, 5)
        assert at[0] in got.tolist()


def test_exact_dedup_takes_text_ids(spark):
    rows = [("b", "x"), ("a", "x"), ("c", "x"), ("c", "x"), (None, "x"), ("d", None), ("e", ""), ("f", "alone")]
    docs = spark.createDataFrame(rows, "name string, body string")
    for history in (F.col("name") <= "b", F.lit(False), F.lit(True)):
        got = exact_dedup.exact_dedup(docs, history, "name", "body").collect()
        assert sorted((r._id or "", r.keep_id, r.group_size) for r in got) == [
            ("", "c", 5), ("a", "c", 5), ("b", "c", 5), ("c", "c", 5), ("c", "c", 5), ("d", "e", 2), ("e", "e", 2), ("f", "f", 1)]
        assert sorted(r._id for r in got if r.kept) == ["c", "e", "f"]
