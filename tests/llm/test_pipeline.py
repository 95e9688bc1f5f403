"""Stages of the pipeline against plain Python: what each keeps, how often, and where it goes."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_corpus import SPACE, hits
from test_dedup import groups


def as_rows(df, cols=("doc_id", "text")):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    items = [(1, rows[12][1]), (2, "solo"), (3, None), (4, " ".join(rows[5][1].split()[3:40]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def test_near_duplicates_keep_the_least_of_each_group(spark, docs, rows):
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    component = groups(rows, 5, 4, 5)
    assert as_rows(kept) == Counter((r[0], r[1]) for r in rows if component[r[0]][1] == r[0])


def test_decontamination_keeps_clean_documents(spark, docs, rows, folder):
    d, items = folder
    kept = corpus_pipeline.decontaminate(spark, docs, d)
    want = Counter((r[0], r[1]) for r in rows if not hits(r[1], items)[3])
    assert as_rows(kept) == want and 0 < len(want) < len(rows)


def shares(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by repeated sharing: whatever exceeds a cap goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left = set(), sum(sizes.values()) * share
    while True:
        rest = [s for s in names if s not in full]
        level = (left - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if level * w[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in names}
        full |= set(over)


def test_mix_plays_sources_by_their_shares(spark, docs, rows):
    count = lambda t: len(SPACE.findall(t or ""))
    out = corpus_pipeline.mix(spark, docs, "")
    got = as_rows(out, ("doc_id",))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    target = shares(sizes)
    for source, goal in target.items():
        mine = [r for r in rows if r[3] == source]
        played = sum(got[(r[0],)] * count(r[1]) for r in mine)
        # a document that is played in part comes whole: one begins and one ends each round
        slack = 4 * max(count(r[1]) for r in mine) + 1024
        assert abs(played - goal) <= slack, (source, played, goal)
    for r in rows:
        n = count(r[1])
        assert got[(r[0],)] == 1 if n == 0 else got[(r[0],)] <= 3
    assert out.columns == docs.columns


def test_shards_match_the_mixture(spark, docs, rows):
    doubled = docs.unionByName(docs)       # rows that repeat wholly are dealt like others
    out = corpus_pipeline.shard(spark, doubled, "")
    got = out.collect()
    assert as_rows(out) == Counter({(r[0], r[1]): 2 for r in rows})
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert len(mine) in (len(got) // 8, -(-len(got) // 8)) and sorted(r.slot for r in mine) == list(range(len(mine)))
        for source, n in Counter(r[3] for r in rows).items():
            assert abs(sum(r.source == source for r in mine) - 2 * n / 8) <= 2
    again = corpus_pipeline.shard(spark, doubled.repartition(5), "")
    assert as_rows(again, ("shard", "slot")) == as_rows(out, ("shard", "slot"))


def test_stages_take_any_id(spark, rows, folder):
    d, _ = folder
    text = spark.createDataFrame([(f"id {i % 9}", *r[1:]) for i, r in enumerate(rows[:20])] + [(None, "no id", *rows[0][2:])],
                                 "doc_id string, text string, lang string, source string, n_chars long, uid string, key string, size string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, text, d)
        assert out.columns[:len(text.columns)] == text.columns
        assert {r[0] for r in out.select(F.col("doc_id")).distinct().collect()} <= {r[0] for r in text.select("doc_id").collect()}
