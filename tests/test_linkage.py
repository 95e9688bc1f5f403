"""Title join against brute force, the candidate lattice, heads of sources, ranks by group."""
import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import linkage as L
from marquee.operators import rank as RK
from marquee.sources import io as IO


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def titles(r, n, alphabet="abc é"):
    out = ["", "a", "ab"]
    while len(out) < n:
        t = r.choice(out)
        if r.random() < 0.12:
            t = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 25)))
        for _ in range(r.choice([0, 0, 1, 1, 3])):
            k = r.randrange(len(t) + 1)
            t = r.choice([t[:k] + r.choice(alphabet) + t[k:], t[:k] + t[k + 1:], t[:k] + r.choice(alphabet) + t[k + 1:]])
        out.append(t)
    return out


@pytest.mark.parametrize("threshold,slack", [(0.9, 0), (0.75, 1), (0.51, 0), (1.0, 0), (0.6, 2)])
def test_title_join_is_brute_force(spark, threshold, slack):
    r = random.Random(int(threshold * 100))
    left = [(f"L{i}", t, r.choice([2000, 2001, 2003, None])) for i, t in enumerate(titles(r, 90))] + [("Ln", None, 2000)]
    right = [(f"t{i}", t, r.choice([2000, 2001, 2002, None])) for i, t in enumerate(titles(r, 30) + [x[1][:9] + "b" + x[1][9:] if k % 2 else x[1] for k, x in enumerate(left[:60])])] + [("t5", "ab", 2000), ("tn", None, 2000)]
    a = spark.createDataFrame(left, "license_id string, title_norm string, release_year long")
    b = spark.createDataFrame(right, "title_id string, title_norm string, releaseYear long")
    got = L.title_similarity_join(a, b, threshold, slack)
    want = set()
    for i, s, y in left:
        for j, t, z in right:
            if None not in (s, t, y, z) and abs(y - z) <= slack:
                most = max(len(s), len(t))
                sim = 1.0 if most == 0 else 1.0 - edits(s, t) / most
                if sim >= threshold:
                    want.add((i, j, round(sim, 6)))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_title_candidates_grow_with_the_rows(spark, monkeypatch):
    """One year holds all titles; what is compared grows like the titles, not like their square."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 9))) for _ in range(3000)]

    def compared(n):
        made = [" ".join(r.choice(words) for _ in range(4)) for _ in range(n)]
        df = spark.createDataFrame([(2000, t) for t in made], "j_year long, t string")
        seen = []
        monkeypatch.setattr(L, "title_similarity", lambda a, b: seen.append(1) or F.lit(1.0))
        pairs = L.similar_titles(df.withColumnRenamed("t", "l_title"), df.withColumnRenamed("t", "r_title"), 0.9)
        assert seen
        return pairs.count()
    a, b = compared(1000), compared(4000)
    assert a < 3000 and b < 8 * a


def test_candidates_are_read_once(spark, tmp_path):
    path = str(tmp_path / "candidates")
    cand = [("a", 2000, None, 10), ("b", 2000, "US", 50), ("c", None, "US", 7), ("d", 1990, "FR", 999)]
    spark.createDataFrame(cand, "title_id string, releaseYear long, region string, numVotes long").write.parquet(path)
    rows = spark.createDataFrame([("L1", 2000, "USA"), ("L2", None, None), ("L3", None, "USA"), ("L4", 1990, "BRA")],
                                 "license_id string, release_year long, territory string")
    out = L.resolve_entities(rows, spark.read.parquet(path), snapshot=False)
    assert path not in out._jdf.queryExecution().toString()        # the plan reads the written roll-up alone
    assert {r.license_id: r.title_id for r in out.collect()} == {"L1": "b", "L2": "d", "L3": "b", "L4": "d"}


def files_read(df):
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        m = node.metrics()
        if m.contains("numFiles"):
            found.append(m.apply("numFiles").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return sum(found)


def test_head_is_in_source_order(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    for k in range(6):
        spark.range(k * 100, k * 100 + 100, 1, 1).select("id", (F.col("id") * 2).alias("w")).sortWithinPartitions(F.desc("id")).write.mode("append").parquet(path)
    files = sorted(spark.read.parquet(path).select("_metadata.file_path").distinct().collect())
    order = [r.id for f in files for r in spark.read.parquet(f.file_path).collect()]
    for n in (0, 1, 100, 150, 599, 600, 5000):
        head = IO.scan_head(spark.read.parquet(path), n, ["id"])
        assert head.columns == ["id"] and sorted(r.id for r in head.collect()) == sorted(order[:n])
    assert files_read(IO.scan_head(spark.read.parquet(path), 150, ["id"])) == 2
    ordered = IO.scan_head(spark.read.parquet(path), 3, ["id"], ["id"])
    assert [r.id for r in ordered.collect()] == [0, 1, 2]
    csv = str(tmp_path / "t.csv")
    spark.range(0, 500, 1, 3).write.csv(csv)
    lines = [r.file_path for r in sorted(spark.read.text(csv).select("_metadata.file_path").distinct().collect())]
    first = [r.id for f in lines for r in spark.read.schema("id long").csv(f).collect()][:250]
    assert [r.id for r in IO.scan_head(spark.read.schema("id long").csv(csv), 250).collect()] == first
    with pytest.raises(ValueError, match="give an order"):
        IO.scan_head(spark.range(5), 2)


def test_rank_by_group_equals_the_window(spark):
    df = spark.range(0, 4000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 11).cast("string"))).alias("g"),
        F.when(F.col("id") % 50 == 7, None).otherwise((F.col("id") * 7919 % 601).cast("double")).alias("v"), "id")
    df = df.withColumn("g", F.when(F.col("id") % 97 == 0, None).otherwise(F.col("g")))
    got = {r.id: r.p for r in RK.pct_rank_by(df, "v", ["g"], "p").collect()}
    want = {r.id: r.p for r in df.select("id", RK.pct_rank_avg(F.col("v"), ["g"]).alias("p")).collect()}
    assert len(got) == 4000
    for k, v in want.items():
        assert (v is None and got[k] is None) or abs(v - got[k]) < 1e-12
