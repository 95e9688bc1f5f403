"""Stored models of the artefact query; licences are joined once a query, in an order that keeps their rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from marquee.plans import fixtures

TABLES = {
    "customer": ("c_custkey long, c_nationkey long, c_mktsegment string", [(1, 0, "A"), (2, 13, "B"), (2, 3, "B"), (None, 1, "C")]),
    "supplier": ("s_suppkey long, s_nationkey long", [(1, 0), (2, 5), (2, 5), (None, 2)]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int",
             [(k, f"name {k}", f"b{k % 3}", "t", 1) for k in range(1, 60)] + [(7, "name 7", "b9", "t", 2), (None, "n", "b", "t", 3)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", None),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                 "l_discount double, l_tax double, l_shipdate timestamp_ntz", None),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    day = F.timestamp_add("DAY", F.col("id").cast("int") % 700, F.lit("2020-01-01").cast("timestamp_ntz"))
    made = {k: spark.createDataFrame(rows, ddl) for k, (ddl, rows) in TABLES.items() if rows}
    o = spark.range(150)
    made["orders"] = o.select((F.col("id") % 140).alias("o_orderkey"), F.when(F.col("id") % 9 > 0, F.col("id") % 3).alias("o_custkey"), day.alias("o_orderdate"))
    k = F.col("id")
    made["lineitem"] = spark.range(1200).select(
        F.when(k % 50 > 0, k % 145).alias("l_orderkey"), F.when(k % 31 > 0, k % 61).alias("l_partkey"), (k % 4).alias("l_suppkey"), (k % 7).cast("int").alias("l_linenumber"),
        (k * 7 % 50).cast("double").alias("l_quantity"), (k * k % 997 + k * 7 % 50 * 3).cast("double").alias("l_extendedprice"),
        ((k % 11) / 100).alias("l_discount"), (k % 5 / 100).alias("l_tax"), day.alias("l_shipdate"))
    for name, df in made.items():
        df.write.parquet(f"{top}/{name}.parquet")
    return str(top)


def test_model_artifacts_predict_as_the_trained_model(spark, folder):
    got = E.queries()["model_artifacts"](spark, folder).collect()
    li = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_orderkey is not null")
    rows = np.array([[r.l_orderkey % 5 == 0, 1.0, r.l_quantity, r.l_discount, r.l_extendedprice] for r in li.collect()])
    train, valid = rows[rows[:, 0] == 0][:, 1:], rows[rows[:, 0] == 1][:, 1:]
    w = np.linalg.lstsq(train[:, :3], train[:, 3], rcond=None)[0]
    e = valid[:, 3] - valid[:, :3] @ w
    assert [r.model for r in got] == ["reloaded"]
    assert got[0].RMSE == pytest.approx(np.sqrt((e * e).mean()), abs=1e-5) and got[0].MAE == pytest.approx(abs(e).mean(), abs=1e-5)


@pytest.mark.parametrize("name", ["licensing", "title_akas"])
def test_views_in_another_join_order_keep_their_rows(spark, folder, name):
    t = fixtures.Tables(spark, folder)
    sql = fixtures.DOMAIN_VIEWS[name]
    used = [x for x in fixtures.DRIVER_TABLES if fixtures._mentions(sql, x)]
    plain = sql
    for x in used:
        plain = fixtures._bind(plain, x)
    plain = spark.sql(plain, **{x: t.raw(x) for x in used})
    assert t[name].schema == plain.schema and fixtures._SPARK_VIEWS[name] != sql
    assert sorted(map(str, t[name].collect())) == sorted(map(str, plain.collect())) and plain.count() > 50


@pytest.mark.parametrize("name", ["outliers_filter", "dedup_most_complete", "dedup_latest", "report_eda", "report_full", "popularity_blend",
                                  "eda_profile", "describe_all", "feature_master"])
def test_licences_are_joined_once(spark, folder, name):
    """The query's last plan reads the stored licences, not the orders behind them."""
    df = E.queries()[name](spark, folder)
    assert not [f for f in df.inputFiles() if "/orders.parquet" in f]
    df.count()


def test_rest_of_the_id_map_and_best_mapping(spark):
    """Licences that repeat, null licences and ids outside the catalogue: the rest is what no row of the licence matches."""
    from marquee.operators import linkage as L
    base = spark.createDataFrame([("a", "t1", 2001, "USA"), ("a", "tx", 2001, "USA"), ("b", "tx", 2001, "USA"), ("c", None, None, None),
                                  (None, "t1", 2001, "USA"), (None, "tx", 2001, "USA"), ("b", "tx", 2001, "USA")],
                                 "license_id string, title_id string, release_year long, territory string")
    core = spark.createDataFrame([("t1", "x", 2001, 5), ("t1", "x", 2001, 5)], "title_id string, title_norm string, releaseYear long, numVotes long")
    cand = core.withColumn("region", F.lit(None).cast("string"))
    for mode, rest in (("intended", ["None", "None", "b", "b", "c"]), ("parity", ["None", "None", "c"])):
        m = L.entity_mapping(base, core, cand, mode=mode)
        assert sorted(str(r.license_id) for r in m.where("method <> 'id_exact'").collect()) == rest
        assert m.where("method = 'id_exact'").count() == (2 if mode == "intended" else 5)
    ranked = {r.license_id: r for r in L.rank_entity_map(L.entity_mapping(base, core, cand)).collect()}
    assert set(ranked) == {"a", "b", "c", None} and ranked["a"].title_id == ranked[None].title_id == "t1" and ranked["a"].match_score == 1.0


def test_quantiles_move_few_values(spark):
    """Only values near a wanted rank are written for an exact quantile."""
    import math
    from unittest import mock

    from marquee.operators import profile as P
    n = 20_000
    df = spark.range(0, n, 1, 4).selectExpr("if(id % 3 = 0, 'a', 'b') as g", "cast((id * 7919) % 20011 as double) as x")
    df = df.unionByName(spark.createDataFrame([("few", float(i)) for i in (5, 1, 4)], "g string, x double"))
    written = []
    ranges = P.in_ranges

    def counted(hist, columns, buckets=None):
        h = ranges(hist, columns, buckets)
        written.append(h.count())
        return h
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    with mock.patch.object(P, "in_ranges", counted):
        got = P.group_quantiles(df, "g", "x", probs)
    values = {}
    for r in df.collect():
        values.setdefault(r.g, []).append(r.x)
    for g, xs in values.items():
        xs.sort()
        for p, q in zip(probs, got[g]):
            h = (len(xs) - 1) * p
            lo, hi = xs[math.floor(h)], xs[math.ceil(h)]
            assert q == lo + (h - math.floor(h)) * (hi - lo)
    assert sum(written) < n / 10


def test_quantiles_outside_their_bracket(spark):
    """A sketch that misses the rank changes nothing but the work."""
    from unittest import mock

    from marquee.operators import profile as P
    df = spark.range(5001).selectExpr("'a' as g", "cast(id * id as double) as x")
    wrong = lambda value, near, size: __import__("pyspark").sql.functions.expr(f"transform(array({','.join(map(str, near))}), p -> p + min(x))")
    with mock.patch.object(P.F, "percentile_approx", wrong):
        assert P.group_quantiles(df, "g", "x", [0.25, 0.5]) == {"a": [1250.0 ** 2, 2500.0 ** 2]}


def test_dedup_carries_the_columns_asked_for(spark):
    """a row's other columns count for its completeness but do not move."""
    from marquee.operators import clean as C
    df = spark.createDataFrame([("k", "b", "long text", 1), ("k", "a", None, 1), (None, "c", None, None), (None, "c", None, None), ("m", "z", None, 3)],
                               "key string, id string, note string, n int")
    out = C.dedup_most_complete(df, "key", ["id"], ["id", "key"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("b", "k"), ("c", None), ("c", None), ("z", "m")], key=str)
    assert "note" not in out._jdf.queryExecution().optimizedPlan().toString()
    whole = C.dedup_most_complete(df, "key", ["id"])
    assert whole.columns == df.columns and ("k", "b", "long text", 1) in map(tuple, whole.collect())
    zero = spark.createDataFrame([(-0.0, 1), (0.0, 2)], "k double, n int")
    assert str(C.dedup_latest(zero, "k", ["n"]).collect()[0].k) == "-0.0"


def test_permutation_goes_back(spark):
    """the bijection can be undone, so a row knows which rows get its values."""
    from pyspark.sql import functions as F

    from marquee.operators import model as M
    for n in (1, 7, 1000, 1024):
        keys = [F.lit(k).cast("long") for k in M.round_keys(11)]
        there, back = ([r[0] for r in M.with_image(spark.range(n), "id", n, keys, "t", back=way).orderBy("id").select("t").collect()] for way in (False, True))
        assert [back[t] for t in there] == list(range(n))


def test_a_rows_predictions_are_made_together(spark):
    """ensembles combine a row's predictions in one task, so the plan has no union of scans."""
    from marquee.plans import q_model as QM
    plan = QM.predictions_long(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1


def test_alignment_decides_on_marked_pages(spark):
    """a teaser marked as an article on every page is no article of the page; equal paragraphs of two articles stay."""
    from marquee.llm import html_extract as H
    card = "<article><h3>Our summer offer</h3><p>Read it now</p></article>"
    story = lambda i: f"<h1>Story {i}</h1><p>Number {i} is told here at length, which takes {i * 37} words</p><p>Equal in all</p>"
    text = lambda i: f"Story {i}\nNumber {i} is told here at length, which takes {i * 37} words\nEqual in all"
    rows = [(i, f"http://main.example/{i}", f"<main>{story(i)}{card}</main>") for i in range(4)]
    rows += [(10 + i, f"http://div.example/{i}", f"<div>{story(i)}</div>{card}") for i in range(4)]
    rows += [(20 + i, f"http://copy.example/{i}", f"<main>{story(1)}</main>") for i in range(4)]
    rows += [(30, "http://lone.example/1", f"<main>{story(1)}{card}</main>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r._id: r.text for r in H.extract(pages).collect()}
    for i in range(4):
        assert got[i] == text(i) and got[20 + i] == text(1)
        assert got[10 + i] == text(i).removesuffix("\nEqual in all")
    assert got[30] == text(1) + "\nOur summer offer\nRead it now"


def test_single_licences_are_mapped_where_they_stand(spark, monkeypatch):
    """rows of one licence each do not move by licence; repeated and null ids give the same rows as before."""
    from marquee.operators import linkage as L
    from marquee.plans import features as FE
    from marquee.session import save_table
    basics = spark.createDataFrame([("tt1", "One", 2001, 10), ("tt2", "Two", 2002, 20), ("tt3", "Three", None, 30)], "tconst string, primaryTitle string, startYear int, runtimeMinutes int")
    ratings = spark.createDataFrame([("tt1", 7.0, 100), ("tt2", 6.0, 5)], "tconst string, averageRating double, numVotes long")
    akas = spark.createDataFrame([("tt1", "ONE", "US", None), ("tt2", "TWO", "GB", None)], "titleId string, title string, region string, language string")
    one = [("a", "tt1", "One", 2001, "USA"), ("b", None, "One", 2001, "USA"), ("c", "tt9", "None", 1900, "GBR"), ("d", None, "x", None, None), ("e", "tt2", None, None, "BRA")]
    more = [("r", "tt1", "r1", 2001, "USA"), ("r", None, "r2", 2001, "USA"), ("r", "tt9", "r3", 2002, "GBR"), ("s", None, "s1", 2001, "USA"), ("s", None, "s2", 1900, "GBR"),
            ("t", "tt2", "t", 2002, "GBR"), ("t", "tt2", "t", 2002, "GBR"), (None, "tt1", "n1", 2001, "USA"), (None, None, "n2", 2002, "GBR")]
    schema = "license_id string, title_id string, title string, release_year int, territory string"
    for rows in (one, more, one + more, []):
        base = save_table(spark.createDataFrame(rows, schema).repartition(2), "base")
        cat = FE.build_catalogue(basics, ratings, akas, store=True)
        for mode in ("intended", "parity"):
            plain, got = (FE.feature_master(base, cat, mode=mode, stored=s) for s in (False, True))
            assert got.columns == plain.columns and got.dtypes == plain.dtypes
            assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() == len(rows)
            with monkeypatch.context() as m:
                m.setattr(L, "REPEATED_IDS", 1)
                assert sorted(map(str, FE.feature_master(base, cat, mode=mode, stored=True).collect())) == sorted(map(str, plain.collect()))
    base = save_table(spark.createDataFrame(one, schema), "base")
    plan = FE.feature_master(base, cat, mode="parity", stored=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [license_id" not in plan and "(license_id#" not in plan.replace("isnotnull(license_id", "")


@pytest.mark.parametrize("mode", ["intended", "parity"])
def test_single_licences_move_by_title_once(spark, mode):
    """the id map and the winners bring the catalogue's columns; nothing but the blocks is written between. Same rows as by joins of their own."""
    from marquee.plans import features as FE
    from marquee.session import save_table
    basics = spark.createDataFrame([("tt1", "One", 2001, "movie"), ("tt2", "Two", 2002, "movie"), ("tt2", "Two", 2002, "movie")],
                                   "tconst string, primaryTitle string, startYear int, titleType string")
    ratings = spark.createDataFrame([("tt1", 7.0, 100)], "tconst string, averageRating double, numVotes long")
    akas = spark.createDataFrame([("tt8", "EIGHT", "GB", None)], "titleId string, title string, region string, language string")
    base = save_table(spark.createDataFrame([("a", "tt1", "own", 2002, "USA"), ("b", None, "by year", 2001, "USA"), ("c", "tt9", "by year", 2001, "USA"), ("d", "tt9", "none", 1900, "GBR"),
                                             ("e", None, "by region", None, "GBR"), ("f", "tt2", "twice", None, None), ("g", None, "any", None, None)],
                                            "license_id string, title_id string, title string, release_year int, territory string"), "base")
    cat = FE.build_catalogue(basics, ratings, akas, store=True)
    plain, got = (FE.feature_master(base, cat, mode=mode, stored=s) for s in (False, True))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.dtypes == plain.dtypes
    titles = {r.license_id: (r.title_id, r.primaryTitle) for r in got.collect()}
    assert titles["a"] == ("tt1", "One") and titles["f"] == ("tt2", "Two") and titles["d"] == ("tt9", None)
    assert (titles["b"], titles["c"]) == ((("tt1", "One"), ("tt1", "One")) if mode == "intended" else ((None, None), ("tt9", None)))
    assert not [f for f in got.inputFiles() if "/keyed/" in f]
