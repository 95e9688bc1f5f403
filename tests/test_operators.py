"""Edge cases with literal expected values (pandas semantics of the reference)."""
import math

import pytest
from pyspark.sql import functions as F

from marquee.functions.stats import chi2_sf, f_sf
from marquee.functions.text import normalize_category, normalize_title
from marquee.operators import clean as C
from marquee.operators import encode as E
from marquee.operators import linkage as L
from marquee.operators import profile as P
from marquee.operators import rank as RK
from marquee.operators import validate as V
from marquee.sources import artifacts as A


def test_normalize_title_order_of_steps(spark):
    df = spark.createDataFrame([(" The__Matrix!  Reloaded ",), (None,), ("Ünïcödé_Tïtle — 2",), ("a - b",)], "t string")
    out = [r[0] for r in df.select(normalize_title("t")).collect()]
    assert out == ["the matrix reloaded", "", "ünïcödé tïtle  2", "a  b"]


def test_normalize_category(spark):
    df = spark.createDataFrame([(" nan ",), (None,), ("",), (" tv ",)], "c string")
    assert [r[0] for r in df.select(normalize_category("c")).collect()] == ["UNKNOWN", "UNKNOWN", "", "TV"]


def test_pct_rank_avg_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 20.0), (1, 30.0)], "g int, v double")
    got = sorted(r[0] for r in df.select(RK.pct_rank_avg(F.col("v"), ["g"])).collect())
    assert got == [0.25, 0.625, 0.625, 1.0]


def test_pct_rank_global_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 97).cast("double").alias("v"))
    a = RK.pct_rank_global(df, "v", "p").groupBy("v").agg(F.first("p").alias("p"))
    b = df.select("v", RK.pct_rank_avg(F.col("v"), None).alias("q")).distinct()
    j = a.join(b, "v").where(F.abs(F.col("p") - F.col("q")) > 1e-12)
    assert j.count() == 0


def test_hist_quantiles_equal_exact(spark):
    df = spark.range(0, 3001).select(((F.col("id") * 7919) % 1009).cast("double").alias("x"))
    exact = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in [0.1, 0.25, 0.5, 0.9]]))).first()[0]
    hist = P.quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9])["x"]
    assert all(abs(a - b) < 1e-9 for a, b in zip(exact, hist))


def test_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    rows = {(r.col_a, r.col_b): r.corr for r in P.corr_matrix(df).collect()}
    assert rows[("a", "b")] is None and rows[("b", "b")] == 1.0


def test_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (2,)], "v int")
    assert P.mode_value(df, "v").first()[0] == 1


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    h = P.histogram(df, "x", 10).orderBy("bin").collect()
    assert h[0].lo == 4.5 and h[-1].hi == 5.5 and sum(r["count"] for r in h) == 4


def test_impute_all_null_and_mode(spark):
    df = spark.createDataFrame([(None, "b", 1.0), (None, "a", None), (None, "b", 3.0), (None, None, None)],
                               "z string, s string, x double")
    out = C.impute(df, "median").collect()
    assert [r.z for r in out] == [None] * 4
    assert [r.s for r in out] == ["b", "a", "b", "b"]
    assert [r.x for r in out] == [1.0, 2.0, 3.0, 2.0]


def test_scale_constant_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [r.x for r in C.scale_standard(df, ["x"]).collect()] == [0.0, 0.0, None]
    assert [r.x for r in C.scale_minmax(df, ["x"]).collect()] == [0.0, 0.0, None]


def test_dedup_keeps_null_keys_and_most_complete(spark):
    df = spark.createDataFrame([("k", "r1", None), ("k", "r2", 1.0), (None, "r3", None), (None, "r4", None)],
                               "key string, id string, v double")
    got = sorted(r.id for r in C.dedup_most_complete(df, "key", ["id"]).collect())
    assert got == ["r2", "r3", "r4"]


def test_dedup_latest_all_null_keeps_first(spark):
    df = spark.createDataFrame([("k", "b", None), ("k", "a", None)], "key string, id string, window_end timestamp")
    assert [r.id for r in C.dedup_latest(df, "key", ["id"]).collect()] == ["a"]


def test_ordinal_unknown_is_minus_one(spark):
    df = spark.createDataFrame([("lo",), ("hi",), ("zz",), (None,)], "c string")
    assert [r.c for r in E.ordinal(df, {"c": ["lo", "hi"]}).collect()] == [0, 1, -1, -1]


def test_one_hot_levels_and_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    out = E.one_hot(df, ["c"])
    assert out.columns == ["c_A", "c_B", "c_UNKNOWN"]
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def test_schema_validate_collects_all_failures(spark):
    df = spark.createDataFrame([("tt1", "2001", "-5"), ("tt2", "x", "3.0"), ("tt3", None, "0")],
                               "tconst string, release_year string, price string")
    res = V.schema_validate(df)
    assert res.status == "failed" and "tconst" in res.frame.columns
    got = sorted((r.column, r.check, r.failure_case) for r in res.failures.collect())
    assert got == [("price", "greater_than(0)", "-5"), ("price", "greater_than(0)", "0"),
                   ("release_year", "coerce_dtype('int64')", "x")]


def test_method_rank_parity_quirk(spark):
    m = spark.createDataFrame([("L1", "t1", L.META_METHOD, 0.9), ("L1", "t2", "fuzzy_title_norm_year", 0.95)],
                              "license_id string, title_id string, method string, match_score double")
    assert L.rank_entity_map(m, mode="intended").first().title_id == "t1"
    assert L.rank_entity_map(m, mode="parity").first().title_id == "t2"   # both rank 1, higher score wins


def test_resolve_entities_threshold_and_blocks(spark):
    cand = spark.createDataFrame(
        [("a", 2000, None, 10), ("b", 2000, "US", 50), ("c", 2001, None, 5), ("d", 1990, "US", 999)],
        "title_id string, releaseYear long, region string, numVotes long")
    rows = spark.createDataFrame([("L1", 2000, "USA"), ("L2", None, "BRA"), ("L3", 1980, "USA")],
                                 "license_id string, release_year long, territory string")
    out = {r.license_id: r for r in L.resolve_entities(rows, cand, snapshot=False).collect()}
    # L1: block {a,b,c}; b: exact year (0.6) + top votes (0.3) + region (0.01) = 0.91
    assert out["L1"].title_id == "b" and abs(out["L1"].match_score - 0.91) < 1e-12
    # L2: no year test, unmapped territory: every candidate; d has the most votes and a region
    assert out["L2"].title_id == "d"
    # L3: empty block
    assert out["L3"].method == "no_match" and out["L3"].title_id is None


def test_resolve_plan_has_no_cartesian(spark):
    cand = spark.createDataFrame([("a", 2000, None, 10)], "title_id string, releaseYear long, region string, numVotes long")
    rows = spark.createDataFrame([("L1", 2000, "USA"), ("L2", None, None)],
                                 "license_id string, release_year long, territory string")
    plan = L.resolve_entities(rows, cand)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_source_role_quirk():
    assert A.source_role("deals", ["license_id", "title", "price"], "parity") == "akas"
    assert A.source_role("deals", ["license_id", "title", "price"], "intended") is None
    assert A.auto_roles({"deals": ["title"], "title.basics": ["tconst"]}, "intended")["base"] == "deals"


def test_run_stage_parse(spark):
    cat = spark.createDataFrame([("20240102-030405_abcd1234", False, False, True, False),
                                 ("bad", True, False, False, False), ("20240102_030405_x", False, False, False, True)],
                                "run_id string, has_raw boolean, has_feature_master boolean, "
                                "has_feature_master_cleaned boolean, has_model boolean")
    out = {r.run_id: r for r in A.run_stage(cat).collect()}
    assert out["20240102-030405_abcd1234"].stage == "CLEANED"
    assert out["20240102-030405_abcd1234"].created_label == "Jan 02, 2024 03:04 AM"
    assert out["bad"].created is None and out["bad"].stage == "STAGED"
    assert out["20240102_030405_x"].stage == "MODELED"


def test_list_files_and_catalog(spark, tmp_path):
    from marquee.sources import io as IO
    df = spark.createDataFrame([(1, 3), (2, 4)], "a long, b long")
    root = str(tmp_path)
    IO.write_parquet(df, f"{root}/processed", "20240101-000000_aaaa", "feature_master_20240101-000000_aaaa")
    IO.write_parquet(df, f"{root}/raw", "20240101-000000_aaaa", "deals")
    back = spark.read.parquet(f"{root}/processed/20240101-000000_aaaa/feature_master_20240101-000000_aaaa.parquet")
    assert sorted(tuple(r) for r in back.collect()) == [(1, 3), (2, 4)]
    listing = A.list_files(spark, {"processed": f"{root}/processed", "raw": f"{root}/raw"})
    cat = A.run_catalog(listing).first()
    assert cat.has_raw and cat.has_feature_master and not cat.has_model


def test_distribution_tails():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(f_sf(4.964602743730712, 1, 10) - 0.05) < 1e-8
    assert math.isclose(chi2_sf(0.0, 3), 1.0)


def test_ridge_matches_closed_form(spark):
    from marquee.operators import model as M
    df = spark.range(0, 200).select(F.col("id").cast("double").alias("x"),
                                    (F.col("id") * 3.0 + F.sin(F.col("id")) * 5).alias("y"))
    data, _ = M.feature_target(df, "y", ["x"])
    m = M.fit(M.ModelSpec("Ridge", "ridge", {"alpha": 10.0}), data)
    b, a = M.fit_ridge_1d(df, "x", "y", 10.0)
    assert abs(m.coefficients[0] - b) < 1e-6 and abs(m.intercept - a) < 1e-4


def test_json_and_csv_round_trips(spark, tmp_path):
    """Default options lose no row: JSON lines, doubled quotes, commas; line breaks by explicit option."""
    from marquee.sources import io as IO
    rows = [(i, f'say "{i}", then go', "a,b") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, said string, other string")
    path = IO.write_json(df, str(tmp_path), "r", "j")
    assert IO.read_any(spark, path).count() == 100
    out = IO.ingest_raw(spark, path, str(tmp_path), "run")
    assert spark.read.parquet(out).count() == 100
    path = IO.write_csv(df, str(tmp_path), "r", "c")
    assert sorted(map(tuple, IO.read_csv(spark, path, "id long, said string, other string").collect())) == rows
    f = tmp_path / "x.csv"
    f.write_text('id,said\n1,"two\nlines ""quoted"""\n2,plain\n')
    got = IO.read_csv(spark, str(f), "id long, said string", multiline=True).orderBy("id").collect()
    assert [r.said for r in got] == ['two\nlines "quoted"', "plain"]


def test_feature_target_says_what_it_drops(spark):
    from marquee.operators import model as M
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0), (3, 4.0, None)], "id long, x double, y double")
    with pytest.raises(Exception, match="on_missing"):
        M.feature_target(df, "y", ["x"], "id")[0].collect()
    data, _ = M.feature_target(df, "y", ["x"], "id", on_missing="drop")
    assert [r.id for r in data.collect()] == [1] and M.missing_rows(df, "y", ["x"]) == 2


def test_stacking_keeps_rows_of_repeated_keys(spark):
    from marquee.operators import model as M
    rows = [(i % 50, float(i), float(2 * i + i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    specs = [M.ModelSpec("a", "linear", {}), M.ModelSpec("b", "ridge", {"alpha": 1.0})]
    oof, _, predict = M.stacking_oof(df, "y", ["x"], "id", specs, k=3)
    assert oof.count() == 200 and predict(df).count() == 200


def test_one_hot_takes_any_number_of_levels(spark):
    from marquee.operators import encode as E
    df = spark.range(1500).selectExpr("cast(id as string) as c")
    assert len(E.one_hot(df, ["c"], normalise=False).columns) == 1500


def test_corr_matrix_of_a_hundred_columns(spark):
    cols = [(F.sin(F.col("id") * (i + 1)) + (F.lit(None) if i == 3 else F.lit(1e6))).alias(f"c{i}") for i in range(100)]
    df = spark.range(0, 300, 1, 4).select(*cols)
    got = {(r.col_a, r.col_b): r["corr"] for r in P.corr_matrix(df, places=None).collect()}
    assert len(got) == 100 * 100
    want = df.select(F.corr("c0", "c7")).first()[0]
    assert abs(got[("c0", "c7")] - want) < 1e-6 and got[("c0", "c7")] == got[("c7", "c0")]
    assert got[("c3", "c3")] is None and abs(got[("c5", "c5")] - 1.0) < 1e-12


def test_corr_matrix_uses_rows_where_both_are_present(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0), (float("nan"), 9.0), (4.0, 7.0)], "a double, b double")
    want = df.where("b is not null and not isnan(a)").select(F.corr("a", "b")).first()[0]
    got = {(r.col_a, r.col_b): r["corr"] for r in P.corr_matrix(df, places=None).collect()}
    assert abs(got[("a", "b")] - want) < 1e-12
    none = {(r.col_a, r.col_b): r["corr"] for r in P.corr_matrix(df.limit(0)).collect()}
    assert len(none) == 4 and set(none.values()) == {None}


def test_whisker_never_inside_the_box(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,)], "x double")
    r = P.box_stats(df, ["x"]).first()
    assert (r.q3, r.whisker_hi, r.fliers) == (27.25, 27.25, 1)


def test_percentile_rank_of_nan_is_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (None,)], "x double")
    got = {str(r.x): r.p for r in RK.pct_rank_global(df, "x", "p").collect()}
    assert got == {"1.0": 0.5, "2.0": 1.0, "nan": None, "None": None}


def test_one_hot_keeps_level_text_and_sparse_width(spark):
    df = spark.createDataFrame([("A B",), ("A-B",), (None,)], "c string")
    assert E.one_hot(df, ["c"], normalise=False).columns == ["c_A B", "c_A-B"]
    rows = E.one_hot_sparse(df, ["c"], normalise=False).collect()
    assert sorted(list(r.c_ohe.toArray()) for r in rows) == [[0.0, 0.0], [0.0, 1.0], [1.0, 0.0]]


def test_range_days_ignore_clock_changes(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 00:00:00' as t union all select timestamp_ntz'2024-03-11 00:00:00'")
        assert P.datetime_summary(df).first().range_days == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_report_items_hold_values(spark):
    from marquee.plans import reports as R
    df = spark.createDataFrame([(1.0, "a"), (3.0, None)], "x double, c string")
    got = {(r.section, r["item"]) for r in R.section_values(R.report_eda(df)).collect()}
    assert ("top_values", '{"value":"a","count":1}') in got
    assert ("preview", '{"x":3.0,"c":null}') in got


def test_times_without_a_zone_ignore_the_session_zone(spark):
    from marquee.functions.columns import epoch_micros
    df = spark.sql("select 'k' as key, 'a' as id, timestamp_ntz'2024-03-10 02:30:00.5' as window_end union all "
                   "select 'k', 'b', timestamp_ntz'2024-03-10 03:10:00' union all select null, 'c', null")
    before = spark.conf.get("spark.sql.session.timeZone")
    seen = set()
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):       # 02:30 did not exist in New York that day
            spark.conf.set("spark.sql.session.timeZone", zone)
            kept = sorted(r.id for r in C.dedup_latest(df, "key", ["id"]).collect())
            micros = [r[0] for r in df.where("id = 'a'").select(epoch_micros(df, "window_end")).collect()]
            top = [(r.column, r.min, r.max) for r in P.describe_all(df).collect() if r.column == "window_end"]
            filled = C.impute(df.where("id <> 'b'"), columns=["window_end"]).where("id = 'c'").select(F.col("window_end").cast("string")).first()[0]
            seen.add((*kept, *micros, *top, filled))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert seen == {("b", "c", 1710037800500000, ("window_end", 1710037800.5, 1710040200.0), "2024-03-10 02:30:00.5")}


def test_too_many_levels_point_to_the_sparse_encoder(spark):
    df = spark.range(30).selectExpr("cast(id as string) as c")
    with pytest.raises(ValueError, match="one_hot_sparse"):
        E.one_hot(df, ["c"], max_levels=29)
    assert len(E.one_hot(df, ["c"], max_levels=30).columns) == 30


def test_feature_build_finds_roles(spark):
    from marquee.plans.features import feature_build
    deals = spark.createDataFrame([("L1", "tt1", "One", 2000, "USA", 5.0), ("L2", None, "Two", 2000, "USA", 6.0)],
                                  "license_id string, tconst string, title string, release_year long, territory string, price double")
    basics = spark.createDataFrame([("tt1", "movie", "One", 2000, 90, "g")], "tconst string, titleType string, primaryTitle string, startYear long, runtimeMinutes int, genres string")
    ratings = spark.createDataFrame([("tt1", 7.0, 99)], "tconst string, averageRating double, numVotes long")
    akas = spark.createDataFrame([("tt1", "Uno", "US", None)], "titleId string, title string, region string, language string")
    staged = {"x": akas, "deals": deals, "y": ratings, "z": basics}
    got = {r.license_id: (r.title_id, r.method) for r in feature_build(staged).collect()}
    assert got == {"L1": ("tt1", "id_exact"), "L2": (None, "no_match")}
    with pytest.raises(ValueError, match="two roles"):
        feature_build({"deals": deals})
    with pytest.raises(ValueError, match="no staged table"):
        feature_build(staged, {"akas": "elsewhere"})
