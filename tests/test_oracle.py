"""Spark queries vs their DuckDB oracle on the smallest driver tables."""
import duckdb
import pytest

from marquee.plans.fixtures import DRIVER_TABLES
from paths import SF_SMALL
from tools.oracle_check import rows_of

import __spark_entry__ as E

SAMPLE = ["catalog_core", "candidate_universe", "id_entity_map_parity", "resolve_entities", "rank_entity_map",
          "feature_master", "feature_master_parity", "territory_summary", "num_summary", "describe_all",
          "corr_matrix", "datetime_trend_weekly", "histogram", "box_stats", "month_box", "impute", "impute_report",
          "outliers_filter", "outliers_clip_report", "dedup_most_complete", "dedup_latest", "one_hot",
          "target_encode", "schema_validate", "regression_metrics", "ensemble_weighted", "qq_points",
          "run_stage", "scan_tsv", "normalize_title", "reference_price", "popularity_blend", "score_metadata"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    assert sorted(s_cols) == sorted(o_cols)
    assert rows_of(s_cols, s_rows) == rows_of(o_cols, res.fetchall())


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"territory", "licences", "avg_price", "hit_pct"} <= set(df.columns)
