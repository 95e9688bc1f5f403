"""Runs are visible once committed, whole, by version; models come back as they were."""
import pytest
from pyspark.sql import functions as F

from marquee.operators import gram as G
from marquee.operators import model as M
from marquee.plans import reports as R
from marquee.sources import artifacts as A
from marquee.sources.runstore import RunStore


def test_only_committed_runs_exist(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    assert store.manifest().count() == 0 and store.listing().collect() == []
    half = store.begin("20240101-000000_a")
    half.put("models", "metrics", spark.range(3))
    assert store.manifest().count() == 0
    with pytest.raises(KeyError, match="no committed run"):
        store.activate("20240101-000000_a")
    half.commit()
    first = store.activate("20240101-000000_a")
    assert first.tables["models/metrics"].count() == 3
    again = store.begin("20240101-000000_a")
    again.put("models", "metrics", spark.range(5).withColumn("note", F.lit("x")))
    again.put("raw", "deals", spark.range(1))
    assert store.activate("20240101-000000_a").attempt == first.attempt
    again.commit()
    second = store.activate("20240101-000000_a")
    assert second.attempt != first.attempt and second.tables["models/metrics"].columns == ["id", "note"]
    old = store.table("20240101-000000_a", "models", "metrics", first.attempt)
    assert old.count() == 3 and store.history().count() == 3 and store.manifest().count() == 2
    assert [(r.stage, r.run_id) for r in A.run_stage(A.run_catalog(store.listing())).collect()] == [("MODELED", "20240101-000000_a")]
    with pytest.raises(ValueError, match="no such root"):
        again.put("elsewhere", "x", spark.range(1))
    with pytest.raises(ValueError, match="already"):
        again.put("raw", "deals", spark.range(1))
    with pytest.raises(KeyError, match="has no"):
        store.table("20240101-000000_a", "raw", "nothing")


def test_models_and_params_come_back(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("odd name"),
                                 (F.col("id") * 2.0 + F.col("id") % 7 * 3 + 1).alias("y"))
    fit = G.solve(G.total(G.grams(df, ["a", "odd name"], "y")), "linear")
    data, _ = M.feature_target(df, "y", ["a"])
    tree = M.fit(M.ModelSpec("t", "gbt", {"maxIter": 2, "maxDepth": 2}), data)
    store = RunStore(spark, str(tmp_path / "s"))
    run = store.begin("r")
    run.put_model("line", fit)
    run.put_model("trees", tree)
    run.put_params({"alpha": 0.5, "features": ["a", "é"], "none": None})
    run.put("processed", "parts", df.withColumn("k", F.col("a") % 3), partition_by=["k"])
    run.commit()
    back = store.activate("r")
    assert back.params == {"alpha": 0.5, "features": ["a", "é"], "none": None}
    assert back.models["line"] == fit
    rows = lambda m: [r.prediction for r in m.transform(data).collect()]
    assert rows(back.models["trees"]) == rows(tree)
    assert back.tables["processed/parts"].columns == ["a", "odd name", "y", "k"] and back.tables["processed/parts"].count() == 100


def test_report_sections_keep_their_types(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a", None), (3.0, None, None)], "x double, c string, t timestamp_ntz")
    store = RunStore(spark, str(tmp_path / "s"))
    run = store.begin("r")
    R.store_sections(run, R.eda_sections(df))
    R.store_sections(run, {f"profile_{k}": v for k, v in R.profile_sections(df).items()})
    run.commit()
    back = store.activate("r").tables
    assert back["reports/preview"].schema == df.schema and back["reports/preview"].count() == 2
    assert [tuple(r) for r in back["reports/top_values"].collect()] == [("a", 1)]
    assert back["reports/profile_trend_t"].count() == 0
    assert set(back) == {f"reports/{k}" for k in ("describe", "preview", "histogram", "top_values")} | {
        f"reports/profile_{k}" for k in ("shape", "dtypes", "missing", "describe", "corr_numeric", "sample_head", "datetime_summary", "trend_t")}
