"""Queries: report sections as typed tables of a stored run, and runs re-activated from the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import evaluate as EV
from marquee.operators.gram import grams, solve, total
from marquee.plans import q_model as QM
from marquee.plans import reports as R
from marquee.plans.registry import ORACLE, query, rnd, tables
from marquee.session import scratch_path
from marquee.sources import artifacts as A
from marquee.sources.runstore import RunStore

RUN = "20240101-000000_report01"


def _store(spark):
    return RunStore(spark, scratch_path(spark, "runs"))


def _section(spark, sections, name):
    """Write one section in a run of its own and read it back from the committed run."""
    store = _store(spark)
    run = store.begin(RUN)
    R.store_sections(run, sections, [name])
    run.commit()
    return rnd(store.table(RUN, "reports", name))


def _licensing(spark, sf_dir):
    return tables(spark, sf_dir)["licensing"]


def _stored(spark, sf_dir):
    return tables(spark, sf_dir).stored("licensing")


def section_query(report, sections, name, sql=None, same_as=None):
    key = f"{report}_{name}"

    @query(key, sql)
    def run(spark, sf_dir):
        return _section(spark, sections(spark, sf_dir), name)
    run.__name__ = f"q_{key}"
    if same_as:
        ORACLE[key] = ORACLE[same_as]


def _eda(spark, sf_dir):
    return R.eda_sections(_licensing(spark, sf_dir))


def _eda_stored(spark, sf_dir):
    return R.eda_sections(_stored(spark, sf_dir))


def _visual(spark, sf_dir):
    return R.visual_sections(_licensing(spark, sf_dir))


def _model(spark, sf_dir):
    return R.model_sections(QM.predictions_long(spark, sf_dir))


def _profile(spark, sf_dir):
    return R.profile_sections(_licensing(spark, sf_dir))


def _profile_stored(spark, sf_dir):
    return R.profile_sections(_stored(spark, sf_dir))


_ROW = "license_id, title_id, title, release_year, territory, media, platform, window_start, window_end, round(units, 6) as units, round(price, 6) as price, currency"
_TOP = "from licensing where license_id is not null group by license_id order by count desc, value limit 20"
_BINS = ("with st as (select min({0}) as lo, max({0}) as hi from {1}), w as (select lo, (hi - lo) / 30.0 as width from st), "
         "c as (select cast(least(floor(({0} - lo) / width), 29) as integer) as bin, count(*) as n from {1}, w where {0} is not null group by 1), "
         "g as (select cast(range as integer) as bin from range(30)) select g.bin, round(lo + g.bin * width, 6) as lo, "
         "round(lo + (g.bin + 1) * width, 6) as hi, cast(coalesce(c.n, 0) as bigint) as count from g cross join w left join c on g.bin = c.bin")
_CORR = " union all ".join(f"select '{a}' as col_a, '{b}' as col_b, round(corr({a}, {b}), 6) as corr from licensing"
                           for a in ("release_year", "units", "price") for b in ("release_year", "units", "price"))
_ENSEMBLES = ("select model, " + QM._r(["RMSE", "MAE", "R2"]) + f" from (select 'average' as model, {QM._METRICS} from (select row_id, any_value(y_true) as y_true, "
              f"avg(y_pred) as y_pred from preds group by row_id) a union all select 'weighted_inverse_rmse', {QM._METRICS} from (select row_id, "
              "any_value(y_true) as y_true, sum(weight * y_pred) as y_pred from preds join w on preds.model = w.model group by row_id) b) t")

section_query("report_eda", _eda_stored, "describe", same_as="describe_all")
section_query("report_eda", _eda, "preview", f"select {_ROW} from licensing order by license_id nulls first limit 25")
section_query("report_eda", _eda, "histogram", _BINS.format("cast(release_year as double)", "licensing"))
section_query("report_eda", _eda, "top_values", f"select license_id as value, count(*) as count {_TOP}")
section_query("report_visual", _visual, "scatter", "select release_year as x, round(units, 6) as y from licensing where release_year is not null and units is not null")
section_query("report_visual", _visual, "corr", _CORR)
section_query("report_model", _model, "metrics", same_as="regression_metrics")
section_query("report_model", _model, "ensembles", QM._PRED_CTE + QM._W_CTE + _ENSEMBLES)
section_query("report_model", _model, "residuals", same_as="residuals")
section_query("report_model", _model, "residual_histogram", QM._PRED_CTE + ", r as (select y_true - y_pred as e from preds), " + _BINS.format("e", "r")[5:])
section_query("report_model", _model, "actual_vs_pred", same_as="actual_vs_pred")
section_query("eda_profile", _profile, "shape", same_as="shape")
section_query("eda_profile", _profile, "missing", same_as="missing_counts")
section_query("eda_profile", _profile_stored, "describe", same_as="describe_all")
section_query("eda_profile", _profile, "corr_numeric", _CORR.replace(", 6)", ", 3)"))
section_query("eda_profile", _profile, "sample_head", f"select {_ROW} from licensing order by license_id nulls first limit 10")
section_query("eda_profile", _profile, "datetime_summary", " union all ".join(
    f"select '{c}' as \"column\", count({c}) as count, min({c}) as min, max({c}) as max, "
    f"cast(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0) as bigint) as range_days, count(*) - count({c}) as missing from licensing"
    for c in ("window_start", "window_end")))
for _c in ("window_start", "window_end"):
    section_query("eda_profile", _profile, f"trend_{_c}", f"select cast(date_trunc('month', {_c}) as timestamp) as period_start, count(*) as count "
                  f"from licensing where {_c} is not null group by 1 order by 1")


_PRED = "(select count(*) from preds)"


@query("report_full_sections", QM._PRED_CTE + "select section, cast(rows as bigint) as rows from (" + " union all ".join(
    f"select '{k}' as section, {v} as rows" for k, v in {
        "eda_describe": "12", "eda_preview": "(select least(25, count(*)) from licensing)", "eda_histogram": "30",
        "eda_top_values": "(select least(20, count(distinct license_id)) from licensing)",
        "visual_scatter": "(select count(*) from licensing where release_year is not null and units is not null)", "visual_corr": "9",
        "model_metrics": "3", "model_ensembles": "2", "model_residuals": _PRED, "model_residual_histogram": "30",
        "model_actual_vs_pred": _PRED, "meta": "1"}.items()) + ") t")
def q_report_full_sections(spark, sf_dir):
    """All sections of the full report written in one run; the committed run's tables and rows."""
    store = _store(spark)
    run = store.begin(RUN)
    R.store_sections(run, R.full_sections(_stored(spark, sf_dir), QM.predictions_long(spark, sf_dir), RUN))
    run.commit()
    return store.manifest().select(F.col("name").alias("section"), "rows")


# ---------------------------------------------------------------- stored model runs

def _model_store(spark, sf_dir):
    """One committed run, that run committed again with its models, and a run that never commits."""
    store = _store(spark)
    tr, va = QM._split(spark, sf_dir)
    pred = QM.predictions_long(spark, sf_dir)
    first = store.begin("20240101-000000_modelrun")
    first.put("models", "metrics", EV.regression_metrics(pred.limit(0)))
    first.commit()
    run = store.begin("20240101-000000_modelrun")
    g = total(grams(tr, QM.FEATS, "y"))
    for name, x in QM.ONE.items():
        run.put_model(name, solve(g.of([x]), "linear"))
    kept = run.put("models", "predictions", pred)
    run.put("models", "metrics", EV.regression_metrics(kept))
    run.put("models", "ensembles", EV.regression_metrics(EV.ensemble_average(kept)).unionByName(EV.regression_metrics(EV.ensemble_weighted(kept))))
    run.put_params({"target": "l_extendedprice", "features": QM.ONE, "seed": 42})
    run.commit()
    store.begin("20240202-000000_brokenoff").put("models", "metrics", EV.regression_metrics(kept))
    return store, va


@query("run_store_metrics", QM._PRED_CTE + QM._W_CTE + f", m2 as (select model, {QM._METRICS} from preds group by model) "
       f"select model, {QM._r(['RMSE', 'MAE', 'R2'])} from m2 union all {_ENSEMBLES}")
def q_run_store_metrics(spark, sf_dir):
    """Metrics and ensembles of the re-activated run."""
    store, _ = _model_store(spark, sf_dir)
    run = store.activate("20240101-000000_modelrun")
    return rnd(run.tables["models/metrics"].unionByName(run.tables["models/ensembles"]))


@query("run_store_predictions", QM._PRED_CTE + "select row_id, model, round(y_true, 4) as y_true, round(y_pred, 4) as y_pred from preds")
def q_run_store_predictions(spark, sf_dir):
    """Held-out rows predicted anew by the models of the re-activated run, named by its parameters."""
    store, va = _model_store(spark, sf_dir)
    run = store.activate("20240101-000000_modelrun")
    out = None
    for name in run.params["features"]:
        p = run.models[name].transform(va).select("row_id", F.lit(name).alias("model"), F.col("y").alias("y_true"), F.col("prediction").alias("y_pred"))
        out = p if out is None else out.unionByName(p)
    return rnd(out, 4)


@query("run_store_catalog", QM._PRED_CTE + "select '20240101-000000_modelrun' as run_id, 'MODELED' as stage, cast(7 as bigint) as artefacts, "
       "cast((select count(*) from preds) + 3 + 2 + 3 + 3 * 2 as bigint) as rows")
def q_run_store_catalog(spark, sf_dir):
    """Runs and stages that the store shows: the run that broke off is not among them."""
    store, _ = _model_store(spark, sf_dir)
    sizes = store.manifest().groupBy("run_id").agg(F.count(F.lit(1)).alias("artefacts"), F.sum("rows").alias("rows"))
    return A.run_stage(A.run_catalog(store.listing())).select("run_id", "stage").join(sizes, "run_id")
