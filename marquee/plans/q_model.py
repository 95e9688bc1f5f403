"""Queries: model training, predictions, metrics, ensembles, diagnostics, chart datasets.

Validation rows are ``l_orderkey % 5 = 0`` (the arithmetic split override, so
both engines see the same rows); target ``l_extendedprice``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import evaluate as EV
from marquee.operators import model as M
from marquee.operators import profile as P
from marquee.operators.gram import grams, solve, total
from marquee.plans import sqlmodel as Q
from marquee.plans.registry import query, rnd, tables

FEATS = ["l_quantity", "l_discount", "l_tax"]
ONE = {"ols_quantity": "l_quantity", "ols_discount": "l_discount", "ols_tax": "l_tax"}


def _li(spark, sf_dir):
    li = tables(spark, sf_dir)["lineitem"]
    return li.select(F.concat_ws("-", *[F.col(c).cast("string") for c in
                                         ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]]).alias("row_id"), "l_orderkey", *FEATS, F.col("l_extendedprice").alias("y"))


def predictions_long(spark, sf_dir):
    li = _li(spark, sf_dir)
    tr, va = li.where(F.col("l_orderkey") % 5 != 0), li.where(F.col("l_orderkey") % 5 == 0)
    made = []
    for name, x in ONE.items():
        b, a = M.fit_ols_1d(tr, x, "y")
        made.append(F.struct(F.lit(name).alias("model"), (F.lit(a) + F.lit(b) * F.col(x)).alias("y_pred")))
    # the models' predictions of a row are made together, so that ensembles combine them before they move
    out = va.select("row_id", F.col("y").alias("y_true"), F.explode(F.array(*made)).alias("p"))
    return out.select("row_id", "p.model", "y_true", "p.y_pred")


_PRED_CTE = (
    "with li as (select concat(cast(l_orderkey as varchar), '-', cast(l_partkey as varchar), '-', "
    "cast(l_suppkey as varchar), '-', cast(l_linenumber as varchar)) as row_id, "
    "l_orderkey, l_quantity, l_discount, l_tax, l_extendedprice as y from lineitem), "
    "tr as (select * from li where l_orderkey % 5 <> 0), va as (select * from li where l_orderkey % 5 = 0), "
    "coef as (select " + ", ".join(f"regr_slope(y, {x}) as b_{n}, regr_intercept(y, {x}) as a_{n}"
                                   for n, x in ONE.items()) + " from tr), "
    "preds as (" + " union all ".join(
        f"select row_id, '{n}' as model, y as y_true, a_{n} + b_{n} * {x} as y_pred from va, coef"
        for n, x in ONE.items()) + ") ")

_METRICS = ("sqrt(avg((y_true - y_pred) * (y_true - y_pred))) as RMSE, avg(abs(y_true - y_pred)) as MAE, "
            "case when var_pop(y_true) * count(*) > 0 then 1.0 - sum((y_true - y_pred) * (y_true - y_pred)) / "
            "(var_pop(y_true) * count(*)) end as R2")


def _r(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


@query("predictions_long", _PRED_CTE + "select row_id, model, round(y_true, 6) as y_true, round(y_pred, 6) as y_pred from preds")
def q_predictions_long(spark, sf_dir):
    return rnd(predictions_long(spark, sf_dir))


@query("regression_metrics", _PRED_CTE + f"select model, {_r(['RMSE', 'MAE', 'R2'])} from "
       f"(select model, {_METRICS} from preds group by model) t")
def q_regression_metrics(spark, sf_dir):
    return rnd(EV.regression_metrics(predictions_long(spark, sf_dir)))


@query("ensemble_average", _PRED_CTE + f"select model, {_r(['RMSE', 'MAE', 'R2'])} from (select 'average' as model, "
       f"{_METRICS} from (select row_id, any_value(y_true) as y_true, avg(y_pred) as y_pred from preds group by row_id) a) t")
def q_ensemble_average(spark, sf_dir):
    return rnd(EV.regression_metrics(EV.ensemble_average(predictions_long(spark, sf_dir))))


_W_CTE = (", m as (select model, 1.0 / (sqrt(avg((y_true - y_pred) * (y_true - y_pred))) + 1e-8) as inv "
          "from preds group by model), w as (select model, inv / sum(inv) over () as weight from m) ")


@query("ensemble_weights", _PRED_CTE + _W_CTE + "select model, round(weight, 6) as weight from w")
def q_ensemble_weights(spark, sf_dir):
    return rnd(EV.inverse_rmse_weights(predictions_long(spark, sf_dir)))


@query("ensemble_weighted", _PRED_CTE + _W_CTE + f"select model, {_r(['RMSE', 'MAE', 'R2'])} from ("
       f"select 'weighted_inverse_rmse' as model, {_METRICS} from (select row_id, any_value(y_true) as y_true, "
       f"sum(weight * y_pred) as y_pred from preds join w on preds.model = w.model group by row_id) a) t")
def q_ensemble_weighted(spark, sf_dir):
    return rnd(EV.regression_metrics(EV.ensemble_weighted(predictions_long(spark, sf_dir))))


@query("best_model", _PRED_CTE + f"select model, round(RMSE, 6) as RMSE from (select model, {_METRICS} from preds "
       "group by model) t order by RMSE, model limit 1")
def q_best_model(spark, sf_dir):
    return rnd(EV.best_model(EV.regression_metrics(predictions_long(spark, sf_dir))))


@query("residuals", _PRED_CTE + "select row_id, model, round(y_pred, 6) as pred, round(y_true - y_pred, 6) as resid from preds")
def q_residuals(spark, sf_dir):
    return rnd(EV.residuals(predictions_long(spark, sf_dir)))


@query("residual_histogram", _PRED_CTE +
       ", r as (select y_true - y_pred as e from preds where model = 'ols_quantity'), "
       "st as (select min(e) as lo, max(e) as hi from r), ww as (select lo, (hi - lo) / 30 as width from st), "
       "c as (select cast(least(floor((e - lo) / width), 29) as integer) as bin, count(*) as n from r, ww group by 1), "
       "g as (select cast(range as integer) as bin from range(30)) "
       "select g.bin, round(lo + g.bin * width, 6) as lo, round(lo + (g.bin + 1) * width, 6) as hi, "
       "cast(coalesce(c.n, 0) as bigint) as count from g cross join ww left join c on g.bin = c.bin")
def q_residual_histogram(spark, sf_dir):
    r = EV.residuals(predictions_long(spark, sf_dir)).where(F.col("model") == "ols_quantity")
    return rnd(P.histogram(r, "resid", 30))


@query("actual_vs_pred", _PRED_CTE + "select row_id, model, round(y_true, 6) as y_true, round(y_pred, 6) as y_pred, "
       "round(min(y_true) over (partition by model), 6) as line_min, "
       "round(max(y_true) over (partition by model), 6) as line_max from preds")
def q_actual_vs_pred(spark, sf_dir):
    return rnd(EV.actual_vs_pred(predictions_long(spark, sf_dir)))


_GRID = [(i + 1) / 20 for i in range(19)]


@query("qq_points", _PRED_CTE + "select model, round(p, 6) as p, round(theoretical, 6) as theoretical, "
       "round(sample, 6) as sample, round(slope, 6) as slope, round(intercept, 6) as intercept from ("
       + " union all ".join(
           f"select model, cast({g} as double) as p, cast({__import__('statistics').NormalDist().inv_cdf(g)!r} as double) as theoretical, "
           f"quantile_cont(y_true - y_pred, {g}) as sample, stddev_pop(y_true - y_pred) as slope, "
           f"avg(y_true - y_pred) as intercept from preds group by model" for g in _GRID) + ") t")
def q_qq_points(spark, sf_dir):
    return rnd(EV.qq_points(predictions_long(spark, sf_dir), points=19))


@query("format_metrics", _PRED_CTE + "select model, " + ", ".join(
    f"case when {c} is null then '—' when abs({c}) < 1e-4 and {c} <> 0 then printf('%.2e', {c}) "
    f"else printf('%.4f', {c}) end as {c}" for c in ["RMSE", "MAE", "R2"]) +
    f" from (select model, {_METRICS} from preds group by model) t")
def q_format_metrics(spark, sf_dir):
    return EV.format_metrics(EV.regression_metrics(predictions_long(spark, sf_dir)))


@query("breusch_pagan", _PRED_CTE +
       ", r as (select l_quantity as x, (y_true - y_pred) * (y_true - y_pred) as u from preds join va "
       "on preds.row_id = va.row_id where model = 'ols_quantity'), "
       "s as (select count(*) as n, corr(u, x) * corr(u, x) as r2 from r) "
       "select round(n * r2, 6) as LM, round(r2 / ((1 - r2) / (n - 2)), 6) as F from s")
def q_breusch_pagan(spark, sf_dir):
    li = _li(spark, sf_dir)
    p = predictions_long(spark, sf_dir).where(F.col("model") == "ols_quantity")
    j = p.join(li.select("row_id", "l_quantity"), "row_id").withColumn("e", F.col("y_true") - F.col("y_pred"))
    bp = EV.breusch_pagan(j, "e", ["l_quantity"])
    return rnd(spark.createDataFrame([(bp["LM"], bp["F"])], "LM double, F double"))


def _bp_sql(source: str) -> str:
    """LM and F of e^2 on the three features with their tail probabilities, by model, from rows with e2."""
    g = "(" + Q.gram3(source, "e2", by="model") + ") g"
    fit = Q.solve3(g, keep="model, n, m1, m2, m3, my, syy, c1, c2, c3")
    return (f"select model, LM, {Q.chi2_sf('LM', 3)} as LM_pvalue, F, {Q.f_sf('F', 3, 'n - 4')} as F_pvalue from ("
            f"select model, n, n * r2 as LM, (r2 / 3) / ((1 - r2) / (n - 4)) as F from ("
            f"select model, n, (w1 * c1 + w2 * c2 + w3 * c3) / syy as r2 from ({fit}) f) r) t")


_TEST_COLS = "round(LM, 6) as LM, round(LM_pvalue, 6) as LM_pvalue, round(F, 6) as F, round(F_pvalue, 6) as F_pvalue"


@query("breusch_pagan_pvalues", _PRED_CTE + ", e as (select 'm' as model, va.*, (y_true - y_pred) * (y_true - y_pred) as e2 from preds "
       "join va on preds.row_id = va.row_id where preds.model = 'ols_quantity'), bp as (" + _bp_sql("e") + f") select {_TEST_COLS} from bp")
def q_breusch_pagan_pvalues(spark, sf_dir):
    li = _li(spark, sf_dir)
    p = predictions_long(spark, sf_dir).where(F.col("model") == "ols_quantity")
    j = p.join(li.select("row_id", *FEATS), "row_id").withColumn("e", F.col("y_true") - F.col("y_pred"))
    bp = EV.breusch_pagan(j, "e", FEATS)
    return rnd(spark.createDataFrame([tuple(bp[k] for k in ["LM", "LM_pvalue", "F", "F_pvalue"])],
                                     "LM double, LM_pvalue double, F double, F_pvalue double"))


# ---------------------------------------------------------------- Spark ML fits

def _split(spark, sf_dir):
    li = _li(spark, sf_dir)
    return li.where(F.col("l_orderkey") % 5 != 0), li.where(F.col("l_orderkey") % 5 == 0)


@query("train_linear", "with tr as (select * from lineitem where l_orderkey % 5 <> 0) select "
       "round(regr_slope(l_extendedprice, l_quantity), 4) as slope, "
       "round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from tr")
def q_train_linear(spark, sf_dir):
    tr, _ = _split(spark, sf_dir)
    data, _ = M.feature_target(tr, "y", ["l_quantity"])
    m = M.fit(M.ModelSpec("LinearRegression", "linear", {}), data)
    return rnd(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double"), 4)


@query("train_ridge", "with tr as (select * from lineitem where l_orderkey % 5 <> 0), s as (select count(*) as n, "
       "covar_pop(l_quantity, l_extendedprice) as cxy, var_pop(l_quantity) as vx, avg(l_quantity) as mx, "
       "avg(l_extendedprice) as my from tr) select round(cxy * n / (vx * n + 1.0), 4) as slope, "
       "round(my - cxy * n / (vx * n + 1.0) * mx, 4) as intercept from s")
def q_train_ridge(spark, sf_dir):
    """Spark ML ridge with the sklearn-equivalent penalty, checked against the closed form."""
    tr, _ = _split(spark, sf_dir)
    data, _ = M.feature_target(tr, "y", ["l_quantity"])
    m = M.fit(M.ModelSpec("Ridge", "ridge", {"alpha": 1.0}), data)
    return rnd(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double"), 4)


@query("train_ridge_closed_form", "with tr as (select * from lineitem where l_orderkey % 5 <> 0), s as (select count(*) as n, "
       "covar_pop(l_quantity, l_extendedprice) as cxy, var_pop(l_quantity) as vx, avg(l_quantity) as mx, "
       "avg(l_extendedprice) as my from tr) select round(cxy * n / (vx * n + 1.0), 6) as slope, "
       "round(my - cxy * n / (vx * n + 1.0) * mx, 6) as intercept from s")
def q_train_ridge_closed_form(spark, sf_dir):
    tr, _ = _split(spark, sf_dir)
    b, a = M.fit_ridge_1d(tr, "l_quantity", "y", 1.0)
    return rnd(spark.createDataFrame([(b, a)], "slope double, intercept double"))


_FIT_CTE = _PRED_CTE.split("coef as (")[0] + "g as (" + Q.gram3("tr") + "), "
_FITS = {"LinearRegression": Q.solve3("g"), "Ridge": Q.solve3("g", 1.0), "Lasso": f"select * from {Q.lasso3('g', 1.0)} l"}
_SPECS = [M.ModelSpec("LinearRegression", "linear", {}), M.ModelSpec("Ridge", "ridge", {"alpha": 1.0}), M.ModelSpec("Lasso", "lasso", {"alpha": 1.0})]


def _coefficients(name):
    w = f"w as ({_FITS[name]}) "
    return _FIT_CTE + w + " union all ".join(f"select '{f}' as feature, round({c}, 4) as coefficient from w" for f, c in zip(
        [*FEATS, "(intercept)"], ["w1", "w2", "w3", "w0"]))


def _fit_all(spark, sf_dir, spec):
    tr, _ = _split(spark, sf_dir)
    return rnd(M.linear_coefficients(solve(total(grams(tr, FEATS, "y")), spec.kind, spec.params.get("alpha", 1.0)), FEATS), 4)


@query("train_linear_features", _coefficients("LinearRegression"))
def q_train_linear_features(spark, sf_dir):
    return _fit_all(spark, sf_dir, _SPECS[0])


@query("train_ridge_features", _coefficients("Ridge"))
def q_train_ridge_features(spark, sf_dir):
    return _fit_all(spark, sf_dir, _SPECS[1])


@query("train_lasso", _coefficients("Lasso"))
def q_train_lasso(spark, sf_dir):
    return _fit_all(spark, sf_dir, _SPECS[2])


@query("train_gbt")
def q_train_gbt(spark, sf_dir):
    tr, va = _split(spark, sf_dir)
    res = M.train_models(tr, "y", FEATS, "row_id",
                         [M.ModelSpec("GBT", "gbt", {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1,
                                                     "subsamplingRate": 0.9, "featureSubsetStrategy": "all"})],
                         valid=va)
    return rnd(res.metrics)


_MODELS_CTE = (_FIT_CTE + ", ".join(f"w_{n} as ({q})" for n, q in _FITS.items()) + ", preds as ("
               + " union all ".join(f"select va.*, '{n}' as model, y as y_true, w0 + w1 * l_quantity + w2 * l_discount + w3 * l_tax as y_pred "
                                    f"from va, w_{n}" for n in _FITS) + ") ")


@query("train_models", _MODELS_CTE + ", e as (select *, (y_true - y_pred) * (y_true - y_pred) as e2 from preds), bp as (" + _bp_sql("e") +
       f"), m as (select model, {_METRICS} from preds group by model) select model, {_r(['RMSE', 'MAE', 'R2'])}, {_TEST_COLS} "
       "from m join bp using (model)")
def q_train_models(spark, sf_dir):
    tr, va = _split(spark, sf_dir)
    res = M.train_models(tr, "y", FEATS, "row_id", _SPECS, valid=va)
    bp = spark.createDataFrame([(k, v.get("LM"), v.get("LM_pvalue"), v.get("F"), v.get("F_pvalue"))
                                for k, v in res.bp.items()],
                               "model string, LM double, LM_pvalue double, F double, F_pvalue double")
    return rnd(res.metrics.join(bp, "model", "left"))


@query("split", "select ('0x' || substr(md5(license_id || '|42'), 1, 8))::bigint % 100 < 20 as is_valid, count(*) as rows "
       "from licensing group by 1")
def q_split(spark, sf_dir):
    """Deterministic hash split of the licences: row counts per side."""
    lic = tables(spark, sf_dir)["licensing"]
    return lic.groupBy(M.split_flag(["license_id"]).alias("is_valid")).agg(F.count(F.lit(1)).alias("rows"))


@query("feature_target", "select license_id, [cast(release_year as double), cast(units as double)] as features, "
       "cast(price as double) as label from licensing where release_year is not null and units is not null and price is not null")
def q_feature_target(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    lic = tables(spark, sf_dir)["licensing"]
    data, feats = M.feature_target(lic, "price", ["release_year", "units"], "license_id", on_missing="drop")
    return data.select("license_id", vector_to_array("features").alias("features"), "label")


_STACK_CTE = (
    _PRED_CTE.split("coef as (")[0].replace("l_orderkey, l_quantity", "l_orderkey, l_partkey, l_quantity", 1) + "f as (select range as fold from range(5)), "
    # each fold's models are fitted on the other folds
    "b as (select fold, regr_slope(y, l_quantity) as w1, regr_intercept(y, l_quantity) as b1, "
    "covar_pop(l_discount, y) * count(*) / (var_pop(l_discount) * count(*) + 1.0) as w2, avg(y) as my, avg(l_discount) as md "
    "from f join tr on tr.l_partkey % 5 <> f.fold group by fold), "
    "o as (select y, b1 + w1 * l_quantity as z1, my + w2 * (l_discount - md) as z2 from tr join b on tr.l_partkey % 5 = b.fold), "
    "s as (select count(*) as n, avg(z1) as m1, avg(z2) as m2, avg(y) as my, var_pop(z1) * count(*) + 1.0 as s11, var_pop(z2) * count(*) + 1.0 as s22, "
    "covar_pop(z1, z2) * count(*) as s12, covar_pop(z1, y) * count(*) as c1, covar_pop(z2, y) * count(*) as c2 from o), "
    "meta as (select *, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) as v1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) as v2 from s), "
    "mean as (select avg(w1) as w1, avg(b1) as b1, avg(w2) as w2, avg(my - w2 * md) as b2 from b) ")


@query("stacking_oof", _STACK_CTE + f", preds as (select 'stacked' as model, va.y as y_true, meta.my - v1 * m1 - v2 * m2 + v1 * (mean.b1 + mean.w1 * l_quantity) "
       f"+ v2 * (mean.b2 + mean.w2 * l_discount) as y_pred from va, meta, mean) select model, {_r(['RMSE', 'MAE', 'R2'])} "
       f"from (select model, {_METRICS} from preds group by model) t")
def q_stacking_oof(spark, sf_dir):
    li = _li(spark, sf_dir).withColumn("fold", F.split("row_id", "-")[1].cast("long") % 5)
    tr, va = li.where(F.col("l_orderkey") % 5 != 0), li.where(F.col("l_orderkey") % 5 == 0)
    specs = [M.ModelSpec("quantity", "linear", {"features": ["l_quantity"]}),
             M.ModelSpec("discount", "ridge", {"alpha": 1.0, "features": ["l_discount"]})]
    _, _, predict = M.stacking_oof(tr, "y", FEATS, "row_id", specs, k=5, fold_col="fold")
    return rnd(EV.regression_metrics(predict(va).withColumn("model", F.lit("stacked"))))


@query("residual_chain")
def q_residual_chain(spark, sf_dir):
    tr, va = _split(spark, sf_dir)
    chain = [M.ModelSpec("LinearRegression", "linear", {}),
             M.ModelSpec("GBT", "gbt", {"maxIter": 10, "maxDepth": 4})]
    p = M.residual_chain(tr, va, "y", FEATS, "row_id", chain)
    return rnd(EV.regression_metrics(p.withColumn("model", F.lit("chain"))))


_TRIALS = ", ".join(f"({j}, {r}, '{f}', {', '.join(map(str, M.round_keys(42 + 1000 * j + r)))})" for j, f in enumerate(FEATS) for r in range(5))


@query("permutation_importance", _FIT_CTE + f"w as ({_FITS['LinearRegression']}), "
       "v as (select *, row_number() over (order by row_id, l_quantity, l_discount, l_tax, y) - 1 as i from va), "
       "size as (select n, low, (n + low - 1) // low as high from (select count(*) as n, cast(floor(sqrt(count(*) - 1)) as bigint) + 1 as low from v) c), "
       f"trials as (select * from (values {_TRIALS}) k(j, r, feature, k0, k1, k2, k3)), "
       f"asked as (select v.*, j, r, feature, {Q.permuted('v.i', 'size.n', 'size.low', 'size.high', ['k0', 'k1', 'k2', 'k3'])} as t from v, size, trials), "
       "mixed as (select a.j, a.r, a.feature, a.y - (w0 + w1 * case when a.j = 0 then d.l_quantity else a.l_quantity end + w2 * case when a.j = 1 then "
       "d.l_discount else a.l_discount end + w3 * case when a.j = 2 then d.l_tax else a.l_tax end) as e from asked a join v d on d.i = a.t, w), "
       "base as (select sum((y - (w0 + w1 * l_quantity + w2 * l_discount + w3 * l_tax)) ** 2) as sse, var_pop(y) * count(*) as sst from v, w) "
       "select feature, round(avg((m.sse - base.sse) / sst), 6) as importance from (select feature, r, sum(e * e) as sse from mixed group by feature, r) m, "
       "base group by feature")
def q_permutation_importance(spark, sf_dir):
    tr, va = _split(spark, sf_dir)
    m = solve(total(grams(tr, FEATS, "y")), "linear")
    return rnd(M.permutation_importance(m, va.select("row_id", *FEATS, F.col("y").alias("label")), FEATS, "row_id"))


@query("linear_shap", "with tr as (select * from lineitem where l_orderkey % 5 <> 0), "
       "c as (select regr_slope(l_extendedprice, l_quantity) as w, avg(l_quantity) as mx from tr) "
       "select 'l_quantity' as feature, round(avg(abs(w * (l_quantity - mx))), 4) as mean_abs_shap from tr, c")
def q_linear_shap(spark, sf_dir):
    tr, _ = _split(spark, sf_dir)
    data, _ = M.feature_target(tr, "y", ["l_quantity"])
    m = M.fit(M.ModelSpec("LinearRegression", "linear", {}), data)
    return rnd(M.linear_shap(m, tr, ["l_quantity"]), 4)
