"""Evaluation over a long prediction table ``(row_id, model, y_true, y_pred)``.

Everything is a grouped aggregation keyed by model (few groups, partial
aggregation) or a per-row projection; nothing is collected except per-model
scalars (weights) and p x p Gram matrices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.stats import chi2_sf, f_sf, norm_ppf
from marquee.operators.profile import group_quantiles


def regression_metrics(pred: DataFrame, by: str = "model") -> DataFrame:
    """RMSE, MAE, R2 per ``by`` group; R2 is null when y has zero variance."""
    e = F.col("y_true") - F.col("y_pred")
    sst = F.var_pop("y_true") * F.count(F.lit(1))
    return pred.groupBy(by).agg(
        F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"),
        F.when(sst > 0, 1.0 - F.sum(e * e) / sst).alias("R2"))


def ensemble_average(pred: DataFrame) -> DataFrame:
    """Mean of the model predictions per row (model = 'average')."""
    return pred.groupBy("row_id").agg(F.first("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred")) \
        .withColumn("model", F.lit("average"))


def inverse_rmse_weights(pred: DataFrame) -> DataFrame:
    """w_m = (1/(RMSE_m + 1e-8)) / sum over models; one row per model."""
    m = regression_metrics(pred).select("model", (1.0 / (F.col("RMSE") + 1e-8)).alias("inv"))
    from pyspark.sql.window import Window
    return m.select("model", (F.col("inv") / F.sum("inv").over(Window.partitionBy())).alias("weight"))


def ensemble_weighted(pred: DataFrame) -> DataFrame:
    """Inverse-RMSE weighted prediction per row (model = 'weighted_inverse_rmse').

    The weight table has one row per model, so the broadcast is bounded by the
    number of models."""
    w = inverse_rmse_weights(pred)
    return (pred.join(F.broadcast(w), "model")
            .groupBy("row_id").agg(F.first("y_true").alias("y_true"),
                                   F.sum(F.col("weight") * F.col("y_pred")).alias("y_pred"))
            .withColumn("model", F.lit("weighted_inverse_rmse")))


def best_model(metrics: DataFrame) -> DataFrame:
    """Lowest RMSE (tie: model name)."""
    return metrics.agg(F.min_by("model", F.struct("RMSE", "model")).alias("model"),
                       F.min("RMSE").alias("RMSE"))


def choose_prediction(pred: DataFrame) -> DataFrame:
    """Display choice: weighted ensemble, else average, else the single model."""
    n_models = pred.select("model").distinct().count()
    if n_models > 1:
        return ensemble_weighted(pred)
    return pred


def residuals(pred: DataFrame) -> DataFrame:
    return pred.select("row_id", "model", F.col("y_pred").alias("pred"),
                       (F.col("y_true") - F.col("y_pred")).alias("resid"))


def actual_vs_pred(pred: DataFrame) -> DataFrame:
    """Pairs plus the identity line range [min(y), max(y)] per model."""
    ends = pred.groupBy("model").agg(F.min("y_true").alias("line_min"), F.max("y_true").alias("line_max"))
    return (pred.select("row_id", "model", "y_true", "y_pred").join(ends.withColumnRenamed("model", "_m"),
                                                                   F.col("model").eqNullSafe(F.col("_m"))).drop("_m"))


def qq_points(pred: DataFrame, points: int = 99, model: str | None = None, approx: bool = False) -> DataFrame:
    """Residual quantiles vs normal quantiles on a fixed probability grid, plus the
    standardised reference line (slope = std, intercept = mean of residuals).

    Quantiles come from a distributed histogram of the residuals; ``approx`` uses the
    mergeable ``percentile_approx`` sketch."""
    p = pred if model is None else pred.where(F.col("model") == model)
    r = F.col("y_true") - F.col("y_pred")
    grid = [(i + 1) / (points + 1) for i in range(points)]
    line = p.groupBy("model").agg(F.stddev_pop(r).alias("slope"), F.avg(r).alias("intercept"))
    if approx:
        q = p.groupBy("model").agg(F.percentile_approx(r, grid, 10000).cast("array<double>").alias("q"))
    else:
        rows = p.select("model", r.cast("double").alias("r")).where(F.col("model").isNotNull() & F.col("r").isNotNull())
        q = p.sparkSession.createDataFrame(sorted(group_quantiles(rows, "model", "r", grid).items()),
                                           "model string, q array<double>")
    z = F.arrays_zip(F.array(*[F.lit(g) for g in grid]).alias("p"),
                     F.array(*[F.lit(norm_ppf(g)) for g in grid]).alias("theoretical"), F.col("q").alias("sample"))
    return line.join(q, "model").select("model", "slope", "intercept", F.explode(z).alias("z")).select(
        "model", F.col("z.p").alias("p"), F.col("z.theoretical").alias("theoretical"),
        F.col("z.sample").alias("sample"), "slope", "intercept")


def breusch_pagan(df: DataFrame, resid: str, features: list[str]) -> dict:
    """LM, LM p, F, F p of the auxiliary regression e^2 ~ [1, X].

    One aggregation gives the covariances of the features with each other and with e^2;
    the solve is on the driver (p small).  Features without a unique solution -> {}.
    """
    u = F.pow(F.col(resid), 2)
    xs = [F.col(c).cast("double") for c in features]
    p = len(xs)
    src = df.dropna(subset=[resid, *features])
    r = src.agg(F.count(F.lit(1)).alias("n"), F.var_pop(u).alias("vu"),
                *[F.covar_pop(x, u).alias(f"xu{i}") for i, x in enumerate(xs)],
                *[F.covar_pop(xs[i], xs[j]).alias(f"xx{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    n = r["n"]
    if n <= p + 1 or not r["vu"]:
        return {}
    sxx = np.array([[r[f"xx{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    sxu = np.array([r[f"xu{i}"] for i in range(p)])
    try:
        beta = np.linalg.solve(sxx, sxu)
    except np.linalg.LinAlgError:
        return {}
    r2 = float(beta @ sxu) / r["vu"]
    fval = (r2 / p) / ((1 - r2) / (n - p - 1))
    return {"LM": n * r2, "LM_pvalue": chi2_sf(n * r2, p), "F": fval, "F_pvalue": f_sf(fval, p, n - p - 1)}


def format_metrics(metrics: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Display strings: 4 decimals, scientific (2 digits) below 1e-4 in magnitude."""
    cols = cols or [c for c in metrics.columns if c != "model"]

    def fmt(c):
        x = F.col(c)
        return (F.when(x.isNull(), F.lit("—"))
                .when((F.abs(x) < 1e-4) & (x != 0), F.format_string("%.2e", x))
                .otherwise(F.format_string("%.4f", x)))
    return metrics.select("model", *[fmt(c).alias(c) for c in cols])
