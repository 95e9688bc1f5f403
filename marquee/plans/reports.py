"""Before/after reports, step manifest and profile bundles (small long tables)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import profile as P
from marquee.session import save_table
from marquee.sources.runstore import RunWriter

EPS = 1e-12


def compare_summaries(before: DataFrame, after: DataFrame, on: str = "column") -> DataFrame:
    """Inner join of two summaries on ``column`` with ``_before`` / ``_after`` suffixes."""
    b = before.select(on, *[F.col(c).alias(f"{c}_before") for c in before.columns if c != on])
    a = after.select(on, *[F.col(c).alias(f"{c}_after") for c in after.columns if c != on])
    return b.join(a, on)


def _pct(delta, base):
    denom = F.when(F.abs(base) > EPS, base).otherwise(F.lit(EPS))
    return delta / denom * 100.0


def impute_report(before: DataFrame, after: DataFrame, cols: list[str], tol_pct: float = 2.0) -> DataFrame:
    comp = compare_summaries(P.imputation_summary(before, cols), P.imputation_summary(after, cols))
    comp = comp.withColumns({
        "mean_delta": F.col("mean_after") - F.col("mean_before"),
        "median_delta": F.col("median_after") - F.col("median_before"),
        "missing_reduction": F.col("missing_before") - F.col("missing_after")})
    comp = comp.withColumns({"mean_delta_pct": _pct(F.col("mean_delta"), F.col("mean_before")),
                             "median_delta_pct": _pct(F.col("median_delta"), F.col("median_before"))})
    comp = comp.withColumns({
        "mean_stable": F.coalesce(F.abs("mean_delta_pct") <= tol_pct, F.lit(False)),
        "median_stable": F.coalesce(F.abs("median_delta_pct") <= tol_pct, F.lit(False))})
    return comp.select("column", "missing_before", "missing_after", "missing_reduction",
                       "mean_before", "mean_after", "mean_delta", "mean_delta_pct", "mean_stable",
                       "median_before", "median_after", "median_delta", "median_delta_pct", "median_stable")


def outliers_report(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    comp = compare_summaries(P.num_summary(before, cols), P.num_summary(after, cols))
    return comp.withColumn("std_delta", F.col("std_after") - F.col("std_before"))


def scaling_report(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    return compare_summaries(P.num_summary(before, cols), P.num_summary(after, cols))


def encoding_report(before: DataFrame, after: DataFrame, cols: list[str], normalise: bool = True) -> DataFrame:
    """cardinality_before (nulls count as a value) and cardinality_after (nulls
    excluded, -1 when the column is gone)."""
    cb = P.cardinality(before, cols, dropna=False).withColumnRenamed("cardinality", "cardinality_before")
    present = [c for c in cols if c in after.columns]
    if present:
        ca = P.cardinality(after, present, dropna=True).withColumnRenamed("cardinality", "cardinality_after")
        out = cb.join(ca, "column", "left")
    else:
        out = cb.withColumn("cardinality_after", F.lit(None).cast("long"))
    return out.withColumn("cardinality_after", F.coalesce("cardinality_after", F.lit(-1).cast("long")))


# ---------------------------------------------------------------- manifest
# fixed values: step names and status texts below are the result's own

def step_rows(steps: list[tuple[str, dict | DataFrame]]) -> list[tuple[int, str, str]]:
    """(seq, step, payload_json) for small payloads (dicts or report tables)."""
    out = []
    for i, (name, payload) in enumerate(steps):
        if isinstance(payload, DataFrame):
            payload = {"summary": [r.asDict() for r in payload.collect()]}   # report tables: one row per column
        out.append((i, name, json.dumps(payload, default=str, sort_keys=True)))
    return out


def step_manifest(spark, steps: list[tuple[str, dict | DataFrame]]) -> DataFrame:
    return spark.createDataFrame(step_rows(steps), "seq int, step string, payload string")


def manifest_status(manifest: DataFrame) -> DataFrame:
    """Dashboard line per step, read from the JSON payloads."""
    p = F.col("payload")
    summary = F.from_json(F.get_json_object(p, "$.summary"), "array<map<string,string>>")
    n_true = lambda k: F.size(F.filter(summary, lambda m: m[k] == "true"))
    status = (
        F.when(F.col("step") == "post_impute_check",
               F.format_string("Mean stable %d, Median stable %d", n_true("mean_stable"), n_true("median_stable")))
        .when(F.col("step") == "outliers", F.format_string("%s applied", F.get_json_object(p, "$.method")))
        .when(F.col("step") == "encoding", F.format_string(
            "%s on %d cols", F.get_json_object(p, "$.method"),
            F.size(F.from_json(F.get_json_object(p, "$.columns"), "array<string>"))))
        .when(F.col("step") == "scaling", F.format_string(
            "%s on %d cols", F.get_json_object(p, "$.scaler"), F.size(summary)))
        .when(F.col("step") == "deduplication", F.format_string(
            "Removed %s rows", F.get_json_object(p, "$.removed_count")))
        .otherwise(F.lit("Recorded")))
    step = (F.when(F.col("step") == "post_impute_check", "Imputation")
            .when(F.col("step") == "outliers", "Outliers").when(F.col("step") == "encoding", "Encoding")
            .when(F.col("step") == "scaling", "Scaling").when(F.col("step") == "deduplication", "Deduplication")
            .otherwise(F.col("step")))
    return manifest.select("seq", step.alias("step"), status.alias("status"))


# ---------------------------------------------------------------- report datasets
#
# A report is a set of named sections, each a table with a schema of its own. Sections are
# given as functions, so that one can be made without the others.

Sections = dict[str, Callable[[], DataFrame]]


def made(sections: Sections, only: list[str] | None = None) -> dict[str, DataFrame]:
    return {k: make() for k, make in sections.items() if only is None or k in only}


def store_sections(run: RunWriter, sections: Sections, only: list[str] | None = None) -> None:
    """Write each section as a table of the run, under ``reports``."""
    for name, make in sections.items():
        if only is None or name in only:
            run.put("reports", name, make())


def profile_sections(df: DataFrame) -> Sections:
    """Shape, dtypes, missing, describe, correlations, sample, datetime summary and monthly trends."""
    from marquee.functions.columns import dtypes_table, select_dtypes
    tim = select_dtypes(df, "datetime")
    out: Sections = {
        "shape": lambda: P.shape(df),
        "dtypes": lambda: dtypes_table(df),
        "missing": lambda: P.missing_counts(df),
        "describe": lambda: P.describe_all(df),
        "corr_numeric": lambda: P.corr_matrix(df),
        "sample_head": lambda: df.orderBy(*df.columns).limit(10),
    }
    if tim:
        out["datetime_summary"] = lambda: P.datetime_summary(df, tim)
    for c in tim:
        out[f"trend_{c}"] = lambda c=c: P.datetime_trend(df, c, "M")
    return out


def eda_profile(df: DataFrame) -> dict[str, DataFrame]:
    """All sections of the profile, sharing one written input of which each reads its columns."""
    return made(profile_sections(save_table(df, "profiled")))


def eda_sections(df: DataFrame) -> Sections:
    """describe table, 30-bin histogram of the first numeric column, top-20 of the
    first non-numeric column, 25-row preview."""
    from marquee.functions.columns import select_dtypes
    num = select_dtypes(df, "numeric")
    cat = [c for c in df.columns if c not in num]
    out: Sections = {"describe": lambda: P.describe_all(df), "preview": lambda: df.orderBy(*df.columns).limit(25)}
    if num:
        out["histogram"] = lambda: P.histogram(df, num[0], 30)
    if cat:
        out["top_values"] = lambda: P.value_counts_top(df, cat[0], 20)
    return out


def visual_sections(df: DataFrame) -> Sections:
    """Scatter of the first two numeric columns and correlations of the first eight."""
    from marquee.functions.columns import select_dtypes
    num = select_dtypes(df, "numeric")
    out: Sections = {}
    if len(num) >= 2:
        out["scatter"] = lambda: scatter_sample(df, num[0], num[1])
    if num:
        out["corr"] = lambda: P.corr_matrix(df, num[:8], places=None)
    return out


def model_sections(pred: DataFrame, importances: DataFrame | None = None) -> Sections:
    from marquee.operators import evaluate as EV
    out: Sections = {
        "metrics": lambda: EV.regression_metrics(pred),
        "ensembles": lambda: EV.regression_metrics(EV.ensemble_average(pred)).unionByName(
            EV.regression_metrics(EV.ensemble_weighted(pred))),
        "residuals": lambda: EV.residuals(pred),
        "residual_histogram": lambda: P.histogram(EV.residuals(pred), "resid", 30),
        "actual_vs_pred": lambda: EV.actual_vs_pred(pred)}
    if importances is not None:
        out["importances"] = lambda: importances.orderBy(F.desc(importances.columns[1])).limit(20)
    return out


def full_sections(df: DataFrame, pred: DataFrame, run_id: str) -> Sections:
    out: Sections = {f"eda_{k}": v for k, v in eda_sections(df).items()}
    out.update({f"visual_{k}": v for k, v in visual_sections(df).items()})
    out.update({f"model_{k}": v for k, v in model_sections(pred).items()})
    out["meta"] = lambda: P.shape(df).select(F.lit(run_id).alias("run_id"), F.col("rows"))
    return out


def report_eda(df: DataFrame) -> dict[str, DataFrame]:
    return made(eda_sections(df))


def report_visual(df: DataFrame) -> dict[str, DataFrame]:
    return made(visual_sections(df))


def report_model(pred: DataFrame, importances: DataFrame | None = None) -> dict[str, DataFrame]:
    return made(model_sections(pred, importances))


def report_full(df: DataFrame, pred: DataFrame, run_id: str) -> dict[str, DataFrame]:
    return made(full_sections(df, pred, run_id))


def section_values(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, item): every row of every report dataset, as JSON with its column names (nulls kept)."""
    parts = [v.select(F.lit(k).alias("section"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in v.columns]),
                                                          {"ignoreNullFields": "false"}).alias("item"))
             for k, v in sections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scatter_sample(df: DataFrame, x: str, y: str, max_points: int | None = None, seed: int = 42,
                   key: list[str] | None = None) -> DataFrame:
    """Rows where both are present; with ``max_points`` a deterministic hash sample of
    at most that many points (top-n by hash: per-partition top-n, then merge).

    The hash is an MD5 of ``key`` (default: the two values) and the seed."""
    there = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = [F.col(x).alias("x"), F.col(y).alias("y")]
    if max_points is None:
        return there.select(*pairs)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key or [x, y]], F.lit(str(seed)))
    return there.select(*pairs, F.md5(text.cast("binary")).alias("_h")).orderBy("_h", "x", "y").limit(max_points).drop("_h")
