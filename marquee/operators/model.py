"""Model training on Spark ML, with deterministic hash splits and long predictions.

* Splits and folds are taken from an MD5 of key and seed - stable across plans,
  engines and re-executions (``randomSplit`` is not, once partitions are recomputed).
* Linear models are solved from one aggregated Gram matrix (``operators.gram``),
  several models and folds at once; other models use ``pyspark.ml``.
* Training inputs are cut from lineage with a reliable checkpoint before the
  iterative estimators run, so a lost executor recomputes from the checkpoint.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.columns import select_dtypes
from marquee.operators.gram import LINEAR_KINDS, grams, solve, total
from marquee.session import cut_lineage, save_table


# ---------------------------------------------------------------- data prep

def feature_target(df: DataFrame, target: str = "price", features: list[str] | None = None,
                   key: str | None = None, on_missing: str = "error"):
    """Numeric target + features (default: the other numeric columns); returns
    (assembled_df, features). A null in a feature or the target is an error, unless
    ``on_missing="drop"``, which leaves such rows out (``missing_rows`` counts them)."""
    feats = features or [c for c in select_dtypes(df, "numeric") if c != target]
    cols = ([key] if key else []) + feats + [target]
    clean = whole_rows(df.select(*cols), feats + [target], on_missing)
    va = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="error")
    return va.transform(clean).withColumn("label", F.col(target).cast("double")), feats


def whole_rows(df: DataFrame, columns: list[str], on_missing: str = "error") -> DataFrame:
    """Rows without a null in ``columns``: others are dropped, or an error for whoever reads one."""
    if on_missing == "drop":
        return df.dropna(subset=columns)
    if on_missing != "error":
        raise ValueError(f"on_missing: {on_missing}")
    absent = F.raise_error(F.lit(f"null in {', '.join(columns)}: pass on_missing='drop' to leave such rows out"))
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    # on every column, so that whichever is read first in a row tells the same
    return df.withColumns({c: F.when(whole, F.col(c)).otherwise(absent.cast(df.schema[c].dataType)) for c in columns})


def missing_rows(df: DataFrame, target: str, features: list[str]) -> int:
    """Rows that ``on_missing="drop"`` leaves out."""
    return df.count() - df.dropna(subset=[*features, target]).count()


def split_flag(key_cols: list[str], seed: int = 42, valid_pct: int = 20):
    """Deterministic 80/20 split column: true = validation row."""
    return keyed_number(key_cols, seed) % 100 < valid_pct


def fold_id(key_cols: list[str], k: int = 5, seed: int = 42):
    return (keyed_number(key_cols, seed + 1) % k).cast("int")


def keyed_number(key_cols: list[str], seed: int) -> Column:
    """32 bits of the MD5 of "key|...|seed" (null keys left out), the same in any engine that has MD5."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


# ---------------------------------------------------------------- closed-form one-feature fits

def fit_ols_1d(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """(slope, intercept) of y ~ x by one aggregation."""
    r = df.agg(F.regr_slope(F.col(y), F.col(x)).alias("b"), F.regr_intercept(F.col(y), F.col(x)).alias("a")).first()
    return r["b"], r["a"]


def fit_ridge_1d(df: DataFrame, x: str, y: str, alpha: float = 1.0) -> tuple[float, float]:
    """Ridge with unpenalised intercept: slope = Sxy / (Sxx + alpha) on centred sums."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = d.agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"),
              F.avg(x).alias("mx"), F.avg(y).alias("my")).first()
    b = r["cxy"] * r["n"] / (r["vx"] * r["n"] + alpha)
    return b, r["my"] - b * r["mx"]


# ---------------------------------------------------------------- estimators

@dataclass
class ModelSpec:
    name: str
    kind: str                 # linear | ridge | lasso | gbt
    params: dict


# fixed values: default model settings (boosting re-aimed to Spark GBT)
DEFAULT_MODELS = [
    ModelSpec("LinearRegression", "linear", {}),
    ModelSpec("Ridge", "ridge", {"alpha": 1.0}),
    ModelSpec("Lasso", "lasso", {"alpha": 1.0}),
    ModelSpec("GBT", "gbt", {"maxIter": 600, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.9,
                             "featureSubsetStrategy": "0.9"}),
]


def make_estimator(spec: ModelSpec, n_train: int | None = None, y_std: float | None = None):
    """Spark ML estimator matching the reference objective.

    ridge: sklearn minimises ||y - Xw||^2 + a||w||^2; Spark minimises
    (1/2n)||y - Xw||^2 + (l/2)||w||^2 on a label scaled by its std, so
    l = a / n * std(y) (population std).  lasso: l = a.
    """
    p = spec.params
    if spec.kind == "linear":
        return LinearRegression(solver="normal", regParam=0.0)
    if spec.kind == "ridge":
        lam = p.get("alpha", 1.0) / n_train * (y_std or 1.0)
        return LinearRegression(solver="normal", regParam=lam, elasticNetParam=0.0, standardization=False)
    if spec.kind == "lasso":
        return LinearRegression(regParam=p.get("alpha", 1.0), elasticNetParam=1.0, standardization=False,
                                maxIter=p.get("maxIter", 1000), tol=1e-8)
    if spec.kind == "gbt":
        return GBTRegressor(maxIter=p.get("maxIter", 100), maxDepth=p.get("maxDepth", 5),
                            stepSize=p.get("stepSize", 0.1), subsamplingRate=p.get("subsamplingRate", 1.0),
                            featureSubsetStrategy=p.get("featureSubsetStrategy", "all"), seed=42)
    raise ValueError(f"unknown model kind {spec.kind}")


def fit(spec: ModelSpec, train: DataFrame):
    n, sd = None, None
    if spec.kind == "ridge":
        r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
        n, sd = r["n"], r["sd"]
    return make_estimator(spec, n, sd).fit(train)


@dataclass
class TrainResult:
    models: dict
    predictions: DataFrame      # long: row_id, model, y_true, y_pred
    metrics: DataFrame          # model, RMSE, MAE, R2
    bp: dict                    # model -> BP dict (linear family only)


def train_models(df: DataFrame, target: str, features: list[str], key: str,
                 specs: list[ModelSpec] | None = None, valid: DataFrame | None = None,
                 seed: int = 42) -> TrainResult:
    """Fit every spec on the same split; predictions on the validation rows.

    The assembled frame is checkpointed once (shared by all fits). All linear models are
    solved from one Gram matrix; the others are trained one after another, each a
    distributed job.
    """
    from marquee.operators.evaluate import breusch_pagan, regression_metrics
    data, _ = feature_target(df, target, features, key)
    if valid is None:
        flagged = data.withColumn("_valid", split_flag([key], seed))
        data = cut_lineage(flagged)
        train, val = data.where(~F.col("_valid")), data.where(F.col("_valid"))
    else:
        train, val = cut_lineage(data), feature_target(valid, target, features, key)[0]
    specs = specs or DEFAULT_MODELS
    models, preds, bp = {}, [], {}
    sums = total(grams(train, features, target)) if any(s.kind in LINEAR_KINDS for s in specs) else None
    for s in specs:
        m = solve(sums, s.kind, s.params.get("alpha", 1.0)) if s.kind in LINEAR_KINDS else fit(s, train)
        models[s.name] = m
        p = m.transform(val).select(F.col(key).cast("string").alias("row_id"), F.lit(s.name).alias("model"),
                                    F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
        preds.append(p)
        if s.kind in LINEAR_KINDS:
            res = m.transform(val).withColumn("_e", F.col("label") - F.col("prediction"))
            bp[s.name] = breusch_pagan(res, "_e", features)
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    return TrainResult(models, allp, regression_metrics(allp), bp)


def linear_coefficients(model, features: list[str]) -> DataFrame:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(f, float(w)) for f, w in zip(features, model.coefficients.toArray())]
    rows.append(("(intercept)", float(model.intercept)))
    return spark.createDataFrame(rows, "feature string, coefficient double")


# ---------------------------------------------------------------- stacking / chains

def stacking_oof(df: DataFrame, target: str, features: list[str], key: str,
                 specs: list[ModelSpec], k: int = 5, alpha: float = 1.0, seed: int = 42, fold_col: str | None = None):
    """Out-of-fold predictions of each base model (hash folds, or ``fold_col``), a ridge meta model
    on them, and a predictor that averages the fold models of each base model.

    A spec's ``features`` parameter names a base model's own features. Linear base models are
    fitted from one pass of Gram matrices by fold, and so is the meta model. Returns
    (oof_df, meta_model, predict) where ``predict(new_df)`` yields (row_id, y_true, y_pred)."""
    if all(s.kind in LINEAR_KINDS for s in specs):
        return _linear_stack(df, target, features, key, specs, k, alpha, seed, fold_col)
    if any("features" in s.params for s in specs):
        raise ValueError("own features are for stacks of linear models")
    return _general_stack(df, target, features, key, specs, k, alpha, seed, fold_col)


def _linear_stack(df, target, features, key, specs, k, alpha, seed, fold_col):
    fold = F.col(fold_col) if fold_col else fold_id([key], k, seed)
    rows = whole_rows(df.select(key, fold.alias("_fold"), *features, target), [*features, target], "error")
    parts = grams(rows, features, target, "_fold")
    everything = total(parts)
    names = [f"oof_{s.name}" for s in specs]
    fits, z = {}, None
    for f, g in parts.items():
        rest = everything - g
        fits[f] = [solve(rest.of(s.params.get("features", features)), s.kind, s.params.get("alpha", 1.0)) for s in specs]
        weights = np.zeros((len(specs), len(features)))
        for i, m in enumerate(fits[f]):
            for name, w in zip(m.features, m.weights):
                weights[i, features.index(name)] = w
        mine = g.mapped(weights, np.array([m.intercept for m in fits[f]]), names)
        z = mine if z is None else z + mine
    meta = solve(z, "ridge", alpha)

    def out_of_fold(i):
        value = F.lit(None).cast("double")
        for f, models in fits.items():
            m = models[i]
            value = F.when(F.col("_fold").eqNullSafe(F.lit(f)), m.value([F.col(f"`{c}`") for c in m.features])).otherwise(value)
        return value
    oof = rows.select(key, F.col(target).cast("double").alias("label"), *[out_of_fold(i).alias(n) for i, n in enumerate(names)])

    def predict(new_df: DataFrame) -> DataFrame:
        out = new_df.select(key, F.col(target).cast("double").alias("label"), *features)
        for i, n in enumerate(names):
            models = [m[i] for m in fits.values()]
            average = sum((m.value([F.col(f"`{c}`") for c in m.features]) for m in models[1:]),
                          models[0].value([F.col(f"`{c}`") for c in models[0].features])) / len(models)
            out = out.withColumn(n, average)
        return meta.transform(out).select(F.col(key).cast("string").alias("row_id"), F.col("label").alias("y_true"),
                                          F.col("prediction").alias("y_pred"))
    return oof, meta, predict


def _general_stack(df, target, features, key, specs, k, alpha, seed, fold_col):
    if fold_col is not None:
        raise ValueError("fold_col is for stacks of linear models")
    data, _ = feature_target(df, target, features, key)
    data = cut_lineage(data.withColumn("_fold", fold_id([key], k, seed)))
    fold_models = {s.name: [] for s in specs}
    oof = None
    for f in range(k):
        tr, va = data.where(F.col("_fold") != f), data.where(F.col("_fold") == f)
        # every model of the fold scores the same rows in turn: no join, so keys may repeat
        part = va
        for s in specs:
            m = fit(s, tr)
            fold_models[s.name].append(m)
            part = m.transform(part).withColumnRenamed("prediction", f"oof_{s.name}")
        part = part.select(key, "label", *[f"oof_{s.name}" for s in specs])
        oof = part if oof is None else oof.unionByName(part)
    oof = cut_lineage(oof)
    meta_in = VectorAssembler(inputCols=[f"oof_{s.name}" for s in specs], outputCol="features").transform(oof)
    meta = fit(ModelSpec("meta", "ridge", {"alpha": alpha}), meta_in)

    def predict(new_df: DataFrame) -> DataFrame:
        nd, _ = feature_target(new_df, target, features, key)
        cols = []
        out = nd.select(key, "features", "label")
        for s in specs:
            pcols = []
            for i, m in enumerate(fold_models[s.name]):
                out = m.transform(out).withColumnRenamed("prediction", f"_p{s.name}{i}")
                pcols.append(F.col(f"_p{s.name}{i}"))
            out = out.withColumn(f"oof_{s.name}", sum(pcols[1:], pcols[0]) / len(pcols))
            cols.append(f"oof_{s.name}")
        mi = VectorAssembler(inputCols=cols, outputCol="_mf").transform(out.drop("features")) \
            .withColumnRenamed("_mf", "features")
        return meta.transform(mi).select(F.col(key).cast("string").alias("row_id"),
                                         F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))

    return oof, meta, predict


def residual_chain(train: DataFrame, valid: DataFrame, target: str, features: list[str], key: str,
                   chain: list[ModelSpec]) -> DataFrame:
    """Each stage fits the residual of the previous; validation prediction = sum.

    The running residual is checkpointed per stage (lineage stays one stage deep)."""
    tr, _ = feature_target(train, target, features, key)
    va, _ = feature_target(valid, target, features, key)
    tr = cut_lineage(tr.withColumn("_resid", F.col("label")))
    acc = va.select(key, "features", "label").withColumn("_sum", F.lit(0.0))
    for i, s in enumerate(chain):
        stage_in = tr.withColumn("label", F.col("_resid"))
        m = fit(s, stage_in)
        tr = cut_lineage(m.transform(stage_in).withColumn("_resid", F.col("_resid") - F.col("prediction"))
                         .drop("prediction"))
        acc = m.transform(acc).withColumn("_sum", F.col("_sum") + F.col("prediction")).drop("prediction")
    return acc.select(F.col(key).cast("string").alias("row_id"), F.col("label").alias("y_true"),
                      F.col("_sum").alias("y_pred"))


# ---------------------------------------------------------------- explanations

#: prime modulus of the round functions
_PRIME = 2**31 - 1
#: steps back into the range; beyond 16 the chance is below n ** -7, and a small range has no longer cycle
_STEPS, _ROUNDS = 16, 4


def round_keys(seed: int) -> list[int]:
    return [int(hashlib.md5(f"{seed}:{j}".encode()).hexdigest()[:8], 16) % _PRIME for j in range(_ROUNDS)]


def with_image(df: DataFrame, i: str, n: int, keys: list[Column], out: str, back: bool = False) -> DataFrame:
    """``out``: image of ``i`` (0 to n-1, n below 2**53) under a bijection of that range, keyed by ``round_keys``.
    ``back``: the number whose image ``i`` is.

    A Feistel network over digits (low, high) of a grid just larger than n: each round adds
    a keyed function of one digit to the other, so it can be undone. An image outside the range is mapped
    again until it falls inside, which keeps the map one-to-one.
    """
    low, high = _grid(n)
    order = list(enumerate(keys))[::-1] if back else list(enumerate(keys))

    def moved(x: Column, y: Column, size: int) -> Column:
        by = y * y % _PRIME
        return (x + (size - by % size)) % size if back else (x + by) % size

    def digits(x: Column) -> tuple[Column, Column]:
        return x % low, ((x - x % low) / low).cast("long")

    def rounds(a: Column, b: Column):
        """The digits after each round."""
        for j, key in order:
            y = ((b if j % 2 == 0 else a) + key) % _PRIME
            if j % 2 == 0:
                a = moved(a, y, low)
            else:
                b = moved(b, y, high)
            yield a, b

    def again(x: Column) -> Column:
        a, b = list(rounds(*digits(x)))[-1]
        return b * low + a
    a, b = digits(F.col(i))
    step = df.withColumns({"_a": a, "_b": b})
    for j, key in order:                   # a column a round: nothing is computed twice
        y = (F.col("_b" if j % 2 == 0 else "_a") + key) % _PRIME
        mine, size = ("_a", low) if j % 2 == 0 else ("_b", high)
        step = step.withColumn("_y", y).withColumn(mine, moved(F.col(mine), F.col("_y"), size))
    step = step.withColumn("_w", F.col("_b") * low + F.col("_a"))
    walk = F.aggregate(F.array_repeat(F.lit(0), _STEPS), F.col("_w"), lambda x, _: F.when(x < n, x).otherwise(again(x)))
    step = step.withColumn(out, F.when(F.col("_w") < n, F.col("_w")).otherwise(walk))
    lost = F.raise_error(F.lit("the walk left the range")).cast("long")
    return step.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(lost)).drop("_a", "_b", "_y", "_w")


def _grid(n: int) -> tuple[int, int]:
    low = math.isqrt(max(n - 1, 0)) + 1
    return low, max(1, -(-n // low))


def dense_index(df: DataFrame, order: list[str], out: str = "_i") -> DataFrame:
    """Rows numbered 0 to n-1 in ``order``, without a one-task sort: written in ranges, numbered inside each.

    The offsets table has one row a range.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    written = save_table(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "indexed")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
               .select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before")))
    return (written.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_at") - F.col("_first"))
            .select(*df.columns, out))


def permutation_importance(model, data: DataFrame, features: list[str], key: str,
                           repeats: int = 5, seed: int = 42) -> DataFrame:
    """Mean drop in R2 when one feature is shuffled, over ``repeats`` shuffles.

    Rows are numbered in order of key and features. A shuffle is a keyed bijection of these
    numbers: the row gets the feature of the row that its number maps to. A row sends its features to
    the rows that get them, so only numbers and single values move: all shuffles of all
    features are one equi-join on row numbers and one aggregate.
    """
    base = data.select(key, *[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.col("label").cast("double").alias("label"))
    rows = save_table(dense_index(base, [key, *features, "label"]).drop(key), "numbered")
    n, sst = rows.agg(F.count(F.lit(1)), F.var_pop("label") * F.count(F.lit(1))).first()
    spark = data.sparkSession
    if not n or not sst:
        return spark.createDataFrame([], "feature string, importance double")

    def sse(df: DataFrame, by: list[str]) -> DataFrame:
        va = VectorAssembler(inputCols=features, outputCol="features").transform(df)
        e = F.col("label") - F.col("prediction")
        return model.transform(va).groupBy(*by).agg(F.sum(e * e).alias("sse"))
    whole = sse(rows, []).first()["sse"]
    trials = F.array(*[F.struct(F.lit(j * repeats + r).alias("_trial"), F.array(*[F.lit(k).cast("long") for k in round_keys(seed + 1000 * j + r)]).alias("_k"),
                                F.col(f"`{f}`").alias("_given"))
                       for j, f in enumerate(features) for r in range(repeats)])
    given = rows.select("_i", F.explode(trials).alias("_x")).select("_i", "_x.*")
    given = with_image(given, "_i", n, [F.col("_k")[i] for i in range(_ROUNDS)], "_to", back=True)
    # row and trial in one number, so that rows are short; never null, so that no filter of the join makes the image again
    count = len(features) * repeats
    given = given.select(F.coalesce(F.col("_to") * count + F.col("_trial"), F.lit(-count)).alias("_place"), "_given")
    # merged, not broadcast: the file of all rows is a small part of what they take in a driver's memory
    mixed = given.join(rows.hint("merge"), F.expr(f"_place div {count}") == F.col("_i")).withColumn("_trial", (F.col("_place") % count).cast("int"))
    mixed = mixed.withColumn("_j", F.floor(F.col("_trial") / repeats).cast("int"))
    mixed = mixed.withColumns({f: F.when(F.col("_j") == j, F.col("_given")).otherwise(F.col(f"`{f}`")) for j, f in enumerate(features)})
    name = F.array(*[F.lit(f) for f in features])
    # R2 falls by (sse of the shuffle - sse) / sst
    return (sse(mixed, ["_j", "_trial"]).groupBy("_j").agg(F.avg((F.col("sse") - F.lit(whole)) / F.lit(sst)).alias("importance"))
            .select(name[F.col("_j")].alias("feature"), "importance").orderBy(F.desc("importance"), "feature"))


def linear_shap(model, data: DataFrame, features: list[str]) -> DataFrame:
    """Mean |SHAP| of a linear model: avg(|w_j * (x_j - mean_j)|) per feature (one pass)."""
    w = model.coefficients.toArray()
    means = data.agg(*[F.avg(f).alias(f) for f in features]).first()
    aggs = [F.avg(F.abs(F.lit(float(w[i])) * (F.col(f) - F.lit(means[f])))).alias(f) for i, f in enumerate(features)]
    r = data.agg(*aggs).first()
    spark = data.sparkSession
    return spark.createDataFrame([(f, float(r[f])) for f in features], "feature string, mean_abs_shap double") \
        .orderBy(F.desc("mean_abs_shap"))
