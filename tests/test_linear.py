"""Gram matrices, lasso, stacking, the keyed permutation and importance, against plain numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import gram as G
from marquee.operators import model as M


def data(n=400, p=3, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p)) * [10.0 ** (i % 3) for i in range(p)] + 100
    y = x @ np.arange(1, p + 1) + r.normal(size=n) * 5 + 1e5
    return x, y


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, i % 5, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, fold long, " + ", ".join(f"{c} double" for c in names) + ", y double"), names


def lasso_descent(x, y, alpha, steps=4000):
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1])
    for _ in range(steps):
        for j in range(len(w)):
            r = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j])
            w[j] = np.sign(r) * max(abs(r) - len(y) * alpha, 0) / (xc[:, j] @ xc[:, j])
    return w


@pytest.mark.parametrize("p,alpha", [(3, 0.5), (4, 20.0), (31, 1.0)])
def test_linear_family(spark, p, alpha):
    x, y = data(600, p)
    df, names = frame(spark, x, y)
    g = G.total(G.grams(df, names, "y"))        # 31 features are too many sums for one JVM aggregate
    full = np.column_stack([np.ones(len(y)), x])
    best = np.linalg.lstsq(full, y, rcond=None)[0]
    m = G.solve(g, "linear")
    assert np.allclose([m.intercept, *m.weights], best, rtol=1e-7, atol=1e-6)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(G.solve(g, "ridge", alpha).weights, np.linalg.solve(xc.T @ xc + alpha * np.eye(p), xc.T @ yc), rtol=1e-8)
    lasso = G.solve(g, "lasso", alpha)
    w = np.array(lasso.weights)
    assert np.allclose(w, lasso_descent(x, y, alpha), atol=1e-6)
    slope = xc.T @ (yc - xc @ w) / len(y)           # optimality: alpha times the sign, or within alpha
    assert np.all(np.where(w != 0, np.abs(slope - alpha * np.sign(w)) < 1e-7, np.abs(slope) <= alpha + 1e-7))
    got = lasso.transform(df).select("id", "prediction").orderBy("id").collect()
    assert np.allclose([r.prediction for r in got], x @ w + lasso.intercept)


def test_dependent_and_constant_features(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.lit(7.0).alias("c"), (F.col("id") * 3.0 + 1).alias("y"))
    m = G.solve(G.total(G.grams(df, ["a", "b", "c"], "y")), "linear")
    assert max(abs(r.prediction - r.y) for r in m.transform(df).collect()) < 1e-8
    assert G.solve(G.total(G.grams(df, ["c"], "y")), "lasso").weights == (0.0,)
    with pytest.raises(ValueError, match="no rows"):
        G.total(G.grams(df.limit(0), ["a"], "y"))


def test_stack_is_that_of_separate_fits(spark):
    x, y = data(500)
    df, names = frame(spark, x, y)
    specs = [M.ModelSpec("a", "linear", {"features": names[:2]}), M.ModelSpec("b", "ridge", {"alpha": 30.0}), M.ModelSpec("c", "lasso", {"alpha": 2.0})]
    oof, _, predict = M.stacking_oof(df, "y", names, "id", specs, fold_col="fold")
    fold = np.arange(500) % 5
    z, mean = np.zeros((500, 3)), np.zeros((500, 3))
    for f in range(5):
        rest = df.where(F.col("fold") != f)
        for i, s in enumerate(specs):
            m = G.solve(G.total(G.grams(rest, s.params.get("features", names), "y")), s.kind, s.params.get("alpha", 1.0))
            value = x[:, :len(m.weights)] @ np.array(m.weights) + m.intercept
            z[fold == f, i] = value[fold == f]
            mean[:, i] += value / 5
    got = sorted(tuple(r) for r in oof.collect())
    assert np.allclose([r[2:] for r in got], z, rtol=1e-7)
    zc, yc = z - z.mean(0), y - y.mean()
    v = np.linalg.solve(zc.T @ zc + np.eye(3), zc.T @ yc)
    want = (mean - z.mean(0)) @ v + y.mean()
    pred = {int(r.row_id): r.y_pred for r in predict(df).collect()}
    assert np.allclose([pred[i] for i in range(500)], want, rtol=1e-6)
    plan = oof._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one(spark, n):
    keys = [F.lit(k).cast("long") for k in M.round_keys(5)]
    image = [r[0] for r in M.with_image(spark.range(n), "id", n, keys, "t").select("t").collect()]
    assert sorted(image) == list(range(n))
    if n >= 1000:
        assert sum(a == i for i, a in enumerate(image)) < 20 and abs(np.corrcoef(image, range(n))[0, 1]) < 0.1


def test_dense_index_and_importance(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"), F.col("id").alias("v"))
    got = M.dense_index(df, ["k"]).collect()
    assert all(r.k == r._i for r in got) and len(got) == 1000
    x, y = data(800, 2)
    frame_, names = frame(spark, x, y)
    m = G.solve(G.total(G.grams(frame_, names, "y")), "linear")
    rows = M.permutation_importance(m, frame_.withColumn("label", F.col("y")), names, "id")
    got = {r.feature: r.importance for r in rows.collect()}
    # a shuffled feature adds 2 w^2 var(x) to the squared error
    for i, f in enumerate(names):
        want = 2 * m.weights[i] ** 2 * x[:, i].var() / y.var()
        assert abs(got[f] - want) < 0.1 * max(want, 0.05)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_importance_never_broadcasts_the_rows(spark):
    # a small file of all rows still takes too much of the driver: the join merges, whatever its size
    x, y = data(300, 2)
    frame_, names = frame(spark, x, y)
    m = G.solve(G.total(G.grams(frame_, names, "y")), "linear")
    rows = M.permutation_importance(m, frame_.withColumn("label", F.col("y")), names, "id")
    for _ in range(2):                          # as planned, and as run
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and "isnotnull(CASE" not in plan
        got = {r.feature: r.importance for r in rows.collect()}
    # the importances of the same shuffles in numpy
    images = spark.range(300)
    for j in range(2):
        for r in range(5):
            images = M.with_image(images, "id", 300, [F.lit(k).cast("long") for k in M.round_keys(42 + 1000 * j + r)], f"t{j}_{r}")
    to = {c: [row[c] for row in images.orderBy("id").collect()] for c in images.columns}
    sse = lambda z: ((y - z @ np.array(m.weights) - m.intercept) ** 2).sum()
    for j, f in enumerate(names):
        shuffled = [np.column_stack([x[to[f"t{j}_{r}"], i] if i == j else x[:, i] for i in range(2)]) for r in range(5)]
        assert np.isclose(got[f], np.mean([(sse(z) - sse(x)) / (y.var() * 300) for z in shuffled]), rtol=1e-9)


def test_splits_do_not_depend_on_the_engine(spark):
    import hashlib
    df = spark.createDataFrame([(f"k{i}", i) for i in range(200)] + [(None, 1)], "a string, b long")
    got = df.select("a", "b", M.split_flag(["a", "b"]).alias("s")).collect()
    text = lambda r: "|".join(str(x) for x in (r.a, r.b, 42) if x is not None)
    assert all(r.s == (int(hashlib.md5(text(r).encode()).hexdigest()[:8], 16) % 100 < 20) for r in got)
