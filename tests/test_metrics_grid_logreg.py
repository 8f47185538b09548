import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from svmflow.functions.vectors import dot, literal_vector, vector_sum
from svmflow.operators.grid import GRID_SCHEMA, expand_grid, param_grid
from svmflow.operators.logreg import fit_logreg, point_gradients, weights_frame
from svmflow.operators.metrics import accuracy, regression_error


def pairs(spark, rows):
    return spark.createDataFrame(rows, "prediction double, target double")


def test_accuracy(spark):
    row = accuracy(pairs(spark, [(1.0, 1.0), (1.0, -1.0), (-1.0, -1.0)])).first()
    assert (row["total"], row["correct"]) == (3, 2) and row["accuracy"] == 2 / 3 * 100
    assert accuracy(pairs(spark, [])).first()["accuracy"] is None


def test_regression(spark):
    draw = np.random.default_rng(0)
    v = draw.normal(size=200)
    y = 0.5 * v + draw.normal(size=200)
    row = regression_error(pairs(spark, [(float(a), float(b)) for a, b in zip(v, y)])).first()
    assert row["mse"] == pytest.approx(((v - y) ** 2).mean())
    assert row["squared_correlation"] == pytest.approx(np.corrcoef(v, y)[0, 1] ** 2)
    constant = regression_error(pairs(spark, [(1.0, 2.0), (1.0, 3.0)])).first()
    assert constant["mse"] == 2.5 and constant["squared_correlation"] is None
    assert regression_error(pairs(spark, [])).first()["mse"] is None


def loop_grid(c_step, g_step, c_init, g_init, c_max, g_max):
    out, i = [], 0
    while c_init + c_step * i <= c_max:
        j = 0
        while g_init + g_step * j <= g_max:
            out.append((c_init + c_step * i, g_init + g_step * j))
            j += 1
        i += 1
    return out


def test_grids_equal_a_loop(spark):
    draw = random.Random(1)
    specs = [(0.1, 0.1, 0.1, 0.1, 0.3, 0.7), (1.0, 1.0, 2.0, 1.0, 1.0, 3.0), (0.5, 0.25, -1.0, 0.0, -1.0, 1.0)]
    for _ in range(60):
        step = [round(draw.uniform(0.01, 1), 2) for _ in range(2)]
        init = [round(draw.uniform(-1, 1), 2) for _ in range(2)]
        specs.append((*step, *init, *(i + s * draw.randrange(0, 12) for i, s in zip(init, step))))
    df = spark.createDataFrame([(k, *s) for k, s in enumerate(specs)], f"k int, {GRID_SCHEMA}")
    found = {}
    for row in expand_grid(df).collect():
        found.setdefault(row["k"], []).append((row["c"], row["g"]))
    for k, spec in enumerate(specs):
        assert sorted(found.get(k, [])) == sorted(loop_grid(*spec)), spec


def test_grid_rejects_steps_that_never_end(spark):
    for steps in ((0.0, 1.0), (1.0, -0.5)):
        with pytest.raises(PySparkException, match="must be positive"):
            param_grid(spark, *steps, 0.0, 0.0, 1.0, 1.0).collect()


def points(spark, n=200, dims=10, scale=1.0):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(n, dims)) * scale
    y = np.where(x[:, 0] + 0.3 * draw.normal(size=n) > 0, 1.0, -1.0)
    df = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y)], "y double, x array<double>")
    return df, x, y


def gradient(w, x, y):
    with np.errstate(over="ignore"):
        return ((1 / (1 + np.exp(-y * (x @ w))) - 1) * y)[:, None] * x


def test_gradient_descent(spark):
    df, x, y = points(spark)
    w = np.full(10, 0.1)
    rows = point_gradients(df, list(w)).select(*(f"g{i}" for i in range(10))).toPandas().to_numpy()
    assert np.allclose(np.sort(rows, axis=0), np.sort(gradient(w, x, y), axis=0))
    for _ in range(4):
        w = w - gradient(w, x, y).sum(axis=0)
    assert np.allclose(fit_logreg(df, 4, initial=[0.1] * 10), w)
    frame = weights_frame(df, list(w)).orderBy("i").collect()
    assert np.allclose([r["w"] for r in frame], w)


def test_steep_margins_do_not_fail(spark):
    df, x, y = points(spark, scale=500.0)
    w = np.ones(10)
    assert np.allclose(fit_logreg(df, 1, initial=list(w)), w - gradient(w, x, y).sum(axis=0))


def test_starting_weights(spark):
    df, *_ = points(spark, n=5)
    start = fit_logreg(df, 0)
    assert len(start) == 10 and all(-1 <= v <= 1 for v in start) and start == fit_logreg(df, 0)
    assert start != fit_logreg(df, 0, seed=1)
    assert fit_logreg(df.where("false"), 2, initial=[0.5] * 10) == [0.5] * 10
    with pytest.raises(ValueError):
        fit_logreg(df, 1, initial=[0.0])


def test_vectors(spark):
    df, x, _ = points(spark, n=30)
    total = df.agg(vector_sum("x").alias("s")).first()["s"]
    assert np.allclose(total, x.sum(axis=0))
    weights = [float(i) for i in range(10)]
    found = df.select(dot([F.col("x")[i] for i in range(10)], literal_vector(weights)).alias("d")).collect()
    assert math.isclose(sum(r["d"] for r in found), float((x @ np.array(weights)).sum()), rel_tol=1e-9)
