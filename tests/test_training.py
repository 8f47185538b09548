import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, rbf, to_matrix, training_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from svmflow.functions import solver, sparse
from svmflow.functions.solver import RbfKernel, offset, solve
from svmflow.functions.sparse import SparseRows
from svmflow.operators import cascade, large_group
from svmflow.operators.cascade import (
    _model_table,
    cascade_predict,
    cascade_train,
    cross_validate,
    grid_search,
    support_vector_rows,
)
from svmflow.operators.grid import param_grid
from svmflow.operators.large_group import train_large_groups
from svmflow.operators.split import stratified_split
from svmflow.operators.subset_train import (
    Cell,
    default_gamma,
    feature_dim,
    precomputed_check,
    train_subsets,
    trained_schema,
)
from svmflow.plans import fixtures as fx
from svmflow.session import shared_dir

CELL = Cell("m", 1.0, 0.5)
EPS = 1e-3


def kkt_gap(kernel, y, alpha, c):
    score = -y * (y * (kernel @ (y * alpha)) - 1.0)
    up = np.where(y > 0, alpha < c, alpha > 0)
    down = np.where(y > 0, alpha > 0, alpha < c)
    return score[up].max() - score[down].min()


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(2, 60), c=st.sampled_from([0.1, 1.0, 10.0]), copies=st.booleans())
def test_solver_meets_the_optimality_conditions(seed, n, c, copies):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3))
    if copies:
        x[n // 3 :] = x[0]
    y = np.where(draw.random(n) < 0.5, 1.0, -1.0)
    y[0], y[1] = 1.0, -1.0
    kernel = rbf(x, x, 0.5)
    alpha, gradient = solve(kernel, y, c, EPS)
    assert abs(alpha @ y) < 1e-9
    assert (alpha >= 0).all() and (alpha <= c).all()
    assert kkt_gap(kernel, y, alpha, c) < EPS + 1e-9
    assert np.isfinite(offset(alpha, y, gradient, c))


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("cache_rows", [0, 3, 10_000])
def test_solver_with_a_small_cache_and_rows_set_aside(monkeypatch, wide, cache_rows):
    """Kernel rows on demand, from dense or from sparse rows, give an optimum as good as the whole matrix does."""
    monkeypatch.setattr(solver, "SHRINK_EVERY", 50)
    if wide:
        monkeypatch.setattr(solver, "STRIP_COLUMNS", 10)
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 64)) * (draw.random((400, 64)) < 0.4)
    y = np.where(x @ draw.normal(size=64) + draw.normal(size=400) > 0, 1.0, -1.0)
    sizes = (x != 0).sum(axis=1)
    rows = SparseRows(np.concatenate([[0], np.cumsum(sizes)]), np.nonzero(x)[1] + 1, x[x != 0])
    whole = rbf(x, x, 0.02)
    kernel = RbfKernel(rows, 0.02, cache_bytes=8 * 400 * cache_rows)
    assert (kernel.matrix is not None) == (cache_rows >= 400)
    assert np.allclose(kernel.row(7), whole[7])
    alpha, gradient = solve(kernel, y, 1.0, EPS)
    assert abs(alpha @ y) < 1e-9 and (alpha >= 0).all() and (alpha <= 1.0).all()
    assert np.allclose(gradient, y * (whole @ (y * alpha)) - 1.0)
    assert kkt_gap(whole, y, alpha, 1.0) < EPS + 1e-9
    assert len(getattr(kernel, "cache", ())) <= max(2, cache_rows)
    alone, _ = solve(whole, y, 1.0, EPS)
    objective = lambda a: 0.5 * (a * y) @ whole @ (a * y) - a.sum()
    assert objective(alpha) == pytest.approx(objective(alone), abs=0.02)
    again, _ = solve(RbfKernel(rows, 0.02, cache_bytes=8 * 400 * cache_rows), y, 1.0, EPS, alpha, gradient)
    assert (again == alpha).all(), "an optimum is left as it is"


def test_a_block_of_any_size_keeps_to_its_kernel_cache():
    """Matrices and what they are made with: a task's memory does not rise with the rows of its group."""
    draw = np.random.default_rng(3)
    rows = SparseRows(np.arange(0, 2 * 3500 + 1, 2), np.tile([1, 2], 3500), draw.normal(size=7000))
    for n in (1900, 3500):
        tracemalloc.start()
        kernel = RbfKernel(rows.rows(0, n), 0.5)
        every = np.arange(n)
        kernel.pulls(every, every[: n // 2], np.ones(n // 2))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20


@pytest.fixture(scope="module")
def data(spark):
    df = training_rows(spark).cache()
    rows = df.orderBy("row_id").collect()
    yield df, to_matrix(rows), np.array([r["label"] for r in rows]), [r["row_id"] for r in rows]
    df.unpersist()


@pytest.fixture(scope="module")
def single(data):
    _, x, y, _ = data
    kernel = rbf(x, x, 0.5)
    alpha, gradient = solve(kernel, y, 1.0, EPS)
    return alpha, np.sign(kernel @ (y * alpha) - offset(alpha, y, gradient, 1.0))


def test_subsets_meet_the_optimality_conditions(spark, data):
    df, x, y, ids = data
    place = {r: i for i, r in enumerate(ids)}
    out = train_subsets(stratified_split(df, 3), [CELL], n_subsets=3, keep_all=True).collect()
    assert sorted(r["row_id"] for r in out) == ids
    for k in range(3):
        part = [r for r in out if r["subset_id"] == k]
        at = [place[r["row_id"]] for r in part]
        alpha = np.array([r["alpha"] for r in part])
        assert abs(alpha @ y[at]) < 1e-9
        assert kkt_gap(rbf(x[at], x[at], 0.5), y[at], alpha, 1.0) < EPS + 1e-9


@pytest.mark.parametrize("n", [1, 3, 4])
def test_cascade_agrees_with_one_solve(spark, data, single, n):
    df, x, y, ids = data
    result = cascade_train(df, [CELL], n_subsets=n)
    model = result.models.first()
    vectors = result.support_vectors.orderBy("row_id").collect()
    assert model["total_sv"] == len(vectors) == sum(model["n_sv"])
    place = {r: i for i, r in enumerate(ids)}
    at = [place[v["row_id"]] for v in vectors]
    coef = np.array([v["coef"][0] for v in vectors])
    assert abs(coef.sum()) < 1e-9 and (np.abs(coef) <= 1.0).all() and (np.sign(coef) == y[at]).all()
    predicted = np.sign(rbf(x, x[at], 0.5) @ coef - model["rho"][0])
    assert (predicted == single[1]).mean() >= 0.99
    if n == 1:
        assert set(at) == set(np.flatnonzero(single[0] > 0))
    layers = result.layers().groupBy("layer").agg(F.count_distinct("subset_id").alias("n")).orderBy("layer").collect()
    assert [r["n"] for r in layers] == {1: [1], 3: [3, 2, 1], 4: [4, 2, 1]}[n]


def test_same_seed_same_model(spark, data):
    df, *_ = data
    found = []
    for parts in (1, 4, 8):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            result = cascade_train(df.repartition(parts), [CELL], n_subsets=4)
            found.append(sorted((r["row_id"], r["coef"][0]) for r in result.support_vectors.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert found[0] == found[1] == found[2]


def test_cells_trained_together_equal_cells_trained_alone(spark, data):
    df, *_ = data
    cells = [Cell("a", 1.0, 0.5), Cell("b", 0.5, 1.5), Cell("c", 10.0, None)]
    together = cascade_train(df, cells, n_subsets=4)
    for cell in cells:
        alone = cascade_train(df, [cell], n_subsets=4)
        pick = together.support_vectors.where(F.col("model_id") == cell.model_id)
        assert sorted((r["row_id"], r["coef"][0]) for r in pick.collect()) == sorted(
            (r["row_id"], r["coef"][0]) for r in alone.support_vectors.collect()
        )
    gammas = {r["model_id"]: r["gamma"] for r in together.models.collect()}
    assert gammas == {"a": 0.5, "b": 1.5, "c": 0.5}, "unset gamma is 1/2 with two dimensions"


@pytest.mark.parametrize("noise", [0, 3])
def test_large_group_equals_one_solve(spark, data, noise, tmp_path):
    """Also where labels are noise in part, so that most rows end as support vectors."""
    df, x, y, ids = data
    y = np.where(np.array(ids) * 7919 % 10 < noise, -y, y)
    flip = F.col("row_id") * 7919 % 10 < noise
    df = df.withColumn("label", F.when(flip, -F.col("label")).otherwise(F.col("label")))
    alone, gradient = solve(rbf(x, x, 0.5), y, 1.0, EPS)
    group = df.select(
        F.lit("m").alias("model_id"), F.lit(0).alias("subset_id"), "row_id", "label", "features",
        F.lit(1.0).alias("c"), F.lit(0.5).alias("gamma"),
    )
    out = train_large_groups(
        group, trained_schema(df), str(tmp_path / "out"), largest=len(ids), eps=EPS, working_rows=150, chunk_rows=70
    ).collect()
    alpha = np.zeros(len(ids))
    place = {r: i for i, r in enumerate(ids)}
    for row in out:
        alpha[place[row["row_id"]]] = row["alpha"]
    kernel = rbf(x, x, 0.5)
    assert abs(alpha @ y) < 1e-9 and (alpha >= 0).all() and (alpha <= 1.0).all()
    assert kkt_gap(kernel, y, alpha, 1.0) < EPS + 1e-6

    def objective(a):
        return 0.5 * (a * y) @ kernel @ (a * y) - a.sum()

    assert objective(alpha) == pytest.approx(objective(alone), abs=0.05)
    predicted = np.sign(kernel @ (y * alone) - offset(alone, y, gradient, 1.0))
    assert (np.sign(kernel @ (y * alpha) - out[0]["rho"]) == predicted).mean() >= 0.99


def test_groups_over_the_limit_are_still_solved(spark, data, single):
    """A limit below the merged sizes sends them through the distributed solver."""
    df, x, y, ids = data
    result = cascade_train(df, [CELL, Cell("n", 1.0, 1.0)], n_subsets=2, block_rows=200)
    place = {r: i for i, r in enumerate(ids)}
    vectors = result.support_vectors.where("model_id = 'm'").collect()
    at = [place[v["row_id"]] for v in vectors]
    rho = result.models.where("model_id = 'm'").first()["rho"][0]
    predicted = np.sign(rbf(x, x[at], 0.5) @ np.array([v["coef"][0] for v in vectors]) - rho)
    assert (predicted == single[1]).mean() >= 0.99
    assert result.models.count() == 2


def test_subsets_of_one_class_keep_their_rows(spark):
    """Two positives in four subsets: at least two subsets have no positive row."""
    pair = F.array(F.struct(F.lit(1).alias("idx"), F.col("id").cast("double").alias("val")))
    df = spark.range(40).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 2, 1.0).otherwise(-1.0).alias("label"), pair.alias("features")
    )
    result = cascade_train(df, [Cell("m", 1.0, 0.1)], n_subsets=4)
    first = result.layers().where("layer = 1").groupBy("subset_id").agg(F.max("label").alias("top"), F.count("*").alias("n"))
    lone = {r["subset_id"]: r["n"] for r in first.collect() if r["top"] < 0}
    assert set(lone.values()) <= {9, 10} and len(lone) == 2
    assert result.models.first()["n_sv"][0] == 2
    limited = cascade_train(df, [Cell("m", 1.0, 0.1)], n_subsets=4, block_rows=18)
    assert limited.models.first()["n_sv"][0] == 2
    with pytest.raises(ValueError, match="both classes"):
        cascade_train(df.where("label < 0"), [CELL])


def test_only_results_stay(spark, data, monkeypatch):
    """Rounds, splits and counts are removed at the end of a run, and when it fails."""
    df, *_ = data
    root = Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.iterdir())
    result = cascade_train(df, [CELL], n_subsets=2, block_rows=200)
    (left,) = set(root.iterdir()) - before
    assert str(left) == result.layers_path.removeprefix("file:")
    monkeypatch.setattr(cascade, "merge_pairs", lambda df: df.no_such_column)
    with pytest.raises(Exception, match="no_such_column"):
        cascade_train(df, [CELL], n_subsets=2, block_rows=200)
    assert all(p.name.startswith("cascade-") and "run" not in p.name for p in set(root.iterdir()) - before)


def test_gamma_scopes(spark, data):
    df, *_ = data
    assert feature_dim(df).first()["max_index"] == 2
    assert default_gamma(df).first()["gamma"] == 0.5
    none = df.withColumn("features", F.slice("features", 1, 0))
    assert (feature_dim(none).first()["max_index"], default_gamma(none).first()["gamma"]) == (0, 0.0)
    whole = cascade_train(df, [Cell("m")], n_subsets=2, gamma_scope="subset")
    assert whole.models.first()["gamma"] == 0.5
    with pytest.raises(ValueError):
        cascade_train(df, [Cell("m")], gamma_scope="row")


def test_support_vector_rows_keep_all_columns(spark, data):
    df, *_ = data
    result = cascade_train(df, [CELL], n_subsets=2)
    kept = support_vector_rows(df, result, "m")
    assert kept.columns == df.columns
    assert kept.count() == result.models.first()["total_sv"]


def test_cascade_predict_and_grid_search(spark, data):
    df, *_ = data
    predictions, acc = cascade_predict(cascade_train(df, [CELL], n_subsets=2), df)
    row = acc.first()
    assert predictions.count() == row["total"] == 500
    assert row["accuracy"] >= 98.0
    grid = param_grid(spark, 1.0, 0.5, 0.5, 0.5, 1.5, 1.0)
    found = grid_search(df, df, grid, n_subsets=2).collect()
    assert len(found) == 4
    assert [r["acc"] for r in found] == sorted((r["acc"] for r in found), reverse=True)


def test_predictions_are_scored_once(spark, data):
    """They are the rows times the support vectors: what is asked of them reads the written predictions."""
    df, *_ = data
    result = cascade_train(df, [Cell("m", gamma=0.5)], n_subsets=2)
    predictions, acc = cascade_predict(result, df)
    for asked in (predictions, acc):
        assert "MapInArrow" not in asked._jdf.queryExecution().toString()
    assert predictions.count() == acc.first()["total"] == df.count()


def test_columns_of_pulling_rows_are_found_once(monkeypatch):
    """Not again for every block of the rows that they pull on."""
    found, real = [], sparse.column_strips
    monkeypatch.setattr(sparse, "column_strips", lambda rows: found.append(1) or real(rows))
    monkeypatch.setattr(large_group, "KERNEL_CELLS", 40)
    x = np.random.default_rng(2).normal(size=(20, 2))
    rows = SparseRows(np.arange(0, 41, 2), np.tile([1, 2], 20), x.ravel())
    part = large_group.Packed(pa.array(range(20)), np.ones((3, 20)), rows)
    assert np.allclose(large_group._pulled(part, part, np.ones(20), 0.5), rbf(x, x, 0.5).sum(axis=1))
    assert len(found) == 1


def test_cross_validation_holds_every_row_out_once(spark, data):
    df, x, y, ids = data
    grid = param_grid(spark, 1.0, 1.0, 0.5, 0.5, 1.5, 1.5)
    found = cross_validate(df, grid, folds=3, n_subsets=2).collect()
    assert [r["total"] for r in found] == [500] * 4
    assert all(r["acc"] == pytest.approx(100.0 * r["correct"] / 500) and r["acc"] >= 95 for r in found)
    (best,) = [r for r in found if r["best"]]
    assert (best["acc"], -best["c"], -best["g"]) == max((r["acc"], -r["c"], -r["g"]) for r in found)


def test_plans_do_not_grow_with_the_grid(spark, data):
    df, *_ = data
    subsets = stratified_split(df, 2, label="label")

    def size(n):
        cells = [Cell(f"cell-{i}", 1.0 + i, 0.5) for i in range(n)]
        trained = train_subsets(subsets, cells, n_subsets=2)
        again = train_subsets(trained.drop("rho").where("alpha > 0"), cells, n_subsets=2)
        return len(_model_table(again, cells)._jdf.queryExecution().analyzed().toString())

    assert size(1000) < 1.05 * size(10)


def test_precomputed_check(spark):
    rows = [(1, [(0, 1.0), (1, 5.0)]), (2, [(1, 1.0)]), (3, [(0, 0.0)]), (4, [(0, 9.0)]), (5, []), (6, [(0, 2.9)])]
    df = spark.createDataFrame(rows, "row_id int, features array<struct<idx:int,val:double>>")
    bad = {r["row_id"]: r["reason"] for r in precomputed_check(df, 2).collect()}
    first, serial = "first column must be 0:sample_serial_number", "sample_serial_number out of range"
    assert bad == {2: first, 3: serial, 4: serial, 5: first}


@pytest.fixture(scope="module")
def wide(spark):
    df = fx.wide_samples(spark, SF).cache()
    rows = df.orderBy("row_id").collect()
    yield df, to_matrix(rows, 64), np.array([r["label"] for r in rows]), [r["row_id"] for r in rows]
    df.unpersist()


@pytest.mark.parametrize("block_rows", [4000, 240])
def test_wide_cascade_against_one_solve(spark, wide, block_rows):
    """64 dimensions: decision values of the cascade against those of a solve of all rows, and the optimum of its last group."""
    df, x, y, ids = wide
    kernel = rbf(x, x, 0.5)
    alpha, gradient = solve(kernel, y, 1.0, EPS)
    alone = kernel @ (y * alpha) - offset(alpha, y, gradient, 1.0)
    result = cascade_train(df, [CELL], n_subsets=2, block_rows=block_rows)
    predictions, acc = cascade_predict(result, df)
    found = np.array([r["decision"][0] for r in predictions.orderBy("row_id").collect()])
    assert np.corrcoef(found, alone)[0, 1] > 0.99
    assert ((found > 0) == (alone > 0)).mean() >= 0.97
    assert acc.first()["accuracy"] == pytest.approx(100.0 * ((found > 0) == (y > 0)).mean())
    # What survives each layer meets the optimality conditions of its group, and what the last layer dropped had no weight.
    place = {r: i for i, r in enumerate(ids)}
    layers = {n: {place[r["row_id"]]: r["alpha"] for r in result.layers().where(F.col("layer") == n).collect()} for n in (1, 2)}
    group = sorted(layers[1])
    final = np.array([layers[2].get(i, 0.0) for i in group])
    assert set(layers[2]) <= set(group)
    assert kkt_gap(kernel[np.ix_(group, group)], y[group], final, 1.0) < EPS + 1e-6
    objective = lambda a: 0.5 * (a * y) @ kernel @ (a * y) - a.sum()
    whole = np.zeros(len(ids))
    whole[group] = final
    assert objective(whole) >= objective(alpha) - 1e-6
    assert objective(whole) == pytest.approx(objective(alpha), rel=0.02)


def test_fixture_labels(spark):
    assert fx.training_samples(spark, SF).where("label_text not in ('+1', '-1')").isEmpty()


def test_wide_samples_hold_whole_embeddings(spark):
    rows = fx.wide_samples(spark, SF).collect()
    assert {tuple(f["idx"] for f in r["features"]) for r in rows} == {tuple(range(1, 65))}
    for r in rows:
        total = sum(f["val"] * w for f, w in zip(r["features"], fx.WIDE_WEIGHTS, strict=True))
        assert r["label_text"] == ("+1" if total > 0 else "-1") and r["label"] == float(r["label_text"])
