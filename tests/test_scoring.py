from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from svmflow.functions.parsing import FEATURES_TYPE
from svmflow.functions.probability import couple_pairs, pair_probability
from svmflow.operators import scoring
from svmflow.operators.scoring import Scorer, noise_scale, score
from svmflow.sources.prediction_store import save_predictions
from svmflow.sources.model_store import (
    SUPPORT_SCHEMA,
    export_support_vectors,
    load_model,
    model_row,
    save_model,
)

DIMS = 6
SAMPLES = f"row_id bigint, target double, features {FEATURES_TYPE}"


def sparse(vector):
    return [(i + 1, float(v)) for i, v in enumerate(vector) if v != 0]


def draw_matrix(draw, n):
    return draw.normal(size=(n, DIMS)) * (draw.random((n, DIMS)) < 0.6)


@pytest.fixture(scope="module")
def setup(spark):
    draw = np.random.default_rng(5)
    x = draw_matrix(draw, 40)
    rows = spark.createDataFrame([(i, 1.0, sparse(v)) for i, v in enumerate(x)], SAMPLES)
    return draw, x, rows


def vectors(spark, model_id, sv, labels, coef):
    data = [
        (model_id, i, float(labels[i]), [float(c) for c in np.atleast_1d(coef[i])], sparse(sv[i])) for i in range(len(sv))
    ]
    return spark.createDataFrame(data, SUPPORT_SCHEMA)


def kernel(kind, a, b, gamma, coef0, degree):
    dots = a @ b.T
    if kind == "linear":
        return dots
    if kind == "polynomial":
        return (gamma * dots + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * dots + coef0)
    return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize("kind", ["linear", "polynomial", "rbf", "sigmoid"])
@pytest.mark.parametrize("svm_type", ["c_svc", "nu_svc", "one_class", "epsilon_svr", "nu_svr"])
def test_binary_kinds(spark, setup, kind, svm_type):
    draw, x, rows = setup
    sv, coef = draw_matrix(np.random.default_rng(1), 9), np.linspace(-1, 1, 9)
    label = [1, -1] if svm_type.endswith("svc") else None
    model = model_row(
        spark, "m", svm_type=svm_type, kernel_type=kind, gamma=0.3, coef0=0.2, degree=3, rho=[0.05], label=label
    )
    out = score(rows, model, vectors(spark, "m", sv, np.where(coef > 0, 1, -1), coef)).orderBy("row_id").collect()
    f = kernel(kind, x, sv, 0.3, 0.2, 3) @ coef - 0.05
    assert np.allclose([r["decision"][0] for r in out], f)
    expected = f if svm_type.endswith("svr") else np.where(f > 0, 1.0, -1.0)
    assert np.allclose([r["prediction"] for r in out], expected)
    assert out[0]["target"] == 1.0 and out[0]["model_id"] == "m" and out[0]["probability"] is None


def ovo(spark, draw, n_classes=4, per_class=5, **scalars):
    n = n_classes * per_class
    sv, coef = draw_matrix(draw, n), draw.normal(size=(n, n_classes - 1))
    position = np.repeat(np.arange(n_classes), per_class)
    labels = [7, 3, 9, 1, 5][:n_classes]
    rho = (draw.normal(size=n_classes * (n_classes - 1) // 2) * 0.1).tolist()
    model = model_row(spark, "m", kernel_type="rbf", gamma=0.4, rho=rho, label=labels, **scalars)
    return model, vectors(spark, "m", sv, np.array(labels)[position], coef), sv, coef, position, labels, rho


def pair_decisions(x, sv, coef, position, n_classes, rho):
    k = kernel("rbf", x, sv, 0.4, 0, 0)
    out = []
    for p, (i, j) in enumerate(combinations(range(n_classes), 2)):
        first, second = position == i, position == j
        out.append(k[:, first] @ coef[first, j - 1] + k[:, second] @ coef[second, i] - rho[p])
    return np.array(out).T


def test_votes_and_blocks(spark, setup):
    _, x, rows = setup
    model, sv_df, sv, coef, position, labels, rho = ovo(spark, np.random.default_rng(2))
    f = pair_decisions(x, sv, coef, position, 4, rho)
    votes = np.zeros((len(x), 4), int)
    for p, (i, j) in enumerate(combinations(range(4), 2)):
        for r in range(len(x)):
            votes[r, i if f[r, p] > 0 else j] += 1
    expected = np.array(labels, float)[votes.argmax(axis=1)]
    for block_bytes in (1 << 20, 400, 100):
        scorer = Scorer(model, sv_df, block_bytes=block_bytes)
        assert (scorer.n_blocks > 4) == (block_bytes < 1000)
        out = scorer.score(rows).orderBy("row_id").collect()
        assert np.allclose([r["decision"] for r in out], f)
        assert np.allclose([r["prediction"] for r in out], expected)


def test_chunks_meet_every_block(spark, setup, monkeypatch, tmp_path):
    """Many chunks and copies, two models of unequal size, other columns, and rows without features; and nothing stays."""
    monkeypatch.setattr(scoring, "CHUNK_ROWS", 3)
    monkeypatch.setattr(scoring, "CHUNKS_PER_BLOCK_COPY", 2)
    _, x, rows = setup
    draw = np.random.default_rng(4)
    parts, models, expected = [], [], {}
    for name, n, kind in (("a", 30, "rbf"), ("b", 3, "linear")):
        sv, coef = draw_matrix(draw, n), draw.normal(size=n)
        parts.append(vectors(spark, name, sv, np.sign(coef), coef))
        models.append(model_row(spark, name, kernel_type=kind, gamma=0.3, rho=[0.1], label=[1, -1]))
        expected[name] = np.append(kernel(kind, x, sv, 0.3, 0, 0), kernel(kind, np.zeros((1, DIMS)), sv, 0.3, 0, 0), axis=0) @ coef - 0.1
    more = rows.union(spark.createDataFrame([(40, None, [])], SAMPLES)).withColumn("label", F.lit("kept"))
    with Scorer(models[0].union(models[1]), parts[0].union(parts[1]), block_bytes=300) as scorer:
        out = scorer.score(more.repartition(3))
        assert out.columns == ["row_id", "target", "label", "model_id", "decision", "prediction", "probability"]
        found = out.orderBy("row_id").collect()
        written = [p for p in scorer._paths]
        assert scorer.score(more.limit(0)).count() == 0
    assert len(found) == 82 and {r["label"] for r in found} == {"kept"}
    for name, f in expected.items():
        mine = [r for r in found if r["model_id"] == name]
        assert np.allclose([r["decision"][0] for r in mine], f)
        assert [r["prediction"] for r in mine] == np.where(f > 0, 1.0, -1.0).tolist()
    assert written and not any(Path(p.removeprefix("file:")).exists() for p in written)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="land the files"):
        Scorer(models[0], parts[0], block_bytes=300).score(stream)


@pytest.mark.parametrize("k", [3, 4, 10])
def test_coupled_pairs_equal_the_linear_system(k):
    """The optimum solves a linear system (Q, 1; 1, 0) (p, b) = (0, 1): an independent way to it, with unequal pairs."""
    draw = np.random.default_rng(k)
    pairs = list(combinations(range(k), 2))
    chance = draw.uniform(0.02, 0.98, (50, len(pairs)))
    found = couple_pairs(chance, pairs, k)
    assert np.allclose(found.sum(axis=1), 1.0)
    for row, p in zip(chance, found, strict=True):
        r = np.zeros((k, k))
        for (i, j), value in zip(pairs, row, strict=True):
            r[i, j], r[j, i] = value, 1.0 - value
        q = np.zeros((k + 1, k + 1))
        for i in range(k):
            for j in range(k):
                q[i, j] = sum(r[s, i] ** 2 for s in range(k) if s != i) if i == j else -r[j, i] * r[i, j]
        q[:k, k] = q[k, :k] = 1.0
        exact = np.linalg.solve(q, np.append(np.zeros(k), 1.0))[:k]
        assert np.abs(p - exact).max() < 0.01
        assert (exact > -1e-9).all()


def test_several_models_in_one_pass(spark, setup):
    _, x, rows = setup
    sv, coef = draw_matrix(np.random.default_rng(3), 6), np.linspace(-1, 1, 6)
    models = [model_row(spark, n, kernel_type="rbf", gamma=g, rho=[0.0], label=[1, -1]) for n, g in (("a", 0.1), ("b", 2.0))]
    both = vectors(spark, "a", sv, np.sign(coef), coef).union(vectors(spark, "b", sv, np.sign(coef), coef))
    out = score(rows, models[0].union(models[1]), both)
    for name, gamma in (("a", 0.1), ("b", 2.0)):
        got = [r["decision"][0] for r in out.where(F.col("model_id") == name).orderBy("row_id").collect()]
        assert np.allclose(got, kernel("rbf", x, sv, gamma, 0, 0) @ coef)


def test_precomputed(spark):
    draw = np.random.default_rng(4)
    values, coef = draw.normal(size=(10, 5)), np.array([0.5, -0.25, 1.0])
    serial = [4, 1, 5]
    rows = spark.createDataFrame(
        [(i, 1.0, [(0, float(i + 1))] + [(k + 1, float(v)) for k, v in enumerate(row)]) for i, row in enumerate(values)], SAMPLES
    )
    sv = spark.createDataFrame([("m", i, 1.0, [float(c)], [(0, float(s))]) for i, (c, s) in enumerate(zip(coef, serial))], SUPPORT_SCHEMA)
    model = model_row(spark, "m", svm_type="nu_svr", kernel_type="precomputed", rho=[0.1])
    out = score(rows, model, sv).orderBy("row_id").collect()
    assert np.allclose([r["prediction"] for r in out], values[:, [s - 1 for s in serial]] @ coef - 0.1)


def best_probabilities(chance, pairs, k):
    """The minimum by the linear system of its optimality conditions."""
    r = np.zeros((k, k))
    for p, (i, j) in enumerate(pairs):
        r[i, j], r[j, i] = chance[p], 1 - chance[p]
    q = -r * r.T
    q[np.diag_indices(k)] = (r**2).sum(axis=0)
    system = np.block([[q, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
    return np.linalg.solve(system, np.r_[np.zeros(k), 1.0])[:k]


@pytest.mark.parametrize("k", [2, 3, 5])
def test_coupling_is_the_minimum(k):
    pairs = list(combinations(range(k), 2))
    chance = np.random.default_rng(k).uniform(0.05, 0.95, size=(50, len(pairs)))
    found = couple_pairs(chance, pairs, k)
    assert np.allclose(found.sum(axis=1), 1.0)
    for row, p in zip(chance, found):
        expected = [row[0], 1 - row[0]] if k == 2 else best_probabilities(row, pairs, k)
        assert np.allclose(p, expected, atol=0.01)


def test_probability_columns(spark, setup):
    _, x, rows = setup
    a, b = [-1.0, -2.0, -0.5], [0.1, 0.0, -0.1]
    model, sv_df, sv, coef, position, labels, rho = ovo(spark, np.random.default_rng(6), 3, prob_a=a, prob_b=b)
    out = score(rows, model, sv_df, probability=True).orderBy("row_id").collect()
    chance = pair_probability(pair_decisions(x, sv, coef, position, 3, rho), tuple(a), tuple(b))
    expected = couple_pairs(chance, list(combinations(range(3), 2)), 3)
    assert np.allclose([[r["probability"][v] for v in labels] for r in out], expected)
    assert [r["prediction"] for r in out] == [float(labels[i]) for i in expected.argmax(axis=1)]
    plain = model_row(spark, "m", rho=[0.0] * 3, label=labels)
    with pytest.raises(ValueError, match="probability"):
        Scorer(plain, sv_df, probability=True)


def test_extreme_decisions_stay_inside_the_clamp():
    p = pair_probability(np.array([[-1e6], [0.0], [1e6]]), (-1.0,), (0.0,))
    assert p[0, 0] == 1e-7 and p[1, 0] == 0.5 and p[2, 0] == 1 - 1e-7


def test_noise_scale(spark):
    models = model_row(spark, "r", svm_type="epsilon_svr", rho=[0.0], prob_a=[0.7]).union(
        model_row(spark, "c", rho=[0.0], label=[1, -1])
    )
    assert [tuple(r) for r in noise_scale(models).collect()] == [("r", 0.7)]


def test_model_store(spark, tmp_path):
    path = str(tmp_path / "store")
    sv = vectors(spark, "m", np.array([[1.0, 0, 2.5, 0, 0, 0], [0, 0, 0, 0, 0, 0]]), [1, -1], [0.25, -0.25])
    model = model_row(spark, "m", gamma=0.5, c=1.0, total_sv=2, rho=[0.1], label=[1, -1], n_sv=[1, 1])
    other = model_row(spark, "n", gamma=0.9, c=1.0, rho=[0.2], label=[1, -1])
    save_model(model, sv, path, run_ts="20240101000000")
    save_model(model.withColumn("gamma", F.lit(0.7)), sv, path, run_ts="20240102000000")
    save_model(other, sv.withColumn("model_id", F.lit("n")), path, run_ts="20240103000000")
    for _ in range(2):
        save_model(model.withColumn("gamma", F.lit(0.8)), sv, path, run_ts="20240102000000")
    models, stored = load_model(spark, path, "m")
    assert models.first()["gamma"] == 0.8 and models.count() == 1 and stored.count() == 2
    assert models.first()["rho"] == [0.1] and models.first()["n_sv"] == [1, 1]
    old, _ = load_model(spark, path, "m", run_ts="20240101000000")
    assert old.first()["gamma"] == 0.5
    assert load_model(spark, path, "n")[0].first()["gamma"] == 0.9
    for missing in ({"model_id": "x"}, {"model_id": "m", "run_ts": "1"}):
        with pytest.raises(LookupError):
            load_model(spark, path, **missing)
    lines = export_support_vectors(stored, models, run_ts="t").orderBy("sv_id").collect()
    assert [r["line"] for r in lines] == ["+1 1:1.0 3:2.5 ", "-1 "], "true labels, also for free vectors"
    assert (lines[0]["c"], lines[0]["g"], lines[0]["run_ts"]) == (1.0, 0.8, "t")


def test_missing_model(spark, setup):
    _, _, rows = setup
    model = model_row(spark, "m", rho=[0.0], label=[1, -1])
    with pytest.raises(LookupError):
        Scorer(model.where("false"), spark.createDataFrame([], SUPPORT_SCHEMA))
    empty = score(rows, model, spark.createDataFrame([], SUPPORT_SCHEMA)).first()
    assert empty["decision"] == [0.0] and empty["prediction"] == -1.0


def test_rows_without_features(spark, setup):
    sv = np.array([[1.0, 0, 0, 0, 0, 2.0]])
    model = model_row(spark, "m", kernel_type="rbf", gamma=0.1, rho=[0.0], label=[1, -1])
    rows = spark.createDataFrame([(0, 1.0, []), (1, 1.0, [(50, 3.0)])], SAMPLES)
    out = score(rows, model, vectors(spark, "m", sv, [1], [1.0])).orderBy("row_id").collect()
    assert np.allclose([r["decision"][0] for r in out], [np.exp(-0.5), np.exp(-1.4)])


def test_one_run_keeps_every_model(spark, setup, tmp_path):
    draw, x, rows = setup
    sv, coef = draw_matrix(np.random.default_rng(8), 6), np.linspace(-1, 1, 6)
    models = [model_row(spark, m, svm_type=t, kernel_type="linear", rho=[0.0], label=label)
              for m, t, label in (("a", "c_svc", [1, -1]), ("b", "c_svc", [1, -1]), ("c", "epsilon_svr", None))]
    parts = [vectors(spark, m, sv, np.sign(coef), coef) for m in "abc"]
    scorer = Scorer(models[0].union(models[1]).union(models[2]), parts[0].union(parts[1]).union(parts[2]))
    path = str(tmp_path / "store")
    save_predictions(scorer.score(rows), path, [m for m in scorer.models if m.model_id != "b"], run_ts="20240101000000")
    save_predictions(scorer.score(rows), path, next(m for m in scorer.models if m.model_id == "b"), run_ts="20240101000000")
    counts = {r["model_id"]: r["count"] for r in spark.read.parquet(f"{path}/predictions").groupBy("model_id").count().collect()}
    assert counts == {"a": 40, "b": 40, "c": 40}
    assert {r["model_id"] for r in spark.read.option("mergeSchema", True).parquet(f"{path}/metrics").collect()} == {"a", "b", "c"}


def test_prediction_store(spark, setup, tmp_path):
    draw, x, rows = setup
    sv, coef = draw_matrix(np.random.default_rng(8), 6), np.linspace(-1, 1, 6)
    for svm_type, label in (("c_svc", [1, -1]), ("epsilon_svr", None)):
        path = str(tmp_path / svm_type)
        model = model_row(spark, "m", svm_type=svm_type, kernel_type="linear", rho=[0.0], label=label)
        scorer = Scorer(model, vectors(spark, "m", sv, np.sign(coef), coef))
        for _ in range(2):
            save_predictions(scorer.score(rows), path, scorer.models[0], run_ts="20240101000000")
        save_predictions(scorer.score(rows.limit(3)), path, scorer.models[0], run_ts="20240102000000")
        stored = spark.read.parquet(f"{path}/predictions")
        assert sorted(r["count"] for r in stored.groupBy("run_ts").count().collect()) == [3, 40]
        metrics = {r["total"]: r for r in spark.read.parquet(f"{path}/metrics").collect()}
        assert set(metrics) == {3, 40}
        f = x @ sv.T @ coef
        if label:
            assert metrics[40]["accuracy"] == pytest.approx((f > 0).mean() * 100)
        else:
            assert metrics[40]["mse"] == pytest.approx(((f - 1.0) ** 2).mean())
