"""Queries on scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svmflow.operators import metrics
from svmflow.operators.scoring import Scorer, noise_scale
from svmflow.plans import fixtures as fx
from svmflow.plans.registry import query
from svmflow.session import scratch_path
from svmflow.sources.model_store import export_support_vectors, load_model, save_model
from svmflow.sources.prediction_store import save_predictions
from svmflow.sources.text import SOURCE_FILE
from svmflow.streaming.ingest import file_accuracy, score_arrivals, score_stream

GAMMA = 1.0 / 64.0

_PAIRS = "CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END"
# Sums of each row against each centroid: dot product, distance.
_CROSS = """
    cent AS (
        SELECT label AS sv_id, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
    cross_terms AS (
        SELECT e.vec_id AS row_id, e.label::DOUBLE AS target, c.sv_id,
               sum(e.embedding[c.i]::DOUBLE * c.m) AS d,
               sum((e.embedding[c.i]::DOUBLE - c.m) * (e.embedding[c.i]::DOUBLE - c.m)) AS dist
        FROM embeddings e, cent c GROUP BY e.vec_id, e.label, c.sv_id)
"""


def _binary_sql(kernel: str, rho: float, output: str) -> str:
    return f"""
        WITH {_CROSS},
        f AS (SELECT row_id, target, sum(CASE WHEN sv_id < 5 THEN 1.0 ELSE -1.0 END * {kernel}) - {rho} AS f
              FROM cross_terms GROUP BY row_id, target)
        SELECT row_id, round(f, 9) + 0.0 AS decision, {output} FROM f
    """


_SIGN = "CASE WHEN f > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS prediction"


def _score(spark: SparkSession, sf_dir: str, **scalars) -> DataFrame:
    models, vectors = fx.binary_model(spark, sf_dir, "fixed", **scalars)
    scored = Scorer(models, vectors).score(fx.embedding_samples(spark, sf_dir))
    return scored.select("row_id", F.round(F.col("decision")[0], 9).alias("decision"), "prediction")


@query(_binary_sql(f"exp(-{GAMMA}::DOUBLE * dist)", 0.0, _SIGN))
def svm_score_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir, kernel_type="rbf", gamma=GAMMA)


@query(_binary_sql(f"exp(-{GAMMA}::DOUBLE * dist)", 0.0, _SIGN))
def svm_score_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with support vectors beyond one block, which rows meet in a shuffle."""
    models, vectors = fx.binary_model(spark, sf_dir, "fixed", kernel_type="rbf", gamma=GAMMA)
    scored = Scorer(models, vectors, block_bytes=1500).score(fx.embedding_samples(spark, sf_dir))
    return scored.select("row_id", F.round(F.col("decision")[0], 9).alias("decision"), "prediction")


@query(_binary_sql("d", 0.01, _SIGN))
def svm_score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir, kernel_type="linear", rho=[0.01])


@query(_binary_sql("pow(2.0::DOUBLE * d + 0.5, 3)", 0.0, _SIGN))
def svm_score_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir, kernel_type="polynomial", gamma=2.0, coef0=0.5, degree=3)


@query(_binary_sql("tanh(2.0::DOUBLE * d + 0.5)", 0.0, _SIGN))
def svm_score_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir, kernel_type="sigmoid", gamma=2.0, coef0=0.5)


@query(_binary_sql(f"exp(-{GAMMA}::DOUBLE * dist)", 0.25, "round(f, 9) + 0.0 AS prediction"))
def svm_score_svr(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _score(spark, sf_dir, svm_type="epsilon_svr", kernel_type="rbf", gamma=GAMMA, rho=[0.25])
    return scored.withColumn("prediction", F.round("prediction", 9))


_SAVED_SQL = """
    SELECT '{model}' AS model_id, '{kind}' AS kind, count(*) AS n, count(DISTINCT row_id) AS n_rows, count(*) AS total,
           {accuracy} AS accuracy, {mse} AS mse
    FROM ({rows})
"""


@query(
    _SAVED_SQL.format(
        model="sign",
        kind="classification",
        accuracy="count(*) FILTER (WHERE prediction = target)::DOUBLE / count(*) * 100.0",
        mse="NULL::DOUBLE",
        rows=_binary_sql("d", 0.01, f"target, {_SIGN}"),
    )
    + " UNION ALL "
    + _SAVED_SQL.format(
        model="level",
        kind="regression",
        accuracy="NULL::DOUBLE",
        mse="round(avg((f - target) * (f - target)), 6)",
        rows=_binary_sql(f"exp(-{GAMMA}::DOUBLE * dist)", 0.25, "target, f"),
    )
)
def prediction_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier and a regression model, saved in one run and read back with their metrics."""
    kinds = {
        "sign": {"kernel_type": "linear", "rho": [0.01]},
        "level": {"svm_type": "epsilon_svr", "kernel_type": "rbf", "gamma": GAMMA, "rho": [0.25]},
    }
    parts = [fx.binary_model(spark, sf_dir, name, **scalars) for name, scalars in kinds.items()]
    scorer = Scorer(parts[0][0].union(parts[1][0]), parts[0][1].union(parts[1][1]))
    samples = fx.embedding_samples(spark, sf_dir)
    path = scratch_path(spark, "predictions")
    save_predictions(scorer.score(samples), path, scorer.models, run_ts="20240101000000")
    stored = spark.read.parquet(f"{path}/predictions").groupBy("model_id").agg(
        F.count("*").alias("n"), F.count_distinct("row_id").alias("n_rows")
    )
    found = spark.read.option("mergeSchema", True).parquet(f"{path}/metrics")
    mse = F.round("mse", 6).alias("mse")
    return stored.join(found, "model_id").select("model_id", "kind", "n", "n_rows", "total", "accuracy", mse)


@query(_binary_sql(f"exp(-{GAMMA}::DOUBLE * dist)", 0.001, _SIGN))
def svm_score_oneclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir, svm_type="one_class", kernel_type="rbf", gamma=GAMMA, rho=[0.001])


@query("""
    WITH sv AS (SELECT DISTINCT label + 1 AS serial, CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END AS coef FROM embeddings),
    f AS (SELECT vec_id AS row_id, sum(coef * embedding[serial]::DOUBLE) - 0.01 AS f
          FROM embeddings, sv GROUP BY vec_id)
    SELECT row_id, round(f, 9) + 0.0 AS decision, CASE WHEN f > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS prediction FROM f
""")
def svm_score_precomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that carry their kernel values, by serial number of the training row."""
    serial = F.struct(F.lit(0).alias("idx"), F.col("row_id").cast("double").alias("val"))
    rows = fx.embedding_samples(spark, sf_dir)
    rows = rows.select("row_id", F.concat(F.array(serial), "features").alias("features"))
    models, vectors = fx.binary_model(spark, sf_dir, "fixed", kernel_type="precomputed", rho=[0.01])
    serials = F.array(F.struct(F.lit(0).alias("idx"), (F.col("sv_id") + 1).cast("double").alias("val")))
    scored = Scorer(models, vectors.withColumn("features", serials)).score(rows)
    return scored.select("row_id", F.round(F.col("decision")[0], 9).alias("decision"), "prediction")


_OVO_PAIRS = [(i, j) for i in range(10) for j in range(i + 1, 10)]
_OVO_OFFSETS = [((i * 10 + j) % 7 - 3) / 1000.0 for i, j in _OVO_PAIRS]
_OVO_RHO = "((a.sv_id * 10 + b.sv_id) % 7 - 3) / 1000.0::DOUBLE"
_OVO_SQL = f"""
    WITH {_CROSS},
    k AS (SELECT row_id, target, sv_id, exp(-4.0::DOUBLE * dist) AS k FROM cross_terms),
    pairs AS (
        SELECT a.row_id, a.target, a.sv_id AS first, b.sv_id AS second, a.k - b.k - {_OVO_RHO} AS f
        FROM k a JOIN k b ON a.row_id = b.row_id AND a.sv_id < b.sv_id),
    counted AS (
        SELECT row_id, target, CASE WHEN f > 0 THEN first ELSE second END AS winner, count(*) AS n FROM pairs GROUP BY ALL),
    summed AS (
        SELECT row_id, round(sum(f * (first + 3 * second)), 6) + 0.0 AS decisions FROM pairs GROUP BY row_id)
    SELECT row_id, target, winner::DOUBLE AS prediction, decisions
    FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, winner) AS place FROM counted)
         JOIN summed USING (row_id)
    WHERE place = 1
"""


@query(_OVO_SQL)
def svm_score_ovo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten classes, one centroid each: a vote over the 45 class pairs, each with an offset of its own."""
    models, vectors = fx.ovo_model(spark, sf_dir, "ovo", kernel_type="rbf", gamma=4.0, rho=_OVO_OFFSETS)
    scored = Scorer(models, vectors).score(fx.embedding_samples(spark, sf_dir))
    weighted = sum((F.col("decision")[k] * (i + 3 * j) for k, (i, j) in enumerate(_OVO_PAIRS)), F.lit(0.0))
    return scored.select("row_id", "target", "prediction", F.round(weighted, 6).alias("decisions"))


@query("SELECT 'noisy' AS model_id, round(avg(l_discount), 9)::DOUBLE AS sigma FROM lineitem")
def svr_noise_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise scale of a regression model, through the model store and back."""
    sigma = fx.table(spark, sf_dir, "lineitem").agg(F.array(F.avg("l_discount")).alias("sigma"))
    models, vectors = fx.binary_model(
        spark, sf_dir, "noisy", svm_type="epsilon_svr", kernel_type="rbf", gamma=GAMMA, rho=[0.25], prob_a=[0.0]
    )
    columns = models.columns
    models = models.crossJoin(sigma).withColumn("prob_a", F.col("sigma")).select(*columns)
    path = scratch_path(spark, "noisy-model")
    save_model(models, vectors, path)
    stored, _ = load_model(spark, path, "noisy")
    return noise_scale(stored).withColumn("sigma", F.round("sigma", 9))


_A, _B = -1.5, 0.2


@query(f"""
    WITH {_CROSS},
    f AS (SELECT row_id, sum(CASE WHEN sv_id < 5 THEN 1.0 ELSE -1.0 END * d) AS f FROM cross_terms GROUP BY row_id),
    p AS (SELECT row_id, 1.0 / (1.0 + exp({_A}::DOUBLE * f + {_B}::DOUBLE)) AS p FROM f)
    SELECT row_id, CASE WHEN p >= 0.5 THEN 1.0 ELSE -1.0 END::DOUBLE AS prediction,
           round(p, 6) AS p_positive, round(1.0 - p, 6) AS p_negative
    FROM p
""")
def svm_prob_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, vectors = fx.binary_model(spark, sf_dir, "fixed", kernel_type="linear", prob_a=[_A], prob_b=[_B])
    scored = Scorer(models, vectors, probability=True).score(fx.embedding_samples(spark, sf_dir))
    return scored.select(
        "row_id",
        "prediction",
        F.round(F.col("probability")[1], 6).alias("p_positive"),
        F.round(F.col("probability")[-1], 6).alias("p_negative"),
    )


@query()
def svm_prob_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class probabilities by coupling the pair probabilities; one row per class."""
    models, vectors = fx.ovo_model(
        spark, sf_dir, "ovo", kernel_type="linear", rho=_OVO_OFFSETS,
        prob_a=[-2.0 - (i + 2 * j) % 5 / 4.0 for i, j in _OVO_PAIRS], prob_b=[((3 * i + j) % 7 - 3) / 20.0 for i, j in _OVO_PAIRS],
    )
    scored = Scorer(models, vectors, probability=True).score(fx.embedding_samples(spark, sf_dir))
    per_class = scored.select("row_id", "prediction", F.explode("probability").alias("label", "p"))
    return per_class.withColumn("p", F.round("p", 6))


@query(f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE prediction = target) AS correct,
           count(*) FILTER (WHERE prediction = target)::DOUBLE / count(*) * 100.0 AS accuracy
    FROM ({_OVO_SQL})
""")
def score_and_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring and its accuracy in one plan."""
    models, vectors = fx.ovo_model(spark, sf_dir, "ovo", kernel_type="rbf", gamma=4.0, rho=_OVO_OFFSETS)
    return metrics.accuracy(Scorer(models, vectors).score(fx.embedding_samples(spark, sf_dir)))


@query("""
    SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1 - toxic) AS correct,
           count(*) FILTER (WHERE quality = 1 - toxic)::DOUBLE / count(*) * 100.0 AS accuracy
    FROM labels
""")
def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fx.table(spark, sf_dir, "labels").select(
        F.col("quality").cast("double").alias("prediction"), (1 - F.col("toxic")).cast("double").alias("target")
    )
    return metrics.accuracy(pairs)


@query("""
    SELECT l_returnflag, count(*) AS total,
           round(avg((v - y) * (v - y)), 6) AS mse,
           round(pow(count(*) * sum(v * y) - sum(v) * sum(y), 2)
                 / ((count(*) * sum(v * v) - sum(v) * sum(v)) * (count(*) * sum(y * y) - sum(y) * sum(y))), 6)
               AS squared_correlation
    FROM (SELECT l_returnflag, l_extendedprice / 1000.0 AS v, l_quantity AS y FROM lineitem) GROUP BY l_returnflag
""")
def eval_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fx.table(spark, sf_dir, "lineitem").select(
        "l_returnflag", (F.col("l_extendedprice") / 1000.0).alias("prediction"), F.col("l_quantity").alias("target")
    )
    found = metrics.regression_error(pairs, by=["l_returnflag"])
    return found.withColumns(
        {"mse": F.round("mse", 6), "squared_correlation": F.round("squared_correlation", 6)}
    )


@query("""
    SELECT l_returnflag, count(*) AS total, round(avg((v - y) * (v - y)), 3) AS mse,
           round(pow(covar_pop(v, y), 2) / (var_pop(v) * var_pop(y)), 6) AS squared_correlation
    FROM (SELECT l_returnflag, 1e9::DOUBLE + l_extendedprice / 1000.0 AS v, 1e9::DOUBLE + l_quantity AS y FROM lineitem)
    GROUP BY l_returnflag
""")
def eval_regression_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values near 1e9 that differ by little: sums of their squares would cancel."""
    pairs = fx.table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        (F.lit(1e9) + F.col("l_extendedprice") / 1000.0).alias("prediction"),
        (F.lit(1e9) + F.col("l_quantity")).alias("target"),
    )
    found = metrics.regression_error(pairs, by=["l_returnflag"])
    return found.withColumns({"mse": F.round("mse", 3), "squared_correlation": F.round("squared_correlation", 6)})


@query("""
    SELECT 'stored' AS model_id, label::BIGINT AS sv_id, 'rbf' AS kernel_type, 0.5::DOUBLE AS gamma, i::INTEGER AS idx,
           round(avg(embedding[i]::DOUBLE), 9) + 0.0 AS val
    FROM embeddings, range(1, 65) r(i) GROUP BY label, i
""")
def model_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model saved twice under one run stamp, then read back by its id."""
    models, vectors = fx.binary_model(spark, sf_dir, "stored", kernel_type="rbf", gamma=0.5)
    path = scratch_path(spark, "model-store")
    run_ts = save_model(models, vectors, path)
    save_model(models, vectors, path, run_ts=run_ts)
    stored, sv = load_model(spark, path, "stored")
    model = stored.first()
    flat = sv.select("model_id", "sv_id", F.inline("features"))
    return flat.select(
        "model_id",
        "sv_id",
        F.lit(model["kernel_type"]).alias("kernel_type"),
        F.lit(model["gamma"]).alias("gamma"),
        "idx",
        F.round("val", 9).alias("val"),
    )


@query("""
    SELECT 'export' AS model_id, o_orderkey AS sv_id, 1.0::DOUBLE AS c, 0.5::DOUBLE AS g,
           CASE WHEN o_totalprice > 250000 THEN '+1' ELSE '-1' END || ' 1:' || (o_custkey % 1000)::DOUBLE
               || ' 2:' || (o_orderkey % 1000)::DOUBLE || ' ' AS line
    FROM orders
""")
def sv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stored support-vector set, rendered as training lines with true labels."""
    pairs = F.array(
        F.struct(F.lit(1).alias("idx"), (F.col("o_custkey") % 1000).cast("double").alias("val")),
        F.struct(F.lit(2).alias("idx"), (F.col("o_orderkey") % 1000).cast("double").alias("val")),
    )
    label = F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(-1.0)
    # Free vectors: a coefficient below C must not change the label.
    vectors = fx.table(spark, sf_dir, "orders").select(
        F.lit("export").alias("model_id"),
        F.col("o_orderkey").alias("sv_id"),
        label.alias("label"),
        F.array(label * 0.5).alias("coef"),
        pairs.alias("features"),
    )
    models = fx.model_rows(spark, "export", kernel_type="rbf", gamma=0.5, c=1.0)
    return export_support_vectors(vectors, models).drop("run_ts")


_RUNS = {"20240101000000": 0.01, "20240102000000": -0.02}


@query(f"""
    SELECT part, run_ts, prediction, count(*) AS n
    FROM (SELECT *, CASE WHEN f > rho THEN 1.0 ELSE -1.0 END::DOUBLE AS prediction
          FROM (SELECT target::INTEGER AS part, row_id, sum(CASE WHEN sv_id < 5 THEN 1.0 ELSE -1.0 END * d) AS f
                FROM (WITH {_CROSS} SELECT * FROM cross_terms) GROUP BY target, row_id),
               (VALUES (0, '20240101000000', 0.01::DOUBLE), (1, '20240102000000', -0.02::DOUBLE)) r(odd, run_ts, rho)
          WHERE part % 2 = odd)
    GROUP BY ALL
""")
def stream_current_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive before and after a newer run of the model is saved, under one checkpoint."""
    source, store = scratch_path(spark, "sample-files"), scratch_path(spark, "model-store")
    table, state = scratch_path(spark, "stream-scores"), scratch_path(spark, "stream-state")
    rows = fx.table(spark, sf_dir, "embeddings")
    lines = rows.select(F.col("label").alias("part"), fx.dense_line(F.col("label")).alias("value"))
    for odd, (run_ts, rho) in enumerate(_RUNS.items()):
        save_model(*fx.binary_model(spark, sf_dir, "current", kernel_type="linear", rho=[rho]), store, run_ts=run_ts)
        lines.where(F.col("part") % 2 == odd).write.mode("append").partitionBy("part").text(source)
        score_arrivals(spark, source, store, "current", table, state)
    part = F.regexp_extract(SOURCE_FILE, r"part=(\d+)/", 1).cast("int").alias("part")
    return spark.read.parquet(table).groupBy(part, "run_ts", "prediction").agg(F.count("*").alias("n"))


_STREAM_SQL = _binary_sql("d", 0.01, "target, CASE WHEN f > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS prediction")


def _stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = scratch_path(spark, "sample-files")
    rows = fx.table(spark, sf_dir, "embeddings")
    lines = rows.select(F.col("label").alias("part"), fx.dense_line(F.col("label")).alias("value"))
    malformed = rows.where("vec_id % 50 = 0").select("label", F.concat(F.lit("none 1:"), F.col("vec_id").cast("string")))
    lines.union(malformed).write.partitionBy("part").text(source)
    models, vectors = fx.binary_model(spark, sf_dir, "fixed", kernel_type="linear", rho=[0.01])
    table, state = scratch_path(spark, "stream-scores"), scratch_path(spark, "stream-state")
    query = score_stream(spark, source, Scorer(models, vectors), table, state, run_ts="20240101000000")
    query.awaitTermination()
    return spark.read.parquet(table)


@query(f"""
    SELECT target, decision, prediction, NULL::VARCHAR AS reject_reason, count(*) AS n FROM ({_STREAM_SQL}) GROUP BY ALL
    UNION ALL SELECT NULL, NULL, NULL, 'bad label', count(*) FROM embeddings WHERE vec_id % 50 = 0
""")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample files scored as they arrive; malformed lines stay with their reason."""
    scored = _stream_scores(spark, sf_dir)
    decision = F.round(F.col("decision")[0], 9).alias("decision")
    return scored.groupBy("target", decision, "prediction", "reject_reason").agg(F.count("*").alias("n"))


@query(f"""
    SELECT target::INTEGER AS part, count(*) AS total, count(*) FILTER (WHERE prediction = target) AS correct,
           count(*) FILTER (WHERE prediction = target)::DOUBLE / count(*) * 100.0 AS accuracy
    FROM ({_STREAM_SQL}) GROUP BY target
""")
def stream_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per arrived file, added up over the files of each native label."""
    part = F.regexp_extract(SOURCE_FILE, r"part=(\d+)/", 1).cast("int").alias("part")
    per_part = file_accuracy(_stream_scores(spark, sf_dir)).groupBy(part)
    sums = per_part.agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
    return sums.withColumn("accuracy", F.try_divide("correct", "total") * 100.0)
