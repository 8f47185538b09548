"""Queries on splitting and training."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svmflow.functions.parsing import accepted, leading_token
from svmflow.functions.vectors import dot, literal_vector, vector_sum
from svmflow.operators import cascade, logreg, split
from svmflow.operators import grid as grids
from svmflow.operators import subset_train as training
from svmflow.operators.scoring import Scorer
from svmflow.plans import fixtures as fx
from svmflow.plans.registry import query
from svmflow.session import scratch_path
from svmflow.sources.model_store import load_model, save_model
from svmflow.sources.points import parse_points
from svmflow.sources.samples import parse_samples
from svmflow.sources.text import SOURCE_FILE, read_whole_files

# Rows of a subset in these queries, whatever the size of the data.
ROWS_PER_SUBSET = 250
FILE_ROWS = 4000
N_SUBSETS = 8
GAMMA = 0.5

_ORDER_LABEL = """
    CASE WHEN o_orderkey % 50 = 0 THEN '0' WHEN o_totalprice > 250000 THEN '+1' ELSE '-1' END
"""
_ORDERS = f"(SELECT o_orderkey AS row_id, {_ORDER_LABEL} AS label_text FROM orders)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.labelled_lines(spark, sf_dir)
    return lines.select("row_id", leading_token(F.col("value")).alias("label_text"))


@query(f"SELECT row_id, label_text FROM {_ORDERS} WHERE label_text IN ('+1', '-1')")
def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.label_filter(_labelled(spark, sf_dir))


@query(f"""
    SELECT *, ceil(total_records / {N_SUBSETS}.0)::BIGINT AS max_records,
           ceil(ceil(total_records / {N_SUBSETS}.0) * (class_1::DOUBLE / total_records))::BIGINT AS max_class_1,
           (ceil(total_records / {N_SUBSETS}.0)
            - ceil(ceil(total_records / {N_SUBSETS}.0) * (class_1::DOUBLE / total_records)) + 1)::BIGINT AS max_class_2
    FROM (SELECT count(*) AS total_records, count(*) FILTER (WHERE label_text = '+1') AS class_1,
                 count(*) FILTER (WHERE label_text = '-1') AS class_2,
                 count(*) FILTER (WHERE label_text = '0') AS dropped
          FROM {_ORDERS})
""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = split.line_class_counts(fx.labelled_lines(spark, sf_dir))
    return split.with_quotas(counts, N_SUBSETS)


def _split_sql(rows: str, n: int | str) -> str:
    return f"""
        SELECT row_id, label_text,
               ((row_number() OVER (PARTITION BY label_text ORDER BY md5('0:' || row_id), row_id) - 1) % {n})::INTEGER
                   AS subset_id
        FROM {rows} WHERE label_text IN ('+1', '-1')
    """


def _split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(split.label_filter(_labelled(spark, sf_dir)), N_SUBSETS)


@query(_split_sql(_ORDERS, N_SUBSETS))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_orders(spark, sf_dir)


@query(f"SELECT subset_id, label_text, count(*) AS n FROM ({_split_sql(_ORDERS, N_SUBSETS)}) GROUP BY ALL")
def subset_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.subset_balance(_split_orders(spark, sf_dir))


@query(f"""
    SELECT (subset_id // 2)::INTEGER AS subset_id, label_text, count(*) AS n
    FROM ({_split_sql(_ORDERS, N_SUBSETS)}) GROUP BY ALL
""")
def pair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.subset_balance(split.merge_pairs(_split_orders(spark, sf_dir)))


_TRAIN = """(
    SELECT vec_id AS row_id, CASE WHEN embedding[1]::DOUBLE + embedding[2]::DOUBLE > 0 THEN '+1' ELSE '-1' END
           AS label_text, embedding FROM embeddings)"""


def _n_subsets_sql(rows: str, rows_per_subset: str) -> str:
    return f"""(SELECT ceil(total / ({rows_per_subset})::DOUBLE)::BIGINT FROM (
        SELECT count(*) AS total FROM {rows} WHERE label_text IN ('+1', '-1')))"""


def _bounded_subsets(rows: DataFrame, rows_per_subset: int = ROWS_PER_SUBSET) -> tuple[DataFrame, int]:
    """A split whose subsets stay within a row count, whatever the size of the data."""
    n = math.ceil(rows.count() / rows_per_subset)
    return split.stratified_split(rows, n), n


@query(f"""
    SELECT subset_id, count(*) AS n_lines
    FROM ({_split_sql(_ORDERS, _n_subsets_sql(_ORDERS, str(FILE_ROWS)))}) GROUP BY subset_id
""")
def whole_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subset written as one text file and read back as one record."""
    lines = fx.labelled_lines(spark, sf_dir).withColumn("label_text", leading_token(F.col("value")))
    subsets, n = _bounded_subsets(split.label_filter(lines), FILE_ROWS)
    path = scratch_path(spark, "subset-files")
    placed = split.place_groups(subsets.select("subset_id", "value"), n)
    placed.drop(split.TASK).write.partitionBy("subset_id").text(path)
    files = read_whole_files(spark, path)
    return files.select(
        F.regexp_extract(SOURCE_FILE, r"subset_id=(\d+)/", 1).cast("int").alias("subset_id"),
        F.regexp_count("value", F.lit("\n")).cast("bigint").alias("n_lines"),
    )


@query(f"""
    SELECT subset_id, count(*) AS n_rows, count(*) FILTER (WHERE label_text = '+1') AS n_positive,
           min(row_id) AS first_row, max(row_id) AS last_row
    FROM ({_split_sql(_TRAIN, _n_subsets_sql(_TRAIN, str(ROWS_PER_SUBSET)))}) GROUP BY subset_id
""")
def subset_as_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subset as one bounded group of one task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def describe(rows: pa.Table) -> pa.Table:
        ends = pc.min_max(rows["row_id"])
        return pa.table(
            {
                "subset_id": rows["subset_id"].slice(0, 1),
                "n_rows": pa.array([rows.num_rows], pa.int64()),
                "n_positive": pa.array([pc.sum(pc.equal(rows["label_text"], "+1")).as_py()], pa.int64()),
                "first_row": pa.array([ends["min"].as_py()], pa.int64()),
                "last_row": pa.array([ends["max"].as_py()], pa.int64()),
            }
        )

    rows, n = _bounded_subsets(fx.training_samples(spark, sf_dir).select("row_id", "label_text"))
    schema = "subset_id int, n_rows bigint, n_positive bigint, first_row bigint, last_row bigint"
    return split.place_groups(rows, n).groupBy(split.TASK, "subset_id").applyInArrow(describe, schema)


@query(f"""
    WITH RECURSIVE layers(layer, n_subsets) AS (
        SELECT 1, ceil(count(*) / {ROWS_PER_SUBSET}.0)::INTEGER FROM orders
        UNION ALL
        SELECT layer + 1, ((n_subsets + 1) // 2)::INTEGER FROM layers WHERE n_subsets > 1)
    SELECT layer, n_subsets FROM layers
""")
def cascade_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = fx.table(spark, sf_dir, "orders").agg(F.ceil(F.count("*") / ROWS_PER_SUBSET).alias("n"))
    return total.select(F.inline(split.cascade_schedule(F.col("n"))))


@query("""
    SELECT vec_id, round(list_sum(list_transform(range(1, 11), lambda i: embedding[i]::DOUBLE * (i / 10.0)::DOUBLE)), 9)
           + 0.0 AS dot
    FROM embeddings
""")
def vec_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [F.col("embedding")[i].cast("double") for i in range(10)]
    weights = literal_vector([(i + 1) / 10.0 for i in range(10)])
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(x, weights), 9).alias("dot"))


@query("""
    SELECT i::INTEGER AS idx, round(sum(embedding[i]::DOUBLE), 6) + 0.0 AS total
    FROM embeddings, range(1, 65) r(i) GROUP BY i
""")
def vec_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise vector sum: one partial vector per task, no exploding of rows."""
    one_row = fx.table(spark, sf_dir, "embeddings").agg(vector_sum("embedding").alias("s"))
    return one_row.select(F.posexplode("s").alias("pos", "v")).select(
        (F.col("pos") + 1).alias("idx"), F.round("v", 6).alias("total")
    )


@query("SELECT max(len(embedding))::INTEGER AS max_index FROM embeddings WHERE vec_id % 29 <> 0")
def feature_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.feature_dim(accepted(parse_samples(fx.sample_lines(spark, sf_dir))))


@query("""
    SELECT o_orderstatus AS subset, max(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 100 + 7 END)::INTEGER
           AS max_index,
           round(1.0 / max(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 100 + 7 END), 9)::DOUBLE AS gamma
    FROM orders GROUP BY o_orderstatus
""")
def default_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-subset default gamma over rows with three features or none."""
    index = [(F.col("o_custkey") % 100 + k).cast("int") for k in (1, 4, 7)]
    three = F.array(*(F.struct(i.alias("idx"), F.col("o_totalprice").alias("val")) for i in index))
    rows = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("subset"),
        F.when(F.col("o_custkey") % 3 == 0, F.slice(three, 1, 0)).otherwise(three).alias("features"),
    )
    return training.default_gamma(rows, ["subset"]).withColumn("gamma", F.round("gamma", 9))


@query("""
    SELECT o_orderkey AS row_id,
           CASE WHEN o_orderkey % 40 = 0 THEN 'first column must be 0:sample_serial_number'
                ELSE 'sample_serial_number out of range' END AS reason
    FROM orders WHERE o_orderkey % 40 = 0 OR o_custkey % 13 NOT BETWEEN 1 AND 10
""")
def precomputed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.struct(
        F.when(F.col("o_orderkey") % 40 == 0, 1).otherwise(0).alias("idx"),
        (F.col("o_custkey") % 13).cast("double").alias("val"),
    )
    rest = F.struct(F.lit(10).alias("idx"), F.col("o_totalprice").alias("val"))
    rows = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.array(first, rest).alias("features")
    )
    return training.precomputed_check(rows, 10).select("row_id", "reason")


def _gradient_sql(weights: list[str], x: str = "x{}") -> tuple[str, list[str]]:
    margin = " + ".join(f"{w} * {x.format(i)}" for i, w in enumerate(weights))
    scale = f"(1.0 / (1.0 + exp(-y * ({margin}))) - 1.0) * y"
    return scale, [f"({scale}) * {x.format(i)}" for i in range(len(weights))]


_POINTS = (
    "SELECT vec_id, CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END::DOUBLE AS y, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(10))
    + " FROM embeddings WHERE vec_id % 41 <> 0"
)
_START = 0.1


@query(
    "SELECT vec_id, "
    + ", ".join(f"round({g}, 9) + 0.0 AS g{i}" for i, g in enumerate(_gradient_sql([str(_START)] * 10)[1]))
    + f" FROM ({_POINTS})"
)
def logistic_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = accepted(parse_points(fx.point_lines(spark, sf_dir)))
    rows = logreg.point_gradients(points, [_START] * 10)
    return rows.select("vec_id", *(F.round(f"g{i}", 9).alias(f"g{i}") for i in range(10)))


def _logreg_sql(steps: int) -> str:
    names = [f"w{i}" for i in range(10)]
    ctes = [f"p AS ({_POINTS})", "s0 AS (SELECT " + ", ".join(f"{_START}::DOUBLE AS {n}" for n in names) + ")"]
    for k in range(1, steps + 1):
        _, parts = _gradient_sql(names)
        step = ", ".join(f"any_value({n}) - sum({g}) AS {n}" for n, g in zip(names, parts, strict=True))
        ctes.append(f"s{k} AS (SELECT {step} FROM p, s{k - 1})")
    rows = " UNION ALL ".join(f"SELECT {i} AS i, round(w{i}, 6) + 0.0 AS w FROM s{steps}" for i in range(10))
    return f"WITH {', '.join(ctes)} {rows}"


@query(_logreg_sql(3))
def logreg_gd(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = accepted(parse_points(fx.point_lines(spark, sf_dir)))
    weights = logreg.fit_logreg(points, 3, initial=[_START] * 10)
    return logreg.weights_frame(points, weights).select("i", F.round("w", 6).alias("w"))


@query("""
    SELECT p_partkey, 0.1 + 0.1 * i AS c, 0.25 + 0.05 * j AS g
    FROM part, range(0, 100) r(i), range(0, 100) s(j)
    WHERE 0.1::DOUBLE + 0.1::DOUBLE * i <= p_size / 100.0::DOUBLE
      AND 0.25::DOUBLE + 0.05::DOUBLE * j <= (p_size % 7) / 10.0::DOUBLE
""".replace("0.1 + 0.1 * i", "0.1::DOUBLE + 0.1::DOUBLE * i").replace("0.25 + 0.05 * j", "0.25::DOUBLE + 0.05::DOUBLE * j"))
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid per part, with limits that depend on its size; some are empty."""
    size = F.col("p_size")
    specs = fx.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.lit(0.1).alias("c_step"),
        F.lit(0.05).alias("g_step"),
        F.lit(0.1).alias("c_init"),
        F.lit(0.25).alias("g_init"),
        (size / 100.0).alias("c_max"),
        ((size % 7) / 10.0).alias("g_max"),
    )
    return grids.expand_grid(specs)


_SUBSET_ROWS = f"({_split_sql(_TRAIN, _n_subsets_sql(_TRAIN, str(ROWS_PER_SUBSET)))})"
_WIDE = f"""(
    SELECT vec_id AS row_id, CASE WHEN {" + ".join(f"embedding[{i + 1}]::DOUBLE * ({w})::DOUBLE" for i, w in enumerate(fx.WIDE_WEIGHTS))}
           > 0 THEN '+1' ELSE '-1' END AS label_text FROM embeddings)"""
_WIDE_SUBSET_ROWS = f"({_split_sql(_WIDE, _n_subsets_sql(_WIDE, str(ROWS_PER_SUBSET)))})"
CELL = training.Cell("cascade", 1.0, GAMMA)


def _optimality(rows: DataFrame) -> DataFrame:
    """Whether each subset's alphas meet the conditions of an optimum, from its rows alone."""
    import numpy as np
    import pyarrow as pa

    from svmflow.functions.sparse import from_arrow, square_distances

    def check(group: pa.Table) -> pa.Table:
        y, alpha = np.sign(group["label"].to_numpy()), group["alpha"].to_numpy()
        x = from_arrow(group["features"])
        gradient = y * (np.exp(-GAMMA * square_distances(x, x)) @ (alpha * y)) - 1.0
        up = ((alpha < CELL.c) & (y > 0)) | ((alpha > 0) & (y < 0))
        low = ((alpha < CELL.c) & (y < 0)) | ((alpha > 0) & (y > 0))
        gap = (-y * gradient)[up].max() - (-y * gradient)[low].min()
        return pa.table(
            {
                "subset_id": group["subset_id"].slice(0, 1),
                "n_rows": pa.array([group.num_rows], pa.int64()),
                "in_box": pa.array([bool(((alpha >= 0) & (alpha <= CELL.c)).all())]),
                "balanced": pa.array([bool(abs((alpha * y).sum()) < 1e-9)]),
                "optimal": pa.array([bool(gap < training.DEFAULT_EPS + 1e-9)]),
            }
        )

    schema = "subset_id int, n_rows bigint, in_box boolean, balanced boolean, optimal boolean"
    return rows.groupBy("subset_id").applyInArrow(check, schema)


@query(f"""
    SELECT subset_id, count(*) AS n_rows, true AS in_box, true AS balanced, true AS optimal
    FROM {_SUBSET_ROWS} GROUP BY subset_id
""")
def subset_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layer: every subset trained, its alphas checked against the conditions of an optimum."""
    subsets, n = _bounded_subsets(fx.training_samples(spark, sf_dir))
    return _optimality(training.train_subsets(subsets, [CELL], n_subsets=n, keep_all=True))


@query(f"""
    SELECT subset_id, count(*) AS n_rows, true AS in_box, true AS balanced, true AS optimal
    FROM {_WIDE_SUBSET_ROWS} GROUP BY subset_id
""")
def wide_subset_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layer over whole embeddings, its alphas checked against the conditions of an optimum."""
    subsets, n = _bounded_subsets(fx.wide_samples(spark, sf_dir))
    return _optimality(training.train_subsets(subsets, [CELL], n_subsets=n, keep_all=True))


@query(f"""
    SELECT subset_id, count(*) AS n_rows, true AS both_classes, true AS fewer, true AS from_subset
    FROM {_SUBSET_ROWS} GROUP BY subset_id
""")
def sv_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that survive the first layer, against the rows of their subset."""
    subsets, n = _bounded_subsets(fx.training_samples(spark, sf_dir))
    kept = training.train_subsets(subsets, [CELL], n_subsets=n).select(
        "row_id", F.col("subset_id").alias("kept_in"), F.lit(True).alias("kept")
    )
    rows = subsets.select("subset_id", "row_id", "label").join(kept, "row_id", "full")
    n_kept = F.count_if("kept")
    return rows.groupBy("subset_id").agg(
        F.count("*").alias("n_rows"),
        (F.count_if(F.col("kept") & (F.col("label") > 0)).between(1, n_kept - 1)).alias("both_classes"),
        (n_kept < F.count("*")).alias("fewer"),
        F.bool_and(F.col("kept").isNull() | (F.col("kept_in") == F.col("subset_id"))).alias("from_subset"),
    )


def _trained(spark: SparkSession, sf_dir: str) -> cascade.CascadeResult:
    return cascade.cascade_train(fx.training_samples(spark, sf_dir), [CELL], rows_per_subset=ROWS_PER_SUBSET)


@query("SELECT 'cascade' AS model_id, true AS in_box, true AS balanced, count(*) AS from_rows, true AS fewer FROM embeddings")
def cascade_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final support vectors, from text lines to model, against the rows that they come from."""
    samples = split.label_filter(accepted(parse_samples(fx.training_lines(spark, sf_dir))))
    result = cascade.cascade_train(samples, [CELL], rows_per_subset=ROWS_PER_SUBSET)
    coef = F.col("coef")[0]
    vectors = result.support_vectors.select("model_id", "row_id", coef.alias("coef"), F.col("label").alias("sv_label"))
    rows = samples.select("row_id", "label").join(vectors, "row_id", "full")
    return rows.groupBy(F.lit("cascade").alias("model_id")).agg(
        F.bool_and(F.col("coef").isNull() | ((F.col("coef") * F.col("sv_label")).between(0.0, CELL.c))).alias("in_box"),
        (F.abs(F.sum("coef")) < 1e-6).alias("balanced"),
        F.count_if(F.col("label").isNotNull() & (F.col("sv_label").isNull() | (F.col("label") == F.col("sv_label")))).alias("from_rows"),
        F.count("coef").between(2, F.count("*") - 1).alias("fewer"),
    )


@query(f"""
    WITH RECURSIVE layers(layer, n_subsets) AS (
        SELECT 1, ceil(count(*) / {ROWS_PER_SUBSET}.0)::INTEGER FROM embeddings
        UNION ALL
        SELECT layer + 1, ((n_subsets + 1) // 2)::INTEGER FROM layers WHERE n_subsets > 1)
    SELECT layer, n_subsets::BIGINT AS n_subsets, true AS both_classes, true AS not_more FROM layers
""")
def cascade_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that the training loop wrote: their subsets, and whether rows only ever go."""
    kept = _trained(spark, sf_dir).layers()
    per_layer = kept.groupBy("layer").agg(
        F.count_distinct("subset_id").alias("n_subsets"), F.count_distinct("label").alias("labels"), F.count("*").alias("n")
    )
    before = per_layer.select((F.col("layer") + 1).alias("layer"), F.col("n").alias("n_before"))
    return per_layer.join(before, "layer", "left").select(
        "layer",
        "n_subsets",
        (F.col("labels") == 2).alias("both_classes"),
        F.coalesce(F.col("n") <= F.col("n_before"), F.lit(True)).alias("not_more"),
    )


@query("SELECT 'cascade' AS model_id, count(*) AS total, true AS accurate, true AS counted FROM embeddings")
def cascade_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A freshly trained model on its training data: 97 % at least."""
    predictions, acc = cascade.cascade_predict(_trained(spark, sf_dir), fx.training_samples(spark, sf_dir))
    hits = predictions.groupBy("model_id").agg(F.count_if(F.col("prediction") == F.col("target")).alias("hits"))
    return acc.join(hits, "model_id").select(
        "model_id", "total", (F.col("accuracy") >= 97.0).alias("accurate"), (F.col("hits") == F.col("correct")).alias("counted")
    )


@query("SELECT 'cascade' AS model_id, count(*) AS total, true AS accurate, true AS counted FROM embeddings")
def wide_cascade_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over whole embeddings: 90 % at least."""
    samples = fx.wide_samples(spark, sf_dir)
    trained = cascade.cascade_train(samples, [CELL], rows_per_subset=ROWS_PER_SUBSET)
    predictions, acc = cascade.cascade_predict(trained, samples)
    hits = predictions.groupBy("model_id").agg(F.count_if(F.col("prediction") == F.col("target")).alias("hits"))
    return acc.join(hits, "model_id").select(
        "model_id", "total", (F.col("accuracy") >= 90.0).alias("accurate"), (F.col("hits") == F.col("correct")).alias("counted")
    )


@query(f"""
    SELECT 'cascade' AS model_id, 'c_svc' AS svm_type, 'rbf' AS kernel_type, {GAMMA}::DOUBLE AS gamma, 1.0::DOUBLE AS c,
           true AS all_stored, count(*) AS n_scored, count(*) AS n_equal
    FROM embeddings
""")
def trained_model_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained model through the model store and back: as complete, and with the same decisions."""
    result = _trained(spark, sf_dir)
    path = scratch_path(spark, "model-store")
    save_model(result.models, result.support_vectors, path)
    models, vectors = load_model(spark, path, "cascade")
    samples = fx.training_samples(spark, sf_dir).select("row_id", "features")
    mine, stored = (
        Scorer(m, v).score(samples).select("model_id", "row_id", F.col("decision")[0].alias(name))
        for m, v, name in ((result.models, result.support_vectors, "f"), (models, vectors, "g"))
    )
    equal = mine.join(stored, ["model_id", "row_id"]).groupBy("model_id").agg(
        F.count("*").alias("n_scored"), F.count_if(F.abs(F.col("f") - F.col("g")) < 1e-9).alias("n_equal")
    )
    n_rows = vectors.groupBy("model_id").agg(F.count("*").alias("n_rows"))
    return models.join(n_rows, "model_id").join(equal, "model_id").select(
        "model_id", "svm_type", "kernel_type", "gamma", "c", (F.col("total_sv") == F.col("n_rows")).alias("all_stored"),
        "n_scored", "n_equal",
    )


@query("""
    SELECT c, g, true AS accurate FROM (VALUES (0.5::DOUBLE), (1.5::DOUBLE)) a(c),
           (VALUES (0.25::DOUBLE), (0.75::DOUBLE), (1.25::DOUBLE)) b(g)
    WHERE (SELECT count(*) FROM embeddings WHERE vec_id % 4 = 3) > 0
""")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per (C, gamma) on rows that the models were not trained on: 90 % at least."""
    rows = fx.training_samples(spark, sf_dir)
    points = grids.param_grid(spark, c_step=1.0, g_step=0.5, c_init=0.5, g_init=0.25, c_max=1.5, g_max=1.25)
    train, test = rows.where("row_id % 4 <> 3"), rows.where("row_id % 4 = 3")
    found = cascade.grid_search(train, test, points, rows_per_subset=ROWS_PER_SUBSET)
    return found.select("c", "g", (F.col("acc") >= 90.0).alias("accurate"))


@query("""
    SELECT c, g, (SELECT count(*) FROM embeddings) AS total, true AS accurate, true AS counted,
           (SELECT count(*) FROM embeddings) > 0 AS one_best
    FROM (VALUES (0.5::DOUBLE), (1.5::DOUBLE)) a(c), (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) b(g)
""")
def grid_cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row held out once: accuracy per (C, gamma) over all of them, 90 % at least, and the best point."""
    points = grids.param_grid(spark, c_step=1.0, g_step=0.5, c_init=0.5, g_init=0.25, c_max=1.5, g_max=0.75)
    found = cascade.cross_validate(fx.training_samples(spark, sf_dir), points, rows_per_subset=ROWS_PER_SUBSET)
    best = found.agg(F.count_if("best").alias("n_best"), F.max_by("best", F.struct("acc", -F.col("c"), -F.col("g"))).alias("on_top"))
    return found.crossJoin(best).select(
        "c", "g", "total", (F.col("acc") >= 90.0).alias("accurate"),
        (F.abs(F.col("acc") - 100.0 * F.col("correct") / F.col("total")) < 1e-9).alias("counted"),
        ((F.col("n_best") == 1) & F.col("on_top")).alias("one_best"),
    )
