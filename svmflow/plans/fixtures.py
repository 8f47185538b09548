"""Inputs in the text formats of the jobs, rendered from the test tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from svmflow.functions.parsing import compute_once
from svmflow.session import discard
from svmflow.sources.model_store import model_row
from svmflow.sources.samples import feature_text, samples_from_arrays


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One access-log line per event; some have no user, no byte count or no valid shape."""
    user, event = F.col("user_id"), F.col("event_id")
    name = F.when(user % 10 == 0, "-").otherwise(_text("u", user))
    size = F.when(event % 83 == 0, "-").otherwise((event % 5000).cast("string"))
    good = _text(
        "10.0.", F.floor(user / 256), ".", user % 256, " - ", name, " [18/Jan/2013:17:56:07 +1100] \"GET /",
        F.col("event_type"), " HTTP/1.1\" 200 ", size, ' "http://ref.example/" "agent/1.0" tail',
    )
    value = F.when(event % 97 == 0, _text("corrupt ", event)).otherwise(good)
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))


def dense_line(label: Column) -> Column:
    """A sample line with every dimension of the embedding."""
    pairs = F.transform(
        "embedding", lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), v.cast("double").cast("string"))
    )
    return F.concat_ws(" ", label.cast("string"), F.array_join(pairs, " "))


def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample line per embedding, in several shapes.

    By vec_id: multiples of 29 are blank, of 31 have a word as label, of 37 a
    word as value; multiples of 7 use tabs, of 11 end in an odd token.
    """
    vec = F.col("vec_id")
    sign = F.when(F.col("label") < 5, "+1").otherwise("-1")
    full = F.concat(dense_line(sign), F.when(vec % 11 == 0, " 65").otherwise(""))
    rows = compute_once(table(spark, sf_dir, "embeddings"), _line=full)
    value = (
        F.when(vec % 29 == 0, "  ")
        .when(vec % 31 == 0, "label 1:0.5")
        .when(vec % 37 == 0, _text(sign, " 1:0.5 2:x"))
        .when(vec % 7 == 0, F.translate("_line", " ", "\t"))
        .otherwise(F.col("_line"))
    )
    return rows.select("vec_id", value.alias("value"))


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training lines over the orders: two classes by price, and some rows with label 0."""
    price = F.col("o_totalprice")
    label = F.when(F.col("o_orderkey") % 50 == 0, "0").when(price > 250000, "+1").otherwise("-1")
    line = _text(label, " 1:", F.col("o_custkey"), " 2:", F.col("o_orderkey") % 1000)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), line.alias("value"))


def _folder(spark: SparkSession, folder: str) -> tuple:
    """A folder's file system, its path, and the paths in it; none if it is not there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, path, [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []


def make_folder(spark: SparkSession, folder: str) -> None:
    """Create a folder that may be there already."""
    fs, path, _ = _folder(spark, folder)
    fs.mkdirs(path)


def rewrite_files(spark: SparkSession, folder: str, drafts: str | None) -> None:
    """Replace the text files of a folder, under their names: by those of the same names in ``drafts``, or by nothing."""
    fs, path, files = _folder(spark, folder)
    for file in files:
        if file.getName().startswith("part-"):
            if drafts is None:
                fs.create(file, True).close()
            else:
                fs.delete(file, False)
    if drafts is not None:
        for draft in _folder(spark, drafts)[2]:
            fs.rename(draft, path)
        discard(spark, drafts)


def move_folders(spark: SparkSession, source: str, target: str) -> None:
    """Move what is in one folder into another."""
    fs, _, found = _folder(spark, source)
    for folder in found:
        fs.rename(folder, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target))


def point_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y x0 .. x9`` per embedding; multiples of 41 of vec_id are cut short."""
    y = F.when(F.col("label") < 5, "1").otherwise("-1")
    full = _text(y, *(p for i in range(10) for p in (" ", F.col("embedding")[i].cast("double"))))
    value = F.when(F.col("vec_id") % 41 == 0, _text(y, " 0.5")).otherwise(full)
    return table(spark, sf_dir, "embeddings").select("vec_id", value.alias("value"))


def rating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user::movie::rating::timestamp`` per line item; every 89th order loses the last field."""
    key, line_no = F.col("l_orderkey"), F.col("l_linenumber")
    start = _text(key, "::", F.col("l_partkey"), "::", line_no)
    value = F.when(key % 89 == 0, start).otherwise(_text(start, "::", key * 10 + line_no))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", value.alias("value"))


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, target, features) with all dimensions; the target is the native label."""
    df = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    return samples_from_arrays(df, "embedding").select(
        "row_id", F.col("label").cast("double").alias("target"), "features"
    )


def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label_text, label, features): two dimensions times 8, label by the sign of x1 + x2."""
    x1, x2 = (F.col("embedding")[i].cast("double") for i in (0, 1))
    df = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.when(x1 + x2 > 0, "+1").otherwise("-1").alias("label_text"),
        F.array(x1 * 8.0, x2 * 8.0).alias("_x"),
    )
    return samples_from_arrays(df, "_x").select(
        "row_id", "label_text", F.col("label_text").cast("double").alias("label"), "features"
    )


#: Weights of the 64 dimensions whose sum labels the wide samples; no two are equal, none is 0.
WIDE_WEIGHTS = [(i * 37) % 64 - 31.5 for i in range(64)]


def wide_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label_text, label, features): all 64 dimensions, label by the sign of their weighted sum."""
    weighted = sum((F.col("embedding")[i].cast("double") * w for i, w in enumerate(WIDE_WEIGHTS)), F.lit(0.0))
    df = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.when(weighted > 0, "+1").otherwise("-1").alias("label_text"), "embedding"
    )
    return samples_from_arrays(df, "embedding").select(
        "row_id", "label_text", F.col("label_text").cast("double").alias("label"), "features"
    )


def training_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training samples as text, one line each."""
    return training_samples(spark, sf_dir).select("row_id", F.concat_ws(" ", "label_text", feature_text()).alias("value"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean embedding per native label: (label, features). One row per label."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    df = table(spark, sf_dir, "embeddings").groupBy("label").agg(Summarizer.mean(vector).alias("_m"))
    return samples_from_arrays(df.withColumn("_x", vector_to_array("_m")), "_x").select("label", "features")


def binary_model(spark: SparkSession, sf_dir: str, model_id: str, **scalars) -> tuple[DataFrame, DataFrame]:
    """A fixed two-class model: the label centroids, coefficient +1 for labels 0-4 and -1 for 5-9."""
    sign = F.when(F.col("label") < 5, 1.0).otherwise(-1.0)
    vectors = centroids(spark, sf_dir).select(
        F.lit(model_id).alias("model_id"),
        F.col("label").cast("bigint").alias("sv_id"),
        sign.alias("label"),
        F.array(sign).alias("coef"),
        "features",
    )
    return model_rows(spark, model_id, **scalars), vectors


def ovo_model(spark: SparkSession, sf_dir: str, model_id: str, **scalars) -> tuple[DataFrame, DataFrame]:
    """A fixed ten-class one-vs-one model: each centroid against each other one."""
    coef = [F.when(F.col("label") > j, -1.0).otherwise(1.0) for j in range(9)]
    vectors = centroids(spark, sf_dir).select(
        F.lit(model_id).alias("model_id"),
        F.col("label").cast("bigint").alias("sv_id"),
        F.col("label").cast("double").alias("label"),
        F.array(*coef).alias("coef"),
        "features",
    )
    return model_rows(spark, model_id, **{"rho": [0.0] * 45, "label": list(range(10))} | scalars), vectors


def model_rows(spark: SparkSession, model_id: str, **scalars) -> DataFrame:
    scalars.setdefault("rho", [0.0])
    if scalars.get("svm_type", "c_svc") in ("c_svc", "nu_svc"):
        scalars.setdefault("label", [1, -1])
    return model_row(spark, model_id, **scalars)
