"""Queries on sources: logs, samples, points, ratings and landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svmflow.functions.parsing import accepted, rejected
from svmflow.operators.log_rollup import log_rollup as roll_up
from svmflow.plans import fixtures as fx
from svmflow.plans.registry import query
from svmflow.session import discard, scratch_path
from svmflow.sources.access_log import parse_log
from svmflow.sources.points import parse_points
from svmflow.sources.ratings import parse_ratings
from svmflow.sources.samples import parse_samples
from svmflow.sources.text import SOURCE_FILE, Landing, land_directory
from svmflow.streaming.ingest import ingest_stream

_LOG_SQL = """
    SELECT event_id,
           event_id % 97 <> 0 AS matched,
           CASE WHEN event_id % 97 <> 0 AND user_id % 10 <> 0
                THEN '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS ip,
           CASE WHEN event_id % 97 <> 0 AND user_id % 10 <> 0 THEN 'u' || user_id END AS "user",
           CASE WHEN event_id % 97 <> 0 AND user_id % 10 <> 0
                THEN 'GET /' || event_type || ' HTTP/1.1' END AS query,
           CASE WHEN event_id % 97 = 0 THEN 0
                WHEN event_id % 83 = 0 THEN NULL
                ELSE event_id % 5000 END AS bytes
    FROM events
"""


@query(f"SELECT * REPLACE (coalesce(bytes, -1)::BIGINT AS bytes) FROM ({_LOG_SQL})")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed log lines; -1 stands for an unreadable byte count."""
    parsed = parse_log(fx.log_lines(spark, sf_dir)).drop("value")
    return parsed.withColumn("bytes", F.coalesce("bytes", F.lit(-1)))


@query(f"""
    SELECT ip, "user", query, count(*) AS n, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes,
           count(*) FILTER (WHERE bytes IS NULL) AS bad_bytes
    FROM ({_LOG_SQL}) GROUP BY ip, "user", query
""")
def log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(fx.log_lines(spark, sf_dir))


_SAMPLE_KIND = """
    CASE WHEN vec_id % 29 = 0 THEN 'blank line' WHEN vec_id % 31 = 0 THEN 'bad label'
         WHEN vec_id % 37 = 0 THEN 'bad feature' END
"""


@query(f"""
    SELECT vec_id,
           CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END::DOUBLE AS label,
           CASE WHEN vec_id % 7 = 0 THEN NULL WHEN label < 5 THEN '+1' ELSE '-1' END AS label_text,
           i::INTEGER AS idx, embedding[i]::DOUBLE AS val
    FROM embeddings, range(1, 65) r(i)
    WHERE {_SAMPLE_KIND} IS NULL
""")
def samples_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = accepted(parse_samples(fx.sample_lines(spark, sf_dir)))
    return good.select("vec_id", "label", "label_text", F.inline("features"))


@query(f"SELECT vec_id, {_SAMPLE_KIND} AS reject_reason FROM embeddings WHERE {_SAMPLE_KIND} IS NOT NULL")
def samples_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(parse_samples(fx.sample_lines(spark, sf_dir))).select("vec_id", "reject_reason")


_POINT_COLUMNS = ", ".join(
    f"CASE WHEN vec_id % 41 <> 0 THEN embedding[{i + 1}]::DOUBLE END AS x{i}" for i in range(1, 10)
)


@query(f"""
    SELECT vec_id, CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END::DOUBLE AS y,
           CASE WHEN vec_id % 41 = 0 THEN 0.5 ELSE embedding[1]::DOUBLE END AS x0, {_POINT_COLUMNS},
           CASE WHEN vec_id % 41 = 0 THEN 'too few fields' END AS reject_reason
    FROM embeddings
""")
def points_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_points(fx.point_lines(spark, sf_dir))
    return parsed.select("vec_id", "y", *(F.col("x")[i].alias(f"x{i}") for i in range(10)), "reject_reason")


@query("""
    SELECT l_orderkey::INTEGER AS user_id, l_partkey::INTEGER AS movie_id, l_linenumber::DOUBLE AS rating,
           CASE WHEN l_orderkey % 89 <> 0 THEN l_orderkey * 10 + l_linenumber ELSE -1 END AS ts,
           CASE WHEN l_orderkey % 89 = 0 THEN 'not 4 fields' END AS reject_reason
    FROM lineitem
""")
def ratings_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed ratings; -1 stands for a missing timestamp."""
    parsed = parse_ratings(fx.rating_lines(spark, sf_dir))
    rating = F.col("rating").cast("double").alias("rating")
    return parsed.select("user_id", "movie_id", rating, F.coalesce("ts", F.lit(-1)).alias("ts"), "reject_reason")


_LINES_SQL = """
    SELECT CASE WHEN l_orderkey % 89 = 0 THEN l_orderkey || '::' || l_partkey || '::' || l_linenumber
                ELSE l_orderkey || '::' || l_partkey || '::' || l_linenumber || '::'
                     || (l_orderkey * 10 + l_linenumber) END AS value
    FROM lineitem
"""


def _render(spark: SparkSession, sf_dir: str) -> str:
    """The rating lines as text files in a fresh shared folder."""
    source = scratch_path(spark, "rating-files")
    fx.rating_lines(spark, sf_dir).select("value").write.text(source)
    return source


@query(f"SELECT value, true AS has_file FROM ({_LINES_SQL})")
def dir_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder landed twice, as by a repeated job: every line is there once."""
    source, table = _render(spark, sf_dir), scratch_path(spark, "landed")
    land_directory(spark, source, table)
    landed = land_directory(spark, source, table)
    return landed.select("value", F.col(SOURCE_FILE).isNotNull().alias("has_file"))


@query(f"""
    SELECT part, status, count(line) AS n_lines, coalesce(sum(length(line)), 0)::BIGINT AS n_chars
    FROM (SELECT part, CASE part WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' WHEN 2 THEN 'emptied'
                                 WHEN 3 THEN 'removed' ELSE 'new' END AS status,
                 CASE WHEN part IN (2, 3) THEN NULL WHEN part = 1 THEN 'x' || value ELSE value END AS line
          FROM (SELECT value, (split_part(value, '::', 1)::BIGINT % 5)::INTEGER AS part FROM ({_LINES_SQL})))
    GROUP BY ALL
""")
def dir_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder landed again after files were added, rewritten, emptied and removed: lines and status by file."""
    drafts, table = scratch_path(spark, "rating-files"), scratch_path(spark, "landed")
    source, later = f"{drafts}/later=false", f"{drafts}/later=true"
    # Every task writes its own lines, both versions of a rewritten part at once and so under equal file names.
    part = (F.col("l_orderkey") % 5).cast("int")
    times = F.when(part == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(~part.isin(0, 2, 3)))
    rows = fx.rating_lines(spark, sf_dir).select(part.alias("part"), F.explode(times).alias("later"), "value")
    value = F.when(F.col("later") & (F.col("part") == 1), F.concat(F.lit("x"), "value")).otherwise(F.col("value"))
    drawn = rows.where("part IS NOT NULL").select("later", "part", value.alias("value"))
    drawn.write.partitionBy("later", "part").text(drafts)
    fx.make_folder(spark, source)
    landing = Landing(spark, table)
    landing.land(source)
    fx.rewrite_files(spark, f"{source}/part=1", f"{later}/part=1")
    fx.rewrite_files(spark, f"{source}/part=2", None)
    discard(spark, f"{source}/part=3")
    fx.move_folders(spark, later, source)
    files = landing.land(source)
    lines = landing.lines().groupBy(SOURCE_FILE).agg(
        F.count("*").alias("n_lines"), F.sum(F.length("value")).cast("bigint").alias("n_chars")
    )
    part = F.regexp_extract(SOURCE_FILE, r"part=(-?\d+)/", 1).cast("int").alias("part")
    told = files.join(lines, SOURCE_FILE, "left").groupBy(part, "status")
    return told.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_lines", "n_chars")))


@query(f"SELECT value, true AS has_file FROM ({_LINES_SQL})")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = scratch_path(spark, "stream-landed")
    ingest_stream(spark, _render(spark, sf_dir), table, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(table).select("value", F.col(SOURCE_FILE).isNotNull().alias("has_file"))
