"""Centroid clustering of integer vectors with exact results and geometrically tightened distance bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svmflow.llm.common import fresh, save

#: Components of a vector, factor before they are cut to integers, and the largest magnitude they may then have.
DIMS, SCALE, MOST = 64, 256, 1 << 27
#: Up to this magnitude squared distances are exact in double precision, and matrix products can be used.
EXACT_IN_DOUBLE = 1 << 22
#: Vectors worked on at once.
STRIP_ROWS = 8_192
#: Slack for rounding of bounds, relative and absolute; distances of integers differ by far more than their rounding.
SLACK = 1e-9

_STATE = "stat boolean, uid long, cluster int, upper double, lower double, distance long, vec binary"


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of every vector to every centroid, as integers."""
    top = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if top <= EXACT_IN_DOUBLE else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    out = (v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :]
    out -= 2 * (v @ c.T)
    return out.astype(np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per cluster, the most by which any vector in its sphere can have come nearer to another centroid.

    The sphere of cluster i has centre ``old[i]`` and holds its vectors.
    Take the plane through that centre and the old and new place of centroid
    j, D apart, with m in their middle. The points that came nearer by t lie
    inside a hyperbola around the way from old to new; the hyperbola lies
    inside its asymptotes, so a point seen from m under the angle w to the way came
    nearer by at most D cos w. The least w of a sphere is the angle of its
    centre less the half angle under which the sphere is seen from m, which is all of it if
    m lies inside. Only a sphere that meets the way ahead loosens by the full drift D.
    """
    way = new - old
    drift = np.sqrt((way * way).sum(axis=1))
    middle = (new + old) / 2
    out = np.zeros(len(old))
    for i in range(len(old)):
        seen = old[i] - middle
        far = np.sqrt((seen * seen).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip((seen * way).sum(axis=1) / (far * drift), -1.0, 1.0))
            half = np.where(far > radius[i], np.arcsin(np.clip(radius[i] / far, 0.0, 1.0)), np.pi)
        least = np.clip(np.nan_to_num(angle - half - SLACK), 0.0, np.pi)
        nearer = np.where(drift > 0, drift * np.maximum(0.0, np.cos(least)), 0.0)
        nearer[i] = 0.0
        out[i] = nearer.max(initial=0.0)
    return out * (1 + SLACK) + SLACK


class Step:
    """What a round needs: centroids, and how far the bounds of the round before still hold."""

    def __init__(self, centroids: np.ndarray, drift: np.ndarray | None = None, loosened: np.ndarray | None = None):
        self.centroids, self.drift, self.loosened = centroids, drift, loosened

    def assign(self, vectors, cluster, upper, lower) -> tuple[np.ndarray, ...]:
        """(cluster, upper, lower, scanned): nearest centroid of every vector, ties to the smaller number.

        A vector whose other centroids are all farther than its own can be by
        the bounds keeps its cluster; then its own distance is computed and the
        test repeated; only those still ambiguous are compared with all.
        """
        n = len(vectors)
        if self.drift is None:
            open_ = np.ones(n, bool)
            cluster, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        else:
            upper = (upper + self.drift[cluster]) * (1 + SLACK)
            lower = lower - self.loosened[cluster]
            open_ = upper * (1 + SLACK) + SLACK >= lower
            if open_.any():
                at = np.flatnonzero(open_)
                gap = vectors[at] - self.centroids[cluster[at]]
                upper[at] = np.sqrt((gap * gap).sum(axis=1))
                open_[at] = upper[at] * (1 + SLACK) + SLACK >= lower[at]
        at = np.flatnonzero(open_)
        for lo in range(0, len(at), STRIP_ROWS):
            rows = at[lo : lo + STRIP_ROWS]
            squares = squared_distances(vectors[rows], self.centroids)
            best = squares.argmin(axis=1)
            cluster[rows] = best
            upper[rows] = np.sqrt(squares[np.arange(len(rows)), best])
            squares[np.arange(len(rows)), best] = np.iinfo(np.int64).max
            others = squares.min(axis=1)
            lower[rows] = np.where(others == np.iinfo(np.int64).max, np.inf, np.sqrt(others))
        return cluster, upper, lower, len(at)


def _matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(v.as_py() for v in column)
    return np.frombuffer(raw, "<i4").astype(np.int64).reshape(len(column), DIMS)


def _vectors(values: np.ndarray) -> pa.Array:
    ends = np.arange(0, values.size * 4 + 1, DIMS * 4, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values.astype("<i4").tobytes())])


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of DIMS finite components as integers; the others are left out."""
    for batch in batches:
        column = batch["vec"]
        fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), DIMS), False))
        part = batch.filter(pa.array(fits))
        flat = part["vec"].flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMS)
        good = np.isfinite(values).all(axis=1)  # a null component reads as not a number
        whole = np.floor(np.clip(values[good] * SCALE, -MOST, MOST)).astype(np.int64)
        yield pa.record_batch({"uid": part["uid"].filter(pa.array(good)), "vec": _vectors(whole)})


def _round(shared: Broadcast, first: bool):
    """Assign the vectors of a task; at the end the sums, count and radius of each cluster in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step: Step = shared.value
        k = len(step.centroids)
        sums, counts, radius, scanned = np.zeros((k, DIMS), np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros(k, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, STRIP_ROWS):
                part = batch.slice(lo, STRIP_ROWS)
                vectors = _matrix(part["vec"])
                bounds = [None] * 3 if first else [np.array(part[c]) for c in ("cluster", "upper", "lower")]
                cluster, upper, lower, n_open = step.assign(vectors, *bounds)
                gap = vectors - step.centroids[cluster]
                np.add.at(sums, cluster, vectors)
                counts += np.bincount(cluster, minlength=k)
                np.maximum.at(radius, cluster, upper)
                scanned[0] += n_open
                yield _state(False, np.asarray(part["uid"]), cluster, upper, lower, (gap * gap).sum(axis=1), part["vec"])
        yield _state(True, counts, np.arange(k), radius, np.zeros(k), scanned, _sums(sums))

    return run


def _sums(sums: np.ndarray) -> pa.Array:
    ends = np.arange(0, sums.size * 8 + 1, DIMS * 8, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sums), [None, pa.py_buffer(ends), pa.py_buffer(sums.astype("<i8").tobytes())])


def _state(stat, uid, cluster, upper, lower, distance, vec) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "stat": pa.array(np.full(len(cluster), stat)),
            "uid": pa.array(uid, pa.int64()),
            "cluster": pa.array(cluster, pa.int32()),
            "upper": pa.array(upper, pa.float64()),
            "lower": pa.array(lower, pa.float64()),
            "distance": pa.array(distance, pa.int64()),
            "vec": vec,
        }
    )


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of tasks, one row per component."""
    for batch in batches:
        n = batch.num_rows
        sums = np.frombuffer(b"".join(v.as_py() for v in batch["vec"]), "<i8").reshape(n, DIMS)
        yield pa.record_batch(
            {
                "cluster": pa.array(np.repeat(np.asarray(batch["cluster"]), DIMS), pa.int32()),
                "position": pa.array(np.tile(np.arange(DIMS), n), pa.int32()),
                "total": pa.array(sums.ravel()),
                "n": pa.array(np.repeat(np.asarray(batch["uid"]), DIMS)),
                "radius": pa.array(np.repeat(np.asarray(batch["upper"]), DIMS)),
            }
        )


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exact floors of the means, radius of every cluster); empty clusters stay where they are."""
    sums = state.where("stat").mapInArrow(_components, "cluster int, position int, total long, n long, radius double")
    exact = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    found = sums.groupBy("cluster", "position").agg(exact("total"), exact("n"), F.max("radius").alias("radius")).collect()
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for row in found:
        if row["n"]:
            new[row["cluster"], row["position"]] = int(row["total"]) // int(row["n"])
        radius[row["cluster"]] = row["radius"]
    return new, radius


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of exactly 64 components, none null or not finite; each
    component x becomes floor(256 x). Centroids 0.. start as the ``k`` kept
    vectors of the least SHA-256 of ``<seed>:<id>`` (fewer if fewer are kept). In each of ``rounds`` rounds
    every vector goes to its nearest centroid, ties to the smaller number, and
    centroids become the exact floors of the componentwise means, empty ones
    staying; then vectors are assigned once more. ``distance`` is squared;
    ``inertia`` sums it over all, ``cluster_inertia`` over the cluster.

    Repeated rows count each and are returned each; those of one id start in the order of
    their components, a null id last. A component beyond +-2**27 after scaling counts as that bound, a sum
    beyond 64 bits as the largest. An empty table gives no rows; further columns are ignored.

    Vectors carry an upper bound of the distance to their centroid and a
    lower bound of that to all others through the rounds. When centroids move, the
    lower bound is loosened by what the geometry of the cluster's sphere
    allows (``loosening``), which is less than the full drift; only vectors
    that the bounds leave ambiguous are compared with all centroids, exactly.
    Every round is one narrow pass, written to the shared folder; k x 64 sums reach the driver.
    """
    spark = vectors.sparkSession
    uid = fresh("uid")
    numbered = save(
        vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).withColumn(uid, F.monotonically_increasing_id()),
        "cluster-rows",
    )
    kept = save(numbered.select(F.col(uid).alias("uid"), "vec").mapInArrow(_integers, "uid long, vec binary"), "cluster-vectors")
    ids = numbered.select(F.col(uid).alias("uid"), "id")
    start = (
        kept.join(ids, "uid")
        .select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "vec")
        .orderBy(F.col("hash").asc_nulls_last(), F.hex("vec"))
        .limit(k)
        .collect()
    )
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, "
    schema += "inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array([np.frombuffer(bytes(r["vec"]), "<i4") for r in start], np.int64)
    state, step = kept, Step(centroids)
    for n in range(rounds + 1):
        shared = spark.sparkContext.broadcast(step)
        state = save(state.mapInArrow(_round(shared, n == 0), _STATE), "cluster-round")
        shared.unpersist()
        if n < rounds:
            new, radius = _moved(state, centroids)
            drift = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(np.float64))
            step = Step(new, drift, loosening(centroids.astype(np.float64), new.astype(np.float64), radius))
            centroids = new
            state = state.where("not stat")
    rows = state.where("not stat").select("uid", "cluster", "distance")
    per_cluster = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("part"))
    parts = {r["cluster"]: int(r["part"]) for r in per_cluster.collect()}  # k rows at most
    bounded = lambda total: min(total, (1 << 63) - 1)
    digests = [
        (i, bounded(parts.get(i, 0)), bounded(sum(parts.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    told = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (
        rows.join(F.broadcast(told), "cluster")  # k rows
        .join(ids, "uid")
        .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    )
