"""Scoring with stored models.

Support vectors whose measured size stays under a block are broadcast, and
scoring is a narrow ``mapInArrow`` over the rows, in batch and on streams. A
larger set stays a table of blocks: chunks of rows meet every block in a
shuffle, each meeting gives partial kernel sums, and these are added up per chunk. So
nothing that grows with a model is broadcast or passes the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from svmflow.functions.probability import couple_pairs, pair_probability
from svmflow.functions.sparse import KERNEL_CELLS, Against, SparseRows, cross_dots, from_arrow, rbf
from svmflow.session import discard, materialise, scratch_path

CLASSIFIERS = ("c_svc", "nu_svc")
REGRESSORS = ("epsilon_svr", "nu_svr")

BLOCK_BYTES = 64 << 20
# Rows of a chunk that meets blocks, at most, bytes of the partial sums of a chunk, and chunks that share one copy of a block.
CHUNK_ROWS = 4096
SUM_BYTES = 64 << 20
CHUNKS_PER_BLOCK_COPY = 16

# Names of the columns that packed rows, blocks and sums travel in.
_ROW, _CHUNK, _BLOCK, _BODY, _COPY = "_row", "_chunk", "_block", "_body", "_copy"


@dataclass(frozen=True)
class Model:
    """Scalars of one model; its support vectors travel separately."""

    model_id: str
    svm_type: str
    kernel_type: str
    degree: int
    gamma: float
    coef0: float
    rho: tuple[float, ...]
    label: tuple[int, ...]
    prob_a: tuple[float, ...]
    prob_b: tuple[float, ...]

    @property
    def n_classes(self) -> int:
        return len(self.label) if self.svm_type in CLASSIFIERS else 2

    @property
    def pairs(self) -> list[tuple[int, int]]:
        """Class pairs in model order; one pseudo pair for non-classifiers."""
        return list(combinations(range(self.n_classes), 2))

    def kernel(self, x: SparseRows, sv: Against) -> np.ndarray:
        if self.kernel_type == "linear":
            return cross_dots(x, sv)
        if self.kernel_type == "polynomial":
            return (self.gamma * cross_dots(x, sv) + self.coef0) ** self.degree
        if self.kernel_type == "rbf":
            return rbf(x, sv, self.gamma)
        if self.kernel_type == "sigmoid":
            return np.tanh(self.gamma * cross_dots(x, sv) + self.coef0)
        if self.kernel_type == "precomputed":
            # A row holds its kernel values by serial number; a support vector
            # is its serial number, stored at index 0.
            serials = sv.rows.dense(np.array([0]))[:, 0].astype(np.int64)
            columns, place = np.unique(serials, return_inverse=True)
            return x.dense(columns)[:, place]
        raise ValueError(f"unknown kernel_type {self.kernel_type!r}")


@dataclass(frozen=True)
class SupportBlock:
    """Support vectors of one model in one block, grouped by class position."""

    vectors: SparseRows
    coef: np.ndarray
    class_at: np.ndarray

    def add_sums(self, model: Model, x: SparseRows, sums: np.ndarray, against: Against) -> None:
        """Add this block's kernel sums to the (row, pair) matrix ``sums``."""
        kernel = model.kernel(x, against)
        if len(model.pairs) == 1:
            sums[:, 0] += kernel @ self.coef[:, 0]
            return
        pair_at = {pair: i for i, pair in enumerate(model.pairs)}
        for cls in np.unique(self.class_at):
            mine = self.class_at == cls
            if model.svm_type in CLASSIFIERS:
                others = [k for k in range(model.n_classes) if k != cls]
                columns = [pair_at[min(cls, k), max(cls, k)] for k in others]
            else:
                columns = [0]
            sums[:, columns] += kernel[:, mine] @ self.coef[mine][:, : len(columns)]


def load_models(models: DataFrame) -> list[Model]:
    """Model scalars on the driver: one small row per model."""
    fields = list(Model.__dataclass_fields__)
    out = []
    for row in models.select(*fields).collect():
        values = row.asDict()
        for name in ("rho", "label", "prob_a", "prob_b"):
            values[name] = tuple(values[name] or ())
        out.append(Model(**values))
    if not out:
        raise LookupError("no such model")
    return sorted(out, key=lambda m: m.model_id)


def _to_blocks(table: pa.Table, models: list[Model]) -> dict[str, SupportBlock]:
    blocks = {}
    ids = table["model_id"].to_numpy(zero_copy_only=False)
    for model in models:
        part = table.filter(pa.array(ids == model.model_id)).sort_by("sv_id")
        if part.num_rows == 0:
            continue
        coef = np.array(part["coef"].to_pylist(), dtype=np.float64).reshape(part.num_rows, -1)
        if model.svm_type in CLASSIFIERS:
            position = {float(label): i for i, label in enumerate(model.label)}
            class_at = np.array([position[v] for v in part["label"].to_pylist()])
        else:
            class_at = np.zeros(part.num_rows, dtype=np.int64)
        blocks[model.model_id] = SupportBlock(from_arrow(part["features"]), coef, class_at)
    return blocks


def _packed_block(models: list[Model]) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        body = pickle.dumps(_to_blocks(table, models))
        return pa.table({_BLOCK: pa.array([key[0].as_py()], pa.int32()), _BODY: pa.array([body], pa.binary())})

    return run


def _finish(model: Model, sums: np.ndarray, probability: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Decision values, prediction and class probabilities of a chunk of rows."""
    decision = sums - np.array(model.rho)
    if model.svm_type in REGRESSORS:
        return decision, decision[:, 0], None
    if model.svm_type == "one_class":
        return decision, np.where(decision[:, 0] > 0, 1.0, -1.0), None
    labels = np.array(model.label, dtype=np.float64)
    if probability:
        chance = couple_pairs(pair_probability(decision, model.prob_a, model.prob_b), model.pairs, model.n_classes)
        return decision, labels[chance.argmax(axis=1)], chance
    votes = np.zeros((len(decision), model.n_classes), dtype=np.int64)
    for p, (i, j) in enumerate(model.pairs):
        first = decision[:, p] > 0
        votes[:, i] += first
        votes[:, j] += ~first
    return decision, labels[votes.argmax(axis=1)], None


def _list_array(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _probability_map(chance: np.ndarray | None, model: Model, n_rows: int) -> pa.Array:
    kind = pa.map_(pa.int32(), pa.float64())
    if chance is None:
        return pa.nulls(n_rows, kind)
    offsets = np.arange(0, chance.size + 1, model.n_classes, dtype=np.int32)
    keys = np.tile(np.array(model.label, dtype=np.int32), n_rows)
    return pa.MapArray.from_arrays(pa.array(offsets), pa.array(keys), pa.array(chance.ravel()))


def _add_block(sums: np.ndarray, x: SparseRows, models: list[Model], blocks: dict[str, SupportBlock]) -> None:
    """Add one block to the sums of all models, in chunks of bounded kernel size."""
    start = 0
    for model in models:
        stop = start + len(model.pairs)
        block = blocks.get(model.model_id)
        if block is not None:
            chunk = max(1, KERNEL_CELLS // len(block.vectors))
            against = Against(block.vectors)
            for lo in range(0, len(x), chunk):
                hi = min(lo + chunk, len(x))
                block.add_sums(model, x.rows(lo, hi), sums[lo:hi, start:stop], against)
        start = stop


def _width(models: list[Model]) -> int:
    return sum(len(m.pairs) for m in models)


def _scored(batch: pa.RecordBatch | pa.Table, models: list[Model], sums: np.ndarray, probability: bool, left_out: tuple) -> Iterator[pa.Table]:
    """One output row per row and model, from the finished kernel sums."""
    n, start = batch.num_rows, 0
    kept = {name: batch.column(name) for name in batch.schema.names if name not in left_out}
    for model in models:
        stop = start + len(model.pairs)
        decision, prediction, chance = _finish(model, sums[:, start:stop], probability)
        start = stop
        yield pa.table(
            {
                **kept,
                "model_id": pa.array([model.model_id] * n, pa.string()),
                "decision": _list_array(decision),
                "prediction": pa.array(prediction, pa.float64()),
                "probability": _probability_map(chance, model, n),
            }
        )


def _narrow_pass(models: list[Model], shared: object, probability: bool) -> Callable:
    """Score the rows where they are with the one broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((batch.num_rows, _width(models)))
            _add_block(sums, from_arrow(batch.column("features")), models, shared.value)
            for table in _scored(batch, models, sums, probability, ("features",)):
                yield from table.to_batches()

    return run


def _packed_chunk(key: tuple, table: pa.Table) -> pa.Table:
    """The features of a chunk of rows in the order of their numbers."""
    body = pickle.dumps(from_arrow(table.sort_by(_ROW)["features"]))
    return pa.table({_CHUNK: pa.array([key[0].as_py()], pa.int64()), _BODY: pa.array([body], pa.binary())})


def _meet(models: list[Model]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Partial kernel sums of some chunks with one block."""

    def run(chunks: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        # A block that no support vector fell into is not there.
        block = pickle.loads(blocks[_BODY][0].as_py()) if blocks.num_rows and chunks.num_rows else {}
        for body in chunks[_BODY]:
            x = pickle.loads(body.as_py())
            sums = np.zeros((len(x), _width(models)))
            _add_block(sums, x, models, block)
            out.append(sums.tobytes())
        return pa.table({_CHUNK: chunks[_CHUNK], _BLOCK: chunks[_BLOCK], _BODY: pa.array(out, pa.binary())})

    return run


def _add_up(models: list[Model], probability: bool, schema: T.StructType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sums over all blocks, in their order, and what they say about the rows of a chunk."""

    def run(rows: pa.Table, parts: pa.Table) -> pa.Table:
        rows = rows.sort_by(_ROW)
        sums = np.zeros((rows.num_rows, _width(models)))
        for body in parts.sort_by(_BLOCK)[_BODY]:
            sums += np.frombuffer(body.as_py(), np.float64).reshape(sums.shape)
        tables = _scored(rows, models, sums, probability, (_ROW, _CHUNK))
        return pa.concat_tables(t.select(schema.names) for t in tables)

    return run


class Scorer:
    """Models loaded once, ready to score any number of frames or streams."""

    def __init__(
        self,
        models: DataFrame,
        support_vectors: DataFrame,
        *,
        probability: bool = False,
        block_bytes: int = BLOCK_BYTES,
    ) -> None:
        self.models = load_models(models)
        self.probability = probability
        if probability:
            for m in self.models:
                if m.svm_type in CLASSIFIERS:
                    able = len(m.prob_a) * len(m.prob_b) == len(m.pairs) ** 2
                else:
                    # Regression carries the scale of its noise; one-class models have no probabilities.
                    able = m.svm_type in REGRESSORS and len(m.prob_a) == 1
                if not able:
                    raise ValueError(f"model {m.model_id} does not support probability estimates")
        self._spark = spark = models.sparkSession
        self._paths: list[str] = []
        wanted = support_vectors.where(F.col("model_id").isin([m.model_id for m in self.models])).select(
            "model_id", "sv_id", "label", "coef", "features"
        )
        wanted = wanted.persist(StorageLevel.MEMORY_AND_DISK)
        # 12 bytes per stored feature and 8 per coefficient.
        cost = 12 * F.size("features") + 8 * F.size("coef") + 16
        size = wanted.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("bytes")).first()["bytes"]
        self.n_blocks = max(1, -(-size // block_bytes))
        self._shared = self._blocks = None
        if self.n_blocks == 1:
            self._shared = spark.sparkContext.broadcast(_to_blocks(wanted.toArrow(), self.models))
        else:
            block = F.pmod(F.xxhash64("model_id", "sv_id"), F.lit(self.n_blocks)).cast("int")
            packed = wanted.groupBy(block.alias(_BLOCK)).applyInArrow(
                _packed_block(self.models), f"{_BLOCK} int, {_BODY} binary"
            )
            self._blocks = self._table(packed)
        wanted.unpersist()

    def _table(self, df: DataFrame) -> DataFrame:
        """A table that stays until the scorer is closed."""
        self._paths.append(scratch_path(df.sparkSession, "scorer"))
        return materialise(df, self._paths[-1])

    def __enter__(self) -> Scorer:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Release the support vectors and what was written for scoring; frames scored must have been written by then."""
        if self._shared is not None:
            self._shared.destroy()
        while self._paths:
            discard(self._spark, self._paths.pop())

    def score(self, samples: DataFrame) -> DataFrame:
        """Add ``model_id``, ``decision``, ``prediction``, ``probability`` in place of ``features``.

        One output row per input row and model; all other columns pass through.
        A stream needs support vectors within one block; for larger models land
        the files and score the table.
        """
        passing = [f for f in samples.schema.fields if f.name != "features"]
        final = T.StructType(
            [
                *passing,
                T.StructField("model_id", T.StringType()),
                T.StructField("decision", T.ArrayType(T.DoubleType())),
                T.StructField("prediction", T.DoubleType()),
                T.StructField("probability", T.MapType(T.IntegerType(), T.DoubleType())),
            ]
        )
        if self._shared is not None:
            return samples.mapInArrow(_narrow_pass(self.models, self._shared, self.probability), final)
        if samples.isStreaming:
            raise ValueError("the support vectors exceed one block: land the files, then score them as a table")
        return self._by_blocks(samples, final)

    def _by_blocks(self, samples: DataFrame, final: T.StructType) -> DataFrame:
        per_row = 8 * _width(self.models) * self.n_blocks
        chunk_rows = max(1, min(CHUNK_ROWS, SUM_BYTES // per_row))
        # Numbers run on inside a partition of the written table, so a chunk is a run of rows.
        numbered = self._table(samples.withColumn(_ROW, F.monotonically_increasing_id()))
        numbered = numbered.withColumn(_CHUNK, F.floor(F.col(_ROW) / chunk_rows))
        features = numbered.select(_CHUNK, _ROW, "features")
        chunks = self._table(features.groupBy(_CHUNK).applyInArrow(_packed_chunk, f"{_CHUNK} long, {_BODY} binary"))
        copies = max(1, -(-chunks.count() // CHUNKS_PER_BLOCK_COPY))
        every_block = F.explode(F.sequence(F.lit(0), F.lit(self.n_blocks - 1)))
        asked = chunks.withColumn(_BLOCK, every_block).withColumn(_COPY, F.pmod(F.xxhash64(_CHUNK), F.lit(copies)).cast("int"))
        given = self._blocks.withColumn(_COPY, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        key = [_BLOCK, _COPY]
        parts = asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInArrow(
            _meet(self.models), f"{_CHUNK} long, {_BLOCK} int, {_BODY} binary"
        )
        rows = numbered.drop("features").groupBy(_CHUNK)
        return rows.cogroup(parts.groupBy(_CHUNK)).applyInArrow(_add_up(self.models, self.probability, final), final)


def score(samples: DataFrame, models: DataFrame, support_vectors: DataFrame, **options) -> DataFrame:
    """``Scorer`` in one call."""
    return Scorer(models, support_vectors, **options).score(samples)


def noise_scale(models: DataFrame) -> DataFrame:
    """Laplace scale of the regression models that carry one."""
    return models.where(F.col("svm_type").isin(*REGRESSORS)).select(
        "model_id", F.try_element_at("prob_a", F.lit(1)).alias("sigma")
    )
