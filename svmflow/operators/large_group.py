"""C-SVC training of many groups that are each too large for one task, all at once.

Decomposition (Joachims, 1999): every group is a set of chunks, a chunk is a
packed row of a distributed table with the alphas and gradients of its rows.
In each round every unfinished group offers a bounded working set of rows
that violate the optimality conditions, one task a group solves it, and the
change is joined back to the chunks of the group by key, where it moves the
gradients. The driver only sees how many groups are unfinished. The result
meets the same stopping rule as a solve in one piece.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from svmflow.functions.solver import RbfKernel, movable, solve
from svmflow.functions.sparse import FEATURES_ARROW, KERNEL_CELLS, Against, SparseRows, from_arrow, rbf
from svmflow.session import Scratch

#: Rows of a working set, and of a chunk.
WORKING_ROWS = 2000
CHUNK_ROWS = 2000

GROUP = ["model_id", "subset_id"]
CHUNK = [*GROUP, "chunk"]

# What a row of the state table is: a chunk, rows that it offers for the working set, or rows that pull on other chunks.
_STATE, _OFFER, _PULL = 0, 1, 2


class Packed:
    """Rows of a group with what training knows of them, as one table row."""

    def __init__(self, ids: pa.Array, numbers: np.ndarray, rows: SparseRows):
        self.ids, self.numbers, self.rows = ids, numbers, rows

    label = property(lambda self: self.numbers[0])
    alpha = property(lambda self: self.numbers[1])
    gradient = property(lambda self: self.numbers[2])

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Packed:
        return Packed(self.ids.take(pa.array(at)), self.numbers[:, at], self.rows.take(at))

    def columns(self) -> dict[str, pa.Array]:
        lengths = np.diff(self.rows.offsets).astype("<i4")
        blob = lambda a: pa.array([a.tobytes()], pa.binary())
        return {
            "ids": pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.ids),
            "numbers": blob(self.numbers.astype("<f8")),
            "lengths": blob(lengths),
            "idx": blob(self.rows.idx.astype("<i4")),
            "val": blob(self.rows.val.astype("<f8")),
        }

    @classmethod
    def of(cls, table: pa.Table) -> Packed:
        """All packed rows of a table, end to end."""
        joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        ids = table["ids"].combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        parts = [np.frombuffer(n, "<f8").reshape(3, -1) for n in table["numbers"].to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(joined("lengths", "<i4"))]).astype(np.int64)
        rows = SparseRows(offsets, joined("idx", "<i4").astype(np.int64), joined("val", "<f8"))
        return cls(ids.flatten(), np.concatenate(parts, axis=1) if parts else np.zeros((3, 0)), rows)


def _packed_fields(row_id: T.DataType) -> list[T.StructField]:
    blobs = [T.StructField(name, T.BinaryType()) for name in ("numbers", "lengths", "idx", "val")]
    return [T.StructField("ids", T.ArrayType(row_id)), *blobs]


def _group_fields() -> list[T.StructField]:
    return [
        T.StructField("model_id", T.StringType()),
        T.StructField("subset_id", T.IntegerType()),
    ]


def _state_schema(row_id: T.DataType) -> T.StructType:
    numbers = ("c", "gamma", "top", "bottom", "free", "n_free", "low", "high", "n_up", "n_down")
    return T.StructType(
        [
            *_group_fields(),
            T.StructField("chunk", T.IntegerType()),
            T.StructField("kind", T.IntegerType()),
            *(T.StructField(name, T.DoubleType()) for name in numbers),
            *_packed_fields(row_id),
        ]
    )


def _step_schema(row_id: T.DataType) -> T.StructType:
    return T.StructType(
        [*_group_fields(), T.StructField("done", T.BooleanType()), T.StructField("rho", T.DoubleType()), *_packed_fields(row_id)]
    )


def _table(head: dict, packed: Packed, schema: T.StructType) -> pa.Table:
    kinds = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}
    columns = {f.name: pa.array([head.get(f.name)], kinds[f.dataType]) for f in schema.fields if f.dataType in kinds}
    return pa.table({**columns, **packed.columns()}).select(schema.names)


def _offers(head: dict, part: Packed, quota: int, round_no: int, schema: T.StructType) -> pa.Table:
    """Stopping figures of a chunk, and the rows that it offers: its worst on each side and a spread of other violators.

    Taking only the worst rows makes rounds undo each other on noisy data,
    where those rows crowd together, so the others are drawn evenly.
    """
    y, alpha, gradient, c = part.label, part.alpha, part.gradient, head["c"]
    up, down = movable(alpha, y, c)
    score, slope = -y * gradient, y * gradient
    free = (alpha > 0) & (alpha < c)
    lowest, highest = (lambda v: float(v.min()) if len(v) else None), (lambda v: float(v.max()) if len(v) else None)
    told = {
        **head,
        "kind": _OFFER,
        "top": highest(score[up]),
        "bottom": lowest(score[down]),
        "free": float(slope[free].sum()),
        "n_free": float(free.sum()),
        "low": lowest(slope[up]),
        "high": highest(slope[down]),
        "n_up": float((y > 0).sum()),
        "n_down": float((y < 0).sum()),
    }
    # Where other chunks stand is not known here: rows beyond the middle of the chunk's own ends come first.
    draw = np.random.default_rng([round_no, abs(head["subset_id"]), head["chunk"]])
    chosen = []
    middle = (score[up].max() + score[down].min()) / 2 if up.any() and down.any() else 0.0
    for side, sign in ((up, 1.0), (down, -1.0)):
        rows = np.flatnonzero(side)
        if len(rows):
            beyond = sign * (score[rows] - middle) > 0
            order = np.lexsort((draw.random(len(rows)), ~beyond))
            worst = rows[np.argmax(sign * score[rows])]
            chosen.append(np.append(worst, rows[order[:quota]]))
    at = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
    return _table(told, part.take(at), schema)


def _packer(schema: T.StructType) -> Callable:
    """Group function: the rows of a chunk, packed, and those of them that pull on others."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        y = np.sign(table["label"].to_numpy())
        alpha = table["alpha"].to_numpy()
        ids = table["row_id"].combine_chunks()
        packed = Packed(
            pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids,
            np.stack([y, alpha, -np.ones(len(y))]),
            from_arrow(table["features"]),
        )
        head = dict(zip(CHUNK, (k.as_py() for k in key), strict=True))
        head |= {"c": table["c"][0].as_py(), "gamma": table["gamma"][0].as_py()}
        pull = packed.take(np.flatnonzero(alpha > 0))
        out = [_table({**head, "kind": _STATE}, packed, schema)]
        if len(pull):
            out.append(_table({**head, "kind": _PULL}, pull, schema))
        return pa.concat_tables(out)

    return run


def _pulled(part: Packed, source: Packed, weights: np.ndarray, gamma: float) -> np.ndarray:
    """Change of the gradients of ``part`` by weighted rows."""
    out = np.zeros(len(part))
    step = max(1, KERNEL_CELLS // max(1, len(source)))
    against = Against(source.rows)
    for lo in range(0, len(part) if len(source) else 0, step):
        hi = min(lo + step, len(part))
        out[lo:hi] = rbf(part.rows.rows(lo, hi), against, gamma) @ weights
    return part.label * out


def _first_pull(state: pa.Table, pulls: pa.Table) -> pa.Table:
    """What one chunk's support vectors add to the gradients of another chunk."""
    part, source = Packed.of(state), Packed.of(pulls)
    change = _pulled(part, source, source.label * source.alpha, state["gamma"][0].as_py())
    columns = {name: state[name].slice(0, 1) for name in CHUNK}
    return pa.table({**columns, "change": pa.array([change.astype("<f8").tobytes()], pa.binary())})


def _starter(schema: T.StructType, quota: int) -> Callable:
    """Add what all chunks pull to the gradients of a chunk, and make the first offer."""

    def run(state: pa.Table, changes: pa.Table) -> pa.Table:
        part = Packed.of(state)
        for change in sorted(changes["change"].to_pylist()):  # an order that does not depend on the shuffle
            part.numbers[2] += np.frombuffer(change, "<f8")
        head = {name: state[name][0].as_py() for name in (*CHUNK, "c", "gamma")}
        return pa.concat_tables([_table({**head, "kind": _STATE}, part, schema), _offers(head, part, quota, 0, schema)])

    return run


def _solver(eps: float, working_rows: int, schema: T.StructType) -> Callable:
    """Group function: solve the working set of a group, or find that the group is done."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        figure = lambda name: table[name].drop_null().to_numpy()
        head = dict(zip(GROUP, (k.as_py() for k in key), strict=True))
        top, bottom = figure("top"), figure("bottom")
        nothing = Packed.of(table.slice(0, 0)) if table.num_rows == 0 else Packed.of(table.slice(0, 1)).take(np.zeros(0, np.int64))
        if not figure("n_up").sum() or not figure("n_down").sum():
            # One class only: the rows move on unchanged.
            return _table({**head, "done": True, "rho": float("nan")}, nothing, schema)
        if not len(top) or not len(bottom) or top.max() - bottom.min() < eps:
            n_free = figure("n_free").sum()
            ends = [f for f in (figure("low"), figure("high")) if len(f)]
            bounds = (ends[0].min(), ends[-1].max()) if len(ends) == 2 else (ends[0].min(),) * 2
            rho = figure("free").sum() / n_free if n_free else sum(bounds) / 2.0
            return _table({**head, "done": True, "rho": float(rho)}, nothing, schema)
        c, gamma = table["c"][0].as_py(), table["gamma"][0].as_py()
        offered = Packed.of(table.sort_by("chunk"))
        y, score = offered.label, -offered.label * offered.gradient
        up, down = movable(offered.alpha, y, c)
        middle = (top.max() + bottom.min()) / 2.0
        # The worst rows of all chunks come first on each side, then an even spread of what else violates.
        draw = np.random.default_rng(len(offered)).random(len(offered))
        chosen = []
        for side, sign in ((up, 1.0), (down, -1.0)):
            rows = np.flatnonzero(side & (sign * (score - middle) > 0))
            order = rows[np.argsort(draw[rows], kind="stable")]
            worst = rows[np.argsort(-sign * score[rows], kind="stable")][: working_rows // 8]
            chosen.append(np.append(worst, order[: working_rows // 2 - len(worst)]))
        part = offered.take(np.unique(np.concatenate(chosen)))
        new, _ = solve(RbfKernel(part.rows, gamma), part.label, c, eps / 2, alpha=part.alpha, gradient=part.gradient)
        if not np.isfinite(new).all():
            raise ValueError(f"model {head['model_id']}: training rows hold values that are not finite")
        moved = np.flatnonzero(new != part.alpha)
        change = part.take(moved)
        # In place of the gradient the change carries the pull of each row.
        numbers = np.stack([change.label, new[moved], change.label * (new[moved] - change.alpha)])
        return _table({**head, "done": False, "rho": None}, Packed(change.ids, numbers, change.rows), schema)

    return run


def _mover(schema: T.StructType, quota: int, round_no: int) -> Callable:
    """Bring a working set's change to a chunk of its group; chunks of other groups are left out."""

    def run(state: pa.Table, steps: pa.Table) -> pa.Table:
        if state.num_rows == 0 or steps.num_rows == 0:
            return _empty(schema, state)
        part, change = Packed.of(state), Packed.of(steps)
        head = {name: state[name][0].as_py() for name in (*CHUNK, "c", "gamma")}
        part.numbers[2] += _pulled(part, change, change.numbers[2], head["gamma"])
        at = pa.compute.index_in(part.ids, value_set=change.ids)
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        part.numbers[1, hit] = change.alpha[at.drop_null().to_numpy(zero_copy_only=False)]
        return pa.concat_tables([_table({**head, "kind": _STATE}, part, schema), _offers(head, part, quota, round_no, schema)])

    return run


def _empty(schema: T.StructType, like: pa.Table) -> pa.Table:
    return like.slice(0, 0).select(schema.names)


def _finisher(trained: T.StructType) -> Callable:
    """The support vectors of a chunk whose group is done; all rows of a group of one class."""

    def run(state: pa.Table, steps: pa.Table) -> pa.Table:
        if steps.num_rows == 0 or state.num_rows == 0:
            at, part, rho = np.zeros(0, np.int64), Packed.of(state), float("nan")
        else:
            part, rho = Packed.of(state), steps["rho"][0].as_py()
            at = np.arange(len(part)) if rho is None or np.isnan(rho) else np.flatnonzero(part.alpha > 0)
        kept = part.take(at)
        n, rows = len(kept), kept.rows
        features = pa.ListArray.from_arrays(
            pa.array(rows.offsets, pa.int32()),
            pa.StructArray.from_arrays([pa.array(rows.idx, pa.int32()), pa.array(rows.val, pa.float64())], names=["idx", "val"]),
        )
        head = {name: state[name][0].as_py() if n else None for name in GROUP}
        columns = {
            "model_id": pa.array([head["model_id"]] * n, pa.string()),
            "subset_id": pa.array([head["subset_id"]] * n, pa.int32()),
            "row_id": kept.ids,
            "label": pa.array(kept.label),
            "alpha": pa.array(kept.alpha),
            "rho": pa.array(np.full(n, rho, np.float64)),
            "features": features.cast(FEATURES_ARROW),
        }
        return pa.table(columns).select(trained.names)

    return run


def _to_chunks(df: DataFrame, n_chunks: int, name: str = "chunk") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))


def train_large_groups(
    groups: DataFrame,
    trained_schema: T.StructType,
    path: str,
    *,
    largest: int,
    eps: float,
    working_rows: int = WORKING_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Support vectors of all groups, whatever their size, with ``alpha`` and ``rho``, as a table at ``path``.

    ``groups`` has model_id, subset_id, row_id, label, features, c and gamma,
    and optionally the alpha from which a row starts: any alphas whose labelled sum is
    zero in each group, such as those of its halves. ``largest`` is the size of the
    largest group or a bound of it; it sets the number of chunks.

    A task holds one chunk, or one chunk and one working set, or the offers
    of one group: its worst rows, two a chunk, and about twice a working set.
    Rounds are written to the shared folder and removed two rounds later.
    """
    spark = groups.sparkSession
    row_id = groups.schema["row_id"].dataType
    state_schema, step_schema = _state_schema(row_id), _step_schema(row_id)
    n_chunks = max(1, -(-largest // chunk_rows))
    quota = max(1, -(-working_rows // n_chunks))
    alpha = F.col("alpha") if "alpha" in groups.columns else F.lit(0.0)
    chunk: Column = F.pmod(F.xxhash64("row_id"), F.lit(n_chunks)).cast("int")
    with Scratch(spark, "large-groups") as scratch:
        rows = groups.select(*GROUP, chunk.alias("chunk"), "row_id", "label", alpha.alias("alpha"), "c", "gamma", "features")
        packed = scratch.write(rows.groupBy(*CHUNK).applyInArrow(_packer(state_schema), state_schema), by=["kind"])
        fresh = lambda df: df.toDF(*df.columns)  # noqa: E731  (columns of its own, where a table meets itself)
        chunks = packed.where(F.col("kind") == _STATE)
        pulls = fresh(packed.where(F.col("kind") == _PULL)).withColumnRenamed("chunk", "other")
        # Every chunk meets the support vectors of every chunk of its group, each pair a task's group of its own.
        pair = [*CHUNK, "other"]
        asked = _to_chunks(pulls, n_chunks)
        met = _to_chunks(fresh(chunks), n_chunks, "other").join(asked.select(*pair), pair, "left_semi")
        change_schema = T.StructType([*_group_fields(), T.StructField("chunk", T.IntegerType()), T.StructField("change", T.BinaryType())])
        changes = met.groupBy(*pair).cogroup(fresh(asked).groupBy(*pair)).applyInArrow(_first_pull, change_schema)
        state = scratch.write(
            chunks.groupBy(*CHUNK).cogroup(changes.groupBy(*CHUNK)).applyInArrow(_starter(state_schema, quota), state_schema),
            by=["kind"],
        )
        spark.createDataFrame([], trained_schema).write.mode("overwrite").parquet(path)
        round_no = 0
        while True:
            round_no += 1
            offers = state.where(F.col("kind") == _OFFER)
            steps = scratch.write(offers.groupBy(*GROUP).applyInArrow(_solver(eps, working_rows, step_schema), step_schema))
            told = steps.agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("open")).first()
            chunks = state.where(F.col("kind") == _STATE).groupBy(*CHUNK)
            to_chunks = lambda part: _to_chunks(part, n_chunks).groupBy(*CHUNK)
            if told["done"]:
                done = chunks.cogroup(to_chunks(steps.where("done"))).applyInArrow(_finisher(trained_schema), trained_schema)
                done.write.mode("append").parquet(path)
            if not told["open"]:
                break
            moved = chunks.cogroup(to_chunks(steps.where("not done"))).applyInArrow(
                _mover(state_schema, quota, round_no), state_schema
            )
            state = scratch.write(moved, keep=4, by=["kind"])
    return spark.read.schema(trained_schema).parquet(path)
