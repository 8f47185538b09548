"""N-gram Jaccard join over an R-tree of group-count vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svmflow.llm.common import fresh, save
from svmflow.llm.components import components
from svmflow.llm.shingling import mix, shingle_sets, slices
from svmflow.session import Scratch

#: Words of a shingle, and the least Jaccard similarity of a link in hundredths.
WIDTH, LEAST = 5, 75
#: Groups that shingles are hashed into: the dimensions of the indexed points. A larger set also keeps
#: the counts of finer groups, one for about four shingles, as its bound is useless with few.
GROUPS, SHINGLES_PER_GROUP, MOST_GROUPS = 64, 4, 1 << 16
#: Rows of a leaf of the tree, children of an inner node, and node pairs and leaf pairs that are looked at together.
LEAF, FAN = 32, 8
NODE_PAIRS, LEAF_PAIRS = 2_048, 64
#: Rows of one neighbourhood that one task joins by their counts; a larger one is joined in pairs of chunks.
CHUNK_ROWS = 4_096
#: Rows of the neighbourhoods that share a task.
TASK_ROWS = 10_000
#: Bytes of the sets of a chunk, and of the neighbourhoods that share a task, where sets are compared.
CHUNK_BYTES, TASK_BYTES = 8 << 20, 8 << 20
#: Bins of the count of common shingles, and how far above its task's mean a bin must be to be told.
BINS, COMMON_TIMES, COMMON_LEAST = 1 << 20, 4, 16
#: Values of the hash that narrows the documents whose sets are needed again.
ID_BITS = 1 << 20
#: Links of one document to its group's leader that are verified in one place.
SALT_LINKS = 1_000

#: The two leaders of an entry in a cell, and how their size classes are moved.
LEADERS = {"lead_a": 0.0, "lead_b": 0.5}

#: A leader is verified at once if it leads an entry in one cell for so many shingles; most linked pairs share more.
LED_PART = 16

#: The first shingles of linked sets share one, and one more for so many shingles of the smaller set.
SHARED_PART = 20
#: Entries of like size behind an entry of a cell that it is paired with; with more it goes by leaders.
CROWD = 4
#: Cells, at most, that two entries must be paired in to be told.
PAIRED_CELLS = 4

_MEMBER = np.uint64(BINS - 1)


def _signed(h: int) -> int:
    return int(np.uint64(h).astype(np.int64))


def _set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that two different sets do not share in practice."""
    with np.errstate(over="ignore"):
        return _signed(mix(hashes, 1).sum(dtype=np.uint64)), _signed(mix(hashes, 2).sum(dtype=np.uint64))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its id, set size and set key; at the end the bins that are common in this task."""
    bins, total = np.zeros(BINS, np.int32), 0
    for batch in slices(batches):
        sizes, one, two = [], [], []
        for hashes in shingle_sets(batch["text"], WIDTH):
            k1, k2 = _set_key(hashes)
            sizes.append(len(hashes))
            one.append(k1)
            two.append(k2)
            np.add.at(bins, hashes & _MEMBER, 1)
            total += len(hashes)
        yield _summary(False, batch["id"].cast(pa.int64()), sizes, one, two)
    common = np.flatnonzero(bins >= max(COMMON_LEAST, COMMON_TIMES * total / BINS))
    nothing = pa.nulls(len(common), pa.int64())
    yield _summary(True, nothing, bins[common], common, np.zeros(len(common)))


def _summary(is_bin, ids, n, k1, k2) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "is_bin": pa.array(np.full(len(ids), is_bin)),
            "id": ids,
            "n": pa.array(np.asarray(n, np.int64)),
            "k1": pa.array(np.asarray(k1, np.int64)),
            "k2": pa.array(np.asarray(k2, np.int64)),
        }
    )


def prefix_length(n: int) -> int:
    """Number of first shingles, in any common order, of which two linked sets share ``1 + m // SHARED_PART``, m the smaller size."""
    return n - (LEAST * n + 99) // 100 + 1 + n // SHARED_PART


def group_counts(hashes: np.ndarray) -> np.ndarray:
    """How many shingles fall into each group; groups are parts of the hash range, so finer ones add up to coarser."""
    bits = n_groups(len(hashes)).bit_length() - 1
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u4")


def n_groups(n: int) -> int:
    """Groups of a set of so many shingles, a power of two."""
    return 1 << (min(MOST_GROUPS, max(GROUPS, n // SHINGLES_PER_GROUP)).bit_length() - 1)


def _point_bytes(counts: np.ndarray) -> bytes:
    return (counts.astype("<u1") if counts.max(initial=0) < 256 else counts).tobytes()


def _counts(point: bytes, n: int) -> np.ndarray:
    return np.frombuffer(point, "<u1" if len(point) == n_groups(n) else "<u4").astype(np.int64)


def _fold(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(groups, -1).sum(axis=1)


def _index_rows(levels):
    """Set key, size and prefix of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = levels.value
        for batch in slices(batches):
            keys, sizes, prefix = [], [], []
            for hashes in shingle_sets(batch["text"], WIDTH):
                keys.append(_set_key(hashes))
                sizes.append(len(hashes))
                level = level_of[hashes & _MEMBER]
                first = hashes if not level.any() else hashes[np.argsort(level, kind="stable")]
                prefix.append((first[: prefix_length(len(hashes))] if len(hashes) else first).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            values = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            yield pa.record_batch(
                {
                    "id": batch["id"].cast(pa.int64()),
                    "k1": pa.array([k[0] for k in keys], pa.int64()),
                    "k2": pa.array([k[1] for k in keys], pa.int64()),
                    "n": pa.array(sizes, pa.int32()),
                    "prefix": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                }
            )

    return run


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set key and group counts of every text."""
    for batch in slices(batches):
        keys, point = [], []
        for hashes in shingle_sets(batch["text"], WIDTH):
            keys.append(_set_key(hashes))
            point.append(_point_bytes(group_counts(hashes)))
        yield pa.record_batch(
            {
                "id": batch["id"].cast(pa.int64()),
                "k1": pa.array([k[0] for k in keys], pa.int64()),
                "k2": pa.array([k[1] for k in keys], pa.int64()),
                "point": pa.array(point, pa.binary()),
            }
        )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = list(shingle_sets(batch["text"], WIDTH))
        keys = [_set_key(s) for s in sets]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.record_batch(
            {
                "id": batch["id"].cast(pa.int64()),
                "k1": pa.array([k[0] for k in keys], pa.int64()),
                "k2": pa.array([k[1] for k in keys], pa.int64()),
                "members": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            }
        )


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of these sizes: 100 * overlap >= LEAST * (a + b - overlap)."""
    return -(-LEAST * (a + b) // (100 + LEAST))


class _Nodes(NamedTuple):
    """Bounds of the nodes of one level: sizes, connected groups, cells, sides, and the largest count of every dimension."""

    low: np.ndarray
    high: np.ndarray
    group: np.ndarray
    last_group: np.ndarray
    cell: np.ndarray
    last_cell: np.ndarray
    side: np.ndarray
    last_side: np.ndarray
    top: np.ndarray

    def over(self, starts: np.ndarray) -> _Nodes:
        """Nodes that each cover the nodes from one start to the next."""
        least, most = np.minimum.reduceat, np.maximum.reduceat
        return _Nodes(*((least, most)[i % 2](v, starts) for i, v in enumerate(self[:-1])), most(self.top, starts, axis=0))

    def fitting(self, x: np.ndarray, y: np.ndarray, two_sided: bool) -> np.ndarray:
        """Positions of the pairs below which a link is possible."""
        alone = lambda first, last: (first[x] == last[x]) & (first[y] == last[y]) & (first[x] == first[y])
        fits = (self.last_cell[x] >= self.cell[y]) & ~alone(self.group, self.last_group)
        fits &= (LEAST * self.low[x] <= 100 * self.high[y]) & (LEAST * self.low[y] <= 100 * self.high[x])
        if two_sided:
            fits &= ~alone(self.side, self.last_side)
        at = np.flatnonzero(fits)
        x, y = x[at], y[at]
        return at[np.minimum(self.top[x], self.top[y]).sum(axis=1) >= _needed(self.low[x], self.low[y])]


def tree_pairs(
    size: np.ndarray, point: np.ndarray, group: np.ndarray, cell: np.ndarray, side: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of row pairs inside each cell that may link, by the bounds of an R-tree.

    Rows are packed into leaves by cell, side, group, size and then their counts, leaves
    into inner nodes; a node keeps the least and largest size and the largest
    count of every dimension. The overlap of two sets is at most the sum of the
    smaller counts, for two nodes the sum of the smaller of their largest
    counts. Node pairs are followed from the root down; those that cannot reach the overlap of a link
    are left out. So are pairs of one ``group`` (already connected), and with both sides present pairs of one side.
    """
    n = len(size)
    if n == 0:
        return
    order = np.lexsort((point[:, 0], size, group, side, cell))
    size, point, group, cell, side = size[order], point[order], group[order], cell[order], side[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    starts = np.flatnonzero(nth % LEAF == 0)
    ends = np.append(starts[1:], n)
    two_sided = side.min() != side.max()
    levels = [_Nodes(size, size, group, group, cell, cell, side, side, point).over(starts)]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].over(np.arange(0, len(levels[-1].low), FAN)))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, x, y = stack.pop()
        at = levels[level].fitting(x, y, two_sided)
        x, y = x[at], y[at]
        if level:
            x, y = _below(x, y, x * FAN, y * FAN, np.minimum(x * FAN + FAN, len(levels[level - 1].low)), np.minimum(y * FAN + FAN, len(levels[level - 1].low)), FAN, True)
            cuts = range(0, len(x), NODE_PAIRS)
            stack += [(level - 1, x[i : i + NODE_PAIRS], y[i : i + NODE_PAIRS]) for i in reversed(cuts)]
            continue
        for i in range(0, len(x), LEAF_PAIRS):
            u, v = x[i : i + LEAF_PAIRS], y[i : i + LEAF_PAIRS]
            a, b = _below(u, v, starts[u], starts[v], ends[u], ends[v], LEAF, False)
            fits = (cell[a] == cell[b]) & (group[a] != group[b])
            fits &= LEAST * np.maximum(size[a], size[b]) <= 100 * np.minimum(size[a], size[b])
            if two_sided:
                fits &= side[a] != side[b]
            a, b = a[fits], b[fits]
            fits = np.minimum(point[a], point[b]).sum(axis=1) >= _needed(size[a], size[b])
            if fits.any():
                yield order[a[fits]], order[b[fits]]


def _below(x, y, x_from, y_from, x_to, y_to, width: int, with_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of what two nodes cover, each pair once; of a node with itself also of a child with itself if asked."""
    steps = np.arange(width)
    a = np.repeat(x_from[:, None] + steps, width, axis=1)
    b = np.tile(y_from[:, None] + steps, (1, width))
    ordered = a <= b if with_self else a < b
    fits = (a < x_to[:, None]) & (b < y_to[:, None]) & ((x != y)[:, None] | ordered)
    return a[fits], b[fits]


def _candidates(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of neighbourhoods that have a partner which their counts cannot rule out: never more than come in."""
    table = table.combine_chunks()
    column = lambda name: np.asarray(table[name].combine_chunks())
    size = column("n")
    fine = [_counts(p, n) for p, n in zip(table["point"].to_pylist(), size.tolist(), strict=True)]
    point = np.stack([_fold(f, GROUPS) for f in fine])
    told = np.zeros(len(size), bool)
    for a, b in tree_pairs(size, point, column("component"), column("cell"), column("side")):
        open_ = ~(told[a] & told[b])
        for i, j in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
            if not (told[i] and told[j]) and _finer_bound(fine[i], fine[j]) >= _needed(size[i], size[j]):
                told[i] = told[j] = True
    return pa.table({"cell": column("cell")[told], "uid": column("uid")[told]})


def _forest(key: tuple, table: pa.Table) -> pa.Table:
    """Links that connect what is linked in some neighbourhoods: one for each row at most.

    Sets are compared exactly, in the order of the tree; a pair that is connected by then is left out.
    """
    table = table.combine_chunks()
    column = lambda name: np.asarray(table[name].combine_chunks())
    members = table["members"].combine_chunks()
    hashes = members.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    size = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    rows = np.repeat(np.arange(len(size)), size)
    shift = np.uint64(64 - (GROUPS.bit_length() - 1))
    point = np.bincount(rows * GROUPS + (hashes >> shift).astype(np.int64), minlength=len(size) * GROUPS).reshape(-1, GROUPS)
    shingles, local = np.unique(hashes, return_inverse=True)
    marked = np.zeros(len(shingles), bool)
    uid = column("uid")
    _, group = np.unique(column("component"), return_inverse=True)
    root = np.arange(group.max(initial=-1) + 1)
    found_a, found_b = [], []
    # A row comes once with all of its cells that are in the task.
    cells = table["cells"].combine_chunks()
    at = np.repeat(np.arange(len(size)), cells.value_lengths().to_numpy(zero_copy_only=False))
    cell = cells.flatten().to_numpy(zero_copy_only=False)
    for a, b in tree_pairs(size[at], point[at], group[at], cell, column("side")[at]):
        a, b = at[a], at[b]
        open_ = root[group[a]] != root[group[b]]
        a, b = a[open_], b[open_]
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        for lo, hi in pairwise([*np.flatnonzero(np.append(True, a[1:] != a[:-1])).tolist(), len(a)] if len(a) else []):
            one, others = int(a[lo]), b[lo:hi]
            others = others[root[group[others]] != root[group[one]]]
            if not len(others):
                continue
            own = local[ends[one] - size[one] : ends[one]]
            marked[own] = True
            lengths = size[others]
            starts = np.cumsum(lengths) - lengths
            theirs = np.repeat(ends[others] - lengths - starts, lengths) + np.arange(lengths.sum())
            both = np.add.reduceat(marked[local[theirs]].astype(np.int64), starts)
            marked[own] = False
            for other in others[100 * both >= LEAST * (size[one] + lengths - both)].tolist():
                low, high = sorted((int(root[group[one]]), int(root[group[other]])))
                if low != high:
                    root[root == high] = low
                    found_a.append(uid[one])
                    found_b.append(uid[other])
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def _finer_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Most shingles that two sets can share, by the finest groups that both keep."""
    groups = min(len(a), len(b))
    return int(np.minimum(_fold(a, groups), _fold(b, groups)).sum())


def _holding(docs: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """(id, text) of the rows of ``docs`` that may have a wanted id, told by a table of hashed ids of fixed size."""
    marked = fresh("bit")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    # At most ID_BITS values, whatever the data.
    bits = wanted.select(bit("id").alias(marked)).distinct()
    return docs.join(F.broadcast(bits), bit("id") == F.col(marked), how).select("id", "text")


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(uid, members) of the wanted (uid, id, k1, k2), made again from the texts of the rows that hold them."""
    sets = _holding(docs, wanted).mapInArrow(_whole_sets, "id long, k1 long, k2 long, members array<long>")
    return sets.join(wanted, ["id", "k1", "k2"])


def _entries(docs: DataFrame, summary: DataFrame, reps: DataFrame, levels, scratch: Scratch) -> DataFrame:
    """(uid, n, prefix) of every set, from the row that stands for it.

    A row whose id is in no other row and whose set no smaller id holds stands for its set under its own id,
    and need not be looked up; the others are few, unless most texts are copies.
    """
    of_set = summary.where("n > 0 and id is not null").join(reps.select("k1", "k2", "rep_id"), ["k1", "k2"])
    odd = of_set.groupBy("id").agg(F.max(F.col("id") != F.col("rep_id")).alias("other"), F.count("*").alias("rows"))
    odd = scratch.write(odd.where("other or rows > 1").select("id"))
    schema = "id long, k1 long, k2 long, n int, prefix array<long>"
    index = lambda rows: rows.mapInArrow(_index_rows(levels), schema).where("n > 0")
    held = docs.where("id is not null and text is not null")
    sure = index(_holding(held, odd, "left_anti")).select(F.col("id").alias("uid"), "n", "prefix")
    named = reps.select("uid", F.col("rep_id").alias("id"), "k1", "k2")
    looked_up = index(_holding(held, odd)).join(named, ["id", "k1", "k2"]).select("uid", "n", "prefix")
    return sure.union(looked_up)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct ``(a, b)`` whose whole sets are similar enough; every ``a`` is in one pair.

    A document that many pairs share as ``b`` is dealt out under several salts.
    """
    named = lambda end: reps.select(F.col("uid").alias(end), F.col("rep_id").alias("id"), "k1", "k2")
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_LINKS).alias("salts"))
    salted = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
    spokes = _sets(salted.join(named("a"), "a").drop("salts"), docs).select("a", "b", "salt", "members")
    hubs = _sets(salts.join(named("b"), "b"), docs).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("members").alias("members_b")
    )
    both = F.size(F.array_intersect("members", "members_b"))
    either = F.size("members") + F.size("members_b") - both
    return spokes.join(hubs, ["b", "salt"]).where(both * 100 >= either * LEAST).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    The set of a text is its distinct shingles of five words (A-Z lower-cased,
    words parted by ASCII white space), or the whole sequence of a shorter text.
    Two rows link at a Jaccard similarity of 0.75; the component is the least
    id reachable by links. A text that is null or without words has an empty
    set and links with nothing; so does a row without id, whose component is
    null. Repeated rows are kept, very long texts are taken whole, an empty
    table gives no rows.

    Equal sets are one entry. Entries meet in cells: those of the shingles that
    any two linked sets must share some of, in an order that puts common
    shingles last, so a passage that many documents share makes no cell. Entries that meet in too few cells to link are
    left out. In a full cell entries have a leader, in others one of two leads the other; each entry is verified against the leader of most of its cells,
    which links groups of copies by one pair an entry. The entries of one leader are
    its neighbourhood; those that are then not all connected are joined by a count-vector R-tree, which
    tells the entries with a possible partner, and once more with their sets, which are compared
    inside the task, so that a task gives at most one link a row.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark, "jaccard") as scratch:
        told = scratch.write(source.mapInArrow(_summarise, "is_bin boolean, id long, n long, k1 long, k2 long"))
        summary = told.where("not is_bin").drop("is_bin")
        reps = summary.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep_id"), F.first("n").alias("n"))
        # An id names its set, unless rows of one id hold several sets of which it is the least id.
        several = reps.groupBy("rep_id").agg(F.count("*").alias("sets")).where("sets > 1")
        uid = F.when(F.col("sets").isNull(), F.col("rep_id")).otherwise(F.xxhash64("k1", "k2"))
        reps = scratch.write(reps.join(several, "rep_id", "left").withColumn("uid", uid).drop("sets"))
        # At most BINS rows: the common bins with the power of two of their count.
        bins = told.where("is_bin").groupBy("k1").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level")).toPandas()
        level_of = np.zeros(BINS, np.uint8)
        level_of[bins["k1"].to_numpy()] = bins["level"].to_numpy()
        levels = spark.sparkContext.broadcast(level_of)
        entries = _entries(source, summary, reps, levels, scratch)
        spokes = _spokes(entries, scratch)
        # The leader of most cells of an entry; of equals the least hash, so that a group agrees on one.
        best = F.max(F.struct("times", F.xxhash64("lead_uid"), "lead_uid"))["lead_uid"]
        # Pairs that share few cells or differ too much in size are left to the tree, which rules out most by their counts.
        fitting = spokes.where(F.greatest("n", "lead_n") * LEAST <= F.least("n", "lead_n") * 100).where(
            F.col("times") * LED_PART >= F.col("n")
        )
        pairs = scratch.write(fitting.groupBy(F.col("uid").alias("a")).agg(best.alias("b")))
        links = scratch.write(_verified(pairs, reps, source))
        first = components(links, scratch)
        near = _neighbourhoods(spokes, first, scratch)
        if near.head(1):
            links = links.union(_linked_inside(near, first, reps, source, scratch))
        final = components(links, scratch)
        named = reps.join(final.withColumnRenamed("node", "uid"), "uid", "left").withColumn(
            "component", F.coalesce("component", "uid")
        )
        least = named.groupBy("component").agg(F.min("rep_id").alias("least"))
        of_set = named.join(least, "component").select("k1", "k2", "least")
        linked = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("least")).otherwise(F.col("id"))
        result = summary.join(of_set, ["k1", "k2"], "left").select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), linked.alias("component_id")
        )
        return save(result, "jaccard-components")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that a document of a smaller id stands for; columns stay as they are.

    Rows without id or words stay; of rows that repeat one id one stays. Only
    rows that may go are shuffled: the others are told apart by a table of
    hashed ids of fixed size.
    """
    found = jaccard_components(docs, id_col, text_col)
    gone_id, goes, bit_of, marked, nth = (fresh(name) for name in ("gone_id", "gone", "bit_of", "bit", "nth"))
    times = F.count("*")
    gone = (
        found.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias(gone_id))
        .agg(F.max(F.col("component_id") < F.col(id_col)).alias(goes), times.alias(nth))
        .where(F.col(goes) | (F.col(nth) > 1))
        .select(gone_id, goes)
    )
    gone = save(gone, "jaccard-gone")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    bits = F.broadcast(gone.select(bit(F.col(gone_id).cast("long")).alias(bit_of)).distinct())  # ID_BITS rows at most
    rows = docs.withColumn(marked, bit(F.col(id_col).cast("long")))
    sure = rows.join(bits, F.col(marked) == F.col(bit_of), "left_anti").drop(marked)
    of_id = Window.partitionBy(id_col).orderBy(text_col)
    unsure = (
        rows.join(bits, F.col(marked) == F.col(bit_of), "left_semi")
        .drop(marked)
        .join(gone, F.col(id_col) == F.col(gone_id), "left")
        .where(F.col(goes).isNull() | ~F.col(goes))
        .withColumn(nth, F.row_number().over(of_id))
        .where((F.col(nth) == 1) | F.col(id_col).isNull())
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )
    return sure.union(unsure)


def _like(less: Column, more: Column) -> Column:
    """Whether sets of these sizes may link."""
    return more.cast("long") * LEAST <= less.cast("long") * 100


def _paired_cells(n: Column) -> Column:
    """Of the cells that linked sets share, ``n`` the smaller size: two that are paired in fewer than these are led in others."""
    return F.least(F.lit(PAIRED_CELLS), F.floor((2 + F.floor(n / SHARED_PART)) / 2))


def _led_cells(n: Column) -> Column:
    """Least number of cells in which an entry of ``n`` shingles is led together with a linked one that it is not paired with often enough."""
    smaller = F.ceil(n.cast("long") * LEAST / 100)
    return 2 + F.floor(smaller / SHARED_PART) - _paired_cells(smaller)


def _spokes(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, lead_uid, times, n, lead_n): any two entries that may link have a leader in common, or one leads the other.

    In a cell an entry is paired with the entries of like size behind it, unless these are many: then it and they go by
    leaders. Two linked entries share ``1 + m // SHARED_PART`` cells, m the smaller size. So they are paired in
    some of them, or each is led in the rest, and what meets in fewer cells, as texts of one language do by chance, is left out.
    """
    in_cell = Window.partitionBy("cell").orderBy("n", "uid")
    met = (
        entries.select(F.explode("prefix").alias("cell"), "uid", "n")
        .withColumn("previous", F.lag("n").over(in_cell))
        .withColumn("next", F.lead("n").over(in_cell))
        .where(_like(F.col("previous"), F.col("n")) | _like(F.col("n"), F.col("next")))
        .withColumns({f"{c}_{k}": F.lead(c, k).over(in_cell) for c in ("uid", "n") for k in range(1, CROWD + 1)})
        .withColumn("crowded", F.coalesce(_like(F.col("n"), F.lead("n", CROWD + 1).over(in_cell)), F.lit(False)))
        # A row behind a crowded one of like size goes by leaders too.
        .withColumn("behind_crowd", _like(F.max(F.when(F.col("crowded"), F.col("n"))).over(in_cell), F.col("n")))
        .withColumns({name: _leader(shift) for name, shift in LEADERS.items()})
    )
    spoke = lambda uid, n, lead, lead_n, led: F.struct(
        uid.alias("uid"), lead.alias("lead_uid"), n.alias("n"), lead_n.alias("lead_n"), F.lit(led).alias("led")
    )
    uid, n = F.col("uid"), F.col("n")
    spokes = [F.when(F.col("behind_crowd"), spoke(uid, n, F.col(lead)["uid"], F.col(lead)["n"], True)) for lead in LEADERS]
    for k in range(1, CROWD + 1):
        other, other_n = F.col(f"uid_{k}"), F.col(f"n_{k}")
        fits = ~F.col("crowded") & _like(n, other_n)
        spokes.append(F.when(fits & (uid < other), spoke(other, other_n, uid, n, False)).when(fits & (uid > other), spoke(uid, n, other, other_n, False)))
    times_in = met.select(F.explode(F.array(*spokes)).alias("spoke")).where("spoke is not null").groupBy("spoke.uid", "spoke.lead_uid", "spoke.led")
    told = times_in.agg(F.count("*").alias("times"), F.first("spoke.n").alias("n"), F.first("spoke.lead_n").alias("lead_n"))
    told = scratch.write(told.where(F.col("led") | (F.col("times") >= _paired_cells(F.least("n", "lead_n")))))
    paired = told.where("not led")
    # An entry has its two leaders in every cell where it is led, itself maybe.
    led = told.where("led")
    enough = led.groupBy("uid").agg(F.sum("times").alias("rows"), F.first("n").alias("n")).where(F.col("rows") >= 2 * _led_cells(F.col("n")))
    led = led.where("lead_uid <> uid").join(enough.select("uid"), "uid", "left_semi").select(paired.columns)
    kept = paired.withColumn("times", F.col("times") * len(LEADERS)).union(led)
    return scratch.write(kept.groupBy("uid", "lead_uid").agg(F.sum("times").alias("times"), F.first("n").alias("n"), F.first("lead_n").alias("lead_n")))


def _leader(shift: float) -> Column:
    """One entry of the row's cell and size class, drawn by hash, so that most cells of a group draw the same one.

    A class is as wide as two linked sets can differ in size, twice over; with
    the classes moved by half their width, any two sets that may link share
    one of their two classes.
    """
    width = 2 * math.log(100 / LEAST)
    size_class = F.floor(F.log("n") / width + shift)
    return F.first(F.struct("uid", "n")).over(Window.partitionBy("cell", size_class).orderBy(F.xxhash64("uid"), "uid"))


def _neighbourhoods(spokes: DataFrame, first: DataFrame, scratch: Scratch) -> DataFrame:
    """(cell, uid, n, component) of the leaders that are not connected with all their entries, and of those entries.

    Entries that may link share a leader; where each is connected with its leaders, nothing is left to find.
    """
    of = lambda name, to: first.select(F.col("node").alias(name), F.col("component").alias(to))
    told = (
        spokes.select("uid", "n", "lead_uid", "lead_n")
        .join(of("uid", "component"), "uid", "left")
        .join(of("lead_uid", "lead_component"), "lead_uid", "left")
        .withColumn("component", F.coalesce("component", "uid"))
        .withColumn("lead_component", F.coalesce("lead_component", "lead_uid"))
    )
    told = scratch.write(told)
    open_ = told.where("component <> lead_component").groupBy("lead_uid").agg(
        F.first("lead_n").alias("n"), F.first("lead_component").alias("component")
    )
    open_ = scratch.write(open_)
    members = told.join(open_.select("lead_uid"), "lead_uid", "left_semi").select(
        F.col("lead_uid").alias("cell"), "uid", "n", "component"
    )
    leaders = open_.select(F.col("lead_uid").alias("cell"), F.col("lead_uid").alias("uid"), "n", "component")
    return scratch.write(members.union(leaders).withColumn("n", F.col("n").cast("long")))


def _dealt(near: DataFrame, leads: DataFrame, weight: Column, chunk: int, task: int) -> DataFrame | None:
    """Rows of neighbourhoods with the tasks that they go to: large ones are dealt to pairs of chunks, small ones share a task.

    Neighbourhoods whose leaders are connected hold much the same entries, so they share a task as far as it has room.
    """
    sizes = near.groupBy("cell").agg(F.sum(weight).alias("weight")).join(leads, "cell")
    per_lead = sizes.groupBy("lead").agg(F.sum("weight").alias("lead_weight"))
    total = per_lead.agg(F.sum("lead_weight")).first()[0]
    if total is None:
        return None
    chunks = F.ceil(F.col("weight") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("uid"), chunks).cast("int")
    place = lambda task, i, j, side: F.struct(task.alias("task"), i.alias("i"), j.alias("j"), side.alias("side"))
    several = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda j: place(F.col("cell"), F.least(mine, j), F.greatest(mine, j), F.when(j < mine, 1).otherwise(0)),
    )
    part = F.pmod(F.xxhash64("cell"), F.ceil(F.col("lead_weight") / task))
    shared = F.pmod(F.xxhash64("lead", part), F.lit(-(-total // task)))
    single = F.array(place(shared, F.lit(-1), F.lit(-1), F.lit(0)))
    dealt = near.join(sizes.join(per_lead, "lead"), "cell").withColumn("at", F.explode(F.when(chunks > 1, several).otherwise(single)))
    return dealt.select("at.*", "cell", "uid", "n", "component")


def _linked_inside(near: DataFrame, first: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that connect what is linked inside the neighbourhoods and not connected yet."""
    wanted = reps.select("uid", F.col("rep_id").alias("id"), "k1", "k2").join(near.select("uid").distinct(), "uid", "left_semi")
    points = _holding(docs, wanted).mapInArrow(_points, "id long, k1 long, k2 long, point binary")
    points = points.join(wanted, ["id", "k1", "k2"]).dropDuplicates(["uid"])
    # A leader is among its own entries.
    leads = near.where("uid = cell").select("cell", F.col("component").alias("lead"))
    dealt = _dealt(near, leads, F.lit(1), CHUNK_ROWS, TASK_ROWS)
    told = dealt.join(points.select("uid", "point"), "uid").groupBy("task", "i", "j").applyInArrow(_candidates, "cell long, uid long")
    told = scratch.write(told.distinct())
    left = scratch.write(near.join(told, ["cell", "uid"], "left_semi"))
    dealt = _dealt(left, leads, F.col("n") * 8, CHUNK_BYTES, TASK_BYTES)
    if dealt is None:
        return first.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    once = dealt.groupBy("task", "i", "j", "side", "uid").agg(F.collect_list("cell").alias("cells"), F.first("component").alias("component"))
    sets = _sets(wanted.join(left.select("uid").distinct(), "uid", "left_semi"), docs).dropDuplicates(["uid"])
    both = once.join(scratch.write(sets.select("uid", "members")), "uid")
    return scratch.write(both.groupBy("task", "i", "j").applyInArrow(_forest, "a long, b long"))
