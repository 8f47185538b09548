"""Incremental, reversible line deduplication: sharded cuckoo filters in front of exact reference-count tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from svmflow.llm.common import fresh, save
from svmflow.llm.cuckoo import CuckooFilter
from svmflow.session import scratch_path

#: Code points that a key needs to count.
LEAST_CHARS = 10
#: Keys of a filter shard, about; shards are powers of two and double as keys come in.
SHARD_KEYS = 16_384
#: Batches that a whole corpus is inserted in.
BATCHES = 2

_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(_UPPER, _LOWER)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_WHITE)), _UPPER, _LOWER)


def references(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (key, doc_id) of lines that count; keys are SHA-256 digests. Rows without id or text have none."""
    keys = F.transform(F.split(F.col(text_col).cast("string"), "\n", -1), line_key)
    counted = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= LEAST_CHARS))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(counted).alias("line"))
    return rows.select(F.unhex(F.sha2("line", 256)).alias("key"), "doc_id").distinct()


def _hashes(keys: pa.ChunkedArray) -> np.ndarray:
    """64 bits of each digest, other than those that choose its shard."""
    raw = b"".join(keys.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, 4)[:, 1].copy() if raw else np.zeros(0, np.uint64)


def _loaded(shard: pa.Table) -> CuckooFilter:
    return CuckooFilter.from_bytes(shard["body"][0].as_py()) if shard.num_rows else CuckooFilter()


def _probe(keys: pa.Table, shard: pa.Table) -> pa.Table:
    """The keys of a batch, and whether the index may hold them; a no is certain."""
    maybe = _loaded(shard).contains(_hashes(keys["key"]))
    return keys.select(["key", "n_docs", "first_doc"]).append_column("maybe", pa.array(maybe, pa.bool_()))


def _update(key: tuple, changes: pa.Table, shard: pa.Table) -> pa.Table:
    """The filter of a shard after deletions and insertions."""
    held = _loaded(shard)
    hashes = _hashes(changes["key"])
    gone = changes["gone"].to_numpy(zero_copy_only=False).astype(bool)
    held.delete(hashes[gone])
    held.insert(np.sort(hashes[~gone]))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([held.to_bytes()], pa.binary())})


class LineIndex:
    """Which documents hold which lines, kept as tables in a shared folder; every change adds a version.

    ``references`` has one row per key and document, ``removed`` the documents
    that left, ``counts`` the documents of every changed key and the smallest
    of them, exact in its newest version, and ``filters`` one cuckoo filter per
    shard of the key space over all keys that have documents. A batch asks
    the filters first: keys that they do not hold are new for certain and are
    only written; only the others are looked up in the counts. Shards get one row per
    key, never per document, so a line that all documents hold is no hot key.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "line-index")
        self.version = 0
        #: Leading bits of a key that name its shard, keys that have documents, and deletions so far.
        self.bits, self.n_keys, self.removals = 0, 0, 0

    def _write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={self.version}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, version int").parquet(f"{self.path}/{name}")

    def live_references(self) -> DataFrame:
        """(key, doc_id) of the documents in the index."""
        rows = self._read("references", "key binary, doc_id long")
        if self.removals:
            removed = self._read("removed", "doc_id long").groupBy("doc_id").agg(F.max("version").alias("removed_in"))
            rows = rows.join(removed, "doc_id", "left").where("removed_in is null or removed_in < version")
        return rows.select("key", "doc_id")

    def counts(self) -> DataFrame:
        """(key, n_docs, first_doc) of every key that documents hold."""
        rows = self._read("counts", "key binary, n_docs long, first_doc long")
        newest = rows.groupBy("key").agg(F.max_by(F.struct("n_docs", "first_doc"), "version").alias("now"))
        return newest.select("key", "now.*").where("n_docs > 0")

    def _filters(self) -> DataFrame:
        schema = "shard int, body binary"
        if self.version == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/filters/version={self.version}")

    def _shard(self, bits: int) -> Column:
        lead = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
        return F.shiftright(lead, 32 - bits).cast("int")

    def _refilter(self, changes: DataFrame, n_keys: int) -> DataFrame:
        """Filters after (key, gone) changes; with many more keys than shards they are made anew over twice the shards."""
        bits = max(0, (max(1, n_keys // SHARD_KEYS) - 1).bit_length())
        filters = self._filters()
        if bits > self.bits:
            old = self.counts().select("key", F.lit(False).alias("gone")) if self.version else changes.limit(0)
            changes = old.unionByName(changes)
            filters = filters.limit(0)
            self.bits = bits
        dealt = changes.withColumn("shard", self._shard(self.bits))
        return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_update, "shard int, body binary")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents that are not in the index; see ``replace`` for others."""
        fresh_rows = save(references(docs, id_col, text_col), "line-references")
        batch = fresh_rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        batch = save(batch, "line-batch")
        if self.version == 0:
            counted = batch.withColumn("is_new", F.lit(True))
        else:
            dealt = batch.withColumn("shard", self._shard(self.bits))
            probed = dealt.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(
                _probe, "key binary, n_docs long, first_doc long, maybe boolean"
            )
            probed = save(probed, "line-probed")
            asked = probed.where("maybe").drop("maybe")
            rows = self._read("counts", "key binary, n_docs long, first_doc long").join(asked.select("key"), "key", "left_semi")
            known = rows.groupBy("key").agg(F.max_by(F.struct("n_docs", "first_doc"), "version").alias("was"))
            met = asked.join(known.where("was.n_docs > 0"), "key", "left").select(
                "key",
                (F.col("n_docs") + F.coalesce("was.n_docs", F.lit(0))).alias("n_docs"),
                F.least("first_doc", "was.first_doc").alias("first_doc"),
                F.col("was").isNull().alias("is_new"),
            )
            counted = probed.where("not maybe").drop("maybe").withColumn("is_new", F.lit(True)).unionByName(met)
        counted = save(counted, "line-counted")
        n_keys = self.n_keys + counted.where("is_new").count()
        filters = self._refilter(counted.where("is_new").select("key", F.lit(False).alias("gone")), n_keys)
        self._commit(filters, counted.drop("is_new"), n_keys, references=fresh_rows)

    def _commit(self, filters: DataFrame, counts: DataFrame, n_keys: int, **tables: DataFrame) -> None:
        """Write the next version. It counts once all its tables are there."""
        self.version += 1
        for name, df in {**tables, "counts": counts, "filters": filters}.items():
            self._write(name, df)
        self.n_keys = n_keys

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents out; lines that they alone kept from others come back. Ids not in the index are ignored."""
        gone = ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        gone = save(gone, "line-gone")
        if self.version == 0:
            return
        live = self.live_references()
        touched = save(live.join(gone, "doc_id", "left_semi").select("key").distinct(), "line-touched")
        rest = live.join(gone, "doc_id", "left_anti").join(touched, "key", "left_semi")
        left = rest.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        counted = touched.join(left, "key", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)).cast("long"))
        counted = save(counted.select("key", "n_docs", "first_doc"), "line-counted")
        dropped = counted.where("n_docs = 0").select("key", F.lit(True).alias("gone"))
        n_keys = self.n_keys - dropped.count()
        self._commit(self._refilter(dropped, n_keys), counted, n_keys, removed=gone)
        self.removals += 1

    def replace(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Documents whose text may have changed: taken out, where they are in, and added."""
        self.delete(docs.select(id_col), id_col)
        self.insert(docs, id_col, text_col)

    def dropped_keys(self) -> DataFrame:
        """(doc_id, keys): per document the keys that a document of a smaller id keeps."""
        shared = self.counts().where("n_docs > 1").select("key", "first_doc")
        lost = self.live_references().join(shared, "key").where("doc_id <> first_doc")
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_lines, n_dropped, text) of documents of the index: texts without the lines that others keep."""
        keys, joined = fresh("keys"), fresh("doc_id")
        dropped = self.dropped_keys().select(F.col("doc_id").alias(joined), F.col("keys").alias(keys))
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        both = rows.join(dropped, F.col("id").cast("long") == F.col(joined), "left").drop(joined)
        kind = docs.schema[id_col].dataType.simpleString()
        out = both.select("id", "text", F.col(keys).alias("keys")).mapInArrow(
            _without, f"id {kind}, n_lines long, n_dropped long, text string"
        )
        return out.withColumnRenamed("id", id_col)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, texts = [], [], []
        for text, keys in zip(batch["text"], batch["keys"], strict=True):
            text, keys = text.as_py() or "", set(keys.as_py() or ())
            lines = text.split("\n")
            n_lines.append(len(lines))
            if keys:
                kept = [line for line in lines if _digest(line) not in keys]
                n_dropped.append(len(lines) - len(kept))
                text = "\n".join(kept)
            else:
                n_dropped.append(0)
            texts.append(text)
        yield pa.record_batch(
            {"id": batch["id"], "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "text": pa.array(texts, pa.string())}
        )


def _digest(line: str) -> bytes:
    return hashlib.sha256(line.strip(_WHITE).translate(_LOWERED).encode()).digest()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, n_lines, n_dropped, text) of every row of ``docs`` without the lines that a document of a smaller id keeps.

    Texts are split at line feeds; a line's key is the line without ASCII
    white space at its ends, A-Z lower-cased. Lines whose key has at least ten
    code points and is in at least two documents stay only in the document of the smallest id that
    holds it, there all of them; all other lines stay, in order.

    A null or empty text is one empty line. Rows of one id are one document.
    Rows without id keep all lines and count for no key. Lines and texts of any length are taken whole, an
    empty table gives no rows, and further columns are ignored.

    The documents go into a fresh ``LineIndex`` in ``batches`` parts by the hash of
    their id, each document in one, so that later parts meet the filters of earlier ones.
    """
    index = LineIndex(docs.sparkSession)
    part = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(batches))
    for i in range(batches):
        index.insert(docs.where(part == i), id_col, text_col)
    return index.dedup(docs, id_col, text_col)
