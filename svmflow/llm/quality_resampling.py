"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svmflow.llm.common import fresh, save
from svmflow.llm.shingling import mix, slices, text_blocks

#: UTF-8 bytes of an n-gram, and the buckets that n-grams are hashed into.
GRAM, BUCKETS = 3, 1 << 16
#: Labelled good documents at most that the target model is fitted on.
TARGET_ROWS = 20_000
#: Part of the fitted good documents that may lie below the weight which sets how many documents are sampled.
LOST_PART = 0.003
#: Equal parts that a search for the k-th key looks at in one pass.
PARTS = 256


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte; the last ``GRAM - 1`` bytes begin none."""
    n = max(0, len(data) - GRAM + 1)
    code = np.zeros(n, np.uint64)
    for k in range(GRAM):
        code = (code << np.uint64(8)) | data[k : n + k]
    return (mix(code) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which n-grams lie inside one text."""
    inside = np.ones(n, bool)
    for back in range(1, GRAM):
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    return inside


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        for _, data, offsets in text_blocks(batch["text"]):
            buckets = gram_buckets(data)
            counts += np.bincount(buckets[_inside(offsets, len(buckets))], minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.record_batch({"bucket": pa.array(used), "n": pa.array(counts[used])})


def _model(texts: DataFrame) -> np.ndarray:
    """Log probability of each bucket, add-one smoothed; one count per bucket reaches the driver."""
    counted = texts.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.ones(BUCKETS)
    counts[counted["bucket"].to_numpy()] += counted["n"].to_numpy()
    return np.log(counts) - math.log(counts.sum())


def _log_weight(table) -> Column:
    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        ratio = table.value
        out = np.zeros(len(texts))
        for at, data, offsets in text_blocks(texts):
            buckets = gram_buckets(data)
            values = np.where(_inside(offsets, len(buckets)), ratio[buckets], 0.0)
            total = np.concatenate([[0.0], np.cumsum(values)])
            ends = np.minimum(offsets, len(values))
            out[at : at + len(offsets) - 1] = total[ends[1:]] - total[ends[:-1]]
        return pa.array(out)

    return weigh


def gumbel(id_col: str, seed: int) -> Column:
    """A standard Gumbel draw that depends on the id and the seed alone."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 52))
    return -F.log(-F.log((drawn + 0.5) / float(1 << 52)))


class Resampler:
    """Importance weights of documents, fitted on good labelled documents against all documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int = 1, id_col: str = "doc_id"):
        """``labels`` has the id and ``quality`` (1: good).

        The raw model counts all of ``docs``. The target model counts at most
        ``TARGET_ROWS`` good documents, drawn by hash. Without any good
        document both models are equal, all weights are 0 and all are kept.
        """
        self.seed, self.id_col = seed, id_col
        good = labels.where("quality = 1").select(F.col(id_col).alias("good_id")).distinct()
        n_good = good.count()
        drawn = F.pmod(F.xxhash64(F.lit(seed), "good_id"), F.lit(1 << 30)) < int((1 << 30) * TARGET_ROWS / max(n_good, TARGET_ROWS))
        # About TARGET_ROWS ids at most, whatever the data.
        sample = F.broadcast(good.where(drawn))
        texts = docs.select(F.col(id_col).alias("good_id"), F.col("text").cast("string").alias("text"))
        target = texts.join(sample, "good_id", "left_semi").select("text")
        raw = _model(texts.select("text"))
        ratio = _model(target) - raw if n_good else np.zeros(BUCKETS)
        self.weigh = _log_weight(docs.sparkSession.sparkContext.broadcast(ratio))
        cut = target.select(self.weigh("text").alias("w")).agg(F.percentile("w", F.lit(LOST_PART)).alias("cut")).first()["cut"]
        self.least = 0.0 if cut is None else cut

    def keys(self, docs: DataFrame, log_weight: str, key: str) -> DataFrame:
        """``docs`` with the log importance weight and the weight perturbed by a Gumbel draw."""
        # Whole columns of weights are summed in one order, so that reruns agree to the bit of the rounding below.
        weight = F.round(self.weigh(F.col("text").cast("string")), 6)
        return docs.withColumn(log_weight, weight).withColumn(key, F.col(log_weight) + gumbel(self.id_col, self.seed))

    def threshold(self, scored: DataFrame, log_weight: str, key: str) -> float:
        """The key of the last of the k sampled documents; k is how many weigh as much as good documents do."""
        k = scored.where(F.col(log_weight) >= self.least).count()
        return kth_largest(scored, key, k)


def kth_largest(scored: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a column, by counts over ever finer parts of its range; infinity for k = 0."""
    if k == 0:
        return math.inf
    low, high = scored.agg(F.min(key), F.max(key)).first()
    while low < high:
        width = (high - low) / PARTS
        if low + width == low:
            break
        part = F.least(F.floor((F.col(key) - low) / width), F.lit(PARTS - 1))
        inside = scored.where((F.col(key) >= low) & (F.col(key) <= high))
        counts = inside.groupBy(part.alias("part")).agg(
            F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")
        )
        above = scored.where(F.col(key) > high).count()
        for row in counts.orderBy(F.desc("part")).collect():
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low


def quality_sample(docs: DataFrame, labels: DataFrame, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(id, log_weight, sample_key, kept) of every document.

    The log weight is the log ratio of the text's n-grams under the two
    models. Sampling without replacement in proportion to the weights takes the
    k largest weights perturbed by Gumbel draws; documents with equal keys at
    the end are all taken. A null or very short text has no n-gram and weight
    1. Null ids share one draw, repeated rows fare alike, an empty table gives
    no rows, further columns are ignored.
    """
    model = Resampler(docs, labels, seed, id_col)
    scored = save(model.keys(docs.select(id_col, "text"), "log_weight", "sample_key").drop("text"), "quality-keys")
    least = model.threshold(scored, "log_weight", "sample_key")
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(least))


def quality_documents(docs: DataFrame, labels: DataFrame, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, with their columns."""
    model = Resampler(docs, labels, seed, id_col)
    weight, key = fresh("weight"), fresh("key")
    scored = save(model.keys(docs.select(id_col, "text"), weight, key).drop("text"), "quality-keys")
    least = model.threshold(scored, weight, key)
    return model.keys(docs, weight, key).where(F.col(key) >= F.lit(least)).drop(weight, key)
