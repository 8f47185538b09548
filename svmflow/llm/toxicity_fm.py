"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svmflow.llm.common import save
from svmflow.llm.shingling import plain_terms, slices

#: Labelled documents of each class that the machine is fitted on, about.
TRAIN_PER_CLASS = 4_000
#: Values that terms are hashed to; large, as a long text holds thousands of terms and few count.
HASH_BITS = 40
#: Terms that the machine keeps: those most dependent on the label, at least so much (chi-squared).
TERMS, LEAST_CHI2 = 2_048, 25.0
#: Width of the pairwise factors, passes over the sample, rows of a step, learning rate and shrinkage.
FACTORS, PASSES, STEP_ROWS, RATE, SHRINK = 8, 30, 64, 0.1, 1e-4
#: Score from which a document counts as toxic.
TOXIC_FROM = 0.7


def held_out(id_col: str) -> Column:
    """Rows whose labels nothing may be learned from."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(3)) == 1


def _terms(text: str, keep: tuple[str, ...]):
    """Rows of ``keep`` with the distinct hashed terms of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [t >> np.uint64(64 - HASH_BITS) for t in plain_terms(batch[text])]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.record_batch(
                {k: batch[k] for k in keep} | {"terms": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}
            )

    return run


class FactorizationMachine:
    """w0 + sum of w over the terms present + sum of the products of factors over pairs of them."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        n = len(self.terms)
        self.w0, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(5).normal(0, 0.05, (n, FACTORS))

    def columns(self, terms: np.ndarray) -> np.ndarray:
        """Positions of those of the sorted ``terms`` that the machine knows."""
        if not len(self.terms) or not len(terms):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at[self.terms[at] == terms]

    def margin(self, columns: np.ndarray) -> float:
        factors = self.v[columns]
        total = factors.sum(axis=0)
        return float(self.w0 + self.w[columns].sum() + 0.5 * (total @ total - (factors * factors).sum()))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """Logistic loss by AdaGrad over shuffled steps of rows."""
        rng = np.random.default_rng(3)
        seen0, seen_w, seen_v = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        for _ in range(PASSES if len(rows) else 0):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), STEP_ROWS):
                g0, gw, gv = 0.0, SHRINK * self.w, SHRINK * self.v
                for i in order[at : at + STEP_ROWS]:
                    x = rows[i]
                    error = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.margin(x))))) - labels[i]
                    g0 += error
                    gw[x] += error
                    gv[x] += error * (self.v[x].sum(axis=0) - self.v[x])
                seen0 += g0 * g0
                seen_w += gw * gw
                seen_v += gv * gv
                self.w0 -= RATE * g0 / math.sqrt(seen0)
                self.w -= RATE * gw / np.sqrt(seen_w)
                self.v -= RATE * gv / np.sqrt(seen_v)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> FactorizationMachine:
    """A machine fitted on a hash-drawn sample of labelled documents outside the held-out fold.

    Terms are chosen by their dependence on the label over the sample, which
    is counted in Spark; the sample's chosen terms, a few for each document,
    are what reaches the fitting loop.
    """
    known = labels.where(~held_out(id_col) & F.col("toxic").isin(0, 1)).select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, TRAIN_PER_CLASS / max(n, TRAIN_PER_CLASS)).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30)) < share * (1 << 30)
    # About twice TRAIN_PER_CLASS ids, whatever the data.
    sample = F.broadcast(known.where(drawn))
    rows = save(
        docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
        .join(sample, "id")
        .mapInArrow(_terms("text", ("toxic",)), "toxic int, terms array<long>"),
        "toxicity-sample",
    )
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    a, m, p = F.col("hits").cast("double"), F.col("docs").cast("double"), float(positive)
    chi2 = F.lit(float(n)) * F.pow(a * n - m * p, 2) / (m * (n - m) * p * (n - p) + F.lit(1e-9))
    chosen = (
        rows.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("docs"), F.sum("toxic").alias("hits"))
        .where(F.col("docs") >= 5)
        .select("term", chi2.alias("chi2"))
        .where(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "term")
        .limit(TERMS)
    )
    machine = FactorizationMachine(np.array([r["term"] for r in chosen.collect()], np.int64))
    wanted = F.array(*(F.lit(int(t)) for t in machine.terms)) if len(machine.terms) else F.array().cast("array<long>")
    fitted = rows.select("toxic", F.array_sort(F.array_intersect("terms", wanted)).alias("terms")).toPandas()
    fitted = fitted.assign(k=[tuple(t) for t in fitted["terms"]]).sort_values(["toxic", "k"], kind="stable")
    machine.fit([machine.columns(np.array(t, np.int64)) for t in fitted["k"]], fitted["toxic"].to_numpy(float))
    return machine


def _score(model) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        machine = model.value
        out = []
        for terms in plain_terms(texts):
            margin = machine.margin(machine.columns(np.unique(terms >> np.uint64(64 - HASH_BITS)).astype(np.int64)))
            out.append(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, margin)))))
        return pa.array(out, pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every document.

    Terms are the words of the whole text, A-Z lower-cased and without
    punctuation behind them, and their first 4 to 6 bytes. A null or empty
    text, and one without known terms, gets the score of no evidence. Without
    labels every score is 0.5. Null or other labels are not learned from,
    repeated rows fare alike, an empty table gives no rows, and other columns
    are never looked at.
    """
    score = _score(docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, id_col)))
    return docs.select(
        id_col, held_out(id_col).alias("held_out"), score(F.col("text").cast("string")).alias("score")
    ).withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))
