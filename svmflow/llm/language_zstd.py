"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Raw content of a dictionary, and the longest text taken into one whole.
DICTIONARY_BYTES, SAMPLE_TEXT_BYTES = 1 << 17, 1 << 14
#: Texts of each language that dictionaries are made of, about.
SAMPLE_TEXTS = 400
#: Slices of longer texts of each language that fill up what its short texts leave, about.
SAMPLE_SLICES = 64
#: Compression level; levels under 6 miss many of the short matches that tell languages apart.
LEVEL = 7
#: Part by which the smallest size must undercut the next for an answer to count as sure.
SURE_MARGIN = 0.01
#: Bytes of difference that change the odds by a factor of two.
BYTES_PER_HALVING = 2.0

UNDETERMINED = "und"


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    """Rows that nothing may be learned from."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(folds)) == fold


def _drawn(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """(lang, text, draw) of about ``most`` rows of each language, by hash."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.lit("dictionary"), id_col, "text"), F.lit(1 << 30))
    return (
        rows.join(F.broadcast(counts), "lang")  # one row per language
        .where(draw * F.col("n") < F.lit(most << 30))
        .select("lang", "text", draw.alias("draw"))
    )


def _slice(draw: Column) -> Column:
    """A run of characters of a long text, from a place that the draw tells."""
    spare = F.greatest(F.length("text") - SAMPLE_TEXT_BYTES // 2, F.lit(0))
    at = F.pmod(F.xxhash64(F.lit("slice"), draw), spare + 1).cast("int")
    return F.substring("text", at + 1, F.lit(SAMPLE_TEXT_BYTES // 2))


def learn_dictionaries(docs: DataFrame, id_col: str = "doc_id") -> dict[str, bytes]:
    """Raw dictionary content of every language, from a hash-drawn sample of bounded size.

    Only rows outside the held-out fold with a language and a letter count.
    Short texts come first and whole; where they do not fill the dictionary,
    slices of longer texts follow, so a language of long texts has one too.
    A language with little text gets a smaller dictionary.
    """
    rows = docs.select(id_col, "lang", F.col("text").cast("string").alias("text")).where(
        ~held_out(id_col) & F.col("lang").isNotNull()
    )
    short = _drawn(rows.where(F.octet_length("text").between(1, SAMPLE_TEXT_BYTES)), id_col, SAMPLE_TEXTS)
    longer = _drawn(rows.where(F.octet_length("text") > SAMPLE_TEXT_BYTES), id_col, SAMPLE_SLICES)
    sampled = (
        short.withColumn("long", F.lit(False))
        .union(longer.select("lang", _slice(F.col("draw")).alias("text"), "draw", F.lit(True)))
        .orderBy("lang", "long", "draw", "text")
    )
    parts: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for row in sampled.toLocalIterator():
        data = row["text"].lower().encode()
        if sizes.get(row["lang"], 0) + len(data) <= DICTIONARY_BYTES:
            parts.setdefault(row["lang"], []).append(data)
            sizes[row["lang"]] = sizes.get(row["lang"], 0) + len(data) + 1
    return {lang: b"\n".join(texts) for lang, texts in sorted(parts.items())}


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(model.value)
        packers = []
        for name in names:
            content = zstandard.ZstdCompressionDict(model.value[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            packers.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )
        for batch in batches:
            texts = pc.utf8_lower(pc.fill_null(batch["text"].cast(pa.large_string()), ""))
            spoken = np.asarray(pc.match_substring_regex(texts, r"\p{L}")) & bool(names)
            lang, score, sure = [], [], []
            for text, any_letter in zip(texts, spoken, strict=True):
                if not any_letter:
                    lang.append(UNDETERMINED)
                    score.append(0.0)
                    sure.append(False)
                    continue
                data = text.as_buffer()
                sizes = np.array([len(p.compress(data)) for p in packers], float)
                order = np.argsort(sizes, kind="stable")
                best, next_best = sizes[order[0]], sizes[order[1]] if len(order) > 1 else np.inf
                odds = np.exp2(-np.minimum(sizes - best, 1_000) / BYTES_PER_HALVING)
                lang.append(names[order[0]])
                score.append(float(1.0 / odds.sum()))
                sure.append(bool(next_best - best >= SURE_MARGIN * best))
            yield pa.record_batch(
                {
                    "id": batch["id"],
                    "held_out": batch["held_out"],
                    "lang_pred": pa.array(lang, pa.string()),
                    "score": pa.array(score, pa.float64()),
                    "sure": pa.array(sure, pa.bool_()),
                }
            )

    return run


def identify_language(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, lang_pred, score, sure) of every document.

    Each whole text, lower-cased, is compressed with the dictionary of every language; the
    smallest wins, ties go to the first name. ``score`` is the share of the
    winner in the odds that the sizes imply. ``sure`` is false where the
    margin to the next language is narrow: such answers are to be rejected. A
    text that is null or has no letter, and every text when no language could
    be learned, gives ``und`` with score 0. Repeated rows fare alike, an empty
    table gives no rows, and other columns are never looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn_dictionaries(docs, id_col))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), held_out(id_col).alias("held_out")
    )
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(
        _predict(model), f"id {id_type}, held_out boolean, lang_pred string, score double, sure boolean"
    )
    return found.withColumnRenamed("id", id_col)
