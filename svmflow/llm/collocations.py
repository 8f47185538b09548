"""Phrase collocations from count transducers that are built per shard and united by prefix range."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svmflow.llm.common import save
from svmflow.llm.count_transducer import DEPTH, Transducer, decode, merged, new_states, sorted_names, union
from svmflow.llm.shingling import slices, text_blocks

#: Words counted in one transducer of a task, and words of the corpus in one prefix range.
RUN_WORDS, RANGE_WORDS = 500_000, 1_000_000
#: Bytes of text that a word takes, about: only the number of ranges depends on it.
WORD_BYTES = 6
#: Share of the documents, and step between their windows, from which range bounds are drawn. Bounds only balance work.
SAMPLE_DOCS, SAMPLE_STEP = 1 / 32, 32
#: Frequent phrases in one range of the look-ups.
LOOKUP_ROWS = 200_000

Bound = tuple[bytes, ...]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes of all words, their lengths, text of each, whether the next is in the same piece)."""
    n = len(data)
    gap = _GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = ~gap, ~gap
    start[1:] &= gap[:-1] | edge[1:n]
    end[:-1] &= gap[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_BREAK[data], dtype=np.int64)[starts]
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    return _LOWER[data[~gap]], ends - starts, text, joined


def _windows(langs: list[str], blocks: list[tuple]) -> Transducer:
    """The transducer of the windows of all words: each word with those behind it in its piece, DEPTH in all."""
    data = np.concatenate([b[0] for b in blocks])
    ends = np.concatenate([[0], np.cumsum(np.concatenate([b[1] for b in blocks]))]).astype(np.int64)
    joined = np.concatenate([b[3] for b in blocks])
    raw = pa.Array.from_buffers(pa.large_binary(), len(joined), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    words, at = sorted_names(raw)
    names, lang_at = sorted_names(pa.array([name.encode() for name in langs], pa.large_binary()))
    columns = [lang_at[np.concatenate([b[2] for b in blocks])], at + 1]
    go_on = joined
    for k in range(1, DEPTH):
        following = np.zeros(len(at), np.int64)
        following[: len(at) - k] = np.where(go_on[: len(at) - k], at[k:] + 1, 0)
        columns.append(following)
        go_on = go_on & np.append(joined[k:], np.zeros(min(k, len(at)), bool))[: len(at)]
    return merged(names, words, columns, np.ones(len(at), np.int64))


def _runs(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Transducer]:
    """Transducers of about ``words`` words each; a longer text is taken whole."""
    known: dict[str, int] = {}
    blocks: list[tuple] = []
    held = 0
    for batch in slices(batches):
        lang = np.array([known.setdefault(name, len(known)) for name in pc.fill_null(batch["lang"], "und").to_pylist()])
        for first, data, offsets in text_blocks(batch["text"]):
            if len(data) == 0:
                continue
            letters, lengths, text, joined = _words(data, offsets)
            blocks.append((letters, lengths, lang[text + first], joined))
            held += len(lengths)
            if held >= words:
                yield _windows(list(known), blocks)
                blocks, held = [], 0
    if held:
        yield _windows(list(known), blocks)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, RUN_WORDS // 8):
        at = np.arange(0, len(run), SAMPLE_STEP)
        symbols = [run.langs, [b"", *run.words]]
        yield pa.record_batch(
            {f"s{k}": pa.array([symbols[min(k, 1)][i] for i in c[at].tolist()], pa.binary()) for k, c in enumerate(run.columns)}
        )


def _least_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = min((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), default=None)
    if least is not None:
        yield pa.record_batch({f"s{k}": pa.array([v], pa.binary()) for k, v in enumerate(least)})


_SYMBOLS = [f"s{k}" for k in range(DEPTH + 1)]
_SYMBOL_ROW = ", ".join(f"{s} binary" for s in _SYMBOLS)


def _bounds(sample: DataFrame, ranges: int) -> list[Bound]:
    """Least sequences of ranges 1.. of about equal size: at most one row per range reaches the driver."""
    if ranges < 2:
        return []
    least = sample.repartitionByRange(ranges, *_SYMBOLS).mapInArrow(_least_row, _SYMBOL_ROW).collect()
    return sorted({tuple(bytes(v) for v in row) for row in least})[1:]


def _shard_parts(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _runs(batches, RUN_WORDS):
            cuts = [0, *(shard.position(b) for b in bounds.value), len(shard)]
            parts = [(r, low, high) for r, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)) if low < high]
            yield pa.record_batch(
                {
                    "range": pa.array([r for r, _, _ in parts], pa.int32()),
                    "body": pa.array([shard.part(low, high).encode() for _, low, high in parts], pa.binary()),
                }
            )

    return run


def _united(bounds, least: int):
    """Group function: the counts of all prefixes in a range; those that reach into other ranges are marked as cut."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        whole = union([decode(body) for body in table["body"].to_pylist()])
        r = key[0].as_py()
        ends = bounds.value[max(0, r - 1) : r + 1] if r else bounds.value[:1]
        names = [b"", *whole.words]
        out: dict[str, list] = {"lang": [], "phrase": [], "words": [], "f": [], "cut": []}

        def tell(lang: int, symbols: list[int], f: int, cut: bool) -> None:
            for name, value in zip(
                out, (whole.langs[lang], b" ".join(names[s] for s in symbols), len(symbols), f, cut), strict=True
            ):
                out[name].append(value)

        for level, first in enumerate(whole.new_states()):
            total = np.add.reduceat(whole.weights, first)
            # A sequence that ends before this level is no phrase of its length.
            phrase = whole.columns[level][first] > 0 if level else np.ones(len(first), bool)
            cut = np.zeros(len(first), bool)
            if 0 < level < DEPTH:
                for bound in ends:
                    low = int(np.searchsorted(first, whole.position([*bound[: level + 1], *[b""] * (DEPTH - level)])))
                    cut[low : low + 1] = True  # the state of the bound's prefix, or one marked in vain
            chosen = np.flatnonzero(phrase & (cut | (total >= least))) if level else np.arange(len(first))
            for i in chosen.tolist():
                at = first[i]
                tell(whole.columns[0][at], [whole.columns[k][at] for k in range(1, level + 1)], int(total[i]), bool(cut[i]))
        kinds = {"lang": pa.binary(), "phrase": pa.binary(), "words": pa.int32(), "f": pa.int64(), "cut": pa.bool_()}
        return pa.table({name: pa.array(out[name], kind) for name, kind in kinds.items()})

    return run


def _ranged(bounds, backwards: bool):
    """Frequent phrases with the lookup range of each; a prefix also goes to all ranges that its extensions reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, rows, own = [], [], []
            sequences = []
            for i, (lang, phrase) in enumerate(zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True)):
                words = phrase.split(b" ")
                words = words[::-1] if backwards else words
                at = (lang, *words, *[b""] * (DEPTH - len(words)))
                behind = (lang, *words[:-1], words[-1] + b"\0")
                low = bisect_right(bounds.value, at)
                high = max(low, bisect_left(bounds.value, behind)) if len(words) < DEPTH else low
                for r in range(low, high + 1):
                    ranges.append(r)
                    rows.append(i)
                    own.append(r == low)
                    sequences.append(at)
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = {s: pa.array([q[k] for q in sequences], pa.binary()) for k, s in enumerate(_SYMBOLS)}
            yield pa.record_batch(
                {"range": pa.array(ranges, pa.int32()), "own": pa.array(own, pa.bool_()), "phrase": taken["phrase"], "f": taken["f"], **columns}
            )

    return run


def _composed(table: pa.Table) -> pa.Table:
    """Run every phrase of a range through the transducer of the range, reading the weights of its prefixes on the way.

    In order, a prefix stands before its extensions, so the weight of the
    state that a phrase passes is the weight of the first row of that state.
    """
    langs, lang_at = sorted_names(table["s0"].combine_chunks())
    names = pa.chunked_array([table[s].combine_chunks() for s in _SYMBOLS[1:]]).combine_chunks()
    words, word_at = sorted_names(names)
    columns = [lang_at, *np.split(word_at, DEPTH)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    f = table["f"].to_numpy()[order]
    states = new_states(columns)
    size = [np.diff(np.append(s, len(f))) for s in states]
    one, two = (np.repeat(f[states[level]], size[level]) for level in (1, 2))
    # The most frequent phrase of DEPTH words behind each pair of words.
    longer = f.copy()
    ends = [c == (0 if words and words[0] == b"" else -1) for c in columns]
    longer[ends[DEPTH]] = 0
    most = np.repeat(np.maximum.reduceat(longer, states[2]), size[2]) if len(f) else longer
    length = DEPTH - sum(e.astype(int) for e in ends[1:])
    own = table["own"].to_numpy(zero_copy_only=False)[order]
    rows = table.take(pa.array(order))
    pick = lambda values, where: pa.array(values, pa.int64(), mask=~(own & where))
    return pa.table(
        {
            "lang": rows["s0"],
            "phrase": rows["phrase"],
            "a": pick(f, length > 0),
            "one": pick(one, length > 1),
            "two": pick(two, length > 2),
            "longer": pa.array(np.where(length == 2, most, 0), pa.int64()),
        }
    )


def _lookups(frequent: DataFrame, rows: int, backwards: bool) -> DataFrame:
    """(lang, phrase, a, one, two, longer): count of each phrase, of its first one and two words, and of its best extension.

    Backwards, words are read from the last to the first.
    """
    spark = frequent.sparkSession
    ranges = -(-rows // LOOKUP_ROWS)
    nothing = spark.sparkContext.broadcast([])
    schema = f"range int, own boolean, phrase binary, f long, {_SYMBOL_ROW}"
    sample = frequent.sample(min(1.0, 100 * ranges / rows + 0.01), 7).mapInArrow(_ranged(nothing, backwards), schema) if ranges > 1 else None
    bounds = spark.sparkContext.broadcast(_bounds(sample.select(*_SYMBOLS), ranges) if ranges > 1 else [])
    placed = frequent.mapInArrow(_ranged(bounds, backwards), schema)
    return placed.groupBy("range").applyInArrow(_composed, "lang binary, phrase binary, a long, one long, two long, longer long")


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(frequent phrases: lang, phrase, words, f; totals: lang, n).

    Phrases of up to three words that occur at least ``least`` times, with
    their exact counts, and all word occurrences per language.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = -(-size // (WORD_BYTES * RANGE_WORDS))
    sample = source.sample(SAMPLE_DOCS, 7).mapInArrow(_sample, _SYMBOL_ROW)
    bounds = spark.sparkContext.broadcast(_bounds(sample, ranges))
    parts = source.where("text is not null").mapInArrow(_shard_parts(bounds), "range int, body binary")
    counted = save(
        parts.groupBy("range").applyInArrow(
            _united(bounds, least), "lang binary, phrase binary, words int, f long, cut boolean"
        ),
        "phrase-counts",
    )
    phrases = counted.where("words > 0")
    cut = phrases.where("cut").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    frequent = phrases.where("not cut").drop("cut").unionByName(cut)
    totals = counted.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return save(frequent, "phrase-frequent"), totals


def phrase_collocations(
    docs: DataFrame, least: int = 10, top: int = 2000, covered: int = 50, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The best ``top`` phrases of two and three words per language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line
    breaks, and pieces into words at blanks and tabs. A phrase that occurs
    ``a >= least`` times is a candidate; its score is the least of
    floor(1000000 a a / (l r)) over its cuts into parts that occur l and r
    times (ties to the earlier cut). A candidate of which a longer candidate
    takes ``covered`` per cent of the occurrences is left out. Order: score and a
    descending, then the phrase by its UTF-8 bytes.

    A null text has no words, a null language is ``und``, repeated rows count
    each time, texts of any length are taken whole, further columns are
    ignored, and an empty table gives no rows.

    Tasks build count transducers of windows of three words, cut at common
    bounds; a range's parts are united in one task, where infrequent phrases
    end. Bounds may lie inside the windows of one word or word pair, so a
    frequent one is dealt over tasks; counts of prefixes across bounds are
    added up afterwards. Part counts are read off the paths of the phrases in
    transducers of the frequent phrases, forwards and backwards.
    """
    frequent, totals = phrase_counts(docs, least, text_col, lang_col)
    rows = frequent.count()
    looked = [_lookups(frequent, max(1, rows), backwards) for backwards in (False, True)]
    named = [
        df.select(
            "lang", "phrase", "a", "longer", *(F.col(c).alias(f"{side}_{c}") if side == kept else F.lit(None).cast("long").alias(f"{kept}_{c}")
            for kept in ("left", "right") for c in ("one", "two"))
        )
        for side, df in zip(("left", "right"), looked, strict=True)
    ]
    parts = named[0].unionByName(named[1])
    values = ("a", "longer", "left_one", "left_two", "right_one", "right_two")
    joined = parts.groupBy("lang", "phrase").agg(*(F.max(c).alias(c) for c in values)).where("left_one is not null")
    pair = F.col("left_two").isNull()
    # Cuts in order: behind the first word, behind the second.
    cuts = F.array(
        F.struct(F.col("left_one").alias("l"), F.when(pair, F.col("right_one")).otherwise(F.col("right_two")).alias("r")),
        F.struct(F.coalesce("left_two", "left_one").alias("l"), F.col("right_one").alias("r")),
    )
    exact = "cast(1000000 as decimal(7,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))"
    score = lambda k: F.expr(
        f"({exact}) div (cast(cuts[{k}].l as decimal(19,0)) * cast(cuts[{k}].r as decimal(19,0)))"
    )
    kept = joined.where(F.lit(100) * F.col("longer") < F.lit(covered) * F.col("a"))
    scored = kept.withColumn("cuts", cuts).withColumn("first", score(0)).withColumn("second", score(1))
    chosen = F.when(F.col("first") <= F.col("second"), F.col("cuts")[0]).otherwise(F.col("cuts")[1])
    best = scored.withColumn("chosen", chosen).withColumn("score", F.least("first", "second"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        F.col("lang").cast("string").alias("lang"), "rank", F.col("phrase").cast("string").alias("phrase"), "a",
        F.col("chosen.l").alias("l"), F.col("chosen.r").alias("r"), "n", "score",
    )
