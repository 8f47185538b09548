"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svmflow.llm.common import fresh
from svmflow.llm.shingling import mix, plain_words, slices

#: Least words of an item that may be matched with edits.
LEAST_WORDS = 8
#: One word edit in so many words still counts as the item.
WORDS_PER_EDIT = 5
#: Items from this many words on are found by walks of LONG; shorter ones by windows that their edits cannot all touch.
LONG_WORDS = 32
#: Words of the run, from its start, by which an item that occurs as it is is looked up; all of a shorter item.
RUN_WORDS = 16
#: Items that one pass over the documents looks for.
BLOCK_ITEMS = 5_000
_FILTER_BITS = 23
_RUN_FILTER_BITS = 20


@dataclass(frozen=True)
class Windows:
    """How the windows of a class of items are embedded: by walks of ``steps`` over at most ``words`` words."""

    words: int
    steps: int
    #: Walk steps that each signature samples.
    samples: np.ndarray
    #: Words that an indexed start must still have ahead.
    ahead: int
    #: Distance between the starts of the windows of a document; items are indexed at every start.
    stride: int
    #: Different words in which the walks of two windows must agree to be verified, if they differ at all.
    agreeing: int

    @classmethod
    def of(cls, words: int, steps: int, signatures: int, sampled: int, seed: int, **more: int) -> Windows:
        # One step from each part of the walk, as it may rest on a common word for some steps.
        part = steps // sampled
        samples = np.random.default_rng(seed).integers(0, part, (signatures, sampled)) + np.arange(sampled) * part
        return cls(words, steps, samples, **more)

    def walk(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """CGK embedding of the window at each start: the word under a walk that advances by a random bit of the word.

        Two windows a few edits apart fall back into step, so that their walks
        agree in most places: edit distance becomes Hamming distance. Behind
        the window a walk sees zeros.
        """
        padded = np.concatenate([words, np.zeros(self.steps, np.uint64)])
        at = starts.astype(np.int64)
        seen = np.empty((self.steps, len(starts)), np.uint64)
        for step in range(self.steps):
            seen[step] = padded[at]
            if step >= self.words:
                seen[step][at - starts >= self.words] = 0
            at = at + ((seen[step] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        return seen

    def signatures(self, seen: np.ndarray) -> Iterator[np.ndarray]:
        """The bit-sampling hashes of embedded windows, one array for each repetition."""
        factors = mix(np.arange(1, self.samples.size + 1, dtype=np.uint64)).reshape(self.samples.shape)
        with np.errstate(over="ignore"):
            for nth, (steps, by) in enumerate(zip(self.samples, factors, strict=True)):
                yield mix((seen[steps] * by[:, None]).sum(axis=0, dtype=np.uint64), nth + 1)


#: Walks that cover about 12 words.
LONG = Windows.of(24, 24, 8, 4, seed=2_016, ahead=LEAST_WORDS, stride=2, agreeing=5)
#: Windows of a few words, looked up at every start: those of equal runs always meet.
SHORT = {n: Windows.of(n, 2 * n, 2, n, seed=n, ahead=n, stride=1, agreeing=n - 1) for n in (3, 4)}


def edits_allowed(n: int) -> int:
    """Word edits up to which ``n`` words count as found; short items must be found as they are."""
    return n // WORDS_PER_EDIT if n >= LEAST_WORDS else 0


def intact_run(n: int) -> int:
    """Words that some run of an item of ``n`` words keeps under all allowed edits."""
    edits = edits_allowed(n)
    return -(-(n - edits) // (edits + 1))


def edit_distance(item: np.ndarray, region: np.ndarray) -> int:
    """Least word edits between ``item`` and any run of words of ``region``."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


@dataclass
class WindowIndex:
    """The windows of a class of items: their walks, and the sorted signatures of these."""

    windows: Windows
    key: np.ndarray
    window: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    walks: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, windows: Windows, items: list[int], words: list[np.ndarray]) -> WindowIndex:
        starts = [np.arange(len(words[i]) - windows.ahead + 1) for i in items]
        walks = np.concatenate([windows.walk(words[i], at) for i, at in zip(items, starts, strict=True)], axis=1)
        key = np.concatenate(list(windows.signatures(walks)))
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[key >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(
            windows, key[order], order % walks.shape[1], np.repeat(items, [len(at) for at in starts]),
            np.concatenate(starts), walks, seen,
        )

    def places(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Rows (text, item, start of a window in ``words`` less the window's place in the item) of windows that meet."""
        out = [np.zeros((3, 0), np.int64)]
        starts = np.arange(0, len(words), self.windows.stride)
        walked = self.windows.walk(words, starts)
        for signature in self.windows.signatures(walked):
            hit = np.flatnonzero(self.seen[signature >> np.uint64(64 - _FILTER_BITS)])
            left = np.searchsorted(self.key, signature[hit], "left")
            count = np.searchsorted(self.key, signature[hit], "right") - left
            hit, left, count = hit[count > 0], left[count > 0], count[count > 0]
            entry = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
            window, hit = self.window[entry], np.repeat(hit, count)
            mine = self.walks[:, window]
            agree = mine == walked[:, hit]
            equal = agree.all(axis=0)
            agree &= mine != 0
            agree[1:] &= mine[1:] != mine[:-1]
            close = equal | (agree.sum(axis=0) >= self.windows.agreeing)
            window, start = window[close], starts[hit[close]]
            text = np.searchsorted(before, start, "right") - 1
            out.append(np.stack([text, self.item[window], start - self.offset[window]]))
        return np.unique(np.concatenate(out, axis=1), axis=1)


@dataclass
class ItemIndex:
    """Items of one block: words, windows by class, and by number of words the runs that items start with."""

    ids: list[int]
    words: list[np.ndarray]
    classes: list[WindowIndex]
    runs: dict[int, tuple[np.ndarray, np.ndarray]]
    starts_run: np.ndarray
    #: Words and allowed edits of the items under LONG_WORDS, by item position.
    padded: np.ndarray
    allowed: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None]) -> ItemIndex:
        words = list(plain_words(pa.array(texts, pa.string())))
        classes: dict[int, list[int]] = {}
        runs: dict[int, tuple[list, list]] = {}
        padded = np.zeros((len(words), LONG_WORDS), np.uint64)
        for i, w in enumerate(words):
            if not len(w):
                continue
            n = min(len(w), RUN_WORDS)
            keys, owners = runs.setdefault(n, ([], []))
            keys.append(_run_keys(w[:n], n)[0])
            owners.append(i)
            if len(w) >= LEAST_WORDS:
                classes.setdefault(0 if len(w) >= LONG_WORDS else intact_run(len(w)), []).append(i)
            if len(w) < LONG_WORDS:
                padded[i, : len(w)] = w
        starts_run = np.zeros(1 << _RUN_FILTER_BITS, bool)
        for keys, _ in runs.values():
            starts_run[np.array(keys, np.uint64) >> np.uint64(64 - _RUN_FILTER_BITS)] = True
        return cls(
            ids, words, [WindowIndex.of(SHORT.get(c, LONG), items, words) for c, items in sorted(classes.items())],
            {n: (np.array(k, np.uint64), np.array(o)) for n, (k, o) in runs.items()}, starts_run,
            padded, np.array([edits_allowed(len(w)) for w in words], np.int64),
        )

    def found(self, words: np.ndarray) -> dict[int, int]:
        """Edits of every item that the words of one text, or texts behind each other, hold; by item position."""
        return {i: e for (_, i), e in self.found_in(words, np.array([0, len(words)])).items()}

    def found_in(self, words: np.ndarray, before: np.ndarray) -> dict[tuple[int, int], int]:
        """(text, item position) -> edits, for texts whose words start at ``before``."""
        out: dict[tuple[int, int], int] = {}
        for n, (keys, owners) in self.runs.items():
            runs = _run_keys(words, n)
            at = np.flatnonzero(self.starts_run[runs >> np.uint64(64 - _RUN_FILTER_BITS)])
            for at in at[np.isin(runs[at], keys)].tolist():
                text = int(np.searchsorted(before, at, "right")) - 1
                for i in owners[keys == runs[at]].tolist():
                    to = at + len(self.words[i])
                    if to <= before[text + 1] and np.array_equal(words[at:to], self.words[i]):
                        out[text, i] = 0
        for index in self.classes:
            places = index.places(words, before)
            if index.windows is not LONG:
                places = places[:, self._plausible(words, places[1], places[2])]
            for text, item, base in places.T.tolist():
                self._verify(out, words, before, text, item, base)
        return out

    def _plausible(self, words: np.ndarray, item: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Whether enough words of each short item are near their places, counted from ``base``."""
        out = np.zeros(len(item), bool)
        for lo in range(0, len(item), 1 << 14):
            mine = self.padded[item[lo : lo + (1 << 14)]]
            allowed = self.allowed[item[lo : lo + (1 << 14)]]
            at = base[lo : lo + (1 << 14), None] + np.arange(LONG_WORDS)
            near = np.zeros(mine.shape, bool)
            for shift in range(-int(allowed.max()), int(allowed.max()) + 1):
                place = at + shift
                inside = (place >= 0) & (place < len(words))
                near |= inside & (words[np.where(inside, place, 0)] == mine)
            out[lo : lo + (1 << 14)] = (near | (mine == 0)).sum(axis=1) >= LONG_WORDS - allowed
        return out

    def _verify(self, out: dict, words: np.ndarray, before: np.ndarray, text: int, item: int, base: int) -> None:
        if out.get((text, item)) == 0:
            return
        mine = self.words[item]
        allowed = edits_allowed(len(mine))
        lo, hi = max(before[text], base - allowed), min(before[text + 1], base + len(mine) + allowed)
        region = words[lo:hi]
        if base >= lo and np.array_equal(words[base : min(hi, base + len(mine))], mine):
            edits = 0
        elif len(region) < len(mine) - allowed or np.isin(mine, region).sum() < len(mine) - allowed:
            return
        else:
            edits = edit_distance(mine, region)
        if edits <= allowed:
            out[text, item] = min(edits, out.get((text, item), edits))


def _run_keys(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words."""
    factors = mix(np.arange(1, n + 1, dtype=np.uint64), 99)
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n if len(out) else 0):
            out += words[k : len(words) - n + 1 + k] * factors[k]
    return mix(out)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[ItemIndex]:
    """The items in blocks of bounded size; items without id or words are left out."""
    block: list = []
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for row in rows.where("id is not null and text is not null").orderBy("id", "text").toLocalIterator():
        block.append(row)
        if len(block) == BLOCK_ITEMS:
            yield ItemIndex.of([r["id"] for r in block], [r["text"] for r in block])
            block = []
    if block:
        yield ItemIndex.of([r["id"] for r in block], [r["text"] for r in block])


def _search(index, text: str, found: str):
    """Add to the list column ``found`` the items of one block that each text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in slices(batches):
            hits: dict[int, list] = {}
            at = 0
            for words, before in plain_words(batch[text], whole=True):
                for (row, item), edits in items.found_in(words, before).items():
                    hits.setdefault(at + row, []).append({"item_id": items.ids[item], "edits": edits})
                at += len(before) - 1
            column = batch[found].to_pylist()
            column = [old + hits.get(i, []) for i, old in enumerate(column)]
            yield batch.set_column(
                batch.schema.get_field_index(found), batch.schema.field(found), pa.array(column, batch.schema.field(found).type)
            )

    return run


def find_items(
    docs: DataFrame, benchmark: DataFrame, found: str, item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with a column ``found``: array of (item_id, edits) of the benchmark items that the text holds.

    Words are compared with A-Z lower-cased and ASCII punctuation behind them
    ignored. An item counts as found if some run of words of the text is at
    most one edit in five words away (items under eight words: none). Items
    that occur as they are are looked up by their first words at every word of
    the text. For edited ones, windows are embedded by a CGK walk; several bit
    samples of the embedding are looked up among those of the item's own
    windows, and what matches is verified by the exact edit distance. Windows
    of long items are walked for 24 steps at every second word; those of items
    under 32 words are so short that the allowed edits cannot touch all of
    them, and are looked up at every word. Items are searched in blocks of
    bounded size, each in a narrow pass over all documents.

    A null or empty text holds nothing, a null, empty or id-less item is never
    found, equal items are found separately, and empty tables give empty results.
    """
    spark = docs.sparkSession
    empty = F.array().cast("array<struct<item_id:long,edits:int>>")
    out = docs.withColumn(found, empty)
    for index in _indexes(benchmark, item_col, "text"):
        handle = spark.sparkContext.broadcast(index)
        out = out.mapInArrow(_search(handle, text_col, found), out.schema)
    return out


def _distinct_ids(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x["item_id"])))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, contaminated, item_ids, edits) of every document; edits is the least over its items, null without any."""
    found = fresh("found")
    hits = find_items(docs.select(id_col, F.col("text").cast("string")), benchmark, found)
    return hits.select(
        id_col,
        (F.size(found) > 0).alias("contaminated"),
        _distinct_ids(F.col(found)).alias("item_ids"),
        F.array_min(F.transform(found, lambda x: x["edits"])).alias("edits"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    found = fresh("found")
    return find_items(docs, benchmark, found).where(F.size(found) == 0).drop(found)
