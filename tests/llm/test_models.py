"""Trained and sampled operators against plain re-statements of them, over whole small tables."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from svmflow.llm import language_zstd, quality_resampling, toxicity_fm
from svmflow.llm.cgk_decontam import ItemIndex, contamination, edit_distance, edits_allowed
from svmflow.llm.language_zstd import identify_language, learn_dictionaries
from svmflow.llm.quality_resampling import gram_buckets, gumbel, quality_sample
from svmflow.llm.sharding import difference
from svmflow.llm.shingling import plain_terms, plain_words
from svmflow.llm.toxicity_fm import fit_toxicity, toxicity

SF = "/root/testdata/sf0.001"


def tables(spark, *names, sf=SF):
    return [spark.read.parquet(f"{sf}/{name}.parquet") for name in names]


def test_quality_weights_keys_and_k(spark):
    """Each text alone: its grams counted in a dictionary, weights, Gumbel keys, and the k largest."""
    docs, labels = tables(spark, "documents", "labels")
    docs = docs.unionByName(docs.where("doc_id < 6"))  # ties: repeated rows share weight and key
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    grams = lambda text: gram_buckets(np.frombuffer(text.encode(), np.uint8)).tolist()
    counts = {True: {}, False: {}}
    for doc, text in rows:
        for gram in grams(text):
            counts[False][gram] = counts[False].get(gram, 0) + 1
            if doc in good:
                counts[True][gram] = counts[True].get(gram, 0) + 1
    size = {side: sum(c.values()) + quality_resampling.BUCKETS for side, c in counts.items()}
    log_p = lambda side, gram: math.log(1 + counts[side].get(gram, 0)) - math.log(size[side])
    weight = [sum(log_p(True, g) - log_p(False, g) for g in grams(text)) for _, text in rows]
    least = np.percentile([w for (doc, _), w in zip(rows, weight, strict=True) if doc in good], 100 * quality_resampling.LOST_PART)
    k = sum(round(w, 6) >= least for w in weight)
    draw = {r["doc_id"]: r["g"] for r in docs.select("doc_id", gumbel("doc_id", 1).alias("g")).distinct().collect()}
    keys = [round(w, 6) + draw[doc] for (doc, _), w in zip(rows, weight, strict=True)]
    last = sorted(keys, reverse=True)[k - 1]
    got = quality_sample(docs.withColumn("log_weight", F.lit("clash")), labels).collect()
    found = sorted((r["doc_id"], r["log_weight"], r["sample_key"], r["kept"]) for r in got)
    wanted = sorted((doc, w, key, key >= last) for (doc, _), w, key in zip(rows, weight, keys, strict=True))
    assert [f[0] for f in found] == [w[0] for w in wanted]
    assert np.allclose([f[1] for f in found], [w[1] for w in wanted], atol=1e-5)
    assert np.allclose([f[2] for f in found], [w[2] for w in wanted], atol=1e-5)
    assert [f[3] for f in found] == [w[3] for w in wanted]
    assert 0 < sum(f[3] for f in found) < len(rows)


def test_languages_by_one_compression_each(spark):
    (docs,) = tables(spark, "documents")
    known = learn_dictionaries(docs)
    assert sorted(known) == sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    got = {r["doc_id"]: r for r in identify_language(docs.withColumn("score", F.lit("clash"))).collect()}
    for row in docs.collect():
        sizes = []
        for lang, content in known.items():
            packer = zstandard.ZstdCompressor(
                level=language_zstd.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            sizes.append((len(packer.compress(row["text"].lower().encode())), lang))
        if any(c.isalpha() for c in row["text"]):
            best, second, *_ = sorted(sizes)
            found = got[row["doc_id"]]
            assert found["lang_pred"] == best[1]
            odds = sum(2.0 ** (-min(n - best[0], 1000) / language_zstd.BYTES_PER_HALVING) for n, _ in sizes)
            assert found["score"] == pytest.approx(1 / odds)
            assert found["sure"] == (second[0] - best[0] >= language_zstd.SURE_MARGIN * best[0])


def test_languages_that_tie_go_to_the_first_name(spark):
    text = "the same words in both of them and nothing else at all"
    rows = [(i, text, lang) for i in range(60) for lang in ("b", "a")]
    got = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r["lang_pred"], r["score"], r["sure"]) for r in got} == {("a", 0.5, False)}


def test_toxicity_sums_all_pairs(spark):
    """The score of every document by its terms and an explicit sum over all pairs of them."""
    docs, labels = tables(spark, "documents", "labels", sf="/root/testdata/sf0.01")
    machine = fit_toxicity(docs, labels)
    assert len(machine.terms)
    place = {int(t): i for i, t in enumerate(machine.terms)}
    got = {r["doc_id"]: r["score"] for r in toxicity(docs.withColumn("score", F.lit("clash")), labels).collect()}
    for row in docs.select("doc_id", "text").collect():
        (terms,) = plain_terms(pa.array([row["text"]]))
        mine = sorted({place[t] for t in (terms >> np.uint64(64 - toxicity_fm.HASH_BITS)).tolist() if t in place})
        margin = machine.w0 + sum(machine.w[i] for i in mine)
        margin += sum(float(machine.v[i] @ machine.v[j]) for i, j in combinations(mine, 2))
        assert got[row["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))), abs=1e-9)


def differenced(sizes, parts):
    """Largest differencing with plain lists: the final sums."""
    left = [(-size, i, sorted([size] + [0] * (parts - 1), reverse=True)) for i, size in enumerate(sizes)]
    serial = len(left)
    while len(left) > 1:
        left.sort(key=lambda x: x[:2])
        (_, _, a), (_, _, b), *left = left
        sums = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        left.append((sums[-1] - sums[0], serial, sums))
        serial += 1
    return left[0][2]


@pytest.mark.parametrize("parts", [2, 3, 7, 16])
def test_differencing_against_plain_lists(parts):
    draw = np.random.default_rng(parts)
    for n in (1, 2, parts, 40, 150):
        sizes = np.sort(draw.integers(1, 10_000, n))[::-1].astype(np.int64)
        part = difference(sizes, parts)
        assert sorted(np.bincount(part, weights=sizes, minlength=parts).astype(int).tolist(), reverse=True) == differenced(sizes.tolist(), parts)


@pytest.mark.parametrize("n", [32, 36, 40, 50, 64, 80, 120])
def test_recall_of_long_items_by_length(n):
    rng = random.Random(n)
    vocabulary = [f"w{int(rng.expovariate(0.01))}" for _ in range(2_000)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for _ in range(40)]
    index = ItemIndex.of(list(range(len(items))), items)
    tried = found = 0
    for i, item in enumerate(items):
        for edits in (0, 1, 2, edits_allowed(n) // 2, edits_allowed(n)):
            text = item.split()
            for k in range(edits):
                at = rng.randrange(len(text))
                text[at : at + k % 2] = [rng.choice(vocabulary)]
            around = rng.choices(vocabulary, k=30 + edits % 2)
            hits = index.found(next(plain_words(pa.array([" ".join(around + text + around)]))))
            tried += 1
            found += hits.get(i, n) <= edits
    assert found >= 0.97 * tried


def test_leaks_against_all_pairs(spark):
    """Every document against every item by plain edit distance: nothing wrong is found, nearly nothing is missed."""
    rng = random.Random(8)
    (docs,) = tables(spark, "documents")
    natural = [" ".join((r["text"] or "").split()[:150]) for r in docs.orderBy("doc_id").limit(40).collect()]
    items = [" ".join(text.split()[k : k + n]) for text, k, n in zip(natural, range(40), [8, 9, 12, 15, 20, 31, 32, 40, 60, 5] * 4, strict=True)]
    texts = list(natural)
    for item in items:
        copy = item.split()
        for _ in range(rng.randint(0, edits_allowed(len(copy)) + 1)):
            copy[rng.randrange(len(copy))] = rng.choice(natural[0].split())
        texts.append(" ".join(rng.choices(natural[1].split(), k=20) + copy + rng.choices(natural[2].split(), k=20)))
    as_words = [next(plain_words(pa.array([t]))) for t in texts]
    truth = {}
    for j, item in enumerate(items):
        mine = next(plain_words(pa.array([item])))
        for i, text in enumerate(as_words):
            distance = edit_distance(mine, text) if len(mine) else 1
            if len(mine) and distance <= edits_allowed(len(mine)):
                truth.setdefault(i, {})[j] = distance
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination(frame, bench).collect()}
    pairs = {(i, j) for i, r in got.items() for j in r["item_ids"]}
    wanted = {(i, j) for i, held in truth.items() for j in held}
    assert pairs <= wanted
    assert len(pairs) >= 0.97 * len(wanted) and len(wanted) > 60
    for i, row in got.items():
        if {(i, j) for j in truth.get(i, ())} <= pairs and row["contaminated"]:
            assert row["edits"] == min(truth[i].values())
