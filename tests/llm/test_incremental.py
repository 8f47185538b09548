"""Phrase collocations, reversible line deduplication and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from svmflow.llm import collocations, line_index
from svmflow.llm.collocations import phrase_collocations
from svmflow.llm.count_transducer import DEPTH, decode, merged, union
from svmflow.llm.cuckoo import SLOTS, CuckooFilter
from svmflow.llm.line_index import LineIndex, dedup_lines
from svmflow.llm.sphere_kmeans import Step, cluster_vectors, loosening, squared_distances

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def best_phrases(docs, least, top=2000, covered=50):
    counts, totals = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        rows, longer = [], Counter()
        for phrase, a in f.items():
            for pair in (phrase[:2], phrase[1:]) if len(phrase) == 3 and a >= least else ():
                longer[pair] = max(longer[pair], a)
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            if longer[phrase] and 100 * longer[phrase] >= covered * a:
                continue
            rows.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrases(df):
    return sorted(tuple(r) for r in df.collect())


EDGES = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n.", None), (4, "a b c. A  b\tC, a b c", "en"), (4, "a b c. A  b\tC, a b c", "en"),
    (5, "x y; x y! x y? x y: x y", None), (6, "é ü é ü é\vé ü", ""), (7, "one", "de"), (8, "w " * 30_000, "xx\\\nyy"), (None, "a b", "en"),
]


def test_phrases_equal_brute_force(spark):
    df = spark.createDataFrame(EDGES, DOCS).withColumn("range", F.lit(1)).withColumn("phrase", F.lit("clash"))
    for least in (1, 2):
        assert phrases(phrase_collocations(df, least)) == best_phrases(EDGES, least)
    assert phrases(phrase_collocations(df, 1, top=2, covered=90)) == best_phrases(EDGES, 1, 2, 90)
    assert phrase_collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [2, 10])
def test_phrases_over_many_ranges_and_runs(spark, monkeypatch, least):
    """Ranges far smaller than what one word takes, so that words and pairs are cut by bounds."""
    for name, value in {"RUN_WORDS": 3_000, "RANGE_WORDS": 4_000, "LOOKUP_ROWS": 300, "SAMPLE_DOCS": 0.9, "SAMPLE_STEP": 3}.items():
        monkeypatch.setattr(collocations, name, value)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    df = df.union(spark.range(300).select("id", F.concat(F.lit("the hot pair "), F.col("id") % 7, F.lit(" ends")), F.lit("en")))
    rows = [tuple(r) for r in df.collect()]
    assert phrases(phrase_collocations(df.repartition(5), least)) == best_phrases(rows, least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 4), st.integers(0, 4), st.integers(0, 4)), max_size=40), st.integers(0, 40))
def test_transducers_round_trip_and_unite(rows, cut):
    rows = [(lang, a, b, c if b else 0) for lang, a, b, c in rows]
    langs, words = [b"", b"d\ne", b"x\\n"], [b"a", b"b\\", b"c", b"\xc3\xa9"]
    columns = [np.array([r[k] for r in rows], np.int64) for k in range(DEPTH + 1)]
    whole = merged(langs, words, columns, np.ones(len(rows), np.int64))
    cut = min(cut, len(whole))
    parts = [decode(part.encode()) for part in (whole.part(0, cut), whole.part(cut, len(whole)), whole) if len(part)]
    named = lambda t: {
        (t.langs[r[0]], *(t.words[i - 1] if i else b"" for i in r[1:])): int(n)
        for *r, n in zip(*(c.tolist() for c in t.columns), t.weights.tolist(), strict=True)
    }
    if parts:
        assert named(union(parts)) == {k: 2 * n for k, n in named(whole).items()}
    every = sorted(named(whole))
    for i, row in enumerate(every):
        assert whole.position(row) == i
    assert whole.position((b"zz", b"", b"", b"")) == len(every)


@pytest.mark.parametrize("n", [1, 60, 5_000])
def test_cuckoo_filters_hold_what_they_were_given(n):
    draw = np.random.default_rng(n)
    hashes = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    held = CuckooFilter()
    for part in np.array_split(hashes, 3):
        held.insert(part)
        held.insert(part[:1])  # held twice
        held = CuckooFilter.from_bytes(held.to_bytes())
    assert held.contains(hashes).all()
    others = draw.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert held.contains(others).mean() < 0.01
    held.delete(hashes[::2])
    assert held.contains(hashes[1::2]).all()
    assert held.contains(hashes[::2]).mean() <= 0.01 + 3 / len(hashes[::2])  # three were held twice
    crowd = CuckooFilter()
    crowd.insert(np.full(5 * SLOTS, 12_345, np.uint64))  # more than two buckets hold
    assert len(crowd) == 5 * SLOTS
    crowd.delete(np.full(5 * SLOTS, 12_345, np.uint64))
    assert len(crowd) == 0 and not crowd.contains(np.array([12_345], np.uint64)).any()


def kept_lines(docs):
    """{id: (n_lines, n_dropped, text)} for rows of (id, text)."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    first, holders = {}, {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(doc)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [line for line in lines if doc is None or first.get(key(line), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found_lines(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


LINES = [
    (5, "A repeated line\nown line of five\n  a REPEATED line\t"), (2, "a repeated line\r\nshort\n\nshort"), (9, "short\n" * 50 + "a repeated line"),
    (1, None), (3, ""), (4, "\n\n"), (7, "ten chars!\nÉcole normale\nécole normale"), (8, "TEN CHARS!\nÉcole Normale \x0b"), (None, "a repeated line\nten chars!"),
    (6, "x" * 300_000 + "\n" + "y" * 10), (10, "y" * 10 + "\n" + "X" * 300_000 + "\n"), (9, "ten chars!"),
]


def test_lines_stay_where_they_come_first(spark):
    df = spark.createDataFrame(LINES, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n_lines", F.lit(3))
    for batches in (1, 3):
        assert found_lines(dedup_lines(df, batches=batches)) == kept_lines(LINES)
    assert dedup_lines(df.limit(0)).count() == 0


def test_deletions_are_reversible(spark, monkeypatch):
    monkeypatch.setattr(line_index, "SHARD_KEYS", 16)
    draw = np.random.default_rng(3)
    stock = [f"shared line number {i}" for i in range(60)]
    docs = [(i, "\n".join(draw.choice(stock, 6).tolist() + [f"line of document {i} only"])) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index, held = LineIndex(spark), {}

    def check():
        rows = sorted(held.items())
        assert found_lines(index.dedup(frame(rows))) == kept_lines(rows)
        keys = {r["key"]: r["n_docs"] for r in index.counts().collect()}
        lines = Counter(k for _, text in rows for k in set(text.split("\n")))
        assert keys == {hashlib.sha256(k.encode()).digest(): n for k, n in lines.items()}
        filters = {r["shard"]: CuckooFilter.from_bytes(r["body"]) for r in index._filters().collect()}
        assert sum(len(f) for f in filters.values()) == len(keys), "every key is held once, and no other"

    index.delete(frame([(1, "")]))
    for part in (docs[:10], docs[10:50]):
        index.insert(frame(part))
        held |= dict(part)
        check()
    assert index.bits > 0
    index.delete(frame([(i, "") for i in (0, 1, 2, 17, 99, 1)]))
    held = {k: v for k, v in held.items() if k not in (0, 1, 2, 17)}
    check()
    index.replace(frame([(1, docs[1][1]), (5, "shared line number 7\nanother text"), (55, docs[55][1])]))
    held |= {1: docs[1][1], 5: "shared line number 7\nanother text", 55: docs[55][1]}
    check()


def clustered(rows, k=40, rounds=5):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, np.clip(np.floor(np.array(v, float) * 256), -(1 << 27), 1 << 27).astype(np.int64)) for i, v in kept]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1].astype("<i4").tobytes()))
    centroids = np.array([v for _, v in start[:k]])
    vectors = np.array([v for _, v in kept])
    for n in range(rounds + 1):
        squares = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        nearest = squares.argmin(axis=1)
        for j in range(len(centroids) if n < rounds else 0):
            mine = vectors[nearest == j]
            if len(mine):
                centroids[j] = [sum(int(x) for x in column) // len(mine) for column in mine.T]
    inertia = Counter()
    for j, d in zip(nearest.tolist(), squares.min(axis=1).tolist(), strict=True):
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    top = (1 << 63) - 1
    rows = [(kept[r][0], j, int(squares[r, j]), min(inertia[j], top), min(sum(inertia.values()), top), digest[j]) for r, j in enumerate(nearest.tolist())]
    return sorted(rows, key=repr)


VECTORS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("k, scale", [(40, 1.0), (7, 1.0), (5, 90_000.0), (3, 1e300)])
def test_clusters_equal_brute_force(spark, k, scale):
    """Small integers tie often; large ones leave double precision; huge ones are bounded."""
    draw = np.random.default_rng(k)
    rows = [(i, (draw.integers(-1, 2, 64) / 256 * scale).tolist()) for i in range(300)]
    rows += [(i, (draw.normal(size=64) * scale).tolist()) for i in range(300, 500)]
    rows += [rows[3], rows[4], (None, rows[5][1]), (600, None), (601, [1.0] * 63), (602, [1.0] * 65), (603, [None] + [1.0] * 63), (604, [float("nan")] * 64)]
    rows += [(605, [float("inf")] + [0.0] * 63), (606, [])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("clash")).withColumn("uid", F.lit(1))
    got = sorted((tuple(r) for r in cluster_vectors(df, k).collect()), key=repr)
    assert got == clustered(rows, k)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    got = sorted((tuple(r) for r in cluster_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)
    assert got == clustered(rows)
    nothing = cluster_vectors(spark.createDataFrame(rows, VECTORS).limit(0))
    assert nothing.count() == 0
    assert nothing.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_loosening_holds_and_is_less_than_the_drift():
    draw = np.random.default_rng(1)
    tighter = 0
    for _ in range(300):
        old = draw.normal(size=(5, 8)) * 10
        new = old + draw.normal(size=(5, 8)) * draw.choice([0.0, 0.1, 1.0, 5.0], size=(5, 1))
        radius = draw.uniform(0, 12, 5)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        allowed = loosening(old, new, radius)
        for i in range(5):
            ways = draw.normal(size=(400, 8))
            points = old[i] + ways / np.sqrt((ways**2).sum(axis=1))[:, None] * draw.uniform(0, 1, (400, 1)) ** 0.1 * radius[i]
            before = np.sqrt(((points[:, None] - old[None]) ** 2).sum(axis=2))
            after = np.sqrt(((points[:, None] - new[None]) ** 2).sum(axis=2))
            others = np.arange(5) != i
            assert ((before - after)[:, others] <= allowed[i] + 1e-9).all()
            assert allowed[i] <= drift[others].max() + 1e-6
            tighter += allowed[i] < 0.9 * drift[others].max()
    assert tighter > 300


def test_bounds_spare_most_scans():
    draw = np.random.default_rng(2)
    centres = draw.integers(-400, 400, (8, 64))
    vectors = np.repeat(centres, 50, axis=0) + draw.integers(-20, 20, (400, 64))
    cluster, upper, lower, scanned = Step(centres).assign(vectors, None, None, None)
    assert scanned == 400
    moved = centres + draw.integers(-3, 4, centres.shape)
    drift = np.sqrt(((moved - centres) ** 2).sum(axis=1).astype(float))
    radius = np.array([upper[cluster == j].max() for j in range(8)])
    again, _, _, scanned = Step(moved, drift, loosening(centres.astype(float), moved.astype(float), radius)).assign(
        vectors, cluster.copy(), upper, lower
    )
    assert scanned == 0
    assert (again == squared_distances(vectors, moved).argmin(axis=1)).all()
