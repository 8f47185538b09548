"""Similarity joins against brute force, and their edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from svmflow.llm import shingle_rtree, vector_pigeonhole
from svmflow.llm.components import components
from svmflow.llm.shingle_rtree import distinct_documents, jaccard_components, tree_pairs
from svmflow.llm.vector_pigeonhole import near_vectors, rotate

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) >= 5:
        return frozenset(b" ".join(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([b" ".join(words)]) if words else frozenset()


def least_of_components(ids, linked):
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    linked = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, least_of_components(ids, linked)


def corpus(seed, groups, copies, words=60):
    """Groups of texts that differ from each other by a few word edits, and a line that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, words))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text += "all rights reserved by the one who wrote this line".split()
            out.append(" ".join(text))
    return list(enumerate(out))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1}
    assert {got[i] for i in range(100, 130)} == {100}
    assert got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_brute_force(spark, seed):
    rows = corpus(seed, 25, 6)
    sets, want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard_components(docs).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_tree_join_alone_finds_what_stars_miss(spark, monkeypatch):
    # With no star verification at all, every link must come from the tree.
    monkeypatch.setattr(shingle_rtree, "CHUNK_ROWS", 7)
    monkeypatch.setattr(shingle_rtree, "CHUNK_BYTES", 2_000)
    rows = corpus(3, 8, 12)
    real = shingle_rtree._verified
    calls = []

    def first_time_nothing(pairs, reps, docs):
        calls.append(1)
        found = real(pairs, reps, docs)
        return found.limit(0) if len(calls) == 1 else found

    monkeypatch.setattr(shingle_rtree, "_verified", first_time_nothing)
    _, want = brute_components(rows)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_tree_bound_never_loses_a_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(200, 290), replace=False)) for _ in range(80)]
    point = np.stack([shingle_rtree._fold(shingle_rtree.group_counts(s).astype(int), shingle_rtree.GROUPS) for s in sets])
    size = np.array([len(s) for s in sets])
    n = len(sets)
    blocks = list(tree_pairs(size, point, np.arange(n), np.zeros(n, int), np.zeros(n, int)))
    found = [(min(x, y), max(x, y)) for a, b in blocks for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) == len(set(found))
    for x in range(n):
        for y in range(x + 1, n):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 75 * (size[x] + size[y] - both):
                assert (x, y) in found


def test_tree_follows_cells_sides_and_groups(monkeypatch):
    """Small nodes, several cells: exactly the pairs whose counts allow a link, each once."""
    monkeypatch.setattr(shingle_rtree, "LEAF", 3)
    monkeypatch.setattr(shingle_rtree, "FAN", 2)
    monkeypatch.setattr(shingle_rtree, "NODE_PAIRS", 5)
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 120):
        size, point = rng.integers(5, 30, n), rng.integers(0, 3, (n, 8))
        group, cell, side = rng.integers(0, 40, n), rng.integers(0, 6, n), rng.integers(0, 2, n)
        for sides in (np.zeros(n, int), side):
            found = [p for a, b in tree_pairs(size, point, group, cell, sides) for p in zip(a.tolist(), b.tolist(), strict=True)]
            want = {
                (x, y) for x in range(n) for y in range(x + 1, n)
                if cell[x] == cell[y] and group[x] != group[y] and (sides[x] != sides[y] or sides.min() == sides.max())
                and 75 * max(size[x], size[y]) <= 100 * min(size[x], size[y])
                and np.minimum(point[x], point[y]).sum() >= shingle_rtree._needed(size[x], size[y])
            }
            assert {(min(p), max(p)) for p in found} == want and len(found) == len(want)


def test_one_group_of_near_copies_grows_in_proportion(spark, monkeypatch):
    """Rows that leave the tasks, and sets that are compared, for groups of 100, 200 and 400 edited copies."""
    made = {}
    real = shingle_rtree._linked_inside

    def counted(*args):
        found = real(*args)
        made["links"] = found.count()
        return found

    monkeypatch.setattr(shingle_rtree, "_linked_inside", counted)
    for copies in (100, 200, 400):
        rows = corpus(9, 1, copies)
        _, want = brute_components(rows)
        made["links"] = 0
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert made["links"] <= 3 * copies


def test_texts_that_meet_by_chance_are_left_out(spark, monkeypatch):
    """Unlike texts of few words share shingles; hardly any of them may reach the neighbourhoods, whose number would grow with the square."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(90, 110)))) for i in range(80)]
    rows += [(100 + i, t + " and one more") for i, t in rows[:10]]
    real, met = shingle_rtree._neighbourhoods, []

    def counted(spokes, *args):
        met.append(spokes.count())
        return real(spokes, *args)

    monkeypatch.setattr(shingle_rtree, "_neighbourhoods", counted)
    sets, want = brute_components(rows)
    assert sum(bool(sets[a] & sets[b]) for a in range(80) for b in range(a)) > 1_000
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert met[0] <= 60


@pytest.mark.parametrize("crowd,seed", [(1, 6), (2, 7)])
def test_full_and_small_cells_together(spark, monkeypatch, crowd, seed):
    """Entries paired in some of the cells that they share and led in others, sizes on both sides of the steps of the shared count."""
    monkeypatch.setattr(shingle_rtree, "CROWD", crowd)
    rows = corpus(seed, 12, 5, words=110) + [(500 + i, t) for i, t in corpus(seed + 50, 3, 25, words=90)]
    _, want = brute_components(rows)
    assert len(set(want.values())) < len(rows) - 10
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_prefixes_share_as_many_shingles_as_stated():
    """Linked sets of any sizes, in the worst order: what they do not share comes first."""
    for large in range(1, 400):
        for small in range(-(-3 * large // 4), large + 1):
            both = int(shingle_rtree._needed(np.array(small), np.array(large)))
            if both > small:
                continue
            shared = [shingle_rtree.prefix_length(n) - (n - both) for n in (small, large)]
            assert min(shared) >= 1 + small // shingle_rtree.SHARED_PART and shingle_rtree.prefix_length(large) <= large


def test_ids_that_hold_several_sets(spark):
    """Rows of one id with different texts are entries of their own, also where the id is the least of several sets."""
    rows = corpus(5, 6, 4) + [(2, "other words of row two that nobody else has written down"), (2, "yet another text of that very id, unlike the rest")]
    rows += [(900, "other words of row two that nobody else has written down"), (901, "yet another text of that very id, unlike the rest of it")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by_set = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by_set[900, len(shingles(rows[-2][1]))] == 2 and by_set[901, len(shingles(rows[-1][1]))] == 2
    _, want = brute_components(corpus(5, 6, 4))
    assert all(by_set[i, len(shingles(t))] == want[i] for i, t in corpus(5, 6, 4))


def test_jaccard_edges(spark):
    long_text = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 1), (2, "", None, None, None), (3, " \t\n", "en", "a", 3), (4, "A b", "en", "a", 3),
        (5, "a B", "en", "a", 3), (6, "a b c", "en", "a", 5), (9, long_text, "en", "a", 9), (8, long_text + " y", "en", "a", 9),
        (None, "a b", "en", "a", 3), (7, "q r s t u v", "en", "a", 9), (7, "q r s t u v", "en", "a", 9),
    ]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 0): 1, (2, 0): 2, (3, 0): 3, (4, 1): 4, (5, 1): 4, (6, 1): 6, (9, 29_996): 8, (8, 29_997): 8, (None, 1): None, (7, 2): 7}
    clashing = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(1)).withColumn("uid", F.lit("x")).withColumn("n", F.lit(0))
    for name in ("bit", "gone", "gone_id", "times", "component_id", "members"):
        clashing = clashing.withColumn(name, F.lit("clash"))
    kept = distinct_documents(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, 6, 7, 8, None]
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    assert distinct_documents(spark.createDataFrame([], DOCS)).count() == 0


def brute_vectors(rows):
    ids = [i for i, _ in rows]
    unit = np.array([v for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    linked = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)]
    return dict(zip(ids, near.sum(axis=1).tolist(), strict=True)), least_of_components(ids, linked)


@pytest.mark.parametrize("chunk,dims", [(16_384, 64), (40, 64), (40, 10)])
def test_vectors_match_brute_force(spark, monkeypatch, chunk, dims):
    monkeypatch.setattr(vector_pigeonhole, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    points = np.concatenate([
        rng.normal(size=(150, dims)),
        centres[rng.integers(0, 12, 150)] + rng.normal(size=(150, dims)) * rng.uniform(0.05, 0.3, (150, 1)),
        centres[0] + rng.normal(size=(120, dims)) * 0.03,
    ])
    rows = [(int(i), [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(1_000 + i, rows[i][1]) for i in range(5)] + [(2_000, [2.0 * x for x in rows[0][1]])]
    links, least = brute_vectors(rows)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == links
    assert {r["vec_id"]: r["component_id"] for r in got} == least
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 3), (2, [2.0, 0.0], 3), (3, None, None), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
        (7, [None, 1.0], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1e30, 0.0], 1), (None, [1.0, 0.0], 1), (11, [0.0, 1.0], 1),
        (11, [0.0, 1.0], 1),
    ]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, uid int")).collect()
    assert len(got) == len(rows)
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by_id[1] == (2, 1, True) and by_id[2] == (2, 1, False) and by_id[10] == (2, 1, False)
    assert all(by_id[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9))
    assert by_id[11] == (1, 11, True) and by_id[None] == (0, None, False)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rotation_keeps_lengths_and_ignores_batches():
    x = np.random.default_rng(1).normal(size=(20, 48))
    turned = rotate(x)
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1))
    assert (turned[3:5] == rotate(x[3:5])).all()
