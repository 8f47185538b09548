"""URL verdicts, mixing, sharding, registered queries and the pipeline."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from svmflow.llm import sharding, url_redirects
from svmflow.llm.mixing import mix, mixed_documents
from svmflow.llm.queries import ORACLES, QUERIES, URL_RULES
from svmflow.llm.sharding import difference, shard
from svmflow.llm.url_redirects import page_links, resolved, url_verdicts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string, host string"


def canonical(url):
    return f'<head><link rel="canonical" href="{url}"></head>'


def test_blocks_reach_aliases_and_allow_stands(spark):
    rows = [
        (1, "http://a.example.org/es/1", None, "x"),
        (2, "http://mirror.net/x", canonical("http://A.example.org/es/1/#top"), "x"),
        (3, "https://mirror.net/x/", None, "x"),
        (4, "http://free.com/fr/1", canonical("http://mirror.net/x"), "x"),
        (5, "http://other.net/", canonical("http://b.com/de/9"), "x"),
        (6, "http://far.net/p", "<meta http-equiv='refresh' content='0; url=//other.net'>", "x"),
        (7, "http://clean.net/", canonical("/home"), "x"),
        (8, None, None, "x"), (9, "mailto:x", None, "x"), (10, "", "", "x"), (11, "http://Org.example.COM?x", None, "x"),
        (2, "http://mirror.net/x", canonical("http://A.example.org/es/1/#top"), "x"),
    ]
    got = url_verdicts(spark.createDataFrame(rows, PAGES), URL_RULES).collect()
    assert len(got) == len(rows)
    verdict = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert verdict[1] == ("example.org/es/", "block")
    assert verdict[2] == verdict[3] == (None, "block")
    assert verdict[4] == ("com/fr/", "allow")
    assert verdict[5] == verdict[6] == (None, "block")
    assert verdict[7] == verdict[8] == verdict[9] == verdict[10] == verdict[11] == (None, "allow")
    parts = {r["page_id"]: (r["host"], r["path"]) for r in got}
    assert parts[8] == parts[9] == ("", "") and parts[11] == ("org.example.com", "")
    assert url_verdicts(spark.createDataFrame([], PAGES), URL_RULES).count() == 0


def test_only_stated_edges_make_aliases(spark):
    rows = [
        (1, "http://b.com/de/", None, "x"), (2, "https://b.com/de", None, "x"), (3, "http://b.com/de/#a", None, "x"),
        (4, "http://m.net/", canonical("http://c.com/de/x/"), "x"), (5, "https://c.com/de/x", None, "x"), (6, "http://M.net", None, "x"),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_verdicts(spark.createDataFrame(rows, PAGES), URL_RULES).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block"}


def brute_verdicts(urls, rules, links):
    """Longest fitting rule, else a block anywhere in the URL's component of the stated links, by breadth first search."""

    def own(url):
        host, slash, path = url.split("://")[1].partition("/")
        fitting = [(len(r), v == "allow", v, r) for v, r in rules for rh, rp in [r.split("/", 1)]
                   if (host == rh or host.endswith("." + rh)) and (slash + path).startswith("/" + rp)]
        return max(fitting)[2:] if fitting else (None, None)

    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for url in urls:
        seen, todo = {url}, [url]
        while todo:
            for other in near.get(todo.pop(), set()) - seen:
                seen.add(other)
                todo.append(other)
        verdict, rule = own(url)
        out[url] = (rule, verdict or ("block" if any(own(u)[0] == "block" for u in seen) else "allow"))
    return out


@pytest.mark.parametrize("hosts", [20_000, 0])
def test_verdicts_match_brute_force_on_random_links(spark, monkeypatch, hosts):
    monkeypatch.setattr(url_redirects, "BROADCAST_HOSTS", hosts)
    draw = np.random.default_rng(6)
    names = ["a.org", "b.a.org", "c.net", "d.c.net", "e.com", "f.e.com", "g.info"]
    urls = sorted({f"http://{draw.choice(names)}/{draw.choice(list('pqrst'))}/{draw.integers(6)}" for _ in range(120)})
    rules = [("block", "a.org/p/"), ("allow", "b.a.org/p/"), ("block", "c.net/q/1"), ("block", "e.com/r/"), ("allow", "e.com/"), ("block", "c.net/q/1"), ("allow", "c.net/q/1")]
    links = [(str(draw.choice(urls)), str(draw.choice(urls))) for _ in range(70)]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], PAGES)
    edges = spark.createDataFrame([(a, b.replace("http:", "https:") + "#x") for a, b in links], "from_url string, to_url string")
    got = {urls[r["page_id"]]: (r["rule"], r["verdict"]) for r in url_verdicts(pages, rules, edges).collect()}
    assert got == brute_verdicts(urls, rules, links)
    assert {v for _, v in got.values()} == {"allow", "block"} and any(r is None and v == "block" for r, v in got.values())


def test_links_as_pages_write_them(spark):
    url = "http://h.net/a/b?k"
    html = (
        "<link rel=canonical href='https://h.net/x?a=1&amp;b=2&copy=3'><link href=\"./c\" rel='nofollow canonical'>"
        "<link rel='stylesheet' href='/no.css'><!-- <link rel=canonical href=/no> -->"
        "<meta http-equiv=refresh content='0;url=../d?p=1&amp;q=2;r'><META content=\"5; URL='?q'\" HTTP-EQUIV=\"Refresh\">"
        "<meta http-equiv=refresh content=30>"
    )
    got = page_links(spark.createDataFrame([(1, url, html, "x"), (2, None, html, "x"), (3, url, None, "x")], PAGES)).collect()
    assert sorted(r["to_url"] for r in got) == sorted(
        ["https://h.net/x?a=1&b=2&copy=3", "http://h.net/a/c", "http://h.net/d?p=1&q=2;r", "http://h.net/a/b?q"]
    )
    assert {r["from_url"] for r in got} == {url}
    for target, found in {
        "../../../up": "http://h.net/up", "./": "http://h.net/a/", "..": "http://h.net/", "//o.net/p": "http://o.net/p",
        "/r/./s": "http://h.net/r/s", "#top": "http://h.net/a/b?k#top", "t": "http://h.net/a/t", "ftp://f.net/../x": "ftp://f.net/../x",
    }.items():
        assert resolved(url, target) == found
    assert resolved("http://h.net", "t") == "http://h.net/t"
    rows = [
        (1, "http://b.com/de/9?a=1&b=2", None, "x"),
        (2, "http://m.net/y", canonical("http://ok.net/") + canonical("http://b.com/de/9?a=1&amp;b=2"), "x"),
    ]
    assert {r["verdict"] for r in url_verdicts(spark.createDataFrame(rows, PAGES), URL_RULES).collect()} == {"block"}


def test_mix_edges(spark):
    rows = [
        (1, None, "en", "b", 1), (2, "", "en", "b", 1), (3, "one two three", "en", None, 1), (4, "w " * 50_000, "en", "a", 1),
        (5, "x y", "en", "b", 1), (5, "x y", "en", "b", 1), (None, "p q r", "en", "c", 1), (6, None, "en", "empty", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = mix(docs).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got) and all(r["target"] <= 2 * r["source_size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {(r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in targets) <= 1.5 * total + 1e-6
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, got))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("doc_id in (1, 2, 6)").count() == 3
    assert mix(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_mix_draws_some_of_equal_rows(spark):
    """Rows of one id and size share a draw key; the goal still falls between them."""
    texts = {"a": "w x y z", "b": "p q", "c": "one"}
    rows = [(None, texts[s], "en", s, 1) for s in "abc" for _ in range(200)] + [(i, "u v w", "en", "c", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_repeat", F.lit("clash")).withColumn("whole", F.lit(7)).withColumn("fitting", F.lit(None))
    got = mix(docs).collect()
    assert len(got) == len(rows)
    for source_size in {r["source_size"] for r in got}:
        mine = [r for r in got if r["source_size"] == source_size]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and {r["_repeat"] for r in mixed.select("_repeat").distinct().collect()} == {"clash"}
    words = F.size(F.split("text", " "))
    per_source = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    wanted = {s: sum(r["taken"] for r in got if r["source_size"] == n) for s, n in (("a", 800), ("b", 400), ("c", 320))}
    assert per_source == wanted


def test_differencing_beats_greedy_on_the_textbook_case():
    part = difference(np.array([8, 7, 6, 5, 4]), 2)
    sums = np.bincount(part, weights=[8, 7, 6, 5, 4])
    assert abs(sums[0] - sums[1]) == 2
    assert difference(np.zeros(0, np.int64), 4).tolist() == []
    assert sorted(difference(np.array([5, 5, 5]), 4).tolist()) == sorted(set(difference(np.array([5, 5, 5]), 4).tolist()))


@pytest.mark.parametrize("limit", [20_000, 60])
def test_shards_are_whole_even_and_gapless(spark, monkeypatch, limit):
    monkeypatch.setattr(sharding, "TASK_ITEMS", limit)
    monkeypatch.setattr(sharding, "BUNDLES", 8)
    monkeypatch.setattr(sharding, "LARGE_PART", 4)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    rows = [(i, f"text {i % 150} " + "y" * (i % 150 * 7), "en", "a", 1) for i in range(400)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (500, "", "en", "a", 0), (7, "text 7 " + "y" * 49, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("clash")).withColumn("item", F.lit(2))
    got = shard(docs, 4).collect()
    assert len(got) == len(rows)
    by_text, bytes_of, slots = {}, {}, {}
    for r in got:
        assert by_text.setdefault(r["text"], r["shard"]) == r["shard"]
        bytes_of[r["shard"]] = bytes_of.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 0.02 * sum(bytes_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard(docs.limit(0), 4).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet') t")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(ORACLES[name]).fetchall()
    at = [[d[0] for d in con.description].index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_return_every_row(spark, name):
    table = {"op3": "embeddings", "op13": "embeddings", "op4": "pages"}.get(name.split("_")[0], "documents")
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() and out.where("shard not between 0 and 15").count() == 0
