"""Named corpus queries over the test tables, and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svmflow.llm.cgk_decontam import contamination
from svmflow.llm.collocations import phrase_collocations
from svmflow.llm.common import tables_in
from svmflow.llm.language_zstd import identify_language
from svmflow.llm.line_index import dedup_lines
from svmflow.llm.mixing import mix
from svmflow.llm.quality_resampling import quality_sample
from svmflow.llm.sharding import shard
from svmflow.llm.shingle_rtree import jaccard_components
from svmflow.llm.sphere_kmeans import cluster_vectors
from svmflow.llm.toxicity_fm import toxicity
from svmflow.llm.url_redirects import ALLOW, BLOCK, url_verdicts
from svmflow.llm.vector_pigeonhole import near_vectors
from svmflow.llm.wrapper_html import extract_text

URL_RULES = [
    (ALLOW, "org/"),
    (BLOCK, "example.org/es/"),
    (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"),
    (BLOCK, "com/de/"),
]

Query = Callable[[SparkSession, str], DataFrame]


def op1_redirect_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url by rule, or passed on from its aliases."""
    (pages,) = tables_in(spark, sf_dir, "pages")
    return url_verdicts(pages, URL_RULES)


def op2_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a Jaccard similarity of 0.75."""
    (docs,) = tables_in(spark, sf_dir, "documents")
    return jaccard_components(docs)


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    (vectors,) = tables_in(spark, sf_dir, "embeddings")
    return near_vectors(vectors, 0.95)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    (pages,) = tables_in(spark, sf_dir, "pages")
    return extract_text(pages)


def op5_quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones keeps."""
    docs, labels = tables_in(spark, sf_dir, "documents", "labels")
    return quality_sample(docs, labels)


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compression."""
    (docs,) = tables_in(spark, sf_dir, "documents")
    return identify_language(docs)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a factorization machine."""
    docs, labels = tables_in(spark, sf_dir, "documents", "labels")
    return toxicity(docs, labels)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes, by source weight."""
    (docs,) = tables_in(spark, sf_dir, "documents")
    return mix(docs)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; equal texts share a shard."""
    (docs,) = tables_in(spark, sf_dir, "documents")
    out = shard(docs, 16, keep=("doc_id",))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds, up to word edits."""
    docs, benchmark = tables_in(spark, sf_dir, "documents", "benchmark")
    return contamination(docs, benchmark)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of every language."""
    (docs,) = tables_in(spark, sf_dir, "documents")
    return phrase_collocations(docs)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that are left once repeated ones stay only where they come first."""
    (docs,) = tables_in(spark, sf_dir, "documents")
    kept = dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of all embeddings after five rounds."""
    (vectors,) = tables_in(spark, sf_dir, "embeddings")
    return cluster_vectors(vectors)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_redirect_urls,
        op2_shingle_components,
        op3_vector_links,
        op4_main_text,
        op5_quality_sample,
        op6_languages,
        op7_toxicity,
        op8_mix_sources,
        op9_shards,
        op10_benchmark_leaks,
        op11_collocations,
        op12_line_dedup,
        op13_vector_clusters,
    )
}

ORACLES: dict[str, str] = {
    "op1_redirect_urls": r"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rests AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
          FROM pages),
parts AS (
  SELECT row_number() OVER () AS n, page_id, html,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(regexp_extract(rest, '^[^#]*'), '\?.*$') AS query
  FROM rests),
keyed AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || query END AS node FROM parts),
judged AS (
  SELECT k.n, k.page_id, k.host, k.path, k.node, k.html,
         arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS own
  FROM keyed k LEFT JOIN rules r
    ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
  GROUP BY ALL),
links AS (
  SELECT node AS a, regexp_replace(regexp_extract(regexp_extract(html, '<link[^>]*rel="canonical"[^>]*>'),
                                   'href="[a-z]+://([^"#]*)', 1), '/+$', '') AS b
  FROM judged WHERE html LIKE '%rel="canonical"%'),
reach(node, other) AS (
  SELECT node, node FROM judged WHERE own = 'block' AND node IN (SELECT a FROM links UNION ALL SELECT b FROM links)
  UNION
  SELECT r.node, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM reach r JOIN links l ON l.a = r.other OR l.b = r.other)
SELECT page_id, host, path, rule,
       coalesce(own, CASE WHEN node IN (SELECT other FROM reach) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
""",
    "op8_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, size, md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))) AS k
  FROM (SELECT doc_id, source,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)),
sources AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, position,
         CAST([3, 1, 2][(position - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS position
        FROM sized GROUP BY source)),
levels AS (
  SELECT *, cap / weight AS clamps_at,
         (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / sum(weight) OVER after AS level
  FROM sources
  WINDOW before AS (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY cap / weight, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goals AS (
  SELECT *, floor(target / nullif(source_size, 0)) AS whole
  FROM (SELECT source, source_size,
               least(cap, weight * (SELECT arg_min(level, clamps_at) FROM levels WHERE level <= clamps_at)) AS target
        FROM levels)),
ranked AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, coalesce(g.whole, 0) AS whole,
         g.target - coalesce(g.whole, 0) * g.source_size AS goal,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k ROWS UNBOUNDED PRECEDING) - s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN middle <= goal THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM ranked
""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k),
counts AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cuts AS (
  SELECT lang, phrase, k, f, unnest(range(1, k)) AS cut_at, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cut_scores AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, c.cut_at, p.f AS l, q.f AS r,
         ((1000000::HUGEINT * c.f * c.f) // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM cuts c JOIN counts p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1 : c.cut_at], ' ')
              JOIN counts q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[c.cut_at + 1 :], ' ')),
best AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f AS longer
  FROM cuts WHERE k = 3 AND cut_at = 1),
kept AS (
  SELECT * FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= 50 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000
""",
    "op12_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, line, i,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
shared AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
told AS (SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.first_doc AS gone FROM lines l LEFT JOIN shared s ON s.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
""",
}
