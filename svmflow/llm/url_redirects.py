"""URL verdicts by rules, passed on to aliases over redirect and canonical-link edges."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svmflow.llm.common import fresh, save
from svmflow.llm.components import components

ALLOW, BLOCK = "allow", "block"

_TAGS = r"""(?is)<(?:link|meta)\b(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)"""
_ATTRIBUTE = re.compile(r"""([^\s=>"'/<]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: A reference without its semicolon is one in an attribute only where no letter, digit or = follows.
_REFERENCE = re.compile(r"&(?:#(?:\d+|[xX][0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*)(;|(?![=A-Za-z0-9])))")
_REFRESH = re.compile(r"\s*(?:[\d.]+\s*(?:[;,]\s*|\s+|\Z))?(url\s*=\s*)?(.*)", re.I | re.S)


def decoded(value: str) -> str:
    """The value of an attribute without character references."""

    def of(m: re.Match) -> str:
        if m[1] is None:
            return html.unescape(m[0])
        return html5.get(m[1] + m[2], m[0])

    return _REFERENCE.sub(of, value)


def stated_target(tag: str) -> str | None:
    """Target of a canonical link or of a refresh redirect; null for other tags."""
    values: dict[str, str] = {}
    for name, *quoted in _ATTRIBUTE.findall(tag):
        values.setdefault(name.lower(), decoded("".join(quoted)))
    if tag[1:5].lower() == "link":
        return values.get("href", "").strip() or None if "canonical" in values.get("rel", "").lower().split() else None
    if values.get("http-equiv", "").strip().lower() != "refresh":
        return None
    content = values.get("content", "")
    m = _REFRESH.match(content)
    target = m[2].strip()
    if not m[1] and not content.lstrip()[:1].isdigit():
        return None
    if target[:1] in ("'", '"'):
        target = target[1:].partition(target[0])[0].strip()
    return target or None


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for part in parts:
        if part == "..":
            if len(out) > 1:
                out.pop()
        elif part != ".":
            out.append(part)
    return "/".join(out) + ("/" if parts[-1] in (".", "..") else "")


def resolved(base: str, target: str) -> str:
    """``target`` as an absolute URL, as a page at ``base`` means it; one with a scheme stays as it is."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        return target
    scheme, mark, rest = base.partition("://")
    if not mark or target.startswith("//"):
        return f"{scheme}:{target}" if mark else target
    host, path, query = re.match(r"(?s)([^/?#]*)([^?#]*)([^#]*)", rest).groups()
    site = f"{scheme}://{host}"
    own, more = re.match(r"(?s)([^?#]*)(.*)", target).groups()
    if not own:
        return site + path + (more if more.startswith("?") else query + more)
    return site + _without_dots(own if own.startswith("/") else (path.rpartition("/")[0] + "/" + own)) + more


def _state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = [
            (url, resolved(url, target))
            for url, tags in zip(batch["url"].to_pylist(), batch["tags"].to_pylist(), strict=True)
            for target in map(stated_target, tags)
            if target
        ]
        yield pa.record_batch(
            {"from_url": pa.array([a for a, _ in links], pa.string()), "to_url": pa.array([b for _, b in links], pa.string())}
        )


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def resource_key(url: Column) -> Column:
    """The resource that a URL leads to: scheme, fragment and closing slash do not count; null without a host."""
    no_fragment = F.regexp_extract(_rest(url), r"(?s)^[^#]*", 0)
    query = F.regexp_extract(no_fragment, r"(?s)\?.*$", 0)
    key = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), query)
    return F.when(host_of(url) != "", key)


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of all canonical links and refresh redirects that pages state themselves.

    Character references in targets are decoded. Targets may be absolute, start
    with ``//``, ``/`` or ``?``, or be relative to the page's folder, with
    ``.`` and ``..``. Pages with null url or html state none.
    """
    tags = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), F.lit(_TAGS), F.lit(0))
    stating = F.filter(tags, lambda t: F.lower(t).rlike(r"canonical|http-equiv"))
    stated = (
        pages.where("url is not null and html is not null")
        .where(F.lower("html").rlike(r"canonical|http-equiv"))
        .select("url", stating.alias("tags"))
    )
    return stated.mapInArrow(_state, "from_url string, to_url string")


def _host_rules(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, candidates): the rules whose host is the host or a parent of it, the longest first.

    Works on distinct hosts: each looks up its few parents, so neither a
    common host nor a long rule list multiplies rows.
    """
    spark = hosts.sparkSession
    table = spark.createDataFrame(
        [(r.partition("/")[0].lower(), "/" + r.partition("/")[2], v, r) for v, r in rules],
        "rule_host string, rule_path string, verdict string, rule string",
    )
    by_host = table.groupBy("rule_host").agg(
        F.collect_list(
            F.struct(F.length("rule").alias("n"), (F.col("verdict") == ALLOW).alias("first"), "rule_path", "verdict", "rule")
        ).alias("own")
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (
        hosts.select("host", F.explode(suffixes).alias("rule_host"))
        .join(by_host, "rule_host")
        .groupBy("host")
        .agg(F.reverse(F.array_sort(F.flatten(F.collect_list("own")))).alias("candidates"))
    )


#: Hosts with rules that are sent to all tasks at most, so that pages stay where they are; beyond, pages meet them in a shuffle.
BROADCAST_HOSTS = 20_000


def _judge(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``urls`` with host, path, rule and rule_verdict (null where no rule fits)."""
    split = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    of_host = save(_host_rules(split.select("host").distinct(), rules), "url-hosts")
    if of_host.count() <= BROADCAST_HOSTS:
        of_host = F.broadcast(of_host)
    fitting = F.filter("candidates", lambda r: F.col("path").startswith(r["rule_path"]))
    return (
        split.join(of_host, "host", "left")
        .withColumn("hit", F.get(fitting, F.lit(0)))
        .select(*urls.columns, "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("rule_verdict"))
    )


def url_verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str]], links: DataFrame | None = None, id_col: str = "page_id"
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` are (verdict, "host/path") pairs; a rule fits its host and all
    subdomains if the path starts with the rule's, and the longest wins, an
    allow before a block of the same text. ``links`` (from_url, to_url) are redirect and
    canonical-link edges; by default those that the pages state. An edge names resources: scheme,
    fragment and closing slash of its URLs do not count. Without a
    rule of its own a URL that edges name is blocked if a block rule fits any URL in its
    component, and allowed otherwise, as is one that no edge names; an explicit allow always
    stands. A null url or one without ``://`` has empty host and path, fits no
    rule, has no aliases and is allowed. Repeated rows are all judged.
    """
    links = page_links(pages) if links is None else links
    edges = save(
        links.select(
            resource_key(F.col("from_url")).alias("a"), resource_key(F.col("to_url")).alias("b"), F.col("to_url").alias("url")
        ),
        "url-links",
    )
    key = fresh("row")
    judged = save(_judge(pages.select(F.col(id_col).alias(key), "url"), rules), "url-judged")
    targets = _judge(edges.select("url").where("url is not null").distinct(), rules)
    of = components(edges)
    blocked = (
        judged.where(F.col("rule_verdict") == BLOCK).select("url")
        .union(targets.where(F.col("rule_verdict") == BLOCK).select("url"))
        .select(resource_key(F.col("url")).alias("node"))
        .distinct()
        .join(of, "node")
        .select(F.col("component").alias("group"))
        .distinct()
        .withColumn("alias_block", F.lit(True))
    )
    undecided = (
        judged.where("rule_verdict is null")
        .select(resource_key(F.col("url")).alias("node"))
        .distinct()
        .join(of, "node")
        .select("node", F.col("component").alias("group"))
        .join(blocked, "group")
        .select("node", "alias_block")
    )
    return (
        judged.withColumn("node", F.when(F.col("rule_verdict").isNull(), resource_key(F.col("url"))))
        .join(undecided, "node", "left")
        .select(
            F.col(key).alias(id_col),
            "host",
            "path",
            "rule",
            F.coalesce("rule_verdict", F.when(F.col("alias_block"), BLOCK), F.lit(ALLOW)).alias("verdict"),
        )
    )
