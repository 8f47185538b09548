"""Main text of pages by wrappers: union-free regular expressions inferred from pages of one host."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svmflow.llm.common import fresh, save
from svmflow.llm.url_redirects import host_of
from svmflow.session import Scratch

#: Shapes of pages of one host, about, that one task aligns; the wrappers of such parts are aligned in turn.
PART_SHAPES = 64
#: Longest group of tokens that is looked for as repeated.
GROUP_TOKENS = 12
#: Part of a page's main text that the region must hold; text outside it is kept too, unless most of it is links.
REGION_PART = 0.8

#: Different pages of a host on which a slot must hold the same text to be taken as the template's.
CONSTANT_PAGES = 3

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta link input "
    "q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article body div main section td".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
#: Elements whose end may be left out.
OPEN_ENDED = frozenset("dd dt li option p td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BESIDE_TAGS = frozenset("aside footer head menu nav title".split())
#: Tags that, like names, only leave out an element that does not hold most of the page's text: some pages are one form.
BESIDE_UNLESS_MOST = frozenset("dialog fieldset form".split())
#: Elements inside a line whose own text is left out.
MUTED = frozenset("button select".split())
BESIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus foot footer gdpr masthead menu modal nav navbar navigation newsletter notice notification "
    "pagination popup promo related reply respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar topbar widget".split()
)
#: Words that before a name of BESIDE_NAMES tell what the element has, not what it is.
STATES = frozenset("has have hide is no not show toggle with without".split())
#: Words that behind a name of BESIDE_NAMES only say which part or form of it the element is.
PARTS = frozenset(
    "area bar block body bottom box btn button buttons col column container content fixed form frame group header icon "
    "icons inner inline item items label left line link links list main message outer overlay panel posts primary right "
    "row secondary section slot thread title top unit widgets wrap wrapper".split()
)
_RAW = "script|style|noscript|template|svg|textarea|iframe|object|math"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<({_RAW})\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^<]++|<)""",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """('text', s), ('open', label) and ('close', tag) of a page; scripts, styles and comments are left out.

    A label is the tag with its class, id and role names, as in ``div.ad``;
    slashes of names, which would part a path, are written ``%2F``.
    """
    for m in _TOKEN.finditer(page):
        if m[5] is not None:
            yield "text", m[5]
        elif m[3] is not None:
            tag = m[3].lower()
            if m[2]:
                yield "close", tag
            else:
                names = [n.lower().replace("/", "%2F") for found in _NAMED.findall(m[4]) for n in "".join(found).split()] if m[4] else []
                yield "open", ".".join([tag, *names])


def _tag(label: str) -> str:
    return label.partition(".")[0]


def beside(label: str, inside_article: bool) -> bool:
    """Whether a tag holds what stands beside the main text: menus, footers and the like."""
    tag = _tag(label)
    return tag in BESIDE_TAGS or (tag == "header" and not inside_article)


def named_beside(label: str) -> bool:
    """Whether a name of an element says so: a whole name, its head word, or its first word before words of PARTS."""
    tag, *names = label.split(".")
    if tag in ("html", "body"):
        return False
    for name in names:
        words = re.split(r"[-_]+", name.strip("-_"))
        if words[0] in STATES:
            continue
        if words[-1] in BESIDE_NAMES or (words[0] in BESIDE_NAMES and all(w in PARTS or w.isdigit() for w in words[1:])):
            return True
    return False


def _events(page: str) -> Iterator[tuple]:
    """('open', label), ('close', tag) and ('block', path, text, characters inside links, beside, in article, named).

    Beside is told by tags only; ``named`` are the numbers of the elements
    around the block that have a name or a tag of what stands beside unless it holds most of the page.
    Buttons and the like are part of a line, without their text.
    """
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # label, in an article, beside, named
    parts: list[str] = []
    linked = links = opened = 0
    muted: int | None = None  # height of the stack below an open button

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        of_links, linked = linked, 0
        if text:
            _, article, aside, named = stack[-1] if stack else ("", False, False, ())
            yield "block", tuple(s[0] for s in stack), text, of_links, aside, article, named

    for kind, value in tokens(page):
        if muted is not None:
            if kind == "open" and _tag(value) not in VOID:
                stack.append((value, *stack[-1][1:]))
            elif kind == "close":
                height = max((i for i, s in enumerate(stack) if _tag(s[0]) == _tag(value)), default=len(stack))
                if height < muted:
                    # The end of what holds a button that was never closed.
                    del stack[muted:]
                    yield from flush()
                    yield kind, value
                    links = 0
                muted = muted if height > muted else None
                del stack[height:]
            continue
        if kind == "text":
            value = html.unescape(value)
            parts.append(value)
            linked += len(value) if links else 0
            continue
        tag = _tag(value)
        if tag in MUTED:
            if kind == "open":
                parts.append(" ")
                muted = len(stack)
                stack.append((value, *(stack[-1][1:] if stack else (False, False, ()))))
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = int(kind == "open")
            continue
        yield from flush()
        yield kind, value
        if kind == "open":
            if tag in ENDS_P and stack and _tag(stack[-1][0]) == "p":
                stack.pop()
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and _tag(stack[-1][0]) == tag:
                stack.pop()
            if tag not in VOID:
                _, article, aside, named = stack[-1] if stack else ("", False, False, ())
                opened += 1
                aside = aside or beside(value, article)
                named = (*named, opened) if named_beside(value) or tag in BESIDE_UNLESS_MOST else named
                stack.append((value, article or tag in ("article", "main"), aside, named))
        else:
            links = 0
            if any(_tag(s[0]) == tag for s in stack):
                while _tag(stack.pop()[0]) != tag:
                    pass
    yield from flush()


def _spared(found: list[tuple]) -> set[int]:
    """Numbers of elements that their names, or tags of forms, alone may not leave out.

    They hold most of the page's text, and no article or main element stands
    outside of them.
    """
    size: Counter = Counter()
    articles: Counter = Counter()
    total = of_articles = 0
    for _, _, text, of_links, aside, article, named in found:
        n = 0 if aside else max(0, len(text) - of_links)
        total += n
        of_articles += n if article else 0
        for element in named:
            size[element] += n
            articles[element] += n if article else 0
    return {e for e, n in size.items() if 2 * n > total and articles[e] == of_articles}


def _judged(events: Iterator[tuple]) -> list[tuple]:
    """The events as a list, blocks as ('block', path, text, characters inside links, beside)."""
    out = list(events)
    found = [e for e in out if e[0] == "block"]
    spared = _spared(found) if any(e[6] for e in found) else set()
    return [(*e[:4], e[4] or any(n not in spared for n in e[6])) if e[0] == "block" else e for e in out]


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int, bool]]:
    """(path of labels, text, characters inside links, beside) of every block with text, in page order.

    Open elements that a page never closes are closed as browsers do: a
    paragraph by the next block, others by the end of what holds them.
    """
    return (e[1:] for e in _judged(_events(page)) if e[0] == "block")


def text_key(path: tuple[str, ...], text: str) -> str:
    """Short name of a text in the slots under a path."""
    data = "\n".join((*path, text)).encode("utf-8", "replace")
    return f"{zlib.crc32(data):08x}{zlib.adler32(data):08x}{len(data):x}"


def slots_of(events: list[tuple]) -> dict[tuple[str, ...], list[str]]:
    """Texts of the slots of a page by their path, without what is beside."""
    slots: dict[tuple, list] = {}
    for event in events:
        if event[0] == "block" and not event[4]:
            slots.setdefault(event[1], []).append(event[2])
    return slots


def constant_texts(pages: list[list[tuple]]) -> set[str]:
    """Keys of the texts of slots that hold the same on all different pages which have the slot.

    Slots are told by their path. A slot that varies, as the paragraphs of an
    article do, holds no template text even where one of its texts recurs.
    What is beside anyway is not looked at.
    """
    held: dict[tuple, list] = {}
    for page in pages:
        for path, texts in slots_of(page).items():
            held.setdefault(path, []).append(texts)
    return {
        text_key(path, text)
        for path, texts in held.items()
        if len(texts) >= CONSTANT_PAGES and all(t == texts[0] for t in texts)
        for text in texts[0]
    }


def stream(events: list[tuple], constants: set[str] | frozenset[str] = frozenset()) -> list[str]:
    """The page as tags and text slots, without ends that pages may leave out.

    ``#same`` is a slot with the template's text, ``#text`` any other.
    """
    out: list[str] = []
    for kind, *value in events:
        if kind == "block":
            out.append("#same" if constants and text_key(value[0], value[1]) in constants else "#text")
        elif kind == "open":
            out.append(f"<{value[0]}>")
        elif value[0] not in OPEN_ENDED:
            out.append(f"</{value[0]}>")
    return out


def fold(items: list) -> list:
    """Runs of one group of items as a single repeated group."""
    out: list = []
    for item in items:
        out.append(item)
        for n in range(1, GROUP_TOKENS + 1):
            tail = tuple(out[-n:])
            if len(out) > n and out[-n - 1] == ("+", tail):
                del out[-n:]
                break
            if len(out) >= 2 * n and tuple(out[-2 * n : -n]) == tail and not (n == 1 and isinstance(tail[0], tuple)):
                out[-2 * n :] = [("+", tail)]
                break
    return out


def align(wrapper: list, page: list) -> list:
    """The wrapper, widened to match one more page: what only one of them has becomes optional."""
    out: list = []
    for what, a, b, c, d in SequenceMatcher(None, wrapper, page, autojunk=False).get_opcodes():
        if what == "equal":
            out.extend(wrapper[a:b])
            continue
        for part in (wrapper[a:b], page[c:d]):
            fixed: list = []
            for item in part:
                if isinstance(item, tuple) and item[0] == "?":
                    if fixed:
                        out.append(("?", tuple(fixed)))
                        fixed = []
                    out.append(item)
                else:
                    fixed.append(item)
            if fixed:
                out.append(("?", tuple(fixed)))
    return [x for i, x in enumerate(out) if i == 0 or x != out[i - 1] or not isinstance(x, tuple)]


def expression(items) -> str:
    """A wrapper as text: tags, ``#text`` and ``#same`` slots, ``( )+`` repeated and ``( )?`` optional groups."""
    return " ".join(f"( {expression(x[1])} ){x[0]}" if isinstance(x, tuple) else x for x in items)


@lru_cache(256)
def parse(wrapper: str) -> tuple:
    """The items of an ``expression``."""
    levels: list[list] = [[]]
    for word in wrapper.split():
        if word == "(":
            levels.append([])
        elif word in (")+", ")?"):
            group = (word[1], tuple(levels.pop()))
            levels[-1].append(group)
        else:
            levels[-1].append(word)
    return tuple(levels[0])


def matches(wrapper: str, page: list) -> bool:
    """Whether the folded stream of a page is one that the wrapper describes."""
    items: list = []
    skip: dict[int, int] = {}
    for item in parse(wrapper):
        if isinstance(item, tuple) and item[0] == "?":
            skip[len(items)] = len(items) + len(item[1])
            items.extend(item[1])
        else:
            items.append(item)

    def reached(places: set[int]) -> set[int]:
        out = set(places)
        for place in places:
            while place in skip and skip[place] not in out:
                place = skip[place]
                out.add(place)
        return out

    at = reached({0})
    for item in page:
        at = reached({p + 1 for p in at if p < len(items) and items[p] == item})
        if not at:
            return False
    return len(items) in at


def template_slots(wrapper: str, page: list[str]) -> set[int]:
    """Places in the stream of a page whose ``#same`` slots fall on such slots when the page is aligned with the wrapper.

    For pages that the wrapper does not describe as a whole, as they have an option that no sampled page had.
    """

    def flat(items) -> Iterator[str]:
        for item in items:
            if isinstance(item, tuple):
                yield from flat(item[1])
            else:
                yield item

    aligned: set[int] = set()
    for a, b, n in SequenceMatcher(None, list(flat(parse(wrapper))), page, autojunk=False).get_matching_blocks():
        aligned.update(i for i in range(b, b + n) if page[i] == "#same")
    return aligned


def container_weights(found: Iterator[tuple]) -> tuple[Counter, int]:
    """(characters of main text outside links by the path of each container that holds them, all of them) of the blocks of a page."""
    weight: Counter = Counter()
    total = 0
    for path, text, of_links, aside in found:
        size = max(0, len(text) - of_links)
        if aside or not size:
            continue
        total += size
        for n in range(1, len(path) + 1):
            if _tag(path[n - 1]) in CONTAINERS:
                weight[path[:n]] += size
    return weight, total


def region_of(pages: list[str]) -> str:
    """Path of the deepest container that holds most of the main text of pages of one wrapper; empty without any.

    Slots count by their text outside links; what stands beside is left out.
    """
    weight: Counter = Counter()
    total = 0
    for page in pages:
        of_page, size = container_weights(blocks(page))
        weight.update(of_page)
        total += size
    fitting = [p for p, w in weight.items() if w >= REGION_PART * total]
    return "/".join(max(fitting, key=lambda p: (len(p), p))) if total and fitting else ""


def infer(pages: list[str]) -> tuple[str, str]:
    """(wrapper expression, region path) of pages of one host."""
    return infer_constants(pages)[:2]


def infer_constants(pages: list[str]) -> tuple[str, str, list[str]]:
    """(wrapper expression, region path, keys of the template's texts) of pages of one host."""
    different = list(dict.fromkeys(pages))
    events = [_judged(_events(page)) for page in different]
    constants = constant_texts(events)
    return merged(fold(stream(page, constants)) for page in events), region_of(different), sorted(constants)


def merged(shapes: Iterator[list]) -> str:
    """The expression of a wrapper that describes all of the folded streams or wrappers; one that it describes already does not widen it."""
    wrapper: list = []
    told = ""
    for shape in shapes:
        plain = not any(isinstance(x, tuple) and x[0] == "?" for x in shape)
        if not wrapper or not (plain and matches(told, shape)):
            wrapper = align(wrapper, shape) if wrapper else shape
            told = expression(wrapper)
    return told


def main_text(
    page: str | None, region: str | None, wrapper: str | None = None, constants: frozenset[str] = frozenset()
) -> str:
    """Blocks of the page that are not beside the main text, joined by line ends.

    A page is left without the texts of the wrapper's constant slots, unless
    these are most of it: of all that it has where it matches the wrapper as a
    whole, else of those that fall on such slots when it is aligned. Outside
    the region, a block that is no heading and mostly links is a menu, but for a single
    paragraph between others. A page without the region is its own sample.
    """
    if not page:
        return ""
    events = _judged(_events(page))
    every = [e[1:] for e in events if e[0] == "block"]
    found = [b for b in every if not b[3]]
    if constants and wrapper:
        same = {i for i, b in enumerate(every) if not b[3] and text_key(b[0], b[1]) in constants}
        own = [b for i, b in enumerate(every) if not b[3] and i not in same]
        most = 2 * sum(len(b[1]) - b[2] for b in own) >= sum(len(b[1]) - b[2] for b in found)
        # The wrapper is only needed where it decides something.
        if own and same and most:
            items = stream(events, constants)
            if not matches(wrapper, fold(items)):
                slots = [i for i, item in enumerate(items) if item in ("#same", "#text")]
                aligned = template_slots(wrapper, items)
                own = [b for i, b in enumerate(every) if not b[3] and not (i in same and slots[i] in aligned)]
            found = own
    labels = tuple(region.split("/")) if region else ()
    if not labels or not any(at[: len(labels)] == labels for at, *_ in found):
        region = region_of([page])
        labels = tuple(region.split("/")) if region else ()
    menu = [at[: len(labels)] != labels and 2 * of_links > len(text) and not any(_tag(x) in HEADINGS for x in at) for at, text, of_links, _ in found]
    alone = [not any(menu[max(0, i - 1) : i] + menu[i + 1 : i + 2]) and _tag(found[i][0][-1] if found[i][0] else "") == "p" for i in range(len(found))]
    return "\n".join(b[1] for b, links, single in zip(found, menu, alone, strict=True) if not links or single)


def _path_id(path: tuple[str, ...]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(path).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_PARSED = (
    "host string, page long, drawn long, total long, slots array<struct<path:long,texts:long,keys:array<string>>>, "
    "weights array<struct<labels:array<string>,size:long>>, items binary"
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What inference needs of every page: its slots, the weights of its containers and its stream, with keys for texts."""
    kinds = {
        "total": pa.int64(),
        "slots": pa.list_(pa.struct({"path": pa.int64(), "texts": pa.int64(), "keys": pa.list_(pa.string())})),
        "weights": pa.list_(pa.struct({"labels": pa.list_(pa.string()), "size": pa.int64()})),
        "items": pa.binary(),
    }
    for batch in batches:
        out: dict[str, list] = {name: [] for name in kinds}
        for page in batch["html"]:
            events = _judged(_events(page.as_py()))
            slots = []
            for path, texts in slots_of(events).items():
                keys = [text_key(path, text) for text in texts]
                slots.append({"path": _path_id(path), "texts": _path_id(tuple(texts)), "keys": list(dict.fromkeys(keys))})
            weight, total = container_weights(e[1:5] for e in events if e[0] == "block")
            items = (f"#{text_key(e[1], e[2])}" if e[0] == "block" else stream([e])[:1] for e in events)
            words = (w for item in items for w in ([item] if isinstance(item, str) else item))
            out["total"].append(total)
            out["slots"].append(slots)
            out["weights"].append([{"labels": [_clean(x) for x in p], "size": n} for p, n in weight.items()])
            out["items"].append(zlib.compress(" ".join(words).encode("utf-8", "replace"), 1))
        yield pa.record_batch({c: batch[c] for c in ("host", "page", "drawn")} | {c: pa.array(v, kinds[c]) for c, v in out.items()})


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded stream of every page as an expression; slots with one of the keys of its host are the template's."""
    for batch in batches:
        shapes = []
        for items, keys in zip(batch["items"], batch["keys"], strict=True):
            same = _key_set(keys.as_py() or b"")
            words = zlib.decompress(items.as_py()).decode().split(" ")
            shapes.append(expression(fold([w if w[:1] != "#" else "#same" if w[1:] in same else "#text" for w in words if w])))
        yield pa.record_batch({"host": batch["host"], "drawn": batch["drawn"], "shape": pa.array(shapes, pa.string())})


@lru_cache(64)
def _key_set(keys: bytes) -> frozenset[str]:
    return frozenset(keys.decode().split())


def _merge(key: tuple, shapes: pd.DataFrame) -> pd.DataFrame:
    ordered = shapes.sort_values(["drawn", "shape"], kind="stable")
    wrapper = merged(list(parse(shape)) for shape in ordered["shape"])
    return pd.DataFrame({"host": [key[0]], "drawn": [ordered["drawn"].iloc[0]], "shape": [wrapper]})


def _wrappers(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, drawn, shape) with one wrapper for all shapes of a host, merged in parts of bounded size, and these again."""
    while True:
        counts = shapes.groupBy("host").agg(F.count("*").alias("shapes"))
        most = counts.agg(F.max("shapes")).first()[0] or 0
        part = F.pmod(F.xxhash64("shape"), F.ceil(F.col("shapes") / PART_SHAPES))
        dealt = shapes.join(counts, "host").withColumn("part", part).drop("shapes")
        shapes = scratch.write(dealt.groupBy("host", "part").applyInPandas(_merge, "host string, drawn long, shape string"))
        if most <= PART_SHAPES:
            return shapes


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, region, constants, packed, pages) of every host, from all of its different pages.

    Every page is parsed where it lies. Constant slots and the region are counted over all pages of a host with partial
    aggregation; the different shapes of its pages are aligned in parts, and the wrappers of these again, so a host with a third of all pages is in no
    single task. Packed is the compressed wrapper and its constant texts, where it has any.
    """
    rows = pages.where("html is not null and html <> ''").select(
        host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), F.xxhash64("url", "html").alias("drawn"), "html"
    )
    with Scratch(pages.sparkSession, "html") as scratch:
        parsed = rows.where("host is not null").mapInArrow(_parsed, _PARSED)
        first = [F.min_by(c, "drawn").alias(c) for c in ("total", "slots", "weights", "items")]
        parsed = scratch.write(parsed.groupBy("host", "page").agg(F.min("drawn").alias("drawn"), *first))
        slots = parsed.select("host", F.explode("slots").alias("slot")).select("host", "slot.*")
        constant = (
            slots.groupBy("host", "path")
            .agg(F.count("*").alias("pages"), F.min("texts").alias("least"), F.max("texts").alias("most"))
            .where((F.col("pages") >= CONSTANT_PAGES) & (F.col("least") == F.col("most")))
            .select("host", "path")
        )
        keys = slots.join(constant, ["host", "path"], "left_semi").select("host", F.explode("keys").alias("key")).distinct()
        constants = scratch.write(keys.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("constants")))
        of_host = constants.select("host", F.concat_ws(" ", "constants").cast("binary").alias("keys"))
        shapes = parsed.select("host", "drawn", "items").join(of_host, "host", "left").select("host", "drawn", "items", "keys")
        shapes = shapes.mapInArrow(_shapes, "host string, drawn long, shape string")
        wrappers = _wrappers(scratch.write(shapes.groupBy("host", "shape").agg(F.min("drawn").alias("drawn"))), scratch)
        totals = parsed.groupBy("host").agg(F.sum("total").alias("total"), F.count("*").cast("int").alias("pages"))
        weights = parsed.select("host", F.explode("weights").alias("w")).groupBy("host", "w.labels").agg(F.sum("w.size").alias("size"))
        fitting = weights.join(totals, "host").where(F.col("size") >= REGION_PART * F.col("total"))
        deepest = fitting.groupBy("host").agg(F.max(F.struct(F.size("labels").alias("n"), "labels"))["labels"].alias("labels"))
        found = (
            wrappers.join(totals, "host").join(deepest, "host", "left").join(constants, "host", "left")
            .select("host", F.col("shape").alias("wrapper"), F.coalesce(F.concat_ws("/", "labels"), F.lit("")).alias("region"), "constants", "pages")
        )
        schema = "host string, wrapper string, region string, constants array<string>, packed binary, pages int"
        return save(found.mapInArrow(_packed, schema), "html-wrappers")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [
            zlib.compress("\n".join((wrapper, *constants)).encode("utf-8", "replace")) if constants else None
            for wrapper, constants in zip(batch["wrapper"].to_pylist(), batch["constants"].to_pylist(), strict=True)
        ]
        columns = {c: batch[c] for c in ("host", "wrapper", "region", "constants")}
        yield pa.record_batch(columns | {"packed": pa.array(packed, pa.binary()), "pages": batch["pages"]})


@lru_cache(256)
def _unpacked(packed: bytes) -> tuple[str, frozenset[str]]:
    """(wrapper, constants)."""
    wrapper, *constants = zlib.decompress(packed).decode().split("\n")
    return wrapper, frozenset(constants)


def _extract(columns: tuple[str, ...], page: str, region: str, packed: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for values in zip(*(batch[c] for c in (page, region, packed)), strict=True):
                html_, of_host, wrapper = (v.as_py() for v in values)
                texts.append(main_text(html_, of_host, *(_unpacked(wrapper) if wrapper else ())))
            yield pa.record_batch({c: batch[c] for c in columns} | {text: pa.array(texts, pa.string())})

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``.

    Blocks of text follow in page order, one a line, without menus, headers,
    footers, adverts, forms, scripts, comments and the like; an element that holds most of the
    page's text is never taken for a form. A page is matched
    against the wrapper of its host, or else aligned with it; slots with the template's
    text are left out too, unless they are most of the page. Outside the
    region, the container that holds most of the host's text, blocks of links
    are left out. A null or empty html gives an empty text. A page whose region
    is missing, as of a host with a null url, is taken as a sample of its own.
    Repeated rows and ids are all kept, an empty table gives no rows, further
    columns are ignored.
    """
    host, *of_host = (fresh(c) for c in ("host", "region", "packed"))
    wrappers = infer_wrappers(pages.select("url", "html"))
    wrappers = wrappers.select(
        F.col("host").alias(host), *(F.col(c).alias(n) for c, n in zip(("region", "packed"), of_host, strict=True))
    )
    rows = (
        pages.select(F.col(id_col), "url", "html")
        .withColumn(host, host_of(F.col("url")))
        .join(wrappers, host, "left")
        .select(id_col, "url", "html", *of_host)
    )
    schema = rows.select(id_col, "url", F.lit("").alias("text")).schema
    found = rows.mapInArrow(_extract((id_col, "url"), "html", *of_host, "text"), schema)
    return found.withColumn("n_chars", F.length("text").cast("long"))
