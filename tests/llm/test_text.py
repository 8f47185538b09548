"""Text operators: accuracy on held-out rows, exact verification, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from svmflow.llm.cgk_decontam import ItemIndex, contamination, decontaminated, edit_distance, edits_allowed
from svmflow.llm.language_zstd import identify_language
from svmflow.llm.quality_resampling import kth_largest, quality_documents, quality_sample
from svmflow.llm.shingling import plain_words
from svmflow.llm.toxicity_fm import FactorizationMachine, toxicity
from svmflow.llm import wrapper_html
from svmflow.llm.wrapper_html import expression, extract_text, fold, infer, infer_constants, main_text, matches, parse, region_of

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, "12 34 !!", "en", None, 8),
    (5, "x" * 300_000, "en", "a", 1), (6, "ab " * 100_000, "en", "a", 1), (None, "one two", "en", "a", 7),
    (7, "same", "en", "a", 4), (7, "same", "en", "a", 4),
]


def words(text):
    return next(plain_words(pa.array([text])))


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_edit_distance_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        assert edit_distance(a, b) == plain_distance(a.tolist(), b.tolist())


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.1, 0.97), (0.2, 0.93)])
def test_recall_of_edited_items(rate, least):
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.expovariate(0.01))}" for _ in range(2_000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(15, 50))) for _ in range(150)]
    index = ItemIndex.of(list(range(len(items))), items)
    found = 0
    for i, item in enumerate(items):
        text = item.split()
        for _ in range(int(rate * len(text))):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        around = rng.choices(vocabulary, k=31)
        hits = index.found(words(" ".join(around + text + around)))
        found += i in hits
        assert all(e <= edits_allowed(len(items[k].split())) for k, e in hits.items())
    assert found >= least * len(items)


@pytest.mark.parametrize("n", [8, 9, 10, 11, 12, 13, 14, 15, 20, 31])
def test_recall_of_short_items(n):
    rng = random.Random(n)
    vocabulary = [f"w{int(rng.expovariate(0.01))}" for _ in range(2_000)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for _ in range(40)]
    index = ItemIndex.of(list(range(len(items))), items)
    for i, item in enumerate(items):
        for edits in range(edits_allowed(n) + 1):
            text = item.split()
            for k in range(edits):
                at = rng.randrange(len(text))
                text[at : at + k % 2] = [rng.choice(vocabulary)]
            for before in (30, 31):
                around = rng.choices(vocabulary, k=before)
                hits = index.found(words(" ".join(around + text + around)))
                assert hits[i] <= edits


def test_leaks_in_tables(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "only three words"), (5, item)], "item_id long, text string")
    rows = [
        (10, f"before it {item.upper()}, after it", "en", "a", 1), (11, f"x {item.replace('lazy', 'idle')} y", "en", "a", 1),
        (12, "the quick brown fox is not here", "en", "a", 1), (13, "so Only three words. here", "en", "a", 1), *ODD,
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in contamination(docs, bench).collect()}
    assert got[10]["item_ids"] == [1, 5] and got[10]["edits"] == 0
    assert got[11]["item_ids"] == [1, 5] and got[11]["edits"] == 1
    assert got[13]["item_ids"] == [4] and not got[12]["contaminated"]
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert contamination(spark.createDataFrame([], DOCS), bench).count() == 0
    assert decontaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    rows = [(100 + i, "the cat and the dog " * (i % 5 + 1), "en", "a", 1) for i in range(30)]
    rows += [(200 + i, "der hund und die katze " * (i % 5 + 1), "de", "a", 1) for i in range(30)]
    got = identify_language(spark.createDataFrame(rows + ODD, DOCS)).collect()
    assert len(got) == len(rows) + len(ODD)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by_id[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and by_id[6] in ("en", "de")
    assert by_id[101] == "en" and by_id[201] == "de"
    unknown = identify_language(spark.createDataFrame([(1, "text", None, None, None)], DOCS)).collect()
    assert unknown[0]["lang_pred"] == "und"
    assert identify_language(spark.createDataFrame([], DOCS)).count() == 0


def test_language_of_long_texts_only(spark):
    rng = random.Random(1)
    english, italian = (
        ["".join(rng.choices(syllables.split(), k=rng.randint(1, 4))) for _ in range(2_000)]
        for syllables in ("the ing ow th ea sh and er ough wh", "zio gli ne ca sa \u00e8 vi ri tto lla")
    )
    rows = [(i, " ".join(rng.choices(english, k=300)), "en", "a", 1) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choices(italian, k=3_000)), "it", "b", 1) for i in range(12)]
    assert all(len(r[1]) > 1 << 14 for r in rows[60:])
    got = identify_language(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r["doc_id"] >= 100, r["lang_pred"]) for r in got} == {(False, "en"), (True, "it")}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit >= 0.75 * sum(r["toxic"] for r in got)
    assert hit >= 0.9 * sum(r["predicted"] for r in got)


def test_pairs_count_beyond_single_terms():
    """Neither term alone is toxic, both together are: no additive weights can tell."""
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(4) < 0.5) for _ in range(600)]
    labels = np.array([float((0 in x) == (1 in x)) for x in rows])
    machine = FactorizationMachine(np.arange(4))
    machine.fit(rows, labels)
    assert np.mean([(machine.margin(x) > 0) == y for x, y in zip(rows, labels, strict=True)]) > 0.95


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (7, 0, 5)], "doc_id long, quality int, toxic int")
    got = toxicity(spark.createDataFrame(ODD, DOCS), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert toxicity(spark.createDataFrame([], DOCS), labels).count() == 0
    assert {r["score"] for r in toxicity(spark.createDataFrame(ODD, DOCS), labels.limit(0)).collect()} == {0.5}


def test_quality_keeps_good_and_drops_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_sample(docs, labels)
    joined = got.join(labels, "doc_id").collect()
    good = [r["kept"] for r in joined if r["quality"] == 1]
    junk = [r["kept"] for r in joined if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.3
    kept = quality_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] for r in got.where("kept").collect())


def test_kth_largest(spark):
    values = [3.0, -1.5, 3.0, 7.25, 0.0, 1e-9, 2.0]
    scored = spark.createDataFrame([(v,) for v in values], "k double")
    for k in range(1, len(values) + 1):
        assert kth_largest(scored, "k", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(scored, "k", 0) == float("inf")


def test_quality_edges(spark):
    labels = spark.createDataFrame([(6, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(ODD, DOCS)
    assert quality_sample(docs, labels).count() == len(ODD)
    assert quality_sample(docs, labels.limit(0)).where("kept").count() > 0
    assert quality_sample(docs.limit(0), labels).count() == 0
    assert quality_documents(docs.limit(0), labels).count() == 0


PAGE = (
    "<html><body><div id='top-menu'>Home</div><header>Site</header><div class=content><h2>T &amp; U</h2>"
    "<p>One\n <b>two</b>&nbsp;three<p>Four<br>five<script>var x='<p>no</p>'</script><aside>See also</aside>"
    "<div class='user-comments'><p>Nice!</div><form>Mail</form><!-- c --></div><footer>Foot</footer></body></html>"
)


def test_main_text_of_messy_pages():
    assert region_of([PAGE]) == "html/body/div.content"
    assert main_text(PAGE, "html/body/div.content") == "T & U\nOne two three\nFour five"
    assert main_text(PAGE, "html/body/div.other") == "T & U\nOne two three\nFour five"
    assert main_text(None, "x") == main_text("", None) == ""
    assert main_text("just text &lt;3 <", None) == "just text <3 <"


def test_title_and_lead_outside_the_body(spark):
    body = "".join(f"<p>sentence {i} of the long text</p>" for i in range(20))
    text = "\n".join(f"sentence {i} of the long text" for i in range(20))
    page = "<html><body><div><a href=/>Start</a> <a href=/b>Shop</a></div><article><h1><a href=/{0}>Title {0}</a></h1>"
    page += "<p>Lead {0}</p><div class=body>" + body + "</div></article></body></html>"
    other = "<html><body><article><p>Teaser</p></article><div class=story><h1>Story</h1>" + body + "</div></body></html>"
    assert main_text(page.format(1), None) == "Title 1\nLead 1\n" + text
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(6)] + [(6, "http://h.org/6", other)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nLead {i}\n{text}" for i in range(6))
    assert got[6] == "Teaser\nStory\n" + text


def test_template_text_is_left_out_of_matching_pages(spark):
    page = "<html><body><div class=top><p>Welcome to this site of ours</p></div>{1}<article><h1>Title {0}</h1>"
    page += "".join(f"<p>sentence {i} of page {{0}}</p>" for i in range(9)) + "<p>The end.</p></article></body></html>"
    texts = ["\n".join([f"Title {k}", *(f"sentence {i} of page {k}" for i in range(9)), "The end."]) for k in range(6)]
    pages = [page.format(i, "<h2>New</h2>" if i % 2 else "") for i in range(6)]
    wrapper, region, constants = infer_constants(pages[:5])
    assert "<p> #same" in wrapper and "( <p> #text )+" in wrapper and expression(parse(wrapper)) == wrapper
    assert main_text(pages[0], region, wrapper, frozenset(constants)) == texts[0]
    strange = pages[5].replace("<article>", "<table><tr><td>cell</td></tr></table><article>")
    # An option that no sampled page had: the page is aligned, and what falls on the template's slots goes.
    assert main_text(strange, region, wrapper, frozenset(constants)) == texts[5].replace("Title 5", "New\ncell\nTitle 5")
    moved = "<html><body><article><h1>Other</h1><p>Text of its own kind</p></article><div class=top><p>Welcome to this site of ours</p></div></body></html>"
    assert main_text(moved, region, wrapper, frozenset(constants)).startswith("Other\nText of its own kind")
    rows = [(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(texts))
    same = [p.replace("page ", "the one page") for p in [page.format(7, "")]] * 4
    assert "sentence 8" in main_text(same[0], *infer(same))


def test_pages_match_with_and_without_options():
    wrapper = "a ( b c )? ( d )? ( e )+ ( f )?"
    for page in ("abcdEf", "aE", "adE", "abcE", "aEf"):
        assert matches(wrapper, [("+", ("e",)) if x == "E" else x for x in page])
    for page in ("", "a", "abE", "acE", "aEE", "adbcE", "ae"):
        assert not matches(wrapper, [("+", ("e",)) if x == "E" else x for x in page])


@pytest.mark.parametrize("name", ["w-2/3", "has-sidebar", "content-sidebar-wrap", "comments-open", "social-science", "social"])
def test_names_do_not_empty_pages(name):
    start = f"<html><body><div class='sidebar'><p>Side</p></div><div class='footer-links'>Foot</div><div class='{name}'>"
    page = start + "<h1>Title</h1><p>All of the main text stands in here</p><div id='post-comments'>Nice</div></div></body></html>"
    _, region = infer([page])
    assert region == "html/body/div." + name.replace("/", "%2F")
    assert main_text(page, region) == main_text(page, None) == "Title\nAll of the main text stands in here"
    long = "<div class=comments>" + "<p>What a long comment this is</p>" * 9 + "</div>"
    assert main_text(f"<html><body><article><p>Short text</p></article>{long}</body></html>", None) == "Short text"


def test_forms_and_buttons_do_not_take_the_text_with_them():
    article = "<article><h1>Title</h1><p>All of the main text stands in here, and more of it</p></article>"
    login = "<form id=login><fieldset><label>Name</label><input><button>Log in</button></fieldset></form>"
    text = "Title\nAll of the main text stands in here, and more of it"
    for whole in ("<form id=aspnetForm method=post>{}</form>", "<dialog open>{}</dialog>", "<form><fieldset>{}</fieldset></form>"):
        assert main_text("<html><body>" + whole.format(login + article) + "</body></html>", None) == text
    assert main_text(f"<html><body>{login}{article}</body></html>", None) == text
    line = "<html><body><p>Press <button type=button><div>Start</div></button> to begin, <select><option>a<option>b</select> or wait.</p>{}</body></html>"
    assert main_text(line.format(""), None) == "Press to begin, or wait."
    assert main_text(line.format("<p>Never <button>closed</p><p>Next</p>"), None) == "Press to begin, or wait.\nNever\nNext"
    assert main_text("<button>a</button>", None) == main_text("<select><option>x", None) == ""
    assert main_text("<p>a</p><button>b</div></button><p>c</p>", None) == "a\nc"


def test_single_linked_paragraphs_stay():
    body = "".join(f"<p>sentence {i} of the long text</p>" for i in range(9))
    page = "<html><body><ul><li><a href=/>Start</a><li><a href=/b>Shop</a></ul><div class=lead><p><a href=/r>The whole report</a></p></div>"
    page += f"<article>{body}</article><p><a href=/1>One</a></p><p><a href=/2>Two</a></p></body></html>"
    assert main_text(page.replace("</ul>", "</ul><p>Opening words</p>"), None).startswith("Opening words\nThe whole report\nsentence 0")
    assert main_text(page, None).endswith("sentence 8 of the long text")


def test_wrappers_hold_repeats_and_options():
    assert fold(list("abababc")) == [("+", ("a", "b")), "c"]
    plain = "<html><body><ul><li>a<li>b</ul><article><p>some longer text</p><p>and more</p></article></body></html>"
    other = "<html><body><ul><li>a</li></ul><h2>n</h2><article><p>another long text</p><p>and more</p></article></body></html>"
    wrapper, region = infer([plain, other])
    assert region == "html/body/article"
    assert "( <li> #text )+" in wrapper and "( <p> #text )+" in wrapper
    assert "( <h2> #text </h2> )?" in wrapper and " | " not in wrapper
    assert expression(["a", ("?", ("b",))]) == "a ( b )?"


def test_wrappers_are_inferred_from_all_pages(spark, monkeypatch):
    """What only few of many pages of a host tell: a slot of the template on three, a text that differs on one, shapes merged in parts."""
    monkeypatch.setattr(wrapper_html, "PART_SHAPES", 3)
    rng = random.Random(2)
    pages = []
    for i in range(150):
        parts = [f"<h1>Title {i}</h1>", "<p class=hint>Read all of it in print</p>" if i != 77 else "<p class=hint>Only here another hint</p>"]
        parts += ["<div class=offer>Order the yearbook by mail</div>"] * (i in (20, 70, 140))
        body = [f"<{t}>{t} number {i} {k} has words of its own</{t}>" for k, t in enumerate(rng.choices(["p", "h2", "pre", "blockquote"], k=6))]
        pages.append(f"<html><body><article>{''.join(parts + body)}</article></body></html>")
    rows = [(i, f"http://h.org/{i}", page) for i, page in enumerate(pages)] + [(500, "http://h.org/again", pages[20]), (600, "http://few.org/", pages[20])]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    host = {r["host"]: r for r in wrapper_html.infer_wrappers(docs).collect()}
    _, region, constants = infer_constants(pages)
    assert (host["h.org"]["region"], host["h.org"]["constants"], host["h.org"]["pages"]) == (region, constants, 150)
    assert host["few.org"]["constants"] is None and host["few.org"]["pages"] == 1
    streams = [wrapper_html.stream(wrapper_html._judged(wrapper_html._events(page)), frozenset(constants)) for page in pages]
    assert all(matches(host["h.org"]["wrapper"], fold(s)) for s in streams)
    text = {r["page_id"]: r["text"] for r in extract_text(docs).collect()}
    assert "yearbook" not in text[20] + text[70] + text[140] + text[500] and "yearbook" in text[600]
    assert "another hint" in text[77] and all("all of it in print" in text[i] for i in range(150) if i != 77)


def test_extract_edges(spark):
    rows = [
        (1, "http://h.org/1", PAGE, 1), (2, "http://h.org/2", None, 1), (3, None, PAGE, 1), (4, "http://h.org/4", "", 1),
        (5, "http://h.org/5", "<article>" + "<p>word</p>" * 5_000, 1), (1, "http://h.org/1", PAGE, 1), (None, "no host", "<p>x", 1),
    ]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, region int")).collect()
    assert sorted(r["n_chars"] for r in got) == sorted([29, 0, 29, 0, 24_999, 29, 1])
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
