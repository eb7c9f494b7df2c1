"""Normalisation, links and page parsing on invented fragments."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from locusmith.functions import text as T
from locusmith.operators import links, pages


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression).first()[0]


@pytest.mark.parametrize(
    ("fragment", "want"),
    [
        ("<p>A (<em>b 1</em>)\n  c</p>", "A (b 1) c"),
        ("x<br>y<BR/>z", "x y z"),
        ("&amp;lt; &lt;b&gt; &quot;q&quot; &ldquo;&unknown;", '&lt; <b> "q" “&unknown;'),
        ("&#8220;a&#x201D; &#0; &#xD800; &#99999999999;", "“a” \x00 &#xD800; &#99999999999;"),
        ("é    f", "é f"),
        ('word<sup><a name=-28T href=#$28T>74</a></sup>.', "word."),
        ("", ""),
        (" \n ", ""),
    ],
)
def test_normalised(spark, fragment, want):
    assert one(spark, T.normalised(F.col("x"), T.FOOTNOTE_RAISED), x=fragment) == want


def test_normalised_null_and_long(spark):
    assert one(spark, T.normalised(F.col("x"), T.FOOTNOTE_NONE), x=None) is None
    assert len(one(spark, T.normalised(F.col("x"), T.FOOTNOTE_NONE), x="ő <i>a</i> " * 100_000)) == 4 * 100_000 - 1


def test_small_helpers(spark):
    assert one(spark, T.without_marker_residue(F.col("x")), x=". . Text.") == "Text."
    assert one(spark, T.folded_locator(F.col("x")), x="I&ordf;-IIae  q. 2,") == "I-II q. 2"
    assert one(spark, T.contents_spelling(F.col("x")), x="I q. 1 ad arg.") == "I q. 1 ad"
    assert one(spark, T.slug(F.col("x")), x=" [The *Next*](a.md) — Part <b>2</b>, ő_x ") == "the-next--part-2-ő_x"
    assert one(spark, T.source_of(F.col("x")), x="a:b:c") == "a"
    assert one(spark, T.article_of(F.col("x")), x="summa:pr") == "summa:pr"
    for n, want in ((7, "K0007"), (2345, "K2345"), (12345, "K12345")):
        assert spark.range(1).select(T.anchor_of(F.lit(n))).first()[0] == want


INDEX = """<a href="/b-2#x">x</a> <A HREF='/a-1'>y</A> <a href=/b-2>z</a> <a class=k href="/c-3?q">w</a>"""


def test_links(spark):
    df = spark.createDataFrame([(1, INDEX, "https://h.example/d/i.html"), (2, None, None), (3, "no links", "https://h.example/")], "page_id long, html string, base string")
    got = rows(links.page_links(df, links.discovery("any-path")), "page_id", "position", "slug")
    assert got == [(1, 1, "b-2"), (1, 2, "a-1"), (1, 3, "c-3")]
    assert rows(links.page_links(df, links.discovery("quoted-path")), "slug") == [("b-2",), ("c-3",)]
    assert rows(links.page_links(df, links.discovery("any-path-sorted")), "position", "slug") == [(1, "a-1"), (2, "b-2"), (3, "c-3")]
    assert rows(links.page_links(df, links.discovery("any-path"), base="base"), "url") == [("https://h.example/a-1",), ("https://h.example/b-2",), ("https://h.example/c-3",)]
    with pytest.raises(ValueError):
        links.discovery("nowhere")
    with pytest.raises(ValueError):
        links.require_pages(links.page_links(df.where("page_id = 3"), links.discovery("any-path")))


ANCHORED = """<html><div class="nav">x</div><div class="t article-content"><p><strong>1. Cikkely</strong></p>
<p><a name="K0001">1.</a> Az első <div>belső</div> szöveg.</p><p>2. Második.<a name="JB1" href="#J1">[1]</a></p><p><strong>Összefoglalás</strong></p>
<p>3. Harmadik.</p><p>9. nem jel</p><p>EGY CÍM</p><p>4. Negyedik.</p><p>Jegyzetek</p><p><a name="J1">1</a> jegyzet</p></div>lábléc</html>"""
SECOND = """<div class="article-content"><p>5. Ötödik.</p><p align="center">Cím középen</p><p><a name="56">6</a>. Hatodik</p></div>"""
BLOCK = """<hr noshade size="1"><p class=MsoNormal>12
One sentence.<br> 13 Two <sup><a name=-1 href=#$1>12</a></sup> more.</p><p class="MsoNormal"><b>IN BRIEF</b></p><p class=MsoNormal>14 Three.</p><HR WIDTH=30%><p><a name=$1>1</a> note <a name=$2>2</a></p><hr width=70%>"""


def page_frame(spark):
    data = [(1, "s", "hu", "p1", ANCHORED), (2, "s", "hu", "p2", SECOND), (3, "t", "en", "q1", BLOCK), (4, "s", "hu", "p3", '<div class="article-content"> never closed'), (5, "s", "hu", "p4", None)]
    return spark.createDataFrame(data, "page_id long, source_id string, language string, page string, html string").withColumn("family", pages.family_of(F.col("html")))


def test_numbered_units(spark):
    units = pages.numbered_units(page_frame(spark), ["source_id", "language"])
    got = rows(units.where("source_id = 's'"), "number", "text", "role")
    assert got == [
        (1, "Az első belső szöveg.", None),
        (2, "Második.", None),
        (3, "Harmadik. 9. nem jel", "summary"),
        (4, "Negyedik.", None),
        (5, "Ötödik.", None),
        (6, "Hatodik", None),
    ]


def test_block_units_and_footnotes(spark):
    scans = pages.scanned(page_frame(spark).where("family = 'block'"))
    assert rows(pages.footnote_balance(scans), "referenced", "defined", "undefined", "unreferenced") == [(1, 2, "", "2")]
    marks = rows(pages.marked(scans, ["page_id"]), "what", "printed", "inline", "in_brief")
    assert ("marker", 12, False, False) in marks and ("marker", 13, True, False) in marks and ("marker", 14, False, True) in marks


def test_sequence_runs_across_pages_and_rejects_strays(spark):
    marks = spark.createDataFrame([("d", "p1", 1, 1, "K0001"), ("d", "p1", 2, 3, None), ("d", "p1", 3, 2, None), ("d", "p2", 1, 3, None), ("d", "p2", 2, 9, "K0009"), ("d", "p2", 3, 4, None), ("d", "p2", 4, 10, None), ("e", "p1", 1, 1, None)], "doc string, page string, start int, printed int, anchor string").withColumn("what", F.lit("marker")).withColumn("sure", F.col("anchor").isNotNull()).withColumn("kind", F.lit(None).cast("string"))
    got = rows(pages.accepted_markers(marks, ["doc"], ["page", "start"]), "doc", "page", "printed", "accepted")
    assert got == sorted([("d", "p1", 1, True), ("d", "p1", 3, False), ("d", "p1", 2, True), ("d", "p2", 3, True), ("d", "p2", 9, True), ("d", "p2", 4, False), ("d", "p2", 10, True), ("e", "p1", 1, True)], key=repr)


def test_pages_without_body_or_units(spark):
    frame = page_frame(spark)
    scans = pages.scanned(frame.where("family IS NOT NULL"))
    assert rows(pages.without_body(scans), "page_id", "locator") == [(4, "page:p3")]
    units = pages.numbered_units(frame, ["source_id", "language"])
    assert rows(pages.unnumbered_pages(frame, units)) == [(4,), (5,)]
    kinds = dict(rows(pages.skipped_headings(scans).where("family = 'anchored'"), "skipped", "headings"))
    assert kinds == {"heading-bold": 1, "heading-in-brief": 1, "heading-allcaps": 1, "heading-centred": 1}


def test_in_brief_force_equals_ranges(spark):
    import random

    rng = random.Random(1)
    data, want = [], []
    for page in range(60):
        inside = False
        for at in range(rng.randrange(1, 12)):
            what = rng.choice(["label", "heading", "empty", "marker"])
            data.append((page, [(what, at, at, None, None, False, "bold", None)]))
            inside = {"label": True, "heading": False}.get(what, inside)
            want.append((page, at, inside))
    df = spark.createDataFrame(data, f"page_id int, marks array<{pages.MARK.simpleString()}>")
    assert rows(pages.marked(df, ["page_id"]), "page_id", "start", "in_brief") == sorted(want, key=repr)


TITLED = """<P TITLE="I q. 1 a. 1 arg. 1"><A NAME="101"><SPAN CLASS="ref">[101] I&ordf; q. 1 a. 1 arg. 1 </SPAN></A>Utrum <i>sit</i>.</P>
<p class=x title="I q. 1 a. 1 co.">Respondeo.</p><OPTION value="#101">Iª q. 1 a. 1 arg. 1' <OPTION value="#102">Iª q. 1 a. 1 sc.'"""


def test_titled_units_and_enumeration(spark):
    df = spark.createDataFrame([(1, TITLED), (2, '<p title="x">y</p>')], "page_id long, html string").withColumn("family", pages.family_of(F.col("html")))
    units = pages.titled_units(df, ["page_id"])
    assert rows(units.where("page_id = 1"), "label", "ref_number", "ref_label", "text") == [("I q. 1 a. 1 arg. 1", 101, "I q. 1 a. 1 arg. 1", "Utrum sit."), ("I q. 1 a. 1 co.", None, None, "Respondeo.")]
    assert rows(pages.enumeration_defects(df, units)) == [(1, "enumeration-mismatch", 2, 2, 1, 1), (2, "enumeration-absent", 0, 1, 0, 1)]


@pytest.mark.parametrize(
    ("label", "locator", "sequence"),
    [
        ("I q. 2 a. 3 arg. 1", "summa:I.q2.a3.arg1", [1, 2, 3, 1, 1]),
        ("II-II q. 48 pr.", "summa:II-II.q48.pr", [3, 48, 0, 0, 0]),
        ("III q. 1 a. 2 s. c.", "summa:III.q1.a2.sc", [4, 1, 2, 2, 0]),
        ("III q. 1 a. 2 s. c. 2", "summa:III.q1.a2.sc2", [4, 1, 2, 2, 2]),
        ("I q. 1 a. 1 ad arg.", "summa:I.q1.a1.adarg", [1, 1, 1, 4, 0]),
        ("I q. 1 a. 1 ad 3", "summa:I.q1.a1.ad3", [1, 1, 1, 4, 3]),
        ("I-II pr.", "summa:I-II.pr", [2, 0, 0, 0, 0]),
        ("Summa theologiae, pr.", "summa:pr", [0, 0, 0, 0, 0]),
        ("IV q. 1 pr.", None, None),
        ("I q. 1 a. 1 foo", None, None),
    ],
)
def test_addresses(spark, label, locator, sequence):
    row = spark.createDataFrame([(label,)], "x string").select(pages.address(F.col("x")).alias("a")).select(pages.address_locator(F.col("a")).alias("l"), pages.address_sequence(F.col("a")).alias("s")).first()
    assert (row["l"], row["s"]) == (locator, sequence)


def test_headings_in_force_against_a_walk(spark):
    import random

    rng = random.Random(2)
    data, want = [], []
    for page in range(80):
        q = a = None
        for at in range(rng.randrange(1, 10)):
            kind = rng.choice(["B", "D", "E", "G", None, None])
            number = rng.randrange(1, 9) if kind in ("D", "E") else None
            data.append((page, at, kind, number))
            if kind == "D":
                q, a = number, None
            elif kind == "G":
                a = None
            elif kind == "B":
                q = a = None
            elif kind == "E":
                a = number
            want.append((page, at, q, a))
    df = spark.createDataFrame(data, "page int, at int, kind string, number int")
    assert rows(pages.headings_in_force(df, ["page"]), "page", "at", "quaestio", "articulus") == sorted(want, key=repr)


@pytest.mark.parametrize(("text", "want"), [("hic quaeruntur decem et septem. primo", 17), ("Et quaeruntur quatuor.", 4), ("quaeruntur DUO", 2), ("nihil", None), ("quaeruntur multa", None)])
def test_stated_count(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(pages.stated_count(F.col("x"))).first()[0] == want


def test_article_shapes(spark):
    def units(article, *tails):
        return [("d", f"s:I.q1.{article}.{t}", None) for t in tails]

    data = units("a1", "arg1", "arg2", "sc", "co", "ad1", "ad2") + units("a2", "arg1", "arg3", "co", "ad1") + units("a3", "arg1", "ad1", "ad2", "ad3") + units("a4", "arg1", "arg1", "co")
    got = rows(pages.article_shapes(spark.createDataFrame(data, "doc string, locator string, role string"), ["doc"]), "article", "kind")
    assert got == [("s:I.q1.a2", "objections-not-contiguous"), ("s:I.q1.a3", "answer-absent"), ("s:I.q1.a3", "more-replies"), ("s:I.q1.a4", "objections-not-contiguous")]


def test_regions():
    assert pages.balanced_region('<div class="article-content">a<div>b</div>c</div>d') == "a<div>b</div>c"
    assert pages.balanced_region("<div>x</div>") is None
    assert pages.ruled_region("<HR SIZE=1 NOSHADE>a<hr width=\"70%\">b") == ("a", "")
    assert pages.ruled_region("a<hr>b") is None
    text = "szöveg Jegyzetek: <br> <a name=\"J1\">1</a>"
    assert text[pages.apparatus_start(text) :].startswith("Jegyzetek")
    assert pages.apparatus_start("nincs") == 5
    assert re.compile(pages.TITLED)
    with pytest.raises(ValueError):
        pages.family("x")
