"""Look-alikes and markup residue: what is one form, what stays, and pages rendered with their structure."""

import pytest
from conftest import rows

from locusmith.llm import confusables as C
from locusmith.llm import markup as M


@pytest.mark.parametrize(
    ("a", "b"),
    [("é", "e\u0301"), ("аlаzаt", "alazat"), ("a\u200bb\u00adc\ufeff", "abc"), ("ａｂｃ，１", "abc,1"), ("a\u00a0b\u3000c\u2005d", "a b c d"), ("ﬁnis ﬃ", "finis ffi"), ("ⅯⅭⅠ", "MCI"), ("x\u037e", "x;"), ("a\u2011b", "a-b"), ("ő", "o\u030b"), ("ν", "v"), ("", "")],
)
def test_same_look(a, b):
    assert C.skeleton(a) == C.skeleton(b)
    assert C.one_form(C.one_form(a)) == C.one_form(a)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("æ", "ae"), ("x²", "x2"), ("¹", "1"), ("a,", "a;"), ("ő", "ö"), ("ab", "a b"), ("œ", "oe"), ("„", "“"), ("½", "1/2")])
def test_other_look(a, b):
    assert C.skeleton(a) != C.skeleton(b)


def test_every_look_alike_is_one_character():
    likes = [x for group in C.LOOK_ALIKES.values() for x in group]
    assert all(len(x) == 1 and ord(x) > 127 for x in likes)
    assert len(C.LOOK_ALIKES) < 200


def test_pairs_against_brute_force(spark):
    left = [(1, "s:1", "hu", "аbc", "x"), (2, "s:1", "hu", "abc", "x"), (3, "s:1", "la", "аbc", "x"), (4, "s:2", "hu", " \u00a0", "x"), (5, None, "hu", "аbc", "x"), (6, "s:1", "hu", None, "x"), (7, "s:1", "hu", "abd", "x"), (8, "s:3", "hu", "ｘ" * 50_000, "x")] * 2
    right = [(10, "s:1", "hu", "abc", "y"), (11, "s:1", "hu", "abс", "y"), (12, "s:2", "hu", "  ", "y"), (13, "s:3", "hu", "x" * 50_000, "y"), (14, None, "hu", "abc", "y")]
    a = spark.createDataFrame(left, "context_id long, locator string, language string, text string, unit_id string")
    b = spark.createDataFrame(right, "unit_id long, locator string, language string, text string, context_id string")
    want = sorted({(i, j) for i, l, g, t, _ in left for j, m, h, u, _ in right if l == m and l and g == h and t and u and t != u and C.skeleton(t) == C.skeleton(u) and C.skeleton(t).strip()})
    assert rows(C.same_look_pairs(a, b, "context_id", "unit_id", ["locator", "language"])) == want
    assert C.same_look_pairs(a.limit(0), b, "context_id", "unit_id", ["locator", "language"]).count() == 0
    sizes = {r["unit_id"]: (r["members"], r["texts"]) for r in C.look_classes(b, "unit_id", ["language"]).collect()}
    assert sizes[10] == (3, 2) and sizes[13] == (1, 1) and 12 not in sizes


@pytest.mark.parametrize(
    "text",
    [
        "If a < b and b > c, then order is lost.",
        "Where a<b and c>d, leaf 801 is read twice.",
        "The tablet is 1270'' high, bread&salt; oil comes later.",
        "The tablet is 8²'' high.",
        "The count was 5 * 3 * 2, item #2701, &c.",
        "#419 is the oldest leaf, and 3 -> 4 -> 5 its order.",
        "Write x_1 + x_2 = 2^2012 for the sum; field unit_no_366 was blank, so was A|B.",
        "The set {1, 2, 1360} is closed; stands in note 1467 [sic].",
        "The Q&A of year 797 was kept in C:\\archive\\old.",
        "The Q&A was kept in Ⅽ꞉\\archive\\old.",
        "The ledger gives $40 for the lamp and ~710 for oil.",
        "Rock & roll – „idézet” (vö. s:1).",
        "",
        "  ",
    ],
)
def test_signs_that_are_meant(text):
    assert M.cleaned(text) == (text, [])


@pytest.mark.parametrize(
    ("text", "clean", "kind"),
    [
        ("An <em>old</em> word.", "An old word.", "html"),
        ("a<br>b", "a\nb", "html"),
        ("word<sup><a name=-D>13</a></sup> end", "word[13] end", "html"),
        ("cut <p align=", "cut", "html"),
        ("cut <span class", "cut", "html"),
        ("He said &ldquo;so&rdquo;&nbsp;now &#8211; &amp;nbsp;yes", "He said “so” now – yes", "html"),
        ("The&nbsp shepherd", "The shepherd", "html"),
        ("a &lt;b&gt;b&lt;/b&gt; c", "a b c", "html"),
        ("x <!-- nav --> y", "x y", "html"),
        ("a **bold** b", "a bold b", "markdown"),
        ("a **bold b", "a bold b", "markdown"),
        ("a _b c_ d", "a b c d", "markdown"),
        ("a ~~b~~ c", "a b c", "markdown"),
        ("a `b` c", "a b c", "markdown"),
        ("## Title\n\nText.", "Title\n\nText.", "markdown"),
        ("> a\n> b", "a\nb", "markdown"),
        ("[word](https://g.example/1) on", "word on", "markdown"),
        ("![pic](fig8.png) on", "pic on", "markdown"),
        ("note[^78] on", "note on", "markdown"),
        ("x:\n* a\n* b", "x:\na\nb", "markdown"),
        ("a '''b''' c", "a b c", "wiki"),
        ("a [[b|c]] d", "a c d", "wiki"),
        ("a [[b c", "a b c", "wiki"),
        ("== T ==\nx", "T\nx", "wiki"),
        ("{{quote|a b}} c", "a b c", "wiki"),
        ("__NOTOC__\na", "a", "wiki"),
        ("a.\n[[Category:X y]]", "a.", "wiki"),
        ("\\emph{a} b", "a b", "latex"),
        ("h\\'es \\ae{} x", "hés æ x", "latex"),
        ("a ``b'' c", "a “b” c", "latex"),
        ("a. \\cite{l9}", "a.", "latex"),
        ("a. $n \\le 54$", "a. n \\le 54", "latex"),
        ("a\\\\ b", "a\nb", "latex"),
        ("{\\em a b} c", "a b c", "latex"),
    ],
)
def test_leftover_markup(text, clean, kind):
    got, kinds = M.cleaned(text)
    assert got == clean and kind in kinds


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = 1 < 2;</script></head><body><div class="nav"><a href=x>nav</a></div>
<h2>Cím <b>kettő</b></h2><p>Első &amp; <em>má</em>sodik<br>sor<p>Implied end<ul><li>a<li>b<ul><li>c</ul></ul><ol><li>x</li><li>y</li></ol>
<table><tr><th>n<th>név<tr><td>12<td>x</table><pre><code>if (a &lt; b) {
    c();
}</code></pre><p>n<sub>0</sub> = 10<sup>12</sup> <math><mi>a</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math></p>
<blockquote>quoted</blockquote><p style="display:none">hidden</p><!-- c --><p>A ''wiki'' \\emph{word}</p></body></html>"""


def test_rendered_page():
    assert M.rendered(PAGE) == "\n\n".join(
        [
            "nav",
            "## Cím kettő",
            "Első & második\nsor",
            "Implied end",
            "- a\n- b\n  - c",
            "1. x\n2. y",
            "n  | név\n12 | x",
            "```\nif (a < b) {\n    c();\n}\n```",
            "n_0 = 10^{12} a = 1/2",
            "> quoted",
            "A wiki word",
        ]
    )


def test_rendering_survives_anything():
    for page in ("", " ", "<", "<p", "</p></div>", "<table><td>a", "<li>x<p>y</ul>", "<div>" * 5000 + "x", "a" * 300_000, "<b>" * 3000 + "y" + "</b>" * 3000):
        assert isinstance(M.rendered(page), str)
    assert M.rendered("<div>" * 5000 + "x").strip() == "x"


def test_markup_frames(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "a **b**", "k"), (3, "a **b**", "k")], "context_id long, text string, kinds string")
    assert rows(M.clean_texts(df, "context_id")) == [(1, None, []), (2, "", []), (3, "a b", ["markdown"]), (3, "a b", ["markdown"])]
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x")], "page_id long, html string")
    assert rows(M.clean_pages(pages)) == [(1, None), (2, ""), (3, "x")]
