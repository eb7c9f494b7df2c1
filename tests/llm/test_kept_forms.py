"""Headings, lists, code blocks and formulas stay in the clean text, in one form whatever they were written in."""

import pytest
from conftest import rows

from locusmith.llm import markup as M


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("<h3>T</h3>Some *text*.", "### T\nSome text."),
        ("### T ###\nSome *text*.", "### T\nSome text."),
        ("=== T ===\nSome *text*.", "### T\nSome text."),
        ("T\n=====\nx", "# T\nx"),
        ("T\n-----\nx", "## T\nx"),
        ("\\section*{T} x", "# T\nx"),
        ("## **T** of [[a|b]]\n\nx", "## T of b\n\nx"),
        ("* a\n* b\n** c\n* d", "- a\n- b\n  - c\n- d"),
        ("+ a\n    - b\n+ c", "- a\n  - b\n- c"),
        ("- a\n  - b <em>x</em>\n- c", "- a\n  - b x\n- c"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
        ("<ol><li>a<li>b</ol>", "1. a\n2. b"),
        ("\\begin{itemize}\\item a \\item b\\end{itemize}", "- a\n- b"),
        ("\\begin{enumerate}\\item a\\item b\\end{enumerate} **c**", "1. a\n2. b\nc"),
        ("see **b**:\n```\nx = a**b**c\n\n# n_\n  - &lt;b&gt;\n```\n**end**", "see b:\n```\nx = a**b**c\n\n# n_\n  - &lt;b&gt;\n```\nend"),
        ("a\n~~~\nlocus 12\n~~~", "a\n```\nlocus 12\n```"),
        ("a\n```py\nx = '''s'''", "a\n```py\nx = '''s'''\n```"),
        ("a<pre>if (b &lt; c) {\n    d();\n}</pre>b", "a\n```\nif (b < c) {\n    d();\n}\n```\nb"),
        ("use `x = a**b**c` **now**", "use x = a**b**c now"),
        ("**a** x<sup>n+1</sup>", "a x^{n+1}"),
        ("**a** $x_{33} \\le 4$", "a x_{33} \\le 4"),
        ("\\begin{equation} a^{2} = b \\end{equation}", "a^{2} = b"),
    ],
)
def test_structure_stays(text, clean):
    got, kinds = M.kept(text)
    assert got == clean and kinds == M.cleaned(text)[1] != []


def test_formulas_of_pages():
    assert M.rendered("<p>10<sup>n+1</sup> <math><msup><mi>x</mi><mrow><mi>a</mi><mi>b</mi></mrow></msup></math> **b**") == "10^{n+1} x^{a b} b"


def test_structure_frames(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "== T ==\n* a\n* b"), (4, "- a")], "context_id long, text string")
    assert rows(M.clean_texts(df, "context_id").select("context_id", "clean")) == [(1, None), (2, ""), (3, "## T\n- a\n- b"), (4, "- a")]
