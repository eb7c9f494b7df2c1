"""Damage is proposed, found and put right in whatever notation its characters are written."""

import pandas as pd
import pytest
from test_encoding import PAGES, corpus

from locusmith.llm import encoding as E


def proposed(text):
    out = pd.concat(E.gather([pd.DataFrame({"page_id": [1], "html": [text], "language": ["en"]})]))
    return set(out[out.kind == "r"].a)


@pytest.mark.parametrize(
    "run",
    [
        "Ã©", "&Atilde;&copy;", "&#195;&#169;", "&#xC3;&#xa9;", "Ã&copy;", "&Atilde;©",
        "&amp;Atilde;&amp;copy;", "&amp;#195;&amp;#169;", "&amp;#xC3;&amp;#xA9;", "&amp;amp;Atilde;&amp;amp;copy;", "Ã&amp;copy;", "&amp;Atilde;©",
        "�", "&#65533;", "&#xFFFD;", "&#xfffd;", "&amp;#65533;", "\x92", "&#146;", "&#x92;", "&amp;#146;",
    ],
)
def test_every_notation_is_proposed(run):
    assert proposed(f"<p>mag{run}got</p>") == {run}


@pytest.mark.parametrize("text", ["<p>caf&eacute; &amp;eacute; &#233; &#8217; &#8211;x</p>", "<p>R&amp;D &amp; AT&T, &lt;b&gt;&lt;i&gt;</p>", "<p>&ldquo;&nbsp;x&#160;&#8221;</p>", "<p>&#1114112; &#9999999; &#99;</p>"])
def test_written_references_are_not_proposed(text):
    assert proposed(text) == set()


def test_pages_damaged_in_one_notation_only(spark):
    runs = {1: "&amp;Atilde;&amp;copy;", 2: "&amp;#195;&amp;#169;", 3: "&#146;", 4: "&#xFFFD;", 5: "&#65533;", 6: "&amp;#xC3;&amp;#xA9;"}
    pages = spark.createDataFrame(corpus() + [(2000 + i, f"<p>mag{run}got ’</p>", "hu", "x") for i, run in runs.items()] + [(3000, "<p>caf&eacute; &#8211; &amp;copy; 1</p>", "hu", "x")], PAGES)
    spots = E.damage(pages)
    fixed = {r["page_id"]: (r["html"], r["lost"]) for r in E.repaired_pages(pages, spots).collect()}
    good = ("<p>magégot ’</p>", False)
    assert fixed == {2001: good, 2002: good, 2006: good, 2003: ("<p>mag’got ’</p>", False), 2004: ("<p>mag&#xFFFD;got ’</p>", True), 2005: ("<p>mag&#65533;got ’</p>", True)}
