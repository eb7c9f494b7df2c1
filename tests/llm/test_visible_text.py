"""All visible text of a page is emitted: what hides an element, where a head ends, text between the parts of a table."""

import pytest

from locusmith.llm import markup as M


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'aria-hidden="false"', 'href="the-hidden-life.html"', 'title="The hidden well"', "class=hidden-not", 'title="display:none"'])
def test_shown(attributes):
    assert M.rendered(f"<p>a <a {attributes}>b</a> c") == "a b c"


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', "HIDDEN id=x", 'style="color:red; display: none"', "style='visibility:hidden'"])
def test_hidden(attributes):
    assert M.rendered(f"<p>a</p><div {attributes}>b</div><p>c") == "a\n\nc"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><meta name=x><h1>H</h1><p>a", "# H\n\na"),
        ("<head><title>T</title><script>var a = '<p>';</script><p>a", "a"),
        ("<head><title>T</title>a <b>b</b>", "a b"),
        ("<head><title>T<p>a", "a"),
        ("<head><noscript><img src=x>no</noscript><title>T</title></head><body><p>a", "a"),
        ("<table>loose <b>x</b><tr><td>a<td>b</table>", "loose x\na | b"),
        ("<table><tr>loose<td>a<td>b</tr></table>", "loose\na | b"),
        ("<table><tr><form><td>a</td><td>b</td></form></tr><tr><td>c</td></tr></table>", "a | b\nc"),
        ("<table><caption>C</caption><tbody><tr><th>a</th></tr></tbody><p>after</p></table>", "C\nafter\na"),
    ],
)
def test_no_text_is_lost(page, text):
    assert M.rendered(page) == text
