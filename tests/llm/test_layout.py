"""Blocks inside items and cells, depth without bound, code and signs that no rule touches."""

import pytest

from locusmith.llm import markup as M


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p title="the hidden life">Seen text</p>', "Seen text"),
        ('<a href="/hidden/page.html">link text</a>', "link text"),
        ('<div class="menu">Home</div><nav>Up</nav><p>x', "Home\n\nUp\n\nx"),
        ("<select><option>a<option>b</select><textarea>c</textarea>", "a b c"),
        ("<ul><li>a<pre>x = 1\n  y</pre></li><li>b</ul>", "- a\n  ```\n  x = 1\n    y\n  ```\n- b"),
        ("<ul><li><div><ul><li>a<li>b</ul></div><li>c</ul>", "-\n  - a\n  - b\n- c"),
        ("<ul><li>t<div><ul><li>a<li>b</ul></div><li>c</ul>", "- t\n  - a\n  - b\n- c"),
        ("<ul><li><p>a</p><p>b</p></ul>", "- a\n  b"),
        ("<ol start=5><li>a<li>b<li value=9>c<li>d</ol>", "5. a\n6. b\n9. c\n10. d"),
        ("<p>call <code>f(a**b**c)</code> now", "call `f(a**b**c)` now"),
        ("<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>dd<td>e</table><tr><td>f<td>g</table>", "a | b  | c\n  | dd | e\nf | g"),
        ("<table><tr><td>a<td><pre>x\n  **y**</pre></table>", "a | ```\n  | x\n  |   **y**\n  | ```"),
        ("<table><tr><td>**a**<td>b</table>", "a | b"),
        ("<p>a == b, c != d", "a == b, c != d"),
        ("<pre>if a == b: '''c'''\n\n[[d|e]] \\emph{f}</pre>", "```\nif a == b: '''c'''\n\n[[d|e]] \\emph{f}\n```"),
        ("<p>costs $5 and $6 {ok}", "costs $5 and $6 {ok}"),
    ],
)
def test_rendered(page, text):
    assert M.rendered(page) == text


@pytest.mark.parametrize("text", ["If a == b, c != d.", "If a<=b and n==m, go.", "It costs $5 and $6 {ok} now.", "See {a note} there."])
def test_meant(text):
    assert M.cleaned(text) == (text, [])


@pytest.mark.parametrize("depth", [210, 3000])
def test_scripts_below_any_depth(depth):
    page = "<div>" * depth + "<script>var a = 1;</script><p>x</p>" + "</div>" * depth + "<ul>" * depth + "<li>y"
    assert M.rendered(page).split() == ["x", "-", "y"]
