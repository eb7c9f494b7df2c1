"""Leftover markup as elements of a tree: what it holds, what is hidden, crossing and lost ends, and tables."""

import pytest

from locusmith.llm import markup as M


def marked(*parts):
    """Text with element marks: ("b", 0, True) opens element 0, ("b", 0, False) ends it."""
    return "".join(p if isinstance(p, str) else chr((M.STARTS if p[1] else M.ENDS_AT) + p[0]) for p in parts)


def test_tree_of_marks():
    names = ["b", "a", "hidden"]
    tree = M.grown(marked("x", (0, True), "y", (1, True), "z", (1, False), (0, False), (2, True), "w"), names)
    assert [c if isinstance(c, str) else c.name for c in tree.children] == ["x", "b", "hidden", "w"]
    assert [c if isinstance(c, str) else c.name for c in tree.children[1].children] == ["y", "a"]
    assert M.visible_text(tree) == "xyzw"


@pytest.mark.parametrize(
    "parts",
    [
        [(0, True), "a", (1, True), "b", (0, False), "c", (1, False)],  # crossing
        [(0, True), "a", "b", "c"],  # no end
        ["a", "b", (0, False), "c"],  # no start
        [],
    ],
)
def test_broken_trees_lose_no_text(parts):
    assert M.visible_text(M.grown(marked(*parts), ["b", "a"])) == "".join(p for p in parts if isinstance(p, str))


def test_rules_needs_and_elements_go_together():
    assert len(M.RULES) == len(M.NEEDS) == len(M.BUILDS)


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("| a | n |\n|---|---|\n| bcd | 11 |\n\nText.", "a   | n\nbcd | 11\n\nText."),
        ("| **a** | [b](c) |\n|:-:|--|\n| `d` | e < f |\nend", "a | b\nd | e < f\nend"),
        ('{| class="x"\n! a !! b\n|-\n| c || d\n|-\n| align="left" | e\n| f\n|}\nend', "a | b\nc | d\ne | f\nend"),
        ('{| class="x"\n|-\n| one cell only', "one cell only"),
        ("''a **b'' c**", "a b c"),
        ("x [[Category:Y]] z \\cite{k}", "x z"),
    ],
)
def test_kept_text(text, clean):
    got, kinds = M.kept(text)
    assert got == clean and kinds


def test_very_many_elements():
    assert M.kept("**a** " * 3000)[0] == ("a " * 3000).strip()
    assert M.cleaned("*a* " * (M.MARKS + 10))[0] == ("a " * (M.MARKS + 10)).strip()
