"""Unicode's table of look-alikes as it is used: what it folds, what stays apart, and pairs against cases written by hand."""

import unicodedata

import pytest
from conftest import rows

from locusmith.llm import confusables as C


@pytest.fixture(scope="module")
def drawing(spark):
    return C.Drawing(C.joined_looks(spark))


FOLDED = ["𝐚a", "ᎪA", "ꓐB", "ⲞO", "ɩi", "ⲟo", "ɡg", "ⅿm", "ᴋк", "кk", "ІI", "ӏl", "ꓳO", "𝟘0", "𝟏1", "ΜM", "ᏟC", "ΚK", "ｗw", "\u2003 "]
APART = [("1", "l"), ("0", "O"), ("I", "l"), ("m", "rn"), ("æ", "ae"), ("œ", "oe"), ("“", '"'), ("’", "'"), ("²", "2"), ("ç", "c"), ("ç", "c\u0326"), ("ø", "o"), ("ő", "ö"), ("А", "а"), ("–", "-"), ("…", "..."), ("½", "1/2"), ("ʰ", "h"), ("ē", "e")]


@pytest.mark.parametrize("pair", FOLDED)
def test_folded(drawing, pair):
    assert C.skeleton(pair[0], drawing) == C.skeleton(pair[1], drawing)


@pytest.mark.parametrize(("a", "b"), APART)
def test_apart(drawing, a, b):
    assert C.skeleton(a, drawing) != C.skeleton(b, drawing)


def test_every_letter_keeps_its_form(drawing):
    """The form of a form is the form; no letter of ASCII and no accent of it moves."""
    for code in range(0x20, 0x250):
        form = C.one_form(chr(code), drawing)
        assert C.one_form(form, drawing) == form
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii():
            assert form == chr(code)
    assert 1000 < len(drawing.joined) < 10_000
    for code in drawing.joined:
        assert C.skeleton(C.skeleton(chr(code), drawing), drawing) == C.skeleton(chr(code), drawing), hex(code)


def test_pairs_and_forms(spark):
    left = spark.createDataFrame([(1, "s:1", "hu", "Ꭺz út"), (2, "s:1", "hu", "Az út"), (3, "s:1", "hu", "az út"), (4, "s:1", "la", "Az út"), (5, "s:1", "hu", None)], "context_id long, locator string, language string, text string")
    right = spark.createDataFrame([(10, "s:1", "hu", "Az út"), (11, "s:1", "hu", "Az\u00a0u\u0301t"), (12, "s:1", "hu", "")], "unit_id long, locator string, language string, text string")
    assert rows(C.same_look_pairs(left, right, "context_id", "unit_id", ["locator", "language"])) == [(1, 10), (1, 11), (2, 11)]
    assert rows(C.one_formed(left, "context_id")) == [(1, "Az út"), (2, "Az út"), (3, "az út"), (4, "Az út"), (5, None)]
    assert rows(C.one_formed(right, "unit_id")) == [(10, "Az út"), (11, "Az út"), (12, "")]
    assert C.one_formed(right.limit(0), "unit_id").count() == 0
