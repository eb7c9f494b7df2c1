"""Wrong encodings: exact round trips, traps that must stay, and the whole operator on small pages."""

import random

import pytest
from conftest import rows

from locusmith.llm import encoding as E

WORDS = "szőlő kőudvar őszi szűk erdő harang élő virrasztás törvény lélek œconomia æternitas prudentia the naïve garden".split()


def misread(text, read_as):
    return "".join(next((c for c, b in E.to_bytes(read_as).items() if b == byte), chr(byte)) if byte >= 128 else chr(byte) for byte in text.encode("utf-8"))


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp1250", "iso8859-2", "cp1251", "cp437", "cp852", "mac-roman"])
def test_decoding_is_undone(codec):
    text = "„Az őszi szűk, élő æ œ – álom”"
    assert E.decoded(codec, misread(text, codec)) == text
    assert E.decoded(codec, "plain ASCII & text") == "plain ASCII & text"


def bits(ch):
    return 0.0 if ch < "\x80" else {"Ã": 4.6, "â": 4.0, "€": 5.0, "Å": 5.0, "Ä": 6.0, "“": 0.7, "”": 0.7, "’": 1.5, "–": 0.5, "«": 0.1, "Â": 5.0}.get(ch, 1.0 if ch in "áéíóöőúüűæœÖ" else 9.0)


@pytest.mark.parametrize(
    ("run", "left", "right", "want"),
    [
        ("Ã©", "m", "g", "é"),
        ("ÃƒÂ©", "m", "g", "é"),
        ("Ã¢â‚¬â€œ", " ", " ", "–"),
        ("&Atilde;&copy;", "m", "g", "é"),
        ("&amp;Atilde;&amp;copy;", "m", "g", "é"),
        ("Ã–", " ", "s", "Ö"),
        ("Å‘Ã­", "d", "t", "őí"),
        ("\x96", " ", " ", "–"),
        ("&nbsp;Ã©", "z", "s", "&nbsp;é"),
    ],
)
def test_search_restores(run, left, right, want):
    assert E.search(run, left, right, bits) == (want, True)


@pytest.mark.parametrize(("run", "left", "right"), [("Ã”", "H", " "), ("“æ", " ", "t"), ("őí", "d", "t"), ("слово", " ", " "), ("λόγος", " ", "."), ("道", " ", " "), ("&eacute;&aacute;", "k", "r"), ("©", " ", " ")])
def test_search_leaves_what_was_meant(run, left, right):
    assert E.search(run, left, right, bits) == (run, False)


PAGES = "page_id long, html string, language string, extra string"


def corpus():
    rng = random.Random(6)
    data = [(i, "<p>" + " ".join(rng.choice(WORDS) for _ in range(60)) + " – „vég”</p>", "hu", "x") for i in range(300)]
    return data


def test_damage_and_repair(spark):
    clean = corpus()
    original = {1000 + k: f"<p>A szűk őszi kőudvar és az élő törvény – „vég” {k}</p>" for k in range(6)}
    data = list(clean)
    data += [(1000, misread(original[1000], "latin-1"), "hu", "x"), (1001, misread(original[1001], "cp1250"), None, "x")]
    data += [(1002, misread(misread(original[1002], "cp1252"), "cp1252"), "hu", "x"), (1003, original[1003].encode("cp1250").decode("cp1252"), "hu", "x")]
    data += [(1004, original[1004].replace("élő", "&Atilde;&copy;l&Aring;&lsquo;"), "hu", "x"), (1005, original[1005].encode("cp1250").decode("utf-8", "replace"), "hu", "x")]
    data += [(2000, "<p>Az észt „sõna” és „õnn” szó, MANHÃ and NÃO</p>", "hu", "x"), (2001, None, "hu", "x"), (2002, "", None, "x"), (2003, "x" * 200_000, "en", "x")]
    data += data[-8:]
    pages = spark.createDataFrame(data, PAGES)
    spots = E.damage(pages)
    assert {r[0] for r in spots.select("page_id").distinct().collect()} == set(original)
    fixed = {r["page_id"]: r for r in E.repaired_pages(pages, spots).collect()}
    for k in (1000, 1001, 1002, 1003, 1004):
        assert fixed[k]["html"] == original[k] and not fixed[k]["lost"]
    assert fixed[1005]["lost"]


def test_no_pages(spark):
    assert E.damage(spark.createDataFrame([], PAGES)).count() == 0
    assert rows(E.damage(spark.createDataFrame([(1, None, None, None)], PAGES))) == []
