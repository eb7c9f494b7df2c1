"""What is found is restored or marked lost, and the search of long runs comes to its end by itself."""

import random

import pytest
from test_encoding import PAGES, bits, corpus, misread

from locusmith.llm import encoding as E

NEAR_REFERENCES = ["&#9;Ã©ta", "&nbsp;Ã©s", "Ã©&nbsp;s", "&ldquo;Ã©s&rdquo;", "&#0000195;&#169;s", "„Ã©s”", "&eacute;Ã©s", "&rsquo;Ã\xadt"]
RESTORED = ["&#9;éta", "&nbsp;és", "é&nbsp;s", "&ldquo;és&rdquo;", "és", "„és”", "&eacute;és", "&rsquo;ít"]


def test_damage_beside_references(spark):
    pages = spark.createDataFrame(corpus() + [(5000 + i, f"<p>z {x} k</p>", "hu", "x") for i, x in enumerate(NEAR_REFERENCES)], PAGES)
    got = {r["page_id"]: (r["html"], r["lost"]) for r in E.repaired_pages(pages, E.damage(pages)).collect()}
    assert got == {5000 + i: (f"<p>z {x} k</p>", False) for i, x in enumerate(RESTORED)}


def test_every_found_page_is_restored_or_lost(spark):
    rng = random.Random(8)
    codecs = ["latin-1", "cp1252", "cp1250", "iso8859-2", "cp437", "cp852", "mac-roman"]
    words = "szőlő kőudvar őszi erdő élő törvény lélek œconomia æternitas naïve „vég” – garden".split()
    data, written = corpus(), {}
    for i in range(200):
        text = " ".join(rng.choice(words) for _ in range(12))
        at = rng.randrange(0, len(text) // 2)
        part = text[at : at + rng.randrange(8, 40)]
        damaged = misread(part, rng.choice(codecs))
        if damaged != part:
            written[6000 + i] = f"<p>{text}</p>"
            data.append((6000 + i, f"<p>{text[:at]}{damaged}{text[at + len(part) :]}</p>", "hu", "x"))
    pages = spark.createDataFrame(data, PAGES)
    got = {r["page_id"]: (r["html"], r["lost"]) for r in E.repaired_pages(pages, E.damage(pages)).collect()}
    before = {row[0]: row[1] for row in data}
    assert set(got) <= set(written)
    assert all(lost or text != before[i] for i, (text, lost) in got.items())
    assert sum(got.get(i, ("",))[0] == text for i, text in written.items()) >= 0.95 * len(written)


def test_one_run_damaged_in_one_place_only():
    spots = [("run", "m", "Ã©", "g", "é")]
    assert E.restore("mÃ©g MÃ©T", spots) == "még MÃ©T"


@pytest.mark.parametrize("codecs", [["latin-1"] * 4, ["cp1250", "cp852", "latin-1"], ["cp437", "mac-roman", "cp1251", "cp1252"]])
def test_long_runs_end(codecs):
    text = "őíűáéóú" * 40
    for codec in codecs:
        text = misread(text, codec)
    run = "".join(c for c in text if c > "\x7f")
    assert E.search(run, "", "", bits)[1]


def test_letters_are_searched_by_their_neighbours():
    assert E.search_letter("õ", {"õ": 1, "ő": 40}) == ("ő", True)
    assert E.search_letter("õ", {"õ": 3, "ő": 3}) == ("õ", False)
    assert E.search_letter("x", {"x": 1, "ő": 40}) == ("x", False)
