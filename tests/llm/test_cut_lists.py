"""Verse and lists cut inside a word or after a word that ends no line, in small and in larger corpora."""

import pytest
from conftest import rows

from locusmith.llm import truncation

NOUNS = "lantern harvest river mercy shelter garment orchard witness vessel covenant".split()


def verse(i, last):
    lines = [f"the {NOUNS[(i + k) % 10]} of a {NOUNS[(i * 3 + k) % 10]}" for k in range(6)]
    return "\n".join(["A song", *lines, last])


@pytest.mark.parametrize("copies", [8, 60, 400])
def test_cut_inside_a_word_or_before_the_line_ends(spark, copies):
    data = [(i, verse(i, f"the {NOUNS[i % 10]} of a {NOUNS[(i + 1) % 10]}"), "s:1", "verse") for i in range(copies)]
    data += [(9001, verse(1, "the river and its lante"), "s:1", "verse"), (9002, verse(2, "the river of a harv"), "s:1", "verse"), (9003, verse(3, "the witness and the"), "s:1", "verse")]
    data += [(9004, verse(1, "the river and its lante"), "s:2", "verse")]  # a repeat under another id and source
    df = spark.createDataFrame(data, "doc_id long, text string, source string, genre string")
    assert rows(truncation.cut_documents(df), "doc_id") == [(9001,), (9002,), (9003,), (9004,)]
    rates = {r["source"]: r["cut_documents"] for r in truncation.cut_rates(df, truncation.cut_documents(df)).collect()}
    assert rates == {"s:1": 3, "s:2": 1}
