"""Cuts told by the whole text, and by rates that hold at every number of texts."""

import random

import pytest
from conftest import rows

from locusmith.llm import truncation

DOCUMENTS = "doc_id long, text string, source string, genre string"
WORDS = "the lamp of a quiet garden opens every old gate and keeps some bread for each guest".split()


def prose(rng, n):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(n))


@pytest.mark.parametrize("n", [3, 20, 2000])
@pytest.mark.parametrize("line", ["The old garden", "Every quiet lamp of the old gate", "Some bread for"])
def test_different_texts_cut_at_the_same_line(spark, n, line):
    rng = random.Random(n)
    data = [(i, prose(rng, 4) + "\n" + prose(rng, 3), "s", "homily") for i in range(200)]
    data += [(500 + i, prose(rng, 3) + f"\n\n{c}", "s", "homily") for i, c in enumerate(["Amen", "Here ends part one", "Finis"] * 12)]
    data += [(1000 + i, prose(rng, 4) + "\n" + line, "s", "homily") for i in range(n)]
    found = {r[0] for r in rows(truncation.cut_documents(spark.createDataFrame(data, DOCUMENTS)), "doc_id")}
    assert found == {1000 + i for i in range(n)}


LEFT_OPEN = {
    "quote": "He said “come to the old gate.\n\nThe lamp opens.",
    "low quote": "He said „come to the old gate.\n\nThe lamp opens.",
    "straight": 'He said "come to the old gate.\nThe lamp opens.',
    "bracket": "The gate (see the lamp.\n\nThe guest keeps bread.",
    "tags": "<div><b>The gate.\nThe lamp opens.",
    "fence": "The gate:\n```\nx = 1.\n\ny = 2.",
    "environment": "The gate \\begin{quote} opens.\nThe lamp keeps it.",
    "escape": "The ga\\u00\nThe lamp opens.",
}


def test_open_before_the_last_line(spark):
    rng = random.Random(1)
    data = [(i, prose(rng, 3), "s", "homily") for i in range(200)] + [(1000 + k, t, "s", "homily") for k, t in enumerate(LEFT_OPEN.values())]
    assert rows(truncation.cut_documents(spark.createDataFrame(data, DOCUMENTS)), "doc_id") == [(1000 + k,) for k in range(len(LEFT_OPEN))]


WHOLE = [
    "„A (b) “c” d” e.", "„A“, said the guest.", "“A.\n\n“B.”", 'The "lamp" is 5" wide.', "a) lamp\nb) gate.", "If a<b and c>d.", "On [0, 1) the gate opens.",
    "<p>The <b>lamp</b><br>opens.", "```\nx = (1.\n```\nThe gate.", "\\begin{quote}x\\end{quote}.", "\\{ the gate.", "The lamp’s gate.", "caf\\u00e9 opens.", "Tildes ~~~ opens.",
]


@pytest.mark.parametrize("text", WHOLE)
def test_nothing_is_left_open(text):
    assert truncation.left_open(text) == []


def test_a_habit_of_the_source_is_no_evidence(spark):
    rng = random.Random(3)
    data = [(i, prose(rng, 2) + " «The lamp opens.", "careless", "homily") for i in range(60)] + [(i, prose(rng, 2), "careful", "homily") for i in range(100, 200)]
    data += [(900, prose(rng, 2) + " «The lamp opens.", "careful", "homily"), (901, prose(rng, 2) + " (The lamp opens.", "careless", "homily")]
    assert rows(truncation.cut_documents(spark.createDataFrame(data, DOCUMENTS)), "doc_id") == [(900,), (901,)]


def test_closing_line_cut_inside(spark):
    rng = random.Random(4)
    data = [(i, prose(rng, 3) + "\n" + f"Given on the feast of {'harbour' if i % 2 else 'summer'}", "s", "letter") for i in range(60)] + [(i, prose(rng, 4), "s", "letter") for i in range(100, 200)]
    data += [(900, prose(rng, 3) + "\nGiven on the feast of", "s", "letter"), (901, prose(rng, 3) + "\nGiven on the feast of harb", "s", "letter")]
    assert rows(truncation.cut_documents(spark.createDataFrame(data, DOCUMENTS)), "doc_id") == [(900,), (901,)]


def test_no_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, " ", "s", None)], DOCUMENTS)
    assert truncation.cut_documents(df).count() == 0 and truncation.cut_documents(df.limit(0)).count() == 0
