"""Token budgets, packing, mixing and truncation on small frames and against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from locusmith.llm import mixing, packing, tokens, truncation

CHUNKS = "chunk_id long, document_id string, source_id string, language string, strategy string, text string, kind string"
DOCS = "document_id string, source_id string, language string, kind string, text string"


def test_budget(spark):
    chunks = [(1, "d", "S ", "hun", "a@1", "egy kettő", "x"), (1, "d", "S ", "hun", "a@1", "egy kettő", "x"), (2, "d", None, None, "a@1", " ", "x"), (3, "d", "s", "hu", "b@1", "egy kettő három négy", "x"), (4, "zz", " S", "HU-hu", "a@1", "<|endoftext|> x", "x"), (5, None, None, None, None, "árva", None), (6, "d", "s", "hu", "a@1", None, "x")]
    docs = [("d", "s", "hu", "k", "y"), ("d", "s", "hu", "k", "y")]
    counted = tokens.counted_chunks(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(docs, DOCS))
    count = tokens.tokenizer(tokens.vocabulary_path()).encode_ordinary
    got = {r["chunk_id"]: r for r in counted.collect()}
    assert {i: r["tokens"] for i, r in got.items()} == {1: len(count("egy kettő")), 3: len(count("egy kettő három négy")), 4: len(count("<|endoftext|> x")), 5: len(count("árva"))}
    assert (got[4]["source"], got[4]["language"], got[4]["kind"]) == ("s", "hu", "k") and got[5]["source"] is None
    cube = {(r["source"], r["language"], r["kind"]): r for r in tokens.token_budget(counted).collect()}
    assert cube["s", "hu", "k"]["tokens"] == got[3]["tokens"] + got[4]["tokens"]
    assert cube["*", "*", "*"]["tokens_all_strategies"] == sum(r["tokens"] for r in got.values())
    assert cube["?", "*", "*"]["tokens"] == got[5]["tokens"]


@pytest.mark.parametrize("capacity", [1, 7, 64, 1000])
def test_sum_of_squares(capacity):
    rng = random.Random(capacity)
    items = [(i, rng.choice([rng.randrange(1, 12), rng.randrange(1, 3 * capacity + 1)])) for i in range(800)]
    placed, packer = packing.pack_all(items, capacity)
    fill, pieces = Counter(), defaultdict(list)
    for container, item, first, size in placed:
        fill[container] += size
        pieces[item].append((first, size))
    assert max(fill.values()) <= capacity and len(fill) == packer.made
    for item, size in items:
        own = sorted(pieces[item])
        assert sum(s for _, s in own) == size and len(own) == -(-size // capacity)
        assert [f for f, _ in own] == [k * capacity for k in range(len(own))]
    counts = Counter(v for v in fill.values() if v < capacity)
    assert {h: n for h, n in enumerate(packer.levels) if n} == dict(counts)


def test_sum_of_squares_rule():
    packer = packing.SumOfSquares(10)
    for size in (6, 6, 6, 4, 3):
        packer.place(size)
    # 4 closes one of three at level 6; 3 then opens a container (1 more) rather than leave level 6 twofold apart
    assert packer.levels[6] in (1, 2) and packer.levels.sum() * 1 == sum(len(c) for c in packer.open.values())
    with pytest.raises(ValueError):
        packing.SumOfSquares(0)


def test_packing_frames(spark, monkeypatch):
    rng = random.Random(1)
    data = [(i, rng.randrange(0, 400), "x") for i in range(900)] + [(1000, None, "x"), (1001, 5000, "x"), (1001, 7, "x")]
    items = spark.createDataFrame(data, "item_id long, tokens long, container_id string")
    total = sum(n or 0 for _, n, _ in data)
    for limit in (10_000, 200):
        monkeypatch.setattr(packing, "ITEMS_PER_PACKER", limit)
        placed = packing.packed(items, {"a": 512, "b": 64})
        report = {r["container_id"]: r for r in packing.fill_report(placed, {"a": 512, "b": 64}).collect()}
        for name, capacity in (("a", 512), ("b", 64)):
            assert report[name]["tokens"] == total and report[name]["fullest"] <= capacity
            assert report[name]["unused_share"] < 0.12
        assert rows(placed) == rows(packing.packed(items, {"a": 512, "b": 64}))
    assert packing.packed(items.limit(0), {"a": 512}).count() == 0


TARGETS = "mix_id string, source string, target_share double, max_repeats int, total_fraction double"


def test_mixing(spark):
    rng = random.Random(2)
    data = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), rng.randrange(1, 300), 0) for i in range(3000)] + [(9000, None, 50, 0), (9001, "big", None, 0), (9002, "mid", 0, 0)]
    records = spark.createDataFrame(data, "doc_id long, source string, tokens long, copies int")
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.2), ("m", "small", 0.4, 3, 0.2), ("m", "gone", 0.1, 2, 0.2), ("n", "mid", 1.0, 5, 1.0)], TARGETS)
    chosen, report = mixing.mixed(records, targets)
    total = sum(t for _, s, t, _ in data if t)  # a fraction of all tokens, those of records without a source included
    have = defaultdict(int)
    for _, s, t, _ in data:
        have[s] += t or 0
    got = {(r["mix_id"], r["source"]): r for r in report.collect()}
    for (mix, source), r in got.items():
        share, repeats, fraction = {("m", "big"): (0.5, 1, 0.2), ("m", "small"): (0.4, 3, 0.2), ("m", "gone"): (0.1, 2, 0.2), ("n", "mid"): (1.0, 5, 1.0)}[mix, source]
        wanted = share * fraction * total
        assert r["most_copies"] <= repeats
        assert r["reached_tokens"] <= wanted + 1e-6
        assert r["reached_tokens"] > min(wanted, repeats * have[source]) - 300
    # nested: a larger budget keeps what a smaller one chose
    more = mixing.mixed(records, targets.withColumn("total_fraction", F.col("total_fraction") * 1.3))[0]
    ids = lambda df: {(r["mix_id"], r["doc_id"], r["copies"]) for r in df.where("source = 'big'").collect()}
    assert ids(chosen) < ids(more)
    assert rows(chosen) == rows(mixing.mixed(records, targets)[0])
    none, empty = mixing.mixed(records.limit(0), targets)
    assert none.count() == 0 and {r["reached_tokens"] for r in empty.collect()} == {0}


DOCUMENTS = "doc_id long, text string, source string, genre string, word string"


def prose(rng, n):
    words = "the lamp of a quiet garden opens every old gate and keeps some bread for each guest".split()
    return " ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() + "." for _ in range(n))


def truncation_corpus():
    rng = random.Random(9)
    data, cut = [], set()
    closings = ["Amen", "Finis", "The editors of s", "(cf. s:12)"]
    for i in range(400):
        text = prose(rng, rng.randrange(1, 6))
        if i % 4 == 0:
            text += "\n\n" + closings[i // 4 % 4]
        data.append((i, text, "s", "homily", "x"))
    for i in range(400, 480):
        lines = [f"the {rng.choice(['lamp', 'gate', 'bread'])} – an old {rng.choice(['garden', 'guest', 'lamp'])}" for _ in range(rng.randrange(4, 9))]
        data.append((i, "\n".join(lines), "s", "glossary", "x"))
    tails = ["", " The lamp of a qui", " The old gate and", " “The lamp keeps", " (the lamp keeps bread.", " The lamp…", " The la...", " The lam [...]", " The l\\u00", " The lamp �", " The gate &nb", " The gate <em", " Every gue ", " The lamp,"]
    for k, tail in enumerate(tails):
        text = prose(rng, 3) + tail
        data.append((1000 + k, text, "t", "homily", "x"))
        if tail:
            cut.add(1000 + k)
    data.append((1100, data[-1][1], "t", "homily", "x"))
    cut.add(1100)
    data += [(1200, None, "t", "homily", "x"), (1201, " \n", None, None, "x"), (1202, prose(rng, 20_000) + " The la", None, None, "x"), (1203, "“" + prose(rng, 2) + "”", "t", "homily", "x")]
    cut.add(1202)
    return data, cut


def test_truncation(spark):
    data, cut = truncation_corpus()
    df = spark.createDataFrame(data, DOCUMENTS)
    found = truncation.cut_documents(df)
    assert {r["doc_id"] for r in found.collect()} == cut
    rates = {r["source"]: r for r in truncation.cut_rates(df, found).collect()}
    assert rates["s"]["cut_documents"] == 0 and rates["t"]["cut_documents"] == len(cut) - 1 and rates[None]["cut_documents"] == 1
    assert truncation.cut_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "state"), [("A “b (c) d” e.", "complete"), ("A (b.", "open"), ("A “b.", "open"), ("A.", "complete"), ("A.”", "complete"), ("A “b”", "bare"), ("A…", "mark"), ("x\n(cf. s:1)", "complete"), ("A ‘b.", "complete"), ("A\\", "escape")])
def test_end_state(text, state):
    assert truncation.end_state(text)[0] == state
