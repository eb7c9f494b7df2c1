"""Retrieval, metrics, gate, rate limits and lint against hand-computed cases and brute force."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from locusmith.operators import gate, lint, metrics, ratelimit, retrieval
from locusmith.streaming import ratelimit as stream


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


def test_top_k_is_the_same_shared_and_in_pairs_of_blocks(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 40)
    data = [(f"v{i:03}", [float(rng.randrange(-1, 2)) for _ in range(3)], "x") for i in range(150)] + [("w0", None, "x"), ("w1", [1.0], "x"), ("w2", [0.0] * 3, "x")]
    items = spark.createDataFrame(data, "vec_id string, embedding array<double>, query string").repartition(5)
    queries = items.where("vec_id < 'v050' AND exists(embedding, x -> x <> 0)").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    asked = {r["query"]: r["vector"] for r in queries.collect()}
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / sum(x * x for x in a) ** 0.5 / sum(x * x for x in b) ** 0.5, 12)
    want = []
    for q, v in asked.items():
        best = sorted((-cosine(v, e), i) for i, e, _ in data if e and len(e) == 3 and any(e) and i != q)[:6]
        want += [(q, rank, i) for rank, (_, i) in enumerate(best, 1)]
    for shared in (1 << 20, 30):
        assert rows(retrieval.top_k(items, queries, 6, block=7, shared=shared), "query", "rank", "vec_id") == sorted(want)


def test_top_k_matches_brute_force_over_blocks(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=5).tolist()) for i in range(80)] + [(80, None), (81, [0.0] * 5), (82, [1.0])]
    data += [(90 + i, data[i][1]) for i in range(5)]  # ties
    items = vectors(spark, data)
    queries = items.where("vec_id % 10 = 0 AND vec_id < 80").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    got = rows(retrieval.top_k(items, queries, 7, block=3), "query", "rank", "vec_id")
    usable = {i: np.array(v, dtype=np.float32).astype(float) for i, v in data if v and len(v) == 5 and any(v)}
    want = []
    for q in range(0, 80, 10):
        scored = sorted((-round(float(usable[q] @ v / np.linalg.norm(usable[q]) / np.linalg.norm(v)), 12), i) for i, v in usable.items() if i != q)
        want += [(q, r + 1, i) for r, (_, i) in enumerate(scored[:7])]
    assert got == sorted(want, key=repr)
    assert retrieval.top_k(items.limit(0), queries, 3).count() == 0
    assert retrieval.top_k(items, queries.limit(0), 3).count() == 0


def test_fidelity(spark):
    x, y, z, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.9994, 0.0346, 0.0]
    same = spark.createDataFrame([(i, v, v) for i, v in enumerate([x, y, z, near])], "id int, reference array<double>, exported array<double>")
    row = retrieval.fidelity(same, 2).first()
    assert row["agreement"] == 1.0 and abs(row["perturbation"]) < 1e-12
    with pytest.raises(Exception, match="probes"):
        retrieval.fidelity(same, 4).collect()


RANKED = "question_id string, rank int, units array<string>"
QUESTIONS = "question_id string, expected array<string>, slice string"


def test_question_scores(spark):
    ranked = [("a", 1, []), ("a", 2, ["x", "y"]), ("a", 12, ["z"]), ("b", 1, ["q"]), ("c", 1, ["x"])]
    questions = [("a", ["y", "z", "y"], "s"), ("b", ["w"], "s"), ("c", [], "s"), ("d", ["x"], "t"), ("e", None, "t")]
    got = metrics.question_scores(spark.createDataFrame(ranked, RANKED), spark.createDataFrame(questions, QUESTIONS))
    assert rows(got, "question_id", "`recall@5`", "`full-recall@10`", "`full-recall@20`", "`MRR@10`") == [("a", 1.0, 0.0, 1.0, 0.5), ("b", 0.0, 0.0, 0.0, 0.0), ("d", 0.0, 0.0, 0.0, 0.0)]


def test_slices_list_empty_ones(spark):
    questions = spark.createDataFrame([("a", ["x"], "same-language")], QUESTIONS)
    scores = metrics.question_scores(spark.createDataFrame([("a", 1, ["x"])], RANKED), questions)
    got = {(r["slice"], r["metric"]): (r["n"], r["mean"]) for r in metrics.slice_means(scores, questions).collect()}
    assert got["all", "recall@5"] == (1, 1.0) and got["cross-lingual", "recall@5"] == (0, None)


def test_intervals(spark):
    data = [("one", 1.0), ("const", 0.5), ("const", 0.5), *[("mix", float(i % 2)) for i in range(40)]]
    got = {r["g"]: r for r in metrics.mean_intervals(spark.createDataFrame(data, "g string, value double"), ["g"], resamples=999).collect()}
    assert got["one"]["status"] == "singleton" and got["one"]["low"] is None
    assert (got["const"]["low"], got["const"]["high"]) == (0.5, 0.5)
    assert got["mix"]["low"] < 0.5 < got["mix"]["high"] and abs(got["mix"]["high"] - got["mix"]["low"] - 0.3) < 0.06
    with pytest.raises(ValueError):
        metrics.mean_intervals(spark.createDataFrame(data, "g string, value double"), ["g"], resamples=0)
    with pytest.raises(Exception, match="finite"):
        metrics.mean_intervals(spark.createDataFrame([("g", math.nan)], "g string, value double"), ["g"]).collect()


@pytest.mark.parametrize(("values", "want"), [([1, 0, 0, 0], 32), ([1], None), ([0, 0], None), ([1, 1], None), ([1.0, 0.9], 2)])
def test_required_n(spark, values, want):
    df = spark.createDataFrame([(float(v),) for v in values], "d double")
    assert df.agg(metrics.required_n(F.col("d"))).first()[0] == want


def test_comparison(spark):
    data = [(i, q, "s", v) for i, vs in {"m": [1, 0, 1], "n": [1, 1, 0], "o": [0, 0, 0]}.items() for q, v in zip("abc", map(float, vs))]
    df = spark.createDataFrame(data, "identity string, question_id string, slice string, value double")
    row = metrics.compared(df).where("slice = 'all'").first()
    assert (row["first"], row["second"], row["gains"], row["losses"], row["required_n"]) == ("m", "n", "c", "b", None)
    full = df.withColumns({"corpus_hash": F.lit("c"), "gold_hash": F.lit("g")})
    assert metrics.require_comparable(full).count() == 9
    with pytest.raises(ValueError):
        metrics.require_comparable(full.where("identity = 'm'"))
    with pytest.raises(ValueError):
        metrics.require_comparable(full.where("NOT (identity = 'm' AND question_id = 'a')"))


SEGMENTS = "answer_id string, segment int, kind string, text string, citations array<string>, locator string"
CONTEXT = "answer_id string, locator string, text string, edition string, url string, position int"


def brute_gate(segments, context, limits):
    units = {c[1]: c for c in sorted(context, key=lambda c: c[5])}
    codes, alive = {}, []
    for s in segments:
        if s[2] == "quotation":
            u = units.get(s[5])
            code = "quotation_unknown_locator" if not u else "quotation_not_exact" if s[3] not in u[2] else "quotation_too_long" if len(s[3]) > limits.max_chars else "quotation_missing_attribution" if limits.attribution and not (u[3] and u[4]) else None
            codes[s[1]] = code
            alive += [s] if code is None else []
    for loc in {s[5] for s in alive}:
        own = [s for s in alive if s[5] == loc]
        if units[loc][2] and sum(len(s[3]) for s in own) / len(units[loc][2]) > limits.unit_share:
            for s in own:
                codes[s[1]] = "quotations_exceed_unit_ratio"
                alive.remove(s)
    prose = sum(len(s[3]) for s in segments if s[2] != "quotation")
    while alive:
        quoted = sum(len(s[3]) for s in alive)
        if prose + quoted == 0 or quoted / (prose + quoted) <= limits.answer_share:
            break
        codes[alive.pop()[1]] = "quotations_exceed_answer_ratio"
    return codes


def test_gate_matches_the_loop(spark):
    rng = random.Random(8)
    limits = gate.Limits(max_chars=12, answer_share=0.3, unit_share=0.6)
    segments, context, want = [], [], []
    for a in range(120):
        units = [(str(a), f"u{i}", "abcdefghij" * rng.randrange(0, 4), rng.choice(["e", None, ""]) if rng.random() < 0.2 else "e", "http", i) for i in range(3)]
        units.append((str(a), "u0", "abcdefghijabcdefghij", "e", "http", 9))
        own = []
        for n in range(rng.randrange(1, 8)):
            if rng.random() < 0.6:
                own.append((str(a), n, "quotation", rng.choice(["abc", "abcdef", "bcdefghij", "xyz", "abcdefghijabcdef", ""]), None, rng.choice(["u0", "u1", "u2", "u9"])))
            else:
                own.append((str(a), n, rng.choice(["claim", "connective"]), "p" * rng.randrange(0, 30), ["u0", "u9"] if rng.random() < 0.5 else ["u9"], None))
        segments += own
        context += units
        want += [(str(a), n, c) for n, c in brute_gate(own, units, limits).items()]
    sdf, cdf = spark.createDataFrame(segments, SEGMENTS), gate.context_map(spark.createDataFrame(context, CONTEXT))
    assert rows(gate.judged_quotations(sdf, cdf, limits), "answer_id", "segment", "code") == sorted(want, key=repr)
    found = gate.violations(sdf, cdf, limits)
    status = {r["answer_id"]: r["status"] for r in gate.verdicts(sdf, found).collect()}
    fatal = {r["answer_id"] for r in found.where("fatal").collect()}
    assert {a for a, s in status.items() if s == "failed"} == fatal and set(status.values()) == {"failed", "repaired", "pass"}
    kept = gate.repaired_segments(sdf, cdf, limits)
    assert not {r["answer_id"] for r in kept.collect()} & fatal
    assert gate.gate_metrics(sdf, found).first()["quotations"] == len(want)


def test_gate_nulls(spark):
    sdf = spark.createDataFrame([("a", 0, "claim", None, None, None), ("b", 0, "quotation", None, None, "u"), ("c", 0, "connective", "x", None, None)], SEGMENTS)
    cdf = spark.createDataFrame([("b", "u", None, None, None, 0)], CONTEXT)
    found = gate.violations(sdf, cdf)
    assert rows(found, "answer_id", "code") == [("a", "claim_without_citation"), ("b", "quotation_missing_attribution")]
    assert rows(gate.verdicts(sdf, found), "answer_id", "status") == [("a", "failed"), ("b", "repaired"), ("c", "pass")]


T0 = datetime(2024, 1, 1)
LOG = "event_id long, ts timestamp, user_id long, kind string"


def test_rate_limits_match_brute_force(spark, tmp_path):
    rng = random.Random(4)
    data = [(i, T0 + timedelta(seconds=rng.randrange(0, 400)), rng.randrange(3), rng.choice("xy")) for i in range(200)]
    df = spark.createDataFrame([*data, (900, None, 1, "x"), (901, T0, None, "x")], LOG)
    limit = ratelimit.Limit(3, 30)
    earlier, logged, times = [], [], {}
    for i, t, u, k in sorted(data, key=lambda r: (r[1], r[0])):
        group = times.setdefault((u, k), ([], []))
        for log, out in zip(group, (earlier, logged)):
            n = sum(x >= t - timedelta(seconds=30) for x in log)
            out.append((i, n < 3))
            if log is group[0] or n < 3:
                log.append(t)
    got = ratelimit.replayed(df, limit, "user_id", "kind")
    assert rows(got.where("event_id < 900"), "event_id", "allowed") == sorted(earlier, key=repr)
    assert rows(got.where("event_id >= 900"), "event_id", "allowed") == [(900, False), (901, False)]
    assert rows(ratelimit.replayed_logging_allowed(df, limit, "user_id", "kind"), "event_id", "allowed") == sorted(logged, key=repr)
    df.coalesce(1).write.parquet(str(tmp_path / "log"))
    arriving = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    run = stream.limited(arriving, limit, "user_id", "kind").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows(spark.read.schema(stream.OUT).parquet(str(tmp_path / "out")), "event_id", "allowed") == sorted(logged, key=repr)


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([(1, T0, 1, "x"), (2, T0 + timedelta(minutes=70), 1, "x"), (3, T0 + timedelta(hours=9), 1, "y")], LOG).coalesce(1).write.parquet(str(tmp_path / "log"))
    counts = stream.windowed_counts(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), "kind")
    run = counts.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("windowed").count() == 3


def test_honeypot(spark):
    df = spark.createDataFrame([("",), ("  \n",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(ratelimit.not_blank(F.col("t"))).collect()] == [False, False, False, True]


DOC = """# Title
> **TL;DR** short
[ok](b.md#part-1) [up](../../x.md) `[code](no.md)` ![pic](img/a%20b.png)
```
[not](no.md)
```
## Part
## Part
[own](#part-1) [bad](#nope) [away](https://e.example/#x)
"""


def test_lint(spark):
    docs = spark.createDataFrame([("docs/a.md", DOC), ("docs/b.md", "# Part\n# Part\n[a](a.md)"), ("docs/c.md", None)], "path string, content string")
    assert rows(lint.anchors(docs.where("path = 'docs/a.md'")), "anchor") == [("part",), ("part-1",), ("title",)]
    assert rows(lint.anchor_checks(docs), "target", "verdict") == [("#nope", "broken"), ("#part-1", "ok"), ("b.md#part-1", "ok")]
    exists = spark.createDataFrame([("docs/a.md",), ("docs/b.md",)], "path string")
    assert rows(lint.broken_links(docs, exists), "target") == [("../../x.md",), ("img/a%20b.png",)]
    assert rows(lint.without_summary(docs)) == [("docs/b.md",), ("docs/c.md",)]
    assert rows(lint.not_indexed(docs.select("path"), docs.where("path <> 'docs/c.md'"))) == [("docs/c.md",)]
    report = {r["rule"]: r for r in lint.report(docs, exists).collect()}
    assert report["link"]["violations"] == 2 and report["anchor"]["violations"] == 1 and not report["link"]["vacuous"]
    assert all(r["vacuous"] for r in lint.report(docs.limit(0), exists).collect())
    guide = spark.createDataFrame([("g", "## `m.py` and more\n`n.py`")], "path string, content string")
    modules = spark.createDataFrame([("src/m.py",), ("src/n.py",), ("src/__init__.py",)], "path string")
    assert rows(lint.without_walkthrough(modules, guide)) == [("n.py",)]
