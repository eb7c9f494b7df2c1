"""Reports, what a fidelity measurement says, fetching through a reader, and the embedding loop."""

import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from locusmith.functions import vectors
from locusmith.operators import metrics, reports, retrieval
from locusmith.sources import fetch, files


def report(spark, identity="m@onnx:1", corpus="c", value=0.5):
    intervals = spark.createDataFrame([("all", "MRR@10", 2, value, 0.1, 0.9, "percentile-bootstrap"), ("none", "MRR@10", 0, None, None, None, "empty")], "slice string, metric string, n int, mean double, low double, high double, status string")
    questions = spark.createDataFrame([("q2", "all", 1.0), ("q1", "all", 0.0)], "question_id string, slice string, `MRR@10` double")
    truncation = spark.createDataFrame([("s", 10, 2)], "source_id string, passages int, truncated int")
    return reports.made(identity, corpus, "g", intervals, questions, {"p50": 1.5, "p95": 2.25}, truncation, ["q9"])


def test_report_round_trip_and_text(spark, tmp_path):
    one, two = report(spark), report(spark, "n@onnx:2")
    assert reports.from_json(reports.as_json(one)) == one
    comparison = [{"slice": "all", "first": "m", "second": "n", "n": 2, "mean_difference": 0.125, "required_n": None}]
    paths = reports.write(tmp_path / "out", "20260101T000000Z", one, comparison, [two])
    assert sorted(p.name for p in paths) == ["20260101T000000Z.comparison.json", "20260101T000000Z.json", "20260101T000000Z.md"]
    text = paths[1].read_text(encoding="utf-8")
    for part in ("| all | MRR@10 | 2 | 0.5000 | 0.1000 | 0.9000 | percentile-bootstrap |", "| none | MRR@10 | 0 | – | – | – | empty |", "| q1 | all | 0.0000 |", "p95: 2.25 ms", "| s | 10 | 2 |", "`c`", "q9", "0.1250"):
        assert part in text
    assert text.index("| q1 |") < text.index("| q2 |")
    assert json.loads(paths[2].read_text())["identities"] == ["m@onnx:1", "n@onnx:2"]
    with pytest.raises(FileExistsError):
        reports.write(tmp_path / "out", "20260101T000000Z", one)
    with pytest.raises(ValueError, match="two reports"):
        reports.comparison_json(comparison, [one])
    with pytest.raises(ValueError, match="one corpus"):
        reports.comparison_json(comparison, [one, report(spark, "n", "other")])
    with pytest.raises(ValueError):
        report(spark, value=float("nan"))
    with pytest.raises(TypeError):
        reports.from_json('{"identity": "x"}')


MEASURED = {"model_id": "m", "precision": "int8", "artifact_bytes": 5e8, "declared_dimensions": 4, "observed_dimensions": 4, "probes": 10, "min_cosine": 0.9, "mean_cosine": 0.95, "control_cosine": 0.9999, "agreement": 0.7, "mean_margin": 0.01, "perturbation": 0.05, "margins_below": 3, "load_seconds": 2.0, "query_seconds": 0.02}


@pytest.mark.parametrize(
    ("change", "part"),
    [
        ({"error": "boom"}, "no export (boom)"),
        ({"observed_dimensions": 5}, "WRONG dimensions: 5"),
        ({"precision": "fp32"}, "nothing was quantized"),
        ({"control_cosine": None}, "control: missing"),
        ({"mean_cosine": 0.6}, "BROKEN by quantizing"),
        ({"control_cosine": 0.9}, "FAULT of the export"),
        ({"margins_below": 10}, "NO POWER"),
        ({}, "3 of 10 margins"),
        ({"agreement": None}, "Not established"),
    ],
)
def test_fidelity_lines(change, part):
    assert any(part in line for line in reports.fidelity_lines(MEASURED | change))


def test_verdict_with_control(spark):
    data = [(0.6, 0.1, 0, 0.9999, "broken by quantizing"), (0.6, 0.1, 0, 0.9, "fault of the export"), (0.995, 0.95, 0, 0.9999, "faithful"), (0.6, 0.1, 0, None, "unfaithful")]
    df = spark.createDataFrame(data, "mean double, agreement double, below int, control double, want string")
    got = df.select(metrics.fidelity_verdict(F.col("mean"), F.col("agreement"), F.col("below"), F.lit(5), F.col("control")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_bootstrap_of_known_questions(spark):
    """Published bounds of eight questions: the draws go by the order of the questions."""
    mrr = [0.0, 0.5, 1.0, 0.5, 0.0, 1.0, 0.0, 1.0]
    recall = [float(v > 0) for v in mrr]
    data = [(f"q{i}", name, v) for name, values in (("MRR@10", mrr), ("recall@10", recall)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "question_id string, metric string, value double").repartition(3)
    every = spark.createDataFrame([("MRR@10",), ("recall@10",), ("nothing",)], "metric string")
    got = {r["metric"]: (r["n"], r["mean"], r["low"], r["high"], r["status"]) for r in metrics.mean_intervals(df, ["metric"], every=every).collect()}
    assert got == {"MRR@10": (8, 0.5, 0.1875, 0.8125, "percentile-bootstrap"), "recall@10": (8, 0.625, 0.25, 0.875, "percentile-bootstrap"), "nothing": (0, None, None, None, "empty")}


def test_fetching(spark, tmp_path):
    served = {"x://h/1": (200, "Egy ő".encode()), "x://h/2": (404, b""), "x://h/3": (200, b"\xff")}
    asked, waits = [], []

    def read(url):
        asked.append(url)
        return served[url]

    again = {"read": read, "cache": tmp_path, "wait": waits.append}
    got = fetch.fetched(spark, [("p1", "x://h/1"), ("p3", "x://h/3")], "s", "hu", **again)
    assert rows(got, "page", "html") == [("p1", "Egy ő"), ("p3", "\ufffd")] and waits == [0.25]
    fetch.fetched(spark, [("p1", "x://h/1")], "s", "hu", **again)
    assert asked == ["x://h/1", "x://h/3"]
    fetch.fetched(spark, [("p1", "x://h/1")], "s", "hu", refetch=True, **again)
    assert asked[2:] == ["x://h/1"]
    with pytest.raises(ValueError, match="404"):
        fetch.fetched(spark, [("p2", "x://h/2")], "s", "hu", **again)
    with pytest.raises(ValueError, match="no name"):
        fetch.fetched(spark, [("../p", "x://h/1")], "s", "hu", **again)
    assert rows(files.cached_pages(spark, str(tmp_path)), "page") == [("p1",), ("p3",)]
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "a").write_bytes(b"a")
    reader = fetch.folder_reader(tmp_path / "site")
    assert reader("http://a") == (200, b"a") and reader("http://../s/hu/p1.html")[0] == 404


def test_embedding_goes_on_where_it_was(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(25)], "chunk_id long, text string")
    folder = str(tmp_path / "vectors")
    empty = spark.createDataFrame([], "chunk_id long, model string, vector array<double>")
    empty.write.parquet(folder)
    stored = lambda: spark.read.parquet(folder)
    encode = lambda texts: np.array([[len(t), 1.0] for t in texts])
    hashes = iter("aaab")
    calls = []

    def write(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        df.write.mode("append").parquet(folder)

    with pytest.raises(RuntimeError):
        retrieval.embed_pending(chunks, stored, encode, "m", 2, write, lambda: next(hashes), rounds=4)
    done = stored().count()
    assert 0 < done < 25
    assert retrieval.embed_pending(chunks, stored, encode, "m", 2, write, lambda: "a", rounds=4) == 25 - done
    assert sorted(rows(stored(), "chunk_id")) == [(i,) for i in range(25)]
    assert retrieval.embed_pending(chunks, stored, encode, "m", 2, write, lambda: "a") == 0
    with pytest.raises(ValueError, match="changed"):
        retrieval.embed_pending(chunks, stored, encode, "other", 2, write, iter("ab").__next__, rounds=1)
    with pytest.raises(Exception, match="another number or size"):
        retrieval.embed_pending(chunks, stored, encode, "third", 3, write, lambda: "a", rounds=1)


def test_vector_literals(spark):
    data = [(1, [0.1, -1e-300, 3.0]), (2, None), (3, [1 / 3])]
    df = spark.createDataFrame(data, "id int, v array<double>")
    back = df.select("id", vectors.vector_of(vectors.literal(F.col("v"))).alias("v"))
    assert [(r["id"], r["v"]) for r in back.orderBy("id").collect()] == data
    assert spark.range(1).select(vectors.vector_of(F.lit("none")).alias("v")).first()[0] is None


def test_percentiles_of_skewed_values(spark):
    rng = np.random.default_rng(3)
    groups = {"a": [5.0] * 4000 + rng.normal(size=333).tolist(), "b": [1.5], "c": rng.exponential(size=2000).tolist(), None: [2.0, 1.0], "d": []}
    data = [(k, float(v)) for k, values in groups.items() for v in values] + [("d", None), ("b", None)]
    df = spark.createDataFrame(data, "kind string, ms double").repartition(5)
    got = {r["kind"]: (r["n"], r["p50"], r["p95"]) for r in metrics.latency_percentiles(df, "ms", ["kind"]).collect()}
    assert set(got) == set(groups)
    for kind, values in groups.items():
        want = (None, None) if not values else tuple(np.percentile(values, [50, 95]))
        assert got[kind] == (len(values), *[None if w is None else pytest.approx(w) for w in want])
    assert metrics.latency_percentiles(df.limit(0), "ms", ["kind"]).count() == 0
