"""Checks, chunks, hashes, storage and sources on small dirty frames."""

import hashlib
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from locusmith.functions import hashing, vectors
from locusmith.operators import checks, chunking, storage
from locusmith.sources import corpus, files


def numbers(spark, *values, document="d"):
    return spark.createDataFrame([(document, i, n, [n], f"s:{n}") for i, n in enumerate(values)], "doc string, ordinal int, number bigint, sequence array<bigint>, locator string")


def test_gaps_and_order(spark):
    assert rows(checks.gap_defects(numbers(spark, 1, 2, 4), ["doc"]), "missing") == [(3,)]
    assert rows(checks.gap_defects(numbers(spark, 3), ["doc"]), "missing") == [(1,), (2,)]
    assert checks.gap_defects(numbers(spark, 1, 2, 2, 3), ["doc"]).count() == 0
    assert rows(checks.order_defects(numbers(spark, 1, 2, 2, 1), ["doc"]), "locator") == [("s:1",), ("s:2",)]
    tree = spark.createDataFrame([("d", 0, [1, 2, 1, 1, 3], "a"), ("d", 1, [1, 2, 1, 2, 1], "b"), ("d", 2, [1, 2], "c")], "doc string, ordinal int, sequence array<int>, locator string")
    assert rows(checks.order_defects(tree, ["doc"]), "locator") == [("c",)]


def test_counts_declared_and_stale(spark):
    expected = spark.createDataFrame([("d", 3), ("e", 0), ("f", 2)], "doc string, expected_units bigint")
    assert rows(checks.count_defects(numbers(spark, 1, 2), expected, ["doc"])) == [("d", 2, 3), ("f", 0, 2)]
    found = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "locator string, kind string")
    allowed = spark.createDataFrame([("b", "y"), ("c", "z")], "locator string, kind string")
    assert rows(checks.undeclared(found, allowed, ["locator", "kind"])) == [("a", "x"), ("a", "x")]
    assert rows(checks.stale(found, allowed, ["locator", "kind"])) == [("c", "z")]
    assert checks.undeclared(found.limit(0), allowed, ["locator", "kind"]).count() == 0


def test_anchor_defects(spark):
    data = [("d", "s:1", "1", "K0001", "K0001", True, None), ("d", "s:2", "2", None, "K0002", True, None), ("d", "s:3", "3", "3", "K0003", True, None), ("d", "s:4", "4", "K0040", "K0004", True, None), ("d", "s:5", "5", None, "K0005", True, "s:6"), ("e", "s:1", "1", None, None, False, None)]
    df = spark.createDataFrame(data, "doc string, locator string, label string, anchor string, anchor_expected string, anchor_signal boolean, relabelled_from string")
    assert rows(checks.anchor_defects(df, ["doc"]), "locator", "kind") == [("s:2", "anchor-absent"), ("s:3", "anchor-missing-prefix"), ("s:4", "anchor-typo")]


def test_relabelled(spark):
    data = [("d", "p", "7", [7], "s:7", 1), ("d", "p", "9", [9], "s:9", 2), ("d", "p", "9", [9], "s:9", 3)]
    units = spark.createDataFrame(data, "doc string, page string, label string, sequence array<int>, locator string, ordinal int")
    fix = spark.createDataFrame([("p", "9", 2, "s:8", [8])], "page string, label string, occurrence int, correct_locator string, correct_sequence array<int>")
    assert rows(checks.relabelled(units, fix, ["doc"]), "ordinal", "locator", "relabelled_from") == [(1, "s:7", None), (2, "s:8", "s:9"), (3, "s:9", None)]


def test_probes_fire_and_do_not(spark):
    data = [("markup-residue", "A tag <em>survived</em>."), ("entity-residue", "He said &ldquo;it&rdquo;."), ("bracket-footnote", "A marker[64] here."), ("empty-text", " "), ("double-space", "A  space."), ("leading-marker-residue", ". Left."), ("clean", "A clean text, 5 < 6 & 7."), (None, None), ("empty-text", "")]
    df = spark.createDataFrame(data, "locator string, text string")
    hits = checks.probe_hits(df)
    assert all(r["locator"] == r["probe"] for r in hits.collect()) and hits.count() == 7
    furniture = [checks.furniture_probe("Tárgymutató")]
    words = spark.createDataFrame([("yes", "lásd: Tárgymutató"), ("no", "Tárgymutatóban"), ("no", "xTárgymutató")], "locator string, text string")
    assert rows(checks.probe_hits(words, furniture), "locator") == [("yes",)]
    assert all(r["vacuous"] for r in checks.probe_summary(hits.limit(0), df.limit(0)).collect())
    assert checks.probe_message(7, "x", list("abcdefg")) == "x: 7 unit(s): a, b, c, d, e … and 2 more"


def test_comparisons(spark):
    a = spark.createDataFrame([("s", "s:1"), ("s", "s:2"), ("s", "s:2"), ("t", "t:1")], "source_id string, locator string")
    b = spark.createDataFrame([("s", "s:1"), ("s", "s:2"), ("u", "u:1")], "source_id string, locator string")
    assert rows(checks.locator_comparison(a, b, ["source_id"])) == [("s", 2, 0, 0, False), ("t", 0, 1, 0, True), ("u", 0, 0, 1, True)]
    left = spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], "locator string, role string")
    right = spark.createDataFrame([("a", None), ("b", "y")], "locator string, role string")
    assert rows(checks.role_divergence(left, right), "locator") == [("b",), ("c",)]
    expected = spark.createDataFrame([("q", "s:1"), ("q", "s:9"), ("q", "z:1")], "question_id string, locator string")
    assert rows(checks.resolution(expected, a, a), "locator", "verdict") == [("s:1", "resolved"), ("s:9", "failure"), ("z:1", "pending")]


def test_slate(spark):
    schema = "model_id string, base_family string, serving string, local boolean, query_prefix string, passage_prefix string, prefix_note string"
    good = [("a", "f", "local", True, "q", "p", None), ("b", "g", "local", True, "q", None, "as documented")]
    assert checks.slate_violations(spark.createDataFrame(good, schema)).count() == 0
    bad = [("a", "f", "none", True, "q", "", ""), ("a", "f", "local", False, None, None, None)]
    assert rows(checks.slate_violations(spark.createDataFrame(bad, schema)), "rule") == [("duplicate-model",), ("not-measurable",), ("not-servable",), ("one-family",), ("undeclared-asymmetry",)]


def test_vacuity(spark):
    none = spark.createDataFrame([], "rule string, detail string")
    assert rows(checks.with_vacuity(none, none, "r")) == [("r", "nothing was checked")]


def test_chunks(spark):
    data = [("d", "s:I.q1.a1.arg1", "x" * 40, 1), ("d", "s:I.q1.a1.arg2", "y" * 40, 2), ("d", "s:I.q1.a1.co", "z" * 200, 3), ("d", "s:I.q1.a1.ad1", None, 4), ("d", "s:pr", "w", 5)]
    units = spark.createDataFrame(data, "doc string, locator string, text string, ordinal int")
    got = chunking.scholastic_article(units, ["doc"], budget=100)
    assert rows(got, "article", "batch", "unit_locators") == [("s:I.q1.a1", 0, ["s:I.q1.a1.arg1", "s:I.q1.a1.arg2"]), ("s:I.q1.a1", 1, ["s:I.q1.a1.co"]), ("s:I.q1.a1", 2, ["s:I.q1.a1.ad1"]), ("s:pr", 0, ["s:pr"])]
    assert got.where("article = 's:pr'").first()["text"] == "s:pr\n[Prooemium] w"
    assert got.where("batch = 0 AND article LIKE '%a1'").first()["text"].startswith("s:I.q1.a1\n[Obiectio 1] xxx")
    assert chunking.numbered_paragraph(units, ["doc"]).count() == 5
    assert rows(chunking.split_statistics(got, ["doc"])) == [("d", 2, 1, 1, 3)]
    with pytest.raises(ValueError):
        chunking.chunker("pericope")


def test_links_of_chunks(spark):
    chunks = spark.createDataFrame([(1, "d", ["a", "b"]), (2, "e", ["a"])], "chunk_id long, document_id string, unit_locators array<string>")
    units = spark.createDataFrame([(10, "d", "a"), (11, "d", "b")], "unit_id long, document_id string, locator string")
    links = chunking.link_rows(chunks, units)
    assert rows(links, "chunk_id", "ordinal", "unit_id") == [(1, 0, 10), (1, 1, 11), (2, 0, None)]
    with pytest.raises(ValueError):
        chunking.require_linked(links)


def test_hashes(spark):
    units = spark.createDataFrame([("d", "s:1", None, "egy", 1), ("d", "s:2", "", "kettő\t\n", 2), ("e", "s:1", "co", "x", 1)], "document_id string, locator string, role string, text string, ordinal int")
    got = dict(rows(hashing.document_hashes(units, ["document_id"])))
    assert got["d"] == hashlib.sha256("s:1\t\tegy\ns:2\t\tkettő\t\n\n".encode()).hexdigest()
    docs = spark.createDataFrame([("s", "hu", "h1"), ("a", "la", "h2")], "source_id string, language string, content_hash string")
    assert hashing.corpus_hash(docs).first()[0] == hashlib.sha256(b"a:la\th2\ns:hu\th1\n").hexdigest()
    assert hashing.gold_hash([{"id": "b", "x": "ő"}, {"id": "a"}]) == hashlib.sha256('[{"id": "a"}, {"id": "b", "x": "ő"}]'.encode()).hexdigest()
    assert hashing.embedding_identity("m", {"b": 1, "a": 2}) == hashing.embedding_identity("m", {"a": 2, "b": 1})
    stored = spark.createDataFrame([("d", got["d"]), ("e", "other")], "document_id string, content_hash string")
    assert rows(checks.hash_mismatches(units, stored), "document_id") == [("e",)]


def test_artifact_hash(tmp_path):
    (tmp_path / "m.onnx").write_bytes(b"abc")
    (tmp_path / "t.json").write_text("{}")
    first = hashing.artifact_hash(tmp_path)
    (tmp_path / "t.json").write_text("{ }")
    assert hashing.artifact_hash(tmp_path) != first
    (tmp_path / "link").symlink_to(tmp_path / "t.json")
    with pytest.raises(ValueError):
        hashing.artifact_hash(tmp_path)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8])], "a array<double>, b array<double>")
    assert abs(df.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] - 0.6) < 1e-12
    for bad in ([1.0], [], [0.0, 0.0]):
        with pytest.raises(Exception, match="vector"):
            spark.createDataFrame([([1.0, 0.0], bad)], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()
    data = [([1.0, 2.0],), ([1.0],), ([0.0, 0.0],), ([float("inf"), 1.0],), (None,), ([None, 1.0],)]
    assert [r[0] for r in spark.createDataFrame(data, "v array<double>").select(vectors.faults(F.col("v"), 2)).collect()] == [None, "dimensions", "zero", "not finite", "missing", "not finite"]


def test_versioned_store(spark):
    schema = "source_id string, language string, content_hash string, unit_count int, ingested_at int, is_current boolean"
    history = spark.createDataFrame([("s", "hu", "h1", 3, 1, True), ("s", "la", "l1", 3, 1, True)], schema)
    again = storage.versioned(history, history.drop("is_current"))
    assert rows(again, "source_id", "content_hash", "is_current") == [("s", "h1", True), ("s", "l1", True)]
    incoming = spark.createDataFrame([("s", "hu", "h2", 4, 2), ("s", "hu", "h2", 4, 2), ("t", "hu", "n", 1, 2)], schema.rsplit(",", 1)[0])
    after = storage.versioned(history, incoming)
    assert rows(after, "source_id", "language", "content_hash", "is_current") == [("s", "hu", "h1", False), ("s", "hu", "h2", True), ("s", "la", "l1", True), ("t", "hu", "n", True)]
    assert storage.several_current(after).count() == 0
    back = storage.versioned(after.drop("document_id"), spark.createDataFrame([("s", "hu", "h1", 3, 3)], schema.rsplit(",", 1)[0]))
    assert back.where("is_current AND language = 'hu' AND source_id = 's'").count() == 1


def test_upserts_and_locks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 9), ("c", 4)], "id string, v int")
    assert rows(storage.upserted(old, new, ["id"])) == [("a", 1), ("b", 9), ("c", 4)]
    vectors_ = spark.createDataFrame([(1, "m", 5), (1, "m", 3), (2, "m", 1)], "chunk_id int, model string, at int")
    assert rows(storage.new_vectors(vectors_, spark.createDataFrame([(2, "m")], "chunk_id int, model string"), "at")) == [(1, "m", 3)]
    entries = [{"source_id": "s", "language": "hu", "h": "1"}]
    path = tmp_path / "lock.json"
    assert storage.write_lock(path, entries, "t1") and not storage.write_lock(path, entries, "t2")
    assert json.loads(path.read_text())["generated_at"] == "t1"
    path.write_text("{ broken")
    assert files.previous_lock(path) is None
    crashed = spark.createDataFrame([("x", False, 0), ("y", False, 3), ("z", True, 0), ("w", None, 0)], "document_id string, is_current boolean, unit_count int")
    assert rows(storage.without_crashed(crashed), "document_id") == [("w",), ("y",), ("z",)]
    assert rows(storage.revision_diff(old.select(F.col("id").alias("locator"), F.col("v").cast("string").alias("text")), new.where("v <> 9").select(F.col("id").alias("locator"), F.col("v").cast("string").alias("text")))) == [("a", "removed"), ("b", "changed"), ("c", "added")]


MANIFEST = """{"sources": [{"id": "s", "title": "S", "kind": "scripture", "authority_tier": 1, "license": "open", "locator_scheme": "n", "chunking": "numbered-paragraph",
  "canonical_url": "https://s.example/", "documents": [{"language": "hu", "revision": "1", "index_url": "https://s.example/i", "parser": "anchored"}]},
 {"id": "t", "title": "T", "kind": "scientific", "authority_tier": 9, "license": "unresolved", "locator_scheme": "n", "chunking": "x", "documents": []}]}"""


def test_manifest_and_errata(spark):
    sources = files.manifest(spark, MANIFEST)
    assert files.selected_document(sources, "s", "hu")["encoding"] == "utf-8"
    with pytest.raises(ValueError, match="s/hu"):
        files.selected_document(sources, "s", "en")
    faults = rows(files.manifest_faults(sources))
    assert {f for i, f in faults if i == "t"} == {"tier-range", "tier-of-untiered-kind", "license-unresolved", "no-documents"} and not [f for f in faults if f[0] == "s"]
    assert files.errata(None, "s", 5)["expected_units"] == 5
    with pytest.raises(ValueError):
        files.errata(None, "s")
    assert files.errata('{"expected_units": 3, "note": "x", "allowed": [{"locator": "s:1", "kind": "k", "why": "w"}]}', "s")["allowed"] == [{"locator": "s:1", "kind": "k"}]


def test_gold_and_files(spark, tmp_path):
    with pytest.raises(ValueError):
        files.gold_set(spark, tmp_path)
    question = {"id": "q1", "question": "?", "language": "hu", "category": "doctrine", "expected_units": ["s:1"], "adversarial_target": None, "notes": None}
    (tmp_path / "q-1.yaml").write_text(json.dumps(question))
    assert files.gold_set(spark, tmp_path).count() == 1
    (tmp_path / "q-2.yaml").write_text(json.dumps({**question, "extra": 1}))
    with pytest.raises(ValueError, match="extra"):
        files.gold_set(spark, tmp_path)
    page = tmp_path / "cache" / "s" / "hu" / "p1.html"
    page.parent.mkdir(parents=True)
    page.write_bytes("ő".encode() + b"\xff")
    assert rows(files.cached_pages(spark, str(tmp_path / "cache"))) == [("s", "hu", "p1", "ő�")]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# A")
    assert rows(files.markdown_files(spark, str(tmp_path))) == [("docs/a.md", "# A")]


def test_corpus_reads(spark):
    docs = spark.createDataFrame([("d1", "s", "hu", True), ("d2", "s", "la", True), ("d3", "s", "en", False)], "document_id string, source_id string, language string, is_current boolean")
    chunks = spark.createDataFrame([(1, "d1", "x", "t", ["b", "a", "a"]), (2, "d3", "x", "t", ["c"])], "chunk_id long, document_id string, strategy string, text string, unit_locators array<string>")
    assert rows(corpus.chunk_units(chunks, docs)) == [(1, ["a", "b"])]
    assert rows(corpus.current_chunks(chunks, docs), "chunk_id") == [(1,)]
    assert rows(corpus.sibling_languages(docs)) == [("s", "hu", "la"), ("s", "la", "hu")]
    with pytest.raises(ValueError):
        corpus.page_of(docs, [], 0)
    with pytest.raises(ValueError, match="failed"):
        corpus.snapshot(lambda: {"d": docs}, [lambda f: f["d"]])
    assert corpus.snapshot(lambda: {"d": docs}, [lambda f: f["d"].limit(0)])["d"].count() == 3


def test_pages_by_place(spark):
    from locusmith.sources.corpus import page_after

    df = spark.createDataFrame([(a, b, "x") for a in ("s", "t") for b in range(7)] + [("s", None, "x"), (None, 1, "x")], "a string, b int, x string").repartition(3)
    seen, last = [], None
    while page := [tuple(r) for r in page_after(df, ["a", "b"], last, 4).select("a", "b").collect()]:
        seen += page
        last = page[-1]
    assert seen == [(a, b) for a in ("s", "t") for b in range(7)]
    with pytest.raises(ValueError):
        page_after(df, [], None)
    with pytest.raises(ValueError):
        page_after(df, ["a", "b"], ("s",))
