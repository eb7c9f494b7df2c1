"""The driver's contract, and the library without the subpackage for training text."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from locusmith.operators import checks, pages
from locusmith.plans import corpus_store, ingest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert len(queries) > 100


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_subpackage():
    names = [p for p in (ROOT / "locusmith").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in names if "locusmith.llm" in p.read_text(encoding="utf-8")]
    code = "import sys; sys.modules['locusmith.llm'] = None\nimport __spark_entry__ as e; assert len(e.queries()) > 90 and 'p3_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0


def test_no_local_checkpoints():
    for p in (ROOT / "locusmith").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text(encoding="utf-8")
    assert importlib.util.find_spec("locusmith")


PAGE = '<div class="article-content"><p><a name="K0001">1.</a> Egy.</p><p>2. Kettő.</p><p>{}. Utolsó.</p></div>'


def test_ingest(spark):
    source = spark.createDataFrame([(1, "s", "hu", "p1", PAGE.format(3))], "page_id long, source_id string, language string, page string, html string")
    history = spark.createDataFrame([], ingest.HISTORY)
    allowed = spark.createDataFrame([("s", "hu", f"s:{n}", "anchor-absent") for n in (2, 3)], ingest.ALLOWED)
    with pytest.raises(ValueError, match="anchor-absent"):
        ingest.ingest(source, history)
    made = ingest.ingest(source, history, allowed)
    assert rows(made.units, "locator", "text") == [("s:1", "Egy."), ("s:2", "Kettő."), ("s:3", "Utolsó.")]
    assert made.chunks.count() == 3 and made.undeclared.count() == 0
    again = ingest.ingest(source, made.documents.drop("document_id"), allowed)
    assert rows(again.documents, "content_hash", "is_current") == rows(made.documents, "content_hash", "is_current")
    gap = source.withColumn("html", F.lit(PAGE.format(3).replace("2. Kettő.", '<a name="K0007">7.</a> Kettő.')))
    with pytest.raises(ValueError, match="paragraph-absent"):
        ingest.ingest(gap, history, allowed)
    assert ingest.ingest(gap, history, allowed, strict=False).undeclared.count() > 0
    assert pages.family("anchored").dense


def test_arguments():
    good = ingest.arguments(["--source=s", "--language=hu", "--pages=p", "--dry-run"])
    assert good.dry_run and good.source == "s"
    with pytest.raises(SystemExit, match="did you mean --source"):
        ingest.arguments(["--sorce=s"])
    with pytest.raises(SystemExit, match="twice"):
        ingest.arguments(["--source=s", "--source=t"])


ANCHORED = '<div class="article-content"><p><a name="K0001">1.</a> {0}.</p><p><a name="K0002">2.</a> {1}.</p></div>'
SOURCE = "page_id long, source_id string, language string, page string, html string"


def stored_locators(store):
    units = store.part("units")
    return None if units is None else units.select("source_id", "language", "locator")


def publish(spark, store, html, language="hu", **more):
    source = spark.createDataFrame([(1, "s", language, "p1", html)], SOURCE)
    made = ingest.ingest(source, store.documents(), existing=stored_locators(store), **more)
    return store.publish(ingest.written(made.documents, "documents"), {"units": made.units, "chunks": made.chunks, "links": made.links}), made


def test_store_keeps_every_version(spark, tmp_path):
    store = corpus_store.Store(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.documents().count() == 0 and store.part("units") is None
    publish(spark, store, ANCHORED.format("Egy", "Kettő"))
    publish(spark, store, ANCHORED.format("Egy", "Kettő"))  # the same content changes nothing
    assert rows(store.documents(), "is_current", "unit_count") == [(True, 2)]
    assert rows(store.part("units"), "locator", "text") == [("s:1", "Egy."), ("s:2", "Kettő.")]
    number, made = publish(spark, store, ANCHORED.format("Egy", "Más"))
    assert number == 3 and store.version() == 3
    assert rows(store.documents(), "is_current") == [(False,), (True,)]
    assert rows(store.part("units"), "text") == [("Egy.",), ("Más.",)]
    assert rows(store.part("units", current=False), "text") == [("Egy.",), ("Egy.",), ("Kettő.",), ("Más.",)]
    assert store.part("links").count() == 2 and store.part("chunks").count() == 2
    # a run that fails before it publishes, or loses a race, leaves the published version as it was
    (tmp_path / "store" / "versions" / "00000004").write_bytes(b"")
    with pytest.raises(Exception, match="(?i)exist|EOF"):
        publish(spark, store, ANCHORED.format("Egy", "Új"))


def test_unreadable_store_is_an_error(spark, tmp_path):
    store = corpus_store.Store(spark, str(tmp_path / "store"))
    publish(spark, store, ANCHORED.format("Egy", "Kettő"))
    for p in (tmp_path / "store" / "documents").rglob("*.parquet"):
        p.write_bytes(b"broken")
    with pytest.raises(Exception):
        store.documents().collect()


def test_languages_are_compared(spark, tmp_path):
    store = corpus_store.Store(spark, str(tmp_path / "store"))
    publish(spark, store, ANCHORED.format("Egy", "Kettő"))
    _, made = publish(spark, store, ANCHORED.format("One", "Two"), "en")
    assert rows(made.compared, "language", "sibling", "shared", "fails") == [("en", "hu", 2, False)]
    assert {r["same_locators_as"] for r in made.lock.collect()} == {"hu"}
    with pytest.raises(ValueError, match="1 in hu only"):
        publish(spark, store, ANCHORED.format("Unum", "").replace("K0002", "x").replace(">2.<", "><"), "la")


def test_errata_and_titles(spark, tmp_path):
    path = tmp_path / "errata.json"
    path.write_text('{"relabels": [{"page": "p1", "found_label": "3", "occurrence": 1, "correct_locator": "s:2"}], "allowed": [{"locator": "s:9", "kind": "paragraph-absent"}], "expected_units": 2}')
    errata = ingest.read_errata(spark, str(path), "s", "hu")
    html = ANCHORED.format("Egy", "Kettő").replace("K0002", "K0003").replace(">2.<", ">3.<")
    source = spark.createDataFrame([(1, "s", "hu", "p1", html)], SOURCE)
    made = ingest.ingest(source, spark.createDataFrame([], ingest.HISTORY), errata=errata)
    assert rows(made.units, "locator", "relabelled_from") == [("s:1", None), ("s:2", "s:3")]
    assert rows(made.stale, "locator") == [("s:9",)]
    assert ingest.keep_lock(str(tmp_path / "lock.json"), made, "now") and not ingest.keep_lock(str(tmp_path / "lock.json"), made, "later")
    titled = spark.createDataFrame([(1, "s", "la", "p1", '<p title="I q. 1 a. 1 arg. 1">Videtur.</p><p title="I q. 1 a. 1 co.">Respondeo.</p>')], SOURCE)
    made = ingest.ingest(titled, spark.createDataFrame([], ingest.HISTORY), chunker="scholastic-article")
    assert rows(made.units, "locator", "role") == [("s:I.q1.a1.arg1", "objection"), ("s:I.q1.a1.co", "respondeo")]
    assert made.chunks.count() == 1 and made.links.count() == 2
    odd = titled.withColumn("html", F.lit('<p title="somewhere">x</p>'))
    with pytest.raises(ValueError, match="label-disagreement"):
        ingest.ingest(odd, spark.createDataFrame([], ingest.HISTORY))


def test_wide_gaps_unfold_in_blocks(spark):
    units = spark.createDataFrame([("s", 1, 1), ("s", 2, 25_003)], "source_id string, ordinal int, number long")
    found = checks.gap_defects(units, ["source_id"])
    assert found.count() == 25_001 and rows(found.agg(F.min("missing"), F.max("missing"))) == [(2, 25_002)]
    wide = spark.createDataFrame([("s", 1, 9_000_000_000)], "source_id string, ordinal int, number long")
    assert rows(checks.gap_ranges(wide, ["source_id"])) == [("s", 1, 8_999_999_999, 0, 9_000_000_000)]
