"""The ingest of document sets: pages to units, corrected, checked, compared, chunked, linked, hashed and stored as new versions."""

from __future__ import annotations

import argparse
import difflib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusmith.functions.hashing import document_hashes
from locusmith.operators import checks, chunking, pages, storage
from locusmith.plans.corpus_store import HISTORY, Store, new_rows
from locusmith.plans.store import written
from locusmith.sources import files

DOCUMENT = ["source_id", "language"]
DEFECT = [*DOCUMENT, "locator", "kind"]
ALLOWED = "source_id string, language string, locator string, kind string"
RELABELS = "source_id string, language string, page string, label string, occurrence int, correct_locator string, correct_sequence array<int>"
EXPECTED = "source_id string, language string, expected_units int"


@dataclass(frozen=True)
class Ingested:
    """What an ingest made: units, chunks and links of every document of the run, the version history, what was compared, and the defects."""

    units: DataFrame
    chunks: DataFrame
    documents: DataFrame
    undeclared: DataFrame
    stale: DataFrame
    links: DataFrame
    compared: DataFrame
    lock: DataFrame


@dataclass(frozen=True)
class Errata:
    """What is known to be wrong with a source: corrections of labels, declared defects and expected counts; a part left out is empty."""

    relabels: DataFrame | None = None
    allowed: DataFrame | None = None
    expected: DataFrame | None = None
    fields: dict = field(default_factory=lambda: {"relabels": RELABELS, "allowed": ALLOWED, "expected": EXPECTED})

    def part(self, name: str, spark: SparkSession) -> DataFrame:
        rows = getattr(self, name)
        return spark.createDataFrame([], self.fields[name]) if rows is None else rows


def units_of(source: DataFrame) -> DataFrame:
    """Units of pages (page_id, source_id, language, page, html) of all families, with label, locator, ordinal and sequence.

    Numbered families are addressed by source and number, the titled one by the address its paragraphs print; a paragraph whose
    title is no address keeps the title as its locator and has no sequence.
    """
    framed = source.withColumn("family", pages.family_of(F.col("html")))
    keys = [*DOCUMENT, "page", "page_id"]
    numbered = pages.numbered_units(framed, DOCUMENT)
    numbered = numbered.select(
        *keys,
        F.col("number").cast("long").alias("position"),
        F.col("number").cast("string").alias("label"),
        "number",
        "anchor",
        "anchor_expected",
        F.col("anchor_expected").isNotNull().alias("anchor_signal"),
        "role",
        "text",
        F.concat_ws(":", "source_id", "number").alias("locator"),
        F.array(F.col("number").cast("int")).alias("sequence"),
    )
    nothing = F.lit(None).cast("string")
    at = pages.address(F.col("label"))
    titled = pages.titled_units(framed, keys).withColumn("_a", at)
    titled = titled.select(
        *keys,
        F.col("position").cast("long").alias("position"),
        "label",
        F.lit(None).cast(numbered.schema["number"].dataType).alias("number"),
        nothing.alias("anchor"),
        nothing.alias("anchor_expected"),
        F.lit(False).alias("anchor_signal"),
        pages.address_role(F.col("_a")).alias("role"),
        "text",
        F.coalesce(F.regexp_replace(pages.address_locator(F.col("_a"), ""), "^:", F.concat(F.col("source_id"), F.lit(":"))), F.concat_ws(":", "source_id", "label")).alias("locator"),
        pages.address_sequence(F.col("_a")).cast("array<int>").alias("sequence"),
    )
    order = F.row_number().over(Window.partitionBy(*DOCUMENT).orderBy("page", "page_id", "position"))
    return numbered.unionByName(titled).withColumn("ordinal", order).drop("position")


def corrected(units: DataFrame, relabels: DataFrame) -> DataFrame:
    """units with the corrections of labels applied, each to the source and language it names."""
    keyed = relabels.select(F.concat_ws("/", *DOCUMENT, "page").alias("page"), "label", "occurrence", "correct_locator", "correct_sequence")
    both = checks.relabelled(units.withColumn("_page", F.col("page")).withColumn("page", F.concat_ws("/", *DOCUMENT, "page")), keyed, DOCUMENT)
    return both.withColumn("page", F.col("_page")).drop("_page")


def defects_of(units: DataFrame, expected: DataFrame) -> DataFrame:
    """(source_id, language, locator, kind) of all defects: gaps, order, anchors, counts, addresses that cannot be read, and locators that occur twice."""
    dense = units.where("number IS NOT NULL AND relabelled_from IS NULL")
    gaps = checks.gap_defects(dense, DOCUMENT).select(*DOCUMENT, F.concat_ws(":", "source_id", "missing").alias("locator"), F.lit("paragraph-absent").alias("kind"))
    counts = checks.count_defects(units, expected, DOCUMENT).select(*DOCUMENT, F.concat(F.lit("units:"), F.col("units").cast("string")).alias("locator"), F.lit("count-mismatch").alias("kind"))
    unread = units.where("sequence IS NULL").select(*DOCUMENT, "locator", F.lit("label-disagreement").alias("kind"))
    twice = units.groupBy(*DOCUMENT, "locator").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*DOCUMENT, "locator", F.lit("locator-repeated").alias("kind"))
    parts = [gaps, checks.order_defects(units.where("sequence IS NOT NULL"), DOCUMENT), checks.anchor_defects(units, DOCUMENT), counts, unread, twice]
    found = parts[0].select(*DEFECT)
    for part in parts[1:]:
        found = found.unionByName(part.select(*DEFECT))
    return found


def compared_languages(units: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Locators of every document of the run against each other language of its source, among the run's own and the stored current ones.

    Columns source_id, language, sibling, shared, only_incoming, only_existing, fails. Without another language there is no row: nothing was compared.
    """
    own = units.select(*DOCUMENT, "locator").distinct()
    other = own
    if existing is not None:
        kept = existing.join(own.select(*DOCUMENT).distinct(), DOCUMENT, "left_anti").select(*DOCUMENT, "locator").distinct()
        other = own.unionByName(kept)
    pairs = own.select(*DOCUMENT).distinct().join(other.select("source_id", F.col("language").alias("sibling")).distinct(), "source_id").where("language <> sibling")
    incoming = pairs.join(own, DOCUMENT)
    theirs = pairs.join(other.withColumnRenamed("language", "sibling"), ["source_id", "sibling"])
    return checks.locator_comparison(incoming, theirs, [*DOCUMENT, "sibling"])


def ingest(source: DataFrame, history: DataFrame, allowed: DataFrame | None = None, chunker: str = "numbered-paragraph", strict: bool = True, errata: Errata | None = None, existing: DataFrame | None = None) -> Ingested:
    """Runs the stages in order; with strict, an undeclared defect or languages that differ stop it before anything is stored.

    history: source_id, language, content_hash, unit_count, ingested_at, is_current. allowed: source_id, language, locator, kind (those of
    errata are added). existing: locators of stored current units (source_id, language, locator).
    Units are written once to the shared folder; every later stage reads them from there.
    """
    spark = source.sparkSession
    errata = errata or Errata()
    declared = errata.part("allowed", spark).select(*DEFECT)
    declared = declared if allowed is None else declared.unionByName(allowed.select(*DEFECT))
    raw = units_of(source)
    units = written(corrected(raw, errata.part("relabels", spark)), "units")
    found = written(defects_of(units, errata.part("expected", spark)), "defects")
    undeclared = checks.undeclared(found, declared, DEFECT)
    if strict and (first := undeclared.first()):
        raise ValueError(f"undeclared defect {first['kind']} at {first['locator']} ({first['language']})")
    compared = written(compared_languages(units, existing), "compared")
    if strict and (first := compared.where("fails").first()):
        raise ValueError(f"{first['source_id']}: {first['only_incoming']} locators are in {first['language']} only, {first['only_existing']} in {first['sibling']} only, {first['shared']} in both")
    chunks = chunking.chunker(chunker)(units, DOCUMENT)
    sizes = units.groupBy(*DOCUMENT).agg(F.count(F.lit(1)).cast("int").alias("unit_count"))
    incoming = written(document_hashes(units, DOCUMENT).join(sizes, DOCUMENT).withColumn("ingested_at", F.current_timestamp()), "incoming")
    documents = storage.versioned(storage.without_crashed(history), incoming)
    ids = documents.join(incoming.select(*DOCUMENT, "content_hash"), [*DOCUMENT, "content_hash"])
    units, chunks = new_rows(units, ids, DOCUMENT), new_rows(chunks, ids, DOCUMENT)
    chunks = chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col("document_id"), F.col("strategy"), F.to_json("unit_locators"), F.md5("text")), 256))
    units = units.withColumn("unit_id", F.sha2(F.concat_ws("|", "document_id", "locator", F.col("ordinal").cast("string")), 256))
    links = chunking.link_rows(chunks, units)
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    siblings = compared.groupBy(*DOCUMENT).agg(F.concat_ws("/", F.sort_array(F.collect_set("sibling"))).alias("same_locators_as"))
    lock = ids.join(counts, "document_id", "left").join(siblings, DOCUMENT, "left").select(*DOCUMENT, "content_hash", "unit_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("same_locators_as", F.lit("")).alias("same_locators_as"))
    return Ingested(units, chunks, documents, undeclared, checks.stale(found, declared, DEFECT), links, compared, lock)


FLAGS = ("--source", "--language", "--dry-run", "--pages", "--store", "--errata", "--chunker", "--lock")


def arguments(argv: list[str]) -> argparse.Namespace:
    """The closed set of flags; an unknown one is refused with the nearest known, a repeated one too."""
    names = [a.split("=", 1)[0] for a in argv if a.startswith("-")]
    for name in names:
        if name not in FLAGS:
            near = difflib.get_close_matches(name, FLAGS, 1)
            raise SystemExit(f"unknown flag {name}" + (f"; did you mean {near[0]}?" if near else ""))
        if names.count(name) > 1:
            raise SystemExit(f"{name} is given twice")
    parser = argparse.ArgumentParser(prog="locusmith", allow_abbrev=False)
    parser.add_argument("--source", required=True)
    parser.add_argument("--language", required=True, choices=("hu", "en", "la"))
    parser.add_argument("--pages", required=True, help="parquet of pages")
    parser.add_argument("--store", help="folder of the store")
    parser.add_argument("--errata", help="errata of the source (YAML or JSON)")
    parser.add_argument("--chunker", default="numbered-paragraph", choices=tuple(chunking.CHUNKERS))
    parser.add_argument("--lock", help="lock manifest to keep up to date")
    parser.add_argument("--dry-run", action="store_true")
    return parser.parse_args(argv)


def read_errata(spark: SparkSession, path: str | None, source: str, language: str) -> Errata:
    """Errata of a file for one document; without a file there are none, and no count is expected."""
    if path is None:
        return Errata()
    known = files.errata(Path(path).read_text(encoding="utf-8"), source)
    relabels = [(source, language, r["page"], r["found_label"], int(r["occurrence"]), r["correct_locator"], None) for r in known["relabels"]]
    expected = [(source, language, known["expected_units"])] if known["expected_units"] is not None else []
    return Errata(
        spark.createDataFrame(relabels, RELABELS),
        spark.createDataFrame([(source, language, a["locator"], a["kind"]) for a in known["allowed"]], ALLOWED),
        spark.createDataFrame(expected, EXPECTED),
    )


def keep_lock(path: str, made: Ingested, at: str) -> bool:
    """Puts the entries of the run in place of those of the same documents; the file is written only if an entry changed."""
    before = files.previous_lock(path) or {}
    own = [r.asDict() for r in made.lock.collect()]  # one row per document of the run
    replaced = {(e["source_id"], e["language"]) for e in own}
    rest = [e for e in before.get("documents", []) if (e["source_id"], e["language"]) not in replaced]
    return storage.write_lock(path, rest + own, at)


def main(argv: list[str]) -> int:
    options = arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    own = spark.read.parquet(options.pages).where((F.col("source_id") == options.source) & (F.col("language") == options.language)).dropDuplicates(["page_id"])
    store = Store(spark, options.store) if options.store else None
    history = store.documents() if store else spark.createDataFrame([], HISTORY)
    stored = store.part("units") if store else None
    existing = None if stored is None else stored.select(*DOCUMENT, "locator")
    made = ingest(own, history, None, options.chunker, errata=read_errata(spark, options.errata, options.source, options.language), existing=existing)
    print(json.dumps({"units": made.units.count(), "chunks": made.chunks.count(), "stale declarations": made.stale.count()}))
    if options.dry_run or store is None:
        return 0
    chunking.require_linked(made.links)
    documents = written(made.documents, "documents")
    number = store.publish(documents, {"units": made.units, "chunks": made.chunks, "links": made.links})
    if options.lock:
        keep_lock(options.lock, made, str(spark.range(1).select(F.current_timestamp().cast("string")).first()[0]))
    print(f"version {number}")
    return 0
