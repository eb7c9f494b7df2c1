"""Readers of manifests, errata, gold sets, pages and document trees; the small ones on the driver, the large ones as scans."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

try:
    import yaml
except ImportError:  # JSON is YAML too; only other YAML needs the library
    yaml = None

# The domains a manifest is checked against.
KINDS = ("scripture", "church_document", "theological_work", "historical", "scientific")
LANGUAGES = ("hu", "en", "la")
CATEGORIES = ("doctrine", "morals", "scripture", "liturgy", "history", "practice", "apologetics")
QUESTION_KEYS = frozenset({"id", "question", "language", "category", "expected_units", "expects_refusal", "cross_lingual", "adversarial_target", "notes"})

MANIFEST = "id string, title string, kind string, authority_tier smallint, author string, languages array<string>, license string, license_note string, locator_scheme string, chunking string, canonical_url string, expected_units int, documents array<struct<language:string, revision:string, edition:string, index_url:string, fetch:string, parser:string, encoding:string>>"
GOLD = "id string, question string, language string, category string, expected_units array<string>, expects_refusal boolean, cross_lingual boolean, adversarial_target string, notes string"


def parsed(text: str) -> object:
    return yaml.safe_load(text) if yaml else json.loads(text)


def manifest(spark: SparkSession, raw: str) -> DataFrame:
    """The sources of a manifest, with defaults filled in. manifest_faults tells what is wrong with them."""
    rows = []
    for source in parsed(raw)["sources"]:
        row = {"languages": [d.get("language") for d in source.get("documents", [])], **source}
        row["documents"] = [{"encoding": "utf-8", "fetch": "html", **d} for d in source.get("documents", [])]
        rows.append(row)
    return spark.createDataFrame(rows, MANIFEST)


def manifest_faults(sources: DataFrame) -> DataFrame:
    """(id, fault) for every rule a source of a manifest breaks."""
    c = F.col
    tierless = c("kind").isin("scientific", "historical")
    rules: Mapping[str, Column] = {
        "kind": ~c("kind").isin(*KINDS),
        "tier-range": c("authority_tier").isNotNull() & ~c("authority_tier").between(1, 5),
        "tier-of-untiered-kind": tierless & c("authority_tier").isNotNull(),
        "tier-missing": ~tierless & c("authority_tier").isNull(),
        "license-unresolved": c("license").isNull() | c("license").isin("unresolved", "unknown"),
        "url": c("canonical_url").isNotNull() & ~c("canonical_url").rlike("^https?://[^/]+"),
        "language": F.exists("documents", lambda d: ~d["language"].isin(*LANGUAGES)),
        "index-url": F.exists("documents", lambda d: d["index_url"].isNull() | ~d["index_url"].rlike("^https?://")),
        "expected-units": c("expected_units").isNotNull() & (c("expected_units") <= 0),
        "no-documents": F.size("documents") <= 0,
    }
    own = sources.select("id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in rules.items()]))).alias("fault"))
    twice = sources.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate-id").alias("fault"))
    return own.unionByName(twice)


def selected_document(sources: DataFrame, source: str, language: str) -> dict:
    """The one document of a source and language, or an error that lists what there is."""
    rows = sources.select("id", F.explode("documents").alias("d")).select("id", "d.*")
    found = rows.where((F.col("id") == source) & (F.col("language") == language)).take(1)
    if not found:
        there = ", ".join(sorted(f"{r['id']}/{r['language']}" for r in rows.select("id", "language").collect()))
        raise ValueError(f"no document {source}/{language}; there are {there}")
    return found[0].asDict()


def errata(raw: str | None, source: str, expected_units: int | None = None) -> dict:
    """The errata of a source: relabels, allowed, text_probes, furniture, summary_omitted, expected_units; extra prose is ignored.

    Without a file there are none, provided the expected count is known.
    """
    if raw is None:
        if expected_units is None:
            raise ValueError(f"{source} has neither errata nor an expected count")
        body: Mapping = {}
    else:
        body = parsed(raw) or {}
    needed = {"relabels": ("page", "found_label", "occurrence", "correct_locator"), "allowed": ("locator", "kind"), "text_probes": ("locator", "probe")}
    out = {"source": source, "expected_units": body.get("expected_units", expected_units)}
    for name, keys in needed.items():
        out[name] = [{k: entry[k] for k in keys} for entry in body.get(name, [])]
    for name in ("furniture", "summary_omitted"):
        out[name] = list(body.get(name, []))
    return out


def gold_set(spark: SparkSession, folder: str | Path) -> DataFrame:
    """The questions of a folder (q-*.yaml), by id. An empty folder, an unknown key or a repeated id is an error."""
    rows = [parsed(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("q-*.yaml"))]
    if not rows:
        raise ValueError(f"no questions in {folder}")
    for row in rows:
        if extra := set(row) - QUESTION_KEYS:
            raise ValueError(f"{row.get('id')}: unknown keys {', '.join(sorted(extra))}")
    ids = [r["id"] for r in rows]
    if repeated := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"repeated ids {', '.join(repeated)}")
    rows = [{"expected_units": [], "expects_refusal": False, "cross_lingual": False, **r} for r in rows]
    return spark.createDataFrame(sorted(rows, key=lambda r: r["id"]), GOLD)


def gold_faults(questions: DataFrame) -> DataFrame:
    """(id, fault) of questions: repeated ids, domains, and units expected together with a refusal."""
    c = F.col
    expects = F.size(F.coalesce("expected_units", F.array().cast("array<string>"))) > 0
    rules = {"language": ~c("language").isin(*LANGUAGES), "blank-question": ~F.coalesce(c("question").rlike(r"\S"), F.lit(False)), "refusal-with-units": c("expects_refusal") & expects}
    own = questions.select("id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in rules.items()]))).alias("fault")).distinct()
    twice = questions.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated-id").alias("fault"))
    return own.unionByName(twice)


@F.pandas_udf(StringType())
def _decoded(raw: pd.Series, encodings: pd.Series) -> pd.Series:
    def one(b: bytes | None, e: str | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode(e or "utf-8", "replace")
        except LookupError:
            return bytes(b).decode("utf-8", "replace")

    return pd.Series([one(b, e) for b, e in zip(raw, encodings, strict=True)])


def decoded(raw: Column, encoding: Column) -> Column:
    """Bytes as text in the declared encoding; bytes that do not fit become U+FFFD, an unknown encoding is read as UTF-8."""
    return _decoded(raw, F.trim(F.lower(encoding)))


def cached_pages(spark: SparkSession, folder: str, encoding: str = "utf-8") -> DataFrame:
    """Pages kept as files <folder>/<source>/<language>/<page>.html: (source_id, language, page, html)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(folder)
    parts = F.regexp_extract_all(F.regexp_replace("path", r"\.html$", ""), F.lit("([^/]+)"), F.lit(1))
    return files.select(F.element_at(parts, -3).alias("source_id"), F.element_at(parts, -2).alias("language"), F.element_at(parts, -1).alias("page"), decoded(F.col("content"), F.lit(encoding)).alias("html"))


def markdown_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Documents of a tree: (path below the folder, content)."""
    root = Path(folder).resolve().as_posix()
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root, wholetext=True)
    path = F.regexp_replace(F.input_file_name(), f"^.*?{root}/", "")
    return files.select(path.alias("path"), F.col("value").alias("content"))


def previous_lock(path: str | Path) -> Mapping | None:
    """A lock manifest written before; null if it cannot be read, whatever the reason."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None

