"""Assertions over units, documents and gold sets. Every check is a frame of defects; an empty one passes only beside a count of what was checked."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmith.functions import text as T
from locusmith.functions.hashing import document_hashes


def relabelled(units: DataFrame, relabels: DataFrame, document: list[str], order: str = "ordinal") -> DataFrame:
    """Units with the corrections of relabels (page, label, occurrence, correct_locator, correct_sequence) applied.

    A correction names the n-th unit of a page with that label. Corrected units keep their old locator in relabelled_from;
    the units of a document are then sorted by sequence (equal ones as they were) and numbered from 1 again.
    """
    nth = F.row_number().over(Window.partitionBy(*document, "page", "label").orderBy(order))
    fixes = relabels.select("page", "label", F.col("occurrence").alias("_nth"), "correct_locator", "correct_sequence")
    both = units.withColumn("_nth", nth).join(fixes, ["page", "label", "_nth"], "left")
    both = both.withColumns(
        {
            "relabelled_from": F.when(F.col("correct_locator").isNotNull(), F.col("locator")),
            "locator": F.coalesce("correct_locator", "locator"),
            "sequence": F.coalesce("correct_sequence", "sequence"),
            "_was": F.col(order),
        }
    )
    again = F.row_number().over(Window.partitionBy(*document).orderBy("sequence", "_was"))
    return both.withColumn(order, again).drop("_nth", "_was", "correct_locator", "correct_sequence")


def anchor_defects(units: DataFrame, document: list[str]) -> DataFrame:
    """Units whose anchor is absent, lacks its prefix or is mistyped; units without an anchor signal or relabelled are not looked at.

    units: the document columns, locator, label, anchor, anchor_expected, anchor_signal, relabelled_from.
    """
    kind = F.when(F.col("anchor").isNull(), "anchor-absent").when(F.col("anchor") != F.col("anchor_expected"), F.when(F.col("anchor") == F.col("label"), "anchor-missing-prefix").otherwise("anchor-typo"))
    rows = units.where("anchor_signal AND relabelled_from IS NULL")
    return rows.select(*document, "locator", kind.alias("kind")).where("kind IS NOT NULL")


def order_defects(units: DataFrame, document: list[str], order: str = "ordinal") -> DataFrame:
    """Units (document..., locator, sequence) whose sequence does not exceed the greatest before it; arrays compare element by element, a prefix first."""
    before = Window.partitionBy(*document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = units.withColumn("_max", F.max("sequence").over(before))
    return rows.where("_max >= sequence").select(*document, "locator", F.lit("number-not-increasing").alias("kind"))


#: Missing numbers that one row unfolds into at a time.
GAP_BLOCK = 10_000


def gap_ranges(units: DataFrame, document: list[str], order: str = "ordinal", number: str = "number") -> DataFrame:
    """Ranges missing from the dense sequence of each document, from 1 on: (document..., first, last, after, before)."""
    before = Window.partitionBy(*document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = units.withColumn("_max", F.coalesce(F.max(number).over(before), F.lit(0)))
    gaps = rows.where(F.col(number) - F.col("_max") > 1)
    return gaps.select(*document, (F.col("_max") + 1).alias("first"), (F.col(number) - 1).alias("last"), F.col("_max").alias("after"), F.col(number).alias("before"))


def gap_defects(units: DataFrame, document: list[str], order: str = "ordinal", number: str = "number") -> DataFrame:
    """Numbers missing from the dense sequence of each document, from 1 on: (document..., missing, after, before). Wide gaps unfold block by block."""
    ranges = gap_ranges(units, document, order, number)
    blocks = ranges.withColumn("_from", F.explode(F.sequence("first", "last", F.lit(GAP_BLOCK).cast(ranges.schema["first"].dataType))))
    upto = F.least(F.col("last"), F.col("_from") + F.lit(GAP_BLOCK - 1))
    return blocks.select(*document, F.explode(F.sequence(F.col("_from"), upto)).alias("missing"), "after", "before")


def count_defects(units: DataFrame, expected: DataFrame, document: list[str]) -> DataFrame:
    """Documents of expected (document..., expected_units) whose number of units is another: (document..., units, expected_units)."""
    per = units.groupBy(*document).agg(F.count(F.lit(1)).alias("units"))
    both = expected.select(*document, "expected_units").join(per, document, "left").withColumn("units", F.coalesce("units", F.lit(0)))
    return both.where("NOT units <=> expected_units").select(*document, "units", "expected_units")


def undeclared(found: DataFrame, allowed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Defects nobody has declared; repeated ones stay repeated."""
    return found.join(allowed.select(*on).distinct(), list(on), "left_anti")


def stale(found: DataFrame, allowed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Declarations of defects that no longer occur."""
    return allowed.join(found.select(*on).distinct(), list(on), "left_anti")


def locator_comparison(incoming: DataFrame, existing: DataFrame, by: list[str], locator: str = "locator") -> DataFrame:
    """Per group: locators shared, only incoming and only existing; fails where any differ or one side is empty."""
    a = incoming.select(*by, locator).distinct().withColumn("_a", F.lit(1))
    b = existing.select(*by, locator).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, [*by, locator], "full_outer")
    per = both.groupBy(*by).agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"),
        F.count_if(F.col("_b").isNull()).alias("only_incoming"),
        F.count_if(F.col("_a").isNull()).alias("only_existing"),
    )
    return per.withColumn("fails", (F.col("only_incoming") > 0) | (F.col("only_existing") > 0) | (F.col("shared") == 0))


def role_divergence(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Locators of left (by..., locator, role) whose role is another in right; one missing from right differs, even from a null role."""
    on = [*by, "locator"]
    b = right.select(*on, F.col("role").alias("other_role"), F.lit(True).alias("_there"))
    both = left.select(*on, "role").join(b, on, "left")
    return both.where("_there IS NULL OR NOT role <=> other_role").select(*on, "role", "other_role")


def revision_disagreements(documents: DataFrame) -> DataFrame:
    """Sources whose documents are of several revisions: (source_id, revision, languages)."""
    per = documents.groupBy("source_id", "revision").agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))
    several = per.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return per.join(several, "source_id").select("source_id", "revision", "languages")


@dataclass(frozen=True)
class Probe:
    name: str
    pattern: str
    why: str


# The text probes. Blanks are those of ECMAScript.
TEXT_PROBES = (
    Probe("markup-residue", r"<[a-zA-Z/]", "text that still opens or closes an element"),
    Probe("entity-residue", r"&[a-zA-Z0-9#]+;", "text that still spells a character by reference"),
    Probe("bracket-footnote", r"\[[0-9]+\]", "a number in brackets, as notes are called"),
    Probe("empty-text", f"^(?:{T.BLANKS})?$", "nothing is left to cite"),
    Probe("double-space", "  ", "two blanks side by side"),
    Probe("leading-marker-residue", r"^[0-9.]", "begins with what belongs to its number"),
)


def furniture_probe(word: str) -> Probe:
    """Finds a word of the page template, as a whole word of Unicode letters, digits and underscores."""
    return Probe(f"furniture:{word}", rf"(?<![\p{{L}}\p{{N}}_]){re.escape(word)}(?![\p{{L}}\p{{N}}_])", f"{word} belongs to the page template")


def probe_hits(units: DataFrame, probes: Sequence[Probe] = TEXT_PROBES, key: Sequence[str] = ("locator",)) -> DataFrame:
    """One row per unit and probe that matches: key columns, probe, excerpt (90 characters and an ellipsis). Null texts match nothing."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p.pattern), F.lit(p.name)) for p in probes]))
    return units.select(*key, F.explode(hits).alias("probe"), F.concat(F.substring("text", 1, 90), F.lit("…")).alias("excerpt"))


def probe_summary(hits: DataFrame, units: DataFrame, probes: Sequence[Probe] = TEXT_PROBES) -> DataFrame:
    """One row per probe: units checked and hits, with zero where nothing was found; a check over no unit is a violation."""
    names = hits.sparkSession.createDataFrame([(p.name, p.why) for p in probes], "probe string, why string")
    checked = units.agg(F.count(F.lit(1)).alias("checked"))
    per = hits.groupBy("probe").agg(F.count(F.lit(1)).alias("hits"))
    out = names.join(per, "probe", "left").join(F.broadcast(checked)).withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select("probe", "why", "checked", "hits", (F.col("checked") == 0).alias("vacuous"))


def probe_message(hits: int, probe: str, samples: Sequence[str], shown: int = 5) -> str:
    """A failure in words, with the first samples and how many more there are."""
    more = f" … and {hits - shown} more" if hits > shown else ""
    return f"{probe}: {hits} unit(s): {', '.join(samples[:shown])}{more}"


def orphan_chunks(chunks: DataFrame, key: str = "chunk_id", locators: str = "unit_locators") -> DataFrame:
    """Chunks that cover no unit."""
    return chunks.where(F.col(locators).isNull() | (F.size(locators) == 0)).select(key).distinct()


def missing_sources(gold: DataFrame, present: DataFrame) -> DataFrame:
    """Sources of gold locators that are not among the present ones: (source_id)."""
    wanted = gold.select(F.explode("expected_units").alias("l")).where("l IS NOT NULL").select(T.source_of(F.col("l")).alias("source_id")).distinct()
    return wanted.exceptAll(present.select("source_id").distinct())


def resolution(expected: DataFrame, units: DataFrame, documents: DataFrame) -> DataFrame:
    """expected (question_id, locator) with verdict: resolved (a current unit has the locator), failure (its source is held) or pending (it is not).

    units and documents: those that are current, with locator and source_id.
    """
    known = units.select("locator").distinct().withColumn("_unit", F.lit(True))
    held = documents.select("source_id").distinct().withColumn("_held", F.lit(True))
    rows = expected.withColumn("source_id", T.source_of(F.col("locator"))).join(known, "locator", "left").join(held, "source_id", "left")
    verdict = F.when(F.col("_unit"), "resolved").when(F.col("_held"), "failure").otherwise("pending")
    return rows.select("question_id", "locator", "source_id", verdict.alias("verdict"))


def hash_mismatches(units: DataFrame, documents: DataFrame, by: str = "document_id") -> DataFrame:
    """Documents whose stored content_hash is not that of their units: (by, content_hash, derived)."""
    derived = document_hashes(units, [by]).withColumnRenamed("content_hash", "derived")
    return documents.select(by, "content_hash").join(derived, by).where("content_hash <> derived")


def slate_violations(slate: DataFrame) -> DataFrame:
    """Rules a slate of embedding models breaks: (rule, model_id).

    slate: model_id, base_family, serving, local (measurable without sending the corpus away), query_prefix, passage_prefix, prefix_note.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    asymmetric = blank(F.col("query_prefix")) != blank(F.col("passage_prefix"))
    rules: Mapping[str, Column] = {
        "not-measurable": ~F.col("local"),
        "not-servable": F.col("serving") == "none",
        "undeclared-asymmetry": asymmetric & blank(F.col("prefix_note")),
    }
    own = slate.select("model_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))
    twice = slate.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("model_id", F.lit("duplicate-model").alias("rule"))
    few = slate.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("base_family").alias("f"))
    whole = few.select(F.lit(None).cast("string").alias("model_id"), F.when(F.col("n") < 2, "too-few").when(F.col("f") == 1, "one-family").alias("rule")).where("rule IS NOT NULL")
    return own.unionByName(twice).unionByName(whole)


def artifact_violations(artifacts: DataFrame, conventions: DataFrame) -> DataFrame:
    """(model_id, rule): artifacts that may not stand for their model.

    artifacts: model_id, base_family, pooling, quantization (of its settings, null for none), files (names). conventions: model_id, pooling (as
    measured), base_family, quantized_fails (whether quantized exports of the family failed the fidelity control). A model without a convention is unknown.
    An artifact is quantized if its settings or the name of a model file say so.
    """
    known = conventions.select("model_id", F.col("pooling").alias("_pooling"), "quantized_fails", F.lit(True).alias("_known"))
    rows = artifacts.join(known, "model_id", "left")
    named = F.exists(F.coalesce("files", F.array().cast("array<string>")), lambda f: f.endswith(".onnx") & f.contains("quantized"))
    quantized = F.coalesce(F.col("quantization"), F.lit("")) != ""
    rules: Mapping[str, Column] = {
        "unknown-model": F.col("_known").isNull(),
        "pooling": F.col("_known").isNotNull() & ~F.col("pooling").eqNullSafe(F.col("_pooling")),
        "quantized-failed": F.coalesce("quantized_fails", F.lit(False)) & (quantized | named),
        "no-model-file": ~F.exists(F.coalesce("files", F.array().cast("array<string>")), lambda f: f.endswith(".onnx")),
    }
    return rows.select("model_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))


def with_vacuity(violations: DataFrame, checked: DataFrame, rule: str) -> DataFrame:
    """violations (rule, detail), and one more if nothing was checked."""
    empty = checked.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(rule).alias("rule"), F.lit("nothing was checked").alias("detail"))
    return violations.select("rule", "detail").unionByName(empty)
