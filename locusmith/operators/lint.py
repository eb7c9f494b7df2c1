"""Checks of a tree of Markdown documents: prose, links, headings, anchors, and what each kind of document must hold."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from locusmith.functions.text import slug

# Shapes of Markdown and the marker of a summary.
FENCE = r"^\s*(?:```|~~~)"
LINK = r'\[[^\]]*\]\(\s*<?([^)\s>]+)>?(?:\s+"[^"]*")?\s*\)'
HEADING = r"^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
SUMMARY, SUMMARY_LINES = "> **TL;DR**", 20
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"


def lines(docs: DataFrame) -> DataFrame:
    """(path, line, text) of every line of docs (path, content), from 1."""
    return docs.select("path", F.posexplode(F.split("content", "\n")).alias("_p", "text")).select("path", (F.col("_p") + 1).alias("line"), "text")


def prose(docs: DataFrame) -> DataFrame:
    """Lines outside fenced code. A fence toggles; the fences themselves are no prose."""
    fence = F.col("text").rlike(FENCE)
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(docs).withColumn("_fence", fence).withColumn("_fences", F.sum(F.col("_fence").cast("int")).over(upto))
    return rows.where("NOT _fence AND _fences % 2 = 0").select("path", "line", "text")


def links(docs: DataFrame) -> DataFrame:
    """(path, line, target) of inline links and images; code spans hold none."""
    bare = F.regexp_replace("text", "`[^`]*`", "")
    return prose(docs).select("path", "line", F.explode(F.regexp_extract_all(bare, F.lit(LINK), F.lit(1))).alias("target"))


def headings(docs: DataFrame) -> DataFrame:
    """(path, line, level, heading)."""
    rows = prose(docs).where(F.col("text").rlike(HEADING))
    return rows.select("path", "line", F.length(F.regexp_extract("text", HEADING, 1)).alias("level"), F.regexp_extract("text", HEADING, 2).alias("heading"))


def anchors(docs: DataFrame) -> DataFrame:
    """(path, line, anchor) of headings; the second of a name ends in -1, the third in -2."""
    rows = headings(docs).withColumn("_slug", slug(F.regexp_replace("heading", r"!\[", "["))).where("_slug <> ''")
    nth = F.row_number().over(Window.partitionBy("path", "_slug").orderBy("line")) - 1
    return rows.withColumn("_n", nth).select("path", "line", F.when(F.col("_n") == 0, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), F.col("_n"))).alias("anchor"))


@F.pandas_udf(StringType())
def _resolved(paths: pd.Series, targets: pd.Series) -> pd.Series:
    def one(path: str, target: str) -> str:
        return posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(target.split("#")[0].split("?")[0])))

    return pd.Series([one(p, t) for p, t in zip(paths, targets, strict=True)])


@F.pandas_udf(StringType())
def _fragment(targets: pd.Series) -> pd.Series:
    return pd.Series([unquote(t.partition("#")[2]).lower() or None for t in targets])


def resolved_links(docs: DataFrame) -> DataFrame:
    """links with relative (stays in the tree and on no other host), resolved path and fragment."""
    rows = links(docs).withColumn("relative", ~F.col("target").rlike(SCHEME) & ~F.col("target").startswith("#"))
    own = F.col("target").startswith("#")
    return rows.withColumns({"resolved": F.when(own, F.col("path")).when(F.col("relative"), _resolved("path", "target")), "fragment": _fragment("target")})


def broken_links(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, target, resolved) of relative links that lead out of the tree or to no file of files (path)."""
    known = files.select(F.col("path").alias("resolved")).distinct().withColumn("_there", F.lit(True))
    rows = resolved_links(docs).where("relative").join(known, "resolved", "left")
    return rows.where("_there IS NULL OR resolved LIKE '..%'").select("path", "line", "target", "resolved")


def anchor_checks(docs: DataFrame) -> DataFrame:
    """(path, line, target, verdict) of links with a fragment: ok, broken, or skipped where the target is no document of docs."""
    rows = resolved_links(docs).where("fragment IS NOT NULL AND resolved IS NOT NULL")
    known = docs.select(F.col("path").alias("resolved"), F.lit(True).alias("_doc"))
    named = anchors(docs).select(F.col("path").alias("resolved"), F.col("anchor").alias("fragment"), F.lit(True).alias("_anchor")).distinct()
    rows = rows.join(known, "resolved", "left").join(named, ["resolved", "fragment"], "left")
    verdict = F.when(F.col("_doc").isNull(), "skipped").when(F.col("_anchor").isNull(), "broken").otherwise("ok")
    return rows.select("path", "line", "target", verdict.alias("verdict"))


def without_summary(docs: DataFrame) -> DataFrame:
    """Documents without a summary block in their first lines: (path)."""
    having = lines(docs).where((F.col("line") <= SUMMARY_LINES) & F.col("text").startswith(SUMMARY)).select("path")
    return docs.select("path").join(having, "path", "left_anti")


def not_indexed(paths: DataFrame, index: DataFrame) -> DataFrame:
    """Paths no link of the index names by file name: (path)."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    linked = links(index).select(base(F.regexp_replace("target", r"[#?].*$", "")).alias("_base"))
    return paths.select("path", base("path").alias("_base")).join(linked, "_base", "left_anti").select("path")


def without_walkthrough(modules: DataFrame, walkthrough: DataFrame) -> DataFrame:
    """Modules (path) no heading of the walkthrough names in code type: (module)."""
    named = lines(walkthrough).where(F.col("text").rlike(r"^#{1,6}\s")).select(F.explode(F.regexp_extract_all("text", F.lit("`([^`]*)`"), F.lit(1))).alias("module"))
    names = modules.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("module")).where("module <> '__init__.py'")
    return names.join(named, "module", "left_anti")


def report(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, checked, violations, skipped, vacuous) of the link and anchor rules."""
    relative = resolved_links(docs).where("relative").agg(F.count(F.lit(1)).alias("checked"))
    bad = broken_links(docs, files).agg(F.count(F.lit(1)).alias("violations"))
    by_link = relative.join(F.broadcast(bad)).select(F.lit("link").alias("rule"), "checked", "violations", F.lit(0).cast("bigint").alias("skipped"))
    v = F.col("verdict")
    by_anchor = anchor_checks(docs).agg(F.count_if(v != "skipped").alias("checked"), F.count_if(v == "broken").alias("violations"), F.count_if(v == "skipped").alias("skipped"))
    both = by_link.unionByName(by_anchor.select(F.lit("anchor").alias("rule"), "checked", "violations", "skipped"))
    return both.withColumn("vacuous", F.col("checked") == 0)
