"""The versioned store: idempotent upserts of sources and documents, vectors kept once, and lock manifests written only on change."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_crashed(documents: DataFrame) -> DataFrame:
    """documents without those a crashed run left: not current and without units. A null in either is no proof of a crash."""
    return documents.where(~F.coalesce(~F.col("is_current") & (F.col("unit_count") == 0), F.lit(False)))


def children_of(children: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """The children whose document is still there: what a cascading delete leaves."""
    return children.join(documents.select(key).distinct(), key, "left_semi")


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new put in by key; of several new rows of a key the last by order counts (without one, the greatest)."""
    columns = [c for c in new.columns if c not in key]
    ranked = F.struct(*([F.col(order).alias("_o")] if order else []), *[F.col(c) for c in columns])
    last = new.groupBy(*key).agg(F.max(ranked).alias("_r")).select(*key, *[f"_r.{c}" for c in columns])
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def document_id(source: str = "source_id", language: str = "language", content: str = "content_hash"):
    """An id that follows from what the document is, so that repeated runs give the same."""
    return F.sha2(F.concat_ws(":", source, language, content), 256)


def versioned(history: DataFrame, incoming: DataFrame, at: str = "ingested_at") -> DataFrame:
    """history with new versions of documents (source_id, language, content_hash, unit_count, ingested_at), one current per source and language.

    An incoming version equal in content to the current one changes nothing; any other is added, and the latest version becomes the
    only current one (ties by hash). Old versions stay for good.
    """
    key = ["source_id", "language"]
    current = history.where("is_current").select(*key, "content_hash")
    fresh = incoming.join(current, [*key, "content_hash"], "left_anti").dropDuplicates([*key, "content_hash"])
    columns = [*key, "content_hash", "unit_count", at]
    touched = fresh.select(*key).distinct().withColumn("_touched", F.lit(True))
    every = history.select(*columns, "is_current", F.lit(False).alias("_new")).unionByName(fresh.select(*columns, F.lit(False).alias("is_current"), F.lit(True).alias("_new")))
    every = every.join(touched, key, "left")
    latest = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col(at).desc(), "content_hash"))
    current_now = F.when(F.col("_touched"), latest == 1).otherwise(F.col("is_current"))
    return every.withColumn("_current", current_now).select(document_id().alias("document_id"), *columns, F.col("_current").alias("is_current"))


def several_current(documents: DataFrame) -> DataFrame:
    """(source_id, language) with more than one current document."""
    return documents.where("is_current").groupBy("source_id", "language").agg(F.count(F.lit(1)).alias("current")).where("current > 1")


def new_vectors(vectors: DataFrame, stored: DataFrame, order: str, key: tuple[str, str] = ("chunk_id", "model")) -> DataFrame:
    """The vectors to add: first by order of each key, none whose key is stored."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return vectors.withColumn("_n", first).where("_n = 1").drop("_n").join(stored.select(*key), list(key), "left_anti")


def merged_lock(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lock entries by (source_id, language): new ones replace old ones."""
    return old.join(new.select("source_id", "language"), ["source_id", "language"], "left_anti").unionByName(new)


def lock_changed(old: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: how many entries are new or gone; the time of generation is no part of an entry."""
    plus = merged.exceptAll(old).agg(F.count(F.lit(1)).alias("added"))
    minus = old.exceptAll(merged).agg(F.count(F.lit(1)).alias("removed"))
    return plus.join(F.broadcast(minus)).withColumn("write", (F.col("added") > 0) | (F.col("removed") > 0))


def write_lock(path: str | Path, entries: list[Mapping], generated_at: str) -> bool:
    """Writes a lock manifest sorted by source and language, unless its entries are those already there; returns whether it wrote."""
    from locusmith.sources.files import previous_lock

    ordered = sorted((dict(e) for e in entries), key=lambda e: (e["source_id"], e["language"]))
    before = previous_lock(path)
    if before is not None and before.get("documents") == ordered:
        return False
    Path(path).write_text(json.dumps({"generated_at": generated_at, "documents": ordered}, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return True


def merged_results(old: DataFrame, new: DataFrame, slate: DataFrame) -> DataFrame:
    """Results by model_id, new ones in place of old, in the order of slate (model_id, position); unknown models last, by id."""
    rows = old.join(new.select("model_id"), "model_id", "left_anti").unionByName(new).join(slate.select("model_id", "position"), "model_id", "left")
    place = F.row_number().over(Window.orderBy(F.col("position").isNull(), "position", "model_id"))
    return rows.withColumn("place", place).drop("position")


def revision_diff(old: DataFrame, new: DataFrame, key: str = "locator", text: str = "text") -> DataFrame:
    """(key, change) between two revisions of a document's units: added, removed or changed."""
    a = old.select(key, F.col(text).alias("_a"), F.lit(True).alias("_old"))
    b = new.select(key, F.col(text).alias("_b"), F.lit(True).alias("_new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")
