"""The stored corpus: current documents, their chunks and units, and consistent snapshots of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_documents(documents: DataFrame) -> DataFrame:
    """Current document keys: (document_id, source_id, language)."""
    return documents.where("is_current").select("document_id", "source_id", "language").distinct()


def current_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of current documents: (source_id, language, chunk_id, strategy, text). Order is the reader's to ask for."""
    rows = chunks.select("chunk_id", "document_id", "strategy", "text").distinct()
    return rows.join(current_documents(documents), "document_id").select("source_id", "language", "chunk_id", "strategy", "text")


def chunk_units(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, units): the locators each chunk of a current document covers, as a sorted set."""
    rows = chunks.select("chunk_id", "document_id", F.explode("unit_locators").alias("locator"))
    rows = rows.join(current_documents(documents).select("document_id"), "document_id", "left_semi")
    return rows.groupBy("chunk_id").agg(F.array_sort(F.collect_set("locator")).alias("units"))


def current_units(units: DataFrame, documents: DataFrame, source: str | None = None, language: str | None = None) -> DataFrame:
    """Units of current documents, of one source and language if named."""
    docs = current_documents(documents)
    docs = docs.where(F.col("source_id") == source) if source else docs
    docs = docs.where(F.col("language") == language) if language else docs
    return units.join(docs.select("document_id", "source_id"), "document_id")


def page_of(rows: DataFrame, order: list[str], offset: int, size: int = 1000) -> DataFrame:
    """One page of rows in a stated order; without an order a page is a wrong answer, so it is required."""
    if not order:
        raise ValueError("a page needs an order")
    return rows.orderBy(*order).offset(offset).limit(size)


def page_after(rows: DataFrame, order: list[str], after: tuple | None, size: int = 1000) -> DataFrame:
    """The page that follows the row with the order's values after (the first page for None). Only the rows behind it are looked at, and each task keeps size of them, so a
    deep page costs no more than the first; the order must tell every row apart. Rows with a null in the order come on no page."""
    if not order:
        raise ValueError("a page needs an order")
    rows = rows.where(F.struct(*order).isNotNull() & ~F.exists(F.array(*[F.col(c).isNull() for c in order]), lambda x: x))
    if after is not None:
        if len(after) != len(order):
            raise ValueError("a place needs a value for every column of the order")
        rows = rows.where(F.struct(*order) > F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)]))
    return rows.orderBy(*order).limit(size)


def sibling_languages(documents: DataFrame) -> DataFrame:
    """(source_id, language, sibling): other languages of a source that have a current document."""
    docs = current_documents(documents).select("source_id", "language").distinct()
    other = docs.select("source_id", F.col("language").alias("sibling"))
    return docs.join(other, "source_id").where("language <> sibling")


def snapshot(read: Callable[[], dict[str, DataFrame]], checks: list[Callable[[dict[str, DataFrame]], DataFrame]]) -> dict[str, DataFrame]:
    """Frames read once for a run, or an error naming the first check that finds a defect in them."""
    frames = read()
    for check in checks:
        defects = check(frames)
        if not defects.isEmpty():
            raise ValueError(f"{getattr(check, '__name__', 'check')} failed: {defects.first().asDict()}")
    return frames

