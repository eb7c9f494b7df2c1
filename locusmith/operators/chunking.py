"""Chunks of units: one unit each, or the passages of an article up to a budget of characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmith.functions.text import article_of
from locusmith.operators.fold import ordered_fold

#: Characters (code points) of a chunk's texts; labels and line ends do not count.
BUDGET = 6000


def numbered_paragraph(units: DataFrame, document: list[str], order: str = "ordinal") -> DataFrame:
    """One chunk per unit: document columns, chunk_no, strategy, text, unit_locators."""
    return units.select(*document, F.col(order).alias("chunk_no"), F.lit("numbered-paragraph@1").alias("strategy"), "text", F.array("locator").alias("unit_locators"))


# The names of passages by the role in their locator.
PASSAGES = {"pr": "Prooemium", "co": "Respondeo", "adarg": "Ad argumentum"}
COUNTED = {"arg": "Obiectio", "sc": "Sed contra", "ad": "Ad"}


def passage_label(locator: Column) -> Column:
    role = F.regexp_extract(locator, r"([^.:]*)$", 1)
    kind, number = F.regexp_extract(role, r"^(arg|sc|ad)\d*$", 1), F.regexp_extract(role, r"^(?:arg|sc|ad)(\d*)$", 1)
    named = F.create_map(*[F.lit(x) for p in PASSAGES.items() for x in p])[role]
    counted = F.create_map(*[F.lit(x) for p in COUNTED.items() for x in p])[kind]
    return F.coalesce(named, F.when(number != "", F.concat(counted, F.lit(" "), number)).otherwise(counted), role)


def batches(units: DataFrame, document: list[str], order: str = "ordinal", budget: int = BUDGET) -> DataFrame:
    """Units with article, article_no (by first appearance) and batch: a unit opens a new batch where the article's open one holds something and would exceed the budget.

    A unit over the budget gets a batch of its own. The fold sees sizes only; texts do not pass through it.
    """
    rows = units.withColumn("article", article_of(F.col("locator")))

    def step(state: tuple[int, int], row) -> tuple[tuple[int, int], int]:
        batch, size = state
        if size >= 0 and size + row.chars > budget:
            batch, size = batch + 1, -1
        return (batch, max(size, 0) + row.chars), batch

    sized = rows.select(*document, "article", "locator", order, F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    folded = ordered_fold(sized, [*document, "article"], [order, "locator"], lambda: (0, -1), step, "batch", "int")
    first = Window.partitionBy(*document, "article")
    return folded.withColumn("_first", F.min(order).over(first))


def scholastic_article(units: DataFrame, document: list[str], order: str = "ordinal", budget: int = BUDGET) -> DataFrame:
    """Chunks of articles: document columns, article, batch, first_ordinal, strategy, text, unit_locators.

    The text is the article's locator and one line per passage, '[label] text'. A null text counts and shows as empty.
    """
    keys = [*document, "locator", order]
    rows = batches(units, document, order, budget).drop("chars", "_first").join(units.select(*keys, "text"), keys)
    line = F.concat(F.lit("["), passage_label(F.col("locator")), F.lit("] "), F.coalesce("text", F.lit("")))
    rows = rows.select(*document, "article", "batch", F.struct(F.col(order).alias("o"), "locator", line.alias("line")).alias("_u"))
    grouped = rows.groupBy(*document, "article", "batch").agg(F.sort_array(F.collect_list("_u")).alias("_us"))
    return grouped.select(
        *document,
        "article",
        "batch",
        F.col("_us")[0]["o"].alias("first_ordinal"),
        F.lit("scholastic-article@1").alias("strategy"),
        F.concat_ws("\n", F.array("article"), F.transform("_us", lambda u: u["line"])).alias("text"),
        F.transform("_us", lambda u: u["locator"]).alias("unit_locators"),
    )


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"numbered-paragraph": numbered_paragraph, "scholastic-article": scholastic_article}


def chunker(name: str) -> Callable[..., DataFrame]:
    """The chunker of a name; there is no default."""
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name}; there are {', '.join(sorted(CHUNKERS))}")
    return CHUNKERS[name]


def split_statistics(chunks: DataFrame, document: list[str]) -> DataFrame:
    """Per document: articles, those in one chunk, those split, and the most chunks of an article."""
    per = chunks.groupBy(*document, "article").agg(F.count_distinct("batch").alias("n"))
    return per.groupBy(*document).agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("n") == 1).alias("whole"), F.count_if(F.col("n") > 1).alias("split"), F.max("n").alias("most"))


def link_rows(chunks: DataFrame, units: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, locator, ordinal, unit_id): the units a chunk covers, numbered from 0; unit_id is null where the document lacks the unit."""
    rows = chunks.select(key, "document_id", F.posexplode("unit_locators").alias("ordinal", "locator"))
    ids = units.groupBy("document_id", "locator").agg(F.min("unit_id").alias("unit_id"))
    return rows.join(ids, ["document_id", "locator"], "left").select(key, "document_id", "locator", "ordinal", "unit_id")


def require_linked(links: DataFrame) -> DataFrame:
    """links, or an error if a chunk covers a unit its document lacks."""
    if not links.where("unit_id IS NULL").isEmpty():
        raise ValueError("a chunk covers a unit that its document lacks")
    return links
