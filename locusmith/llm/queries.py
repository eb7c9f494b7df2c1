"""Queries of the problems on training text, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmith.llm import confusables, encoding, markup, mixing, packing, tokens, truncation
from locusmith.plans.store import table, written


def _damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.damage(table(spark, sf_dir, "source_pages", ["page_id", "html", "language"]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damage(spark, sf_dir).select("page_id").distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repaired_pages(table(spark, sf_dir, "source_pages", ["page_id", "html"]), _damage(spark, sf_dir))


def p2_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks", ["chunk_id", "document_id", "source_id", "language", "strategy", "text"])
    documents = table(spark, sf_dir, "emitted_documents", ["document_id", "source_id", "language", "kind"])
    return tokens.token_budget(tokens.counted_chunks(chunks, documents))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = table(spark, sf_dir, "context_units", ["context_id", "locator", "language", "text"])
    stored = table(spark, sf_dir, "stored_units", ["unit_id", "locator", "language", "text"])
    return confusables.same_look_pairs(context, stored, "context_id", "unit_id", ["locator", "language"])


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "stored_units", ["unit_id", "language", "text"])
    return confusables.look_classes(stored, "unit_id", ["language"])


def p5_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every text of both tables."""
    units = (("context_units", "context_id"), ("stored_units", "unit_id"))
    frames = [confusables.one_formed(table(spark, sf_dir, name, [key, "text"]).withColumnRenamed(key, "id"), "id").select(F.lit(name).alias("unit_table"), "id", "form") for name, key in units]
    return frames[0].unionByName(frames[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = table(spark, sf_dir, "context_units", ["context_id", "text"])
    return markup.clean_texts(context, "context_id").where(F.size("kinds") > 0).select("context_id").distinct()


def p6_clean_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = table(spark, sf_dir, "context_units", ["context_id", "text"])
    return markup.clean_texts(context, "context_id").select("context_id", "clean", F.array_join("kinds", ",").alias("kinds"))


def p6_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_pages(table(spark, sf_dir, "source_pages", ["page_id", "html"]))


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The container sizes: a fixed table of four rows, which become parameters of the packing."""
    return {r[0]: r[1] for r in table(spark, sf_dir, "container_sizes", ["container_id", "capacity_tokens"]).collect()}


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.document_tokens(table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))
    items = written(counted.select(F.col("doc_id").alias("item_id"), "tokens"), "document-tokens")
    return packing.packed(items, _capacities(spark, sf_dir)).withColumnRenamed("item_id", "doc_id")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir), _capacities(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = tokens.document_tokens(table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))
    return mixing.mixed(counted, table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


DOCUMENT_COLUMNS = ["doc_id", "text", "source", "genre"]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_documents(table(spark, sf_dir, "documents", DOCUMENT_COLUMNS)).select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", DOCUMENT_COLUMNS)
    return truncation.cut_rates(documents, truncation.cut_documents(documents))


QUERIES = {q.__name__: q for q in (p1_found, p1_repaired, p2_budget, p5_found, p5_classes, p5_one_form, p6_found, p6_clean_units, p6_clean_pages, p7_packing, p7_fill, p8_mix, p8_shares, p9_found, p9_rates)}

#: None of these is within reach of SQL (graph search, tokenizer, Unicode tables, tree building, online packing,
#: hash thresholds, stack automaton); tests/llm holds their brute-force comparisons.
ORACLE: dict[str, str] = {}
