"""Token counts under an existing tokenizer, and how much usable text each source, language and kind holds."""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from locusmith.plans.store import spread

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Names and codes of the corpus' languages beyond their two-letter code, without accents.
LANGUAGES = {"hun": "hu", "hungarian": "hu", "magyar": "hu", "hungarica": "hu", "eng": "en", "english": "en", "angol": "en", "anglica": "en", "lat": "la", "latin": "la", "latina": "la"}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    """The byte-level BPE of a rank file; loaded once in each worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Exact number of tokens of a text column, encoded in Arrow batches; null for null, special tokens read as text."""
    path = path or vocabulary_path()

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = tokenizer(path).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count(text)


def has_text(text: Column) -> Column:
    return text.rlike(r"[^\s\p{Z}\p{C}]")


def language_code(language: Column) -> Column:
    """hu-HU, HUN, ' hu', Hungarian and the like as hu; a spelling that is not known stays, in lower case."""
    spelled = F.lower(F.regexp_replace(language, r"[\s\p{Z}]+", ""))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    first = F.regexp_extract(spelled, "^[a-z]+", 0)
    return F.nullif(F.coalesce(known[first], first), F.lit(""))


def counted_chunks(chunks: DataFrame, documents: DataFrame, path: str | None = None) -> DataFrame:
    """One row per usable chunk: chunk_id, document_id, strategy, source, language, kind, tokens.

    Usable: the text is not null or blank. The chunk's document names its source, language and kind; only where the
    document is unknown are the chunk's own spellings used, brought to their usual form. Copies (one chunk_id) count once;
    of differing copies the greatest values stay. Texts are counted before the shuffle, so none travels.
    """
    facts = documents.groupBy("document_id").agg(F.max(F.struct("source_id", "language", "kind")).alias("_d"))
    kinds = documents.groupBy(F.lower(F.trim("source_id")).alias("_spelled")).agg(F.max("kind").alias("_kind"))
    rows = spread(chunks.select("chunk_id", "document_id", "source_id", "language", "strategy", "text")).where(has_text(F.col("text")))
    rows = rows.withColumn("tokens", token_count(F.col("text"), path)).drop("text")
    values = ["document_id", "strategy", "tokens", "source_id", "language"]
    once = rows.groupBy("chunk_id").agg(F.max(F.struct(*values)).alias("_c")).select("chunk_id", *[f"_c.{v}" for v in values])
    once = once.withColumn("_spelled", F.lower(F.trim("source_id"))).join(facts, "document_id", "left").join(kinds, "_spelled", "left")
    return once.select(
        "chunk_id",
        "document_id",
        "strategy",
        F.coalesce("_d.source_id", "_spelled").alias("source"),
        F.coalesce(F.col("_d.language"), language_code(F.col("language"))).alias("language"),
        F.coalesce("_d.kind", "_kind").alias("kind"),
        "tokens",
    )


def token_budget(counted: DataFrame) -> DataFrame:
    """Chunks and tokens by source, language and kind and every coarser slice (cube); a slice's open dimensions read '*'.

    A document chunked under several strategies holds the same text several times: the strategy with the most tokens is
    counted (ties: the first by name), and tokens_all_strategies keeps the sum over all. Sums are made per document and strategy in
    the map tasks, and the cube runs over those few rows.
    """
    per = counted.groupBy("document_id", "strategy", "source", "language", "kind").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"))
    best = Window.partitionBy("document_id", "source", "language", "kind").orderBy(F.col("tokens").desc(), "strategy")
    per = per.withColumn("_first", F.row_number().over(best) == 1)
    per = per.withColumns({c: F.coalesce(c, F.lit("?")) for c in ("source", "language", "kind")})
    flat = per.groupBy("source", "language", "kind").agg(
        F.sum(F.when(F.col("_first"), F.col("chunks")).otherwise(0)).alias("chunks"),
        F.sum(F.when(F.col("_first"), F.col("tokens")).otherwise(0)).alias("tokens"),
        F.sum("tokens").alias("tokens_all_strategies"),
    )
    dims = ("source", "language", "kind")
    cube = flat.cube(*dims).agg(*[F.sum(c).alias(c) for c in ("chunks", "tokens", "tokens_all_strategies")], *[F.grouping(d).alias(f"_{d}") for d in dims])
    return cube.select(*[F.when(F.col(f"_{d}") == 1, "*").otherwise(F.col(d)).alias(d) for d in dims], "chunks", "tokens", "tokens_all_strategies")


def document_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the documents that hold text."""
    rows = spread(documents.select("doc_id", "source", "text")).where(has_text(F.col("text")))
    return rows.select("doc_id", "source", token_count(F.col("text"), path).alias("tokens"))
