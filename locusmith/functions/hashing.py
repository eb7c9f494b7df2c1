"""Content identity: hashes of documents, pages, corpora, gold sets and settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_hash(html: Column) -> Column:
    return F.sha2(html, 256)


def pseudonym(identifier: Column) -> Column:
    return F.sha2(identifier.cast("string"), 256)


def document_hashes(units: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """(by..., content_hash): SHA-256 over locator, role and text of a document's units, a tab between and a newline after each.

    A null role counts as empty; a unit whose locator or text is null adds nothing. Units equal in order are taken by locator, then text.
    Lines stream through sorted partitions into a running digest, so a document of any size is hashed in constant memory, by one task.
    """
    line = F.concat("locator", F.lit("\t"), F.coalesce("role", F.lit("")), F.lit("\t"), "text", F.lit("\n"))
    rows = units.select(*by, F.col(order).alias("_order"), F.col("locator").alias("_locator"), line.alias("_line"))
    schema = ", ".join([*(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by), "content_hash string"])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, digest = None, None
        for batch in batches:
            done = []
            keys = zip(*[batch[b].astype(object).where(batch[b].notna(), None) for b in by], strict=True)
            for key, text in zip(keys, batch["_line"], strict=True):
                if digest is None or key != group:
                    if digest is not None:
                        done.append((*group, digest.hexdigest()))
                    group, digest = key, hashlib.sha256()
                if text is not None:
                    digest.update(text.encode("utf-8"))
            if done:
                yield pd.DataFrame(done, columns=[*by, "content_hash"])
        if digest is not None:
            yield pd.DataFrame([(*group, digest.hexdigest())], columns=[*by, "content_hash"])

    return rows.repartition(*by).sortWithinPartitions(*by, "_order", "_locator", "_line").mapInPandas(run, schema)


#: Ordinals of one leaf of tree_hashes.
LEAF = 1024


def tree_hashes(units: DataFrame, by: list[str], order: str = "ordinal", leaf: int = LEAF) -> DataFrame:
    """(by..., tree_hash): as document_hashes, but of a tree, so that a document of any size is hashed by many tasks.

    Leaves are the lines of `leaf` consecutive ordinals, the root is SHA-256 over the leaves' numbers and hashes in order. Only hashes come together in
    one place; units equal in order are taken by locator, then text, and lines that are null add nothing.
    """
    line = F.concat("locator", F.lit("\t"), F.coalesce("role", F.lit("")), F.lit("\t"), "text", F.lit("\n"))
    rows = units.select(*by, F.floor(F.col(order) / leaf).alias("_leaf"), F.struct(F.col(order).alias("o"), F.col("locator").alias("l"), line.alias("t")).alias("_u")).where("_u.t IS NOT NULL")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("_u")), lambda u: u["t"]), "")
    leaves = rows.groupBy(*by, "_leaf").agg(F.sha2(text, 256).alias("h"))
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("_leaf", "h"))), lambda n: F.concat(n["_leaf"].cast("string"), F.lit(":"), n["h"], F.lit("\n")))
    return leaves.groupBy(*by).agg(F.sha2(F.array_join(nodes, ""), 256).alias("tree_hash"))


def corpus_hash(documents: DataFrame) -> DataFrame:
    """One row: SHA-256 over 'source:language<tab>hash<newline>' of all documents, sorted by key (and hash). Without documents that of nothing.

    Sorted lines stream through one partition into a running digest, which needs no memory for them. A null in any of the three adds nothing.
    """
    key = F.concat("source_id", F.lit(":"), "language")
    lines = documents.select(key.alias("_key"), F.concat(key, F.lit("\t"), "content_hash", F.lit("\n")).alias("_line")).where("_line IS NOT NULL")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = hashlib.sha256()
        for batch in batches:
            digest.update("".join(batch["_line"]).encode("utf-8"))
        yield pd.DataFrame({"corpus_hash": [digest.hexdigest()]})

    whole = lines.repartition(1).sortWithinPartitions("_key", "_line").mapInPandas(run, "corpus_hash string")
    return whole.agg(F.coalesce(F.max("corpus_hash"), F.lit(hashlib.sha256(b"").hexdigest())).alias("corpus_hash"))


def gold_hash(questions: Iterable[Mapping[str, object]]) -> str:
    """SHA-256 of the questions as canonical JSON, sorted by id."""
    ordered = sorted(questions, key=lambda q: str(q["id"]))
    return hashlib.sha256(json.dumps(ordered, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def embedding_identity(model: str, settings: Mapping[str, object]) -> str:
    """The model and the digest of all settings that shape its vectors."""
    return f"{model}@onnx:{hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()}"


def artifact_hash(folder: str | Path) -> str:
    """SHA-256 over path, size and bytes of every file of an artifact; links are refused and an .onnx file is required."""
    root = Path(folder)
    files = sorted(p for p in root.rglob("*") if not p.is_dir())
    if any(p.is_symlink() for p in root.rglob("*")):
        raise ValueError("an artifact holds no symbolic links")
    if not any(p.suffix == ".onnx" for p in files):
        raise ValueError("an artifact holds an .onnx file")
    digest = hashlib.sha256()
    for p in files:
        digest.update(f"{p.relative_to(root).as_posix()}\0{p.stat().st_size}\0".encode())
        with p.open("rb") as stream:
            while block := stream.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()
