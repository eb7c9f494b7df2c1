"""Queries of the source, check, chunk, hash and storage operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmith.functions import hashing, vectors
from locusmith.functions import text as T
from locusmith.operators import checks, chunking, storage
from locusmith.plans.store import table
from locusmith.plans.ingest import compared_languages
from locusmith.plans.text_queries import CONTEXT, PAGES, UNITS, context_table, page_table, quoted, unit_table
from locusmith.sources import corpus, files

DOCS = "(SELECT DISTINCT document_id, source_id, language, revision, edition, content_hash, unit_count, chunk_count, emitted_at, withdrawn_at, withdrawn_at IS NULL AS is_current FROM emitted_documents)"
CHUNKS = "(SELECT DISTINCT chunk_id, document_id, strategy, text, token_count, unit_locators FROM chunks)"
GOLD = "(SELECT DISTINCT id, question, language, category, expected_units, expects_refusal, cross_lingual, notes FROM gold_questions)"


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["document_id", "source_id", "language", "revision", "edition", "content_hash", "unit_count", "chunk_count", "emitted_at", "withdrawn_at"]
    return table(spark, sf_dir, "emitted_documents", columns).distinct().withColumn("is_current", F.col("withdrawn_at").isNull())


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks", ["chunk_id", "document_id", "strategy", "text", "token_count", "unit_locators"]).dropDuplicates(["chunk_id"])


def gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gold_questions", ["id", "question", "language", "category", "expected_units", "expects_refusal", "cross_lingual", "notes"]).dropDuplicates(["id"])


# --- sources


def src3_gold_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = F.when(F.length("question") % 7 == 0, F.upper("language")).otherwise(F.col("language"))
    return files.gold_faults(gold_table(spark, sf_dir).withColumn("language", spoilt))


def src7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.current_chunks(chunk_table(spark, sf_dir), document_table(spark, sf_dir))


def src8_chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_units(chunk_table(spark, sf_dir), document_table(spark, sf_dir)).select("chunk_id", F.array_join("units", ",").alias("units"))


def src9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.current_documents(document_table(spark, sf_dir))


def src11_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.current_units(unit_table(spark, sf_dir, "document_id", "locator", "ordinal"), document_table(spark, sf_dir)).select("document_id", "ordinal", "unit_id", "locator")
    return corpus.page_of(rows, ["document_id", "ordinal", "unit_id"], 1000)


def src11_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind a place in the middle, by language and unit."""
    rows = unit_table(spark, sf_dir, "language", "locator").select("language", "unit_id", "locator")
    return corpus.page_after(rows, ["language", "unit_id"], ("hu", 500), 1000)


def src12_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sibling_languages(document_table(spark, sf_dir))


def src13_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.current_units(unit_table(spark, sf_dir, "document_id", "locator"), document_table(spark, sf_dir)).select("document_id", "locator")


# --- checks


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose address is a number, ordered within their document by ordinal and id."""
    rows = unit_table(spark, sf_dir, "document_id", "locator", "ordinal", "text")
    number = F.regexp_extract("locator", r":(\d+)$", 1)
    rows = rows.where(number != "").withColumn("number", number.cast("bigint"))
    return rows.select("unit_id", "document_id", "locator", "text", "number", (F.col("ordinal").cast("bigint") * 10**10 + F.col("unit_id")).alias("place"))


NUMBERED = f"(SELECT unit_id, document_id, locator, text, TRY_CAST(regexp_extract(locator, ':(\\d+)$', 1) AS BIGINT) AS number, CAST(ordinal AS BIGINT) * 10000000000 + unit_id AS place FROM {UNITS} WHERE regexp_matches(locator, ':\\d+$'))"


def ast2_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = numbered(spark, sf_dir).select("unit_id", "document_id", F.col("document_id").alias("page"), "locator", F.col("number").cast("string").alias("label"), F.array(F.col("number")).alias("sequence"), F.col("place").alias("ordinal"))
    wrong = units.where("sequence[0] % 97 = 0").select("page", "label", F.lit(1).alias("occurrence"), F.concat(T.source_of(F.col("locator")), F.lit(":"), F.col("sequence")[0] + 2).alias("correct_locator"), F.transform("sequence", lambda n: n + 2).alias("correct_sequence")).distinct()
    rows = checks.relabelled(units, wrong, ["document_id"])
    return rows.select("unit_id", "locator", "relabelled_from", F.col("ordinal").cast("bigint").alias("ordinal"))


ANCHOR = r'(?i)<a\s+name="(K?\d+)"[^>]*>\s*(\d{1,4})\b'


def ast3_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored markers of all pages, some of their anchors spoilt in the three ways that are told apart."""
    rows = page_table(spark, sf_dir, "source_id", "html")
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("anchor"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("label"))
    rows = rows.select("page_id", "source_id", F.posexplode(both).alias("_at", "m")).dropDuplicates(["page_id", "_at"]).select("page_id", F.concat_ws(":", "source_id", "m.label").alias("locator"), "m.label", "m.anchor")
    n = F.col("label").cast("int")
    spoilt = F.when(n % 10 == 0, F.col("label")).when(n % 10 == 1, F.concat("anchor", F.lit("0"))).when(n % 10 != 2, F.col("anchor"))
    units = rows.withColumns({"anchor": spoilt, "anchor_expected": T.anchor_of(n), "anchor_signal": F.lit(True), "relabelled_from": F.when(n % 100 == 0, F.lit("moved"))})
    return checks.anchor_defects(units, ["page_id"])


def ast4_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # in an order that is not that of the addresses
    rows = numbered(spark, sf_dir).withColumns({"sequence": F.array("number"), "shuffled": F.md5("locator")})
    return checks.order_defects(rows, ["document_id"], "shuffled")


def ast5_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.gap_defects(numbered(spark, sf_dir), ["document_id"], "place")


def ast6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = document_table(spark, sf_dir).groupBy("document_id").agg(F.max("unit_count").cast("bigint").alias("expected_units"))
    return checks.count_defects(unit_table(spark, sf_dir, "document_id"), expected, ["document_id"])


def _found_and_declared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gaps = ast5_gaps(spark, sf_dir).select("document_id", "missing", F.lit("paragraph-absent").alias("kind"))
    declared = gaps.where("missing % 3 = 0").unionByName(numbered(spark, sf_dir).where("number % 50 = 0").select("document_id", F.col("number").alias("missing"), F.lit("paragraph-absent").alias("kind")).distinct())
    return gaps, declared


def ast7_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, declared = _found_and_declared(spark, sf_dir)
    return checks.undeclared(found, declared, ["document_id", "missing", "kind"])


def ast8_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, declared = _found_and_declared(spark, sf_dir)
    return checks.stale(found, declared, ["document_id", "missing", "kind"])


def ast9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language of every source against every other."""
    rows = unit_table(spark, sf_dir, "locator", "language")
    return compared_languages(rows.select(T.source_of(F.col("locator")).alias("source_id"), "language", "locator"), None)


def ast10_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of every language's units against those of every other language."""
    per = unit_table(spark, sf_dir, "locator", "language", "role").groupBy("locator", "language").agg(F.max("role").alias("role"))
    languages = per.agg(F.collect_set("language").alias("_languages"))  # one row: a handful of codes
    left = per.join(F.broadcast(languages)).withColumn("sibling", F.explode("_languages")).where("language <> sibling")
    return checks.role_divergence(left.withColumn("pair", F.concat_ws("/", "language", "sibling")), left.select("locator", "role", F.concat_ws("/", "sibling", "language").alias("pair")), ["pair"])


def ast11_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.revision_disagreements(document_table(spark, sf_dir))


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_table(spark, sf_dir, "locator", "text")


def ast13_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.probe_hits(_probed(spark, sf_dir), key=["context_id", "locator"])


FURNITURE = ("harang", "órás", "fons", "the")


def ast14_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.probe_hits(_probed(spark, sf_dir), [checks.furniture_probe(w) for w in FURNITURE], key=["context_id"])


def ast16_undeclared_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = checks.probe_hits(_probed(spark, sf_dir), key=["context_id", "locator"])
    declared = hits.where("context_id % 4 = 0").select("locator", "probe")
    return checks.undeclared(hits, declared, ["locator", "probe"]).select("context_id", "locator", "probe")


def ast17_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _probed(spark, sf_dir)
    return checks.probe_summary(checks.probe_hits(rows), rows).select("probe", "checked", "hits", "vacuous")


def ast18_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_table(spark, sf_dir)
    known = unit_table(spark, sf_dir, "document_id", "locator", "deleted_at").where("deleted_at IS NULL").select("document_id", "locator").distinct()
    covered = chunks.select("chunk_id", "document_id", F.explode("unit_locators").alias("locator")).join(known, ["document_id", "locator"], "left_semi")
    held = covered.groupBy("chunk_id").agg(F.collect_set("locator").alias("held"))
    return checks.orphan_chunks(chunks.select("chunk_id").join(held, "chunk_id", "left"), locators="held")


def ast19_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_sources(gold_table(spark, sf_dir), document_table(spark, sf_dir))


def ast21_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = unit_table(spark, sf_dir, "document_id", "locator", "role", "text", "ordinal")
    return checks.hash_mismatches(units, document_table(spark, sf_dir)).select("document_id", "derived").distinct()


def ast22_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    spoilt = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 10 == 1, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 10 == 2, F.array_repeat(F.lit(float("nan")).cast("float"), 64)).otherwise(F.col("embedding"))
    return rows.select("vec_id", vectors.faults(spoilt, 64).alias("fault"))


def ast25_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = document_table(spark, sf_dir).where("is_current")
    units = unit_table(spark, sf_dir, "document_id", "locator").join(documents.select("document_id"), "document_id", "left_semi")
    expected = gold_table(spark, sf_dir).select(F.col("id").alias("question_id"), F.explode("expected_units").alias("locator")).where("locator IS NOT NULL")
    return checks.resolution(expected, units, documents)


# --- chunks and hashes

SMALL_BUDGET = 600


def _scholastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unit_table(spark, sf_dir, "document_id", "locator", "ordinal", "text", "ingested_at")
    return rows.select("document_id", "locator", "text", (F.col("ordinal").cast("bigint") * 10**10 + F.col("unit_id")).alias("ordinal"))


def chk1_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.numbered_paragraph(_scholastic(spark, sf_dir), ["document_id"])
    return rows.select("document_id", "chunk_no", "strategy", "text", F.array_join("unit_locators", ",").alias("unit_locators"))


def chk2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.batches(_scholastic(spark, sf_dir), ["document_id"], budget=SMALL_BUDGET)
    return rows.select("document_id", "article", "ordinal", "locator", F.col("batch").cast("bigint").alias("batch"))


def chk5_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.scholastic_article(_scholastic(spark, sf_dir), ["document_id"])
    return rows.select("document_id", "article", F.col("batch").cast("bigint").alias("batch"), "text", F.array_join("unit_locators", ",").alias("unit_locators"))


def chk7_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_statistics(chunking.batches(_scholastic(spark, sf_dir), ["document_id"], budget=SMALL_BUDGET), ["document_id"])


def chk2_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As chk2_batches, with the budget that holds by default."""
    rows = chunking.batches(_scholastic(spark, sf_dir), ["document_id"])
    return rows.select("document_id", "article", "ordinal", "locator", F.col("batch").cast("bigint").alias("batch"))


def chk7_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_statistics(chunking.batches(_scholastic(spark, sf_dir), ["document_id"]), ["document_id"])


def src1_manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a manifest on the sources of the emitted documents; some of their fields are spoilt by the length of the name."""
    rows = table(spark, sf_dir, "emitted_documents", ["source_id", "language", "kind", "authority_tier", "index_url", "unit_count"]).distinct()
    size = F.length("source_id")
    per = rows.groupBy("source_id").agg(F.max("kind").alias("kind"), F.max("authority_tier").alias("authority_tier"), F.max("unit_count").alias("unit_count"), F.collect_set(F.struct("language", "index_url")).alias("documents"))
    sources = per.select(
        F.col("source_id").alias("id"),
        F.when(size % 7 == 0, "novel").otherwise(F.col("kind")).alias("kind"),
        F.when(size % 5 == 0, 9).otherwise(F.col("authority_tier")).alias("authority_tier"),
        F.when(size % 3 == 0, "unknown").otherwise("public-domain").alias("license"),
        F.when(size % 4 == 0, "ftp://x").otherwise("https://example.org/a").alias("canonical_url"),
        F.when(size % 6 == 0, 0).otherwise(F.col("unit_count")).alias("expected_units"),
        F.when(size == 8, F.array().cast("array<struct<language:string,index_url:string>>")).otherwise(F.transform("documents", lambda d: F.struct(F.when(size == 9, "xx").otherwise(d["language"]).alias("language"), F.when(size == 10, "gopher").otherwise(d["index_url"]).alias("index_url")))).alias("documents"),
    )
    return files.manifest_faults(sources)


def src10_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus read once and checked, as a run takes it: rows of each of its parts."""

    def read() -> dict[str, DataFrame]:
        documents = document_table(spark, sf_dir)
        units = unit_table(spark, sf_dir, "document_id", "locator", "deleted_at").where("deleted_at IS NULL")
        return {"documents": corpus.current_documents(documents), "units": corpus.current_units(units, documents), "chunks": corpus.current_chunks(chunk_table(spark, sf_dir), documents)}

    def twice_current(frames: dict[str, DataFrame]) -> DataFrame:
        return frames["documents"].groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    frames = corpus.snapshot(read, [twice_current])
    parts = [rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows")) for name, rows in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def chk8_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table(spark, sf_dir).groupBy("document_id", "strategy").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("unit_locators")).alias("units"))


def hsh1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = unit_table(spark, sf_dir, "document_id", "locator", "role", "text", "ordinal")
    return hashing.document_hashes(units, ["document_id"])


def hsh1_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = unit_table(spark, sf_dir, "document_id", "locator", "role", "text", "ordinal")
    return hashing.tree_hashes(units, ["document_id"], leaf=64)


def hsh3_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.corpus_hash(document_table(spark, sf_dir).where("is_current"))


def hsh7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", ["event_id", "user_id"]).select("event_id", hashing.pseudonym(F.col("user_id")).alias("identifier"))


# --- storage


DELIVERED = ["snapshot_id", "id", "language", "content_hash", "unit_count", "is_current", "ingested_at", "delivered_at"]


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all deliveries, one row per delivery and document, in the shape of the store; first tells the earliest delivery."""
    rows = table(spark, sf_dir, "document_snapshots", DELIVERED).withColumn("content_hash", F.lower("content_hash"))
    best = rows.groupBy("snapshot_id", "id").agg(F.max(F.struct("delivered_at", "content_hash", "language", "unit_count", "is_current", "ingested_at")).alias("r"))
    least = rows.agg(F.min("snapshot_id").alias("_least"))
    best = best.join(F.broadcast(least)).withColumn("first", F.col("snapshot_id") == F.col("_least"))
    return best.select("first", "snapshot_id", F.col("id").alias("source_id"), "r.language", "r.content_hash", "r.unit_count", "r.is_current", "r.ingested_at")


_DELIVERIES = """(SELECT snapshot_id = min(snapshot_id) OVER () AS first, snapshot_id, id AS source_id, language, lower(content_hash) AS content_hash, unit_count, is_current, ingested_at FROM document_snapshots
      QUALIFY row_number() OVER (PARTITION BY snapshot_id, id ORDER BY delivered_at DESC, lower(content_hash) DESC, language DESC, unit_count DESC, is_current DESC, ingested_at DESC) = 1)"""


def snk2_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = _deliveries(spark, sf_dir).withColumn("unit_count", F.when(F.col("unit_count") % 5 == 0, 0).otherwise(F.col("unit_count")))
    return storage.without_crashed(spoilt).select("snapshot_id", "source_id", "content_hash", "is_current", "unit_count")


def snk3_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delivery, with all later ones put in: of the rows of a document the latest delivery's counts."""
    rows = _deliveries(spark, sf_dir).select("first", "source_id", "snapshot_id", "language", "content_hash", "unit_count")
    return storage.upserted(rows.where("first").drop("first"), rows.where("NOT first AND unit_count % 2 = 0").drop("first"), ["source_id"], "snapshot_id")


def snk4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delivery as the store, and the contents of all later ones as new versions."""
    rows = _deliveries(spark, sf_dir)
    history = rows.where("first").withColumn("is_current", F.lit(True))
    later = rows.where("NOT first").groupBy("source_id", "language", "content_hash").agg(F.max(F.struct("ingested_at", "unit_count")).alias("v"))
    made = storage.versioned(history, later.select("source_id", "language", "content_hash", "v.unit_count", "v.ingested_at"))
    return made.select("document_id", "source_id", "language", "content_hash", "unit_count", "is_current")


def snk5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.link_rows(chunk_table(spark, sf_dir), unit_table(spark, sf_dir, "document_id", "locator"))
    return rows.select("chunk_id", "locator", F.col("ordinal").cast("bigint").alias("ordinal"), "unit_id")


def snk6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "label"]).select((F.col("vec_id") % 1500).alias("chunk_id"), F.concat(F.lit("m"), F.col("label") % 3).alias("model"), "vec_id")
    return storage.new_vectors(rows, rows.where("vec_id % 7 = 0"), "vec_id")


def _locks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = document_table(spark, sf_dir).groupBy("source_id", "language", "is_current").agg(F.max(F.struct("emitted_at", "content_hash"))["content_hash"].alias("content_hash"))
    return rows.where("NOT is_current").drop("is_current"), rows.where("is_current").drop("is_current")


def snk7_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.merged_lock(*_locks(spark, sf_dir))


def snk7_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _locks(spark, sf_dir)
    return storage.lock_changed(old, storage.merged_lock(old, new))


def snk9_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "embeddings", ["label"]).groupBy(F.concat(F.lit("m"), "label").alias("model_id")).agg(F.count(F.lit(1)).alias("n"))
    slate = per.where("model_id < 'm6'").select("model_id", (10 - F.substring("model_id", 2, 1).cast("int")).alias("position"))
    rows = storage.merged_results(per.where("model_id <> 'm3'"), per.where("model_id IN ('m2', 'm3')").withColumn("n", F.col("n") * 2), slate)
    return rows.withColumn("place", F.col("place").cast("bigint"))


def pln1_revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unit_table(spark, sf_dir, "document_id", "locator", "language", "text")
    docs = document_table(spark, sf_dir)
    both = rows.join(docs.select("document_id", "is_current").distinct(), "document_id").withColumn("key", F.concat_ws("|", "locator", "language"))
    per = both.groupBy("key", "is_current").agg(F.max("text").alias("text"))
    return storage.revision_diff(per.where("NOT is_current"), per.where("is_current"), "key")


QUERIES = {
    q.__name__: q
    for q in (src1_manifest_faults, src3_gold_faults, src7_chunks, src8_chunk_units, src9_documents, src10_snapshot, src11_page, src11_after, src12_siblings, src13_locators, ast2_relabelled, ast3_anchors, ast4_order, ast5_gaps, ast6_counts, ast7_undeclared, ast8_stale, ast9_languages, ast10_roles, ast11_revisions, ast13_probes, ast14_furniture, ast16_undeclared_hits, ast17_summary, ast18_orphans, ast19_sources, ast21_hashes, ast22_vectors, ast25_resolution, chk1_numbered, chk2_batches, chk2_full, chk5_articles, chk7_splits, chk7_full, chk8_strategies, hsh1_documents, hsh1_trees, hsh3_corpus, hsh7_pseudonyms, snk2_swept, snk3_upserted, snk4_versions, snk5_links, snk6_vectors, snk7_lock, snk7_changed, snk9_results, pln1_revision_diff)
}

_GAPS = f"""gaps AS (SELECT document_id, unnest(generate_series(m + 1, number - 1)) AS missing, m AS after, number AS before FROM
      (SELECT document_id, number, coalesce(max(number) OVER (PARTITION BY document_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM {NUMBERED}) WHERE number - m > 1),
      declared AS (SELECT document_id, missing FROM gaps WHERE missing % 3 = 0 UNION ALL SELECT DISTINCT document_id, number FROM {NUMBERED} WHERE number % 50 = 0)"""
_HITS = "hits AS (" + " UNION ALL ".join(f"SELECT context_id, locator, {quoted(p.name)} AS probe, substring(text, 1, 90) || '…' AS excerpt FROM {CONTEXT} WHERE regexp_matches(text, {quoted(p.pattern)})" for p in checks.TEXT_PROBES) + ")"
_ORDERED = f"(SELECT document_id, locator, text, CAST(ordinal AS BIGINT) * 10000000000 + unit_id AS ordinal, regexp_replace(locator, '\\.[^.]*$', '') AS article FROM {UNITS})"


def _batches_sql(budget: int) -> str:
    return f"""RECURSIVE o AS (SELECT *, coalesce(length(text), 0) AS chars, row_number() OVER (PARTITION BY document_id, article ORDER BY ordinal, locator) AS rn FROM {_ORDERED}),
      b AS (SELECT document_id, article, ordinal, locator, text, rn, CAST(0 AS BIGINT) AS batch, CAST(chars AS BIGINT) AS size FROM o WHERE rn = 1
        UNION ALL SELECT o.document_id, o.article, o.ordinal, o.locator, o.text, o.rn, b.batch + CASE WHEN b.size + o.chars > {budget} THEN 1 ELSE 0 END, CASE WHEN b.size + o.chars > {budget} THEN o.chars ELSE b.size + o.chars END
        FROM b JOIN o ON o.document_id = b.document_id AND o.article = b.article AND o.rn = b.rn + 1)"""


_LABEL = "CASE WHEN r = 'pr' THEN 'Prooemium' WHEN r = 'co' THEN 'Respondeo' WHEN r = 'adarg' THEN 'Ad argumentum' WHEN regexp_matches(r, '^(arg|sc|ad)\\d*$') THEN trim(CASE regexp_extract(r, '^([a-z]+)', 1) WHEN 'arg' THEN 'Obiectio' WHEN 'sc' THEN 'Sed contra' ELSE 'Ad' END || ' ' || regexp_extract(r, '(\\d*)$', 1)) ELSE r END"
_DERIVED = f"(SELECT document_id, sha256(string_agg(locator || chr(9) || coalesce(role, '') || chr(9) || text || chr(10), '' ORDER BY ordinal, locator, locator || chr(9) || coalesce(role, '') || chr(9) || text || chr(10))) AS content_hash FROM {UNITS} GROUP BY document_id)"
_LOCKS = f"r AS (SELECT source_id, language, is_current, max_by(content_hash, (emitted_at, content_hash)) AS content_hash FROM {DOCS} GROUP BY ALL), old AS (SELECT source_id, language, content_hash FROM r WHERE NOT is_current), new AS (SELECT source_id, language, content_hash FROM r WHERE is_current), merged AS (SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.source_id = old.source_id AND new.language = old.language) UNION ALL SELECT * FROM new)"

ORACLE = {
    "src3_gold_faults": f"SELECT id, 'language' AS fault FROM {GOLD} WHERE length(question) % 7 = 0 OR language NOT IN ('hu', 'en', 'la') UNION ALL SELECT id, 'blank-question' FROM {GOLD} WHERE NOT coalesce(regexp_matches(question, '\\S'), false) UNION ALL SELECT id, 'refusal-with-units' FROM {GOLD} WHERE expects_refusal AND len(coalesce(expected_units, [])) > 0",
    "src7_chunks": f"SELECT d.source_id, d.language, c.chunk_id, c.strategy, c.text FROM {CHUNKS} c JOIN {DOCS} d ON c.document_id = d.document_id WHERE d.is_current",
    "src8_chunk_units": f"SELECT chunk_id, array_to_string(list_sort(list_distinct(unit_locators)), ',') AS units FROM {CHUNKS} WHERE len(unit_locators) > 0 AND document_id IN (SELECT document_id FROM {DOCS} WHERE is_current)",
    "src9_documents": f"SELECT DISTINCT document_id, source_id, language FROM {DOCS} WHERE is_current",
    "src11_page": f"SELECT u.document_id, u.ordinal, u.unit_id, u.locator FROM {UNITS} u WHERE u.document_id IN (SELECT document_id FROM {DOCS} WHERE is_current) ORDER BY 1, 2, 3 LIMIT 1000 OFFSET 1000",
    "src11_after": f"SELECT language, unit_id, locator FROM {UNITS} WHERE language > 'hu' OR (language = 'hu' AND unit_id > 500) ORDER BY language, unit_id LIMIT 1000",
    "src12_siblings": f"SELECT DISTINCT a.source_id, a.language, b.language AS sibling FROM {DOCS} a JOIN {DOCS} b ON a.source_id = b.source_id AND a.language <> b.language WHERE a.is_current AND b.is_current",
    "src13_locators": f"SELECT document_id, locator FROM {UNITS} WHERE document_id IN (SELECT document_id FROM {DOCS} WHERE is_current)",
    "ast2_relabelled": f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY document_id, number ORDER BY place) AS nth FROM {NUMBERED}),
      f AS (SELECT *, number % 97 = 0 AND nth = 1 AS wrong FROM u)
      SELECT unit_id, CASE WHEN wrong THEN split_part(locator, ':', 1) || ':' || (number + 2) ELSE locator END AS locator, CASE WHEN wrong THEN locator END AS relabelled_from,
        CAST(row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN wrong THEN number + 2 ELSE number END, place) AS BIGINT) AS ordinal FROM f""",
    "ast3_anchors": f"""WITH m AS (SELECT page_id, source_id, unnest(regexp_extract_all(html, {quoted(ANCHOR)}, 1)) AS a, unnest(regexp_extract_all(html, {quoted(ANCHOR)}, 2)) AS l FROM {PAGES}),
      s AS (SELECT page_id, source_id || ':' || l AS locator, l, CAST(l AS INT) AS n, 'K' || lpad(l, greatest(4, length(l))::INT, '0') AS e, CASE WHEN CAST(l AS INT) % 10 = 0 THEN l WHEN CAST(l AS INT) % 10 = 1 THEN a || '0' WHEN CAST(l AS INT) % 10 <> 2 THEN a END AS x FROM m)
      SELECT page_id, locator, CASE WHEN x IS NULL THEN 'anchor-absent' WHEN x = l THEN 'anchor-missing-prefix' ELSE 'anchor-typo' END AS kind FROM s WHERE n % 100 <> 0 AND (x IS NULL OR x <> e)""",
    "ast4_order": f"SELECT document_id, locator, 'number-not-increasing' AS kind FROM (SELECT *, max(number) OVER (PARTITION BY document_id ORDER BY md5(locator) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {NUMBERED}) WHERE m >= number",
    "ast5_gaps": f"WITH {_GAPS} SELECT document_id, missing, after, before FROM gaps",
    "ast6_counts": f"SELECT d.document_id, coalesce(n, 0) AS units, e AS expected_units FROM (SELECT document_id, CAST(max(unit_count) AS BIGINT) AS e FROM {DOCS} GROUP BY 1) d LEFT JOIN (SELECT document_id, count(*) AS n FROM {UNITS} GROUP BY 1) u ON d.document_id = u.document_id WHERE coalesce(n, 0) IS DISTINCT FROM e",
    "ast7_undeclared": f"WITH {_GAPS} SELECT document_id, missing, 'paragraph-absent' AS kind FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.document_id = g.document_id AND d.missing = g.missing)",
    "ast8_stale": f"WITH {_GAPS} SELECT document_id, missing, 'paragraph-absent' AS kind FROM declared d WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE d.document_id = g.document_id AND d.missing = g.missing)",
    "ast9_languages": f"""WITH u AS (SELECT DISTINCT split_part(locator, ':', 1) AS source_id, language, locator FROM {UNITS}), l AS (SELECT DISTINCT source_id, language FROM u),
      p AS (SELECT a.source_id, a.language, b.language AS sibling FROM l a JOIN l b ON a.source_id = b.source_id AND a.language <> b.language), t AS (SELECT DISTINCT source_id, locator FROM u)
      SELECT *, only_incoming > 0 OR only_existing > 0 OR shared = 0 AS fails FROM (SELECT p.*, count(*) FILTER (a.locator IS NOT NULL AND b.locator IS NOT NULL) AS shared, count(*) FILTER (a.locator IS NOT NULL AND b.locator IS NULL) AS only_incoming, count(*) FILTER (a.locator IS NULL AND b.locator IS NOT NULL) AS only_existing
        FROM p JOIN t ON t.source_id = p.source_id LEFT JOIN u a ON a.source_id = p.source_id AND a.language = p.language AND a.locator = t.locator LEFT JOIN u b ON b.source_id = p.source_id AND b.language = p.sibling AND b.locator = t.locator GROUP BY ALL)""",
    "ast10_roles": f"""WITH p AS (SELECT locator, language, max(role) AS role FROM {UNITS} GROUP BY ALL), l AS (SELECT DISTINCT language FROM p)
      SELECT a.language || '/' || l.language AS pair, a.locator, a.role, b.role AS other_role FROM p a JOIN l ON l.language <> a.language LEFT JOIN p b ON a.locator = b.locator AND b.language = l.language WHERE b.locator IS NULL OR a.role IS DISTINCT FROM b.role""",
    "ast11_revisions": f"WITH p AS (SELECT source_id, revision, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM {DOCS} GROUP BY 1, 2) SELECT * FROM p WHERE source_id IN (SELECT source_id FROM p GROUP BY 1 HAVING count(*) > 1)",
    "ast13_probes": f"WITH {_HITS} SELECT * FROM hits",
    "ast14_furniture": " UNION ALL ".join(f"SELECT context_id, 'furniture:{w}' AS probe, substring(text, 1, 90) || '…' AS excerpt FROM {CONTEXT} WHERE regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])')" for w in FURNITURE),
    "ast16_undeclared_hits": f"WITH {_HITS} SELECT context_id, locator, probe FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits d WHERE d.context_id % 4 = 0 AND d.locator = h.locator AND d.probe = h.probe)",
    "ast17_summary": f"WITH {_HITS}, names AS (SELECT unnest([{', '.join(quoted(p.name) for p in checks.TEXT_PROBES)}]) AS probe) SELECT n.probe, (SELECT count(*) FROM {CONTEXT}) AS checked, count(h.probe) AS hits, (SELECT count(*) FROM {CONTEXT}) = 0 AS vacuous FROM names n LEFT JOIN hits h ON h.probe = n.probe GROUP BY n.probe",
    "ast18_orphans": f"SELECT chunk_id FROM {CHUNKS} WHERE chunk_id NOT IN (SELECT c.chunk_id FROM (SELECT chunk_id, document_id, unnest(unit_locators) AS locator FROM {CHUNKS}) c JOIN {UNITS} u ON c.document_id = u.document_id AND c.locator = u.locator WHERE u.deleted_at IS NULL)",
    "ast19_sources": f"SELECT DISTINCT split_part(l, ':', 1) AS source_id FROM (SELECT unnest(expected_units) AS l FROM {GOLD}) WHERE l IS NOT NULL AND split_part(l, ':', 1) NOT IN (SELECT source_id FROM {DOCS})",
    "ast21_hashes": f"SELECT DISTINCT d.document_id, h.content_hash AS derived FROM {DOCS} d JOIN {_DERIVED} h ON d.document_id = h.document_id WHERE d.content_hash <> h.content_hash",
    "ast22_vectors": "SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN 'dimensions' WHEN 1 THEN 'zero' WHEN 2 THEN 'not finite' END AS fault FROM embeddings",
    "ast25_resolution": f"""WITH e AS (SELECT id AS question_id, unnest(expected_units) AS locator FROM {GOLD})
      SELECT question_id, locator, split_part(locator, ':', 1) AS source_id, CASE WHEN locator IN (SELECT locator FROM {UNITS} WHERE document_id IN (SELECT document_id FROM {DOCS} WHERE is_current)) THEN 'resolved'
        WHEN split_part(locator, ':', 1) IN (SELECT source_id FROM {DOCS} WHERE is_current) THEN 'failure' ELSE 'pending' END AS verdict FROM e WHERE locator IS NOT NULL""",
    "chk1_numbered": f"SELECT document_id, ordinal AS chunk_no, 'numbered-paragraph@1' AS strategy, text, locator AS unit_locators FROM {_ORDERED}",
    "chk2_batches": f"WITH {_batches_sql(SMALL_BUDGET)} SELECT document_id, article, ordinal, locator, batch FROM b",
    "chk5_articles": f"WITH {_batches_sql(chunking.BUDGET)}, l AS (SELECT *, regexp_extract(locator, '([^.:]*)$', 1) AS r FROM b) SELECT document_id, article, batch, article || chr(10) || string_agg('[' || {_LABEL} || '] ' || coalesce(text, ''), chr(10) ORDER BY ordinal, locator) AS text, string_agg(locator, ',' ORDER BY ordinal, locator) AS unit_locators FROM l GROUP BY document_id, article, batch",
    "src1_manifest_faults": """WITH p AS (SELECT source_id AS id, length(source_id) AS n, max(kind) AS kind, max(authority_tier) AS tier, max(unit_count) AS units, bool_or(language NOT IN ('hu', 'en', 'la')) AS odd, bool_or(index_url IS NULL OR NOT regexp_matches(index_url, '^https?://')) AS nowhere FROM emitted_documents GROUP BY 1),
      s AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'novel' ELSE kind END AS k, CASE WHEN n % 5 = 0 THEN 9 ELSE tier END AS t FROM p)
      SELECT id, 'kind' AS fault FROM s WHERE k NOT IN ('scripture', 'church_document', 'theological_work', 'historical', 'scientific') OR k IS NULL
      UNION ALL SELECT id, 'tier-range' FROM s WHERE t NOT BETWEEN 1 AND 5 UNION ALL SELECT id, 'tier-of-untiered-kind' FROM s WHERE k IN ('scientific', 'historical') AND t IS NOT NULL
      UNION ALL SELECT id, 'tier-missing' FROM s WHERE k NOT IN ('scientific', 'historical') AND t IS NULL UNION ALL SELECT id, 'license-unresolved' FROM s WHERE n % 3 = 0 UNION ALL SELECT id, 'url' FROM s WHERE n % 4 = 0
      UNION ALL SELECT id, 'language' FROM s WHERE n <> 8 AND (n = 9 OR odd) UNION ALL SELECT id, 'index-url' FROM s WHERE n <> 8 AND (n = 10 OR nowhere)
      UNION ALL SELECT id, 'expected-units' FROM s WHERE n % 6 = 0 OR units <= 0 UNION ALL SELECT id, 'no-documents' FROM s WHERE n = 8""",
    "src10_snapshot": f"""WITH d AS (SELECT DISTINCT document_id, source_id, language FROM {DOCS} WHERE is_current), u AS (SELECT DISTINCT unit_id, document_id, locator, deleted_at FROM stored_units)
      SELECT 'documents' AS part, count(*) AS rows FROM d UNION ALL SELECT 'units', count(*) FROM u JOIN d ON u.document_id = d.document_id WHERE u.deleted_at IS NULL
      UNION ALL SELECT 'chunks', count(*) FROM (SELECT DISTINCT chunk_id, document_id, strategy, text FROM chunks) c JOIN d ON c.document_id = d.document_id""",
    "chk2_full": f"WITH {_batches_sql(chunking.BUDGET)} SELECT document_id, article, ordinal, locator, batch FROM b",
    "chk7_full": f"WITH {_batches_sql(chunking.BUDGET)}, p AS (SELECT document_id, article, count(DISTINCT batch) AS n FROM b GROUP BY ALL) SELECT document_id, count(*) AS articles, count(*) FILTER (n = 1) AS whole, count(*) FILTER (n > 1) AS split, max(n) AS most FROM p GROUP BY 1",
    "chk7_splits": f"WITH {_batches_sql(SMALL_BUDGET)}, p AS (SELECT document_id, article, count(DISTINCT batch) AS n FROM b GROUP BY ALL) SELECT document_id, count(*) AS articles, count(*) FILTER (n = 1) AS whole, count(*) FILTER (n > 1) AS split, max(n) AS most FROM p GROUP BY 1",
    "chk8_strategies": f"SELECT document_id, strategy, count(*) AS chunks, CAST(sum(len(unit_locators)) AS BIGINT) AS units FROM {CHUNKS} GROUP BY 1, 2",
    "hsh1_trees": f"""WITH l AS (SELECT document_id, CAST(floor(ordinal / 64) AS BIGINT) AS leaf, sha256(string_agg(locator || chr(9) || coalesce(role, '') || chr(9) || text || chr(10), '' ORDER BY ordinal, locator, locator || chr(9) || coalesce(role, '') || chr(9) || text || chr(10))) AS h FROM {UNITS} GROUP BY ALL)
      SELECT document_id, sha256(string_agg(leaf || ':' || h || chr(10), '' ORDER BY leaf)) AS tree_hash FROM l GROUP BY 1""",
    "hsh1_documents": f"SELECT * FROM {_DERIVED}",
    "hsh3_corpus": f"SELECT sha256(string_agg(source_id || ':' || language || chr(9) || content_hash || chr(10), '' ORDER BY source_id || ':' || language, source_id || ':' || language || chr(9) || content_hash || chr(10))) AS corpus_hash FROM {DOCS} WHERE is_current",
    "hsh7_pseudonyms": "SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS identifier FROM events",
    "snk2_swept": f"SELECT snapshot_id, source_id, content_hash, is_current, CASE WHEN unit_count % 5 = 0 THEN 0 ELSE unit_count END AS unit_count FROM {_DELIVERIES} WHERE NOT coalesce(NOT is_current AND unit_count % 5 = 0, false)",
    "snk3_upserted": f"""WITH d AS (SELECT * FROM {_DELIVERIES}), new AS (SELECT source_id, snapshot_id, language, content_hash, unit_count FROM d WHERE NOT first AND unit_count % 2 = 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY snapshot_id DESC) = 1)
      SELECT source_id, snapshot_id, language, content_hash, unit_count FROM d WHERE first AND source_id NOT IN (SELECT source_id FROM new) UNION ALL SELECT * FROM new""",
    "snk4_versions": f"""WITH d AS (SELECT * FROM {_DELIVERIES}), h AS (SELECT * FROM d WHERE first),
      l AS (SELECT source_id, language, content_hash, max(ingested_at) AS newest, arg_max(unit_count, (ingested_at, unit_count)) AS unit_count FROM d WHERE NOT first GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY source_id, language ORDER BY newest DESC, content_hash) = 1 AS is_current FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source_id = l.source_id AND h.language = l.language AND h.content_hash = l.content_hash)),
      a AS (SELECT source_id, language, content_hash, unit_count, NOT EXISTS (SELECT 1 FROM n WHERE n.source_id = h.source_id AND n.language = h.language) AS is_current FROM h UNION ALL SELECT source_id, language, content_hash, unit_count, is_current FROM n)
      SELECT sha256(source_id || ':' || language || ':' || content_hash) AS document_id, * FROM a""",
    "snk5_links": f"SELECT c.chunk_id, c.locator, c.ordinal, u.unit_id FROM (SELECT chunk_id, document_id, unnest(unit_locators) AS locator, CAST(generate_subscripts(unit_locators, 1) - 1 AS BIGINT) AS ordinal FROM {CHUNKS}) c LEFT JOIN (SELECT document_id, locator, min(unit_id) AS unit_id FROM {UNITS} GROUP BY 1, 2) u ON c.document_id = u.document_id AND c.locator = u.locator",
    "snk6_vectors": "WITH r AS (SELECT vec_id % 1500 AS chunk_id, 'm' || (label % 3) AS model, vec_id FROM embeddings) SELECT chunk_id, model, min(vec_id) AS vec_id FROM r WHERE (chunk_id, model) NOT IN (SELECT (chunk_id, model) FROM r WHERE vec_id % 7 = 0) GROUP BY 1, 2",
    "snk7_lock": f"WITH {_LOCKS} SELECT * FROM merged",
    "snk7_changed": f"WITH {_LOCKS} SELECT a AS added, b AS removed, a > 0 OR b > 0 AS write FROM (SELECT (SELECT count(*) FROM (SELECT * FROM merged EXCEPT ALL SELECT * FROM old)) AS a, (SELECT count(*) FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM merged)) AS b)",
    "snk9_results": "WITH p AS (SELECT 'm' || label AS model_id, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT model_id, CASE WHEN model_id IN ('m2', 'm3') THEN n * 2 ELSE n END AS n FROM p) SELECT model_id, n, row_number() OVER (ORDER BY model_id >= 'm6', CASE WHEN model_id < 'm6' THEN 10 - CAST(model_id[2] AS INT) END, model_id) AS place FROM m",
    "pln1_revision_diff": f"""WITH p AS (SELECT u.locator || '|' || u.language AS key, d.is_current, max(u.text) AS text FROM {UNITS} u JOIN (SELECT DISTINCT document_id, is_current FROM {DOCS}) d ON u.document_id = d.document_id GROUP BY 1, 2)
      SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM p WHERE NOT is_current) a FULL JOIN (SELECT * FROM p WHERE is_current) b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.text <> b.text""",
}
