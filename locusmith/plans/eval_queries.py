"""Queries of retrieval, metrics, the citation gate, rate limiting and document lint, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusmith.functions import vectors
from locusmith.operators import checks, gate, lint, metrics, ratelimit, reports, retrieval
from locusmith.plans.corpus_queries import CHUNKS, chunk_table
from locusmith.plans.store import table, temporary, written
from locusmith.plans.text_queries import CONTEXT, context_table
from locusmith.streaming import ratelimit as stream

K = 20
#: The stated query set: every row whose id is divisible by 50, against all rows.
QUERY_IDS = 50


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])


def _ranking(spark: SparkSession, sf_dir: str, vector: str = "embedding", dimensions: int = 64) -> DataFrame:
    items = embedded(spark, sf_dir).select("vec_id", F.slice("embedding", 1, dimensions).alias(vector))
    queries = items.where(f"vec_id % {QUERY_IDS} = 0").select(F.col("vec_id").alias("query"), F.col(vector).alias("vector"))
    return retrieval.top_k(items, queries, K, vector=vector)


def vec1_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir)
    head, tail = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    return rows.select("vec_id", F.round(vectors.cosine(head, tail), 9).alias("cosine"))


def vec2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = [((i * 7) % 13 - 6) / 10 for i in range(64)]
    return retrieval.search(embedded(spark, sf_dir), query, K).select("vec_id", F.round("distance", 9).alias("distance"))


def vec3_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranking(spark, sf_dir).select("query", "vec_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def vec4_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    rows = embedded(spark, sf_dir).select(F.col("label").cast("string").alias("slate"), F.col("vec_id").alias("id"), F.col("embedding").alias("reference"), coarse.alias("exported"))
    measured = retrieval.fidelity(rows, 3, "slate")
    figures = ["mean_cosine", "min_cosine", "perturbation", "agreement", "mean_margin"]
    return measured.select("slate", "probes", *[F.round(c, 6).alias(c) for c in figures], "margins_below")


def met15_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vec4_fidelity(spark, sf_dir)
    return rows.select("slate", metrics.fidelity_verdict(F.col("mean_cosine"), F.col("agreement"), F.col("margins_below"), F.col("probes")).alias("verdict"))


def vec7_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*[F.slice("embedding", i * 16 + 1, 16) for i in range(4)])
    mask = F.array(F.lit(1), F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(0))
    rows = embedded(spark, sf_dir)
    # all components in one number each: the sum of component times its place
    weighed = lambda v: F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", *[F.round(weighed(vectors.pooled(states, mask, how)), 9).alias(how) for how in ("mean", "cls", "lasttoken")])


def vec9_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_table(spark, sf_dir)
    done = rows.where("token_count IS NOT NULL").select("chunk_id", F.lit("m").alias("model"))
    return retrieval.pending(rows.select("chunk_id"), done, "m")


def vec11_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_table(spark, sf_dir).withColumn("tokens", F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))))
    return retrieval.truncation_counts(rows, 30, "document_id")


def judged_ranking(spark: SparkSession, sf_dir: str, dimensions: int = 64) -> tuple[DataFrame, DataFrame]:
    """(ranked units, questions): a vector's units are its label and its own name; a query expects its label and a rare second unit."""
    items = embedded(spark, sf_dir)
    units = items.select(F.col("vec_id"), F.array(F.concat(F.lit("label:"), "label"), F.concat(F.lit("vector:"), "vec_id")).alias("units"))
    ranking = retrieval.ranked_units(_ranking(spark, sf_dir, dimensions=dimensions), units, "vec_id")
    ranked = ranking.select(F.col("query").alias("question_id"), "rank", "units")
    asked = items.where(f"vec_id % {QUERY_IDS} = 0")
    second = F.when(F.col("vec_id") % 200 == 0, F.array(F.concat(F.lit("vector:"), F.col("vec_id") + 1))).otherwise(F.array().cast("array<string>"))
    expected = F.when(F.col("vec_id") % 450 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("label:"), "label")), second))
    questions = asked.select(F.col("vec_id").alias("question_id"), expected.alias("expected"), F.when(F.col("vec_id") % 100 == 0, "same-language").otherwise("cross-lingual").alias("slice"))
    return ranked, questions


METRIC_NAMES = {m: m.lower().replace("@", "_at_").replace("-", "_") for m in metrics.METRICS}


def met5_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.question_scores(*judged_ranking(spark, sf_dir))
    return scores.select("question_id", *[F.col(f"`{m}`").alias(n) for m, n in METRIC_NAMES.items()])


def met6_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, questions = judged_ranking(spark, sf_dir)
    means = metrics.slice_means(metrics.question_scores(ranked, questions), questions, [*metrics.SLICES, "no-such-slice"])
    return means.select("slice", "metric", "n", F.round("mean", 9).alias("mean"))


def met7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.source_scores(*judged_ranking(spark, sf_dir))
    return scores.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("`recall@10`"), 9).alias("recall_at_10"), F.round(F.avg("`MRR@10`"), 9).alias("mrr_at_10"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, questions = judged_ranking(spark, sf_dir)
    rows = metrics.long_scores(metrics.question_scores(ranked, questions)).join(questions.select("question_id", "slice"), "question_id")
    every = spark.createDataFrame([(s, m) for s in ("same-language", "cross-lingual", "no-such-slice") for m in metrics.METRICS], "slice string, metric string")
    return metrics.mean_intervals(rows, ["slice", "metric"], every=every)


def met8_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir)


def met8_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir).select("slice", "metric", "n", F.round("mean", 9).alias("mean"), "status")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, dimensions in (("full", 64), ("short", 12), ("tiny", 4)):
        ranked, questions = judged_ranking(spark, sf_dir, dimensions)
        scores = metrics.question_scores(ranked, questions).select("question_id", F.col("`recall@10`").alias("value"))
        parts.append(scores.join(questions.select("question_id", "slice"), "question_id").withColumn("identity", F.lit(name)))
    return written(parts[0].unionByName(parts[1]).unionByName(parts[2]), "reports")  # one row per question and report, read several times


def met10_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.compared(_reports(spark, sf_dir).withColumn("question_id", F.lpad(F.col("question_id").cast("string"), 9, "0")))
    return rows.withColumn("mean_difference", F.round("mean_difference", 9))


def met9_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events", ["event_type", "value"]).groupBy("event_type").agg(metrics.required_n(F.col("value") - 50).alias("required_n"), F.count("value").alias("n"))
    return per


def met11_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.latency_percentiles(table(spark, sf_dir, "events", ["event_type", "value"]), "value", ["event_type"])
    return rows.select("event_type", "n", F.round("p50", 9).alias("p50"), F.round("p95", 9).alias("p95"))


def met13_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def passed(dimensions: int) -> DataFrame:
        scores = metrics.question_scores(*judged_ranking(spark, sf_dir, dimensions))
        return scores.select("question_id", "`full-recall@10`")

    return metrics.regressions(passed(64), passed(1), "full-recall@10")


# --- the gate, on answers derived from the context units


def answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(segments, context): every context unit is quoted in its answer, some of them wrongly, and cited by a claim."""
    rows = context_table(spark, sf_dir, "answer_id", "locator", "text", "edition", "url").withColumn("position", F.col("context_id"))
    i = F.col("context_id")
    length = (F.lit(10) + (i % 6) * 90).cast("int")
    quote = F.concat(F.substring("text", F.lit(1), length), F.when(i % 13 == 0, "!").otherwise(""))
    quotations = rows.select("answer_id", (i * 3).alias("segment"), F.lit("quotation").alias("kind"), quote.alias("text"), F.lit(None).cast("array<string>").alias("citations"), F.when(i % 11 == 0, F.concat("locator", F.lit("x"))).otherwise(F.col("locator")).alias("locator"))
    cited = F.when(i % 17 == 0, F.array(F.lit("nowhere:2"))).when(i % 7 == 0, F.array("locator", F.lit("nowhere:1"))).otherwise(F.array("locator"))
    claims = rows.select("answer_id", (i * 3 + 1).alias("segment"), F.lit("claim").alias("kind"), F.repeat(F.lit("claim "), 20).alias("text"), cited.alias("citations"), F.lit(None).cast("string").alias("locator"))
    links = rows.where(i % 2 == 0).select("answer_id", (i * 3 + 2).alias("segment"), F.lit("connective").alias("kind"), F.lit("and so").alias("text"), F.lit(None).cast("array<string>").alias("citations"), F.lit(None).cast("string").alias("locator"))
    return quotations.unionByName(claims).unionByName(links), gate.context_map(rows)


#: More room than the default for a unit's share, so that every rule decides some cases.
LIMITS = gate.Limits(max_chars=200, answer_share=0.25, unit_share=0.9)


def gte1_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir)[1].select("answer_id", "locator", "context_id")


def gte2_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.judged_quotations(*answers(spark, sf_dir), LIMITS).select("answer_id", "segment", "locator", "code")


def gte2_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As gte2_quotations, with the limits that hold by default."""
    return gate.judged_quotations(*answers(spark, sf_dir)).select("answer_id", "segment", "locator", "code")


def gte8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.violations(*answers(spark, sf_dir), LIMITS)


def gte10_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.verdicts_of(gate.judged_segments(*answers(spark, sf_dir), LIMITS))


def gte10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.repaired_segments(*answers(spark, sf_dir), LIMITS)
    return rows.select("answer_id", "status", "segment", "kind", F.array_join("citations", ",").alias("citations"))


def met14_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, context = answers(spark, sf_dir)
    rows = gate.gate_metrics(segments, gate.violations(segments, context, LIMITS))
    return rows.select("quotations", "claims", "citations", *[F.round(c, 9).alias(c) for c in ("quote_fidelity", "citation_validity", "groundedness")])


def met14_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions refused or not by the length of their text, which stands in for the answers."""
    asked = table(spark, sf_dir, "gold_questions", ["id", "expects_refusal", "question"]).distinct()
    results = asked.select(F.col("id").alias("question_id"), "expects_refusal", (F.length("question") % 3 == 0).alias("refused"))
    rows = gate.refusal_correctness(results)
    return rows.select("refusals_due", "refused_rightly", "answers_due", "refused_wrongly", *[F.round(c, 9).alias(c) for c in ("refusal_correctness", "answer_rate", "accuracy")])


# --- rate limiting

DAY = ratelimit.Limit(5, 86400)
HOUR = ratelimit.Limit(5, 3600)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])


def rat1_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratelimit.replayed(_events(spark, sf_dir).withColumn("any", F.lit("any")), DAY, "user_id", "any")
    return rows.select("event_id", "identifier", "earlier", "allowed")


def rat1_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user and type, with the limit that holds by default."""
    return ratelimit.replayed(_events(spark, sf_dir), ratelimit.Limit(), "user_id", "event_type").select("event_id", "earlier", "allowed")


def rat1_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratelimit.replayed(_events(spark, sf_dir).withColumn("any", F.lit("any")), HOUR, "event_type", "any").select("event_id", "earlier", "allowed")


def rat1_logged_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratelimit.replayed_logging_allowed(_events(spark, sf_dir), DAY, "user_id", "event_type")


def rat1_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole event log run through the streaming limiter in available-now micro-batches, written to the shared folder and read back."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = temporary(spark, "rate-stream")
    log = f"{folder}/log"
    # files by stretches of time, which all arrive in the one micro-batch that is available now; within it the limiter goes by time
    source.select("event_id", "ts", "user_id", "event_type").repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(log)
    arriving = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string" if source.schema["ts"].dataType.simpleString() == "timestamp_ntz" else "event_id bigint, ts timestamp, user_id bigint, event_type string").parquet(log)
    judged = stream.limited(arriving, DAY, "user_id", "event_type")
    run = judged.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.OUT).parquet(f"{folder}/out")


def rat2_honeypot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gold_questions", ["id", "notes"]).distinct()
    return rows.select("id", ratelimit.not_blank(F.col("notes")).alias("caught")).distinct()


# --- document lint, on Markdown made of the documents


def _name(c: Column) -> Column:
    return F.concat(F.lit("docs/"), c.cast("string"), F.lit(".md"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a Markdown file with headings, fences and links, some of them broken."""
    d = F.col("doc_id")
    title = F.coalesce("title", F.lit("Untitled"))
    content = F.concat(
        F.lit("# "), title, F.lit("\n"),
        F.when(d % 3 == 0, "> **TL;DR** short\n").otherwise(""),
        F.lit("\n## Notes & more\n[next]("), (d + 1).cast("string"), F.lit(".md#notes--more) and [up](../README.md) `[no](code.md)`\n"),
        F.lit("```\n[not](a-link.md)\n# no heading\n```\n## Notes & more\n[own](#notes--more-1) [bad](#nowhere) [out](https://example.org/x#y) ![pic](img/"), (d % 10).cast("string"), F.lit(".png)\n"),
        F.coalesce("text", F.lit("")),
    )
    return table(spark, sf_dir, "documents", ["doc_id", "title", "text"]).select(_name(d).alias("path"), content.alias("content"))


def lnt1_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.prose(markdown(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


def lnt2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.links(markdown(spark, sf_dir)).withColumn("line", F.col("line").cast("bigint"))


def lnt3_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.headings(markdown(spark, sf_dir)).select("path", F.col("line").cast("bigint").alias("line"), "level", "heading")


def lnt4_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.anchors(markdown(spark, sf_dir)).select("path", "anchor")


def lnt5_anchor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.anchor_checks(markdown(spark, sf_dir)).groupBy("verdict").agg(F.count(F.lit(1)).alias("links"))


def lnt6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown(spark, sf_dir)
    pictures = spark.range(0, 10, 2).select(F.concat(F.lit("docs/img/"), "id", F.lit(".png")).alias("path"))
    return lint.broken_links(docs, docs.select("path").unionByName(pictures)).groupBy("resolved").agg(F.count(F.lit(1)).alias("links"))


def lnt7_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.without_summary(markdown(spark, sf_dir))


def lnt8_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown(spark, sf_dir)
    return lint.not_indexed(docs.select("path"), docs)


def lnt9_walkthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id"])
    modules = docs.select(F.concat(F.lit("src/m"), F.col("doc_id") % 500, F.lit(".py")).alias("path")).distinct()
    guide = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("guide/"), "doc_id").alias("path"), F.concat(F.lit("## `m"), F.col("doc_id") % 400, F.lit(".py` explained\ntext `m1.py`")).alias("content"))
    return lint.without_walkthrough(modules, guide)


def lnt10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown(spark, sf_dir)
    return lint.report(docs, docs.select("path"))


def ast23_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slate rules on configurations derived from the labels of the vectors."""
    per = embedded(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    label = F.col("label")
    slate = per.select(
        F.concat(F.lit("m"), F.when(label == 9, 8).otherwise(label)).alias("model_id"),
        F.lit("base").alias("base_family"),
        F.when(label % 4 == 0, "none").otherwise("local").alias("serving"),
        (label % 3 != 0).alias("local"),
        F.lit("query: ").alias("query_prefix"),
        F.when(label % 2 == 0, "").otherwise("passage: ").alias("passage_prefix"),
        F.when(label % 5 == 0, "as documented").otherwise(" ").alias("prefix_note"),
    )
    return checks.slate_violations(slate)


def ast24_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts derived from the labels of the vectors, against the conventions of the models that are known."""
    label = F.col("label")
    rows = embedded(spark, sf_dir).select("label").distinct()
    artifacts = rows.select(
        F.concat(F.lit("m"), label).alias("model_id"),
        F.lit("base").alias("base_family"),
        F.when(label % 3 == 0, "cls").otherwise("mean").alias("pooling"),
        F.when(label % 4 == 0, "int8").alias("quantization"),
        F.when(label == 5, F.array(F.lit("notes.txt"))).otherwise(F.array(F.when(label % 5 == 2, "model_quantized.onnx").otherwise("model.onnx"))).alias("files"),
    )
    conventions = rows.where("label <> 7").select(F.concat(F.lit("m"), label).alias("model_id"), F.lit("mean").alias("pooling"), (label % 2 == 0).alias("quantized_fails"))
    return checks.artifact_violations(artifacts, conventions)


def vec8_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector written as text and read back: how many of its numbers are the same, and their sum."""
    own = F.transform("embedding", lambda x: x.cast("double"))
    back = vectors.vector_of(vectors.literal(F.col("embedding")))
    same = F.size(F.filter(F.zip_with(own, back, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return embedded(spark, sf_dir).select("vec_id", same.cast("bigint").alias("same"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def vec10_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding loop over all chunks with text; lengths stand in for an encoder, and a part is stored before the run begins."""
    chunks = chunk_table(spark, sf_dir).where(F.trim("text") != "").select("chunk_id", "text")
    folder = temporary(spark, "vectors")
    before = chunks.where("chunk_id % 5 = 0").select("chunk_id", F.lit("m").alias("model"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector"))
    before.write.parquet(folder)

    def encode(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ") + 1)] for t in texts]

    def corpus() -> str:
        return chunks.agg(F.bit_xor(F.xxhash64("chunk_id", "text")).cast("string").alias("h")).first()["h"]

    stored = lambda: spark.read.schema("chunk_id bigint, model string, vector array<double>").parquet(folder)
    retrieval.embed_pending(chunks, stored, encode, "m", 2, lambda df: df.write.mode("append").parquet(folder), corpus, rounds=2)
    return stored().select("chunk_id", "model", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("words"))


def met12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of means of a report, line by line, as it stands in the Markdown."""
    ranked, questions = judged_ranking(spark, sf_dir)
    scores = metrics.question_scores(ranked, questions)
    means = metrics.slice_means(scores, questions, [*metrics.SLICES, "no-such-slice"])
    rows = means.select("slice", "metric", "n", F.round("mean", 9).alias("mean"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.when(F.col("n") == 0, "empty").otherwise("mean").alias("status"))
    report = reports.made("m@onnx:0", "corpus", "gold", rows, scores.limit(0), {})
    lines = reports.as_markdown(report).split("## Means\n\n")[1].split("\n\n")[0].split("\n")
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "line int, text string")


QUERIES = {
    q.__name__: q
    for q in (vec10_embedded, met12_lines, ast24_artifacts, vec8_literals, vec1_cosine, vec2_nearest, vec3_ranks, vec4_fidelity, met15_verdicts, vec7_pooled, vec9_pending, vec11_truncated, met5_questions, met6_slices, met7_sources, met8_intervals, met8_status, met9_required, met10_comparison, met11_percentiles, met13_regressions, gte1_context, gte2_quotations, gte2_default, gte8_violations, gte10_verdicts, gte10_repaired, met14_gate, met14_refusals, rat1_by_user, rat1_default, rat1_by_type, rat1_logged_allowed, rat1_stream, rat2_honeypot, lnt1_prose, lnt2_links, lnt3_headings, lnt4_anchors, lnt5_anchor_checks, lnt6_links, lnt7_summaries, lnt8_index, lnt9_walkthrough, lnt10_report, ast23_slate)
}


def _top_sql(dimensions: int = 64) -> str:
    v = f"CAST(embedding[1:{dimensions}] AS DOUBLE[])"
    return f"""(SELECT * FROM (SELECT q.vec_id AS query, i.vec_id, list_cosine_similarity(q.v, i.v) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, i.v), 12) DESC, i.vec_id) AS rank
      FROM (SELECT vec_id, {v} AS v FROM embeddings WHERE vec_id % {QUERY_IDS} = 0) q JOIN (SELECT vec_id, {v} AS v FROM embeddings) i ON q.vec_id <> i.vec_id) WHERE rank <= {K})"""


def _scores_sql(dimensions: int = 64) -> str:
    recall = ", ".join(f"coalesce(max(CASE WHEN rank <= {k} AND hit THEN 1.0 END), 0.0)::DOUBLE AS recall_at_{k}, CASE WHEN bool_or(rank <= {k} AND has1) AND (max(n) = 1 OR bool_or(rank <= {k} AND has2)) THEN 1.0 ELSE 0.0 END::DOUBLE AS full_recall_at_{k}" for k in metrics.CUTS)
    return f"""(SELECT question_id, slice, {recall}, coalesce(1.0 / min(CASE WHEN rank <= 10 AND hit THEN rank END), 0.0)::DOUBLE AS mrr_at_10, max(n) AS n,
      coalesce(1.0 / min(CASE WHEN rank <= 10 AND has1 THEN rank END), 0.0)::DOUBLE AS mrr_label, coalesce(1.0 / min(CASE WHEN rank <= 10 AND has2 THEN rank END), 0.0)::DOUBLE AS mrr_vector,
      coalesce(max(CASE WHEN rank <= 10 AND has1 THEN 1.0 END), 0.0)::DOUBLE AS r_label, coalesce(max(CASE WHEN rank <= 10 AND has2 THEN 1.0 END), 0.0)::DOUBLE AS r_vector
      FROM (SELECT t.query AS question_id, CASE WHEN t.query % 100 = 0 THEN 'same-language' ELSE 'cross-lingual' END AS slice, t.rank, i.label = q.label AS has1, t.query % 200 = 0 AND t.vec_id = t.query + 1 AS has2,
        i.label = q.label OR (t.query % 200 = 0 AND t.vec_id = t.query + 1) AS hit, CASE WHEN t.query % 200 = 0 THEN 2 ELSE 1 END AS n
        FROM {_top_sql(dimensions)} t JOIN embeddings i ON i.vec_id = t.vec_id JOIN embeddings q ON q.vec_id = t.query WHERE t.query % 450 <> 0) GROUP BY question_id, slice)"""


_LONG = " UNION ALL ".join(f"SELECT question_id, slice, '{m}' AS metric, {n} AS value FROM s" for m, n in METRIC_NAMES.items())
_REPORTS = " UNION ALL ".join(f"SELECT '{name}' AS identity, lpad(CAST(question_id AS VARCHAR), 9, '0') AS question_id, slice, recall_at_10 AS value FROM {_scores_sql(d)}" for name, d in (("full", 64), ("short", 12), ("tiny", 4)))
def _answers_sql(limits: gate.Limits) -> str:
    return f"""rows AS (SELECT * FROM {CONTEXT}),
  ctx AS (SELECT answer_id, locator, context_id, coalesce(text, '') AS unit_text, edition, url FROM rows QUALIFY row_number() OVER (PARTITION BY answer_id, locator ORDER BY context_id DESC) = 1),
  quotes AS (SELECT answer_id, context_id * 3 AS segment, CASE WHEN context_id % 11 = 0 THEN locator || 'x' ELSE locator END AS locator, coalesce(substring(text, 1, CAST(10 + (context_id % 6) * 90 AS INT)) || CASE WHEN context_id % 13 = 0 THEN '!' ELSE '' END, '') AS quote FROM rows),
  claims AS (SELECT answer_id, context_id * 3 + 1 AS segment, CASE WHEN context_id % 17 = 0 THEN ['nowhere:2'] WHEN context_id % 7 = 0 THEN [locator, 'nowhere:1'] ELSE [locator] END AS citations FROM rows),
  prose AS (SELECT answer_id, sum(120 + CASE WHEN context_id % 2 = 0 THEN 6 ELSE 0 END) AS prose FROM rows GROUP BY 1),
  j1 AS (SELECT q.*, c.unit_text, length(quote) AS chars, CASE WHEN c.locator IS NULL THEN 'quotation_unknown_locator' WHEN NOT contains(c.unit_text, quote) THEN 'quotation_not_exact' WHEN length(quote) > {limits.max_chars} THEN 'quotation_too_long'
    WHEN coalesce(c.edition, '') = '' OR coalesce(c.url, '') = '' THEN 'quotation_missing_attribution' END AS code FROM quotes q LEFT JOIN ctx c ON c.answer_id = q.answer_id AND c.locator = q.locator),
  j2 AS (SELECT * REPLACE (CASE WHEN code IS NULL AND length(unit_text) > 0 AND sum(CASE WHEN code IS NULL THEN chars ELSE 0 END) OVER (PARTITION BY answer_id, locator) / length(unit_text) > {limits.unit_share} THEN 'quotations_exceed_unit_ratio' ELSE code END AS code) FROM j1),
  j3 AS (SELECT j2.*, prose, sum(CASE WHEN code IS NULL THEN chars ELSE 0 END) OVER (PARTITION BY j2.answer_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM j2 JOIN prose ON prose.answer_id = j2.answer_id),
  judged AS (SELECT answer_id, segment, locator, quote, CASE WHEN code IS NULL AND NOT (prose + upto = 0 OR upto / (prose + upto) <= {limits.answer_share}) THEN 'quotations_exceed_answer_ratio' ELSE code END AS code FROM j3),
  cited AS (SELECT answer_id, segment, unnest(citations) AS locator, generate_subscripts(citations, 1) AS i FROM claims),
  known AS (SELECT cited.*, ctx.locator IS NOT NULL AS there FROM cited LEFT JOIN ctx ON ctx.answer_id = cited.answer_id AND ctx.locator = cited.locator),
  found AS (SELECT answer_id, segment, code, locator FROM judged WHERE code IS NOT NULL UNION ALL SELECT answer_id, segment, 'citation_not_in_context', locator FROM known WHERE NOT there
    UNION ALL SELECT answer_id, segment, 'claim_without_citation', NULL FROM known GROUP BY 1, 2 HAVING NOT bool_or(there)),
  marked AS (SELECT *, code IN ('quotation_unknown_locator', 'quotation_not_exact', 'claim_without_citation') AS fatal FROM found),
  verdicts AS (SELECT a.answer_id, coalesce(f, 0) AS fatal, coalesce(d, 0) AS dropped, CASE WHEN coalesce(f, 0) > 0 THEN 'failed' WHEN coalesce(d, 0) = 0 THEN 'pass' ELSE 'repaired' END AS status
    FROM (SELECT DISTINCT answer_id FROM rows) a LEFT JOIN (SELECT answer_id, count(*) FILTER (fatal) AS f, count(*) FILTER (NOT fatal) AS d FROM marked GROUP BY 1) m ON m.answer_id = a.answer_id)"""


_ANSWERS, _ANSWERS_DEFAULT = _answers_sql(LIMITS), _answers_sql(gate.Limits())
_MD = r"""docs AS (SELECT doc_id, 'docs/' || doc_id || '.md' AS path, '# ' || coalesce(title, 'Untitled') || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '> **TL;DR** short' || chr(10) ELSE '' END || chr(10) || '## Notes & more' || chr(10) || '[next](' || (doc_id + 1) || '.md#notes--more) and [up](../README.md) `[no](code.md)`' || chr(10)
    || '```' || chr(10) || '[not](a-link.md)' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '## Notes & more' || chr(10) || '[own](#notes--more-1) [bad](#nowhere) [out](https://example.org/x#y) ![pic](img/' || (doc_id % 10) || '.png)' || chr(10) || coalesce(text, '') AS content FROM documents),
  lines AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM docs),
  fenced AS (SELECT *, regexp_matches(text, '^\s*(?:```|~~~)') AS fence, sum(CASE WHEN regexp_matches(text, '^\s*(?:```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS fences FROM lines),
  prose AS (SELECT path, line, text FROM fenced WHERE NOT fence AND fences % 2 = 0),
  links AS (SELECT path, line, unnest(regexp_extract_all(regexp_replace(text, '`[^`]*`', '', 'g'), '\[[^\]]*\]\(\s*<?([^)\s>]+)>?(?:\s+"[^"]*")?\s*\)', 1)) AS target FROM prose),
  heads AS (SELECT path, line, length(regexp_extract(text, '^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$', 1)) AS level, regexp_extract(text, '^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$', 2) AS heading FROM prose WHERE regexp_matches(text, '^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$')),
  slugs AS (SELECT path, line, replace(regexp_replace(lower(trim(heading)), '[^\p{L}\p{N} _-]', '', 'g'), ' ', '-') AS slug FROM heads),
  anchors AS (SELECT path, slug || CASE WHEN n = 0 THEN '' ELSE '-' || n END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY line) - 1 AS n FROM slugs WHERE slug <> ''))"""
# Links that stay in the tree, with the file they lead to: one step up leaves docs, a fragment or query is no part of a file.
_RELATIVE = r"""relative AS (SELECT *, resolved IN (SELECT path FROM docs) AS in_docs, resolved IN (SELECT path FROM docs) OR regexp_matches(resolved, '^docs/img/[02468]\.png$') AS there
    FROM (SELECT path, line, target, CASE WHEN target LIKE '../%' THEN regexp_replace(substr(target, 4), '[#?].*$', '') ELSE 'docs/' || regexp_replace(target, '[#?].*$', '') END AS resolved FROM links WHERE NOT regexp_matches(target, '(?i)^[a-z][a-z0-9+.-]*:|^//|^#')))"""
# The fold as recursion: the times of the allowed attempts travel from each attempt to the next of its user and type.
_LOGGED = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      f AS (SELECT event_id, user_id, event_type, us, n, true AS allowed, [us] AS times FROM e WHERE n = 1
        UNION ALL SELECT event_id, user_id, event_type, us, n, len(kept) < {DAY.attempts}, CASE WHEN len(kept) < {DAY.attempts} THEN list_append(kept, us) ELSE kept END
          FROM (SELECT e.*, list_filter(f.times, lambda t: t >= e.us - {DAY.seconds * 1_000_000}) AS kept FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1))
      SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS identifier, event_type AS action, us, allowed FROM f"""
_VEC7 = "(SELECT vec_id, [CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[17:32] AS DOUBLE[]), CAST(embedding[33:48] AS DOUBLE[])] AS s, vec_id % 2 AS m FROM embeddings)"

ORACLE = {
    "ast24_artifacts": """WITH l AS (SELECT DISTINCT label FROM embeddings), m AS (SELECT label, 'm' || label AS model_id FROM l)
      SELECT model_id, 'unknown-model' AS rule FROM m WHERE label = 7 UNION ALL SELECT model_id, 'pooling' FROM m WHERE label <> 7 AND label % 3 = 0
      UNION ALL SELECT model_id, 'quantized-failed' FROM m WHERE label <> 7 AND label % 2 = 0 AND (label % 4 = 0 OR (label % 5 = 2 AND label <> 5)) UNION ALL SELECT model_id, 'no-model-file' FROM m WHERE label = 5""",
    "vec10_embedded": f"SELECT chunk_id, 'm' AS model, CASE WHEN chunk_id % 5 = 0 THEN 0.0 ELSE length(text) END::DOUBLE AS chars, CASE WHEN chunk_id % 5 = 0 THEN 1.0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END::DOUBLE AS words FROM {CHUNKS} WHERE trim(text) <> ''",
    "met12_lines": f"""WITH s AS (SELECT * FROM {_scores_sql()}), l AS ({_LONG}), a AS (SELECT slice, metric, value FROM l UNION ALL SELECT 'all', metric, value FROM l), d AS (SELECT unnest(['all', 'same-language', 'cross-lingual', 'no-such-slice']) AS slice), m AS (SELECT unnest([{', '.join(repr(x) for x in METRIC_NAMES)}]) AS metric),
      t AS (SELECT d.slice, m.metric, count(a.value) AS n, round(avg(a.value), 9) AS mean FROM d CROSS JOIN m LEFT JOIN a ON a.slice = d.slice AND a.metric = m.metric GROUP BY 1, 2)
      SELECT 0 AS line, '| slice | metric | n | mean | low | high | status |' AS text UNION ALL SELECT 1, '|---|---|---|---|---|---|---|'
      UNION ALL SELECT CAST(1 + row_number() OVER (ORDER BY slice, metric) AS INT), '| ' || slice || ' | ' || metric || ' | ' || n || ' | ' || coalesce(printf('%.4f', mean), '–') || ' | – | – | ' || CASE WHEN n = 0 THEN 'empty' ELSE 'mean' END || ' |' FROM t""",
    "vec8_literals": "SELECT vec_id, len(embedding) AS same, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
    "vec1_cosine": "SELECT vec_id, round(list_cosine_similarity(CAST(embedding[1:32] AS DOUBLE[]), CAST(embedding[33:64] AS DOUBLE[])), 9) AS cosine FROM embeddings",
    "vec2_nearest": f"SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST([{', '.join(str(((i * 7) % 13 - 6) / 10) for i in range(64))}] AS DOUBLE[])), 9) AS distance FROM embeddings ORDER BY 2, 1 LIMIT {K}",
    "vec3_ranks": f"SELECT query, vec_id, round(score, 9) AS score, rank FROM {_top_sql()}",
    "vec4_fidelity": """WITH p AS (SELECT CAST(label AS VARCHAR) AS slate, vec_id AS id, CAST(embedding AS DOUBLE[]) AS r, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 1)) AS e FROM embeddings),
      c AS (SELECT a.slate, a.id, b.id AS other, round(list_cosine_similarity(a.r, b.r), 12) AS sr, round(list_cosine_similarity(a.e, b.e), 12) AS se FROM p a JOIN p b ON a.slate = b.slate AND a.id <> b.id),
      k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sr DESC, other) AS kr, row_number() OVER (PARTITION BY id ORDER BY se DESC, other) AS ke, sr - lead(sr) OVER (PARTITION BY id ORDER BY sr DESC, other) AS fall FROM c),
      q AS (SELECT slate, id, list(other ORDER BY kr) FILTER (kr <= 3) = list(other ORDER BY ke) FILTER (ke <= 3) AS same, min(fall) FILTER (kr <= 3) AS margin FROM k GROUP BY 1, 2),
      m AS (SELECT slate, count(*) AS probes, avg(list_cosine_similarity(r, e)) AS mc, min(list_cosine_similarity(r, e)) AS lc FROM p GROUP BY 1)
      SELECT m.slate, m.probes, round(mc, 6) AS mean_cosine, round(lc, 6) AS min_cosine, round(1 - mc, 6) AS perturbation, round(avg(CAST(same AS INT)), 6) AS agreement, round(avg(margin), 6) AS mean_margin, count(*) FILTER (margin < 1 - mc) AS margins_below FROM m JOIN q ON q.slate = m.slate GROUP BY m.slate, m.probes, mc, lc""",
    "met15_verdicts": "SELECT slate, CASE WHEN margins_below >= probes THEN 'no verdict: every margin is below the perturbation' WHEN mean_cosine >= 0.99 AND agreement >= 0.9 THEN 'faithful' WHEN agreement >= 0.5 THEN 'usable: some orderings changed' ELSE 'unfaithful' END AS verdict FROM (@vec4)",
    "vec7_pooled": f"""WITH c AS (SELECT vec_id, s[1] AS cls, s[2 + m] AS last, list_transform(range(1, 17), lambda i: (s[1][i] + s[2][i] + m * s[3][i]) / (2 + m)) AS mean FROM {_VEC7})
      SELECT vec_id, round(list_sum(list_transform(range(1, 17), lambda i: mean[i] * i)) / sqrt(list_sum(list_transform(mean, lambda x: x * x))), 9) AS mean, round(list_sum(list_transform(range(1, 17), lambda i: cls[i] * i)) / sqrt(list_sum(list_transform(cls, lambda x: x * x))), 9) AS cls, round(list_sum(list_transform(range(1, 17), lambda i: last[i] * i)) / sqrt(list_sum(list_transform(last, lambda x: x * x))), 9) AS lasttoken FROM c""",
    "vec9_pending": f"SELECT chunk_id FROM {CHUNKS} WHERE token_count IS NULL",
    "vec11_truncated": f"SELECT document_id, count(*) AS passages, count(*) FILTER (len(regexp_extract_all(text, '[^ \\n]+')) > 30) AS truncated FROM {CHUNKS} GROUP BY 1",
    "met5_questions": f"SELECT question_id, {', '.join(METRIC_NAMES.values())} FROM {_scores_sql()}",
    "met6_slices": f"WITH s AS (SELECT * FROM {_scores_sql()}), l AS ({_LONG}), a AS (SELECT slice, metric, value FROM l UNION ALL SELECT 'all', metric, value FROM l), d AS (SELECT unnest(['all', 'same-language', 'cross-lingual', 'no-such-slice']) AS slice), m AS (SELECT unnest([{', '.join(repr(x) for x in METRIC_NAMES)}]) AS metric) SELECT d.slice, m.metric, count(a.value) AS n, round(avg(a.value), 9) AS mean FROM d CROSS JOIN m LEFT JOIN a ON a.slice = d.slice AND a.metric = m.metric GROUP BY 1, 2",
    "met7_sources": f"WITH s AS (SELECT * FROM {_scores_sql()}) SELECT 'label' AS source_id, count(*) AS n, round(avg(r_label), 9) AS recall_at_10, round(avg(mrr_label), 9) AS mrr_at_10 FROM s UNION ALL SELECT 'vector', count(*), round(avg(r_vector), 9), round(avg(mrr_vector), 9) FROM s WHERE n = 2 HAVING count(*) > 0",
    "met8_status": f"""WITH s AS (SELECT * FROM {_scores_sql()}), l AS ({_LONG}), d AS (SELECT unnest(['same-language', 'cross-lingual', 'no-such-slice']) AS slice), m AS (SELECT DISTINCT metric FROM l UNION SELECT unnest([{', '.join(repr(x) for x in METRIC_NAMES)}]))
      SELECT d.slice, m.metric, count(value) AS n, round(avg(value), 9) AS mean, CASE WHEN count(value) = 0 THEN 'empty' WHEN count(value) = 1 THEN 'singleton' WHEN min(value) = max(value) THEN 'constant' ELSE 'percentile-bootstrap' END AS status FROM d CROSS JOIN m LEFT JOIN l ON l.slice = d.slice AND l.metric = m.metric GROUP BY 1, 2""",
    "met9_required": f"SELECT event_type, CAST(greatest(2, ceil({metrics.Z * metrics.Z!r} * var_samp(value - 50) / (avg(value - 50) * avg(value - 50)))) AS BIGINT) AS required_n, count(value) AS n FROM events GROUP BY 1",
    "met10_comparison": f"""WITH r AS ({_REPORTS}), a AS (SELECT * FROM r UNION ALL SELECT identity, question_id, 'all', value FROM r), p AS (SELECT slice, identity, row_number() OVER (PARTITION BY slice ORDER BY avg(value) DESC, identity) AS place FROM a GROUP BY 1, 2),
      x AS (SELECT a.slice, a.question_id, max(CASE WHEN place = 1 THEN value END) AS a, max(CASE WHEN place = 2 THEN value END) AS b, max(CASE WHEN place = 1 THEN a.identity END) AS first, max(CASE WHEN place = 2 THEN a.identity END) AS second FROM a JOIN p ON p.slice = a.slice AND p.identity = a.identity WHERE place <= 2 GROUP BY 1, 2)
      SELECT slice, first, second, count(*) AS n, round(avg(a - b), 9) AS mean_difference, CASE WHEN count(*) >= 2 AND avg(a - b) <> 0 AND var_samp(a - b) <> 0 THEN CAST(greatest(2, ceil({metrics.Z * metrics.Z!r} * var_samp(a - b) / (avg(a - b) * avg(a - b)))) AS BIGINT) END AS required_n,
        coalesce(string_agg(question_id, ',' ORDER BY question_id) FILTER (a > b), '') AS gains, coalesce(string_agg(question_id, ',' ORDER BY question_id) FILTER (a < b), '') AS losses FROM x GROUP BY 1, 2, 3""",
    "met11_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY 1",
    "met13_regressions": f"SELECT a.question_id FROM {_scores_sql(64)} a JOIN {_scores_sql(1)} b ON a.question_id = b.question_id WHERE a.full_recall_at_10 = 1 AND b.full_recall_at_10 = 0",
    "gte1_context": f"WITH {_ANSWERS} SELECT answer_id, locator, context_id FROM ctx",
    "gte2_quotations": f"WITH {_ANSWERS} SELECT answer_id, segment, locator, code FROM judged",
    "gte2_default": f"WITH {_ANSWERS_DEFAULT} SELECT answer_id, segment, locator, code FROM judged",
    "gte8_violations": f"WITH {_ANSWERS} SELECT answer_id, segment, code, locator, fatal FROM marked",
    "gte10_verdicts": f"WITH {_ANSWERS} SELECT * FROM verdicts",
    "gte10_repaired": f"""WITH {_ANSWERS}, good AS (SELECT answer_id, status FROM verdicts WHERE status <> 'failed')
      SELECT j.answer_id, g.status, j.segment, 'quotation' AS kind, NULL AS citations FROM judged j JOIN good g ON g.answer_id = j.answer_id WHERE code IS NULL
      UNION ALL SELECT k.answer_id, g.status, k.segment, 'claim', string_agg(locator, ',' ORDER BY i) FILTER (there) FROM known k JOIN good g ON g.answer_id = k.answer_id GROUP BY 1, 2, 3
      UNION ALL SELECT r.answer_id, g.status, context_id * 3 + 2, 'connective', NULL FROM rows r JOIN good g ON g.answer_id = r.answer_id WHERE context_id % 2 = 0""",
    "met14_gate": f"""WITH {_ANSWERS}, t AS (SELECT (SELECT count(*) FROM quotes) AS quotations, (SELECT count(*) FROM claims) AS claims, (SELECT sum(len(citations)) FROM claims)::BIGINT AS citations,
      (SELECT count(*) FROM found WHERE code IN ('quotation_unknown_locator', 'quotation_not_exact')) AS a, (SELECT count(*) FROM found WHERE code = 'citation_not_in_context') AS b, (SELECT count(*) FROM found WHERE code = 'claim_without_citation') AS c)
      SELECT quotations, claims, citations, round((quotations - a) / quotations, 9) AS quote_fidelity, round((citations - b) / citations, 9) AS citation_validity, round((claims - c) / claims, 9) AS groundedness FROM t""",
    "met14_refusals": """WITH q AS (SELECT DISTINCT id, expects_refusal AS due, question FROM gold_questions), r AS (SELECT due, coalesce(length(question) % 3 = 0, false) AS refused FROM q WHERE due IS NOT NULL),
      t AS (SELECT count(*) FILTER (due) AS a, count(*) FILTER (due AND refused) AS b, count(*) FILTER (NOT due) AS c, count(*) FILTER (NOT due AND refused) AS d FROM r)
      SELECT a AS refusals_due, b AS refused_rightly, c AS answers_due, d AS refused_wrongly, round(b / nullif(a, 0), 9) AS refusal_correctness, round((c - d) / nullif(c, 0), 9) AS answer_rate, round((b + c - d) / nullif(a + c, 0), 9) AS accuracy FROM t""",
    "rat1_by_user": f"SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS identifier, count(*) OVER w - 1 AS earlier, count(*) OVER w - 1 < {DAY.attempts} AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {DAY.seconds} SECONDS PRECEDING AND CURRENT ROW)",
    "rat1_logged_allowed": _LOGGED,
    "rat1_stream": _LOGGED,
    "rat1_default": f"SELECT event_id, count(*) OVER w - 1 AS earlier, count(*) OVER w - 1 < 5 AS allowed FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW)",
    "rat1_by_type": f"SELECT event_id, count(*) OVER w - 1 AS earlier, count(*) OVER w - 1 < {HOUR.attempts} AS allowed FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {HOUR.seconds} SECONDS PRECEDING AND CURRENT ROW)",
    "rat2_honeypot": "SELECT DISTINCT id, coalesce(regexp_matches(notes, '[^\\s\\p{Z}]'), false) AS caught FROM gold_questions",
    "lnt1_prose": f"WITH {_MD} SELECT path, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM prose GROUP BY 1",
    "lnt2_links": f"WITH {_MD} SELECT path, line, target FROM links",
    "lnt3_headings": f"WITH {_MD} SELECT path, line, level, heading FROM heads",
    "lnt4_anchors": f"WITH {_MD} SELECT path, anchor FROM anchors",
    "lnt5_anchor_checks": f"""WITH {_MD}, r AS (SELECT *, CASE WHEN target LIKE '#%' THEN path ELSE 'docs/' || split_part(target, '#', 1) END AS resolved, lower(split_part(target, '#', 2)) AS fragment FROM links WHERE contains(target, '#') AND NOT regexp_matches(target, '(?i)^[a-z][a-z0-9+.-]*:'))
      SELECT CASE WHEN resolved NOT IN (SELECT path FROM docs) THEN 'skipped' WHEN (resolved, fragment) IN (SELECT (path, anchor) FROM anchors) THEN 'ok' ELSE 'broken' END AS verdict, count(*) AS links FROM r WHERE fragment <> '' GROUP BY 1""",
    "lnt6_links": f"WITH {_MD}, {_RELATIVE} SELECT resolved, count(*) AS links FROM relative WHERE NOT there GROUP BY 1",
    "lnt7_summaries": f"WITH {_MD} SELECT path FROM docs WHERE path NOT IN (SELECT path FROM lines WHERE line <= {lint.SUMMARY_LINES} AND starts_with(text, '> **TL;DR**'))",
    "lnt8_index": f"WITH {_MD} SELECT path FROM docs WHERE regexp_extract(path, '[^/]*$') NOT IN (SELECT regexp_extract(regexp_replace(target, '[#?].*$', ''), '[^/]*$') FROM links)",
    "lnt9_walkthrough": """WITH guide AS (SELECT '## `m' || (doc_id % 400) || '.py` explained' || chr(10) || 'text `m1.py`' AS content FROM documents WHERE doc_id % 2 = 0),
      heads AS (SELECT unnest(string_split(content, chr(10))) AS text FROM guide), named AS (SELECT unnest(regexp_extract_all(text, '`([^`]*)`', 1)) AS module FROM heads WHERE regexp_matches(text, '^#{1,6}\\s'))
      SELECT DISTINCT 'm' || (doc_id % 500) || '.py' AS module FROM documents WHERE 'm' || (doc_id % 500) || '.py' NOT IN (SELECT module FROM named)""",
    "lnt10_report": f"""WITH {_MD}, {_RELATIVE}, r AS (SELECT *, CASE WHEN target LIKE '#%' THEN path ELSE 'docs/' || split_part(target, '#', 1) END AS resolved, lower(split_part(target, '#', 2)) AS fragment FROM links WHERE contains(target, '#') AND NOT regexp_matches(target, '(?i)^[a-z][a-z0-9+.-]*:')),
      v AS (SELECT CASE WHEN resolved NOT IN (SELECT path FROM docs) THEN 'skipped' WHEN (resolved, fragment) IN (SELECT (path, anchor) FROM anchors) THEN 'ok' ELSE 'broken' END AS verdict FROM r WHERE fragment <> '')
      SELECT 'link' AS rule, count(*) AS checked, count(*) FILTER (NOT in_docs) AS violations, 0 AS skipped, count(*) = 0 AS vacuous FROM relative
      UNION ALL SELECT 'anchor', count(*) FILTER (verdict <> 'skipped'), count(*) FILTER (verdict = 'broken'), count(*) FILTER (verdict = 'skipped'), count(*) FILTER (verdict <> 'skipped') = 0 FROM v""",
    "ast23_slate": """WITH s AS (SELECT DISTINCT label FROM embeddings), m AS (SELECT label, 'm' || CASE WHEN label = 9 THEN 8 ELSE label END AS model_id FROM s)
      SELECT model_id, 'not-measurable' AS rule FROM m WHERE label % 3 = 0 UNION ALL SELECT model_id, 'not-servable' FROM m WHERE label % 4 = 0 UNION ALL SELECT model_id, 'undeclared-asymmetry' FROM m WHERE label % 2 = 0 AND label % 5 <> 0
      UNION ALL SELECT model_id, 'duplicate-model' FROM m GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT NULL, CASE WHEN count(*) < 2 THEN 'too-few' ELSE 'one-family' END FROM m""",
}
ORACLE["met15_verdicts"] = ORACLE["met15_verdicts"].replace("@vec4", ORACLE["vec4_fidelity"])
