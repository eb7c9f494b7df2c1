"""Retrieval metrics over ranked sets of units, their means, intervals and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmith.functions.text import source_of
from locusmith.plans.store import written

CUTS = (5, 10, 20)
MRR_CUT = 10
METRICS = (*[f"{m}@{k}" for k in CUTS for m in ("recall", "full-recall")], f"MRR@{MRR_CUT}")
SLICES = ("all", "same-language", "cross-lingual")
# Normal quantiles of 0.975 and 0.8.
Z = 1.959963984540054 + 0.8416212335729143


def scorable(questions: DataFrame) -> DataFrame:
    """Questions (question_id, expected, slice...) that expect at least one unit."""
    return questions.where(F.size("expected") > 0)


def question_scores(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, metric columns): ranked (question_id, rank from 1, units) against questions (question_id, expected).

    The cut is by rank, before units are merged: a chunk of several units takes one rank. recall is 1 where any expected unit
    is covered, full-recall where all are, MRR the inverse rank of the first that covers one. A question without a ranking scores 0.
    """
    wanted = scorable(questions).select("question_id", F.array_distinct("expected").alias("expected"))
    hits = wanted.join(ranked.select("question_id", "rank", "units").where(F.col("rank") <= max(CUTS)), "question_id", "left")
    hit = F.arrays_overlap("units", "expected")
    covered = F.array_intersect("expected", F.coalesce("units", F.array().cast("array<string>")))
    rows = hits.select("question_id", F.size("expected").alias("_n"), "rank", hit.alias("_hit"), F.explode_outer(covered).alias("_unit"))
    aggregates: list[Column] = []
    for k in CUTS:
        aggregates.append(F.coalesce(F.max(F.when((F.col("rank") <= k) & F.col("_hit"), 1.0)), F.lit(0.0)).alias(f"recall@{k}"))
        seen = F.count_distinct(F.when(F.col("rank") <= k, F.col("_unit")))
        aggregates.append(F.when(seen == F.max("_n"), 1.0).otherwise(0.0).alias(f"full-recall@{k}"))
    first = F.min(F.when(F.col("_hit") & (F.col("rank") <= MRR_CUT), F.col("rank")))
    return rows.groupBy("question_id").agg(*aggregates, F.coalesce(1.0 / first, F.lit(0.0)).alias(f"MRR@{MRR_CUT}"))


def long_scores(scores: DataFrame) -> DataFrame:
    """(question_id, metric, value) from the metric columns."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in METRICS])
    return scores.select("question_id", F.explode(pairs).alias("_p")).select("question_id", "_p.metric", "_p.value")


def slice_means(scores: DataFrame, questions: DataFrame, slices: Sequence[str] = SLICES) -> DataFrame:
    """(slice, metric, n, mean) for all questions and each slice; a slice without questions is listed with n 0 and no mean."""
    rows = long_scores(scores).join(questions.select("question_id", "slice"), "question_id")
    rows = rows.select(F.explode(F.array(F.lit("all"), F.col("slice"))).alias("slice"), "metric", "value")
    per = rows.groupBy("slice", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    every = rows.sparkSession.createDataFrame([(s, m) for s in slices for m in METRICS], "slice string, metric string")
    return every.join(per, ["slice", "metric"], "left").select("slice", "metric", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def source_scores(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """(source_id, question_id, metric columns): expectations narrowed to each source in turn, the same mixed ranking for all."""
    parts = scorable(questions).select("question_id", F.explode(F.array_distinct("expected")).alias("u")).where("u IS NOT NULL")
    narrowed = parts.groupBy(source_of(F.col("u")).alias("source_id"), "question_id").agg(F.collect_set("u").alias("expected"))
    keyed = narrowed.withColumn("_key", F.concat_ws("\x1f", "source_id", "question_id"))
    again = keyed.select("question_id", "_key").join(ranked, "question_id").select(F.col("_key").alias("question_id"), "rank", "units")
    scored = question_scores(again, keyed.select(F.col("_key").alias("question_id"), "expected"))
    return scored.withColumnRenamed("question_id", "_key").join(keyed.select("_key", "source_id", "question_id"), "_key").drop("_key")


def bootstrap_mean(values: np.ndarray, seed: int, resamples: int, batch: int = 256) -> tuple[float, float]:
    """Percentile bounds (95 %) of the mean over resamples drawn with PCG64, batch by batch."""
    rng = np.random.default_rng(seed)
    means = np.empty(resamples)
    for at in range(0, resamples, batch):
        n = min(batch, resamples - at)
        means[at : at + n] = values[rng.integers(0, len(values), (n, len(values)))].mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def mean_intervals(rows: DataFrame, by: list[str], value: str = "value", order: str = "question_id", seed: int = 0, resamples: int = 9999, every: DataFrame | None = None) -> DataFrame:
    """by columns, n, mean, low, high, status: percentile bootstrap intervals of means; the draws go by the order of the values' questions (of the values, without that column).

    A single value has no interval, equal values one of width zero, and a group of every (by columns) without values neither mean nor interval; all
    three say so in status (singleton, constant, empty). Values must be finite. Questions of
    a slice are authored, so a group holds thousands of numbers at most; they are all that is gathered.
    """
    if resamples < 1:
        raise ValueError("resamples must be positive")
    ordered = [order] if order in rows.columns else []

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values([*ordered, value])[value].to_numpy(dtype=float)
        if not np.isfinite(values).all():
            raise ValueError("a metric that is not finite")
        mean, n = float(values.mean()), len(values)
        if n == 1:
            low, high, status = None, None, "singleton"
        elif values.min() == values.max():
            low, high, status = mean, mean, "constant"
        else:
            low, high = bootstrap_mean(values, seed, resamples)
            status = "percentile-bootstrap"
        return pd.DataFrame([[*(pdf[b].iloc[0] for b in by), n, mean, low, high, status]], columns=[*by, "n", "mean", "low", "high", "status"])

    types = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)
    found = rows.groupBy(*by).applyInPandas(one, f"{types}, n bigint, mean double, low double, high double, status string")
    if every is None:
        return found
    return every.select(*by).distinct().join(found, by, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "status": F.coalesce("status", F.lit("empty"))})


def required_n(difference: Column) -> Column:
    """An aggregate: paired questions needed (95 %, power 80 %) by the normal approximation; null without effect, spread or two values."""
    effect, spread, n = F.avg(difference), F.var_samp(difference), F.count(difference)
    usable = (n >= 2) & (effect != 0) & (spread != 0) & (F.abs(effect) < float("inf")) & ~F.isnan(effect)
    return F.when(usable, F.greatest(F.lit(2), F.ceil(F.lit(Z * Z) * spread / (effect * effect)))).cast("bigint")


def compared(reports: DataFrame, metric: str = "recall@10") -> DataFrame:
    """Per slice: the two reports with the greatest mean and their paired differences.

    reports: identity, question_id, slice, value. Columns: slice, first, second, n, mean_difference, required_n, gains, losses (question ids, sorted,
    comma-joined). Ties are broken by identity. A slice with fewer than two reports is left out.
    """
    rows = reports.select("identity", "question_id", F.explode(F.array(F.lit("all"), F.col("slice"))).alias("slice"), "value")
    means = rows.groupBy("slice", "identity").agg(F.avg("value").alias("mean"))
    place = means.withColumn("_place", F.row_number().over(Window.partitionBy("slice").orderBy(F.col("mean").desc(), "identity"))).where("_place <= 2")
    picked = rows.join(place.select("slice", "identity", "_place"), ["slice", "identity"])
    pairs = picked.groupBy("slice", "question_id").agg(
        F.max(F.when(F.col("_place") == 1, F.col("value"))).alias("a"),
        F.max(F.when(F.col("_place") == 2, F.col("value"))).alias("b"),
        F.max(F.when(F.col("_place") == 1, F.col("identity"))).alias("first"),
        F.max(F.when(F.col("_place") == 2, F.col("identity"))).alias("second"),
    ).where("a IS NOT NULL AND b IS NOT NULL")
    d = F.col("a") - F.col("b")

    def named(c: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("question_id")))), ",")

    return pairs.groupBy("slice", "first", "second").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_difference"), required_n(d).alias("required_n"), named(d > 0).alias("gains"), named(d < 0).alias("losses"))


def require_comparable(reports: DataFrame) -> DataFrame:
    """reports, or an error: at least two identities, one corpus and gold hash, each question once per report and the same in all."""
    facts = reports.agg(F.count_distinct("identity").alias("n"), F.count_distinct("corpus_hash", "gold_hash").alias("sets")).first()
    if facts["n"] < 2:
        raise ValueError("a comparison needs two reports")
    if facts["sets"] != 1:
        raise ValueError("reports of different corpora or gold sets")
    per = reports.groupBy("question_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("identity").alias("reports"), F.count_distinct("slice").alias("slices"))
    if not per.where((F.col("rows") != F.col("reports")) | (F.col("reports") != facts["n"]) | (F.col("slices") != 1)).isEmpty():
        raise ValueError("reports do not score the same questions once each")
    return reports


def latency_percentiles(latencies: DataFrame, value: str, by: list[str], shares: Mapping[str, float] = MappingProxyType({"p50": 0.5, "p95": 0.95})) -> DataFrame:
    """by columns, n and a column per share (p50, p95), exact, with linear interpolation. Null values do not count; a group without values has null.

    Equal values fall together first; the different ones are cut into ranges of key and value, whose sums tell which range holds a wanted rank. Only
    these few ranges are ranked, so neither a key nor a value has to fit in one place.
    """
    key = F.struct(*by).alias("_key")
    rows = latencies.select(key, F.col(value).cast("double").alias("_v"))
    different = rows.where("_v IS NOT NULL").groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranges = written(different.repartitionByRange("_key", "_v").withColumn("_range", F.spark_partition_id()), "percentiles")
    sums = ranges.groupBy("_key", "_range").agg(F.sum("_c").alias("_sum"))
    whole = Window.partitionBy("_key")
    sums = sums.withColumns({"n": F.sum("_sum").over(whole), "_before": F.sum("_sum").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(share)) * (F.col("n") - 1)).alias("at")) for name, share in shares.items()])
    ranks = sums.select("_key", "_range", "_sum", "_before", F.explode(wanted).alias("_w")).select("*", F.explode(F.array_distinct(F.array(F.floor("_w.at"), F.ceil("_w.at")))).alias("_rank"))
    ranks = ranks.where("_before <= _rank AND _rank < _before + _sum")
    there = ranges.join(ranks, ["_key", "_range"])
    upto = F.sum("_c").over(Window.partitionBy("_key", "_range", "_w.name", "_rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = there.withColumn("_upto", F.col("_before") + upto).where("_upto > _rank AND _upto - _c <= _rank")
    low, high = F.min("_v"), F.max("_v")
    each = found.groupBy("_key", F.col("_w.name").alias("name")).agg((low + (high - low) * (F.max("_w.at") - F.floor(F.max("_w.at")))).alias("value"))
    wide = each.groupBy("_key").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares])
    counts = latencies.groupBy(*by).agg(F.count(value).alias("n")).withColumn("_key", F.struct(*by))
    return counts.join(wide, "_key", "left").select(*by, "n", *shares)


def regressions(before: DataFrame, after: DataFrame, metric: str = "recall@10") -> DataFrame:
    """Questions that passed before and fail after: (question_id)."""
    passed = before.where(F.col(f"`{metric}`") == 1).select("question_id")
    failed = after.where(F.col(f"`{metric}`") == 0).select("question_id")
    return passed.join(failed, "question_id")


def fidelity_verdict(mean_cosine: Column, agreement: Column, margins_below: Column, probes: Column, control: Column | None = None) -> Column:
    """What a fidelity measurement allows one to say; control is the cosine of the unquantized export with the original, where it was measured."""
    # An unquantized export below the first is wrong, a quantized one below the second is broken.
    right, broken = 0.999, 0.9
    said = F.when(margins_below >= probes, "no verdict: every margin is below the perturbation").when((mean_cosine >= 0.99) & (agreement >= 0.9), "faithful").when(agreement >= 0.5, "usable: some orderings changed").otherwise("unfaithful")
    if control is None:
        return said
    fault = F.when(control < right, "fault of the export").when((control > right) & (mean_cosine < broken), "broken by quantizing")
    return F.coalesce(fault, said)
