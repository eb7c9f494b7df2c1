"""Choosing records so that each source contributes its target share of a mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusmith.plans.store import written

#: A record's place: 48 bits of the hash of its id, looked at 16 bits at a time.
BITS, STEP, LEVELS = 48, 16, 3
#: Rows of targets up to which they are sent to all executors.
FEW_TARGETS = 100_000


def placed(records: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, _h) of the records with tokens; _h is the same in every run and on every executor."""
    rows = records.select("doc_id", "source", "tokens").where("tokens > 0")
    return rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS))


def kept(df: DataFrame, few: bool, label: str) -> DataFrame:
    """A result of at most one row per target, computed once: at hand on the driver where the targets were counted to be few, else as a table."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema) if few else written(df, label)


def thresholds(rows: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """(mix_id, source, target_share, wanted, available, whole, below) for every target.

    whole: how often all records of the source are used. below: records whose _h is smaller are used once more. The place
    where the rest of the budget ends is found by histograms of tokens over hash buckets: the first cuts the whole range in 65536, and each
    next one only the bucket on the boundary. No record is sorted or collected; a histogram has 65536 rows per source.
    """
    per_source = rows.groupBy("source").agg(F.sum("tokens").alias("available"))
    per_source = per_source.withColumn("_all", F.sum("available").over(Window.partitionBy()))  # one row per source
    total = per_source.agg(F.max("_all").alias("_all"))
    wanted = targets.select("mix_id", "source", "target_share", "max_repeats", "total_fraction").join(per_source.drop("_all"), "source", "left").join(F.broadcast(total))
    wanted = wanted.withColumns({"available": F.coalesce("available", F.lit(0)), "wanted": F.col("target_share") * F.col("total_fraction") * F.coalesce("_all", F.lit(0))})
    most = F.col("available") * F.col("max_repeats")
    plan = wanted.withColumn("whole", F.when(F.col("available") == 0, 0).when(F.col("wanted") >= most, F.col("max_repeats")).otherwise(F.floor(F.col("wanted") / F.col("available"))).cast("int"))
    plan = plan.withColumn("rest", F.when(F.col("wanted") >= most, 0.0).otherwise(F.col("wanted") - F.col("whole") * F.col("available")))
    plan = kept(plan.drop("_all"), few, "mix-plan")
    small = F.broadcast if few else (lambda df: df)

    edge = plan.where("rest > 0").select("mix_id", "source", F.col("rest").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(LEVELS):
        shift = BITS - STEP * (level + 1)
        narrowed = rows.withColumn("_prefix", F.shiftright("_h", shift + STEP)).join(small(edge.select("source", "_prefix").distinct()), ["source", "_prefix"])
        histogram = narrowed.groupBy("source", "_prefix", F.shiftright("_h", shift).alias("_bucket")).agg(F.sum("tokens").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("source", "_prefix").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
        running = histogram.withColumn("_upto", upto).join(small(edge), ["source", "_prefix"])
        crossed = running.where("_upto > _left AND _upto - _n <= _left")
        edge = kept(crossed.select("mix_id", "source", (F.col("_left") - (F.col("_upto") - F.col("_n"))).alias("_left"), F.col("_bucket").alias("_prefix")), few, "mix-edge")
    # Records that share the last bucket share all 48 bits; they would exceed the budget and stay out together.
    found = edge.select("mix_id", "source", F.col("_prefix").alias("below"))
    return plan.join(found, ["mix_id", "source"], "left").withColumn("below", F.coalesce("below", F.lit(0).cast("long")))


def mixed(records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen records, report) of every mix.

    records: doc_id, source, tokens. targets: mix_id, source, target_share, max_repeats, total_fraction.
    Chosen: mix_id, doc_id, source, tokens, copies (1 to max_repeats). A source smaller than its share is repeated as a whole
    and once more in part; where max_repeats does not reach the share, everything is used max_repeats times.
    Report: one row per target with tokens wanted and reached, and the target and reached share of the mix.
    A source without records reaches 0. Records with null or no tokens, without a source or of a source no mix names are not used; the latter
    two count for the size that total_fraction is a fraction of.
    """
    rows = written(placed(records), "mix-records")
    few = targets.count() <= FEW_TARGETS
    plan = kept(thresholds(rows, targets, few), few, "mix-thresholds")
    wanted = plan.select("mix_id", "source", "whole", "below")
    chosen = rows.join(F.broadcast(wanted) if few else wanted, "source")
    chosen = chosen.withColumn("copies", F.col("whole") + (F.col("_h") < F.col("below")).cast("int")).where("copies > 0")
    chosen = chosen.select("mix_id", "doc_id", "source", "tokens", "copies")
    reached = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_copies"))
    report = plan.join(reached, ["mix_id", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("reached_tokens", "records", "most_copies")})
    share = F.col("reached_tokens") / F.nullif(F.sum("reached_tokens").over(Window.partitionBy("mix_id")), F.lit(0))
    report = report.select("mix_id", "source", "target_share", F.round("wanted", 3).alias("wanted_tokens"), "available", "reached_tokens", "records", "most_copies", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("reached_share"))
    return chosen, report
