"""References to records that did not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys per block. Runs end at block borders, so no group of runs or window of keys grows with the data.
BLOCK = 4096
#: References to one key that are judged in one task; those to a key with more are dealt out, its spans copied to every part.
PART = 100_000
#: White space of any kind, for trimming.
EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def reference_key(c: Column) -> Column:
    """The form in which keys are compared: no white space around it, lower case; blank becomes null."""
    return F.nullif(F.lower(F.regexp_replace(c, EDGE, "")), F.lit(""))


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Splits a key into the part before its last number and that number; a key without one is its own part, number 0.

    Numbers with leading zeros or more than 15 digits stay text: they would not come back unchanged.
    """
    digits = F.regexp_extract(key, r"(?:^|[^0-9])(0|[1-9][0-9]{0,14})$", 1)
    df = df.withColumn("_digits", digits)
    number = F.when(F.col("_digits") != "", F.col("_digits").cast("long")).otherwise(F.lit(0))
    stem = F.when(F.col("_digits") != "", F.expr(f"concat('#', left({key}, length({key}) - length(_digits)))")).otherwise(F.col(key))
    return df.withColumns({"_n": number, "_stem": stem}).drop("_digits")


def merged_validity(parents: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to) with overlapping and touching spans of a key made one; valid_to null is open.

    Spans are merged within a month first, so a key with very many versions reaches the second pass already small.
    """
    rows = parents.where("key IS NOT NULL AND valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)").distinct()
    far = F.lit("9999-12-31").cast("timestamp")
    rows = rows.select("key", "valid_from", F.coalesce("valid_to", far).alias("_to"))

    def merge(df: DataFrame, by: list[Column]) -> DataFrame:
        before = Window.partitionBy(*by).orderBy("valid_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*by).orderBy("valid_from", "_to").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_reach", F.max("_to").over(before))
        df = df.withColumn("_part", F.count(F.when(F.col("_reach").isNull() | (F.col("_reach") < F.col("valid_from")), 1)).over(upto))
        return df.groupBy(*by, "_part").agg(F.min("valid_from").alias("valid_from"), F.max("_to").alias("_to"))

    monthly = merge(rows.withColumn("_month", F.date_trunc("month", "valid_from")), [F.col("key"), F.col("_month")])
    return merge(monthly.select("key", "valid_from", "_to"), [F.col("key")]).select("key", "valid_from", F.col("_to").alias("valid_to"))


def key_runs(keys: DataFrame) -> DataFrame:
    """Contiguous runs of the integer keys (key): (_stem, _block, first, last). Repeated keys count once."""
    numbers = _numbered(keys.select("key").where("key IS NOT NULL").distinct(), "key").withColumn("_block", F.expr(f"_n div {BLOCK}"))
    run = Window.partitionBy("_stem", "_block").orderBy("_n")
    islands = numbers.withColumn("_island", F.col("_n") - F.row_number().over(run))
    return islands.groupBy("_stem", "_block", "_island").agg(F.min("_n").alias("first"), F.max("_n").alias("last")).drop("_island")


def _as_of(known: DataFrame, asked: DataFrame, by: list[str], at: str, carried: str) -> DataFrame:
    """asked with the carried value of the last known row at or before it in each group: both sorted in one sequence, the last known carried forward."""
    both = known.select(*by, at, carried, F.lit(0).alias("_side")).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(carried, F.last(carried, ignorenulls=True).over(before)).where("_side = 1").drop("_side")


def _orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """orphan_references with the key of every reference in the column key."""
    refs = _numbered(references.select("ref_table", "ref_id", "ref_value", "ref_time", "key").where("key IS NOT NULL"), "key")
    spans = _numbered(merged_validity(parents), "key")
    asked = refs.groupBy("_stem", "_n").agg(F.count(F.lit(1)).alias("_asked")).withColumn("_block", F.expr(f"_n div {BLOCK}"))
    runs = key_runs(spans.select("key")).withColumnRenamed("first", "_n").withColumnRenamed("last", "_end")
    judged = _as_of(runs, asked, ["_stem", "_block"], "_n", "_end")
    judged = judged.select("_stem", "_n", F.coalesce(F.col("_n") <= F.col("_end"), F.lit(False)).alias("_inside"), F.ceil(F.col("_asked") / PART).cast("int").alias("_parts"))
    dealt = refs.join(judged, ["_stem", "_n"]).withColumn("_part", F.pmod(F.xxhash64("ref_id", "ref_time"), "_parts").cast("int"))
    spans = spans.join(judged.where("_inside"), ["_stem", "_n"]).withColumn("_part", F.explode(F.expr("sequence(0, _parts - 1)")))
    dealt = dealt.select("_stem", "_n", "_part", "_inside", F.col("ref_time").alias("_at"), "ref_table", "ref_id", "ref_value", "ref_time")
    spans = spans.select("_stem", "_n", "_part", F.col("valid_from").alias("_at"), F.col("valid_to").alias("_until"))
    found = _as_of(spans, dealt, ["_stem", "_n", "_part"], "_at", "_until")
    exists = F.col("_inside") & F.coalesce(F.col("_until") > F.col("ref_time"), F.lit(False))
    return found.where(~exists).select("ref_table", "ref_id", "ref_value", "ref_time").distinct()


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of references (ref_table, ref_id, ref_value, ref_time) whose parent did not exist at ref_time.

    parents: (key, valid_from, valid_to), key in the form of reference_key. Parent keys that ever existed are compressed to runs of
    consecutive integers. Every key referred to is matched as of the run that starts at or before it, and has no parent where it lies beyond
    that run's end; the others are matched in time, as of the parent's span that starts at or before the reference. Keys are asked
    once, however many references they have, in blocks of BLOCK numbers; references to a key with more than PART of them are dealt out.

    Null and blank values are no references. A reference without a time matches nothing and is reported. Repeated rows
    give one row. With no parents every reference is an orphan.
    """
    return _orphans(references.withColumn("key", reference_key(F.col("ref_value"))), parents)


def corpus_orphans(gold: DataFrame, expectations: DataFrame, units: DataFrame, documents: DataFrame) -> DataFrame:
    """orphan_references of gold questions and expectations against stored units and emitted documents."""
    gold_refs = gold.select(
        F.lit("gold_questions.expected_units").alias("ref_table"),
        F.col("id").cast("string").alias("ref_id"),
        F.explode("expected_units").alias("ref_value"),
        F.col("created_at").alias("ref_time"),
    )

    def expected(column: str) -> DataFrame:
        return expectations.select(
            F.lit(f"expectations.{column}").alias("ref_table"),
            F.col("expectation_id").cast("string").alias("ref_id"),
            F.col(column).alias("ref_value"),
            F.col("recorded_at").alias("ref_time"),
        )

    def spelled(kind: Column, value: str) -> Column:
        return F.concat(kind, F.lit(" "), reference_key(F.col(value)))  # one pass for both kinds of parents

    unit, source = F.lit("unit"), F.lit("source")
    references = gold_refs.unionByName(expected("locator")).unionByName(expected("source_id"))
    kind = F.when(F.col("ref_table") == "expectations.source_id", source).otherwise(unit)
    unit_keys = units.select(spelled(unit, "locator").alias("key"), F.col("ingested_at").alias("valid_from"), F.col("deleted_at").alias("valid_to"))
    source_keys = documents.select(spelled(source, "source_id").alias("key"), F.col("emitted_at").alias("valid_from"), F.col("withdrawn_at").alias("valid_to"))
    return _orphans(references.withColumn("key", spelled(kind, "ref_value")), unit_keys.unionByName(source_keys))


def orphans_per_period(orphans: DataFrame) -> DataFrame:
    """Orphans by referring table and month; references without a time have a null month."""
    return orphans.groupBy("ref_table", F.date_format("ref_time", "yyyy-MM").alias("period")).agg(
        F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref_value").alias("missing_values")
    )
