"""Rate limiting over an event log: trailing-window counts, and the fold in which only allowed attempts are logged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmith.functions.hashing import pseudonym
from locusmith.operators.fold import ordered_fold


@dataclass(frozen=True)
class Limit:
    """Five attempts within ten minutes."""

    attempts: int = 5
    seconds: int = 600


def not_blank(text: Column) -> Column:
    """The honeypot: whether a field holds anything but white space; null does not."""
    return F.coalesce(text.rlike(r"[^\s\p{Z}﻿]"), F.lit(False))


def replayed(log: DataFrame, limit: Limit, identifier: str, action: str, at: str = "ts", key: str = "event_id") -> DataFrame:
    """Every attempt with earlier (attempts of its identifier and action in the window that ends with it, itself and those
    logged at the same time after it excluded) and allowed. All attempts are logged.

    Time is cut into stretches as long as the window, and every attempt is counted in its own stretch and shown to the next, so a busy
    identifier is spread over its stretches. Identifiers appear as pseudonyms only. A null identifier or time is denied: nothing can be counted for it.
    """
    rows = log.select(key, pseudonym(F.col(identifier)).alias("identifier"), F.col(action).alias("action"), F.col(at).alias("at"))
    rows = rows.withColumn("_us", F.unix_micros(F.col("at").cast("timestamp")))
    length = limit.seconds * 1_000_000
    rows = rows.withColumn("_later", F.explode(F.when(F.col("_us").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    rows = rows.withColumn("_stretch", F.floor(F.col("_us") / F.lit(length)) + F.col("_later"))
    by = ["identifier", "action", "_stretch"]
    window = Window.partitionBy(*by).orderBy("_us").rangeBetween(-length, 0)
    tie = Window.partitionBy(*by, "_us")
    order = F.row_number().over(tie.orderBy(key))
    earlier = F.count(F.lit(1)).over(window) - (F.count(F.lit(1)).over(tie) - order) - 1
    known = F.col("identifier").isNotNull() & F.col("_us").isNotNull()
    rows = rows.withColumn("earlier", F.when(known, earlier)).where("_later = 0")
    return rows.select(key, "identifier", "action", "at", "earlier", F.coalesce(F.col("earlier") < limit.attempts, F.lit(False)).alias("allowed"))


def replayed_logging_allowed(log: DataFrame, limit: Limit, identifier: str, action: str, at: str = "ts", key: str = "event_id") -> DataFrame:
    """As replayed, but only allowed attempts count: a fold whose state is at most `attempts` times per identifier and action."""
    rows = log.where(F.col(identifier).isNotNull() & F.col(at).isNotNull()).select(key, pseudonym(F.col(identifier)).alias("identifier"), F.col(action).alias("action"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    window, most = limit.seconds * 1_000_000, limit.attempts

    def step(times: tuple[int, ...], row) -> tuple[tuple[int, ...], bool]:
        times = tuple(t for t in times if t >= row.us - window)
        allowed = len(times) < most
        return ((*times, row.us) if allowed else times), allowed

    return ordered_fold(rows, ["identifier", "action"], ["us", key], tuple, step, "allowed", "boolean")
