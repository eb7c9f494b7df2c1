"""What changed between consecutive full deliveries of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def snapshot_changes(
    df: DataFrame,
    compared: dict[str, Column],
    snapshot: str = "snapshot_id",
    key: str = "id",
    delivered: str = "delivered_at",
) -> DataFrame:
    """Rows (snapshot, key, change) for every delivery but the first; change is added, removed or changed.

    EXCEPT ALL both ways in one aggregation: every row counts +1 for its own delivery and -1 for the next one, and what sums to zero is
    identical in both. The residues of both signs meet by key, as in a full join, in a second aggregation. After the latest row of each key is
    known, rows travel once more, by key alone, and all that follows stays in place. A removed key carries the id of the later delivery.

    compared: the columns that make a change, already brought to one spelling; two nulls are equal.
    Of several rows of a key in a delivery the one with the greatest delivery time counts (a null time is the least;
    equal times: the greatest values, so the result does not depend on the order of rows). Copies therefore fall
    together in the map-side aggregation, and a key has one row per delivery thereafter. Rows with a null snapshot or key are no records and are ignored.
    An empty table, or one with a single delivery, gives no rows. Other columns of df are never read.
    """
    names = [f"_v{i}" for i in range(len(compared))]
    rows = df.select(
        F.col(snapshot).alias("_snapshot"),
        F.col(key).alias("_key"),
        F.col(delivered).alias("_at"),
        *[c.alias(n) for n, c in zip(names, compared.values(), strict=True)],
    ).where("_snapshot IS NOT NULL AND _key IS NOT NULL")
    # One row: the ids of the deliveries, a handful, however large the deliveries are.
    deliveries = df.agg(F.sort_array(F.collect_set(snapshot)).alias("_all"))
    latest = rows.groupBy("_snapshot", "_key").agg(F.max(F.struct("_at", *names)).alias("_r")).repartition("_key")
    numbered = latest.join(F.broadcast(deliveries)).withColumn("_no", F.array_position("_all", F.col("_snapshot")))
    signs = [F.struct((F.col("_no") + later).alias("_no"), F.lit(sign).alias("_sign")) for later, sign in ((0, 1), (1, -1))]
    signed = numbered.select("_key", "_all", *[F.col(f"_r.{n}").alias(n) for n in names], F.explode(F.array(*signs)).alias("_s"))
    # The delivery after the last one does not exist.
    signed = signed.where((F.col("_s._no") > 1) & (F.col("_s._no") <= F.size("_all")))
    signed = signed.select("_key", *names, F.col("_s._no").alias("_no"), F.col("_s._sign").alias("_sign"), F.element_at("_all", F.col("_s._no").cast("int")).alias("_snapshot"))
    residue = signed.groupBy("_key", "_no", "_snapshot", *names).agg(F.sum("_sign").alias("_n")).where("_n <> 0")
    both = residue.groupBy("_key", "_no", "_snapshot").agg(F.max(F.col("_n") > 0).alias("_new"), F.max(F.col("_n") < 0).alias("_old"))
    change = F.when(~F.col("_old"), "added").when(~F.col("_new"), "removed").otherwise("changed")
    return both.select(F.col("_snapshot").alias(snapshot), F.col("_key").alias(key), change.alias("change"))


def document_snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """snapshot_changes of document_snapshots: letter case of the hash and blanks around the edition do not count."""
    return snapshot_changes(
        snapshots,
        {
            "content_hash": F.lower("content_hash"),
            "edition": blank_to_null(F.col("edition")),
            "is_current": F.col("is_current"),
        },
    )


def changes_per_delivery(changes: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """How many keys were added, removed and changed, by delivery."""
    return changes.groupBy(snapshot, "change").agg(F.count(F.lit(1)).alias("records"))
