"""Filling containers of fixed capacity with items, dividing an item only where it alone exceeds the capacity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmith.plans.store import written

#: Items of one packer. Each packer ends with some containers unfilled, so it should have many items; they take little memory.
ITEMS_PER_PACKER = 200_000
#: Packers whose partly filled containers are placed once more together; each leaves fewer than its capacity has levels.
GROUP = 1000
PACKED = "container_id string, packer int, container_no bigint, item_id bigint, first_token bigint, tokens bigint"


class SumOfSquares:
    """Online packing by the sum-of-squares rule.

    levels[h] counts the containers filled to h that are neither empty nor full. An item goes where the sum of squares of the
    counts grows least; among equals into the fullest container. Containers of one level are taken last in, first out.
    """

    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ValueError("a container holds at least one token")
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        #: levels where containers exist, else a number no level reaches
        self.present = np.full(capacity + 1, -(1 << 40), dtype=np.int64)
        self.open: dict[int, list[int]] = {}
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> int:
        """The container an item of at most the capacity goes to."""
        capacity, levels = self.capacity, self.levels
        if size == capacity:
            return self.new()
        # growth of the sum, halved: levels[h + size] - levels[h] + 1, and half less where the container becomes full (nothing is left to count)
        growth = (levels[size + 1 :] - self.present[1 : capacity - size + 1]) * 2 + 2
        growth[-1] -= 1
        from_top = int(growth[::-1].argmin())
        height = capacity - size - from_top
        if growth[height - 1] <= 2 * levels[size] + 1:
            container = self.open[height].pop()
            levels[height] -= 1
            self.present[height] = levels[height] or -(1 << 40)
        else:
            container, height = self.new(), 0
        if height + size < capacity:
            self.open.setdefault(height + size, []).append(container)
            levels[height + size] += 1
            self.present[height + size] = levels[height + size]
        return container


def pack_all(items: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], SumOfSquares]:
    """([(container, item, first token, tokens)], packer): full pieces of an item that exceeds the capacity fill containers of their own."""
    packer = SumOfSquares(capacity)
    out = []
    for item, size in items:
        done = 0
        while size - done > capacity:
            out.append((packer.new(), item, done, capacity))
            done += capacity
        if size > done:
            out.append((packer.place(size - done), item, done, size - done))
    return out, packer


def packed(items: DataFrame, capacities: Mapping[str, int]) -> DataFrame:
    """Every item (item_id, tokens) in containers of each capacity: (container_id, packer, container_no, item_id, first_token, tokens).

    Items are dealt to packers by the hash of their id and placed in the order of that hash, so a lost task is repeated with the same
    result. Every packer of every capacity is a task of its own. The containers a packer leaves partly filled are placed once more, as items, by one
    packer for GROUP of the first kind; a container's number is that of the packer and container where it ends up.
    Items without tokens (or null) need no place. Repeated ids are items of their own. No items, no rows.
    """
    items = items.select("item_id", "tokens").where("tokens > 0")
    names = list(capacities)
    packers = max(1, items.count() // ITEMS_PER_PACKER)
    hashed = items.withColumn("_h", F.xxhash64("item_id")).withColumn("_no", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    hashed = hashed.withColumn("_slot", (F.pmod(F.col("_h"), F.lit(packers)) * len(names) + F.col("_no")).cast("int"))
    dealt = hashed.repartitionById(packers * len(names), "_slot").sortWithinPartitions("_h", "item_id", "tokens").select("_slot", "item_id", "tokens")

    def first(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)  # two numbers an item, ITEMS_PER_PACKER items or so
        if not frames:
            return
        own = pd.concat(frames)
        no, which = divmod(int(own["_slot"].iloc[0]), len(names))
        capacity = capacities[names[which]]
        rows, packer = pack_all(zip(own.item_id.tolist(), own.tokens.tolist(), strict=True), capacity)
        level = {c: h for h, containers in packer.open.items() for c in containers}
        frame = pd.DataFrame(rows, columns=["container_no", "item_id", "first_token", "tokens"])
        frame["level"] = frame.container_no.map(level).fillna(capacity).astype("int64")
        frame["container_id"], frame["packer"] = names[which], no
        yield frame[["container_id", "packer", "container_no", "item_id", "first_token", "tokens", "level"]]

    placed = written(dealt.mapInPandas(first, PACKED + ", level bigint"), "packed")
    sizes = F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair])
    left = placed.where(F.col("level") < sizes[F.col("container_id")]).select("container_id", "packer", "container_no", "level").distinct()
    left = left.withColumn("_group", F.expr(f"packer div {GROUP}"))

    def second(group: pd.DataFrame) -> pd.DataFrame:
        name, no = group.container_id.iloc[0], int(group["_group"].iloc[0])
        again = SumOfSquares(capacities[name])
        group = group.sort_values(["level", "packer", "container_no"], ascending=[False, True, True])
        group["new_no"] = [again.place(int(h)) for h in group.level]
        group["new_packer"] = -1 - no
        return group[["container_id", "packer", "container_no", "new_packer", "new_no"]]

    moved = left.groupBy("container_id", "_group").applyInPandas(second, "container_id string, packer int, container_no bigint, new_packer int, new_no bigint")
    joined = placed.join(moved, ["container_id", "packer", "container_no"], "left")
    return joined.select("container_id", F.coalesce("new_packer", "packer").alias("packer"), F.coalesce("new_no", "container_no").alias("container_no"), "item_id", "first_token", "tokens")


def fill_report(placed: DataFrame, capacities: Mapping[str, int]) -> DataFrame:
    """By capacity: containers used, the fewest any packing could need, tokens, and the share of space left unused."""
    sizes = F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair])
    per = placed.groupBy("container_id", "packer", "container_no").agg(F.sum("tokens").alias("tokens"))
    total = per.groupBy("container_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    capacity = sizes[F.col("container_id")]
    return total.select(
        "container_id",
        capacity.alias("capacity_tokens"),
        "containers",
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        "tokens",
        "fullest",
        F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6).alias("unused_share"),
    )
