"""Folds over ordered rows whose state is no window function: state travels down a sorted partition, row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, by: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, Any]], out: str, out_type: str) -> DataFrame:
    """df with a column out: step(state, row) gives the next state and the row's value, in order within each group of by.

    Groups are hashed to partitions and sorted there; batches stream through with one state in memory, so a group of any length is
    never gathered. A group is folded by one task, since each state hangs on the one before: keep the rows narrow. The
    order must be total for a repeatable result. A null in by is a group of its own.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` {out_type}"])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = object(), None
        for batch in batches:
            keys = zip(*[batch[b].astype(object).where(batch[b].notna(), None).tolist() for b in by], strict=True)
            values = []
            for key, row in zip(keys, batch.itertuples(index=False), strict=True):
                if key != group:
                    group, state = key, start()
                state, value = step(state, row)
                values.append(value)
            yield batch.assign(**{out: values})

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
