"""Folds over ordered events of a key, with memory for one key's state at a time."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(events: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple], schema: str) -> DataFrame:
    """``step(state, row)`` for each event of a key in order; the rows that it returns.

    Events are dealt by key and sorted in their partition; a task streams them and
    holds a single state. A key's events are one sequence, and so one task's: a key
    with a third of all events bounds the time, whatever the cluster. Null keys are
    one key. Longs stay longs beside nulls.
    """
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, first = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            row_of = namedtuple("Event", batch.schema.names)
            rows = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = row_of(*values)
                own = getattr(row, key)
                if first or own != current:
                    current, state, first = own, start(), False
                rows.append(step(state, row))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
