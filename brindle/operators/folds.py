"""Ordered folds: rules in which what becomes of a row depends on what became of the rows before it.

A running sum can't express them, since a refused row leaves the state as it was. Rows are dealt by key and sorted, and one
state for each key is carried over its rows as they stream by: no group is ever held, so a key's rows are bounded by time only, not by
memory. Callers keep a fold small by settling beforehand, with sums, whatever can't be refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str | Column], reads: list[str], start: Callable[[tuple], object], step: Callable[[object, tuple], tuple], result: pa.Schema) -> DataFrame:
    """``rows`` with the columns of ``result``, which ``step`` gives for each row.

    start: the state before a key's first row, from that row's values of ``reads``; step: the result for a row, from the state (which it changes in place) and the
    row's values of ``reads``. Rows whose keys are equal, null being equal to null, share a state.
    """
    kept = [c for c in rows.columns if c not in result.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            given = [batch.column(c).to_pylist() for c in keys], [batch.column(c).to_pylist() for c in reads]
            found = []
            for key, row in zip(zip(*given[0]), zip(*given[1])):
                if key != now:
                    now, state = key, start(row)
                found.append(step(state, row))
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*found), result)] if found else [pa.array([], f.type) for f in result]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *result.names])

    dealt = rows.select(*[F.col(f"`{c}`") for c in kept]).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, StructType([*dealt.schema.fields, *from_arrow_schema(result).fields]))
