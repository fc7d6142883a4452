"""One ordered fold for the steps that are greedy by nature.

Rows are hashed by stream and sorted within the partitions, then read once in Arrow batches.  Only the
state of the stream at hand is kept, never its rows, so a stream of any length passes through one task in
constant memory.  A greedy step depends on the one before; a single stream cannot be folded in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(
    df: DataFrame,
    stream: str,
    order: tuple[str, ...],
    columns: tuple[str, ...],
    start: Callable[[], Any],
    step: Callable[[Any, tuple], list[tuple]],
    finish: Callable[[Any], list[tuple]],
    schema: str,
) -> DataFrame:
    """Fold the rows of each stream in order.

    ``start`` makes the state, ``step(state, row)`` changes it and gives output rows, ``finish(state)`` gives
    the last ones.  ``row`` holds ``columns``; output rows follow ``schema`` without the stream, which comes first.
    Streams that are null are left out; nulls in ``order`` come first.
    """
    kept = tuple(dict.fromkeys((stream, *order, *columns)))
    places = [kept.index(c) for c in columns]
    whole = f"`{stream}` {dict(df.dtypes)[stream]}, {schema}"
    form = to_arrow_schema(StructType.fromDDL(whole))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(form), form)], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out: list[tuple] = []
            values = [c.to_pylist() for c in batch.columns]
            for name, row in zip(values[0], zip(*[values[p] for p in places])):
                if name != current:
                    if current is not None:
                        out += [(current, *x) for x in finish(state)]
                    current, state = name, start()
                out += [(current, *x) for x in step(state, row)]
            yield batch_of(out)
        if current is not None:
            yield batch_of([(current, *x) for x in finish(state)])

    slim = df.select(*kept).where(df[stream].isNotNull())
    return slim.repartition(stream).sortWithinPartitions(stream, *order).mapInArrow(run, whole)
