"""The N best rows of every group, by partition lower bounds.

Each input partition keeps its own N best distinct rows of every group it sees; the score of its N-th best
is a lower bound for the group's N-th best overall.  The greatest bound of each group is joined to those
rows, rows below it go, and only the survivors are ranked.  The input is read once and its rows are never
shuffled: what moves is at most N rows for each group and partition.

Order: score descending, then the order column, then the id, both ascending (null and NaN first).  Rows
without a group and scores that are null or NaN take no part; rows repeated whole count once; a group with
fewer than N rows keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize

_BUFFER_ROWS = 65_536


def _local_best(rows: pa.Table, n: int, bounds: bool) -> pa.Table:
    rows = rows.group_by(["g", "x", "t", "id"]).aggregate([]).select(["g", "x", "t", "id"])
    keys = [("g", "ascending"), ("x", "descending"), ("t", "ascending"), ("id", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
    code = rows["g"].combine_chunks().dictionary_encode()
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
    first = np.ones(len(code), bool)
    first[1:] = code[1:] != code[:-1]
    at = np.arange(len(code))
    place = at - np.maximum.accumulate(np.where(first, at, 0))
    kept = rows.filter(pa.array(place < n))
    if bounds:
        x = rows["x"].to_numpy()
        bound = np.full(int(code.max()) + 1 if len(code) else 0, np.nan)
        last = place == n - 1
        bound[code[last]] = x[last]
        kept = kept.append_column("bound", pa.array(bound[code[place < n]], pa.float64(), from_pandas=True))
    return kept


def top_n(df: DataFrame, group_col: str, score_col: str, order_col: str, id_col: str, n: int) -> DataFrame:
    """group, id, score, order column and place (from 1) of the ``n`` best rows of each group."""
    if n < 1:
        raise ValueError("n must be at least 1")
    t = F.col(order_col)
    if dict(df.dtypes)[order_col] in ("double", "float"):
        t = F.when(~F.isnan(t), t)
    slim = df.select(F.col(group_col).alias("g"), F.col(score_col).cast("double").alias("x"), t.alias("t"), F.col(id_col).alias("id"))
    slim = slim.filter(F.col("g").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size > _BUFFER_ROWS + (2 * len(best) if best is not None else 0):
                best = _local_best(pa.concat_tables(([best] if best is not None else []) + [pa.Table.from_batches(waiting)]), n, False)
                waiting, size = [], 0
        if waiting:
            best = pa.concat_tables(([best] if best is not None else []) + [pa.Table.from_batches(waiting)])
        if best is not None and len(best):
            yield from _local_best(best, n, True).to_batches(max_chunksize=10_000)

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    best = materialize(slim.mapInArrow(local, f"g {kinds['g']}, x double, t {kinds['t']}, id {kinds['id']}, bound double"), "local-best")
    bounds = best.groupBy("g").agg(F.max("bound").alias("least"))
    alive = best.join(bounds, "g").filter(F.col("least").isNull() | (F.col("x") >= F.col("least"))).select("g", "x", "t", "id").distinct()
    order = Window.partitionBy("g").orderBy(F.desc("x"), F.asc_nulls_first("t"), F.asc_nulls_first("id"))
    ranked = alive.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return ranked.select(
        F.col("g").alias(group_col), F.col("id").alias(id_col), F.col("x").alias(score_col), F.col("t").alias(order_col), "place"
    )
