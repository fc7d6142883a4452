"""Runs of near-equal consecutive events, each collapsed into one row with count and duration.

The events are sorted by sequence, time and id over range partitions, so a sequence with most of the rows
spreads over many tasks.  Within a partition only the boundary events count, those that differ from their
predecessor: the next boundary ends a run, the difference of their positions is its count, and the event
before the next boundary gives its end.  The first and the last run of each partition may go on beside it;
these fragments, two to a partition, are stitched afterwards.

Defined cases: events without a sequence or an id, or with a null or zero hash, take no part; rows repeated whole
count once; events order by time (null first, NaN last), then id; the duration is the difference of the
times of the last and the first event (null if either is null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize

_FIELDS = ("first_id", "last_id", "first_t", "last_t", "first_hash", "last_hash")


def _runs_of_partition(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        pending: list | None = None  # the open run: sequence, fields, count
        number = 0

        def rows(table: dict, edge: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            k = len(edge)
            seq = np.arange(number, number + k)
            number += k
            arrays = [pa.array(np.full(k, part), pa.int32()), pa.array(seq, pa.int64()), table["s"], pa.array(edge)]
            arrays += [table[f] for f in _FIELDS] + [pa.array(table["n"], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "seq", "s", "edge", *_FIELDS, "n"])

        for batch in batches:
            if not len(batch):
                continue
            s, t, i, h = batch.columns
            hv = h.to_numpy(zero_copy_only=False).view(np.uint64)
            code = s.dictionary_encode().indices.to_numpy()
            iv = i.to_numpy(zero_copy_only=False)
            tv = t.to_numpy(zero_copy_only=False)
            same = code[1:] == code[:-1]
            # Whole repetitions lie side by side in this order.
            same_t = (tv[1:] == tv[:-1]) | ((tv[1:] != tv[1:]) & (tv[:-1] != tv[:-1]))
            repeated = np.concatenate([[False], same & same_t & (iv[1:] == iv[:-1]) & (hv[1:] == hv[:-1])])
            if pending is not None and s[0] == pending[0] and iv[0] == pending[1][1].as_py() and hv[0] == pending[2]:
                p_t, a_t = pending[1][3].as_py(), t[0].as_py()
                repeated[0] = p_t == a_t or (p_t is not None and a_t is not None and p_t != p_t and a_t != a_t)
                if repeated[0]:  # further repetitions of the same row follow it
                    stop = np.flatnonzero(~repeated)
                    repeated[: stop[0] if len(stop) else len(repeated)] = True
            keep = np.flatnonzero(~repeated)
            if not len(keep):
                continue
            code, hv = code[keep], hv[keep]
            differs = np.ones(len(keep), bool)
            differs[1:] = (code[1:] != code[:-1]) | (np.bitwise_count(hv[1:] ^ hv[:-1]) > max_bits)
            joins = pending is not None and s[int(keep[0])] == pending[0] and int(np.bitwise_count(hv[0] ^ pending[2])) <= max_bits
            starts = np.flatnonzero(differs)
            ends = np.append(starts[1:], len(keep)) - 1
            count = ends - starts + 1
            a, b = keep[starts], keep[ends]
            table = {
                "s": s.take(pa.array(a)).cast(pa.string()),
                "first_id": i.take(pa.array(a)),
                "last_id": i.take(pa.array(b)),
                "first_t": t.take(pa.array(a)),
                "last_t": t.take(pa.array(b)),
                "first_hash": h.take(pa.array(a)),
                "last_hash": h.take(pa.array(b)),
                "n": count,
            }
            if pending is not None and not joins:
                yield rows(_single(pending), np.array([number == 0]))
            elif pending is not None:
                head = _single(pending)
                for f in ("first_id", "first_t", "first_hash"):
                    table[f] = pa.concat_arrays([head[f], table[f].slice(1)])
                count[0] += head["n"][0]
            last = len(count) - 1
            pending = [table["s"][last], [table[f][last] for f in _FIELDS], np.uint64(hv[-1]), int(count[last])]
            if last:
                done = {k: (v[:last] if k == "n" else v.slice(0, last)) for k, v in table.items()}
                edge = np.zeros(last, bool)
                edge[0] = number == 0
                yield rows(done, edge)
        if pending is not None:
            yield rows(_single(pending), np.array([True]))

    return run


def _single(pending: list) -> dict:
    out = {f: pa.array([v.as_py()], v.type) for f, v in zip(_FIELDS, pending[1])}
    return out | {"s": pa.array([pending[0].as_py()], pa.string()), "n": np.array([pending[3]])}


def collapse_runs(df: DataFrame, sequence_col: str, time_col: str, id_col: str, hash_col: str, max_bits: int = 6) -> DataFrame:
    """Every run of each sequence, those of one event too: sequence, first_id, last_id, n_events, start, end, duration."""
    slim = df.select(
        F.col(sequence_col).cast("string").alias("s"), F.col(time_col).cast("double").alias("t"), F.col(id_col).cast("long").alias("id"), F.col(hash_col).cast("long").alias("h")
    ).filter(F.col("s").isNotNull() & F.col("id").isNotNull() & F.col("h").isNotNull() & (F.col("h") != 0))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = slim.repartitionByRange(parts, "s", "t", "id", "h").sortWithinPartitions("s", "t", "id", "h")
    schema = (
        "part int, seq bigint, s string, edge boolean, first_id bigint, last_id bigint, first_t double, last_t double, "
        "first_hash bigint, last_hash bigint, n bigint"
    )
    found = materialize(sorted_.mapInArrow(_runs_of_partition(max_bits), schema), "runs")
    inner = found.filter(~F.col("edge"))
    # Fragments of one sequence, in order; a fragment goes on with the one of an earlier partition if it is near enough.
    w = Window.partitionBy("s").orderBy("part", "seq")
    near = (F.lag("part").over(w) < F.col("part")) & (F.bit_count(F.lag("last_hash").over(w).bitwiseXOR(F.col("first_hash"))) <= max_bits)
    pieces = found.filter("edge").withColumn("_new", F.when(near, 0).otherwise(1))
    pieces = pieces.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct("part", "seq")
    stitched = pieces.groupBy("s", "_run").agg(
        F.min_by("first_id", order).alias("first_id"),
        F.max_by("last_id", order).alias("last_id"),
        F.min_by("first_t", order).alias("first_t"),
        F.max_by("last_t", order).alias("last_t"),
        F.sum("n").alias("n"),
    )
    cols = ["s", "first_id", "last_id", "first_t", "last_t", "n"]
    return (
        inner.select(*cols)
        .unionByName(stitched.select(*cols))
        .select(
            F.col("s").alias(sequence_col),
            "first_id",
            "last_id",
            F.col("n").alias("n_events"),
            F.col("first_t").alias("start"),
            F.col("last_t").alias("end"),
            (F.col("last_t") - F.col("first_t")).alias("duration"),
        )
    )
