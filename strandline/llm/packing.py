"""Filling containers of fixed capacity by bulk-synchronous best fit.

Documents larger than a container are cut into full pieces and a rest.  Pieces are range-sorted by size:
with integer sizes that is a count of pieces for each size, at most ``capacity`` numbers.  Each step takes
all pieces of the largest size not yet placed, sweeps the gaps upward from that size (the successor of the
size comes first), lets each gap take as many pieces as it holds, resolves conflicts by rank (the piece of
rank r of its size goes to the r-th place offered), updates the gaps and repeats.  What is left over opens
new containers.  Gaps of the same history are one cohort with a count, so the sweep works on cohorts, and
its result is a list of rank intervals; the corpus itself is only ranked (in range parts, never in one task) and
looks its container up by size and rank.  The outcome equals best fit decreasing over single pieces.

The pieces are sorted and ranked by the cluster; the sweep over the counts of sizes and gaps runs on the driver, because
each step depends on the gaps that the one before left.  (Rounds that place as many single pieces as there are gaps at once
need about a quarter more containers, see the README.)

Defined cases: sizes that are null or below 1 are not placed; a piece is never split unless its document
exceeds the capacity; ranks follow the id, so container numbers do not depend on partitioning; an
empty table gives no rows.  Ids must be unique.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize, release

#: The plan keeps one number for each size up to the capacity on the driver.
MAX_CAPACITY = 1 << 20
_PART_ROWS = 1_000_000


@dataclass
class Plan:
    """Rank intervals of the sizes, and the fill of the containers.

    Pieces of ``size[i]`` with rank in [rank[i], rank[i + 1]) go to container ``first[i] + (rank - rank[i]) // per[i]``.
    """

    size: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    per: np.ndarray
    container: np.ndarray  # starts of container ranges of equal fill
    fill: np.ndarray
    n_containers: int

    def locate(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Container and its fill of each piece."""
        order = np.lexsort((rank, size))
        key_s, key_r = size[order], rank[order]
        # Both lists are sorted by size and rank: count the intervals that start at or before each piece.
        merged = np.lexsort((np.concatenate([np.zeros(len(self.size)), np.ones(len(order))]), np.concatenate([self.rank, key_r]), np.concatenate([self.size, key_s])))
        seen = np.cumsum(merged < len(self.size))
        at = np.empty(len(order), np.int64)
        mine = merged >= len(self.size)
        at[order[merged[mine] - len(self.size)]] = seen[mine] - 1
        where = self.first[at] + (rank - self.rank[at]) // self.per[at]
        return where, self.fill[np.searchsorted(self.container, where, side="right") - 1]


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing for ``counts`` (size: number of pieces)."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: ranges (first container, number)
    open_gaps: list[int] = []  # sorted
    done: list[tuple[int, int, int]] = []  # first, number, gap at the end
    intervals: list[tuple[int, int, int, int]] = []
    n = 0

    def put(gap: int, first: int, number: int) -> None:
        if number and gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, number))
        elif number:
            done.append((first, number, 0))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            k = bisect.bisect_left(open_gaps, size)
            if k == len(open_gaps):
                gap, first, number = capacity, n, -(-left // (capacity // size))
                n += number
            else:
                gap = open_gaps[k]
                first, number = gaps[gap].pop(0)
                if not gaps[gap]:
                    del gaps[gap], open_gaps[k]
            per = gap // size
            full = min(number, left // per)
            if full:
                intervals.append((size, rank, first, per))
                put(gap - per * size, first, full)
                rank, left, first, number = rank + full * per, left - full * per, first + full, number - full
            if left and number:  # fewer pieces than one more container holds
                intervals.append((size, rank, first, left))
                put(gap - left * size, first, 1)
                first, number, left = first + 1, number - 1, 0
            put(gap, first, number)
    for gap, ranges in gaps.items():
        done += [(first, number, gap) for first, number in ranges]
    done.sort()
    table = np.array(sorted(intervals) or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    ends = np.array(done or np.zeros((0, 3)), np.int64).reshape(-1, 3)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], ends[:, 0], capacity - ends[:, 2], n)


def split_into_pieces(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """_id, piece, start and size of the pieces: full ones, then the rest."""
    n = F.col(size_col).cast("long")
    pieces = F.sequence(F.lit(0).cast("long"), F.expr(f"(_n + {capacity - 1}) div {capacity}") - 1)
    return (
        sizes.select(F.col(id_col).alias("_id"), n.alias("_n"))
        .filter(F.col("_id").isNotNull() & (F.col("_n") > 0))
        .select("_id", "_n", F.explode(pieces).alias("piece"))
        .select("_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).alias("size"))
    )


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """id, piece, start, size, container and container_fill of every piece of ``sizes``."""
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must lie between 1 and {MAX_CAPACITY}")
    if id_col in ("piece", "start", "size", "container", "container_fill"):
        raise ValueError("id_col has the name of a result column")
    pieces = materialize(split_into_pieces(sizes, id_col, size_col, capacity), "pieces")
    # Rank within a size: the pieces of the size in the parts before, then the place within the part.
    order = [F.asc("size"), F.asc("_id"), F.asc("piece")]
    parts = 1 + pieces.count() // _PART_ROWS
    placed = materialize(pieces.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "parts")
    release(pieces)
    # A row for each size of each part: parts follow one another in size, so there are fewer than sizes and parts together.
    held = placed.groupBy("size", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = materialize(held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "held")
    counts = {r["size"]: r["n"] for r in held.groupBy("size").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    # A few intervals for each size.
    shared = sizes.sparkSession.sparkContext.broadcast(plan_packing(counts, capacity))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    # In a part the rows of smaller sizes come first.
    smaller = Window.partitionBy("_part").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_offset", F.col("_before") - F.coalesce(F.sum("_n").over(smaller), F.lit(0)))
    ranked = placed.withColumn("_place", place).join(held.select("size", "_part", "_offset"), ["size", "_part"]).select("_id", "piece", "start", "size", (F.col("_offset") + F.col("_place")).alias("_rank"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            if len(batch):
                where, fill = plan.locate(batch.column(3).to_numpy(), batch.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array(where, pa.int64()), pa.array(fill, pa.int64())],
                    names=[id_col, "piece", "start", "size", "container", "container_fill"],
                )

    kind = ranked.schema["_id"].dataType.simpleString()
    return ranked.mapInArrow(look_up, f"`{id_col}` {kind}, piece bigint, start bigint, size bigint, container bigint, container_fill bigint")
