"""States of queue items: legal transitions and their side effects, plans for resuming, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import ranged

# The states that may follow each state.
TRANSITIONS = {
    "queued": ("running", "retrying", "cancelled", "interrupted", "failed"),
    "running": ("retrying", "completed", "failed", "cancelled", "interrupted"),
    "retrying": ("running", "failed", "cancelled", "interrupted"),
    "interrupted": ("queued", "running", "cancelled"),
    "failed": ("queued", "running", "cancelled"),
    "cancelled": ("queued", "running"),
    "completed": ("queued", "running"),
}
TERMINAL = ("completed", "failed", "cancelled")
ERROR_LENGTH = 4000


def is_legal(before: Column, after: Column) -> Column:
    """Whether a state may follow another; a first state and a state that stays are legal."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return before.isNull() | (before == after) | F.coalesce(F.array_contains(F.try_element_at(table, before), after), F.lit(False))


def replay(log: DataFrame, item: str, order: list[Column], status: str, at: str, progress: str, error: str) -> DataFrame:
    """Each entry of a log of states with the state before it, whether that is legal, and the side effects.

    Progress is held between 0 and 1 and is 1 once completed; completion clears the error, and an error is cut at
    ``ERROR_LENGTH`` characters; a terminal state sets the end, any other clears it.
    """
    known = log.filter(F.col(item).isNotNull() & F.col(status).isNotNull())
    out = ranged.previous(known, item, order, before=F.col(status))
    done = F.col(status) == "completed"
    return out.select(
        item,
        at,
        "before",
        F.col(status).alias("after"),
        is_legal(F.col("before"), F.col(status)).alias("legal"),
        F.when(done, 1.0).otherwise(F.least(F.greatest(F.coalesce(F.col(progress), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).alias("progress"),
        F.when(~done, F.substring(F.col(error), 1, ERROR_LENGTH)).alias("error"),
        F.when(F.col(status).isin(*TERMINAL), F.col(at)).alias("ended"),
    )


def resume_plan(work: DataFrame, completed: DataFrame, key: list[str]) -> DataFrame:
    """``work`` with the action for each row: its result is reused if ``key`` is among ``completed``, else it is processed.

    Rows with a null in ``key`` are processed.
    """
    done = completed.select(*key).dropna().distinct().withColumn("_done", F.lit(True))
    return work.join(done, key, "left").withColumn("action", F.when(F.col("_done"), "reuse").otherwise("process")).drop("_done")


def telemetry(df: DataFrame, message: str, started: str, now: str) -> DataFrame:
    """Adds done, total, fps and eta (seconds) from messages such as ``3/10 frame``; too short a time gives none."""
    units = scalars.progress_units(F.col(message))
    elapsed = F.greatest(F.lit(0.0), F.when(F.col(started) != 0, F.col(now) - F.col(started)).otherwise(0.0))
    out = df.withColumn("done", F.coalesce(units["done"], F.lit(0))).withColumn("total", F.coalesce(units["total"], F.lit(0)))
    fps = F.when((F.col("done") > 0) & (elapsed > 0.2), F.col("done") / elapsed)
    return out.withColumn("fps", fps).withColumn("eta", F.when(F.col("total") > F.col("done"), (F.col("total") - F.col("done")) / fps))


def time_range(df: DataFrame, start: Column, end: Column, duration: Column) -> DataFrame:
    """Adds range_start and range_end held within the duration (an open end is the duration), and whether anything is left."""
    first, last = F.least(start, duration), F.coalesce(F.least(end, duration), duration)
    return df.withColumn("range_start", first).withColumn("range_end", last).withColumn("usable", F.col("range_end") > F.col("range_start"))


def top_per_source(df: DataFrame, query: str, source: str, url: str, order: str, limits: dict[str, int]) -> DataFrame:
    """The first rows of each query and source, as many as the source allows; only the first row of a url counts."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), F.col(source)), F.lit(0))
    keep = [c for c in df.columns if c not in (query, source, url, order)]
    first = df.filter(F.col(url).isNotNull()).groupBy(query, source, url).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in keep])
    place = F.row_number().over(Window.partitionBy(query, source).orderBy(order, url))
    # The literal bound lets every partition drop rows before the shuffle.
    return first.withColumn("place", place).filter(F.col("place") <= max(limits.values())).filter(F.col("place") <= limit)


def bucket_faults(hashes: DataFrame, buckets: DataFrame, key: str, hash_col: str) -> DataFrame:
    """For each key the hashes missing from the buckets and those in buckets only; a key with either must be rebuilt."""
    a = hashes.select(key, hash_col).dropna().distinct().withColumn("_a", F.lit(1))
    b = buckets.select(key, hash_col).dropna().distinct().withColumn("_b", F.lit(1))
    both = a.join(b, [key, hash_col], "full_outer")
    out = both.groupBy(key).agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("stray"))
    return out.withColumn("rebuild", (F.col("missing") > 0) | (F.col("stray") > 0))
