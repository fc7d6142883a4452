"""Running values over ordered streams, balanced whatever the length of a stream.

Rows are range-partitioned by stream and order, so a stream with most of the rows spreads over many parts.
Each part is worked on by itself; what the next part needs of it is one row, the value at its end.  Those
rows, one for each part, are combined and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize


def _placed(df: DataFrame, stream: str, order: list[Column]) -> DataFrame:
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = df.repartitionByRange(parts, F.col(stream), *order).withColumn("_part", F.spark_partition_id())
    return materialize(placed, "ranged")


def _running(df: DataFrame, stream: str, order: list[Column], inside, across: str, values: dict[str, Column]) -> DataFrame:
    """Add ``values`` to ``df``; ``inside`` makes the running value of a part, ``across`` says how parts combine."""
    placed = _placed(df.withColumns({f"_v_{n}": c for n, c in values.items()}), stream, order)
    in_part = Window.partitionBy("_part").orderBy(F.col(stream), *order)
    in_stream = Window.partitionBy("_part", stream).orderBy(*order)
    names = list(values)
    local = placed.withColumn("_pos", F.row_number().over(in_part)).withColumns({f"_in_{n}": inside(F.col(f"_v_{n}"), in_stream) for n in names})
    # The value that a stream has when a part ends is that of the part's last row.
    end = [F.col(f"_v_{n}" if across == "lag" else f"_in_{n}").alias(f"_end_{n}") for n in names]
    edges = local.groupBy("_part").agg(F.max_by(F.struct(F.col(stream).alias("_s"), *end), "_pos").alias("_e")).select("_part", "_e.*")
    edges = materialize(edges, "edges")  # one row for each part
    so_far = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    if across == "last":
        edges = edges.withColumns({f"_end_{n}": F.last(f"_end_{n}", True).over(so_far) for n in names})
    elif across == "sum":
        edges = edges.withColumns({f"_end_{n}": F.sum(f"_end_{n}").over(so_far) for n in names})
    following = F.lead("_part").over(Window.orderBy("_part"))
    carried = edges.withColumn("_next", following).filter("_next IS NOT NULL").select(F.col("_next").alias("_part"), "_s", *[f"_end_{n}" for n in names])
    joined = local.join(F.broadcast(carried), "_part", "left")
    same = F.col("_s") == F.col(stream)
    out = {}
    for n in names:
        before = F.when(same, F.col(f"_end_{n}"))
        if across == "sum":
            out[n] = F.col(f"_in_{n}") + F.coalesce(before, F.lit(0))
        elif across == "last":
            out[n] = F.coalesce(F.col(f"_in_{n}"), before)
        else:
            out[n] = F.when(F.col("_first"), before).otherwise(F.col(f"_in_{n}"))
    if across == "lag":
        joined = joined.withColumn("_first", F.row_number().over(in_stream) == 1)
    joined = joined.withColumns(out)
    return joined.select(*df.columns, *names)


def running_last(df: DataFrame, stream: str, order: list[Column], **values: Column) -> DataFrame:
    """The last value so far that is not null, this row's included."""
    return _running(df, stream, order, lambda v, w: F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "last", values)


def running_sum(df: DataFrame, stream: str, order: list[Column], **values: Column) -> DataFrame:
    """The sum so far, this row's value included."""
    return _running(df, stream, order, lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)), "sum", values)


def successor_places(df: DataFrame, stream: str, order: list[Column], wants: Column) -> DataFrame:
    """Adds ``_place``: for a row that wants, the place (from 0) of the row it is served by; for any other, its own place.

    In ``order``, the k-th row that wants is served by the first other row behind it that serves no earlier one: with a_j the
    others before the j-th row that wants, that is the place k + max over j <= k of (a_j - j).  All in one pass over the range parts.
    """
    placed = _placed(df.withColumn("_w", wants.cast("int")), stream, order)
    in_part = Window.partitionBy("_part").orderBy(F.col(stream), *order)
    upto = Window.partitionBy("_part", stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_pos", F.row_number().over(in_part)).withColumn("_g", F.sum(1 - F.col("_w")).over(upto)).withColumn("_d", F.sum("_w").over(upto))
    local = local.withColumn("_m", F.max(F.when(F.col("_w") == 1, F.col("_g") - F.col("_d") + 1)).over(upto))
    edges = local.groupBy("_part").agg(F.max_by(F.struct(F.col(stream).alias("_s"), "_g", "_d", "_m"), "_pos").alias("_e")).select("_part", "_e.*")
    so_far = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("_g1", F.sum("_g").over(so_far)).withColumn("_d1", F.sum("_d").over(so_far))
    # The lead of a part counts from what came before it.
    edges = edges.withColumn("_m1", F.max(F.col("_m") + F.col("_g1") - F.col("_g") - F.col("_d1") + F.col("_d")).over(so_far))
    edges = edges.withColumn("_next", F.lead("_part").over(Window.orderBy("_part"))).filter("_next IS NOT NULL")
    edges = materialize(edges.select(F.col("_next").alias("_part"), "_s", "_g1", "_d1", "_m1"), "edges")  # one row for each part
    joined = local.join(F.broadcast(edges), "_part", "left")
    same = F.col("_s") == F.col(stream)
    g0, d0 = F.when(same, F.col("_g1")), F.when(same, F.col("_d1"))
    g0, d0 = F.coalesce(g0, F.lit(0)), F.coalesce(d0, F.lit(0))
    wanted = d0 + F.col("_d") - 1 + F.greatest(F.col("_m") + g0 - d0, F.when(same, F.col("_m1")))
    return joined.select(*df.columns, F.when(F.col("_w") == 1, wanted).otherwise(g0 + F.col("_g") - 1).alias("_place"))


def previous(df: DataFrame, stream: str, order: list[Column], **values: Column) -> DataFrame:
    """The value of the row before, null for the first of a stream.  ``order`` should leave no ties."""
    return _running(df, stream, order, lambda v, w: F.lag(v).over(w), "lag", values)
