"""A score cutoff for each source that keeps a target fraction of its records.

Iterative histogram refinement: scores are counted into bins per source, the bin that holds the target
rank is found, and only its rows are counted again, into finer bins between its least and greatest score,
until the bin holds one value.  The first bins depend on the score alone (its logarithm), so the first
round needs no join; each later round splits off at least the least from the greatest score, and the rows
in question shrink by the number of bins.

Defined cases: rows without a source and scores that are null or NaN take no part; infinities do; the
cutoff of a source with n scored records is the score at place ceil(n * numerator / denominator) from the
top (so at least one is kept), and all records that tie with it are kept; rows repeated whole count once.
An empty table gives no sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize, release
from strandline.skew import join_by_weight

BINS = 4096
_BINS_PER_E = 32
_SHIFT = 1_000_000


def _first_bin(x: Column) -> Column:
    """A bin number that never falls as ``x`` grows."""
    size = F.floor(F.log(F.abs(x)) * _BINS_PER_E).cast("long") + _SHIFT
    inf = F.lit(float("inf"))
    return (
        F.when(x == inf, F.lit(4 * _SHIFT))
        .when(x == -inf, F.lit(-4 * _SHIFT))
        .when(x == 0, F.lit(0))
        .when(x > 0, size)
        .otherwise(-size)
        .cast("long")
    )


def _target(counted: DataFrame) -> DataFrame:
    """The bin of each source that holds the wanted rank.  A source has a bounded number of bins."""
    from_top = Window.partitionBy("_src").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counted.withColumn("_upto", F.sum("_n").over(from_top))
        .filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        .withColumn("_above", F.col("_above") + F.col("_upto") - F.col("_n"))
        .withColumn("_rank", F.col("_rank") - (F.col("_upto") - F.col("_n")))
        .drop("_upto")
    )


def scored_rows(df: DataFrame, source_col: str, id_col: str, score_col: str) -> DataFrame:
    """The distinct rows (_src, _id, _x) that take part, written once."""
    x = F.col(score_col).cast("double")
    slim = df.select(F.col(source_col).alias("_src"), F.col(id_col).alias("_id"), x.alias("_x"))
    return materialize(slim.filter(F.col("_src").isNotNull() & F.col("_x").isNotNull() & ~F.isnan("_x")).distinct(), "scored")


def find_cutoffs(scored: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """_src, _n_scored, _cutoff and _n_kept of each source of ``scored_rows``."""
    if not 0 < numerator <= denominator:
        raise ValueError("the target fraction must lie in (0, 1]")
    total = scored.count()
    counted = scored.groupBy("_src", _first_bin(F.col("_x")).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
    )
    whole = Window.partitionBy("_src")
    counted = (
        counted.withColumn("_n_scored", F.sum("_n").over(whole))
        .withColumn("_rank", F.expr(f"(_n_scored * {numerator} + {denominator - 1}) div {denominator}"))
        .withColumn("_above", F.lit(0).cast("long"))
    )
    state = materialize(_target(counted), "cutoff-state")
    closed = [state.filter("_lo = _hi")]
    rows = scored.withColumn("_bin", _first_bin(F.col("_x")))
    while True:
        open_ = state.filter("_lo < _hi")
        if open_.isEmpty():
            break
        near = open_.select(F.struct("_src", "_bin").alias("_key"), "_n", "_lo", "_hi", "_rank", "_above", "_n_scored")
        slim = rows.select(F.struct("_src", "_bin").alias("_key"), "_x")
        inside = join_by_weight(slim, near, "_key", "_n", total)
        share = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        inside = inside.select(
            F.col("_key._src").alias("_src"),
            F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("long").alias("_bin"),
            "_x",
            "_rank",
            "_above",
            "_n_scored",
        )
        before, rows = rows, materialize(inside, "cutoff-rows")
        counted = rows.groupBy("_src", "_bin").agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_x").alias("_lo"),
            F.max("_x").alias("_hi"),
            *[F.max(c).alias(c) for c in ("_n_scored", "_rank", "_above")],
        )
        state = materialize(_target(counted), "cutoff-state")
        closed.append(state.filter("_lo = _hi"))
        release(before)
    out = None
    for part in closed:
        part = part.select("_src", "_n_scored", F.col("_lo").alias("_cutoff"), (F.col("_above") + F.col("_n")).alias("_n_kept"))
        out = part if out is None else out.unionByName(part)
    return out


def keep_fraction(
    df: DataFrame, source_col: str, id_col: str, score_col: str, numerator: int = 1, denominator: int = 4
) -> tuple[DataFrame, DataFrame]:
    """The cutoffs (source, n_scored, cutoff, n_kept) and the kept rows (source, id, score)."""
    scored = scored_rows(df, source_col, id_col, score_col)
    cutoffs = materialize(find_cutoffs(scored, numerator, denominator), "cutoffs")
    joined = join_by_weight(scored, cutoffs, "_src", "_n_scored", scored.count())
    kept = joined.filter(F.col("_x") >= F.col("_cutoff"))
    report = cutoffs.select(
        F.col("_src").alias(source_col), F.col("_n_scored").alias("n_scored"), F.col("_cutoff").alias("cutoff"), F.col("_n_kept").alias("n_kept")
    )
    return report, kept.select(F.col("_src").alias(source_col), F.col("_id").alias(id_col), F.col("_x").alias(score_col))
