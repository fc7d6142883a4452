"""Relational operators: latest states, prefix sums, eviction, matching of lists, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import vectors
from strandline.operators import ranged
from strandline.session import materialize


def latest(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The row of each key that is greatest in ``order`` (nulls least), whole rows breaking further ties.

    ``max`` of a struct is aggregated before the shuffle, so a key with many rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    best = F.max(F.struct(*order, *rest))
    return df.groupBy(*key).agg(best.alias("_b")).select(*[F.col(c) if c in key else F.col(f"_b.{c}").alias(c) for c in df.columns])


def prefix_sum(df: DataFrame, order: tuple[str, ...], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows before this one in ``order``, which must be unique.

    Rows are range-partitioned by ``order``; each part is summed by itself and gets the total of the parts
    before it.  No task sees more than one part, and only one number for each part is joined back.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.coalesce(F.sum(value).over(own), F.lit(0)))
    # One row for each part, as many as there are shuffle partitions.
    return inside.join(F.broadcast(before.select("_part", "_offset")), "_part").withColumn(out, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")


def evict(df: DataFrame, age: str, tie: str, size: str, quota: int, cutoff: Column | None = None, count_all: bool = True) -> DataFrame:
    """Rows to remove, oldest first, until what stays is within ``quota``.

    Only rows older than ``cutoff`` may go.  With ``count_all`` the whole table counts against the quota (a
    quota of 0 removes nothing), else only the rows that may go (a quota of 0 removes them all).
    """
    if count_all and quota <= 0:
        return df.limit(0).withColumn("freed_before", F.lit(0).cast("long"))
    may_go = df if cutoff is None else df.filter(F.col(age) < cutoff)
    total = (df if count_all else may_go).agg(F.coalesce(F.sum(size), F.lit(0)).alias("_sum"))
    summed = prefix_sum(may_go, (age, tie), size, "freed_before")
    return summed.filter(total.scalar() - F.col("freed_before") > quota)


def list_difference(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What is listed but not present (missing), and present but not listed (unexpected)."""
    a = listed.select(key).distinct().withColumn("_a", F.lit(1))
    b = present.select(key).distinct().withColumn("_b", F.lit(1))
    out = a.join(b, key, "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return out.select(key, F.when(F.col("_b").isNull(), "missing").otherwise("unexpected").alias("difference"))


def changed(before: DataFrame, after: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows of ``after`` that are new or have another stamp."""
    old = before.select(key, F.col(stamp).alias("_old"))
    return after.join(old, key, "left").filter(F.col("_old").isNull() | (F.col("_old") != F.col(stamp))).select(key, F.when(F.col("_old").isNull(), "new").otherwise("changed").alias("change"))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in ``order``; null keys go."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.col(order)).alias(order), F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*[F.col(c) if c in (key, order) else F.col(f"_r.{c}").alias(c) for c in df.columns])


def scan_patterns(df: DataFrame, key: str, text: str, patterns: tuple[str, ...]) -> DataFrame:
    """Each line with each pattern it contains: key, line number from 1, pattern.

    The patterns are parameters, so they are part of the expression; nothing is joined.
    """
    lines = df.select(key, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("_at", "_line"))
    hits = F.filter(F.array(*[F.when(F.col("_line").contains(p), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())
    return lines.select(key, (F.col("_at") + 1).alias("line"), F.explode(hits).alias("pattern"))


def label_coverage(df: DataFrame, text: str, labels: tuple[str, ...]) -> DataFrame:
    """How many texts contain each label; labels that never occur have 0."""
    counts = df.agg(*[F.count_if(F.col(text).contains(x)).alias(f"c{k}") for k, x in enumerate(labels)])
    pairs = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"c{k}").alias("n_texts")) for k, x in enumerate(labels)])
    return counts.select(F.inline(pairs))


def status_counts(decided: DataFrame, stream: str, statuses: tuple[str, ...]) -> DataFrame:
    """Rows of each status by stream."""
    return decided.groupBy(stream).agg(F.count(F.lit(1)).alias("considered"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def near_pairs(df: DataFrame, stream: str, hash_col: str, max_bits: int) -> DataFrame:
    """Pairs of distinct hashes of a stream within ``max_bits`` (6 at most), each with its rows.

    Copies of a hash are one representative, so they are never paired with each other.  The join is on two
    equal bytes, of which hashes within 6 bits have at least one choice.
    """
    if max_bits > 6:
        raise ValueError("pairs of equal bytes are complete up to 6 bits only")
    h = df.filter(F.col(stream).isNotNull() & F.col(hash_col).isNotNull()).groupBy(stream, hash_col).agg(F.count(F.lit(1)).alias("n"))
    keyed = h.select(stream, hash_col, "n", F.explode(vectors.pair_keys(F.col(hash_col))).alias("_key"))
    # Of the keys that a pair shares only the first, that of its first two equal bytes, gives the pair.
    upto, own = vectors.pair_masks(F.col("_key"))
    # Written, so that the planner knows its size (the estimate of an explode does not count its rows).
    keyed = materialize(keyed.withColumn("_upto", upto).withColumn("_own", own), "pair-keys")
    a = keyed.select(stream, "_key", "_upto", "_own", F.col(hash_col).alias("hash_a"), F.col("n").alias("n_a"))
    b = keyed.select(stream, "_key", F.col(hash_col).alias("hash_b"), F.col("n").alias("n_b"))
    bits = vectors.hamming(F.col("hash_a"), F.col("hash_b"))
    pairs = a.join(b, [stream, "_key"]).filter((F.col("hash_a") < F.col("hash_b")) & (bits <= max_bits))
    pairs = pairs.filter(vectors.equal_byte_flags(F.col("hash_a"), F.col("hash_b")).bitwiseAND(F.col("_upto")) == F.col("_own"))
    return pairs.select(stream, "hash_a", "hash_b", "n_a", "n_b", bits.alias("bits"))


def unique_names(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """Names made unique in ``order``: the first keeps its name, the others get _01, _02, ... before the suffix."""
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    numbered = ranged.running_sum(df, name, [F.asc(order)], _k=F.lit(1)).withColumn("_k", F.col("_k") - 1)
    return numbered.withColumn(out, F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(stem, F.format_string("_%02d", F.col("_k")), suffix))).drop("_k")


def contained_match(files: DataFrame, name: str, entries: DataFrame, entry: str, max_entries: int = 10_000) -> DataFrame:
    """The first entry, in order, that each name contains; the first of all entries if it contains none.

    Entries are a list of at most ``max_entries``, which becomes part of the expression.
    """
    values = [r[0] for r in entries.select(entry).filter(F.col(entry).isNotNull()).distinct().orderBy(entry).limit(max_entries + 1).collect()]
    if len(values) > max_entries:
        raise ValueError(f"more than {max_entries} entries")
    if not values:
        return files.withColumn("match", F.lit(None).cast("string"))
    listed = F.array(*[F.lit(v) for v in values])
    hits = F.filter(listed, lambda v: F.col(name).contains(v))
    return files.withColumn("match", F.when(F.size(hits) > 0, hits[0]).otherwise(values[0]))
