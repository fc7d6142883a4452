"""Sampling, matching, segmenting and selecting in ordered streams.

Every operator takes the stream, its order (a time and a column that breaks ties) and a parameter object;
rows without a stream take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import vectors
from strandline.operators import ranged
from strandline.operators.fold import ordered_fold
from strandline.session import materialize

EPSILON = 1e-6


@dataclass(frozen=True)
class Quality:
    """Thresholds of the quality filters; None turns one off."""

    min_sharpness: float | None = 100.0
    max_motion_blur: float | None = 0.30
    max_hash_bits: int | None = 6


@dataclass(frozen=True)
class CutRule:
    """Parameters of the cut detector."""

    threshold: float = 0.30
    min_gap: float = 0.5
    flash_ratio: float = 0.55
    flash_brightness: float = 0.18
    confirmations: int = 2
    initial_confirmations: int = 1


def stream_meta(frames: DataFrame, stream: str, ts: str) -> DataFrame:
    """Rows, first and last time, duration and rate of each stream (rate 30 where it has no duration)."""
    out = frames.groupBy(stream).agg(F.count(F.lit(1)).alias("frame_count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    length = F.col("last_ts") - F.col("first_ts")
    return out.withColumn("duration", F.round(length, 6)).withColumn("fps", F.round(F.when(length > 0, F.col("frame_count") / length).otherwise(30.0), 6))


def interval_targets(meta: DataFrame, stream: str, first: Column, end: Column, step_ms: int, limit: int | None = None) -> DataFrame:
    """Grid points from ``first`` below ``end``, a fixed step apart (counted in whole steps, so nothing drifts)."""
    n = F.greatest(F.ceil((end - first) * 1000 / step_ms - EPSILON).cast("int"), F.lit(0))
    n = F.least(n, F.lit(limit)) if limit else n
    grid = meta.select(stream, first.alias("_a"), n.alias("_n")).filter("_n > 0")
    grid = grid.select(stream, "_a", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("k"))
    return grid.select(stream, "k", F.round(F.col("_a") + F.col("k") * step_ms / 1000, 6).alias("target"))


def count_targets(meta: DataFrame, stream: str, first: Column, end: Column, count: int) -> DataFrame:
    """``count`` even points up to a tenth of a second before ``end``; the middle if one is wanted."""
    last = F.greatest(first, end - 0.1)
    if count == 1:
        point = (first + end) / 2
    else:
        point = first + (last - first) * F.col("k") / (count - 1)
    return meta.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")).select(stream, "k", F.round(point, 6).alias("target"))


def short_refill(meta: DataFrame, stream: str, first: Column, end: Column, step_ms: int, limit: int) -> DataFrame:
    """The interval grid, or ``limit`` even points for streams that have fewer ticks."""
    ticks = F.ceil((end - first) * 1000 / step_ms - EPSILON)
    long_ = interval_targets(meta.filter(ticks >= limit), stream, first, end, step_ms, limit)
    return long_.unionByName(count_targets(meta.filter((ticks < limit) & (end > first)), stream, first, end, limit))


def match_targets(targets: DataFrame, frames: DataFrame, stream: str, ts: str, tie: str) -> DataFrame:
    """The first frame at or after each target; targets beyond the last frame get none.

    Targets and frames are sorted together, latest first, and the last frame seen is carried along, so
    there is no join of all pairs, and a long stream spreads over many tasks.
    """
    a = targets.select(stream, F.col("target").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_id"), "k")
    b = frames.select(stream, (F.col(ts) + EPSILON).alias("_t"), F.lit(0).alias("_kind"), F.col(tie).alias("_id"), F.lit(None).cast("int").alias("k"))
    # At equal times a frame serves the target, so it is met before it.
    order = [F.desc("_t"), F.asc("_kind"), F.desc("_id"), F.asc("k")]
    out = ranged.running_last(a.unionByName(b), stream, order, _hit=F.when(F.col("_kind") == 0, F.struct("_id", "_t"))).filter("_kind = 1")
    return out.select(stream, "k", F.col("_t").alias("target"), F.col("_hit._id").alias(tie), F.round(F.col("_hit._t") - EPSILON, 6).alias(ts))


def match_targets_greedy(targets: DataFrame, frames: DataFrame, stream: str, ts: str, tie: str) -> DataFrame:
    """As ``match_targets``, but each frame serves one target only, so dense targets slip to later frames.

    With a_j the place of the first frame at or after target j, target k gets the frame at place
    k + max over j <= k of (a_j - j): two running counts and a running maximum over range parts, so one long stream
    spreads over many tasks.  Targets beyond the last frame get none.
    """
    a = targets.select(stream, F.col("target").alias("_t"), F.lit(0).alias("_kind"), F.col("k").cast("long").alias("_id"), F.col("target").alias("_at"))
    b = frames.select(stream, (F.col(ts) + EPSILON).alias("_t"), F.lit(1).alias("_kind"), F.col(tie).cast("long").alias("_id"), F.col(ts).alias("_at"))
    order = [F.asc("_t"), F.asc("_kind"), F.asc("_id")]
    # At equal times the frame comes behind the target it serves.
    placed = materialize(ranged.successor_places(a.unionByName(b).filter(F.col("_t").isNotNull()), stream, order, F.col("_kind") == 0), "greedy")
    wanted = placed.filter("_kind = 0").select(stream, F.col("_id").cast("int").alias("k"), F.col("_at").alias("target"), "_place")
    served = placed.filter("_kind = 1").select(stream, "_place", F.col("_id").alias(tie), F.col("_at").alias(ts))
    return wanted.join(served, [stream, "_place"]).select(stream, "k", "target", tie, ts)


def nearest(points: DataFrame, choices: DataFrame, stream: str, at: str, choice: str) -> DataFrame:
    """The choice nearest in time to each point (the earlier of two equally near), or the point itself."""
    p = points.select(*points.columns, F.col(at).alias("_t"), F.lit(1).alias("_kind"))
    c = choices.select(stream, F.col(choice).alias("_t")).distinct()
    for name in points.columns:
        if name != stream:
            c = c.withColumn(name, F.lit(None).cast(dict(points.dtypes)[name]))
    c = c.withColumn("_kind", F.lit(0)).select(*p.columns)
    mark = F.when(F.col("_kind") == 0, F.col("_t"))
    both = ranged.running_last(p.unionByName(c), stream, [F.asc("_t"), F.asc("_kind")], _before=mark)
    both = ranged.running_last(both, stream, [F.desc("_t"), F.asc("_kind")], _after=mark)
    pick = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull(), F.col("_before"))
    pick = pick.when(F.col("_t") - F.col("_before") <= F.col("_after") - F.col("_t"), F.col("_before")).otherwise(F.col("_after"))
    return both.filter("_kind = 1").select(*points.columns, F.coalesce(pick, F.col("_t")).alias("nearest"))


def rate_limited(frames: DataFrame, stream: str, ts: str, tie: str, fps: float) -> DataFrame:
    """Keep a row if it comes at least 1 / fps after the last one kept; rows without a time go.

    A row that far behind its predecessor is always kept, as the last one kept is no later than that.  So
    such rows cut a stream into pieces that do not depend on each other, each of which is folded by itself.
    """
    gap = 1.0 / fps

    def step(state: dict, row: tuple) -> list[tuple]:
        name, at, number = row
        if "next" in state and at + EPSILON < state["next"]:
            return []
        state["next"] = at + gap
        return [(name, float(at), int(number))]

    order = [F.asc(ts), F.asc(tie)]
    slim = frames.filter(F.col(stream).isNotNull() & F.col(ts).isNotNull()).select(stream, ts, tie)
    near = ranged.previous(slim, stream, order, _before=F.col(ts))
    reset = F.when(F.col("_before").isNull() | (F.col(ts) + EPSILON >= F.col("_before") + gap), 1).otherwise(0)
    pieces = ranged.running_sum(near, stream, order, _piece=reset).withColumn("_piece", F.concat_ws("\x01", F.col("_piece").cast("string"), F.col(stream).cast("string")))
    kind = dict(frames.dtypes)[stream]
    return ordered_fold(pieces, "_piece", (ts, tie), (stream, ts, tie), dict, step, lambda s: [], f"{stream} {kind}, {ts} double, {tie} bigint").drop("_piece")


def neighbour_change(frames: DataFrame, stream: str, ts: str, tie: str, brightness: str, hash_col: str) -> DataFrame:
    """Change of brightness, hash bits and time against the predecessor in the stream."""
    slim = frames.select(stream, ts, tie, F.col(brightness).alias("_b"), F.col(hash_col).alias("_h"))
    both = ranged.previous(slim, stream, [F.asc(ts), F.asc(tie)], _pb=F.col("_b"), _ph=F.col("_h"), _pt=F.col(ts))
    return both.select(
        stream,
        tie,
        F.round(F.abs(F.col("_b") - F.col("_pb")), 6).alias("brightness_change"),
        vectors.hamming(F.col("_h"), F.col("_ph")).alias("bits_changed"),
        F.round(F.col(ts) - F.col("_pt"), 6).alias("gap"),
    )


def quality_status(sharpness: Column, motion: Column, rule: Quality) -> Column:
    """blurry, motion_blur or ok; the first filter that hits wins, and nulls pass."""
    out = F.lit("ok")
    if rule.max_motion_blur is not None:
        out = F.when(motion > rule.max_motion_blur, "motion_blur").otherwise(out)
    if rule.min_sharpness is not None:
        out = F.when((sharpness < rule.min_sharpness) & ~F.isnan(sharpness), "blurry").otherwise(out)
    return out


def _pair_tokens(h: int) -> list[int]:
    b = [(h >> (8 * i)) & 255 for i in range(8)]
    return [((i * 8 + j) << 16) + b[i] * 256 + b[j] for i in range(8) for j in range(i + 1, 8)]


def accept(frames: DataFrame, stream: str, ts: str, tie: str, hash_col: str, status_col: str, max_bits: int | None, everywhere: bool, carry: dict[str, str] | None = None) -> DataFrame:
    """The final status of each row: rejected before, duplicate, or saved.  ``carry`` (double columns and new names) goes along.

    A row whose quality is ok is a duplicate if its hash lies within ``max_bits`` of the last saved one, or,
    with ``everywhere``, of any saved one of the stream.  Rows without a hash are saved and compared with nothing.
    """

    def step(state: dict, row: tuple) -> list[tuple]:
        number, h, status = row
        if status != "ok" or max_bits is None:
            return [(int(number), "saved" if status == "ok" else status)]
        if h is None:
            return [(int(number), "saved")]
        h &= 0xFFFFFFFFFFFFFFFF
        last = state.get("last")
        if last is not None and (h ^ last).bit_count() <= max_bits:
            return [(int(number), "duplicate")]
        if everywhere:
            index = state.setdefault("index", {})
            if max_bits <= 6:
                tokens = _pair_tokens(h)
                near = any((h ^ o).bit_count() <= max_bits for t in tokens for o in index.get(t, ()))
            else:
                tokens = [0]
                near = any((h ^ o).bit_count() <= max_bits for o in index.get(0, ()))
            if near:
                return [(int(number), "duplicate_global")]
            for t in tokens:
                index.setdefault(t, []).append(h)
        state["last"] = h
        return [(int(number), "saved")]

    text = frames.withColumn("_h", F.col(hash_col).cast("string"))

    carry = carry or {}

    def parse(state: dict, row: tuple) -> list[tuple]:
        return [(*x, *row[3:]) for x in step(state, (row[0], None if row[1] is None else int(row[1]), row[2]))]

    kept = text.withColumns({f"_c_{n}": F.col(c).cast("double") for c, n in carry.items()})
    out = ordered_fold(
        kept, stream, (ts, tie), (tie, "_h", status_col, *[f"_c_{n}" for n in carry.values()]), dict, parse, lambda s: [], f"{tie} bigint, status string" + "".join(f", {n} double" for n in carry.values())
    )
    return out


def _better(best: tuple | None, x: tuple, rule: Quality, choose_best: bool) -> tuple:
    """An acceptable row beats one that is not, then greater sharpness wins if asked for; ties keep the earlier."""
    if best is None:
        return x
    if rule.max_motion_blur is not None:
        ok_best, ok_x = best[4] <= rule.max_motion_blur, x[4] <= rule.max_motion_blur
        if ok_best != ok_x:
            return x if ok_x else best
    return x if choose_best and x[3] > best[3] else best


def detect_cuts(
    frames: DataFrame, stream: str, ts: str, tie: str, level: str, sharpness: str, motion: str, rule: CutRule, quality: Quality, choose_best: bool = True
) -> DataFrame:
    """Segments of each stream with their best row: segment, cut time (null for the first), best row and its time.

    A cut opens where the level changes by the threshold or more against the predecessor, far enough from the
    last cut.  It is dropped as a flash if a following row is back near the level before it, and stands once
    enough following rows confirm it.  While it waits the predecessor stays as it was.
    """

    def start() -> dict:
        return {"best": None, "pending": None, "prev": None, "last_cut": None, "segment": 0, "cut": None}

    def close(s: dict) -> list[tuple]:
        best = s["best"]
        return [(s["segment"], s["cut"], int(best[1]), float(best[0]))] if best is not None else []

    def commit(s: dict) -> list[tuple]:
        out = close(s)
        candidate = s["pending"]["row"]
        s["segment"] += 1
        s["cut"] = s["last_cut"] = float(candidate[0])
        s["best"], s["pending"] = candidate, None
        return out

    def step(s: dict, x: tuple) -> list[tuple]:
        at, _, value = x[0], x[1], x[2]
        out: list[tuple] = []
        if s["best"] is None:
            s["best"] = x
            if s["last_cut"] is None:
                s["last_cut"] = float(at) - rule.min_gap
        elif s["pending"] is not None:
            back = abs(value - s["pending"]["before"])
            if back <= rule.threshold * rule.flash_ratio and back <= rule.flash_brightness:
                s["pending"] = None
                s["best"] = _better(s["best"], x, quality, choose_best)
            else:
                s["pending"]["n"] += 1
                if s["pending"]["n"] < rule.confirmations:
                    return []
                out = commit(s)
                s["best"] = _better(s["best"], x, quality, choose_best)
        else:
            change = abs(value - s["prev"])
            if change >= rule.threshold and at - s["last_cut"] >= rule.min_gap:
                s["pending"] = {"row": x, "before": s["prev"], "n": rule.initial_confirmations}
            else:
                s["best"] = _better(s["best"], x, quality, choose_best)
        s["prev"] = value
        return out

    def finish(s: dict) -> list[tuple]:
        out: list[tuple] = []
        if s["pending"] is not None:
            if s["pending"]["n"] >= rule.confirmations:
                out = commit(s)
            else:
                s["best"] = _better(s["best"], s["pending"]["row"], quality, choose_best)
        return out + close(s)

    usable = frames.filter(F.col(level).isNotNull() & F.col(ts).isNotNull())
    slim = usable.withColumn(sharpness, F.coalesce(F.nanvl(F.col(sharpness), F.lit(0.0)), F.lit(0.0))).withColumn(motion, F.coalesce(F.col(motion), F.lit(0.0)))
    return ordered_fold(slim, stream, (ts, tie), (ts, tie, level, sharpness, motion), start, step, finish, f"segment int, cut double, best_{tie} bigint, best_{ts} double")


def segment_ids(frames: DataFrame, cuts: DataFrame, stream: str, ts: str, tie: str) -> DataFrame:
    """The segment of each row: the number of cuts up to its time."""
    a = frames.select(stream, F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.col(tie))
    b = cuts.filter(F.col("cut").isNotNull()).select(stream, F.col("cut").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias(tie))
    both = ranged.running_sum(a.unionByName(b), stream, [F.asc("_t"), F.asc("_kind"), F.asc(tie)], segment=1 - F.col("_kind"))
    return both.filter("_kind = 1").select(stream, tie, F.col("segment").cast("int").alias("segment"))


def mark_existing(decided: DataFrame, stream: str, ts: str, tie: str, label: Column, outputs: DataFrame) -> DataFrame:
    """Saved rows whose output is there already become ``existing``.

    ``outputs`` lists stream and label of earlier outputs; within the run the first row of a label makes the output.  A row
    that exists counts as the last accepted one all the same, so the decisions on duplicates stay as they are.
    """
    there = outputs.select(stream, F.col("label").alias("_label")).distinct().withColumn("_there", F.lit(True))
    named = decided.withColumn("_label", F.when(F.col("status") == "saved", label))
    first = Window.partitionBy(stream, "_label").orderBy(ts, tie)
    marked = named.join(there, [stream, "_label"], "left").withColumn("_k", F.when(F.col("_label").isNotNull(), F.row_number().over(first)))
    status = F.when((F.col("status") == "saved") & (F.col("_there") | (F.col("_k") > 1)), "existing").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("_label", "_there", "_k")


#: Order in which rejected rows fill up a quota.
FILL_ORDER = ("duplicate_global", "duplicate", "motion_blur", "blurry", "not_selected")


def force_fill(decided: DataFrame, stream: str, ts: str, tie: str, sharpness: str, quota: int) -> DataFrame:
    """The least bad rejected rows that fill each stream up to ``quota`` saved ones.

    Reasons rank as in ``FILL_ORDER``, then sharpness descends and time ascends; of rows within a
    millisecond only the first counts.  Each partition keeps at most ``quota`` rows of a stream before the shuffle.
    """
    rank = F.lit(len(FILL_ORDER))
    for k, reason in reversed(list(enumerate(FILL_ORDER))):
        rank = F.when(F.col("status") == reason, k).otherwise(rank)
    order = [rank, F.desc(F.nanvl(F.coalesce(F.col(sharpness), F.lit(0.0)), F.lit(0.0))), F.col(ts), F.col(tie)]
    saved = decided.groupBy(stream).agg(F.count_if(F.col("status") == "saved").alias("saved"))
    rejected = decided.filter("status <> 'saved'").withColumn("_ms", F.round(ts, 3))
    first = rejected.withColumn("_one", F.row_number().over(Window.partitionBy(stream, "_ms").orderBy(*order))).filter("_one = 1")
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(stream).orderBy(*order))).filter(F.col("place") <= quota)
    return ranked.join(saved, stream).filter(F.col("place") <= quota - F.col("saved")).select(stream, "place", tie, F.col("status").alias("reason"))
