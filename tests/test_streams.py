import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import relational, streams
from strandline.operators.streams import CutRule, Quality

SCHEMA = "s string, t double, id bigint, level double, sharpness double, motion double, h bigint"


def frames(spark, levels, s="a"):
    return spark.createDataFrame([(s, float(k), k, v, 1.0 + k, 0.0, None) for k, v in enumerate(levels)], SCHEMA)


def cuts(spark, levels, **rule):
    got = streams.detect_cuts(frames(spark, levels), "s", "t", "id", "level", "sharpness", "motion", CutRule(threshold=0.3, **rule), Quality(None, 0.3, None))
    return [(r["segment"], r["cut"], r["best_id"]) for r in got.orderBy("segment").collect()]


@pytest.mark.parametrize(
    "levels, expected",
    [
        ([0.1, 0.1, 0.1], [(0, None, 2)]),
        ([0.1, 0.1, 0.9, 0.9, 0.9], [(0, None, 1), (1, 2.0, 4)]),
        ([0.1, 0.1, 0.9, 0.1, 0.1], [(0, None, 4)]),  # a flash
        ([0.1, 0.1, 0.9], [(0, None, 2)]),  # still waiting at the end
    ],
)
def test_cut_script(spark, levels, expected):
    assert cuts(spark, levels) == expected


def test_confirmations_and_gap(spark):
    levels = [0.1, 0.9, 0.9, 0.1, 0.1]
    assert len(cuts(spark, levels)) == 3
    assert len(cuts(spark, levels, min_gap=100.0)) == 2
    assert len(cuts(spark, levels, initial_confirmations=0)) == 1  # the level is back before the cut is sure


@pytest.mark.parametrize("bits, status", [(6, "duplicate"), (7, "saved"), (8, "saved")])
def test_hash_boundary(spark, bits, status):
    far = ((1 << bits) - 1) ^ -(1 << 63)
    rows = [("a", 0.0, 1, -(1 << 63), "ok"), ("a", 1.0, 2, far, "ok")]
    df = spark.createDataFrame(rows, "s string, t double, id bigint, h bigint, q string")
    got = {r["id"]: r["status"] for r in streams.accept(df, "s", "t", "id", "h", "q", 6, False).collect()}
    assert got == {1: "saved", 2: status}


def test_global_dedup_against_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for k in range(400):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 8)):
            h ^= 1 << rng.randrange(64)
        rows.append(("ab"[k % 2], float(k // 3), k, None if k % 29 == 0 else h - (1 << 64) if h >> 63 else h, "ok" if k % 7 else "blurry"))
    df = spark.createDataFrame(rows, "s string, t double, id bigint, h bigint, q string")
    expected = {}
    for s in "ab":
        last, seen = None, []
        for _, _, k, h, q in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])):
            if q != "ok" or h is None:
                expected[k] = "saved" if q == "ok" else q
                continue
            u = h & (2**64 - 1)
            if last is not None and (u ^ last).bit_count() <= 6:
                expected[k] = "duplicate"
            elif any((u ^ o).bit_count() <= 6 for o in seen):
                expected[k] = "duplicate_global"
            else:
                expected[k] = "saved"
                last = u
                seen.append(u)
    got = {r["id"]: r["status"] for r in streams.accept(df, "s", "t", "id", "h", "q", 6, True).collect()}
    assert got == expected


def test_force_fill(spark):
    rows = [("a", k / 10, k, "blurry" if k % 2 else "motion_blur", float(k)) for k in range(10)] + [("a", 0.1001, 11, "blurry", 99.0)]
    df = spark.createDataFrame(rows, "s string, t double, id bigint, status string, sharpness double")
    got = [r["id"] for r in streams.force_fill(df, "s", "t", "id", "sharpness", 10).orderBy("place").collect()]
    assert got == [8, 6, 4, 2, 0, 11, 9, 7, 5, 3]


def test_targets(spark):
    m = spark.createDataFrame([("a", 0.0, 1.0), ("b", 3.0, 3.0)], "s string, lo double, hi double")
    assert streams.interval_targets(m, "s", F.col("lo"), F.col("hi"), 100).count() == 10
    assert [r["target"] for r in streams.count_targets(m.limit(1), "s", F.col("lo"), F.col("hi"), 1).collect()] == [0.5]
    assert streams.short_refill(m, "s", F.col("lo"), F.col("hi"), 500, 4).count() == 4


def test_nearest_falls_back(spark):
    p = spark.createDataFrame([("a", 1.0), ("a", 4.8), ("b", 2.0)], "s string, at double")
    c = spark.createDataFrame([("a", 1.2), ("a", 4.8), ("a", 0.8)], "s string, choice double")
    got = {(r["s"], r["at"]): r["nearest"] for r in streams.nearest(p, c, "s", "at", "choice").collect()}
    assert got == {("a", 1.0): 0.8, ("a", 4.8): 4.8, ("b", 2.0): 2.0}


def test_prefix_sum_and_eviction(spark):
    df = spark.createDataFrame([(k, float(k % 5), 1 + k % 3) for k in range(200)], "id bigint, age double, size bigint")
    rows = sorted(df.collect(), key=lambda r: (r["age"], r["id"]))
    running, expected = 0, {}
    for r in rows:
        expected[r["id"]] = running
        running += r["size"]
    assert {r["id"]: r["before"] for r in relational.prefix_sum(df, ("age", "id"), "size", "before").collect()} == expected
    gone = {r["id"] for r in relational.evict(df, "age", "id", "size", 100).collect()}
    assert gone == {k for k, b in expected.items() if running - b > 100}
    assert relational.evict(df, "age", "id", "size", 0).count() == 0
    assert relational.evict(df, "age", "id", "size", 0, F.lit(2.0), count_all=False).count() == 80
    two = spark.createDataFrame([(1, 1.0, 8), (2, 2.0, 8)], "id bigint, age double, size bigint")
    assert [r["id"] for r in relational.evict(two, "age", "id", "size", 8).collect()] == [1]


def test_lists(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert sorted(map(tuple, relational.list_difference(a, b, "k").collect())) == [("x", "missing"), ("z", "unexpected")]
    texts = spark.createDataFrame([(1, "a\r\nb a\nc"), (2, None)], "id bigint, text string")
    assert sorted(map(tuple, relational.scan_patterns(texts, "id", "text", ("a", "c")).collect())) == [(1, 1, "a"), (1, 2, "a"), (1, 3, "c")]
    with pytest.raises(ValueError):
        relational.near_pairs(a, "k", "k", 7)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert streams.rate_limited(empty, "s", "t", "id", 1.0).count() == 0
    assert streams.detect_cuts(empty, "s", "t", "id", "level", "sharpness", "motion", CutRule(), Quality()).count() == 0
    assert streams.stream_meta(empty, "s", "t").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_running_values_over_parts(spark, seed):
    from strandline.operators import ranged

    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 8 + list("abc")), k, rng.choice([None, rng.randint(0, 9)])) for k in range(400)]
    df = spark.createDataFrame(rows, "s string, k int, v int").repartition(5)
    up, down = {}, {}
    for s in {r[0] for r in rows}:
        last, total, before = None, 0, None
        for _, k, v in sorted(r for r in rows if r[0] == s):
            last, total = v if v is not None else last, total + (v or 0)
            up[k] = (last, total, before)
            before = v
        last = None
        for _, k, v in sorted((r for r in rows if r[0] == s), key=lambda r: -r[1]):
            last = v if v is not None else last
            down[k] = last
    order = [F.asc("k")]
    x = {r["k"]: r for r in ranged.running_last(df, "s", order, x=F.col("v")).collect()}
    y = {r["k"]: r for r in ranged.running_sum(df, "s", order, x=F.coalesce("v", F.lit(0))).collect()}
    z = {r["k"]: r for r in ranged.previous(df, "s", order, x=F.col("v")).collect()}
    assert {k: (x[k]["x"], y[k]["x"], z[k]["x"]) for k in x} == up
    assert {r["k"]: r["x"] for r in ranged.running_last(df, "s", [F.desc("k")], x=F.col("v")).collect()} == down
    assert ranged.previous(df.limit(0), "s", order, x=F.col("v")).count() == 0


@pytest.mark.parametrize("parts", ["1", "5", "23"])
def test_greedy_match_over_parts(spark, parts):
    """One hot stream and small ones, dense and sparse targets, over any number of range parts."""
    import random

    rng = random.Random(int(parts))
    frames = [(rng.choice(["hot"] * 6 + ["a", "b"]), round(rng.uniform(0, 40), 2), k) for k in range(400)]
    targets = [(v, k, float(t)) for v in ("hot", "a", "b", "none") for k, t in enumerate(sorted(rng.uniform(0, 45) for _ in range(120)))]
    expected = set()
    for v in ("hot", "a", "b"):
        mine, at = sorted((t, i) for s, t, i in frames if s == v), 0
        for _, k, t in sorted(x for x in targets if x[0] == v):
            while at < len(mine) and mine[at][0] + 1e-6 < t:
                at += 1
            if at < len(mine):
                expected.add((v, k, mine[at][1]))
                at += 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = streams.match_targets_greedy(
            spark.createDataFrame(targets, "v string, k int, target double"), spark.createDataFrame(frames, "v string, ts double, frame_id bigint"), "v", "ts", "frame_id"
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r["v"], r["k"], r["frame_id"]) for r in got} == expected and len(got) == len(expected)
