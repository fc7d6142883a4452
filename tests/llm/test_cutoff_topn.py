import math
import random
from collections import defaultdict

import pytest

from strandline.llm import cutoff, topn

INF, NAN = float("inf"), float("nan")
SCHEMA = "v string, id bigint, x double, t double, _src string, g int, _x double"


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "clash", 1, 0.5) for r in rows], SCHEMA).repartition(parts)


def random_rows(seed, n=1500):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = rng.choice(["hot"] * 6 + ["a", "b", "c", None, ""])
        x = rng.choice([None, NAN, INF, -INF, 0.0, -0.0, rng.gauss(0, 1), rng.gauss(0, 1), 10 ** rng.uniform(-300, 300), -(10 ** rng.uniform(-5, 5)), float(rng.randint(1, 6)), 5e-324])
        rows.append((v, None if k % 97 == 0 else k, x, rng.choice([None, NAN, float(rng.randint(0, 3))])))
    return rows + rows[:200]


def scored(rows):
    by = defaultdict(set)
    for v, i, x, t in rows:
        if v is not None and x is not None and not math.isnan(x):
            by[v].add((i, x + 0.0, None if t is None or math.isnan(t) else t))
    return by


@pytest.mark.parametrize("seed, num, den", [(1, 1, 4), (2, 1, 10), (3, 1, 1), (4, 2, 3)])
def test_cutoff_against_sorting(spark, seed, num, den):
    rows = random_rows(seed)
    report, kept = cutoff.keep_fraction(table(spark, rows), "v", "id", "x", num, den)
    expected_report, expected = {}, set()
    for v, members in scored(rows).items():
        xs = {(i, x) for i, x, _ in members}
        values = sorted((x for _, x in xs), reverse=True)
        cut = values[-(-len(values) * num // den) - 1]
        chosen = {(v, i, x) for i, x in xs if x >= cut}
        expected_report[v] = (len(values), cut, len(chosen))
        expected |= chosen
    assert {r["v"]: (r["n_scored"], r["cutoff"], r["n_kept"]) for r in report.collect()} == expected_report
    assert {tuple(r) for r in kept.collect()} == expected


def test_cutoff_edges(spark):
    with pytest.raises(ValueError):
        cutoff.keep_fraction(table(spark, []), "v", "id", "x", 0, 4)
    report, kept = cutoff.keep_fraction(table(spark, []), "v", "id", "x")
    assert report.count() == 0 and kept.count() == 0
    report, kept = cutoff.keep_fraction(table(spark, [("a", k, 7.0, 0.0) for k in range(9)]), "v", "id", "x")
    assert [tuple(r) for r in report.collect()] == [("a", 9, 7.0, 9)] and kept.count() == 9


@pytest.mark.parametrize("seed, n", [(1, 5), (2, 1), (3, 40), (4, 3000)])
def test_top_n_against_sorting(spark, seed, n):
    rows = random_rows(seed)
    expected = set()
    for v, members in scored(rows).items():
        order = sorted(members, key=lambda m: (-m[1], m[2] is not None, m[2] or 0, m[0] is not None, m[0] or 0))
        expected |= {(v, i, k) for k, (i, _, _) in enumerate(order[:n], 1)}
    got = topn.top_n(table(spark, rows, 7), "v", "x", "t", "id", n).collect()
    assert {(r["v"], r["id"], r["place"]) for r in got} == expected and len(got) == len(expected)


def test_top_n_edges(spark):
    assert topn.top_n(table(spark, []), "v", "x", "t", "id", 5).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(table(spark, []), "v", "x", "t", "id", 0)


def test_top_n_buffers(spark, monkeypatch):
    rows = [("a", k, float(k % 1000), 0.0) for k in range(3000)]
    df = table(spark, rows, 1)
    assert [r["id"] for r in topn.top_n(df, "v", "x", "t", "id", 3).orderBy("place").collect()] == [999, 1999, 2999]
