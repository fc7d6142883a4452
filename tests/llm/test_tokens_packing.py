import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import packing, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.DEFAULT_VOCABULARY), reason="vocabulary is absent")
_KEPT = []


def encoder():
    if not _KEPT:
        with open(tokenizer.DEFAULT_VOCABULARY, "rb") as f:
            _KEPT.append(tokenizer.ForcedBoundaryEncoder(f.read()))
    return _KEPT[0]


pieces = st.sampled_from(["'s", "'", "'re", " ", "  ", "\n", "\r\n", "\t", "\xa0", "　", " ", "a", "ll", "é", "é", "ế", "字", "1", "42", "٣", "!", "…", "’", "😀", "<|endoftext|>", "_", "\x00", "A"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(pieces, max_size=20).map("".join), max_size=5))
def test_fragments_encode_as_the_whole(texts):
    assert encoder().encode(pa.array(texts, pa.string())).to_pylist() == [encoder().whole(t) for t in texts]
    assert encoder().lengths(pa.array(texts, pa.string())).tolist() == [len(encoder().whole(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert encoder().encode(pa.array([text])).to_pylist() == [encoder().whole(text)]


def test_round_trip_long_texts_and_slices():
    texts = ["x" * 50_000, " " * 20_000, None, "", "字" * 9_000, "word " * 20_000]
    array = pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts))
    got = encoder().encode(array).to_pylist()
    assert got == [encoder().whole(t) if t else [] for t in texts]
    assert encoder()._bpe.decode(got[5]) == texts[5]


def test_corpus(spark):
    rows = [(1, "Chào bạn, it's <|endoftext|>", "x", 1), (1, "Chào bạn, it's <|endoftext|>", "x", 1), (2, None, None, 2), (3, "", "", 3), (None, "a", "", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, ids int")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in tokenizer.encode_corpus(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(0, [64]), (1, encoder().whole(rows[0][1])), (1, encoder().whole(rows[0][1])), (2, []), (3, [])], key=str)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokenizer.count_tokens(df, "doc_id", "text").collect()}
    assert counts[2] == 0 and counts[3] == 0 and counts[None] == 1
    assert tokenizer.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        tokenizer.encode_corpus(df, "doc_id", "text", "doc_id")


def best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100])
    sizes = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 300]))] + [rng.randint(1, max(1, capacity // 10)) for _ in range(200)]
    plan = packing.plan_packing({s: sizes.count(s) for s in set(sizes)}, capacity)
    gaps = []
    ends = [*plan.container[1:], plan.n_containers]
    for first, end, fill in zip(plan.container, ends, plan.fill):
        gaps += [capacity - fill] * int(end - first)
    assert sorted(gaps) == best_fit(sizes, capacity)


def check(rows, sizes, capacity):
    fill, parts = {}, {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        parts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["size"]))
    assert max(fill.values(), default=0) <= capacity
    assert all(r["container_fill"] == fill[r["container"]] for r in rows)
    assert set(fill) == set(range(len(fill)))
    assert set(parts) == {d for d, n in sizes if n and n > 0 and d is not None}
    for d, n in sizes:
        if d in parts:
            at = 0
            for k, (piece, start, size) in enumerate(sorted(parts[d])):
                assert (piece, start) == (k, at)
                at += size
            assert at == n and (len(parts[d]) == 1 or n > capacity)
    return len(fill)


@pytest.mark.parametrize("block", [50_000, 20])
def test_pack(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "_PART_ROWS", block)
    rng = random.Random(5)
    sizes = [(k, rng.choice([None, 0, -3, 30, 30, 30, 100, 101, 250, 1000, rng.randint(1, 100)])) for k in range(600)] + [(None, 5)]
    df = spark.createDataFrame([(*s, 1) for s in sizes], "doc_id bigint, n_tokens bigint, piece int")
    rows = packing.pack(df, "doc_id", "n_tokens", 100).collect()
    n = check(rows, sizes, 100)
    assert n <= -(-sum(r["size"] for r in rows) // 100) * 1.03 + 1
    again = packing.pack(df.repartition(3), "doc_id", "n_tokens", 100).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_pack_edges(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(df, "doc_id", "n_tokens", 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", "n_tokens", 0)
    with pytest.raises(ValueError):
        packing.pack(df.withColumnRenamed("doc_id", "size"), "size", "n_tokens", 10)
