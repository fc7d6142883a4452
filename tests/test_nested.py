import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.operators import nested


def brute(text):
    try:
        v = json.loads(text)
        if isinstance(v, str):
            v = json.loads(v)
    except (ValueError, TypeError):
        return None
    if not isinstance(v, dict):
        return None

    def objects(x):
        return [(0, x)] if isinstance(x, dict) else [(k, e) for k, e in enumerate(x) if isinstance(e, dict)] if isinstance(x, list) else []

    out = set()
    for a, s in objects(v.get("scenes")):
        out.add(f"scenes/{a}")
        for b, f in objects(s.get("frames")):
            out.add(f"scenes/{a}/frames/{b}")
            out |= {f"scenes/{a}/frames/{b}/rejections/{c}" for c, _ in objects(f.get("rejections"))}
    return out | {f"attempts_log/{a}" for a, _ in objects(v.get("attempts_log"))}


def nodes(texts):
    found = [set() for _ in texts]
    whole = set()
    for rows in nested.flatten_batch([t.encode() if t is not None else None for t in texts], nested.REPORT):
        for r, p in zip(rows.record.tolist(), rows.node.to_pylist()):
            if rows.table == "reports":
                whole.add(r)
            elif rows.table in nested.NESTED_TABLES:
                assert p not in found[r]
                found[r].add(p)
    return [found[i] if i in whole else None for i in range(len(texts))]


leaf = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.floats(allow_infinity=False), st.text('ab"\\{}[]:,é😀\n ', max_size=6))
keys = st.sampled_from(["scenes", "frames", "rejections", "attempts_log", "x", 'q"', "\\", "é"])
value = st.recursive(leaf, lambda c: st.one_of(st.lists(c, max_size=4), st.dictionaries(keys, c, max_size=4)), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(value, st.sampled_from(["plain", "wide", "ascii", "string", "cut"])), max_size=8))
def test_equals_a_parser(cases):
    texts = []
    for v, kind in cases:
        t = json.dumps(v, ensure_ascii=kind == "ascii", indent=2 if kind == "wide" else None)
        texts.append(json.dumps(t) if kind == "string" else t[: len(t) // 2] if kind == "cut" else t)
    assert nodes(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, None),
        ("", None),
        ("   ", None),
        ("[]", None),
        ("null", None),
        ("3", None),
        ('"done"', None),
        ("{} x", None),
        ("{}", set()),
        ('{"scenes": NaN}', set()),
        ('{"scenes": {"frames": {"rejections": {}}}}', {"scenes/0", "scenes/0/frames/0", "scenes/0/frames/0/rejections/0"}),
        ('{"scenes": [0, null, {}, "x", [{}], {}]}', {"scenes/2", "scenes/5"}),
        ('{"scenes": [{}], "scenes": []}', set()),
        ('{"previous": {"scenes": [{}]}}', set()),
        ('{"\\u0073cenes": [{}]}', {"scenes/0"}),
        ('{"a": "\\\\", "scenes": [{"frames": [{"x": "]}\\""}]}]}', {"scenes/0", "scenes/0/frames/0"}),
        ('{"a":' + "[" * 200 + "]" * 200 + "}", set()),
    ],
)
def test_cases(text, expected):
    assert nodes([text]) == [expected]


def test_very_long_record_and_no_records():
    text = json.dumps({"scenes": [{"frames": [{"tags": ["x" * 1000], "rejections": [{}]}]}] * 2000})
    assert len(nodes([text, None, "{}"])[0]) == 6000
    assert nested.flatten_batch([], nested.REPORT) == []


def test_tables_keep_links_and_values(spark):
    report = {"video": "v", "saved": "3", "scenes": [None, {"start": 1, "end": "2.5", "frames": {"ts": 1.5, "tags": ["a", 'b"'], "file": "é\n"}}], "attempts_log": [{"attempt": "x"}]}
    rows = [("i", 1.0, "{}", "extra"), ("i", 2.0, json.dumps(report), "extra"), ("i", 2.0, json.dumps(report), "extra"), ("n", None, "{}", ""), (None, 1.0, "{}", ""), ("z", 1.0, None, "")]
    df = spark.createDataFrame(rows, "item_id string, updated_at double, report_json string, _key string")
    t = nested.related_tables(nested.report_nodes(df), nested.REPORT)
    assert [r["record_key"] for r in t["reports"].orderBy("record_key").collect()] == ["i", "n"]
    assert t["reports"].filter("record_key = 'i'").head()["saved"] == 3
    scene = t["scenes"].head()
    assert (scene["node"], scene["parent_node"], scene["place"], scene["start"], scene["end"]) == ("scenes/1", "", 1, 1.0, 2.5)
    frame = t["frames"].head()
    assert (frame["node"], frame["parent_node"], frame["ts"], frame["file"]) == ("scenes/1/frames/0", "scenes/1", 1.5, "é\n")
    assert [(r["node"], r["parent_node"], r["value"]) for r in t["tags"].orderBy("place").collect()] == [("scenes/1/frames/0/tags/0", "scenes/1/frames/0", "a"), ("scenes/1/frames/0/tags/1", "scenes/1/frames/0", 'b"')]
    assert t["attempts"].head()["attempt"] is None
    assert t["rejections"].count() == 0
    assert nested.report_nodes(df.limit(0)).count() == 0


def test_no_limit_on_depth_or_digits():
    deep = '{"scenes": [{}], "x": ' + "[" * 30_000 + "]" * 30_000 + "}"
    long_ = '{"scenes": [{"start": ' + "7" * 6000 + "}]}"
    assert nodes([deep, long_, '{"scenes": [{}], "x": ' + "[" * 30_000 + "]" * 29_999 + "}"]) == [{"scenes/0"}, {"scenes/0"}, None]


@pytest.mark.parametrize("value", ["Infinity", "-Infinity", "-NaN", "nan", "01", "1.", ".5", "1e", "+1", "tru", "nulls", "'a'", "\\u0041", '"\\x"', '"\\u12g4"', '"\t"', "[1,]", "[,1]", "[1 2]", '{"a"}', '{"a":}', '{1:2}', '{"a":1,}', '{"a" 1}', "[1}", "1 2", "", ":", "[1:2]"])
def test_what_is_no_json(value):
    text = '{"scenes": [{}], "x": ' + value + "}"
    assert nodes([text, '{"scenes": [{}]}']) == [None, {"scenes/0"}]


junk = st.lists(st.sampled_from(list('{}[]:,"\\ 01-+.eEaNtrufls\n\t') + ["null", "true", "NaN", '"a"', '"scenes"']), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(junk, st.sampled_from(["{%s}", '{"a":%s}', "%s", '{"a":[%s]}'])), min_size=1, max_size=6))
def test_whole_as_a_parser_says(cases):
    texts = [form % t for t, form in cases]

    def refuse(name):
        if name != "NaN":
            raise ValueError(name)
        return float("nan")

    def whole(t):
        try:
            v = json.loads(t, parse_constant=refuse)
            v = json.loads(v, parse_constant=refuse) if isinstance(v, str) else v
        except ValueError:
            return False
        return isinstance(v, dict)

    number, _ = nested.whole_records([t.encode() for t in texts])
    assert number.tolist() == [i for i, t in enumerate(texts) if whole(t)]


def test_maps_values_and_lone_objects(spark):
    report = """{"stage_timings": {"decode": {"ms": 1.5, "count": 2}, "a/\\u00e9": 7, "decode": {"ms": 2}}, "shortfall_reasons": {"x": 3, "y": null, "z": [1]},
      "selected_times": [1, null, {}, 2.5], "scene_times": 4, "manifest_validation": {"status": "ok", "missing": ["a.png", 3]},
      "attempts_log": {"error": {"cause": {"kind": "k", "trace": [{"fn": "f"}, 1, {"line": 9}]}}}, "previous": {"scenes": [{"frames": {"ts": 1}}]}}"""
    df = spark.createDataFrame([("i", 1.0, report)], "item_id string, updated_at double, report_json string")
    t = nested.related_tables(nested.report_nodes(df), nested.REPORT)
    get = lambda name, *c: [tuple(r[x] for x in c) for r in t[name].orderBy("node").collect()]
    assert get("stage_timings", "node", "name", "ms", "count") == [("stage_timings/a/é", "a/é", None, None), ("stage_timings/decode", "decode", 2.0, None)]
    assert get("shortfall_reasons", "name", "value") == [("x", 3), ("y", None), ("z", None)]
    assert get("selected_times", "node", "value") == [("selected_times/0", 1.0), ("selected_times/3", 2.5)]
    assert get("scene_times", "node", "value") == [("scene_times/0", 4.0)]
    assert get("missing_files", "node", "parent_node", "value") == [("manifest_validation/missing/0", "manifest_validation", "a.png"), ("manifest_validation/missing/1", "manifest_validation", "3")]
    assert get("trace", "node", "fn", "line") == [("attempts_log/0/error/cause/trace/0", "f", None), ("attempts_log/0/error/cause/trace/2", None, 9)]
    assert get("previous_frames", "node", "ts") == [("previous/scenes/0/frames/0", 1.0)]
    assert t["scenes"].count() == t["frames"].count() == 0
