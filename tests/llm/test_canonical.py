import random

from strandline.llm import canonical
from strandline.llm.queries import LICENCE_ALIASES, LICENCE_FILLERS

ENTRIES = [
    (1, "CC BY 2.0", "Attribution 2.0", "Ghi công 2.0", "cc", "2.0"),
    (2, "CC BY-NC-SA 4.0", "Attribution-NonCommercial-ShareAlike 4.0", "Ghi công - Phi thương mại - Chia sẻ tương tự 4.0", "cc", "4.0"),
    (3, "CC BY-ND 4.0", "Attribution-NoDerivatives 4.0", "Ghi công - Không phái sinh 4.0", "cc", "4.0"),
    (4, "CC BY 4.0", "Attribution 4.0", "Ghi công 4.0", "cc", "4.0"),
    (5, "CC0 1.0", "Creative Commons Zero 1.0 Universal", None, "cc0", "1.0"),
    (6, "Public Domain Mark 1.0", "Public Domain Mark 1.0", None, "pdm", "1.0"),
    (7, "Quintessa Free License", "Quintessa Free License", None, "stock", None),
    (8, "Quintessa Commercial License", "Quintessa Commercial License", None, "stock", None),
    (9, "Belmara Open License 1.0", "Belmara Open License 1.0", None, "stock", "1.0"),
    (10, "Belmara Open License 2.0", "Belmara Open License 2.0", None, "stock", "2.0"),
]

VALUES = {
    "CC BY 2.0": 1,
    "by 2": 1,
    "2.0 CC BY": 1,
    "ccbyncsa4.0": 2,
    "CC-BY-SA-NC-4.0": 2,
    "(cc) by NC sa v4,0": 2,
    "Creative Commons: Attribution - Non-Comercial - Share Alike 4.0 International": 2,
    "GIẤY PHÉP CC GHI CÔNG – PHI THƯƠNG MẠI – CHIA SẺ TƯƠNG TỰ 4.0": 2,
    "Attribution-NoDerivs 4.0": 3,
    "ＣＣ ＢＹ ４．０": 4,
    '<a href="https://x.example/l/q">CC BY 4.0</a>, see page': 4,
    "Attribution-NonComercail-Shraelaike 4.0": 2,
    "Attribution-NonCommercial-ShareAliekk 4.0": 2,
    "Attribution-NoDreivatvies 4.0": 3,
    "Atribbution 2.0": 1,
    "Cc0": 5,
    "cc-zero 1.0": 5,
    "pdm": 6,
    "Public-Domain Mrak": 6,
    "quintesas  free_Lizenz": 7,
    "Quintessa Commerical Licence (free to use)": 8,
    "Photo (Quintessa Free License)": 7,
    "Belmara Open 2": 10,
    "CC BY": 0,
    "CC BY 2.5": 0,
    "CC BY-ND-SA 4.0": 0,
    "CC BY 2.0 or 4.0": 0,
    "Quintessa License": 0,
    "Quintessa Free or Commercial": 0,
    "Quintessa Free License 3.0": 0,
    "Belmara Open License": 0,
    "Another Free License": 0,
    "public domain": 0,
    "?": 0,
    "x" * 20_000: 0,
}


def match(spark, values, entries=ENTRIES):
    rows = spark.createDataFrame([(k, v, "clash", 9) for k, v in enumerate(values)], "result_id bigint, license string, value string, license_id int")
    reference = spark.createDataFrame(entries, "license_id bigint, name string, long_name string, name_vi string, family string, version string")
    out = canonical.map_to_entries(
        rows, "result_id", "license", reference, "license_id", ("name", "long_name", "name_vi"), "family", "version", LICENCE_FILLERS, LICENCE_ALIASES
    )
    return {r["result_id"]: r["license_id"] for r in out.collect()}


def test_meanings(spark):
    values = list(VALUES)
    got = match(spark, values)
    assert {v: got[k] for k, v in enumerate(values)} == VALUES


def test_blank_null_and_repeated(spark):
    assert match(spark, [None, "", " \t\xa0", "CC BY 2.0", "CC BY 2.0"]) == {3: 1, 4: 1}
    assert match(spark, []) == {}
    assert match(spark, ["CC BY 2.0"], []) == {0: 0}


def test_edits_and_deletions_agree():
    """Any two words within the allowed edits share a deletion variant."""
    rng = random.Random(3)
    assert canonical.edits("sharealike", "shraelaike") == 2 and canonical.edits("", "ab") == 2 and canonical.edits("abc", "acb") == 1
    for _ in range(3000):
        word = "".join(rng.choices("abcd", k=rng.randint(4, 12)))
        other = word
        for _ in range(canonical.allowed_edits(len(word))):
            k, kind = rng.randrange(len(other)), rng.randrange(4)
            swapped = other[:k] + other[k + 1 : k + 2] + other[k] + other[k + 2 :]
            other = [other[:k] + other[k + 1 :], other[:k] + "x" + other[k:], other[:k] + "x" + other[k + 1 :], swapped][kind]
        if canonical.edits(word, other) <= canonical.allowed_edits(len(word)) and len(other) >= 4:
            assert canonical.deletions(word) & canonical.deletions(other)


def test_a_long_list_of_any_kind(spark):
    """50,000 titles of common words, mistyped: found without a table that grows faster than the list."""
    rng = random.Random(11)
    sounds = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]
    lexicon = ["".join(rng.choices(sounds, k=rng.randint(3, 5))) for _ in range(3000)]
    common = ["senior", "junior", "manager", "engineer", "director"]
    titles = set()
    while len(titles) < 50_000:
        titles.add(" ".join(rng.sample(common, rng.randint(0, 2)) + rng.sample(lexicon, rng.randint(1, 3))))
    titles = sorted(titles)
    entries = [(k + 1, t) for k, t in enumerate(titles)]

    def mistype(text):
        k = rng.randrange(len(text) - 1)
        return [text[:k] + text[k + 1 :], text[:k] + rng.choice("aeious") + text[k:], text[:k] + text[k + 1] + text[k] + text[k + 2 :]][rng.randrange(3)]

    chosen = rng.sample(entries, 1500)
    rows = [(n, " ".join(mistype(w) if len(w) > 5 and rng.random() < 0.5 else w for w in t.split()).upper() + rng.choice(["", " !", " xqqx"]), e) for n, (e, t) in enumerate(chosen)]
    rows += [(10_000 + k, f"{rng.choice(['wq', 'xj'])}{k} qqxqj", 0) for k in range(200)]
    out = canonical.map_to_entries(
        spark.createDataFrame(rows, "id long, title string, truth long"), "id", "title", spark.createDataFrame(entries, "entry long, name string"), "entry", ("name",)
    )
    truth = {n: e for n, _, e in rows}
    got = {r["id"]: r["entry"] for r in out.collect()}
    assert len(got) == len(rows)
    placed = [n for n, e in truth.items() if e]
    right = sum(got[n] == truth[n] for n in placed)
    wrong = sum(got[n] not in (0, truth[n]) for n in truth)
    print("recall", right / len(placed), "wrong", wrong)
    assert right >= 0.9 * len(placed) and wrong <= 0.02 * len(rows)
    assert all(got[n] == 0 for n, e in truth.items() if not e)


def test_a_share_of_the_words_is_enough_if_asked_for(spark):
    entries = spark.createDataFrame([(1, "grand hotel kalimora"), (2, "grand hotel venduro"), (3, "grand station")], "entry long, name string")
    rows = spark.createDataFrame([(1, "hotel Kalimora"), (2, "grand hotel"), (3, "kalimroa"), (4, "venduro kalimora")], "id long, v string")
    out = canonical.map_to_entries(rows, "id", "v", entries, "entry", ("name",), min_share=0.5, min_score=0.7)
    assert {r["id"]: r["entry"] for r in out.collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
