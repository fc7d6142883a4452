"""Freely typed values mapped to the entry of a reference list that they mean.

1. Distinct values are split into words (compatibility forms unified, markup tags dropped, case and accents
   folded, numbers read as versions where entries have one).
2. Token-level repair: distinct words, and neighbouring words run together, are joined to the phrases of the
   reference list by edit distance (a letter wrong, missing, added, or swapped with its neighbour): one edit from
   four letters, two from eight, none below.  The join is an equality join on deletion variants, so it needs no cross join.
3. The phrases of a value become concepts.  Columns of one entry that divide into equally many parts at
   their hyphens are translations of each other, part by part.
4. Soft TF-IDF ranks the entries: the cosine of the concepts of value and entry, weighted by inverse document frequency in
   the list and by the likeness of the repaired words.  Words that no entry knows are remarks and weigh nothing, a concept
   said in brackets with other words weighs a little less, and a concept that the entry lacks weighs ``KIN_WEIGHT`` fold
   if it is kin (it stands beside one of the entry's concepts in another entry) and nothing otherwise.
5. The best entry stands if its score reaches ``min_score`` and no entry of other concepts comes within ``MARGIN`` of it.
   Among entries of equal concepts the stated version decides; without one there must be only one such entry.
   Otherwise the value settles on nothing: 0.

An entry is looked up by its rarest concepts only: as many as a value must hold one of to reach ``min_share`` of the
entry's weight (1: every concept of the entry must be there).  So a word common to many entries fans nothing out.

Null and blank values give no row; every other row of the input gives one, repeated rows one together.  An empty reference
list leaves everything unmatched.  The reference list passes through the driver, in memory linear in its length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize
from strandline.skew import join_by_weight

KIN_WEIGHT = 4.0
MARGIN = 0.08
MIN_SCORE = 0.85
_ASIDE = 0.92
_MIN_REPAIR, _TWO_EDITS = 4, 8
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
_VERSION = re.compile(r"\d+(?:\.\d+)*")
_BRACKETS = re.compile(r"\([^()]*\)")
_TAG = re.compile(r"<[^<>]*>")

def words(value: str) -> list[str]:
    """Folded words and numbers of a value, in order."""
    return [w for w, _ in words_and_asides(value)]


def words_and_asides(value: str) -> list[tuple[str, bool]]:
    """The words, and whether each stands in brackets with others, as a remark does."""
    text = _TAG.sub(" ", unicodedata.normalize("NFKC", value))
    text = unicodedata.normalize("NFD", text.casefold().replace("đ", "d"))
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"(?<=\d),(?=\d)", ".", text)
    asides = [m.span() for m in _BRACKETS.finditer(text) if len(_WORD.findall(m[0])) > 1]
    return [(m[0], any(a <= m.start() < z for a, z in asides)) for m in _WORD.finditer(text)]


def version_of(word: str) -> str | None:
    """A number as version: 2 and 2.0 are the same; a lone 0 is a name."""
    if not _VERSION.fullmatch(word) or word == "0":
        return None
    return word if "." in word else f"{word}.0"


@dataclass
class Lexicon:
    """Phrases of the reference list and the concepts they stand for."""

    phrases: dict[str, tuple[str, ...]] = field(default_factory=dict)  # words run together -> concepts; none for fillers
    required: dict[int, list[tuple[str, ...]]] = field(default_factory=dict)  # entry -> sets of concepts, each of which names it
    version: dict[int, str | None] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    codes: tuple[str, ...] = ()  # short words that may be written without spaces
    longest: int = 1
    versions: bool = False

    @classmethod
    def build(
        cls,
        entries: list[dict],
        id_col: str,
        name_cols: tuple[str, ...],
        family_col: str | None = None,
        version_col: str | None = None,
        fillers: tuple[str, ...] = (),
        aliases: dict[str, str] | None = None,
    ) -> "Lexicon":
        out = cls(versions=version_col is not None)
        same: dict[str, str] = {}
        filler = {"".join(words(f)) for f in fillers}
        split = re.compile(r"\s*[-–]\s*")
        plain = lambda text: [w for w in words(text) if not (out.versions and version_of(w))]
        for e in entries:
            parts = [[plain(p) for p in split.split(e[c])] for c in name_cols if e[c]]
            first = parts[0] if parts else []
            for other in parts[1:]:
                if len(other) == len(first) and other != first and len(first[-1]) and all(other) and (len(first) > 1 or len(first[0]) > 1):
                    for a, b in zip(first, other):
                        # The last word of a part of the first name is its code: "CC BY" and "Attribution".
                        if a and len(a[-1]) <= 3 and a[-1].isalpha():
                            same["".join(b)] = a[-1]
                            out.longest = max(out.longest, len(b))
        for a, b in (aliases or {}).items():
            same["".join(words(a))] = same.get("".join(words(b)), "".join(words(b)))
            out.longest = max(out.longest, len(words(a)))

        def concepts(text: str) -> list[str]:
            found: list[str] = []
            ws, k = plain(text), 0
            while k < len(ws):
                for n in range(min(out.longest, len(ws) - k), 0, -1):
                    key = "".join(ws[k : k + n])
                    if n == 1 or key in same:
                        if key not in filler:
                            found.append(same.get(key, key))
                        k += n
                        break
            return found

        for key, code in same.items():
            out.phrases[key] = (code,)
        out.longest = max([out.longest, *(len(words(f)) for f in fillers)])
        families: dict[str, list[int]] = defaultdict(list)
        short: set[str] = set()
        for e in entries:
            number = int(e[id_col])
            variants = [v for v in (concepts(e[c]) for c in name_cols if e[c]) if v]
            for v in variants:
                for c in v:
                    out.phrases.setdefault(c, (c,))
                    if len(c) <= 3:
                        short.add(c)
            common = set(variants[0]).intersection(*variants[1:]) if variants else set()
            # Names that share nothing each name the entry.
            out.required[number] = [tuple(sorted(common))] if common else sorted({tuple(sorted(set(v))) for v in variants})
            out.version[number] = version_of(str(e[version_col])) if version_col and e[version_col] else None
            if family_col and e[family_col]:
                families["".join(words(e[family_col]))].append(number)
        for f in filler:
            out.phrases[f] = ()
        # The name of a family with one entry names the entry.
        for name, members in families.items():
            if len(members) == 1 and name not in out.phrases and len(out.required[members[0]]) == 1:
                out.phrases[name] = out.required[members[0]][0]
        out.codes = tuple(sorted(short))
        seen = Counter(c for sets in out.required.values() for c in {c for r in sets for c in r})
        out.weight = {c: math.log(1 + len(entries) / n) for c, n in seen.items()}
        return out

    def glued(self, word: str) -> list[str] | None:
        """A word as a row of codes, if it is one."""
        if len(word) > 3 * len(self.codes):
            return None
        codes, best = set(self.codes), [[]] + [None] * len(word)
        for k in range(1, len(word) + 1):
            for n in (3, 2, 1):
                if n <= k and word[k - n : k] in codes and best[k - n] is not None and (best[k] is None or len(best[k - n]) + 1 < len(best[k])):
                    best[k] = best[k - n] + [word[k - n : k]]
        found = best[len(word)]
        return found if found and len(found) > 1 else None


def _ngrams(longest: int, versions: bool, longest_phrase: int):
    """Words and runs of words with their places; what is longer than every phrase by more than two letters matches none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, at, n, gram = [], [], [], []
            for v in batch.column(0).to_pylist():
                ws = words(v)
                for k in range(len(ws)):
                    for m in range(1, min(longest, len(ws) - k) + 1):
                        if m > 1 and versions and version_of(ws[k + m - 1]):
                            break
                        joined = "".join(ws[k : k + m])
                        if len(joined) <= longest_phrase + 2:
                            value.append(v)
                            at.append(k)
                            n.append(m)
                            gram.append(joined)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value, pa.string()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(gram, pa.string())],
                names=["value", "at", "n", "gram"],
            )

    return run


def edits(a: str, b: str) -> int:
    """Letters wrong, missing, added, or swapped with their neighbours between two words."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def allowed_edits(length: int) -> int:
    return 0 if length < _MIN_REPAIR else 1 if length < _TWO_EDITS else 2


def deletions(word: str) -> set[str]:
    """The word, and the word without one letter or, from eight letters less the edits, without two."""
    out = {word}
    # A word one or two letters shorter than a phrase may still be two edits from it.
    for _ in range(0 if len(word) < _MIN_REPAIR - 1 else 1 if len(word) < _TWO_EDITS - 2 else 2):
        out |= {w[:k] + w[k + 1 :] for w in out for k in range(len(w))}
    return out


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, key = [], []
        for w in batch.column(0).to_pylist():
            ks = deletions(w)
            word += [w] * len(ks)
            key += ks
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(key, pa.string())], names=["word", "key"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram, phrase, like = [], [], []
        for g, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            d = edits(g, p)
            if d <= (allowed_edits(len(p)) if len(g) >= _MIN_REPAIR else 0):
                gram.append(g)
                phrase.append(p)
                like.append(1 - (d / len(p)) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.string()), pa.array(phrase, pa.string()), pa.array(like, pa.float64())], names=["gram", "phrase", "like"])


def repair(grams: DataFrame, phrases: list[str]) -> DataFrame:
    """gram, phrase and likeness (1 - (edits / length) ** 2) of the phrases within the edits that their length allows."""
    spark = grams.sparkSession
    vocabulary = spark.createDataFrame([(p,) for p in phrases], "word string")
    keyed = lambda df, name: df.mapInArrow(_variants, "word string, key string").withColumnRenamed("word", name)
    left = keyed(grams.select(F.col("gram").alias("word")).distinct(), "gram")
    # Written, so that the planner knows how large it is.
    right = materialize(keyed(vocabulary, "phrase"), "vocabulary")
    pairs = left.join(right, "key").select("gram", "phrase").distinct()
    return pairs.mapInArrow(_near, "gram string, phrase string, like double")


_CONCEPT = "struct<place:int,concept:string,like:double,aside:boolean,w2:double>"


def _concepts_of_values(lexicon: Lexicon):
    kind = pa.list_(pa.struct([("place", pa.int32()), ("concept", pa.string()), ("like", pa.float64()), ("aside", pa.bool_()), ("w2", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, concepts, versions = [], [], []
            for v, matches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_place: dict[int, list] = defaultdict(list)
                for m in matches or ():
                    by_place[m["at"]].append((m["n"], m["like"], m["phrase"]))
                read, k = words_and_asides(v), 0
                found: dict[tuple[int, str], tuple[float, bool]] = {}
                stated: set[str] = set()
                while k < len(read):
                    word, aside = read[k]
                    number = version_of(word) if lexicon.versions else None
                    if number:
                        stated.add(number)
                        k += 1
                    elif by_place[k]:
                        # Each phrase by the run of words most like it; then the longest run, and of its repairs the exact one, or all.
                        nearest: dict[str, tuple[float, int]] = {}
                        for m, like, phrase in by_place[k]:
                            nearest[phrase] = max(nearest.get(phrase, (0.0, 0)), (like, m))
                        n = max(m for _, m in nearest.values())
                        same = [(like, phrase) for phrase, (like, m) in nearest.items() if m == n]
                        top = max(same)[0]
                        for like, phrase in same:
                            if like == top or top < 1:
                                for c in lexicon.phrases[phrase]:
                                    if c in lexicon.weight:
                                        found[k, c] = max(found.get((k, c), (0.0, aside)), (like, aside))
                        k += n
                    else:
                        for i, c in enumerate(lexicon.glued(word) or ()):
                            if c in lexicon.weight:
                                found[k * 1000 + i + 1_000_000, c] = (1.0, aside)
                        k += 1
                value.append(v)
                concepts.append([{"place": k, "concept": c, "like": like, "aside": aside, "w2": lexicon.weight[c] ** 2} for (k, c), (like, aside) in found.items()])
                versions.append(sorted(stated))
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.string()), pa.array(concepts, kind), pa.array(versions, pa.list_(pa.string()))], names=["value", "concepts", "versions"])

    return run


def _entry_groups(lexicon: Lexicon, min_share: float) -> tuple[list[tuple], list[tuple], set[tuple[str, str]]]:
    """Groups of entries of equal concepts, the concepts to look each up by, and the concepts that stand side by side."""
    members: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for e, sets in lexicon.required.items():
        for r in sets:
            if r:
                members[r].append(e)
    groups, index, kin = [], [], set()
    for g, (names, entries) in enumerate(sorted(members.items())):
        weights = {c: lexicon.weight[c] ** 2 for c in names}
        left = total = sum(weights.values())
        for c in sorted(names, key=lambda c: (-weights[c], c)):
            if left < min_share * total * (1 - 1e-9):
                break
            index.append((c, g))
            left -= weights[c]
        groups.append((g, list(names), [weights[c] for c in names], total, [(e, lexicon.version[e]) for e in sorted(set(entries))]))
        kin.update((a, b) for a in names for b in names if a != b)
    return groups, index, kin


def match_values(values: DataFrame, lexicon: Lexicon, min_share: float = 1.0, min_score: float = MIN_SCORE) -> DataFrame:
    """value, entry (0: none) and score for each row of ``values`` (one distinct column ``value``)."""
    spark = values.sparkSession
    longest = max(map(len, lexicon.phrases), default=0)
    grams = materialize(values.mapInArrow(_ngrams(lexicon.longest, lexicon.versions, longest), "value string, at int, n int, gram string"), "grams")
    repaired = materialize(repair(grams, list(lexicon.phrases)), "repaired")
    matched = grams.join(repaired, "gram").groupBy("value").agg(F.collect_list(F.struct("at", "n", "phrase", "like")).alias("matches"))
    read = values.join(matched, "value", "left").mapInArrow(_concepts_of_values(lexicon), f"value string, concepts array<{_CONCEPT}>, versions array<string>")
    read = materialize(read, "concepts")
    groups, index, kin = _entry_groups(lexicon, min_share)
    lists = materialize(
        spark.createDataFrame(groups, "g int, names array<string>, weights array<double>, total double, entries array<struct<entry:bigint,version:string>>"), "groups"
    )
    heads = materialize(spark.createDataFrame(index, "concept string, g int"), "heads")
    sides = materialize(spark.createDataFrame(sorted(kin), "u string, c string"), "kin")
    wanted = read.select("value", F.explode(F.array_distinct(F.transform("concepts", lambda x: x["concept"]))).alias("concept")).join(heads, "concept").select("value", "g").distinct()
    both = wanted.join(lists.select("g", "names", "weights", "total"), "g").join(read.select("value", "concepts"), "value")
    said = lambda c: F.array_max(F.transform(F.filter("concepts", lambda x: x["concept"] == c), lambda x: x["like"] * F.when(x["aside"], _ASIDE).otherwise(1.0)))
    terms = F.transform(F.arrays_zip("names", "weights"), lambda x: F.struct(x["weights"].alias("w"), said(x["names"]).alias("like")))
    both = both.withColumn("_t", terms)
    fold = lambda f: F.aggregate("_t", F.lit(0.0), lambda s, x: s + F.when(x["like"].isNotNull(), f(x)).otherwise(0.0))
    both = both.withColumn("part", fold(lambda x: x["w"] * x["like"])).withColumn("share", fold(lambda x: x["w"]))
    both = both.filter(F.col("share") >= min_share * F.col("total") * (1 - 1e-9))
    used = F.transform(F.filter("concepts", lambda x: F.array_contains("names", x["concept"])), lambda x: x["place"])
    others = F.filter("concepts", lambda x: ~x["aside"] & ~F.array_contains(F.col("used"), x["place"]))
    scored = both.withColumn("used", used).select("value", "g", "names", "part", "share", "total", others.alias("others"))
    scored = materialize(scored, "candidates")
    # Concepts said beside the entry's that stand beside one of them elsewhere.
    extra = scored.select("value", "g", "names", F.explode("others").alias("x")).select("value", "g", "x.place", "x.w2", F.col("x.concept").alias("u"), F.explode("names").alias("c"))
    extra = extra.join(sides, ["u", "c"], "left_semi").groupBy("value", "g", "place").agg(F.max("w2").alias("w2")).groupBy("value", "g").agg(F.sum("w2").alias("extra"))
    score = F.col("part") / F.sqrt(F.col("total") * (F.col("share") + KIN_WEIGHT * F.coalesce("extra", F.lit(0.0))))
    ranked = scored.select("value", "g", "part", "share", "total").join(extra, ["value", "g"], "left").select("value", "g", score.alias("score"))
    best = F.max("score").over(Window.partitionBy("value"))
    close = ranked.withColumn("best", best).filter((F.col("best") >= min_score) & (F.col("score") > F.col("best") - MARGIN))
    single = close.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.max("g").alias("g"), F.max("score").alias("score")).filter("n = 1")
    stated = F.col("versions")
    agree = F.filter(
        "entries", lambda x: ((F.size(stated) == 0) & (F.size("entries") == 1)) | ((F.size(stated) == 1) & x["version"].eqNullSafe(F.try_element_at(stated, F.lit(1))))
    )
    settled = single.join(lists.select("g", "entries"), "g").join(read.select("value", "versions"), "value").withColumn("agree", agree).filter(F.size("agree") == 1)
    settled = settled.select("value", F.col("agree")[0]["entry"].alias("entry"), "score")
    return values.join(settled, "value", "left").select("value", F.coalesce("entry", F.lit(0)).alias("entry"), "score")


def map_to_entries(
    df: DataFrame,
    id_col: str,
    value_col: str,
    reference: DataFrame,
    entry_col: str,
    name_cols: tuple[str, ...],
    family_col: str | None = None,
    version_col: str | None = None,
    fillers: tuple[str, ...] = (),
    aliases: dict[str, str] | None = None,
    min_share: float = 1.0,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """``id_col``, ``value_col``, the entry (0 if unmatched) and the score of every row with a value.

    ``fillers`` are words that never tell entries apart, ``aliases`` other names of reference words.
    """
    kept = [entry_col, *name_cols, *[c for c in (family_col, version_col) if c]]
    entries = [r.asDict() for r in reference.select(*dict.fromkeys(kept)).filter(F.col(entry_col).isNotNull()).distinct().collect()]
    lexicon = Lexicon.build(sorted(entries, key=lambda e: [str(v) for v in e.values()]), entry_col, name_cols, family_col, version_col, fillers, aliases)
    rows = df.select(F.col(id_col).alias("_id"), F.col(value_col).cast("string").alias("value")).filter(F.col("value").rlike(r"(?U)\S")).distinct()
    counted = materialize(rows.groupBy("value").agg(F.count(F.lit(1)).alias("_n")), "values")
    fate = match_values(counted.select("value"), lexicon, min_share, min_score).join(counted, "value")
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).head()[0]
    out = join_by_weight(rows, materialize(fate, "matched"), "value", "_n", total)
    return out.select(F.col("_id").alias(id_col), F.col("value").alias(value_col), F.col("entry").alias(entry_col), "score")
