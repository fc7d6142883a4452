"""Text that was decoded with a wrong character encoding: found, and restored where possible.

A hidden Markov model labels the characters outside ASCII (ASCII looks the same in every state and is
skipped).  There is one clean state, one state for each pair of a true and a wrong encoding, and one for
lost characters.  A state emits a stretch of characters at a cost, its negative log probability up to a
constant:

* clean: the characters as they stand.  Letters of one script side by side, quotes where quotes go and so on
  are cheap; a symbol inside a word, two scripts in one word, control characters and unassigned ones are dear.
* UTF-8 read as a one-byte encoding: units of two to four characters that are one UTF-8 sequence in that
  encoding, at the cost of the character they stand for; other characters as in the clean state and more.
* a one-byte encoding read as another: every character at the cost of the one it stands for; for Cyrillic, whole words.
* UTF-8 read as UTF-16: pairs of bytes, at the cost of the text they spell.

Entering a state costs too, so one odd character alone stays clean.  The cheapest path is found by dynamic
programming (Viterbi) over the stretches of a document, and each labelled stretch gets the inverse transform
of its state.  A restored text is labelled again until nothing more is found (or a text comes back that was there
before), for text that was decoded wrongly more than once.

A stretch is plain if the clean state explains it well and better than any other.  Correct words also stand between
garbled ones, so every state emits a plain stretch at the same cost; a cost that all states share changes no path,
and plain stretches are left out of the sequence.

A vectorised pass over all characters first rules out documents in which nothing is odd: there the clean
path is the cheapest, as every other one pays for entering its state.

Defined cases: null and empty texts are clean; U+FFFD and control characters that no state explains are
lost characters and stay as they are, as do sequences of which a character is missing (``n_unrestored`` counts the
stretches that stay so); correct text in any language, script or normal form is clean.
One row comes out for each row that goes in.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 read as these.
WRONG = ("cp1252", "latin_1", "iso8859_15", "cp1250", "cp1251", "cp1253", "cp1254", "cp1258", "koi8_r", "cp437", "cp850", "mac_roman")
#: One one-byte encoding read as another: what it was, and what it was read as.
SWAPPED = (
    ("cp1252", "cp1251"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "mac_roman"),
    ("cp1251", "latin_1"),
    ("cp1251", "cp1252"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1251"),
    ("koi8_r", "latin_1"),
)
STATES = ("clean", *(f"utf8-as-{e}" for e in WRONG), *(f"{t}-as-{e}" for t, e in SWAPPED), "utf8-as-utf16", "lost")
_N_WRONG = len(WRONG)
_UTF16, _LOST = len(STATES) - 2, len(STATES) - 1

_ENTER_UTF8, _ENTER_OTHER, _LEAVE, _CHANGE = 4.0, 5.0, 1.0, 6.0
_NEVER = 1e12
_IMPLAUSIBLE = 14.0
_CACHE = 200_000
_LONGEST_WORD = 30


def _bytes_of(encoding: str) -> dict[str, int]:
    """Characters outside ASCII and their bytes; bytes an encoding of the Windows family leaves free stand for themselves, as in Latin-1."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    if encoding.startswith("cp12"):
        for b in range(0x80, 0x100):
            if b not in out.values():
                out[chr(b)] = b
    return out


_BYTES = {e: _bytes_of(e) for e in {*WRONG, *(e for _, e in SWAPPED)}}
_SWAP = {(t, e): {c: bytes([b]).decode(t, "replace") for c, b in _BYTES[e].items()} for t, e in SWAPPED}

_CYRILLIC_STATES = {1 + _N_WRONG + k: p for k, p in enumerate(SWAPPED) if p[0] != "cp1252"}
_ONE_LETTER_WORDS = set("авикосуя")
_NEAR_WORD = 40

_OPENING = set("«“‘„‚¿¡‹")
_CLOSING = set("»”…›")
_DASHES = set("–—•·―‐‑−")
_AFTER_WORD = set("²³¹ºª™®°µ′″")
_TEXT_MARKS = set("–—‘’“”„‚•…‹›«»¿¡€ ​﻿")


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0xFB00 <= o < 0xFB07:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "other"


def _context(c: str) -> str:
    """An ASCII neighbour, as far as costs depend on it."""
    return "" if not c or c.isspace() else "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "."


def _is_word(c: str) -> bool:
    return bool(c) and c.isalpha()


def _clean_cost(prev: str, c: str, following: str) -> float:
    o = ord(c)
    if c == "�":
        return 30.0
    if o < 0xA0:
        return 12.0
    kind = unicodedata.category(c)
    before, after = _is_word(prev), _is_word(following)
    if kind[0] == "L":
        if o in (0xAA, 0xBA):
            return 8.0 if before and after else 3.0
        script = _script(c)
        if script == "other":
            return 5.0 if 0x3400 <= o < 0xA000 else 3.0
        cost = 2.0 if script == "latin" else 3.0
        if any(_is_word(x) and _script(x) != script and _script(x) != "other" for x in (prev, following)):
            cost += 8.0
        elif script != "latin":
            cost -= 1.0 if before or after else 0.0
            if script == "cyrillic" and c.isupper() and before and prev.islower():
                cost += 3.0
            if 0x402 <= o < 0x410 or 0x452 <= o < 0x460:
                cost += 2.0
        else:
            if c.isupper() and before and prev.islower():
                cost += 5.0
            if c in "þðÿıƒˇ" or o >= 0xFB00 or 0x180 <= o < 0x250 and c not in "ƠơƯư":
                cost += 2.0
            if c in "œŒšŠžŽŸ" and prev and prev in "ÃÂÄÅÐÑÆ":
                cost += 3.0
        return cost
    if kind[0] == "M":
        return 1.0 if before or prev and unicodedata.category(prev)[0] == "M" else 6.0
    if kind in ("Cn", "Co", "Cs"):
        return _IMPLAUSIBLE
    if kind == "Cf":
        return 4.0 if o in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF, 0x200E, 0x200F) else 10.0
    if c in "   　":
        return 2.0
    if c == "’":
        return 2.0
    if c in _OPENING:
        return 7.0 if before else 2.0
    if c in _CLOSING:
        return 7.0 if after else 2.0
    if 0x2500 <= o < 0x25A0:
        beside = [x for x in (prev, following) if x and not x.isascii()]
        if before or after:
            return 8.0
        if any(not 0x2500 <= ord(x) < 0x25A0 for x in beside):
            return 6.0
        return 4.0 if any((ord(x) >= 0x2580) != (o >= 0x2580) for x in beside) else 1.0
    if o >= 0x1F000:
        return 2.0
    if c in _DASHES:
        return 2.0 if not (before and after) else 4.0 if c in "–—" else 8.0
    if c in _AFTER_WORD and not (before and after):
        return 3.0
    if kind[0] == "P" and not (before and after):
        return 2.0 if o > 0x2FFF else 3.0
    if 0x2190 <= o < 0x2C00 and not (before or after):
        return 2.0
    return 3.0 if not (before or after) else 8.0 if before and after else 5.5


def _meaning_cost(y: str) -> float:
    """The cost of a character that a garbled sequence stands for."""
    o = ord(y)
    if y in _TEXT_MARKS:
        return 3.0
    if 0xC0 <= o < 0x180 or y in "ƠơƯư" or 0x1EA0 <= o < 0x1EFA or 0x300 <= o < 0x370:
        return 2.5
    if 0xA1 <= o < 0xC0 or y in "×÷":
        return 2.5
    if 0x386 <= o < 0x3CF or 0x401 <= o < 0x460:
        return 3.0
    if 0x2010 <= o < 0x2060 or 0x20A0 <= o < 0x20C0 or 0x2100 <= o < 0x2700 or 0x3000 <= o < 0x3100 or 0x4E00 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4:
        return 3.5
    if 0x1100 <= o < 0x1200 or 0xFF00 <= o < 0xFF61 or 0x1F000 <= o < 0x1FB00 or o in (0xFE0F, 0x200D):
        return 3.5
    if y in _BYTES["cp1252"] or 0x80 <= o < 0xA0:
        return 4.5  # part of a sequence that is itself garbled
    return _IMPLAUSIBLE


def _unit(run: str, k: int, codes: dict[str, int]) -> str | None:
    """The character that a UTF-8 sequence beginning at ``k`` stands for."""
    first = codes.get(run[k], 0)
    n = 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
    if not n or k + n > len(run):
        return None
    raw = bytes(codes.get(c, 0) for c in run[k : k + n])
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _as_utf16(run: str) -> tuple[float, str] | None:
    if any(ord(c) > 0xFFFF or 0xD800 <= ord(c) < 0xE000 for c in run):
        return None
    raw = run.encode("utf-16-le")
    text = raw.decode("utf-8", "replace")
    cost = 0.0
    for i, c in enumerate(text):
        if c == "�":
            # A sequence may be cut at either end of the stretch.
            cost += 3.0 if i < 2 or i > len(text) - 3 else _IMPLAUSIBLE
        elif c.isascii():
            cost += 1.6 if c.islower() or c == " " else 3.0 if c.isprintable() or c in "\r\n\t" else _IMPLAUSIBLE
        else:
            cost += _meaning_cost(c)
    return cost, text


#: Letters of Russian from frequent to rare (fixed values); the rest of the script is rarer still.
_LETTER_COST = {c: 0.5 + 0.04 * k for k, c in enumerate("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё")}


def _cyrillic_cost(before: str, run: str, meant: list[str], after: str, clean: list[float]) -> float | None:
    """The cost of a stretch as a Cyrillic word in a wrong one-byte encoding; None if it can be none."""
    if before.isalpha() or after.isalpha() or len(run) > _LONGEST_WORD:
        return None
    letters = [y for y in meant if y.isalpha()]
    if len(letters) < 2 or any(_script(y) != "cyrillic" for y in letters) or len({_script(x) for x in run if x.isalpha()}) > 1:
        return None  # right letters among them
    if len(letters) < 3 and not all(0xC0 <= ord(x) < 0x100 or 0x410 <= ord(x) < 0x450 for x, y in zip(run, meant) if y.isalpha()):
        return None  # too short to tell from a cut sequence
    if 4 * len(letters) < 3 * len(run):
        return None
    total = _word_cost(meant)
    if any(x.isalpha() and _script(x) == "cyrillic" for x in run):
        # Cyrillic either way: the clean state, corrected by what the one reading costs more as a word than the other.
        return sum(clean) + total - _word_cost(list(run)) + 1.0
    marks = sum(clean[i] if x == y else 1.5 + _clean_cost(meant[i - 1] if i else before, y, meant[i + 1] if i + 1 < len(meant) else after) for i, (x, y) in enumerate(zip(run, meant)) if not y.isalpha())
    return 2.0 + total + marks


def _word_cost(word: list[str]) -> float:
    """The letters of a Cyrillic word by their frequency, and its capitals: one in front costs nothing, all of them little."""
    letters = [c for c in word if c.isalpha()]
    total = sum(_LETTER_COST.get(c.lower(), 4.0) for c in letters)
    total += 1.5 if len(letters) > 2 and all(c.isupper() for c in letters) else 0.0
    return total + sum(5.0 for a, b in zip(letters, letters[1:]) if b.isupper() and a.islower())


def emissions(before: str, run: str, after: str) -> tuple[np.ndarray, list[str | None]]:
    """The cost of a stretch outside ASCII in every state, and its text by each state's inverse transform."""
    padded = [before, *run, after]
    clean = [_clean_cost(padded[i], c, padded[i + 2]) for i, c in enumerate(run)]
    total = sum(clean)
    cost = np.full(len(STATES), total + 2.0)
    text: list[str | None] = [None] * len(STATES)
    cost[0] = total
    n = len(run)
    for s, encoding in enumerate(WRONG, 1):
        codes = _BYTES[encoding]
        if n < 2 or not any(0xC2 <= codes.get(c, 0) < 0xF5 for c in run):
            continue
        best = [0.0] * (n + 1)
        back: list[tuple[int, str]] = [(0, "")] * (n + 1)
        best[1:] = [_NEVER] * n
        units = False
        for k in range(n):
            if best[k] + clean[k] + 2.0 < best[k + 1]:
                best[k + 1], back[k + 1] = best[k] + clean[k] + 2.0, (k, run[k])
            y = _unit(run, k, codes)
            if y is not None:
                z = k + (2 if codes[run[k]] < 0xE0 else 3 if codes[run[k]] < 0xF0 else 4)
                if best[k] + _meaning_cost(y) < best[z]:
                    best[z], back[z] = best[k] + _meaning_cost(y), (k, y)
                    units = True
        if units:
            cost[s] = best[n]
            parts, k = [], n
            while k:
                k, piece = back[k]
                parts.append(piece)
            text[s] = "".join(reversed(parts))
    for s, pair in enumerate(SWAPPED, 1 + _N_WRONG):
        swap = _SWAP[pair]
        meant = [swap.get(c, c) for c in run]
        if meant == list(run):
            continue
        if pair[0] != "cp1252":
            c_total = _cyrillic_cost(before, run, meant, after, clean)
            if c_total is not None:
                cost[s], text[s] = c_total, "".join(meant)
            continue
        ring = [before, *meant, after]
        c_total = 0.0
        for i, (x, y) in enumerate(zip(run, meant)):
            if x not in swap:
                c_total += clean[i] + 3.0
            elif y.isalpha() and ord(y) >= 0xC0:
                c_total += 2.5 + (4.0 if y.isupper() and ring[i] and ring[i].islower() else 0.0)
                c_total += 2.0 if i and meant[i - 1].isalpha() and x.isalpha() else 0.0  # accents seldom stand side by side
            elif y in _TEXT_MARKS or y in "°ºª":
                c_total += 1.5 + _clean_cost(ring[i], y, ring[i + 2])
            else:
                c_total += _IMPLAUSIBLE
        cost[s] = c_total
        text[s] = "".join(meant)
    if n > 1 and (found := _as_utf16(run)):
        cost[_UTF16], text[_UTF16] = found
    gone = [x == "�" or "\x80" <= x < "\xa0" and x != "\x85" for x in run]
    lost = any(gone)
    # A control character behind the first byte of a sequence is rather the rest of it.
    rest = [i > 0 and g and x != "�" and 0xC2 <= ord(run[i - 1]) < 0xF5 for i, (x, g) in enumerate(zip(run, gone))]
    cost[_LOST] = sum(4.0 if r else 1.0 if g else c for c, g, r in zip(clean, gone, rest)) + 2.0 if lost else _NEVER
    if lost:
        text[_LOST] = run
    return cost, text


_CHANGES = np.full((len(STATES), len(STATES)), _CHANGE)
np.fill_diagonal(_CHANGES, 0.0)
_CHANGES[0, 1:], _CHANGES[1:, 0] = _ENTER_OTHER, _LEAVE
_CHANGES[0, 1 : 1 + _N_WRONG] = _ENTER_UTF8
# No change costs more than one by way of the clean state, so that a plain stretch in between makes none cheaper.
_CHANGES = np.minimum(_CHANGES, _CHANGES[:, :1] + _CHANGES[:1, :])


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For code points below 0x2600: states in which it begins or continues a sequence, and whether a word makes it odd."""
    lead, cont, odd = np.zeros(0x2600, np.uint16), np.zeros(0x2600, np.uint16), np.zeros(0x2600, bool)
    for s, e in enumerate(WRONG):
        for c, b in _BYTES[e].items():
            if ord(c) < 0x2600:
                if 0xC2 <= b < 0xF5:
                    lead[ord(c)] |= 1 << s
                elif b < 0xC0:
                    cont[ord(c)] |= 1 << s
    for pair in SWAPPED:
        for c, y in _SWAP[pair].items():
            if pair[0] == "cp1252" and ord(c) < 0x2600 and c != y and (y.isalpha() and ord(y) >= 0xC0):
                odd[ord(c)] = True
    return lead, cont, odd


_LEAD, _CONT, _ODD = _tables()
_UPPER = np.array([0xC0 <= o and chr(o).isupper() for o in range(0x250)])


def _odd_places(a: np.ndarray) -> np.ndarray:
    """Places of characters that a state other than the clean one might explain better."""
    at = np.flatnonzero(a > 0x7F)
    if not len(at):
        return at
    c = a[at]
    low = np.minimum(c, 0x25FF)
    low_c = np.where(c < 0x2600, low, 0)
    prev = np.where(at > 0, a[np.maximum(at - 1, 0)], 0x20)
    following = np.where(at + 1 < len(a), a[np.minimum(at + 1, len(a) - 1)], 0x20)
    next_c = np.where(following < 0x2600, np.minimum(following, 0x25FF), 0)
    found = (_LEAD[low_c] & _CONT[next_c]) != 0
    is_lower = lambda x: (x >= 0x61) & (x <= 0x7A)
    is_letter = lambda x: is_lower(x | 0x20) & (x < 0x80)
    letter = ((c >= 0xC0) & (c < 0x250) & (c != 0xD7) & (c != 0xF7)) | ((c >= 0x1E00) & (c < 0x1F00))
    upper = np.zeros(0x250, bool)
    upper[[o for o in range(0xC0, 0x250) if chr(o).isupper()]] = True
    found |= _ODD[low_c] & ~letter & (is_letter(prev) | is_letter(following))
    found |= _ODD[low_c] & letter & upper[np.minimum(c, 0x24F)] & is_lower(prev)
    found |= (c == 0xFFFD) | ((c >= 0x80) & (c < 0xA0))
    # Cyrillic in another one-byte encoding: three letters of Latin-1 in a row, or a Cyrillic capital behind a small letter.
    latin_1 = (c >= 0xC0) & (c < 0x100) & (c != 0xD7) & (c != 0xF7)
    row = latin_1[:-2] & latin_1[1:-1] & latin_1[2:] & (at[2:] - at[:-2] == 2)
    found[: max(len(at) - 2, 0)] |= row
    small = ((prev >= 0x430) & (prev < 0x450)) | (prev == 0x451)
    found |= (c >= 0x410) & (c < 0x430) & small
    pair = lambda x: (x >= 0x2000) & (x < 0x7F00) & ((x & 0xFF) >= 0x20) & ((x & 0xFF) < 0x7F)
    found |= pair(c) & pair(following)
    return at[found]


class Labeller:
    """Labels and restores texts; costs of short stretches are kept."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str, str], tuple[np.ndarray, list[str | None], bool]] = {}

    def _cost(self, before: str, run: str, after: str):
        key = (before, run, after)
        got = self._known.get(key)
        if got is None:
            sample = {"": "", "a": "a", "A": "A", "0": "0", ".": "."}
            cost, text = emissions(sample[before], run, sample[after])
            plain = cost[0] <= 3.5 * len(run) and cost[0] + 1.0 <= cost[1:].min()
            got = (cost, text, plain)
            if len(run) <= 24:
                if len(self._known) > _CACHE:
                    self._known.clear()
                self._known[key] = got
        return got

    def label(self, text: str) -> list[tuple[int, int, int, str]]:
        """The wrongly decoded stretches: from, to, state and restored text."""
        spans, steps, short = [], [], []
        n, k = len(text), 0
        for k, z in _stretches(text):
            cost, back, plain = self._cost(_context(text[k - 1]) if k else "", text[k:z], _context(text[z]) if z < n else "")
            if not plain:
                spans.append((k, z, back))
                steps.append(cost)
            elif z - k == 1 and not (k and text[k - 1].isalpha()) and not (z < n and text[z].isalpha()):
                short.append((k, z))
        if not spans:
            return []
        best = steps[0] + _CHANGES[0]
        froms = []
        for cost in steps[1:]:
            ways = best[:, None] + _CHANGES
            origin = ways.argmin(0)
            froms.append(origin)
            best = ways[origin, np.arange(len(STATES))] + cost
        state = int(best.argmin())
        path = [state]
        for origin in reversed(froms):
            state = int(origin[state])
            path.append(state)
        path.reverse()
        found = [(a, z, s, back[s]) for (a, z, back), s in zip(spans, path) if s and back[s] is not None and (back[s] != text[a:z] or s == _LOST)]
        return self._with_short_words(text, found, short) if short else found

    def _with_short_words(self, text: str, found: list, short: list[tuple[int, int]]) -> list[tuple[int, int, int, str]]:
        """Words of one letter close to a word of a Cyrillic state belong to that state if it makes them a word."""
        known = [f for f in found if f[2] in _CYRILLIC_STATES]
        if not known:
            return found
        starts = [f[0] for f in known]
        for a, z in short:
            k = bisect.bisect_left(starts, a)
            near = [f for f in known[max(k - 1, 0) : k + 1] if min(abs(f[0] - z), abs(a - f[1])) <= _NEAR_WORD]
            for f in near[:1]:
                letter = _SWAP[_CYRILLIC_STATES[f[2]]].get(text[a:z])
                if letter and letter.lower() in _ONE_LETTER_WORDS:
                    found.append((a, z, f[2], letter))
        return sorted(found)

    def restore(self, text: str) -> tuple[str, list[str], int, int]:
        """The restored text, the states used, the number of stretches, and of those that stay wrong."""
        states: list[str] = []
        stretches, before = 0, {text}
        while True:
            found = self.label(text)
            parts, at = [], 0
            for a, z, s, piece in found:
                parts += [text[at:a], piece]
                at = z
                if STATES[s] not in states:
                    states.append(STATES[s])
            fresh = "".join(parts) + text[at:]
            if not found or fresh in before:
                stretches = max(stretches, len(found))
                return text, states, stretches, len(found)
            stretches += len(found)
            before.add(fresh)
            text = fresh


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    outside = a > 0x7F
    edge = np.flatnonzero(np.diff(np.concatenate([[False], outside, [False]]).astype(np.int8)))
    return zip(edge[::2].tolist(), edge[1::2].tolist())


def label_batch(texts: list[str | None], labeller: Labeller) -> list[tuple[str | None, list[str], int, int]]:
    """Restored text, states, number of stretches and of those left for each text."""
    out: list[tuple[str | None, list[str], int, int]] = [(t, [], 0, 0) for t in texts]
    wide = [i for i, t in enumerate(texts) if t and not t.isascii()]
    if not wide:
        return out
    joined = "\n".join(texts[i] for i in wide)
    odd = _odd_places(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    ends = np.cumsum([len(texts[i]) + 1 for i in wide])
    for j in np.unique(np.searchsorted(ends, odd, side="right")).tolist():
        i = wide[j]
        out[i] = labeller.restore(texts[i])
    return out


def find_wrong_decoding(df: DataFrame, id_col: str, text_col: str, only_found: bool = False) -> DataFrame:
    """id, states, n_stretches, n_unrestored and restored text of each row; with ``only_found`` of the affected rows alone.

    The restored text is null where nothing was found, so that clean texts are not copied.
    """
    if id_col in ("states", "n_stretches", "n_unrestored", "restored"):
        raise ValueError("id_col has the name of a result column")
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        for batch in batches:
            found = label_batch(batch.column(1).to_pylist(), labeller)
            rows = [i for i, x in enumerate(found) if x[2] or not only_found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([found[i][1] for i in rows], pa.list_(pa.string())),
                    pa.array([found[i][2] for i in rows], pa.int32()),
                    pa.array([found[i][3] for i in rows], pa.int32()),
                    pa.array([found[i][0].encode("utf-8", "replace").decode() if found[i][2] else None for i in rows], pa.string()),
                ],
                names=[id_col, "states", "n_stretches", "n_unrestored", "restored"],
            )

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, states array<string>, n_stretches int, n_unrestored int, restored string")
