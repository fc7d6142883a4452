"""Deeply nested JSON records into related flat tables.

The records of an Arrow batch are indexed together with numpy: bitmaps of quotes, brackets and
delimiters are built over one byte buffer, nesting depth is a prefix sum over the brackets outside
strings, and spans of members are cut at the delimiters of their own container.  The index also says
whether a record is whole: brackets pair up, neighbouring tokens fit the grammar, and numbers, literals,
escapes and bytes are checked, all of it vectorised.  Nothing recurses, so depth and length have no limit.

Semantics (all of them are covered by tests):

* A record counts if its text is one whole JSON object, or a JSON string whose content is one.  Bare
  ``NaN`` is allowed, infinities are not.  Null, empty, broken, scalar and array records give no rows.
* Every array element that is an object gives one row, named by its path of zero-based places, its
  parent's path and its place.  Elements that are no objects give no row but keep their place.  An
  object in place of an array is its element 0.
* Lists of scalars give a row for each element that is a scalar and not null; maps one for each member, with its
  name; lone objects one row, named by the member.
* A member that occurs twice counts with its last value.
* Fields of a row are its direct members as text: strings decoded, other values as written, JSON null
  and absent members as null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import materialize

_QUOTE, _BACKSLASH, _COMMA, _COLON = 0x22, 0x5C, 0x2C, 0x3A
_OPEN = np.zeros(256, bool)
_OPEN[[0x7B, 0x5B]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[0x7D, 0x5D]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True


@dataclass(frozen=True)
class Child:
    """A member of the parent table's objects that becomes a table, and the fields to keep.

    ``kind``: ``array`` of objects, ``object`` (a lone one), ``values`` (an array of scalars, field ``value``) or
    ``map`` (a row for each member with field ``name``, and the fields of its object or its scalar as ``value``).
    """

    table: str
    member: str
    fields: dict[str, str] = field(default_factory=dict)
    children: tuple["Child", ...] = ()
    kind: str = "array"


@dataclass(frozen=True)
class Root:
    """The top object of a record."""

    table: str
    fields: dict[str, str] = field(default_factory=dict)
    children: tuple[Child, ...] = ()


def structural_index(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Bitmaps and depths of the records ``buf[starts[i]:ends[i]]``, which follow one another in ``buf``.

    Gives the positions of structural bytes outside strings (``pos``), their bytes, their records, the
    depth of the container each belongs to (a bracket belongs to the container it opens or closes) and,
    per position, the index of its container's opening bracket.
    """
    n = len(buf)
    # A byte is escaped when the run of backslashes before it has odd length.
    slash = buf == _BACKSLASH
    where = np.flatnonzero(slash)
    escaped = np.zeros(n + 1, bool)
    if len(where):
        first = np.ones(len(where), bool)
        first[1:] = np.diff(where) > 1
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, len(where)))
        last = where[at + length - 1]
        escaped[last[length % 2 == 1] + 1] = True
        # Within a run no backslash is a structural byte, so only the byte after it matters.
    quote = (buf == _QUOTE) & ~escaped[:n]
    inside = np.cumsum(quote, dtype=np.int32)
    record_of_byte_start = inside[starts - 1] if len(starts) else np.zeros(0, np.int32)
    record_of_byte_start = np.where(starts > 0, record_of_byte_start, 0)
    marks = np.flatnonzero(_OPEN[buf] | _CLOSE[buf] | (buf == _COMMA) | (buf == _COLON))
    record = np.searchsorted(ends, marks, side="right")
    keep = (inside[marks] - record_of_byte_start[record]) % 2 == 0
    pos, record = marks[keep], record[keep]
    byte = buf[pos]
    step = _OPEN[byte].astype(np.int32) - _CLOSE[byte].astype(np.int32)
    total = np.cumsum(step)
    before = total - step
    head = np.searchsorted(record, np.arange(len(starts)))
    base = np.where(head < len(before), before[np.minimum(head, max(len(before) - 1, 0))] if len(before) else 0, 0)
    depth = total - base[record] + (step < 0) if len(record) else total
    # The bytes of one container are consecutive among those of its record and depth, from its
    # opening bracket on: a stable sort by record and depth, then a count of the opening brackets.
    order = np.lexsort((pos, depth, record))
    opens = _OPEN[byte[order]]
    owner_rank = np.cumsum(opens) - 1
    open_at = order[opens]
    owner = np.full(len(pos), -1)
    ok = owner_rank >= 0
    owner[order[ok]] = open_at[owner_rank[ok]]
    return {"pos": pos, "byte": byte, "record": record, "depth": depth, "owner": owner}


class _Members:
    """Member spans of every container of a batch."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        x = structural_index(buf, starts, ends)
        self.buf, self.x = buf, x
        pos, byte, owner = x["pos"], x["byte"], x["owner"]
        is_open, is_close, is_colon = _OPEN[byte], _CLOSE[byte], byte == _COLON
        m = len(pos)
        order = np.lexsort((pos, owner))
        self.close = np.full(m, -1)
        closing = np.flatnonzero(is_close & (owner >= 0))
        self.close[owner[closing]] = pos[closing]
        # In this order each container is: bracket, (colon,) value, comma, ..., bracket.  A member runs
        # from a bracket or comma to the next comma or bracket of the container.
        o_pos, o_owner, o_byte = pos[order], owner[order], byte[order]
        o_colon = is_colon[order]
        cut = ~o_colon & (o_owner >= 0)
        c = np.flatnonzero(cut)
        if len(c) < 2:
            self.owner = self.lo = self.hi = self.colon = self.place = np.zeros(0, np.int64)
            return
        same = (o_owner[c[1:]] == o_owner[c[:-1]]) & ~_CLOSE[o_byte[c[:-1]]]
        left, right = c[:-1][same], c[1:][same]
        self.owner = o_owner[left]
        self.lo = o_pos[left] + 1
        self.hi = o_pos[right]
        has = right - left > 1
        self.colon = np.where(has, o_pos[np.minimum(left + 1, len(o_pos) - 1)], -1)
        first = np.ones(len(self.owner), bool)
        first[1:] = self.owner[1:] != self.owner[:-1]
        idx = np.arange(len(self.owner))
        self.place = idx - np.maximum.accumulate(np.where(first, idx, 0))

    def trimmed(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans without white space at their ends."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            go = (lo < hi) & _SPACE[self.buf[np.minimum(lo, len(self.buf) - 1)]]
            if not go.any():
                break
            lo[go] += 1
        while True:
            go = (lo < hi) & _SPACE[self.buf[np.maximum(hi - 1, 0)]]
            if not go.any():
                break
            hi[go] -= 1
        return lo, hi

    def named(self, owners: np.ndarray, name: str) -> np.ndarray:
        """For each container in ``owners`` the row of its last member called ``name``, or -1."""
        out = np.full(len(owners), -1)
        if not len(owners) or not len(self.owner):
            return out
        lookup = np.full(len(self.x["pos"]), -1)
        lookup[owners] = np.arange(len(owners))
        rows = np.flatnonzero((lookup[self.owner] >= 0) & (self.colon >= 0))
        lo, hi = self._key_spans(rows)
        raw = name.encode()
        want = np.frombuffer(raw, np.uint8)
        hit = hi - lo == len(want)
        for i, b in enumerate(want):
            at = np.flatnonzero(hit)
            hit[at[self.buf[lo[at] + i] != b]] = False
        # Keys written with escapes are compared after decoding.
        for r in self._escaped_keys(rows, lo, hi):
            try:
                hit[r] = json.loads(b'"' + self.buf[lo[r] : hi[r]].tobytes() + b'"') == name
            except ValueError:
                hit[r] = False
        found = rows[hit]
        out[lookup[self.owner[found]]] = found  # later members overwrite earlier ones
        return out

    def _key_spans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.trimmed(self.lo[rows], self.colon[rows])
        return lo + 1, np.maximum(hi - 1, lo + 1)

    def _escaped_keys(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        slashes = np.flatnonzero(self.buf == _BACKSLASH)
        if not len(slashes):
            return np.zeros(0, np.int64)
        k = np.searchsorted(slashes, lo)
        return np.flatnonzero((k < len(slashes)) & (slashes[np.minimum(k, len(slashes) - 1)] < hi))

    def values(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.trimmed(np.where(self.colon[rows] >= 0, self.colon[rows] + 1, self.lo[rows]), self.hi[rows])


_OBJECT, _ARRAY, _END_OBJECT, _END_ARRAY, _COMMA_T, _COLON_T, _STRING, _SCALAR, _KEY = range(9)
_CODE = np.full(256, -1, np.int8)
for _b, _c in ((0x7B, _OBJECT), (0x5B, _ARRAY), (0x7D, _END_OBJECT), (0x5D, _END_ARRAY), (_COMMA, _COMMA_T), (_COLON, _COLON_T)):
    _CODE[_b] = _c


def _grammar() -> np.ndarray:
    """Whether a token may follow another: container (0 object, 1 array), the one before (a key is a token of its own), the token."""
    ok = np.zeros((2, 9, 8), bool)
    value = [_OBJECT, _ARRAY, _STRING, _SCALAR]
    ok[0, _OBJECT, [_STRING, _END_OBJECT]] = ok[0, _COMMA_T, _STRING] = ok[0, _COLON_T, value] = ok[0, _KEY, _COLON_T] = True
    ok[1, _ARRAY, [*value, _END_ARRAY]] = ok[1, _COMMA_T, value] = True
    for before in (_STRING, _SCALAR, _END_OBJECT, _END_ARRAY):
        ok[0, before, [_COMMA_T, _END_OBJECT]] = ok[1, before, [_COMMA_T, _END_ARRAY]] = True
    return ok


def _number_states() -> np.ndarray:
    """States of a number: 0 start, 1 sign, 2 zero, 3 digits, 4 point, 5 fraction, 6 e, 7 sign, 8 exponent, 9 no number."""
    to = np.full((10, 256), 9, np.int8)
    digits = np.arange(0x30, 0x3A)
    to[0, 0x2D] = 1
    for state in (0, 1):
        to[state, digits] = 3
        to[state, 0x30] = 2
    to[3, digits] = 3
    to[[2, 3], 0x2E] = 4
    to[4, digits] = to[5, digits] = 5
    for e in (0x45, 0x65):
        to[[2, 3, 5], e] = 6
    to[6, [0x2B, 0x2D]] = 7
    for state in (6, 7, 8):
        to[state, digits] = 8
    return to


_FOLLOWS, _NUMBER = _grammar(), _number_states()
_NUMBER_TEXT = re.compile(rb"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


def _scalars_fit(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each scalar is a number, true, false, null or NaN."""
    good = np.zeros(len(lo), bool)
    for word in (b"true", b"false", b"null", b"NaN"):
        same = hi - lo == len(word)
        for i, b in enumerate(word):
            same[same] = buf[lo[same] + i] == b
        good |= same
    rest = np.flatnonzero(~good)
    for k in rest[hi[rest] - lo[rest] > 64].tolist():
        good[k] = _NUMBER_TEXT.fullmatch(buf[lo[k] : hi[k]].tobytes()) is not None
    rest = rest[hi[rest] - lo[rest] <= 64]
    state, at = np.zeros(len(rest), np.int8), lo[rest].copy()
    going = np.arange(len(rest))
    while len(going):
        state[going] = _NUMBER[state[going], buf[at[going]]]
        at[going] += 1
        going = going[(at[going] < hi[rest[going]]) & (state[going] != 9)]
    good[rest] = np.isin(state, (2, 3, 5, 8))
    return good


def whole_objects(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the records ``buf[starts[i]:ends[i]]`` are one whole JSON object; the records follow one another."""
    n, count = len(buf), len(starts)
    record_of = np.repeat(np.arange(count), ends - starts)
    bad = np.zeros(count, bool)
    slash = np.flatnonzero(buf == _BACKSLASH)
    starting = slash[:0]
    quote = buf == _QUOTE
    if len(slash):
        first = np.ones(len(slash), bool)
        first[1:] = (np.diff(slash) > 1) | (record_of[slash[1:]] != record_of[slash[:-1]])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
        starting = slash[(np.arange(len(slash)) - begin) % 2 == 0]  # those that escape the byte after them
        inside_record = starting + 1 < ends[record_of[starting]]
        bad[record_of[starting[~inside_record]]] = True
        starting = starting[inside_record]
        quote[starting + 1] = False
    run = np.cumsum(quote, dtype=np.int64)
    base = np.where(starts > 0, run[np.maximum(starts - 1, 0)], 0)
    inside = (run - base[record_of]) % 2 == 1
    last = np.where(ends > starts, run[np.maximum(ends - 1, 0)] - base, 0)
    bad |= last % 2 == 1
    # Strings: no control characters, sound escapes.
    bad[record_of[np.flatnonzero(inside & (buf < 0x20))]] = True
    if len(starting):
        bad[record_of[starting[~_ESCAPES[buf[starting + 1]] | ~inside[starting]]]] = True
        u = starting[buf[starting + 1] == 0x75]
        for k in range(2, 6):
            at = np.minimum(u + k, n - 1)
            bad[record_of[u[(u + k >= ends[record_of[u]]) | ~_HEX[buf[at]]]]] = True
    # Tokens: structural bytes, strings by their opening quotes, scalars by their first bytes.
    structural = ~inside & (_CODE[buf] >= 0)
    scalar = ~inside & ~quote & ~structural & ~_SPACE[buf]
    begins = scalar.copy()
    begins[1:] &= ~scalar[:-1] | (record_of[1:] != record_of[:-1])
    stops = scalar.copy()
    stops[:-1] &= ~scalar[1:] | (record_of[1:] != record_of[:-1])
    lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    bad[record_of[lo[~_scalars_fit(buf, lo, hi)]]] = True
    token = structural | begins | (quote & inside)
    pos = np.flatnonzero(token)
    rec = record_of[pos]
    code = np.where(structural[pos], _CODE[buf[pos]], np.where(begins[pos], _SCALAR, _STRING)).astype(np.int64)
    tokens = np.bincount(rec, minlength=count)
    bad |= tokens < 2
    if not len(pos):
        return ~bad
    opens, closes = code <= _ARRAY, (code == _END_OBJECT) | (code == _END_ARRAY)
    step = opens.astype(np.int64) - closes
    total = np.cumsum(step)
    head = np.concatenate([[True], rec[1:] != rec[:-1]])
    offset = np.zeros(count, np.int64)
    offset[rec[head]] = (total - step)[head]
    depth = total - offset[rec] + closes  # a bracket belongs to the container it opens or closes
    tail = np.concatenate([head[1:], [True]])
    bad[rec[depth < 1]] = True
    bad[rec[head & (code != _OBJECT)]] = True
    bad[rec[tail & ((code != _END_OBJECT) | (depth != 1))]] = True
    bad[rec[opens & (depth == 1) & ~head]] = True
    order = np.lexsort((pos, depth, rec))
    opener = order[np.maximum.accumulate(np.where(opens[order], np.arange(len(order)), 0))]
    owner = np.empty(len(pos), np.int64)
    owner[order] = opener
    container = np.where(code[owner] == _ARRAY, 1, 0)
    bad[rec[(rec[owner] != rec) | ~opens[owner] | (depth[owner] != depth)]] = True
    bad[rec[closes & (code - 2 != code[owner])]] = True
    before, t = np.arange(len(pos) - 1), np.arange(1, len(pos))
    key = (code == _STRING) & (container == 0)
    key[t] &= np.isin(code[before], (_OBJECT, _COMMA_T))
    context = np.where(opens[t], container[before], container[t])
    fits = _FOLLOWS[context, np.where(key[before], _KEY, code[before]), code[t]] & ~(opens[t] & closes[before])
    bad[rec[t[~fits & ~head[t]]]] = True
    return ~bad


def _candidate(text: bytes) -> bytes | None:
    """The text that should be an object: the record itself, or the content of the JSON string that it is."""
    for _ in range(2):
        text = text.removeprefix(b"\xef\xbb\xbf").strip(b" \t\r\n")
        if text[:1] == b"{":
            return text
        if text[:1] != b'"':
            return None
        try:
            text = json.loads(text).encode("utf-8", "surrogatepass")  # one string: nothing nested to parse
        except ValueError:
            return None
    return None


def _is_utf8(text: bytes) -> bool:
    try:
        text.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return False
    return True


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts, ends


def whole_records(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers and object texts of the records that count."""
    known = [(i, c) for i, t in enumerate(texts) if t and (c := _candidate(t)) is not None]
    if known and not _is_utf8(b"".join(c for _, c in known)):
        known = [(i, c) for i, c in known if _is_utf8(c)]
    if not known:
        return np.zeros(0, np.int64), []
    good = np.flatnonzero(whole_objects(*_buffer([c for _, c in known]))).tolist()
    return np.array([known[k][0] for k in good], np.int64), [known[k][1] for k in good]


@dataclass
class Rows:
    """Rows of one table of a batch: record numbers, paths, parents' paths, places, and the fields as rows of (row, name, text)."""

    table: str
    record: np.ndarray
    node: pa.Array
    parent: pa.Array
    place: np.ndarray
    field_row: np.ndarray
    field_name: pa.Array
    field_text: pa.Array

    def fields(self) -> pa.MapArray:
        order = np.argsort(self.field_row, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(self.field_row, minlength=len(self.record)))]).astype(np.int32)
        at = pa.array(order)
        return pa.MapArray.from_arrays(pa.array(offsets), self.field_name.take(at), self.field_text.take(at))


def _texts(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The values in the spans as text, strings without quotes and decoded."""
    quoted = buf[np.minimum(lo, len(buf) - 1)] == _QUOTE
    lo, hi = lo + quoted, hi - quoted
    length = hi - lo
    ends = np.cumsum(length)
    at = np.repeat(lo - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    data = buf[at]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    raw = pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    slashes = np.concatenate([[0], np.cumsum(data == _BACKSLASH)])
    special = np.flatnonzero(quoted & (slashes[offsets[1:]] > slashes[offsets[:-1]]))
    # A lone surrogate, written as bytes or as an escape, cannot be kept: it becomes a replacement character.
    if _is_utf8_strict(data):
        text = raw.cast(pa.large_string()).cast(pa.string())
    else:
        text = pa.array([r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.string())
    if len(special):
        decoded = pa.array([json.loads(b'"' + r + b'"').encode("utf-8", "replace").decode() for r in raw.take(pa.array(special)).to_pylist()], pa.string())
        place = np.arange(len(lo))
        place[special] = len(lo) + np.arange(len(special))
        text = pa.concat_arrays([text, decoded]).take(pa.array(place))
    return text


def _is_utf8_strict(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def flatten_batch(texts: list[bytes | None], root: Root) -> list[Rows]:
    """Rows of all tables of one batch."""
    number, whole = whole_records(texts)
    if not len(number):
        return []
    buf, starts, ends = _buffer(whole)
    m = _Members(buf, starts, ends)
    x = m.x
    top = np.flatnonzero(_OPEN[x["byte"]] & (x["depth"] == 1))  # one per record, in order
    at_byte = np.full(len(buf) + 1, -1)
    opening = np.flatnonzero(_OPEN[x["byte"]])
    at_byte[x["pos"][opening]] = opening
    out: list[Rows] = []

    def is_null(lo: np.ndarray) -> np.ndarray:
        return buf[np.minimum(lo, len(buf) - 1)] == 0x6E  # n of null, as the record is sound

    def fields_of(containers: np.ndarray, names: dict[str, str], rows: np.ndarray | None = None) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        found_fields = []
        for name in names:
            found = m.named(containers, name)
            has = np.flatnonzero(found >= 0)
            lo, hi = m.values(found[has])
            some = ~is_null(lo)
            found_fields.append(((has if rows is None else rows[has])[some], name, lo[some], hi[some]))
        return found_fields

    def add(table: str, record: np.ndarray, node: pa.Array, parent: pa.Array, place: np.ndarray, spans: list, names: list | None = None) -> None:
        row = np.concatenate([s[0] for s in spans]) if spans else np.zeros(0, np.int64)
        lo = np.concatenate([s[2] for s in spans]) if spans else np.zeros(0, np.int64)
        hi = np.concatenate([s[3] for s in spans]) if spans else np.zeros(0, np.int64)
        label = np.repeat(np.arange(len(spans)), [len(s[0]) for s in spans])
        text = _texts(buf, lo, hi)
        name = pa.array([s[1] for s in spans], pa.string()).take(pa.array(label, pa.int64()))
        if names is not None:  # the member names of a map
            row = np.concatenate([np.arange(len(record)), row])
            name = pa.concat_arrays([pa.array(["name"] * len(record), pa.string()), name])
            text = pa.concat_arrays([names, text])
        out.append(Rows(table, record, node, parent, place, row, name, text))

    def path(above: pa.Array, *parts) -> pa.Array:
        tail = pc.binary_join_element_wise(*parts, "/") if len(parts) > 1 else parts[0]
        return pc.if_else(pc.equal(above, ""), tail, pc.binary_join_element_wise(above, tail, "/"))

    def descend(child: Child, containers: np.ndarray, records: np.ndarray, paths: pa.Array) -> None:
        found = m.named(containers, child.member)
        has = np.flatnonzero(found >= 0)
        if not len(has):
            return
        lo, hi = m.values(found[has])
        inner = at_byte[lo]
        is_array, is_object = (inner >= 0) & (buf[lo] == 0x5B), (inner >= 0) & (buf[lo] == 0x7B)
        # Members of the arrays (or of the maps), each with the row of its parent.
        owner_of = np.full(len(x["pos"]), -1)
        if child.kind == "map":
            owner_of[inner[is_object]] = has[is_object]
        elif child.kind != "object":
            owner_of[inner[is_array]] = has[is_array]
        rows = np.flatnonzero(owner_of[m.owner] >= 0) if len(m.owner) else np.zeros(0, np.int64)
        if child.kind == "map":
            rows = rows[m.colon[rows] >= 0]
        e_lo, e_hi = m.values(rows)
        some = e_lo < e_hi
        rows, e_lo, e_hi = rows[some], e_lo[some], e_hi[some]
        e_open = at_byte[e_lo]
        e_object = (e_open >= 0) & (buf[e_lo] == 0x7B)
        parent, place = owner_of[m.owner[rows]], m.place[rows]
        names = None
        if child.kind == "values":
            scalar = (e_open < 0) & ~is_null(e_lo)
            lone = (inner < 0) & ~is_null(lo)
            parent, place = np.concatenate([parent[scalar], has[lone]]), np.concatenate([place[scalar], np.zeros(lone.sum(), np.int64)])
            element = np.full(len(parent), -1)
            v_lo, v_hi = np.concatenate([e_lo[scalar], lo[lone]]), np.concatenate([e_hi[scalar], hi[lone]])
        elif child.kind == "map":
            k_lo, k_hi = m.trimmed(m.lo[rows], m.colon[rows])
            names = _texts(buf, k_lo, k_hi)
            # A name that occurs twice counts with its last value, at its last place.
            key = pa.table({"p": pa.array(parent), "n": names, "r": pa.array(np.arange(len(rows)))}).group_by(["p", "n"]).aggregate([("r", "max")])
            last = np.sort(key["r_max"].to_numpy())
            parent, place, element, names = parent[last], place[last], np.where(e_object, e_open, -1)[last], names.take(pa.array(last))
            v_lo, v_hi = e_lo[last], e_hi[last]
        elif child.kind == "object":
            parent, place, element = has[is_object], np.zeros(is_object.sum(), np.int64), inner[is_object]
        else:
            parent = np.concatenate([parent[e_object], has[is_object]])
            place = np.concatenate([place[e_object], np.zeros(is_object.sum(), np.int64)])
            element = np.concatenate([e_open[e_object], inner[is_object]])
        if not len(parent):
            return
        order = np.lexsort((place, parent))
        element, parent, place = element[order], parent[order], place[order]
        above = paths.take(pa.array(parent))
        member = pa.scalar(child.member)
        if child.kind == "object":
            own = path(above, pa.array([child.member] * len(parent), pa.string()))
        elif child.kind == "map":
            names = names.take(pa.array(order))
            own = path(above, member, names)
        else:
            own = path(above, member, pa.array(place).cast(pa.string()))
        objects = np.flatnonzero(element >= 0)
        spans = fields_of(element[objects], child.fields, objects)
        if child.kind in ("values", "map"):
            v_lo, v_hi = v_lo[order], v_hi[order]
            plain = np.flatnonzero((element < 0) & ~is_null(v_lo) & (buf[v_lo] != 0x5B))
            spans.append((plain, "value", v_lo[plain], v_hi[plain]))
        add(child.table, records[parent], own, above, place, spans, names)
        for c in child.children:
            descend(c, element[objects], records[parent][objects], own.take(pa.array(objects)))

    records = number[x["record"][top]]
    none = pa.array([""] * len(top), pa.string())
    add(root.table, records, none, pa.nulls(len(top), pa.string()), np.zeros(len(top), np.int64), fields_of(top, root.fields))
    for child in root.children:
        descend(child, top, records, none)
    return out


NODE_SCHEMA = T.StructType(
    [
        T.StructField("record_key", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("parent_node", T.StringType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)


def explode_records(df: DataFrame, key_col: str, json_col: str, root: Root) -> DataFrame:
    """One linked row for each object of ``root``'s tables in ``json_col``, keyed by ``key_col``.

    ``key_col`` should identify a record (see ``latest_records``); rows with a null key give no rows,
    as their children could not name a parent.  Other columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for r in flatten_batch(texts, root):
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(r.record)).cast(pa.string()), pa.array([r.table] * len(r.record), pa.string()), r.node, r.parent, pa.array(r.place, pa.int32()), r.fields()],
                    names=NODE_SCHEMA.names,
                )

    slim = df.select(F.col(key_col).cast("string").alias("_key"), F.col(json_col).cast("string").alias("_json"))
    return slim.filter(F.col("_key").isNotNull() & F.col("_json").isNotNull()).mapInArrow(run, NODE_SCHEMA)


def latest_records(df: DataFrame, key_col: str, order_col: str, json_col: str) -> DataFrame:
    """The row of each key with the greatest ``order_col`` (nulls are least; equal ones: greatest text).

    ``max_by`` is aggregated before the shuffle, so a key with many rows sends one row per partition.
    """
    rank = F.struct(F.col(order_col).isNotNull(), F.col(order_col), F.coalesce(F.col(json_col), F.lit("")))
    return df.groupBy(F.col(key_col).alias("_key")).agg(F.max_by(F.col(json_col), rank).alias("_json"))


def related_tables(nodes: DataFrame, root: Root) -> dict[str, DataFrame]:
    """The flat tables of ``explode_records``: record_key, node, parent_node, place and typed fields.

    A field that cannot be cast to its type is null.  ``nodes`` is written once, in one folder for each table,
    so that a reader scans its own table only.
    """
    kept = materialize(nodes, "nodes", partition="table_name")
    out: dict[str, DataFrame] = {}

    def add(name: str, fields: dict[str, str]) -> None:
        typed = [F.col("fields")[f].try_cast(t).alias(f) for f, t in fields.items()]
        out[name] = kept.filter(F.col("table_name") == name).select("record_key", "node", "parent_node", "place", *typed)

    def walk(c: Child | Root) -> None:
        add(c.table, c.fields)
        for sub in c.children:
            walk(sub)

    walk(root)
    return out


REPORT = Root(
    "reports",
    {
        "video": "string",
        "selection_mode": "string",
        "requested": "int",
        "saved": "int",
        "rejected_blurry": "int",
        "rejected_motion_blur": "int",
        "rejected_duplicate": "int",
        "rejected_duplicate_cross_run": "int",
        "cache_hit": "boolean",
        "error": "string",
    },
    (
        Child(
            "scenes",
            "scenes",
            {"scene": "int", "start": "double", "end": "double"},
            (
                Child("cuts", "cut", {"score": "double", "confirmations": "int"}, (Child("flashes", "flash", {"ratio": "double", "bright": "double"}, kind="object"),), "object"),
                Child(
                    "frames",
                    "frames",
                    {"ts": "double", "file": "string", "hash": "string", "sharpness": "double"},
                    (
                        Child("tags", "tags", {"value": "string"}, kind="values"),
                        Child(
                            "rejections",
                            "rejections",
                            {"reason": "string", "value": "double", "limit": "double"},
                            (Child("rejected_against", "against", {"ts": "double", "distance": "int"}, kind="object"),),
                        ),
                    ),
                ),
            ),
        ),
        Child(
            "attempts",
            "attempts_log",
            {"attempt": "int", "seconds": "double"},
            (
                Child(
                    "errors",
                    "error",
                    {"code": "string", "message": "string", "retryable": "boolean"},
                    (Child("causes", "cause", {"kind": "string"}, (Child("trace", "trace", {"fn": "string", "line": "int"}),), "object"),),
                    "object",
                ),
            ),
        ),
        Child("stage_timings", "stage_timings", {"name": "string", "ms": "double", "count": "int"}, kind="map"),
        Child("shortfall_reasons", "shortfall_reasons", {"name": "string", "value": "int"}, kind="map"),
        Child("resources", "resource_guard", {"name": "string", "free_mb": "bigint", "free_gb": "double", "ok": "boolean"}, kind="map"),
        Child("manifests", "manifest_validation", {"status": "string"}, (Child("missing_files", "missing", {"value": "string"}, kind="values"),), "object"),
        Child("scene_times", "scene_times", {"value": "double"}, kind="values"),
        Child("selected_times", "selected_times", {"value": "double"}, kind="values"),
        Child("fallback_reasons", "forced_fallback_reasons", {"value": "string"}, kind="values"),
        Child(
            "previous_runs",
            "previous",
            {"run": "string"},
            (Child("previous_scenes", "scenes", {"scene": "int", "start": "double"}, (Child("previous_frames", "frames", {"ts": "double", "file": "string"}),)),),
            "object",
        ),
    ),
)
#: The tables whose rows are objects of nested arrays reached from the top of a report.
NESTED_TABLES = ("scenes", "frames", "rejections", "attempts")


def report_nodes(queue_items: DataFrame, root: Root = REPORT) -> DataFrame:
    """All linked rows of the latest report of each queue item."""
    latest = latest_records(queue_items.select("item_id", "updated_at", "report_json"), "item_id", "updated_at", "report_json")
    return explode_records(latest, "_key", "_json", root)
