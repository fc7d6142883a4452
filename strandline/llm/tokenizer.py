"""Encoding a corpus with a byte-level BPE vocabulary by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be merged across, so the text
may be cut there.  Cuts are found for a whole Arrow batch at once with a table of the 65,536 pairs.  The
fragments are dictionary-encoded, each distinct fragment is encoded once per worker, and the ids are
put together again with array arithmetic.

The pre-splitting pattern of the vocabulary adds two rules to the table, so that fragments split as they
would in the whole text (the pattern looks ahead only after white space, and treats an apostrophe with
certain letters as one piece): no cut after white space, and none before an apostrophe unless a letter
or digit precedes it.  A cut inside a character is never made.

Defined cases: null and empty texts have no ids; strings that look like special tokens are ordinary
text; bytes that are no UTF-8 are read as U+FFFD.  One row comes out for each row that goes in.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-splitting pattern that belongs to this public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CACHE_FRAGMENTS = 400_000

_ENCODERS: dict[str, "ForcedBoundaryEncoder"] = {}


def _spaces() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
    return out


def pair_table(tokens: list[bytes]) -> np.ndarray:
    """Whether a text may be cut between two bytes (index: first * 256 + second)."""
    joined = np.frombuffer(b"".join(tokens), np.uint8).astype(np.uint16)
    inner = np.ones(len(joined), bool)
    inner[np.cumsum([len(t) for t in tokens]) - 1] = False
    at = np.flatnonzero(inner[:-1])
    free = np.ones(65536, bool)
    free[(joined[at] << 8) | joined[at + 1]] = False
    free = free.reshape(256, 256)
    free[:, 0x80:0xC0] = False  # inside a character
    free[_spaces(), :] = False
    alnum = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]
    keep = free[alnum, 0x27].copy()
    free[:, 0x27] = False
    free[alnum, 0x27] = keep
    return free.reshape(-1)


class ForcedBoundaryEncoder:
    """Encodes batches of texts; one lives in each worker."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines()) if t}
        self._bpe = tiktoken.Encoding("forced", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._free = pair_table(list(ranks))
        self._number: dict[bytes, int] = {}
        self._flat: list[np.ndarray] = []
        self._length = np.zeros(0, np.int64)

    @classmethod
    def shared(cls, vocabulary: bytes, pattern: str) -> "ForcedBoundaryEncoder":
        key = hashlib.sha1(vocabulary + pattern.encode()).hexdigest()
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(vocabulary, pattern)
        return _ENCODERS[key]

    def whole(self, text: str) -> list[int]:
        """The ids of a text encoded in one piece."""
        return self._bpe.encode_ordinary(text)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in ``data`` before which it may be cut."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        pairs = (data[:-1].astype(np.uint16) << 8) | data[1:]
        at = np.flatnonzero(self._free[pairs])
        # White space of more than one byte: look at the bytes that end the character on the left.
        wide = at[data[at] >= 0x80]
        b1, b2, b3 = data[wide], data[np.maximum(wide - 1, 0)], data[np.maximum(wide - 2, 0)]
        space = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        space |= (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
        space |= (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)
        space |= (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)
        space |= (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)
        if space.any():
            at = np.setdiff1d(at, wide[space], assume_unique=True)
        return at + 1

    def fragments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The fragments of all texts in order, and for each text the number of those before it (and the total)."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = int(bounds[0]), int(bounds[-1])
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
        edge = bounds - lo
        starts = np.zeros(len(data) + 1, bool)
        starts[self.cuts(data)] = True
        starts[edge] = True
        starts[len(data)] = True
        at = np.flatnonzero(starts)
        offsets = pa.py_buffer(at.astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, offsets, pa.py_buffer(data)])
        return pieces, np.searchsorted(at, edge)

    def _numbers(self, distinct: list[bytes]) -> np.ndarray:
        """The numbers under which the ids of the fragments are kept; new fragments are encoded."""
        if len(self._number) > CACHE_FRAGMENTS:
            self._number, self._flat, self._length = {}, [], np.zeros(0, np.int64)
        known = self._number
        fresh = [p for p in distinct if p not in known]
        if fresh:
            encode = self._bpe.encode_ordinary
            ids = [encode(p.decode("utf-8", "replace")) for p in fresh]
            base = len(known)
            known.update(zip(fresh, range(base, base + len(fresh))))
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._flat.append(np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())))
            self._flat = [np.concatenate(self._flat)]
            self._length = np.concatenate([self._length, lengths])
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        pieces, edge = self.fragments(texts)
        if not len(pieces):
            return np.zeros(len(texts), np.int64)
        coded = pieces.dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        total = np.concatenate([[0], np.cumsum(self._length[number])])
        return np.diff(total[edge])

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, as an array of lists."""
        pieces, edge = self.fragments(texts)
        if not len(pieces):
            return pa.array([[]] * len(texts), pa.list_(pa.int32()))
        coded = pieces.dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        length = self._length[number]
        first = (np.cumsum(self._length) - self._length)[number]
        end = np.cumsum(length)
        at = np.arange(end[-1]) + np.repeat(first - (end - length), length)
        offsets = np.concatenate([[0], end])[edge].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self._flat[0][at], pa.int32()))


def _prepared(df: DataFrame, id_col: str, text_col: str, vocabulary_path: str):
    with open(vocabulary_path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())  # a fixed file, below 1 MB
    key: Column = F.col(id_col)
    return vocabulary, df.select(key.alias("_id"), F.col(text_col).cast("string").alias("_text"))


def encode_corpus(
    df: DataFrame, id_col: str, text_col: str, ids_col: str = "ids", vocabulary_path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN
) -> DataFrame:
    """``id_col`` and the token ids of ``text_col``, one row for each row of ``df``; null and empty texts give []."""
    if id_col == ids_col:
        raise ValueError("ids_col must differ from id_col")
    vocabulary, slim = _prepared(df, id_col, text_col, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ForcedBoundaryEncoder.shared(vocabulary.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.encode(batch.column(1))], names=[id_col, ids_col])

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>")


def count_tokens(
    df: DataFrame, id_col: str, text_col: str, size_col: str = "n_tokens", vocabulary_path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN
) -> DataFrame:
    """``id_col`` and the number of token ids of ``text_col``; 0 for null and empty texts."""
    if id_col == size_col:
        raise ValueError("size_col must differ from id_col")
    vocabulary, slim = _prepared(df, id_col, text_col, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ForcedBoundaryEncoder.shared(vocabulary.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(encoder.lengths(batch.column(1)), pa.int64())], names=[id_col, size_col]
            )

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, `{size_col}` bigint")
