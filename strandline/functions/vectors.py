"""Vector and hash expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    """Mean of an array; null for an empty one."""
    return F.try_divide(_sum(F.transform(a, lambda x: x.cast("double"))), F.size(a))


def pixel_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long arrays."""
    return F.try_divide(_sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))), F.size(a))


def histogram_difference(a: Column, b: Column) -> Column:
    """(1 - Pearson correlation) / 2 within [0, 1]; 0 where either array is constant."""
    n = F.size(a).cast("double")
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    sx, sy = _sum(x), _sum(y)
    sxy = _sum(F.zip_with(x, y, lambda p, q: p * q))
    sxx, syy = _sum(F.transform(x, lambda p: p * p)), _sum(F.transform(y, lambda q: q * q))
    bottom = (n * sxx - sx * sx) * (n * syy - sy * sy)
    corr = F.when(bottom > 1e-18, (n * sxy - sx * sy) / F.sqrt(bottom)).otherwise(F.lit(1.0))
    return F.least(F.greatest((1 - corr) / 2, F.lit(0.0)), F.lit(1.0))


def scene_distance(pixel: Column, histogram: Column) -> Column:
    """Weighted change against the predecessor; 0 where there is none."""
    return F.coalesce(0.70 * pixel + 0.30 * histogram, F.lit(0.0))


def difference_hash(grid: Column, width: int, height: int) -> Column:
    """One bit for each pair of neighbours in a row (right greater than left), row by row, first bit highest."""
    at = F.sequence(F.lit(0), F.lit((width - 1) * height - 1))
    left = lambda i: (F.floor(i / (width - 1)) * width + i % (width - 1) + 1).cast("int")
    bits = F.transform(at, lambda i: F.when(F.element_at(grid, left(i) + 1) > F.element_at(grid, left(i)), 1).otherwise(0))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit.cast("long")))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two 64-bit hashes, which may be negative."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def bucket_keys(h: Column) -> Column:
    """The eight (offset, byte) keys of a hash; hashes within 7 bits share at least one."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda o: F.struct(o.alias("offset"), F.call_function("shiftrightunsigned", h, o * 8).bitwiseAND(F.lit(255)).cast("int").alias("byte")))


_PAIRS = [(i, j) for i in range(8) for j in range(i + 1, 8)]


def pair_keys(h: Column) -> Column:
    """A number for each two of the eight bytes: (first * 8 + second) << 16, and the bytes.

    Hashes within 6 bits share at least one.
    """
    byte = lambda o: F.call_function("shiftrightunsigned", h, o * 8).bitwiseAND(F.lit(255))
    pairs = F.array(*[F.lit(i * 8 + j) for i, j in _PAIRS])
    return F.transform(pairs, lambda p: p.cast("long") * 65536 + byte(F.floor(p / 8).cast("int")) * 256 + byte(p % 8))


_FLAG = [1 << (8 * o + 7) if o < 4 else 1 << (8 * (o - 4) + 6) for o in range(8)]


def equal_byte_flags(a: Column, b: Column) -> Column:
    """A flag for each byte in which two hashes agree (no branches, so it stays one small expression)."""
    x = a.bitwiseXOR(b)
    half = 0x7F7F7F7F

    def zeros(h: Column) -> Column:
        return F.bitwise_not((h.bitwiseAND(F.lit(half)) + half).bitwiseOR(h).bitwiseOR(F.lit(half))).bitwiseAND(F.lit(0x80808080))

    low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
    return zeros(low).bitwiseOR(F.shiftright(zeros(high), 1))


def pair_masks(key: Column) -> tuple[Column, Column]:
    """For a key of ``pair_keys``: the flags of all bytes up to its second, and those of its two."""
    number = F.shiftright(key, 16).cast("int") + 1
    upto, own = [0] * 64, [0] * 64
    for i, j in _PAIRS:
        upto[i * 8 + j], own[i * 8 + j] = sum(_FLAG[: j + 1]), _FLAG[i] | _FLAG[j]
    table = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), number)
    return table(upto), table(own)
