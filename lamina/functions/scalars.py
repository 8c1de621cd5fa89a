"""Scalar functions as columns: hashes of names and pixels, names of files, freshness, a damped step of three unknowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where the 64-bit name hash starts, and what its prime adds to two to the 40.
FNV_START, FNV_PRIME_LOW = 1469598103934665603, 435
#: Multipliers of a pixel's place and frame, and of the mixed word.
PIXEL_X, PIXEL_Y, PIXEL_FRAME, PIXEL_MIX = 374761393, 668265263, 2246822519, 1274126177
_WORD = 0xFFFFFFFF


def fnv1a64(data: Column) -> Column:
    """The FNV-1a hash of bytes or of a text's UTF-8, as 16 hexadecimal digits; null of null.

    The hash is kept as two words of 32 bits, as its product doesn't fit into one long."""
    pairs = F.regexp_extract_all(F.hex(data.cast("binary")), F.lit("(..)"), F.lit(1))
    start = F.struct(F.lit(FNV_START >> 32).cast("long").alias("hi"), F.lit(FNV_START & _WORD).cast("long").alias("lo"))

    def step(h: Column, pair: Column) -> Column:
        low = h["lo"].bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        product = low * FNV_PRIME_LOW
        high = h["hi"] * FNV_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(_WORD).alias("hi"), product.bitwiseAND(_WORD).alias("lo"))

    return F.aggregate(pairs, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


def _times(a: Column, factor: int) -> Column:
    """A word times a factor, modulo two to the 32."""
    high = (F.shiftright(a, 16) * factor).bitwiseAND(0xFFFF)
    return (F.shiftleft(high, 16) + a.bitwiseAND(0xFFFF) * factor).bitwiseAND(_WORD)


def pixel_hash(x: Column, y: Column, frame: Column) -> Column:
    """A value from 0 to below 1 for each pixel and frame, the same on every machine."""
    word = lambda c: c.cast("long").bitwiseAND(_WORD)
    h = (_times(word(x), PIXEL_X) + _times(word(y), PIXEL_Y) + _times(word(frame), PIXEL_FRAME)).bitwiseAND(_WORD)
    h = _times(h.bitwiseXOR(F.shiftright(h, 13)), PIXEL_MIX)
    return F.shiftright(h, 8) / F.lit(16777216.0)


def basename(path: Column, most: int = 256) -> Column:
    """The last part of a path, slashes at its end passed over; null where there is none, or where it has ``most`` bytes or more: a shortened name would be another's."""
    name = F.regexp_extract(path, "([^/]+)/*$", 1)
    return F.when((name != "") & (F.octet_length(name) < most), name)


def fresh(size: Column, modified: Column, source: Column) -> Column:
    """Whether a file has bytes and isn't older than its source; a source without a time (null) doesn't count."""
    return F.coalesce((size > 0) & (source.isNull() | (modified >= source)), F.lit(False))


def finish_names(runs: DataFrame, finished: str, order: str) -> DataFrame:
    """With ``finish_name``: the second in which a run finished, and from the second run of one second on its number, in ``order``."""
    second = F.date_format(finished, "yyyyMMddHHmmss")
    nth = F.row_number().over(Window.partitionBy(second).orderBy(order))
    return runs.withColumn("finish_name", F.when(nth == 1, second).otherwise(F.concat(second, F.lit("-"), nth.cast("string"))))


def damped_step(a: Sequence[Column], b: Sequence[Column], damping: float) -> list[Column]:
    """The step that solves (A + damping * diag A) d = -b for a symmetric A, given as its upper triangle row by row; nulls where that is singular."""
    m = [c if k not in (0, 3, 5) else c + damping * F.greatest(c, F.lit(1e-12)) for k, c in enumerate(a)]
    xx, xy, xz, yy, yz, zz = m
    c = [yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy]
    det = xx * c[0] + xy * c[1] + xz * c[2]
    rows = ((c[0], c[1], c[2]), (c[1], c[3], c[4]), (c[2], c[4], c[5]))
    return [F.when(F.abs(det) >= 1e-30, -F.try_divide(sum((u * v for u, v in zip(r, b, strict=True)), F.lit(0.0)), det)) for r in rows]
