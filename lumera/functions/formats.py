"""Pixel encodings: shared-exponent RGBE/XYZE, LogLuv, raw floats. Bytes are integers 0..255 in columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumera.functions.ieee import fdiv, log2


def from_radiance(b0: Column, b1: Column, b2: Column, e: Column, exposure: Column | float = 1.0) -> tuple[Column, Column, Column]:
    """Three values of a shared-exponent pixel; exponent 0 is black."""
    scale = F.pow(F.lit(2.0), (e - 136).cast("double")) / exposure
    return tuple(F.when(e == 0, 0.0).otherwise(b * scale) for b in (b0, b1, b2))


def exponent(v: Column) -> Column:
    """The whole number ``k`` with ``2**(k-1) <= v < 2**k``, for positive ``v``."""
    k = F.floor(F.log2(v)).cast("int") + 1
    return F.when(v >= F.pow(F.lit(2.0), k.cast("double")), k + 1).when(v < F.pow(F.lit(2.0), (k - 1).cast("double")), k - 1).otherwise(k)


def to_radiance(c1: Column, c2: Column, c3: Column) -> tuple[Column, Column, Column, Column]:
    """Mantissas and exponent of three values; nothing above 1e-32 is all zeros."""
    top = F.greatest(c1, c2, c3)
    lit = top > 1e-32
    k = exponent(F.when(lit, top))
    mantissa = top * F.pow(F.lit(2.0), -k.cast("double"))
    scale = mantissa * 256 / top
    cell = lambda c: F.when(lit, (c * scale).cast("int")).otherwise(0)
    return cell(c1), cell(c2), cell(c3), F.when(lit, k + 128).otherwise(0)


def luminance_to_word(y: Column) -> Column:
    """Sign and 15-bit logarithm of a luminance, 256 steps an octave; 0 is 0."""
    size = F.abs(y)
    step = F.floor(256 * (log2(F.when(size > 0, size)) + 64)).cast("int")
    return F.when(size > 0, F.when(y < 0, step.bitwiseOR(F.lit(32768))).otherwise(step)).otherwise(0)


def word_to_luminance(word: Column) -> Column:
    """Inverse of :func:`luminance_to_word`, at the middle of the step."""
    size = F.pow(F.lit(2.0), (word.bitwiseAND(F.lit(32767)) + 0.5) / 256 - 64)
    return F.when(word.bitwiseAND(F.lit(32768)) != 0, -size).otherwise(size)


def to_logluv(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column, Column]:
    """Luminance word as two bytes and the chromaticity bytes u, v."""
    size = x + 15 * F.abs(y) + 3 * z
    u, v = fdiv(4 * x, size), fdiv(9 * F.abs(y), size)
    cell = lambda c: F.when((c > 0) & ~F.isnan(c), F.least(F.lit(255), F.floor(F.least(c, F.lit(10.0)) * 410).cast("int"))).otherwise(0)
    high, low = split_word(luminance_to_word(y))
    return high, low, cell(u), cell(v)


def from_logluv(high: Column, low: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """X, Y, Z of a LogLuv pixel."""
    y = word_to_luminance(join_word(high, low))
    u, v = (u + 0.5) / 410, (v + 0.5) / 410
    s = 6 * u - 16 * v + 12
    lx, ly = 9 * u / s, 4 * v / s
    return lx / ly * F.abs(y), y, (1 - lx - ly) / ly * F.abs(y)


def split_word(word: Column) -> tuple[Column, Column]:
    """High and low byte."""
    return F.shiftright(word, 8).bitwiseAND(F.lit(255)), word.bitwiseAND(F.lit(255))


def join_word(high: Column, low: Column) -> Column:
    """A 16-bit word of two bytes."""
    return F.shiftleft(high.cast("int"), 8).bitwiseOR(low.cast("int"))


def to_bytes(c1: Column, c2: Column, c3: Column, big_endian: bool = False) -> Column:
    """Three 32-bit floats as 12 bytes."""

    def pack(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        rows = np.column_stack([a, b, c]).astype(">f4" if big_endian else "<f4")
        return pd.Series([r.tobytes() for r in rows])

    return F.pandas_udf(pack, "binary")(c1, c2, c3)


def from_bytes(data: Column, big_endian: bool = False) -> Column:
    """Three 32-bit floats of 12 bytes, as an array."""

    def unpack(raw: pd.Series) -> pd.Series:
        kind = ">f4" if big_endian else "<f4"
        return pd.Series([np.frombuffer(r, kind, 3).astype(np.float64) for r in raw])

    return F.pandas_udf(unpack, "array<double>")(data)
