"""Portable float maps: three 32-bit floats a pixel, rows from bottom to top."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from lumera.schema import RGB
from lumera.sources.errors import FormatError, UnsupportedError
from lumera.sources.rows import Memory, encoded, gathered

UPWARDS = True


def read_header(data: bytes) -> tuple[dict, int]:
    """Header fields and the place of the raster."""
    lines, at = [], 0
    for _ in range(3):
        end = data.find(b"\n", at)
        if end < 0:
            raise FormatError("pfm: the header does not end")
        lines.append(data[at:end].strip())
        at = end + 1
    if lines[0] not in (b"PF", b"pf"):
        raise FormatError("pfm: no magic")
    try:
        width, height = (int(n) for n in lines[1].split())
        scale = float(lines[2])
    except ValueError as bad:
        raise FormatError("pfm: size or scale is no number") from bad
    if width <= 0 or height <= 0 or scale == 0 or not math.isfinite(scale):
        raise FormatError("pfm: size or scale out of range")
    if lines[0] == b"pf":
        raise UnsupportedError("pfm: grey maps")
    return {"width": width, "height": height, "model": RGB, "scale": scale}, at


def iter_rows(f, head: dict, at: int, y0: int, y1: int, step: int) -> Iterator[tuple[int, np.ndarray]]:  # noqa: ANN001
    """The rows ``y0`` to ``y1``, ``step`` at a time: the first one's number and channels as 32-bit floats.

    Only their bytes are read.
    """
    size = 12 * head["width"]
    for y in range(y0, y1, step):
        stop = min(y + step, y1)
        data = f.read_at((stop - y) * size, at + (head["height"] - stop) * size)
        if len(data) < (stop - y) * size:
            raise FormatError("pfm: the raster is cut short")
        raw = np.frombuffer(data, "<f4" if head["scale"] < 0 else ">f4").reshape(-1, head["width"], 3)[::-1]
        yield y, (raw.astype(np.float64) / abs(head["scale"])).astype(np.float32)


def decode(data: bytes) -> tuple[dict, np.ndarray]:
    """Header and channels (height, width, 3), as 32-bit floats."""
    head, at = read_header(data)
    return head, gathered(iter_rows, Memory(data), head, at)


def codec_options(options: dict[str, str]) -> dict:
    """There are no options."""
    return {}


def head(width: int, height: int, model: str = RGB) -> bytes:
    """The header of a file."""
    if model != RGB:
        raise UnsupportedError(f"pfm: colour model {model}")
    return b"PF\n%d %d\n-1.0\n" % (width, height)


def rows(values: np.ndarray, model: str = RGB) -> bytes:
    """Some rows of a file, the lowest first."""
    return np.ascontiguousarray(values[::-1], dtype="<f4").tobytes()


def encode(values: np.ndarray, model: str = RGB) -> bytes:
    """A little-endian float map of RGB channels."""
    return encoded(values, head, rows, model, UPWARDS)
