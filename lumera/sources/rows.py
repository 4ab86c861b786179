"""Reading and writing images by ranges of rows, in bounded memory.

A codec (a module, or an object with the same names) has ``read_header(data)``,
``iter_rows(f, head, at, y0, y1, step)``, ``head(width, height, model, ...)``,
``rows(values, model, ...)``, ``codec_options(options)`` and, if its rows run from the
bottom up, ``UPWARDS = True``. A file is its head and then the rows of its bands in
file order, so bands that are encoded apart and joined give the same bytes as the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Pixels of a band, the unit of encoding.
BAND_PIXELS = 1 << 16


def band_rows(width: int, pixels: int = BAND_PIXELS) -> int:
    """Rows of a band of an image of this width."""
    return max(1, pixels // width)


def band_order(height: int, per_band: int, upwards: bool = False) -> list[int]:
    """Numbers of the bands of an image in file order."""
    order = range(-(-height // per_band))
    return list(reversed(order)) if upwards else list(order)


def encoded(values: np.ndarray, head: Callable[..., bytes], rows: Callable[..., bytes], model: str, upwards: bool = False, pixels: int = BAND_PIXELS, **options) -> bytes:  # noqa: ANN003
    """A whole file, band by band."""
    h, w, _ = values.shape
    n = band_rows(w, pixels)
    return b"".join([head(w, h, model, **options), *[rows(values[b * n : (b + 1) * n], model, **options) for b in band_order(h, n, upwards)]])


def gathered(iter_rows: Callable[..., Iterator[tuple[int, np.ndarray]]], f, head: dict, at: int, y0: int = 0, y1: int | None = None) -> np.ndarray:  # noqa: ANN001
    """Channels of the rows ``y0`` to ``y1``, all by default."""
    y1 = head["height"] if y1 is None else y1
    parts = [v for _, v in iter_rows(f, head, at, y0, y1, max(1, y1 - y0))]
    return parts[0] if parts else np.zeros((0, head["width"], 3), np.float32)


class Memory:
    """Bytes in memory, read as a file is."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


class Stream:
    """The bytes of a file from a place on, read in pieces; ``at`` is the place of the next one."""

    def __init__(self, f, at: int, piece: int = 1 << 20) -> None:  # noqa: ANN001
        self.f, self.at, self.piece, self.end = f, at, piece, f.size()
        self.data, self.i = b"", 0

    def ahead(self, n: int) -> memoryview | bytes:
        """The next ``n`` bytes, fewer where the file ends; they stay next."""
        if len(self.data) - self.i < n and self.at + len(self.data) - self.i < self.end:
            held = self.data[self.i :]
            more = self.f.read_at(max(self.piece, n - len(held)), self.at + len(held))
            self.data, self.i = held + bytes(more), 0
        return self.data[self.i : self.i + n]

    def skip(self, n: int) -> None:
        self.i += n
        self.at += n

    def pieces(self) -> Iterator[bytes]:
        """All further bytes."""
        while data := self.ahead(self.piece):
            self.skip(len(data))
            yield bytes(data)
