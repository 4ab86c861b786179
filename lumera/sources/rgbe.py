"""Radiance files: shared-exponent RGB or XYZ, flat or run-length encoded rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from lumera.schema import RGB, XYZ
from lumera.sources.errors import FormatError, UnsupportedError
from lumera.sources.rows import Memory, Stream, encoded, gathered

# Fixed values of the format.
MAGIC = (b"#?RADIANCE", b"#?RGBE", b"#?AUTOPANO")
MODELS = {"32-bit_rle_rgbe": RGB, "32-bit_rle_xyze": XYZ}
SIZE = re.compile(rb"-Y (\d+) \+X (\d+)")


def read_header(data: bytes) -> tuple[dict, int]:
    """Header fields and the place of the first row."""
    at, magic, model, exposure = 0, False, RGB, 1.0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise FormatError("rgbe: the header does not end")
        line, at = data[at:end].rstrip(b"\r"), end + 1
        if not line:
            break
        if line in MAGIC:
            magic = True
        elif line.startswith(b"FORMAT="):
            name = line[7:].decode("latin-1").strip()
            if name not in MODELS:
                raise UnsupportedError(f"rgbe: format {name}")
            model = MODELS[name]
        elif line.startswith(b"EXPOSURE="):
            try:
                exposure = float(line[9:])
            except ValueError as bad:
                raise FormatError("rgbe: exposure is no number") from bad
    if not magic:
        raise FormatError("rgbe: no magic line")
    end = data.find(b"\n", at)
    size = SIZE.fullmatch(data[at:end].strip()) if end >= 0 else None
    if not size:
        raise FormatError("rgbe: no size in the order -Y +X")
    if not 1e-12 <= exposure <= 1e12:
        exposure = 1.0
    return {"width": int(size[2]), "height": int(size[1]), "model": model, "exposure": exposure}, end + 1


def _plane(data: bytes, at: int, width: int) -> tuple[bytearray, int]:
    """One channel of a row from its runs, and the place behind them."""
    out = bytearray()
    while len(out) < width:
        if at + 1 >= len(data):
            raise FormatError("rgbe: a run-length row is cut short")
        n = data[at]
        if n > 128:
            out += data[at + 1 : at + 2] * (n - 128)
            at += 2
        else:
            n = max(n, 1)
            if at + 1 + n > len(data):
                raise FormatError("rgbe: a run goes beyond the file")
            out += data[at + 1 : at + 1 + n]
            at += 1 + n
    if len(out) > width:
        raise FormatError("rgbe: a run goes beyond its row")
    return out, at


def _behind(data: bytes, at: int, width: int) -> int:
    """The place behind one channel of a row, whose values aren't looked at."""
    filled = 0
    while filled < width:
        if at >= len(data):
            raise FormatError("rgbe: a run-length row is cut short")
        n = data[at]
        filled += n - 128 if n > 128 else max(n, 1)
        at += 2 if n > 128 else 1 + max(n, 1)
    return at


def row_offsets(f, head: dict, at: int, y0: int = 0, y1: int | None = None) -> Iterator[tuple[int, int]]:  # noqa: ANN001
    """Place and size of each row from ``y0`` to ``y1``: flat rows by arithmetic, run-length rows by a pass over the runs.

    No row is decoded, and a buffer of some rows is all that is held.
    """
    w = head["width"]
    stream = Stream(f, at)
    for y in range(head["height"] if y1 is None else y1):
        data = stream.ahead(8 * w + 4)
        size = 4 * w
        if _is_rle(data, w):
            size = 4
            for _ in range(4):
                size = _behind(data, size, w)
        if size > len(data):
            raise FormatError("rgbe: the rows are cut short")
        if y >= y0:
            yield stream.at, size
        stream.skip(size)


def _is_rle(data: bytes, width: int) -> bool:
    return len(data) >= 4 and data[0] == 2 and data[1] == 2 and data[2] * 256 + data[3] == width


def iter_rows(f, head: dict, at: int, y0: int, y1: int, step: int) -> Iterator[tuple[int, np.ndarray]]:  # noqa: ANN001
    """The rows ``y0`` to ``y1``, ``step`` at a time: the first one's number and channels as 32-bit floats.

    Rows before them are passed over once.
    """
    w = head["width"]
    first = next(row_offsets(f, head, at, y0, y0 + 1))[0] if 0 < y0 < y1 else at
    stream = Stream(f, first)
    for y in range(y0, y1, step):
        cells = np.empty((min(step, y1 - y), w, 4), np.uint8)
        for row in cells:
            data, i = stream.ahead(8 * w + 4), 4
            if _is_rle(data, w):
                for c in range(4):
                    plane, i = _plane(data, i, w)
                    row[:, c] = np.frombuffer(plane, np.uint8)
            else:
                i = 4 * w
                if i > len(data):
                    raise FormatError("rgbe: the rows are cut short")
                row[:] = np.frombuffer(data, np.uint8, i).reshape(w, 4)
            stream.skip(i)
        yield y, from_cells(cells, head["exposure"])


def decode(data: bytes) -> tuple[dict, np.ndarray]:
    """Header and channels (height, width, 3), as 32-bit floats."""
    head, at = read_header(data)
    return head, gathered(iter_rows, Memory(data), head, at)


def from_cells(cells: np.ndarray, exposure: float = 1.0) -> np.ndarray:
    """Channels of shared-exponent pixels."""
    e = cells[..., 3:].astype(np.int32)
    return np.where(e == 0, 0.0, np.ldexp(cells[..., :3].astype(np.float64), e - 136) / exposure).astype(np.float32)


def to_cells(values: np.ndarray) -> np.ndarray:
    """Shared-exponent pixels of channels."""
    values = values.astype(np.float64)
    top = values.max(axis=-1, keepdims=True)
    mantissa, e = np.frexp(np.where(top > 1e-32, top, 1.0))
    scaled = values * (mantissa * 256 / np.where(top > 1e-32, top, 1.0))
    cells = np.concatenate([np.trunc(np.clip(scaled, 0, 255)), e + 128], axis=-1)
    return np.where(top > 1e-32, cells, 0).astype(np.uint8)


def _runs(row: np.ndarray) -> bytes:
    """One channel of a row, window by window of up to 128 bytes.

    The first stretch of at least five equal bytes in a window (as far as it lies in it,
    127 at most) is written as a run behind the bytes before it, and the next window
    begins there. A window without one is written as it is.
    """
    data, out, at = row.tobytes(), bytearray(), 0
    edge = np.flatnonzero(np.diff(row)) + 1
    begins, ends = [0, *edge.tolist()], [*edge.tolist(), len(data)]
    i = 0
    while at < len(data):
        stop = min(at + 128, len(data))
        while ends[i] <= at:
            i += 1
        j, found = i, None
        while found is None and j < len(begins) and begins[j] < stop:
            a = max(begins[j], at)
            if min(ends[j], stop) - a > 4:
                found = a, min(min(ends[j], stop) - a, 127)
            j += 1
        plain = stop if found is None else found[0]
        if plain > at:
            out.append(plain - at)
            out += data[at:plain]
        at = plain
        if found is not None:
            out += bytes((128 + found[1], data[found[0]]))
            at += found[1]
    return bytes(out)


def codec_options(options: dict[str, str]) -> dict:
    """What ``head`` and ``rows`` take, of the options of a writer: ``rle``, true unless it is false."""
    return {"rle": options.get("rle", "true").lower() != "false"}


def head(width: int, height: int, model: str = RGB, rle: bool = True) -> bytes:
    """The header of a file."""
    name = next((n for n, m in MODELS.items() if m == model), None)
    if name is None:
        raise UnsupportedError(f"rgbe: colour model {model}")
    return b"#?RADIANCE\nFORMAT=%s\n\n-Y %d +X %d\n" % (name.encode(), height, width)


def rows(values: np.ndarray, model: str = RGB, rle: bool = True) -> bytes:
    """Some rows of a file."""
    cells, w = to_cells(values), values.shape[1]
    if not (rle and 8 <= w < 32768):
        return cells.tobytes()
    begin = bytes((2, 2, w >> 8, w & 255))
    return b"".join(begin + b"".join(_runs(np.ascontiguousarray(row[:, c])) for c in range(4)) for row in cells)


def encode(values: np.ndarray, model: str = RGB, rle: bool = True) -> bytes:
    """A Radiance file of channels (height, width, 3)."""
    return encoded(values, head, rows, model, rle=rle)
