"""HLi files: a CBOR header and a compressed raster of one of several pixel formats."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import zstandard

from lumera.schema import RGB, XYZ
from lumera.sources import rgbe
from lumera.sources.errors import FormatError, UnsupportedError
from lumera.sources.rows import Memory, Stream, encoded, gathered

# Fixed values of the format: magic, names of the pixel formats with their model and bytes a channel.
MAGIC = b"HLi.v1"
FORMATS = {"RGBE": (RGB, 4, 1), "XYZE": (XYZ, 4, 1), "RGB": (RGB, 3, 4), "XYZ": (XYZ, 3, 4), "LogLuv": (XYZ, 4, 1)}
RASTERS = ("normal", "separately")
COMPRESSIONS = ("gzip", "zstd")


@dataclass(frozen=True)
class Header:
    """What the header holds; empty fields are filled in on writing."""

    width: int = 0
    height: int = 0
    depth: int = 32
    format: str = ""
    raster_mode: str = "normal"
    compression: str = "gzip"
    metadata: dict = field(default_factory=dict)


PRESETS = {
    1: Header(raster_mode="separately"),
    2: Header(format="XYZE", raster_mode="separately"),
    3: Header(format="RGB", raster_mode="separately"),
    4: Header(format="XYZ", raster_mode="separately"),
    5: Header(format="LogLuv", raster_mode="separately"),
    6: Header(format="LogLuv", raster_mode="separately", compression="zstd"),
}


def _head(major: int, n: int) -> bytes:
    for size, (info, kind) in {24: (0, ""), 256: (24, ">B"), 65536: (25, ">H"), 1 << 32: (26, ">I"), 1 << 64: (27, ">Q")}.items():
        if n < size:
            return bytes([major << 5 | (info or n)]) + (struct.pack(kind, n) if kind else b"")
    raise FormatError("hli: number too large")


def cbor(value) -> bytes:  # noqa: ANN001
    """Whole numbers, strings and maps in CBOR."""
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, str):
        return _head(3, len(value.encode())) + value.encode()
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(cbor(k) + cbor(v) for k, v in value.items())
    raise UnsupportedError(f"hli: {type(value).__name__} in a header")


def uncbor(data: bytes, at: int = 0):  # noqa: ANN201
    """A CBOR value and the place behind it."""
    try:
        major, info = data[at] >> 5, data[at] & 31
        at += 1
        if major == 7:
            if info in (20, 21, 22):
                return {20: False, 21: True, 22: None}[info], at
            size, kind = {26: (4, ">f"), 27: (8, ">d")}[info]
            return struct.unpack(kind, data[at : at + size])[0], at + size
        n = info
        if info >= 24:
            size = 1 << (info - 24)
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if major == 0 or major == 1:
            return (n if major == 0 else -1 - n), at
        if major in (2, 3):
            part = data[at : at + n]
            if len(part) < n:
                raise IndexError
            return (part.decode() if major == 3 else part), at + n
        if major in (4, 5):
            items = []
            for _ in range(n * (major - 3)):
                item, at = uncbor(data, at)
                items.append(item)
            return (items if major == 4 else dict(zip(items[::2], items[1::2], strict=True))), at
    except (IndexError, KeyError, struct.error, UnicodeDecodeError) as bad:
        raise FormatError("hli: the header is no CBOR map") from bad
    raise UnsupportedError("hli: tagged values in a header")


def read_header(data: bytes) -> tuple[dict, int]:
    """Header fields and the place of the raster."""
    at = len(MAGIC)
    if data[:at] != MAGIC or len(data) <= at:
        raise FormatError("hli: no magic")
    width = data[at]
    size = int.from_bytes(data[at + 1 : at + 1 + width], "big")
    at += 1 + width
    found, _ = uncbor(data[at : at + size])
    if not isinstance(found, dict):
        raise FormatError("hli: the header is no map")
    found = {str(k).lower(): v for k, v in found.items()}
    head = asdict(Header()) | {k: found[k] for k in asdict(Header()) if found.get(k) is not None}
    if head["format"] not in FORMATS:
        raise UnsupportedError(f"hli: format {head['format']}")
    return head | {"model": FORMATS[head["format"]][0]}, at + size


#: Bytes that are unpacked at once.
PIECE = 1 << 20


def _unpacked(stream: Stream, compression: str) -> Iterator[bytes]:
    """The raster's bytes in order; the streams of its bands follow each other, and one whose end is missing serves as far as it goes."""
    if compression == "zstd":
        reader = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
        for piece in stream.pieces():
            for a in range(0, len(piece), PIECE // 8):
                yield reader.decompress(piece[a : a + PIECE // 8])
    elif compression == "gzip":
        reader = zlib.decompressobj(31)
        for piece in stream.pieces():
            while piece:
                if reader.eof:
                    if piece[:1] != b"\x1f":
                        return
                    reader = zlib.decompressobj(31)
                yield reader.decompress(piece, PIECE)
                piece = reader.unused_data if reader.eof else reader.unconsumed_tail
        yield reader.flush()
    else:
        raise UnsupportedError(f"hli: compression {compression}")


def iter_rows(f, head: dict, at: int, y0: int, y1: int, step: int) -> Iterator[tuple[int, np.ndarray]]:  # noqa: ANN001
    """The rows ``y0`` to ``y1``, ``step`` at a time: the first one's number and channels as 32-bit floats.

    Rows before them are unpacked but not decoded.
    """
    if head["raster_mode"] not in RASTERS:
        raise UnsupportedError(f"hli: raster mode {head['raster_mode']}")
    w, (_, parts, size) = head["width"], FORMATS[head["format"]]
    row, pieces, held, passed = w * parts * size, _unpacked(Stream(f, at), head["compression"]), bytearray(), 0
    for y in range(y0, y1, step):
        wanted = (min(y + step, y1) - y) * row
        while len(held) < wanted:
            data = next(pieces, None)
            if data is None:
                raise FormatError("hli: the raster is cut short")
            gone = min(len(data), max(0, y0 * row - passed))
            passed += gone
            held += data[gone:]
        cells = np.frombuffer(bytes(held[:wanted]), np.uint8)
        del held[:wanted]
        separate = head["raster_mode"] == "separately"
        cells = np.ascontiguousarray(cells.reshape(-1, parts, w, size).transpose(0, 2, 1, 3) if separate else cells.reshape(-1, w, parts, size))
        if size == 4:
            yield y, cells.view("<f4")[..., 0]
        else:
            yield y, from_logluv(cells[..., 0]) if head["format"] == "LogLuv" else rgbe.from_cells(cells[..., 0])


def decode(data: bytes) -> tuple[dict, np.ndarray]:
    """Header and channels (height, width, 3), as 32-bit floats."""
    head, at = read_header(data)
    return head, gathered(iter_rows, Memory(data), head, at)


def to_logluv(xyz: np.ndarray) -> np.ndarray:
    """LogLuv pixels of XYZ channels."""
    x, y, z = (xyz[..., i].astype(np.float64) for i in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        word = np.where(y == 0, 0, np.clip(np.floor(256 * (np.log2(np.abs(y)) + 64)), 0, 32767)).astype(np.int32) | np.where(y < 0, 32768, 0)
        s = x + 15 * np.abs(y) + 3 * z
        u, v = 4 * x / s, 9 * np.abs(y) / s
    cell = lambda c: np.where(np.nan_to_num(c) > 0, np.clip(np.floor(410 * np.nan_to_num(c)), 0, 255), 0).astype(np.int32)
    return np.stack([word >> 8, word & 255, cell(u), cell(v)], axis=-1).astype(np.uint8)


def from_logluv(cells: np.ndarray) -> np.ndarray:
    """XYZ channels of LogLuv pixels."""
    c = cells.astype(np.float64)
    word = cells[..., 0].astype(np.int32) << 8 | cells[..., 1]
    y = np.exp2(((word & 32767) + 0.5) / 256 - 64) * np.where(word & 32768, -1, 1)
    u, v = (c[..., 2] + 0.5) / 410, (c[..., 3] + 0.5) / 410
    s = 6 * u - 16 * v + 12
    lx, ly = 9 * u / s, 4 * v / s
    return np.stack([lx / ly * np.abs(y), y, (1 - lx - ly) / ly * np.abs(y)], axis=-1).astype(np.float32)


def codec_options(options: dict[str, str]) -> dict:
    """What ``head`` and ``rows`` take, of the options of a writer.

    ``preset`` 1 to 6 (6 without any option), or ``pixel_format``, ``raster_mode`` and
    ``compression`` in place of the preset's; ``metadata`` is a JSON map of strings.
    """
    named = {"pixel_format": "format", "raster_mode": "raster_mode", "compression": "compression"}
    given = {field: options[o] for o, field in named.items() if o in options}
    base = PRESETS[int(options["preset"])] if "preset" in options else PRESETS[6] if not given else Header()
    return {"header": replace(base, **given, metadata=json.loads(options.get("metadata", "{}")))}


def _filled(header: Header, width: int, height: int, model: str) -> Header:
    """The header with what is left open."""
    filled = replace(header, width=width, height=height, format=header.format or ("XYZE" if model == XYZ else "RGBE"))
    if filled.format not in FORMATS:
        raise UnsupportedError(f"hli: format {filled.format}")
    if filled.raster_mode not in RASTERS or filled.compression not in COMPRESSIONS:
        raise UnsupportedError(f"hli: {filled.raster_mode}, {filled.compression}")
    return filled


def head(width: int, height: int, model: str = RGB, header: Header = PRESETS[6]) -> bytes:
    """The header of a file."""
    fields = cbor({k: v for k, v in asdict(_filled(header, width, height, model)).items() if v != {}})
    length = len(fields).to_bytes(max(1, (len(fields).bit_length() + 7) // 8), "big")
    return MAGIC + bytes([len(length)]) + length + fields


def rows(values: np.ndarray, model: str = RGB, header: Header = PRESETS[6]) -> bytes:
    """Some rows of a file, a stream of their own; channels of another model than the format's are converted."""
    from lumera.functions.color import RGB_TO_XYZ, XYZ_TO_RGB

    h, w, _ = values.shape
    fields = _filled(header, w, h, model)
    wanted, parts, size = FORMATS[fields.format]
    if wanted != model and model in (RGB, XYZ):
        values = values.astype(np.float64) @ np.array(RGB_TO_XYZ if wanted == XYZ else XYZ_TO_RGB).T
    cells = to_logluv(values) if fields.format == "LogLuv" else values.astype("<f4")[..., None].view(np.uint8) if size == 4 else rgbe.to_cells(values)
    cells = cells.reshape(h, w, parts, size)
    raw = np.ascontiguousarray(cells.transpose(0, 2, 1, 3) if fields.raster_mode == "separately" else cells).tobytes()
    if fields.compression == "zstd":
        return zstandard.ZstdCompressor().compress(raw)
    packer = zlib.compressobj(wbits=31)
    return packer.compress(raw) + packer.flush()


def encode(values: np.ndarray, model: str = RGB, header: Header = PRESETS[6]) -> bytes:
    """An HLi file; channels of another model than the format's are converted."""
    return encoded(values, head, rows, model, header=header)
