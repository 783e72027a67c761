"""Sizes of images from their headers alone: JPEG, PNG, GIF, BMP, TIFF, WebP, JPEG 2000."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a header tells; error says why it tells nothing.
HEADER = "format string, width bigint, height bigint, channels int, error string"


def _png(data: bytes) -> tuple[int, int, int]:
    kind, width, height, _, colour = struct.unpack_from(">4sIIBB", data, 12)
    if kind != b"IHDR":
        raise ValueError("no IHDR chunk")
    return width, height, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[colour]


def _jpeg(data: bytes) -> tuple[int, int, int]:
    at = 2
    while True:
        while data[at] != 0xFF:  # rubbish between segments is passed over
            at += 1
        while data[at] == 0xFF:
            at += 1
        marker, at = data[at], at + 1
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, channels = struct.unpack_from(">HHB", data, at + 3)
            return width, height, channels
        if marker in (0xD9, 0xDA):
            raise ValueError("no frame before the scan")
        if not (marker == 1 or 0xD0 <= marker <= 0xD8):
            at += struct.unpack_from(">H", data, at)[0]


def _gif(data: bytes) -> tuple[int, int, int]:
    return *struct.unpack_from("<HH", data, 6), 3


def _bmp(data: bytes) -> tuple[int, int, int]:
    width, height, _, bits = struct.unpack_from("<iiHH", data, 18)
    return width, abs(height), {32: 4}.get(bits, 3)


def _tiff(data: bytes) -> tuple[int, int, int]:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(f"{order}I", data, 4)[0]
    found = {}
    for k in range(struct.unpack_from(f"{order}H", data, at)[0]):
        tag, kind, _ = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if tag in (256, 257, 277):
            found[tag] = struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", data, at + 10 + 12 * k)[0]
    return found[256], found[257], found.get(277, 1)


def _webp(data: bytes) -> tuple[int, int, int]:
    kind = data[12:16]
    if kind == b"VP8X":
        sides = [int.from_bytes(data[k : k + 3], "little") + 1 for k in (24, 27)]
        return *sides, 4 if data[20] & 16 else 3
    if kind == b"VP8L":
        bits = struct.unpack_from("<I", data, 21)[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 4 if bits >> 28 & 1 else 3
    if kind == b"VP8 ":
        width, height = struct.unpack_from("<HH", data, 26)
        return width & 0x3FFF, height & 0x3FFF, 3
    raise ValueError("no WebP chunk")


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes that follow one another; one of length 0 goes to the end."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        begin = at + 8
        if size == 1:
            size, begin = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        until = end if size == 0 else at + size
        if until < begin:
            raise ValueError("a box that is shorter than its head")
        yield kind, begin, until
        at = until


def _jp2(data: bytes) -> tuple[int, int, int]:
    for kind, begin, end in _boxes(data, 0, len(data)):
        if kind == b"jp2h":
            for inner, at, _ in _boxes(data, begin, min(end, len(data))):
                if inner == b"ihdr":
                    height, width, channels = struct.unpack_from(">IIH", data, at)
                    return width, height, channels
        if kind == b"jp2c":
            return _codestream(data[begin:])
    raise ValueError("no ihdr box")


def _codestream(data: bytes) -> tuple[int, int, int]:
    """The SIZ marker follows the start marker at once; the image is what lies beyond its offset in the reference grid."""
    if data[:4] != b"\xff\x4f\xff\x51":
        raise ValueError("no SIZ marker")
    x, y, left, top = struct.unpack_from(">IIII", data, 8)
    return x - left, y - top, struct.unpack_from(">H", data, 40)[0]


_READERS = (
    ("png", b"\x89PNG\r\n\x1a\n", _png), ("jpeg", b"\xff\xd8\xff", _jpeg), ("gif", b"GIF87a", _gif), ("gif", b"GIF89a", _gif), ("bmp", b"BM", _bmp), ("tiff", b"II*\0", _tiff), ("tiff", b"MM\0*", _tiff),
    ("jp2", b"\0\0\0\x0cjP  ", _jp2), ("jp2", b"\xff\x4f\xff\x51", _codestream),
)


def header(data: bytes | None) -> dict:
    """format, width, height, channels and error of an image; the sizes are null where there is an error."""
    out = dict.fromkeys(("format", "width", "height", "channels", "error"))
    if not data:
        return out | {"error": "no bytes"}
    reader = next(((name, read) for name, mark, read in _READERS if data.startswith(mark)), None)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        reader = "webp", _webp
    if reader is None:
        return out | {"error": "not an image of a known format"}
    out["format"] = reader[0]
    try:
        sides = reader[1](data)
    except (struct.error, IndexError):
        return out | {"error": "the file ends within its header"}
    except KeyError as e:
        return out | {"error": f"the header lacks or doesn't allow {e}"}
    except ValueError as e:
        return out | {"error": str(e)}
    if min(sides) <= 0:
        return out | {"error": "a side of zero"}
    return out | dict(zip(("width", "height", "channels"), sides, strict=True))


def headers(content: str | Column) -> Column:
    """The header of each image as a struct. Tasks over ``binaryFile`` hold files of spark.sql.files.maxPartitionBytes together, so batches are as large at most."""

    def work(data: pd.Series) -> pd.DataFrame:
        rows = [header(None if x is None else bytes(x)) for x in data]
        out = pd.DataFrame(rows, columns=["format", "width", "height", "channels", "error"], dtype="object")
        return out.astype({"width": "Int64", "height": "Int64", "channels": "Int32"})

    return F.pandas_udf(work, HEADER)(content)
