"""Media columns: TIFF. One row per page of every image in a binary column, with its decoded samples.

The reader walks the chain of image directories (classic and BigTIFF, either byte order), undoes PackBits, LZW or
deflate in strips or tiles, and reverses the horizontal and floating-point predictors. The writer makes the same
variants; it serves round trips and columns that are yet to become images.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
COMPRESSION = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


class TiffError(ValueError):
    """The bytes are no TIFF, or one that is damaged or of a kind not read here."""


@dataclass
class Page:
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    photometric: int
    predictor: int
    layout: str
    pixels: bytes  # rows without padding between them; samples interleaved, multi-byte ones little-endian; under 8 bits one byte a sample


# --- codecs


def packbits_decode(data: bytes, expected: int) -> bytes:
    out, at, n, size = bytearray(), 0, len(data), 0
    while at < n and len(out) < expected:
        size = data[at]
        at += 1
        if size < 128:
            out += data[at : at + size + 1]
            at += size + 1
        elif size > 128:
            out += data[at : at + 1] * (257 - size)
            at += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(chunk: bytes) -> None:
        for k in range(0, len(chunk), 128):
            part = chunk[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(data[at : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.append(m[0][0])
        at = m.end()
    literal(data[at:])
    return bytes(out)


_BASE = [bytes((k,)) for k in range(256)] + [b"", b""]


#: Codes of LZW that are unpacked at once: 12 bits each, 48 KB.
_CODES = 1 << 12


def _codes(data: np.ndarray, at: int, width: int, count: int) -> np.ndarray:
    """Up to count codes of width bits from bit `at` on."""
    count = min(count, _CODES, (8 * len(data) - at) // width)
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(data[at >> 3 : (at + count * width + 7) >> 3])[at & 7 :][: count * width]
    return bits.reshape(count, width) @ (1 << np.arange(width - 1, -1, -1))


def lzw_decode(data: bytes, expected: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, each width ending one entry early. Codes are unpacked a block at a time."""
    stream = np.frombuffer(data, dtype=np.uint8)
    out, at = bytearray(), 0
    table, previous = list(_BASE), b""
    while len(out) < expected:
        # After a clear, entry 258 + k is made by code k + 2: how many codes of this width are left is known.
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        limit = (1 << width) - 1 - len(table) if width < 12 else 1 << 16
        codes = _codes(stream, at, width, max(1, limit + (not previous)))
        if not len(codes):
            break
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        used = int(stop[0]) if len(stop) else len(codes)
        add = table.append
        for code in codes[:used].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and previous:
                entry = previous + previous[:1]
            else:
                raise TiffError("LZW code out of range")
            if previous:
                add(previous + entry[:1])
            out += entry
            previous = entry
        at += width * used
        if len(stop):
            at += width
            if codes[used] == 257:
                break
            table, previous = list(_BASE), b""
    return bytes(out[:expected])


def lzw_encode(data: bytes) -> bytes:
    codes: list[int] = [256]
    widths: list[int] = [9]
    table: dict[int, int] = {}
    following, width, prefix = 258, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        found = table.get(key)
        if found is not None:
            prefix = found
            continue
        codes.append(prefix)
        widths.append(width)
        table[key] = following
        following += 1
        prefix = byte
        if following == 512 or following == 1024 or following == 2048:
            width += 1
        elif following == 4094:
            codes.append(256)
            widths.append(12)
            table, following, width = {}, 258, 9
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    codes.append(257)
    widths.append(width)
    c, w = np.array(codes, dtype=np.int64), np.array(widths, dtype=np.int64)
    grid = ((c << (12 - w))[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(grid[np.arange(12) < w[:, None]].astype(np.uint8)).tobytes()


def _inflate(data: bytes, expected: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, max(1, expected))
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


#: Each byte with its bits in reverse.
_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def decompress(data: bytes, compression: int, expected: int) -> bytes:
    if compression == NONE:
        return data[:expected]
    if compression == PACKBITS:
        return packbits_decode(data, expected)
    if compression == LZW:
        return lzw_decode(data, expected)
    if compression in (DEFLATE, OLD_DEFLATE):
        return _inflate(data, expected)
    raise TiffError(f"compression {compression}")


# --- predictors


def undo_predictor(rows: np.ndarray, predictor: int, samples: int) -> np.ndarray:
    """rows: (height, width * samples) as stored. Sums wrap at the sample's size."""
    if predictor == 2:
        rows = rows.astype(rows.dtype.newbyteorder("="))
        h, n = rows.shape
        return np.add.accumulate(rows.reshape(h, n // samples, samples), axis=1, dtype=rows.dtype).reshape(h, n)
    if predictor == 3:
        h, n = rows.shape
        size = rows.dtype.itemsize
        planes = np.ascontiguousarray(rows).view(np.uint8).reshape(h, n * size)
        # Differences run over the bytes; then the planes (highest byte first) are woven into samples.
        summed = np.add.accumulate(planes.reshape(h, n * size // samples, samples), axis=1, dtype=np.uint8).reshape(h, size, n)
        woven = np.ascontiguousarray(summed.transpose(0, 2, 1))
        return woven.view(f">u{size}").reshape(h, n)
    return rows


# --- reading


def _field(data: bytes, order: str, big: bool, at: int) -> tuple[int, tuple]:
    head = order + ("HHQ" if big else "HHI")
    tag, kind, count = struct.unpack_from(head, data, at)
    code = _SIZES.get(kind)
    if code is None:
        return tag, ()
    form = f"{count}s" if kind == 2 else code * count if len(code) > 1 else f"{count}{code}"
    size, inline = struct.calcsize(order + form), 8 if big else 4
    place = at + struct.calcsize(head)
    if size > inline:
        (place,) = struct.unpack_from(order + ("Q" if big else "I"), data, place)
    if place + size > len(data):
        raise TiffError("a field lies beyond the end")
    return tag, struct.unpack_from(order + form, data, place)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory in the chain; a chain that comes back to itself ends there."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8:
        raise TiffError("no TIFF header")
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    big = magic == 43
    seen: set[int] = set()
    try:
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
        while at and at not in seen:
            seen.add(at)
            (count,) = struct.unpack_from(order + ("Q" if big else "H"), data, at)
            first, step = at + (8 if big else 2), 20 if big else 12
            yield order, dict(_field(data, order, big, first + k * step) for k in range(count))
            (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, first + count * step)
    except struct.error:
        raise TiffError("a directory lies beyond the end") from None


def _page(data: bytes, order: str, f: dict[int, tuple]) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in f and f[tag]:
            return int(f[tag][0])
        if default is None:
            raise TiffError(f"no tag {tag}")
        return default

    width, height = one(256), one(257)
    depths = f.get(258) or (1,)
    samples, compression = one(277, 1), one(259, NONE)
    predictor, planar, photometric, fill = one(317, 1), one(284, 1), one(262, 1), one(266, 1)
    bits = int(depths[0])
    if any(b != bits for b in depths) or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise TiffError(f"samples of {depths} bits")
    if width <= 0 or height <= 0 or samples <= 0 or width * height * samples * bits > 8 << 31:
        raise TiffError("a size out of range")
    if predictor not in (1, 2, 3) or (predictor == 2 and bits < 8) or (predictor == 3 and bits < 16):
        raise TiffError(f"predictor {predictor} with {bits} bits")
    if fill not in (1, 2):
        raise TiffError(f"fill order {fill}")
    tiled = 322 in f
    w, h = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    if w <= 0 or h <= 0:
        raise TiffError("a size out of range")
    offsets, counts = f.get(324 if tiled else 273, ()), f.get(325 if tiled else 279, ())
    across, down = -(-width // w), -(-height // h)
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) != across * down * planes or len(counts) != len(offsets):
        raise TiffError("strips or tiles are missing")
    kind = np.dtype(np.uint8) if bits <= 8 else np.dtype(f"{order}u{bits // 8}")
    out = np.zeros((height, width, samples), dtype=np.uint8 if bits <= 8 else f"<u{bits // 8}")
    row_bytes = -(-w * each * bits // 8)
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, place = divmod(k, across * down)
        y, x = place // across * h, place % across * w
        rows = h if tiled else min(h, height - y)
        if at + size > len(data):
            raise TiffError("a strip or tile lies beyond the end")
        stored = data[at : at + size].translate(_REVERSED) if fill == 2 else data[at : at + size]
        raw = decompress(stored, compression, row_bytes * rows)
        if len(raw) < row_bytes * rows:
            raise TiffError("a strip or tile is too short")
        block = np.frombuffer(raw, dtype=np.uint8).reshape(rows, row_bytes)
        if bits < 8:
            parts = np.unpackbits(block, axis=1).reshape(rows, row_bytes * 8 // bits, bits)
            block = (parts @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8))[:, : w * each]
        else:
            block = undo_predictor(block.view(kind), predictor, each)
        block = block.reshape(rows, w, each)[: height - y, : width - x]
        out[y : y + block.shape[0], x : x + block.shape[1], plane : plane + each] = block
    return Page(width, height, bits, samples, compression, photometric, predictor, "tiles" if tiled else "strips", out.tobytes())


def read_tiff(data: bytes) -> Iterator[Page | TiffError]:
    """The pages of an image; one that can't be read is given as its error, and damage to the chain ends it with one."""
    try:
        for order, fields in directories(data):
            try:
                yield _page(data, order, fields)
            except TiffError as e:
                yield e
    except TiffError as e:
        yield e


# --- writing


def _put_predictor(rows: np.ndarray, predictor: int, samples: int) -> np.ndarray:
    if predictor == 2:
        h, n = rows.shape
        cube = rows.reshape(h, n // samples, samples)
        return np.concatenate((cube[:, :1], cube[:, 1:] - cube[:, :-1]), axis=1).reshape(h, n)
    if predictor == 3:
        h, n = rows.shape
        size = rows.dtype.itemsize
        planes = np.ascontiguousarray(rows.astype(f">u{size}")).view(np.uint8).reshape(h, n, size).transpose(0, 2, 1).reshape(h, n * size // samples, samples)
        return np.concatenate((planes[:, :1], planes[:, 1:] - planes[:, :-1]), axis=1).reshape(h, n * size)
    return rows


def write_tiff(images: list[np.ndarray], compression: int = NONE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 16, order: str = "<") -> bytes:
    """A TIFF of unsigned images (height, width) or (height, width, samples), of 8, 16 or 32 bits, one page each."""
    pack = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: zlib.compress}[compression]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        cube = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = cube.shape
        size = cube.dtype.itemsize
        h, w = tile or (max(1, min(rows_per_strip, height)), width)
        places, lengths = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = cube[y : y + h, x : x + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                rows = _put_predictor(block.reshape(block.shape[0], -1), predictor, samples)
                raw = rows.astype(f"{order}u{size}").tobytes() if predictor != 3 else rows.tobytes()
                places.append(len(out))
                out += (done := pack(raw))
                lengths.append(len(done))
        fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8 * size] * samples), (259, 3, [compression]), (262, 3, [2 if samples >= 3 else 1]), (277, 3, [samples]), (317, 3, [predictor])]
        fields += [(322, 4, [w]), (323, 4, [h]), (324, 4, places), (325, 4, lengths)] if tile else [(273, 4, places), (278, 4, [h]), (279, 4, lengths)]
        entries = []
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{_SIZES[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                entries.append(struct.pack(order + "HHII", tag, kind, len(values), len(out)))
                out += raw
            else:
                entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


# --- columns

PAGE_WIDTH, PAGE_ROWS = 256, 64


def capture(raw: bytes, number: int, width: int = PAGE_WIDTH, rows: int = PAGE_ROWS) -> bytes:
    """Bytes as the grey samples of an image of pages of width x rows, the last rows padded with 0; number picks one of the variants."""
    height = max(1, -(-len(raw) // width))
    grid = np.frombuffer(raw.ljust(height * width, b"\0"), dtype=np.uint8).reshape(height, width)
    images = [grid[k : k + rows] for k in range(0, height, rows)]
    kind = (NONE, PACKBITS, LZW, DEFLATE)[number % 4]
    return write_tiff(images, kind, 2 if kind in (LZW, DEFLATE) and number // 4 % 2 else 1, (32, 64) if number // 8 % 2 else None, 16, "<" if number // 16 % 2 else ">")


def captures(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """page_id and tiff: every page's UTF-8 bytes as an image, in a variant by id. A NULL page stays NULL; NULL ids count as 0."""

    @F.pandas_udf("binary")
    def draw(raw: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else capture(bytes(r), int(n)) for r, n in zip(raw, number, strict=True)], dtype="object")

    return pages.select(F.col(id_col).cast("long").alias("page_id"), draw(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))).alias("tiff"))


_OUT = "image_id long, no_id boolean, page int, width int, height int, bits int, samples int, compression string, photometric int, predictor int, layout string, pixels binary, error string"


def tiff_pages(images: DataFrame, id_col: str = "page_id", image_col: str = "tiff") -> DataFrame:
    """One row per page: image_id, page (from 0), width, height, bits, samples, compression, photometric, predictor, layout, pixels, error.

    Defined cases: NULL and empty images have no pages; bytes that are no TIFF, and pages that are damaged or of an unknown kind, give
    a row with error and NULL pixels, and the other pages of the image are still read; a page of more than 2 GiB of samples, which no cell can hold, is such
    an error too; NULL ids are carried; repeated rows each give their pages; other columns are ignored, whatever their names; no rows give no rows.
    """
    names = [f.split()[0] for f in _OUT.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for number, none, data in zip(batch["image_id"], batch["no_id"], batch["data"], strict=True):
                for k, p in enumerate(read_tiff(bytes(data))):
                    if isinstance(p, TiffError):
                        out.append((number, none, k, *[None] * 9, str(p)))
                    else:
                        held += len(p.pixels)
                        out.append((number, none, k, p.width, p.height, p.bits, p.samples, COMPRESSION[p.compression], p.photometric, p.predictor, p.layout, p.pixels, None))
                    if held > 16 << 20:
                        yield _frame(out, names)
                        out, held = [], 0
            yield _frame(out, names)

    rows = images.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("image_id"), F.col(id_col).isNull().alias("no_id"), F.col(image_col).cast("binary").alias("data")).where(F.length("data") > 0)
    return rows.mapInPandas(walk, _OUT).withColumn("image_id", F.expr("if(no_id, NULL, image_id)")).drop("no_id")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("width", "height", "bits", "samples", "photometric", "predictor"):
        out[c] = out[c].astype("Int32")
    return out


SQL = f"""
WITH r AS (SELECT page_id, hex(encode(html)) AS h, greatest(1, (strlen(html) + {PAGE_WIDTH - 1}) // {PAGE_WIDTH}) AS n_rows FROM pages WHERE html IS NOT NULL),
p AS (SELECT page_id, rpad(h, CAST(n_rows * {2 * PAGE_WIDTH} AS INTEGER), '0') AS h, n_rows, unnest(range(0, (n_rows + {PAGE_ROWS - 1}) // {PAGE_ROWS})) AS k FROM r)
SELECT page_id AS image_id, CAST(k AS INTEGER) AS page, {PAGE_WIDTH} AS width, CAST(least({PAGE_ROWS}, n_rows - {PAGE_ROWS} * k) AS INTEGER) AS height, 8 AS bits, 1 AS samples,
  CASE page_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'packbits' WHEN 2 THEN 'lzw' ELSE 'deflate' END AS compression, 1 AS photometric,
  CAST(CASE WHEN page_id % 4 >= 2 AND page_id // 4 % 2 = 1 THEN 2 ELSE 1 END AS INTEGER) AS predictor, CASE WHEN page_id // 8 % 2 = 1 THEN 'tiles' ELSE 'strips' END AS layout,
  substring(h, CAST(k * {2 * PAGE_WIDTH * PAGE_ROWS} + 1 AS INTEGER), {2 * PAGE_WIDTH * PAGE_ROWS}) AS pixels, CAST(NULL AS VARCHAR) AS error
FROM p
"""
