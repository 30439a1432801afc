"""TIFF as a media column: image directories, strips and tiles, PackBits, LZW and deflate, predictors.

``read_pages`` turns a binary column into one row per page.  Defined results: a null value gives no
row; a broken file gives its readable pages and then one row with ``error`` set and no pixels;
a directory that points back to an earlier one ends the walk; a page whose header asks for more samples
than its strips or tiles can hold, or than ``LARGEST`` bytes, is broken; very long values are decoded
whole up to that; an empty table has no rows; extra columns are carried through, and those whose names
clash with the page columns are replaced by them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed values of the format: tags, field types' sizes and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 317, 322, 323, 324, 325
FIELD_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: Bytes that the pages of one file hold at most, unless the caller says otherwise.
MOST = 1 << 30
#: Bytes of a page's samples at most: what a binary value holds.
LARGEST = 1 << 30
#: Bytes that one byte of a part can become, at most, by compression.
EXPANSION = {NONE: 1, LZW: 2800, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}

PAGE_FIELDS = [
    T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("channels", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("pixels", T.BinaryType()),
    T.StructField("mean", T.DoubleType()), T.StructField("stddev", T.DoubleType()), T.StructField("entropy", T.DoubleType()),
    T.StructField("error", T.StringType()),
]


def unpack_packbits(data: bytes, most: int = LARGEST) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, most: int = LARGEST) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears, 257 ends; widths grow one code early."""
    out = bytearray()
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    width, have, held, prior = 9, 0, 0, b""
    for byte in data:
        held, have = (held << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code == 257 or len(out) >= most:
            return bytes(out)
        if code == 256:
            del table[258:]
            width, prior = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif prior and code == len(table):
            entry = prior + prior[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if prior:
            table.append(prior + entry[:1])
        prior = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    table = {bytes((i,)): i for i in range(256)}
    size, width, word = 258, 9, b""
    for byte in data:
        more = word + bytes((byte,))
        if more in table:
            word = more
            continue
        codes.append((table[word], width))
        table[more] = size
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        if size >= 4094:
            codes.append((256, width))
            table = {bytes((i,)): i for i in range(256)}
            size, width = 258, 9
        word = bytes((byte,))
    if word:
        codes.append((table[word], width))
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    codes.append((257, width))
    value = bits = 0
    out = bytearray()
    for code, w in codes:
        value, bits = (value << w) | code, bits + w
        while bits >= 8:
            bits -= 8
            out.append(value >> bits)
            value &= (1 << bits) - 1
    if bits:
        out.append((value << (8 - bits)) & 255)
    return bytes(out)


def _unpacked(data: bytes, compression: int, most: int) -> bytes:
    """The first ``most`` bytes, or a few more, that a part holds."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if compression == LZW:
        return unpack_lzw(data, most)
    return unpack_packbits(data, most)


def _field(raw: bytes, order: str, entry: int) -> tuple[int, list[int]]:
    tag, kind, count = struct.unpack_from(order + "HHI", raw, entry)
    code = FIELD_CODES.get(kind)
    if code is None:
        return tag, []
    size = struct.calcsize(code) * count
    at = entry + 8 if size <= 4 else struct.unpack_from(order + "I", raw, entry + 8)[0]
    return tag, list(struct.unpack_from(f"{order}{count}{code}", raw, at))


def directories(raw: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """The fields of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", raw, at)[0]
        yield order, dict(_field(raw, order, at + 2 + 12 * k) for k in range(n))
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def image(raw: bytes, order: str, fields: dict[int, list[int]]) -> np.ndarray:
    """The samples of a page: height x width x channels."""
    one = lambda tag, default: (fields.get(tag) or [default])[0]
    width, height, channels = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits = set(fields.get(BITS) or [1])
    if len(bits) != 1 or not bits <= {8, 16}:
        raise ValueError(f"samples of {sorted(bits)} bits are not supported")
    kind = np.dtype("u1") if bits == {8} else np.dtype(order + "u2")
    planes = channels if one(PLANAR, 1) == 2 else 1
    deep = channels // planes
    tiled = TILE_OFFSETS in fields
    part_w = one(TILE_WIDTH, 0) if tiled else width
    part_h = one(TILE_HEIGHT, 0) if tiled else min(one(STRIP_ROWS, height), height)
    offsets, sizes = (fields[TILE_OFFSETS], fields[TILE_SIZES]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_SIZES])
    compression = one(COMPRESSION, NONE)
    if compression not in EXPANSION:
        raise ValueError(f"compression {compression} is not supported")
    if not (part_w and part_h and width and height and channels):
        raise ValueError("an image without extent")
    across, down = -(-width // part_w), -(-height // part_h)
    if min(len(offsets), len(sizes)) < planes * across * down:
        raise ValueError("fewer parts than the image has")
    held = sum(max(0, min(size, len(raw) - at)) for at, size in zip(offsets, sizes))
    if width * height * channels * kind.itemsize > min(LARGEST, held * EXPANSION[compression]) or part_w * part_h * deep * kind.itemsize > LARGEST:
        raise ValueError("more samples than the file can hold")
    out = np.empty((height, width, channels), kind.newbyteorder("="))
    for plane in range(planes):
        for k in range(across * down):
            row, col = k // across * part_h, k % across * part_w
            rows = part_h if tiled else min(part_h, height - row)
            at, size = offsets[plane * across * down + k], sizes[plane * across * down + k]
            data = _unpacked(raw[at : at + size], compression, rows * part_w * deep * kind.itemsize)
            part = np.frombuffer(data, kind, rows * part_w * deep).reshape(rows, part_w, deep)
            if one(PREDICTOR, 1) == 2:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
            elif one(PREDICTOR, 1) != 1:
                raise ValueError("only the horizontal predictor is supported")
            part = part[: height - row, : width - col]
            out[row : row + part.shape[0], col : col + part.shape[1], plane * deep : (plane + 1) * deep] = part
    return out


def encode(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_bytes: int = 65536,
    tile: tuple[int, int] | None = None, order: str = "<", level: int = 2,
) -> bytes:
    """A TIFF file of height x width x channels arrays of 8 or 16 bit samples, without loss."""
    pack = {NONE: bytes, DEFLATE: lambda d: zlib.compress(d, level), LZW: pack_lzw, PACKBITS: pack_packbits}[compression]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    link = 4
    for page in pages:
        height, width, channels = page.shape
        bits = page.dtype.itemsize * 8
        if tile:
            th, tw = tile
            full = np.zeros((-(-height // th) * th, -(-width // tw) * tw, channels), page.dtype)
            full[:height, :width] = page
            parts = [full[r : r + th, c : c + tw] for r in range(0, full.shape[0], th) for c in range(0, full.shape[1], tw)]
        else:
            rows = max(1, strip_bytes // max(1, width * channels * page.dtype.itemsize))
            parts = [page[r : r + rows] for r in range(0, height, rows)]
        offsets, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            data = pack(part.astype(part.dtype.newbyteorder(order)).tobytes())
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [bits] * channels), COMPRESSION: ("H", [compression]),
                  PHOTOMETRIC: ("H", [2 if channels == 3 else 1]), SAMPLES: ("H", [channels]), PREDICTOR: ("H", [predictor])}
        if tile:
            fields |= {TILE_WIDTH: ("I", [tile[1]]), TILE_HEIGHT: ("I", [tile[0]]), TILE_OFFSETS: ("I", offsets), TILE_SIZES: ("I", sizes)}
        else:
            fields |= {STRIP_OFFSETS: ("I", offsets), STRIP_ROWS: ("I", [rows]), STRIP_SIZES: ("I", sizes)}
        entries = []
        for tag, (code, values) in sorted(fields.items()):
            value = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(value) > 4:
                at = len(out)
                out += value + b"\0" * (len(value) % 2)
                value = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, 3 if code == "H" else 4, len(values)) + value.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def pages_of(raw: bytes, most: int = MOST) -> Iterator[tuple]:
    """The values of PAGE_FIELDS for each page; a file whose pages hold more than ``most`` bytes together ends in
    an error row."""
    n, held = 0, 0
    try:
        for order, fields in directories(raw):
            pixels = image(raw, order, fields)
            held += pixels.nbytes
            if held > most:
                raise ValueError(f"pages hold more than {most} bytes")
            h, w, c = pixels.shape
            counts = np.bincount(pixels.reshape(-1)).astype(np.float64) / pixels.size
            levels = np.arange(len(counts))
            mean = float(counts @ levels)
            p = counts[counts > 0]
            yield (n, w, h, c, pixels.dtype.itemsize * 8, pixels.tobytes(), mean, float(np.sqrt(max(0.0, counts @ (levels - mean) ** 2))), float(-(p @ np.log2(p))), None)
            n += 1
    except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
        yield (n, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")


def read_pages(df: DataFrame, media: str = "media", most: int = MOST) -> DataFrame:
    """One row per page of each file; ``df``'s other columns stand before the page columns.

    Pages are handed on as they are decoded, some 32 MB at a time, so that no file's pages are held together;
    ``most``: bytes that the pages of one file may hold before it ends in an error row.
    """
    new = {f.name for f in PAGE_FIELDS}
    kept = [f for f in df.schema.fields if f.name not in new]
    kinds = to_arrow_schema(T.StructType(PAGE_FIELDS))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of, held = [], [], 0

            def taken(batch=batch) -> pa.RecordBatch:
                own = [batch.column(f.name).take(pa.array(of)) for f in kept]
                pages = [pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)]
                return pa.RecordBatch.from_arrays(own + pages, names=[f.name for f in kept] + kinds.names)

            for k, raw in enumerate(batch.column(media)):
                for page in pages_of(raw.as_py(), most) if raw.is_valid else ():
                    rows.append(page)
                    of.append(k)
                    held += len(page[5] or b"")
                    if held > 32_000_000:
                        yield taken()
                        rows, of, held = [], [], 0
            if rows:
                yield taken()

    return df.mapInArrow(walk, T.StructType(kept + PAGE_FIELDS))
