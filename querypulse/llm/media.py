"""TIFF as a media column: write samples as TIFF, walk the image directories of stored files, one row per page.

Read: both byte orders, strips and tiles, no compression, PackBits, LZW and deflate, horizontal predictor, 1, 8 and 16 bits, chunky or planar samples.
Written: 8-bit samples in strips or tiles under any of the four.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship, texts

# Fixed values of the format: tags, field sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
SCHEMES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}

#: Pages of more samples are reported, not decoded: more than a binary value of Spark can hold. Callers that read files of unknown origin may set less.
MAX_SAMPLES = (1 << 31) - 1

PAGE = T.StructType([
    T.StructField("number", T.IntegerType()), T.StructField("of", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("samples", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("compression", T.StringType()), T.StructField("predictor", T.IntegerType()),
    T.StructField("tiled", T.BooleanType()), T.StructField("blocks", T.IntegerType()), T.StructField("mean", T.DoubleType()), T.StructField("entropy", T.DoubleType()),
    T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType()),
])


def packbits(data: bytes) -> bytes:
    """Runs of 3 to 128 equal bytes become two bytes; the rest goes out as literals."""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(a)]))
    out, literal = bytearray(), 0
    long = np.flatnonzero(ends - starts >= 3)
    for s, e in [*zip(starts[long].tolist(), ends[long].tolist(), strict=True), (len(a), len(a))] if len(a) else []:
        for k in range(literal, s, 128):
            out.append(min(128, s - k) - 1)
            out += data[k : min(k + 128, s)]
        while e - s >= 2:
            n = min(128, e - s)
            out += bytes((257 - n, data[s]))
            s += n
        literal = s
        if s < e:
            literal = s
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += 2 + k
        else:
            if k > 128:
                out.append(data[i + 1 : i + 2] * (257 - k))
            i += 1 + (k > 128)
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """Most significant bit first; codes grow one code early, as readers expect."""
    table = {bytes((i,)): i for i in range(256)}
    out, bits, held, width, following = bytearray(), 0, 0, 9, 258

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(256)
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following == (1 << width):
            width += 1
        if following >= 4094:
            put(256)
            table, width, following = {bytes((i,)): i for i in range(256)}, 9, 258
        word = data[k : k + 1]
    if word:
        put(table[word])
        following += 1
        if following == (1 << width) and width < 12:
            width += 1
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, before = single.copy(), 9, b""
    out, bits, held = [], 0, 0
    for byte in data:
        bits, held = (bits << 8 | byte) & 0xFFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = single.copy(), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif before and code == len(table):
            word = before + before[:1]
        else:
            raise ValueError("LZW code before its definition")
        if before:
            table.append(before + word[:1])
        out.append(word)
        before = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


PACK = {"none": bytes, "packbits": packbits, "lzw": lzw, "deflate": lambda d: zlib.compress(d, 1)}
UNPACK = {"none": bytes, "packbits": unpackbits, "lzw": unlzw}


def unpacked(scheme: str, data: bytes, size: int) -> bytes:
    """The bytes of a strip or tile; of a deflate stream no more than it should have."""
    return zlib.decompressobj().decompress(data, max(1, size)) if scheme == "deflate" else UNPACK[scheme](data)


def write_tiff(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 2, rows: int = 256, tile: int | None = None) -> bytes:
    """Pages of shape (height, width) or (height, width, samples), 8 bits; in strips of so many rows or in square tiles of a multiple of 16."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        image = np.ascontiguousarray(page, np.uint8).reshape(*page.shape[:2], -1)
        height, width, samples = image.shape
        step_y, step_x = (tile, tile) if tile else (rows, width)
        offsets, counts = [], []
        for y in range(0, height, step_y):
            for x in range(0, width, step_x):
                block = image[y : y + step_y, x : x + step_x]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
                offsets.append(len(out))
                packed = b"".join(packbits(line.tobytes()) for line in block) if compression == "packbits" else PACK[compression](block.tobytes())  # PackBits runs end with their row
                out += packed
                counts.append(len(packed))
                out += b"\0" * (len(out) % 2)
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [CODES[compression]], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {OFFSETS: offsets, ROWS: [rows], COUNTS: counts}
        entries = []
        for tag, values in sorted(tags.items()):
            kind, letter = (4, "I") if tag in (OFFSETS, COUNTS, TILE_OFFSETS, TILE_COUNTS, WIDTH, HEIGHT, ROWS) else (3, "H")
            raw = struct.pack(f"<{len(values)}{letter}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", where)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image directory; a chain that runs in a circle is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories run in a circle")
        seen.add(at)
        tags = {}
        n = struct.unpack_from(f"{order}H", data, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if letter := FIELD.get(kind):
                form = f"{order}{count}{letter}"
                where = at + 10 + 12 * k
                tags[tag] = struct.unpack_from(form, data, where if struct.calcsize(form) <= 4 else struct.unpack_from(f"{order}I", data, where)[0])
        yield order, tags
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def page_of(data: bytes, order: str, tags: dict[int, tuple], max_samples: int) -> dict:
    """Decode one directory's image."""
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(PREDICTOR, 1)
    bits, scheme, planar = one(BITS, 1), SCHEMES.get(one(COMPRESSION, 1)), one(PLANAR, 1)
    tiled = TILE_OFFSETS in tags
    if not width or not height or scheme is None or bits not in (1, 8, 16) or predictor not in (1, 2) or (bits == 1 and (samples > 1 or predictor == 2)) or len(set(tags.get(BITS, (1,)))) > 1:
        raise ValueError("unsupported kind of image")
    if width * height * samples > max_samples:
        raise ValueError(f"more than {max_samples} samples")
    step_x, step_y = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    offsets, counts = tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS]
    kind = np.dtype(np.uint8 if bits < 16 else f"{order}u2")
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    image = np.zeros((height, width, samples), kind.newbyteorder("=") if bits == 16 else np.uint8)
    across, down = -(-width // step_x), -(-height // step_y)
    for k in range(planes * across * down):
        plane, y, x = k // (across * down), k // across % down * step_y, k % across * step_x
        rows = step_y if tiled else min(step_y, height - y)
        stride = -(-step_x * each * bits // 8)
        raw = unpacked(scheme, data[offsets[k] : offsets[k] + counts[k]], rows * stride)
        if bits == 1:
            block = np.unpackbits(np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride), axis=1)[:, :step_x, None]
        else:
            block = np.frombuffer(raw, kind, rows * step_x * each).reshape(rows, step_x, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=image.dtype)
        part = image[y : y + rows, x : x + step_x, plane : plane + 1] if planes > 1 else image[y : y + rows, x : x + step_x]
        part[...] = block[: part.shape[0], : part.shape[1]]
    shares = np.bincount(image.reshape(-1) if bits < 16 else (image.reshape(-1) >> 8)) / image.size
    shares = shares[shares > 0]
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": scheme, "predictor": predictor, "tiled": tiled, "blocks": len(offsets), "mean": float(image.mean()), "entropy": float(-(shares * np.log2(shares)).sum()) + 0.0, "pixels": image.tobytes(), "error": None}


def pages_of(data: bytes | None, max_samples: int = MAX_SAMPLES) -> list[dict]:
    """All pages; what cannot be read gives a page with its error. Null gives no page."""
    if data is None:
        return []
    pages, blank = [], dict.fromkeys(PAGE.fieldNames())
    try:
        for order, tags in directories(data):
            try:
                pages.append(blank | page_of(data, order, tags, max_samples))
            except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error, ZeroDivisionError) as e:
                pages.append(blank | {"error": str(e) or type(e).__name__})
    except (ValueError, struct.error) as e:
        pages.append(blank | {"error": str(e)})
    for k, p in enumerate(pages):
        p |= {"number": k, "of": len(pages)}
    return pages


def decode_tiff(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",), as_col: str = "page", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """One row per page of each stored file: the columns in keep, then as_col, a struct of PAGE (pixels: row by row, samples of a pixel together).

    A null file has no rows. A file or page that cannot be decoded has one row with page.error and null pixels; nothing is dropped silently. Repeated rows
    give repeated pages; null keys stay; an empty table gives none. Columns not named in keep are not read. keep must not hold as_col (ValueError).
    """
    if as_col in keep or len(set(keep)) < len(keep):
        raise ValueError(f"{as_col} and the columns kept need different names")
    ship(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(as_col, PAGE)])
    arrow = pa.struct([pa.field(f.name, {"integer": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}[f.dataType.typeName()]) for f in PAGE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(len(keep))
            for start in range(0, batch.num_rows, 256):  # so that decoded pages of few rows are held at a time
                found = [pages_of(x.as_py(), max_samples) for x in media[start : start + 256]]
                rows = pa.array(np.repeat(np.arange(start, start + len(found)), [len(x) for x in found]), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(keep))), pa.array([p for x in found for p in x], arrow)], names=schema.fieldNames())

    return df.select(*keep, F.col(media_col).alias("_media")).mapInArrow(run, schema)


def encode_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, compression: str = "deflate", predictor: int = 2, rows: int = 256) -> DataFrame:
    """Store each text's UTF-8 bytes, with bytes 0 up to a positive multiple of width, as one 8-bit TIFF page of that width.

    Returns id_col, n_bytes (without padding), media. Null text counts as empty; null ids, repeated rows and other columns as in decode_tiff.
    """
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in texts(batch.column(1))]
            media = [write_tiff([np.frombuffer(b + b"\0" * (-len(b) % width or (0 if b else width)), np.uint8).reshape(-1, width)], compression, predictor, rows) for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=schema.fieldNames())

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
