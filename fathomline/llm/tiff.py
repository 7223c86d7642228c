"""TIFF as a media column: write and read 8-bit grey pages, one row a page.

Reader: any number of image directories, either byte order, strips or tiles, no compression, PackBits, LZW or deflate,
predictor 1 or 2, 8 bits a sample, chunky samples. Writer: the same except LZW tiles of other writers' variants.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Fixed values of the TIFF 6.0 format: tags, compression schemes, field type sizes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: A payload's unit: rows of this many samples.
ROW = 192
STRIP_ROWS = 512
#: Bytes of a page that the reader makes at most.
MOST_PIXELS = 1 << 31


def packbits_decode(data: bytes, most: int = 1 << 62) -> bytes:
    """``most`` bytes and a little more at the most."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
                i += 1
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out.append(i - start - 1)
        out += data[start:i]
    return bytes(out)


def lzw_decode(data: bytes, most: int = 1 << 62) -> bytes:
    """Codes most significant bit first, width grown one code early, 256 clears, 257 ends. Stops a word after ``most`` bytes."""
    words, out = [], bytearray()
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    bits = held = at = 0
    width, before = 9, None
    words = start[:]
    while True:
        while held < width:
            if at >= len(data):
                return bytes(out)
            bits = (bits << 8 | data[at]) & 0xFFFFFFFF
            at, held = at + 1, held + 8
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            words, width, before = start[:], 9, None
            continue
        if before is None:
            if code >= 256:
                raise ValueError("damaged LZW strip")
            word = words[code]
        else:
            if code > len(words):
                raise ValueError("damaged LZW strip")
            word = words[code] if code < len(words) else before + before[:1]
            words.append(before + word[:1])
        out += word
        if len(out) >= most:
            return bytes(out)
        before = word
        size = len(words) + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12


def lzw_encode(data: bytes) -> bytes:
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    def fresh() -> dict[bytes, int]:
        return {bytes((i,)): i for i in range(256)}

    words, following, width = fresh(), 258, 9
    put(256, 9)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in words:
            word = longer
            continue
        put(words[word], width)
        words[longer] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following >= 4094:
            put(256, width)
            words, following, width = fresh(), 258, 9
        word = data[i : i + 1]
    if word:
        put(words[word], width)
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257, width)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def deflate_decode(data: bytes, most: int = 0) -> bytes:
    """``most`` bytes at the most, all of them for 0."""
    return zlib.decompressobj().decompress(data, most)


def plain_decode(data: bytes, most: int = 1 << 62) -> bytes:
    return bytes(data[:most])


DECODE = {NONE: plain_decode, PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: deflate_decode, OLD_DEFLATE: deflate_decode}
ENCODE = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian TIFF of uint8 pages (rows, columns) or (rows, columns, samples); ``tile`` (rows, columns), multiples of 16, writes tiles."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        image = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = image.shape
        blocks = []
        if tile:
            th, tw = tile
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    block = np.zeros((th, tw, samples), np.uint8)
                    part = image[y : y + th, x : x + tw]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        places, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            data = ENCODE[compression](np.ascontiguousarray(block).tobytes())
            places.append(len(out))
            counts.append(len(data))
            out += data
            out += b"\0" * (len(out) % 2)
        at = [TILE_OFFSETS, TILE_COUNTS] if tile else [STRIP_OFFSETS, STRIP_COUNTS]
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor]), (at[0], 4, places), (at[1], 4, counts)]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_LENGTH, 4, [tile[0]])] if tile else [(ROWS_PER_STRIP, 4, [strip_rows])]
        entries = b""
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"
    return bytes(out)


def decode(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a TIFF in the order of their directories, uint8 (rows, columns, samples)."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    kind = struct.unpack_from(order + "H", data, 2)[0] if order and len(data) >= 8 else None
    if kind == 43:
        raise ValueError("a BigTIFF, whose 64-bit directories are not read")
    if kind != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        tags: dict[int, list[int]] = {}
        (entries,) = struct.unpack_from(order + "H", data, at)
        for i in range(entries):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in (1, 3, 4):
                continue
            place = at + 10 + 12 * i
            if TYPE_SIZE[kind] * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = list(struct.unpack_from(f"{order}{count}{'BxHI'[kind - 1]}", data, place))
        yield _page(data, tags)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * entries)


def _page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples, predictor = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(PREDICTOR, 1)
    if set(tags.get(BITS, [1])) != {8} or predictor not in (1, 2):
        raise ValueError("only 8-bit samples with predictor 1 or 2")
    unpack = DECODE.get(one(COMPRESSION, NONE))
    if unpack is None:
        raise ValueError(f"compression {one(COMPRESSION, NONE)}")
    tiled = TILE_OFFSETS in tags
    bh, bw = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    places, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, [])
    if not min(width, height, samples, bh, bw) or len(places) != len(counts) or len(places) != -(-height // bh) * -(-width // bw):
        raise ValueError("a directory without size or with too few strips or tiles")
    if width * height * samples > MOST_PIXELS:
        raise ValueError("a page above the limit")
    out = np.empty((height, width, samples), np.uint8)
    across = -(-width // bw)
    for i, (place, count) in enumerate(zip(places, counts, strict=True)):
        y, x = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, height - y)
        size = rows * bw * samples
        # No more than the block needs is unpacked, whatever the bytes would give.
        raw = unpack(data[place : place + count], size)
        if len(raw) < size:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(raw, np.uint8)[:size].reshape(rows, bw, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + bw] = block[: height - y, : width - x]
    return out


PAGES = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])


def pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, page, width, height, samples, pixels, error) of TIFF files, one row a page.

    A null file has no rows; a damaged one its pages up to the damage and then a row that says what is wrong, in place of ending the job. Rows that
    repeat an id have their pages each; columns other than the two are not read; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                k = 0
                try:
                    for page in decode(data.as_py()):
                        yield pa.RecordBatch.from_pylist([{"id": key, "page": k, "width": page.shape[1], "height": page.shape[0], "samples": page.shape[2], "pixels": page.tobytes()}], schema=PAGES)
                        k += 1
                except (ValueError, struct.error, IndexError, zlib.error) as wrong:
                    yield pa.RecordBatch.from_pylist([{"id": key, "page": k, "error": str(wrong)}], schema=PAGES)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary")).mapInArrow(run, "id long, page int, width int, height int, samples int, pixels binary, error string")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length and the bytes padded with spaces to a positive multiple of a row."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def store(payload: bytes) -> bytes:
    """One grey page of 192 columns in deflate strips."""
    return encode([np.frombuffer(payload, np.uint8).reshape(-1, ROW)], DEFLATE, 1)


def features(page: np.ndarray) -> str:
    """Sorted JSON of a page's shape and grey statistics; equal pages give equal strings."""
    counts = np.bincount(page.ravel(), minlength=256)
    total = int(counts.sum())
    levels = np.arange(256)
    mean = float((counts * levels).sum() / total)
    var = float((counts * (levels - mean) ** 2).sum() / total)
    return json.dumps({"width": page.shape[1], "height": page.shape[0], "mean": round(mean, 6), "std": round(var**0.5, 6), "levels": int((counts > 0).sum())}, sort_keys=True)


def op6_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a one-page TIFF, read back. Null and empty texts are one row of spaces; the texts are never cut.

    Equal texts give equal values, whatever their ids; rows that repeat an id have a row each; other columns are not read; an empty table gives no rows.
    """

    def run(ids, texts):
        rows = []
        for text in texts:
            n, payload = payload_of(text)
            media = store(payload)
            page = np.concatenate([p.reshape(-1) for p in decode(media)])
            back = page.tobytes()
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(page.reshape(-1, ROW))))
        columns = list(zip(*rows, strict=True))
        return {"doc_id": ids} | {k: pa.array(v, t) for k, v, t in zip(("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)}

    return map_texts(table(spark, sf_dir, "documents"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
