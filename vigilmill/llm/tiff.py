"""TIFF media columns: a reader that walks image directories to one row per page, and the writer of its test forms.

Read: both byte orders, chains of directories, strips and tiles, no compression, PackBits, LZW (early change, most
significant bit first) and deflate, horizontal differencing, 8-bit chunky samples.  Whatever is wrong with a file ends as its
error text: declared sizes are held against a limit before anything is unpacked, and nothing is unpacked beyond them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmill.llm.common import free_names

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Fixed values of the format: tag numbers, and bytes of a value by type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

#: The stored form: rows of 576 samples, at most this many rows in a page and in a strip.
ROW = 576
PAGE_ROWS = 64
STRIP = 16
TILE = (64, 16)
#: Samples of all pages of a file at most.
MOST_SAMPLES = 1 << 30
#: Decoded bytes that a task holds before it passes them on, besides those of one file.
DECODED_BYTES = 64 << 20


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes, most: int = MOST_SAMPLES) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n, plain = bytearray(), 0, len(data), 0

    def flush(upto: int) -> None:
        for at in range(plain, upto, 128):
            part = data[at : min(upto, at + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    while i + 2 < n:
        if data[i] == data[i + 1] == data[i + 2]:
            flush(i)
            j = i + 3
            while j < n and data[j] == data[i] and j - i < 128:
                j += 1
            out += bytes((257 - (j - i), data[i]))
            i = plain = j
        else:
            i += 1
    flush(n)
    return bytes(out)


CLEAR, END = 256, 257
_SINGLE = [bytes((i,)) for i in range(256)] + [b"", b""]
_CODE = {bytes((i,)): i for i in range(256)}


def unpack_lzw(data: bytes, most: int = MOST_SAMPLES) -> bytes:
    """Codes of 9 to 12 bits, widened one code early as the format has it; ends once `most` bytes are there."""
    out: list[bytes] = []
    left = most
    table = list(_SINGLE)
    acc = held = at = 0
    width, last, n = 9, b"", len(data)
    while True:
        while held < width:
            if at >= n:
                return b"".join(out)
            acc = (acc & 0xFFFF) << 8 | data[at]
            at += 1
            held += 8
        held -= width
        code = acc >> held & (1 << width) - 1
        if code == CLEAR:
            table, width, last = list(_SINGLE), 9, b""
            continue
        if code == END:
            return b"".join(out)
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        left -= len(entry)
        if left <= 0:
            return b"".join(out)
        if last and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = entry


def pack_lzw(data: bytes) -> bytes:
    out, acc, held = bytearray(), CLEAR, 9
    table, width, word = dict(_CODE), 9, b""
    following = 258

    def drained(acc: int, held: int) -> tuple[int, int]:
        whole = held >> 3
        out.extend((acc >> (held & 7)).to_bytes(whole, "big"))
        return acc & (1 << (held & 7)) - 1, held & 7

    for byte in _split(data):
        longer = word + byte
        if longer in table:
            word = longer
            continue
        acc, held = acc << width | table[word], held + width
        table[longer] = following
        following += 1
        word = byte
        if following > (1 << width) - 1:
            if width < 12:
                width += 1
            else:
                acc, held = acc << 12 | CLEAR, held + 12
                table, width, following = dict(_CODE), 9, 258
        if held > 512:
            acc, held = drained(acc, held)
    if word:
        acc, held = acc << width | table[word], held + width
        if following + 1 > (1 << width) - 1 and width < 12:
            width += 1
    acc, held = acc << width | END, held + width
    pad = -held % 8
    acc, held = drained(acc << pad, held + pad)
    return bytes(out)


def _split(data: bytes) -> list[bytes]:
    return [_SINGLE[b] for b in data]


def _unpacked(data: bytes, compression: int, most: int) -> bytes:
    """A strip or tile; at most about `most` bytes of it."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, most)
    if compression == LZW:
        return unpack_lzw(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise TiffError(f"compression {compression}")


def _packed(data: bytes, compression: int) -> bytes:
    if compression == PACKBITS:
        return pack_bits(data)
    if compression == LZW:
        return pack_lzw(data)
    return zlib.compress(data, 1) if compression == DEFLATE else data


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The entries of each image directory; a chain that returns to a directory or leaves the file is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("directory chain")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise TiffError("directory beyond the file")
        entries = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = SIZES.get(kind, 0) * count
            place = at + 10 + 12 * k
            if size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if place + size > len(data):
                raise TiffError("value beyond the file")
            if kind in (1, 3, 4):
                entries[tag] = struct.unpack_from(f"{order}{count}{'BHI'[(kind == 3) + 2 * (kind == 4)]}", data, place)
        yield entries
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_page(data: bytes, tags: dict[int, tuple], most: int = MOST_SAMPLES) -> np.ndarray:
    """uint8[height, width, samples] of a directory, of `most` samples at most."""

    def one(tag: int, default=None) -> int:
        value = tags.get(tag, (default,))
        if not value or value[0] is None:
            raise TiffError(f"tag {tag} is missing")
        return value[0]

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if set(tags.get(BITS, (1,))) != {8}:
        raise TiffError("only 8-bit samples")
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(STRIP_ROWS, height)))
    offsets, counts = (tags[t] if t in tags else () for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    if min(width, height, samples, w, h) < 1:
        raise TiffError("a size is zero")
    if width * height * samples > most or w * h * samples > most:
        raise TiffError("page too large")
    across, down = -(-width // w), -(-height // h)
    if len(offsets) != across * down or len(counts) != len(offsets):
        raise TiffError("strips or tiles do not cover the page")
    page = np.zeros((height, width, samples), np.uint8)
    for k, (at, size) in enumerate(zip(offsets, counts)):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        raw = _unpacked(data[at : at + size], one(COMPRESSION, 1), rows * w * samples)
        if len(raw) < rows * w * samples:
            raise TiffError("a strip or tile is too short")
        block = np.frombuffer(raw, np.uint8, rows * w * samples).reshape(rows, w, samples)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        elif one(PREDICTOR, 1) != 1:
            raise TiffError("predictor")
        page[y : y + rows, x : x + w] = block[: height - y, : width - x]
    return page


def write_tiff(pages: list[np.ndarray], compression: int, predictor: int, tiled: bool) -> bytes:
    """A little-endian file of uint8[height, width] pages."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        if tiled:
            w, h = TILE
            full = np.zeros((-(-height // h) * h, -(-width // w) * w), np.uint8)
            full[:height, :width] = page
            blocks = [full[y : y + h, x : x + w] for y in range(0, height, h) for x in range(0, width, w)]
        else:
            h = min(STRIP, height)
            blocks = [page[y : y + h] for y in range(0, height, h)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate((b[:, :1], np.diff(b, axis=1)), axis=1)
            raw = _packed(b.tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw + b"\0" * (len(raw) & 1)
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [TILE[0]], TILE_HEIGHT: [TILE[1]], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tiled else {STRIP_OFFSETS: offsets, STRIP_ROWS: [h], STRIP_COUNTS: counts}
        fields = b""
        for tag in sorted(tags):
            values = tags[tag]
            raw = struct.pack(f"<{len(values)}I", *values)
            place = raw
            if len(raw) > 4:
                place = struct.pack("<I", len(out))
                out += raw
            fields += struct.pack("<HHI", tag, 4, len(values)) + place
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: The stored forms, dealt to texts by their checksum: compression, predictor, tiles.
FORMS = ((PACKBITS, 1, False), (LZW, 1, False), (DEFLATE, 2, True), (DEFLATE, 1, False), (PACKBITS, 1, True), (LZW, 2, False))


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (ROW * max(1, -(-len(raw) // ROW)) - len(raw)), len(raw)


def store(data: bytes) -> bytes:
    samples = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    pages = [samples[y : y + PAGE_ROWS] for y in range(0, len(samples), PAGE_ROWS)]
    return write_tiff(pages, *FORMS[zlib.crc32(data) % len(FORMS)])


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes (null: none) as a TIFF file; one row for a row, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [payload(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([store(d) for d, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


PAGE = "struct<page:int,width:int,height:int,samples_per_pixel:int,compression:int,predictor:int,tiled:boolean,mean:double,deviation:double,low:int,high:int,samples:binary>"


def decode_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """media with `pages` (array of PAGE, in file order) and `error`; a null, empty or damaged file has no pages and says why.

    Other columns pass through; where one of them is named so, underscores go before the new name.  The bytes are read where
    they lie: nothing is shuffled.
    """
    names = media.columns
    pages_, error_ = free_names(names, "pages", "error")
    kind = pa.list_(pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples_per_pixel", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()),
                               ("mean", pa.float64()), ("deviation", pa.float64()), ("low", pa.int32()), ("high", pa.int32()), ("samples", pa.binary())]))

    def read(data: bytes | None) -> tuple[list, str | None]:
        if not data:
            return [], "empty"
        pages, left = [], MOST_SAMPLES
        try:
            for n, tags in enumerate(directories(data)):
                p = read_page(data, tags, left)
                left -= p.size
                # A mean and deviation from whole sums, so that equal pages give equal numbers everywhere.
                hist = np.bincount(p.reshape(-1), minlength=256)
                total, level = int(hist.sum()), np.arange(256)
                if not total:
                    raise TiffError("page without samples")
                mean = int(hist @ level) / total
                deviation = (max(0.0, int(hist @ (level * level)) / total - mean * mean)) ** 0.5
                used = np.flatnonzero(hist)
                pages.append({"page": n, "width": p.shape[1], "height": p.shape[0], "samples_per_pixel": p.shape[2], "compression": tags.get(COMPRESSION, (1,))[0], "predictor": tags.get(PREDICTOR, (1,))[0],
                              "tiled": TILE_OFFSETS in tags, "mean": mean, "deviation": deviation, "low": int(used[0]), "high": int(used[-1]), "samples": p.tobytes()})
        except Exception as e:  # a file may be wrong in any way
            return [], str(e) or type(e).__name__
        return pages, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, lo, found, size = b.column(names.index(column)), 0, [], 0
            for i in range(b.num_rows):
                found.append(read(files[i].as_py()))
                size += sum(len(p["samples"]) for p in found[-1][0])
                # Decoded samples are passed on once they are many, so a folder of large files is never held decoded.
                if size >= DECODED_BYTES or i == b.num_rows - 1:
                    part = b.slice(lo, i + 1 - lo)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.string())], [*names, pages_, error_])
                    lo, found, size = i + 1, [], 0

    from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

    schema = StructType([*media.schema.fields, StructField(pages_, _parse_datatype_string(f"array<{PAGE}>")), StructField(error_, StringType())])
    return media.mapInArrow(run, schema)


def page_rows(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of each file: media's other columns, then the fields of PAGE (underscores go before a name that is taken)."""
    others = [c for c in media.columns if c != column]
    read = decode_pages(media, column)
    fields = free_names(others, *[f.split(":")[0] for f in PAGE[7:-1].split(",")])
    return read.select(*others, F.inline(F.col(read.columns[-2])).alias(*fields))


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as TIFF and read back: the digests come from the decoded samples of its pages, in order.

    One row for a row of docs; null and empty texts have a payload of fill bytes alone; equal texts have equal values.
    """
    read = decode_pages(encode_texts(docs))
    whole = F.unhex(F.array_join(F.transform("pages", lambda p: F.hex(p["samples"])), ""))  # linear in the pages
    read = read.withColumn("payload", F.when(F.size("pages") == 1, F.col("pages")[0]["samples"]).otherwise(whole))
    feature = F.concat_ws(
        ";", F.concat(F.lit("pages="), F.size("pages")), F.concat(F.lit("compression="), F.col("pages")[0]["compression"]), F.concat(F.lit("predictor="), F.col("pages")[0]["predictor"]),
        F.concat(F.lit("tiled="), F.col("pages")[0]["tiled"]), F.concat(F.lit("rows="), F.aggregate("pages", F.lit(0), lambda n, p: n + p["height"])),
        F.concat(F.lit("mean="), F.array_join(F.transform("pages", lambda p: F.format_string("%.4f", p["mean"])), ",")),
        F.concat(F.lit("deviation="), F.array_join(F.transform("pages", lambda p: F.format_string("%.4f", p["deviation"])), ",")),
    )
    n = F.octet_length("payload")
    return read.select(
        "doc_id", "n_bytes", n.cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
