"""TIFF columns: pages out of files, and files out of payloads.

Reading walks the image directories, decodes strips or tiles (stored, PackBits, LZW, deflate), undoes the
horizontal predictor and gives a row for each page.  Writing stores bytes as 8-bit grey pages of 64 samples
a line, deflated with the predictor.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices

#: Of a payload file: samples in a line, lines in a strip, lines in a page.
WIDTH, STRIP, PAGE = 64, 512, 8192
#: A page may claim so many bytes at most; more is an error, not memory.
LARGEST = 1 << 28
#: Field types' sizes and codes, by the format (fixed values).
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NUMBERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
#: Tags (fixed values).
COLUMNS, LINES, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_LINES, STRIP_BYTES, PLANAR, PREDICTOR, TILE_COLUMNS, TILE_LINES, TILE_AT, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends; widths grow one code early."""
    out = bytearray()
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last = list(base), b""
    width, held, bits = 9, 0, 0
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, last, width = list(base), b"", 9
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("an LZW code that isn't defined")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == STORED:
        out = data
    elif compression == PACKBITS:
        out = unpackbits(data, size)
    elif compression == LZW:
        out = unlzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression} isn't supported")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in NUMBERS:
            continue
        place = at + 10 + 12 * k
        if SIZES[kind] * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if SIZES[kind] * count > len(data):
            raise ValueError("a field is longer than the file")
        fields[tag] = struct.unpack_from(f"{order}{count}{NUMBERS[kind]}", data, place)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return fields, following


def _page(data: bytes, f: dict[int, tuple], order: str) -> np.ndarray:
    columns, lines, samples = f[COLUMNS][0], f[LINES][0], f.get(SAMPLES, (1,))[0]
    bits, compression, predictor, planar = f.get(BITS, (1,)), f.get(COMPRESSION, (STORED,))[0], f.get(PREDICTOR, (1,))[0], f.get(PLANAR, (1,))[0]
    if len(set(bits)) != 1 or bits[0] not in (8, 16, 32) or predictor not in (1, 2):
        raise ValueError(f"{bits} bits with predictor {predictor} aren't supported")
    kind = np.dtype(f"{order}u{bits[0] // 8}")
    if columns < 1 or lines < 1 or samples < 1:
        raise ValueError("the page has no samples")
    if columns * lines * samples * kind.itemsize > LARGEST:
        raise ValueError("the page is too large")
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    out = np.zeros((lines, columns, samples), kind)
    tiled = TILE_AT in f
    high, wide = (f[TILE_LINES][0], f[TILE_COLUMNS][0]) if tiled else (min(f.get(STRIP_LINES, (lines,))[0], lines), columns)
    if high < 1 or wide < 1 or high * wide * samples * kind.itemsize > LARGEST:
        raise ValueError("a strip or tile has no samples, or too many")
    places, sizes = (f[TILE_AT], f[TILE_BYTES]) if tiled else (f[STRIP_AT], f[STRIP_BYTES])
    across, down = -(-columns // wide), -(-lines // high)
    if min(len(places), len(sizes)) < planes * across * down:
        raise ValueError("strips or tiles are missing")
    for k in range(planes * across * down):
        plane, (row, column) = k // (across * down), divmod(k % (across * down), across)
        tall = high if tiled else min(high, lines - row * high)
        block = np.frombuffer(_decode(data[places[k] : places[k] + sizes[k]], compression, tall * wide * depth * kind.itemsize), kind).reshape(tall, wide, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        here = out[row * high : row * high + tall, column * wide : column * wide + wide, plane : plane + depth]
        here[...] = block[: here.shape[0], : here.shape[1]]
    return out


def pages(data: bytes) -> Iterator[np.ndarray]:
    """Each page's samples (lines, columns, samples); ValueError where the file is damaged or not supported."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if not order:
        raise ValueError("not a TIFF file")
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("the directories run in a circle")
            seen.add(at)
            fields, at = _fields(data, at, order)
            yield _page(data, fields, order)
    except (struct.error, KeyError, IndexError, TypeError, OverflowError, ZeroDivisionError, zlib.error) as e:
        raise ValueError(f"damaged: {e!r}") from e


def write(payload: bytes) -> bytes:
    """A file whose pages' samples are ``payload`` (a positive multiple of 64 bytes) again."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(lines), PAGE):
        page = lines[top : top + PAGE]
        places, sizes = [], []
        for start in range(0, len(page), STRIP):
            strip = page[start : start + STRIP]
            packed = zlib.compress(np.diff(strip, axis=1, prepend=np.uint8(0)).tobytes(), 1)
            places.append(len(out))
            sizes.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)
        fields = [(COLUMNS, 4, [WIDTH]), (LINES, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]), (STRIP_AT, 4, places), (SAMPLES, 3, [1]), (STRIP_LINES, 4, [STRIP]), (STRIP_BYTES, 4, sizes), (PREDICTOR, 3, [2])]
        struct.pack_into("<I", out, link, len(out))
        directory, more = struct.pack("<H", len(fields)), b""
        behind = len(out) + 2 + 12 * len(fields) + 4
        for tag, kind, values in fields:
            packed = struct.pack(f"<{len(values)}{NUMBERS[kind]}", *values)
            if len(packed) > 4:
                packed, more = struct.pack("<I", behind + len(more)), more + packed
            directory += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        link = len(out) + len(directory)
        out += directory + b"\0\0\0\0" + more
    return bytes(out)


def read_pages(files: DataFrame, id_column: str, data_column: str) -> DataFrame:
    """id, page, width, height, samples, bits, pixels, error: a row for each page, pages counted from 0.

    ``pixels``: samples in reading order, little-endian.  A null, empty or damaged file gives the pages before
    the damage and then a row with ``error`` set and no pixels; so does a page that claims more than ``LARGEST``
    bytes (256 MB), which no task should hold.  A null id stays; repeated rows give repeated rows; an empty table
    gives none; other columns don't matter.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            for i, data in enumerate(batch["data"]):
                own, number = batch["id"].slice(i, 1), -1
                try:
                    for number, page in enumerate(pages(data.as_py() or b"")):
                        height, width, samples = page.shape
                        yield _page_row(own, number, width, height, samples, 8 * page.itemsize, page.astype(page.dtype.newbyteorder("<")).tobytes(), None)
                except ValueError as e:
                    yield _page_row(own, number + 1, None, None, None, None, None, str(e))

    kind = files.schema[id_column].dataType.simpleString()
    return files.select(F.col(id_column).alias("id"), F.col(data_column).alias("data")).mapInArrow(rows, f"id {kind}, {PAGE_ROW}")


PAGE_ROW = "page int, width int, height int, samples int, bits int, pixels binary, error string"


def _page_row(ident: pa.Array, *cells) -> pa.RecordBatch:
    """One row, with the id as it came."""
    kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([ident, *(pa.array([c], k) for c, k in zip(cells, kinds, strict=True))], names=["id", *(c.split()[0] for c in PAGE_ROW.split(", "))])


def payload(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length, and its bytes filled with 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def feature(parts: list[np.ndarray]) -> str:
    """Pages, mean and spread of the samples, mean step along a line, and a histogram of 16 classes."""
    flat = np.concatenate([p.reshape(-1, WIDTH) for p in parts])
    counts = np.bincount(flat.ravel(), minlength=256)
    n, values = int(counts.sum()), np.arange(256)
    mean = float(counts @ values) / n
    spread = max(0.0, float(counts @ values**2) / n - mean**2) ** 0.5
    step = float(np.abs(np.diff(flat.astype(np.int16), axis=1)).sum()) / n
    return f"pages={len(parts)};mean={mean:.4f};sd={spread:.4f};step={step:.4f};hist=" + ",".join(map(str, counts.reshape(16, 16).sum(1)))


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each whole text stored as TIFF, read back, and described by what was read: the columns of ``MEDIA``.

    Null and empty texts are 64 bytes 0, very long ones as many pages as they need; null ids stay; repeated rows
    give repeated rows; an empty table none; other columns don't matter.
    """

    names = [c.split()[0] for c in MEDIA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in MEDIA.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in batch["text"].to_pylist():
                n, raw = payload(text)
                stored = write(raw)
                parts = [p[:, :, 0] for p in pages(stored)]
                back = b"".join(p.tobytes() for p in parts)
                out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(parts)))
            cells = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cells], names=names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(rows, MEDIA)
