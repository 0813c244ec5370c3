"""Web archives of zstd frames that share a dictionary.

An archive starts with a skippable frame that holds a Zstandard dictionary, built from records that the
archives hold; each record after it is a frame of its own, so a reader can start at any record's offset.  Equal
payloads are stored once: one record is the response, the others are revisits that refer to it.

The rows are first written once to the shared folder, each with a number of its own, and everything after that
looks at those.  Tasks write archives under names of the attempt; only those that the committed manifest names
are then moved to where readers look, so what a lost executor began is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import by_size, materialize, partitions, slices

#: Frames that hold a dictionary, and the range of all skippable ones (fixed values of the formats).
DICTIONARY_FRAME, SKIPPABLE, FRAME = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), b"\x28\xb5\x2f\xfd"
#: What a revisit says about its payload (fixed value).
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Of the table of repeated payloads, that a task may hold.
BROADCAST_ROWS = 100_000


class Archive(NamedTuple):
    """``least``: bytes from which a repeated payload is stored once.  ``bytes``: after which the next archive
    begins.  The dictionary has at most ``dictionary`` bytes, from no more than ``sample`` different payloads of
    at most ``sample_bytes`` each; it is what the archives are packed with, and no row depends on it."""

    least: int = 1000
    bytes: int = 64 << 20
    level: int = 3
    dictionary: int = 112_640
    sample: int = 1024
    sample_bytes: int = 65_536
    date: str = "1970-01-01T00:00:00Z"


# --- records -------------------------------------------------------------------------------------------


def _value(text: str) -> str:
    """A header's value on one line: control characters, and blanks at its ends, are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]|^ +| +$", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), text)


def record_id(run: str, number: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{run}:{number}'.encode()).digest()[:16], version=5)}>"


def record(kind: str, ident: str, date: str, block: bytes, **fields: str | None) -> bytes:
    """One record's bytes; fields without a value are left out."""
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": date, **{k.replace("_", "-"): v for k, v in fields.items()}, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {_value(v)}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def page_record(run: str, date: str, row: dict) -> bytes:
    """A response with its payload, or a revisit that has only the heads."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n']}\r\n\r\n".encode()
    ident, number = record_id(run, row["number"]), row["page_id"]
    told = {
        "WARC_Target_URI": row["url"],
        "WARC_Payload_Digest": f"sha1:{base64.b32encode(row['digest']).decode()}",
        "Content_Type": "application/http; msgtype=response",
        "Page_ID": None if number is None else str(number),
    }
    if row["stored"] is None or row["stored"] == row["number"]:
        return record("response", ident, date, http + row["payload"].encode(), **told)
    return record("revisit", ident, date, http, **told, WARC_Profile=IDENTICAL, WARC_Refers_To=record_id(run, row["stored"]), WARC_Refers_To_Target_URI=row["stored_url"], WARC_Refers_To_Date=date)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads (names in lower case) and block of each record in ``data``."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError("not a WARC record")
        head = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"not a head: {line[:40]}")
            head[name.strip().lower()] = value.strip(" \t")
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is too short")
        yield head, data[start:stop]
        at = stop + 4


# --- archives ------------------------------------------------------------------------------------------


def dictionary(records: list[bytes], size: int) -> bytes:
    """A trained dictionary; empty where the records are too few to train one."""
    try:
        return zstandard.train_dictionary(size, records, k=1024, d=8).as_bytes() if len(records) > 7 else b""
    except zstandard.ZstdError:
        return b""


class Writer:
    """One archive: the dictionary's frame, a record about the archive, then what it is given."""

    def __init__(self, out, trained: bytes, level: int, about: bytes):
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
        self.out, self.size, self.records = out, 0, 0
        if trained:
            packed = zstandard.compress(trained, 19)
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self._put(self.packer.compress(about))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.packer.compress(data))
        self.records += 1


def frames(stream, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each frame, by the dictionary that the stream starts with, if any; one frame
    is held at a time.  ValueError where the archive is damaged."""
    held, at, reader = b"", 0, zstandard.ZstdDecompressor()

    def more(n: int) -> bool:
        nonlocal held
        while len(held) < n and (got := stream.read(max(chunk, n - len(held)))):
            held += got
        return len(held) >= n

    while more(1):
        if not more(8):
            raise ValueError("the archive ends in a frame")
        magic, size = struct.unpack("<II", held[:8])
        if magic in SKIPPABLE:
            if not more(8 + size):
                raise ValueError("the archive ends in a frame")
            if at == 0 and magic == DICTIONARY_FRAME:
                own = held[8 : 8 + size]
                own = zstandard.ZstdDecompressor().decompress(own) if own.startswith(FRAME) else own
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
            held, at = held[8 + size :], at + 8 + size
            continue
        unpacker = reader.decompressobj()
        content, length = [], 0
        try:
            while not unpacker.eof:
                if not more(1):
                    raise ValueError("the archive ends in a frame")
                content.append(unpacker.decompress(held))
                length += len(held)
                held = unpacker.unused_data
            length -= len(held)
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged: {e}") from e
        yield at, length, b"".join(content)
        at += length


# --- writing -------------------------------------------------------------------------------------------

MANIFEST = "part int, number int, attempt string, records long, bytes long"


def write_warcs(pages: DataFrame, folder: str, archive: Archive = Archive(), id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Archives of ``pages`` in ``folder`` (a URI that executors can write to): path, records and bytes of each.

    Of the rows with the same payload of ``archive.least`` bytes or more, that with the largest id is the
    response (null ids are smallest; of repeated rows any one); the others are revisits of it.  Payloads below
    that size are all responses.  Null payloads are empty, null urls and ids are left out of a record's head;
    payloads of any length are stored whole; an empty table gives no archives.  Other columns don't matter.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    own = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), text.alias("payload"))
    own = own.select("*", F.monotonically_increasing_id().alias("number"), F.unhex(F.sha1(F.encode("payload", "utf-8"))).alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    own = materialize(own, "warc-rows")
    top = F.max(F.struct("page_id", "number", "url")).alias("top")
    groups = materialize(own.groupBy("digest", "n").agg(top, F.count("*").alias("copies")), "warc-payloads")
    trained = _trained(own, groups, archive)
    stored = groups.filter((F.col("n") >= archive.least) & (F.col("copies") > 1)).select("digest", F.col("top.number").alias("stored"), F.col("top.url").alias("stored_url"))
    told = own.join(by_size(stored, BROADCAST_ROWS), "digest", "left")
    run, about = uuid.uuid4().hex, "software: tidemark\r\nformat: WARC File Format 1.1\r\n"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/attempts", recursive=True)
        part, made, writer, name = TaskContext.get().partitionId(), 0, None, ""

        def closed() -> pa.RecordBatch:
            nonlocal writer, made
            writer.out.close()
            one = [{"part": part, "number": made, "attempt": name, "records": writer.records, "bytes": writer.size}]
            writer, made = None, made + 1
            return pa.RecordBatch.from_pylist(one, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("attempt", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    info = record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", archive.date, about.encode(), Content_Type="application/warc-fields")
                    writer = Writer(system.open_output_stream(f"{root}/attempts/{name}"), trained, archive.level, info)
                writer.add(page_record(run, archive.date, row))
                if writer.size >= archive.bytes:
                    yield closed()
        if writer is not None:
            yield closed()

    return _published(materialize(told.mapInArrow(rows, MANIFEST), "warc-manifest"), folder, run)


def _trained(own: DataFrame, groups: DataFrame, archive: Archive) -> bytes:
    """The dictionary of a bounded number of different payloads, as their records; chosen by a hash, so that the
    same pages give the same one.  One task trains it."""
    few = groups.filter((F.col("n") > 0) & (F.col("n") <= archive.sample_bytes)).orderBy(F.xxhash64("digest"), "digest").limit(archive.sample)
    chosen = own.join(F.broadcast(few.select(F.col("top.number").alias("number"))), "number")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda r: r["digest"])
        made = dictionary([page_record("", archive.date, {**row, "stored": None}) for row in rows], archive.dictionary)
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([made], pa.binary())})

    found = chosen.repartition(1).mapInArrow(train, "dictionary binary").first()
    return bytes(found["dictionary"]) if found else b""


def _published(manifest: DataFrame, folder: str, run: str) -> DataFrame:
    """Moves what the manifest names to where it is read; a move that was made before is left as it is."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                names.append(f"pages-{run}-{row['part']:06d}-{row['number']:06d}.warc.zst")
                if system.get_file_info(f"{root}/{names[-1]}").type == fs.FileType.NotFound:
                    system.move(f"{root}/attempts/{row['attempt']}", f"{root}/{names[-1]}")
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{n}" for n in names], pa.string()), "records": batch["records"], "bytes": batch["bytes"]})

    made = materialize(manifest.mapInArrow(move, "path string, records long, bytes long"), "warc-archives")
    system, root = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{root}/attempts").type == fs.FileType.Directory:
        system.delete_dir(f"{root}/attempts")
    return made


# --- reading -------------------------------------------------------------------------------------------

RECORD = "archive string, offset long, length long, record_type string, record_id string, page_id long, url string, digest string, full_bytes long, refers_to string, payload binary, error string"
_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for n, t in (c.split() for c in RECORD.split(", "))])


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of a folder's archives."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")


def _row(head: dict[str, str], block: bytes) -> dict:
    """What a response or revisit says; ``payload`` is null for a revisit."""
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = re.findall(rb"(?mi)^content-length:\s*([0-9]+)\s*$", http)
    algorithm, _, digest = head.get("warc-payload-digest", "").partition(":")
    response = head["warc-type"] == "response"
    return {
        "record_type": head["warc-type"], "record_id": head.get("warc-record-id"), "page_id": int(head["page-id"]) if "page-id" in head else None,
        "url": head.get("warc-target-uri"), "digest": base64.b32decode(digest).hex() if algorithm == "sha1" else None,
        "full_bytes": len(payload) if response else int(sizes[0]) if sizes else None, "refers_to": head.get("warc-refers-to"), "payload": payload if response else None,
    }


def read_warcs(paths: DataFrame, size: int = 2_000_000) -> DataFrame:
    """A row for each response and revisit in the archives at ``paths`` (path): where it stands, what its heads
    say, its payload.  Other kinds of records are passed over.

    An archive that is damaged gives the records before the damage and then a row with ``error`` set.  About
    ``size`` bytes of payloads are held at a time, or one record.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                out, held, at = [], 0, 0
                with system.open_input_stream(place) as stream:
                    try:
                        for at, length, content in frames(stream):
                            for head, block in parsed(content):
                                if head["warc-type"] in ("response", "revisit"):
                                    out.append({"archive": path, "offset": at, "length": length, **_row(head, block)})
                                    held += len(block)
                            if held >= size:
                                yield pa.RecordBatch.from_pylist(out, _ARROW)
                                out, held = [], 0
                    except (ValueError, KeyError) as e:
                        out.append({"archive": path, "offset": at, "error": str(e)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)

    spark = paths.sparkSession
    dealt = paths.select("path").repartition(max(1, min(paths.count(), 16 * partitions(spark))))
    return dealt.mapInArrow(rows, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: each record with the payload that it has or
    refers to, as it was read; ``refers_to`` is the response's page_id.

    A revisit whose response isn't there has null for size and digest, and so has a record that is damaged.
    """
    told = records.select("page_id", "record_type", "record_id", F.col("refers_to").alias("response"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    told = materialize(told, "warc-read")
    own = told.filter("record_type = 'response'")
    held = own.select(F.col("record_id").alias("response"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = told.filter("record_type = 'revisit'").select("page_id", "record_type", "response").join(held, "response", "left")
    return own.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(again.select(columns))
