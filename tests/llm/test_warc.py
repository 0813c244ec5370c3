"""Archives against brute force: who is stored, what is read back, odd rows, damage, lost attempts."""

import hashlib
import io
import random
import struct

import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F
from tidemark.llm import warc
from tidemark.llm.shared import shared_dir

PAGES = "page_id long, url string, html string, digest string"


def brute(rows):
    """(page_id, bytes, digest, kind, refers_to) of each row; of repeated rows any one is the response."""
    largest = {}
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            largest[raw] = max(largest.get(raw, -(2**63)), -(2**63) if page is None else page)
    out, seen = [], set()
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        top = largest.get(raw)
        first = top is None or ((-(2**63) if page is None else page) == top and raw not in seen)
        if top is not None and first:
            seen.add(raw)
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first else "revisit", None if first or top == -(2**63) else top))
    return sorted(out, key=str)


def pages(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    body = lambda k: "<p>" + " ".join(rng.choices(words, k=k)) + "é日</p>"
    common, other = body(400), body(300)
    rows = [(i, f"http://h{i % 7}/a?{i}", rng.choice([common, common, other, "short", body(rng.randrange(500)), "", None]), "mine") for i in range(n)]
    odd = [(2**60 + 1, "http://x/\r\n\tWARC-Type: odd", common, None), (None, None, other, None), (5, "http://again/", common, None), (5, "http://again/", common, None), (1007, " http://blank ", body(40_000), None)]
    return rows + odd


def written(spark, rows, archive=warc.Archive()):
    folder = f"{shared_dir(spark)}/warc-test-{random.random()}"
    return folder, warc.write_warcs(spark.createDataFrame(rows, PAGES).repartition(5), folder, archive)


def test_archives_give_back_every_page(spark):
    rows = pages()
    folder, made = written(spark, rows)
    records = warc.read_warcs(warc.archives(spark, folder))
    assert sorted(map(tuple, warc.resolved(records).collect()), key=str) == brute(rows)
    assert records.filter("error is not null or digest <> coalesce(sha1(payload), digest)").count() == 0
    urls = {r["page_id"]: r["url"] for r in records.collect()}
    assert urls[2**60 + 1] == "http://x/%0D%0A%09WARC-Type: odd" and urls[1007] == "%20http://blank%20" and urls[None] is None
    assert made.agg(F.sum("records")).first()[0] == len(rows)


def test_only_large_equal_payloads_are_stored_once(spark):
    html = "x" * 999
    rows = [(1, "a", html, None), (2, "b", html, None), (3, "c", html + "y", None), (4, "d", html + "y", None), (None, "e", html + "y", None)]
    folder, _ = written(spark, rows)
    got = sorted(map(tuple, warc.resolved(warc.read_warcs(warc.archives(spark, folder))).collect()), key=str)
    assert got == brute(rows) and [r[0] for r in got if r[3] == "revisit"] == [3, None]


def test_each_record_is_a_frame_under_the_archives_dictionary(spark):
    folder, made = written(spark, pages(), warc.Archive(bytes=20_000))
    paths = [r["path"] for r in made.collect()]
    assert len(paths) > 5
    system, place = fs.FileSystem.from_uri(paths[0])
    data = system.open_input_stream(place).read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    trained = zstandard.ZstdCompressionDict(zstandard.decompress(data[8 : 8 + size]))
    assert trained.dict_id() and zstandard.get_frame_parameters(data[8 + size :]).dict_id == trained.dict_id()
    for r in warc.read_warcs(made).filter(F.col("archive") == paths[0]).collect():
        alone = zstandard.ZstdDecompressor(dict_data=trained).decompressobj().decompress(data[r["offset"] : r["offset"] + r["length"]])
        assert alone.startswith(b"WARC/1.1\r\n") and (r["payload"] is None or alone.endswith(bytes(r["payload"]) + b"\r\n\r\n"))


def test_the_dictionary_pays(spark):
    own = [f"<html><head><title>{i}</title><link rel=stylesheet href=/style.css></head><body class=page>{random.Random(i).random()}</body></html>".encode() for i in range(500)]
    made = warc.dictionary(own, 4096)
    size = lambda d: sum(len(zstandard.ZstdCompressor(dict_data=d and zstandard.ZstdCompressionDict(d)).compress(x)) for x in own)
    assert 2 * size(made) < size(None)
    assert warc.dictionary(own[:3], 4096) == b""


def test_damaged_archives_are_told(spark):
    folder, made = written(spark, pages(60), warc.Archive(bytes=2000))
    paths = [r["path"] for r in made.collect()][:3]
    system, _ = fs.FileSystem.from_uri(folder)
    for path, cut in zip(paths, (slice(0, -3), slice(0, 5), slice(None, None)), strict=True):
        place = fs.FileSystem.from_uri(path)[1]
        data = system.open_input_stream(place).read()[cut]
        with system.open_output_stream(place) as out:
            out.write(data if cut != slice(None, None) else data[:-9] + b"\xff" * 9)
    got = {r["archive"]: r["error"] for r in warc.read_warcs(made).filter("error is not null").collect()}
    assert set(got) == set(paths)
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"\0" * 50)))


def test_what_an_attempt_left_is_never_read(spark):
    folder = f"{shared_dir(spark)}/warc-lost-{random.random()}"
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{root}/attempts")
    with system.open_output_stream(f"{root}/attempts/lost.warc.zst") as out:
        out.write(b"half an archive")
    rows = pages(20)
    warc.write_warcs(spark.createDataFrame(rows, PAGES), folder)
    assert sorted(map(tuple, warc.resolved(warc.read_warcs(warc.archives(spark, folder))).collect()), key=str) == brute(rows)
    # The same moves again change nothing.
    manifest = spark.createDataFrame([(0, 0, "gone.warc.zst", 1, 1)], warc.MANIFEST)
    with system.open_output_stream(f"{root}/pages-r-000000-000000.warc.zst") as out:
        out.write(b"there")
    assert warc._published(manifest, folder, "r").count() == 1 and system.open_input_stream(f"{root}/pages-r-000000-000000.warc.zst").read() == b"there"


def test_no_pages_no_archives(spark):
    folder, made = written(spark, [])
    assert made.count() == 0 and warc.resolved(warc.read_warcs(made)).count() == 0


def test_same_rows_as_sql(spark):
    import duckdb
    from tidemark.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    ours = QUERIES["op11_warc"](spark, folder)
    theirs = con.sql(ORACLE_SQL["op11_warc"]).fetchall()
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(theirs, key=str) and len(theirs) > 20
