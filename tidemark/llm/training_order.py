"""Writing token sequences in the order in which training reads them.

Documents become sequences of a fixed number of ids.  A keyed Feistel network with cycle-walking permutes
0 .. n-1, so every sequence knows its global slot without any sort or table of the order.  Slots are dense:
shard s holds slots s*per_shard .. and each partition writes a range of shards, plain files of fixed-stride
records, each under a temporary name that is then renamed.  A reader finds slot k at byte
(k % per_shard) * stride.

Everything is under a folder whose name is a fingerprint of the texts and of all that decides the bytes, so
what is there is of the same input.  The sequences are written once; the shards follow in a few steps, each a
range of shards that is shuffled, written and noted, so that no more than a step's share is held twice on disk.
A job that was stopped goes on where it was: with the sequences that are written, the steps that are noted,
and the shards that are there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import mix64, partitions, shuffles_dropped, slices
from tidemark.llm.wordpieces import Vocabulary, encoder, public_vocabulary

#: Shards that one partition writes at most.
SHARDS = 64
ROUNDS = 4


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0 .. n-1 takes ``index``; ids outside the domain walk on until they are in it."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(ROUNDS):
            with np.errstate(over="ignore"):
                word = mix64(right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64))
            left, right = right, left ^ (word & mask)
        return left << shift | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def squeeze(ids: np.ndarray) -> bytes:
    """Compressed little-endian 16-bit ids."""
    return zstandard.compress(ids.astype("<u2").tobytes())


def sequences(docs: DataFrame, length: int, text_column: str = "text", end_id: int = 50256, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(part, idx, n_tokens, ids): the ids of a partition's documents, each ended by ``end_id``, cut every ``length``.

    The last sequence of a partition is filled up with ``end_id``; n_tokens says how many ids are real.  Null
    texts count as empty.  ``ids`` are unsigned 16-bit numbers, squeezed: they are written and shuffled once.
    A vocabulary with ids that don't fit 16 bits is an error.
    """
    vocabulary = vocabulary or public_vocabulary()
    if not 0 <= end_id < 2**16:
        raise ValueError("end_id must fit 16 bits")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        if coder.limit > 2**16:
            raise ValueError(f"ids up to {coder.limit - 1} don't fit 16 bits")
        part, at = TaskContext.get().partitionId(), 0
        rest = np.empty(0, np.uint16)
        end = np.array([end_id], np.uint16)

        def out(whole: np.ndarray, n_tokens: int) -> pa.RecordBatch:
            n = len(whole)
            return pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int64()), "idx": pa.array(range(at, at + n), pa.int64()), "n_tokens": pa.array([n_tokens] * n, pa.int32()), "ids": pa.array([squeeze(x) for x in whole], pa.binary())})

        for batch in slices(batches, "text"):
            flat = np.concatenate([rest, *(x for ids in coder.encode(batch["text"].to_pylist()) for x in (ids.astype(np.uint16), end))])
            n = len(flat) // length
            rest = flat[n * length :].copy()
            if n:
                yield out(flat[: n * length].reshape(n, length), length)
                at += n
        if len(rest):
            filled = np.full((1, length), end_id, np.uint16)
            filled[0, : len(rest)] = rest
            yield out(filled, len(rest))

    return docs.select(F.col(text_column).alias("text")).mapInArrow(rows, "part long, idx long, n_tokens int, ids binary")


ROWS = "slot long, shard long, byte_offset long, n_tokens int, ids_crc32 long"


def write_in_order(seqs: DataFrame, folder: str, length: int, key: int, per_shard: int, steps: int = 2) -> DataFrame:
    """Writes ``seqs`` (of ``sequences``, as a written table) as shards into ``folder``; a row for each sequence.

    slot, shard, byte_offset, n_tokens, ids_crc32.  No sequences, no shards.  ``folder`` is a URI that the
    executors can write to, and of these ``seqs``, ``key`` and ``per_shard`` alone, as ``materialise`` sees to: a
    step that it notes, and a shard that it holds, aren't made again.
    """
    spark = seqs.sparkSession
    # One number for each partition, as Spark itself keeps one for each task.
    counts = {r["part"]: r["n"] for r in seqs.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part] = total
        total += counts[part]
    shards = -(-total // per_shard)
    offsets = spark.createDataFrame(list(starts.items()) or [(0, 0)], "part long, first long")
    together = min(SHARDS, max(1, shards // partitions(spark)))

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), total, key))

    slot = slot.asNondeterministic()  # so that it isn't taken again for each filter

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows come by slot, so each of its shards in turn."""
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        shard, out, part, name = -1, None, "", ""

        def close() -> None:
            if out is not None:
                out.close()
                system.move(part, name)

        for batch in slices(batches, "ids"):
            slots = batch["slot"].to_numpy()
            ids = [zstandard.decompress(x.as_buffer()) for x in batch["ids"]]
            own = slots // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for at, stop in zip(cuts, cuts[1:], strict=False):
                if own[at] != shard:
                    close()
                    shard, out = int(own[at]), None
                    name = f"{root}/shard-{shard:08d}.bin"
                    if system.get_file_info(name).type == fs.FileType.NotFound:
                        part = f"{name}.{TaskContext.get().taskAttemptId()}"
                        out = system.open_output_stream(part)
                if out is not None:
                    out.write(b"".join(ids[at:stop]))
            yield pa.RecordBatch.from_pydict({"slot": slots, "shard": own, "byte_offset": slots % per_shard * length * 2, "n_tokens": batch["n_tokens"], "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())})
        close()

    placed = seqs.join(F.broadcast(offsets), "part").select(slot(F.col("first") + F.col("idx")).alias("slot"), "n_tokens", "ids")
    system, root = fs.FileSystem.from_uri(folder)
    done = []
    for step in range(steps):
        first, last = shards * step // steps, shards * (step + 1) // steps
        noted = f"rows-{step}-of-{steps}"
        if system.get_file_info(f"{root}/{noted}/_SUCCESS").type == fs.FileType.NotFound:
            own = placed.filter((F.col("slot") >= first * per_shard) & (F.col("slot") < last * per_shard))
            with shuffles_dropped(spark):
                ranges = F.expr(f"cast(slot div {per_shard * together} as int) - {first // together}")
                dealt = own.repartitionById(max(1, -(-last // together) - first // together), ranges).sortWithinPartitions("slot")
                dealt.mapInArrow(write, ROWS).write.mode("overwrite").parquet(f"{folder}/{noted}")
        done.append(spark.read.schema(ROWS).parquet(f"{folder}/{noted}"))
    return reduce(DataFrame.unionByName, done)


def fingerprint(docs: DataFrame, text_column: str, **decides) -> str:
    """Of the texts, in whatever order, and of what else decides the bytes."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    sums = [F.sum(F.xxhash64(text, F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    found = docs.agg(F.count("*"), *sums).first()
    return hashlib.sha256(json.dumps([str(x) for x in found] + sorted(map(str, decides.items()))).encode()).hexdigest()[:24]


def materialise(docs: DataFrame, folder: str, length: int = 2048, key: int = 20_240_607, per_shard: int = 4096, text_column: str = "text", end_id: int = 50256, vocabulary: Vocabulary | None = None, steps: int = 2) -> DataFrame:
    """``sequences`` and ``write_in_order`` together, under ``folder``; the rows that the latter gives.

    Called again with the same texts and parameters it goes on with what is there; with others it writes
    elsewhere under ``folder``.  Null and empty texts are a single ``end_id``; repeated rows are each written;
    texts of any length are cut into as many sequences as they need; ids and other columns don't matter; an
    empty table gives no rows and no shards.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or public_vocabulary()
    own = f"{folder}/{fingerprint(docs, text_column, length=length, key=key, per_shard=per_shard, end=end_id, vocabulary=vocabulary)}"
    system, root = fs.FileSystem.from_uri(own)
    made = written(system, root)
    if made is None:
        made = f"sequences-{uuid.uuid4().hex}"
        sequences(docs, length, text_column, end_id, vocabulary).write.parquet(f"{own}/{made}")
    seqs = spark.read.schema("part long, idx long, n_tokens int, ids binary").parquet(f"{own}/{made}")
    return write_in_order(seqs, f"{own}/shards-of-{made}", length, key, per_shard, steps)


def written(system: fs.FileSystem, root: str) -> str | None:
    """The sequences that were written to the end, if any; shards are kept by them, as another attempt may have
    dealt the documents otherwise."""
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    whole = [x.base_name for x in found if x.base_name.startswith("sequences-") and system.get_file_info(f"{x.path}/_SUCCESS").type == fs.FileType.File]
    return min(whole, default=None)


def read_slots(path: str, first: int, n: int, length: int = 2048) -> np.ndarray:
    """``n`` records of a local shard from its ``first`` on, without reading what is before them."""
    return np.memmap(path, "<u2", "r", offset=first * length * 2, shape=(n, length))
