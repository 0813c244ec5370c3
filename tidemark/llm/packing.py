"""Packing documents into training windows.

Each task packs the rows it reads, chunk after chunk, so nothing is shuffled and memory is bounded by the
chunk.  Within a chunk a document of n ids gives n // window full windows; the remainders are counted by
length cell (window / 32 ids wide).  All combinations of at most four cells that fill a window are the
columns of a non-negative least-squares problem whose right side is that histogram; its solution, rounded
down, says how often each combination is used.  Rounding lengths up to cells leaves a little room in each
window: the documents that no combination took are packed greedily into that room, being cut where a window
ends, and then one after another.  The last ids of a chunk, fewer than a window, become sequences of powers
of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices
from tidemark.llm.wordpieces import Vocabulary, encoder, public_vocabulary

CELLS, DEPTH = 32, 4
#: Ids that are packed together: 16 MB.
CHUNK_IDS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache
def combinations(cells: int = CELLS, depth: int = DEPTH) -> np.ndarray:
    """One column for each multiset of at most ``depth`` cell numbers that sums to ``cells``: counts by cell."""

    def parts(total: int, least: int, left: int) -> Iterator[tuple[int, ...]]:
        if total >= least:
            yield (total,)
        if left > 1:
            for first in range(least, total // 2 + 1):
                for more in parts(total - first, first, left - 1):
                    yield (first, *more)

    found = list(parts(cells, 1, depth))
    out = np.zeros((cells + 1, len(found)))
    for j, combination in enumerate(found):
        for cell in combination:
            out[cell, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes |a x - b| small: accelerated projected gradient steps."""
    gram, right = a.T @ a, a.T @ b
    step = 1 / np.linalg.norm(gram, 2)
    x = y = np.zeros(a.shape[1])
    momentum = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - step * (gram @ y - right))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = nxt + (momentum - 1) / faster * (nxt - x)
        x, momentum = nxt, faster
    return x


def plan(rests: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Positions in ``rests`` (lengths under ``window``) by window, and those that no window takes."""
    cell = -(-rests * CELLS // window)
    have = np.bincount(cell, minlength=CELLS + 1)
    a = combinations()
    times = np.floor(nnls(a, have.astype(float)) + 1e-6).astype(int)
    order = np.argsort(cell, kind="stable")
    ends = np.cumsum(have)
    at = ends - have
    windows = []
    for j in np.argsort(-times, kind="stable"):
        need = a[:, j].astype(int)
        used = np.flatnonzero(need)
        fits = min(times[j], *((ends[used] - at[used]) // need[used]))
        for _ in range(fits):
            windows.append([int(order[at[c] + k]) for c in used for k in range(need[c])])
            at[used] += need[used]
    left = [int(i) for c in range(CELLS + 1) for i in order[at[c] : ends[c]]]
    return windows, left


def pack_lengths(lengths: np.ndarray, window: int = 1024) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length): all full but the last, whose lengths are powers of two."""
    full, rests = lengths // window, lengths % window
    for doc in np.flatnonzero(full):
        for k in range(full[doc]):
            yield [(int(doc), k * window, window)]
    docs = np.flatnonzero(rests)
    whole = [(int(d), int(full[d] * window), int(rests[d])) for d in docs]
    windows, left = plan(rests[docs], window)
    room = np.array([window - sum(whole[i][2] for i in w) for w in windows], np.int64)
    spare = sum(whole[i][2] for i in left)
    # Windows are given up from the end until what is left over fills the room in all others.
    keep = len(windows)
    missing = int(room.sum())
    while missing > spare:
        keep -= 1
        missing -= int(room[keep])
        spare += window - int(room[keep])
    rest = iter([whole[i] for i in [*left, *(i for w in windows[keep:] for i in w)]])
    piece = next(rest, None)

    def fill(sequence: list, n: int) -> list:
        nonlocal piece
        while n and piece:
            doc, start, length = piece
            take = min(n, length)
            sequence.append((doc, start, take))
            n -= take
            piece = (doc, start + take, length - take) if take < length else next(rest, None)
        return sequence

    for w, n in zip(windows[:keep], room[:keep], strict=True):
        yield fill([whole[i] for i in w], int(n))
    spare -= missing
    while spare:
        take = window if spare >= window else 1 << (spare.bit_length() - 1)
        yield fill([], take)
        spare -= take


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 1024, end_id: int = 0, vocabulary: Vocabulary | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and then ``end_id``; a null or empty text has only that
    one.  Each id is in one piece; a sequence's pieces follow each other from offset 0.  Rows that share
    doc_id are packed each for itself, and a null doc_id stays null; an empty table gives no rows.  A text of
    any length is packed whole, its chunk being as long as it needs; other columns don't matter.
    """
    vocabulary = vocabulary or public_vocabulary()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([end_id], np.uint32)
        base = TaskContext.get().partitionId() << 32
        docs_: list[int | None] = []
        kept: list[np.ndarray] = []
        held = sequence = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            lengths = np.array([len(x) for x in kept], np.int64)
            out: list[tuple[int, ...]] = []
            for pieces in pack_lengths(lengths, window):
                offset = 0
                for doc, start, length in pieces:
                    out.append((doc, start, length, zlib.crc32(kept[doc][start : start + length]), base + sequence, offset))
                    offset += length
                sequence += 1
            doc, start, length, crc, sequences, offsets = np.array(out, np.int64).T
            columns = [pa.array(docs_, pa.int64()).take(pa.array(doc)), start, length, crc, lengths[doc], sequences, offsets]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

        for batch in slices(batches, "text"):
            for name, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist()), strict=True):
                docs_.append(name)
                kept.append(np.concatenate([ids, end]).astype("<u4"))
                held += len(kept[-1])
                if held >= CHUNK_IDS:
                    yield flush()
                    docs_, kept, held = [], [], 0
        if kept:
            yield flush()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(rows, SCHEMA)
