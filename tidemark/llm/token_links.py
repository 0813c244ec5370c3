"""Which ids of one tokenizer stand where ids of another do.

Two tokenizers cut the same bytes; where both cut, a group of ids of each ends.  Groups are interned twice: a
task numbers the different groups of a block of documents and writes each document as numbers, and Spark counts
the different groups of all blocks.  What is linked in a group is expanded once for each different one and
weighed by the documents that hold it.  A document that holds a pair in several of its groups would be counted
for each of them, so the blocks also say by how much.  What a group is worth goes back to its blocks by the
group's key, and the documents of a block are summed from that.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import give_back, materialize, mix64, shared_dir, shuffles_dropped, slices
from tidemark.llm.wordpieces import Vocabulary, encoder, public_vocabulary

#: Bytes of text in a block of documents.
BLOCK_BYTES = 3_000_000
#: What a piece has for a space (fixed value).
MARK = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Blanks and what follows them up to the next blank.
WORD = re.compile(r" +[^ ]*")


class Pair(NamedTuple):
    """``first``: a byte-level vocabulary; ``second``: a file of pieces."""

    first: Vocabulary
    second: str


def public_pair(ranks: str = "byte_bpe_50k.tiktoken", pieces: str = "piece_bpe_32k.model") -> Pair:
    """Two installed public vocabularies; strings of special tokens are plain text."""
    import public_tokenizers

    return Pair(public_vocabulary(ranks)._replace(special=()), public_tokenizers.path(pieces))


# --- tokens of a block ---------------------------------------------------------------------------------


class Pieces:
    """Ids of a file of pieces.  No piece has a space behind another character, so a text is cut before its runs
    of spaces, and each different stretch of a block is looked at once; were there such a piece, texts would go
    through whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        spelt = [bytes([int(m[1], 16)]) if self.model.is_byte(i) and (m := BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.spelling = Spelling(spelt)
        self.space = [self.model.piece_to_id(MARK)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (none empty) one after another, and how many each has.  A space is put before
        each, as the model does itself."""
        words = [WORD.findall(" " + t) if self.cuts else [" " + t] for t in texts]
        coded = pa.array([w for own in words for w in own], pa.large_string()).dictionary_encode()
        # The model puts no space before nothing, so a space at the end is looked up.
        made = [x or self.space for x in self.model.encode([w[1:] for w in coded.dictionary.to_pylist()], num_threads=1)]
        counts = np.array([len(x) for x in made], np.int64)
        ids = np.array([i for x in made for i in x], np.int64)
        codes = coded.indices.to_numpy().astype(np.int64)
        flat = ids[ranges((np.cumsum(counts) - counts)[codes], counts[codes])]
        of_text = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        return flat, np.bincount(of_text, counts[codes], len(texts)).astype(np.int64)


class Spelling:
    """The bytes of each id."""

    def __init__(self, spelt: list[bytes]):
        self.size = np.array([len(b) for b in spelt], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.start[ids], self.size[ids])]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. (counts[0] of them), starts[1], .."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + counts, counts)


@lru_cache(2)
def readers(pair: Pair) -> tuple:
    """One for each worker process."""
    with open(pair.first.ranks_path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    spelt = Spelling([ranks.get(i, b"") for i in range(max(ranks) + 1)])
    return encoder(pair.first), spelt, Pieces(pair.second)


class Block(NamedTuple):
    """Ids of some documents, one after another; ``owner_a`` and ``owner_b``: the group of each id, groups counted
    through; ``group_doc``: the document of each group."""

    a: np.ndarray
    b: np.ndarray
    owner_a: np.ndarray
    owner_b: np.ndarray
    group_doc: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


def tokens(texts: list[str | None], pair: Pair) -> Block:
    """Both tokenizers' ids of a space and each text, and the groups that they fall into; a null or empty text, and
    one that either tokenizer doesn't give back byte for byte, has none."""
    first, spelt, pieces = readers(pair)
    n = len(texts)
    here = np.array([i for i, t in enumerate(texts) if t], np.int64)
    own = [" " + texts[i] for i in here]
    coded = list(first.encode(own))
    a, n_a = (np.concatenate(coded) if coded else np.empty(0)).astype(np.int64), np.array([len(x) for x in coded], np.int64)
    b, n_b = pieces.encode([texts[i] for i in here]) if len(here) else (a, n_a)
    raw = [t.encode() for t in own]
    size = np.array([len(x) for x in raw], np.int64)
    given = np.frombuffer(b"".join(raw), np.uint8)
    doc_a, doc_b = np.repeat(np.arange(len(own)), n_a), np.repeat(np.arange(len(own)), n_b)
    good = _same(spelt, a, doc_a, given, size) & _same(pieces.spelling, b, doc_b, given, size)
    a, doc_a, b, doc_b = a[good[doc_a]], doc_a[good[doc_a]], b[good[doc_b]], doc_b[good[doc_b]]
    ends_a, ends_b = np.cumsum(spelt.size[a]), np.cumsum(pieces.spelling.size[b])
    # No id is empty, so both lists grow.
    cuts = ends_b[ends_a[np.searchsorted(ends_a, ends_b)] == ends_b]
    owner_a, owner_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    group_doc = np.empty(len(cuts), np.int64)
    group_doc[owner_a] = here[doc_a]
    whole_a, whole_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole_a[here], whole_b[here] = np.where(good, n_a, 0), np.where(good, n_b, 0)
    return Block(a, b, owner_a, owner_b, group_doc, whole_a, whole_b)


def _same(spelling: Spelling, ids: np.ndarray, doc: np.ndarray, given: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each document's ids spell its bytes."""
    long = np.bincount(doc, spelling.size[ids], len(size)).astype(np.int64) == size
    keep = long[doc]
    made, at = spelling.of(ids[keep]), ranges((np.cumsum(size) - size)[long], size[long])
    wrong = np.flatnonzero(made != given[at])
    long[np.searchsorted(np.cumsum(size), at[wrong], "right")] = False
    return long


def interned(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the different rows of two columns, and the first place of each."""
    of, names = pd.factorize(keys[:, 0])
    first = np.empty(len(names), np.int64)
    first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
    if (keys[first[of], 1] != keys[:, 1]).any():  # the first column alone doesn't tell all rows apart
        _, first, of = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    return of.ravel(), first


class Groups(NamedTuple):
    """The different groups of a block: ``of`` says which one each of the block's groups is; ids of the k-th are
    a[a_at[k]:a_at[k + 1]] and so on."""

    of: np.ndarray
    a: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_at: np.ndarray


def different(block: Block) -> Groups:
    """Equal groups are found by 128 bits of a hash of their ids and places."""
    n = len(block.group_doc)
    long_a, long_b = np.bincount(block.owner_a, minlength=n), np.bincount(block.owner_b, minlength=n)
    start_a, start_b = np.cumsum(long_a) - long_a, np.cumsum(long_b) - long_b
    place_a, place_b = np.arange(len(block.a)) - start_a[block.owner_a], np.arange(len(block.b)) - start_b[block.owner_b]
    keys = np.zeros((n, 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            for ids, place, side, start in ((block.a, place_a, 0, start_a), (block.b, place_b, 1, start_b)):
                words = mix64(mix64(ids.astype(np.uint64) + np.uint64(salt)) + (2 * place + side).astype(np.uint64) * np.uint64(salt | 1))
                if n:
                    keys[:, k] += np.add.reduceat(words, start)
            keys[:, k] = mix64(keys[:, k])
    of, first = interned(keys)
    a, b = block.a[ranges(start_a[first], long_a[first])], block.b[ranges(start_b[first], long_b[first])]
    return Groups(of, a, np.concatenate([[0], np.cumsum(long_a[first])]), b, np.concatenate([[0], np.cumsum(long_b[first])]))


def spelt_out(groups: Groups) -> list[bytes]:
    """``a1,a2|b1`` of each different group."""
    a, b = list(map(str, groups.a.tolist())), list(map(str, groups.b.tolist()))
    a_at, b_at = groups.a_at.tolist(), groups.b_at.tolist()
    return [(",".join(a[a_at[k] : a_at[k + 1]]) + "|" + ",".join(b[b_at[k] : b_at[k + 1]])).encode() for k in range(len(a_at) - 1)]


def linked(groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs (a << 32 | b) of each different group, and whose they are."""
    long_a, long_b = np.diff(groups.a_at), np.diff(groups.b_at)
    # Each a of a group beside each of the group's b.
    times = np.repeat(long_b, long_a)
    left = np.repeat(groups.a, times)
    owner = np.repeat(np.arange(len(long_a)), long_a * long_b)
    right = groups.b[ranges(np.repeat(groups.b_at[:-1], long_a), times)]
    pairs = left << 32 | right
    order = np.lexsort((pairs, owner))
    pairs, owner = pairs[order], owner[order]
    new = np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])])[: len(pairs)]
    return pairs[new], owner[new]


def counted_again(groups: Groups, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that documents hold in more than one of their different groups (``doc`` holds ``group``), and in how many
    more than one, summed over the documents."""
    pairs, owner = linked(groups)
    names, code, times = np.unique(pairs, return_inverse=True, return_counts=True)
    several = times[code] > 1
    code, owner = code[several], owner[several]
    n = len(groups.a_at) - 1
    long = np.bincount(owner, minlength=n)
    start = np.cumsum(long) - long
    held = code[ranges(start[group], long[group])] + np.repeat(doc, long[group]) * len(names)
    held.sort()
    again = held[1:][held[1:] == held[:-1]] % max(1, len(names))
    found, n_again = np.unique(again, return_counts=True)
    return names[found], n_again


# --- the corpus ----------------------------------------------------------------------------------------

#: kind 0: a document; 1: a group of a block and how many of its documents hold it; 2: a pair counted too often.
ROWS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups array<int>, times array<int>, number int, ids string, n long, a int, b int, kind int"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
_ARROW = pa.schema([(n, _KINDS[t]) for n, t in (c.split() for c in ROWS.split(", "))])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _table(kind: int, rows: int, **columns) -> pa.RecordBatch:
    made = [columns.get(f.name) for f in _ARROW]
    arrays = [pa.nulls(rows, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, _ARROW, strict=True)]
    arrays[-1] = pa.array(np.full(rows, kind, np.int32))
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def block_rows(number: int, ids: list[int | None], texts: list[str | None], pair: Pair) -> Iterator[pa.RecordBatch]:
    """What a block of documents gives: ``ROWS``."""
    block = tokens(texts, pair)
    groups = different(block)
    text = np.array(spelt_out(groups), object)
    n, kinds = len(ids), len(text)
    n_groups = np.bincount(block.group_doc, minlength=n)
    links = np.diff(groups.a_at) * np.diff(groups.b_at)
    n_links = np.bincount(block.group_doc, links[groups.of], n).astype(np.int64)
    ends = np.cumsum(n_groups)
    spelt = [hashlib.sha256(b";".join(text[groups.of[stop - k : stop]])).hexdigest() if k else "" for stop, k in zip(ends.tolist(), n_groups.tolist(), strict=True)]
    held, times = np.unique(block.group_doc * max(1, kinds) + groups.of, return_counts=True)
    doc, group = held // max(1, kinds), held % max(1, kinds)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (group, times)]
    yield _table(0, n, block=np.full(n, number), doc_id=ids, n_a=block.n_a, n_b=block.n_b, n_groups=n_groups, n_links=n_links, groups_sha256=spelt, groups=lists[0], times=lists[1])
    if not kinds:
        return
    in_docs = np.bincount(group, minlength=kinds)
    yield _table(1, kinds, block=np.full(kinds, number), number=np.arange(kinds), ids=[t.decode() for t in text], n=in_docs)
    pairs, more = counted_again(groups, doc, group)
    if len(pairs):
        yield _table(2, len(pairs), block=np.full(len(pairs), number), n=-more, a=(pairs >> 32).astype(np.int32), b=(pairs & 0xFFFFFFFF).astype(np.int32))


def token_links(docs: DataFrame, pair: Pair | None = None, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: ids of both tokenizers, groups, links, those of them whose pair is held by no fewer documents
    than any other of its first id, the sum of the links' counts, and a hash of the groups.

    A pair's count is how many rows of ``docs`` hold it linked; repeated rows, and rows that share an id, each count.
    Null, empty and not exactly spelt texts have zeros and an empty hash; null ids stay; an empty table gives no rows;
    other columns don't matter.  A text of any length is a block of its own if it is longer than ``block_bytes``.
    """
    spark, pair = docs.sparkSession, pair or public_pair()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        names: list[int | None] = []
        texts: list[str | None] = []
        held = 0
        for batch in slices(batches, "text"):
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()
            for name, text, size in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), sizes, strict=True):
                if texts and held + size > block_bytes:
                    yield from block_rows(block, names, texts, pair)
                    give_back()
                    block, names, texts, held = block + 1, [], [], 0
                names.append(name)
                texts.append(text)
                held += size
        if texts:
            yield from block_rows(block, names, texts, pair)
        give_back()

    path = f"{shared_dir(spark)}/token-links-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(rows, ROWS).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(ROWS).parquet(path)
    local = found.filter("kind = 1").select("block", "number", "ids", "n")
    groups = materialize(local.groupBy("ids").agg(F.sum("n").alias("n")), "token-groups")
    worth = _worth(groups, found.filter("kind = 2").select("a", "b", "n"))
    values = local.select("block", "number", "ids").join(worth, "ids").select("block", "number", "best", "sums")
    values = materialize(values, "token-values")
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def summed(docs: pa.Table, values: pa.Table) -> pa.Table:
        """A block's documents with what its groups are worth."""
        order = np.argsort(values["number"].to_numpy())
        flat = docs["groups"].combine_chunks()
        group, times = flat.flatten().to_numpy(), docs["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(docs)), pc.list_value_length(flat).to_numpy(zero_copy_only=False))
        out = {c: docs[c] for c in columns if c in docs.column_names}
        for name, value in (("n_best", "best"), ("count_sum", "sums")):
            made = np.zeros(len(docs), np.int64)
            if len(group):
                np.add.at(made, owner, values[value].to_numpy()[order][group] * times)
            out[name] = pa.array(made)
        return pa.table({c: out[c] for c in columns})

    own = found.filter("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "times")
    return own.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(summed, RESULT)


def _worth(groups: DataFrame, again: DataFrame) -> DataFrame:
    """ids, best, sums: for each different group (ids, n documents), how many of its links are their first id's most
    frequent, and the sum of the links' counts.  ``again`` (a, b, n): what the groups count too often."""
    sides = F.split("ids", r"\|")
    side = lambda k: F.transform(F.split(F.get(sides, F.lit(k)), ","), lambda x: x.cast("int"))
    each = groups.select("ids", "n", side(0).alias("as"), side(1).alias("bs"))

    def distinct(name: str) -> F.Column:
        return F.transform(F.array_distinct(name), lambda x: F.struct(x.alias("id"), F.size(F.filter(name, lambda y: y == x)).alias("times")))

    each = each.select("ids", "n", F.explode(distinct("as")).alias("a"), distinct("bs").alias("bs")).select("ids", "n", "a", F.explode("bs").alias("b"))
    each = materialize(each.select("ids", "n", F.col("a.id").alias("a"), F.col("b.id").alias("b"), (F.col("a.times").cast("long") * F.col("b.times")).alias("times")), "token-pairs")
    counts = each.select("a", "b", "n").unionByName(again).groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = materialize(counts, "token-counts")
    # One row for each first id, which the vocabulary bounds.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("highest")))
    counts = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("top"))
    met = each.join(counts, ["a", "b"])
    return met.groupBy("ids").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("count")).alias("sums"))
