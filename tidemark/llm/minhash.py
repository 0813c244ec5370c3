"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Each text gives its shingle set's signature and band keys; texts with the same words become one node.
2. Nodes with the same band key share a bucket.  Each is compared with the smallest node of its buckets, in
   chunks of a bounded size, so a bucket of copies, however large, is gone through once.
3. What these links connect needs no more links.  Only buckets that still hold several components are open:
   there members of the largest component meet the others, and those each other, in pairs of blocks of a
   bounded size; a pair counts in the first bucket it shares.
4. Pairs are compared hash batch by hash batch: with m of n hashes equal and a uniform prior, P(similarity >=
   threshold) is a binomial tail, and a pair is pruned as soon as that is below ``miss``.  Signatures go first;
   full sets follow for the texts of surviving pairs alone, and confirm them, unless both are connected already.
5. The components of all confirmed links are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import by_size, free_name, materialize, mix64, slices
from tidemark.llm.shingles import hashed_words, shingle_set

#: Nodes in a block and shingles in a block (its memory), and rows up to which a list of ids is broadcast.
BLOCK, BLOCK_SHINGLES = 256, 500_000
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Likeness:
    """Link texts whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` at least.

    ``bands`` of ``rows`` hashes: a pair at 0.85 shares no band with probability (1-0.85**6)**40 < 1e-8, one at
    0.80 with less than 1e-5.  ``batch``: hashes compared at a time.  ``miss``: the posterior probability
    below which a pair is given up.
    """

    percent: int = 85
    words: int = 5
    bands: int = 40
    rows: int = 6
    batch: int = 48
    miss: float = 1e-9
    seed: int = 11

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


@lru_cache
def _coefficients(likeness: Likeness) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(likeness.seed)
    a, b = rng.integers(0, 2**32, (2, likeness.hashes, 1), dtype=np.uint32)
    return a | np.uint32(1), b | np.uint32(1)


def signature(shingles: np.ndarray, likeness: Likeness) -> np.ndarray:
    a, b = _coefficients(likeness)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(likeness.hashes, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            np.minimum(out, (a * low[at : at + 2048] + b * high[at : at + 2048]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, likeness: Likeness) -> np.ndarray:
    rows = sig.reshape(likeness.bands, likeness.rows).astype(np.uint64)
    keys = np.arange(1, likeness.bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(likeness.rows):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return keys.view(np.int64)


@lru_cache
def fewest_equal(likeness: Likeness) -> tuple[int, ...]:
    """For 0, 1, .. hashes compared: with fewer equal ones the posterior is below ``miss``."""
    t, out = likeness.percent / 100, []
    for n in range(likeness.hashes + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= likeness.miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def alive(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, likeness: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (``left[i]``, ``right[j]``) of signatures those that no batch of hashes has pruned."""
    equal, fewest = np.zeros(len(i), np.int64), fewest_equal(likeness)
    for at in range(0, likeness.hashes, likeness.batch):
        equal += (left[i, at : at + likeness.batch] == right[j, at : at + likeness.batch]).sum(axis=1)
        stay = equal >= fewest[min(at + likeness.batch, likeness.hashes)]
        i, j, equal = i[stay], j[stay], equal[stay]
    return i, j


def alike(a: np.ndarray, b: np.ndarray, likeness: Likeness) -> bool:
    """By the full sets (sorted)."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < likeness.percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= likeness.percent * (len(a) + len(b) - both)


def together(key: str, small: F.Column, rows: F.Column, n: int) -> list[F.Column]:
    """Grouping columns: small groups by a hash, so that about ``BLOCK`` rows come together; others by themselves."""
    batch = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // BLOCK))))
    return [small.alias("small"), F.when(small, batch).otherwise(F.col(key)).alias("group"), rows]


def crossing(group: pd.DataFrame, likeness: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Places (i of side 0, j of side 1) of a group's pairs that are to be confirmed: of the same bucket and of
    different components, first met in this band, not pruned; where none of a pair is in the bucket's main
    component, with the smaller node at i."""
    sig = np.array([np.frombuffer(x, np.uint32) for x in group["sig"]])
    key, side, node, comp, main, band = (group[c].to_numpy() for c in ("key", "side", "node", "component", "main", "band"))
    order = np.lexsort((side, key))
    cuts = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1 if len(order) else 0))
    lefts, rights = [], []
    for at, stop in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[at:stop]
        split = np.searchsorted(side[own], 1)
        one, two = own[:split], own[split:]
        i, j = np.repeat(one, len(two)), np.tile(two, len(one))
        meet = (comp[i] != comp[j]) & ((comp[i] == main[i]) | (node[i] < node[j]))
        lefts.append(i[meet])
        rights.append(j[meet])
    i, j = (np.concatenate([np.empty(0, int), *x]) for x in (lefts, rights))
    first = np.zeros(len(i), bool)
    for at in range(0, len(i), 20_000):
        x, y = i[at : at + 20_000], j[at : at + 20_000]
        shared = (sig[x] == sig[y]).reshape(len(x), likeness.bands, likeness.rows).all(axis=2)
        first[at : at + 20_000] = shared.any(axis=1) & (shared.argmax(axis=1) == band[x])
    return alive(sig, sig, i[first], j[first], likeness)


def fingerprints(docs: DataFrame, likeness: Likeness, full: bool = False) -> DataFrame:
    """(doc, h, n_shingles, bands), or with ``full`` (doc, h, sig, shingles).  h: 128 bits of the word sequence,
    null where there are no words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = list(hashed_words(batch["text"].to_pylist()))
            sets = [shingle_set(w, likeness.words) for w in words]
            sigs = [signature(s, likeness) if len(s) else None for s in sets]
            out = {"doc": batch["doc"], "h": pa.array([xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in words], pa.binary())}
            if full:
                out |= {"sig": pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}
            else:
                out |= {"n_shingles": pa.array([len(s) for s in sets], pa.int64()), "bands": pa.array([None if s is None else band_keys(s, likeness) for s in sigs], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(out)

    kind = "doc long, h binary, sig binary, shingles binary" if full else "doc long, h binary, n_shingles long, bands array<long>"
    return docs.mapInArrow(rows, kind)


def _blocks(n: F.Column, shingles: F.Column) -> F.Column:
    """How many blocks of bounded size hold so many rows and shingles."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _star_links(held: DataFrame, texts: DataFrame, likeness: Likeness) -> DataFrame:
    """(a, b): the members of ``held`` (node, low) that are like their buckets' smallest node."""
    size = texts.groupBy("node").agg(F.sum(F.octet_length("shingles") / 8).alias("n"))
    pairs = materialize(held.filter("node <> low").select("node", "low").distinct().join(size, "node"), "stars")
    per = pairs.groupBy("low").agg(_blocks(F.count("*"), F.sum("n")).alias("chunks"))
    per = materialize(per, "star-chunks")
    chunk = F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk")
    spokes = pairs.join(per, "low").select("low", "chunks", chunk, "node", F.lit(False).alias("hub"))
    hubs = per.select("low", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("low").alias("node"), F.lit(True).alias("hub"))
    keys = together("low", F.col("chunks") == 1, F.col("chunk"), pairs.count() + per.count())
    dealt = spokes.unionByName(hubs).select(*keys, "low", "node", "hub").join(texts, "node")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.array([np.frombuffer(x, np.uint32) for x in group["sig"]])
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        low, node, hub = (group[c].to_numpy() for c in ("low", "node", "hub"))
        found: set[tuple[int, int]] = set()
        order = np.argsort(low, kind="stable")
        cuts = np.flatnonzero(np.diff(low[order], prepend=low[order[0]] - 1))
        for at, stop in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[at:stop]
            others = own[~hub[own]]
            for c in own[hub[own]]:
                _, rest = alive(sig, sig, np.full(len(others), c), others, likeness)
                found |= {(int(low[c]), int(node[j])) for j in rest if (int(low[c]), int(node[j])) not in found and alike(sets[c], sets[j], likeness)}
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return dealt.groupBy("small", "group", "chunk").applyInPandas(links, "a long, b long")


def _open_links(held: DataFrame, texts: DataFrame, components: DataFrame, likeness: Likeness) -> DataFrame:
    """(a, b): links between different components in the same bucket; of two components one or more each."""
    placed = held.select("key", "band", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sized = placed.join(texts.groupBy("node").agg(F.sum(F.octet_length("shingles") / 8).alias("n")), "node")
    parts = sized.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    size = F.struct("rows", "component")
    opened = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", size).alias("main"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max_by(F.struct("rows", "n"), size).alias("largest")).filter("parts > 1")
    opened = opened.select("key", "main", _blocks(F.col("rows"), F.col("n")).alias("every"), _blocks(F.col("rows") - F.col("largest.rows"), F.col("n") - F.col("largest.n")).alias("others"))
    members = materialize(placed.join(opened, "key"), "open-buckets")
    block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    small = (F.col("every") == 1) & (F.col("others") == 1)
    keys = together("key", small, F.col("i"), 2 * members.filter(small).count())
    told = ["key", "band", "main", "component", "node"]
    every = members.select(*told, "every", "others", block("every", 1).alias("i"), upto("others").alias("j"), F.lit(0).alias("side"))
    rest = members.filter("component <> main").select(*told, "every", "others", upto("every").alias("i"), block("others", 2).alias("j"), F.lit(1).alias("side"))
    dealt = every.unionByName(rest).select(*keys, "j", "side", *told)
    kind = "small boolean, group long, i int, j int, side int, key long, band int, main long, component long, node long, h binary, sig binary"

    def survivors(group: pd.DataFrame) -> pd.DataFrame:
        i, j = crossing(group, likeness)
        return group.iloc[np.union1d(i, j)][[c.split()[0] for c in kind.split(", ")]]

    def confirmed(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        comp, node = group["component"].to_numpy(), group["node"].to_numpy()
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        found = []
        for i, j in zip(*crossing(group, likeness), strict=True):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b and alike(sets[i], sets[j], likeness):
                root[max(a, b)] = min(a, b)
                found.append((int(node[i]), int(node[j])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    by = ["small", "group", "i", "j"]
    signed = dealt.join(texts.select("node", "h", "sig"), "node")
    left = materialize(signed.groupBy(*by).applyInPandas(survivors, kind), "survivors")
    return left.join(texts.drop("sig"), ["node", "h"]).groupBy(*by).applyInPandas(confirmed, "a long, b long")


def near_duplicates(docs: DataFrame, likeness: Likeness | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each of ``docs``.

    component_id is the smallest doc_id that links reach, kept says that it is the row's own.  Null texts and
    texts without words have n_shingles 0 and are linked with nothing; so are rows without doc_id, whose
    component_id is null and which are kept.  Rows with the same words are linked; rows that share doc_id
    share a component where their texts do.  Texts of any length are compared whole; other columns don't matter.
    An empty table gives an empty one.
    """
    likeness = likeness or Likeness()
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    marks = materialize(fingerprints(rows, likeness), "fingerprints")
    real = marks.filter(F.col("h").isNotNull() & F.col("doc").isNotNull())
    first = materialize(real.groupBy("h").agg(F.min("doc").alias("node")), "texts")
    nodes = materialize(real.join(first, (F.col("doc") == F.col("node")) & (real["h"] == first["h"])).select("node", real["h"], "n_shingles", "bands"), "nodes")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = materialize(keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high"), "shared-bands")
    held = materialize(keys.join(shared, "key").distinct(), "buckets")
    some = materialize(held.select("node").distinct(), "candidates")
    full = fingerprints(rows.join(by_size(some, BROADCAST_ROWS), F.col("doc") == F.col("node"), "left_semi"), likeness, True)
    texts = full.withColumnRenamed("h", "own").join(nodes.select("node", "h"), (F.col("doc") == F.col("node")) & (F.col("own") == F.col("h")))
    texts = materialize(texts.select("node", "h", "sig", "shingles").dropDuplicates(["node", "h"]), "candidate-sets")

    stars = connected_components(_star_links(held, texts, likeness))
    more = _open_links(held, texts, stars, likeness)
    final = connected_components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)).withColumnRenamed("component", "found")
    answer = materialize(first.join(final, "node", "left").select("h", F.coalesce("found", "node").alias("component_id")), "answer")
    joined = marks.join(answer, "h", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return joined.select(F.col("doc").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, likeness: Likeness | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without those that ``near_duplicates`` doesn't keep.

    Null texts, texts without words and rows without id stay; of repeated rows with one id all stay or all go;
    the columns are those of ``docs``, whatever their names; an empty table stays empty.
    """
    gone = free_name(docs, "gone")
    marked = near_duplicates(docs, likeness, id_column, text_column)
    copies = materialize(marked.filter("not kept").select(F.col("doc_id").alias(gone)).distinct(), "copies")
    return docs.join(by_size(copies, BROADCAST_ROWS), docs[id_column] == F.col(gone), "left_anti")
