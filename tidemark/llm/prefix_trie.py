"""The trie of all conversations' beginnings, by a radix sort of their turns.

Turns (role and text) are numbered by a dictionary, so that a conversation is an array of numbers and texts
don't travel.  Equal conversations become one sequence with its members counted.  Then the sequences are
partitioned by their most significant turn: a bucket of sequences with the same beginning that is too large for
a task is a node of its own; the turns that all of it share are passed over at once (they are those that its
smallest and its largest sequence share), and it falls into buckets by the turn after them.  Buckets that a task
can hold are finished by a multikey quicksort, whose recursion gives the nodes below.  What a node knows of its
subtree is then summed from the deepest large buckets up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import by_size, materialize, partitions

#: A bucket with at most so many sequences and turns is finished by one task.
LOCAL_SEQUENCES, LOCAL_TURNS = 256, 25_000
#: Large buckets of a level that are handed to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Bytes of member ids that are joined into one row.
CHUNK = 1 << 20
#: Rebuilt conversations take up to so many turns from another one.
TAKEN = 5
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


class Node(NamedTuple):
    """``parent``: place of the node above in the same list; -1 for the first ones."""

    parent: int
    depth: int
    first: int
    members: int
    chars: int
    end: str | None


def listed(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[dict]:
    """The rows of ``batches``, of which few at a time are Python's objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield from batch.slice(start, rows).to_pylist()


# --- sequences -----------------------------------------------------------------------------------------


def encoded(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, ids, chars: each conversation's turns in order, as numbers and as lengths of their texts in code points.

    Turns are ordered by number, null first, those with the same number by a digest of role and text.  Equal
    turns have equal numbers; a null role or text is an empty one; rows without a conversation are left out.
    A conversation's numbers are held by a task, as a text is; its texts aren't.
    """
    said, who = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), "utf-8"), 256))
    turns = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), digest.alias("said"), F.length(said).alias("chars"))
    turns = materialize(turns, "turns")
    words = materialize(turns.select("said").distinct().select("said", F.monotonically_increasing_id().alias("id")), "turn-dictionary")
    turns = turns.join(words, "said")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "said", "id", "chars")))
    return turns.groupBy("conv_id").agg(ordered.alias("o")).select("conv_id", F.col("o.id").alias("ids"), F.col("o.chars").alias("chars"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversation c with its first h turns taken from c - c % 100, h being crc32(c) % 6: all that one has if it
    has fewer, none if there is no such conversation."""
    convs = materialize(convs, "conversations")
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string")) % (TAKEN + 1)).cast("int")
    head = convs.filter(c % 100 == 0).select(c.alias("base"), F.slice("ids", 1, TAKEN).alias("head"), F.slice("chars", 1, TAKEN).alias("head_chars"))
    both = convs.withColumn("base", c - c % 100).join(head, "base", "left")

    def joined(own: str, given: str) -> F.Column:
        begin = F.when(F.col(given).isNotNull() & (h > 0), F.slice(given, F.lit(1), h)).otherwise(F.slice(own, 1, 0))
        return F.concat(begin, F.slice(own, h + 1, F.greatest(F.size(own), F.lit(1))))

    return both.select("conv_id", joined("ids", "head").alias("ids"), joined("chars", "head_chars").alias("chars"))


SEQUENCE = "seq binary, ids array<long>, chars array<int>, conv_id long, members long, ends string"


def sequences(convs: DataFrame) -> DataFrame:
    """The different sequences: turns, smallest member, number of members, and the SHA-256 of the members' ids, in
    ascending order with commas between.

    Members are sorted over all tasks, a sequence's too; what goes to one task afterwards is their joined text,
    megabyte by megabyte, which it hashes as it comes.
    """
    keyed = materialize(convs.select(F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)).alias("seq"), "conv_id", "ids", "chars"), "sequences")
    dealt = keyed.repartitionByRange(partitions(keyed.sparkSession), "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    schema = pa.schema([("seq", pa.binary()), ("ids", pa.list_(pa.int64())), ("chars", pa.list_(pa.int32())), ("conv_id", pa.int64()), ("members", pa.int64()), ("ends", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, size = None, [], 0

        def chunk() -> dict:
            return {**now, "members": len(texts), "ends": ",".join(texts)}

        for batch in batches:
            out = []
            seqs, members = batch["seq"].to_pylist(), batch["conv_id"].to_pylist()
            for i, (seq, member) in enumerate(zip(seqs, members, strict=True)):
                if now is None or now["seq"] != seq or size >= CHUNK:
                    if now is not None:
                        out.append(chunk())
                    now, texts, size = {"seq": seq, "conv_id": member, "ids": batch["ids"][i].as_py(), "chars": batch["chars"][i].as_py()}, [], 0
                texts.append(str(member))
                size += len(texts[-1]) + 1
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([chunk()], schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for row in listed(batches):
            if now is not None and now["seq"] == row["seq"]:
                state.update(b"," + row["ends"].encode())
                now["members"] += row["members"]
                continue
            if now is not None:
                out.append({**now, "ends": state.hexdigest()})
            now, state = row, hashlib.sha256(row["ends"].encode())
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([*out, {**now, "ends": state.hexdigest()}], schema)

    parts = dealt.mapInArrow(chunks, SEQUENCE)
    return materialize(parts.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(hashed, SEQUENCE), "different-sequences")


# --- a bucket that a task holds ------------------------------------------------------------------------


def sorted_nodes(rows: list[dict], depth: int) -> list[Node]:
    """Nodes below ``depth`` turns that all ``rows`` share, the one at ``depth`` first, parents before children.

    A multikey quicksort: rows are split by their next turn into smaller, equal and larger ones; the equal ones
    are a node, and are split by the turn after it.
    """
    nodes: list[Node] = []

    def add(parent: int, at: int, own: list[dict]) -> tuple[int, list[dict]]:
        """A node, and those of its rows that go on below it."""
        end = next((r["ends"] for r in own if len(r["ids"]) == at), None)
        nodes.append(Node(parent, at, min(r["conv_id"] for r in own), sum(r["members"] for r in own), own[0]["chars"][at - 1] if at else 0, end))
        return len(nodes) - 1, [r for r in own if len(r["ids"]) > at]

    top, below = add(-1, depth, rows)
    work = [(top, depth, below)]
    while work:
        parent, at, own = work.pop()
        while len(own) == 1 and len(own[0]["ids"]) > at:
            at += 1
            parent, own = add(parent, at, own)
        if not own:
            continue
        pivot = own[len(own) // 2]["ids"][at]
        less, same, more = ([r for r in own if r["ids"][at] < pivot], [r for r in own if r["ids"][at] == pivot], [r for r in own if r["ids"][at] > pivot])
        work += [(parent, at, part) for part in (less, more) if part]
        child, below = add(parent, at + 1, same)
        if below:
            work.append((child, at + 1, below))
    return nodes


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FINISHED = f"{NODE}, above binary"
_FINISHED = pa.schema([(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for n, t in (c.split() for c in FINISHED.split(", "))])


def bucket_nodes(rows: list[dict]) -> list[tuple]:
    """All nodes of one bucket, as rows of ``FINISHED``; the first one names the large bucket above it."""
    nodes = sorted_nodes(rows, rows[0]["depth"])
    children, leaves, saved = [0] * len(nodes), [0] * len(nodes), [(n.members - 1) * n.chars for n in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if (above := nodes[i].parent) >= 0:
            children[above] += 1
            leaves[above] += leaves[i]
            saved[above] += saved[i]
    return [
        (n.first, n.depth, nodes[n.parent].first if n.parent >= 0 else rows[0]["parent_conv_id"], n.members, children[i], leaves[i], saved[i], n.end or NO_MEMBERS, rows[0]["above"] if n.parent < 0 else None)
        for i, n in enumerate(nodes)
    ]


def finished(buckets: DataFrame) -> DataFrame:
    """Nodes of the buckets that tasks can hold (bucket, depth, above, parent_conv_id and a sequence in each row)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FINISHED, strict=True)], schema=_FINISHED)
            out.clear()
            return made

        for row in listed(batches):
            if own and own[0]["bucket"] != row["bucket"]:
                out += bucket_nodes(own)
                own = []
                if len(out) >= 10_000:
                    yield flushed()
            own.append(row)
        if own:
            out += bucket_nodes(own)
        if out:
            yield flushed()

    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rows, FINISHED)


# --- the trie ------------------------------------------------------------------------------------------


def prefix_trie(convs: DataFrame, local_sequences: int = LOCAL_SEQUENCES, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """A row for each different beginning of ``convs`` (conv_id, ids, chars), the empty one included.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, a node's members but one times its last text's code points) and ends_sha256
    (of the ids, in order with commas between, of members that end there).  Conversations without turns are
    members of the root alone; no conversations, no rows.

    A level of large buckets is a few jobs; there are as many levels as buckets split until tasks can hold them,
    however long the beginnings are that they share.
    """
    found = sequences(convs)
    open_ = found.withColumns({"bucket": F.unhex(F.sha2(F.lit(""), 256)), "above": F.lit(None).cast("binary"), "depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    carried = ["bucket", "above", "depth", "parent_conv_id", "seq", "ids", "chars", "conv_id", "members", "ends"]
    large: list[DataFrame] = []
    small: list[DataFrame] = []
    while True:
        open_ = materialize(open_.select(carried), "open-buckets")
        if open_.isEmpty():
            break
        lo, hi = F.min("ids"), F.max("ids")
        tops = open_.groupBy("bucket").agg(
            lo.alias("lo"), hi.alias("hi"), F.min("conv_id").alias("first"), F.sum("members").alias("n_convs"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.first("parent_conv_id").alias("parent_conv_id"),
            F.min(F.struct("ids", "chars", "ends")).alias("least"),
        )
        # Where the smallest and the largest sequence part, some of the bucket's do, and before it none.
        unequal = F.array_position(F.transform(F.arrays_zip("lo", "hi"), lambda x: x["lo"].eqNullSafe(x["hi"])), False)
        shared = F.when(unequal > 0, unequal - 1).otherwise(F.size("lo")).cast("long")
        ends = F.when(F.size("lo") == F.col("shared"), F.col("least.ends"))
        tops = materialize(tops.withColumn("shared", shared).select("bucket", "above", "parent_conv_id", "depth", "shared", "first", "n_convs", F.slice("least.chars", F.lit(1), F.col("shared").cast("int")).alias("chars"), ends.alias("ends")), "large-buckets")
        known = by_size(tops.select("bucket", "shared", "first"), BROADCAST_ROWS)
        below = open_.select("bucket", "seq", "ids", "chars", "conv_id", "members", "ends").join(known, "bucket").filter(F.size("ids") > F.col("shared"))
        below = below.withColumnRenamed("bucket", "above").withColumn("next", F.element_at("ids", (F.col("shared") + 1).cast("int")))
        deeper = (F.size("ids") - F.col("shared") - 1).cast("long")
        sizes = below.groupBy("above", "next").agg(F.count("*").alias("n"), F.sum(deeper).alias("turns"))
        sizes = materialize(sizes, "buckets")
        large.append(tops.join(sizes.groupBy(F.col("above").alias("bucket")).agg(F.count("*").alias("n_children")), "bucket", "left"))
        too_large = sizes.filter((F.col("n") > 1) & ((F.col("n") > local_sequences) | (F.col("turns") > local_turns))).select("above", "next", F.lit(True).alias("large"))
        named = F.unhex(F.sha2(F.concat(F.col("above"), F.encode(F.col("next").cast("string"), "utf-8")), 256))
        routed = below.join(by_size(too_large, BROADCAST_ROWS), ["above", "next"], "left")
        routed = routed.select(named.alias("bucket"), "above", (F.col("shared") + 1).alias("depth"), F.col("first").alias("parent_conv_id"), "seq", "ids", "chars", "conv_id", "members", "ends", F.coalesce("large", F.lit(False)).alias("large"))
        routed = materialize(routed, "routed")
        small.append(materialize(finished(routed.filter("not large").select(carried)), "finished"))
        open_ = routed.filter("large")
    if not large:
        return found.sparkSession.createDataFrame([], NODE)
    names = [c.split()[0] for c in NODE.split(", ")]
    made = [s.select(names) for s in small]
    tops_below = None
    for level, s in zip(reversed(large), reversed(small), strict=True):
        under = s.filter("above is not null").select("above", "n_leaves", "saved_tokens")
        under = under.unionByName(tops_below) if tops_below is not None else under
        sums = under.groupBy(F.col("above").alias("bucket")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        level = level.join(sums, "bucket", "left").withColumns({"leaves": F.coalesce("leaves", F.lit(1)), "n_children": F.coalesce("n_children", F.lit(0)), "saved": F.coalesce("saved", F.lit(0))})
        level = materialize(_chains(level), "large-nodes")
        made.append(level.select(names))
        tops_below = level.filter("above is not null").select("above", "n_leaves", "saved_tokens")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _chains(level: DataFrame) -> DataFrame:
    """The nodes of large buckets: from ``depth`` on to ``shared`` turns, each the only child of the one before."""
    steps = F.posexplode(F.sequence(F.col("depth"), F.col("shared")))
    each = level.select("*", steps.alias("place", "at"))
    last = F.col("at") == F.col("shared")
    # Lengths of the turns from a node's own on; the root has none.
    rest = F.slice("chars", F.greatest(F.col("at"), F.lit(1)).cast("int"), F.greatest(F.size("chars"), F.lit(1)))
    own = (F.col("n_convs") - 1) * F.aggregate(rest, F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select(
        F.col("first").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("place") > 0, F.col("first")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"), (F.col("saved") + own).cast("long").alias("saved_tokens"),
        F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(NO_MEMBERS)).alias("ends_sha256"), F.when(F.col("place") == 0, F.col("above")).alias("above"),
    )
