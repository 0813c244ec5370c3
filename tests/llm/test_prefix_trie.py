"""The trie against brute force: hot beginnings, copies, odd rows, large buckets of several levels."""

import hashlib
import random
import zlib

import pytest
from tidemark.llm import prefix_trie as t

TURNS = "conv_id long, turn long, role string, text string, seq string, ids string, bucket string"


def rebuilt(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))

    def key(x):
        return (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest())

    own = {c: [x[1:] for x in sorted(v, key=key)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in members.items()
    )


def made(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def conversations(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), n):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi", "hi", "yé😀", "", None, "no"]), "s", "i", "b"))
    for c in (1001, 1003, 1250, 1251):  # copies, one of them very long
        rows += [(c, k, "user", f"t{k // (1 if c < 1250 else 50)}", "s", "i", "b") for k in range(400)]
    rows += [(None, 1, "user", "nobody", None, None, None), (2000, None, None, None, None, None, None), (2000, None, "a", "b", None, None, None), (-5, 3, "user", "x", None, None, None), (-100, 3, "user", "x", None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [(2000, 100_000), (3, 100_000), (1, 5), (2000, 30)])
def test_trie_against_brute_force(spark, limits):
    rows = conversations(3)
    convs = t.rebuilt(t.encoded(spark.createDataFrame(rows, TURNS)))
    want = brute(rebuilt(rows))
    assert made(t.prefix_trie(convs, *limits)) == want and len(want) > 800


def test_turnless_and_single_conversations(spark):
    one = [(next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1), 0, "user", "a")]
    for rows in (one, [(200, 0, "user", "a")], [(200, k, "user", str(k)) for k in range(3)]):
        convs = t.rebuilt(t.encoded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
        assert made(t.prefix_trie(convs)) == brute(rebuilt(rows))


def test_no_conversations_no_nodes(spark):
    assert t.prefix_trie(t.rebuilt(t.encoded(spark.createDataFrame([], TURNS)))).collect() == []


def test_members_of_a_large_sequence_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(t, "CHUNK", 64)
    convs = spark.range(0, 3000).selectExpr("id as conv_id", "array(1L, 2L) as ids", "array(3, 4) as chars")
    got = t.sequences(convs).collect()
    assert len(got) == 1 and got[0]["members"] == 3000 and got[0]["conv_id"] == 0
    assert got[0]["ends"] == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()


def test_quicksort_gives_parents_before_children():
    rng = random.Random(1)
    texts = {tuple(rng.randrange(3) for _ in range(rng.randrange(7))) for _ in range(200)}
    rows = [{"ids": list(x), "chars": [1] * len(x), "conv_id": i, "members": 1, "ends": str(i)} for i, x in enumerate(texts)]
    nodes = t.sorted_nodes(rows, 0)
    assert len(nodes) == len({x[:d] for x in texts for d in range(len(x) + 1)})
    assert all(n.parent < i and (n.parent < 0 or nodes[n.parent].depth == n.depth - 1) for i, n in enumerate(nodes))
    assert sum(n.end is not None for n in nodes) == len(texts)
