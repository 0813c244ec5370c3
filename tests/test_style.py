"""Nearest vectors in many dimensions: no pairs are joined, and the answer is exact."""

import math
import random

import pytest

from tidemark.operators import style
from tidemark.registry import QUERIES

KIND = "i long, g string, v array<double>"


def vectors(spark):
    """Exact and very near copies, vectors that can't take part, groups that are unknown."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", None]), [rng.gauss(0, 1) + 1000 for _ in range(32)]) for i in range(1500)]
    rows += [(2000 + i, "a", rows[0][2]) for i in range(30)] + [(3000 + i, "b", [x + 1e-7 * i for x in rows[20][2]]) for i in range(20)]
    odd = [(4000, "a", [math.inf] * 32), (4020, "b", [math.nan] * 32), (4040, "a", None), (4060, "a", [1.0, None] * 16), (4080, "a", [1.0])]
    return rows, spark.createDataFrame(rows + odd, KIND).repartition(3)


def test_uniqueness_meets_block_by_block(spark):
    rows, df = vectors(spark)
    out = style.uniqueness(df.filter("i % 20 = 0"), df, "i", "g", "v")
    assert "Join" not in out._jdf.queryExecution().analyzed().toString()
    want = {i: min(math.dist(v, w) for _, h, w in rows if h and h != g) for i, g, v in rows if i % 20 == 0 and g}
    assert {r["i"]: r["uniqueness"] for r in out.collect()} == pytest.approx(want, rel=1e-9)


def test_neighbours_among_copies(spark):
    rows, df = vectors(spark)
    out = style.neighbours(df.filter("i % 20 = 0"), df, "i", "v", 5, ["g"])
    assert "Join" not in out._jdf.queryExecution().analyzed().toString()
    want = sorted((i, n, j) for i, g, v in rows if i % 20 == 0 and g for n, (_, j) in enumerate(sorted((math.dist(v, w), j) for j, h, w in rows if h == g and j != i)[:5], 1))
    assert sorted((r["i"], r["rank"], r["neighbour"]) for r in out.collect()) == want


def test_every_vector_has_its_uniqueness(spark):
    """The registered query asks for all rows of its table; a number that is there with two labels meets itself, as in SQL."""
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").filter("label is not null").count()
    assert QUERIES["uniqueness"](spark, folder).count() == rows
    twice = spark.createDataFrame([(1, "a", [0.0, 1.0]), (1, "b", [0.0, 1.0]), (1, "c", [0.0, 2.0]), (2, "b", [0.0, 4.0])], KIND)
    out = style.uniqueness(twice, twice, "i", "g", "v")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0.0), (2, 2.0)]
