"""The best book of a group: ties and what isn't known."""

import pytest

from tidemark.operators import markets as m

KIND = "k int, volume double, book string, implied double, fair double"


@pytest.mark.parametrize("turned", [False, True])
def test_ties_of_book_and_price_go_to_the_smaller_fair_price(spark, turned):
    rows = [(1, 30.0, "a", 0.5, 0.58), (1, 30.0, "a", 0.5, 0.9), (1, 30.0, "b", 0.5, 0.55), (2, 30.0, "a", None, 0.9), (2, 30.0, None, 0.4, 0.9), (2, 30.0, "c", 0.4, 0.6), (3, 10.0, "a", 0.1, 0.9)]
    df = spark.createDataFrame(rows[::-1] if turned else rows, KIND).coalesce(1)
    got = {r["k"]: (r["book"], r["fair"]) for r in m.divergences(df, "volume", "book", "fair", "implied", ["k"], 20).collect()}
    assert got == {1: ("a", 0.58), 2: ("c", 0.6)}
