"""Removing passages that stand in the corpus already, by overlapping windows of three lines.

Only DataFrame functions.  Every three consecutive non-blank lines are hashed (twice, 128 bits together);
the hashes are counted over all documents, map-side first; and of each window that occurs more than once
every occurrence but the first is covered.  A document loses the union of its covered lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, materialize

WINDOW = 3
#: White space that doesn't tell lines apart.
EDGE = " \t\r"
#: Rows, and covered windows in them, up to which the table of covered documents is broadcast.
BROADCAST_ROWS, BROADCAST_WINDOWS = 200_000, 1_000_000


def _lines(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _numbered(lines: F.Column) -> F.Column:
    """(at, line) of the lines that aren't blank, trimmed."""
    both = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(EDGE)).alias("line")))
    return F.filter(both, lambda x: x["line"] != "")


def windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(h1, h2, doc, th, at): each window's hashes and where it starts, counted over non-blank lines from 0."""
    text = F.col(text_column)
    rows = docs.filter(F.col(id_column).isNotNull() & text.isNotNull()).select(F.col(id_column).alias("doc"), F.xxhash64(text).alias("th"), _numbered(_lines(text)).alias("l"))

    def window(i: F.Column) -> F.Column:
        three = [F.get("l", i + k)["line"] for k in range(WINDOW)]
        return F.struct(F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("again"), *three[::-1]).alias("h2"), i.alias("at"))

    found = F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), window)
    return rows.filter(F.size("l") >= WINDOW).select("doc", "th", F.explode(found).alias("w")).select("w.h1", "w.h2", "doc", "th", "w.at")


def covered(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, th, starts): the windows of each document that are later occurrences."""
    every = materialize(windows(docs, id_column, text_column), "line-windows")
    repeated = every.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = every.join(materialize(repeated, "repeated-windows"), ["h1", "h2"]).filter(F.struct("doc", "th", "at") > F.col("first"))
    return materialize(later.groupBy("doc", "th").agg(F.collect_set("at").alias("starts")), "covered-lines")


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the text cleaned and two more columns at the end, ``n_lines`` and ``n_removed``.

    Occurrences are in the order of id, then position; the first keeps its lines.  Lines are compared
    without white space at their edges; blank lines are in no window and stay.  A text with fewer than three
    non-blank lines, a null text and a row without id stay as they are.  Rows that share id and text stand at
    the same place, so none is later than the other.  Texts of any length are cleaned whole.  An empty table
    gives an empty one.  Should ``docs`` have columns of the two names, the new ones get a leading underscore;
    other columns don't matter.
    """
    lines, removed, out = (free_name(docs, n) for n in ("n_lines", "n_removed", "line_rest"))
    own = {c: free_name(docs, f"cover_{c}") for c in ("doc", "th", "starts")}
    found = covered(docs, id_column, text_column)
    small = found.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    cover = found.withColumnsRenamed(own)
    if small[0] <= BROADCAST_ROWS and small[1] <= BROADCAST_WINDOWS:
        cover = F.broadcast(cover)
    text, hit = F.col(text_column), F.col(own["starts"]).isNotNull()
    joined = docs.join(cover, (F.col(id_column) == F.col(own["doc"])) & (F.xxhash64(text) == F.col(own["th"])), "left")
    joined = joined.withColumn(out, F.when(hit, _without(text, F.col(own["starts"]))))
    return joined.select(
        *[F.when(hit, F.col(out)["text"]).otherwise(text).alias(c) if c == text_column else docs[c] for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).alias(lines),
        F.when(hit, F.col(out)["removed"]).otherwise(0).alias(removed),
    )


def _let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """``body`` of ``value``, which is computed once however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: F.Column, starts: F.Column) -> F.Column:
    """(text, removed): without the lines in the windows that begin at ``starts``."""
    numbers = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + WINDOW - 1))))

    def rest(lines: F.Column) -> F.Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        gone = _let(F.transform(_numbered(lines), lambda x: x["at"]), lambda at: F.transform(numbers, lambda n: F.get(at, n)))
        return _let(F.array_except(every, gone), lambda left: F.struct(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(left)).alias("removed")))

    return _let(_lines(text), rest)
