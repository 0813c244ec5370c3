"""Text expressions: similarity, names, classes, parsed fields."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """The set of three-letter pieces of each word, words padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


@lru_cache
def _bases() -> tuple[str, str]:
    """Every letter that is another one with marks, and those others, in all scripts: by canonical decomposition."""
    found = {}
    for c in map(chr, range(0xA0, sys.maxunicode + 1)):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
        if len(plain) == 1 and plain != c:
            found[c] = plain
    return "".join(found), "".join(found.values())


def fold(text: Column) -> Column:
    """Without accents and other marks, whether they are written into a letter or after it, in lower case."""
    return F.lower(F.regexp_replace(F.translate(text, *_bases()), r"\p{M}+", ""))


def name_candidates(name: Column, aliases: Mapping[str, str]) -> Column:
    """(key, priority): the folded name, its alias, the reversed name, and that one's alias."""
    plain = F.btrim(fold(name))
    turned = F.concat_ws(" ", F.split_part(plain, F.lit(" "), F.lit(-1)), F.regexp_replace(plain, " ?[^ ]+$", ""))
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    alias = lambda c: known[c] if known is not None else F.lit(None).cast("string")
    ladder = [plain, alias(plain), turned, alias(turned)]
    return F.filter(F.array(*[F.struct(c.alias("key"), F.lit(i).alias("priority")) for i, c in enumerate(ladder)]), lambda x: x["key"].isNotNull())


def classify(text: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str = "other") -> Column:
    """The first class of which one keyword occurs."""
    low, out = F.lower(text), F.lit(other)
    for label, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, label).otherwise(out)
    return out


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group; null, not an empty string, without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def optional_int(text: Column) -> Column:
    """Integers; ``--`` and whatever isn't one are null."""
    return F.when(text.rlike("^-?[0-9]{1,9}$"), text.cast("int"))


def made_attempted(text: Column) -> Column:
    """``7-15`` as a struct; ``--`` is null."""
    parts = F.split(text, "-")
    return F.when(text.rlike("^[0-9]+-[0-9]+$"), F.struct(parts[0].cast("int").alias("made"), parts[1].cast("int").alias("attempted")))


def year_wrap(month: Column, day: Column, seen: Column) -> Column:
    """The date of a month and day without year: in the year before if it would lie over 60 days ahead."""
    guess = F.make_date(F.year(seen), month, day)
    return F.when(F.datediff(guess, seen) > 60, F.add_months(guess, -12)).otherwise(guess)


def status_bucket(status: Column) -> Column:
    low = F.lower(status)
    return F.when(low.isin("out", "out for season", "suspended"), "out").when(low.isin("doubtful", "questionable", "day-to-day", "game time decision"), "at_risk").when(low.isin("probable", "available"), "likely")
