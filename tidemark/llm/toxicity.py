"""Toxicity by a weighted lexicon that is learnt from labels.

Texts are folded first: case, lookalike letters of other alphabets and digits used as letters go to one plain
letter each; accents stay, as they tell words apart, but whole words are also looked up without them.  The lexicon holds whole words and beginnings of words; a weight is the log of how
much more often an entry stands in toxic texts than in clean ones, word for word.
One Aho-Corasick pass finds them; hits inside exception phrases don't count; the sum of weights, divided by
the root of the text's length in words, is put on a scale from 0 to 1 on which 0.7 separates the labels best.

The fit looks at a bounded sample (``TOXIC`` + ``CLEAN`` labelled documents, chosen by a hash of the id).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import give_back, held_out, materialize

#: Bounds of the sample.
TOXIC, CLEAN = 4000, 8000
#: Lengths of word beginnings, documents that must hold an entry, its least weight, different words before it.
SHORTEST, LONGEST, SUPPORT, LEAST, CONTEXTS = 3, 10, 8, 2.5, 4
#: A longer entry stays beside its beginning only if its weight is so much larger.
LARGER = 2.5
#: Entries that a task counts before it hands them on.
HELD = 50_000
#: Score from which a text is rejected.
REJECT = 0.7
#: What is used where labels teach nothing (fixed values).
BASIC = ("idiot", "moron", "loser", "scum", "stupid", "pathetic", "worthless", "disgusting")
#: Letters of other alphabets that look like Latin ones, and digits and signs used for letters (fixed values).
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i",
}


class _Fold(dict):
    """By code point, filled as characters come."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKC", chr(code).lower()):
            c = LOOKALIKES.get(c, c)
            if c.isalnum() or unicodedata.category(c) in ("Mn", "Mc"):
                out += c
            elif unicodedata.category(c) not in ("Cf", "Me"):
                out += " "
        self[code] = out
        return out


class _Plain(dict):
    """Letters without their accents."""

    def __missing__(self, code: int) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c) != "Mn")
        self[code] = out = unicodedata.normalize("NFC", bare)
        return out


_FOLD, _PLAIN = _Fold(), _Plain()


def fold(text: str | None) -> str:
    """Folded words with one space before, between and after; a single space if there are none."""
    # Composed before, so that equal texts fold alike, and after, as lookalikes may take accents.
    words = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text or "").translate(_FOLD)).split()
    return f" {' '.join(words)} " if words else " "


@dataclass(frozen=True)
class Lexicon:
    """``weights``: by " word " or " beginning"; ``exceptions``: folded phrases " a b "; ``threshold``: normalised
    sum from which a text counts as toxic."""

    weights: tuple[tuple[str, float], ...] = tuple((fold(w), 6.0) for w in BASIC)
    exceptions: tuple[str, ...] = field(default=())
    threshold: float = 1.0


def _automaton(lexicon: Lexicon, whole: bool = False) -> ahocorasick.Automaton:
    """With ``whole`` only of the whole words."""
    out = ahocorasick.Automaton()
    spared = set(lexicon.exceptions)
    for phrase in spared:
        out.add_word(phrase, (len(phrase), 0.0))
    for pattern, weight in lexicon.weights:
        if pattern not in spared and (pattern.endswith(" ") or not whole):
            out.add_word(pattern, (len(pattern), weight))
    if len(out):
        out.make_automaton()
    return out


def _spaces(text: str) -> list[int]:
    return [m.start() for m in re.finditer(" ", text)]


class Matcher:
    """A lexicon's automata, which a task builds once."""

    def __init__(self, lexicon: Lexicon):
        self.all, self.whole = _automaton(lexicon), _automaton(lexicon, True)

    def hits(self, folded: str) -> dict[int, float]:
        """The largest weight at each word's start, without words that an exception phrase holds."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for automaton, plain in ((self.all, False), (self.whole, True)):
            if not len(automaton) or plain and folded.isascii():
                continue
            text = folded.translate(_PLAIN) if plain else folded
            # Words may change their length, not their number: the n-th space of one text is that of the other.
            place = dict(zip(_spaces(text), _spaces(folded), strict=True)) if plain else None
            for end, (length, weight) in automaton.iter(text):
                start = end - length + 1
                if place is not None:
                    start, end = place[start], place[end]
                if weight:
                    found[start] = max(weight, found.get(start, 0.0))
                else:
                    spared.append((start, end))
        if not spared:
            return found
        # Both in order, so each is looked at once.
        kept, upto, at = {}, -1, 0
        spared.sort()
        for start in sorted(found):
            while at < len(spared) and spared[at][0] <= start:
                upto = max(upto, spared[at][1])
                at += 1
            if start >= upto:
                kept[start] = found[start]
        return kept

    def strength(self, text: str | None) -> float:
        folded = fold(text)
        return sum(self.hits(folded).values()) / math.sqrt(folded.count(" ") + 9)


def scaled(raw: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    middle = math.log(REJECT / (1 - REJECT))
    slope = (middle + 3.5) / lexicon.threshold
    return 1 / (1 + np.exp(-np.clip(middle + slope * (raw - lexicon.threshold), -50, 50)))


def scores(texts: F.Column, lexicon: Lexicon) -> F.Column:
    """0 to 1; null and empty texts get the score of a text without hits."""

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon)
        for column in columns:
            yield pd.Series(scaled(np.array([matcher.strength(t) for t in column]), lexicon))
            give_back()

    return score(texts)


def _sample(docs: DataFrame, labels: DataFrame, toxic: str, id_column: str, text_column: str) -> DataFrame:
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [known.filter(F.col(toxic) == y).select("doc_id", F.lit(y).alias("y")).distinct().orderBy(*order).limit(n) for y, n in ((1, TOXIC), (0, CLEAN))]
    ids = chosen[0].union(chosen[1]).groupBy("doc_id").agg(F.max("y").alias("y"))
    # At most TOXIC + CLEAN ids.
    return materialize(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y"), "labelled")


def _patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each word and word beginning, how often it stands there, and a set of the words before it: sums
    over some texts at a time, so that a task holds no more than about ``HELD`` entries."""
    docs: Counter = Counter()
    times: Counter = Counter()
    before: dict[str, int] = {}

    def summed() -> pd.DataFrame:
        out = pd.DataFrame({"p": list(docs), "docs": list(docs.values()), "n": [times[p] for p in docs], "before": [before[p] for p in docs]})
        for held in (docs, times, before):
            held.clear()
        return out

    for batch in batches:
        for text in batch["text"]:
            words = fold(text).split()
            own: dict[str, list[int]] = {}
            for word, last in zip(words, ["", *words], strict=False):
                entry = own.setdefault(word, [0, 0])
                entry[0] += 1
                entry[1] |= 1 << (sum(last.encode()) % 31)
            here = set()
            for word, (n, bits) in own.items():
                for p in [f" {word} ", *(f" {word[:k]}" for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]:
                    here.add(p)
                    times[p] += n
                    before[p] = before.get(p, 0) | bits
            docs.update(here)
            if len(docs) >= HELD:
                yield summed()
        give_back()
    if docs:
        yield summed()
    give_back()


def _closed(found: DataFrame) -> DataFrame:
    """Without entries of which one longer entry has nearly all occurrences."""
    longer = found.groupBy(F.expr("substring(p, 1, length(p) - 1)").alias("p")).agg(F.max("n").alias("longer"))
    return found.join(longer, "p", "left").filter(F.coalesce("longer", F.lit(0)) < 0.9 * F.col("n")).drop("longer")


def _shortest(weights: dict[str, float]) -> dict[str, float]:
    """Without entries that say little more than a kept beginning of theirs."""
    kept: dict[str, float] = {}
    for p in sorted(weights, key=len):
        if all(weights[p] >= kept[p[:k]] + LARGER for k in range(SHORTEST + 1, len(p)) if p[:k] in kept):
            kept[p] = weights[p]
    return kept


def learn(docs: DataFrame, labels: DataFrame, toxic: str = "toxic", id_column: str = "doc_id", text_column: str = "text") -> Lexicon:
    """A lexicon from the rows of ``labels`` (doc_id and ``toxic`` 0 or 1) outside the held-out fold.

    Without toxic and clean labelled texts, or if no word tells them apart, the basic one.
    """
    sample = _sample(docs, labels, toxic, id_column, text_column)
    sums = sample.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))).alias("words")).collect()
    many, words = {r["y"]: r["n"] for r in sums}, {r["y"]: r["words"] + 1 for r in sums}
    if not many.get(1) or not many.get(0):
        return Lexicon()
    toxic_rows, clean_rows = sample.filter("y = 1"), sample.filter("y = 0")
    support = min(SUPPORT, max(2, many[1] // 50))
    kind = "p string, docs long, n long, before long"
    mined = toxic_rows.select("text").mapInPandas(_patterns, kind).groupBy("p").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.bit_or("before").alias("before"))
    wide = materialize(mined.filter((F.col("docs") >= support) & (F.bit_count("before") >= min(CONTEXTS, support))).select("p", "n"), "patterns")
    clean = clean_rows.select("text").mapInPandas(_patterns, kind).groupBy("p").agg(F.sum("n").alias("clean"))
    rate = lambda n, y: F.log((n + 0.5) / words[y])
    weighed = _closed(wide).join(clean, "p", "left").select("p", (rate(F.col("n"), 1) - rate(F.coalesce("clean", F.lit(0)), 0)).alias("w"))
    # All that tell toxic from clean texts; the sample bounds them.
    weights = {r["p"]: r["w"] for r in weighed.filter(F.col("w") >= LEAST).collect()}
    lexicon = Lexicon(tuple(sorted((p, round(w, 3)) for p, w in _shortest(weights).items())))
    if not lexicon.weights:
        return Lexicon()

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        matcher = Matcher(lexicon)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                folded, own = fold(text), set()
                for start in matcher.hits(folded):
                    last, after = folded.rfind(" ", 0, start), folded.find(" ", start + 1)
                    if last >= 0:
                        own.add(folded[last : after + 1])
                    if (then := folded.find(" ", after + 1)) > 0:
                        own.add(folded[start : then + 1])
                counts.update((p, y) for p in own)
            give_back()
        if counts:
            yield pd.DataFrame({"p": [p for p, _ in counts], "y": [y for _, y in counts], "n": list(counts.values())})

    around = sample.mapInPandas(phrases, "p string, y int, n long").groupBy("p").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    spared = around.filter((F.col("good") >= support) & (F.col("good") / many[0] >= 9 * F.col("bad") / many[1]))
    lexicon = Lexicon(lexicon.weights, tuple(sorted(r["p"] for r in spared.collect())))

    @F.pandas_udf("int")
    def bin_of(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon)
        for column in columns:
            yield pd.Series([min(4000, int(50 * matcher.strength(t))) for t in column], dtype="int32")

    table = sample.groupBy(bin_of("text").alias("bin"), "y").agg(F.count("*").alias("n")).collect()
    return Lexicon(lexicon.weights, lexicon.exceptions, _threshold([(r["bin"], r["y"], r["n"]) for r in table]))


def _threshold(table: list[tuple[int, int, int]]) -> float:
    """The normalised sum with the best F measure; in the lower half of the range that has it."""
    bad, good = Counter(), Counter()
    for b, y, n in table:
        (bad if y else good)[b] += n
    total, best = sum(bad.values()), (-1.0, 1, 1)
    caught, wrong = 0, 0
    bins = sorted({*bad, *good}, reverse=True)
    for b, lower in zip(bins, [*bins[1:], 0], strict=True):
        caught, wrong = caught + bad[b], wrong + good[b]
        measure = 2 * caught / (total + caught + wrong)
        if b and measure > best[0]:
            best = (measure, lower + 1 if lower or good[0] else b, b)
    return max(0.02, (best[1] + 0.4 * (best[2] - best[1])) / 50)


def toxicity(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; predicted is 1 from a score of 0.7 on.

    Null, empty and very long texts are scored like any other, whole; a null id is in no fold (held_out false);
    repeated rows give repeated rows, an empty table none; other columns don't matter.
    """
    score = F.col("score")
    out = docs.select(F.col(id_column).alias("doc_id"), scores(F.col(text_column), lexicon).alias("score"))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (score >= REJECT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic.

    Null and empty texts stay, as they hold no toxic word; repeated rows stay or go together; rows without id are
    judged like any other; the columns are those of ``docs``, whatever their names; an empty table stays empty.
    """
    return docs.filter(scores(F.col(text_column), lexicon) < REJECT)
