"""License texts in documents, by patience alignment.

A template's words that occur once in it say where it may stand: their places in a text that imply about the
same beginning make a stretch.  The stretch and the template are then aligned: words unique to both sides
are anchors, the longest increasing subsequence of them is kept, and the gaps between anchors are aligned
the same way; equal words at the ends of a gap count first.  Coverage is the share of the template's words
that are matched.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.license_texts import NOTICES
from tidemark.llm.shared import slices

WORD = re.compile(r"[^\W_]+")
#: Share of a template's single words that a stretch must hold to be aligned, and coverage from which it is reported.
LIKELY, COVERAGE = 0.5, 0.85


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of ``pairs`` (sorted by first) whose seconds increase, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        before.append(at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [b]
        at[pile : pile + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``, increasing in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        out.extend(anchors)
        if anchors:
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            stack.extend((p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False))
    return sorted(out)


class Scanner:
    def __init__(self, templates: Mapping[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {k: words(t) for k, t in templates.items()}
        self.seeds: dict[str, list[tuple[str, int]]] = defaultdict(list)
        self.n_seeds = {}
        for k, t in self.templates.items():
            count = Counter(t)
            once = [(w, i) for i, w in enumerate(t) if count[w] == 1]
            self.n_seeds[k] = len(once)
            for w, i in once:
                self.seeds[w].append((k, i))

    def stretches(self, text: list[str]) -> Iterator[tuple[str, int, int]]:
        """(template, first, last + 1): where enough of its single words imply about the same beginning."""
        implied: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for at, w in enumerate(text):
            for k, i in self.seeds.get(w, ()):
                implied[k].append((at - i, w))
        for k, found in implied.items():
            size, enough = len(self.templates[k]), LIKELY * self.n_seeds[k]
            slack = size // 4 + 2
            found.sort()
            group: list[tuple[int, str]] = []
            for begin, w in [*found, (None, "")]:
                if group and (begin is None or begin - group[-1][0] > slack):
                    if len({x for _, x in group}) >= enough:
                        yield k, max(0, group[0][0] - slack), min(len(text), group[-1][0] + size + slack)
                        for first, last in self.copies(group, size, slack, enough):
                            yield k, max(0, first), min(len(text), last)
                    group = []
                if begin is not None:
                    group.append((begin, w))

    @staticmethod
    def copies(group: list[tuple[int, str]], size: int, slack: int, enough: float) -> Iterator[tuple[int, int]]:
        """Stretches around each beginning that many single words of a group (sorted) agree on, as it may hold
        several copies: as long as the template, as far as words nearby reach, and widened."""
        agree: dict[int, set[str]] = defaultdict(set)
        for begin, w in group:
            agree[begin].add(w)
        begins = sorted(agree)
        for i, peak in enumerate(begins):
            near = begins[bisect_left(begins, peak - slack) : bisect_left(begins, peak + slack + 1)]
            if any((len(agree[b]), -b) > (len(agree[peak]), -peak) for b in near if abs(b - peak) <= slack // 2):
                continue
            if len(set().union(*(agree[b] for b in near))) >= enough:
                close = [b for b in near if abs(b - peak) <= slack // 2]
                yield peak, peak + size
                yield close[0], close[-1] + size
                yield peak - slack, peak + size + slack

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, first word, last word + 1, matched words), by place; of stretches that overlap the
        one with more matched words stays, then the shorter."""
        own = words(text or "")
        found = set()
        for k, first, last in sorted(set(self.stretches(own))):
            template = self.templates[k]
            matched = align(own[first:last], template)
            # Matches far off the rest are chance.
            middle = sorted(x - y for x, y in matched)[len(matched) // 2] if matched else 0
            inner = [m for m in matched if abs((m[0] - m[1]) - middle) <= len(template) // 4 + 2]
            if inner and len(inner) >= self.coverage * len(template):
                found.add((k, len(inner) / len(template), first + inner[0][0], first + inner[-1][0] + 1, len(inner)))
        kept: list[tuple[int, int, tuple[str, float, int, int, int]]] = []  # in order, none over another
        for x in sorted(found, key=lambda x: (-x[4], -x[1], x[0], x[3] - x[2], x[2])):
            at = bisect_left(kept, (x[2],))
            if (at == len(kept) or x[3] <= kept[at][0]) and (not at or kept[at - 1][1] <= x[2]):
                insort(kept, (x[2], x[3], x))
        return [x for _, _, x in kept]


def license_spans(docs: DataFrame, templates: Mapping[str, str] = NOTICES, coverage: float = COVERAGE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, license, coverage, first_word, end_word, matched: a row for each stretch that covers a template.

    Null and empty texts give none; null ids stay; repeated rows give repeated rows; an empty table none; other
    columns don't matter.  Whole texts are searched.  A text with several notices, or one several times, gives a
    row for each; of stretches that overlap the one with most matched words counts.
    """
    names = ["license", "coverage", "first_word", "end_word", "matched"]
    kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in slices(batches, "text"):
            out = [(d, *x) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for x in scanner.scan(t)]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.int64(), *kinds], strict=True)], ["doc_id", *names])

    return docs.filter(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(rows, "doc_id long, license string, coverage double, first_word int, end_word int, matched int")
