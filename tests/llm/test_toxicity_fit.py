"""What the lexicon is fitted to, against plain counting over the same texts."""

import math
import random
import zlib
from collections import Counter, defaultdict
from functools import reduce

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.llm import toxicity as tox

DOCS = "doc_id long, text string, lang string"


def corpus(seed=3, n=420):
    """Every sixth text is toxic: slurs in it, of which one is harmless in a phrase that clean texts have."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ran", "vel", "tor", "min", "sup") for b in ("ak", "emo", "isu", "und", "ef")]
    slurs = ["grobnik", "grobniks", "zchwurm", "veltrash"]
    docs = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(8, 40))
        if i % 6 == 0:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(slurs))
        elif i % 3 == 1:
            at = rng.randrange(len(words))
            words[at:at] = ["der", "zchwurm"] if i % 2 else ["zchwurm", "moth"]
        docs.append((i, " ".join(words), "x"))
    return docs, [(i, 0, int(i % 6 == 0)) for i in range(n)]


def entries(text):
    """Times that each word and beginning stands in a text, and marks of the words before it."""
    times, marks = Counter(), defaultdict(set)
    words = tox.fold(text).split()
    for word, last in zip(words, ["", *words], strict=False):
        for p in [f" {word} ", *(f" {word[:k]}" for k in range(tox.SHORTEST, min(tox.LONGEST, len(word)) + 1))]:
            times[p] += 1
            marks[p].add(sum(last.encode()) % 31)
    return times, marks


def brute_weights(bad, good):
    support = min(tox.SUPPORT, max(2, len(bad) // 50))
    docs, n, marks, clean = Counter(), Counter(), defaultdict(set), Counter()
    for text in bad:
        times, own = entries(text)
        docs.update(list(times))
        n.update(times)
        for p in own:
            marks[p] |= own[p]
    for text in good:
        clean.update(entries(text)[0])
    words = {1: sum(len(t.split()) for t in bad) + 1, 0: sum(len(t.split()) for t in good) + 1}
    wide = {p for p in docs if docs[p] >= support and len(marks[p]) >= min(tox.CONTEXTS, support)}
    closed = {p for p in wide if max((n[q] for q in wide if q[:-1] == p), default=0) < 0.9 * n[p]}
    weights = {p: math.log((n[p] + 0.5) / words[1]) - math.log((clean[p] + 0.5) / words[0]) for p in closed}
    weights = {p: w for p, w in weights.items() if w >= tox.LEAST}
    kept = {}
    for p in sorted(weights, key=len):
        if all(weights[p] >= kept[p[:k]] + tox.LARGER for k in range(tox.SHORTEST + 1, len(p)) if p[:k] in kept):
            kept[p] = weights[p]
    return kept, support


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    lexicon = tox.learn(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    seen = [(t, labels[i][2]) for i, t, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    return lexicon, [t for t, y in seen if y], [t for t, y in seen if not y]


def test_weights_are_those_of_plain_counts(fitted):
    lexicon, bad, good = fitted
    want, _ = brute_weights(bad, good)
    assert dict(lexicon.weights) == pytest.approx(want, abs=1e-3) and any("grobnik" in p or p.strip().startswith("gro") for p in want)


def test_counts_may_be_handed_on_in_parts(spark, fitted, monkeypatch):
    _, bad, _ = fitted
    whole = pd.concat(tox._patterns(iter([pd.DataFrame({"text": bad})])))
    monkeypatch.setattr(tox, "HELD", 40)
    parts = list(tox._patterns(iter([pd.DataFrame({"text": bad[:9]}), pd.DataFrame({"text": bad[9:]})])))
    assert len(parts) > 5
    sums = pd.concat(parts).groupby("p").agg({"docs": "sum", "n": "sum", "before": lambda x: reduce(int.__or__, map(int, x))})
    assert sums.sort_index().to_dict() == whole.set_index("p").sort_index().to_dict()


def test_exceptions_are_phrases_of_clean_texts(fitted):
    lexicon, bad, good = fitted
    matcher = tox.Matcher(tox.Lexicon(lexicon.weights))

    def phrases(texts):
        out = Counter()
        for text in texts:
            folded, own = tox.fold(text), set()
            words, starts = folded.split(), set(matcher.hits(folded))
            at = 0
            for i, w in enumerate(words):
                if at in starts:
                    own |= ({f" {words[i - 1]} {w} "} if i else set()) | ({f" {w} {words[i + 1]} "} if i + 1 < len(words) else set())
                at += len(w) + 1
            out.update(own)
        return out

    _, support = brute_weights(bad, good)
    b, g = phrases(bad), phrases(good)
    want = {p for p in g if g[p] >= support and g[p] / len(good) >= 9 * b[p] / len(bad)}
    assert set(lexicon.exceptions) == want


def test_the_threshold_has_the_best_measure(fitted):
    lexicon, bad, good = fitted
    matcher = tox.Matcher(lexicon)
    strengths = [(min(4000, int(50 * matcher.strength(t))), y) for texts, y in ((bad, 1), (good, 0)) for t in texts]

    def measure(cut):
        caught, wrong = (sum(s >= cut and y == want for s, y in strengths) for want in (1, 0))
        return 2 * caught / (len(bad) + caught + wrong)

    best = max(measure(c) for c in {s for s, _ in strengths if s})
    assert measure(math.ceil(50 * lexicon.threshold)) == pytest.approx(best)


def test_held_out_rows_teach_nothing(spark, fitted):
    docs, labels = corpus()
    changed = [(i, f"{t} newword{i % 2} newword" if zlib.crc32(str(i).encode()) % 3 == 1 else t, x) for i, t, x in docs]
    again = tox.learn(spark.createDataFrame(changed, DOCS), spark.createDataFrame([(i, 0, 1 if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in labels], "doc_id long, quality int, toxic int"))
    assert again == fitted[0]
    rows = tox.toxicity(spark.createDataFrame(docs, DOCS), again).filter("held_out").join(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id")
    assert rows.filter(F.col("predicted") != F.col("toxic")).count() <= 0.1 * rows.count()
