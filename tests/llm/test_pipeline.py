"""The corpus pipeline against plain Python, stage by stage."""

import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm import wordpieces

from test_operators import DOCS, brute_components, brute_lines, edited, fill, prose


def test_pipeline_against_brute_force(spark, tmp_path):
    base = [prose(s, 120) for s in range(8)]
    passage = "first shared line\nsecond shared line\nthird shared line"
    texts = [f"{b}\n{passage}" if i % 2 else b for i, b in enumerate(base)] + [edited(b, i, 2) for i, b in enumerate(base)]
    texts += [prose(50 + i, random.Random(i).randrange(20, 200)) for i in range(20)]
    texts += ["you idiot moron scum", f"idiot moron scum\n{passage}", passage, "", base[0]]
    rows = [(i, t, "en" if i % 3 else "fr", f"src{i % 5}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # Without labels the basic words judge.
    left = [r for r in rows if "idiot" not in r[1]]
    cut = brute_lines([r[1] for r in left])
    left = [(i, t, lang, source) for (i, _, lang, source, _), (t, n) in zip(left, cut, strict=True) if not (n and not t.strip(" \t\r\n"))]
    groups = brute_components([t for _, t, _, _ in left], 80)
    left = [r for r, (at, _, first) in zip(left, groups, strict=True) if at == first]
    assert len(left) < len(rows) - 10
    leaves = {}
    for i, t, lang, source in left:
        leaves.setdefault((f"d{int(source[3:]) % 4}", lang, source), []).append((i, t))
    tokens = {k: sum(len(t.split()) for _, t in own) for k, own in leaves.items()}
    budget = {(): float(int(sum(tokens.values()) * 0.9))}
    for depth in (1, 2, 3):
        for parent in {k[: depth - 1] for k in leaves}:
            kids = sorted({k[:depth] for k in leaves if k[: depth - 1] == parent})
            budget |= zip(kids, fill(budget[parent], [sum(n for k, n in tokens.items() if k[:depth] == kid) for kid in kids], [1] * len(kids)), strict=True)
    want = {}
    for leaf, own in leaves.items():
        full, rest = divmod(int(budget[leaf] + 1e-6), tokens[leaf])
        upto = 0
        for i, t in sorted(own, key=lambda x: hashlib.md5(f"20240607:{full + 1}:{x[0]}".encode()).hexdigest()):
            upto += len(t.split())
            if full or upto <= rest:
                want[i] = t
    ids = wordpieces.encoder(wordpieces.public_vocabulary()).encode(list(want.values()))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert 0 < len(want) < len(left) and got == {i: len(x) + 1 for i, x in zip(want, ids, strict=True)}


EXTRA = ("n_removed", "n_lines", "gone", "doc", "th", "at", "epoch", "start", "score", "node", "component_id", "kept", "level_0", "mix_full", "ids")


def write(spark, folder, rows):
    """``rows`` as documents with columns that could clash, and no labels."""
    docs = spark.createDataFrame(rows, DOCS)
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit(7))
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_keep_the_columns_and_odd_rows(spark, tmp_path):
    passage = "first shared line\nsecond shared line\nthird shared line"
    rows = [(None, None, None, None, None), (None, "some words", "en", "src1", 10), (1, None, "en", "src1", 0), (2, "", None, "src1", 0), (3, prose(1, 60), "en", None, None), (3, prose(1, 60), "en", None, None)]
    rows += [(4, f"{passage}\n{prose(2, 50)}", "en", "src1", 9), (5, f"{prose(3, 50)}\n{passage}", "en", "src1", 9), (6, passage, "en", "src1", 9), (7, "idiot moron scum", "en", "src1", 9), (8, prose(9, 30_000), "en", "src2", 9)]
    docs = write(spark, str(tmp_path), rows)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema == docs.schema
        docs = spark.createDataFrame(out.collect(), docs.schema)
        left[name] = sorted((r["doc_id"] or 0) for r in docs.collect())
        assert all(r[c] == 7 for r in docs.collect() for c in EXTRA)
    assert left["toxicity"] == [0, 0, 1, 2, 3, 3, 4, 5, 6, 8]
    # The passage of 5 goes and 6, which is nothing else, with it.
    assert left["line_dedup"] == [0, 0, 1, 2, 3, 3, 4, 5, 8] and {r["doc_id"]: r["n_chars"] for r in docs.collect()}.get(5) == len(prose(3, 50))
    assert left["near_dedup"] == left["line_dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted({r["doc_id"] or 0 for r in packed}) == sorted(set(left["mixture"]))


def test_nothing_gives_nothing(spark, tmp_path):
    write(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
