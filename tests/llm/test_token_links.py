"""Links between two tokenizers against brute force: groups, counts, odd texts, blocks."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tidemark.llm import token_links as t

DOCS = "doc_id long, text string, block string, ids string, n string"
ODD = ["a", " ", "  ", "a ", " a  b ", "x\n\n y", "日本語 テキスト١٢", "😀😀 áb áb", "<|endoftext|> <s></s>", "<0x41> ▁x", "a▁b", "ﬁ ﬀ", "\x00 a\x00", "  a　b", "===== ======== aaaaaaaaaaaaaaaaaaaaaaaa", "\t\t a", "the the the", "", None, " x", "﻿a", "e" * 3000]


def brute(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel  # noqa: F401

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    docs = []
    for doc, text, *_ in rows:
        whole, groups = (" " + (text or "")).encode(), []
        a = [(i, bytes(code[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in (second.encode(text) if text else []) for p in [second.id_to_piece(i)]]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((doc, [], [], []))
            continue
        at = 0, 0
        left, right, ia, ib, now = 0, 0, 0, 0, ([], [])
        while ia < len(a) or ib < len(b):
            if left <= right and ia < len(a):
                now[0].append(a[ia][0])
                left += len(a[ia][1])
                ia += 1
            else:
                now[1].append(b[ib][0])
                right += len(b[ib][1])
                ib += 1
            if left == right:
                groups.append(now)
                now = ([], [])
        del at
        docs.append((doc, a, b, groups))
    count = Counter()
    for _, _, _, groups in docs:
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc, a, b, groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        spelt = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(spelt.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    pieces = ["the", " ", "  ", "ing", "tion", "é", "\n", "12", "日", "'s", "...", "▁", "zz", " hello", "=" * 5, "́"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(n)]


@pytest.mark.parametrize("block", [t.BLOCK_BYTES, 40])
def test_links_against_brute_force(spark, block):
    own = [*ODD, *texts(4, 150), *texts(4, 40)]
    rows = [(i, x, "b", "i", "n") for i, x in enumerate(own)] + [(3, "the the", None, None, None), (3, "the the", None, None, None), (None, "an", None, None, None), (2**60 + 1, " hello", None, None, None)]
    got = t.token_links(spark.createDataFrame(rows, DOCS).repartition(3), block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_whole_documents_of_the_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = t.token_links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_no_documents(spark):
    assert t.token_links(spark.createDataFrame([], DOCS)).collect() == []
    assert t.token_links(spark.createDataFrame([(1, None, "", "", "")], DOCS).repartition(1)).collect() == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_pairs_held_by_several_groups_of_a_document_count_once():
    # Groups 5|7, 5,6|7 and 6|8; the first document holds the first two of them, the second all.
    groups = t.Groups(np.array([0]), np.array([5, 5, 6, 6]), np.array([0, 1, 3, 4]), np.array([7, 7, 8]), np.array([0, 1, 2, 3]))
    pairs, n = t.counted_again(groups, np.array([0, 0, 1, 1, 1]), np.array([0, 1, 0, 1, 2]))
    assert [(int(p) >> 32, int(p) & 0xFFFFFFFF, int(k)) for p, k in zip(pairs, n, strict=True)] == [(5, 7, 2)]


def test_interned_rows_are_told_apart_by_both_columns():
    keys = np.array([[1, 1], [2, 5], [1, 2], [1, 1], [2, 5], [1, 2]], np.uint64)
    for own in (keys, keys[[0, 1, 3, 4]]):
        of, first = t.interned(own)
        assert (own[first[of]] == own).all() and len(first) == len({tuple(k) for k in own.tolist()})
