"""The operators on small frames: brute-force versions, round trips, nulls, ties, repeated rows, empty tables."""

import itertools
import math
import random
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tidemark.llm import license_texts, licenses, lines, minhash, mixing, packing, shingles, tiff, topk, toxicity, training_order, url_rules, wordpieces
from tidemark.llm.components import connected_components
from tidemark.llm.shared import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


# --- words and ids -------------------------------------------------------------------------------------

ODD_TEXTS = ["a²b 12½ x", "it's we'll  foo\n\n bar\t", "日本語 テキスト١٢", "😀 áb‍ __init__ $$$", "\x1c a", " ", "x\u3000y", "I'M don'T <|endoftext|>", "a   b \n  \n c", " \n", "a\n \nb", "", " a", "a ", None, "foo\n  bar", "x \ty"]


def test_ids_are_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    pieces = ["<|endoftext|>", "<|endoftext", " ", "  ", "a", "é", "\n", "12", "日", "'s", "..."]
    texts = [*ODD_TEXTS, *(prose(i, 300) for i in range(5)), "<|endoftext|>", "<|endoftext|><|endoftext|>", *("".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(2000))]
    for text, ids in zip(texts, wordpieces.encoder(wordpieces.public_vocabulary()).encode(texts), strict=True):
        assert ids.tolist() == own.encode(text or "", add_special_tokens=False).ids


def test_shingle_words_split_at_ascii_space_only():
    a, b, c, d = shingles.hashed_words(["A\tb\x0bc", " a b  c ", "a\u00a0b c", None])
    assert a.tolist() == b.tolist() and len(c) == 2 and len(d) == 0
    assert len(shingles.shingle_set(a, 5)) == 1 and len(shingles.shingle_set(d, 5)) == 0


# --- mixture -------------------------------------------------------------------------------------------


def fill(total, caps, weights):
    """Water-filling, by bisection."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for c, w in zip(caps, weights, strict=True)) <= total else (low, mid)
    return [min(c, w * low) for c, w in zip(caps, weights, strict=True)]


def test_mixture_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, prose(i, rng.randrange(0, 60)), rng.choice(["en", "fr", None]), f"src{rng.choice([0, 0, 0, 1, 2, 5])}", 0) for i in range(400)]
    mixture = mixing.Mixture(weights={("d0",): 2, ("d0", "en"): 3, ("d2", "fr"): 0}, share=0.8, epochs=2, seed=3)
    leaves = {}
    for i, t, lang, source, _ in rows:
        leaves.setdefault((f"d{int(source[3:]) % 4}", lang or "(none)", source), []).append((i, len(t.split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budget = {(): float(int(sum(tokens.values()) * 0.8))}
    for depth in (1, 2, 3):
        for parent in {k[: depth - 1] for k in leaves}:
            kids = sorted({k[:depth] for k in leaves if k[: depth - 1] == parent})
            caps = [2 * sum(n for k, n in tokens.items() if k[:depth] == kid) for kid in kids]
            budget |= zip(kids, fill(budget[parent], caps, [mixture.weights.get(k, 1) for k in kids]), strict=True)
    import hashlib

    want = Counter()
    for leaf, own in leaves.items():
        b = int(budget[leaf] + 1e-6)
        full, rest = divmod(b, tokens[leaf])
        for i, _ in own:
            want.update((i, e) for e in range(1, full + 1))
        upto = 0
        for i, n in sorted(own, key=lambda x: hashlib.md5(f"3:{full + 1}:{x[0]}".encode()).hexdigest()):
            upto += n
            if upto > rest:
                break
            want[(i, full + 1)] += 1
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.mix(spark.createDataFrame(rows, DOCS), mixture).collect())
    assert got == want


def test_mixture_edges(spark):
    plain = mixing.Mixture()
    assert mixing.mix(spark.createDataFrame([], DOCS), plain).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, 0, 9), (1, "", "en", "x", 0, 9), (1, "a b", "en", "x", 0, 9), (1, "a b", "en", "x", 0, 9)], DOCS + ", epoch int")
    got = mixing.mix(odd, mixing.Mixture(share=1.0))
    assert got.columns == [*odd.columns, "_epoch"] and got.count() == 4


# --- line windows --------------------------------------------------------------------------------------


def brute_lines(texts):
    first, out = {}, []
    for text in texts:
        own = (text or "").split("\n")
        real = [i for i, x in enumerate(own) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(real) - 2):
            window = tuple(own[i].strip(" \t\r") for i in real[k : k + 3])
            if window in first:
                gone |= set(real[k : k + 3])
            first.setdefault(window, True)
        out.append(("\n".join(x for i, x in enumerate(own) if i not in gone) if text is not None else None, len(gone)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["a", "b", "c", " a ", "", "long line", "z"]) for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    texts += [None, "", "a\nb\nc", "a\nb\nc", "a\na\na\na\na", "\n\n\n\n", "x\n" * 3000]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in lines.drop_repeated_lines(docs_of(spark, texts).filter("text is not null")).collect())
    want = [(i, *x) for i, x in enumerate(brute_lines(texts)) if x[0] is not None]
    assert got == want


def test_lines_edges(spark):
    odd = spark.createDataFrame([(None, "a\nb\nc", 5), (1, None, 5), (2, "a\nb\nc", 5), (2, "a\nb\nc", 5), (3, "a\nb\nc\nd", 5)], "doc_id long, text string, n_lines int")
    got = lines.drop_repeated_lines(odd)
    assert got.columns == ["doc_id", "text", "n_lines", "_n_lines", "n_removed"]
    assert sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in got.filter("text is not null").collect()) == [(0, "a\nb\nc", 0), (2, "a\nb\nc", 0), (2, "a\nb\nc", 0), (3, "d", 3)]
    assert lines.drop_repeated_lines(odd.limit(0)).count() == 0


def test_lines_beside_clashing_columns(spark):
    odd = spark.createDataFrame([(1, "a\nb\nc", 1), (2, "a\nb\nc\nd", 1)], "doc_id long, text string, doc int")
    for c in ("th", "starts", "cover_doc", "cover_starts", "line_rest", "n_removed", "h1", "at", "l", "w"):
        odd = odd.withColumn(c, F.lit(1))
    got = lines.drop_repeated_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "_n_removed"] and sorted(r["text"] for r in got.collect()) == ["a\nb\nc", "d"]


def test_lines_of_a_long_text(spark):
    # Twice the lines, about twice the time: a text is split once.
    long = "\n".join(f"line {i % 9000} {i // 9000}" for i in range(18_000))
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs_of(spark, [long, long + "\nlast", long])).collect()}
    assert [(got[i]["n_lines"], got[i]["n_removed"]) for i in range(3)] == [(18_000, 0), (18_001, 18_000), (18_000, 18_000)]
    assert got[1]["text"] == "last" and got[2]["text"] == "" and got[0]["text"] == long


# --- toxicity ------------------------------------------------------------------------------------------


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T") == toxicity.fold("іdіоt") == toxicity.fold("ｉｄｉｏｔ") == " idiot "
    assert toxicity.fold(None) == toxicity.fold("") == " "
    own = toxicity.Matcher(toxicity.Lexicon(((" idiot ", 5.0), (" scum", 4.0)), (" idiot proof ",)))
    assert own.strength("an idiot proof design") == 0
    assert own.strength("Ídiôt") == own.strength("idiot") > 0
    assert own.strength("you idiot, you scumbag") > own.strength("you idiot " + "word " * 100) > 0


def test_strength_against_brute_force():
    rng = random.Random(9)
    words_ = ["idiot", "idiots", "ídiôt", "proof", "scum", "scumbag", "sc", "a", "b", "हिन्दी", "of", "the", "tha"]
    lexicon = toxicity.Lexicon(((" idiot ", 5.0), (" scum", 4.0), (" scumbag ", 6.0), (" sc ", 1.5), (" idi", 2.0), (" a ", 0.5)), (" idiot proof ", " scum of the ", " of scum ", " a a "))
    matcher = toxicity.Matcher(lexicon)
    for _ in range(400):
        own = [rng.choice(words_) for _ in range(rng.randrange(40))]
        # Digits and lookalikes are in other tests: here a word folds to itself but for its accents.
        folded = toxicity.fold(" ".join(own)).split()
        plain = toxicity.fold(" ".join("".join(c for c in unicodedata.normalize("NFKD", w) if unicodedata.category(c) != "Mn") if w.isascii() or w == "ídiôt" else w for w in own)).split()
        total = 0.0
        for i, w in enumerate(folded):
            best = max((x for p, x in lexicon.weights if (p[1:-1] in (w, plain[i]) if p.endswith(" ") else w.startswith(p[1:]))), default=0)
            inside = any(side[s : s + len(e.split())] == e.split() for e in lexicon.exceptions for side in (folded, plain) for s in range(i - len(e.split()) + 1, i + 1) if s >= 0)
            total += 0 if inside else best
        assert matcher.strength(" ".join(own)) == pytest.approx(total / math.sqrt((len(folded) + 1) + 9))


def test_exceptions_of_a_long_text():
    # Each hit and each exception is looked at once.
    matcher = toxicity.Matcher(toxicity.Lexicon(((" idiot ", 5.0),), (" idiot proof ",)))
    folded = toxicity.fold("idiot proof or idiot " * 60_000)
    assert len(matcher.hits(folded)) == 60_000


@pytest.mark.parametrize("other", ["x\u0323\u0316", "हिन्दी", "바보", "\u0301", "ﬁ"])
def test_accents_beside_any_other_word(other):
    matcher = toxicity.Matcher(toxicity.Lexicon(((" idiot ", 5.0), (" café ", 4.0)), (" idiot proof ",)))
    for text in (f"{other} an Ídiôt", f"an Ídiôt {other}", f"{other} an I\u0301dio\u0302t"):
        folded = toxicity.fold(text)
        assert matcher.hits(folded) == {folded.index(" ídiôt "): 5.0}
    assert matcher.hits(toxicity.fold(f"{other} cafe\u0301")) and not matcher.hits(toxicity.fold(f"{other} ídiôt proof"))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    got = toxicity.toxicity(docs, lexicon).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    # Some toxic labels are on texts that hold nothing but junk.
    assert n[(1, 1)] >= 0.93 * (n[(1, 1)] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.005 * n[(0, 0)]


def test_rare_toxic_words_are_weighed_too(spark):
    rng = random.Random(6)
    common = sorted({"".join(rng.choice("bcdfghjkmnpqrtuvwxyz") for _ in range(7)) for _ in range(5000)})
    texts = [" ".join(rng.sample(common, len(common))) for _ in range(60)]
    toxic = [f"{t} zorgul {rng.choice(common)}" if i < 20 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(toxic + texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, toxic int")
    assert any(p.startswith(" zo") for p, _ in toxicity.learn(docs, labels).weights)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "idiot moron scum", 1), (2, "idiot moron scum", 1), (3, "fine " * 50_000, 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, none)
    got = sorted((r["doc_id"] or 0, r["predicted"]) for r in toxicity.toxicity(docs, lexicon).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 0)]
    assert toxicity.drop_toxic(docs, lexicon).columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), lexicon).count() == 0


# --- near duplicates -----------------------------------------------------------------------------------


def brute_components(texts, percent=85):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(s), root[i]) for i, s in enumerate(sets)]


def edited(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_against_brute_force(spark):
    base = [prose(s, 150) for s in range(12)]
    texts = [edited(b, 100 * k + i, k % 7) for i, b in enumerate(base) for k in range(30)]
    texts += base[:3] * 5 + ["", None, " \n", "one", "one", "One two", "one two", "é É", "a b c d", "a  b\tc d", prose(77, 4000), edited(prose(77, 4000), 1, 20)]
    random.Random(1).shuffle(texts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, texts)).collect())
    assert got == brute_components(texts)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    base = prose(3, 120)
    texts = [edited(base, i, i % 5) for i in range(60)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, texts)).collect())
    assert got == brute_components(texts)


def test_near_duplicates_in_chains(spark, monkeypatch):
    # Ends of a chain share buckets and aren't alike; two chains share a long passage and so some buckets.
    monkeypatch.setattr(minhash, "BLOCK", 3)
    texts, shared = [], prose(40, 90)
    for c in range(3):
        text = f"{shared} {prose(c, 60)}"
        for i in range(25):
            texts.append(text)
            text = edited(text, 100 * c + i, 2)
    random.Random(2).shuffle(texts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, texts)).collect())
    assert got == brute_components(texts)


def test_keep_one_beside_clashing_columns(spark):
    odd = spark.createDataFrame([(1, "a b", 5), (2, "a b", 5), (3, None, 5), (None, "a b", 5)], "doc_id long, text string, gone int")
    for c in ("kept", "node", "h", "doc", "component_id", "n_shingles", "low", "key"):
        odd = odd.withColumn(c, F.lit(1))
    got = minhash.keep_one(odd)
    assert got.columns == odd.columns and sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 1, 3]


def test_near_duplicates_edges(spark):
    odd = spark.createDataFrame([(None, "a b", 1), (5, "a b", 1), (5, "a b", 1), (6, "A B", 1), (7, None, 1)], "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect() if r["component_id"] is not None)
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True)]
    assert minhash.keep_one(odd).columns == odd.columns and minhash.keep_one(odd).count() == 4
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {n: n for p in links for n in p}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    want = {n: r for n, r in root.items() if sum(x == r for x in root.values()) > 1}
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- URLs ----------------------------------------------------------------------------------------------

URLS = {
    "https://Blog.Example.ORG/es/1?x=1": ("blog.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://other.org/en/12": ("other.org", "/en/12", "org/", "allow"),
    "http://notorg/": ("notorg", "/", None, "allow"),
    "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
    "http://a.com/de": ("a.com", "/de", None, "allow"),
    "http://a.org": ("a.org", "", None, "allow"),
    "http://a.org#x": ("a.org", "", None, "allow"),
    "a.org/es": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "x://É.com/fr/?://": ("É.com", "/fr/", "com/fr/", "allow"),
}


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(URLS)], "page_id long, url string, host int")
    got = url_rules.judge(pages, []).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == list(URLS.values())
    assert url_rules.judge(pages.limit(0), []).count() == 0


def test_mined_url_rules(spark):
    rng = random.Random(1)
    urls = [f"http://h{rng.randrange(5)}.net/{rng.choice(['buy', 'news'])}/{rng.randrange(999)}{rng.choice(['?ref=x', ''])}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = F.col("url").contains("/buy/") & F.col("url").contains("ref=")
    labelled = pages.select(url_rules.tokens(F.col("url")).alias("items"), bad.alias("block"))
    mined = url_rules.mine(labelled)
    assert mined and url_rules.mine(labelled.limit(0)) == []
    got = {r["page_id"]: (r["verdict"], r["by"]) for r in url_rules.judge(pages, mined).collect()}
    items = {i: set(r["items"]) for i, r in enumerate(labelled.collect())}
    for i, u in enumerate(urls):
        best = max(((c, len(need), v) for need, v, c in mined if set(need) <= items[i]), default=None)
        assert got[i] == ((best[2], "mined") if best else ("allow", "default"))
        assert (got[i][0] == "block") == ("/buy/" in u and "ref=" in u)


def test_url_tokens_are_whole(spark):
    url = "http://a.b.c.d.e.net/p/q/r/s/casino/x7"
    (row,) = spark.createDataFrame([(url,)], "url string").select(url_rules.tokens(F.col("url")).alias("items")).collect()
    hosts = {"host:net", "host:e.net", "host:d.e.net", "host:c.d.e.net", "host:b.c.d.e.net", "host:a.b.c.d.e.net"}
    words = {*(f"word:{w}" for w in ("a", "b", "c", "d", "e", "net")), *(f"in:{w}" for w in ("p", "q", "r", "s", "casino", "x"))}
    assert set(row["items"]) == {"scheme:http", "first:a", *hosts, *words, "path0:p", "path1:q", "path2:r", "path3:s", "path4:casino", "path5:x#"}


def test_words_of_urls_are_tokens(spark):
    url = "http://spam-farm.best-casino7.example/Win_now/42-free%20é?q=word"
    (row,) = spark.createDataFrame([(url,)], "url string").select(url_rules.tokens(F.col("url")).alias("items")).collect()
    assert {"word:spam", "word:farm", "word:casino", "in:win", "in:now", "in:free", "in:é"} <= set(row["items"]) and not any("word:q" in t or t == "in:" for t in row["items"])


def test_rare_verdicts_have_rules_by_their_odds(spark):
    """One page in ten is bad, half of those with one word: a confidence of 0.75 says nothing of it, its odds do."""
    rng = random.Random(5)
    rows = []
    for i in range(1000):
        hit = rng.random() < 0.1
        rows.append((i, f"http://{'spam-' if hit else ''}h{i % 7}.net/p{i % 11}", rng.random() < (0.55 if hit else 0.05)))
    pages = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    labelled = pages.select(url_rules.tokens(F.col("url")).alias("items"), "block")
    spam = lambda mined: {r["verdict"] for r in url_rules.judge(pages, mined).filter("url like '%spam-%'").collect()}
    assert "allow" in spam(url_rules.mine(labelled))
    assert spam(url_rules.mine(labelled, confidence=0.5, odds_ratio=3.0)) == {"block"}


def test_mined_url_rules_of_deep_paths_and_middle_labels(spark):
    rng = random.Random(2)
    urls = [f"http://{rng.choice('abcdefgh')}.{rng.choice('mnop')}.{rng.choice(['bad', 'ok1', 'ok2'])}.x.y.net/{'/'.join(rng.choice('uvw') for _ in range(4))}/{rng.choice(['casino', 'news'])}/z" for _ in range(800)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = F.col("url").contains("/casino/") & F.col("url").contains(".bad.")
    mined = url_rules.mine(pages.select(url_rules.tokens(F.col("url")).alias("items"), bad.alias("block")), 0.05)
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, mined).collect()}
    assert all((got[i] == "block") == ("/casino/" in u and ".bad." in u) for i, u in enumerate(urls))


def test_mined_url_rules_are_minimal_and_whole(spark):
    rng = random.Random(3)
    baskets = [({"u", *(t for t in "abcde" if rng.random() < 0.5)}, rng.random()) for _ in range(300)]
    baskets = [(i | ({"a2"} if "a" in i else set()), x < (0.95 if {"a", "b"} <= i else 0.8 if "c" in i else 0.6)) for i, x in baskets]
    got = list(url_rules.mine(spark.createDataFrame([(sorted(i), b) for i, b in baskets], "items array<string>, block boolean"), 0.02))
    share, want = sum(b for _, b in baskets) / len(baskets), {}
    assert share > 2 / 3
    for n in range(1, 8):
        for need in itertools.combinations(["a", "a2", "b", "c", "d", "e", "u"], n):
            own = [b for i, b in baskets if set(need) <= i]
            for verdict, hit, base in (("block", sum(own), share), ("allow", len(own) - sum(own), 1 - share)):
                if hit >= 6 and hit / len(own) >= max(0.75, base) and all(hit / len(own) > c for (s, v), c in want.items() if v == verdict and set(s) < set(need)):
                    want[need, verdict] = hit / len(own)
    assert {(tuple(i), v): pytest.approx(c) for i, v, c in got} == want and len(got) == len(want)


# --- packing -------------------------------------------------------------------------------------------


def test_packing(spark):
    texts = [*ODD_TEXTS, *(prose(i, random.Random(i).randrange(1, 900)) for i in range(300)), prose(9, 9000), "same text", "same text"]
    rows = packing.pack(docs_of(spark, texts)).collect()
    own = dict(enumerate(wordpieces.encoder(wordpieces.public_vocabulary()).encode(texts)))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, ids in own.items():
        whole, at = np.append(ids, 0).astype("<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole) and r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_packing_edges(spark):
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1)], "doc_id long, text string, start int")
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packing.pack(odd).collect()) == [(0, 1), (1, 1), (1, 1)]
    assert packing.pack(odd.limit(0)).count() == 0


def test_nnls_against_its_conditions():
    a = packing.combinations()
    b = np.random.default_rng(0).integers(0, 50, a.shape[0]).astype(float)
    x = packing.nnls(a, b, 20_000)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and slope.min() > -1e-3 and abs(slope @ x) < 0.1


# --- TIFF ----------------------------------------------------------------------------------------------


def lzw(data):
    table, width, last, held, bits, out = {bytes([i]): i for i in range(256)}, 9, b"", 0, 0, bytearray()

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    put(256)
    following = 258
    for b in data:
        if last + bytes([b]) in table:
            last += bytes([b])
            continue
        put(table[last])
        table[last + bytes([b])] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            put(256)
            table, following, width = {bytes([i]): i for i in range(256)}, 258, 9
        last = bytes([b])
    put(table[last])
    following += 1
    width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def packbits(data):
    out = bytearray()
    for value, run in itertools.groupby(data):
        n = len(list(run))
        while n:
            k = min(n, 128)
            out += bytes([257 - k, value]) if k > 1 else bytes([0, value])
            n -= k
    return bytes(out) + bytes([128])


PACK = {tiff.STORED: bytes, tiff.PACKBITS: packbits, tiff.LZW: lzw, tiff.DEFLATE: zlib.compress, tiff.OLD_DEFLATE: zlib.compress}


def image(samples, order, compression, predictor, tile=None, strip=5):
    """One-page file; ``samples``: (lines, columns, channels)."""
    high, wide, depth = samples.shape
    kind = samples.dtype.newbyteorder(order)

    def pack(block):
        block = np.diff(block, axis=1, prepend=block.dtype.type(0)) if predictor == 2 else block
        return PACK[compression](block.astype(kind).tobytes())

    if tile:
        padded = np.zeros((-(-high // tile) * tile, -(-wide // tile) * tile, depth), samples.dtype)
        padded[:high, :wide] = samples
        blocks = [pack(padded[r : r + tile, c : c + tile]) for r in range(0, high, tile) for c in range(0, wide, tile)]
    else:
        blocks = [pack(samples[r : r + strip]) for r in range(0, high, strip)]
    body, places = b"", []
    for b in blocks:
        places.append(8 + len(body))
        body += b + b"\0" * (len(b) % 2)
    tags = [(256, [wide]), (257, [high]), (258, [8 * samples.itemsize] * depth), (259, [compression]), (277, [depth]), (317, [predictor])]
    tags += [(322, [tile]), (323, [tile]), (324, places), (325, [len(b) for b in blocks])] if tile else [(273, places), (278, [strip]), (279, [len(b) for b in blocks])]
    at = 8 + len(body)
    directory, more = struct.pack(order + "H", len(tags)), b""
    for tag, values in sorted(tags):
        packed = struct.pack(f"{order}{len(values)}I", *values)
        if len(packed) > 4:
            packed, more = struct.pack(order + "I", at + 6 + 12 * len(tags) + len(more)), more + packed
        directory += struct.pack(order + "HHI", tag, 4, len(values)) + packed
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + body + directory + b"\0\0\0\0" + more


@pytest.mark.parametrize("compression", PACK)
@pytest.mark.parametrize("order", "<>")
def test_tiff_reads_what_was_written(compression, order):
    rng = np.random.default_rng(compression)
    for kind, depth, predictor, tile in itertools.product((np.uint8, np.uint16), (1, 3), (1, 2), (None, 16)):
        samples = rng.integers(0, 9, (37, 41, depth)).astype(kind)
        if compression == tiff.LZW:
            samples = rng.integers(0, 200, (67, 101, depth)).astype(kind)
        (got,) = tiff.pages(image(samples, order, compression, predictor, tile))
        assert (got == samples).all()


def test_tiff_rows(spark):
    _, long = tiff.payload("é" * 400_000)
    files = [(1, tiff.write(long)), (2, None), (3, b"no"), (4, tiff.write(b"\0" * 64)[:-9]), (5, image(np.ones((3, 3, 1), np.uint8), "<", 1, 1)), (5, image(np.ones((3, 3, 1), np.uint8), "<", 1, 1))]
    got = tiff.read_pages(spark.createDataFrame(files, "id long, data binary"), "id", "data").collect()
    assert b"".join(bytes(r["pixels"]) for r in sorted((r for r in got if r["id"] == 1), key=lambda r: r["page"])) == long
    assert [bool(r["error"]) for r in got if r["id"] in (2, 3, 4)] == [True] * 3 and sum(r["id"] == 5 for r in got) == 2


@pytest.mark.parametrize("tag", [256, 257, 277, 278, 322, 323])
def test_tiff_without_size(tag, spark):
    samples = np.ones((5, 7, 1), np.uint8)
    for tile in (None, 16):
        good = bytearray(image(samples, "<", tiff.DEFLATE, 1, tile))
        (at,) = struct.unpack_from("<I", good, 4)
        for k in range(struct.unpack_from("<H", good, at)[0]):
            if struct.unpack_from("<H", good, at + 2 + 12 * k)[0] == tag:
                struct.pack_into("<I", good, at + 2 + 12 * k + 8, 0)
                with pytest.raises(ValueError):
                    list(tiff.pages(bytes(good)))


def test_damaged_tiff_is_only_an_error():
    rng = random.Random(5)
    samples = np.arange(40 * 30, dtype=np.uint8).reshape(40, 30, 1)
    good = [image(samples, order, c, p, tile) for order in "<>" for c in PACK for p in (1, 2) for tile in (None, 16)]
    for n in range(6000):
        data = bytearray(good[n % len(good)])
        (at,) = struct.unpack_from("<I" if data[:2] == b"II" else ">I", data, 4)
        for _ in range(rng.randrange(1, 4)):
            place = rng.randrange(at, len(data)) if rng.random() < 0.7 else rng.randrange(len(data))
            data[place] = rng.choice([0, 1, 255, rng.randrange(256)])
        try:
            list(tiff.pages(bytes(data[: rng.choice([len(data), len(data), rng.randrange(len(data))])])))
        except ValueError:
            pass


def test_text_media(spark):
    import hashlib

    texts = ["", None, "a", "é" * 32, "x" * 64, "x" * 65, "same", "same", "long text " * 60_000]
    odd = docs_of(spark, texts).withColumn("feature", F.lit(1))
    rows = sorted(tiff.text_media(odd).collect(), key=lambda r: r["doc_id"])
    for t, r in zip(texts, rows, strict=True):
        raw = (t or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert rows[6]["feature"] == rows[7]["feature"] and rows[6]["media_sha256"] == rows[7]["media_sha256"] and rows[0]["feature"] == rows[1]["feature"]
    assert tiff.text_media(odd.limit(0)).count() == 0


def test_tiff_ids_beside_nulls_keep_their_digits(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    rows = spark.createDataFrame([(i, str(i), tiff.write(b"\0" * 64)) for i in ids], "doc_id long, text string, data binary").coalesce(1)
    assert [r["doc_id"] for r in tiff.text_media(rows).collect()] == ids
    assert [r["id"] for r in tiff.read_pages(rows, "doc_id", "data").collect()] == ids


# --- licences ------------------------------------------------------------------------------------------


def test_increasing_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        seconds = rng.sample(range(20), 9)
        pairs = list(enumerate(seconds))
        best = max(n for n in range(1, 10) for c in itertools.combinations(seconds, n) if list(c) == sorted(c))
        got = licenses.increasing(pairs)
        assert len(got) == best and [b for _, b in got] == sorted(b for _, b in got)


def common(a, b):
    """Length of a longest common subsequence, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment_against_brute_force():
    rng = random.Random(8)
    for n in range(300):
        a = [rng.choice("abcdefghijklmnop"[: 2 + n % 15]) for _ in range(rng.randrange(25))]
        b = [rng.choice("abcdefghijklmnop"[: 2 + n % 15]) for _ in range(rng.randrange(25))]
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
        assert len(got) <= common(a, b)
        # Where every word stands once on each side, patience alignment finds a longest one.
        a, b = rng.sample(range(30), 18), rng.sample(range(30), 18)
        assert len(licenses.align(a, b)) == common(a, b)


def test_spans_against_brute_force():
    # Every window of a text against every template, by longest common subsequences.
    rng = random.Random(12)
    templates = {f"t{k}": " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(9)}" for _ in range(n)) for k, n in enumerate((8, 14, 25))}
    scanner = licenses.Scanner(templates)
    for n in range(60):
        own = []
        for _ in range(rng.randrange(4)):
            own += [f"x{rng.randrange(40)}" for _ in range(rng.randrange(12))]
            copy = rng.choice(list(templates.values())).split()
            for _ in range(n % 3):
                copy[rng.randrange(len(copy))] = f"y{rng.randrange(9)}"
            own += copy
        own += [f"x{rng.randrange(40)}" for _ in range(10)]
        best = {k: max(common(own[i : i + len(t.split())], t.split()) for i in range(len(own))) / len(t.split()) for k, t in templates.items()}
        got = {k for k, *_ in scanner.scan(" ".join(own))}
        assert {k for k, c in best.items() if c >= licenses.COVERAGE} <= got <= {k for k, c in best.items() if c >= licenses.COVERAGE - 0.2}


def test_texts_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("you may read this\nbut not aloud")
    assert license_texts.read_texts(spark, str(tmp_path)) == {"Own-1.0": "you may read this\nbut not aloud"}
    with pytest.raises(ValueError, match="bytes"):
        license_texts.read_texts(spark, str(tmp_path), 5)


def test_license_spans(spark):
    header = license_texts.NOTICES["Apache-2.0-header"]
    mit = license_texts.NOTICES["MIT-text"]
    changed = mit.replace("sublicense", "relicense").replace("Software", "Work", 1)
    texts = [prose(1, 300) + "\n" + header + "\n" + prose(2, 200), changed, prose(3, 50), None, "", f"{mit} {prose(4, 30)} {mit}", "Released under the MIT License.", "the License of the software in any version " * 50]
    got = {}
    for r in licenses.license_spans(docs_of(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["license"] for r in got[0]] == ["Apache-2.0-header"] and got[0][0]["coverage"] == 1.0 and got[0][0]["first_word"] == 300
    assert [r["license"] for r in got[1]] == ["MIT-text"] and 0.9 < got[1][0]["coverage"] < 1
    assert [r["license"] for r in got[5]] == ["MIT-text"] * 2 and [r["license"] for r in got[6]] == ["MIT"]
    assert set(got) == {0, 1, 5, 6} and licenses.license_spans(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("name", license_texts.NOTICES)
def test_each_of_adjacent_notices(name):
    text = license_texts.NOTICES[name]
    n = len(licenses.words(text))
    for copies in (2, 3, 5):
        assert [x[:1] + x[2:4] for x in licenses.Scanner(license_texts.NOTICES).scan(" ".join([text] * copies))] == [(name, i * n, (i + 1) * n) for i in range(copies)]


def test_notices_with_plain_english_between():
    header = license_texts.NOTICES["Apache-2.0-header"]
    between = "you may copy the software and use it under the license or the law in this file as agreed except for the work of others " * 4
    got = licenses.Scanner(license_texts.NOTICES).scan(f"{header} {between} {header}")
    n, m = len(licenses.words(header)), len(licenses.words(between))
    assert [x[:1] + x[2:4] for x in got if x[0] == "Apache-2.0-header"] == [("Apache-2.0-header", 0, n), ("Apache-2.0-header", n + m, 2 * n + m)]


# --- training order ------------------------------------------------------------------------------------


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n, 5).tolist()) == list(range(n))
    assert training_order.feistel(np.arange(1000), 1000, 5).tolist() != training_order.feistel(np.arange(1000), 1000, 6).tolist()


def stored(folder, rows, per_shard, length):
    """What the shards hold by slot; the rows' sums must agree with it."""
    out = []
    for r in sorted(rows, key=lambda r: r["slot"]):
        own = training_order.read_slots(f"{folder}/shard-{r['shard']:08d}.bin", r["slot"] % per_shard, 1, length)
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["byte_offset"] == r["slot"] % per_shard * length * 2
        out.append(own.tobytes())
    return out


@pytest.mark.parametrize("steps", [1, 2, 7])
def test_training_order(spark, tmp_path, steps):
    docs = docs_of(spark, [*ODD_TEXTS, *(prose(i, 200) for i in range(40))]).repartition(3)
    seqs = materialize(training_order.sequences(docs, 64), "sequences")
    rows = training_order.write_in_order(seqs, f"file://{tmp_path}/out", 64, 9, 10, steps).collect()
    n = seqs.count()
    assert [r["slot"] for r in sorted(rows)] == list(range(n))
    assert sorted(stored(tmp_path / "out", rows, 10, 64)) == sorted(zstandard.decompress(r["ids"]) for r in seqs.collect())
    empty = materialize(training_order.sequences(docs.limit(0), 64), "sequences")
    assert training_order.write_in_order(empty, f"file://{tmp_path}/none", 64, 9, 10, steps).count() == 0


def test_training_order_goes_on_and_sees_other_input(spark, tmp_path):
    texts = [prose(i, 200) for i in range(40)]
    run = lambda t, **more: training_order.materialise(docs_of(spark, t), f"file://{tmp_path}", 64, 9, 10, **more).collect()
    rows = run(texts)
    (folder,) = tmp_path.glob("*/shards-of-*")
    whole = stored(folder, rows, 10, 64)
    files = {p: p.stat().st_mtime_ns for p in folder.glob("*.bin")}
    assert sorted(run(texts)) == sorted(rows) and {p: p.stat().st_mtime_ns for p in folder.glob("*.bin")} == files
    # A step that isn't noted is made again: only what is missing is written.
    (folder / "rows-1-of-2" / "_SUCCESS").unlink()
    (lost := max(files)).unlink()
    assert sorted(run(texts)) == sorted(rows) and stored(folder, rows, 10, 64) == whole
    assert all(p.stat().st_mtime_ns == t for p, t in files.items() if p != lost)
    # Texts of equal number and length, but others; and another key.
    other = run([t.replace("w1", "w2") for t in texts])
    (second,) = set(tmp_path.glob("*/shards-of-*")) - {folder}
    assert stored(second, other, 10, 64) != whole and stored(folder, rows, 10, 64) == whole
    assert len(run(texts, end_id=7)) == len(rows) and len(set(tmp_path.glob("*/shards-of-*"))) == 3
    # Sequences that were not written to the end are not used.
    (next(folder.parent.glob("sequences-*")) / "_SUCCESS").unlink()
    again = run(texts)
    (third,) = set(folder.parent.glob("shards-of-*")) - {folder}
    assert stored(third, again, 10, 64) and len(again) == len(rows)


def test_training_order_edges(spark, tmp_path):
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "x " * 50_000, 1)], "slot long, text string, ids int")
    rows = training_order.materialise(odd, f"file://{tmp_path}", 64, 9, 100).collect()
    assert sum(r["n_tokens"] for r in rows) > 50_000
    assert training_order.materialise(odd.limit(0), f"file://{tmp_path}", 64, 9, 100).count() == 0
    wide = wordpieces.public_vocabulary()._replace(special=(("<x>", 70_000),))
    with pytest.raises(Exception, match="16 bits"):
        training_order.sequences(odd, 64, vocabulary=wide).count()
    with pytest.raises(ValueError, match="16 bits"):
        training_order.sequences(odd, 64, end_id=2**16)


# --- top-k ---------------------------------------------------------------------------------------------


def brute_top(rows, k):
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: a for i, a in whole if i % 20 == 0}.items():
        found = sorted({(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(a) == len(b)})[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_topk_against_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + spread * rng.normal(size=16)).round(3).tolist()) for i in range(900)]
    rows += [(i, centres[0].tolist()) for i in range(900, 1000)]  # one vector many times
    rows += [(2000, None), (2001, []), (2020, [float("nan")] * 16), (2040, [None] * 16), (2060, [1.0] * 3), (2061, [2.0] * 3), (None, [1.0] * 16)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table).collect())
    assert got == brute_top(rows, 20)


def test_topk_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], kind)).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])], kind)
    assert [tuple(r) for r in topk.top_k(twice).collect()] == [(0, 1, 1, 4096)]


def test_topk_in_many_cells_and_rounds(spark, monkeypatch):
    for name, n in (("QUERY_BLOCK", 4), ("DATA_BLOCK", 20), ("PIVOTS", 9), ("SAMPLE", 30)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(3)
    rows = [(i, (3 * rng.normal(size=2)).round(1).tolist()) for i in range(500)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == brute_top(rows, 20)


def test_topk_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [2e9, 1.0]), (20, [2e9, 3.0]), (21, [1.0, 0.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    most, big = 2**63 - 1, 64 * 2 * 10**9
    assert got[:5] == [(0, 1, 1, most), (0, 2, 3, most), (0, 3, 20, most), (0, 4, 21, most), (0, 5, 2, -(2**63))]
    assert got[5:] == [(20, 1, 0, most), (20, 2, 1, most), (20, 3, 3, most), (20, 4, 21, 64 * big), (20, 5, 2, -(2**63))]


def test_cover_tree_covers():
    points = np.random.default_rng(1).normal(size=(500, 3))
    tree = topk.CoverTree(points)
    for centre, radius, children, members in tree.nodes:
        assert np.linalg.norm(points[members] - points[centre], axis=1).max() <= radius + 1e-9
        assert not children or sorted(i for c in children for i in tree.nodes[c][3]) == sorted(members)
    assert len(tree.nodes) > 1
