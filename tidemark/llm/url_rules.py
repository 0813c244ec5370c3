"""Judging URLs by given rules, then by association rules mined from labels.

Tokens of a URL are its scheme, all its host's suffixes and its first label, the words of its host and of its path,
all path segments by position (digits as #), query keys and whether it has a fragment.  Spark's FP-growth mines which combinations of tokens go with
blocked pages; rules are pruned by support and confidence, none may be worse than no rule, and none stays that a
part of it makes needless; their number has no bound.  Each rule stands in an inverted index under its rarest
token, so a URL meets only rules of which it holds that token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import by_size, materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: The rules that every page is judged by first (fixed values).
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pruning of mined rules, and up to how many the index is broadcast (beyond that it is joined by a shuffle).
SUPPORT, CONFIDENCE, LIFT, BROADCAST = 0.005, 0.75, 1.0, 100_000
BLOCK, ALLOW = "=block", "=allow"


def _rest(url: F.Column) -> F.Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: F.Column) -> F.Column:
    """A-Z lower-cased; empty for null and where ``://`` is missing."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host_: F.Column, path_: F.Column, rules: Sequence[Rule]) -> F.Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: F.Column) -> F.Column:
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    placed = F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), F.regexp_replace(s, "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query:"), F.substring_index(s, "=", 1)))
    scheme = F.concat(F.lit("scheme:"), F.substring_index(F.coalesce(url, F.lit("")), "://", 1))
    said = lambda kind, c: F.transform(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != ""), lambda w: F.concat(F.lit(kind), w))
    fragment = F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(scheme, F.concat(F.lit("first:"), F.get(labels, 0))), suffixes, placed, keys, fragment, said("word:", host(url)), said("in:", path(url))))


@dataclass(frozen=True, eq=False)
class Mined:
    """Mined rules as written tables, iterated as (tokens, verdict, confidence).

    ``alias``: token, its stand-in; tokens on exactly the same labelled pages share one.  ``rules``: token (the
    rarest of ``need``), need (stand-ins), mined, confidence, gain.
    """

    alias: DataFrame
    rules: DataFrame

    def __iter__(self) -> Iterator[tuple[list[str], str, float]]:
        """One for each choice of tokens behind the stand-ins."""
        same: dict[str, list[str]] = {}
        for r in self.alias.toLocalIterator():
            same.setdefault(r["item"], []).append(r["token"])
        for r in self.rules.toLocalIterator():
            for items in product(*(same[t] for t in r["need"])):
                yield sorted(items), r["mined"], r["confidence"]


def _minimal(itemsets: DataFrame) -> DataFrame:
    """``itemsets`` (need, mined, confidence) with ``below``: the largest confidence of a smaller set with the same verdict."""
    longest = itemsets.agg(F.max(F.size("need"))).first()[0] or 0
    level = itemsets.filter(F.size("need") == 1).withColumn("below", F.lit(0.0))
    levels = [level]
    for k in range(2, longest + 1):
        upto = level.select(F.col("need").alias("less"), "mined", F.greatest("confidence", "below").alias("below"))
        parts = itemsets.filter(F.size("need") == k).withColumn("less", F.explode(F.transform("need", lambda t: F.array_except("need", F.array(t)))))
        level = materialize(parts.join(upto, ["less", "mined"]).groupBy("need", "mined").agg(F.first("confidence").alias("confidence"), F.max("below").alias("below")), "level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, odds_ratio: float = 0.0) -> Mined | list:
    """The rules in ``labelled`` (items: array of tokens, block: boolean); an empty list without labelled pages.

    A rule goes only if a part of its tokens gives the same verdict with at least its confidence.  ``odds_ratio``: how
    far the odds of a rule's verdict must be above those of all pages, which asks the same of a rare verdict as of a
    common one.
    """
    mark = F.when(F.col("block"), BLOCK).otherwise(ALLOW)
    known = labelled.filter(F.col("items").isNotNull() & F.col("block").isNotNull())
    numbered = known.select(F.monotonically_increasing_id().alias("basket"), F.array_distinct(F.concat("items", F.array(mark))).alias("items"))
    baskets = materialize(numbered.select("basket", F.explode("items").alias("token")), "baskets")
    marks = {r["token"]: r["count"] for r in baskets.filter(F.col("token").isin(BLOCK, ALLOW)).groupBy("token").count().collect()}
    total = sum(marks.values())
    if not total:
        return []
    # Sets with two tokens of the same pages, or with one of all pages, say what a smaller set says.
    pages = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("basket")).alias("x"), F.bit_xor(F.xxhash64("basket", F.lit(1))).alias("y")]
    often = baskets.filter(~F.col("token").isin(BLOCK, ALLOW)).groupBy("token").agg(*pages).filter(F.col("n") >= math.ceil(support * total))
    alias = materialize(often.withColumn("item", F.min("token").over(Window.partitionBy("n", "x", "y"))).select("token", "item", "n"), "alias")
    # At most tokens of a page / support.
    single = F.broadcast(alias.filter((F.col("token") == F.col("item")) & (F.col("n") < total)).select("token"))
    kept = baskets.join(single, "token").unionByName(baskets.filter(F.col("token").isin(BLOCK, ALLOW)).select("token", "basket"))
    items = materialize(kept.groupBy("basket").agg(F.collect_list("token").alias("items")), "items")
    found = FPGrowth(itemsCol="items", minSupport=support).fit(items).freqItemsets
    of = F.when(F.array_contains("items", BLOCK), BLOCK).when(F.array_contains("items", ALLOW), ALLOW)
    sets = materialize(found.select(F.array_sort(F.array_except("items", F.array(F.lit(BLOCK), F.lit(ALLOW)))).alias("need"), of.alias("mined"), "freq").filter(F.size("need") > 0), "itemsets")
    whole = sets.filter("mined is null").select("need", F.col("freq").alias("n"))
    rated = materialize(sets.filter("mined is not null").join(whole, "need").select("need", "mined", (F.col("freq") / F.col("n")).alias("confidence")), "rated")
    everywhere = [([r["item"]], m, n / total, 0.0) for r in alias.filter(F.col("n") == total).select("item").distinct().collect() for m, n in marks.items()]
    rules = _minimal(rated).unionByName(labelled.sparkSession.createDataFrame(everywhere, "need array<string>, mined string, confidence double, below double"))
    share = F.when(F.col("mined") == BLOCK, marks.get(BLOCK, 0) / total).otherwise(marks.get(ALLOW, 0) / total)
    odds = lambda p: F.when(p < 1, p / (1 - p)).otherwise(float("inf"))
    rules = rules.filter((F.col("confidence") >= confidence) & (F.col("confidence") >= lift * share) & (F.col("confidence") > F.col("below")))
    rules = rules.select("need", F.expr("substring(mined, 2)").alias("mined"), "confidence", F.when(share < 1, odds(F.col("confidence")) / odds(share)).otherwise(1.0).alias("gain")).filter(F.col("gain") >= odds_ratio)
    known_items = F.broadcast(alias.filter("token = item").select("item", "n"))
    rarest = rules.withColumn("item", F.explode("need")).join(known_items, "item").groupBy("need", "mined").agg(F.min(F.struct("n", "item")).alias("rarest"), F.first("confidence").alias("confidence"), F.first("gain").alias("gain"))
    return Mined(alias, materialize(rarest.select(F.col("rarest.item").alias("token"), "need", "mined", "confidence", "gain"), "rules"))


def judge(pages: DataFrame, mined: Mined | list, rules: Sequence[Rule] = RULES, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, by for each row of ``pages``.

    ``by`` says what judged: rule, mined or default.  A null url, or one without ``://``, has an empty host and
    path and so no rule.  Repeated rows give repeated rows; an empty table none; null ids stay.  Of mined rules
    that fit, the one whose odds are most above those of all labelled pages judges.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")).select("page_id", "url", host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    learnt = F.lit(None).cast("string")
    if mined:
        open_ = rows.filter("found is null and url is not null").select("url").distinct().withColumn("token", F.explode(tokens(url)))
        held = open_.join(F.broadcast(mined.alias), "token").groupBy("url").agg(F.collect_set("item").alias("items"))
        index = by_size(mined.rules, BROADCAST)
        met = held.withColumn("token", F.explode("items")).join(index, "token").filter(F.size(F.array_except("need", "items")) == 0)
        best = met.groupBy(F.col("url").alias("known")).agg(F.max(F.struct("gain", "confidence", F.size("need"), "mined")).alias("best")).select("known", "best.mined")
        # Pages that a given rule judges have nothing to look up, and would all have the same key.
        asked = F.col("found").isNull() & url.isNotNull()
        judged = rows.filter(~asked).withColumns({"known": F.lit(None).cast("string"), "mined": F.lit(None).cast("string")})
        rows = rows.filter(asked).join(best, url == F.col("known"), "left").unionByName(judged)
        learnt = F.col("mined")
    by = F.when(F.col("found").isNotNull(), "rule").when(learnt.isNotNull(), "mined").otherwise("default")
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", learnt, F.lit(default)).alias("verdict"), by.alias("by"))
