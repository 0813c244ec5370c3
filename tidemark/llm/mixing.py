"""Mixing sources to target weights.

Only DataFrame functions.  Sources are the leaves of a tree (domain, language, source).  The token budget
goes down the tree in proportion to the weights of siblings; no node gets more than its leaves can give in
``epochs`` passes, and what it can't take goes to its siblings, so it leaves a subtree only when that is
full.  A leaf with budget b and t tokens gives b // t whole epochs and a prefix of the next one, in the
order of a hash of seed, epoch and document.  The prefix is found by sums over 4096 ranges of that hash and
then inside one range, so no task ever holds a leaf.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import by_size, free_name, materialize

NONE = "(none)"
#: Words as the token measure (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: Leaves up to which the plan is broadcast.
BROADCAST_LEAVES = 100_000
#: The domain of a source: its number's remainder by four.
DOMAIN = "concat('d', coalesce(cast(try_cast(regexp_extract(source, '([0-9]{1,9})', 1) as int) % 4 as string), 'x'))"


@dataclass(frozen=True)
class Mixture:
    """``levels``: names and SQL expressions of the tree's levels.  ``weights``: by path, a tuple of names
    from the top; 1 where nothing is given.  ``share``: the budget as a share of all tokens."""

    levels: Mapping[str, str] = field(default_factory=lambda: {"domain": DOMAIN, "lang": "lang", "source": "source"})
    weights: Mapping[tuple[str, ...], int] = field(default_factory=dict)
    share: float = 0.9
    epochs: int = 1
    seed: int = 7


def _names(mixture: Mixture, docs: DataFrame) -> list[tuple[str, F.Column]]:
    return [(f"level_{k}", F.coalesce(F.expr(e).cast("string"), F.lit(NONE))) for k, e in enumerate(mixture.levels.values())]


def _key(mixture: Mixture, epoch, id_column: str) -> F.Column:
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(mixture.seed)), epoch.cast("string"), name))


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``leaves`` (level_0, .., docs, tokens) with ``capacity`` and ``budget``."""
    levels = [f"level_{k}" for k in range(len(mixture.levels))]
    spark = leaves.sparkSession
    leaves = leaves.withColumn("capacity", F.col("tokens") * mixture.epochs)
    total = float(int((leaves.agg(F.sum("tokens")).first()[0] or 0) * mixture.share))
    done = None
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("cap"))
        given = [(*p, int(w)) for p, w in mixture.weights.items() if len(p) == depth]
        if given:
            known = spark.createDataFrame(given, ", ".join(f"{c} string" for c in path) + ", weight long")
            nodes = nodes.join(F.broadcast(known), path, "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
        else:
            nodes = nodes.withColumn("weight", F.lit(1).cast("long"))
        nodes = nodes.withColumn("above", F.lit(total)) if done is None else nodes.join(done, path[:-1])
        # Siblings in the order in which they fill up.  The common level of those that don't is the largest
        # (budget left by the fuller ones) / (weights of the others).
        by = Window.partitionBy(*path[:-1]) if depth > 1 else Window.partitionBy(F.lit(0))
        order = by.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf")), path[-1])
        fuller = order.rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("cap").over(fuller), F.lit(0))
        heavier = F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(fuller), F.lit(0))
        nodes = nodes.withColumn("level", F.when(heavier > 0, (F.col("above") - before) / heavier))
        share = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(F.max("level").over(by), F.lit(0.0)))
        done = nodes.select(*path, F.greatest(share, F.lit(0.0)).alias("above"))
    return leaves.join(done, levels).withColumn("budget", F.floor("above").cast("long")).drop("above")


def plan(docs: DataFrame, mixture: Mixture, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each leaf: its levels, docs, tokens, capacity, budget, full_epochs and cutoff: of the epoch after
    the full ones, documents whose key is at most ``cutoff`` are taken."""
    names = _names(mixture, docs)
    levels = [n for n, _ in names]
    tokens = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = materialize(docs.select(F.col(id_column).alias("doc"), *[c.alias(n) for n, c in names], tokens.alias("tokens")), "token-counts")
    leaves = narrow.groupBy(*levels).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    planned = budgets(leaves, mixture).withColumn("full_epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens")).cast("int")).otherwise(0))
    planned = materialize(planned.withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens")), "mixture-plan")
    keyed = narrow.withColumnRenamed("tokens", "n").join(by_size(planned.select(*levels, "full_epochs", "rest"), BROADCAST_LEAVES), levels).withColumn("key", _key(mixture, F.col("full_epochs") + 1, "doc"))
    ranges = keyed.groupBy(*levels, F.substring("key", 1, 3).alias("range"), "rest").agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy(*levels).orderBy("range")
    passed = ranges.withColumn("upto", F.sum("n").over(so_far)).filter(F.col("upto") > F.col("rest"))
    edge = materialize(passed.groupBy(*levels).agg(F.min("range").alias("range"), F.min(F.col("upto") - F.col("n")).alias("before")), "mixture-edges")
    inside = keyed.withColumn("range", F.substring("key", 1, 3)).join(by_size(edge, BROADCAST_LEAVES), [*levels, "range"])
    within = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(*levels).orderBy("key"))).filter(F.col("before") + F.col("upto") <= F.col("rest"))
    last = within.groupBy(*levels).agg(F.max("key").alias("last"))
    # All hexadecimal keys are below "g": a leaf without a passed range is taken whole.
    return planned.join(edge, levels, "left").join(last, levels, "left").select(*levels, "docs", "tokens", "capacity", "budget", "full_epochs", F.coalesce("last", "range", F.lit("g")).alias("cutoff"))


def mix(docs: DataFrame, mixture: Mixture, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` in the epochs in which they are taken, with a last column ``epoch`` (from 1).

    A null level is a source of its own, a null text has no tokens, a null id hashes like an empty one; rows
    with the same id stand at the same place of an epoch and enter it together or not at all.  Leaves of
    weight 0 give nothing but documents without tokens at most; a leaf without tokens is taken once.  An
    empty table gives an empty one.
    """
    names = _names(mixture, docs)
    chosen = materialize(plan(docs, mixture, id_column, text_column), "mixture")
    epoch = free_name(docs, "epoch")
    own = {n: free_name(docs, f"mix_{n}") for n, _ in names}
    leaf = chosen.select(*[F.col(n).alias(own[n]) for n in own], F.col("full_epochs").alias(full := free_name(docs, "mix_full")), F.col("cutoff").alias(cut := free_name(docs, "mix_cutoff")))
    joined = docs.withColumns({own[n]: c for n, c in names}).join(by_size(leaf, BROADCAST_LEAVES), list(own.values()))
    partial = _key(mixture, F.col(full) + 1, id_column) <= F.col(cut)
    epochs = F.col(full) + partial.cast("int")
    return joined.filter(epochs > 0).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), epochs)).alias(epoch))
