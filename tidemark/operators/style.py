"""Style space: standardised vectors, nearest neighbours, uniqueness."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standardise(df: DataFrame, columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Each column's z-score (sample deviation; 0 where nothing varies); the moments are joined, not windowed."""
    fitted = df.groupBy(*within).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.join(fitted, list(within)) if within else df.join(F.broadcast(fitted))  # one row
    made = {f"{c}_z": F.when(F.col(c).isNotNull(), F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0)) for c in columns}
    return out.withColumns(made).select(*df.columns, *made)


#: Rows of a block of points and of one of queries, at most about so many.
POINTS, QUERIES = 131_072, 65_536
#: Pairs of blocks, at least, if there are enough rows.
FEWEST = 32
#: Distances that a task looks at together.
CELLS = 1 << 22


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _codes(a: pa.Table, b: pa.Table, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the two tables' values in ``columns``, equal where these are; and which rows have no null there."""
    out, known = np.zeros(len(a) + len(b), dtype=np.int64), np.ones(len(a) + len(b), dtype=bool)
    for c in columns:
        codes = pa.chunked_array([*a[c].chunks, *b[c].chunks], type=a[c].type).combine_chunks().dictionary_encode().indices
        known &= codes.is_valid().to_numpy(zero_copy_only=False)
        out = np.unique(np.stack([out, codes.fill_null(-1).to_numpy()]), axis=1, return_inverse=True)[1].reshape(-1)
    return out[: len(a)], out[len(a) :], known[: len(a)], known[len(a) :]


def _nearest(k: int, same: Sequence[str], other: Sequence[str]):
    """A block of queries against a block of points: ``k`` pairs for each query, by distance and point.

    A product of matrices of single precision, about the points' centre and in units of the largest component, says for
    all pairs how far apart they are, but for its rounding and for what the query's own length adds; those that this
    leaves in question are measured again, component after component.  Points lie by ``other``, so that those which a
    query may not meet are a slice.
    """

    def task(asked: pa.Table, points: pa.Table) -> pa.Table:
        q_ids, p_ids = asked["__q"], points["__p"]
        found: list[tuple] = []
        if len(asked) and len(points):
            points = points.rename_columns([c.replace("__p_", "__g_") for c in points.column_names])
            asked = asked.rename_columns([c.replace("__q_", "__g_") for c in asked.column_names])
            qs, ps, q_known, p_known = _codes(asked, points, [f"__g_{c}" for c in same])
            qo, po, q_faces, p_faces = _codes(asked, points, [f"__g_{c}" for c in other])
            q_known, p_known = q_known & q_faces, p_known & p_faces
            one = pa.chunked_array([*q_ids.chunks, *p_ids.chunks], type=p_ids.type).combine_chunks()
            places = np.unique(one.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            qi, pi = places[: len(asked)], places[len(asked) :]
            v, w = _matrix(asked["__v"]), _matrix(points["__w"])
            for g in np.unique(qs[q_known]):
                mine, theirs = np.flatnonzero((qs == g) & q_known), np.flatnonzero((ps == g) & p_known)
                if not len(theirs):
                    continue
                mine, theirs = mine[np.argsort(qo[mine], kind="stable")], theirs[np.argsort(po[theirs], kind="stable")]
                x, at, far = w[theirs], pi[theirs], po[theirs]
                centre = x.mean(axis=0)
                unit = max(np.abs(x - centre).max(initial=0), np.abs(v[mine] - centre).max(initial=0)) or 1.0
                about, asks = (((y - centre) / unit).astype(np.float32) for y in (x, v[mine]))
                of, own = (np.square(y, dtype=np.float64).sum(axis=1) for y in (about, asks))
                known_by, by_id = np.vstack([-2 * about.T, of.astype(np.float32)]), np.argsort(at, kind="stable")
                # What the product's rounding may hide of the distances that are compared, and somewhat more.
                slack = 6 * (v.shape[1] + 4) * 2.0**-24 * (own + of.max())
                step = max(1, CELLS // len(theirs))
                for i in range(0, len(mine), step):
                    m = mine[i : i + step]
                    d = np.hstack([asks[i : i + step], np.ones((len(m), 1), np.float32)]) @ known_by
                    if not other:
                        _close_off(d, qi[m], at, by_id)
                    else:
                        firsts = np.flatnonzero(np.diff(qo[m], prepend=-1))
                        for first, last in zip(firsts, [*firsts[1:], len(m)], strict=True):
                            d[first:last, slice(*np.searchsorted(far, [qo[m[first]], qo[m[first]] + 1]))] = np.inf
                    kth = np.fmin.reduce(d, axis=1) if k == 1 else np.partition(d, k - 1, axis=1)[:, k - 1] if k <= d.shape[1] else np.full(len(m), np.inf)
                    # Of too few points all are near.
                    near = np.minimum(kth + slack[i : i + step], np.finfo(np.float32).max).astype(np.float32)
                    r, c = np.divmod(np.flatnonzero(d <= near[:, None]), d.shape[1])
                    total = np.zeros(len(r))
                    for j in range(v.shape[1]):
                        total += (x[c, j] - v[m[r], j]) ** 2
                    order = np.lexsort((at[c], total, r))
                    r, c, total = r[order], c[order], total[order]
                    first = np.arange(len(r)) - np.searchsorted(r, r) < k
                    found.append((m[r[first]], theirs[c[first]], np.sqrt(total[first])))
        a, b, d = (np.concatenate([f[i] for f in found]) if found else np.array([], dtype=t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"__q": q_ids.take(pa.array(a)), "__p": p_ids.take(pa.array(b)), "distance": pa.array(d, pa.float64())})

    return task


def _close_off(d: np.ndarray, asked: np.ndarray, at: np.ndarray, by_id: np.ndarray) -> None:
    """No row meets itself: the distances of rows (``asked``) to points of their own number (``at``) become infinite."""
    first, last = (np.searchsorted(at, asked, side, sorter=by_id) for side in ("left", "right"))
    while (more := np.flatnonzero(first < last)).size:
        d[more, by_id[first[more]]] = np.inf
        first = first + 1


def _near(queries: DataFrame, points: DataFrame, ident: str, vector: str, k: int, same: Sequence[str], other: Sequence[str]) -> DataFrame:
    """(__q, __p, distance): pairs among which are each query's ``k`` nearest points, exactly.

    All pairs are looked at, which in many dimensions no bound spares: blocks of queries meet blocks of points, each
    pair of them in a task, by products of matrices.  Vectors that are null, or hold what is null or not finite, take
    no part, and only those of equal length meet.
    """
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    known = [*same, *other]
    asked = queries.filter(whole).select(F.col(ident).alias("__q"), F.col(vector).alias("__v"), F.size(vector).alias("__size"), *[F.col(c).alias(f"__q_{c}") for c in known])
    own = points.filter(whole).select(F.col(ident).alias("__p"), F.col(vector).alias("__w"), F.size(vector).alias("__size"), *[F.col(c).alias(f"__p_{c}") for c in known])
    asked, own = (df.filter(F.col(c).isNotNull()) for df, c in ((asked, "__q"), (own, "__p")))
    n_points, n_queries = own.count(), asked.count()
    # As few copies of rows as give so many pairs of blocks.
    n = max(math.ceil(n_points / POINTS), min(math.ceil(math.sqrt(FEWEST * n_points / max(n_queries, 1))), FEWEST, math.ceil(n_points / 1024)), 1)
    m = max(math.ceil(n_queries / QUERIES), min(math.ceil(FEWEST / n), math.ceil(n_queries / 1024)), 1)
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    asked = asked.withColumn("__b", F.pmod(F.xxhash64("__q"), F.lit(m)).cast("int")).withColumn("__a", every(n))
    own = own.withColumn("__a", F.pmod(F.xxhash64("__p"), F.lit(n)).cast("int")).withColumn("__b", every(m))
    by = ("__a", "__b", "__size")
    kind = f"__q {asked.schema['__q'].dataType.simpleString()}, __p {own.schema['__p'].dataType.simpleString()}, distance double"
    return asked.groupBy(*by).cogroup(own.groupBy(*by)).applyInArrow(_nearest(k, same, other), kind)


def neighbours(queries: DataFrame, points: DataFrame, ident: str, vector: str, k: int, within: Sequence[str] = ()) -> DataFrame:
    """(ident, rank, neighbour, distance): the ``k`` nearest points of the same ``within`` to each query, ties to
    the smaller neighbour; vectors that are null take no part."""
    pairs = _near(queries, points, ident, vector, k, within, ())
    w = Window.partitionBy("__q").orderBy("distance", "__p")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("__q").alias(ident), "rank", F.col("__p").alias("neighbour"), "distance")


def uniqueness(queries: DataFrame, points: DataFrame, ident: str, entity: str, vector: str) -> DataFrame:
    """Distance to the nearest point of another entity; queries that no other entity faces give no row."""
    pairs = _near(queries, points, ident, vector, 1, (), (entity,))
    return pairs.groupBy(F.col("__q").alias(ident)).agg(F.min("distance").alias("uniqueness"))
