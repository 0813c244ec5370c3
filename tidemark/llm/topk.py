"""Exact top-k by inner product: queries and data, both in cover trees, are searched together.

Vectors are dealt to cells around a bounded set of pivots, as many cells as give them a good size, and a cell's
rows to blocks of a bounded size.  Pairs of cells are searched in rounds, for each query cell the pairs with the
largest possible score first; after each round a query's floor is its kth score so far, and a pair of cells is
left out if none of its vectors can reach the floors of its queries.  So later rounds give back only rows that
beat what is known.  Each pair of blocks is one group: there a cover tree over the queries and one over the data
are walked together, and a pair of nodes is pruned when the inner product of the centres plus what the covering
radii can add is below the worst floor or kth score of the queries in that node.
Of equal vectors only the k+1 smallest ids can be among any query's first k, so only these are searched.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize

#: Bounds: vectors in the sample that gives pivots and first scores, pivots, rows in a block, points in a leaf.
SAMPLE, PIVOTS, QUERY_BLOCK, DATA_BLOCK, LEAF = 2048, 64, 1024, 4096, 48
#: Pairs that a query cell is given in each round but the last, which has all that are left.
ROUNDS = (2, 8)
#: Scores that don't fit a long count as its ends.
LOWEST, HIGHEST = -(2**63), 2**63 - 1


class CoverTree:
    """Nodes of (centre, radius, children, members): a child's centre is within 2**(level-1) of the points it
    covers, and centres of siblings are further apart than that.  A node whose points fall apart into nearly
    as many children is a leaf."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple[int, float, list[int], np.ndarray]] = []
        distance = np.linalg.norm(points - points[0], axis=1)
        reach = float(distance.max())
        self.root = self._node(np.arange(len(points)), distance, int(np.ceil(np.log2(reach))) if reach else 0)

    def _node(self, members: np.ndarray, distance: np.ndarray, level: int) -> int:
        centre, radius = int(members[0]), float(distance.max())
        children: list[int] = []
        while len(members) > LEAF and radius > 0:
            level = min(level - 1, int(np.ceil(np.log2(radius))) - 1)
            groups, rest, own = [], members, distance
            while len(rest) and len(groups) <= len(members) // 4:
                near = own <= 2.0**level
                groups.append((rest[near], own[near]))
                rest = rest[~near]
                if len(rest):
                    own = np.linalg.norm(self.points[rest] - self.points[rest[0]], axis=1)
            if len(rest):
                break  # the points fall apart
            if len(groups) > 1:
                children = [self._node(m, d, level) for m, d in groups]
                break
        self.nodes.append((centre, radius, children, members))
        return len(self.nodes) - 1


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's best k rows here, without the query's own; ``floors``: scores
    that k rows are known to reach."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(data.astype(float)).max(initial=0)) * queries.shape[1]
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    # Beyond 2**53 a score as a double may be a little more than it is.
    under = 0.0 if kind is np.float64 else 1e-12
    ours, theirs = queries.astype(kind), data.astype(kind)
    qt, dt = CoverTree(queries.astype(float)), CoverTree(data.astype(float))
    qn, dn = np.linalg.norm(qt.points, axis=1), np.linalg.norm(dt.points, axis=1)
    worst = floors.astype(float) - under * np.where(np.isfinite(floors), np.abs(floors), 0)
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]  # heaps of (score, -id)

    def bound(a: int, b: int) -> float:
        (qc, qr, *_), (dc, dr, *_) = qt.nodes[a], dt.nodes[b]
        top = float(qt.points[qc] @ dt.points[dc]) + qn[qc] * dr + dn[dc] * qr + qr * dr
        return top + 1e-9 * (abs(top) + 1)

    stack = [(bound(qt.root, dt.root), qt.root, dt.root)]
    while stack:
        top, a, b = stack.pop()
        members = qt.nodes[a][3]
        if top < worst[members].min():
            continue
        below_a, below_b = qt.nodes[a][2], dt.nodes[b][2]
        if below_a and (not below_b or qt.nodes[a][1] >= dt.nodes[b][1]):
            pairs = [(bound(c, b), c, b) for c in below_a]
        elif below_b:
            pairs = [(bound(a, c), a, c) for c in below_b]
        else:
            others = dt.nodes[b][3]
            scores = ours[members] @ theirs[others].T
            for row in np.flatnonzero((scores >= worst[members, None]).any(axis=1)):
                q = int(members[row])
                heap = best[q]
                for j in np.flatnonzero(scores[row] >= worst[q]):
                    if data_ids[others[j]] == query_ids[q]:
                        continue
                    item = (min(max(int(scores[row, j]), LOWEST), HIGHEST), -int(data_ids[others[j]]))
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                if len(heap) == k:
                    worst[q] = max(worst[q], heap[0][0] - under * abs(heap[0][0]))
            continue
        stack.extend(sorted(pairs))
    return [(int(query_ids[q]), -i, s) for q, heap in enumerate(best) for s, i in heap]


def quantised(table: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(vec_id, v): the rows whose vectors are whole, with components floor(scale * x)."""
    x = F.col(vector_column)
    whole = F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    return table.filter(whole).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the ``k`` best others.

    Ties go to the smaller id.  Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows without id; vectors of other lengths than the query's are no candidates of it.  Rows
    that share an id are one candidate, with its best score.  Components beyond a long count as its ends, and so
    do scores.  Other columns don't matter.  No queries, no rows.
    """
    spark = table.sparkSession
    rows = quantised(table, id_column, vector_column, scale)
    sample = [(r["vec_id"], r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(v) for _, v in sample}:
        own = [(i, v) for i, v in sample if len(v) == size]
        by_size[size] = np.array([i for i, _ in own]), np.array([v for _, v in own], np.float64)

    def cells(n: int):
        """Each vector's nearest of the first ``n`` pivots and the distance to it."""

        def nearest(v: pd.Series) -> pd.DataFrame:
            out = np.zeros((len(v), 2))
            sizes = v.map(len).to_numpy()
            for size in set(sizes.tolist()) & by_size.keys():
                at = np.flatnonzero(sizes == size)
                points, pivots = np.array([v.iloc[i] for i in at], np.float64), by_size[size][1][:n]
                square = (points**2).sum(1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(1)
                out[at, 0] = square.argmin(1)
                out[at, 1] = np.linalg.norm(points - pivots[square.argmin(1)], axis=1)
            return pd.DataFrame({"cell": out[:, 0].astype(int), "away": out[:, 1]})

        return F.pandas_udf(nearest, "cell int, away double")

    def floors(ids: pd.Series, v: pd.Series) -> pd.Series:
        out = np.full(len(v), -np.inf)
        for size, (known, points) in by_size.items():
            at = [i for i, x in enumerate(v) if len(x) == size]
            if not at:
                continue
            scores = np.array([v.iloc[i] for i in at], np.float64) @ points.T
            scores[ids.to_numpy()[at][:, None] == known[None, :]] = -np.inf
            if scores.shape[1] > k and len(set(known.tolist())) == len(known):
                out[at] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        return pd.Series(out)

    floor_of = F.pandas_udf(floors, "double")
    rows = rows.withColumn("dim", F.size("v"))
    same = Window.partitionBy("v").orderBy("vec_id")
    distinct = materialize(rows.withColumn("n", F.dense_rank().over(same)).filter(F.col("n") <= k + 1).drop("n"), "distinct-vectors")
    asked = rows.filter(F.col("vec_id") % every == 0)
    wanted = lambda df, block: min(PIVOTS, max(1, -(-df.count() // block)))
    placed = lambda df, n: df.withColumn("c", cells(n)("v")).select("vec_id", "v", "dim", "c.cell", "c.away")
    data = materialize(placed(distinct, wanted(distinct, DATA_BLOCK)), "candidates")
    queries = materialize(placed(asked, wanted(asked, QUERY_BLOCK)).withColumn("floor", floor_of("vec_id", "v")), "queries")
    # At most PIVOTS rows for each vector length.
    in_data = data.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            found = dual_tree(np.array(left["v"].tolist(), np.int64), left["vec_id"].to_numpy(), left["floor"].to_numpy(), np.array(right["v"].tolist(), np.int64), right["vec_id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def among(pairs: list[tuple]) -> DataFrame:
        """What the groups of some pairs of cells find."""
        met = F.broadcast(spark.createDataFrame(pairs, "dim int, qcell int, qblocks int, dcell int, dblocks int"))
        block = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
        q = queries.withColumnRenamed("cell", "qcell").join(met, ["dim", "qcell"]).withColumn("qb", block(F.col("qblocks"))).withColumn("db", F.explode(F.sequence(F.lit(0), F.col("dblocks") - 1)))
        d = data.withColumnRenamed("cell", "dcell").join(met, ["dim", "dcell"]).withColumn("db", block(F.col("dblocks"))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)))
        keys = ["dim", "qcell", "dcell", "qb", "db"]
        return q.select(*keys, "vec_id", "v", "floor").groupBy(*keys).cogroup(d.select(*keys, "vec_id", "v").groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    seen: set[tuple] = set()
    for most in (*ROUNDS, None):
        in_queries = queries.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.min("floor").alias("f")).collect()
        pairs = []
        for q in in_queries:
            able = sorted(((_highest(q, d, by_size), d) for d in in_data if d["dim"] == q["dim"] and (q["dim"], q["cell"], d["cell"]) not in seen), key=lambda x: -x[0])
            pairs += [(q["dim"], q["cell"], -(-q["n"] // QUERY_BLOCK), d["cell"], -(-d["n"] // DATA_BLOCK)) for top, d in able[:most] if top >= q["f"]]
        if not pairs:
            continue
        seen |= {(dim, qcell, dcell) for dim, qcell, _, dcell, _ in pairs}
        both = kept.drop("rank").unionByName(among(pairs)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        kept = materialize(both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "best-so-far")
        if most is not None:
            kth = kept.filter(F.col("rank") == k).select(F.col("query_id").alias("known"), F.col("score").cast("double").alias("kth"))
            raised = queries.join(kth, F.col("vec_id") == F.col("known"), "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", F.lit(float("-inf")))))
            queries = materialize(raised.select("vec_id", "v", "dim", "cell", "away", "floor"), "queries")
    return kept.select("query_id", "rank", "vec_id", "score")


def _highest(q: Row, d: Row, pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> float:
    """What no pair of vectors of a query cell and a data cell can score above."""
    if q["dim"] not in pivots:
        return float("inf")
    a, b = pivots[q["dim"]][1][q["cell"]], pivots[q["dim"]][1][d["cell"]]
    top = float(a @ b + np.linalg.norm(a) * d["r"] + np.linalg.norm(b) * q["r"] + q["r"] * d["r"])
    return top + 1e-9 * (abs(top) + 1)
