"""Nearest neighbours by cosine: a vantage-point tree per shard, pruned by the triangle inequality.

Vectors are scaled to length one, where Euclidean distance orders as cosine does and is a metric.  Shards are dealt by
hash of the row and hold about ``shard_rows`` rows each; every shard's tree is built once and written to the shared
folder.  Trees stay where they are read and queries travel: they go out in waves of at most ``wave_bytes``, each
broadcast to all tasks.  A task keeps the k nearest of the wave over all trees it reads, so what one tree found prunes
the next, and k rows a query leave it.  A block of queries walks a tree together: at each node the queries take their
near side first, then those whose ball reaches across the median sphere take the other.  The ball's radius is divided
by ``factor``: 1 prunes only what cannot hold a nearer row and so is exact, larger factors prune more.

Equal vectors of a shard are stored once with their k + 1 smallest ids, as no other of them can be among the k
nearest when ties go to the smaller id (an id counts once there, as its repeated rows meet in one shard); so a vector that many rows share costs no more than one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Folders

LEAF = 64
SLACK = 1e-9


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, every row summed in the same order."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def build(ids: np.ndarray, vectors: np.ndarray, k: int) -> dict:
    """ids and vectors of a shard, in tree order, with the nodes (start, end, radius, inner, outer), children after their parent."""
    order = np.lexsort([ids, *vectors.T[::-1]])
    ids, vectors = ids[order], vectors[order]
    once = np.ones(len(ids), bool)
    once[1:] = (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
    ids, vectors = ids[once], vectors[once]
    new = np.ones(len(ids), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    nth = np.arange(len(ids)) - np.flatnonzero(new)[group]
    keep = nth <= k
    first = vectors[new]
    unit = first / np.sqrt((first * first).sum(axis=1))[:, None]
    members = np.full((len(first), k + 1), -1, np.int64)
    held = np.zeros((len(first), k + 1), bool)
    members[group[keep], nth[keep]], held[group[keep], nth[keep]] = ids[keep], True
    place = np.arange(len(first))
    nodes: list[list] = []
    stack = [(0, len(first), -1, 0)]
    rng = np.random.default_rng(0)
    while stack:
        a, b, parent, side = stack.pop()
        if parent >= 0:
            nodes[parent][3 + side] = len(nodes)
        node = [a, b, -1.0, -1, -1]
        nodes.append(node)
        if b - a > LEAF:
            # The row in front is the vantage point, the rest is split at the median distance to it.
            v = a + int(rng.integers(b - a))
            place[[a, v]] = place[[v, a]]
            d = np.sqrt(np.maximum(0, 2 - 2 * unit[place[a + 1 : b]] @ unit[place[a]]))
            near = np.argsort(d, kind="stable")
            place[a + 1 : b] = place[a + 1 : b][near]
            half = (b - a - 1) // 2
            node[2] = float(d[near[half]])
            stack.append((a + 1 + half, b, len(nodes) - 1, 1))
            stack.append((a + 1, a + 1 + half, len(nodes) - 1, 0))
    return {"raw": first[place], "unit": unit[place], "ids": members[place], "held": held[place], "nodes": nodes}


class Search:
    """The k nearest of a block of queries among the shards it is shown."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.qid, self.raw, self.k, self.factor = query_ids, queries, k, factor
        self.unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1, np.int64)
        self.compared = 0

    def take(self, tree: dict, active: np.ndarray, a: int, b: int) -> None:
        """Compare the active queries with the rows a to b of the tree."""
        if not len(active) or a >= b:
            return
        self.compared += len(active) * (b - a)
        near = self.unit[active] @ tree["unit"][a:b].T
        rows, cols = np.nonzero(near >= self.score[active, -1][:, None] - SLACK)
        for i in range(0, len(rows), 50_000):
            self.merge(active, rows[i : i + 50_000], cols[i : i + 50_000] + a, tree)

    def merge(self, active: np.ndarray, rows: np.ndarray, cols: np.ndarray, tree: dict) -> None:
        q = active[rows]
        score = exact_cosine(self.raw[q], tree["raw"][cols])
        k1 = tree["ids"].shape[1]
        q, score, ids = np.repeat(q, k1), np.repeat(score, k1), tree["ids"][cols].ravel()
        ok = tree["held"][cols].ravel() & (ids != self.qid[q])
        touched = np.unique(q[ok])
        old = self.score[touched] > -np.inf
        q = np.concatenate([q[ok], np.repeat(touched, self.k)[old.ravel()]])
        score = np.concatenate([score[ok], self.score[touched][old]])
        ids = np.concatenate([ids[ok], self.found[touched][old]])
        order = np.lexsort([ids, -score, q])
        q, score, ids = q[order], score[order], ids[order]
        start = np.searchsorted(q, q)
        nth = np.arange(len(q)) - start
        best = nth < self.k
        self.score[touched], self.found[touched] = -np.inf, -1
        self.score[q[best], nth[best]], self.found[q[best], nth[best]] = score[best], ids[best]

    def walk(self, tree: dict) -> None:
        self.visit(tree, 0, np.arange(len(self.qid)))

    def visit(self, tree: dict, node: int, active: np.ndarray) -> None:
        a, b, radius, inner, outer = tree["nodes"][node]
        if not len(active):
            return
        if inner < 0:
            self.take(tree, active, a, b)
            return
        self.take(tree, active, a, a + 1)
        d = np.sqrt(np.maximum(0, 2 - 2 * self.unit[active] @ tree["unit"][a]))
        first = d < radius
        self.visit(tree, inner, active[first])
        self.visit(tree, outer, active[~first])
        # Distance that still could hold a row as near as the last one found.
        reach = np.sqrt(np.maximum(0, 2 - 2 * np.minimum(1, self.score[active, -1] - SLACK))) / self.factor + SLACK
        reach[self.score[active, -1] == -np.inf] = np.inf
        self.visit(tree, outer, active[first & (d + reach >= radius)])
        self.visit(tree, inner, active[~first & (d - reach <= radius)])


def usable(vector: Column) -> Column:
    """Not null, all components finite, and a squared length in double precision that is neither zero nor infinite."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < big), F.lit(False)))
    square = F.aggregate(vector, F.lit(0.0), lambda n, x: n + x * x)
    return F.coalesce(fine & (square > 0) & (square < big), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 1.0, shard_rows: int = 4096, block_rows: int = 512, wave_bytes: int = 32 << 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row with is_query, among all rows but itself.

    Vectors that are null, zero, hold null or non-finite components, or whose squared length overflows or vanishes in
    double precision take no part; vectors of different lengths are not compared; rows with a null id take no part.  Of
    rows with the same id and vector one counts; a query is never its own answer, nor is another row with its id.  Ties
    go to the smaller id.  With fewer than k others, all are returned.  An empty table gives an empty result.  Columns
    but the two named are not read, so they may have any name.
    """
    spark, made = vectors.sparkSession, Folders(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    rows = rows.where(F.col("_id").isNotNull() & usable(F.col("_v"))).withColumn("_dim", F.size("_v"))
    n, n_queries, query_bytes = rows.agg(F.count(F.lit(1)), F.count_if("_q"), F.coalesce(F.sum(F.when(F.col("_q"), 8 * F.col("_dim") + 8)), F.lit(0))).first()
    shards, waves = max(1, -(-n // shard_rows)), max(1, -(-query_bytes // wave_bytes))

    def index(pdf_key, pdf):
        import pandas as pd

        tree = build(pdf["_id"].to_numpy(np.int64), np.stack(pdf["_v"].to_numpy()), k)
        return pd.DataFrame({"_dim": [pdf_key[0]], "_tree": [pickle.dumps(tree)]})

    # Repeats are combined before the exchange, so a row repeated very often is one row of its shard.
    dealt = rows.select("_dim", "_id", "_v").distinct().withColumn("_shard", F.pmod(F.xxhash64("_id", "_v"), F.lit(shards)))
    trees = made.materialise(dealt.groupBy("_dim", "_shard").applyInPandas(index, "_dim int, _tree binary"), "vp-trees")
    asked = made.materialise(rows.where("_q").select("_dim", "_id", "_v").distinct().withColumn("_wave", F.pmod(F.xxhash64("_id", "_v", F.lit(1)), F.lit(waves))), "vp-queries")

    def wave(number: int) -> DataFrame:
        queries = asked.where(F.col("_wave") == number).toPandas()
        sent = spark.sparkContext.broadcast({int(d): (p["_id"].to_numpy(np.int64), np.stack(p["_v"].to_numpy())) for d, p in queries.groupby("_dim")})

        def search(batches: Iterator) -> Iterator:
            import pandas as pd

            state: dict[int, list[Search]] = {}
            for pdf in batches:
                for dim, raw in zip(pdf["_dim"], pdf["_tree"]):
                    if dim not in sent.value:
                        continue
                    ids, matrix = sent.value[dim]
                    if dim not in state:
                        state[dim] = [Search(ids[i : i + block_rows], matrix[i : i + block_rows], k, factor) for i in range(0, len(ids), block_rows)]
                    tree = pickle.loads(raw)
                    for s in state[dim]:
                        s.walk(tree)
            for s in (s for block in state.values() for s in block):
                hit = s.score > -np.inf
                yield pd.DataFrame({"query_id": s.qid[np.nonzero(hit)[0]], "vec_id": s.found[hit], "score": s.score[hit]})

        found = trees.select("_dim", "_tree").mapInPandas(search, "query_id long, vec_id long, score double")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return made.materialise(found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "vp-found")

    # The stated query set against all rows, in blocks.  An id with several vectors may be in several waves.
    parts = [wave(i) for i in range(waves)]
    out = parts[0]
    if waves > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        out = out.withColumn("rank", best).where(F.col("rank") <= k)
    made.drop(trees, asked)
    return out


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) /
         (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(c.e, lambda x: x * x)))) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
