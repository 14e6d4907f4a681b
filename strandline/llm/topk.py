"""Exact top-k inner-product search with ball trees, branch and bound, and a shared k-th score.

Queries come in blocks of bounded size that are broadcast one after another;
the other side is never collected.  Each task cuts its rows into shards, builds
a ball tree over each, and carries the queries' current k-th scores from shard
to shard; a first search in a small part of the rows gives all tasks a score to
start from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import checkpoint

#: Rows of a shard, points of a leaf, queries of a block, and about how many rows the first search sees.
SHARD, LEAF, BLOCK, SEED_ROWS = 8192, 64, 16_384, 4096
_LOW = np.iinfo(np.int64).min + 1


class BallTree:
    """Leaves of at most ``LEAF`` points; every node has a centre, a radius and its least id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.leaves: list[tuple[np.ndarray, np.ndarray]] = []
        centres, radii, self.parent, self.leaf_node, least = [], [], [], [], []
        real = points.astype(np.float64)
        todo = [(np.arange(len(ids)), -1)]
        while todo:
            of, up = todo.pop()
            part = real[of]
            centre = part.mean(0)
            away = np.sqrt(((part - centre) ** 2).sum(1))
            node = len(centres)
            centres.append(centre)
            radii.append(away.max())
            least.append(ids[of].min())
            self.parent.append(up)
            if len(of) <= LEAF or radii[-1] == 0:
                for low in range(0, len(of), SHARD):
                    self.leaves.append((ids[of[low : low + SHARD]], points[of[low : low + SHARD]]))
                    self.leaf_node.append(node)
                continue
            # cut at the median along the line from the farthest point to the one farthest from it
            one = part[away.argmax()]
            two = part[((part - one) ** 2).sum(1).argmax()]
            order = np.argsort(part @ (two - one), kind="stable")
            middle = len(of) // 2
            todo += [(of[order[:middle]], node), (of[order[middle:]], node)]
        self.centres, self.radii, self.least = np.array(centres), np.array(radii), np.array(least)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with the points of each leaf: the least over the leaf and the nodes above it."""
        real = queries.astype(np.float64)
        norm = np.sqrt((real * real).sum(1))
        bound = real @ self.centres.T + norm[:, None] * self.radii
        bound += 1e-9 * (np.abs(real) @ np.abs(self.centres).T + norm[:, None] * self.radii) + 1e-6  # rounding
        for node, up in enumerate(self.parent):
            if up >= 0:
                np.minimum(bound[:, node], bound[:, up], out=bound[:, node])
        return bound[:, self.leaf_node]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows; beyond 64 bits they stop at the ends of the range, as ``top_k`` says."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.array([[max(min(x, 2**63 - 1), _LOW + 1) for x in row] for row in wide], dtype=np.int64).reshape(len(a), len(b))


class Best:
    """The k best (score, id) of each query so far: higher scores first, smaller ids among equals."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
        self.query_ids, self.queries, self.k, self.floor = query_ids, queries, k, floor
        self.scores = np.full((len(queries), k), _LOW, dtype=np.int64)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max, dtype=np.int64)

    def kth(self) -> np.ndarray:
        """Scores that a row must reach: the k-th so far, or the one known from elsewhere."""
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        score = _products(self.queries[rows], points)
        own = ids[None, :] == self.query_ids[rows][:, None]
        kth, last = self.scores[rows, -1][:, None], self.ids[rows, -1][:, None]
        better = ((score > kth) | ((score == kth) & (ids[None, :] < last))) & (score >= self.floor[rows][:, None]) & ~own
        hit = better.any(1)
        rows, score, better = rows[hit], score[hit], better[hit]
        if not len(rows):
            return
        score = np.where(better, score, _LOW)
        names = np.where(better, ids[None, :], np.iinfo(np.int64).max)
        score, names = np.concatenate([self.scores[rows], score], axis=1), np.concatenate([self.ids[rows], names], axis=1)
        order = np.lexsort((names, -score), axis=-1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)

    def search(self, tree: BallTree) -> None:
        """Each query meets the leaves by falling bound, and stops at a leaf that can hold nothing better."""
        bound = tree.bounds(self.queries)
        order = np.argsort(-bound, axis=1, kind="stable")
        least = tree.least[tree.leaf_node]
        alive = np.arange(len(self.queries))
        for turn in range(order.shape[1]):
            leaf = order[alive, turn]
            limit, kth = bound[alive, leaf], self.kth()[alive]
            alive = alive[limit >= kth]
            if not len(alive):
                return
            leaf = order[alive, turn]
            # a leaf of equal scores only helps with an id smaller than the last one kept
            useful = (bound[alive, leaf] >= self.scores[alive, -1] + 1) | (least[leaf] < self.ids[alive, -1])
            rows, leaf = alive[useful], leaf[useful]
            by = np.argsort(leaf, kind="stable")
            rows, leaf = rows[by], leaf[by]
            cuts = np.nonzero(np.diff(leaf))[0] + 1
            for part, own in zip(np.split(rows, cuts), np.split(leaf, cuts), strict=True):
                if len(part):
                    self.add(part, *tree.leaves[own[0]])

    def found(self) -> pd.DataFrame:
        row, place = np.nonzero(self.ids != np.iinfo(np.int64).max)
        return pd.DataFrame({"query_id": self.query_ids[row], "vec_id": self.ids[row, place], "score": self.scores[row, place]})


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of vectors, shorter ones filled with zeros."""
    out = np.zeros((len(column), width), dtype=np.int64)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _scan(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], floor: np.ndarray, k: int, width: int) -> DataFrame:
    """The best k of each task's rows for each query of a block, without those below the query's floor."""
    sent = rows.sparkSession.sparkContext.broadcast((*queries, floor))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, points, floors = sent.value
        best, held = Best(ids, points, k, floors), []

        def flush() -> None:
            if held:
                whole = pd.concat(held, ignore_index=True)
                for low in range(0, len(whole), SHARD):
                    part = whole.iloc[low : low + SHARD]
                    best.search(BallTree(part["vec_id"].to_numpy(np.int64), _matrix(part["v"], width)))
                held.clear()

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= SHARD:
                flush()
        flush()
        yield best.found()

    return rows.mapInPandas(run, "query_id bigint, vec_id bigint, score bigint")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def grid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v array<bigint>)``: floor(64 * x) of each component, x as double; rows with a null id, a null vector, or a null or non-finite component are left out.

    A component whose floor is beyond 64 bits becomes the nearest 64-bit number.
    Empty vectors, repeated rows and ids stay; an empty table gives no rows.
    """
    rows = table.select(table[id_col].cast("bigint").alias("vec_id"), table[vector_col].cast("array<double>").alias("x"))
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & usable).select("vec_id", F.transform("x", lambda x: F.floor(x * 64).cast("bigint")).alias("v"))


def top_k(rows: DataFrame, is_query, k: int = 20, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows with the largest inner product for each row of ``(vec_id, v)`` that ``is_query`` picks.

    Exact, ties go to the smaller id, and a query meets every row but those of
    its own id.  Vectors of unequal length are filled with zeros; if several
    rows share a query's id, the least vector asks, and rows that share a
    candidate's id are answers each.  A score stops at 2 - 2**63 and
    2**63 - 1, and scores at the same end tie; that needs components of over
    2**31 or so.  A query without other rows has no
    answer, and an empty table none.  Queries go in blocks of about ``block`` by
    a hash of their id, each collected, broadcast and searched with one pass over
    the rows; a pass builds its trees again, which takes a small part of the time
    that a full block takes to search them.
    """
    picked = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_distinct(F.when(is_query, F.col("vec_id"))).alias("queries")).first()
    blocks = max(1, -(-(size["queries"] or 0) // block))
    width = max(size["width"] or 0, 1)
    seeds = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, size["n"] // SEED_ROWS))) == 0)
    out = None
    for b in range(blocks):
        part = picked.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)) == b).toPandas()
        queries = (part["vec_id"].to_numpy(np.int64), _matrix(part["v"], width))
        floor = np.full(len(part), _LOW, dtype=np.int64)
        known = _top(_scan(seeds, queries, floor, k, width), k).filter(F.col("rank") == k).select("query_id", "score").toPandas()
        place = {q: i for i, q in enumerate(queries[0])}
        for q, s in zip(known["query_id"], known["score"], strict=True):
            floor[place[q]] = s
        found = _top(_scan(rows, queries, floor, k, width), k)
        found = found if blocks == 1 else checkpoint(found)
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", "rank", "vec_id", "score")
