"""Exact top-k by inner product over sorted lists, without random access.

Candidates are dealt into slabs by id hash; in a slab every dimension is one list sorted by value. For a block of queries the
lists are read in runs of growing depth, from the top where the query's component is positive and from the bottom where it
is negative. What was read gives each candidate a lower bound (unread components at the far end of their list) and an
upper bound (unread components at the list's frontier). Once the frontier itself, which bounds every candidate not yet
met, is below the k-th best lower bound, reading ends; scores of the candidates whose upper bound is not below it are
then resolved. The k-th bound is carried from slab to slab within a task, and slab results meet in one top-k per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewise as bw
from .tables import stored

#: Queries and candidates of one task; candidates are read in slabs of SLAB, for blocks of BLOCK queries.
QUERY_TILE, CANDIDATE_TILE, SLAB, BLOCK = 2048, 32768, 4096, 128


class _Lists:
    """The sorted lists of one slab of candidates, one per dimension."""

    def __init__(self, c: np.ndarray, rows: np.ndarray):
        self.c, self.rows = c, rows
        self.order = np.argsort(c, axis=0, kind="stable")
        self.ranked = np.take_along_axis(c, self.order, axis=0)

    def search(self, q: np.ndarray, own_rows: np.ndarray, k: int, bound: np.ndarray):
        """(query, candidate, score) of all that may be among the k best, given and raising the bounds of earlier slabs."""
        c, order, ranked = self.c, self.order, self.ranked
        n, dims = c.shape
        low, high = ranked[0], ranked[-1]
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        own = own_rows[:, None] == self.rows[None, :]
        active = np.arange(len(q))
        # what a candidate's read components add to the least that its unread ones can be, and where these stand
        lower = np.repeat((plus @ low + minus @ high)[:, None], n, axis=1)
        lower[own] = -np.inf
        unread_top, unread_bottom = np.ones((n, dims)), np.ones((n, dims))
        hits, read, depth = [], 0, max(1, n // 16)
        while len(active):
            until = min(n, read + depth)
            column = np.arange(dims)[None, :]
            down, up = order[n - until : n - read], order[read:until]
            step = np.zeros((n, dims))
            step[down, column] = ranked[n - until : n - read] - low
            lower += plus[active] @ step.T
            step[:] = 0
            step[up, column] = ranked[read:until] - high
            lower += minus[active] @ step.T
            unread_top[down, column] = 0
            unread_bottom[up, column] = 0
            read = until
            front_top, front_bottom = ranked[n - read], ranked[read - 1]
            if n > k:
                bound[active] = np.maximum(bound[active], np.partition(lower, n - k, axis=1)[:, n - k])
            # the frontier bounds every candidate of which nothing was read
            outside = plus[active] @ front_top + minus[active] @ front_bottom
            done = (outside < bound[active]) | (read == n)
            rows = np.flatnonzero(done)
            if len(rows):
                # an unread component is at most at the frontier, that is so much above the far end
                most = (plus[active[rows]] * (front_top - low)) @ unread_top.T
                most += (minus[active[rows]] * (front_bottom - high)) @ unread_bottom.T
                most += lower[rows]
                i, j = np.nonzero((most >= bound[active[rows]][:, None]) & ~own[active[rows]])
                hits.append((active[rows[i]], j, np.einsum("ij,ij->i", q[active[rows[i]]], c[j])))
                active, lower = active[~done], lower[~done]
            depth *= 2
        return [np.concatenate(x) for x in zip(*hits, strict=True)]


def _tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of the tile for each query row."""
    q, c = np.stack(queries["v"].to_numpy()), np.stack(candidates["v"].to_numpy())
    q_ids, q_rows, ids, rows = (x.to_numpy() for x in (queries["id"], queries["row"], candidates["id"], candidates["row"]))
    bound, best = np.full(len(q), -np.inf), pd.DataFrame({"at": [], "vec_id": [], "score": []})
    for i in range(0, len(c), SLAB):
        lists, parts = _Lists(c[i : i + SLAB], rows[i : i + SLAB]), [best]
        for j in range(0, len(q), BLOCK):
            at, col, score = lists.search(q[j : j + BLOCK], q_rows[j : j + BLOCK], k, bound[j : j + BLOCK])
            parts.append(pd.DataFrame({"at": j + at, "vec_id": ids[i + col], "score": score}))
        best = pd.concat(parts).sort_values(["at", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        best = best.groupby("at", sort=False).head(k)
        full = best.groupby("at")["score"].agg(["min", "size"])
        full = full[full["size"] == k]["min"]
        bound = np.maximum(bound, full.reindex(np.arange(len(q))).fillna(-np.inf).to_numpy())
    at = best["at"].to_numpy().astype(np.int64)
    out = pd.DataFrame({"query_id": q_ids[at], "query_row": q_rows[at], "vec_id": best["vec_id"].to_numpy(), "score": best["score"].to_numpy()}).astype("int64")
    bw.release()
    return out


def quantised(vector, scale: int = 256):
    """floor(scale * x) of every component as double; null for a vector that is null or holds a null, NaN or infinite one."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")))


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest inner product, ties to the smaller id.

    Components must be whole numbers (below 2**20, so that sums are exact). Rows with null id or a null or empty vector
    take no part; a query meets vectors of its own length. Rows count one by one, also with equal ids: a query's own row
    is no candidate of its, another row of its id is. Queries with fewer than k candidates return all; an empty table
    gives no rows, further columns of ``vectors`` are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("is_query"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).filter("id is not null and v is not null and size(v) > 0")
    rows = stored(rows.withColumn("s", F.size("v")), "topk-vectors")  # so that row numbers stay
    total = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    empty = "query_id long, query_row long, vec_id long, score long"
    q_tiles, c_tiles = max(1, -(-total.q // QUERY_TILE)), max(1, -(-total.n // CANDIDATE_TILE))
    tile = lambda n, salt: F.pmod(F.xxhash64("id", "row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = rows.filter("is_query").select("id", "row", "v", "s", tile(q_tiles, 1).alias("qt"), every(c_tiles).alias("ct"))
    c = rows.select("id", "row", "v", "s", tile(c_tiles, 2).alias("ct"), every(q_tiles).alias("qt"))

    def best(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}).astype("int64")
        return _tile(queries, candidates, k)

    found = q.groupBy("s", "qt", "ct").cogroup(c.groupBy("s", "qt", "ct")).applyInPandas(best, empty)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
