"""Exact top-k by inner product with Fagin's threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .words import release

#: Rows of a block: a 64th of all, not fewer than these, but with no more components than these. Queries of a chunk.
FEWEST_ROWS, MOST_NUMBERS = 8_192, 2**23
CHUNK_QUERIES = 512
FIRST_DEPTH = 16
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def usable(vector: str) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim): rows that take part, components floor(scale * x) as longs."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & usable("x"))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size("x").alias("dim"))


class SortedLists:
    """A block of vectors with one list of its rows for each dimension, in order of the component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], np.ascontiguousarray(vectors[order], np.int64)
        self.vectors = self.whole.astype(np.float64)
        self.most = float(np.abs(self.vectors).max(initial=0))
        self.lists = np.argsort(self.whole, axis=0, kind="stable")

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the ``k`` best rows by inner product, ``own`` excluded, ties to the smaller id.

        Every list is read in step from the end that helps the query more, a
        slab at a time, and what is met is scored in full. What no list has
        shown yet scores at most the sum of the lists' next components; once
        the k-th best score, or ``floor``, what other rows have reached
        already, is above that bound, the rest cannot matter (at the bound it
        could: a tie with a smaller id). Sums that doubles may not hold are
        taken in whole numbers of any size.
        """
        n = len(self.ids)
        use = np.nonzero(query)[0]
        if self.most * float(np.abs(query.astype(np.float64)).sum()) < EXACT:
            vectors, weight = self.vectors, query.astype(np.float64)
        else:
            vectors, weight = self.whole.astype(object), query.astype(object)
        up = query[use] < 0
        seen = self.ids == own
        best = np.empty(0, np.int64)
        scores = np.empty(0, weight.dtype)
        at, depth = 0, FIRST_DEPTH
        while at < n:
            row = np.where(up, self.lists[at, use], self.lists[n - 1 - at, use])
            bound = (vectors[row, use] * weight[use]).sum()
            if floor is not None and floor > bound or len(best) == k and scores[-1] > bound:
                break
            to = min(n, at + depth)
            if len(use):
                ends = np.where(up[None, :], self.lists[at:to, use], self.lists[n - to : n - at, use][::-1])
                met = np.zeros(n, bool)
                met[ends.ravel()] = True
                new = np.nonzero(met & ~seen)[0]
            else:  # all scores are zero
                to = n
                new = np.nonzero(~seen)[0]
            seen[new] = True
            best = np.concatenate([best, new])
            more = vectors[new] @ weight
            scores = np.concatenate([scores, more if more.dtype != object else np.asarray([min(max(x, LOWEST), HIGHEST) for x in more], object)])
            top = np.lexsort((best, -scores))[:k] if scores.dtype != object else np.asarray(sorted(range(len(best)), key=lambda i: (-scores[i], best[i]))[:k], np.int64)
            best, scores = best[top], scores[top]  # rows stand in order of id
            at, depth = to, 2 * depth
        return self.ids[best], [int(x) for x in scores]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, the ``k`` best other rows, exactly.

    Components become floor(``scale`` * x), x as double; scores are integer
    inner products; ties go to the smaller id. Candidates are dealt into blocks
    by hash and written once; a block's rows never move again, only chunks of
    queries do, to every block, where each runs the threshold algorithm over
    the block's sorted lists. A chunk first visits one block; the k-th score it
    finds there is a bound that lets it stop early, or at once, in all others.
    Blocks grow with the table up to 8 million components (131,072 rows of 64,
    10,922 of 768), as every block sees all queries. A query's best of all
    blocks are merged.

    Null ids, null vectors and vectors with null, NaN or infinite components
    take no part. Repeated rows are candidates each, and one query; rows of the
    query's id are its own and no candidates. Different vectors of one id are
    queries of their own. Vectors meet vectors of their length only; empty ones
    meet at score 0. Components and scores beyond 64 bits count as the nearest
    such number; all others are exact. Fewer than k candidates give fewer rows. Other columns are ignored.
    An empty table gives an empty result.
    """
    rows = quantised(vectors, scale, id_col, vector_col)
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).collect()}
    by_dim = lambda f: F.create_map(*[x for d, v in sizes.items() for x in (F.lit(d), F.lit(f(d, *v)))])[F.col("dim")] if sizes else F.lit(1)
    n_blocks = lambda d, n, q: max(1, -(-n // max(1, min(MOST_NUMBERS // max(d, 1), max(FEWEST_ROWS, n // 64)))))
    blocks = by_dim(n_blocks)
    tasks = min(16_384, sum(n_blocks(d, *v) for d, v in sizes.items()) or 1)  # a block is much work in few bytes: tasks are not merged by size
    chunks = by_dim(lambda _, n, q: -(-q // CHUNK_QUERIES) or 1)
    pool = materialise(rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), blocks).cast("int")).groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("m")).select("dim", "block", F.col("m.vec_id").alias("ids"), F.col("m.v").alias("vs")), "lists")
    asked = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), chunks).cast("int"))
    ask = asked.groupBy("dim", "chunk").agg(F.collect_list(F.struct("vec_id", "v")).alias("m")).select("dim", "chunk", F.col("m.vec_id").alias("own"), F.col("m.v").alias("q"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, lists = None, None
        for batch in batches:
            for dim, chunk, own, q, floors, block, ids, vs in batch.itertuples(index=False):
                if held != (dim, block):
                    held, lists = (dim, block), SortedLists(np.asarray(ids, np.int64), np.asarray([np.asarray(v, np.int64) for v in vs], np.int64).reshape(len(ids), dim))
                found, scores, least = [], [], []
                for j, (o, v) in enumerate(zip(own, q, strict=True)):
                    at, s = lists.search(int(o), np.asarray(v, np.int64), k, None if floors is None or floors[j] is None or np.isnan(floors[j]) else int(floors[j]))
                    found.append(at)
                    scores.append(s)
                    least.append(float(s[-1]) * (1 - 1e-15 * np.sign(s[-1])) - 1 if len(s) == k else None)
                yield pd.DataFrame({"dim": [dim], "chunk": [chunk], "own": [own], "q": [q], "floors": [least], "block": [block], "found": [found], "scores": [scores]})
        release()

    out = "dim int, chunk int, own array<long>, q array<array<long>>, floors array<double>, block int, found array<array<long>>, scores array<array<long>>"
    lists = ["ids", "vs"]
    home = ask.withColumns({"floors": F.lit(None).cast("array<double>"), "block": F.pmod(F.col("chunk"), blocks).cast("int")})
    first = materialise(home.join(pool, ["dim", "block"]).select("dim", "chunk", "own", "q", "floors", "block", *lists).mapInPandas(search, out), "first")
    other = first.select("dim", "chunk", "own", "q", "floors", F.col("block").alias("home"), F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block")).where("block <> home").drop("home")
    rest = other.repartition(tasks, "dim", "block").join(pool.repartition(tasks, "dim", "block"), ["dim", "block"]).select("dim", "chunk", "own", "q", "floors", "block", *lists).mapInPandas(search, out)
    each = first.unionByName(rest).select(F.explode(F.arrays_zip("own", "q", "found", "scores")).alias("e")).select(F.col("e.own").alias("query_id"), F.xxhash64("e.q").alias("q"), F.explode(F.arrays_zip("e.found", "e.scores")).alias("f")).select("query_id", "q", F.col("f.found").alias("vec_id"), F.col("f.scores").alias("score"))
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
