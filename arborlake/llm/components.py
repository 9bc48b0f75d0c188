"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise


def with_totals(rows: DataFrame, key: str, node: str, totals: dict[str, Callable[[str], Column]], salts: int = 256) -> DataFrame:
    """``rows`` with columns ``totals`` beside: each name's column aggregated over the rows of a ``key``.

    A key may have a third of all rows: they are dealt by a hash of ``node``
    into as many as ``salts`` parts, aggregated by part, then over the parts,
    and meet the totals by key and part. A part without rows has none. The
    aggregates must be ones that may be taken in two steps (min, max, sum).
    """
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(node), F.lit(salts)))
    partial = dealt.groupBy(key, "__part").agg(*[f(name).alias(name) for name, f in totals.items()])
    whole = partial.groupBy(key).agg(*[f(name).alias(name) for name, f in totals.items()], F.collect_list("__part").alias("__part"))
    return dealt.drop(*totals).join(whole.withColumn("__part", F.explode("__part")), [key, "__part"]).drop("__part")


#: Blocks of a group that one key of a join of block pairs holds on either side, on average.
STRIP = 16


def block_pairs(left: DataFrame, right: DataFrame, key: list[str], own: str, block: str, blocks: str) -> DataFrame:
    """All pairs of a left and a right row of a ``key``: blocks number ``own`` and ``block``, of as many as ``blocks`` says on either side.

    Blocks are dealt into strips of some STRIP by number, and a pair of strips
    is a key of its own, so the pairs of a group of n blocks are n^2 / STRIP^2
    keys and a row goes to n / STRIP of them.
    """
    strips = f"cast({blocks} div {STRIP} + 1 as int)"
    every = f"sequence(0, {strips} - 1)"
    one = left.withColumn("__own", F.expr(f"cast(pmod({own}, {strips}) as int)")).withColumn("__other", F.explode(F.expr(every))).drop(blocks)
    two = right.withColumn("__other", F.expr(f"cast(pmod({block}, {strips}) as int)")).withColumn("__own", F.explode(F.expr(every))).drop(blocks)
    return one.join(two, [*key, "__own", "__other"]).drop("__own", "__other")


def _star(edges: DataFrame) -> DataFrame:
    """Large-star: every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.select("a", "b", F.col("b").alias("m")).union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("a").alias("m")))
    return with_totals(both, "a", "b", {"m": F.min}).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Small-star: a node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.least("a", "b").alias("m"))
    moved = with_totals(down, "a", "b", {"m": F.min})
    return moved.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def thinned(links: np.ndarray) -> np.ndarray:
    """(n, 2) links -> ones that join the same components, each from a node to the least node of its component.

    Local results that name the same least node agree, so few distinct links
    are left of many overlapping groups.
    """
    nodes, index = np.unique(links.ravel(), return_inverse=True)
    u, v = index.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:  # the least label spreads along links, then labels jump to their label's label
        new = root.copy()
        np.minimum.at(new, u, root[v])
        np.minimum.at(new, v, root[u])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    moved = np.nonzero(root != np.arange(len(root)))[0]
    return np.stack([nodes[moved], nodes[root[moved]]], axis=1)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) edges of longs -> (node, component), component the least node reachable.

    Alternates large-star and small-star until every edge leads to a root,
    which takes a number of rounds logarithmic in the longest path. A hub
    with a third of all edges is dealt over many tasks (with_totals). Each round is written to the
    shared folder. Null ends and self-loops are ignored; nodes without an
    edge do not occur in the result; an empty table gives an empty result.
    """
    once = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = materialise(_small_star(once), "cc")
    for _ in range(rounds):
        inner = now.join(now.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").select("a")
        torn = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        if inner.union(torn).isEmpty():
            break
        now = materialise(_small_star(_star(now)), "cc")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
