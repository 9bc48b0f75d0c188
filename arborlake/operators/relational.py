"""Relational kernels: joins, windows and set operations that have no one-word form in the DataFrame API."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialise


# -- filters ---------------------------------------------------------------


def null_passes(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` is true or unknown."""
    return df.where(condition.isNull() | condition)


def at_most_lines(df: DataFrame, column: str, lines: int) -> DataFrame:
    """Rows whose text has at most ``lines`` lines; null texts go."""
    return df.where(F.size(F.split(F.col(column), "\n")) <= lines).where(F.col(column).isNotNull())


# -- joins -----------------------------------------------------------------


def sum_having(parent: DataFrame, child: DataFrame, on: Sequence[str], value: Column, least: float, name: str = "total") -> DataFrame:
    """Parents whose children's ``value`` sums to over ``least``; the child side is summed before it is joined."""
    totals = child.groupBy(*on).agg(F.sum(value).alias(name)).where(F.col(name) > least)
    return parent.join(totals, list(on))


def last_wins_update(base: DataFrame, updates: DataFrame, on: Sequence[str], value: str, order: Column) -> DataFrame:
    """``base`` with ``value`` from the last matching update, where there is one."""
    last = updates.groupBy(*on).agg(F.max_by(value, order).alias("__new"))
    return base.join(last, list(on), "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def union_prefer_left(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """All of ``a``, and the rows of ``b`` whose key ``a`` lacks."""
    return a.unionByName(b.join(a.select(*on).distinct(), list(on), "left_anti").select(*a.columns))


def interval_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs with ``low`` <= ``point`` <= ``high``.

    Spans are listed under every stretch of ``width`` they touch and points
    under their own, so that an equi-join on the stretch finds the pairs and a
    shuffle deals them out; choose ``width`` near a usual span's length.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    listed = spans.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("__cell", cell(point)).join(listed, "__cell").where(F.col(point).between(F.col(low), F.col(high))).drop("__cell")


def innermost(points: DataFrame, spans: DataFrame, point: str, keys: Sequence[str], low: str, high: str, depth: str, name: str, width: int) -> DataFrame:
    """For each point the ``name`` of the deepest span around it (of equally deep ones the greatest name)."""
    return interval_join(points, spans, point, low, high, width).groupBy(*keys).agg(F.max(F.struct(depth, name))[name].alias(name))


def prefix_join(left: DataFrame, right: DataFrame, text: str, prefix: str, separator: str = "/") -> DataFrame:
    """Left rows with the longest ``prefix`` of the right that their ``text`` starts with, else null.

    Prefixes end at ``separator``: a text is listed under each of its own, and
    an equi-join finds the right's; no pair is tried in vain.
    """
    parts = F.split(F.col(text), separator, -1)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    texts = left.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    own = texts.withColumn(text, F.col("__text")) if text != "__text" else texts
    hits = own.select("__text", F.explode(cuts).alias(prefix)).join(right.select(prefix).distinct(), prefix).groupBy("__text").agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return left.join(hits, left[text] == hits["__text"], "left").drop("__text")


def around(df: DataFrame, group: Sequence[str], position: str, marked: Column) -> DataFrame:
    """Rows before the first and after the last marked row of their group, with ``side`` before or after."""
    ends = df.where(marked).groupBy(*group).agg(F.min(position).alias("__lo"), F.max(position).alias("__hi"))
    side = F.when(F.col(position) < F.col("__lo"), "before").when(F.col(position) > F.col("__hi"), "after")
    return df.join(ends, list(group)).withColumn("side", side).where("side is not null").drop("__lo", "__hi")


def sharing_values(df: DataFrame, group: Sequence[str], key: str, values: Column, marked: Column) -> DataFrame:
    """(group, key, shared): unmarked rows and how many distinct values they share with a marked row of their group."""
    rows = df.select(*group, key, marked.alias("__m"), F.explode(F.array_distinct(values)).alias("__v"))
    seeds = rows.where("__m").select(*group, "__v").distinct()
    return rows.where("not __m").join(seeds, [*group, "__v"]).groupBy(*group, key).agg(F.count("*").alias("shared"))


def dice_pairs(df: DataFrame, key: str, items: str, block: Sequence[str], least: float) -> DataFrame:
    """(a, b, common, dice) for a < b of one block with Dice similarity 2 * common / (|a| + |b|) >= ``least`` > 0.

    ``items`` are arrays without repeats. A set's sketch has a bit for each
    bucket of hashes, set if the bucket holds an odd number of items: two
    sketches differ in no more bits than the sets have items that only one of
    them holds, so no pair is lost. Sets are dealt into bands of sizes, of which
    only neighbours can be similar, and bands into tiles; sketches of two tiles
    are compared at a time. Only the pairs that may be similar meet their items
    and are counted in full, so what is shuffled does not grow with the pairs
    that share an item.
    """
    sized = df.select(key, *block, items).withColumn("n", F.size(items)).where("n > 0")
    sized = reduce(DataFrame.where, (F.col(c).isNotNull() for c in (key, *block)), sized)
    ratio = max((2 - least) / least * 1.001, 1.1)  # similar sets are in one band or the next
    sketched = sized.select(key, *block, "n", F.floor(F.log("n") / math.log(ratio)).cast("int").alias("band"), F.transform(items, lambda x: F.xxhash64(x)).alias("h"))
    kinds = {f.name: f.dataType for f in sketched.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in (key, *block, "n", "band")] + [T.StructField("sketch", T.BinaryType())])
    sketched = materialise(sketched.mapInArrow(_sketches(ratio), schema), "sketches")
    bits = F.least(F.greatest(F.pow(F.lit(ratio), F.col("band") + 1) * 2, F.lit(float(SKETCH[0]))), F.lit(float(SKETCH[1])))
    dealt = sketched.join(sketched.groupBy(*block, "band").agg(F.count("*").alias("m")), [*block, "band"])
    dealt = dealt.withColumn("tile", F.expr("xxhash64(" + f"`{key}`" + ")")).withColumn("tile", F.pmod("tile", F.ceil(F.col("m") * bits / TILE_BITS)).cast("int"))
    tiles = materialise(dealt.groupBy(*block, "band", "tile").agg(F.collect_list(F.struct(F.col(key).alias("k"), "n", "sketch")).alias("sets")), "tiles")
    other = lambda *more: tiles.select(*block, F.col("band").alias("band2"), F.col("tile").alias("tile2"), *more)
    near = (F.col("band2") == F.col("band") + 1) | ((F.col("band2") == F.col("band")) & (F.col("tile2") >= F.col("tile")))
    ids = tiles.select(*block, "band", "tile")
    units = (ids.join(other(), list(block)) if block else ids.crossJoin(other())).where(near)
    units = units.join(tiles.withColumnRenamed("sets", "l"), [*block, "band", "tile"]).join(other(F.col("sets").alias("r")), [*block, "band2", "tile2"]).select(*block, "l", "r")
    pair = T.StructType([T.StructField(c, kinds[c]) for c in block] + [T.StructField(c, kinds[key]) for c in "xy"])
    met = units.mapInArrow(_alike(len(block), least), pair).where("x <> y").select(*block, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    met = materialise(met, "met")
    some = met.select(*block, F.col("a").alias(key)).union(met.select(*block, F.col("b").alias(key))).distinct()
    kept = materialise(sized.join(some, [*block, key], "left_semi").select(*block, key, items), "sets")
    full = lambda k, s: kept.select(*block, F.col(key).alias(k), F.col(items).alias(s))
    counted = met.join(full("a", "sa"), [*block, "a"]).join(full("b", "sb"), [*block, "b"]).withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return counted.withColumn("dice", 2 * F.col("common").cast("double") / (F.size("sa") + F.size("sb"))).where(F.col("dice") >= least).select(*block, "a", "b", "common", "dice")


#: Fewest and most bits of a sketch: twice the items of its band, between these.
SKETCH = (256, 1 << 16)
#: Bits of all sketches of a tile, in the mean.
TILE_BITS = 1 << 22


def _width(ratio: float, band: int) -> int:
    """Bits of a sketch, a power of two."""
    return min(max(1 << math.ceil(math.log2(2 * ratio ** (band + 1))), SKETCH[0]), SKETCH[1])


def _sketches(ratio: float):
    """Rows whose last column, hashes, is made a sketch; the column before is the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat, edges = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            out = []
            for band, lo, hi in zip(b.column(b.num_columns - 2).to_pylist(), edges[:-1], edges[1:], strict=True):
                bits = _width(ratio, band)
                odd = np.bincount((flat[lo:hi] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], [*b.schema.names[:-1], "sketch"])

    return run


def _alike(blocks: int, least: float):
    """(block, x, y) of pairs of sets that may be similar by their sizes and sketches, from rows (block, l, r) of two tiles."""

    def side(sets: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        k, n, sketch = sets.flatten()
        return k, n.to_numpy().astype(np.int64), np.frombuffer(b"".join(sketch.to_pylist()), np.uint64).reshape(len(sets), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                (ka, na, sa), (kb, nb, sb) = (side(b.column(blocks + c)[at].values) for c in (0, 1))
                width = min(sa.shape[1], sb.shape[1])  # folding a sketch gives that of fewer buckets
                sa, sb = (np.bitwise_xor.reduce(s.reshape(len(s), -1, width), axis=1).T.copy() for s in (sa, sb))
                found = []
                for lo in range(0, len(na), 256):
                    hi = min(lo + 256, len(na))
                    differ = np.zeros((hi - lo, len(nb)), np.int32)
                    for u, v in zip(sa[:, lo:hi], sb, strict=True):
                        differ += np.bitwise_count(u[:, None] ^ v[None, :])
                    total = na[lo:hi, None] + nb[None, :]
                    close = (differ <= (1 - least) * total + 1e-6) & (2 * np.minimum(na[lo:hi, None], nb[None, :]) >= least * total - 1e-6)
                    i, j = np.nonzero(close)
                    found.append(np.stack([i + lo, j]))
                    if sum(x.shape[1] for x in found) > 1 << 18 or hi == len(na):
                        i, j = np.concatenate(found, axis=1)
                        found = []
                        own = [pa.repeat(b.column(c)[at], len(i)) for c in range(blocks)]
                        yield pa.RecordBatch.from_arrays([*own, ka.take(pa.array(i)), kb.take(pa.array(j))], [*b.schema.names[:blocks], "x", "y"])

    return run


# -- aggregates and windows ----------------------------------------------------


def top_n(df: DataFrame, n: int, group: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1; Spark prunes to n rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def islands(df: DataFrame, group: Sequence[str], position: str, gap: int) -> DataFrame:
    """Adds ``island``: within a group a new one starts where ``position`` is over ``gap`` beyond the row before."""
    order = Window.partitionBy(*group).orderBy(position)
    starts = F.when(F.col(position) - F.lag(position).over(order) > gap, 1).otherwise(0)
    return df.withColumn("__s", starts).withColumn("island", F.sum("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def count_of_counts(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """(size, groups): how many groups have how many rows."""
    return df.groupBy(*group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def shards(df: DataFrame, key: str, n: int, ranges: int = 64) -> DataFrame:
    """Adds ``shard`` 0..n-1: consecutive runs of ceil(rows / n) rows in order of the numeric, distinct ``key``.

    Keys are dealt into ``ranges`` at approximate quantiles; a row's rank is
    that in its range and the counts of the ranges before.
    """
    cuts = sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.002)))
    dealt = df.withColumn("__p", sum((F.when(F.col(key) > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).withColumn("__total", F.sum("__n").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1 + F.col("__before")
    return dealt.join(F.broadcast(counts), "__p").withColumn("shard", F.floor(rank / F.ceil(F.col("__total") / n)).cast("long")).drop("__p", "__n", "__before", "__total")


def descendants(edges: DataFrame, parent: str, child: str, rounds: int = 1000) -> DataFrame:
    """(ancestor, node, distance): the transitive closure of a forest of ``parent`` -> ``child`` edges.

    Paths double in every round, so a chain of n takes log2 n joins.
    """
    paths = edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("node"), F.lit(1).cast("long").alias("distance"))
    paths, reach = materialise(paths, "closure"), 1
    for _ in range(rounds):
        step = paths.alias("x").join(paths.alias("y"), F.col("x.node") == F.col("y.ancestor")).where(F.col("x.distance") == reach).select("x.ancestor", "y.node", (F.col("x.distance") + F.col("y.distance")).alias("distance"))
        step = materialise(step, "closure")
        if step.isEmpty():
            return paths
        paths = paths.unionByName(step)
        reach *= 2
    raise RuntimeError("a cycle, or too deep")
