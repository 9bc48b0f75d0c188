"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .words import release

#: floor(2**40 / golden ratio): a step of the golden-ratio sequence in units of 2**-40.
GOLDEN_STEP = 679_538_232_609
MODULUS = 1 << 40


def golden_points(index: np.ndarray) -> np.ndarray:
    """Points i/phi mod 1 as integers below 2**40, exact for i < 2**40."""
    low, high = index & 0xFFFFF, index >> 20
    return (low * GOLDEN_STEP % MODULUS + high * ((GOLDEN_STEP << 20) % MODULUS) % MODULUS) % MODULUS


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    out: list[float | None] = [None] * len(sizes)
    while True:
        free = [i for i, t in enumerate(out) if t is None]
        rest = total - sum(t for t in out if t is not None)
        unit = rest / sum(weights[i] for i in free) if free else 0.0
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not over:
            return [unit * weights[i] if t is None else t for i, t in enumerate(out)]
        for i in over:
            out[i] = float(most * sizes[i])


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """Sum of (a * i + b) // m over i < n, in logarithmic time."""
    out = 0
    while True:
        out += n * (n - 1) // 2 * (a // m) + n * (b // m)
        n, b = divmod(a % m * n + b % m, m)
        if not n:
            return out
        m, a = a % m, m


def points_below(n: int, edge: int) -> int:
    """How many of the first ``n`` golden-ratio points, those of 1..n, lie below ``edge``."""
    return floor_sum(n, MODULUS, GOLDEN_STEP, GOLDEN_STEP) - floor_sum(n, MODULUS, GOLDEN_STEP, GOLDEN_STEP + MODULUS - edge) + n


def count_words(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    """(row, doc_id, source, size): words separated by blanks (space, tab, LF, VT, FF, CR)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(x.as_py().split()) if x.is_valid else 0 for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int64())], ["row", "doc_id", "source", "size"])
        release()

    return docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(count, "row long, doc_id long, source string, size long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most: int = 2, block_words: int = 2048, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Draws ``budget`` times the corpus's words, sources in proportion to their weights.

    Sources in order of code point (null last) take the cyclic ``weights``; a
    target is at most ``most`` times its source's size. Each source's documents
    are shuffled by hash and laid end to end; the stream is cut into blocks of
    ``block_words`` words. Golden-ratio points, mapped through the cumulative
    shares, give the schedule: its k-th slot of a source takes that source's
    k-th block, in a further epoch from its first block again, up to the
    target. Slots and documents meet in a join on (source, block).

    Returns per document row: doc_id, source, size, source_size, target, taken
    (words taken, repeats counted, at most ``most`` * size). Only one total per
    source goes to the driver, as it does with the weights themselves. A source
    with a third of all rows is spread over hash buckets; running sums go by
    bucket, then over bucket totals.

    Texts of any length count whole; null and empty ones have size 0 and are
    never taken. A null source is a
    source of its own. Repeated rows are documents of their own, and so are
    rows of one id or of null ids. An empty table gives an empty result. Other
    columns are ignored. Reruns agree, but for which of several rows of one id
    and size comes first.
    """
    sized = materialise(count_words(docs, id_col, text_col, source_col, F.monotonically_increasing_id()), "sizes")
    return draw(sized, weights, budget, most, block_words, seed).drop("row")


def resample(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most: int = 2, block_words: int = 2048, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as many times as ``mix`` takes its words, to the nearest whole; none at 0.

    Rows are numbered and written once, so that rows of one id, of null ids and
    repeated rows keep their own shares. Rows without words go, as nothing is
    taken of them. Columns are those of ``docs``.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    kept = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    sized = materialise(count_words(kept, id_col, text_col, source_col, F.col(row)), "sizes")
    times = draw(sized, weights, budget, most, block_words, seed).where("size > 0").select(F.col("row").alias(row), F.expr("cast((2 * taken + size) div (2 * size) as int)").alias("n")).where("n > 0")
    return kept.join(times.select(row, F.explode(F.sequence(F.lit(1), F.col("n")))).select(row), row).select(*docs.columns)


#: Sources of at most some 100 bytes each that may be sent to all tasks.
BROADCAST_SOURCES = 100_000


def draw(sized: DataFrame, weights: Sequence[float], budget: float, most: int, block_words: int, seed: int) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, taken) for a written table of (row, doc_id, source, size); see mix."""
    spark = sized.sparkSession
    per = sorted(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in per]
    rows = sum(r["n"] for r in per)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(per))], budget * sum(sizes), most)
    words = [round(t) for t in goal]
    blocks = [-(-s // block_words) for s in sizes]
    slots = [0 if not s else t // s * b + -(-(t % s) // block_words) for s, t, b in zip(sizes, words, blocks, strict=True)]
    facts = spark.createDataFrame([(i, r["source"], s, float(t)) for i, (r, s, t) in enumerate(zip(per, sizes, goal, strict=True))], "sid int, source string, source_size long, target double")
    if len(per) <= BROADCAST_SOURCES:
        facts = F.broadcast(facts)
    keyed = sized.join(facts, sized["source"].eqNullSafe(facts["source"])).select("row", "doc_id", sized["source"], "size", "sid", "source_size", "target")

    buckets = max(512, rows // 20_000)
    real = keyed.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    inside = Window.partitionBy("sid", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    before = real.groupBy("sid", "bucket").agg(F.sum("size").alias("w")).withColumn("before", F.sum("w").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("w")).drop("w")
    laid = real.withColumn("at", F.sum("size").over(inside) - F.col("size")).join(before, ["sid", "bucket"]).withColumn("at", F.col("at") + F.col("before"))
    parts = laid.withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})"))).withColumn("lo", F.greatest(F.col("at") - F.col("block") * block_words, F.lit(0))).withColumn("hi", F.least(F.col("at") + F.col("size") - F.col("block") * block_words, F.lit(block_words)))

    taken = parts.join(schedule(spark, sizes, words, blocks, slots, block_words), ["sid", "block"]).groupBy("sid", "at").agg(F.sum(F.greatest(F.least("hi", "words") - F.col("lo"), F.lit(0))).alias("taken"))
    columns = ["row", "doc_id", "source", "size", "source_size", "target"]
    full = laid.join(taken, ["sid", "at"], "left").select(*columns, F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return full.unionByName(keyed.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def schedule(spark, sizes: list[int], words: list[int], blocks: list[int], slots: list[int], block_words: int) -> DataFrame:
    """(sid, block, words, slot): one row per used slot, taking the first ``words`` words of the block.

    Four points for each wanted slot are enough: a golden-ratio sequence
    returns to an interval of length p within 3/p steps, and its counts stray
    from proportion by the logarithm of their number only. Slots beyond a
    source's quota are void. A slot's rank among its source's is known without
    a shuffle: how many points before a task's first one lie in a source's
    interval is a sum of floors, found in logarithmic time.
    """
    total = sum(slots)
    if not total:
        return spark.createDataFrame([], "sid int, block long, words long, slot long")
    edges = np.asarray([MODULUS * c // total for c in np.cumsum(slots).tolist()], np.int64)
    own, goal, number = (np.asarray(x, np.int64) for x in (sizes, words, np.maximum(blocks, 1)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected, before = -1, None
        for b in batches:
            if not b.num_rows:
                continue
            slot = b.column(0).to_numpy()
            if slot[0] != expected:
                below = np.asarray([points_below(int(slot[0]), e) for e in edges.tolist()], np.int64)
                before = np.diff(below, prepend=0)
            expected = slot[-1] + 1
            sid = np.searchsorted(edges, golden_points(slot + 1), "right")
            count = np.bincount(sid, minlength=len(edges))
            order = np.argsort(sid, kind="stable")
            rank = np.empty(len(sid), np.int64)
            rank[order] = np.arange(len(sid)) - np.repeat(np.cumsum(count) - count, count)
            rank += before[sid]
            before = before + count
            done = rank // number[sid] * own[sid] + rank % number[sid] * block_words
            use = done < goal[sid]
            sid, rank, done = sid[use], rank[use], done[use]
            yield pa.RecordBatch.from_arrays([pa.array(sid.astype(np.int32)), pa.array(rank % number[sid]), pa.array(np.minimum(goal[sid] - done, block_words)), pa.array(slot[use])], ["sid", "block", "words", "slot"])

    return spark.range(4 * total + 64).mapInArrow(pick, "sid int, block long, words long, slot long")
