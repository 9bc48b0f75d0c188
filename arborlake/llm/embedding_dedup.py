"""Embedding near-duplicates with a neighbour graph refined by NN-descent."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .components import components, thinned, with_totals
from .topk import usable

BLOCK = 1024  # members of a compared block on average


def unit_nodes(own: DataFrame) -> DataFrame:
    """(id, label, v, least, copies): one node per label and vector, v of length 1."""
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))
    nodes = own.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    return nodes.withColumn("norm", norm).where("norm > 0 and norm < double('infinity')").select(F.xxhash64("label", "x").alias("id"), "label", F.transform("x", lambda x: x / F.col("norm")).alias("v"), "least", "copies")


def local_join(groups: DataFrame, best: int) -> DataFrame:
    """Groups (ids, vs, floors, and those of another block or nulls) -> (a, b, sim): the ``best`` closest fellows of each member above its floor, both ways.

    A block alone is compared with itself, else with the other block.
    """

    def nearest(sims: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        rows, cols = np.repeat(np.arange(len(sims)), k), near.ravel()
        s = sims[rows, cols]
        keep = s > np.asarray(floors)[rows]
        return rows[keep], cols[keep], s[keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vs, floors, ids2, vs2, floors2 in batch.itertuples(index=False):
                ids, v = np.asarray(ids, np.int64), np.stack(vs)
                if ids2 is None:
                    sims = v @ v.T
                    np.fill_diagonal(sims, -2.0)
                    i, j, s = nearest(sims, floors, min(best, len(ids) - 1))
                    a, b = ids[i], ids[j]
                else:
                    ids2, sims = np.asarray(ids2, np.int64), v @ np.stack(vs2).T
                    i, j, s = nearest(sims, floors, min(best, len(ids2)))
                    j2, i2, s2 = nearest(sims.T, floors2, min(best, len(ids)))
                    a, b, s = np.concatenate([ids[i], ids[i2]]), np.concatenate([ids2[j], ids2[j2]]), np.concatenate([s, s2])
                yield pd.DataFrame({"a": np.concatenate([a, b]), "b": np.concatenate([b, a]), "sim": np.concatenate([s, s])})

    return groups.mapInPandas(run, "a long, b long, sim double")


def best_lists(edges: DataFrame, size: int, larger: DataFrame | None = None, most: int = 0) -> DataFrame:
    """The ``size`` nearest distinct neighbours of each node; of nodes in ``larger`` (id, most) the ``most`` nearest, up to ``most`` of all."""
    near = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    ranked = edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= max(size, most))
    if larger is not None:
        ranked = ranked.join(larger, ranked["a"] == larger["id"], "left").where(F.col("r") <= F.coalesce("most", F.lit(size))).drop("id", "most")
    return ranked.drop("r")


def grouped(members: DataFrame, key: list[str], nodes: DataFrame, most: int = BLOCK) -> DataFrame:
    """(…key, id, floor) rows as local joins, with their vectors: a group, or all pairs of blocks of one with over ``most`` members."""
    members = materialise(members, "groups")
    sizes = members.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    dealt = members.join(sizes, key).withColumn("parts", F.expr(f"(n - 1) div {most} + 1")).withColumn("part", F.expr(f"pmod(xxhash64(id, {', '.join(key)}), parts)"))
    gathered = lambda df: df.join(nodes.select("id", "v"), "id").repartition(*key, "part").groupBy(*key, "part", "parts").agg(F.collect_list(F.struct("id", "v", "floor")).alias("m"))
    fields = lambda m, suffix="": [F.col(f"{m}.id").alias(f"ids{suffix}"), F.col(f"{m}.v").alias(f"vs{suffix}"), F.col(f"{m}.floor").alias(f"floors{suffix}")]
    alone = lambda df: df.where(F.size("m") > 1).select(*fields("m"), *[F.lit(None).cast(t).alias(f"{c}2") for c, t in (("ids", "array<long>"), ("vs", "array<array<double>>"), ("floors", "array<double>"))])
    small = alone(gathered(dealt.where("parts = 1")))
    if sizes.where(F.col("n") > most).isEmpty():
        return small
    blocks = materialise(gathered(dealt.where("parts > 1")), "crowded")
    left = blocks.where("part < parts - 1").withColumn("part", F.explode(F.expr("sequence(part + 1, parts - 1)"))).select(*key, "part", F.col("m").alias("l"))
    crossed = left.join(blocks, [*key, "part"]).select(*fields("l"), *fields("m", "2"))
    return small.unionByName(alone(blocks)).unionByName(crossed)


def hash_groups(nodes: DataFrame, dim: int, bits: int, tables: int, seed: int) -> DataFrame:
    """(table, code, label, id, floor): members of sign-projection buckets, the first guess at neighbourhoods."""
    planes = np.random.default_rng(seed).standard_normal((dim, bits * tables))
    power = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.stack([np.asarray(x) for x in b.column(2).to_pylist()])
                codes = ((v @ planes > 0).reshape(len(v), tables, bits) * power).sum(axis=2)
                n = len(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables), n)), pa.array(codes.ravel()), b.column(1).take(pa.array(np.repeat(np.arange(n), tables))), b.column(0).take(pa.array(np.repeat(np.arange(n), tables))), pa.array(np.full(n * tables, -2.0))], ["table", "code", "label", "id", "floor"])

    return nodes.select("id", F.col("label").cast("string").alias("label"), "v").where(F.size("v") == dim).mapInArrow(run, "table long, code long, label string, id long, floor double")


def descend(nodes: DataFrame, graph: DataFrame, size: int, larger: DataFrame | None, most: int, more: DataFrame | None = None) -> DataFrame:
    """One round: a node's neighbours and reverse neighbours are joined with one another; lists keep the best, of ``more`` pairs too.

    All members of a neighbourhood meet; crowded ones are compared in blocks.
    A pair is returned only where it beats the worst of a full list.
    """
    held = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    if larger is not None:
        held = held.join(larger, held["a"] == larger["id"], "left").drop("id")
    room = F.coalesce(F.col("most"), F.lit(size)) if larger is not None else F.lit(size)
    floor = held.select(F.col("a").alias("id"), F.when(F.col("n") >= room, F.col("least")).otherwise(-2.0).alias("floor"))
    about = graph.select(F.col("a").alias("center"), F.col("b").alias("id")).union(graph.select(F.col("b").alias("center"), F.col("a").alias("id"))).distinct()
    edges = graph.unionByName(local_join(grouped(about.join(floor, "id"), ["center"], nodes), max(size, most)))
    return best_lists(edges.unionByName(more) if more is not None else edges, size, larger, most)


def planted_twins(nodes: DataFrame, n: int, threshold: float, probes: int, seed: int) -> DataFrame:
    """(id, label, v, of): for about ``probes`` of the ``n`` nodes a vector each in a random direction from it, at ``threshold`` and hardly more.

    They are the hardest links to find. However rare links are among the rows,
    the share of twins found is evidence of the recall.
    """
    some = nodes.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(max(1, n // probes))) == 0).where(F.size("v") > 1)
    kind = nodes.schema["label"].dataType
    cosine = min(1.0, threshold + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            twins = []
            for i, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                v = np.asarray(v)
                side = np.random.default_rng([seed, i & 0xFFFFFFFFFFFFFFFF]).standard_normal(len(v))
                side -= (side @ v) * v
                twin = cosine * v + (1 - cosine**2) ** 0.5 * side / np.linalg.norm(side)
                twins.append(twin / np.linalg.norm(twin))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(twins, pa.list_(pa.float64()))], ["of", "label", "v"])

    made = some.select("id", "label", "v").mapInArrow(run, f"of long, label {kind.simpleString()}, v array<double>")
    return made.select(F.xxhash64("of", F.lit("twin")).alias("id"), "label", "v", "of")


def block_links(some: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that span the components of all links between ``some`` of the ``nodes`` and every node of their label, exactly.

    Both sides are dealt into blocks of about 1024; every block of ``some`` is
    compared with every block of its label.
    """
    key = ["label", "d"]
    tall = lambda df: df.select("id", F.col("label").cast("string").alias("label"), F.size("v").alias("d"), "v")

    def dealt(df: DataFrame) -> DataFrame:
        sizes = df.groupBy(*key).agg(F.expr(f"count(*) div {BLOCK} + 1").alias("blocks"))
        placed = df.join(sizes, key).withColumn("block", F.expr("pmod(xxhash64(id, 17), blocks)"))
        return placed.repartition(*key, "block").groupBy(*key, "block", "blocks").agg(F.collect_list(F.struct("id", "v")).alias("m"))

    blocks = materialise(dealt(tall(nodes)), "blocks")
    count = blocks.select(*key, "blocks").distinct()
    left = dealt(tall(some)).drop("block", "blocks").join(count, key).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(*key, "block", F.col("m.id").alias("a"), F.col("m.v").alias("av"))
    pairs = left.join(blocks, [*key, "block"]).select("a", "av", F.col("m.id").alias("b"), F.col("m.v").alias("bv"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, av, b, bv in batch.itertuples(index=False):
                i, j = np.nonzero(np.stack(av) @ np.stack(bv).T >= threshold)
                links = thinned(np.stack([np.asarray(a, np.int64)[i], np.asarray(b, np.int64)[j]], axis=1))
                yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return pairs.mapInPandas(run, "a long, b long")


def joined_counts(nodes: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(id, links, first): the nodes of the components that ``links`` make, with their links in it and its least vec_id."""
    joined = components(links)
    members = materialise(nodes.join(joined, nodes["id"] == joined["node"]).select("id", "component", "v", "copies", F.col("least").alias("first")), "members")
    named = with_totals(members.select("id", "component", "first"), "component", "id", {"first": F.min})
    return materialise(named.join(count_links(members, threshold), "id").select("id", "links", "first"), "counted")


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): links of each member within its component, copies counted, exactly.

    A component is dealt into blocks of about 1024; every pair of blocks meets
    by its own key and gives one count per member, not the links themselves.
    """
    sized = with_totals(members.select("id", "component", F.lit(1).alias("n")), "component", "id", {"n": F.sum})
    dealt = members.join(sized.select("id", F.expr(f"n div {BLOCK} + 1").alias("blocks")), "id").withColumn("block", F.expr("pmod(xxhash64(id, 13), blocks)"))
    blocks = materialise(dealt.repartition("component", "block").groupBy("component", "block", "blocks").agg(F.collect_list(F.struct("id", "v", "copies")).alias("m")), "blocks")
    left = blocks.select("component", F.col("block").alias("own"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("block"), F.col("m").alias("l"))
    pairs = left.join(blocks, ["component", "block"]).select(F.col("l.id").alias("a"), F.col("l.v").alias("av"), F.col("l.copies").alias("ac"), F.col("m.id").alias("b"), F.col("m.v").alias("bv"), F.col("m.copies").alias("bc"), (F.col("own") == F.col("block")).alias("same"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, av, ac, b, bv, bc, same in batch.itertuples(index=False):
                near = np.stack(av) @ np.stack(bv).T >= threshold
                if same:
                    np.fill_diagonal(near, False)
                    yield pd.DataFrame({"id": a, "links": near @ np.asarray(bc)})
                else:
                    yield pd.DataFrame({"id": np.concatenate([a, b]), "links": np.concatenate([near @ np.asarray(bc), np.asarray(ac) @ near])})

    return pairs.mapInPandas(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, size: int = 10, rounds: int = 12, recall: float = 0.99, probes: int = 1000, tables: int = 8, widest: int = 40, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links have equal labels and a cosine >= ``threshold`` in doubles.

    Equal vectors of a label are one node. Neighbour lists of ``size`` start
    from ``tables`` sets of buckets of random sign projections. A round of
    NN-descent joins each neighbourhood with itself. A list is saturated if all
    of it reaches the threshold, as there may be more: it is four times as long
    in the next round, up to ``widest``. Recall is audited on planted twins (see
    planted_twins), which are nodes like others until the links are taken; while
    fewer than ``recall`` of them are found the next round also starts from
    further buckets. Rounds end when recall is reached and no list grows.

    Nodes whose lists are saturated at ``widest`` are compared with every node
    of their label, in blocks, so that no link of theirs is lost; then the
    members of each component are, so that counts of links are complete and
    no pair is kept below the threshold. If after ``rounds`` rounds recall is
    not reached, every pair of a label is compared.

    n_links counts other rows linked directly; component_id is the smallest
    vec_id reachable, itself included; kept is whether that is the row's own.
    Null labels, and vectors that are null, empty, zero or hold null, NaN or
    infinite components, link with nothing. Vectors of different lengths do
    not link. Null ids link but represent nothing. Repeated rows are linked
    copies. Other columns are ignored. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).alias("label"))
    own = rows.where(F.col("label").isNotNull() & usable("x") & (F.size("x") > 0))
    nodes = materialise(unit_nodes(own), "nodes")
    facts = nodes.groupBy(F.size("v").alias("dim"), "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n"), F.sum("n").alias("all")).collect()
    out = rows.select("vec_id", F.when(F.col("label").isNotNull() & usable("x") & (F.size("x") > 0), F.xxhash64("label", "x")).alias("id"))
    if not any(f["n"] > 1 for f in facts):
        links = nodes.select("id", F.lit(0).cast("long").alias("links"), "copies", "least")
    else:
        twins = materialise(planted_twins(nodes, sum(f["all"] for f in facts), threshold, probes, seed), "twins")
        n_twins = twins.count()
        every = nodes.select("id", "label", "v").unionByName(twins.drop("of"))

        def met(again: int) -> DataFrame:
            """Pairs that the ``again``-th sets of buckets bring together."""
            found = None
            for f in facts:
                if f["n"] > 1:
                    bits = max(1, min(24, math.ceil(math.log2(max(2, f["n"] / 24)))))
                    part = local_join(grouped(hash_groups(every, f["dim"], bits, tables, seed + again), ["table", "code", "label"], every), size)
                    found = part if found is None else found.unionByName(part)
            return found

        graph, larger, most, found = materialise(best_lists(met(0), size), "graph"), None, size, 0.0
        for r in range(rounds):
            graph = materialise(descend(every, graph, size, larger, most, met(r) if r and found < recall else None), "graph")
            found = twins_found(graph, twins, threshold) / n_twins if n_twins else 1.0
            full = saturated_lists(graph, threshold, size, larger)
            grow = materialise(full.where(F.col("most") < widest).select("id", F.least(F.col("most") * 4, F.lit(widest)).alias("most")), "larger")
            if grow.isEmpty():
                if found >= recall:
                    break
                continue
            if r == rounds - 1:  # lists that would grow further count as saturated
                break
            larger = materialise(grow if larger is None else grow.unionByName(larger.join(grow, "id", "left_anti")), "larger")
            most = widest
        if found >= recall:
            near = graph.where(F.col("sim") >= threshold).select("a", "b")
            edges = near.join(twins, near["a"] == twins["id"], "left_anti").join(twins, near["b"] == twins["id"], "left_anti")
            saturated = materialise(nodes.join(saturated_lists(graph, threshold, size, larger), "id", "left_semi"), "saturated")
            if not saturated.isEmpty():
                edges = edges.union(block_links(saturated, nodes, threshold))
        else:
            edges = block_links(nodes, nodes, threshold)
        counted = joined_counts(nodes, edges, threshold)
        links = nodes.select("id", "copies", "least").join(counted, "id", "left").select("id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "copies", F.coalesce("first", "least").alias("least"))
    full = out.join(links, "id", "left")
    component = F.coalesce("least", "vec_id")
    return full.select("vec_id", (F.coalesce("links", F.lit(0).cast("long")) + F.coalesce("copies", F.lit(1).cast("long")) - 1).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def saturated_lists(graph: DataFrame, threshold: float, size: int, larger: DataFrame | None) -> DataFrame:
    """(id, most): the nodes whose whole list reaches the threshold, and how long it may be."""
    listed = graph.where(F.col("sim") >= threshold).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    if larger is None:
        return listed.where(F.col("n") >= size).select("id", F.lit(size).alias("most"))
    return listed.join(larger, "id", "left").withColumn("most", F.coalesce("most", F.lit(size))).where("n >= most").select("id", "most")


def twins_found(graph: DataFrame, twins: DataFrame, threshold: float) -> int:
    """How many planted twins are linked with their nodes, from either side."""
    near = graph.where(F.col("sim") >= threshold)
    pair = twins.select(F.col("id").alias("twin"), "of")
    one = near.join(pair, (near["a"] == pair["twin"]) & (near["b"] == pair["of"])).select("twin")
    other = near.join(pair, (near["b"] == pair["twin"]) & (near["a"] == pair["of"])).select("twin")
    return one.union(other).distinct().count()
