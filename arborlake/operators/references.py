"""References between nodes of templates: an edge table beside the node table.

nodes: (template_id, node_id, dfs, last, type, value, …), a node's subtree
being the nodes with dfs in dfs..last. refs: (template_id, src, dst, kind).
Both tables hold any number of templates; nothing crosses a template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

#: Kinds of references.
KINDS = ("refer_to", "referred_from", "context_refer", "self_refer", "attribute_refer_to", "attribute_referred_from")
#: What stands at the other end of a reference of each kind that is cleaned from both ends.
MIRROR = {"referred_from": "refer_to", "refer_to": "referred_from", "context_refer": "refer_to", "self_refer": "self_refer"}


def resolved(refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, dangling): references whose ends both exist, and the others; null ends dangle."""
    known = nodes.select("template_id", "node_id").distinct()
    end = lambda c: known.select("template_id", F.col("node_id").alias(c))
    kept = refs.join(end("src"), ["template_id", "src"], "left_semi").join(end("dst"), ["template_id", "dst"], "left_semi").select(*refs.columns)
    marked = refs.join(end("src").withColumn("__a", F.lit(1)), ["template_id", "src"], "left").join(end("dst").withColumn("__b", F.lit(1)), ["template_id", "dst"], "left")
    return kept, marked.where("__a is null or __b is null").select(*refs.columns)


def referring(nodes: DataFrame, refs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Nodes that have a reference of one of ``kinds`` themselves."""
    ends = refs.where(F.col("kind").isin(*kinds)).select("template_id", F.col("src").alias("node_id"))
    return nodes.join(ends, ["template_id", "node_id"], "left_semi")


def referring_below(nodes: DataFrame, refs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Nodes of which a node further down has a reference of one of ``kinds``."""
    below = referring(nodes, refs, kinds).select("template_id", F.col("dfs").alias("__at"))
    inside = (nodes["template_id"] == below["template_id"]) & (below["__at"] > nodes["dfs"]) & (below["__at"] <= nodes["last"])
    return nodes.join(below, inside, "left_semi")


def pruned(nodes: DataFrame, refs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Nodes that have a reference of one of ``kinds`` in their subtree; the rest of each tree goes, roots stay."""
    hits = referring(nodes, refs, kinds).select("template_id", F.col("dfs").alias("__at"))
    inside = (nodes["template_id"] == hits["template_id"]) & (hits["__at"] >= nodes["dfs"]) & (hits["__at"] <= nodes["last"])
    roots = nodes.where("type = 'Root'")
    return nodes.where("type <> 'Root'").join(hits, inside, "left_semi").unionByName(roots)


def cleaned(refs: DataFrame, marked: DataFrame, mode: str = "all") -> DataFrame:
    """References without those of the ``marked`` (template_id, node_id) nodes of kind ``mode`` (or all), nor their mirrors at the other ends."""
    modes = [k for k in MIRROR if mode in ("all", k)]
    nodes = marked.select("template_id", "node_id").distinct()
    own = nodes.select("template_id", F.col("node_id").alias("src"))
    gone = refs.where(F.col("kind").isin(*modes)).join(own, ["template_id", "src"], "left_semi").select("template_id", "src", "dst", "kind")
    mirror = F.create_map(*[F.lit(x) for pair in MIRROR.items() for x in pair])
    back = gone.select("template_id", F.col("dst").alias("src"), F.col("src").alias("dst"), mirror[F.col("kind")].alias("kind"))
    return refs.join(gone.union(back).distinct(), ["template_id", "src", "dst", "kind"], "left_anti").select(*refs.columns)


def subtree(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """All nodes at or below ``tops`` (template_id, node_id)."""
    top = nodes.join(tops.select("template_id", "node_id").distinct(), ["template_id", "node_id"], "left_semi").select(F.col("template_id").alias("__t"), F.col("dfs").alias("__lo"), F.col("last").alias("__hi"))
    return nodes.join(top, (nodes["template_id"] == top["__t"]) & nodes["dfs"].between(top["__lo"], top["__hi"]), "left_semi")


def cleaned_below(refs: DataFrame, nodes: DataFrame, tops: DataFrame, mode: str = "all") -> DataFrame:
    """``cleaned`` for the nodes that a chain of nodes with references of that kind leads down to from ``tops``.

    A node without a reference of a kind ends the descent for that kind.
    """
    for kind in [k for k in MIRROR if mode in ("all", k)]:
        has = materialise(referring(nodes, refs, (kind,)).select("template_id", "node_id", "parent_id"), "refs")
        level = has.join(tops.select("template_id", "node_id").distinct(), ["template_id", "node_id"], "left_semi").select("template_id", "node_id")
        hit = level
        while not level.isEmpty():
            level = materialise(has.join(level.select("template_id", F.col("node_id").alias("parent_id")), ["template_id", "parent_id"]).select("template_id", "node_id"), "level")
            hit = hit.union(level)
        refs = materialise(cleaned(refs, hit, kind), "refs")
    return refs


def consistent(refs: DataFrame, nodes: DataFrame, context: Column | None = None) -> DataFrame:
    """References without those between nodes of different type or value that should be equal.

    That holds for self references of all nodes, and for references outwards of
    nodes of a context tree, where ``context`` (a predicate over src's node
    columns) says so. Null values equal null values.
    """
    side = lambda p: nodes.select("template_id", F.col("node_id").alias(p), *[F.col(c).alias(f"__{p}_{c}") for c in ("type", "value")])
    about = nodes.select("template_id", F.col("node_id").alias("src"), (context if context is not None else F.lit(False)).alias("__context"))
    both = refs.join(side("src"), ["template_id", "src"]).join(side("dst"), ["template_id", "dst"]).join(about, ["template_id", "src"])
    same = (F.col("__src_type") == F.col("__dst_type")) & F.col("__src_value").eqNullSafe(F.col("__dst_value"))
    bound = (F.col("kind") == "self_refer") | (F.col("kind") == "refer_to") & F.col("__context")
    return both.where(same | ~bound).select(*refs.columns)


def insert_references(nodes: DataFrame, refs: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, refs) of Insert templates with what refers to a before side's body node as a bare Reference.

    ``bodies`` (template_id, node_id) are the body nodes before. Nodes that
    refer to one of them become leaves of type Reference without a value; what
    hung under them goes, with its references, and so do references to nodes
    under the bodies.
    """
    pointing = refs.where("kind = 'refer_to'").join(bodies.select("template_id", F.col("node_id").alias("dst")), ["template_id", "dst"], "left_semi").select("template_id", F.col("src").alias("node_id")).distinct()
    tops = materialise(nodes.join(pointing, ["template_id", "node_id"], "left_semi").select("template_id", "node_id", "dfs", "last"), "tops")
    span = tops.select(F.col("template_id").alias("__t"), F.col("dfs").alias("__lo"), F.col("last").alias("__hi"))
    under = materialise(nodes.join(span, (nodes["template_id"] == span["__t"]) & (nodes["dfs"] > span["__lo"]) & (nodes["dfs"] <= span["__hi"]), "left_semi").select("template_id", "node_id"), "under")
    bare = tops.select("template_id", "node_id", F.lit(True).alias("__bare"))
    kept = nodes.join(under, ["template_id", "node_id"], "left_anti").join(bare, ["template_id", "node_id"], "left")
    changed = kept.withColumns({"type": F.when(F.col("__bare"), "Reference").otherwise(F.col("type")), "value": F.when(F.col("__bare").isNull(), F.col("value")), "last": F.when(F.col("__bare"), F.col("dfs")).otherwise(F.col("last"))}).select(*nodes.columns)
    inner = subtree(nodes, bodies).join(bodies.select("template_id", "node_id"), ["template_id", "node_id"], "left_anti")
    left = cleaned(cleaned(refs, under), inner, "referred_from")
    loose = left.where(F.col("kind").isin("context_refer", "attribute_refer_to", "attribute_referred_from")).join(bare.select("template_id", F.col("node_id").alias("src")), ["template_id", "src"], "left_semi")
    return changed, left.join(loose.select("template_id", "src", "dst", "kind"), ["template_id", "src", "dst", "kind"], "left_anti").select(*refs.columns)
