"""Training sets for a repair model, and template files."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.changes import changed_lines
from ..functions.rewriting import enclosing_function, training_masks
from ..functions.trees import parse_module

FOREST_SCHEMA = "template_id string, parent_id string, action string, instances long, before string, after string, within string, before_context string, after_context string, places string"


def line_pairs(hunks: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old, context, new): changed lines of hunks that both remove and add, with the function around them.

    Comments and blank lines are no change; hunks with a missing newline mark,
    or whose lines do not add up to their heads, go.
    """
    joined = hunks.join(sources, [*keys, "before_path"])
    kinds = dict(joined.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", old string, context string, new string"

    def pair(r: dict) -> tuple[str, str, str] | None:
        found = changed_lines(r["content"], r["b_start"], r["a_start"])
        lines = r["content"].split("\n")
        sizes = [sum(x[:1] not in skip for x in lines) for skip in ("+", "-")]
        module = parse_module(r["before_source"])
        if found is None or module is None or sizes != [r["b_len"], r["a_len"]] or not found[0] or not found[1]:
            return None
        text = lambda mark: " ".join(x[1:].strip() for x in lines if x.startswith(mark) and x[1:].strip() and not x[1:].strip().startswith("#"))
        around = enclosing_function(module, found[2])
        return None if around is None else (text("-"), around.replace("\n", ""), text("+"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*[r[k] for k in keys], *got) for r in b.to_dict("records") if (got := pair(r))]
            yield pd.DataFrame(rows, columns=[*keys, "old", "context", "new"], dtype=object)

    return joined.mapInPandas(run, schema)


def as_text(pairs: DataFrame) -> DataFrame:
    """One line a pair: old lines, the context after a mark, a tab, new lines."""
    return pairs.select(F.concat("old", F.lit(" <CTX> "), "context", F.lit("\t"), "new").alias("value"))


def masked_training_set(fixed: DataFrame, depth: int = 3) -> DataFrame:
    """(source, labels): statements of fixed code (column source) with their parts masked, each source once."""
    kind = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType()))]))

    @F.pandas_udf(kind)
    def masks(sources: pd.Series) -> pd.Series:
        def of(text) -> list[tuple[str, list[str]]]:
            module = parse_module(text)
            return [] if module is None else [x for s in module.body for x in training_masks(s, depth)]

        return sources.map(of)

    each = fixed.select(F.inline(masks("source")))
    return each.groupBy("source").agg(F.min("labels").alias("labels"))


def first_instances(templates: DataFrame, meta: DataFrame, on: list[str]) -> DataFrame:
    """Template instances with their metadata, removals apart: the first match of each instance, each once."""
    kept = templates.where("action <> 'Remove'").dropDuplicates(["template_id", *on])
    first = meta.groupBy(*on).agg(F.min(F.struct(*[c for c in meta.columns if c not in on])).alias("m"))
    return kept.join(first, on).select(*kept.columns, "m.*")


# -- template files -----------------------------------------------------------------


def write_templates(forest: DataFrame, path: str) -> None:
    """The forest as JSON lines, a folder for each action."""
    forest.write.mode("overwrite").partitionBy("action").json(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split()[0] for c in FOREST_SCHEMA.split(", ")]
    return spark.read.schema(FOREST_SCHEMA).json(path).select(*names)


def mined_index(forest: DataFrame) -> DataFrame:
    """(action, instances, template_id): templates of each action, the best supported first, in a distributed sort."""
    return forest.select("action", "instances", "template_id").orderBy("action", F.desc("instances"), "template_id")


def similarity_matrix(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """(a, one column per id) from (a, b, exact, shape) pairs: ``exact;shape``."""
    return pairs.groupBy("a").pivot("b", ids).agg(F.first(F.concat_ws(";", "exact", "shape")))


def relabel(tree: str, old: str, new: str, drop_value: bool = False) -> str:
    """A dumped tree with nodes of kind ``old`` made ``new``."""
    rows = json.loads(tree)
    for r in rows:
        if r["kind"] == old and r["type"] == old:
            r["kind"] = r["type"] = new
            r["value"] = None if drop_value else r["value"]
    return json.dumps(rows)


def looser_after_sides(forest: DataFrame) -> DataFrame:
    """End_Expr and Identifier in after sides become Expr without a value."""

    @F.pandas_udf(T.StringType())
    def loosen(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: None if t is None else relabel(relabel(t, "End_Expr", "Expr", True), "Identifier", "Expr", True))

    return forest.withColumn("after", loosen("after"))


def statements_of(source: str) -> list[str]:
    module = parse_module(source)
    return [] if module is None else [ast.unparse(s) for s in module.body]
