"""Trees in DataFrames: parsers, fingerprints, similarities and matching in Arrow batches."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..functions import kernels
from ..functions.trees import PACKED, Tree, exact_fingerprint, pack, parse, shape_fingerprint, unpack
from ..session import materialise
from .relational import dice_pairs

#: Nodes or leaves that a task holds as Python objects before it hands them on, unless one tree has more; so many characters count as one.
HELD, CHARACTERS = 4096, 64
NODE_FIELDS = ("dfs", "last", "parent", "depth", "role", "place", "kind", "type", "value", "vtype", "alias", "line", "end_line")
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})


class _Page(HTMLParser):
    """The elements that are open, with their children so far. It has no reference to itself, so a page's nodes go when its tree does."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[Tree]]] = [("#root", [])]

    def end(self) -> None:
        tag, children = self.open.pop()
        self.open[-1][1].append(Tree("Element", tag, role="child", children=tuple(children)))

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, []))
        if tag in VOID:
            self.end()

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open[1:]):
            while self.open[-1][0] != tag:
                self.end()
            self.end()

    def handle_data(self, data):
        if data.strip():
            self.open[-1][1].append(Tree("Text", "Text", data.strip(), role="child"))


def parse_html(text: str | None) -> Tree | None:
    """A page as a tree of elements (kind Element, type the tag) with text leaves; unclosed elements end with their parent."""
    if text is None:
        return None
    page = _Page()
    page.feed(text)
    while len(page.open) > 1:
        page.end()
    return Tree("Root", "Root", children=tuple(page.open[0][1]))


PARSERS: dict[str, Callable[[str | None], Tree | None]] = {"python": lambda s: parse(s) if s is not None else None, "html": parse_html}


#: with_tree's struct in Arrow.
TREE = pa.struct({"nodes": pa.list_(pa.struct({f: pa.int32() if f in ("dfs", "last", "parent", "depth", "place", "line", "end_line") else pa.string() for f in NODE_FIELDS})), "fp_exact": pa.string(), "fp_shape": pa.string()})


def _arrays(rows: Iterator[tuple[object, int]], kind: pa.DataType) -> Iterator[pa.Array]:
    """Arrow arrays of (value, size) rows, of some HELD in all each: Python objects of a whole batch would take gigabytes."""
    held, size = [], 0
    for value, n in rows:
        held.append(value)
        size += n + 1
        if size > HELD:
            yield pa.array(held, kind)
            held, size = [], 0
    if held:
        yield pa.array(held, kind)


def _once(udf):
    """``udf`` evaluated once a row: of a deterministic one, a filter on its result (as inline has one) gets a copy, and each task a second worker that parses everything again."""
    return udf.asNondeterministic()


def _built(batches: Iterator[pa.Array], parser: Callable[[str | None], Tree | None]) -> Iterator[pa.Array]:
    """with_tree's structs of batches of sources."""

    def rows() -> Iterator[tuple[dict, int]]:
        for b in batches:
            for x in b:
                t = parser(text := x.as_py())
                row = dict.fromkeys(("nodes", "fp_exact", "fp_shape")) if t is None else {"nodes": pack(t), "fp_exact": exact_fingerprint(t), "fp_shape": shape_fingerprint(t)}
                yield row, len(row["nodes"] or ()) + len(text or "") // CHARACTERS

    return _arrays(rows(), TREE)


def with_tree(df: DataFrame, source_col: str, language: str = "python", name: str = "tree") -> DataFrame:
    """Adds the packed tree of ``source_col`` and its two fingerprints; null where it does not parse."""
    parser = PARSERS[language]

    @arrow_udf(f"struct<nodes: {PACKED}, fp_exact: string, fp_shape: string>")
    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _built(batches, parser)

    return df.withColumn(name, _once(build)(F.col(source_col)))


def nodes(df: DataFrame, keys: list[str], tree: str = "tree") -> DataFrame:
    """One row per node; a node's descendants are those with dfs in (dfs, last]."""
    return df.select(*keys, F.inline(F.col(tree)["nodes"]))


def leaves(found: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes without children: their interval is themselves."""
    return found.where("dfs = last")


def paths(df: DataFrame, keys: list[str], tree: str = "tree") -> DataFrame:
    """(…keys, dfs, path): each leaf's types from the root down, by one pass over the packed nodes."""
    packed = F.col(tree)["nodes"]

    @arrow_udf("array<struct<dfs: int, path: string>>")
    def climb(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def listed(starts, ends, names) -> list[dict]:
            out, open_ = [], []
            for s, e, name in zip(starts, ends, names, strict=True):
                while open_ and open_[-1][0] < s:
                    open_.pop()
                open_.append((e, f"{open_[-1][1]}/{name}" if open_ else name))
                if s == e:
                    out.append({"dfs": s, "path": open_[-1][1]})
            return out

        def rows() -> Iterator[tuple[list[dict] | None, int]]:
            for columns in batches:
                for row in zip(*columns, strict=True):
                    found = listed(*(x.as_py() for x in row)) if row[0].is_valid else None
                    yield found, sum(1 + len(x["path"]) // CHARACTERS for x in found or ())

        return _arrays(rows(), pa.list_(pa.struct({"dfs": pa.int32(), "path": pa.string()})))

    return df.select(*keys, F.inline(climb(packed["dfs"], packed["last"], packed["type"])))


def _pairwise(schema: str, kernel: Callable[[Tree | None, Tree | None], object]):
    @pandas_udf(schema)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[int, Tree | None] = {}

        def tree(x) -> Tree | None:
            if x is None:
                return None
            if id(x) not in seen:
                seen[id(x)] = unpack([dict(zip(NODE_FIELDS, r, strict=True)) if isinstance(r, tuple) else r for r in x])
            return seen[id(x)]

        return pd.Series([kernel(tree(x), tree(y)) for x, y in zip(a, b, strict=True)])

    return run


def tree_dice(a: Column, b: Column, structural: bool = False) -> Column:
    """Dice similarity of two packed trees from the root down; null where one is null."""
    return _pairwise("double", lambda x, y: kernels.dice(x, y, structural))(a, b)


def tree_leaf_similarity(a: Column, b: Column, structural: bool = False) -> Column:
    return _pairwise("double", lambda x, y: kernels.leaf_similarity(x, y, structural))(a, b)


def tree_matches(a: Column, pattern: Column) -> Column:
    """Whether a tree holds an embedding of the pattern's body."""
    return _pairwise("boolean", lambda x, p: x is not None and p is not None and bool(kernels.embeddings(x, p, 1)))(a, pattern)


def tree_generalise(a: Column, b: Column) -> Column:
    """The least general pattern of two packed trees, packed."""
    return _pairwise(PACKED, lambda x, y: None if x is None or y is None else pack(kernels.generalise(x, y)))(a, b)


def tree_tokens(tree: Column, structural: bool = False) -> Column:
    """A packed tree as a set of 64-bit tokens, one a node: its label, the way to it from the root, and how many siblings its fields have on the way.

    Nodes of two trees pair off from the root down exactly where they have a
    token in common, so Dice of the sets is tree_dice. ``structural`` takes
    types for labels. Tokens are hashes; trees of up to 2**16 nodes have unequal
    ones with a probability of 1 - 2**-32.
    """

    return _tokens_of(lambda x: x, structural)(tree)


def source_tokens(source: Column, language: str = "python", structural: bool = False) -> Column:
    """The tree_tokens of a source's tree, which does not leave the task that parses it; null where it does not parse."""
    parser = PARSERS[language]

    def packed(text: str) -> list[dict] | None:
        t = parser(text)
        return None if t is None else pack(t)

    return _tokens_of(packed, structural)(source)


def _tokens_of(packed: Callable[[object], list[dict] | None], structural: bool):
    """The column of tokens of what ``packed`` makes of a value."""

    def tokens(rows: list[dict]) -> list[int]:
        wide = Counter((r["parent"], r["role"]) for r in rows)
        out: dict[int | None, bytes] = {None: b""}
        for r in rows:  # in pre-order
            label = Tree(r["kind"], r["type"]).type_class if structural else repr((r["kind"], r["type"], r["value"], r["vtype"]))
            own = repr((label, r["role"], r["place"], wide[r["parent"], r["role"]]) if r["parent"] is not None else label)
            out[r["dfs"]] = hashlib.blake2b(out[r["parent"]] + own.encode(), digest_size=8).digest()
        return sorted(int.from_bytes(x, "little", signed=True) for k, x in out.items() if k is not None)

    @arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def rows() -> Iterator[tuple[list[int] | None, int]]:
            for b in batches:
                for x in b:
                    nodes = packed(x.as_py()) if x.is_valid else None
                    yield (None, 0) if nodes is None else (tokens(nodes), len(nodes))

        return _arrays(rows(), pa.list_(pa.int64()))

    return _once(run)


def tree_classes(trees: DataFrame, key: str, tree: str = "tree", structural: bool = False) -> DataFrame:
    """(key, class, tokens): trees with equal tokens are a class, named by its least key."""
    return token_classes(trees.select(key, tree_tokens(F.col(tree)["nodes"], structural).alias("tokens")), key)


def token_classes(told: DataFrame, key: str) -> DataFrame:
    """tree_classes of (key, tokens) from tree_tokens or source_tokens."""
    told = told.where("tokens is not null").withColumn("same", F.sha2(F.array_join("tokens", ","), 256))
    told = materialise(told, "tokens")
    names = told.groupBy("same").agg(F.min(key).alias("class"))
    return told.join(names, "same").select(key, "class", "tokens")


def similar_trees(classes: DataFrame, key: str, least: float) -> DataFrame:
    """(a, b, na, nb, common, dice) for a < b: classes of trees (see tree_classes) with a Dice similarity of ``least`` or more from the root down.

    A join of token sets by their sketches (relational.dice_pairs), so trees of
    unlike shape meet too. Equal
    trees are one class with na or nb members: they never meet in pairs.
    """
    one = classes.groupBy("class").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"))
    one = materialise(one.select(F.col("class").alias(key), "n", "tokens"), "classes")
    pairs = dice_pairs(one, key, "tokens", [], least)
    size = lambda k: one.select(F.col(key).alias(k), F.col("n").alias(f"n{k}"))
    return pairs.join(size("a"), "a").join(size("b"), "b").select("a", "b", "na", "nb", "common", "dice")


def blocked_pairs(trees: DataFrame, key: str, block: list[str], tree: str = "tree") -> DataFrame:
    """(a, b, ta, tb) for a < b of one block: only there can a similarity count."""
    left, right = (trees.select(*block, F.col(key).alias(k), F.col(tree)["nodes"].alias(t)) for k, t in (("a", "ta"), ("b", "tb")))
    return left.join(right, block).where("a < b")
