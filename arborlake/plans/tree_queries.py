"""Queries of the tree algebra over pages, and over code written for the rows of given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import trees
from ..session import materialise, table
from . import mining, patching

#: (case, before, after, content, start of the hunk before, and after)
CHANGES = [
    ("wrap1", "def f(e):\n    return json(e.errors())\n", "def f(e):\n    return json(encode(e.errors()))\n", "-    return json(e.errors())\n+    return json(encode(e.errors()))", 2, 2),
    ("wrap2", "def g(x):\n    return json(x.items())\n", "def g(x):\n    return json(encode(x.items()))\n", "-    return json(x.items())\n+    return json(encode(x.items()))", 2, 2),
    ("guard1", "def f(a):\n    if a.body:\n        return 1\n", "def f(a):\n    if a.body and a.ready:\n        return 1\n", "-    if a.body:\n+    if a.body and a.ready:", 2, 2),
    ("guard2", "def h(b):\n    if b.text:\n        return 2\n", "def h(b):\n    if b.text and b.open:\n        return 2\n", "-    if b.text:\n+    if b.text and b.open:", 2, 2),
    ("cast1", "def f(n):\n    s = 'a' + n\n    return s\n", "def f(n):\n    s = 'a' + str(n)\n    return s\n", "-    s = 'a' + n\n+    s = 'a' + str(n)", 2, 2),
    ("cast2", "def k(m):\n    t = 'b' + m\n    return t\n", "def k(m):\n    t = 'b' + str(m)\n    return t\n", "-    t = 'b' + m\n+    t = 'b' + str(m)", 2, 2),
    ("none1", "def f(x):\n    y = x.get(1)\n    return y.z\n", "def f(x):\n    y = x.get(1)\n    if y is None:\n        return None\n    return y.z\n", "+    if y is None:\n+        return None", 3, 3),
    ("none2", "def q(u):\n    v = u.get(2)\n    return v.w\n", "def q(u):\n    v = u.get(2)\n    if v is None:\n        return None\n    return v.w\n", "+    if v is None:\n+        return None", 3, 3),
]

#: Kinds of changes in code, for names V, W and a number N: (kind, before, after, content of the hunk, its line before and after, outline of the tree after).
KINDS = [
    ("wrap", "def f(V):\n    return json(V.W())\n", "def f(V):\n    return json(encode(V.W()))\n", "-    return json(V.W())\n+    return json(encode(V.W()))", 2, 2, "Root\n FunctionDef\n  Variable f\n  Variable V\n  Return\n   Call\n    Variable json\n    Call\n     Variable encode\n     Call\n      Attribute V.W"),
    ("guard", "def f(V):\n    if V.W:\n        return N\n", "def f(V):\n    if V.W and V.ready:\n        return N\n", "-    if V.W:\n+    if V.W and V.ready:", 2, 2, "Root\n FunctionDef\n  Variable f\n  Variable V\n  If\n   BoolOp\n    Op And\n    Attribute V.W\n    Attribute V.ready\n   Return\n    Literal N"),
    ("cast", "def f(V):\n    s = 'W' + V\n    return s\n", "def f(V):\n    s = 'W' + str(V)\n    return s\n", "-    s = 'W' + V\n+    s = 'W' + str(V)", 2, 2, "Root\n FunctionDef\n  Variable f\n  Variable V\n  Assign\n   Variable s\n   BinOp\n    Literal 'W'\n    Op Add\n    Call\n     Type str\n     Variable V\n  Return\n   Variable s"),
    ("none", "def f(V):\n    x = V.get(N)\n    return x.W\n", "def f(V):\n    x = V.get(N)\n    if x is None:\n        return None\n    return x.W\n", "+    if x is None:\n+        return None", 3, 3, "Root\n FunctionDef\n  Variable f\n  Variable V\n  Assign\n   Variable x\n   Call\n    Attribute V.get\n    Literal N\n  If\n   Compare\n    Variable x\n    Op Is\n    Type None\n   Return\n    Type None\n  Return\n   Attribute x.W"),
    ("keyword", "def f(V):\n    return V.load(W)\n", "def f(V):\n    return V.load(W, safe=True)\n", "-    return V.load(W)\n+    return V.load(W, safe=True)", 2, 2, "Root\n FunctionDef\n  Variable f\n  Variable V\n  Return\n   Call\n    Attribute V.load\n    Variable W\n    Keyword safe\n     Literal True"),
]

#: (pattern, two snippets that it generalises)
PATTERNS = [
    ("call", "return json(encode(a.b()))", "return json(encode(c.d()))"),
    ("test", "if a is None:\n    return None", "if b is None:\n    return None"),
    ("text", "s = 'p' + str(a)", "t = 'q' + str(b)"),
    ("both", "if a.x and a.y:\n    return 3", "if b.v and b.w:\n    return 4"),
    ("three", "a = c.f(1)\nif a is None:\n    return None\nreturn a.x", "b = d.g(2)\nif b is None:\n    return None\nreturn b.y"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _pages(spark, sf_dir):
    return trees.with_tree(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "html").drop("html")


def _classes(spark, sf_dir):
    """(page_id, class, tokens) of the pages' shapes."""
    return trees.token_classes(table(spark, sf_dir, "pages").select("page_id", trees.source_tokens(F.col("html"), "html", structural=True).alias("tokens")), "page_id")


@query
def html_tree_nodes(spark, sf_dir):
    return trees.nodes(_pages(spark, sf_dir), ["page_id"]).select("page_id", "dfs", "last", "parent", "depth", "kind", "type")


@query
def html_leaf_paths(spark, sf_dir):
    return trees.paths(_pages(spark, sf_dir), ["page_id"])


@query
def html_tree_classes(spark, sf_dir):
    """Pages whose trees have one shape, texts and attributes apart: the class of each page."""
    return _classes(spark, sf_dir).select("page_id", "class")


@query
def html_tree_dice(spark, sf_dir):
    """Similarity of page shapes from the root down, 0.8 or more: pairs of classes, with the number of pages of each."""
    return trees.similar_trees(_classes(spark, sf_dir), "page_id", 0.8)


def _filled(text: Column) -> Column:
    """A text of KINDS with a row's names v, w and number n."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bV\b", F.col("v")), r"\bW\b", F.col("w")), r"\bN\b", F.col("n").cast("string"))


def _of_kind(k: int) -> Column:
    """Field ``k`` of a row's entry in KINDS."""
    return F.element_at(F.array(*[F.lit(x[k]) for x in KINDS]), F.col("kind") + 1)


def _named(spark, sf_dir, name: str, key: str, nation: str, mark: str) -> DataFrame:
    """(case, kind, v, w, n) for each row of a table: what its code is about, from its key and nation."""
    own = table(spark, sf_dir, name).select(F.col(key).alias("case"), F.col(nation).alias("nation"))
    return own.select("case", (F.col("case") % len(KINDS)).cast("int").alias("kind"), F.concat(F.lit(mark), F.col("nation").cast("string")).alias("v"), F.concat(F.lit("w"), (F.col("case") % 7).cast("string")).alias("w"), (F.col("case") % 3).alias("n"))


def _changes(spark, sf_dir):
    """A change of code for each customer."""
    rows = _named(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "v")
    return rows.withColumns({"before_source": _filled(_of_kind(1)), "after_source": _filled(_of_kind(2)), "content": _filled(_of_kind(3))})


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as a shuffle has: few bytes may be much work for a parser, so sizes alone do not deal it well."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@query
def tree_match(spark, sf_dir):
    """How many of the customers' changed sources of each kind hold each pattern, generalised from two snippets; equal sources are parsed and tried once."""
    texts = _dealt(_changes(spark, sf_dir).groupBy("kind", "after_source").agg(F.count("*").alias("n")))
    sources = trees.with_tree(texts, "after_source").select("kind", "n", F.col("tree")["nodes"].alias("t"))
    snippets = spark.createDataFrame(PATTERNS, "pattern string, one string, other string")
    parsed = [trees.with_tree(snippets.select("pattern", c), c).select("pattern", F.col("tree")["nodes"].alias(c)) for c in ("one", "other")]
    patterns = parsed[0].join(parsed[1], "pattern").select("pattern", trees.tree_generalise("one", "other").alias("p"))
    held = sources.join(F.broadcast(patterns)).select("pattern", "kind", "n", trees.tree_matches("t", "p").alias("held"))  # as many patterns as PATTERNS
    return held.groupBy("pattern", "kind").agg(F.sum("n").alias("sources"), F.sum(F.col("held").cast("long") * F.col("n")).alias("matches"))


@query
def anti_unify(spark, sf_dir):
    """The least general pattern of each customer's changed source and that of the next customer of its kind; equal pairs of sources are generalised once.

    Joins are by merging: what a tree takes in memory is many times the size
    that Spark reckons for a source, so neither side may be broadcast.
    """
    own = _changes(spark, sf_dir).select("case", F.col("after_source").alias("one"))
    other = own.select((F.col("case") - len(KINDS)).alias("case"), F.col("one").alias("other"))
    pairs = materialise(own.join(other.hint("merge"), "case"), "pairs")
    parsed = trees.with_tree(trees.with_tree(_dealt(pairs.select("one", "other").distinct()), "one", name="t"), "other", name="u")
    patterns = materialise(parsed.select("one", "other", trees.tree_generalise(F.col("t")["nodes"], F.col("u")["nodes"]).alias("p")), "patterns")
    return pairs.join(patterns.hint("merge"), ["one", "other"]).select("case", F.inline("p")).select("case", "dfs", "last", "type", "value")


def _found(spark, sf_dir) -> DataFrame:
    """The templates of the customers' changes that differ in their code, with the number of customers of each as ``copies``."""
    texts = ["before_source", "after_source", "content", "b_start", "a_start"]
    every = _changes(spark, sf_dir).withColumns({"b_start": _of_kind(4), "a_start": _of_kind(5)})
    some = materialise(_dealt(every.groupBy(*texts).agg(F.min("case").alias("case"), F.count("*").alias("copies"))), "changes")
    rows = some.withColumns({"before_path": F.lit("m.py"), "after_path": F.lit("m.py"), "loc": F.lit("")})
    sources = rows.select("case", "copies", "before_path", "after_path", "before_source", "after_source")
    hunks = rows.select("case", "copies", "before_path", "after_path", "loc", "content", "b_start", "a_start")
    return mining.change_templates(hunks, sources, ["case", "copies"])[0]


@query
def template_fixpoint(spark, sf_dir):
    """Templates mined from the customers' changes: the most general one of each shape that changes have, and the roots."""
    found = _found(spark, sf_dir)
    forest = materialise(mining.mine(found, copies="copies"), "forest")
    shapes = found.select("action", "fp_shape").distinct()
    tops = patching.shaped(forest).join(shapes, ["action", "fp_shape"]).groupBy("action", "fp_shape").agg(F.max("instances").alias("instances"))
    roots = forest.where("parent_id is null").select(F.lit("root").alias("what"), "action", "instances")
    return tops.select(F.lit("shape").alias("what"), "action", "instances").unionByName(roots)


@query
def patch_rewrite(spark, sf_dir):
    """Code of suppliers patched by templates mined from customers' changes: the patches that are what a change of that kind makes; equal code is patched once."""
    forest = materialise(mining.mine(_found(spark, sf_dir), copies="copies"), "forest")
    rows = _named(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s")
    own = materialise(rows.select(F.col("case").cast("string").alias("case"), "kind", _filled(_of_kind(1)).alias("source"), F.regexp_replace(_filled(_of_kind(2)), r"\n\z", "").alias("fixed"), _of_kind(4).alias("line")), "suppliers")
    code = ["kind", "source", "fixed", "line"]
    some = materialise(_dealt(own.groupBy(*code).agg(F.min("case").alias("case"))), "code")
    # a guard's second attribute is new, so it is a mask and no such patch
    made = patching.patches(some.select("case", "source", F.array("line").alias("lines"), (F.col("kind") == 3).alias("added")), forest)
    fixed = made.join(some.withColumn("before", F.col("source")).withColumn("source", F.col("fixed")), ["case", "source"]).select(*[F.col("before" if c == "source" else c).alias(c) for c in code], "action").distinct()
    return own.join(fixed, code).select("case", "action", F.col("fixed").alias("source")).distinct()


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) v({columns})"


def _outline(kind: int, text: str) -> list[tuple]:
    """(kind, dfs, last, type, value) rows of an indented outline: a line for a node, a blank a level."""
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip()) for x in lines]
    rows = []
    for k, x in enumerate(lines):
        last = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines)) - 1
        type_, _, value = x.strip().partition(" ")
        rows.append((kind, k, last, type_, value or None))
    return rows


def _fill_sql(text: str, row: str, mark: str = "v") -> str:
    for name, value in (("V", f"'{mark}' || {row}.nation"), ("W", f"'w' || ({row}.k % 7)"), ("N", f"({row}.k % 3)::VARCHAR")):
        text = f"regexp_replace({text}, '\\b{name}\\b', {value}, 'g')"
    return text


_PEOPLE = "(SELECT c_custkey AS k, c_nationkey AS nation, (c_custkey % 5)::INTEGER AS kind FROM customer)"
_SUPPLIERS = "(SELECT s_suppkey AS k, s_nationkey AS nation, (s_suppkey % 5)::INTEGER AS kind FROM supplier)"
#: The action of each kind of change, and what its root is: those of one action differ in their numbers of trees, or in whether they share a context.
_ACTIONS = _values("kind, action, root", [(0, "Replace", "Replace by two"), (1, "Insert", "Insert"), (2, "Replace", "Replace"), (3, "Add", "Add"), (4, "Add", "Add within")])

ORACLE_SQL = {
    "tree_match": f"SELECT pattern, kind, count(*) AS sources, (count(*) * (kind = holder)::INT)::BIGINT AS matches FROM {_PEOPLE} c, {_values('pattern, holder', [('call', 0), ('test', 3), ('text', 2), ('both', 1), ('three', 3)])} GROUP BY pattern, kind, holder",
    "anti_unify": f"""SELECT a.k AS "case", dfs::INTEGER AS dfs, last::INTEGER AS last, type,
        CASE WHEN {_fill_sql("value", "a")} = {_fill_sql("value", "b")} THEN {_fill_sql("value", "a")} WHEN type = 'Literal' THEN CASE WHEN starts_with(value, chr(39)) THEN 'str' ELSE 'int' END WHEN value IS NOT NULL THEN 'ABSTRACTED' END AS value
      FROM {_PEOPLE} a JOIN {_PEOPLE} b ON b.k = a.k + 5 JOIN {_values("kind, dfs, last, type, value", [r for k, x in enumerate(KINDS) for r in _outline(k, x[6])])} ON v.kind = a.kind""",
    "template_fixpoint": f"""WITH c AS (SELECT kind, action, root FROM {_PEOPLE} JOIN {_ACTIONS} USING (kind))
      SELECT 'shape' AS what, action, count(*) AS instances FROM c GROUP BY kind, action UNION ALL SELECT 'root', action, count(*) FROM c GROUP BY root, action""",
    "patch_rewrite": f"""SELECT k::VARCHAR AS "case", action, regexp_replace({_fill_sql("after", "s", "s")}, chr(10) || '$', '') AS source
      FROM {_SUPPLIERS} s JOIN {_ACTIONS} USING (kind) JOIN {_values("kind, after", [(k, x[2]) for k, x in enumerate(KINDS)]).replace(") v(", ") w(")} USING (kind) WHERE kind <> 1""",
}
