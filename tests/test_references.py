"""References, locations, tests' paths and patterns of several trees."""

import ast

from arborlake.functions import edits, locating, rewriting
from arborlake.functions.changes import Template
from arborlake.functions.trees import build, root
from arborlake.operators import passages, references as refs_of
from arborlake.plans import mining, patching, tree_queries
from arborlake.sources import cases

NODES = [  # t: a Root with two statements, each with two names; the second statement's first name has a child
    ("t", 0, None, 0, 6, "Root", None), ("t", 1, 0, 1, 3, "Expr", None), ("t", 2, 1, 2, 2, "Variable", "a"), ("t", 3, 1, 3, 3, "Variable", "b"),
    ("t", 4, 0, 4, 6, "Expr", None), ("t", 5, 4, 5, 6, "Call", None), ("t", 6, 5, 6, 6, "Variable", "a"), ("u", 2, None, 0, 0, "Variable", "a"),
]
EDGES = [("t", 2, 6, "refer_to"), ("t", 6, 2, "referred_from"), ("t", 3, 6, "self_refer"), ("t", 6, 3, "self_refer"), ("t", 2, 9, "refer_to"), ("u", 2, 6, "refer_to"), ("t", 4, 1, "refer_to"), ("t", 1, 4, "referred_from")]


def tables(spark):
    nodes = spark.createDataFrame(NODES, "template_id string, node_id int, parent_id int, dfs int, last int, type string, value string")
    return nodes, spark.createDataFrame(EDGES, "template_id string, src int, dst int, kind string")


def ids(df):
    return sorted((r["template_id"], r["node_id"]) for r in df.collect())


def edges(df):
    return sorted(tuple(r) for r in df.select("template_id", "src", "dst", "kind").collect())


def test_references_resolve_and_select(spark):
    nodes, refs = tables(spark)
    kept, dangling = refs_of.resolved(refs, nodes)
    assert edges(dangling) == [("t", 2, 9, "refer_to"), ("u", 2, 6, "refer_to")] and len(edges(kept)) == 6
    assert ids(refs_of.referring(nodes, kept)) == [("t", k) for k in (1, 2, 3, 4, 6)]
    assert ids(refs_of.referring(nodes, kept, ("refer_to",))) == [("t", 2), ("t", 4)]
    assert ids(refs_of.referring_below(nodes, kept)) == [("t", k) for k in (0, 1, 4, 5)]
    assert ids(refs_of.referring_below(nodes, kept, ("refer_to",))) == [("t", 0), ("t", 1)]
    assert ids(refs_of.pruned(nodes, kept, ("refer_to",))) == [("t", 0), ("t", 1), ("t", 2), ("t", 4)]
    assert ids(refs_of.subtree(nodes, nodes.where("node_id = 4"))) == [("t", 4), ("t", 5), ("t", 6)]


def test_references_are_cleaned_at_both_ends(spark):
    nodes, refs = tables(spark)
    kept, _ = refs_of.resolved(refs, nodes)
    at = lambda *k: spark.createDataFrame([("t", x) for x in k], "template_id string, node_id int")
    assert edges(refs_of.cleaned(kept, at(6))) == [("t", 1, 4, "referred_from"), ("t", 4, 1, "refer_to")]
    assert len(edges(refs_of.cleaned(kept, at(6), "referred_from"))) == 4
    below = edges(refs_of.cleaned_below(kept, nodes, at(1)))  # 1 has referred_from only, its children have not
    assert below == [e for e in edges(kept) if e[1:3] not in ((1, 4), (4, 1))]
    assert edges(refs_of.consistent(kept, nodes)) == [e for e in edges(kept) if e[3] != "self_refer"]
    assert edges(refs_of.consistent(kept.where("kind = 'refer_to'"), nodes, nodes["type"] == "Variable")) == [("t", 2, 6, "refer_to"), ("t", 4, 1, "refer_to")]


def test_insert_references_are_bare(spark):
    nodes, refs = tables(spark)
    kept, _ = refs_of.resolved(refs, nodes)
    changed, left = refs_of.insert_references(nodes, kept, nodes.where("template_id = 't' and node_id = 1"))
    rows = {(r["template_id"], r["node_id"]): (r["type"], r["last"]) for r in changed.collect()}
    assert rows["t", 4] == ("Reference", 4) and ("t", 5) not in rows and ("t", 6) not in rows and rows["u", 2] == ("Variable", 0)
    assert edges(left) == [("t", 1, 4, "referred_from"), ("t", 4, 1, "refer_to")]
    empty, none = refs_of.insert_references(nodes.limit(0), kept.limit(0), nodes.limit(0))
    assert not empty.count() and not none.count()


SOURCE = """import a
import b

def f(x):
    import c
    def g():
        pass
    return x

class K:
    import d
    n = 1
    def m(self):
        return 2
    k = 3

z = 4
y = 5
if z:
    'text'
    'more'
    y = 6

    y = 7
"""


def test_lines_are_put_into_regions():
    module = ast.parse(SOURCE)
    lines = [1, 2, 5, 6, 8, 11, 12, 14, 15, 17, 18, 22]
    assert locating.regions(module, lines) == [[1], [2], [5, 6], [8], [11], [14], [12], [15], [17, 18], [22]]
    assert locating.regions(module, lines, imports=False) == [[5, 6], [8], [14], [12], [15], [17, 18], [22]]
    assert locating.regions(module, [5]) == [[5]]


def test_buggy_lines_are_located(spark):
    bugs = spark.createDataFrame([("c", "m.py", k) for k in (8, 2, 5, 6, 6)] + [("d", "gone.py", 4), ("d", "gone.py", 5)], "case string, file string, line int")
    sources = spark.createDataFrame([("c", "m.py", SOURCE)], "case string, file string, source string")
    got = sorted((r["file"], r["location"], r["lines"]) for r in patching.located(bugs, sources).collect())
    assert got == [("gone.py", 0, [4, 5]), ("m.py", 0, [2]), ("m.py", 1, [5, 6]), ("m.py", 2, [8])]


def test_innermost_blocks_and_places():
    module = ast.parse(SOURCE)
    assert locating.innermost(module, [7]).name == "g" and locating.innermost(module, [12]).name == "K" and locating.innermost(module, [17]) is module
    block, field, at = locating.insertion_place(module, 23)
    assert (type(block), field, at) == (ast.If, "body", 2) and locating.insertion_place(module, 23, False)[2] == 0
    assert locating.insertion_place(module, 3)[1:] == ("body", 1) and locating.insertion_place(module, 24)[1:] == (None, -1)


def test_paths_of_tests(spark):
    module = ast.parse("class A:\n    def t(self): pass\nclass B:\n    async def t(self): pass\ndef t(): pass\n")
    assert locating.test_paths(module, [], ["t"]) == [["A", "t"], ["B", "t"], ["t"]] and locating.test_paths(module, ["B"], ["t"]) == [["B", "t"]]
    rows = spark.createDataFrame([("c", "t.py", ["A"], ["t"]), ("d", "no.py", [], ["t"]), ("e", "bad.py", None, ["t"])], "case string, test_file string, test_class array<string>, test_func array<string>")
    files = spark.createDataFrame([("c", "t.py", "class A:\n    def t(self): pass\n"), ("e", "bad.py", "def (")], "case string, file string, source string")
    assert [tuple(r) for r in cases.test_commands(rows, files).collect()] == [("c", "pytest t.py::A::t")]


def test_case_sources(spark):
    files = spark.createDataFrame([("x/pandas/pandas-12/bug_info.json", '{"git": "g", "code_files": ["a.py", "b.txt"], "fixed_pr_id": "f"}'), ("x/p/p-3/bug_info.json", "no"), ("x/p/p-3/other", "{}")], "path string, text string")
    rows = {r["case"]: r for r in cases.described_cases(files).collect()}
    assert rows["pandas/pandas-12"]["pr"] == 12 and rows["pandas/pandas-12"]["code_files"] == ["a.py"] and rows["p/p-3"]["git"] is None and len(rows) == 2
    calls = spark.createDataFrame([("A.f()",), ("A.e",), ("g()",), (None,)], "call string")
    assert [tuple(r) for r in cases.class_methods(calls).collect()] == [("A", ["e", "f"])]
    marked = spark.createDataFrame([(1, "y"), (2, "n"), (1, "y")], "id int, label string")
    assert [r["id"] for r in cases.labelled(spark.range(4).selectExpr("cast(id as int) id"), marked, ["id"]).collect()] == [1]
    failed = spark.createDataFrame([(f"p/c-{k // 2}", f"f{k}.py") for k in range(7)], "case string, file string")
    scripts = {r["shard"]: r["script"].count("python test.py") for r in cases.test_scripts(failed, 3).collect()}
    assert scripts == {0: 3, 1: 2, 2: 2} and cases.test_scripts(failed.limit(0), 3).count() == 0
    many = sorted([("p/hot", f"f{k:03}.py") for k in range(90)] + [(f"p/c-{k % 40:02}", f"g{k}.py") for k in range(110)])
    got = {r["shard"]: [x.split()[2:] for x in r["script"].split("\n") if x.startswith("python")] for r in cases.test_scripts(spark.createDataFrame(many[::-1], "case string, file string").repartition(5), 7).collect()}
    assert [tuple(x) for k in range(7) for x in got[k]] == many and [len(got[k]) for k in range(7)] == [29] * 4 + [28] * 3


def test_masked_operations_stand_for_plain_expressions():
    eq = lambda a, b: rewriting.masked_equal(ast.parse(a), ast.parse(b))
    assert eq("if x is VALUE_MASK: pass", "if ready: pass") and eq("y = not VALUE_MASK", "y = a.b") and eq("y = VALUE_MASK and z", "y = 3")
    assert not eq("y = VALUE_MASK and z", "y = f()") and not eq("y = a and z", "y = 3")
    assert eq("y = VALUE_MASK", "y = 3 % z") and eq("y = VALUE_MASK", "y = '%s' % z") and not eq("y = VALUE_MASK", "y = x % z")


def test_patterns_of_several_trees_are_applied():
    side = lambda text: root(build(x) for x in ast.parse(text).body)
    source = "def r(e):\n    q = 0\n    a = f(e)\n    p = 1\n    b = g(a)\n    return b\n"
    before, after = side("a = f(e)\nb = g(a)"), side("a = f(e, 1)\nb = h(a)")
    assert edits.apply_in_context(source, Template("Replace", before, after), [3, 4, 5]) == ["def r(e):\n    q = 0\n    a = f(e, 1)\n    p = 1\n    b = h(a)\n    return b"]
    assert edits.apply_in_context(source, Template("Replace", side("b = g(a)\na = f(e)"), after), [3, 4, 5]) == []  # in that order only
    assert edits.apply_in_context(source, Template("Remove", before, None), [3, 5]) == ["def r(e):\n    q = 0\n    p = 1\n    return b"]
    more = side("a = f(e)\nb = g(a)\nc = 2")
    assert edits.apply_in_context(source, Template("Insert", before, more), [3, 5])[0].endswith("b = g(a)\n    c = 2\n    return b")


def test_many_short_items_are_found(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHORT_ITEMS", 3)
    docs = spark.createDataFrame([(1, "ab cd ef"), (1, "xx"), (2, "ab cd ef"), (2, "ab cd ef"), (None, "cd")], "doc_id long, text string")
    items = spark.createDataFrame([(k, w) for k, w in enumerate(["ab", "cd", "ef", "x", "b c", "zz", "ab cd ef"])], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["hits"]) for r in passages.containing(docs, items).collect()}
    assert got == {1: (0, 6), 2: (0, 10), None: (1, 1)}


def test_every_template_fits_its_own_change(spark):
    from test_plans import mined

    forest = {r["template_id"]: r.asDict() for r in mining.mine(mined(spark)).collect()}
    for case, before, _, _, line, _ in tree_queries.CHANGES:
        fits = {k for k, t in forest.items() if t["before"] and edits.fits(before, mining.load_template(t), [line])}
        if not case.startswith("none"):
            assert any(forest[k]["parent_id"] for k in fits) and any(not forest[k]["parent_id"] for k in fits), case
