"""Whole lines written anew at every indent that parses; inclusions through the index of nodes."""

import ast
import random
import time
from itertools import islice, product

import pytest
from test_mining import some_templates

from arborlake.functions import kernels, rewriting
from arborlake.functions.trees import is_parsable
from arborlake.plans import mining, patching

PARTS = ["x = 1", "if x:", "else:", "for k in x:", "return x", "try:", "finally:", "y = f(", "a, b)", "", "# note", "s = '''t", "u'''", "while x:", "pass", "z = [", "]", "def g():", "a b", "v = \\", "@d", "1)"]
AROUND = [([], []), (["def f(x):"], ["    return 1"]), (["def f(x):", "    if x:"], ["        y = 2", "    return y", ""]), (["class C:", "    def f(self):", "        while 1:"], ["    z = 3"]), (["x = (1,"], ["2)"])]


def every_indent(before, parts, after):
    for levels in product(range(4), repeat=len(parts)):
        text = "\n".join([*before, *(" " * 4 * n + p for n, p in zip(levels, parts, strict=True)), *after])
        if is_parsable(text):
            yield text


@pytest.mark.parametrize("seed", range(6))
def test_indents_equal_all_combinations(seed):
    pick = random.Random(seed)
    for _ in range(60):
        before, after = pick.choice(AROUND)
        parts = [pick.choice(PARTS) for _ in range(pick.randint(0, 4))]
        got, want = list(rewriting.indented(before, parts, after)), set(every_indent(before, parts, after))
        assert len(got) == len(set(got)) and set(got) <= want
        assert {ast.dump(ast.parse(t)) for t in got} == {ast.dump(ast.parse(t)) for t in want}


def test_indents_that_matter_are_all_there():
    for before, after in AROUND[:4]:
        parts = ["if x:", "y = 1", "else:", "y = 2", "z = 3"]
        assert set(rewriting.indented(before, parts, after)) == set(every_indent(before, parts, after))


def test_twelve_lines_need_few_trials(monkeypatch):
    tried, whole = [], rewriting._begins
    monkeypatch.setattr(rewriting, "_begins", lambda t: tried.append(1) or whole(t))
    parts = ["if x:", "y = 1", "for k in y:", "if k:", "z = k", "else:", "z = 2", "w = z", "while w:", "w = f(", "w)", "v = w"]
    got = list(rewriting.indented(["def f(x):"], parts, ["    return v"]))
    assert got and len(tried) < 4**12 // 1000 and all(map(is_parsable, got))
    start = time.time()
    many = rewriting.indented(["def f(x):"], ["s = '''a", *["b"] * 40, "'''"], [""])
    assert len(list(islice(many, 5))) == 5 and time.time() - start < 5  # 4^40 of them, one after another


def test_line_prompts():
    source = "import a\ndef f(x):\n    y = a.g(x)\n    return y\n"
    p = rewriting.line_prompt(source, [3])
    assert p == {"prompt": '"""y = a.g(x)""" import a def f(x): <extra_id_0> return y', "masks": 1, "max_length": 128, "min_length": 2}
    assert rewriting.line_prompt(source, [3, 4])["masks"] == rewriting.line_prompt(source, [4], 1)["masks"] == 2
    assert rewriting.line_prompt(source, [3], 2)["prompt"].index("y = a.g(x) <extra_id_0>") > 0
    assert rewriting.line_prompt("a\n" * 99 + "b\n" * 99, [99], budget=20)["prompt"].count("b") == 8
    assert rewriting.line_prompt("w " * 500, [1]) is None
    assert list(rewriting.fill_lines(source, [3], "<extra_id_0> y = 5")) == ["import a\ndef f(x):\n    y = 5\n    return y\n"]
    guard = "import a\ndef f(x):\n    y = a.g(x)\n{}if y is None:\n{}y = 0\n    return y\n"
    blanks = [(" " * p, " " * q) for p, q in ((0, 4), (4, 8), (4, 12))]  # at the first of these the return is the guard's
    assert list(rewriting.fill_lines(source, [4], "<extra_id_0> if y is None: <extra_id_1> y = 0", 1)) == [guard.format(*b) for b in blanks]
    assert list(rewriting.fill_lines(source, [3, 4], "<extra_id_0> y")) == []


def test_line_attempts(spark):
    source = "def f(x):\n    y = x\n    return y\n"
    rows = [("a", source, [2], 0), ("b", source, [3], 1), ("c", "w " * 500, [1], 0), ("d", source, [2], None), ("e", source, None, 0), ("f", "slow\n", [1], 0), ("g", None, [1], 0), ("h", source, [], 0)]

    def model(prompts):
        if "slow" in prompts[0]["prompt"]:
            while True:
                pass
        return [["<extra_id_0> y = 1 <extra_id_1> y = 2", "<extra_id_0> y = 1 <extra_id_1> y = 2", "<extra_id_0> )"]]

    cases = spark.createDataFrame(rows, "case string, source string, lines array<int>, added int")
    got = {}
    for r in patching.line_attempts(cases, model, seconds=2).collect():
        got.setdefault(r["case"], set()).add((r["candidate"], r["reason"]))
    fixed = {("def f(x):\n    y = 1\n    return y\n", None)}
    assert got["a"] == got["d"] == fixed
    assert got["b"] == {("def f(x):\n    y = x\n    y = 1\n    y = 2\n    return y\n", None)}
    assert {k: next(iter(v))[1] for k, v in got.items() if k in "cefgh"} == {"c": "no prompt within the budget", "e": "no lines", "f": "out of time", "g": "no lines", "h": "no lines"}
    assert patching.line_attempts(cases, model, done=cases.where("case <> 'a'")).count() == 1


def test_inclusions_equal_all_pairs(spark):
    trees = {}
    found = [mining.load_template(r) for r in some_templates(21, 60)]
    sides = [t.before for t in found if t.before is not None]
    for k, t in enumerate(sides):
        trees[f"a{k}"] = t
        trees[f"b{k}"] = kernels.generalise(t, sides[(7 * k + 3) % len(sides)])
        trees[f"c{k}"] = kernels.generalise(t, sides[(5 * k + 1) % len(sides)])
    trees = {k: t for k, t in trees.items()} | {"n1": None, "n2": None}
    group = {k: "x" if k[0] in "abn" or k.endswith("3") else "y" for k in trees}
    table = spark.createDataFrame([(k, group[k], mining.dump_tree(t)) for k, t in trees.items()], "template_id string, g string, tree string")
    got = [(r["lower"], r["upper"]) for r in patching.inclusions(table, "tree", ["g"]).collect()]
    holds = lambda a, b: (a is None and b is None) or (a is not None and b is not None and kernels.includes(a, b))
    want = {(a, b) for a in trees for b in trees if a != b and group[a] == group[b] and holds(trees[a], trees[b])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(trees)
    assert patching.inclusions(table.limit(0), "tree", ["g"]).count() == 0
