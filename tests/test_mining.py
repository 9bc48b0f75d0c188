"""The forest of templates in tables against the same rounds in memory."""

import random

import numpy as np
import pytest
from forests import forest_rows, mine_by_hand, outline
from test_edits import hunk, some_change, some_source

from arborlake.functions.changes import Template, mine_change, tied_nodes
from arborlake.functions.trees import parse, root
from arborlake.functions.vocabulary import REFERRED
from arborlake.plans import mining


def some_templates(seed, n):
    pick, out = random.Random(seed), []
    while len(out) < n:
        before = some_source(pick)
        h = hunk(before, after := some_change(pick, before))
        t = mine_change(before, after, *h)[0] if h else None
        if t is not None:
            out.append(mining.template_row(t))
    return out


def table(spark, rows):
    names = [c.split()[0] for c in mining.TEMPLATE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], mining.TEMPLATE_SCHEMA)


def test_blocks_equal_plain_rounds(spark):
    rows = some_templates(3, 300)
    got = [r.asDict() for r in mining.mine(table(spark, rows)).collect()]
    assert outline(got) == outline(forest_rows(rows))
    by = {r["template_id"]: r for r in got}
    assert len(by) == len(got) and sum(r["instances"] for r in got if r["parent_id"] is None) == 300
    below: dict = {}
    for r in got:
        below.setdefault(r["parent_id"], []).append(r)
    for r in got:
        assert r["instances"] >= sum(x["instances"] for x in below.get(r["template_id"], []))


def test_tables_equal_plain_rounds(spark, monkeypatch):
    """Blocks of over ``alone`` templates go through rounds in tables, with tiles of four."""
    monkeypatch.setattr(mining, "TILE", 4)
    rows = some_templates(3, 24)
    asked = []
    whole = mining._round
    monkeypatch.setattr(mining, "_round", lambda *a: asked.append(a) or whole(*a))
    assert outline([r.asDict() for r in mining.mine(table(spark, rows), alone=8).collect()]) == outline(forest_rows(rows))
    assert len(asked) > 2


@pytest.mark.parametrize("step", ["outer", "within", "pattern", "before", "after"])
def test_partners_are_the_best_of_all(step):
    own = [(f"k{i:03}", mining.load_template(r)) for i, r in enumerate(some_templates(5, 120)) if step != "within" or r["within"]]
    half = len(own) // 2
    for one, two in ((own, None), (own[:half], own[half:])):
        got = {k: (s, p) for k, p, s in mining.nearest_partners(step, one, two)}
        for left, right in ((one, two or one), *(((two, one),) if two else ())):
            for k, t in left:
                score, partner = min((-mining.step_score(step, t, u), j) for j, u in right if j != k)
                assert got[k] == (-score, partner)


def written(action, before, after, within=None):
    b, a = (None if x is None else root(parse(x).children) for x in (before, after))
    return mining.template_row(Template(action, b, a, links=tied_nodes(b, a, None)))


def test_insert_steps():
    """Before sides come first, the after side fixed; then after sides of one shape; then any; then without context."""
    fixed = [written("Insert", f"f({x})", "g(f)") for x in ("a", "b.c")]
    forest = mine_by_hand(fixed)
    (top,) = [r for r, p, n in forest.values() if p is None and n == 2]
    assert mining.load_tree(top["after"]).children[0].size == 4 and top["fp_after"] == fixed[0]["fp_after"] and top["before"] != fixed[0]["before"]
    shaped = [written("Insert", f"f({x})", f"g(f({x}))") for x in ("a", "b")]
    forest = mine_by_hand(shaped)
    (top,) = [r for r, p, n in forest.values() if p is None]
    assert REFERRED in top["after"] and top["fp_after_shape"] == shaped[0]["fp_after_shape"]
    # step 4-2-1 returns early: the pair with equal after sides is joined before the more similar pair of shapes
    mixed = [*fixed, written("Insert", "f(a)", "g(h)")]
    forest = mine_by_hand(mixed)
    pair = next(r for r, _, n in forest.values() if n == 2)
    assert pair["fp_after"] == fixed[0]["fp_after"]


def test_mining_keeps_ties(spark):
    rows = [written("Replace", f"x = {v}({v})", f"x = str({v})") for v in "abcd"]
    (top,) = [r for r in mining.mine(table(spark, rows)).collect() if r["parent_id"] is None]
    t = mining.load_template(top.asDict())
    assert t.links and all(len(g) > 1 for g in t.links) and top["instances"] == 4
    assert REFERRED in {n.value for n in t.after.walk()} and np.isfinite(top["instances"])


def test_nothing_to_mine(spark):
    assert mining.mine(table(spark, some_templates(1, 2)).limit(0)).count() == 0
