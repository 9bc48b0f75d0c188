"""Pairs of similar sets by sketches against all pairs, and what the plan shuffles."""

import random

import pytest

from arborlake.operators import relational as rel


@pytest.mark.parametrize("least", [0.8, 0.5, 1.0])
def test_pairs_equal_all_pairs(spark, least):
    pick = random.Random(5)
    sets = [frozenset(f"w{pick.randrange(4 * n)}" for _ in range(n)) for n in (1, 2, 5, 40, 130, 190, 900) for _ in range(3)]
    sets += [frozenset(x for x in s if pick.random() < keep) | {f"v{pick.randrange(9)}"} for s in sets for keep in (0.7, 0.85, 0.99)] + sets[::3]
    rows = [(f"d{k}", pick.choice("xy"), sorted(s)) for k, s in enumerate(sets)] + [(None, "x", ["a"]), ("n0", None, ["a"]), ("n1", None, ["a"]), ("e0", "x", []), ("e1", "x", [])]
    df = spark.createDataFrame(rows, "doc string, b string, items array<string>")
    want = {}
    for a, p, s in rows:
        for b, q, t in rows:
            if None not in (a, b, p, q) and p == q and a < b and s and t and (d := 2 * len({*s} & {*t}) / (len(s) + len(t))) >= least:
                want[p, a, b] = (len({*s} & {*t}), d)
    got = {(r["b_"], r["a"], r["b"]): (r["common"], r["dice"]) for r in rel.dice_pairs(df.withColumnRenamed("b", "b_"), "doc", "items", ["b_"], least).collect()}
    assert got == want and want


def test_items_are_not_dealt_out(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"])], "k long, items array<string>")
    found = rel.dice_pairs(df, "k", "items", [], 0.8)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 2, 2, 1.0)]
