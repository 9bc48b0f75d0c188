"""The similarity join of trees against all pairs compared node by node."""

import random

import pytest

from arborlake.functions.kernels import dice
from arborlake.operators import trees
from arborlake.operators.trees import parse_html


def some_page(pick, depth=3):
    tag = pick.choice(["div", "p", "ul", "b"])
    inner = [some_page(pick, depth - 1) if depth and pick.random() < 0.7 else pick.choice(["x", "y", "z"]) for _ in range(pick.randint(1, 3))]
    return f"<{tag}>{''.join(inner)}</{tag}>"


def changed(pick, page):
    """The page with an element more, or a text or a tag changed."""
    k = pick.choice(["<i>new</i>", "more"])
    at = pick.choice([i for i, c in enumerate(page) if c == ">"]) + 1
    return page[:at] + k + page[at:]


@pytest.mark.parametrize("structural", [False, True])
def test_join_equals_all_pairs(spark, structural):
    pick = random.Random(3)
    pages = [some_page(pick) for _ in range(25)]
    pages += [changed(pick, p) for p in pages for _ in range(2)] + pages[:5] * 2
    rows = [(k, p) for k, p in enumerate(pages)] + [(900, None), (901, "")]
    df = trees.with_tree(spark.createDataFrame(rows, "page_id long, html string"), "html", "html")
    classes = trees.tree_classes(df, "page_id", structural=structural)
    of = {r["page_id"]: r["class"] for r in classes.collect()}
    built = {k: parse_html(p) for k, p in rows if p is not None}
    like = {(a, b): dice(built[a], built[b], structural) for a in built for b in built if a < b}
    assert all((of[a] == of[b]) == (d == 1) for (a, b), d in like.items()) and 900 not in of
    got = {(r["a"], r["b"]): (r["na"], r["nb"], r["dice"]) for r in trees.similar_trees(classes, "page_id", 0.8).collect()}
    size = {c: sum(x == c for x in of.values()) for c in of.values()}
    want = {(a, b): (size[a], size[b], d) for (a, b), d in like.items() if d >= 0.8 and of[a] == a and of[b] == b and of[a] != of[b]}
    rounded = lambda x: {k: (*v[:2], round(v[2], 9)) for k, v in x.items()}
    assert rounded(got) == rounded(want) and len(want) > 3
    # pages that differ by an element are found though their shapes differ
    assert any(built[a].size != built[b].size for a, b in got)
