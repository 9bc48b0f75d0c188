"""Trees leave a task in arrays of bounded size, however many rows a batch has."""

import gc
import weakref

import pyarrow as pa

from arborlake.operators import trees
from arborlake.plans import tree_queries


def test_batches_are_cut(spark):
    page = "<div>" + "<p>x</p>" * 500 + "</div>"
    batch = pa.array([page] * 40 + [None])
    build = trees.with_tree(spark.range(1).selectExpr("'' AS html"), "html", "html") and trees._arrays
    rows = ((None, 0) if x is None else ({"nodes": trees.pack(trees.parse_html(x)), "fp_exact": "a", "fp_shape": "b"}, 1002) for x in batch.to_pylist())
    made = list(build(rows, trees.TREE))
    assert sum(map(len, made)) == 41 and made[-1][-1].as_py() is None
    assert len(made) > 5 and max(len(a.field("nodes").flatten()) for a in made) <= trees.HELD + 1002
    df = spark.createDataFrame([(k, page if k % 7 else None) for k in range(60)], "page_id long, html string").coalesce(1)
    tree = trees.with_tree(df, "html", "html")
    assert trees.nodes(tree, ["page_id"]).groupBy("page_id").count().select("count").distinct().collect()[0][0] == 1002
    assert {r["count"] for r in trees.paths(tree, ["page_id"]).groupBy("page_id").count().collect()} == {500}
    assert trees.tree_classes(tree, "page_id").where("class = 1").count() == 51


def test_a_parsed_page_leaves_no_cycles():
    gc.collect()
    gc.disable()
    try:
        page = trees.parse_html("<div><p>x</p></div>")
        gone = weakref.ref(page.children[0])
        del page
        assert gone() is None
    finally:
        gc.enable()


def test_classes_parse_a_page_once_in_one_worker(spark, tmp_path, monkeypatch):
    pages = [(1, "<p>a</p>"), (2, "<p>b</p>"), (3, "<p><b>a</b></p>"), (4, None), (5, ""), (6, "<p>a</p>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plans = []
    monkeypatch.setattr(trees, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    tree_queries.html_tree_classes(spark, str(tmp_path))
    assert plans[0].count("ArrowEvalPython") == 1
    monkeypatch.undo()
    df = spark.read.parquet(f"{tmp_path}/pages.parquet")
    for structural, want in ((True, {1: 1, 2: 1, 3: 3, 5: 5, 6: 1}), (False, {1: 1, 2: 2, 3: 3, 5: 5, 6: 1})):
        told = trees.token_classes(df.select("page_id", trees.source_tokens(df["html"], "html", structural).alias("tokens")), "page_id")
        by_trees = trees.tree_classes(trees.with_tree(df, "html", "html"), "page_id", structural=structural)
        assert {tuple(r) for r in told.selectExpr("page_id", "class", "array_join(tokens, ',')").collect()} == {tuple(r) for r in by_trees.selectExpr("page_id", "class", "array_join(tokens, ',')").collect()}
        assert {r["page_id"]: r["class"] for r in told.collect()} == want


def test_long_texts_leave_a_task_early():
    page = f"<p>{'word ' * 8000}</p>"
    made = list(trees._built(iter([pa.array([page] * 300 + [None])]), trees.PARSERS["html"]))
    assert sum(map(len, made)) == 301 and made[-1][-1]["nodes"].as_py() is None
    assert max(a.nbytes for a in made) < 2 * 64 * trees.HELD and {len(x["nodes"]) for a in made for x in a.to_pylist()[:-1]} == {3}


def test_nodes_parse_a_page_once(spark, tmp_path):
    spark.createDataFrame([(1, "<p>a</p>"), (2, None), (3, "")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = tree_queries.html_tree_nodes(spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["page_id"], r["dfs"], r["kind"]) for r in df.collect()) == [(1, 0, "Root"), (1, 1, "Element"), (1, 2, "Text"), (3, 0, "Root")]
