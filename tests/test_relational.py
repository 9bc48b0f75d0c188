"""Relational kernels and their queries against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from arborlake.operators import passages, relational as rel
from arborlake.plans import relational_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(relational_queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = relational_queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(relational_queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)).values.tolist()), key=repr)
    assert rows(got) == rows(want) and len(got)


def test_interval_join_is_inclusive(spark):
    points = spark.createDataFrame([(k,) for k in (0, 9, 10, 19, 20, 35)], "x long")
    spans = spark.createDataFrame([("a", 0, 9), ("b", 10, 35), ("c", 20, 20)], "n string, lo long, hi long")
    got = {(r["x"], r["n"]) for r in rel.interval_join(points, spans, "x", "lo", "hi", 7).collect()}
    assert got == {(0, "a"), (9, "a"), (10, "b"), (19, "b"), (20, "b"), (20, "c"), (35, "b")}


def test_prefix_join_takes_the_longest(spark):
    left = spark.createDataFrame([("a/b/c",), ("a/bc",), (None,), ("",), ("a",)], "t string")
    right = spark.createDataFrame([("a",), ("a/b",), ("a/b",)], "p string")
    assert {(r["t"], r["p"]) for r in rel.prefix_join(left, right, "t", "p").collect()} == {("a/b/c", "a/b"), ("a/bc", "a"), (None, None), ("", None), ("a", "a")}


def test_last_wins_and_prefer_left(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, at int")
    assert {(r["k"], r["v"]) for r in rel.last_wins_update(base, updates, ["k"], "v", F.col("at")).collect()} == {(1, "y"), (2, "b")}
    other = spark.createDataFrame([(2, "z"), (3, "c"), (3, "d")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in rel.union_prefer_left(base, other, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "c"), (3, "d")]


def test_shards_are_runs_of_equal_size(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = {r["k"]: r["shard"] for r in rel.shards(df, "k", 7).collect()}
    assert got == {k: k // 143 for k in range(1000)}


def test_descendants_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(0, 100), (100, 101)], "p long, c long")
    got = {(r["ancestor"], r["node"]): r["distance"] for r in rel.descendants(edges, "p", "c").collect()}
    assert got == {(i, j): j - i for i in range(21) for j in range(i + 1, 21)} | {(0, 100): 1, (0, 101): 2, (100, 101): 1}


def test_containing_short_and_odd_items(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, None), (3, ""), (4, "xtwo three fourx"), (5, "two  three four")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three four"), (2, "e"), (3, ""), (4, None), (5, "o t")], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["hits"]) for r in passages.containing(docs, items).collect()}
    assert got == {1: (1, 3), 4: (1, 3), 5: (2, 1)}


def test_containing_goes_in_passes_and_takes_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHORT_ITEMS", 2)
    texts = {f"d{k}": " ".join(f"w{(k * j) % 11}" for j in range(1, k + 2)) for k in range(25)}
    items = {f"i{k:02}": f"w{k}" for k in range(11)} | {f"j{k:02}": f"w{k} w{2 * k % 11}" for k in range(11)} | {"k": "w2 w4 w6"}
    got = {r["doc_id"]: (r["item_id"], r["hits"]) for r in passages.containing(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), spark.createDataFrame(list(items.items()), "item_id string, text string")).collect()}
    want = {d: [i for i, x in items.items() if x in t] for d, t in texts.items()}
    assert got == {d: (min(own), len(own)) for d, own in want.items() if own}
