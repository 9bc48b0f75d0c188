"""Equal code is parsed, matched, mined and patched once, and counts as often as it stands in the table."""

import shutil

import pytest
from pyspark.sql import functions as F

from arborlake.plans import mining, patching, tree_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def twice(spark, tmp_path):
    """A folder in which each customer and supplier stands twice, with a key of the same remainders."""
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        own = spark.read.parquet(f"{SF}/{name}.parquet").where(F.col(key) < 30)
        own.unionByName(own.withColumn(key, F.col(key) + 105 * 1000)).write.parquet(f"{tmp_path}/{name}.parquet")
    yield str(tmp_path)
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_equal_changes_are_mined_once(spark, twice):
    found = tree_queries._found(spark, twice)
    customers = spark.read.parquet(f"{twice}/customer.parquet").count()
    assert found.count() <= customers // 2 and found.agg(F.sum("copies")).first()[0] == customers
    each = found.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rows = lambda forest: sorted(map(repr, forest.select("template_id", "parent_id", "instances").collect()))
    assert rows(mining.mine(found, copies="copies")) == rows(mining.mine(each))


def test_equal_sources_are_tried_once(spark, twice):
    df = tree_queries.tree_match(spark, twice)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [kind" in plan and "after_source" in plan[plan.index("Aggregate [kind") :].split("\n")[0]
    n = spark.read.parquet(f"{twice}/customer.parquet").groupBy((F.col("c_custkey") % 5).alias("kind")).count()
    assert {(r["kind"], r["sources"]) for r in df.collect()} == {(r["kind"], r["count"]) for r in n.collect()}


def test_no_trees_are_broadcast(spark, twice):
    plan = tree_queries.anti_unify(spark, twice)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_equal_code_is_patched_once(spark, twice, monkeypatch):
    seen = []
    patches = patching.patches
    monkeypatch.setattr(patching, "patches", lambda cases, forest: seen.append(cases) or patches(cases, forest))
    got = tree_queries.patch_rewrite(spark, twice).collect()
    assert seen[0].count() == seen[0].select("source").distinct().count() < spark.read.parquet(f"{twice}/supplier.parquet").count()
    of = lambda far: {(int(r["case"]) % 105_000, r["action"], r["source"]) for r in got if (int(r["case"]) >= 105_000) == far}
    assert of(True) == of(False) and len(of(True)) * 2 == len(got) > 4
