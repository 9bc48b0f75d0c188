"""A forest that grows by batches is the forest of all batches at once."""

import json

from test_mining import some_templates, table

from arborlake.plans import growing, mining


def rows_of(forest):
    """All of a forest but lines: those are of whichever of equal templates came first."""
    plain = lambda x: x and [{k: v for k, v in n.items() if not k.endswith("line")} for n in json.loads(x)]
    return sorted(((r["template_id"], r["parent_id"], r["action"], r["instances"], *(plain(r[s]) for s in mining.SIDES), r["places"]) for r in forest.collect()), key=repr)


def test_two_batches_equal_one(spark):
    rows = some_templates(11, 90)
    first, second = rows[:50], rows[50:] + rows[:7]
    known, forest = growing.started(table(spark, first))
    known, forest = growing.grown(known, forest, table(spark, second))
    assert rows_of(forest) == rows_of(mining.mine(table(spark, first + second)))
    assert sum(r["instances"] for r in known.collect()) == 97


def test_known_templates_only_add_instances(spark, monkeypatch):
    rows = some_templates(12, 60)
    known, forest = growing.started(table(spark, rows))
    want = rows_of(mining.mine(table(spark, rows + rows[:25] + rows[:5])))
    monkeypatch.setattr(mining, "mine_distinct", None)  # nothing is mined again
    assert rows_of(growing.grown(known, forest, table(spark, rows[:25] + rows[:5]))[1]) == want


def test_unchanged_blocks_are_not_mined_again(spark, monkeypatch):
    rows = some_templates(13, 60)
    late = next(r for r in rows if sum(x["block"] == r["block"] and x["action"] == r["action"] for x in rows) > 3)
    early = [r for r in rows if any(r[c] != late[c] for c in mining.SAME)]
    known, forest = growing.started(table(spark, early))
    mined, whole = [], mining.mine_distinct
    monkeypatch.setattr(mining, "mine_distinct", lambda t, **how: mined.append({(r["action"], r["block"]) for r in t.collect()}) or whole(t, **how))
    got = growing.grown(known, forest, table(spark, [late]))[1]
    assert mined == [{(late["action"], late["block"])}]
    monkeypatch.undo()
    assert rows_of(got) == rows_of(mining.mine(table(spark, [*early, late])))


def test_empty_batches(spark):
    rows = some_templates(14, 12)
    none = table(spark, rows).limit(0)
    known, forest = growing.started(none)
    assert known.count() == forest.count() == 0
    known, forest = growing.grown(known, forest, table(spark, rows))
    assert rows_of(forest) == rows_of(mining.mine(table(spark, rows)))
    assert rows_of(growing.grown(known, forest, none)[1]) == rows_of(forest)


def test_stream_of_templates(spark, tmp_path):
    rows = some_templates(15, 45)
    read = spark.readStream.schema(mining.TEMPLATE_SCHEMA).option("maxFilesPerTrigger", 1)
    for k in range(3):
        table(spark, rows[15 * k : 15 * k + 15]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        growing.follow(read.parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "log"))
    assert rows_of(growing.newest(spark, str(tmp_path / "state"))) == rows_of(mining.mine(table(spark, rows)))
    assert spark.read.parquet(str(tmp_path / "state/forest/version=0")).count() == 0
    table(spark, rows[:4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    growing.follow(read.parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "log"))
    assert rows_of(growing.newest(spark, str(tmp_path / "state"))) == rows_of(mining.mine(table(spark, rows + rows[:4])))
