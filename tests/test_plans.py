"""Mining, patching, cases, rendering and training sets from end to end on written snippets."""

import json

from arborlake.functions import rendering
from arborlake.functions.changes import mine_change
from arborlake.functions.trees import parse
from arborlake.plans import mining, patching, training, tree_queries
from arborlake.plans.tree_queries import CHANGES
from arborlake.sources import cases

PATCH = "--- a/x/m.py\n+++ b/x/m.py\n@@ -3,2 +3,2 @@\n a\n-b\n+c\n--- a/n.py\n+++ b/n.py\n@@ -1,2 +1,3 @@\n a\n+b\n c\n"


def written_changes(spark):
    return spark.createDataFrame(CHANGES, "case string, before_source string, after_source string, content string, b_start int, a_start int").selectExpr("*", "'m.py' AS before_path", "'m.py' AS after_path", "'' AS loc")


def mined(spark):
    rows = written_changes(spark)
    return mining.change_templates(rows.drop("before_source", "after_source"), rows.select("case", "before_path", "after_path", "before_source", "after_source"), ["case"])[0]


def test_every_tree_query_runs(spark):
    for name, f in tree_queries.QUERIES.items():
        rows = f(spark, "/root/testdata/sf0.001").collect()
        assert rows, name


def test_forest_and_patches(spark):
    found = mined(spark)
    forest = spark.createDataFrame(mining.mine(found).toPandas().astype(object).where(lambda x: x.notna(), None), training.FOREST_SCHEMA)
    rows = {r["template_id"]: r for r in forest.collect()}
    assert any(r["parent_id"] is None and r["instances"] > 1 for r in rows.values())
    for r in rows.values():  # a parent has its children's instances
        below = [x for x in rows.values() if x["parent_id"] == r["template_id"]]
        assert not below or r["instances"] >= sum(x["instances"] for x in below)
    cases_ = spark.createDataFrame([("c1", "def r(e):\n    return json(e.keys())\n", [2], False), ("c2", "def r(n):\n    w = 'z' + n\n    return w\n", [2], False)], "case string, source string, lines array<int>, added boolean")
    made = patching.patches(cases_, forest).collect()
    assert {r["source"] for r in made} >= {"def r(e):\n    return json(encode(e.keys()))", "def r(n):\n    w = 'z' + str(n)\n    return w"}
    assert mining.without_singles(forest).count() < forest.count()
    assert {r["case"] for r in made} and all(r["rank"] >= 1 for r in made)
    fixes = spark.createDataFrame([("c1", "def r(e):\n    return json(encode(e.keys()))\n"), ("c2", "x = 1\n")], "case string, fixed string")
    found = spark.createDataFrame(made)
    row = patching.coverage(found, fixes).first()
    assert row["cases"] == 2 and row["patched"] >= 1
    filled = patching.candidates(found)
    assert patching.exact_matches(filled, fixes).count() == 2
    assert patching.candidates(found, done=fixes).count() == 0


def test_a_case_that_never_ends_stops_no_other(spark, tmp_path):
    def model(prompts):
        text = prompts[0]["prompt"]
        if "forever" in text:
            while True:
                try:
                    pass
                except Exception:
                    pass
        if "broken" in text:
            raise ValueError
        return [["<extra_id_0> 1" if "good" in text else "nothing"]]

    rows = [("a", 1, "forever = VALUE_MASK"), ("a", 0, "x = 1"), ("b", 1, "good = VALUE_MASK"), ("c", 1, "broken = VALUE_MASK"), ("d", 1, "other = VALUE_MASK"), ("d", 2, "good = VALUE_MASK")]
    found = spark.createDataFrame(rows, "case string, rank int, source string")
    got = {(r["case"], r["rank"]): (r["candidate"], r["reason"]) for r in patching.attempts(found, model, seconds=2).collect()}
    assert got == {("a", 0): ("x = 1", None), ("a", 1): (None, "out of time"), ("b", 1): ("good = 1", None), ("c", 1): (None, "failed: ValueError"), ("d", 1): (None, "no prediction fits"), ("d", 2): ("good = 1", None)}
    assert {r["case"] for r in patching.candidates(found, model, seconds=2, done=found.where("case <> 'b'")).collect()} == {"b"}
    patching.write_patches(found, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 6


def test_rejects_are_kept(spark):
    rows = spark.createDataFrame([("a", "m.py", "m.py", "", "-import a\n+import b", 1, 1), ("b", "m.py", "m.py", "", "-x = 1\n+x = f(1)", 1, 1)], "case string, before_path string, after_path string, loc string, content string, b_start int, a_start int")
    sources = spark.createDataFrame([("a", "m.py", "m.py", "import a\n", "import b\n"), ("b", "m.py", "m.py", "x = 1\n", "x = f(1)\n")], "case string, before_path string, after_path string, before_source string, after_source string")
    found, rejects = mining.change_templates(rows, sources, ["case"])
    assert [r["case"] for r in found.collect()] == ["b"] and [(r["case"], r["reason"]) for r in rejects.collect()] == [("a", "noise")]


def test_support(spark):
    forest = spark.createDataFrame([("a", None, "Add", 20), ("b", "a", "Add", 12), ("c", "b", "Add", 3), ("d", None, "Add", 4), ("e", "d", "Add", 99)], "template_id string, parent_id string, action string, instances long")
    assert sorted(r["template_id"] for r in mining.supported(forest).collect()) == ["a", "b"]
    assert [r["template_id"] for r in mining.top_templates(forest, 2).orderBy("rank").collect()] == ["e", "a"]


def test_bug_lines_and_tests(spark):
    assert cases.bug_lines(PATCH) == [("x/m.py", 4, 0), ("n.py", 2, 1)]
    assert cases.test_names("pytest a.py::T::f\npython3 -m pytest a.py::g\npython -m unittest -q a.b.K.h\n\n") == [("T", "f"), (None, "g"), ("K", "h")]
    df = spark.createDataFrame([("c", PATCH), ("d", None)], "case string, text string")
    assert cases.bugs(df).count() == 2
    info = cases.case_info(spark.createDataFrame([("c", 'github_url="https://h/r"\nbuggy_commit_id = "12"\nbuggy_commit_id="13"')], "case string, text string")).first()
    assert (info["git"], info["buggy_id"], info["py_version"]) == ("https://h/r.git", "12", None)
    assert cases.case_tests(spark.createDataFrame([("c", "a.py", "pytest a.py::T::f")], "case string, test_file string, text string").select("*")).first()["node"] == "a.py::T::f"


def test_results(spark):
    text = spark.createDataFrame([("c-1\tf.py\tTrue\tp",), ("+ c\tf\tTrue\tp",), ("c-1\tf.py\tfail\tq",), ("c-2\tg.py\tTrue",), ("c-1\tf.py\tTrue\tp",)], "value string")
    rows = cases.result_rows(text)
    assert [tuple(r) for r in patching.plausible(rows).collect()] == [("c-1", "f.py", ["p"])]
    lines = spark.createDataFrame([("c-1", "f.py", 1), ("c-1", "g.py", 2), ("c-2", "f.py", 3)], "case string, file string, line int")
    assert cases.plausible_cases(rows, lines).count() == 1
    table = spark.createDataFrame([("| bug_id | b | s |",), ("| c-1-buggy | Ours | PLAUSIBLE |",), ("| c-2 | Ours | FAIL |",)], "value string")
    assert [tuple(r) for r in cases.markdown_plausible(table, lines).collect()] == [("Ours", 1)]
    assert {tuple(r) for r in cases.bug_numbers(lines).collect()} == {("c", 2, 3), (None, 2, 3)}
    assert cases.test_scripts(lines.select("case", "file"), 2).count() == 2
    files = spark.createDataFrame([("c-1", "f-3.py"), ("c-1", "f-9.py"), ("c-1", "f.py")], "case string, file string")
    assert {(r["file"], r["used"]) for r in cases.split_files(lines, files).where("case = 'c-1'").collect()} == {("f.py", "f-3.py"), ("f.py", "f-9.py"), ("g.py", "g.py")}
    sheet = spark.createDataFrame([("https://h/o/r.git", 5, "a; b"), ("https://h/o/r", 5, "c")], "url string, pr int, tests string")
    assert {(r["case"], tuple(r["tests"])) for r in cases.listed_cases(sheet).collect()} == {("r-5", ("a", "b")), ("r-5-2", ("c",))}


def test_rendering():
    t, _ = mine_change(*CHANGES[0][1:])
    text = rendering.template_dot(t)
    assert text.startswith("digraph") and text.count("subgraph") >= 1 and rendering.leaf_path_text(parse("x = 1"))[0].startswith("targets:Variable=x")
    assert '"a" -> "b"' in rendering.forest_dot([("a", None, 2), ("b", "a", 1)])


def test_training_sets(spark, tmp_path):
    hunks = spark.createDataFrame([("a", "m.py", "-    return json(e.errors())\n+    return json(encode(e.errors()))", 2, 1, 2, 1), ("b", "m.py", "-x\n+y", 1, 2, 1, 1)], "case string, before_path string, content string, b_start int, b_len int, a_start int, a_len int")
    sources = spark.createDataFrame([("a", "m.py", CHANGES[0][1]), ("b", "m.py", "x\n")], "case string, before_path string, before_source string")
    pairs = training.line_pairs(hunks, sources, ["case"])
    assert [r["old"] for r in pairs.collect()] == ["return json(e.errors())"]
    assert training.as_text(pairs).first()["value"].endswith("\treturn json(encode(e.errors()))")
    fixed = spark.createDataFrame([("x = f(a)",), ("x = f(a)",), ("(",)], "source string")
    assert training.masked_training_set(fixed).count() >= 1
    forest = spark.createDataFrame([("t1", None, "Add", 3, None, "[]", None, None, None, "[]"), ("t2", None, "Add", 9, None, "[]", None, None, None, "[]")], training.FOREST_SCHEMA)
    training.write_templates(forest, str(tmp_path / "f"))
    assert {tuple(r) for r in training.read_templates(spark, str(tmp_path / "f")).collect()} == {tuple(r) for r in forest.collect()}
    assert [r["template_id"] for r in training.mined_index(forest).collect()] == ["t2", "t1"]
    rows = json.loads(training.relabel(mining.dump_tree(parse("x")), "Variable", "Expr", True))
    assert rows[-1]["kind"] == "Expr" and rows[-1]["value"] is None


def test_stream(spark, tmp_path):
    from arborlake.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.patch").write_text(PATCH)
        ingest.ingest(ingest.stream_patches(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    counted = ingest.instance_counts(spark, str(tmp_path / "out"))
    assert {(r["change"], r["instances"]) for r in counted.collect()} == {("-b\n+c", 2), ("+b", 2)}


def test_large_blocks_are_mined_whole(spark):
    found = mined(spark).where("case LIKE 'wrap%'")
    forest = lambda **more: sorted((r["template_id"], str(r["parent_id"]), r["instances"]) for r in mining.mine(found, **more).collect())
    assert forest(alone=1) == forest()
