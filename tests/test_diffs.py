from arborlake.sources import diffs

DIFF = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,2 +1,3 @@ def f(x):
 a
-b
+c
+d
@@ -9 +10 @@
-x
+y
diff --git a/n.txt b/n.txt
--- a/n.txt
+++ b/n.txt
@@ -1 +1 @@
-x
+y
diff --git a/new.py b/new.py
--- /dev/null
+++ b/new.py
@@ -0,0 +1,1 @@
+z
"""
MAIL = "From " + "a" * 40 + " Mon Sep 17 00:00:00 2001\nSubject: s\n\n" + DIFF + "From " + "b" * 40 + " Mon Sep 17 00:00:00 2001\nSubject: t\n\n" + DIFF


def test_parse_diff():
    got = list(diffs.parse_diff(DIFF))
    assert [(h["before_path"], h["after_path"], h["b_start"], h["b_len"], h["a_start"], h["a_len"]) for h in got] == [("m.py", "m.py", 1, 2, 1, 3), ("m.py", "m.py", 9, 1, 10, 1), (None, "new.py", 0, 0, 1, 1)]
    assert got[0]["loc"] == "def f(x)" and got[0]["content"] == " a\n-b\n+c\n+d"


def test_split_mails():
    assert [c for c, _ in diffs.split_mails(MAIL)] == ["a" * 40, "b" * 40]
    assert [c for c, _ in diffs.split_mails(DIFF)] == [None]


def test_hunks(spark):
    df = spark.createDataFrame([("r", MAIL), ("s", None), ("t", "")], "repo string, text string")
    rows = diffs.hunks(df).collect()
    assert len(rows) == 6 and {r["repo"] for r in rows} == {"r"} and {r["commit"][0] for r in rows} == {"a", "b"}


def test_filters_of_requests(spark):
    meta = spark.createDataFrame([("r", 1, "Fix x", "a"), ("r", 2, "x", "a"), ("r", 3, "x", None), ("r", 4, "x", "type"), ("r", 5, None, "a"), ("r", 6, "fix", "Bumps type"), ("r", 7, "fix", "type\n" * 25), ("r", 8, "fix", "type")], "repo string, pr int, title string, body string")
    changed = spark.createDataFrame([("r", k, 3) for k in range(1, 8)] + [("r", 8, 6), ("r", 8, 6)], "repo string, pr int, modified_locs int")
    assert sorted(r["pr"] for r in diffs.related_pull_requests(meta, changed).collect()) == [1, 3, 4, 5]


def test_commits_and_tests(spark):
    rows = [("r", "c1", 1, "a.py", "a.py"), ("r", "c1", 1, "tests/t.py", "tests/t.py"), ("r", "c2", 1, "a.py", None), ("r", "c2", 2, "a.py", None), ("r", "c3", 1, "x/tests.py", "x/tests.py"), ("r", "c3", 1, "b.py", "b.py")]
    df = spark.createDataFrame(rows, "repo string, commit string, pr int, before_path string, after_path string")
    assert {r["commit"]: (r["has_tests"], r["files"], r["source_files"]) for r in diffs.with_tests(df).collect()} == {"c1": (True, 2, 1), "c2": (False, 1, 1), "c3": (False, 2, 2)}
    assert [r["commit"] for r in diffs.one_source_file(df).collect()] == ["c1"]
    assert [r["pr"] for r in diffs.commits_of_requests(df).where("commit = 'c2'").collect()] == [2]
