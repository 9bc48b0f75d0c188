"""Bug cases: metadata from key=value files, patches and test commands; result tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise
from .diffs import parse_diff

#: What the keys of a case's info files are called here.
INFO_KEYS = {"github_url": "git", "python_version": "py_version", "buggy_commit_id": "buggy_id", "fixed_commit_id": "fixed_id", "test_file": "test_files"}


def bug_lines(patch: str) -> list[tuple[str, int, int]]:
    """(file, line, added): per file the lines a patch removes with added 0; with none removed the first insertion's place with added 1.

    A place is the number of the line that what is inserted comes before.
    """
    removed: dict[str, list[int]] = {}
    inserted: dict[str, int] = {}
    for h in parse_diff(patch):
        if h["before_path"] is None:
            continue
        own = removed.setdefault(h["before_path"], [])
        line = h["b_start"] + (h["b_len"] == 0)
        for x in h["content"].split("\n"):
            if x.startswith("-"):
                own.append(line)
                line += 1
            elif x.startswith("+"):
                inserted.setdefault(h["before_path"], line)
            elif not x.startswith("\\"):
                line += 1
    return [(f, k, 0) for f, own in removed.items() for k in own] + [(f, inserted[f], 1) for f, own in removed.items() if not own and f in inserted]


def test_names(script: str) -> list[tuple[str | None, str]]:
    """(class, function) of the tests that a shell script runs with pytest or unittest, each once."""
    out: list[tuple[str | None, str]] = []
    for line in map(str.strip, script.split("\n")):
        found = None
        if re.match(r"(python3? -m pytest|pytest|py\.test)\b", line):
            parts = [x.strip() for x in line.split("::")]
            found = (None, parts[1]) if len(parts) == 2 else (parts[1], parts[2]) if len(parts) == 3 else None
        elif line.startswith("python -m unittest"):
            parts = line.split()[-1].split(".")
            found = (parts[-2] if len(parts) > 1 and parts[-2][:1].isupper() else None, parts[-1])
        if found and found not in out:
            out.append(found)
    return out


def case_info(files: DataFrame) -> DataFrame:
    """(case, git, py_version, buggy_id, fixed_id, test_files) from (case, text) of key=value files: first value of each key."""
    line = files.select("case", F.posexplode(F.split("text", "\r?\n")).alias("k", "line"))
    pairs = line.select("case", "k", F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("key"), F.regexp_replace(F.regexp_extract("line", "=(.*)$", 1), '["\\s]', "").alias("value"))
    named = [F.min_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col("k"))).alias(name) for key, name in INFO_KEYS.items()]
    return pairs.groupBy("case").agg(*named).withColumn("git", F.concat("git", F.lit(".git")))


def bugs(patches: DataFrame) -> DataFrame:
    """(case, file, line, added) from (case, text) of patches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(c, *x) for c, t in zip(b["case"], b["text"], strict=True) if isinstance(t, str) for x in bug_lines(t)], columns=["case", "file", "line", "added"], dtype=object)

    return patches.select("case", "text").mapInPandas(run, "case string, file string, line int, added int")


def case_tests(scripts: DataFrame) -> DataFrame:
    """(case, test_class, test_func, node) from (case, test_file, text); node is what pytest takes."""
    found = F.pandas_udf(T.ArrayType(T.StructType([T.StructField("test_class", T.StringType()), T.StructField("test_func", T.StringType())])))

    @found
    def names(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: test_names(t) if isinstance(t, str) else [])

    each = scripts.select("case", "test_file", F.inline(names("text")))
    return each.select("case", "test_class", "test_func", F.concat_ws("::", "test_file", "test_class", "test_func").alias("node"))


def listed_cases(table: DataFrame) -> DataFrame:
    """Rows of a sheet (url, pr, tests) as cases: repository name, ``;``-split tests, and a number for repeated names."""
    from pyspark.sql import Window

    repo = F.regexp_extract("url", r"/([^/]+?)(?:\.git)?/?$", 1)
    name = F.concat_ws("-", repo, F.col("pr").cast("string"))
    number = F.row_number().over(Window.partitionBy("name").orderBy("tests", "url"))
    rows = table.select("url", "pr", "tests", repo.alias("repo"), name.alias("name")).withColumn("n", number)
    return rows.select("repo", "pr", F.when(F.col("n") > 1, F.concat_ws("-", "name", F.col("n").cast("string"))).otherwise(F.col("name")).alias("case"), F.transform(F.split("tests", ";"), lambda x: F.trim(x)).alias("tests"), "url")


def split_files(cases: DataFrame, files: DataFrame) -> DataFrame:
    """(case, file, used): a case's file with the variants named ``stem-<number>.py`` that exist of it, else itself."""
    variants = files.select("case", F.col("file").alias("used"), F.concat(F.regexp_extract("file", r"^(.*)-\d+\.py$", 1), F.lit(".py")).alias("file")).where("file <> '.py'")
    return cases.select("case", "file").distinct().join(variants, ["case", "file"], "left").select("case", "file", F.coalesce("used", "file").alias("used"))


def described_cases(files: DataFrame) -> DataFrame:
    """(case, git, py_version, buggy_id, fixed_pr_id, pr, code_files, test_files) from (path, text) of bug_info.json files.

    The case is the folder of the file below its project, whose name ends in
    the number of the pull request. Only Python files are code. Texts that are
    no JSON object give a row of nulls beside the case.
    """
    folder = F.split("path", "/")
    schema = "git string, py_version string, buggy_id string, fixed_pr_id string, code_files array<string>, test_files array<string>"
    info = F.from_json("text", schema)
    case = F.concat_ws("/", F.element_at(folder, -3), F.element_at(folder, -2))
    rows = files.where(F.element_at(folder, -1) == "bug_info.json").select(case.alias("case"), info.alias("i"), F.regexp_extract(F.element_at(folder, -2), r"-(\d+)(?:-\d+)?$", 1).cast("int").alias("pr"))
    return rows.select("case", "i.git", "i.py_version", "i.buggy_id", "i.fixed_pr_id", "pr", F.filter("i.code_files", lambda x: x.endswith(".py")).alias("code_files"), "i.test_files")


def class_methods(calls: DataFrame) -> DataFrame:
    """(class, methods) from (call) like ``Class.method()``; calls without a dot go, the order is that of the names."""
    parts = F.split("call", "\\.")
    return calls.where(F.size(parts) >= 2).select(parts[0].alias("class"), F.replace(parts[1], F.lit("()"), F.lit("")).alias("method")).groupBy("class").agg(F.sort_array(F.collect_list("method")).alias("methods"))


def test_commands(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """(case, command): pytest commands for the tests of (case, test_file, test_class, test_func) found in (case, file, source).

    test_class and test_func are lists of names. Cases whose file is missing or
    does not parse have no command.
    """
    from ..functions.locating import test_paths
    from ..functions.trees import parse_module

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def found(source: pd.Series, classes: pd.Series, functions: pd.Series) -> pd.Series:
        modules = source.map(parse_module)
        return pd.Series([[] if m is None else test_paths(m, list([] if c is None else c), list([] if f is None else f)) for m, c, f in zip(modules, classes, functions, strict=True)])

    met = cases.join(sources.withColumnRenamed("file", "test_file"), ["case", "test_file"])
    each = met.select("case", "test_file", F.explode(found("source", "test_class", "test_func")).alias("path"))
    return each.select("case", F.concat(F.lit("pytest "), F.concat_ws("::", "test_file", F.array_join("path", "::"))).alias("command"))


def labelled(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a reviewer accepted: those whose ``keys`` have the label ``y``, every one of them."""
    return rows.join(labels.where("label = 'y'").select(*keys).distinct(), keys, "left_semi")


# -- results --------------------------------------------------------------------


def result_rows(text: DataFrame) -> DataFrame:
    """(case, file, status, patch) of tab-separated result lines (column value) with four fields; +, - and > lines go."""
    parts = F.split("value", "\t")
    rows = text.where(~F.substring("value", 1, 1).isin("+", "-", ">") & (F.size(parts) == 4))
    return rows.select(*[parts[k].alias(n) for k, n in enumerate(("case", "file", "status", "patch"))])


def plausible_cases(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Distinct (case, file) of known cases with results."""
    return results.select("case", "file").distinct().join(cases.select("case").distinct(), "case", "left_semi")


def markdown_plausible(text: DataFrame, lines: DataFrame) -> DataFrame:
    """(benchmark, bugs): bugs behind the PLAUSIBLE rows of a markdown table: a case's buggy files, less one if several."""
    parts = F.split(F.regexp_replace(F.substring("value", 2, 1 << 20), " ", ""), "\\|")
    rows = text.where(F.startswith("value", F.lit("|"))).select(F.regexp_replace(parts[0], "-buggy", "").alias("case"), parts[1].alias("benchmark"), parts[2].alias("status")).where("status = 'PLAUSIBLE' and case <> 'bug_id'")
    files = lines.groupBy("case").agg(F.countDistinct("file").alias("n"))
    return rows.join(files, "case").groupBy("benchmark").agg(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.col("n"))).alias("bugs"))


def bug_numbers(lines: DataFrame) -> DataFrame:
    """(project, cases, bugs) and a total under a null project."""
    project = F.regexp_replace("case", "-[^-]*$", "")
    return lines.select(project.alias("project"), "case", "file").distinct().rollup("project").agg(F.countDistinct("case").alias("cases"), F.count("*").alias("bugs"))


def test_scripts(failed: DataFrame, split: int) -> DataFrame:
    """(shard, script): commands for failed (case, file) rows in ``split`` runs of consecutive cases.

    Runs differ by one row at most, the longer ones first. Rows are sorted into
    ranges of (case, file) and ranked by their place in a range and the totals
    of the ranges before it, so no task sees all rows, or all of a large case.
    """
    from pyspark.sql import Window

    ranged = materialise(failed.repartitionByRange("case", "file").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # a row for each task
    starts = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    total = ranged.count()
    rank = F.row_number().over(Window.partitionBy("range").orderBy("case", "file")) - 1 + F.col("at")
    long, size = total % split, total // split
    shard = F.when(F.col("rank") < long * (size + 1), F.expr(f"rank div {size + 1}")).otherwise(long + F.expr(f"(rank - {long * (size + 1)}) div {max(size, 1)}"))
    ordered = ranged.join(starts, "range").withColumn("rank", rank).withColumn("shard", shard.cast("int"))
    command = F.concat(F.lit("pyenv global "), F.element_at(F.split("case", "/"), -1), F.lit("\npython test.py "), "case", F.lit(" "), "file")
    return ordered.groupBy("shard").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("case", "file", command.alias("c")))), lambda x: x["c"]), "\n").alias("script"))
