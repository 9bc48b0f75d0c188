"""Diff text as a table of hunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$")
MAIL = re.compile(r"^From ([0-9a-f]{40}) \S+ \S+ +\d+ [\d:]+ \d{4}$")
HUNK_SCHEMA = "commit string, before_path string, after_path string, loc string, b_start int, b_len int, a_start int, a_len int, content string, hunk_no int"


def parse_diff(text: str, only: str = ".py") -> Iterator[dict]:
    """Hunks of a unified diff in order; files whose names end otherwise than ``only`` go, /dev/null is a null path.

    A length left out is 1; loc is the heading after the second @@ without colons;
    content holds the prefixed lines.
    """
    before = after = None
    hunk: dict | None = None
    number = 0

    def side(path: str) -> str | None:
        path = path.split("\t")[0].strip()
        return None if path == "/dev/null" else path[2:] if path[:2] in ("a/", "b/") else path

    for line in text.split("\n"):
        left = hunk and (hunk["_b"] > 0 or hunk["_a"] > 0)
        if left and line[:1] in (" ", "+", "-", "") or hunk and line.startswith("\\"):
            hunk["lines"].append(line)
            hunk["_b"] -= line[:1] in (" ", "-", "")
            hunk["_a"] -= line[:1] in (" ", "+", "")
            continue
        if hunk:
            yield _hunk(hunk, number)
            number += 1
            hunk = None
        if line.startswith("--- "):
            before = side(line[4:])
        elif line.startswith("+++ "):
            after = side(line[4:])
        elif (m := HUNK.match(line)) and all(p is None or p.endswith(only) for p in (before, after)) and (before or after):
            sizes = [int(m[1]), int(m[2]) if m[2] is not None else 1, int(m[3]), int(m[4]) if m[4] is not None else 1]
            hunk = {"before_path": before, "after_path": after, "loc": m[5].replace(":", "").strip(), "sizes": sizes, "lines": [], "_b": sizes[1], "_a": sizes[3]}
    if hunk:
        yield _hunk(hunk, number)


def _hunk(h: dict, number: int) -> dict:
    return {"before_path": h["before_path"], "after_path": h["after_path"], "loc": h["loc"], "b_start": h["sizes"][0], "b_len": h["sizes"][1], "a_start": h["sizes"][2], "a_len": h["sizes"][3], "content": "\n".join(h["lines"]), "hunk_no": number}


def split_mails(text: str) -> Iterator[tuple[str | None, str]]:
    """(commit, patch) for each mail of a mailbox; one without a commit for plain diff text."""
    commit, lines = None, []
    for line in text.split("\n"):
        if m := MAIL.match(line):
            if lines and (commit or any(x.startswith("diff ") for x in lines)):
                yield commit, "\n".join(lines)
            commit, lines = m[1], []
        else:
            lines.append(line)
    if lines:
        yield commit, "\n".join(lines)


def hunks(patches: DataFrame, text_col: str = "text") -> DataFrame:
    """Patch texts (diffs or mailboxes), one a row, as hunks; the other columns come along. Null texts have none."""
    keys = [c for c in patches.columns if c != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema.fields if f.name != text_col] + [HUNK_SCHEMA])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, *(c.split()[0] for c in HUNK_SCHEMA.split(", "))]
        for b in batches:
            rows = []
            for own, text in zip(b[keys].to_dict("records"), b[text_col], strict=True):
                for commit, patch in split_mails(text) if isinstance(text, str) else ():
                    rows += [own | {"commit": commit} | h for h in parse_diff(patch)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return patches.mapInPandas(run, schema)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of patch files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_sources(spark: SparkSession, path: str, suffix: str = ".py") -> DataFrame:
    """(path, source) of source files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("source"))


# -- filters of collected changes ----------------------------------------------------


def related_pull_requests(meta: DataFrame, changed: DataFrame, most_lines: int = 20, most_changed: int = 10) -> DataFrame:
    """Pull requests about type errors, not automatic and not too large.

    A non-null body without "type" and "error" goes if a non-null title lacks
    "fix" too; bodies that begin with "Bumps" or have over ``most_lines``
    lines go; ``changed`` (repo, pr, modified_locs) must sum to at most
    ``most_changed``. A null body passes.
    """
    body, title = F.lower("body"), F.lower("title")
    unrelated = F.col("body").isNotNull() & ~F.contains(body, F.lit("type")) & ~F.contains(body, F.lit("error")) & F.col("title").isNotNull() & ~F.contains(title, F.lit("fix"))
    noisy = F.col("body").isNotNull() & (F.startswith("body", F.lit("Bumps")) | (F.size(F.split("body", "\n")) > most_lines))
    small = changed.groupBy("repo", "pr").agg(F.sum("modified_locs").alias("locs")).where(F.col("locs") <= most_changed)
    return meta.where(~unrelated & ~noisy).join(small.select("repo", "pr"), ["repo", "pr"], "left_semi")


def related_commits(meta: DataFrame, most_changed: int = 10) -> DataFrame:
    """Commits that mention a type error and change some but fewer than ``most_changed`` places."""
    return meta.where((F.col("modified_locs") > 0) & (F.col("modified_locs") < most_changed) & F.contains(F.lower("message"), F.lit("type error")))


def with_tests(found: DataFrame) -> DataFrame:
    """Commits of hunks with whether they touch a path with a component ``tests``, and how many files of either sort."""
    path = F.coalesce("after_path", "before_path")
    test = F.exists(F.split(path, "/"), lambda x: x == "tests")
    files = found.select("repo", "commit", path.alias("path"), test.alias("test")).distinct()
    return files.groupBy("repo", "commit").agg(F.bool_or("test").alias("has_tests"), F.count("*").alias("files"), F.count(F.when(~F.col("test"), 1)).alias("source_files"))


def one_source_file(found: DataFrame) -> DataFrame:
    """Commits with more than one file of which exactly one is not a test."""
    return with_tests(found).where("files > 1 and source_files = 1")


def commits_of_requests(found: DataFrame) -> DataFrame:
    """Hunks keyed by pull request as hunks keyed by commit: of one commit in several requests the last request's."""
    last = found.groupBy("repo", "commit").agg(F.max("pr").alias("pr"))
    return found.join(last, ["repo", "commit", "pr"], "left_semi").withColumn("pr_branch", F.concat(F.lit("pr"), "pr"))


def corrected(found: DataFrame, other: DataFrame) -> DataFrame:
    """Hunks with the content that ``other`` has for the same place, where it does."""
    key = ["repo", "commit", "before_path", "after_path", "loc", "b_start", "b_len", "a_start", "a_len"]
    a, b = found.alias("a"), other.groupBy(*key).agg(F.max("content").alias("__content")).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    joined = a.join(b, same, "left")
    return joined.select(*[F.coalesce("__content", "a.content").alias("content") if c == "content" else F.col(f"a.{c}") for c in found.columns])
