"""Patches: locations joined to templates, ranked, applied, filled and judged."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.edits import apply_in_context, fits, is_usable
from ..functions.kernels import abstract_ratio, includes
from ..functions.limits import OutOfTime, deadline
from ..functions.locating import regions
from ..functions.rewriting import build_prompt, exactly_fixes, fill, fill_lines, fits_fix, line_prompt
from ..functions.trees import Tree, build, exact_fingerprint, find_all, parse_module, shape_fingerprint
from ..functions.vocabulary import ABSTRACTED, REFERRED
from ..session import materialise
from .mining import dump_tree, load_template, load_tree, template_row


def locations(bugs: DataFrame, gap: int = 10) -> DataFrame:
    """Buggy lines (keys, file, line) as islands: runs of lines that are at most ``gap`` apart."""
    from ..operators.relational import islands

    keys = [c for c in bugs.columns if c != "line"]
    return islands(bugs, keys, "line", gap).groupBy(*keys, "island").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def located(bugs: DataFrame, sources: DataFrame, gap: int = 10, imports: bool = True) -> DataFrame:
    """(case, file, location, lines): buggy lines (case, file, line) by the import, function or class they lie in, in runs.

    Files are joined from ``sources`` (case, file, source); what does not parse
    or is missing has its lines in runs, as one region.
    """

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def split(source: pd.Series, lines: pd.Series) -> pd.Series:
        def one(text, at) -> list[list[int]]:
            module = parse_module(text)
            return split_lines([int(k) for k in at]) if module is None else regions(module, [int(k) for k in at], gap, imports)

        return pd.Series([one(s, at) for s, at in zip(source, lines, strict=True)])

    whole = bugs.groupBy("case", "file").agg(F.sort_array(F.collect_set("line")).alias("lines")).join(sources.select("case", "file", "source"), ["case", "file"], "left")
    return whole.select("case", "file", F.posexplode(split("source", "lines")).alias("location", "lines"))


def split_lines(lines: list[int]) -> list[list[int]]:
    """Runs of consecutive lines."""
    out: list[list[int]] = []
    for x in sorted(lines):
        if out and x == out[-1][-1] + 1:
            out[-1].append(x)
        else:
            out.append([x])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _case_kinds(sources: pd.Series, lines: pd.Series, added: pd.Series) -> pd.Series:
    """Types of all nodes in the statements at the lines, and ``*`` for a pattern of any type; ``+`` where all is inserted."""

    def kinds(source: str, at) -> list[str]:
        module = parse_module(source)
        hit = [] if module is None else [s for _, _, _, s in find_all(module) if any(s.lineno <= k <= s.end_lineno for k in at)]
        return sorted({t.type for s in hit for t in build(s).walk()} | {"*"}) if hit else []

    return pd.Series([["+"] if new else kinds(s, at) for s, at, new in zip(sources, lines, added, strict=True)])


_SIDES = ["action", "before", "after", "within", "places", "before_context", "after_context"]


def _known(forest: DataFrame) -> DataFrame:
    """The forest with what selection asks of a template: kind, usable, ratio, and fingerprints of the whole before and after sides."""

    @F.pandas_udf("struct<kind: string, usable: boolean, ratio: double, fp_before: string, fp_after: string, fp_new: string, tops: string, whole: string>")
    def facts(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            t = load_template(r)
            whole = t.before_within()
            first = whole.children[0] if whole is not None and whole.children else None
            kind = "+" if first is None else "*" if first.general else first.type
            out.append((kind, is_usable(t), abstract_ratio(whole) if whole is not None else 0.0, "-" if whole is None else exact_fingerprint(whole), "-" if t.after is None else shape_fingerprint(t.after), "-" if t.after is None else exact_fingerprint(t.after), "-" if t.after is None else repr([c.label for c in t.after.children]), dump_tree(whole)))
        return pd.DataFrame(out, columns=["kind", "usable", "ratio", "fp_before", "fp_after", "fp_new", "tops", "whole"])

    return forest.select("template_id", "parent_id", "instances", *_SIDES, facts(F.struct(*_SIDES)).alias("f")).select("template_id", "parent_id", "instances", *_SIDES, "f.*")


def shaped(forest: DataFrame) -> DataFrame:
    """The forest with fp_shape of each template, as mining.template_row has it."""

    @F.pandas_udf("string")
    def print_of(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([template_row(load_template(r))["fp_shape"] for r in rows.astype(object).where(rows.notna(), None).to_dict("records")], dtype=object)

    return forest.withColumn("fp_shape", print_of(F.struct(*_SIDES)))


def _tried(pairs: DataFrame, cases: DataFrame, known: DataFrame) -> DataFrame:
    """(case, template_id, fit) for (case, template_id) pairs: which templates fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b.astype(object).where(b.notna(), None).to_dict("records")
            fit = [fits(r["source"], load_template(r), list(r["lines"]), bool(r["added"])) for r in rows]
            yield pd.DataFrame({"case": b["case"], "template_id": b["template_id"], "fit": fit})

    return pairs.join(cases, "case").join(known.select("template_id", *_SIDES), "template_id").mapInPandas(run, "case string, template_id string, fit boolean")


def selected(cases: DataFrame, forest: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(case, template_id) of the templates to use, and (case, template_id, fit, depth) of all that were tried.

    cases: case, source, lines, added. The forest is descended a level at a
    time, all cases at once: roots are tried where a node of the type they
    begin with occurs at the lines (an equi-join), children only where their
    parent fits. From the lowest level up a template that fits is chosen if none
    below it is and it can be carried out (is_usable); one that has a child
    with the same before side and an after side of the same shape stands for
    that child. Templates with fewer than ``least`` instances are not used.
    """
    known = materialise(_known(forest.where(F.col("instances") >= least)), "known")
    tree = known.select("template_id", "parent_id", "usable", "fp_before", "fp_after")
    up = tree.select(F.col("template_id").alias("p"), F.col("fp_before").alias("b"), F.col("fp_after").alias("a"))
    tree = materialise(tree.join(up, tree["parent_id"] == up["p"], "left").select("template_id", "parent_id", "usable", F.coalesce((F.col("fp_before") == F.col("b")) & (F.col("fp_after") == F.col("a")) & (F.col("a") != "-"), F.lit(False)).alias("like")), "tree")
    kinds = cases.select("case", F.explode(F.array_distinct(_case_kinds("source", "lines", "added"))).alias("kind"))
    pairs = kinds.join(known.where("parent_id is null").select("template_id", "kind"), "kind").select("case", "template_id")
    levels: list[DataFrame] = []
    while True:
        level = materialise(_tried(pairs, cases, known).withColumn("depth", F.lit(len(levels))), "level")
        levels.append(level)
        fit = level.where("fit").select("case", F.col("template_id").alias("parent_id"))
        pairs = fit.join(tree.where("not like").select("template_id", "parent_id"), "parent_id").select("case", "template_id")
        if pairs.isEmpty():
            break
    stands = tree.where("like").select(F.col("parent_id").alias("template_id")).distinct()
    chosen, below = None, None
    for level in reversed(levels):
        fit = level.where("fit").select("case", "template_id")
        alone = fit if below is None else fit.join(below, ["case", "template_id"], "left_anti")
        own = alone.join(tree.where("usable").select("template_id"), "template_id", "left_semi").unionByName(fit.join(stands, "template_id", "left_semi")).distinct()
        own = materialise(own.select("case", "template_id"), "chosen")
        with_choice = own if below is None else own.unionByName(fit.join(below, ["case", "template_id"], "left_semi")).distinct()
        below = with_choice.join(tree.select("template_id", "parent_id"), "template_id").where("parent_id is not null").select("case", F.col("parent_id").alias("template_id")).distinct()
        below = materialise(below, "below")
        chosen = own if chosen is None else chosen.union(own)
    tried = levels[0]
    for level in levels[1:]:
        tried = tried.union(level)
    return chosen.distinct(), tried


def without_included(chosen: DataFrame, known: DataFrame) -> DataFrame:
    """``chosen`` (case, template_id) less templates that another one chosen for the case includes.

    A template is included if the after sides are equal and its whole before
    side specialises the other's (or neither has one); of equal ones the least
    id stays. Pairs are those of ``inclusions`` among the templates chosen,
    found once for all cases.
    """
    above = materialise(inclusions(known.join(chosen.select("template_id").distinct(), "template_id", "left_semi"), "whole", ["fp_new"]), "above")
    both = above.join(above.select(F.col("upper").alias("lower"), F.col("lower").alias("upper"), F.lit(True).alias("back")), ["lower", "upper"], "left")
    strict = both.where("back is null or lower > upper").select(F.col("lower").alias("template_id"), "upper")
    gone = chosen.join(strict, "template_id").join(chosen.select("case", F.col("template_id").alias("upper")), ["case", "upper"], "left_semi").select("case", "template_id").distinct()
    return chosen.join(gone, ["case", "template_id"], "left_anti")


def _node_keys(t: Tree, path: str = "") -> Iterator[tuple[str, str, bool]]:
    """(place, node, whether it is asked for) of a pattern: what a tree that specialises it has at the same place.

    A node is told by type and roles of children, and once more with its value;
    operators and literals may differ in theirs (kernels.value_satisfies).
    """
    if not t.general:
        free = t.value in (None, ABSTRACTED, REFERRED) or t.kind in ("Op", "Literal")
        name = json.dumps([t.kind, t.type, [c.role for c in t.children]])
        yield path, name, free
        if t.value is not None:
            yield path, name + json.dumps(t.value), not free
    for k, c in enumerate(t.children):
        yield from _node_keys(c, f"{path}/{k}")


def inclusions(patterns: DataFrame, tree: str, within: list[str]) -> DataFrame:
    """(lower, upper): ids of different patterns (template_id, ``tree`` as JSON) with equal ``within``, the lower's tree specialising the upper's.

    An index of the nodes at each place of a tree brings pairs together: the
    upper is looked up by that one of its concrete nodes that fewest trees
    have, then the whole trees are compared. Null trees include each other.
    """

    @F.pandas_udf("struct<has: array<string>, asks: array<string>>")
    def keys(trees: pd.Series) -> pd.DataFrame:
        out = []
        for t in map(load_tree, trees):
            found = [("none", "", True)] if t is None else list(_node_keys(t))
            out.append(([f"{p} {n}" for p, n, _ in found], [f"{p} {n}" for p, n, asked in found if asked]))
        return pd.DataFrame(out, columns=["has", "asks"])

    @F.pandas_udf("boolean")
    def specialises(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(x is None and y is None) or (x is not None and y is not None and includes(x, y)) for x, y in zip(map(load_tree, a), map(load_tree, b), strict=True)], dtype=bool)

    trees = patterns.select(F.col("template_id").alias("id"), *within, F.col(tree).alias("tree"))
    index = materialise(trees.select("id", *within, keys("tree").alias("k")).select("id", *within, F.transform("k.has", lambda x: F.xxhash64(x)).alias("has"), F.transform("k.asks", lambda x: F.xxhash64(x)).alias("asks")), "index")
    has = index.select(F.col("id").alias("lower"), *within, F.explode("has").alias("key"))
    often = has.groupBy(*within, "key").agg(F.count("*").alias("n"))
    asks = index.select(F.col("id").alias("upper"), *within, F.explode("asks").alias("key")).join(often, [*within, "key"])
    rarest = asks.groupBy("upper", *within).agg(F.min(F.struct("n", "key")).alias("m")).select("upper", *within, "m.key")
    met = has.join(rarest, [*within, "key"]).where("lower <> upper").select("lower", "upper").distinct()
    side = lambda k: trees.select(F.col("id").alias(k), F.col("tree").alias(f"{k}_tree"))
    return met.join(side("lower"), "lower").join(side("upper"), "upper").where(specialises("lower_tree", "upper_tree")).select("lower", "upper")


def patches(cases: DataFrame, forest: DataFrame, groups: int = 10, per_group: int = 10, per_template: int = 21) -> DataFrame:
    """(case, template_id, action, rank, source) for cases (case, source, lines, added).

    Templates are chosen by ``selected``, less those that others include. Of the
    groups of templates with one whole before side the ``groups`` least
    generalised stay, and of each the ``per_group`` with the most instances;
    insertions are grouped by the heads of what they insert, and all groups
    stay. Each is applied where its context fits (functions.edits).
    """
    added = F.col("added") if "added" in cases.columns else F.lit(False)
    asked = materialise(cases.select("case", "source", F.col("lines").cast("array<int>").alias("lines"), added.alias("added")), "cases")
    chosen, _ = selected(asked, forest)
    known = materialise(_known(forest).withColumn("together", F.when(F.col("kind") == "+", F.col("tops")).otherwise(F.col("fp_before"))), "known")
    in_group = Window.partitionBy("case", "together").orderBy(F.desc("instances"), "template_id")
    by_group = Window.partitionBy("case").orderBy("ratio", "together")
    ranked = without_included(materialise(chosen, "selected"), known).join(known, "template_id").withColumn("r", F.row_number().over(in_group)).where(F.col("r") <= per_group).withColumn("g", F.dense_rank().over(by_group)).where((F.col("g") <= groups) | (F.col("action") == "Add"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.astype(object).where(b.notna(), None).to_dict("records"):
                for k, text in enumerate(apply_in_context(r["source"], load_template(r), list(r["lines"]), most_patches=per_template)):
                    rows.append((r["case"], r["template_id"], r["action"], int(r["g"]), int(r["r"]), k, text))
            yield pd.DataFrame(rows, columns=["case", "template_id", "action", "grp", "r", "k", "source"], dtype=object)

    made = ranked.select("case", "template_id", "g", "r", *_SIDES).join(asked, "case").mapInPandas(write, "case string, template_id string, action string, grp int, r int, k int, source string")
    order = Window.partitionBy("case").orderBy("grp", "r", "template_id", "k")
    return made.withColumn("rank", F.row_number().over(order)).select("case", "template_id", "action", "rank", "source")


def echo_model(prompts: list[dict]) -> list[list[str]]:
    """Stands in for a sequence-to-sequence model: fills every mask with None, then with 0."""
    return [[" ".join(f"<extra_id_{k}> {v}" for k in range(p["masks"])) for v in ("None", "0")] for p in prompts]


def attempts(found: DataFrame, model: Callable[[list[dict]], list[list[str]]] = echo_model, done: DataFrame | None = None, seconds: float | None = 7200) -> DataFrame:
    """(case, rank, candidate, origin, reason) for patches (case, rank, source): every candidate, and every patch that has none with the reason.

    Patches without a mask pass as they are; the others are filled by
    ``model``. Cases in ``done`` are not asked for again, so what is written is
    where a run resumes. A case has ``seconds`` for all its patches: when they
    are over, what it has so far stays, the rest of its patches are ``out of
    time``, and other cases go on. A case's failure is its own, too.
    """
    todo = found if done is None else found.join(done.select("case").distinct(), "case", "left_anti")

    def of_case(rows: list[dict], out: list[tuple]) -> None:
        for r in rows:
            prompt = build_prompt(r["source"])
            if prompt is None:
                masked = "VALUE_MASK" in r["source"]
                out.append((r["case"], r["rank"], None if masked else r["source"], None if masked else "patch", "no prompt within the budget" if masked else None))
                continue
            (answers,) = model([prompt])
            filled = sorted({text for a in answers if (text := fill(r["source"], a)) is not None})
            out += [(r["case"], r["rank"], text, "model", None) for text in filled] or [(r["case"], r["rank"], None, None, "no prediction fits")]

    return _attempted(todo.select("case", "rank", "source"), of_case, seconds)


def line_attempts(cases: DataFrame, model: Callable[[list[dict]], list[list[str]]] = echo_model, done: DataFrame | None = None, seconds: float | None = 7200, levels: int = 4) -> DataFrame:
    """(case, rank, candidate, origin, reason) for cases (case, source, lines, added): whole lines written anew, without templates.

    ``model`` is asked for the lines themselves, and what it gives is tried at
    every indent (rewriting.indented); ``added`` is 0 or null, 1 for an
    insertion before the line, 2 for one after it. Deadline, rejects and
    resuming are those of ``attempts``; a case without lines is a reject.
    """
    todo = cases if done is None else cases.join(done.select("case").distinct(), "case", "left_anti")

    def of_case(rows: list[dict], out: list[tuple]) -> None:
        for r in rows:
            lines, added = [int(k) for k in r["lines"]] if r["lines"] is not None else [], 0 if pd.isna(r["added"]) else int(r["added"])
            prompt = line_prompt(r["source"], lines, added) if lines and r["source"] is not None else None
            if prompt is None:
                out.append((r["case"], r["rank"], None, None, "no prompt within the budget" if lines and r["source"] is not None else "no lines"))
                continue
            seen: set[str] = set()
            for answer in model([prompt])[0]:
                for text in fill_lines(r["source"], lines, answer, added, levels):
                    if text not in seen:
                        seen.add(text)
                        out.append((r["case"], r["rank"], text, "lines", None))
            if not seen:
                out.append((r["case"], r["rank"], None, None, "no prediction fits"))

    return _attempted(todo.select("case", F.lit(0).alias("rank"), "source", F.col("lines").cast("array<int>").alias("lines"), F.col("added").cast("int").alias("added")), of_case, seconds)


def _attempted(todo: DataFrame, of_case: Callable[[list[dict], list[tuple]], None], seconds: float | None) -> DataFrame:
    """What ``of_case`` appends for the rows of one case after another, each within ``seconds``; a rank that it did not come to has the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _cases(batches):
            out: list[tuple] = []
            reason = None
            try:
                with deadline(seconds):
                    of_case(rows, out)
            except OutOfTime:
                reason = "out of time"
            except Exception as error:  # noqa: BLE001  the model's, whatever it is
                reason = f"failed: {type(error).__name__}"
            met = {rank for _, rank, *_ in out}
            out += [(r["case"], r["rank"], None, None, reason) for r in rows if r["rank"] not in met]
            yield pd.DataFrame(out, columns=["case", "rank", "candidate", "origin", "reason"], dtype=object)

    by_case = todo.repartition("case").sortWithinPartitions("case", "rank")
    return by_case.mapInPandas(run, "case string, rank int, candidate string, origin string, reason string").distinct()


def _cases(batches: Iterator[pd.DataFrame]) -> Iterator[list[dict]]:
    """Rows of one case after another, of batches sorted by case."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_dict("records"):
            if held and held[0]["case"] != r["case"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def candidates(found: DataFrame, model: Callable[[list[dict]], list[list[str]]] = echo_model, done: DataFrame | None = None, seconds: float | None = 7200) -> DataFrame:
    """(case, rank, candidate, origin): the candidates among ``attempts``."""
    return attempts(found, model, done, seconds).where("reason is null").drop("reason")


def write_patches(found: DataFrame, path: str) -> None:
    """Patches as JSON lines, in the order of their ranks, a folder for each case."""
    found.repartition("case").sortWithinPartitions("case", "rank").write.mode("overwrite").partitionBy("case").json(path)


# -- evaluation -----------------------------------------------------------------


def _judge(df: DataFrame, text: str, kernel: Callable[[str, str], bool]) -> DataFrame:
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernel(x, y) for x, y in zip(a, b, strict=True)])

    return df.withColumn("hit", run(F.col(text), F.col("fixed")))


def coverage(found: DataFrame, fixes: DataFrame) -> DataFrame:
    """One row: cases, cases with patches, matched ones, match rate of those, mean rank of the first match (null if none)."""
    hits = _judge(found.join(fixes, "case"), "source", fits_fix).groupBy("case").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    per = fixes.select("case").distinct().join(hits.withColumn("patched", F.lit(1)), "case", "left")
    return per.agg(F.count("*").alias("cases"), F.count("patched").alias("patched"), F.count("first").alias("matched"), (F.count("first") / F.nullif(F.count("patched"), F.lit(0))).alias("rate"), F.avg("first").alias("mean_rank"))


def exact_matches(filled: DataFrame, fixes: DataFrame) -> DataFrame:
    """(case, fixed): whether any candidate is the fix, comments apart."""
    hits = _judge(filled.join(fixes, "case"), "candidate", exactly_fixes).groupBy("case").agg(F.bool_or("hit").alias("solved"))
    return fixes.select("case").distinct().join(hits, "case", "left").select("case", F.coalesce("solved", F.lit(False)).alias("solved"))


def plausible(results: DataFrame) -> DataFrame:
    """(case, file, patches): distinct passing patches from result rows (case, file, status, patch)."""
    return results.where("status = 'True'").groupBy("case", "file").agg(F.sort_array(F.collect_set("patch")).alias("patches"))
