"""Mining templates: hunks with their sources, to changes, to a forest of generalised templates."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import kernels
from ..functions.changes import Template, mine_change
from ..functions.kernels import dice, leaf_paths, leaf_similarity, pattern_dice
from ..functions.merging import abstracted, place_signature
from ..functions.trees import Tree, exact_fingerprint, pack, shape_fingerprint, unpack
from ..functions.vocabulary import ABSTRACTED, REFERRED
from ..session import materialise

SIDES = ("before", "after", "within", "before_context", "after_context")
PRINTS = ("fp_pattern", "fp_shape", "fp_within", "fp_outer", "fp_after", "fp_after_shape", "fp_ties", "places_at")
TEMPLATE_SCHEMA = "action string, before string, after string, within string, before_context string, after_context string, places string, " + ", ".join(f"{p} string" for p in PRINTS) + ", block string"


def dump_tree(t: Tree | None) -> str | None:
    return None if t is None else json.dumps(pack(t))


def load_tree(text: str | None) -> Tree | None:
    return None if text is None else unpack(json.loads(text))


def template_row(t: Template) -> dict:
    """A template as a row, with fingerprints of its parts, and the key that comparable ones share.

    What is tied is told apart by fp_ties alone: a value counts as ABSTRACTED
    whether it is tied or not.
    """
    sides = {s: getattr(t, s) for s in SIDES}
    plain = {s: None if x is None else _untied(x) for s, x in sides.items()}
    fp = lambda f, *names: "|".join("-" if plain[n] is None else f(plain[n]) for n in names)
    exact = lambda x: exact_fingerprint(x, alias=False)
    width = lambda x: -1 if x is None else len(x.children)
    return {
        "action": t.action,
        **{s: dump_tree(x) for s, x in sides.items()},
        "places": dump_places(t),
        "fp_pattern": fp(exact, "before", "after"),
        "fp_shape": fp(shape_fingerprint, "before", "after"),
        "fp_within": fp(exact_fingerprint, "within") + json.dumps([t.before_places, t.after_places]),
        "fp_outer": fp(exact_fingerprint, "before_context", "after_context"),
        "fp_after": fp(exact, "after"),
        "fp_after_shape": fp(shape_fingerprint, "after"),
        "fp_ties": json.dumps(sorted(sorted(g) for g in t.links)),
        "places_at": place_signature(t),
        "block": f"{width(t.before)}/{width(t.after)}",
    }


def _untied(t: Tree) -> Tree:
    return replace(t, value=ABSTRACTED if t.value == REFERRED else t.value, children=tuple(map(_untied, t.children)))


def dump_places(t: Template) -> str:
    """Where the sides' pieces hang in the shared context, and which nodes are tied."""
    return json.dumps([t.before_places, t.after_places, t.links])


def load_template(row: dict) -> Template:
    before, after, *links = json.loads(row["places"] or "[]") or [[], []]
    fixed = [tuple((tuple(p), role, k) for p, role, k in side) for side in (before, after)]
    tied = tuple(tuple((side, k) for side, k in group) for group in (links[0] if links else ()))
    return Template(row["action"], load_tree(row["before"]), load_tree(row["after"]), load_tree(row["within"]), *fixed, load_tree(row["before_context"]), load_tree(row["after_context"]), tied)


def change_templates(hunks: DataFrame, sources: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(templates, rejects) of hunks joined to the file versions they apply to.

    hunks: keys, before_path, after_path, loc, content, b_start, a_start;
    sources: keys, before_path, after_path, before_source, after_source. A
    reject carries the reason; nothing is lost in silence.
    """
    joined = hunks.join(sources, [*keys, "before_path", "after_path"])
    names = [*keys, "before_path", "after_path", "loc", "content"]
    kinds = dict(joined.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", reason string, " + TEMPLATE_SCHEMA

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*names, "reason", *(c.split()[0] for c in TEMPLATE_SCHEMA.split(", "))]
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                found, reason = mine_change(r["before_source"], r["after_source"], r["content"], r["b_start"], r["a_start"])
                rows.append({n: r[n] for n in names} | {"reason": reason} | (template_row(found) if found else {}))
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    mined = materialise(joined.mapInPandas(run, schema), "changes")
    return mined.where("reason = 'ok'").drop("reason"), mined.where("reason <> 'ok'").select(*names, "reason")


SAME = ("action", "block", "fp_pattern", "fp_within", "fp_outer", "fp_ties")


def merge_identical(templates: DataFrame, copies: str | None = None) -> DataFrame:
    """Templates that are equal in all their parts as one, with their number of instances: an aggregate by fingerprint. A row counts once, or as often as ``copies`` says."""
    sides = [F.min(s).alias(s) for s in (*SIDES, "places", "fp_shape", "fp_after", "fp_after_shape", "places_at")]
    return templates.groupBy(*SAME).agg((F.sum(copies) if copies else F.count("*")).alias("instances"), *sides)


#: Steps in order: number, what is generalised, the actions it is for (None: all), the columns that members of a group share. Those without a column of shapes choose among all of a block.
STEPS: tuple[tuple[int, str, tuple[str, ...] | None, tuple[str, ...]], ...] = (
    (2, "outer", None, ("fp_pattern", "fp_within")),
    (3, "within", None, ("fp_pattern", "places_at")),
    (4, "pattern", ("Add", "Remove", "Replace", "Shuffle"), ("fp_shape", "places_at")),
    (5, "pattern", ("Add", "Remove", "Replace", "Shuffle"), ("places_at",)),
    (6, "loose", ("Remove", "Replace"), ("fp_shape",)),
    (7, "loose", ("Remove", "Replace"), ()),
    (4, "before", ("Insert",), ("fp_after", "places_at")),
    (5, "after", ("Insert",), ("fp_after_shape", "places_at")),
    (6, "after", ("Insert",), ("places_at",)),
    (7, "loose_after", ("Insert",), ("fp_after_shape",)),
    (8, "loose_after", ("Insert",), ()),
)
FREE = (("places_at",), ())
TILE = 256


def step_score(step: str, a: Template, b: Template) -> float:
    """How alike two templates of a group are in what the step generalises; insertions' before sides of one shape come first."""
    if step == "outer":
        return sum(leaf_similarity(x, y) or 0.0 for x, y in ((a.before_context, b.before_context), (a.after_context, b.after_context)))
    if step == "within":
        return dice(a.within, b.within) or 0.0
    if step == "before":
        return (dice(a.before, b.before) or 0.0) + kernels.alike_trees(a.before, b.before)
    if step in ("after", "loose_after"):
        return dice(a.after, b.after) or 0.0
    return pattern_dice((a.before, b.before), (a.after, b.after)) or 0.0


def _features(step: str, t: Template) -> list[Counter | None]:
    """What two templates must share for a high score: labels of nodes, of each tree that is scored on its own."""
    if step == "outer":
        return [None if x is None else Counter(n.label for p in leaf_paths(x) for n in p) for x in (t.before_context, t.after_context)]
    sides = {"within": ("within",), "before": ("before",), "after": ("after",), "loose_after": ("after",)}.get(step, ("before", "after"))
    return [Counter((s, n.label) for s in sides if (x := getattr(t, s)) is not None for n in x.walk())]


def _bounds(step: str, left: list[Template], right: list[Template]) -> np.ndarray:
    """Scores that pairs cannot exceed, from the nodes they have in common: products of tables of occurrences."""
    out = np.zeros((len(left), len(right)))
    smooth = step == "outer"
    for one, two in zip(zip(*(_features(step, t) for t in left), strict=True), zip(*(_features(step, t) for t in right), strict=True), strict=True):
        place: dict[tuple, int] = {}
        at = [[[place.setdefault((f, k), len(place)) for f, n in (c or {}).items() for k in range(n)] for c in side] for side in (one, two)]
        tables = [np.zeros((len(side), len(place)), np.float32) for side in at]
        for table, side in zip(tables, at, strict=True):
            for i, where in enumerate(side):
                table[i, where] = 1
        total = tables[0].sum(axis=1)[:, None] + tables[1].sum(axis=1)[None, :]
        part = (2 * (tables[0] @ tables[1].T) + smooth) / np.maximum(total + smooth, 1)
        none = [np.asarray([c is None for c in side]) for side in (one, two)]
        part[none[0][:, None] & none[1][None, :]] = 1.0
        part[none[0][:, None] ^ none[1][None, :]] = 0.0
        out += part
    return out + (step == "before") + 1e-6


def nearest_partners(step: str, own: list[tuple[str, Template]], other: list[tuple[str, Template]] | None) -> list[tuple[str, str, float]]:
    """(id, partner, score): each template's most similar one, ties to the least id, of the other list, or of its own.

    Partners are compared from the highest bound down until none can be better.
    """
    second = own if other is None else other
    bound = _bounds(step, [t for _, t in own], [t for _, t in second])
    known: dict[tuple[str, str], float] = {}
    out = []
    for left, right, table in ((own, second, bound), *(((second, own, bound.T),) if other is not None else ())):
        ids = np.asarray([k for k, _ in right])
        for i, (k, t) in enumerate(left):
            best: tuple[float, str] | None = None
            for j in np.lexsort((ids, -table[i])):
                if best is not None and table[i][j] < -best[0]:
                    break
                k2, t2 = right[j]
                if k2 == k:
                    continue
                key = (min(k, k2), max(k, k2))
                if key not in known:
                    known[key] = step_score(step, t, t2)
                best = min(best, (-known[key], k2)) if best else (-known[key], k2)
            if best:
                out.append((k, best[1], -best[0]))
    return out


def _best_pairs(members: DataFrame, least: float) -> DataFrame:
    """(a, b, step) with a < b: templates of a group (step, g) that are each other's most similar ones.

    A group is dealt into tiles of some 256; every pair of tiles is compared by
    its own key, so a group of any size is many tasks.
    """
    sizes = members.groupBy("g").agg(F.count("*").alias("n"))
    dealt = members.join(sizes, "g").withColumn("tiles", F.expr(f"cast((n - 1) div {TILE} + 1 as int)")).withColumn("tile", F.expr("cast(pmod(xxhash64(id), tiles) as int)"))
    row = F.struct("id", "action", *SIDES, "places")
    tiles = materialise(dealt.groupBy("g", "step", "free", "tiles", "tile").agg(F.collect_list(row).alias("m")), "tiles")
    left = tiles.select("g", "step", "free", F.col("tile").alias("own"), F.col("m").alias("l"), F.explode(F.expr("transform(sequence(0, tiles div 2), d -> (tile + d) % tiles)")).alias("tile"))
    units = left.join(tiles.select("g", "tile", F.col("m").alias("r")), ["g", "tile"]).select("step", "free", "l", F.when(F.col("own") != F.col("tile"), F.col("r")).alias("r"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lambda side: [(r["id"], load_template(r)) for r in side]
        for b in batches:
            for step, free, own, other in b.itertuples(index=False):
                found = nearest_partners(step, made(own), None if other is None else made(other))
                yield pd.DataFrame([(step, *x) for x in found if not free or x[2] >= least], columns=["step", "a", "b", "score"])

    each = units.mapInPandas(run, "step string, a string, b string, score double").groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b", "step")).alias("m")).select("a", "m.b", "m.step")
    each = materialise(each, "partners")
    back = each.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return each.join(back, ["a", "b"]).where("a < b").select("a", "b", "step")


def _above(step: str, a: dict, b: dict) -> list[tuple[str, dict]]:
    """(child, row with id and instances) for both of a pair of rows: what the step makes above them; a child that is so already keeps its id."""
    rows = [template_row(t) for t in abstracted(step, load_template(a), load_template(b))]
    out = []
    for k, t in enumerate((a, b)):
        r = rows[min(k, len(rows) - 1)]
        kept = len(rows) > 1 and all(r[c] == t[c] for c in SAME[2:])
        name = t["id"] if kept else "t" + hashlib.blake2b(f"{step} {a['id']} {b['id']} {k if len(rows) > 1 else ''}".encode(), digest_size=12).hexdigest()
        out.append((t["id"], {"id": name, "instances": int(t["instances"] if len(rows) > 1 else a["instances"] + b["instances"])} | r))
    return out


def _raised(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """(child, id, …template columns): the templates that a step makes above the pairs (a, b, step), a row for each child."""
    schema = "child string, id string, instances long, " + TEMPLATE_SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]
    needed = ("action", *SIDES, "places", "instances", *SAME[2:])
    side = lambda k: live.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in needed])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                a, b = ({"id": r[k]} | {c: r[f"{k}_{c}"] for c in needed} for k in ("a", "b"))
                out += [{"child": child} | row for child, row in _above(r["step"], a, b)]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, schema)


def _mine_block(rows: list[dict], least: float) -> tuple[dict[str, dict], dict[str, str], dict[str, str]]:
    """The rounds of ``mine`` for one block of bounded size: all templates by id, child -> parent, and which became one with which."""
    live = {r["id"]: r for r in rows}
    found, parent, same, last = dict(live), {}, {}, 0
    while True:
        todo: list[tuple[str, bool, list[str]]] = []
        number = 0
        for number, step, actions, key in sorted(STEPS, key=lambda s: s[0]):
            if number <= last or actions is not None and rows[0]["action"] not in actions:
                continue
            groups: dict[tuple, list[str]] = {}
            for k in sorted(live):
                if step != "within" or live[k]["within"] is not None:
                    groups.setdefault(tuple(live[k][c] for c in key), []).append(k)
            todo = [(step, key in FREE, g) for g in groups.values() if len(g) > 1]
            if todo:
                break
        if not todo:
            return found, parent, same
        new = []
        for step, free, group in todo:
            best = {a: (b, s) for a, b, s in nearest_partners(step, [(k, load_template(live[k])) for k in group], None) if not free or s >= least}
            new += [x for a, (b, _) in best.items() if a < b and best.get(b, ("",))[0] == a for x in _above(step, live[a], live[b])]
        new = [(child, r) for child, r in new if child != r["id"]]
        last = 0 if new else number
        for child, r in new:
            parent[child] = r["id"]
            live.pop(child)
        for _, r in new:
            live[r["id"]] = found[r["id"]] = r
        equal: dict[tuple, list[str]] = {}
        for k in sorted(live):
            equal.setdefault(tuple(live[k][c] for c in SAME), []).append(k)
        for rep, *others in equal.values():
            if others:
                live[rep] = found[rep] = live[rep] | {"instances": sum(live[k]["instances"] for k in (rep, *others))}
                same |= dict.fromkeys(others, rep)
                for k in others:
                    live.pop(k)


COLUMNS = ["id", "instances", *[c.split()[0] for c in TEMPLATE_SCHEMA.split(", ")]]


def distinct_templates(templates: DataFrame, copies: str | None = None) -> DataFrame:
    """(id, instances, …template columns) of the templates that differ, each under a digest of what it is."""
    return merge_identical(templates, copies).withColumn("id", F.concat(F.lit("o"), F.md5(F.concat_ws("~", *SAME)))).select(*COLUMNS)


def mine(templates: DataFrame, least: float = 0.0, alone: int = 512, rounds: int = 1000, copies: str | None = None) -> DataFrame:
    """(template_id, parent_id, action, …sides, places, instances): the forest of generalised templates.

    Only templates of one action and block (which sides there are, and how many
    trees each has) can be compared. Equal ones are one, by an aggregate. Then
    in each round every block does the first of STEPS that it has a group for:
    in each group the pairs of templates that are each other's most similar
    ones, ties to the least id, get parents that are alike in what the step
    generalises (functions.merging.abstracted), and so come together in a later
    round. Groups whose best pair is less alike than ``least`` are left in the
    steps that choose among all of a block. What is left in the end are the roots.

    Blocks of up to ``alone`` live templates go through their rounds in one
    task each. The state of larger ones is in tables, written once a round: the
    live templates, edges from child to parent, and which templates became one;
    their groups are compared in tiles, so no block or group is one task, until
    few enough are left. The result does not depend on ``alone``. A row of
    ``templates`` is an instance, or as many as its column ``copies`` says.
    """
    return mine_distinct(distinct_templates(templates, copies), least, alone, rounds).drop("block")


def mine_distinct(templates: DataFrame, least: float = 0.0, alone: int = 512, rounds: int = 1000) -> DataFrame:
    """The forest that ``mine`` makes, with each template's block, from what ``distinct_templates`` gives."""
    columns = COLUMNS
    live = materialise(templates.select(*columns), "templates")
    nodes, edges, same, small, stuck = [live], [], [], [], None
    for _ in range(rounds):
        sizes = live.groupBy("action", "block").agg(F.count("*").alias("n"))
        crowded = sizes.where(F.col("n") > alone).select("action", "block")
        small.append(live.join(crowded, ["action", "block"], "left_anti").select(*columns))
        live = materialise(live.join(crowded, ["action", "block"], "left_semi").select(*columns), "crowded")
        if live.isEmpty():
            break
        live, stuck, moved = _round(live, stuck, least, columns)
        if moved is None:
            small.append(live.limit(0))
            nodes.append(live)
            break
        nodes += moved[0]
        edges += moved[1]
        same += moved[2]
    kinds = "kind string, id string, other string, instances long, " + TEMPLATE_SCHEMA

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        found, parent, one = _mine_block(pdf.astype(object).where(pdf.notna(), None).sort_values("id").to_dict("records"), least)
        out = [{"kind": "node"} | r for r in found.values()]
        out += [{"kind": kind, "id": k, "other": v, "action": pdf["action"].iloc[0], "block": pdf["block"].iloc[0]} for kind, links in (("edge", parent), ("same", one)) for k, v in links.items()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")], dtype=object)

    rest = materialise(reduce(DataFrame.unionByName, small).groupBy("action", "block").applyInPandas(finish, kinds), "blocks")
    nodes.append(rest.where("kind = 'node'").select(*columns))
    edges.append(rest.where("kind = 'edge'").select(F.col("id").alias("child"), F.col("other").alias("parent")))
    same.append(rest.where("kind = 'same'").select(F.col("id").alias("member"), F.col("other").alias("rep")))
    return _forest(nodes, edges, same)


def _round(live: DataFrame, stuck: DataFrame | None, least: float, columns: list[str]) -> tuple[DataFrame, DataFrame | None, tuple | None]:
    """One round of all blocks, in tables: what is live then, (action, block, last) of blocks whose step found no pair, and new nodes, edges, equal ones; None if no block has a step left."""
    groups = None
    for number, step, actions, key in STEPS:
        own = live if actions is None else live.where(F.col("action").isin(*actions))
        own = own.where("within is not null") if step == "within" else own
        part = own.select("id", "action", "block", F.lit(number).alias("number"), F.lit(step).alias("step"), F.lit(key in FREE).alias("free"), F.md5(F.concat_ws("~", F.lit(str(number)), "action", "block", *key)).alias("g"))
        groups = part if groups is None else groups.unionByName(part)
    several = groups.groupBy("g", "action", "block", "number").agg(F.count("*").alias("n")).where("n > 1")
    if stuck is not None:
        several = several.join(stuck, ["action", "block"], "left").where("last is null or number > last").drop("last")
    first = materialise(several.groupBy("action", "block").agg(F.min("number").alias("number")), "steps")
    if first.isEmpty():
        return live, stuck, None
    chosen = several.join(first, ["action", "block", "number"], "left_semi").select("g")
    members = groups.join(chosen, "g", "left_semi").select("id", "g", "step", "free").join(live.drop(*PRINTS), "id")
    raised = materialise(_raised(_best_pairs(members, least), live), "raised")
    new = raised.where("child <> id")
    failed = first.join(new.select("action", "block").distinct(), ["action", "block"], "left_anti").select("action", "block", F.col("number").alias("last"))
    stuck = materialise(failed if stuck is None else stuck.join(first, ["action", "block"], "left_anti").unionByName(failed), "stuck")
    made = new.dropDuplicates(["id"]).select(*columns)
    pool = materialise(live.join(new.select(F.col("child").alias("id")), "id", "left_anti").select(*columns).unionByName(made), "pool")
    # equal ones become one: the one with the least id, which has their instances
    one = pool.groupBy(*SAME).agg(F.min("id").alias("rep"), F.sum("instances").alias("total"), F.count("*").alias("n")).where("n > 1")
    gone = materialise(pool.join(one, list(SAME)).where("id <> rep").select(F.col("id").alias("member"), "rep", "total"), "same")
    left = pool.join(gone.select(F.col("member").alias("id")), "id", "left_anti").join(gone.select(F.col("rep").alias("id"), "total").distinct(), "id", "left")
    live = materialise(left.withColumn("instances", F.coalesce("total", "instances")).select(*columns), "live")
    return live, stuck, ([made, live], [new.select("child", F.col("id").alias("parent"))], [gone.select("member", "rep")])


def _forest(nodes: list[DataFrame], edges: list[DataFrame], same: list[DataFrame]) -> DataFrame:
    """The forest of all templates made, those that became one put together."""
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    alias = materialise(union(same), "alias")
    while True:  # what became one with a template that later became one with another
        up = alias.select(F.col("member").alias("m"), F.col("rep").alias("r"))
        longer = alias.join(up, alias["rep"] == up["m"], "left")
        if longer.where("r is not null").isEmpty():
            break
        alias = materialise(longer.select("member", F.coalesce("r", "rep").alias("rep")), "alias")
    every = union(nodes).groupBy("id").agg(F.max(F.struct("instances", "action", "block", *SIDES, "places")).alias("t")).join(alias.select(F.col("member").alias("id")), "id", "left_anti")
    tree = union(edges).join(alias.select(F.col("member").alias("parent"), "rep"), "parent", "left").select("child", F.coalesce("rep", "parent").alias("parent"))
    out = every.join(tree.withColumnRenamed("child", "id"), "id", "left")
    return out.select(F.col("id").alias("template_id"), F.col("parent").alias("parent_id"), "t.action", "t.block", "t.instances", *[f"t.{s}" for s in SIDES], "t.places")


def without_singles(forest: DataFrame) -> DataFrame:
    """Templates with more than one instance: a parent has its children's instances, so what hangs under one that goes has one, too."""
    return forest.where("instances > 1")


def supported(forest: DataFrame, least: int = 5, below: int = 10) -> DataFrame:
    """Templates with enough instances: roots ``least``, others ``below``; what hangs under one that lacks them goes too."""
    roots = forest.where(F.col("parent_id").isNull() & (F.col("instances") >= least))
    kept, level = roots, roots
    while True:
        level = materialise(forest.join(level.select(F.col("template_id").alias("parent_id")), "parent_id").where(F.col("instances") >= below).select(*forest.columns), "level")
        if level.isEmpty():
            return kept
        kept = kept.unionByName(level)


def top_templates(forest: DataFrame, n: int) -> DataFrame:
    """The ``n`` templates of each action with the most instances."""
    from ..operators.relational import top_n

    return top_n(forest, n, ["action"], [F.desc("instances"), F.col("template_id")])
