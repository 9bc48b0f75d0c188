"""Templates in their context: every change reproduces itself, edits stay at the lines, ties bind, selection descends the forest."""

import ast
import difflib
import random

import pytest
from forests import forest_rows

from arborlake.functions import edits, kernels
from arborlake.functions.changes import Template, changed_lines, mine_change, tied_nodes
from arborlake.functions.merging import merged
from arborlake.functions.trees import Tree, build, exact_fingerprint, parse, root
from arborlake.functions.vocabulary import ABSTRACTED, REFERRED
from arborlake.plans import mining, patching, training, tree_queries
from arborlake.plans.tree_queries import CHANGES


def some_source(pick):
    """A function of a few statements, among them nested ones."""
    name = lambda: pick.choice("abcdefg")
    value = lambda: pick.choice([name(), f"{name()}.{name()}", f"{name()}({name()}, {pick.randint(0, 9)})", f"{name()}[{name()}]", repr(pick.choice(["x", "yy"])), str(pick.randint(0, 99))])
    out = [f"def {pick.choice(['run', 'load', 'save'])}({', '.join(sorted({name(), name()}))}):"]
    for _ in range(pick.randint(3, 6)):
        kind = pick.randint(0, 4)
        if kind == 0:
            out += [f"    if {value()} == {value()}:", f"        {name()} = {value()}"]
        elif kind == 1:
            out += [f"    for {name()} in {name()}.{name()}({value()}):", f"        {name()}({value()}, key={value()})", f"        {name()} += {value()}"]
        else:
            out.append(pick.choice([f"    {name()} = {value()} + {value()}", f"    {name()}({value()}, k={value()})", f"    {name()}.{name()}[{value()}] = {value()}"]))
    return "\n".join([*out, f"    return {value()}", ""])


def some_change(pick, source):
    """The source with one expression changed, one statement taken out, or one put in."""
    module = ast.parse(source)
    kind = pick.choice(["wrap", "wrap", "swap", "attribute", "keyword", "guard", "remove", "insert", "argument", "rename"])
    nodes = [x for x in ast.walk(module) if isinstance(x, ast.expr) and isinstance(getattr(x, "ctx", ast.Load()), ast.Load)]
    node = pick.choice(nodes)

    class Change(ast.NodeTransformer):
        done = False

        def visit(self, x):
            if x is node and not self.done:
                self.done = True
                if kind == "wrap":
                    return ast.Call(ast.Name("str", ast.Load()), [x], [])
                if kind == "swap":
                    return ast.Constant(None)
                if kind == "attribute":
                    return ast.Attribute(x, "body", ast.Load())
                if kind == "rename":
                    return ast.Name("zz", ast.Load())
                if isinstance(x, ast.Call):
                    if kind == "keyword":
                        x.keywords.append(ast.keyword("extra", ast.Constant(1)))
                    if kind == "argument":
                        x.args.insert(0, ast.Name("first", ast.Load()))
            return self.generic_visit(x)

    blocks = [x.body for x in ast.walk(module) if isinstance(getattr(x, "body", None), list) and not isinstance(x, ast.Module)]
    body = pick.choice(blocks)
    if kind == "remove" and len(body) > 1:
        del body[pick.randrange(len(body))]
    elif kind == "insert":
        body.insert(pick.randrange(len(body) + 1), ast.parse("checked(a, 'new')").body[0])
    elif kind == "guard":
        k = pick.randrange(len(body))
        body[k] = ast.If(ast.parse("ready is not None", mode="eval").body, [body[k]], [])
    else:
        module = Change().visit(module)
    return ast.unparse(ast.fix_missing_locations(module)) + "\n"


def hunk(before, after):
    """(content, lines of both starts) of the whole difference as one hunk without context."""
    a, b = before.split("\n"), after.split("\n")
    ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
    if not ops:
        return None
    lo, hi, lo2, hi2 = ops[0][1], ops[-1][2], ops[0][3], ops[-1][4]
    content = "\n".join([*("-" + x for x in a[lo:hi]), *("+" + x for x in b[lo2:hi2])])
    return content, lo + 1, lo2 + 1


def own_patches(before, after, content, b_start, a_start, template=None):
    t = template or mine_change(before, after, content, b_start, a_start)[0]
    lines = changed_lines(content, b_start, a_start)[0] or [b_start]
    lines = lines if any(s.lineno <= lines[0] <= s.end_lineno for s in ast.walk(ast.parse(before)) if isinstance(s, ast.stmt)) else [b_start - 1]
    return edits.apply_in_context(before, t, lines), lines


@pytest.mark.parametrize("change", CHANGES, ids=[c[0] for c in CHANGES])
def test_every_change_reproduces_itself(change):
    got, _ = own_patches(*change[1:])
    assert ast.unparse(ast.parse(change[2])) in got


def test_random_changes_reproduce_themselves():
    pick, seen, missed = random.Random(11), 0, []
    while seen < 200:
        before = some_source(pick)
        after = some_change(pick, before)
        found = hunk(before, after)
        if found is None:
            continue
        t, reason = mine_change(before, after, *found)
        if t is None:
            assert reason in ("noise", "no change of statements")
            continue
        seen += 1
        got, lines = own_patches(before, after, *found, t)
        if ast.unparse(ast.parse(after)) not in got:
            missed.append((before, after, t.action))
        if t.action != "Add" or t.within is not None:
            for text in got:
                moved = hunk(before, text + "\n")
                at = set(changed_lines(*moved)[2])
                # a changed line of the source belongs to a statement at the lines
                assert all(any(s.lineno <= k <= s.end_lineno and any(s.lineno <= x <= s.end_lineno for x in lines) for s in ast.walk(ast.parse(before)) if isinstance(s, ast.stmt) and not isinstance(s, (ast.FunctionDef, ast.For, ast.If))) or k in lines for k in at), (before, text, lines)
    assert not missed, (len(missed), *missed[0])


def test_a_pattern_keeps_what_it_does_not_mention():
    wrap1, wrap2 = (mine_change(*c[1:])[0] for c in CHANGES[:2])
    both = merged(wrap1, wrap2)
    assert REFERRED in {n.value for n in both.after.walk()}
    got = edits.apply_in_context("def r(e, n):\n    return json(n.keys(1), indent=e)\n", both, [2])
    assert got == ["def r(e, n):\n    return json(encode(n.keys(1)), indent=e)"] or "indent=e" in got[0]


def test_edits_stay_at_the_lines():
    cast = merged(*(mine_change(*c[1:])[0] for c in CHANGES[4:6]))
    source = "def q(w):\n    z = 'q' + w\n    print(w.keys())\n    k = 'u' + w\n"
    assert edits.apply_in_context(source, cast, [3]) == []
    assert edits.apply_in_context(source, cast, [4]) == ["def q(w):\n    z = 'q' + w\n    print(w.keys())\n    k = 'u' + str(w)"]
    one = mine_change(*CHANGES[4][1:])[0]
    assert edits.apply_in_context("def f(n):\n    print(n)\n    return n.keys()\n", one, [3]) == []


def test_ties_bind():
    before, after = root(parse("x = f(a, a)").children), root(parse("x = g(a)").children)
    other, new = root(parse("y = h(b, b)").children), root(parse("y = g(b)").children)
    t = merged(Template("Replace", before, after, links=tied_nodes(before, after, None)), Template("Replace", other, new, links=tied_nodes(other, new, None)))
    assert [n.value for n in t.before.walk()][-2:] == [REFERRED, REFERRED]
    assert edits.apply_in_context("z = k(c, c)\n", t, [1]) == ["z = g(c)"]
    assert edits.apply_in_context("z = k(c, d)\n", t, [1]) == []
    loose = merged(t, Template("Replace", root(parse("y = h(b, e)").children), new, links=tied_nodes(root(parse("y = h(b, e)").children), new, None)))
    assert edits.apply_in_context("z = k(c, d)\n", loose, [1]) == ["z = g(c)"]


def test_merged_ties_are_those_of_both():
    """Every tie of a merged pair is between nodes of it, and both templates tie the nodes they come from."""
    pick = random.Random(5)
    found: dict[str, list[Template]] = {}
    for _ in range(300):
        before = some_source(pick)
        h = hunk(before, after := some_change(pick, before))
        if h and (t := mine_change(before, after, *h)[0]):
            found.setdefault(mining.template_row(t)["block"] + t.action, []).append(t)
    pairs = [(a, b) for own in found.values() for a, b in zip(own, own[1:], strict=False)]
    assert len(pairs) > 50
    for a, b in pairs:
        m = merged(a, b)
        size = {s: 0 if getattr(m, s) is None else getattr(m, s).size for s in ("before", "after", "within")}
        assert all(len(g) > 1 and all(0 <= k < size[s] for s, k in g) for g in m.links)
        for s in ("before", "after"):
            if getattr(m, s) is not None:
                _, at = kernels.generalise_aligned(getattr(a, s), getattr(b, s))
                for g in m.links:
                    own = [k for side, k in g if side == s]
                    for x, y in zip(own, own[1:], strict=False):
                        for t, i in ((a, 0), (b, 1)):
                            nodes = list(getattr(t, s).walk())
                            assert exact_fingerprint(nodes[at[x][i]]) == exact_fingerprint(nodes[at[y][i]])
        if m.within is not None:  # places still lead to where the pieces hung
            whole, origin = m.whole_before()
            assert whole.size == size["within"] + (size["before"] - 1 if m.before is not None else 0) and len(origin) == whole.size


def test_merged_templates_reproduce_both_changes():
    """A merged pair that keeps its context turns either source into its fix, masks apart."""
    pick, tried = random.Random(2), 0
    while tried < 60:
        before = some_source(pick)
        h = hunk(before, after := some_change(pick, before))
        rename = {c: c.upper() for c in "abcdefg"}
        swap = lambda s: ast.unparse(_Renamed(rename).visit(ast.parse(s))) + "\n"  # noqa: B023, E731
        t = mine_change(before, after, *h)[0] if h else None
        if t is None or t.action == "Add" and t.within is None:
            continue
        before2, after2 = swap(before), swap(after)
        h2 = hunk(before2, after2)
        t2 = mine_change(before2, after2, *h2)[0] if h2 else None
        if t2 is None or t2.action != t.action or mining.template_row(t2)["block"] != mining.template_row(t)["block"]:
            continue
        tried += 1
        m = merged(t, t2)
        for b, a, own in ((before, after, h), (before2, after2, h2)):
            got, _ = own_patches(b, a, *own, m)
            from arborlake.functions.rewriting import fits_fix

            assert any(fits_fix(text, a) for text in got) or m.within is None, (b, a, got)


class _Renamed(ast.NodeTransformer):
    def __init__(self, names):
        self.names = names

    def visit_Name(self, node):
        return ast.Name(self.names.get(node.id, node.id), node.ctx)


def some_tree(pick, depth=3):
    kind = pick.choice(["Expr", "Variable", "Literal"]) if depth else "Variable"
    children = [some_tree(pick, depth - 1) for _ in range(pick.randint(0, 3))] if kind == "Expr" else []
    value = None if kind == "Expr" else pick.choice("ab")
    return Tree(kind, "Tuple" if kind == "Expr" else kind, value, "str" if kind == "Literal" else None, pick.choice(["x", "y"]), children=tuple(children))


def weakened(pick, t):
    """A pattern that ``t`` satisfies: some children gone, some values abstracted."""
    kept = [weakened(pick, c) for c in t.children if pick.random() < 0.7]
    value = ABSTRACTED if t.value is not None and pick.random() < 0.6 else t.value
    return Tree(t.kind, t.type, value, None if value == ABSTRACTED else t.vtype, t.role, children=tuple(kept))


def matches_by_hand(a, pattern, tied):
    """All maps of pattern nodes to nodes: every choice of children, checked at the end."""
    from itertools import combinations, product

    def ways(x, p, at):
        if not kernels.node_satisfies(x, p):
            return []
        start, places = at + 1, []
        for c in p.children:
            places.append(start)
            start += c.size
        by_role = {}
        for c, k in zip(p.children, places, strict=True):
            by_role.setdefault(c.role, []).append((c, k))
        options = []
        for role, own in by_role.items():
            fields = x.roles().get(role, ())
            options.append([w for chosen in combinations(fields, len(own)) for w in product(*(ways(y, c, k) for y, (c, k) in zip(chosen, own, strict=True)))])
        return [{at: x, **{k: v for field in combo for w in field for k, v in w.items()}} for combo in product(*options)]

    return [w for w in ways(a, pattern, 0) if all(exact_fingerprint(w[i]) == exact_fingerprint(w[j]) for i, js in tied.items() for j in js)]


def test_matches_are_all_there_are():
    pick, several = random.Random(4), 0
    for _ in range(400):
        a = Tree("Expr", "Tuple", role="x", children=tuple(some_tree(pick, 2) for _ in range(3)))
        p = weakened(pick, a) if pick.random() < 0.7 else some_tree(pick, 2)
        bare = [k for k, n in enumerate(p.walk()) if not n.children]
        group = pick.sample(bare, min(len(bare), pick.choice([0, 0, 2])))
        tied = {k: tuple(j for j in group if j != k) for k in group}
        for x in a.walk():
            got = [tuple(sorted((k, id(v)) for k, v in w.items())) for w in kernels.matches(x, p, tied)]
            want = [tuple(sorted((k, id(v)) for k, v in w.items())) for w in matches_by_hand(x, p, tied)]
            assert sorted(got) == sorted(want)
            several += len(got) > 1
    assert several > 20


def test_context_statements_pair_in_order():
    a, b = root(parse("import q\nx = f(a)\nif a:\n    pass").children), root(parse("y = g(a)\nfor i in a:\n    pass\nif a:\n    pass").children)
    got = kernels.generalise_context(a, b)
    assert [c.type for c in got.children] == ["Assign", "If"]


# -- selection -----------------------------------------------------------------------


def recursion(case, rows, children, k):
    """Templates to use from template ``k`` down, as one recursive function."""
    t = mining.load_template(rows[k])
    if rows[k]["instances"] < 2 or not edits.fits(case["source"], t, case["lines"], case["added"]):
        return []
    out, whole = [], t.before_within()
    for c in children.get(k, []):
        if rows[c]["instances"] < 2:
            continue
        u = mining.load_template(rows[c])
        if kernels.equal_trees(u.before_within(), whole) and t.after is not None and kernels.alike_trees(u.after, t.after):
            out.append(k)
        else:
            out += recursion(case, rows, children, c)
    return out or ([k] if edits.is_usable(t) else [])


def test_selection_equals_recursion(spark):
    pick = random.Random(7)
    found, cases = {}, []
    for n in range(160):
        before = some_source(pick)
        h = hunk(before, after := some_change(pick, before))
        t = mine_change(before, after, *h)[0] if h else None
        if t is not None:
            found.setdefault((t.action, mining.template_row(t)["block"]), []).extend([mining.template_row(t)] * 2)
            cases.append((f"c{n}", before, changed_lines(*h)[0] or [h[1]], t.action == "Add" and t.within is None and t.before is None))
    forest = [r for own in found.values() for r in forest_rows(own)]
    table = spark.createDataFrame([tuple(r[c.split()[0]] for c in training.FOREST_SCHEMA.split(", ")) for r in forest], training.FOREST_SCHEMA)
    chosen, tried = patching.selected(spark.createDataFrame(cases, "case string, source string, lines array<int>, added boolean"), table)
    rows = {r["template_id"]: r for r in forest}
    children: dict = {}
    for r in forest:
        children.setdefault(r["parent_id"], []).append(r["template_id"])
    want = {(c[0], k) for c in cases for top in children[None] for k in recursion(dict(zip(("case", "source", "lines", "added"), c, strict=True)), rows, children, top)}
    assert {(r["case"], r["template_id"]) for r in chosen.collect()} == want and len(want) > 50
    assert tried.count() < len(cases) * len(forest) / 2  # what hangs under a template that does not fit is never tried


def test_included_templates_go(spark):
    one, two = (root(parse(x).children) for x in ("x = f(a)", "x = f(b)"))
    general, wide = kernels.generalise(one, two), kernels.generalise(kernels.generalise(one, two), root(parse("x = g.h").children))
    after, other = root(parse("x = 1").children), root(parse("x = 2").children)
    sides = {"t1": (one, after), "t2": (general, after), "t3": (wide, after), "t4": (two, other), "t5": (general, other), "t6": (one, after), "t7": (None, after), "t8": (None, after)}
    rows = [mining.template_row(Template("Replace", *s)) | {"template_id": k, "parent_id": None, "instances": 2} for k, s in sides.items()]
    table = spark.createDataFrame([tuple(r[c.split()[0]] for c in training.FOREST_SCHEMA.split(", ")) for r in rows], training.FOREST_SCHEMA)
    chosen = spark.createDataFrame([(c, k) for c in "ab" for k in sides if (c, k) not in {("b", "t3"), ("b", "t5")}], "case string, template_id string")

    def by_hand(own):
        into = lambda a, b: kernels.equal_trees(sides[a][1], sides[b][1]) and (sides[a][0] is sides[b][0] is None or None not in (sides[a][0], sides[b][0]) and kernels.includes(sides[a][0], sides[b][0]))
        return {a for a in own if not any(a != b and into(a, b) and (not into(b, a) or a > b) for b in own)}

    got = patching.without_included(chosen, patching._known(table)).collect()
    for c in "ab":
        own = {r["template_id"] for r in chosen.collect() if r["case"] == c}
        assert {r["template_id"] for r in got if r["case"] == c} == by_hand(own)
    assert {r["template_id"] for r in got if r["case"] == "a"} == {"t3", "t5", "t7"}


def test_usable_templates():
    insert = mine_change(*CHANGES[2][1:])[0]
    assert edits.is_usable(insert)
    assert not edits.is_usable(Template("Replace", root(parse("a").children), root(parse("b\nc").children)))
    moved = root(parse("f(x)").children)
    assert not edits.is_usable(Template("Insert", moved, moved, links=tied_nodes(moved, moved, None)))
    assert not edits.is_usable(Template("Insert", moved, root(parse("g(2)").children), links=()))
    assert build(ast.parse("x = 1").body[0]).type == "Assign" and ABSTRACTED != REFERRED
    assert tree_queries.CHANGES is CHANGES
