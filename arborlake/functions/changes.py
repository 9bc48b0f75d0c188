"""From a hunk to a classified change: hit statements, changed parts, actions, context."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from .kernels import attach, attach_marked, contained, cut_equal_leaves, difference, equal_trees, find_equal, intersection, leaf_paths
from .trees import Tree, build, exact_fingerprint, root


def changed_lines(content: str, b_start: int, a_start: int) -> tuple[list[int], list[int], list[int], list[int]] | None:
    """Lines removed and added: without blanks and comments, then with them; None for marks of a missing last newline."""
    before, after, raw_before, raw_after = [], [], [], []
    b, a = b_start, a_start
    for line in content.split("\n"):
        if line.startswith("\\"):
            return None
        bare = line[1:].strip()
        real = bool(bare) and not bare.startswith("#")
        if line.startswith("-"):
            raw_before.append(b)
            before += [b] * real
            b += 1
        elif line.startswith("+"):
            raw_after.append(a)
            after += [a] * real
            a += 1
        else:
            b += 1
            a += 1
    return before, after, raw_before, raw_after


def _span(node: ast.AST) -> tuple[int, int] | None:
    return (node.lineno, node.end_lineno) if getattr(node, "lineno", None) is not None else None


def _statements(node: ast.AST):
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.stmt, ast.excepthandler, ast.match_case)):
            yield child
        elif isinstance(child, ast.AST) and not isinstance(child, ast.expr):
            yield from _statements(child)


def _is_comment(node: ast.AST) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


@dataclass
class Changed:
    """The parts of one file version that a hunk changes: whole statements, and statements changed in part."""

    total: list[Tree] = field(default_factory=list)
    partial: list[Tree] = field(default_factory=list)
    siblings: list[tuple[ast.AST, list[ast.AST]]] = field(default_factory=list)


def changed_parts(module: ast.Module, lines: list[int], raw: list[int]) -> Changed:
    """Uppermost statements with all lines changed, and deepest ones with some.

    A statement is totally changed if every one of its lines is in ``raw``. One
    that is hit but has no hit statement below is partially changed. Strings
    that stand alone count as comments.
    """
    out = Changed()
    hits, whole = set(lines), set(raw)

    def visit(parent: ast.AST) -> bool:
        found = False
        own = list(_statements(parent))
        for s in own:
            lo, hi = _span(s) or (0, -1)
            if _is_comment(s) or not any(lo <= x <= hi for x in hits):
                continue
            found = True
            if all(x in whole for x in range(lo, hi + 1)):
                out.total.append(build(s))
                out.siblings.append((s, own))
            elif not visit(s):
                out.partial.append(build(s))
                out.siblings.append((s, own))
        return found

    visit(module)
    return out


def neighbours(changed: Changed) -> tuple[list[ast.AST], list[ast.AST]]:
    """Sibling statements strictly before the first and after the last changed line, each once."""
    if not changed.siblings:
        return [], []
    lo = min(s.lineno for s, _ in changed.siblings)
    hi = max(s.end_lineno for s, _ in changed.siblings)
    all_ = {id(x): x for _, own in changed.siblings for x in own if getattr(x, "lineno", None)}.values()
    return [x for x in all_ if x.end_lineno < lo], [x for x in all_ if x.lineno > hi]


#: Nodes (side, pre-order number) that stand for one and the same tree.
Group = tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Template:
    """A change with its action, its two sides, what they share, the statements around, and which nodes are tied."""

    action: str
    before: Tree | None
    after: Tree | None
    within: Tree | None = None
    before_places: tuple = ()
    after_places: tuple = ()
    before_context: Tree | None = None
    after_context: Tree | None = None
    links: tuple[Group, ...] = ()

    def before_within(self) -> Tree | None:
        """The before side put back into the shared context."""
        return self.before if self.within is None else attach(self.within, self.before, list(self.before_places))

    def whole_before(self) -> tuple[Tree | None, list[tuple[str, int]]]:
        """before_within, and where each of its nodes comes from."""
        return attach_marked(self.within, self.before, list(self.before_places), "before")


_TIED = ("Variable", "Attribute", "Literal", "Builtin", "Type", "Expr", "Stmt")


def tied_nodes(before: Tree | None, after: Tree | None, within: Tree | None) -> tuple[Group, ...]:
    """Groups of equal subtrees of the sides and their shared context, each of two nodes or more."""
    by: dict[str, list[tuple[str, int]]] = {}
    for side, tree in (("before", before), ("after", after), ("within", within)):
        for k, n in enumerate(tree.walk() if tree is not None else ()):
            if n.kind in _TIED:
                by.setdefault(exact_fingerprint(n), []).append((side, k))
    return tuple(tuple(g) for g in by.values() if len(g) > 1)


def classify(before: Changed, after: Changed) -> tuple[str, Tree | None, Tree | None] | None:
    """The action of a change and its two sides: Add, Remove, Insert, Shuffle or Replace; None for no change.

    With statements changed in part on both sides and in equal number, the
    sides are first cut to what differs. Of the first that applies: one side
    empty; parts of one side included in the other's; whole statements that
    are permuted, reappear at the top, or reappear deeper.
    """
    b_all, a_all = [*before.partial, *before.total], [*after.partial, *after.total]
    if not b_all and not a_all:
        return None
    if not b_all:
        return "Add", None, root(a_all)
    if not a_all:
        return "Remove", root(b_all), None
    if before.partial or after.partial:
        if len(before.partial) != len(after.partial) and before.partial and after.partial:
            return None
        pairs = list(zip(before.partial, after.partial, strict=False))
        if pairs and all(contained(x, y) for x, y in pairs) and not before.total:
            return ("Add", root(before.partial), root(a_all)) if not all(equal_trees(x, y) for x, y in pairs) or after.total else None
        if pairs and all(contained(y, x) for x, y in pairs) and not after.total:
            return "Remove", root(b_all), root(after.partial)
        moved = before.total and after.total and all(any(find_equal(t, u) for u in after.total) for t in before.total)
        wrapped = pairs and all(_wrapped(x, y) for x, y in pairs) and not before.total
        return ("Insert" if moved or wrapped else "Replace"), root(b_all), root(a_all)
    prints = [exact_fingerprint(t) for t in before.total]
    others = [exact_fingerprint(t) for t in after.total]
    if prints == others:
        return None
    if sorted(prints) == sorted(others):
        return "Shuffle", root(b_all), root(a_all)
    if all(p in others for p in prints):
        rest = [t for t, p in zip(after.total, others, strict=True) if p not in prints]
        return "Add", None, root(rest)
    if all(any(find_equal(t, u) for u in after.total) for t in before.total):
        return "Insert", root(b_all), root(a_all)
    return "Replace", root(b_all), root(a_all)


def _wrapped(a: Tree, b: Tree) -> bool:
    """Whether what of ``a`` differs from ``b`` reappears whole inside what of ``b`` differs."""
    left, right = cut_equal_leaves(root([a]), root([b]))
    common = intersection(root([a]), root([b]))
    pieces, _ = difference(root([a]), common)
    return bool(left is None or pieces) and all(find_equal(p, b) for p in (pieces.children if pieces else ()))


def split_context(action: str, before: Tree | None, after: Tree | None) -> Template:
    """Takes what both sides share out of them as the context within."""
    if before is None or after is None:
        return Template(action, before, after)
    common = intersection(before, after)
    if common is None or common.size <= 1:
        return Template(action, before, after)
    b, b_places = difference(before, common)
    a, a_places = difference(after, common)
    action = "Add" if b is None and a is not None else "Remove" if a is None and b is not None else action
    return Template(action, b, a, common, tuple(b_places), tuple(a_places))


def references(t: Template) -> list[tuple[str, int, str, int]]:
    """Links (side, node, side, node) between equal named leaves of before, after and the contexts."""
    sides = {"before": t.before, "after": t.after, "within": t.within, "before_context": t.before_context, "after_context": t.after_context}
    named = [(side, k, n) for side, tree in sides.items() if tree for k, n in enumerate(tree.walk()) if n.value is not None and n.kind in ("Variable", "Attribute", "Literal", "Builtin", "Type")]
    by: dict[tuple, list] = {}
    for side, k, n in named:
        by.setdefault((n.kind, n.value, n.vtype), []).append((side, k))
    return [(*x, *y) for group in by.values() for i, x in enumerate(group) for y in group[i + 1 :]]


def linked_context(pattern: Tree | None, statements: list[ast.AST]) -> Tree | None:
    """Statements around a change that name what the pattern names, cut to the paths that do.

    Equal variables and literals link; an attribute links to one it extends.
    Definitions are no context, and equal statements count once.
    """
    if pattern is None:
        return None
    values = {(n.kind, n.value) for n in pattern.walk() if n.kind in ("Variable", "Attribute", "Literal") and n.value not in (None, "None", "True", "False")}
    heads = {v for k, v in values if k in ("Variable", "Attribute")}

    def linked(n: Tree) -> bool:
        return (n.kind, n.value) in values or n.kind == "Attribute" and any(n.value.startswith(h + ".") for h in heads)

    def prune(n: Tree) -> Tree | None:
        kept = [x for x in map(prune, n.children) if x is not None]
        return n.with_children(kept) if kept or linked(n) else None

    out, seen = [], set()
    for s in statements:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        t = prune(build(s))
        if t is not None and exact_fingerprint(t) not in seen:
            seen.add(exact_fingerprint(t))
            out.append(t)
    return root(out) if out else None


def mine_change(before_source: str | None, after_source: str | None, content: str, b_start: int, a_start: int) -> tuple[Template | None, str]:
    """The template of one hunk, or None with the reason why there is none."""
    lines = changed_lines(content, b_start, a_start)
    if lines is None:
        return None, "missing newline mark"
    try:
        old, new = ast.parse(before_source or ""), ast.parse(after_source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None, "does not parse"
    b, a = changed_parts(old, lines[0], lines[2]), changed_parts(new, lines[1], lines[3])
    found = classify(b, a)
    if found is None:
        return None, "no change of statements"
    if is_noise(Template(*found)):
        return None, "noise"
    t = split_context(*found)
    names = t.before or t.after
    side = b if b.siblings else a
    up, down = neighbours(side)
    return Template(t.action, t.before, t.after, t.within, t.before_places, t.after_places, linked_context(names, up), linked_context(names, down), tied_nodes(t.before, t.after, t.within)), "ok"


def is_noise(t: Template) -> bool:
    """Whole functions or classes added or removed, equal sides, imports only, or string literals only."""
    sides = [x for x in (t.before, t.after) if x is not None]
    tops = [c for x in sides for c in x.children]
    if not tops:
        return True
    if t.action in ("Add", "Remove") and t.within is None and all(c.type in ("FunctionDef", "AsyncFunctionDef", "ClassDef") for c in tops):
        return True
    if equal_trees(t.before, t.after):
        return True
    if all(c.type in ("Import", "ImportFrom") for c in tops):
        return True
    if t.action != "Replace" or len(sides) < 2:
        return False
    left = [x for x in cut_equal_leaves(*sides) if x is not None]
    return bool(left) and all(p[0].kind == "Literal" and p[0].vtype == "str" for x in left for p in leaf_paths(x))
