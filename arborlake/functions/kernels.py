"""Pure kernels of the tree algebra: similarity, set operations, matching and generalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

from .trees import Tree, exact_fingerprint, operator_category, root, shape_fingerprint
from .vocabulary import ABSTRACTED, CATEGORY_OPERATORS, GENERAL, IDENTIFIERS, PARENTS, REFERRED, is_a


# -- similarity ----------------------------------------------------------------


def same_node(a: Tree, b: Tree) -> bool:
    return a.label == b.label


def like_node(a: Tree, b: Tree) -> bool:
    return a.type_class == b.type_class


def matched_top_down(a: Tree, b: Tree, equal: Callable[[Tree, Tree], bool]) -> int:
    """Nodes that pair off from the root down; below a pair that differs, and in fields of different length, none do."""
    if not equal(a, b):
        return 0
    fields = b.roles()
    total = 1
    for role, own in a.roles().items():
        other = fields.get(role, ())
        if len(own) == len(other):
            total += sum(matched_top_down(x, y, equal) for x, y in zip(own, other, strict=True))
    return total


def dice(a: Tree | None, b: Tree | None, structural: bool = False) -> float | None:
    """Twice the paired nodes over all nodes; 1 for two absent trees, None (not comparable) for one."""
    if a is None or b is None:
        return 1.0 if a is b else None
    return 2 * matched_top_down(a, b, like_node if structural else same_node) / (a.size + b.size)


def pattern_dice(before: tuple[Tree | None, Tree | None], after: tuple[Tree | None, Tree | None], structural: bool = False) -> float | None:
    """Dice over two pairs of trees together."""
    paired = total = 0
    for a, b in (before, after):
        if (a is None) != (b is None):
            return None
        if a is not None:
            paired += 2 * matched_top_down(a, b, like_node if structural else same_node)
            total += a.size + b.size
    return paired / total if total else 1.0


def leaf_paths(t: Tree) -> list[tuple[Tree, ...]]:
    """Paths from each leaf up to the root's child, leaves in pre-order."""

    def visit(node: Tree, above: tuple[Tree, ...]) -> Iterator[tuple[Tree, ...]]:
        path = (node, *above)
        if not node.children:
            yield path
        for c in node.children:
            yield from visit(c, path)

    return [p for c in t.children for p in visit(c, ())]


def leaf_similarity(a: Tree | None, b: Tree | None, structural: bool = False, smooth: int = 1) -> float | None:
    """Greedy one-to-one pairing of leaf paths by the length they agree on from the leaf up, over all path nodes.

    (2m + smooth) / (n + smooth), with n the nodes of all paths of either tree.
    """
    if a is None or b is None:
        return 1.0 if a is b else None
    equal = like_node if structural else same_node
    left, right = leaf_paths(a), leaf_paths(b)
    scored = []
    for i, p in enumerate(left):
        for j, q in enumerate(right):
            n = 0
            while n < min(len(p), len(q)) and equal(p[n], q[n]) and p[n].role == q[n].role:
                n += 1
            if n:
                scored.append((-n, i, j))
    used_a, used_b, common = set(), set(), 0
    for n, i, j in sorted(scored):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            common -= n
    total = sum(map(len, left)) + sum(map(len, right))
    if not smooth and not common:
        return None
    return (2 * common + smooth) / (total + smooth) if total + smooth else 1.0


# -- set operations --------------------------------------------------------------


def intersection(a: Tree, b: Tree) -> Tree | None:
    """The common tree from the roots down; a field stays only if all its children match."""
    if not same_node(a, b):
        return None
    fields = b.roles()
    kept = []
    for role, own in a.roles().items():
        other = fields.get(role, ())
        if len(own) == len(other):
            both = [intersection(x, y) for x, y in zip(own, other, strict=True)]
            if all(x is not None for x in both):
                kept += both
    order = {id(c): k for k, c in enumerate(a.children)}
    by_source = {role: iter([k for k in order.values() if a.children[k].role == role]) for role in a.roles()}
    placed = sorted(((next(by_source[c.role]), c) for c in kept), key=lambda x: x[0])
    return a.with_children(c for _, c in placed)


def difference(a: Tree, common: Tree | None) -> tuple[Tree | None, list[tuple[tuple[int, ...], str]]]:
    """What of ``a`` is not in ``common``, and where it hung: (path of places into common, field) for each piece.

    common must be an intersection of ``a`` with some tree. Pieces stand under
    one root in source order; attach() puts them back.
    """
    if common is None:
        return a, []
    pieces: list[Tree] = []
    places: list[tuple[tuple[int, ...], str, int]] = []

    def visit(x: Tree, y: Tree, path: tuple[int, ...]) -> None:
        kept = set(y.roles())
        at = 0
        for k, c in enumerate(x.children):
            if c.role in kept:
                visit(c, y.children[at], (*path, at))
                at += 1
            else:
                pieces.append(c)
                places.append((path, c.role, k))

    visit(a, common, ())
    return (Tree("Root", "Root", children=tuple(pieces)) if pieces else None), places


def attach(common: Tree, pieces: Tree | None, places: list) -> Tree:
    """The inverse of difference()."""

    def visit(y: Tree, path: tuple[int, ...]) -> Tree:
        children = [visit(c, (*path, k)) for k, c in enumerate(y.children)]
        for (at, role, k), piece in zip(places, pieces.children if pieces else (), strict=True):
            if tuple(at) == path:
                children.insert(k, replace(piece, role=role))
        return y.with_children(children)

    return visit(common, ())


def attach_marked(common: Tree, pieces: Tree | None, places: list, side: str) -> tuple[Tree, list[tuple[str, int]]]:
    """attach(), and for each node in pre-order where it comes from: ("within" or ``side``, its pre-order number there)."""
    if common is None:
        return pieces, [(side, k) for k in range(pieces.size if pieces is not None else 0)]
    own = list(pieces.children) if pieces is not None else []
    starts = _starts(pieces) if pieces is not None else []

    def visit(y: Tree, path: tuple[int, ...], at: int) -> tuple[Tree, list[tuple[str, int]]]:
        children = [visit(c, (*path, k), i) for k, (c, i) in enumerate(zip(y.children, _starts(y, at), strict=True))]
        for (where, role, k), piece, i in zip(places, own, starts, strict=True):
            if tuple(where) == path:
                children.insert(k, (replace(piece, role=role), [(side, i + j) for j in range(piece.size)]))
        return y.with_children(c for c, _ in children), [("within", at), *(o for _, below in children for o in below)]

    return visit(common, (), 0)


def _starts(t: Tree, at: int = 0) -> list[int]:
    """Pre-order numbers of the children of ``t``, whose own is ``at``."""
    out, k = [], at + 1
    for c in t.children:
        out.append(k)
        k += c.size
    return out


def cut_equal_leaves(a: Tree, b: Tree) -> tuple[Tree | None, Tree | None]:
    """Both trees without leaf paths that are equal in the two, again and again; an emptied tree is None."""

    def keys(t: Tree) -> dict[tuple, tuple[int, ...]]:
        out: dict[tuple, tuple[int, ...]] = {}

        def visit(node: Tree, key: tuple, at: tuple[int, ...]) -> None:
            seen: dict[str, int] = {}
            for k, c in enumerate(node.children):
                place = seen.get(c.role, 0)
                seen[c.role] = place + 1
                own = (*key, (c.role, place, c.label))
                if c.children:
                    visit(c, own, (*at, k))
                else:
                    out[own] = (*at, k)

        visit(t, (), ())
        return out

    def drop(t: Tree, at: tuple[int, ...]) -> Tree:
        k = at[0]
        if len(at) == 1:
            return t.with_children(c for i, c in enumerate(t.children) if i != k)
        return t.with_children(drop(c, at[1:]) if i == k else c for i, c in enumerate(t.children))

    while True:
        left, right = keys(a), keys(b)
        common = left.keys() & right.keys()
        if not common:
            break
        for t_keys, which in ((left, 0), (right, 1)):
            t = (a, b)[which]
            for at in sorted((t_keys[k] for k in common), reverse=True):
                t = drop(t, at)
            a, b = (t, b) if which == 0 else (a, t)
    return (a if a.children else None), (b if b.children else None)


def includes(a: Tree, b: Tree) -> bool:
    """Whether ``a`` specialises pattern ``b``: every kind at or below b's, values kept, same arity."""
    if not (b.general and is_a(a.kind, b.kind) or (a.kind, a.type) == (b.kind, b.type)):
        return False
    if b.value not in (None, ABSTRACTED, REFERRED) and a.value != b.value and not value_satisfies(a, b):
        return False
    if not b.children and b.general:
        return True
    return [c.role for c in a.children] == [c.role for c in b.children] and all(map(includes, a.children, b.children))


def contained(a: Tree, b: Tree) -> bool:
    """Whether ``b`` holds all of ``a``: equal nodes, children an ordered subsequence field by field."""
    if not same_node(a, b):
        return False
    fields = b.roles()
    for role, own in a.roles().items():
        rest = iter(fields.get(role, ()))
        if not all(any(contained(x, y) for y in rest) for x in own):
            return False
    return True


def find_equal(a: Tree, b: Tree) -> Tree | None:
    """The first subtree of ``b``, in pre-order, that equals ``a``."""
    want = exact_fingerprint(a)
    return next((t for t in b.walk() if t.size == a.size and exact_fingerprint(t) == want), None)


# -- matching ------------------------------------------------------------------


def value_satisfies(a: Tree, pattern: Tree) -> bool:
    """Whether a concrete node's value fits: equal, any, a literal's type, or an operator's category."""
    v = pattern.value
    if v is None or v in (ABSTRACTED, REFERRED) or v == a.value:
        return True
    if pattern.kind == "Literal" and pattern.vtype is None:
        return a.kind == "Literal" and a.vtype == v
    return v in CATEGORY_OPERATORS and operator_category(a) == v


def node_satisfies(a: Tree, pattern: Tree) -> bool:
    if pattern.general:
        return is_a(a.kind, pattern.kind) and value_satisfies(a, pattern) or pattern.kind == "Stmt"
    return (a.kind, a.type) == (pattern.kind, pattern.type) and value_satisfies(a, pattern)


def matches(a: Tree, pattern: Tree, same: dict[int, tuple[int, ...]] | None = None) -> Iterator[dict[int, Tree]]:
    """Every way in which ``a`` satisfies ``pattern``: nodes by place in the pattern's pre-order.

    The children of each of the pattern's fields embed, in order, in the same
    field of ``a``. ``same`` ties places whose nodes must be equal trees; a way
    that breaks a tie is left as soon as it does.
    """
    tied = same or {}

    def visit(x: Tree, p: Tree, at: int, found: dict[int, Tree]) -> Iterator[dict[int, Tree]]:
        if not node_satisfies(x, p):
            return
        if any(j in found and exact_fingerprint(found[j]) != exact_fingerprint(x) for j in tied.get(at, ())):
            return
        yield from embed(x.roles(), p.children, 0, at + 1, {}, {**found, at: x})

    def embed(fields: dict, wanted: tuple[Tree, ...], k: int, at: int, used: dict[str, int], found: dict[int, Tree]) -> Iterator[dict[int, Tree]]:
        if k == len(wanted):
            yield found
            return
        c = wanted[k]
        own = fields.get(c.role, ())
        for i in range(used.get(c.role, 0), len(own)):
            for more in visit(own[i], c, at, found):
                yield from embed(fields, wanted, k + 1, at + c.size, {**used, c.role: i + 1}, more)

    return visit(a, pattern, 0, {})


def match(a: Tree, pattern: Tree, same: dict[int, tuple[int, ...]] | None = None) -> dict[int, Tree] | None:
    """The first of ``matches``, which takes the first children that can be taken; None if there is none."""
    return next(matches(a, pattern, same), None)


def embeddings(source: Tree, pattern: Tree, most: int | None = None) -> list[list[dict[int, Tree]]]:
    """All ways to find the pattern's body trees in ``source``, each to the right of the one before."""
    nodes = list(source.walk())[1:]
    order = {id(t): k for k, t in enumerate(source.walk())}
    out: list[list[dict[int, Tree]]] = []

    def extend(k: int, after: int, chosen: list[dict[int, Tree]]) -> None:
        if k == len(pattern.children):
            out.append(chosen)
            return
        for node in nodes:
            if order[id(node)] > after:
                for got in matches(node, pattern.children[k]):
                    if most is not None and len(out) >= most:
                        return
                    extend(k + 1, max(order[id(t)] for t in got.values()), [*chosen, got])

    extend(0, -1, [])
    return out


def context_matches(source: Tree | None, pattern: Tree | None, tolerated: int = 1) -> bool:
    """Whether each leaf path of the pattern fits a leaf path of ``source`` of its own; ``tolerated`` may not."""
    if pattern is None:
        return True
    if source is None:
        return False
    free = leaf_paths(source)
    missed = 0
    for p in leaf_paths(pattern):
        fits = [q for q in free if _path_fits(q, p)]
        if fits:
            free.remove(min(fits, key=lambda q: abs(len(q) - len(p))))
        else:
            missed += 1
            if missed > tolerated:
                return False
    return True


def _path_fits(concrete: tuple[Tree, ...], pattern: tuple[Tree, ...]) -> bool:
    rest = iter(concrete)
    return all(any(node_satisfies(x, p) for x in rest) for p in pattern)


# -- generalisation --------------------------------------------------------------


def _general_kind(a: Tree, b: Tree) -> str:
    """The lowest kind of the lattice above both."""
    kind = a.kind
    while not is_a(b.kind, kind):
        kind = PARENTS.get(kind, "Stmt")
    return kind if kind in GENERAL else PARENTS.get(kind, "Stmt")


def generalise(a: Tree, b: Tree, refers: Callable[[Tree, Tree], bool] | None = None) -> Tree:
    """The least general pattern that both trees satisfy.

    Equal nodes stay. Unequal values of one type become REFERRED if ``refers``
    says that both are tied to the same other nodes, else a literal type's
    name, an operator category, or ABSTRACTED. Identifiers of different kinds
    become Identifier; other mismatches End_Expr, Expr or Stmt leaves. Fields
    keep their common prefix; a field that only one has goes.
    """
    return generalise_aligned(a, b, refers)[0]


def generalise_aligned(a: Tree, b: Tree, refers: Callable[[Tree, Tree], bool] | None = None) -> tuple[Tree, list[tuple[int, int]]]:
    """generalise(), and for each node of the pattern the pre-order numbers of the two nodes it stands for."""
    pairs: list[tuple[int, int]] = []

    def visit(a: Tree, i: int, b: Tree, j: int) -> Tree:
        pairs.append((i, j))
        if a.kind == "Root" and b.kind == "Root":
            return Tree("Root", "Root", children=tuple(visit(x, k, y, m) for x, k, y, m in zip(a.children, _starts(a, i), b.children, _starts(b, j), strict=False)))
        same = (a.kind, a.type) == (b.kind, b.type)
        if not same and not (a.type in IDENTIFIERS and b.type in IDENTIFIERS):
            kind = _general_kind(a, b)
            kind = "Expr" if kind == "Identifier" and (a.children or b.children) else kind
            return Tree(kind, kind, ABSTRACTED if kind in ("Identifier", "End_Expr") else None, role=a.role)
        fields: dict[str, list[tuple[Tree, int]]] = {}
        for y, m in zip(b.children, _starts(b, j), strict=True):
            fields.setdefault(y.role, []).append((y, m))
        taken: dict[str, int] = {}
        children = []
        for c, k in zip(a.children, _starts(a, i), strict=True):
            n = taken.get(c.role, 0)
            taken[c.role] = n + 1
            if n < len(fields.get(c.role, ())):
                children.append(visit(c, k, *fields[c.role][n]))
        kind, type_ = (a.kind, a.type) if same else ("Identifier", "Identifier")
        value, vtype = a.value, a.vtype
        if (a.value, a.vtype) != (b.value, b.vtype):
            vtype = None
            if refers and refers(a, b):
                value = REFERRED
            elif a.kind == b.kind == "Literal" and _literal_type(a) == _literal_type(b):
                value = _literal_type(a)
            elif a.kind == b.kind == "Op" and _category(a) == _category(b) is not None:
                value = _category(a)
            else:
                value = ABSTRACTED
        return Tree(kind, type_, value, vtype, a.role, a.alias if a.alias == b.alias else None, children=tuple(children))

    return visit(a, 0, b, 0), pairs


def _literal_type(t: Tree) -> str | None:
    return t.vtype if t.vtype is not None else t.value if t.value not in (ABSTRACTED, REFERRED) else None


def _category(t: Tree) -> str | None:
    return t.value if t.value in CATEGORY_OPERATORS else operator_category(t)


def generalise_context(a: Tree | None, b: Tree | None) -> Tree | None:
    """The statements of two contexts that pair off, generalised; None where either is absent or none do.

    Statements pair in order, those of one type with one another, so that the
    sum of their similarities is greatest: a statement that only one context
    has does not shift the others.
    """
    if a is None or b is None:
        return None
    n, m = len(a.children), len(b.children)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    score = [[1 + (dice(x, y) or 0.0) if like_node(x, y) else 0.0 for y in b.children] for x in a.children]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], score[i][j] + best[i + 1][j + 1] if score[i][j] else 0.0)
    both, i, j = [], 0, 0
    while i < n and j < m:
        if score[i][j] and best[i][j] == score[i][j] + best[i + 1][j + 1]:
            both.append(generalise(a.children[i], b.children[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return root(both) if both else None


# -- metrics of patterns ---------------------------------------------------------

#: Weights of generalised nodes.
TYPE_WEIGHTS = {"Identifier": 10, "End_Expr": 20, "Expr": 40, "Stmt": 80}
VALUE_WEIGHTS = {ABSTRACTED: 5, REFERRED: 3}


def _type_abstracted(t: Tree) -> bool:
    return t.general


def _value_abstracted(t: Tree) -> bool:
    return t.value in VALUE_WEIGHTS or t.kind == "Literal" and t.value is not None and t.vtype is None or t.value in CATEGORY_OPERATORS


def abstracted_number(t: Tree) -> int:
    """2 for each node with a generalised type, 1 for each with a generalised value only."""
    return sum(2 if _type_abstracted(x) else 1 if _value_abstracted(x) else 0 for x in t.walk())


def abstract_score(t: Tree) -> int:
    return sum((TYPE_WEIGHTS[x.kind] if x.general else 0) + (VALUE_WEIGHTS.get(x.value, 1) if _value_abstracted(x) else 0) for x in t.walk())


def abstract_ratio(t: Tree) -> float:
    """Share of nodes with a generalised type, the root and references apart."""
    own = [x for x in t.walk() if x.kind not in ("Root", "Reference")]
    return sum(map(_type_abstracted, own)) / len(own) if own else 0.0


def equal_trees(a: Tree | None, b: Tree | None) -> bool:
    return a is b or a is not None and b is not None and exact_fingerprint(a) == exact_fingerprint(b)


def alike_trees(a: Tree | None, b: Tree | None) -> bool:
    return a is b or a is not None and b is not None and shape_fingerprint(a) == shape_fingerprint(b)
