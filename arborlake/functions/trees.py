"""Ordered, labelled trees: building them from Python source, packing them into rows, fingerprints."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from .vocabulary import GENERAL, IDENTIFIERS, NAMES, OPERATOR_CATEGORY, STANDARD_TYPES, STATEMENTS


@dataclass(frozen=True, eq=False)
class Tree:
    """A node and its subtree.

    kind is the lattice kind (Root, Stmt, Expr, End_Expr, Variable, …); type
    the syntax class for Stmt and Expr, else the kind; value its text, with
    vtype the Python type of a literal; role the field of the parent it hangs
    on. children are in source order.
    """

    kind: str
    type: str
    value: str | None = None
    vtype: str | None = None
    role: str = "body"
    alias: str | None = None
    line: int = 0
    end_line: int = 0
    children: tuple[Tree, ...] = field(default=())

    def walk(self) -> Iterator[Tree]:
        yield self
        for c in self.children:
            yield from c.walk()

    @property
    def size(self) -> int:
        return 1 + sum(c.size for c in self.children)

    def roles(self) -> dict[str, tuple[Tree, ...]]:
        """Children by field."""
        out: dict[str, list[Tree]] = {}
        for c in self.children:
            out.setdefault(c.role, []).append(c)
        return {k: tuple(v) for k, v in out.items()}

    def with_children(self, children) -> Tree:
        return replace(self, children=tuple(children))

    @property
    def label(self) -> tuple:
        """What two equal nodes agree on, apart from children."""
        return self.kind, self.type, self.value, self.vtype

    @property
    def type_class(self) -> str:
        """Types that are compatible share a class."""
        return "Identifier" if self.type in IDENTIFIERS else f"{self.kind} {self.type}"

    @property
    def general(self) -> bool:
        """Whether the node stands for any node of its kind (an expression statement is a Stmt of type Expr, and does not)."""
        return self.kind == self.type and self.kind in GENERAL


def root(children) -> Tree:
    return Tree("Root", "Root", children=tuple(replace(c, role="body") for c in children))


def leaf(kind: str, value: str | None, role: str, node: ast.AST | None = None, vtype: str | None = None, alias: str | None = None) -> Tree:
    return Tree(kind, kind, value, vtype, role, alias, getattr(node, "lineno", 0), getattr(node, "end_lineno", 0) or 0)


def _name(node: ast.Name, role: str) -> Tree:
    kind = "Type" if node.id in STANDARD_TYPES else "Builtin" if node.id in NAMES else "Variable"
    return leaf(kind, node.id, role, node)


def _literal(node: ast.Constant, role: str) -> Tree:
    if node.value is None:
        return leaf("Type", "None", role, node)
    return leaf("Literal", repr(node.value), role, node, type(node.value).__name__)


def _arguments(node: ast.arguments, link: dict[int, ast.AST] | None) -> list[Tree]:
    """Parameters with their defaults below them; defaults belong to the last positional ones."""
    out = []
    plain = [*node.posonlyargs, *node.args]
    for arg, default in zip(plain, [None] * (len(plain) - len(node.defaults)) + node.defaults, strict=True):
        out.append(_parameter(arg, "args", default, link))
    if node.vararg:
        out.append(_parameter(node.vararg, "vararg", None, link))
    for arg, default in zip(node.kwonlyargs, node.kw_defaults, strict=True):
        out.append(_parameter(arg, "kwonlyargs", default, link))
    if node.kwarg:
        out.append(_parameter(node.kwarg, "kwarg", None, link))
    return out


def _parameter(arg: ast.arg, role: str, default: ast.expr | None, link: dict[int, ast.AST] | None) -> Tree:
    below = [build(arg.annotation, "annotation", link)] if arg.annotation else []
    below += [build(default, "default", link)] if default else []
    out = replace(leaf("Variable", arg.arg, role, arg), children=tuple(below))
    if link is not None:
        link[id(out)] = arg
    return out


def build(node: ast.AST, role: str = "body", link: dict[int, ast.AST] | None = None) -> Tree:
    """The tree of a syntax node.

    Names are Variable, Type or Builtin leaves; attribute chains one leaf with
    their dotted text; constants Literal leaves; operators Op leaves under op;
    keyword arguments Keyword nodes over their value; imported names Module
    leaves; names of functions, classes, globals and handlers Variable leaves. ``link`` is filled
    with the syntax node of each tree node that has one, by identity.
    """
    out = _built(node, role, link)
    if link is not None:
        link[id(out)] = node
    return out


def _built(node: ast.AST, role: str, link: dict[int, ast.AST] | None) -> Tree:
    if isinstance(node, ast.Name):
        return _name(node, role)
    if isinstance(node, ast.Constant):
        return _literal(node, role)
    if isinstance(node, ast.Attribute):
        return leaf("Attribute", ast.unparse(node), role, node)
    if isinstance(node, (ast.operator, ast.boolop, ast.unaryop, ast.cmpop)):
        return leaf("Op", type(node).__name__, role)
    if isinstance(node, ast.keyword):
        return replace(leaf("Keyword", node.arg, role, node), children=(build(node.value, "value", link),))
    if isinstance(node, ast.alias):
        return leaf("Module", node.name, role, node, alias=node.asname)
    kind = "Stmt" if isinstance(node, STATEMENTS) else "Expr"
    children: list[Tree] = []
    for name, value in ast.iter_fields(node):
        if name in ("ctx", "type_comment", "level", "simple", "is_async", "conversion", "kind", "type_ignores"):
            continue
        if isinstance(value, ast.arguments):
            children += _arguments(value, link)
            continue
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, ast.AST):
                children.append(build(x, "op" if name == "ops" else name, link))
            elif isinstance(x, str):
                children.append(leaf("Module" if name == "module" else "Variable", x, "name" if name == "names" else name, node))
    return Tree(kind, type(node).__name__, role=role, line=getattr(node, "lineno", 0), end_line=getattr(node, "end_lineno", 0) or 0, children=tuple(children))


def parse(source: str) -> Tree | None:
    """The tree of a module's statements; None where the source does not parse."""
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return root(build(s) for s in module.body)


def is_parsable(source: str | None) -> bool:
    return source is not None and parse(source) is not None


# -- rows --------------------------------------------------------------------

#: A tree as one row: its nodes in pre-order, each with the last pre-order number of its subtree.
PACKED = "array<struct<dfs: int, last: int, parent: int, depth: int, role: string, place: int, kind: string, type: string, value: string, vtype: string, alias: string, line: int, end_line: int>>"


def pack(tree: Tree) -> list[dict]:
    rows: list[dict] = []

    def visit(t: Tree, parent: int | None, depth: int, place: int) -> None:
        own = len(rows)
        rows.append({"dfs": own, "last": own, "parent": parent, "depth": depth, "role": t.role, "place": place, "kind": t.kind, "type": t.type, "value": t.value, "vtype": t.vtype, "alias": t.alias, "line": t.line, "end_line": t.end_line})
        seen: dict[str, int] = {}
        for c in t.children:
            visit(c, own, depth + 1, seen.get(c.role, 0))
            seen[c.role] = seen.get(c.role, 0) + 1
        rows[own]["last"] = len(rows) - 1

    visit(tree, None, 0, 0)
    return rows


def unpack(rows: list) -> Tree:
    children: dict[int, list[Tree]] = {}
    tree = None
    for r in sorted(rows, key=lambda r: -r["dfs"]):
        tree = Tree(r["kind"], r["type"], r["value"], r["vtype"], r["role"], r["alias"], r["line"], r["end_line"], tuple(reversed(children.pop(r["dfs"], []))))
        if r["parent"] is not None:
            children.setdefault(r["parent"], []).append(tree)
    return tree


# -- fingerprints --------------------------------------------------------------


def _digest(parts: list) -> str:
    return hashlib.blake2b(repr(parts).encode(), digest_size=16).hexdigest()


def exact_fingerprint(t: Tree, alias: bool = True) -> str:
    """Equal for trees that are equal node for node; with ``alias``, import aliases count."""
    return _digest([t.label, t.alias if alias else None, [(c.role, exact_fingerprint(c, alias)) for c in t.children]])


def shape_fingerprint(t: Tree) -> str:
    """Equal for trees of one shape whose types are compatible, whatever their values."""
    return _digest([t.type_class, [(c.role, shape_fingerprint(c)) for c in t.children]])


def operator_category(t: Tree) -> str | None:
    return OPERATOR_CATEGORY.get(t.value or "")


def parse_module(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source) if source is not None else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def find_all(module: ast.Module) -> Iterator[tuple[ast.AST, str, int, ast.stmt]]:
    """(parent, field, place, statement) for every statement, outer ones first."""
    for parent in ast.walk(module):
        for name, value in ast.iter_fields(parent):
            if isinstance(value, list):
                for k, x in enumerate(value):
                    if isinstance(x, ast.stmt):
                        yield parent, name, k, x
