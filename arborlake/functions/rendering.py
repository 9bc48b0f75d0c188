"""Trees, templates and forests as text: labels, leaf paths and graphs in the DOT language."""

from __future__ import annotations

from .changes import Template, references
from .kernels import leaf_paths
from .trees import Tree

SIDES = ("before", "after", "within", "before_context", "after_context")


def label(t: Tree, number: int | None = None) -> str:
    """A node's type, number and value."""
    head = t.type if number is None else f"{t.type} ({number})"
    return head if t.value is None else f"{head}\n{t.value[:1000]}"


def leaf_path_text(t: Tree) -> list[str]:
    """Each leaf's path up to the root's child."""
    return [" < ".join(f"{n.role}:{n.type}" + (f"={n.value}" if n.value is not None else "") for n in p) for p in leaf_paths(t)]


def _quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def tree_dot(t: Tree, name: str = "t") -> list[str]:
    """Lines of a DOT graph for one tree; node k of the pre-order is ``name``_k."""
    lines: list[str] = []

    def visit(node: Tree, at: int) -> int:
        lines.append(f"{name}_{at} [label={_quote(label(node, at))}];")
        below = at + 1
        for c in node.children:
            lines.append(f"{name}_{at} -> {name}_{below} [label={_quote(c.role)}];")
            below = visit(c, below)
        return below

    visit(t, 0)
    return lines


def template_dot(t: Template, links: bool = True) -> str:
    """A template's sides as clusters, with dashed edges between nodes that name the same."""
    out = ["digraph template {", f"label={_quote(t.action)};"]
    for side in SIDES:
        tree = getattr(t, side)
        if tree is not None:
            out += [f"subgraph cluster_{side} {{", f"label={_quote(side)};", *tree_dot(tree, side), "}"]
    if links:
        out += [f"{a}_{i} -> {b}_{j} [style=dashed, dir=none];" for a, i, b, j in references(t)]
    return "\n".join([*out, "}"])


def forest_dot(rows: list[tuple[str, str | None, int]]) -> str:
    """(template, parent, instances) rows as a graph of the forest."""
    out = ["digraph forest {"]
    out += [f"{_quote(t)} [label={_quote(f'{t}: {n}')}];" for t, _, n in rows]
    out += [f"{_quote(p)} -> {_quote(t)};" for t, p, _ in rows if p is not None]
    return "\n".join([*out, "}"])
