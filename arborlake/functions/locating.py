"""Where in a module lines lie: regions of changed lines, innermost blocks, paths of tests."""

from __future__ import annotations

import ast

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_IMPORTS = (ast.Import, ast.ImportFrom)
_BLOCKS = (ast.For, ast.AsyncFor, ast.If, ast.With, ast.AsyncWith, ast.Try, ast.TryStar)


def _covers(node: ast.AST, line: int) -> bool:
    return node.lineno <= line <= node.end_lineno


def _owner(module: ast.Module, line: int) -> ast.AST:
    """The import, outermost function, or else innermost class that a line belongs to; the module if none."""
    best: ast.AST = module
    todo = list(ast.iter_child_nodes(module))
    while todo:
        x = todo.pop()
        if isinstance(x, (*_IMPORTS, *_FUNCTIONS)):
            if _covers(x, line):
                return x
        else:
            if isinstance(x, ast.ClassDef) and _covers(x, line):
                best = x
            todo += ast.iter_child_nodes(x)
    return best


def regions(module: ast.Module, lines: list[int], gap: int = 10, imports: bool = True) -> list[list[int]]:
    """Lines as locations: those of one import, function or class, cut where more than ``gap`` apart and then into runs.

    A function owns all lines in it; a class those that no function or import
    of it owns; the module the rest. Locations come in source order, a class
    after what it holds and the module last. Without ``imports`` lines of
    imports are left out. One line alone is a location whatever it is in.
    """
    if len(lines) == 1:
        return [list(lines)]
    of = {k: _owner(module, k) for k in sorted(set(lines))}
    owned: dict[ast.AST, list[int]] = {}
    for k, x in of.items():
        owned.setdefault(x, []).append(k)

    def place(x: ast.AST) -> tuple:
        return (1, 0) if x is module else (0, x.end_lineno if isinstance(x, ast.ClassDef) else x.lineno)

    out: list[list[int]] = []
    for x in sorted(owned, key=place):
        if isinstance(x, _IMPORTS) and not imports:
            continue
        far = [k for a, k in zip(owned[x], owned[x][1:], strict=False) if k - a > gap or k != a + 1]
        run: list[int] = []
        for k in owned[x]:
            if k in far and run:
                out.append(run)
                run = []
            run.append(k)
        out.append(run)
    return out


def innermost(module: ast.Module, lines: list[int], blocks: bool = False) -> ast.AST:
    """The innermost class or function that any of the lines lie in, or, with ``blocks``, loop, condition, with or try that all do."""
    best: ast.AST = module
    todo: list[ast.AST] = [module]
    while todo:
        x = todo.pop(0)
        if isinstance(x, (*_FUNCTIONS, ast.ClassDef)) and any(_covers(x, k) for k in lines) or blocks and isinstance(x, _BLOCKS) and all(_covers(x, k) for k in lines):
            best = x
        todo[:0] = ast.iter_child_nodes(x)
    return best


def insertion_place(module: ast.Module, line: int, docstrings: bool = True) -> tuple[ast.AST, str | None, int]:
    """(block, field, index): the statement of the innermost block that a line between its first and last comes after.

    Without ``docstrings`` the index does not count strings that stand alone
    before it. (block, None, -1) if the line lies between no two statements.
    """
    block = innermost(module, [line], True)
    for name, value in ast.iter_fields(block):
        if isinstance(value, list) and value and isinstance(value[0], ast.stmt) and value[0].lineno < line < value[-1].lineno:
            at = next(i for i, x in enumerate(value) if x.lineno > line) - 1
            strings = sum(isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str) for x in value[:at])
            return block, name, at if docstrings else at - strings
    return block, None, -1


def test_paths(module: ast.Module, classes: list[str], functions: list[str]) -> list[list[str]]:
    """Names from the outermost class or function down to each of ``functions``; with ``classes`` only those through one of them."""
    out: list[list[str]] = []

    def visit(node: ast.AST, path: list[str]) -> None:
        for x in ast.iter_child_nodes(node):
            own = [*path, x.name] if isinstance(x, (*_FUNCTIONS, ast.ClassDef)) else path
            if isinstance(x, _FUNCTIONS) and x.name in functions and (not classes or set(classes) & set(own)):
                out.append(own)
            visit(x, own)

    visit(module, [])
    return out
