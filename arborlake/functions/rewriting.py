"""Patches from templates: masked source, mask-aware comparison, prompts."""

from __future__ import annotations

import ast
import codeop
import copy
import difflib
import io
import re
import tokenize
from collections.abc import Callable, Iterator
from itertools import product

from .trees import Tree, find_all, parse_module
from .vocabulary import ABSTRACTED, ATTRIBUTE_MASK, CATEGORY_OPERATORS, EXPRESSION_MASK, OPERATOR_CODE, REFERRED, STATEMENT_MASK


def strip_comments(module: ast.Module) -> ast.Module:
    """Without strings that stand alone as statements; a body left empty gets ``pass``."""

    class Strip(ast.NodeTransformer):
        def visit_Expr(self, node: ast.Expr):
            return None if isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) else node

    out = Strip().visit(copy.deepcopy(module))
    for node in ast.walk(out):
        if isinstance(getattr(node, "body", None), list) and not node.body and not isinstance(node, ast.Module):
            node.body = [ast.Pass()]
    return ast.fix_missing_locations(out)


# -- from pattern to syntax ---------------------------------------------------------


def operator_choices(pattern: Tree) -> list[list[str]]:
    """For each generalised operator of the pattern, in pre-order, the operators it may be."""
    return [CATEGORY_OPERATORS[n.value] for n in pattern.walk() if n.kind == "Op" and n.value in CATEGORY_OPERATORS]


def choices(lists: list[list[str]]) -> Iterator[tuple[str, ...]]:
    """Every way to take one of each list."""
    return product(*lists)


def _expression(text: str) -> ast.expr:
    return ast.parse(text, mode="eval").body


def _operator(name: str) -> ast.AST:
    return getattr(ast, name)()


def to_syntax(t: Tree, ops: Iterator[str], bound: Callable[[Tree], ast.AST | None] = lambda _: None) -> ast.AST:
    """The syntax node of a pattern; what is generalised becomes a mask, what ``bound`` knows a copy of its node."""
    known = bound(t)
    if known is not None:
        return copy.deepcopy(known)
    if t.general or t.kind == "Reference":
        return ast.Expr(_expression(STATEMENT_MASK)) if t.kind == "Stmt" else _expression(EXPRESSION_MASK)
    if t.kind in ("Variable", "Type", "Builtin"):
        return _expression(EXPRESSION_MASK if t.value in (None, ABSTRACTED, REFERRED) else t.value)
    if t.kind == "Attribute":
        return _expression(ATTRIBUTE_MASK if t.value in (None, ABSTRACTED, REFERRED) else t.value)
    if t.kind == "Literal":
        return _expression(t.value if t.vtype is not None else EXPRESSION_MASK)
    if t.kind == "Op":
        return _operator(next(ops) if t.value in CATEGORY_OPERATORS else t.value)
    if t.kind == "Keyword":
        value = to_syntax(t.children[0], ops, bound) if t.children else _expression(EXPRESSION_MASK)
        return ast.keyword(None if t.value is None else EXPRESSION_MASK if t.value in (ABSTRACTED, REFERRED) else t.value, value)
    if t.kind == "Module":
        return ast.alias(EXPRESSION_MASK if t.value in (None, ABSTRACTED, REFERRED) else t.value, t.alias)
    return _compound(t, ops, bound)


def _compound(t: Tree, ops: Iterator[str], bound) -> ast.AST:
    """A statement or expression: its class's fields from the children by role, masks for required ones that lack."""
    kind = getattr(ast, t.type)
    roles = t.roles()
    values: dict[str, object] = {}
    for name in kind._fields:
        own = roles.get({"ops": "op"}.get(name, name) if t.type == "Compare" else name, ())
        if name == "args" and t.type in ("FunctionDef", "AsyncFunctionDef", "Lambda"):
            values[name] = parameters(roles, ops, bound)
            continue
        nodes = [to_syntax(c, ops, bound) for c in own]
        if name == "names" and t.type in ("Global", "Nonlocal"):
            values[name] = [c.value or EXPRESSION_MASK for c in roles.get("name", ())] or [EXPRESSION_MASK]
        elif name in _LISTS.get(t.type, _COMMON_LISTS):
            stmts = name in ("body", "orelse", "finalbody") and t.type not in ("Lambda", "IfExp")
            nodes = [n if not (stmts and isinstance(n, ast.expr)) else ast.Expr(n) for n in nodes]
            values[name] = nodes or ([ast.Expr(_expression(STATEMENT_MASK))] if stmts and name == "body" else [])
        elif name in ("name", "id", "arg", "attr", "module", "rest"):
            values[name] = own[0].value if own and own[0].value not in (ABSTRACTED, REFERRED) else None if name in ("module", "rest") or t.type == "ExceptHandler" else EXPRESSION_MASK
        elif name == "ctx":
            values[name] = ast.Load()
        elif nodes:
            values[name] = nodes[0]
        else:
            values[name] = {"level": 0, "simple": 1, "is_async": 0, "conversion": -1}.get(name, _expression(EXPRESSION_MASK) if name in _REQUIRED.get(t.type, ()) else None)
    return ast.fix_missing_locations(_contexts(kind(**values)))


_COMMON_LISTS = frozenset({"body", "orelse", "finalbody", "handlers", "targets", "names", "args", "keywords", "elts", "values", "generators", "ifs", "ops", "comparators", "decorator_list", "items", "keys", "bases", "type_params", "cases", "patterns", "kwd_attrs", "kwd_patterns"})
_LISTS = {"Lambda": frozenset(), "IfExp": frozenset(), "Assign": frozenset({"targets"})}
_REQUIRED = {
    "Assign": ("value",), "AugAssign": ("target", "op", "value"), "AnnAssign": ("target", "annotation"), "For": ("target", "iter"), "While": ("test",), "If": ("test",),
    "Assert": ("test",), "Expr": ("value",), "BinOp": ("left", "op", "right"), "UnaryOp": ("op", "operand"), "Compare": ("left",), "Call": ("func",), "Subscript": ("value", "slice"),
    "IfExp": ("test", "body", "orelse"), "Starred": ("value",), "Await": ("value",), "keyword": ("value",), "withitem": ("context_expr",), "comprehension": ("target", "iter"), "ListComp": ("elt",), "SetComp": ("elt",), "GeneratorExp": ("elt",), "DictComp": ("key", "value"), "Lambda": ("body",), "NamedExpr": ("target", "value"), "YieldFrom": ("value",), "FormattedValue": ("value",),
}


def parameters(roles, ops, bound) -> ast.arguments:
    def one(c: Tree) -> tuple[ast.arg, ast.expr | None]:
        own = c.roles()
        note = to_syntax(own["annotation"][0], ops, bound) if "annotation" in own else None
        default = to_syntax(own["default"][0], ops, bound) if "default" in own else None
        return ast.arg(c.value if c.value not in (None, ABSTRACTED, REFERRED) else EXPRESSION_MASK, note), default

    plain = [one(c) for c in roles.get("args", ())]
    named = [one(c) for c in roles.get("kwonlyargs", ())]
    star = [one(c)[0] for c in roles.get("vararg", ())]
    double = [one(c)[0] for c in roles.get("kwarg", ())]
    return ast.arguments([], [a for a, _ in plain], star[0] if star else None, [a for a, _ in named], [d for _, d in named], double[0] if double else None, [d for _, d in plain if d is not None])


def _contexts(node: ast.AST) -> ast.AST:
    for name in ("targets", "target", "optional_vars"):
        for x in (v if isinstance(v := getattr(node, name, None), list) else [v]):
            for inner in ast.walk(x) if isinstance(x, ast.AST) else ():
                if isinstance(inner, (ast.Name, ast.Attribute, ast.Subscript, ast.Starred, ast.List, ast.Tuple)):
                    inner.ctx = ast.Store()
    return node


def statement(node: ast.AST) -> ast.stmt:
    return ast.Expr(node) if isinstance(node, ast.expr) else node


# -- masks ------------------------------------------------------------------------

_MASKS = (EXPRESSION_MASK, STATEMENT_MASK)
_MASKABLE = (ast.Name, ast.Constant, ast.Attribute, ast.Compare, ast.UnaryOp, ast.BoolOp, ast.Subscript, ast.Call, ast.BinOp, ast.Dict)


def is_mask(node: ast.AST) -> bool:
    if isinstance(node, ast.Expr):
        return isinstance(node.value, ast.Name) and node.value.id == STATEMENT_MASK
    return isinstance(node, ast.Name) and node.id in _MASKS or isinstance(node, ast.Attribute) and ast.unparse(node) == ATTRIBUTE_MASK


_OPERATIONS = (ast.Compare, ast.BoolOp, ast.UnaryOp)
_PLAIN = (ast.Name, ast.Constant, ast.Attribute, *_OPERATIONS)


def holds_mask(node: ast.AST) -> bool:
    """Whether a direct part of the node is a mask."""
    return any(isinstance(x, ast.Name) and x.id in _MASKS for x in ast.iter_child_nodes(node))


def mask_admits(node: ast.AST, statements: bool = True) -> bool:
    """Whether an expression mask may stand for ``node``."""
    if isinstance(node, ast.Call):
        return len(node.args) + len(node.keywords) < 3 or isinstance(node.func, ast.Name) and node.func.id.endswith("Error")
    if isinstance(node, ast.BinOp):
        return isinstance(node.op, ast.Mod) and isinstance(node.left, ast.Constant)
    if isinstance(node, ast.Dict):
        return not node.keys
    return isinstance(node, _MASKABLE) or statements and isinstance(node, ast.stmt)


def same_syntax(a, b) -> bool:
    """Equality of syntax, whatever positions, contexts and type comments."""
    return ast.dump(a) == ast.dump(b) if isinstance(a, ast.AST) and isinstance(b, ast.AST) else a == b


def masked_equal(patch, real, statements: bool = True, found: dict | None = None) -> bool:
    """Whether ``real`` fits a masked ``patch``; ``found`` collects what each mask stands for.

    Any operator equals any operator, and scalar fields are not compared. A
    comparison, boolean or unary operation with a masked part may stand for any
    plain expression.
    """
    if isinstance(patch, ast.AST) and isinstance(real, ast.AST):
        if is_mask(patch):
            ok = isinstance(real, ast.stmt) if isinstance(patch, ast.Expr) and statements else mask_admits(real, statements)
            if ok and found is not None:
                found.setdefault(len(found), ast.unparse(real))
            return ok
        if isinstance(patch, _OPERATIONS) and holds_mask(patch) and isinstance(real, _PLAIN):
            return True
        if isinstance(patch, (ast.operator, ast.boolop, ast.unaryop, ast.cmpop)):
            return isinstance(real, (ast.operator, ast.boolop, ast.unaryop, ast.cmpop))
        if type(patch) is not type(real):
            return False
        return all(masked_equal(x, getattr(real, name, None), statements, found) for name, x in ast.iter_fields(patch) if isinstance(x, (ast.AST, list)) and name != "ctx")
    if isinstance(patch, list) and isinstance(real, list):
        return len(patch) == len(real) and all(masked_equal(x, y, statements, found) for x, y in zip(patch, real, strict=True))
    return True


def fits_fix(patch: str, fixed: str, most_lines: int = 20) -> bool:
    """Whether the masked patch can be filled to the fix; False over ``most_lines`` differing lines."""
    a, b = parse_module(patch), parse_module(fixed)
    if a is None or b is None:
        return False
    a, b = strip_comments(a), strip_comments(b)
    differ = sum(x[:1] in "+-" for x in difflib.ndiff(ast.unparse(a).splitlines(), ast.unparse(b).splitlines()))
    return differ <= most_lines and masked_equal(a, b)


def exactly_fixes(candidate: str, fixed: str) -> bool:
    a, b = parse_module(candidate), parse_module(fixed)
    return a is not None and b is not None and same_syntax(strip_comments(a), strip_comments(b))


# -- prompts and filling ------------------------------------------------------------

_ANY_MASK = re.compile(rf"{STATEMENT_MASK}|{EXPRESSION_MASK}\.{EXPRESSION_MASK}|{EXPRESSION_MASK}")


def build_prompt(patch: str, context: int = 50, budget: int = 490, length: Callable[[str], int] = lambda s: len(s.split())) -> dict | None:
    """Prefix, masked part and suffix as one prompt with numbered sentinels; None where it cannot be made to fit.

    A statement mask may fill 15 tokens, an expression mask 5. The context
    shrinks line by line on either side until the prompt is within ``budget``.
    """
    lines = patch.split("\n")
    at = [k for k, x in enumerate(lines) if _ANY_MASK.search(x)]
    if not at:
        return None
    masks: list[str] = []

    def sentinel(m: re.Match) -> str:
        masks.append(m[0])
        return f"<extra_id_{len(masks) - 1}>"

    middle = [_ANY_MASK.sub(sentinel, x) for x in lines[at[0] : at[-1] + 1]]
    for n in range(context, -1, -1):
        text = "\n".join([*lines[max(0, at[0] - n) : at[0]], *middle, *lines[at[-1] + 1 : at[-1] + 1 + n]])
        if length(text) < budget:
            room = sum(15 if m == STATEMENT_MASK else 5 for m in masks)
            return {"prompt": text, "masks": len(masks), "max_length": room, "min_length": len(masks) + 1}
    return None


_SENTINEL = re.compile(r"<extra_id_(\d+)>")


def _parts(prediction: str, count: int) -> list[str] | None:
    """What a model's segmented output gives for sentinels 0 to ``count`` - 1; None where one lacks."""
    parts = _SENTINEL.split(prediction)
    given = {int(k): v.strip() for k, v in zip(parts[1::2], parts[2::2], strict=False)}
    return [given[k] for k in range(count)] if all(k in given for k in range(count)) else None


def fill(patch: str, prediction: str) -> str | None:
    """The patch with its masks replaced by a model's segmented output; None where parts lack or it does not parse."""
    given = _parts(prediction, len(_ANY_MASK.findall(patch)))
    if given is None:
        return None
    serial = iter(given)
    text = _ANY_MASK.sub(lambda m: next(serial), patch)
    return text if parse_module(text) is not None else None


# -- whole lines --------------------------------------------------------------------

#: Lines that are asked for where lines are to be inserted.
INSERTED_LINES = 2


def around_lines(source: str, lines: list[int], added: int = 0) -> tuple[list[str], list[str], int]:
    """What stands before and after the lines' span, and how many lines are to be written in its place.

    ``added`` 1 is an insertion before the first of the lines, 2 one after it.
    Lines of the span that are not among ``lines`` go with it.
    """
    text = source.split("\n")
    first, last = min(lines), max(lines)
    if added:
        at = lines[0] - (added == 1)
        return text[:at], text[at:], INSERTED_LINES
    return text[: first - 1], text[last:], len(lines)


def line_prompt(source: str, lines: list[int], added: int = 0, context: int = 50, budget: int = 390, length: Callable[[str], int] = lambda s: len(s.split())) -> dict | None:
    """Whole lines as sentinels, after what they are now as a string; None where it cannot be made to fit.

    The context shrinks line by line on either side until the prompt is within
    ``budget``; a line has a sentinel of its own, an insertion INSERTED_LINES.
    """
    before, after, count = around_lines(source, lines, added)
    text = source.split("\n")
    now = '"""' + " ".join(text[k - 1].strip() for k in lines if 0 < k <= len(text)) + '"""'
    masks = [f"<extra_id_{k}>" for k in range(count)]
    for n in range(context, 0, -1):
        prompt = " ".join(x for x in [now, *(x.strip() for x in [*before[-n:], *masks, *after[:n]])] if x)
        if length(prompt) < budget:
            return {"prompt": prompt, "masks": count, "max_length": 128, "min_length": 2}
    return None


def _begins(text: str) -> tuple[bool, bool]:
    """Whether more lines can make a source of ``text``, and whether a further line stands within brackets."""
    try:
        compile(text + "\n", "source", "exec", ast.PyCF_ONLY_AST | codeop.PyCF_ALLOW_INCOMPLETE_INPUT)
        return True, False
    except SyntaxError as error:
        if error.msg != "incomplete input":
            return False, False
    except (ValueError, MemoryError, RecursionError):
        return False, False
    try:
        for _ in tokenize.generate_tokens(io.StringIO(text + "\n").readline):
            pass
    except tokenize.TokenError as error:
        return True, "statement" in str(error)
    except SyntaxError:
        pass
    return True, False


def indented(before: list[str], parts: list[str], after: list[str], levels: int = 4) -> Iterator[str]:
    """Sources with ``parts`` as lines between, each at one of ``levels`` indents of four blanks, that parse; one after another.

    Indents are tried line by line, the least first. A beginning that the
    parser rejects before it comes to the end of it is not gone on with: no
    further line can mend that. So the beginnings tried are those that hold up
    to here, not every combination. A blank part, and one that stands within
    brackets, is tried at one indent, since others make no other tree.
    """

    def further(head: list[str], k: int, bracket: bool) -> Iterator[str]:
        if k == len(parts):
            text = "\n".join([*head, *after])
            if parse_module(text) is not None:
                yield text
            return
        for level in range(1 if bracket or not parts[k].strip() else levels):
            own = [*head, " " * (4 * level) + parts[k]]
            holds, inside = _begins("\n".join(own))
            if holds:
                yield from further(own, k + 1, inside)

    holds, inside = _begins("\n".join(before))
    if holds:
        yield from further(before, 0, inside)


def fill_lines(source: str, lines: list[int], prediction: str, added: int = 0, levels: int = 4) -> Iterator[str]:
    """Sources with the lines replaced by a model's segmented output, at every indent that parses; none where parts lack."""
    before, after, count = around_lines(source, lines, added)
    given = _parts(prediction, count)
    return iter(()) if given is None else indented(before, given, after, levels)


def training_masks(tree: ast.AST, depth: int = 3) -> Iterator[tuple[str, list[str]]]:
    """(source, label) pairs: the children of a statement, down to ``depth``, replaced by sentinels in source order."""
    text = ast.unparse(tree)
    for level in range(1, depth + 1):
        nodes = [x for x in _at_depth(tree, level) if isinstance(x, ast.expr) and hasattr(x, "lineno")]
        if not nodes:
            return
        masked = copy.deepcopy(tree)
        twins = [y for x, y in zip(ast.walk(tree), ast.walk(masked), strict=True) if any(x is n for n in nodes)]
        order = sorted(zip(twins, range(len(twins)), strict=True), key=lambda x: (x[0].lineno, x[0].col_offset))
        labels = [ast.unparse(x) for x, _ in order]
        for k, (x, _) in enumerate(order):
            _replace_anywhere(masked, x, ast.Name(f"MASK_{k}_", ast.Load()))
        source = re.sub(r"MASK_(\d+)_", r"<extra_id_\1>", ast.unparse(ast.fix_missing_locations(masked)))
        if source != text:
            yield source, labels


def _at_depth(node: ast.AST, depth: int) -> list[ast.AST]:
    return [node] if depth == 0 else [y for x in ast.iter_child_nodes(node) for y in _at_depth(x, depth - 1)]


def _replace_anywhere(root: ast.AST, old: ast.AST, new: ast.AST) -> None:
    for parent in ast.walk(root):
        for name, value in ast.iter_fields(parent):
            if value is old:
                setattr(parent, name, new)
                return
            if isinstance(value, list):
                for k, x in enumerate(value):
                    if x is old:
                        value[k] = new
                        return


# -- text ---------------------------------------------------------------------------


def dedent(lines: list[str], by: int | None = None) -> list[str]:
    """Lines without the first one's leading blanks, or ``by`` of them."""
    n = len(lines[0]) - len(lines[0].lstrip(" ")) if by is None and lines else by or 0
    return [x[n:] if not x[:n].strip() else x.lstrip(" ") for x in lines]


def enclosing_function(module: ast.Module, lines: list[int]) -> str | None:
    """Source of the smallest function around all the lines."""
    around = [x for x in ast.walk(module) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and all(x.lineno <= k <= x.end_lineno for k in lines)]
    return ast.unparse(min(around, key=lambda x: x.end_lineno - x.lineno)) if around else None


def enclosing_scope(module: ast.Module, lines: list[int]) -> str | None:
    """Dotted path of the innermost class or function that any of the lines lie in."""
    best: tuple[int, str] | None = None

    def visit(node: ast.AST, path: tuple[str, ...]) -> None:
        nonlocal best
        for x in ast.iter_child_nodes(node):
            own = path
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and any(x.lineno <= k <= x.end_lineno for k in lines):
                own = (*path, x.name)
                if best is None or len(own) > best[0]:
                    best = len(own), ".".join(own)
            visit(x, own)

    visit(module, ())
    return best[1] if best else None
