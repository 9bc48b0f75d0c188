"""Closed vocabularies of the tree algebra."""

from __future__ import annotations

import ast

# Operators by category, in the order in which alternatives are tried.
CATEGORY_OPERATORS = {
    "BOOL_OP": ["And", "Or"],
    "MATH_OP": ["Add", "Sub", "Mult", "MatMult", "Div", "Mod", "Pow", "LShift", "RShift", "BitOr", "BitXor", "BitAnd", "FloorDiv"],
    "UNARY_OP": ["Invert", "Not", "UAdd", "USub"],
    "CMP_OP": ["Eq", "NotEq", "Lt", "LtE", "Gt", "GtE", "Is", "IsNot", "In", "NotIn"],
}
# operators' source text.
OPERATOR_CODE = {
    "And": "and", "Or": "or", "Add": "+", "Sub": "-", "Mult": "*", "MatMult": "@", "Div": "/", "Mod": "%", "Pow": "**", "LShift": "<<", "RShift": ">>",
    "BitOr": "|", "BitXor": "^", "BitAnd": "&", "FloorDiv": "//", "Invert": "~", "Not": "not", "UAdd": "+", "USub": "-", "Eq": "==", "NotEq": "!=",
    "Lt": "<", "LtE": "<=", "Gt": ">", "GtE": ">=", "Is": "is", "IsNot": "is not", "In": "in", "NotIn": "not in",
}
OPERATOR_CATEGORY = {op: category for category, ops in CATEGORY_OPERATORS.items() for op in ops}

# Names that are types.
STANDARD_TYPES = frozenset("int float complex bool list tuple range str bytes bytearray memoryview set frozenset dict dict_keys dict_values dict_items None".split())

# Names that are builtins; error and warning classes count as builtins too.
BUILTINS = frozenset(
    """abs aiter all any anext ascii basestring bin bool breakpoint bytearray bytes callable chr cmp classmethod compile complex delattr dict dir divmod
    enumerate eval exec execfile file filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list
    locals long map max memoryview min next object oct open ord pow print property range raw_input reduce reload repr reversed round set setattr slice
    sorted staticmethod str sum super tuple type unichr unicode vars xrange zip __import__ self""".split()
)
ERRORS = frozenset(
    """BaseException Exception ArithmeticError BufferError LookupError AssertionError AttributeError EOFError GeneratorExit ImportError ModuleNotFoundError
    IndexError KeyError KeyboardInterrupt MemoryError NameError NotImplementedError OSError OverflowError RecursionError ReferenceError RuntimeError
    StopIteration StopAsyncIteration SyntaxError IndentationError TabError SystemError SystemExit TypeError UnboundLocalError UnicodeError
    UnicodeEncodeError UnicodeTranslateError ValueError ZeroDivisionError EnvironmentError IOError WindowsError BlockingIOError ChildProcessError
    ConnectionError BrokenPipeError ConnectionAbortedError ConnectionRefusedError ConnectionResetError FileExistsError FileNotFoundError InterruptedError
    IsADirectoryError NotADirectoryError PermissionError ProcessLookupError TimeoutError""".split()
)
WARNINGS = frozenset(
    """Warning DeprecationWarning PendingDeprecationWarning RuntimeWarning SyntaxWarning UserWarning FutureWarning ImportWarning UnicodeWarning BytesWarning
    EncodingWarning ResourceWarning""".split()
)
NAMES = BUILTINS | ERRORS | WARNINGS

STATEMENTS = (ast.stmt, ast.excepthandler, ast.match_case)

#: The generalisation lattice: what a kind's nodes are instances of.
PARENTS = {
    "Variable": "Identifier", "Attribute": "Identifier", "Type": "Identifier", "Builtin": "Identifier",
    "Identifier": "End_Expr", "Literal": "End_Expr", "Op": "End_Expr", "Module": "End_Expr", "Keyword": "End_Expr",
    "End_Expr": "Expr", "Expr": "Stmt",
}
GENERAL = frozenset({"Stmt", "Expr", "End_Expr", "Identifier"})
IDENTIFIERS = frozenset({"Variable", "Attribute", "Type", "Builtin", "Identifier"})

# Markers of generalised values, and masks in generated source.
ABSTRACTED, REFERRED = "ABSTRACTED", "REFERRED"
EXPRESSION_MASK, ATTRIBUTE_MASK, STATEMENT_MASK = "VALUE_MASK", "VALUE_MASK.VALUE_MASK", "VALUE_MASK___VALUE_MASK"


def is_a(kind: str, other: str) -> bool:
    """Whether ``kind`` is ``other`` or below it in the lattice."""
    while kind != other:
        if kind not in PARENTS:
            return False
        kind = PARENTS[kind]
    return True
