"""Expressions over lenses: the tree, its canonical text, and its Spark columns.

Every node becomes a presence and a value. Absence absorbs through every operator, ``&&`` and
``||`` included. A stored null is a value: it equals null alone, and every other operator on it
is an error, raised only for segments where both sides are present.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from epochal.functions.values import LOW, SPARK_TYPES, Value, kind_of


class Expr:
    """A node; operators build trees, so that expressions can be written in Python too."""


@dataclass(frozen=True)
class Lit(Expr):
    value: Value


@dataclass(frozen=True)
class Ident(Expr):
    name: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Rolling(Expr):
    function: str
    lens: str
    begin: int
    end: int


LEVELS = (("||",), ("&&",), ("==", "!=", "<=", ">=", "<", ">"), ("+", "-"), ("*", "/", "%"))  # loosest first


def idents(e: Expr) -> set[str]:
    """Names of the lenses that the expression reads directly."""
    match e:
        case Ident(name) | Rolling(_, name, _, _):
            return {name}
        case Unary(_, of):
            return idents(of)
        case Binary(_, a, b):
            return idents(a) | idents(b)
    return set()


def literal_text(v: Value) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return format(v, "f").rstrip("0").removesuffix(".") + ("" if "." in format(v, "f").rstrip("0").removesuffix(".") else ".0") if isinstance(v, float) else str(v)


def text(e: Expr) -> str:
    """Canonical text, fully parenthesised."""
    match e:
        case Lit(v):
            return literal_text(v)
        case Ident(name):
            return name
        case Unary(op, of):
            return f"{op}({text(of)})"
        case Binary(op, a, b):
            return f"({text(a)} {op} {text(b)})"
        case Rolling(f, lens, begin, end):
            return f"{f}({lens}, {begin}, {end})"
    raise TypeError(e)


@dataclass
class Node:
    """kind: int, float, str, bool, or None if only nulls are possible."""

    kind: str | None
    present: Column
    value: Column


def _raise(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(SPARK_TYPES[kind])


INVALID = "invalid expression: operator {} does not apply"


def _checked(op: str, kind: str, present: Column, bad: Column | bool, value: Column, zero: Column | None = None) -> Node:
    """value where present; an error where present and ``bad`` (or, for divisions, the divisor is zero)."""
    if bad is True:
        return Node(kind, present, F.when(present, _raise(INVALID.format(op), kind)))
    guarded = F.when(~present, F.lit(None).cast(SPARK_TYPES[kind])).when(bad, _raise(INVALID.format(op), kind))
    if zero is not None:
        guarded = guarded.when(zero, _raise("divide by zero", kind))
    return Node(kind, present, guarded.otherwise(value))


def _ordered(op: str, a: Column, b: Column, real: bool) -> Column:
    held = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return held & ~F.isnan(a) & ~F.isnan(b) if real else held  # no order with NaN


def compile_node(e: Expr, columns: dict[Expr, Node]) -> Node:
    """The Spark columns of ``e``; ``columns`` holds the leaves that read lenses. Analyse under ``wrapping``."""
    if e in columns:
        return columns[e]
    match e:
        case Lit(v):
            kind = kind_of(v)
            return Node(kind, F.lit(True), F.lit(v).cast(SPARK_TYPES[kind or "int"]))
        case Unary(op, of):
            x = compile_node(of, columns)
            if op == "!":
                return _checked(op, "bool", x.present, x.value.isNull() if x.kind == "bool" else True, ~x.value if x.kind == "bool" else x.value)
            if x.kind in ("int", "float"):
                return _checked(op, x.kind, x.present, x.value.isNull(), F.lit(0) - x.value if x.kind == "int" else -x.value)
            return _checked(op, "int", x.present, True, x.value)
        case Binary(op, left, right):
            return _binary(op, compile_node(left, columns), compile_node(right, columns))
    raise TypeError(e)


def _binary(op: str, a: Node, b: Node) -> Node:
    present = a.present & b.present
    some_null = a.value.isNull() | b.value.isNull()
    numbers = a.kind in ("int", "float") and b.kind in ("int", "float")
    ints = a.kind == b.kind == "int"
    if op in ("&&", "||"):
        logical = a.kind == b.kind == "bool"
        return _checked(op, "bool", present, some_null if logical else True, (a.value & b.value if op == "&&" else a.value | b.value) if logical else F.lit(None))
    if op in ("==", "!="):
        return _equality(op, a, b, present, some_null, numbers)
    x, y = (a.value, b.value) if ints else (a.value.cast("double"), b.value.cast("double"))
    kind = "int" if ints else "float"
    if op in ("<", "<=", ">", ">="):
        return _checked(op, "bool", present, some_null if numbers else True, _ordered(op, x, y, not ints) if numbers else F.lit(None))
    if not numbers:
        return _checked(op, "int" if a.kind != "float" and b.kind != "float" else "float", present, True, F.lit(None))
    if op in ("+", "-", "*"):
        return _checked(op, kind, present, some_null, {"+": x + y, "-": x - y, "*": x * y}[op])
    bad = some_null | ((x == LOW) & (y == -1)) if ints else some_null
    value = x % y if op == "%" else F.call_function("div", x, y) if ints else x / y
    return _checked(op, kind, present, bad, value, y == 0)


def _equality(op: str, a: Node, b: Node, present: Column, some_null: Column, numbers: bool) -> Node:
    """Numbers compare as doubles, even two ints; null equals null alone; other mixtures are errors."""
    both_null = a.value.isNull() & b.value.isNull()
    if numbers:
        x, y = a.value.cast("double"), b.value.cast("double")
        equal = (x == y) & ~F.isnan(x) & ~F.isnan(y)
    elif a.kind == b.kind and a.kind is not None:
        equal = a.value == b.value
    else:
        equal = None
    with_null = both_null if op == "==" else ~both_null
    if equal is None:  # decided by null or not at all
        return Node("bool", present, F.when(present & some_null, with_null).when(present, _raise(INVALID.format(op), "bool")))
    return Node("bool", present, F.when(present & some_null, with_null).when(present, equal if op == "==" else ~equal))
