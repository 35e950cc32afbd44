"""Derived lenses: expressions evaluated on the common segments of all lenses they read.

All lenses of an expression, those of its rolling aggregates too, are swept together: one shuffle, of
their facts in the range that is read, whatever the expression. The expression itself is a Spark
expression over the columns that the sweep gives.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.functions.expressions import Binary, Expr, Ident, Node, Rolling, Unary, compile_node
from epochal.functions.values import KINDS, SPARK_TYPES, EngineError, wrapping
from epochal.operators import reads, segments
from epochal.operators.segments import Part, bounded
from epochal.operators.sweep import Leaf

@dataclass
class Base:
    """Stored facts: keys..., layer_id, lo, hi, value. keep_from: retention cut-off of operand reads."""

    facts: DataFrame
    keep_from: int | None = None

    @property
    def kind(self) -> str:
        return KINDS[dict(self.facts.dtypes)["value"]]


@dataclass
class Lazy:
    """An expression that is evaluated at every read; absent outside ``over``."""

    expr: Expr
    over: tuple[int, int] | None = None


@dataclass
class Scope:
    """The lenses that an expression can name, their keys, and (for tests) the rows of a piece of a long series."""

    lenses: dict[str, Base | Lazy]
    keys: list[str] = field(default_factory=list)
    piece: int | None = None

    def lens(self, name: str) -> Base | Lazy:
        if name not in self.lenses:
            raise EngineError(f"unknown lens: {name}")
        return self.lenses[name]


def _leaves(scope: Scope, e: Expr) -> list[Expr]:
    """The stored lenses and rolling aggregates that ``e`` reads, through lazy lenses too."""
    match e:
        case Ident(name):
            lens = scope.lens(name)
            return [e] if isinstance(lens, Base) else _leaves(scope, lens.expr)
        case Rolling():
            scope.lens(e.lens)
            return [e]
        case Unary(_, of):
            return _leaves(scope, of)
        case Binary(_, a, b):
            return _leaves(scope, a) + _leaves(scope, b)
    return []


def _marks(scope: Scope, e: Expr) -> set[int]:
    """Fixed times at which ``e`` can change: the ends of what lazy lenses are restricted to."""
    match e:
        case Ident(name) if isinstance(lens := scope.lens(name), Lazy):
            return _marks(scope, lens.expr) | set(lens.over or ())
        case Unary(_, of):
            return _marks(scope, of)
        case Binary(_, a, b):
            return _marks(scope, a) | _marks(scope, b)
    return set()


def _node(scope: Scope, e: Expr, leaves: dict[Expr, Node]) -> Node:
    """Columns of ``e`` with lazy lenses put in place of their names."""
    match e:
        case Ident(name) if isinstance(lens := scope.lens(name), Lazy):
            inner = _node(scope, lens.expr, leaves)
            if lens.over is None:
                return inner
            inside = inner.present & (F.col("start") >= lens.over[0]) & (F.col("start") < lens.over[1])
            return Node(inner.kind, inside, F.when(inside, inner.value))
        case Unary(op, of):
            return compile_node(Unary(op, Ident("\0")), {Ident("\0"): _node(scope, of, leaves)})
        case Binary(op, a, b):
            return compile_node(Binary(op, Ident("\0"), Ident("\1")), {Ident("\0"): _node(scope, a, leaves), Ident("\1"): _node(scope, b, leaves)})
    return compile_node(e, leaves)


def _part(scope: Scope, leaf: Expr, start: int, end: int) -> tuple[Part, str]:
    """The rows that a leaf reads for [start, end), and the kind of its values. Bounds reach the scan."""
    if isinstance(leaf, Ident):
        lens = scope.lens(leaf.name)
        lower = start if lens.keep_from is None else max(start, lens.keep_from)
        return Part(segments.clip(lens.facts.select(*scope.keys, "layer_id", "lo", "hi", "value"), lower, end)), lens.kind
    a, b = bounded(start + leaf.begin), bounded(end + leaf.end)
    lens = scope.lens(leaf.lens)
    if isinstance(lens, Base):
        lower = a if lens.keep_from is None else max(a, lens.keep_from)
        rows, kind = segments.clip(lens.facts.select(*scope.keys, "layer_id", "lo", "hi", "value"), lower, b), lens.kind
    else:
        inner, _, kind = _cells(scope, [Ident(leaf.lens)], a, max(a, b), whole=True)
        rows = inner.select(*scope.keys, F.col("start").alias("lo"), F.col("end").alias("hi"), "value", F.col("present").cast("long").alias("_n"))
    return Part(rows, Leaf("roll", leaf.function, leaf.begin, leaf.end)), {"count": "int", "avg": "float"}.get(leaf.function, kind)


def _cells(scope: Scope, exprs: list[Expr], start: int, end: int, whole: bool = False) -> tuple[DataFrame, bool, str]:
    """keys, _h, _b, start, end, split, _edge, value of the first expression where it is present and the second is true.

    whole: absent cells, too, with a column ``present``. Also: whether a series was cut, and the kind of the value.
    """
    e, *tests = exprs
    leaves = list(dict.fromkeys(x for y in exprs for x in _leaves(scope, y)))
    read = [_part(scope, leaf, start, end) for leaf in leaves]
    if start >= end:
        read = [(Part(p.rows.where(F.lit(False)), p.leaf), k) for p, k in read]
    parts = [p for p, _ in read]
    if not scope.keys:  # the one series there is, though nothing be stored in it
        spark = _session(scope)
        anchor = spark.range(1 if start < end else 0).select(F.lit(start).cast("long").alias("lo"), F.lit(end).cast("long").alias("hi"), F.lit(0).cast("long").alias("_n"))
        parts = [*parts, Part(anchor, Leaf("depth"))]
    marks = sorted({t for x in exprs for t in _marks(scope, x) if start < t < end})
    spec = {"start": start, "end": end, "cover": True, "keep": True, "points": tuple(marks)}
    if not parts:
        raise EngineError("invalid expression: constants have no series")
    rows, cut = segments.cells(parts, scope.keys, spec, scope.piece)
    nodes: dict[Expr, Node] = {}
    with wrapping(rows.sparkSession):
        for i, (leaf, (_, kind)) in enumerate(zip(leaves, read)):
            value = F.col(f"x{i}")
            if isinstance(leaf, Rolling):
                error = F.raise_error(F.lit("invalid expression: aggregate of a value that is no number")).cast(SPARK_TYPES[kind])
                value = F.when(F.col(f"bad{i}"), error).otherwise(value)
            nodes[leaf] = Node(kind, F.col(f"p{i}"), value)
        node = _node(scope, e, nodes)
        for test in tests:
            found = _node(scope, test, nodes)
            rows = rows.where(found.present & F.coalesce(found.value, F.lit(False))) if found.kind == "bool" else rows.where(F.lit(False))
        if not whole:
            rows = rows.where(node.present)
        kind = node.kind or "int"
        value = F.when(node.present, node.value) if whole else node.value
        out = rows.select(*scope.keys, "_h", "_b", "start", "end", "split", "_edge", value.cast(SPARK_TYPES[kind]).alias("value"), *([node.present.alias("present")] if whole else []))
        out.schema  # noqa: B018 - analysed while the session wraps
    return out, cut, kind


def evaluate(scope: Scope, e: Expr, start: int, end: int, where: Expr | None = None) -> DataFrame:
    """keys, start, end, value of ``e`` on un-merged segments of [start, end); absent ones have no row.

    A segment's value is the expression at its start. where: only segments on which it is true stay
    (absent, null and other values drop the segment); its boundaries split too. A series is what has
    a fact in the range; without keys there is one series whatever is stored.
    """
    out, cut, _ = _cells(scope, [e] + ([where] if where is not None else []), start, end)
    return segments.unsplit(out, scope.keys, cut)


def _session(scope: Scope):
    from pyspark.sql import SparkSession

    for lens in scope.lenses.values():
        if isinstance(lens, Base):
            return lens.facts.sparkSession
    return SparkSession.active()


def range_expr(scope: Scope, e: Expr, start: int, end: int, where: Expr | None = None) -> DataFrame:
    """keys, start, end, value: maximal segments of an expression, filtered before they are merged."""
    out, cut, _ = _cells(scope, [e] + ([where] if where is not None else []), start, end)
    return segments.merged(out, scope.keys, cut)


def reduce_expr(scope: Scope, e: Expr, start: int, end: int, functions=reads.AGGREGATES) -> DataFrame:
    """Aggregates over the un-merged segments of an expression."""
    pieces, _, _ = _cells(scope, [e], start, end)
    return reads.reduce_segments(pieces, scope.keys, functions)


def at_expr(scope: Scope, e: Expr, t: int) -> DataFrame:
    """keys, value of an expression at one time."""
    return evaluate(scope, e, t, t + 1).select(*scope.keys, "value")
