"""Boxes: facts that extend along further axes beside time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from epochal.operators import segments
from epochal.operators.segments import Part
from epochal.operators.sweep import HIGH, LOW, Leaf, groups, in_chunks

BOXES = 1 << 10  # boxes of one series and time that one task sweeps at once
LEAF = 32  # boxes that are compared with one another


def parted(facts: DataFrame, keys: list[str], lo: str, hi: str, name: str, piece: int | None = None, long: bool = True):
    """facts with ``name``, the piece of [lo, hi) along one axis of their series, once per piece that they touch; and the cuts."""
    bare = facts.select(*keys, F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    found = segments.cuts(segments._laid([Part(bare, Leaf("depth"))], keys), piece or BOXES, piece or BOXES) if long else {}
    if not found:
        return facts.withColumn(name, F.lit(0)), None
    edges = facts.sparkSession.sparkContext.broadcast(found)
    number, h = segments.piece_number(edges), segments._hash(keys)
    return facts.withColumn(name, F.explode(F.sequence(number(h, F.col(lo)), number(h, F.col(hi) - 1)))), edges


def in_time(facts: DataFrame, keys: list[str], piece: int | None = None, long: bool = True):
    """facts with _h and _b (series and piece of time), laid out by these; and the cuts."""
    placed, edges = parted(facts, keys, "lo", "hi", "_b", piece, long)
    hashed = placed.withColumn("_h", segments._hash(keys))
    return hashed.repartition("_h", "_b").sortWithinPartitions("_h", "_b", *keys), edges


def piece_range(edges, series: int, piece: int) -> tuple[int, int]:
    own = edges.value.get(series) if edges else None
    if own is None:
        return LOW, HIGH
    return int(own[piece - 1]) if piece else LOW, int(own[piece]) if piece < len(own) else HIGH


def newest_boxes(rows: list[dict], start: int = LOW, end: int = HIGH) -> list[tuple]:
    """(lo, hi, axes, value): disjoint boxes inside [start, end) of time, with the newest row's value wherever rows lie.

    Time is swept once. Between two bounds the rows that hold are laid out along the next axis in the same
    way, and so on; what comes out equal on both sides of a bound is one box. Rows with other numbers of
    axes do not meet.
    """
    out = []
    for count in sorted({len(r["axes"]) for r in rows}):
        held = []
        for r in rows:
            if len(r["axes"]) == count:
                spans = [(max(start, r["lo"]), min(end, r["hi"])), *((a["lo"], a["hi"]) for a in r["axes"])]
                if all(a < b for a, b in spans):
                    held.append((spans, r["layer_id"], r["value"]))
        out += [(box[0][0], box[0][1], list(box[1:]), value) for box, (_, value) in _layout(held, 0)]
    return out


def _token(value):
    """A value under which equal values are found in a dictionary; NaN is equal to itself."""
    return (type(value).__name__, "nan" if value != value else value)


def _line(rows: list[tuple], axis: int) -> list[tuple]:
    """((span,), (token, value)) of what is newest along the last axis, touching equal spans joined."""
    from heapq import heappop, heappush

    begins = sorted(range(len(rows)), key=lambda n: rows[n][0][axis][0])
    times = sorted({t for spans, *_ in rows for t in spans[axis]})
    heap, out, k = [], [], 0
    for at, to in zip(times, times[1:]):
        while k < len(begins) and rows[begins[k]][0][axis][0] <= at:
            n = begins[k]
            heappush(heap, (-(LOW if rows[n][1] is None else rows[n][1]), n))
            k += 1
        while heap and rows[heap[0][1]][0][axis][1] <= at:
            heappop(heap)
        if heap:
            value = rows[heap[0][1]][2]
            token = _token(value)
            if out and out[-1][0][1] == at and out[-1][1] == token:
                out[-1][0][1] = to
            else:
                out.append(([at, to], token, value))
    return [((tuple(span),), (token, value)) for span, token, value in out]


def _layout(rows: list[tuple], axis: int) -> list[tuple]:
    """((span of each axis from ``axis`` on...), (token, value)) of what is newest; disjoint."""
    if not rows:
        return []
    if axis + 1 == len(rows[0][0]):
        return _line(rows, axis)
    events: dict[int, tuple[list, list]] = {}
    for n, (spans, *_) in enumerate(rows):
        lo, hi = spans[axis]
        events.setdefault(lo, ([], []))[0].append(n)
        events.setdefault(hi, ([], []))[1].append(n)
    out, active, opened = [], set(), {}  # opened: what holds since when
    for at in sorted(events):
        begins, ends = events[at]
        active.difference_update(ends)
        active.update(begins)
        inner = {(box, token): value for box, (token, value) in _layout([rows[n] for n in sorted(active)], axis + 1)}
        for key in [k for k in opened if k not in inner]:
            since, value = opened.pop(key)
            out.append((((since, at), *key[0]), (key[1], value)))
        for key, value in inner.items():
            opened.setdefault(key, (at, value))
    return out


def colliding(facts: DataFrame, keys: list[str], piece: int | None = None) -> DataFrame:
    """keys, layer_id, lo, other_lo of pairs of boxes of one layer that overlap on every axis, at least one of every clash.

    A layer of more than ``piece`` boxes is cut in time, and each piece of time again along the second
    axis. In a task boxes are halved along whichever axis parts them best, until few are left to compare.
    A row per clash is enough to refuse an append; not all pairs of a group of clashing boxes are listed.
    """
    by = [*keys, "layer_id"]
    second = F.get(F.col("axes"), F.lit(0))
    held = facts.where("lo < hi").select(*by, "lo", "hi", "axes", F.coalesce(second["lo"], F.lit(0)).alias("_lo"), F.coalesce(second["hi"], F.lit(1)).alias("_hi"))
    placed, cut = parted(held, by, "lo", "hi", "_b", piece)
    if cut is None:
        placed = placed.withColumn("_c", F.lit(0))
    else:  # many boxes may share one time
        placed, _ = parted(placed, [*by, "_b"], "_lo", "_hi", "_c", piece)
    own = [*by, "_b", "_c"]
    types = {f.name: f.dataType for f in held.schema.fields}
    schema = StructType([StructField(c, types[c]) for c in by] + [StructField("lo", LongType()), StructField("other_lo", LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        for table in in_chunks(batches, own):
            firsts = [*groups(table, own).tolist(), table.num_rows]
            for a, b in zip(firsts, firsts[1:]):
                part = table.slice(a, b - a)
                spans = [[(r["lo"], r["hi"]), *((x["lo"], x["hi"]) for x in r["axes"])] for r in part.select(["lo", "hi", "axes"]).to_pylist()]
                if clash := first_clash(spans):
                    fixed = {k: part.column(k)[0].as_py() for k in by}
                    yield pa.RecordBatch.from_pylist([fixed | {"lo": spans[clash[0]][0][0], "other_lo": spans[clash[1]][0][0]}], schema=shape)

    return placed.repartition(*own).sortWithinPartitions(*own).mapInArrow(run, schema).distinct()


def first_clash(spans: list) -> tuple[int, int] | None:
    """Two of the boxes (a span per axis) that overlap on every axis, or None."""
    todo = [list(range(len(spans)))]
    while todo:
        own = todo.pop()
        best = None
        if len(own) > LEAF:
            for axis in range(len(spans[own[0]])):
                bounds = sorted(spans[n][axis][0] for n in own)
                cut = bounds[len(own) // 2]
                left, right = [n for n in own if spans[n][axis][0] < cut], [n for n in own if spans[n][axis][1] > cut]
                if best is None or max(len(left), len(right)) < max(len(best[0]), len(best[1])):
                    best = left, right
        if best is not None and max(len(best[0]), len(best[1])) < len(own):
            todo += best
            continue
        for i, a in enumerate(own):
            for b in own[:i]:
                if len(spans[a]) == len(spans[b]) and all(x[0] < y[1] and y[0] < x[1] for x, y in zip(spans[a], spans[b])):
                    return b, a
    return None
