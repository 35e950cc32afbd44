"""Reads of layered facts: points, ranges, aggregates, history; time travel and retention.

``facts``: keys..., layer_id, lo, hi, value and, where used, written_at and axes. ``keys`` may be
empty (one series). Nothing at a point is no row; a stored null is a row with a null value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.functions.values import wrapping
from epochal.operators import segments
from epochal.operators.segments import elementary, same

AGGREGATES = ("count", "sum", "avg", "min", "max")


def as_of(facts: DataFrame, written: int | None) -> DataFrame:
    """Facts of layers written at or before ``written`` (ms); null stamps are never before."""
    return facts if written is None else facts.where(F.col("written_at") <= written)


def of_layer(facts: DataFrame, layer: int | None) -> DataFrame:
    return facts if layer is None else facts.where(F.col("layer_id") == layer)


def fix_axes(facts: DataFrame, coordinates: list[int]) -> DataFrame:
    """Facts whose further axes all contain the coordinates; another number of axes contains none."""
    out = facts.where(F.size("axes") == len(coordinates))
    for i, c in enumerate(coordinates):
        axis = F.get(F.col("axes"), F.lit(i))
        out = out.where((axis["lo"] <= c) & (axis["hi"] > c))
    return out


def cutoff(now_secs: int, ttl: int | None) -> int | None:
    return None if ttl is None else now_secs - ttl


def at(facts: DataFrame, keys: list[str], t: int, coordinates: list[int] | None = None, written: int | None = None, layer: int | None = None, keep_from: int | None = None) -> DataFrame:
    """keys, value at valid time t (and on further axes at ``coordinates``): the newest layer's.

    keep_from: retention cut-off; an earlier t holds nothing. Of facts of one layer the greater value holds.
    """
    hit = of_layer(as_of(facts, written), layer).where((F.col("lo") <= t) & (F.col("hi") > t))
    if coordinates is not None:
        hit = fix_axes(hit, coordinates)
    if keep_from is not None and t < keep_from:
        hit = hit.where(F.lit(False))
    found = hit.groupBy(*keys).agg(F.max(F.struct("layer_id", "value")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return found.where("_n > 0").select(*keys, F.col("_m.value").alias("value"))


def at_points(facts: DataFrame, points: DataFrame, keys: list[str], written: str | None = None, piece: int | None = None) -> DataFrame:
    """Many points at once: points (keys..., t[, written]) with the value at each that is covered.

    Repeated points are answered once. written: name of a column of points with the time to travel to.
    """
    if written is None:
        return segments.at_points(facts, points, keys, piece)
    asked = points.select(*keys, "t", written).distinct()
    held, levels = by_length(facts.where("lo < hi"))
    at = asked.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>"))).withColumn("_b", F.call_function("shiftright", F.col("t"), F.col("_level")))
    on = same([*keys, "_level", "_b"], "p", "f") & (F.col("f.lo") <= F.col("p.t")) & (F.col("p.t") < F.col("f.hi")) & (F.col("f.written_at") <= F.col(f"p.{written}"))
    newest = F.max(F.struct("f.layer_id", "f.value"))
    return at.alias("p").join(held.alias("f"), on).groupBy(*[F.col(f"p.{c}").alias(c) for c in [*keys, "t", written]]).agg(newest.alias("_m")).select(*keys, "t", written, F.col("_m.value").alias("value"))


def by_length(facts: DataFrame) -> tuple[DataFrame, list[int]]:
    """facts with _level, the power of two that is no less than their length, and _b, the runs of that length they touch.

    A fact touches two runs at most, whatever its length, and a point looks into one run per level that
    there is (at most 64). What meets in a run is less than two lengths apart.
    """
    span = F.call_function("try_subtract", F.col("hi"), F.col("lo"))
    level = F.when(span.isNull(), 63).otherwise(F.ceil(F.log2(span.cast("double"))).cast("int"))
    level = F.when((level < 63) & (F.call_function("shiftleft", F.lit(1).cast("long"), level) < span), level + 1).otherwise(level)
    placed = facts.withColumn("_level", F.least(level, F.lit(63)))
    run = lambda c: F.call_function("shiftright", c, F.col("_level"))
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())
    return placed.withColumn("_b", F.explode(F.array_distinct(F.array(run(F.col("lo")), run(F.col("hi") - 1))))), levels


def range_(facts: DataFrame, keys: list[str], start: int | None, end: int | None, coordinates: list[int] | None = None, written: int | None = None, keep_from: int | None = None, piece: int | None = None) -> DataFrame:
    """keys, start, end, value: maximal newest-wins segments of [start, end)."""
    held = as_of(facts, written)
    if coordinates is not None:
        held = fix_axes(held, coordinates)
    if keep_from is not None:
        start = keep_from if start is None else max(start, keep_from)
    if start is not None and end is not None and start >= end:
        held = held.where(F.lit(False))
    return segments.newest_wins(held, keys, start, end, piece)


def page(found: DataFrame, keys: list[str], limit: int | None, offset: int | None) -> DataFrame:
    """Skip ``offset`` rows, then take ``limit``, in the order of keys and start."""
    out = found.orderBy(*keys, "start")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def _smallest(value: Column, kind: str, largest: bool) -> Column:
    pick = F.max if largest else F.min
    if kind not in ("double", "float"):
        return pick(value)
    usable = F.when(~F.isnan(value), value)
    return F.coalesce(pick(usable), pick(value))  # NaN only where there is nothing else


def reduce_segments(pieces: DataFrame, keys: list[str], functions=AGGREGATES) -> DataFrame:
    """keys and one column per function over elementary pieces (start, end, split, value).

    count and sum are per segment; avg weighs by duration and is a double; min and max are unweighted.
    No segment, no row. A null, text or truth value is an error for all but count; one single segment's
    min or max is returned whatever it is. Sums of integers wrap.
    """
    with wrapping(pieces.sparkSession):
        out = _reduced(pieces, keys, functions)
        out.schema  # noqa: B018 - analysed while the session wraps
    return out


def _reduced(pieces: DataFrame, keys: list[str], functions) -> DataFrame:
    kind = dict(pieces.dtypes)["value"]
    numeric = kind in ("bigint", "int", "double", "float")
    span = (F.col("end") - F.col("start")).cast("double")
    whole = F.col("split")
    n = F.sum(F.when(whole, 1).otherwise(0)).cast("long")
    nulls = F.max(F.col("value").isNull())

    def guarded(c: Column, single: bool) -> Column:
        bad = (nulls if numeric else F.lit(True)) & (n > 1 if single else F.lit(True))
        message = F.raise_error(F.lit("invalid expression: aggregate of a value that is no number"))
        return F.when(bad, message.cast(kind if single else "double")).otherwise(c)

    number = F.col("value").cast("double") if numeric else F.lit(None).cast("double")
    total = (lambda: F.sum(F.when(whole, F.col("value")))) if numeric else (lambda: F.lit(None).cast("double"))
    made = {
        "count": n,
        "sum": F.when(nulls if numeric else F.lit(True), F.raise_error(F.lit("invalid expression: aggregate of a value that is no number")).cast(kind if numeric else "double")).otherwise(total()),
        "avg": guarded(F.sum(number * span) / F.sum(span), False),
        "min": guarded(_smallest(F.col("value"), kind, False), True),
        "max": guarded(_smallest(F.col("value"), kind, True), True),
    }
    out = pieces.groupBy(*keys).agg(n.alias("_n"), *[made[f].alias(f) for f in functions])
    return out.where("_n > 0").drop("_n")


def reduce_(facts: DataFrame, keys: list[str], start: int | None, end: int | None, functions=AGGREGATES, written: int | None = None, keep_from: int | None = None, piece: int | None = None) -> DataFrame:
    """Aggregates over the un-merged segments of [start, end); see :func:`reduce_segments`."""
    if keep_from is not None:
        start = keep_from if start is None else max(start, keep_from)
    held = as_of(facts, written)
    if start is not None and end is not None and start >= end:
        held = held.where(F.lit(False))
    return reduce_segments(elementary(held, keys, start, end, piece), keys, functions)


def history(facts: DataFrame, keys: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """keys, id, written_at, min_start, max_end, tau_count of each layer; of those that overlap [start, end) if given."""
    out = facts.groupBy(*keys, F.col("layer_id").alias("id"), "written_at").agg(F.min("lo").alias("min_start"), F.max("hi").alias("max_end"), F.count(F.lit(1)).alias("tau_count"))
    if start is not None:
        out = out.where((F.col("max_end") > start) & (F.col("min_start") < end))
    return out
