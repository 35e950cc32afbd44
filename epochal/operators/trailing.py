"""Rolling totals over trailing periods, by block decomposition.

Time is cut into blocks as long as the window. Inside a block, prefix and suffix sums
are built, each in one cumulative pass; the total of the window that ends on a day is the
prefix up to that day plus the suffix of the block before, from the day after the one a
window's length ago. Days are laid out in spans of whole blocks of every window, each with the days
of a window before it, so that one shuffle serves all windows and a long series spreads over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.runtime import DAY, floor_div

LOWEST = -(1 << 63)
SPAN = 1024  # days of a span at least


def newest(facts: DataFrame, keys: list[str], value: str = "value", layer: str = "layer_id") -> DataFrame:
    """Per key, the value of the highest layer (a null layer is lowest; equal layers: the greatest value).

    A stored null of the highest layer hides older values and is returned.
    """
    top = F.max(F.struct(F.coalesce(F.col(layer), F.lit(LOWEST)).alias("l"), F.col(value).alias("v")))
    return facts.groupBy(*keys).agg(top.alias("top")).select(*keys, F.col("top.v").alias(value))


def daily(facts: DataFrame, series: list[str], at: str, value: str, period: int = DAY) -> DataFrame:
    """Per series and period: n (facts), n_values (not null or NaN) and total. A fact without a start is void."""
    usable = F.col(value).isNotNull() & ~F.isnan(value)
    return (
        facts.where(F.col(at).isNotNull())
        .groupBy(*series, floor_div(at, period).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(usable, 1).otherwise(0)).cast("long").alias("n_values"),
            F.sum(F.when(usable, F.col(value)).otherwise(0.0)).alias("total"),
        )
    )


def span_of(widths: list[int]) -> int:
    """Days of a span: at least SPAN and four windows, and whole blocks of every width where that stays near it."""
    least = max(SPAN, 4 * max(widths))
    whole = math.lcm(*widths)
    return -(-least // whole) * whole if whole <= least else least


def trailing_totals(days: DataFrame, series: list[str], widths: list[int]) -> DataFrame:
    """For each series and each day from its first to its last: totals and averages over trailing windows.

    days: (series..., day, n, n_values, total), one row per active day, as :func:`daily` gives it.
    Result: series, day, first_day, active, and per width w (the day itself included)
    total_w, values_w and average_w (per day of the window, inactive days counting zero).
    Days without activity are in the result. Null series values form a series of their own.
    """
    widest, span = max(widths), span_of(widths)
    spans = days.groupBy(*series).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    boxes = spans.select(*series, "first_day", "last_day", F.explode(F.sequence(floor_div("first_day", span), floor_div("last_day", span))).alias("_s"))
    # laid out from a window before the span, or before the series' first day
    begin, end = F.col("_s") * span, (F.col("_s") + 1) * span - 1
    grid = boxes.select(*series, "_s", "first_day", F.explode(F.sequence(F.greatest(begin, F.col("first_day")) - widest, F.least(end, F.col("last_day")))).alias("day"))
    # a day belongs to its span and, within a window of the next one's begin, to that one too
    own = floor_div("day", span)
    held = days.withColumn("_s", F.explode(F.array_distinct(F.array(own, floor_div(F.col("day") + widest, span)))))
    none = F.lit(None).cast("long")
    both = grid.select(*series, "_s", "day", "first_day", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("v"), F.lit(0.0).alias("t")).unionAll(
        held.select(*series, "_s", "day", none.alias("first_day"), "n", F.col("n_values").alias("v"), F.col("total").alias("t"))
    )
    by = [*series, "_s"]
    dense = both.repartition(*by).groupBy(*by, "day").agg(F.max("first_day").alias("first_day"), F.sum("n").alias("active"), F.sum("v").alias("v"), F.sum("t").alias("t")).where("first_day is not null")
    out = dense
    for w in widths:
        block = Window.partitionBy(*by, f"_b{w}")
        upto = block.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        after = block.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
        ago = Window.partitionBy(*by).orderBy("day")  # one row a day: w rows are w days
        out = out.withColumn(f"_b{w}", floor_div("day", w))
        out = out.withColumns({f"_p{c}{w}": F.sum(c).over(upto) for c in "tv"} | {f"_q{c}{w}": F.sum(c).over(after) for c in "tv"})
        out = out.withColumns({f"_q{c}{w}": F.lag(f"_q{c}{w}", w).over(ago) for c in "tv"})
    zero = {"t": F.lit(0.0), "v": F.lit(0).cast("long")}
    total = lambda w, c: F.col(f"_p{c}{w}") + F.coalesce(f"_q{c}{w}", zero[c])
    return out.where((own == F.col("_s")) & (F.col("day") >= F.col("first_day"))).select(
        *series, "day", "first_day", "active",
        *[total(w, "t").alias(f"total_{w}") for w in widths],
        *[total(w, "v").alias(f"values_{w}") for w in widths],
        *[(total(w, "t") / float(w)).alias(f"average_{w}") for w in widths],
    )


def trailing_of_facts(facts: DataFrame, widths: list[int]) -> DataFrame:
    """Trailing totals per lens and day; per (lens, start) only the highest layer counts."""
    kept = newest(facts.select("lens", "lo", "layer_id", "value"), ["lens", "lo"])
    return trailing_totals(daily(kept, ["lens"], "lo", "value"), ["lens"], widths)
