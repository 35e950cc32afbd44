"""Late and out-of-order events: per-period aggregates as conflict-free counters.

A *slot* is a counter keyed by series, period and source (the message that reported
the events), with the sequence of the delivery as its version. Merging keeps, per
source, the slots of its ranking version; totals sum over sources. The merge is
associative, commutative and idempotent, so retries and reordering change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.runtime import DAY, floor_div

SOURCE = ["db", "layer_id"]
VERSION = ["batch_id", "delivery_id"]  # the first delivery ranks highest
SERIES = ["db", "lens"]
UNIT_LIMIT = 100_000_000_000  # a smaller stamp is in seconds: as ms it would lie in 1973
LATENESS = 3  # periods after the end of a period in which it is still corrected


def stamp_ms(written_at: Column) -> Column:
    """Transaction time in milliseconds; stamps in seconds are scaled, null stays null."""
    return F.when(F.abs(written_at) < UNIT_LIMIT, written_at * 1000).otherwise(written_at)


def slots(deliveries: DataFrame, period: int = DAY, lateness: int = LATENESS) -> DataFrame:
    """Counters of each delivery: series, day, source, version; events on time, late, too late, undated.

    An event belongs to the period of its start. On time: written before the period's
    end; late: within ``lateness`` periods after it; later ones are counted as too late
    and left out of the total; those without a stamp are undated and only in the total.
    Null or empty event lists and events without a start give a slot without a day: it holds
    the delivery's version against later copies and is in no total. A null value is
    counted, and adds nothing. Series names are trimmed and in lower case. A delivery given twice
    gives its slots twice, not their sum.
    """
    each = deliveries.withColumn("copy", F.monotonically_increasing_id())
    events = each.select("db", F.lower(F.trim("lens")).alias("lens"), "layer_id", *VERSION, "copy", stamp_ms(F.col("written_at")).alias("w"), F.explode_outer("taus").alias("e"))
    day = floor_div(F.col("e.lo"), period)
    end = (day + 1) * (period * 1000)
    late = (F.col("w") >= end) & (F.col("w") < end + lateness * period * 1000)
    too_late = F.col("w") >= end + lateness * period * 1000
    value = F.coalesce("e.value", F.lit(0.0))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return (
        events.withColumn("day", day)
        .groupBy("db", "lens", "day", "layer_id", *VERSION, "copy")
        .agg(
            count(F.col("w") < end).alias("on_time"),
            count(late).alias("late"),
            count(too_late).alias("too_late"),
            count(F.col("w").isNull() & F.col("e.lo").isNotNull()).alias("undated"),
            F.sum(F.when(too_late, 0.0).otherwise(value)).alias("total"),
            F.sum(F.when(F.col("w") < end, value).otherwise(0.0)).alias("total_on_time"),
        )
        .drop("copy")
    )


COUNTS = ["on_time", "late", "too_late", "undated"]
TOTALS = ["total", "total_on_time"]


def sequence() -> Column:
    """The version of a delivery as a sequence that is highest for the first delivery; a null is lowest."""
    return F.struct(*[F.when(F.col(v).isNotNull(), -F.col(v)).alias(v) for v in VERSION])


def merge(held: DataFrame) -> DataFrame:
    """Slots of any number of deliveries, repeated or out of order, merged per source by maximum.

    Per source the maximum of the version's sequence is taken (of the lowest batch, then delivery; nulls
    rank last), and its slots stay, once each however often they were delivered: the maximum of each counter.
    A source with a null in its key is unknown and kept as it is.
    """
    unknown = F.col("db").isNull() | F.col("layer_id").isNull()
    seq = sequence()
    counter = F.max(F.struct(seq.alias("seq"), *COUNTS, *TOTALS)).alias("c")  # combined before the shuffle
    by = ["db", "lens", "day", "layer_id", "_own"]
    best = held.withColumn("_own", F.when(unknown, seq)).groupBy(*by).agg(counter)  # a source has at most one a period
    top = best.withColumn("_top", F.max("c.seq").over(Window.partitionBy(*SOURCE, "_own")))
    kept = top.where(F.col("_top") == F.col("c.seq"))
    return kept.select("db", "lens", "day", "layer_id", *[(-F.col(f"c.seq.{v}")).alias(v) for v in VERSION], *[F.col(f"c.{c}").alias(c) for c in COUNTS + TOTALS])


def totals(merged: DataFrame) -> DataFrame:
    """Per series and period, the sums over all sources."""
    return merged.where("day is not null").groupBy("db", "lens", "day").agg(*[F.sum(c).alias(c) for c in COUNTS + TOTALS])


def corrected_daily(deliveries: DataFrame, period: int = DAY, lateness: int = LATENESS) -> DataFrame:
    """Per-day aggregates over a whole log of deliveries, corrected as late events arrive.

    The slots of all deliveries, repeated ones included, go through :func:`merge` and :func:`totals`.
    """
    narrow = deliveries.select("db", "lens", "layer_id", *VERSION, "written_at", "taus")
    return totals(merge(slots(narrow, period, lateness)))
