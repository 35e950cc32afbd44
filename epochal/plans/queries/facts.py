"""Layered facts derived from the driver's tables, in Spark and in SQL, and SQL for the segment model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.sources.tables import table

HOUR = 3_600_000_000  # microseconds
T0 = 1_704_067_200_000_000  # 2024-01-01, where the events begin
S, E = T0 - 24 * HOUR, T0 + 40 * 24 * HOUR  # the range of most queries: all events, and a day at most after each
MID = T0 + 5 * 24 * HOUR  # where narrower ranges begin
KEY = ["k"]


def micros(ts: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


# name -> (Spark value, SQL value, hours)
VALUES = {
    "ev24": ("value", "value", 24),
    "ev6": ("value", "value", 6),
    "evi": ("cast(floor(value) as bigint)", "CAST(floor(value) AS BIGINT)", 24),
    "evs": ("event_type", "event_type", 24),
    "evb": ("value > 50", "value > 50", 24),
    "evn": ("case when event_type <> 'error' then value end", "CASE WHEN event_type <> 'error' THEN value END", 24),
}


def events_as(spark: SparkSession, d: str, name: str, key: str = "user_id") -> DataFrame:
    value, _, hours = VALUES[name]
    lo = micros("ts")
    return table(spark, d, "events").select(
        F.col(key).alias("k"), F.col("event_id").alias("layer_id"), F.expr("event_id div 100").alias("written_at"), lo.alias("lo"), (lo + hours * HOUR).alias("hi"), F.expr(value).alias("value")
    )


def sql_events(name: str, key: str = "user_id") -> str:
    _, value, hours = VALUES[name]
    return f"SELECT {key} AS k, event_id AS layer_id, event_id // 100 AS written_at, epoch_us(ts) AS lo, epoch_us(ts) + {hours * HOUR} AS hi, {value} AS value FROM events"


def steps(spark: SparkSession, d: str) -> DataFrame:
    """No overlap: each event holds until the user's next."""
    lo = micros("ts")
    held = table(spark, d, "events").select(F.col("user_id").alias("k"), F.lit(1).cast("long").alias("layer_id"), F.lit(0).cast("long").alias("written_at"), lo.alias("lo"), "value")
    nxt = F.lead("lo").over(Window.partitionBy("k").orderBy("lo"))
    return held.withColumn("hi", nxt).where("hi is not null").select("k", "layer_id", "written_at", "lo", "hi", "value")


SQL_STEPS = "SELECT * FROM (SELECT user_id AS k, CAST(1 AS BIGINT) AS layer_id, CAST(0 AS BIGINT) AS written_at, epoch_us(ts) AS lo, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS hi, value FROM events) WHERE hi IS NOT NULL"


def orders_as(spark: SparkSession, d: str) -> DataFrame:
    """A customer's latest order holds for 90 days; times are days."""
    lo = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("layer_id"), F.expr("o_orderkey div 1000").alias("written_at"), lo.alias("lo"), (lo + 90).alias("hi"), F.col("o_totalprice").alias("value"))


SQL_ORDERS = "SELECT o_custkey AS k, o_orderkey AS layer_id, o_orderkey // 1000 AS written_at, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS lo, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 90 AS hi, o_totalprice AS value FROM orders"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Two axes: time, and three users from the event's own on."""
    lo = micros("ts")
    axis = F.array(F.struct(F.col("user_id").alias("lo"), (F.col("user_id") + 3).alias("hi")))
    return table(spark, d, "events").select(F.col("event_id").alias("layer_id"), F.expr("event_id div 100").alias("written_at"), lo.alias("lo"), (lo + 24 * HOUR).alias("hi"), axis.alias("axes"), "value")


SQL_GRID = f"SELECT 0 AS k, event_id AS layer_id, event_id // 100 AS written_at, epoch_us(ts) AS lo, epoch_us(ts) + {24 * HOUR} AS hi, user_id AS x0, user_id + 3 AS x1, value FROM events"


def sql_clip(facts: str, s: int | None = S, e: int | None = E, name: str = "c") -> str:
    """CTE of facts cut to [s, e)."""
    lo, hi = ("lo" if s is None else f"greatest(lo, {s})"), ("hi" if e is None else f"least(hi, {e})")
    test = " AND ".join(["lo < hi"] + ([f"hi > {s}"] if s is not None else []) + ([f"lo < {e}"] if e is not None else []))
    return f"{name} AS (SELECT k, layer_id, {lo} AS lo, {hi} AS hi, value FROM ({facts}) WHERE {test})"


def sql_pieces(facts: str, s: int | None = S, e: int | None = E, pre: str = "") -> str:
    """CTEs ending in {pre}el: un-merged newest-wins segments (k, start, end, value)."""
    c, g, el = f"{pre}c", f"{pre}g", f"{pre}el"
    return f"""{sql_clip(facts, s, e, c)},
{g} AS (SELECT k, p AS start, lead(p) OVER (PARTITION BY k ORDER BY p) AS "end" FROM (SELECT k, lo AS p FROM {c} UNION SELECT k, hi FROM {c})),
{el} AS (SELECT g.k, g.start, g."end", arg_max_null(c.value, c.layer_id) AS value FROM {g} g JOIN {c} c ON g.k IS NOT DISTINCT FROM c.k AND c.lo <= g.start AND g.start < c.hi WHERE g."end" IS NOT NULL GROUP BY ALL)"""


def sql_merge(src: str, out: str = "mg") -> str:
    """CTEs ending in ``out``: maximal segments of equal value."""
    return f"""{out}0 AS (SELECT *, CASE WHEN lag("end") OVER w = start AND lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS fresh FROM {src} WINDOW w AS (PARTITION BY k ORDER BY start)),
{out}1 AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY start) AS island FROM {out}0),
{out} AS (SELECT k, min(start) AS start, max("end") AS "end", arg_min_null(value, start) AS value FROM {out}1 GROUP BY k, island)"""


def sql_range(facts: str, s: int | None = S, e: int | None = E) -> str:
    return f"WITH {sql_pieces(facts, s, e)}, {sql_merge('el')} SELECT k, start, \"end\", value FROM mg"


def sql_grid_of(lenses: dict[str, str], s: int = S, e: int = E, more: list[str] = ()) -> str:
    """CTEs: a clip per lens, and ``g``, the segments between all their bounds (and ``more`` selects of k, p)."""
    clips = ",\n".join(sql_clip(f, None, None, f"c_{n}") for n, f in lenses.items())
    points = " UNION ".join([f"SELECT k, lo AS p FROM c_{n} UNION SELECT k, hi FROM c_{n}" for n in lenses] + list(more))
    return f"""{clips},
pts AS ({points}),
cut AS (SELECT k, p FROM pts WHERE p > {s} AND p < {e} UNION SELECT k, {s} FROM pts UNION SELECT k, {e} FROM pts),
g AS (SELECT * FROM (SELECT k, p AS start, lead(p) OVER (PARTITION BY k ORDER BY p) AS "end" FROM cut) WHERE "end" IS NOT NULL),
""" + ",\n".join(f"v_{n} AS (SELECT g.k, g.start, arg_max_null(c.value, c.layer_id) AS {n}, true AS {n}_there FROM g JOIN c_{n} c ON g.k = c.k AND c.lo <= g.start AND g.start < c.hi GROUP BY ALL)" for n in lenses)


def sql_aligned(lenses: dict[str, str], value: str, test: str = "true", s: int = S, e: int = E, need: list[str] | None = None) -> str:
    """CTEs ending in ``el``: value on each segment on which all of ``need`` hold something and ``test`` is true."""
    need = list(lenses) if need is None else need
    there = " AND ".join([f"coalesce({n}_there, false)" for n in need] + [f"({test})"])
    joins = " ".join(f"LEFT JOIN v_{n} USING (k, start)" for n in lenses)
    return f"{sql_grid_of(lenses, s, e)},\nel AS (SELECT k, start, \"end\", {value} AS value FROM g {joins} WHERE {there})"
