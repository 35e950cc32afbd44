"""Queries of materialised views, text files, appends and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.functions.expressions import Binary, Ident, Lit
from epochal.functions.values import EngineError
from epochal.operators import appends, derived, reads
from epochal.operators.derived import Base, Lazy, Scope
from epochal.plans.engine import Engine
from epochal.plans.queries import problems
from epochal.plans.queries.facts import HOUR, KEY, SQL_STEPS, E, S, events_as, micros, sql_aligned, sql_events, sql_merge, steps
from epochal.runtime import cut_lineage, scratch
from epochal.sources import text
from epochal.sources.tables import table
from epochal.streaming.ingest import CounterLog, append_stream

TWICE = Binary("*", Ident("a"), Lit(2))


def _refresh(facts: DataFrame, layer: int) -> DataFrame:
    """The view computed over ``facts`` as one stored layer."""
    found = derived.range_expr(Scope({"a": Base(facts)}, KEY), TWICE, S, E)
    return cut_lineage(found.select("k", F.lit(layer).cast("long").alias("layer_id"), F.col("start").alias("lo"), F.col("end").alias("hi"), "value"))


def _ranged(facts: str) -> str:
    return f"WITH {sql_aligned({'a': facts}, 'a * 2')}, {sql_merge('el')} SELECT k, start, \"end\", value FROM mg"


def xderive_equals_derive(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(_refresh(events_as(spark, d, "evi"), 0), KEY, S, E)


_EARLY = "layer_id % 3 <> 0"


def xderive_after_correction(spark: SparkSession, d: str) -> DataFrame:
    """A view of part of the layers, refreshed once the others have arrived."""
    facts = events_as(spark, d, "evi")
    views = _refresh(facts.where(_EARLY), 0).unionAll(_refresh(facts, 1))
    return reads.range_(views, KEY, S, E)


def derive_of_view(spark: SparkSession, d: str) -> DataFrame:
    """A lazy lens over a stored view."""
    scope = Scope({"m": Base(_refresh(events_as(spark, d, "evi"), 0)), "out": Lazy(Binary("+", Ident("m"), Lit(1)))}, KEY)
    return derived.range_expr(scope, Ident("out"), S, E)


def csv_copy(spark: SparkSession, d: str) -> DataFrame:
    """All events written as lines, some of them bad, and read as facts with their problems, comments and blank lines aside."""
    lo = micros("ts")
    line = F.concat_ws(",", lo, F.when(F.col("event_id") % 50 == 7, F.lit("x1")).otherwise((lo + 1).cast("string")), F.when(F.col("event_id") % 50 == 9, F.lit("true")).otherwise(F.format_string("%.4f", "value")))
    lines = table(spark, d, "events").select(F.explode(F.array(F.lit("# event"), F.lit(""), F.concat(F.lit("  "), line))).alias("value"))
    path = scratch(spark, "lines")
    lines.write.text(path)
    return text.read_facts(spark, path, "float").select("lo", "hi", "value", "problem")


def _engine(spark: SparkSession, *statements: str) -> Engine:
    engine = Engine(spark, scratch(spark, "engine"))
    for s in ("CREATE DATABASE d", *statements):
        engine.execute(s)
    return engine


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """All events of all users as one series of facts that do not overlap: each holds until the next."""
    held = table(spark, d, "events").select(micros("ts").alias("lo"), "value").groupBy("lo").agg(F.max("value").alias("value"))

    day = F.expr(f"lo div {24 * HOUR}")
    order = Window.partitionBy("_d").orderBy("lo")
    ranked = held.withColumn("_d", day).withColumn("hi", F.lead("lo").over(order))
    return ranked.withColumn("hi", F.coalesce("hi", (F.col("_d") + 1) * (24 * HOUR))).select("lo", "hi", "value")


_SQL_WHOLE = f"SELECT lo, coalesce(lead(lo) OVER (PARTITION BY lo // {24 * HOUR} ORDER BY lo), (lo // {24 * HOUR} + 1) * {24 * HOUR}) AS hi, value FROM (SELECT epoch_us(ts) AS lo, max(value) AS value FROM events GROUP BY ts)"
_SQL_MERGED = f"WITH s AS (SELECT 0 AS k, lo AS start, hi AS \"end\", value FROM ({_SQL_WHOLE})), {sql_merge('s')} SELECT start, \"end\", value FROM mg"


def batch_append(spark: SparkSession, d: str) -> DataFrame:
    """All events appended to a lens of an engine as one checked layer, and read from an engine opened anew."""
    engine = _engine(spark, "CREATE LENS x float")
    engine.append_frame("x", _whole(spark, d))
    again = Engine(spark, engine.path)
    again.execute("USE DATABASE d")
    return again.frame("x", S, E)


def append_nd(spark: SparkSession, d: str) -> DataFrame:
    """The same along a second axis: each event's box holds for the five users from its own; read at each of two users."""
    engine = _engine(spark, "CREATE LENS x float AXES (t, who)")
    boxes = _whole(spark, d).withColumn("who", F.expr("lo div 1000000 % 9"))
    axis = F.array(F.struct(F.col("who").alias("lo"), (F.col("who") + 5).alias("hi")))
    engine.append_frame("x", boxes.select("lo", "hi", axis.alias("axes"), "value"), boxed=True)
    found = [reads.range_(engine.databases["d"].table.facts("x"), [], S, E, coordinates=[x]).withColumn("x", F.lit(x)) for x in (2, 6)]
    return found[0].unionByName(found[1])


def append_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Appends that break a rule, and the errors they are refused with."""
    engine = _engine(spark, "CREATE LENS x float", "CREATE LENS b float AXES (t, who)", "DERIVE LENS y AS x + 1.0")
    facts = _whole(spark, d)
    box = facts.withColumn("axes", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(5).cast("long").alias("hi"))))
    tries = {
        "overlap": lambda: engine.append_frame("x", facts.withColumn("hi", F.col("hi") + 1)),
        "inverted": lambda: engine.append_frame("x", facts.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"), "value")),
        "type": lambda: engine.append_frame("x", facts.withColumn("value", F.lit(1).cast("long"))),
        "boxes": lambda: engine.append_frame("b", box.unionAll(box.withColumn("hi", F.col("hi") + 1)), boxed=True),
        "derived": lambda: engine.append_frame("y", facts),
        "good": lambda: engine.append_frame("x", facts),
    }
    out = []
    for name, go in tries.items():
        try:
            go()
            out.append((name, "OK"))
        except EngineError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "what string, answer string")


def stream_append_then_range(spark: SparkSession, d: str) -> DataFrame:
    """All events streamed into a lens, read as its segments."""
    engine = _engine(spark, "CREATE LENS x float")
    path = scratch(spark, "arrivals")
    _whole(spark, d).write.parquet(path)
    stream = spark.readStream.schema("lo long, hi long, value double").parquet(path)
    append_stream(engine, "x", stream, scratch(spark, "progress"), once=True).awaitTermination()
    return engine.frame("x", S, E)


def append_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Users whose events, taken as one layer, would overlap and be rejected."""
    one = events_as(spark, d, "ev24").withColumn("layer_id", F.lit(1).cast("long"))
    return appends.overlapping(one, KEY).select("k").distinct()


def append_steps_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The same for facts that only touch, of which one user's are lengthened by a little: that user alone."""
    one = steps(spark, d).withColumn("hi", F.when(F.col("k") == 7, F.col("hi") + 1).otherwise(F.col("hi")))
    return appends.overlapping(one, KEY).select("k").distinct()


def stream_late_counters(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries streamed into a log of counters, read as totals: the same as the batch query."""
    log = CounterLog(spark, scratch(spark, "counters"))
    schema = table(spark, d, "wal_entries").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/wal_entries.parque[t]")
    log.write(stream, scratch(spark, "progress"), once=True).awaitTermination()
    out = log.totals()
    return out.select("db", "lens", "day", *problems.late.COUNTS, *[F.round(c, 4).alias(c) for c in problems.late.TOTALS])


QUERIES = {f.__name__: f for f in (xderive_equals_derive, xderive_after_correction, derive_of_view, csv_copy, batch_append, append_nd, append_rejected, stream_append_then_range, append_overlaps, append_steps_overlaps, stream_late_counters)}

_OVERLAP = "SELECT DISTINCT k FROM (SELECT k, lo, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({0})) WHERE reach > lo"
SQL = {
    "xderive_equals_derive": _ranged(sql_events("evi")),
    "xderive_after_correction": _ranged(sql_events("evi")),
    "derive_of_view": _ranged(sql_events("evi")).replace("a * 2", "a * 2 + 1"),
    "csv_copy": """SELECT epoch_us(ts) AS lo, CASE WHEN event_id % 50 <> 7 THEN epoch_us(ts) + 1 END AS hi,
      CASE WHEN event_id % 50 <> 9 THEN CAST(printf('%.4f', value) AS DOUBLE) END AS value,
      CASE event_id % 50 WHEN 7 THEN 'invalid end "x1"' WHEN 9 THEN 'type mismatch' END AS problem FROM events""",
    "batch_append": _SQL_MERGED,
    "stream_append_then_range": _SQL_MERGED,
    "append_nd": " UNION ALL ".join(f"SELECT * FROM (WITH s AS (SELECT 0 AS k, lo AS start, hi AS \"end\", value FROM ({_SQL_WHOLE}) WHERE lo // 1000000 % 9 <= {x} AND lo // 1000000 % 9 + 5 > {x}), {sql_merge('s')} SELECT {x} AS x, start, \"end\", value FROM mg)" for x in (2, 6)),
    "append_rejected": "SELECT * FROM (VALUES ('overlap', 'invalid range (start >= end)'), ('inverted', 'invalid range (start >= end)'), ('type', 'type mismatch on x: expected float, got int'), ('boxes', 'invalid range (start >= end)'), ('derived', 'unknown lens: y'), ('good', 'OK')) AS v(what, answer)",
    "append_overlaps": _OVERLAP.format(sql_events("ev24")),
    "append_steps_overlaps": _OVERLAP.format(f"SELECT k, lo, hi + CASE WHEN k = 7 THEN 1 ELSE 0 END AS hi FROM ({SQL_STEPS})"),
    "stream_late_counters": problems.SQL["p2_daily"],
}
