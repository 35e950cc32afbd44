"""Queries of the general problems 1 to 6 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.operators import changes, intervals, late, once, regrid, trailing
from epochal.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    wal = table(spark, d, "wal_entries").select("delivery_id", "batch_id", "db", "layer_id")
    return once.once(wal, late.SOURCE, late.VERSION, deleted=True).select("delivery_id")


def p1_once(spark: SparkSession, d: str) -> DataFrame:
    wal = once.once(table(spark, d, "wal_entries"), late.SOURCE, late.VERSION)
    return wal.select("delivery_id", "batch_id", "db", "layer_id", "lens", "written_at", F.size("taus").cast("long").alias("n_taus"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return late.corrected_daily(table(spark, d, "wal_entries")).where("late > 0").select("db", "lens", "day")


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    out = late.corrected_daily(table(spark, d, "wal_entries"))
    return out.select("db", "lens", "day", *late.COUNTS, *[F.round(c, 4).alias(c) for c in late.TOTALS])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = trailing.trailing_of_facts(table(spark, d, "facts"), [7, 30])
    return out.where("day >= first_day + 29 and total_30 > 0 and total_7 > total_30 / 2").select("lens", "day")


def p3_trailing(spark: SparkSession, d: str) -> DataFrame:
    out = trailing.trailing_of_facts(table(spark, d, "facts"), [7, 30])
    return out.select("lens", "day", "active", "total_7", "total_30", "values_7", "values_30", F.round("average_7", 4).alias("average_7"), F.round("average_30", 4).alias("average_30"))


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    return regrid.regular_series(table(spark, d, "facts_nd"), table(spark, d, "lens_catalog"))


def p4_observed(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the series that readings cover, with their values."""
    return p4_series(spark, d).where("status = 'observed'").select("lens", "device", "t", "value")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_series(spark, d).where("status <> 'observed'").select("lens", "device", "t")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.live(changes.rebuild(table(spark, d, "change_feed"))).select("lens", "lo", "layer_id")


def p5_state(spark: SparkSession, d: str) -> DataFrame:
    return changes.live(changes.rebuild(table(spark, d, "change_feed"))).select("lens", "lo", "hi", "value", "layer_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods_and_gaps(table(spark, d, "run_entries"), ["lens", "epoch"])


QUERIES = {f.__name__: f for f in (p1_found, p1_once, p2_found, p2_daily, p3_found, p3_trailing, p4_found, p4_series, p4_observed, p5_found, p5_state, p6_found)}

_KEPT = """kept AS (
  SELECT * FROM wal_entries
  QUALIFY row_number() OVER (PARTITION BY db, layer_id ORDER BY batch_id, delivery_id) = 1
)"""
_EVENTS = f"""WITH {_KEPT}, events AS (
  SELECT db, lower(trim(lens)) AS lens, e.lo AS lo, e.value AS value,
         CASE WHEN abs(written_at) < 100000000000 THEN written_at * 1000 ELSE written_at END AS w
  FROM (SELECT db, lens, written_at, unnest(taus) AS e FROM kept)
), dayed AS (
  SELECT *, CAST(floor(lo / 86400) AS BIGINT) AS day, (CAST(floor(lo / 86400) AS BIGINT) + 1) * 86400000 AS day_end FROM events WHERE lo IS NOT NULL
)"""
_TRAILING = """WITH best AS (
  SELECT lens, lo, value FROM facts
  QUALIFY row_number() OVER (PARTITION BY lens, lo ORDER BY layer_id DESC NULLS LAST, value DESC NULLS LAST) = 1
), daily AS (
  SELECT lens, CAST(floor(lo / 86400) AS BIGINT) AS day, count(*) AS n, count(value) AS nv, coalesce(sum(value), 0.0) AS total FROM best GROUP BY ALL
), grid AS (
  SELECT lens, first_day, unnest(generate_series(first_day, last_day)) AS day
  FROM (SELECT lens, min(day) AS first_day, max(day) AS last_day FROM daily GROUP BY lens)
), dense AS (
  SELECT g.lens, g.first_day, g.day, coalesce(n, 0) AS n, coalesce(nv, 0) AS nv, coalesce(total, 0.0) AS total
  FROM grid g LEFT JOIN daily d ON g.lens = d.lens AND g.day = d.day
), rolled AS (
  SELECT lens, first_day, day, CAST(n AS BIGINT) AS active,
         sum(total) OVER w7 AS total_7, sum(total) OVER w30 AS total_30,
         CAST(sum(nv) OVER w7 AS BIGINT) AS values_7, CAST(sum(nv) OVER w30 AS BIGINT) AS values_30
  FROM dense
  WINDOW w7 AS (PARTITION BY lens ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY lens ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
)"""
_STATE = """WITH slots AS (
  SELECT lens, e.lo AS lo, e.hi AS hi, e.value AS value, layer_id, feed_pos, lower(trim(op)) LIKE 'd%' AS deleted
  FROM (SELECT lens, layer_id, feed_pos, op, unnest(taus) AS e FROM change_feed)
), best AS (
  SELECT * FROM slots QUALIFY row_number() OVER (PARTITION BY lens, lo ORDER BY layer_id DESC, feed_pos DESC) = 1
)"""

SQL = {
    "p1_found": "SELECT delivery_id FROM wal_entries QUALIFY row_number() OVER (PARTITION BY db, layer_id ORDER BY batch_id, delivery_id) > 1",
    "p1_once": f"WITH {_KEPT} SELECT delivery_id, batch_id, db, layer_id, lens, written_at, CAST(len(taus) AS BIGINT) AS n_taus FROM kept",
    "p2_found": f"{_EVENTS} SELECT DISTINCT db, lens, day FROM dayed WHERE w >= day_end AND w < day_end + 3 * 86400000",
    "p2_daily": f"""{_EVENTS} SELECT db, lens, day,
      count(*) FILTER (w < day_end) AS on_time,
      count(*) FILTER (w >= day_end AND w < day_end + 3 * 86400000) AS late,
      count(*) FILTER (w >= day_end + 3 * 86400000) AS too_late,
      count(*) FILTER (w IS NULL) AS undated,
      round(coalesce(sum(value) FILTER (w IS NULL OR w < day_end + 3 * 86400000), 0.0), 4) AS total,
      round(coalesce(sum(value) FILTER (w < day_end), 0.0), 4) AS total_on_time
      FROM dayed GROUP BY db, lens, day""",
    "p3_found": f"{_TRAILING} SELECT lens, day FROM rolled WHERE day >= first_day + 29 AND total_30 > 0 AND total_7 > total_30 / 2",
    "p3_trailing": f"{_TRAILING} SELECT lens, day, active, total_7, total_30, values_7, values_30, round(total_7 / 7.0, 4) AS average_7, round(total_30 / 30.0, 4) AS average_30 FROM rolled",
    "p4_observed": """WITH r AS (
      SELECT lens, unnest(generate_series(axes[1].lo, axes[1].hi - 1)) AS device, layer_id, lo, hi, value FROM facts_nd WHERE lo < hi AND axes[1].lo < axes[1].hi
    ), s AS (SELECT lens, min(step_secs) AS step FROM lens_catalog WHERE step_secs > 0 GROUP BY lens),
    cells AS (SELECT lens, device, layer_id, value, unnest(generate_series(CAST(ceil(lo / step) AS BIGINT) * step, hi - 1, step)) AS t FROM r JOIN s USING (lens))
    SELECT lens, device, t, value FROM cells QUALIFY row_number() OVER (PARTITION BY lens, device, t ORDER BY layer_id DESC NULLS LAST, value DESC NULLS LAST) = 1""",
    "p4_found": """WITH r AS (
      SELECT lens, unnest(generate_series(axes[1].lo, axes[1].hi - 1)) AS device, lo, hi FROM facts_nd WHERE lo < hi AND axes[1].lo < axes[1].hi
    ), s AS (SELECT lens, min(step_secs) AS step FROM lens_catalog WHERE step_secs > 0 GROUP BY lens),
    sources AS (SELECT lens, device, step, min(lo) AS a, max(hi) AS b FROM r JOIN s USING (lens) GROUP BY ALL),
    cells AS (SELECT lens, device, unnest(generate_series(CAST(ceil(a / step) AS BIGINT) * step, b - 1, step)) AS t FROM sources),
    covered AS (SELECT DISTINCT lens, device, unnest(generate_series(CAST(ceil(lo / step) AS BIGINT) * step, hi - 1, step)) AS t FROM r JOIN s USING (lens))
    SELECT lens, device, t FROM cells ANTI JOIN covered USING (lens, device, t)""",
    "p5_found": f"{_STATE} SELECT lens, lo, layer_id FROM best WHERE NOT deleted",
    "p5_state": f"{_STATE} SELECT lens, lo, hi, value, layer_id FROM best WHERE NOT deleted",
    "p6_found": """WITH v AS (SELECT DISTINCT lens, epoch, lo, hi FROM run_entries WHERE lo < hi),
    reach AS (SELECT *, max(hi) OVER (PARTITION BY lens, epoch ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
    flagged AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY lens, epoch ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM reach),
    periods AS (SELECT lens, epoch, min(lo) AS lo, max(hi) AS hi FROM flagged GROUP BY lens, epoch, island)
    SELECT lens, epoch, 'period' AS kind, lo, hi FROM periods
    UNION ALL
    SELECT lens, epoch, 'gap' AS kind, hi AS lo, next AS hi FROM (SELECT *, lead(lo) OVER (PARTITION BY lens, epoch ORDER BY lo) AS next FROM periods) WHERE next IS NOT NULL""",
}
