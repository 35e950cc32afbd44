"""Queries for reads, expressions, rolling aggregates and maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.functions.expressions import Binary, Ident, Lit, Rolling, Unary
from epochal.functions.values import wrapping
from epochal.operators import compaction, derived, reads
from epochal.operators.derived import Base, Lazy, Scope
from epochal.plans.queries.facts import (
    HOUR, KEY, SQL_GRID, SQL_ORDERS, SQL_STEPS, MID, T0, E, S,
    events_as, grid, orders_as, sql_aligned, sql_clip, sql_events, sql_grid_of, sql_merge, sql_pieces, sql_range, steps,
)
from epochal.runtime import cut_lineage

QUERIES: dict = {}
SQL: dict[str, str] = {}
T = T0 + 12 * 24 * HOUR
W = 40  # a stamp in the middle of the events' batches at the smallest scale


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _one(facts: str, test: str) -> str:
    return f"SELECT k, arg_max_null(value, layer_id) AS value FROM ({facts}) WHERE {test} GROUP BY k"


# Points


@query(_one(sql_events("evn"), f"lo <= {T} AND hi > {T}"))
def at_point(spark: SparkSession, d: str) -> DataFrame:
    return reads.at(events_as(spark, d, "evn"), KEY, T)


@query(_one(sql_events("ev6"), "lo <= 0 AND hi > 0"))
def at_miss_nil(spark: SparkSession, d: str) -> DataFrame:
    return reads.at(events_as(spark, d, "ev6"), KEY, 0)


@query(f"""WITH f AS ({sql_events("ev24")}), p AS (SELECT DISTINCT o_custkey % 150 AS k, {T0} + (o_orderkey % 720) * {HOUR} AS t FROM orders)
SELECT p.k, p.t, arg_max_null(value, layer_id) AS value FROM p JOIN f ON p.k = f.k AND lo <= t AND t < hi GROUP BY ALL""")
def at_many_points(spark: SparkSession, d: str) -> DataFrame:
    points = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 150).alias("k"), (T0 + (F.col("o_orderkey") % 720) * HOUR).alias("t"))
    return reads.at_points(events_as(spark, d, "ev24"), points, KEY)


@query(f"""WITH f AS ({sql_events("ev24")}), p AS (SELECT DISTINCT o_custkey % 150 AS k, {T0} + (o_orderkey % 720) * {HOUR} AS t, o_orderkey % 100 AS w FROM orders)
SELECT p.k, p.t, p.w, arg_max_null(value, layer_id) AS value FROM p JOIN f ON p.k = f.k AND lo <= t AND t < hi AND written_at <= w GROUP BY ALL""")
def at_many_points_as_of(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    points = orders.select((F.col("o_custkey") % 150).alias("k"), (T0 + (F.col("o_orderkey") % 720) * HOUR).alias("t"), (F.col("o_orderkey") % 100).alias("w"))
    return reads.at_points(events_as(spark, d, "ev24"), points, KEY, "w")


@query(_one(sql_events("ev24"), f"lo <= {T} AND hi > {T} AND written_at <= {W}"))
def at_as_of(spark: SparkSession, d: str) -> DataFrame:
    return reads.at(events_as(spark, d, "ev24"), KEY, T, written=W)


_BY_HUNDRED = f"SELECT k, layer_id // 100 AS layer_id, written_at, lo, hi, value FROM ({sql_events('ev24')})"


def _by_hundred(spark: SparkSession, d: str) -> DataFrame:
    """A hundred events are one layer; each user's facts in it may overlap, and the greater value holds."""
    return events_as(spark, d, "ev24").withColumn("layer_id", F.expr("layer_id div 100"))


@query(f"WITH f AS ({_BY_HUNDRED}), l AS (SELECT min(layer_id) AS l FROM f WHERE lo <= {T} AND hi > {T}) SELECT k, max(value) AS value FROM f, l WHERE layer_id = l AND lo <= {T} AND hi > {T} GROUP BY k")
def at_layer(spark: SparkSession, d: str) -> DataFrame:
    """What the oldest layer that holds anything at T holds there, though newer ones hide it."""
    facts = _by_hundred(spark, d)
    oldest = facts.where((F.col("lo") <= T) & (F.col("hi") > T)).agg(F.min("layer_id")).head()[0]
    return reads.at(facts, KEY, T, layer=oldest)


@query(f"SELECT k, layer_id, start, \"end\" FROM (SELECT k, layer_id, lo AS start, hi AS \"end\" FROM ({_BY_HUNDRED}) WHERE layer_id = 17)")
def layer_contents(spark: SparkSession, d: str) -> DataFrame:
    """All facts of one layer, as they were appended."""
    return reads.of_layer(_by_hundred(spark, d), 17).select("k", "layer_id", F.col("lo").alias("start"), F.col("hi").alias("end"))


def _box(*at: int) -> str:
    return f"lo <= {at[0]} AND hi > {at[0]} AND x0 <= {at[1]} AND x1 > {at[1]}"


@query(f"SELECT arg_max_null(value, layer_id) AS value FROM ({SQL_GRID}) WHERE {_box(T, 7)} HAVING count(*) > 0")
def at_nd(spark: SparkSession, d: str) -> DataFrame:
    return reads.at(grid(spark, d), [], T, [7])


@query(f"SELECT arg_max_null(value, layer_id) AS value FROM ({SQL_GRID}) WHERE {_box(T, 7)} AND written_at <= {W} HAVING count(*) > 0")
def at_nd_as_of(spark: SparkSession, d: str) -> DataFrame:
    return reads.at(grid(spark, d), [], T, [7], written=W)


# Ranges


@query(sql_range(sql_events("ev24")))
def range_base(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(events_as(spark, d, "ev24"), KEY, S, E)


@query(sql_range(sql_events("evb")))
def range_merged(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(events_as(spark, d, "evb"), KEY, S, E)


@query(sql_range(sql_events("evs", "event_type")))
def range_skewed_keys(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(events_as(spark, d, "evs", "event_type"), KEY, S, E)


@query(sql_range(sql_events("evn"), MID + HOUR, MID + 30 * HOUR))
def range_clipped(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(events_as(spark, d, "evn"), KEY, MID + HOUR, MID + 30 * HOUR)


@query(sql_range(sql_events("ev6")))
def range_gaps(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(events_as(spark, d, "ev6"), KEY, S, E)


@query(sql_range(SQL_STEPS))
def range_steps(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(steps(spark, d), KEY, S, E)


@query(sql_range(SQL_ORDERS, 9000, 12000))
def range_orders(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(orders_as(spark, d), KEY, 9000, 12000)


@query(sql_range(f"SELECT * FROM ({sql_events('ev24')}) WHERE written_at <= {W}"))
def range_as_of(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(events_as(spark, d, "ev24"), KEY, S, E, written=W)


@query(sql_range(sql_events("ev24")) + ' ORDER BY k, start LIMIT 50 OFFSET 20')
def range_limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return reads.page(reads.range_(events_as(spark, d, "ev24"), KEY, S, E), KEY, 50, 20)


@query(f"WITH {sql_pieces(f'SELECT * FROM ({SQL_GRID}) WHERE x0 <= 7 AND x1 > 7')}, {sql_merge('el')} SELECT start, \"end\", value FROM mg")
def range_nd_fixed(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(grid(spark, d), [], S, E, coordinates=[7])


CUT = MID + 100 * HOUR  # now minus the time to live


@query(sql_range(sql_events("ev24"), CUT, E))
def range_ttl(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(events_as(spark, d, "ev24"), KEY, S, E, keep_from=CUT)


@query(f"WITH f AS ({sql_events('ev24')}), p AS (SELECT unnest([{T - 1}, {T}]) AS t) SELECT k, t, arg_max_null(value, layer_id) AS value FROM f, p WHERE t >= {T} AND lo <= t AND hi > t GROUP BY ALL")
def at_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Two times, of which the first is past its time to live."""
    facts = events_as(spark, d, "ev24")
    both = [reads.at(facts, KEY, t, keep_from=T).withColumn("t", F.lit(t).cast("long")) for t in (T - 1, T)]
    return both[0].unionByName(both[1])


def _where(scope: Scope, test) -> DataFrame:
    return derived.range_expr(scope, Ident("a"), S, E, test)


def _scope(spark: SparkSession, d: str, **names: str) -> Scope:
    return Scope({n: Base(events_as(spark, d, f)) for n, f in names.items()}, KEY)


def _ranged(lenses: dict[str, str], value: str, test: str = "true") -> str:
    return f"WITH {sql_aligned({n: sql_events(f) for n, f in lenses.items()}, value, test)}, {sql_merge('el')} SELECT k, start, \"end\", value FROM mg"


@query(_ranged({"a": "ev24"}, "a", "a > 50"))
def range_where_self(spark: SparkSession, d: str) -> DataFrame:
    return _where(_scope(spark, d, a="ev24"), Binary(">", Ident("a"), Lit(50)))


@query(_ranged({"a": "evb", "b": "ev6"}, "a", "b < 100"))
def range_where_other(spark: SparkSession, d: str) -> DataFrame:
    return _where(_scope(spark, d, a="evb", b="ev6"), Binary("<", Ident("b"), Lit(100)))


# Aggregates

NUMBERS = 'CAST(count(*) AS BIGINT) AS "count", round(sum(value), 4) AS "sum", round(sum(value * ("end" - start)) / sum("end" - start), 4) AS "avg", min(value) AS "min", max(value) AS "max"'


def _reduced(facts: str, s: int | None = S, e: int | None = E, what: str = NUMBERS) -> str:
    return f"WITH {sql_pieces(facts, s, e)} SELECT k, {what} FROM el GROUP BY k"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c, t in df.dtypes if t == "double" and c in ("sum", "avg")})


@query(_reduced(sql_events("ev24"), None, None))
def reduce_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reads.reduce_(events_as(spark, d, "ev24"), KEY, None, None))


@query(_reduced(sql_events("ev24")))
def reduce_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reads.reduce_(events_as(spark, d, "ev24"), KEY, S, E))


@query(_reduced(sql_events("evn"), what='CAST(count(*) AS BIGINT) AS "count"'))
def reduce_count(spark: SparkSession, d: str) -> DataFrame:
    return reads.reduce_(events_as(spark, d, "evn"), KEY, S, E, ("count",))


@query(_reduced(sql_events("evi"), what='CAST(sum(value) AS BIGINT) AS "sum"'))
def reduce_sum(spark: SparkSession, d: str) -> DataFrame:
    return reads.reduce_(events_as(spark, d, "evi"), KEY, S, E, ("sum",))


@query(_reduced(sql_events("evi"), what='round(sum(value * ("end" - start)) / sum("end" - start), 4) AS "avg"'))
def reduce_avg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reads.reduce_(events_as(spark, d, "evi"), KEY, S, E, ("avg",)))


@query(_reduced(sql_events("evi"), what='min(value) AS "min"'))
def reduce_min(spark: SparkSession, d: str) -> DataFrame:
    return reads.reduce_(events_as(spark, d, "evi"), KEY, S, E, ("min",))


@query(_reduced(sql_events("evi"), what='max(value) AS "max"'))
def reduce_max(spark: SparkSession, d: str) -> DataFrame:
    return reads.reduce_(events_as(spark, d, "evi"), KEY, S, E, ("max",))


BIG = 4_611_686_018_427_387_904  # 2^62: four of them wrap to zero


@query(f"WITH {sql_pieces(sql_events('evi'))}, t AS (SELECT k, sum(CAST(value + {BIG} AS HUGEINT)) % 18446744073709551616 AS s FROM el GROUP BY k) SELECT k, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS \"sum\" FROM t")
def reduce_sum_int_wrap(spark: SparkSession, d: str) -> DataFrame:
    scope = _scope(spark, d, a="evi")
    return derived.reduce_expr(scope, Binary("+", Ident("a"), Lit(BIG)), S, E, ("sum",))


@query(_reduced(sql_events("ev24", "event_type")))
def reduce_skewed_keys(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reads.reduce_(events_as(spark, d, "ev24", "event_type"), KEY, S, E))


@query(_reduced(sql_events("ev24"), CUT, E))
def reduce_ttl(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reads.reduce_(events_as(spark, d, "ev24"), KEY, S, E, keep_from=CUT))


_TWICE = "SELECT k, layer_id * 2 AS layer_id, written_at, lo, hi, 1.5 AS value FROM ({0}) UNION ALL SELECT k, layer_id * 2 + 1, written_at, lo - {1}, hi + {1}, 1.5 FROM ({0})"


@query(_reduced(_TWICE.format(sql_events("ev6"), HOUR), what='CAST(count(*) AS BIGINT) AS "count", round(sum(CAST(value AS DOUBLE)), 4) AS "sum"'))
def reduce_occluded_boundary(spark: SparkSession, d: str) -> DataFrame:
    """A newer, longer fact hides each older one, whose bounds still split."""
    old = events_as(spark, d, "ev6").withColumn("value", F.lit(1.5))
    new = old.select("k", (F.col("layer_id") * 2 + 1).alias("layer_id"), "written_at", (F.col("lo") - HOUR).alias("lo"), (F.col("hi") + HOUR).alias("hi"), "value")
    both = old.withColumn("layer_id", F.col("layer_id") * 2).unionByName(new)
    return rounded(reads.reduce_(both, KEY, S, E, ("count", "sum")))


_NEAR = 9_223_372_036_854_775_000  # near the greatest long: two of them wrap


@query(f"WITH {sql_pieces(f'SELECT k, layer_id, written_at, lo, hi, {_NEAR} + value AS value FROM ({sql_events(chr(101) + chr(118) + chr(105))})')}, t AS (SELECT k, sum(CAST(value AS HUGEINT)) % 18446744073709551616 AS s FROM el GROUP BY k) SELECT k, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS \"sum\" FROM t")
def reduce_near_the_edge(spark: SparkSession, d: str) -> DataFrame:
    """Sums of stored integers that wrap. A value above 807 wraps as it is stored, too; the addition in the SQL raises there."""
    facts = events_as(spark, d, "evi")
    with wrapping(spark):
        facts = facts.withColumn("value", F.lit(_NEAR).cast("long") + F.col("value"))
        facts.schema  # noqa: B018 - analysed while the session wraps
    return reads.reduce_(facts, KEY, S, E, ("sum",))


_OPEN = f"SELECT k, layer_id, written_at, lo, CASE WHEN layer_id % 10 = 0 THEN 9223372036854775807 ELSE hi END AS hi, value FROM ({sql_events('ev6')})"


def _open(spark: SparkSession, d: str, key: str = "user_id") -> DataFrame:
    """Every tenth fact holds from its begin on, without an end."""
    facts = events_as(spark, d, "ev6", key)
    return facts.withColumn("hi", F.when(F.col("layer_id") % 10 == 0, F.lit((1 << 63) - 1)).otherwise(F.col("hi")))


@query(sql_range(_OPEN, None, None))
def range_open_ended(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(_open(spark, d), KEY, None, None)


@query(_reduced(_OPEN))
def reduce_open_ended(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reads.reduce_(_open(spark, d), KEY, S, E))


PIECE = 300  # rows of a piece, so that the series of these queries are cut at every scale
_OPEN_TYPES = _OPEN.replace("user_id AS k", "event_type AS k")


@query(sql_range(_OPEN_TYPES))
def range_cut_series(spark: SparkSession, d: str) -> DataFrame:
    """Long series with facts that never end, cut into pieces."""
    return reads.range_(_open(spark, d, "event_type"), KEY, S, E, piece=PIECE)


@query(_reduced(_OPEN_TYPES))
def reduce_cut_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reads.reduce_(_open(spark, d, "event_type"), KEY, S, E, piece=PIECE))


@query(f"WITH f AS ({_OPEN_TYPES}), p AS (SELECT DISTINCT 'click' AS k, {T0} + (o_orderkey % 720) * {HOUR} AS t FROM orders) SELECT p.k, p.t, arg_max_null(value, layer_id) AS value FROM p JOIN f ON p.k = f.k AND lo <= t AND t < hi GROUP BY ALL")
def at_points_cut_series(spark: SparkSession, d: str) -> DataFrame:
    points = spark.read.parquet(f"{d}/orders.parquet").select(F.lit("click").alias("k"), (T0 + (F.col("o_orderkey") % 720) * HOUR).alias("t"))
    return reads.at_points(_open(spark, d, "event_type"), points, KEY, piece=PIECE)


# History

_LAYERS = "SELECT k, layer_id // 10 AS layer_id, layer_id // 1000 AS written_at, lo, hi, value FROM ({0})"


def _layers(spark: SparkSession, d: str) -> DataFrame:
    facts = events_as(spark, d, "ev24")
    return facts.withColumn("written_at", F.expr("layer_id div 1000")).withColumn("layer_id", F.expr("layer_id div 10"))


_HISTORY = f"SELECT layer_id AS id, written_at, min(lo) AS min_start, max(hi) AS max_end, count(*) AS tau_count FROM ({_LAYERS.format(sql_events('ev24'))}) GROUP BY ALL"


@query(_HISTORY)
def history_all(spark: SparkSession, d: str) -> DataFrame:
    return reads.history(_layers(spark, d), [])


@query(f"{_HISTORY} HAVING max(hi) > {MID} AND min(lo) < {MID + HOUR}")
def history_overlap(spark: SparkSession, d: str) -> DataFrame:
    return reads.history(_layers(spark, d), [], MID, MID + HOUR)


@query("""WITH f AS (SELECT lens, layer_id AS id, written_at, lo, hi FROM facts)
SELECT lens, id, written_at, min(lo) AS min_start, max(hi) AS max_end, count(*) AS tau_count FROM f GROUP BY ALL""")
def history_of_lenses(spark: SparkSession, d: str) -> DataFrame:
    return reads.history(spark.read.parquet(f"{d}/facts.parquet"), ["lens"])


# Derived lenses


def _lazy(spark: SparkSession, d: str, e, **names: str) -> DataFrame:
    scope = _scope(spark, d, **names)
    scope.lenses["out"] = Lazy(e)
    return derived.range_expr(scope, Ident("out"), S, E)


@query(_ranged({"a": "ev24"}, "round(a * 9.0 / 5.0 + 32.0, 6)").replace("round(a * 9.0 / 5.0 + 32.0, 6)", "CAST(a AS DOUBLE) * CAST(9.0 AS DOUBLE) / CAST(5.0 AS DOUBLE) + CAST(32.0 AS DOUBLE)"))
def derive_arith(spark: SparkSession, d: str) -> DataFrame:
    return _lazy(spark, d, Binary("+", Binary("/", Binary("*", Ident("a"), Lit(9.0)), Lit(5.0)), Lit(32.0)), a="ev24")


@query(_ranged({"a": "evi"}, "a * 2 + 1"))
def derive_chain(spark: SparkSession, d: str) -> DataFrame:
    scope = _scope(spark, d, a="evi")
    scope.lenses |= {"y": Lazy(Binary("*", Ident("a"), Lit(2))), "z": Lazy(Binary("+", Ident("y"), Lit(1)))}
    return derived.range_expr(scope, Ident("z"), S, E)


@query(_ranged({"a": "evb", "b": "ev6"}, "(a AND b > 20) OR NOT a"))
def derive_bool(spark: SparkSession, d: str) -> DataFrame:
    return _lazy(spark, d, Binary("||", Binary("&&", Ident("a"), Binary(">", Ident("b"), Lit(20))), Unary("!", Ident("a"))), a="evb", b="ev6")


@query(_ranged({"a": "evn"}, "a IS NULL"))
def derive_null_eq(spark: SparkSession, d: str) -> DataFrame:
    return _lazy(spark, d, Binary("==", Ident("a"), Lit(None)), a="evn")


@query(_ranged({"a": "evi", "b": "ev6"}, "CAST(a AS DOUBLE) + b"))
def derive_two_lens_align(spark: SparkSession, d: str) -> DataFrame:
    return _lazy(spark, d, Binary("+", Ident("a"), Ident("b")), a="evi", b="ev6")


@query(_ranged({"a": "evs"}, "a = 'click'"))
def derive_text_eq(spark: SparkSession, d: str) -> DataFrame:
    return _lazy(spark, d, Binary("==", Ident("a"), Lit("click")), a="evs")


@query(f"WITH {sql_aligned({'a': sql_events('evi')}, 'a * 2', 'true', S, T)}, {sql_merge('el')} SELECT k, start, \"end\", value FROM mg")
def derive_over(spark: SparkSession, d: str) -> DataFrame:
    scope = _scope(spark, d, a="evi")
    scope.lenses["out"] = Lazy(Binary("*", Ident("a"), Lit(2)), (0, T))
    return derived.range_expr(scope, Ident("out"), S, E)


@query(f"SELECT CAST({S} AS BIGINT) AS start, CAST({E} AS BIGINT) AS \"end\", CAST(7 AS BIGINT) AS value")
def derive_literal(spark: SparkSession, d: str) -> DataFrame:
    return derived.range_expr(Scope({"out": Lazy(Lit(7))}, []), Ident("out"), S, E)


@query(_ranged({"a": "evi"}, "(a - 100) // 7 * 10 + (a - 100) % 7"))
def derive_int_div_mod(spark: SparkSession, d: str) -> DataFrame:
    x = Binary("-", Ident("a"), Lit(100))
    return _lazy(spark, d, Binary("+", Binary("*", Binary("/", x, Lit(7)), Lit(10)), Binary("%", x, Lit(7))), a="evi")


@query(_ranged({"a": "evi", "b": "evb"}, "(-a < -50) = (NOT b)").replace("(-a < -50) = (NOT b)", "(-a < -50) = (NOT b)"))
def derive_neg_not(spark: SparkSession, d: str) -> DataFrame:
    return _lazy(spark, d, Binary("==", Binary("<", Unary("-", Ident("a")), Lit(-50)), Unary("!", Ident("b"))), a="evi", b="evb")


HUGE = 9_007_199_254_740_992  # 2^53: its successor is equal to it as a double


@query(_ranged({"a": "evi"}, f"CAST(a - a + {HUGE} AS DOUBLE) = CAST({HUGE + 1} AS DOUBLE)"))
def derive_f64_equality(spark: SparkSession, d: str) -> DataFrame:
    return _lazy(spark, d, Binary("==", Binary("+", Binary("-", Ident("a"), Ident("a")), Lit(HUGE)), Lit(HUGE + 1)), a="evi")


# Rolling aggregates


def _rolled(f: str, begin: int, end: int, name: str = "ev6", facts: str | None = None, what: str | None = None, target: bool = False) -> str:
    """CTEs ending in el: the aggregate of [t + begin, t + end) on each segment (k, start, end, value)."""
    facts = facts or sql_events(name)
    agg = what or {
        "avg": "sum(value * span) / sum(span)", "sum": "sum(value)", "count": "CAST(count(*) AS BIGINT)", "min": "min(value)", "max": "max(value)",
    }[f]
    shifted = [f"SELECT k, lo - ({x}) AS p FROM ({facts}) UNION SELECT k, hi - ({x}) FROM ({facts})" for x in (begin, end)]
    return f"""{sql_pieces(facts, S + begin, E + end, 'w')},
pts AS ({' UNION '.join(shifted + ([f'SELECT k, lo AS p FROM ({facts}) UNION SELECT k, hi FROM ({facts})'] if target else []))}),
cut AS (SELECT k, p FROM pts WHERE p > {S} AND p < {E} UNION SELECT k, {S} FROM pts UNION SELECT k, {E} FROM pts),
g AS (SELECT * FROM (SELECT k, p AS start, lead(p) OVER (PARTITION BY k ORDER BY p) AS "end" FROM cut) WHERE "end" IS NOT NULL),
pairs AS (SELECT g.k, g.start, g."end", w.value, CAST(least(w."end", g.start + ({end})) - greatest(w.start, g.start + ({begin})) AS DOUBLE) AS span
  FROM g JOIN wel w ON g.k = w.k AND w.start < g.start + ({end}) AND w."end" > g.start + ({begin})),
el AS (SELECT k, start, "end", {agg} AS value FROM pairs GROUP BY k, start, "end")"""


def _unmerged(ctes: str, digits: int | None = 4) -> str:
    return f'WITH {ctes} SELECT k, start, "end", {f"round(value, {digits})" if digits else "value"} AS value FROM el'


def _roll(spark: SparkSession, d: str, f: str, begin: int, end: int, name: str = "ev6") -> DataFrame:
    out = derived.evaluate(_scope(spark, d, a=name), Rolling(f, "a", begin, end), S, E)
    return out.withColumn("value", F.round("value", 4)) if dict(out.dtypes)["value"] == "double" else out


BACK = -12 * HOUR


@query(_unmerged(_rolled("avg", BACK, 0)))
def rolling_avg(spark: SparkSession, d: str) -> DataFrame:
    return _roll(spark, d, "avg", BACK, 0)


@query(_unmerged(_rolled("min", BACK, 0)))
def rolling_min(spark: SparkSession, d: str) -> DataFrame:
    return _roll(spark, d, "min", BACK, 0)


@query(_unmerged(_rolled("max", BACK, 0)))
def rolling_max(spark: SparkSession, d: str) -> DataFrame:
    return _roll(spark, d, "max", BACK, 0)


@query(_unmerged(_rolled("sum", BACK, 0)))
def rolling_sum(spark: SparkSession, d: str) -> DataFrame:
    return _roll(spark, d, "sum", BACK, 0)


@query(_unmerged(_rolled("count", BACK, 0), None))
def rolling_count(spark: SparkSession, d: str) -> DataFrame:
    return _roll(spark, d, "count", BACK, 0)


@query(_unmerged(_rolled("avg", HOUR, 8 * HOUR)))
def rolling_forward(spark: SparkSession, d: str) -> DataFrame:
    return _roll(spark, d, "avg", HOUR, 8 * HOUR)


_VS = f"""{_rolled('avg', BACK, 0, target=True)},
here AS (SELECT g.k, g.start, arg_max_null(c.value, c.layer_id) AS a FROM g JOIN ({sql_events('ev6')}) c ON g.k = c.k AND c.lo <= g.start AND g.start < c.hi GROUP BY ALL)"""


@query(f'WITH {_VS} SELECT k, start, "end", a > value AS value FROM el JOIN here USING (k, start)')
def rolling_in_comparison(spark: SparkSession, d: str) -> DataFrame:
    return derived.evaluate(_scope(spark, d, a="ev6"), Binary(">", Ident("a"), Rolling("avg", "a", BACK, 0)), S, E)


@query(f'WITH {_VS}, hit AS (SELECT k, start, "end", a AS value FROM el JOIN here USING (k, start) WHERE a > value), {sql_merge("hit")} SELECT k, start, "end", value FROM mg')
def range_where_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _where(_scope(spark, d, a="ev6"), Binary(">", Ident("a"), Rolling("avg", "a", BACK, 0)))


@query(f"WITH {sql_aligned({'a': sql_events('evi'), 'b': sql_events('ev6')}, 'CAST(a AS DOUBLE) - b')} SELECT k, {NUMBERS} FROM el GROUP BY k")
def reduce_derived(spark: SparkSession, d: str) -> DataFrame:
    return rounded(derived.reduce_expr(_scope(spark, d, a="evi", b="ev6"), Binary("-", Ident("a"), Ident("b")), S, E)).withColumns({})


@query(f"WITH {_rolled('max', BACK, 0)} SELECT k, {NUMBERS} FROM el GROUP BY k")
def reduce_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(derived.reduce_expr(_scope(spark, d, a="ev6"), Rolling("max", "a", BACK, 0), S, E))


@query(_unmerged(_rolled("avg", BACK, 0, facts=sql_events("ev6", "event_type"))))
def rolling_cut_series(spark: SparkSession, d: str) -> DataFrame:
    scope = Scope({"a": Base(events_as(spark, d, "ev6", "event_type"))}, KEY, PIECE)
    return derived.evaluate(scope, Rolling("avg", "a", BACK, 0), S, E).withColumn("value", F.round("value", 4))


@query(_ranged({"a": "evi", "b": "ev6"}, "CAST(a AS DOUBLE) + b").replace("user_id AS k", "event_type AS k"))
def derive_cut_series(spark: SparkSession, d: str) -> DataFrame:
    scope = Scope({n: Base(events_as(spark, d, f, "event_type")) for n, f in (("a", "evi"), ("b", "ev6"))}, KEY, PIECE)
    return derived.range_expr(scope, Binary("+", Ident("a"), Ident("b")), S, E)


# Maintenance

_GENERATIONS = f"SELECT k, layer_id, layer_id // 500 AS written_at, lo, hi, value FROM ({sql_events('evb')})"


def _generations(spark: SparkSession, d: str) -> DataFrame:
    return events_as(spark, d, "evb").withColumn("written_at", F.expr("layer_id div 500"))


@query(sql_range(_GENERATIONS))
def compact_1d_preserves_range(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(cut_lineage(compaction.compact(_generations(spark, d), KEY)), KEY, S, E)


@query(sql_range(f"SELECT * FROM ({_GENERATIONS}) WHERE written_at <= 9"))
def compact_1d_preserves_as_of(spark: SparkSession, d: str) -> DataFrame:
    return reads.range_(cut_lineage(compaction.compact(_generations(spark, d), KEY)), KEY, S, E, written=9)


@query(f"SELECT arg_max_null(value, layer_id) AS value FROM ({SQL_GRID}) WHERE {_box(T, 7)} HAVING count(*) > 0")
def compact_nd_preserves_at(spark: SparkSession, d: str) -> DataFrame:
    return reads.at(compaction.compact_boxes(grid(spark, d), []), [], T, [7])


def _fixed(x: int) -> str:
    return f"WITH {sql_pieces(f'SELECT * FROM ({SQL_GRID}) WHERE x0 <= {x} AND x1 > {x}')}, {sql_merge('el')} SELECT {x} AS x, start, \"end\", value FROM mg"


@query(" UNION ALL ".join(f"SELECT * FROM ({_fixed(x)})" for x in (3, 7, 50, 101)))
def compact_nd_preserves_range(spark: SparkSession, d: str) -> DataFrame:
    """Boxes along time and users, compacted and read at four users over all time."""
    small = cut_lineage(compaction.compact_boxes(grid(spark, d), []))
    found = [reads.range_(small, [], S, E, coordinates=[x]).withColumn("x", F.lit(x)) for x in (3, 7, 50, 101)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
