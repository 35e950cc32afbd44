import random

import numpy as np

from tests.conftest import rows

from tests import oracle
from epochal.functions.expressions import Binary, Ident, Lit, Rolling
from epochal.operators import appends, compaction, derived, reads, sweep
from epochal.operators.derived import Base, Lazy, Scope
from epochal.operators.segments import elementary

SCHEMA = "k int, layer_id long, written_at long, lo long, hi long, value long"
CASES = {k: oracle.stack(random.Random(k)) for k in range(12)}


def facts(spark):
    return spark.createDataFrame([(k, *f) for k, fs in CASES.items() for f in fs], SCHEMA)


def by_key(df, *columns):
    out = {k: [] for k in CASES}
    for r in rows(df, "k", *columns):
        out[r[0]].append(r[1:])
    return {k: sorted(v, key=lambda r: r[0]) for k, v in out.items()}


def test_range_is_brute_force(spark):
    for piece in (None, 5, 40):
        got = by_key(reads.range_(facts(spark), ["k"], 10, 150, piece=piece), "start", "end", "value")
        assert got == {k: oracle.merge(oracle.segments(f, 10, 150)) for k, f in CASES.items()}


def test_unkeyed_range(spark):
    one = facts(spark).where("k = 3").drop("k")
    assert rows(reads.range_(one, [], 0, 500, piece=7)) == oracle.merge(oracle.segments(CASES[3], 0, 500))


def test_as_of_and_points(spark):
    got = by_key(reads.range_(facts(spark), ["k"], 0, 300, written=2), "start", "end", "value")
    assert got == {k: oracle.merge(oracle.segments(f, 0, 300, 2)) for k, f in CASES.items()}
    points = spark.createDataFrame([(k, t, w) for k in CASES for t in range(0, 200, 7) for w in (0, 3)], "k int, t long, w long")
    got = {r[:3]: r[3] for r in rows(reads.at_points(facts(spark), points, ["k"], "w"), "k", "t", "w", "value")}
    want = {(k, t, w): oracle.at(f, t, w)[1] for k, f in CASES.items() for t in range(0, 200, 7) for w in (0, 3) if oracle.at(f, t, w)[0]}
    assert got == want


def test_reduce_counts_every_boundary(spark):
    held = facts(spark).where("value is not null")
    cases = {k: [f for f in fs if f[4] is not None] for k, fs in CASES.items()}
    got = {r["k"]: r for r in reads.reduce_(held, ["k"], 5, 120, piece=6).collect()}
    for k, fs in cases.items():
        found = oracle.segments(fs, 5, 120)
        if not found:
            assert k not in got
            continue
        values = [v for *_, v in found]
        weight = sum(v * (b - a) for a, b, v in found) / sum(b - a for a, b, _ in found)
        r = got[k]
        assert (r["count"], r["sum"], r["min"], r["max"]) == (len(found), sum(values), min(values), max(values))
        assert abs(r["avg"] - weight) < 1e-9


def test_values_past_the_greatest_long_wrap(spark, tmp_path):
    """One event of 900, which no long holds once it is added to; its user's sum is what exact integers give, modulo 2^64."""
    from datetime import datetime, timedelta

    from epochal.plans.queries import reference
    from epochal.plans.queries.facts import HOUR, T0

    events = [(1, 0, 900.5), (1, 5, 3.25), (1, 40, 807.0), (2, 1, 808.0), (3, 2, 12.0), (3, 9, 560.21)]  # user, hours, value
    held = [(i, datetime(2024, 1, 1) + timedelta(hours=h), u, "click", v, None) for i, (u, h, v) in enumerate(events)]
    spark.createDataFrame(held, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    want = []
    for user in (1, 2, 3):
        own = [(i, 0, T0 + h * HOUR, T0 + (h + 24) * HOUR, reference._NEAR + int(v)) for i, (u, h, v) in enumerate(events) if u == user]
        total = sum(v for *_, v in oracle.segments(own, reference.S, reference.E))
        want.append((user, (total + (1 << 63)) % (1 << 64) - (1 << 63)))
    assert rows(reference.reduce_near_the_edge(spark, str(tmp_path)), "k", "sum") == want


def test_elementary_marks_cuts(spark):
    held = [(1, 0, 100, 5)] + [(2, 10 * i, 10 * i + 10, i) for i in range(20)]
    one = spark.createDataFrame(held, "layer_id long, lo long, hi long, value long")
    for piece in (None, 4, 9):
        found = elementary(one, [], piece=piece).orderBy("start").collect()
        assert [r.start for r in found if r.split] == [10 * i for i in range(20)]
        assert all(a.end == b.start for a, b in zip(found, found[1:])) and found[-1].end == 200


def test_open_facts_and_points(spark):
    """Facts that never end, in a series that is cut."""
    rng = random.Random(4)
    held = [(i, 0, lo, (1 << 63) - 1 if i % 9 == 0 else lo + rng.randint(1, 40), i) for i in range(300) for lo in [rng.randint(0, 2000)]]
    df = spark.createDataFrame(held, SCHEMA.removeprefix("k int, "))
    want = oracle.merge(oracle.segments(held, 0, 3000))
    for piece in (None, 20, 150):
        assert rows(reads.range_(df, [], 0, 3000, piece=piece)) == want
        points = spark.createDataFrame([(t,) for t in range(0, 2500, 13)] * 2, "t long")
        got = dict(rows(reads.at_points(df, points, [], piece=piece)))
        assert got == {t: oracle.at(held, t)[1] for t in range(0, 2500, 13) if oracle.at(held, t)[0]}


def test_overlaps_of_a_layer(spark):
    held = [("a", 1, 0, 10), ("a", 1, 10, 20), ("a", 2, 0, 10), ("b", 1, 0, 1000), ("b", 1, 5, 6)] + [("c", 1, i, i + 1) for i in range(50)] + [("d", 1, i, i + 2) for i in range(50)]
    df = spark.createDataFrame(held, "k string, layer_id long, lo long, hi long")
    for piece in (None, 10):
        assert {tuple(r) for r in appends.overlapping(df, ["k"], piece).select("k", "layer_id").distinct().collect()} == {("b", 1), ("d", 1)}


def test_sums_over_runs():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, 300)
    a = rng.integers(0, 300, 500)
    b = np.minimum(300, a + rng.integers(0, 90, 500))
    assert list(sweep.range_sum(x, a, b)) == [int(x[i:j].sum()) for i, j in zip(a, b)]
    some = b > a
    assert list(sweep.range_best(x, a[some], b[some])) == [int(x[i:j].max()) for i, j in zip(a[some], b[some])]
    painted = sweep.paint(300, a[some], b[some], np.arange(some.sum()))
    want = [-1] * 300
    for k, (i, j) in enumerate(zip(a[some], b[some])):
        want[i:j] = [k] * (j - i)
    assert list(painted) == want


def test_compaction_preserves_reads(spark):
    small = compaction.compact(facts(spark), ["k"])
    assert small.count() < facts(spark).count()
    for written in (None, 1):
        a = reads.range_(small, ["k"], 0, 400, written=written)
        b = reads.range_(facts(spark), ["k"], 0, 400, written=written)
        assert rows(a) == rows(b)


def test_boxes_compaction(spark):
    rng = random.Random(5)
    boxes = []
    for layer in range(6):
        for _ in range(3):
            x, y = rng.randint(0, 8), rng.randint(0, 8)
            boxes.append((layer, layer // 2, x, x + rng.randint(1, 6), [(y, y + rng.randint(1, 6))], rng.randint(0, 3)))
    df = spark.createDataFrame(boxes, "layer_id long, written_at long, lo long, hi long, axes array<struct<lo:long,hi:long>>, value long")
    # boxes of one layer may not overlap: keep the first of those that do
    clean = df.collect()
    kept = []
    for r in clean:
        if not any(o.layer_id == r.layer_id and o.lo < r.hi and r.lo < o.hi and o.axes[0].lo < r.axes[0].hi and r.axes[0].lo < o.axes[0].hi for o in kept):
            kept.append(r)
    df = spark.createDataFrame(kept, df.schema)
    whole = compaction.compact_boxes(df, []).collect()

    def at(held, x, y, w):
        c = [r for r in held if r.lo <= x < r.hi and r.axes[0].lo <= y < r.axes[0].hi and r.written_at <= w]
        return max(c, key=lambda r: r.layer_id).value if c else None

    for x in range(15):
        for y in range(15):
            for w in range(3):
                assert at(whole, x, y, w) == at(kept, x, y, w)


def test_empty_and_void(spark):
    none = facts(spark).where("false")
    assert rows(reads.range_(none, ["k"], 0, 10)) == [] and rows(reads.reduce_(none, ["k"], 0, 10)) == []
    assert rows(reads.at(none.drop("k"), [], 3)) == []
    bad = spark.createDataFrame([(1, 5, 5, 1), (2, 9, 3, 1), (3, None, 4, 1), (4, 1, None, 1)], "layer_id long, lo long, hi long, value long")
    assert rows(reads.range_(bad, [], 0, 10)) == []


def test_null_keys_form_a_series(spark):
    df = spark.createDataFrame([(None, 1, 0, 10, 1), (None, 2, 5, 15, 2), ("a", 1, 0, 4, 7)], "k string, layer_id long, lo long, hi long, value long")
    assert rows(reads.range_(df, ["k"], 0, 20, piece=1)) == [("a", 0, 4, 7), (None, 0, 5, 1), (None, 5, 15, 2)]


def scans(df):
    """What each scan of the plan is told to leave out."""
    import re

    return re.findall(r"PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def test_bounds_of_a_read_reach_every_scan(spark, stored):
    a = stored([(k, *f) for k, fs in CASES.items() for f in fs], SCHEMA)
    b = stored([(k, *f) for k, fs in CASES.items() for f in fs], SCHEMA, files=2)
    scope = Scope({"a": Base(a), "b": Base(b), "y": Lazy(Binary("+", Ident("a"), Ident("b")))}, ["k"])
    plain = Ident("y")
    rolled = Binary("+", Ident("b"), Rolling("sum", "a", -20, 5))
    over_lazy = Rolling("max", "y", -20, 5)
    for df, lo, hi in (
        (derived.range_expr(scope, plain, 50, 90), 90, 50),
        (derived.range_expr(scope, Ident("a"), 50, 90, Binary(">", Ident("b"), Lit(0))), 90, 50),
        (derived.reduce_expr(scope, plain, 50, 90, ("count",)), 90, 50),
        (derived.at_expr(scope, plain, 77), 78, 77),
        (derived.evaluate(scope, over_lazy, 50, 90), 95, 30),
        (reads.range_(a, ["k"], 50, 90), 90, 50),
        (reads.at(a, ["k"], 77), None, None),
    ):
        found = scans(df)
        assert found and all("hi" in f and "lo" in f for f in found)
        if lo is not None:
            assert all(f"LessThan(lo,{lo})" in f and f"GreaterThan(hi,{hi})" in f for f in found), found
    found = scans(derived.range_expr(scope, rolled, 50, 90))
    assert len(found) == 2 and any("LessThan(lo,95)" in f and "GreaterThan(hi,30)" in f for f in found) and any("LessThan(lo,90)" in f and "GreaterThan(hi,50)" in f for f in found)


def test_rolling_is_brute_force(spark):
    """Pieces or none; a window over segments of every kind of series."""
    held = [(k, *f[:4], None if f[4] is None else float(f[4])) for k, fs in CASES.items() for f in fs if f[4] is not None]
    df = spark.createDataFrame(held, SCHEMA.replace("value long", "value double"))
    for piece in (None, 9):
        for function in ("count", "sum", "avg", "min", "max"):
            got = derived.evaluate(Scope({"a": Base(df)}, ["k"], piece), Rolling(function, "a", -13, 4), 20, 120).collect()
            for r in got:
                parts = [(max(s, r.start - 13), min(e, r.start + 4), v) for s, e, v in oracle.segments([f for f in CASES[r.k] if f[4] is not None], 7, 124) if s < r.start + 4 and e > r.start - 13]
                values = [v for *_, v in parts]
                weight = sum(e - s for s, e, _ in parts)
                want = {"count": len(values), "sum": sum(values), "min": min(values), "max": max(values), "avg": sum(v * (e - s) for s, e, v in parts) / weight}[function]
                assert abs(r.value - want) < 1e-9
            assert len(got) > 200


def test_clashing_boxes(spark):
    rng = random.Random(7)
    held = []
    for layer in range(6):
        cells = [(x, y) for x in range(12) for y in range(12)]
        held += [(layer, 10 * x, 10 * x + 10, [(10 * y, 10 * y + 10)], 1) for x, y in rng.sample(cells, 60)]  # side by side
        if layer % 2:
            _, lo, hi, axes, _ = rng.choice([h for h in held if h[0] == layer])
            held.append((layer, lo + 3, hi + 3, [(axes[0][0] + 9, axes[0][0] + 12)], 1))
    held += [(9, 0, 1, [(i, i + 1)], 1) for i in range(300)]  # all at one time
    df = spark.createDataFrame(held, "layer_id long, lo long, hi long, axes array<struct<lo:long,hi:long>>, value int")
    for piece in (None, 20):
        assert {r.layer_id for r in appends.colliding_boxes(df, [], piece).collect()} == {1, 3, 5}
