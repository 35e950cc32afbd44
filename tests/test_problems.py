"""The operators of the general problems: edge cases with defined results, and brute force."""

import random

import pytest
from tests.conftest import rows

from epochal.operators import changes, intervals, late, once, regrid, trailing
from epochal.streaming.ingest import CounterLog

TAUS = "array<struct<lo:long,hi:long,value:double>>"
WAL = f"delivery_id long, batch_id long, db string, layer_id long, lens string, written_at long, taus {TAUS}, `_metadata_note` string"
DAY = 86_400


def delivery(i, batch, db, layer, lens="a", written=None, taus=(), note=None):
    return (i, batch, db, layer, lens, written, list(taus), note)


# Problem 1


@pytest.mark.parametrize("limit", [1 << 26, 0])  # broadcast vectors, vectors read from the shared folder
@pytest.mark.parametrize("files", [1, 5])
def test_once(stored, limit, files):
    rng = random.Random(files)
    data = [delivery(i, rng.randint(1, 5), rng.choice("xy"), rng.randint(0, 40), note=f"n{i}") for i in range(300)]
    data += [delivery(1000 + i, 1, "hot", 7) for i in range(200)]  # one message with a third of all copies
    data += [delivery(2000, 1, None, 3), delivery(2001, 1, None, 3), delivery(2002, 1, "x", None)]  # unknown: all stay
    data += [delivery(3000, None, "n", 1), delivery(3001, 9, "n", 1), delivery(3002, None, "n", 2), delivery(3002, None, "n", 2)]
    df = stored(data, WAL, files)
    best = {}
    for i, batch, db, layer, *_ in data:
        if db is not None and layer is not None:
            key, rank = (db, layer), (batch is None, batch or 0, i)
            best[key] = min(best.get(key, rank), rank)
    kept = once.once(df, ["db", "layer_id"], ["batch_id", "delivery_id"], limit=limit)
    assert kept.columns == df.columns
    ids = [r[0] for r in rows(kept, "delivery_id")]
    assert ids == sorted([r[2] for r in best.values()] + [2000, 2001, 2002])
    assert {r[0] for r in rows(kept, "_metadata_note") if r[0]} <= {f"n{i}" for i in range(300)}
    gone = [r[0] for r in rows(once.once(df, ["db", "layer_id"], ["batch_id", "delivery_id"], True, limit), "delivery_id")]
    assert sorted(ids + gone) == sorted(d[0] for d in data)


def test_once_many_containers(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.range(0, 100_000, 1, 1).selectExpr("id as delivery_id", "id div 70000 as batch_id", "'d' as db", "id % 70000 as layer_id").write.parquet(path)
    kept = once.once(spark.read.parquet(path), ["db", "layer_id"], ["batch_id", "delivery_id"])
    assert kept.count() == 70_000 and kept.agg({"delivery_id": "max"}).head()[0] == 69_999


def test_once_empty(stored):
    assert rows(once.once(stored([], WAL), ["db", "layer_id"], ["batch_id"])) == []


# Problem 2


def test_late_counters(stored, spark, tmp_path):
    day = 16_440
    b, end = day * DAY, (day + 1) * DAY * 1000
    data = [
        delivery(1, 1, "d", 1, "A ", end - 1, [(b + 10, b + 20, 1.0)]),
        delivery(2, 1, "d", 2, "a", end, [(b + 10, b + 20, 2.0), (b + DAY, b + DAY + 1, 4.0)]),
        delivery(3, 1, "d", 3, "a", end + 3 * DAY * 1000 - 1, [(b + 10, b + 20, None)]),
        delivery(4, 1, "d", 4, "a", end + 3 * DAY * 1000, [(b + 10, b + 20, 8.0)]),
        delivery(5, 1, "d", 5, "a", None, [(b + 10, b + 20, 16.0)]),
        delivery(6, 2, "d", 1, "a", end + 5, [(b + 10, b + 20, 99.0)]),  # a later copy never counts
        delivery(7, 1, "d", 6, "b", end // 1000, [(b, b + 100, 1.0)]),  # a stamp in seconds
        delivery(8, 1, "d", 7, "c", end, []),
        delivery(9, 1, "d", 8, None, end, [(-5, 3, 1.0)]),  # before 1970
        delivery(10, 1, "d", 9, "c", end, [(None, 3, 1.0)]),
    ]
    want = [
        ("d", "a", day, 1, 2, 1, 1, 19.0, 1.0),
        ("d", "a", day + 1, 1, 0, 0, 0, 4.0, 4.0),
        ("d", "b", day, 0, 1, 0, 0, 1.0, 0.0),
        ("d", None, -1, 0, 0, 1, 0, 0.0, 0.0),
    ]
    cols = ["db", "lens", "day", "on_time", "late", "too_late", "undated", "total", "total_on_time"]
    assert rows(late.corrected_daily(stored(data, WAL, 3)), *cols) == want
    log = CounterLog(spark, str(tmp_path / "log"))  # retried and reordered batches
    frame = spark.createDataFrame(data, WAL)
    log.put(frame.where("batch_id = 2"), 2)
    log.put(frame.where("batch_id = 1"), 1)
    log.put(frame.where("batch_id = 1"), 1)
    log.put(frame, 3)
    assert rows(log.totals(), *cols) == want


def test_late_slots_are_merged(spark, monkeypatch):
    day = 16_440
    b, end = day * DAY, (day + 1) * DAY * 1000
    first = delivery(1, 1, "d", 1, "a", end, [(b + 10, b + 20, 2.0), (b + 20, b + 30, 1.0)])
    again = delivery(2, 1, "d", 1, "a", end, [(b + 10, b + 20, 99.0), (b + DAY, b + DAY + 1, 7.0)])
    merged = []
    own = late.merge
    monkeypatch.setattr(late, "merge", lambda held: merged.append(held) or own(held))
    got = late.corrected_daily(spark.createDataFrame([again, first, first], WAL))
    assert rows(got) == [("d", "a", day, 0, 2, 0, 0, 3.0, 0.0)]
    assert [held.count() for held in merged] == [4]  # slots of every delivery, copies included


@pytest.mark.parametrize("nothing", [None, [], [(None, 3, 1.0)]])
def test_late_copy_of_an_empty_delivery(spark, tmp_path, nothing):
    held = spark.createDataFrame([(1, 1, "d", 1, "a", None, nothing, None), delivery(2, 2, "d", 1, "a", None, [(5, 6, 9.0)])], WAL)
    assert rows(late.corrected_daily(held)) == []
    log = CounterLog(spark, str(tmp_path / "log"))
    log.put(held, 1)
    assert rows(log.totals()) == []


# Problem 3


def test_trailing(spark):
    rng = random.Random(3)
    data = [(lens, rng.choice([None, 1, 2, 3]), 0, rng.randint(-5 * DAY, 80 * DAY) + rng.choice([0, 1980 * DAY if lens == "a" else 0]), 0, rng.choice([None, -2.5, 0.25, 7.0])) for lens in ("a", "b", None) for _ in range(60)]
    data += data[:20]
    df = spark.createDataFrame(data, "lens string, layer_id long, written_at long, lo long, hi long, value double")
    best = {}
    for lens, layer, _, lo, _, v in data:
        rank = (-1 if layer is None else layer, v is not None, v or 0)
        if (lens, lo) not in best or rank > best[lens, lo][0]:
            best[lens, lo] = (rank, v)
    days = {}
    for (lens, lo), (_, v) in best.items():
        days.setdefault(lens, {}).setdefault(lo // DAY, []).append(v)
    want = {}
    for lens, held in days.items():
        for day in range(min(held), max(held) + 1):
            for w in (1, 7, 30, 365):
                own = [v for x in range(day - w + 1, day + 1) for v in held.get(x, []) if v is not None]
                want[lens, day, w] = (sum(own), len(own))
    got = trailing.trailing_of_facts(df, [1, 7, 30, 365]).collect()
    assert len(got) * 4 == len(want)
    for r in got:
        assert r.active == len(days[r.lens].get(r.day, []))
        for w in (1, 7, 30, 365):
            assert (r[f"total_{w}"], r[f"values_{w}"]) == want[r.lens, r.day, w]
            assert abs(r[f"average_{w}"] - want[r.lens, r.day, w][0] / w) < 1e-12


def test_trailing_void(spark):
    df = spark.createDataFrame([("a", 1, None, 1.0)], "lens string, layer_id long, lo long, value double")
    assert rows(trailing.trailing_of_facts(df, [7])) == [] and rows(trailing.trailing_of_facts(df.where("false"), [7])) == []


# Problem 4

ND = "lens string, layer_id long, written_at long, lo long, hi long, axes array<struct<lo:long,hi:long>>, value double, step_secs string"


def test_regular_series(spark):
    rng = random.Random(4)
    data = []
    for lens in ("a", "b"):
        for device in range(5):
            for k in range(60):
                if rng.random() < 0.7:
                    lo = 1000 + k * 10 + rng.randint(0, 3)
                    data.append((lens, rng.randint(0, 9), 0, lo, lo + rng.randint(5, 14), [(device, device + rng.randint(1, 2))], float(device + k % 6)))
    data += [("a", 50, 0, 1200, 1260, [(2, 3)], None), ("a", 1, 0, 1500, 1500, [(0, 1)], 1.0), ("a", 1, 0, None, 9, [(0, 1)], 1.0), ("a", 1, 0, 5, 9, None, 1.0), ("a", 1, 0, 5, 9, [(4, 4)], 1.0), ("nostep", 1, 0, 0, 99, [(0, 1)], 1.0), ("b", 1, 0, 1005, 1012, [(77, 78)], 3.0), ("b", 1, 0, 1805, 1812, [(77, 78)], 3.0), (None, 1, 0, 0, 99, [(0, 1)], 1.0)]
    df = spark.createDataFrame([(*r, "clash") for r in data + data[:50]], ND)
    catalog = spark.createDataFrame([("a", 10), ("a", 10), ("b", 20), ("b", None), ("nostep", None), ("nostep", 0)], "lens string, step_secs long")
    steps = {"a": 10, "b": 20}
    facts = [(lens, d, layer, lo, hi, v) for lens, layer, _, lo, hi, axes, v in data if lens in steps and lo is not None and lo < hi and axes for d in range(*axes[0])]
    got = {(r.lens, r.device, r.t): (r.status, r.value) for r in regrid.regular_series(df, catalog).collect()}
    want = {}
    for lens, d in {f[:2] for f in facts}:
        own = [f for f in facts if f[:2] == (lens, d)]
        step = steps[lens]
        for t in range(-(-min(f[3] for f in own) // step) * step, max(f[4] for f in own), step):
            cover = [f for f in own if f[3] <= t < f[4]]
            want[lens, d, t] = max(((f[2], f[5] is not None, f[5] or 0) for f in cover)) if cover else None
    assert got.keys() == want.keys()
    for key, cover in want.items():
        status, value = got[key]
        assert (status == "observed") == (cover is not None), key
        if cover is not None:
            assert value == (cover[2] if cover[1] else None)
        assert (value is not None) or status != "filled"
    lonely = {k: v for k, v in got.items() if k[:2] == ("b", 77) and v[0] != "observed"}
    assert lonely and all(v == ("unsupported", None) for v in lonely.values())
    assert {v[0] for v in got.values()} == {"observed", "filled", "unsupported"}


def test_filling_recovers_low_rank(spark):
    import math

    hidden, data = {}, []
    for device in range(12):
        for k in range(100):
            value = (1 + device) * math.sin(k / 9) + 20
            if random.Random(device * 1000 + k).random() < 0.25 and 0 < k < 99:
                hidden[device, k * 10] = value
            else:
                data.append(("a", 1, 0, k * 10, k * 10 + 1, [(device, device + 1)], value, ""))
    catalog = spark.createDataFrame([("a", 10)], "lens string, step_secs long")
    got = regrid.regular_series(spark.createDataFrame(data, ND), catalog).where("status = 'filled'").collect()
    assert {(r.device, r.t) for r in got} == set(hidden)
    error = sum((r.value - hidden[r.device, r.t]) ** 2 for r in got)
    mean = sum((20 - v) ** 2 for v in hidden.values())
    assert error < 0.1 * mean


def test_regular_series_without_values(spark):
    df = spark.createDataFrame([("a", 1, 0, 0, 5, [(0, 1)], None, ""), ("a", 1, 0, 25, 35, [(0, 1)], None, "")], ND)
    catalog = spark.createDataFrame([("a", 10)], "lens string, step_secs long")
    assert rows(regrid.regular_series(df, catalog), "t", "value", "status") == [(0, None, "observed"), (10, None, "unsupported"), (20, None, "unsupported"), (30, None, "observed")]
    assert rows(regrid.regular_series(df.where("false"), catalog)) == []


# Problem 5

FEED = f"feed_pos long, lens string, layer_id long, written_at long, op string, taus {TAUS}, deleted string"


def test_changes(spark, tmp_path):
    rng = random.Random(6)
    data = []
    for i in range(400):
        layer = rng.randint(0, 120)
        op = rng.choice(["insert", "I", " Update", "upd", "DELETE", "del ", "d", None])
        data.append((i, rng.choice("ab"), layer, 0, op, [(rng.randint(0, 9), 99, rng.choice([None, 1.0, 2.0])) for _ in range(rng.randint(0, 3))], "x"))
    data += [(500 + i, "hot", i % 50, 0, "u", [(1, 2, float(i))], "") for i in range(200)]
    data += [(900, None, 1, 0, "i", [(1, 2, 1.0)], ""), (901, "a", None, 0, "i", [(1, 2, 1.0)], ""), (902, "a", 1, 0, "i", None, ""), (903, "a", 999, 0, "i", [(None, 2, 1.0)], "")]
    best = {}
    for pos, lens, layer, _, op, taus, _ in data:
        for lo, hi, v in taus or []:
            if None in (lens, layer, lo):
                continue
            deleted = (op or "").strip().lower().startswith("d")
            rank = (layer, pos, not deleted, hi, v is not None, v or 0)
            if (lens, lo) not in best or rank > best[lens, lo][0]:
                best[lens, lo] = (rank, deleted, hi, v)
    want = sorted((lens, lo, hi, rank[0]) for (lens, lo), (rank, deleted, hi, v) in best.items() if not deleted)
    rng.shuffle(data)
    df = spark.createDataFrame(data + data[:100], FEED).repartition(3)
    assert rows(changes.live(changes.rebuild(df, 3)), "lens", "lo", "hi", "layer_id") == want
    table = changes.StateTable(spark, f"file://{tmp_path}/state")  # in two parts, the older changes last
    assert table.current() is None
    table.apply(df.where("layer_id > 60"), 2)
    assert rows(changes.live(table.apply(df.where("layer_id <= 60 or layer_id is null"), 5)), "lens", "lo", "hi", "layer_id") == want
    assert rows(changes.live(table.apply(df, 4)), "lens", "lo", "hi", "layer_id") == want  # idempotent
    assert rows(changes.live(changes.rebuild(df.where("false")))) == []


def test_changes_touch_their_buckets_only(spark, tmp_path):
    def feed(*slots, layer=1, op="insert"):
        return spark.createDataFrame([(i, lens, layer, op, [(lo, lo + 1, float(layer))]) for i, (lens, lo) in enumerate(slots)], "feed_pos long, lens string, layer_id long, op string, taus array<struct<lo:long,hi:long,value:double>>")

    table = changes.StateTable(spark, f"file://{tmp_path}/state")
    table.apply(feed(*[("a", i) for i in range(60)]), 8)
    first = table.manifest()
    assert len(first["data"]) == 8 and len(set(first["data"].values())) == 1
    table.apply(feed(("a", 7), layer=2, op="Delete"))
    second = table.manifest()
    changed = [b for b in first["data"] if second["data"][b] != first["data"][b]]
    assert len(changed) == 1 and changes.live(table.current()).count() == 59 and table.current().count() == 60
    with pytest.raises(RuntimeError):  # two writers began from one version
        table.publish(table.current(), first, 8)
    assert table.manifest() == second and changes.live(table.current()).count() == 59
    for layer in range(3, 7):
        table.apply(feed(("a", 7), layer=layer))
    assert len(table.files.names(f"{table.path}/published")) == 2
    assert set(table.files.names(f"{table.path}/data")) == {d.rsplit("/", 1)[1] for v in table._versions() for d in table._manifest(v)["data"].values()}
    assert {r.layer_id for r in table.current().where("lo = 7").collect()} == {6}


def test_changes_in_steps(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(changes, "FLUSH_SLOTS", 3)
    data = [("a", i // 4, 9, 1.0, i % 4, i, i % 8 == 7) for i in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*data[i : i + 7]), changes.ARROW)], schema=changes.ARROW) for i in range(0, 40, 7)]
    want = [("a", k, 9, 1.0, 3, 4 * k + 3, k % 2 == 1) for k in range(10)]
    whole = [tuple(r.values()) for b in changes.upsert_ordered(batches) for r in b.to_pylist()]
    assert sorted(whole) == want
    parts = [b for b in changes.upsert(batches[::-1])]
    assert sorted(tuple(r.values()) for b in changes.upsert(parts) for r in b.to_pylist() if r["layer_id"] == 3)[:1] == want[:1]


# Problem 6


def brute(data):
    out = []
    by = {}
    for lens, epoch, lo, hi in data:
        if lo is not None and hi is not None and lo < hi:
            by.setdefault((lens, epoch), []).append((lo, hi))
    for key, held in by.items():
        merged = []
        for lo, hi in sorted(held):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        out += [(*key, "period", a, b) for a, b in merged] + [(*key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_periods_and_gaps(spark, seed):
    rng = random.Random(seed)
    data = []
    for _ in range(300):
        lo, width = rng.randint(0, 3000), rng.choice([0, -3, 1, 5, 40, None, 300])
        data.append((rng.choice(["hot", "hot", "b", None]), rng.choice([1, 2, None]), lo, None if width is None else lo + width))
    data += data[:30] + [("a", 1, None, 5), ("long", 1, 0, 10**9), ("long", 1, 5, 6), ("long", 1, 10**9, 10**9 + 1)]
    df = spark.createDataFrame([(*r, "extra") for r in data], "lens string, epoch long, lo long, hi long, kind string")
    for partitions in (1, 7, 40):
        got = intervals.periods_and_gaps(df, ["lens", "epoch"], partitions)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(data)


def test_periods_of_nothing(spark):
    df = spark.createDataFrame([("a", 5, 5)], "e string, lo long, hi long")
    assert rows(intervals.periods_and_gaps(df, ["e"])) == []


# Streams


def test_stream_appends_each_batch_once(spark, tmp_path):
    from epochal.plans.engine import Engine
    from epochal.streaming.ingest import append_stream

    engine = Engine(spark)
    for s in ("CREATE DATABASE d", "CREATE LENS x int", "XDERIVE LENS y AS x + 1"):
        engine.execute(s)
    source = str(tmp_path / "in")
    schema = "lo long, hi long, value long"
    for i in range(2):
        spark.createDataFrame([(i * 10, i * 10 + 10, i), (100, 110, i)], schema).coalesce(1).write.mode("append").parquet(source)
        append_stream(engine, "x", spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp"), once=True).awaitTermination()
    assert engine.wire("RANGE LENS x 0 200") == "RANGE 3; 0:10:i0; 10:20:i1; 100:110:i1"
    assert engine.wire("AT LENS y 15") == "VAL i2"
