"""Elementary, merged and aligned segments of layered facts, and how they are spread over tasks.

A facts DataFrame has key columns (any number, also none), layer_id, lo, hi and value. The rows of a
series meet in one task, which sweeps many series at once (operators.sweep). A series with more than
LONG rows is cut in time into pieces of about PIECE, at quantiles of its own bounds, so that it
spreads over many tasks; facts that fill a piece reach it as one row, by a partial aggregate over a
tree of pieces. The cuts never show in a result: what begins at one is marked ``split = false``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from epochal.operators import sweep
from epochal.operators.sweep import HIGH, LOW, Leaf, Sweep

LONG = 1 << 18  # rows of one series that one task sweeps as they are; a longer one is cut
PIECE = 1 << 16  # rows of its pieces
MOST_PIECES = 1 << 20  # of all series together; with more rows than that gives, pieces grow
SAMPLE = 1 << 18  # bounds of cut series that are read to place the cuts (16 per piece if that is more)


@dataclass
class Part:
    """The rows of one leaf: keys, layer_id, lo, hi, value (and _n: what a row counts, else 1)."""

    rows: DataFrame
    leaf: Leaf = Leaf()

    @property
    def reach(self) -> tuple[Column, Column]:
        """The first and last time at which a row matters."""
        if self.leaf.kind == "point":
            return F.col("lo"), F.col("lo")
        if self.leaf.kind == "roll":
            return _moved("lo", -self.leaf.end), _moved("hi", -self.leaf.begin)
        return F.col("lo"), F.col("hi")


def _moved(x: str, by: int) -> Column:
    c = F.col(x)
    out = F.call_function("try_add", c, F.lit(by).cast("long"))
    return F.coalesce(out, F.lit(HIGH if by > 0 else LOW).cast("long"))


def bounded(t: int) -> int:
    return max(LOW, min(HIGH, t))


def same(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))


def clip(facts: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Facts cut to [start, end); the filters on hi and lo reach the scan. Null and inverted intervals are void."""
    out = facts.where("lo < hi")
    if start is not None:
        out = out.where(F.col("hi") > start)
    if end is not None:
        out = out.where(F.col("lo") < end)
    cut = {} if start is None else {"lo": F.greatest("lo", F.lit(start))}
    return out.withColumns(cut | ({} if end is None else {"hi": F.least("hi", F.lit(end))}))


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys) if keys else F.lit(0).cast("long")


def inner_names(keys: list[str]) -> list[str]:
    """Names of the keys inside a sweep, where they cannot clash with its own columns."""
    return [f"_k{i}" for i in range(len(keys))]


def _laid(parts: list[Part], keys: list[str]) -> DataFrame:
    """All parts as one frame: the keys as _k0, _k1..., _h, _leaf, _n, layer_id, lo, hi, _from, _to and a value column per part."""
    kinds = [dict(p.rows.dtypes).get("value", "bigint") for p in parts]
    out = []
    for i, p in enumerate(parts):
        first, last = p.reach
        values = [(F.col("value") if j == i and p.leaf.kind != "point" and p.leaf.kind != "depth" else F.lit(None)).cast(k).alias(f"v{j}") for j, k in enumerate(kinds)]
        layer = F.col("layer_id").cast("long") if "layer_id" in p.rows.columns else F.lit(0).cast("long")
        weight = (F.col("_n") if "_n" in p.rows.columns else F.lit(1)).cast("long")
        hi = F.col("hi").cast("long") if "hi" in p.rows.columns else F.col("lo").cast("long")
        out.append(p.rows.select(*[F.col(k).alias(n) for k, n in zip(keys, inner_names(keys))], _hash(keys).alias("_h"), F.lit(i).alias("_leaf"), weight.alias("_n"), layer.alias("layer_id"), F.col("lo").cast("long").alias("lo"), hi.alias("hi"), first.cast("long").alias("_from"), last.cast("long").alias("_to"), *values))
    return reduce(DataFrame.unionAll, out)


def cuts(laid: DataFrame, piece: int, longest: int) -> dict[int, object]:
    """Per series (by hash) with more than ``longest`` rows, for pieces of ``piece`` rows: the times at which it is cut, as a sorted array.

    One row per such series comes to the driver, and a sample of their bounds, which decides where
    tasks begin and nothing else. Two series with one hash are cut alike, which harms neither.
    """
    import numpy as np

    counted = laid.groupBy("_h").count().where(F.col("count") > longest).collect()  # at most rows / longest
    if not counted:
        return {}
    spark = laid.sparkSession
    total = sum(r["count"] for r in counted)
    piece = max(piece, total // MOST_PIECES)
    rows = max(SAMPLE, 16 * total // piece)
    hot = spark.createDataFrame([(r["_h"],) for r in counted], "_h long")
    bounds = laid.select("_h", "lo", "hi").join(F.broadcast(hot), "_h").select("_h", F.explode(F.array("lo", "hi")).alias("t")).where("t is not null")
    taken = bounds.sample(min(1.0, rows / (2 * total)), 17).toPandas()
    out = {}
    for h, times in taken.groupby("_h")["t"]:
        n = -(-next(r["count"] for r in counted if r["_h"] == h) // piece)
        held = np.sort(times.to_numpy())
        out[int(h)] = np.unique(held[np.linspace(0, len(held) - 1, n + 1).astype(int)[1:-1]])
    return {h: e for h, e in out.items() if len(e)}


def piece_number(edges):
    """A column function of a series' hash and a time: the piece of the series that holds the time."""

    @F.pandas_udf(IntegerType())
    def piece_of(h: pd.Series, t: pd.Series) -> pd.Series:
        import numpy as np

        out, held = np.zeros(len(h), np.int32), h.to_numpy()
        for one in np.unique(held):
            if (own := edges.value.get(int(one))) is not None:
                here = held == one
                out[here] = np.searchsorted(own, t.to_numpy()[here], "right")
        return pd.Series(out)

    return piece_of


def _spread(laid: DataFrame, parts: list[Part], keys: list[str], edges) -> DataFrame:
    """laid with the piece _b of each row, once per piece in which it matters."""
    values = [f"v{i}" for i in range(len(parts))]
    cols = [*keys, "_h", "_b", "_leaf", "_n", "layer_id", "lo", "hi", *values]
    if edges is None:
        return laid.withColumn("_b", F.lit(0)).select(*cols)
    most = max(len(e) for e in edges.value.values()) + 1

    piece_of = piece_number(edges)
    placed = laid.withColumn("_x", piece_of("_h", "_from")).withColumn("_y", piece_of("_h", "_to"))
    whole = [i for i, p in enumerate(parts) if p.leaf.kind == "roll"]  # every bound of these counts
    every = placed.where(F.col("_leaf").isin(whole)).withColumn("_b", F.explode(F.sequence("_x", "_y"))).select(*cols) if whole else None
    rest = placed.where(~F.col("_leaf").isin(whole)) if whole else placed
    ends = rest.withColumn("_b", F.explode(F.array_distinct(F.array("_x", "_y")))).select(*cols)
    # the pieces between the two ends: nodes of a binary tree over the pieces, the newest fact of each
    top = most.bit_length()
    a, b = F.col("_x") + 1, F.col("_y")

    def node(k: Column, left: bool) -> Column:
        step = F.expr("shiftleft(1, k)") if k is None else F.call_function("shiftleft", F.lit(1), k)
        x, y = F.call_function("shiftright", a + step - 1, k), F.call_function("shiftright", b, k)
        own = x if left else y - 1
        return F.when((x < y) & (F.pmod(x if left else y, F.lit(2)) == 1), F.struct(k.alias("level"), own.alias("node")))

    levels = F.sequence(F.lit(0), F.lit(top))
    nodes = F.filter(F.concat(F.transform(levels, lambda k: node(k, True)), F.transform(levels, lambda k: node(k, False))), lambda x: x.isNotNull())
    inner = rest.where(b > a).withColumn("_k", F.explode(nodes))
    newest = F.max(F.struct("layer_id", *values)).alias("_m")
    by = [*keys, "_h", "_leaf"]
    held = inner.groupBy(*by, "_k").agg(newest, F.sum("_n").alias("_n"))
    width = F.call_function("shiftleft", F.lit(1), F.col("_k.level"))
    boxes = held.withColumn("_b", F.explode(F.sequence(F.col("_k.node") * width, (F.col("_k.node") + 1) * width - 1)))
    filled = boxes.groupBy(*by, "_b").agg(F.max("_m").alias("_m"), F.sum("_n").alias("_n"))
    none = F.lit(None).cast("long")
    fill = filled.select(*keys, "_h", "_b", "_leaf", "_n", F.col("_m.layer_id").alias("layer_id"), none.alias("lo"), none.alias("hi"), *[F.col(f"_m.{v}").alias(v) for v in values])
    out = ends.unionAll(fill)
    return out if every is None else out.unionAll(every)


def cells(parts: list[Part], keys: list[str], spec: dict, piece: int | None = None, long: bool = True) -> tuple[DataFrame, bool]:
    """The cells of a sweep, and whether any series was cut. spec: the other fields of Sweep.

    Columns: keys, _h, _b, start, end, split, _edge, and per leaf p0, x0 (and bad0 for rolling ones).
    Rows of one series and piece lie together, in order. One shuffle of the rows of all parts.
    long = false: it is known that no series is longer than a piece.
    """
    laid = _laid(parts, keys)
    names = inner_names(keys)
    found = cuts(laid, piece or PIECE, piece or LONG) if long else {}
    edges = laid.sparkSession.sparkContext.broadcast(found) if found else None  # eight bytes for each of MOST_PIECES
    rows = _spread(laid, parts, names, edges)
    by = ["_h", "_b", *names]
    ordered = rows.repartition("_h", "_b").sortWithinPartitions(*by)
    plan = Sweep(tuple(names), tuple(p.leaf for p in parts), **spec)
    types = {f.name: f.dataType for f in rows.schema.fields}
    fields = [StructField(k, types[k]) for k in names] + [StructField("_h", LongType()), StructField("_b", IntegerType())]
    fields += [StructField("start", LongType()), StructField("end", LongType()), StructField("split", BooleanType()), StructField("_edge", BooleanType())]
    for i, p in enumerate(parts):
        if p.leaf.kind != "point":
            kind = {"count": LongType()}.get(p.leaf.function, types[f"v{i}"]) if p.leaf.kind != "depth" else LongType()
            if p.leaf.function == "avg":
                from pyspark.sql.types import DoubleType

                kind = DoubleType()
            fields += [StructField(f"p{i}", BooleanType()), StructField(f"x{i}", kind)]
            if p.leaf.kind == "roll":
                fields.append(StructField(f"bad{i}", BooleanType()))
    schema = StructType(fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        for table in sweep.in_chunks(batches, by):
            out = sweep.run(plan, table, edges.value if edges else {})
            if out is not None:
                yield from out.select(shape.names).cast(shape).combine_chunks().to_batches(max_chunksize=1 << 16)

    out = ordered.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *[f.name for f in fields[len(keys) :]]), bool(found)


def any_long(facts: DataFrame, keys: list[str], piece: int | None = None) -> bool:
    """Whether some series has more rows than a piece."""
    return not facts.groupBy(*keys).count().where(F.col("count") > (piece or LONG)).isEmpty()


def _islands(rows: DataFrame, keys: list[str], joined: Column, aggregates: list[Column]) -> DataFrame:
    """Rows that touch a cut, joined over it; all others are islands of their own.

    A series has at most two rows that touch each of its cuts, and only those are looked at together.
    """
    group = Window.partitionBy("_h", *keys, "_own").orderBy("start")
    marked = rows.withColumn("_own", F.when(~F.col("_edge"), F.col("start"))).withColumn("_new", F.when(joined & F.lag("end").over(group).eqNullSafe(F.col("start")), 0).otherwise(1))
    named = marked.withColumn("_island", F.sum("_new").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("_h", *keys, "_own", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *aggregates)


def _over_cuts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, value with equal neighbours joined over cuts."""
    group = Window.partitionBy("_h", *keys, "_own").orderBy("start")
    found = _islands(rows, keys, F.lag("value").over(group).eqNullSafe(F.col("value")), [F.first("value").alias("value")])
    return found.select(*keys, "start", "end", "value")


def elementary(facts: DataFrame, keys: list[str], start: int | None = None, end: int | None = None, piece: int | None = None) -> DataFrame:
    """Un-merged newest-wins segments: keys, start, end, split, value.

    A segment begins at every boundary of every layer, occluded facts included. Rows with
    split = false continue the segment before them across a cut: they add to durations
    and never to counts. A stored null is a value and hides older ones; uncovered time has no row.
    Facts of one layer do not overlap (appends see to it); exact repeats change nothing, and of
    others the greater value holds. A null layer is older than all others.
    """
    clipped = clip(facts.select(*keys, "layer_id", "lo", "hi", "value"), start, end)
    found, _ = cells([Part(clipped)], keys, {"start": start, "end": end}, piece)
    return found.select(*keys, "start", "end", "split", F.col("x0").alias("value"))


def newest_wins(facts: DataFrame, keys: list[str], start: int | None = None, end: int | None = None, piece: int | None = None, long: bool = True) -> DataFrame:
    """Maximal newest-wins segments: keys, start, end, value; the same as merging :func:`elementary`.

    Equality counts null as a value and is exact for every type.
    """
    clipped = clip(facts.select(*keys, "layer_id", "lo", "hi", "value"), start, end)
    found, cut = cells([Part(clipped)], keys, {"start": start, "end": end, "merge": True}, piece, long)
    rows = found.withColumnRenamed("x0", "value")
    return _over_cuts(rows, keys) if cut else rows.select(*keys, "start", "end", "value")


def merged(rows: DataFrame, keys: list[str], cut: bool) -> DataFrame:
    """Maximal segments of equal value of cells (keys, _h, _b, start, end, value, _edge) as :func:`cells` lays them.

    Only narrow steps may lie between: the rows are joined as they come, without a shuffle.
    """
    cols = rows.select(*keys, "_h", "_b", "start", "end", "value", "_edge")
    schema = cols.schema

    def run(batches):
        for table in sweep.in_chunks(batches, ["_h", "_b", *keys]):
            yield from sweep.join_equal(table, keys).combine_chunks().to_batches(max_chunksize=1 << 16)

    joined = cols.mapInArrow(run, schema)
    return _over_cuts(joined, keys) if cut else joined.select(*keys, "start", "end", "value")


def unsplit(rows: DataFrame, keys: list[str], cut: bool) -> DataFrame:
    """keys, start, end, value: un-merged segments, those that a cut has split made one again."""
    if not cut:
        return rows.select(*keys, "start", "end", "value")
    return _islands(rows, keys, ~F.col("split"), [F.first("value").alias("value")]).select(*keys, "start", "end", "value")


def at_points(facts: DataFrame, points: DataFrame, keys: list[str], piece: int | None = None) -> DataFrame:
    """keys, t, value of the newest fact at each point (keys, t) that is covered; repeated points once."""
    asked = points.select(*keys, F.col("t").cast("long").alias("lo")).where("lo is not null")
    held = clip(facts.select(*keys, "layer_id", "lo", "hi", "value"), None, None)
    found, _ = cells([Part(held), Part(asked, Leaf("point"))], keys, {}, piece)
    return found.select(*keys, F.col("start").alias("t"), F.col("x0").alias("value"))


def crowded(facts: DataFrame, keys: list[str], piece: int | None = None) -> DataFrame:
    """keys, start, end: time that more than one fact (lo < hi) of a series covers."""
    held = facts.where("lo < hi").select(*keys, "lo", "hi")
    found, _ = cells([Part(held, Leaf("depth"))], keys, {}, piece)
    return found.select(*keys, "start", "end")
