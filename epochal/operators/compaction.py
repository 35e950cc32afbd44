"""Lossless compaction of layers, per generation (layers that share a written_at)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators import boxes, segments
from epochal.operators.sweep import groups, in_chunks
from epochal.runtime import broadcast_if_small

BLOCK = 1 << 16  # layer numbers that are looked at together


def generations(facts: DataFrame, keys: list[str]) -> DataFrame:
    """facts with ``generation``: the highest layer of the run of layers, in layer order, with one written_at.

    Time travel sees a generation whole or not at all, so only its layers may be merged; equal stamps
    that are not contiguous in layer order are different generations.

    Only the table of layers is looked at, in blocks of BLOCK layer numbers: runs are found inside a block,
    and the first and last run of each block are joined with those of its neighbours.
    """
    layers = facts.select(*keys, "layer_id", "written_at").distinct()
    block = F.call_function("div", F.col("layer_id"), F.lit(BLOCK).cast("long"))
    inner = Window.partitionBy(*keys, "_block").orderBy("layer_id", "written_at")
    other = F.lag(F.lit(1)).over(inner).isNull() | ~F.lag("written_at").over(inner).eqNullSafe(F.col("written_at"))
    numbered = layers.withColumn("_block", block).withColumn("_new", F.when(other, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*keys, "_block", "_run", "written_at").agg(F.max("layer_id").alias("_top"), F.collect_list("layer_id").alias("_layers"))  # at most BLOCK
    by_block = Window.partitionBy(*keys, "_block")
    marked = runs.withColumn("_last", F.max("_run").over(by_block)).withColumn("_rim", (F.col("_run") == 1) | (F.col("_run") == F.col("_last")))
    # at most two runs of a block are at its rim; all others are generations of their own
    rim = Window.partitionBy(*keys, "_own").orderBy("_block", "_run")
    follows = F.lag("written_at").over(rim).eqNullSafe(F.col("written_at")) & (F.lag("_block").over(rim) < F.col("_block"))
    joined = marked.withColumn("_own", F.when(~F.col("_rim"), F.col("_top"))).withColumn("_fresh", F.when(follows & (F.col("_run") == 1), 0).otherwise(1))
    named = joined.withColumn("_island", F.sum("_fresh").over(rim.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.max("_top").over(Window.partitionBy(*keys, "_own", "_island"))
    small = named.withColumn("generation", top).select(*keys, F.explode("_layers").alias("_layer"), "generation").distinct()
    on = segments.same(keys, "f", "n") & (F.col("f.layer_id") == F.col("n._layer"))
    return facts.alias("f").join(broadcast_if_small(small).alias("n"), on).select("f.*", "n.generation")


def compact(facts: DataFrame, keys: list[str], piece: int | None = None) -> DataFrame:
    """keys, layer_id, written_at, lo, hi, value with one layer per generation.

    Points, ranges and time travel read the same as before. Counts and sums over segments may differ:
    occluded boundaries are gone, and layers swallowed by their generation can no longer be asked for.
    """
    held = generations(facts, keys)
    by = [*keys, "generation", "written_at"]
    whole = segments.newest_wins(held, by, piece=piece, long=segments.any_long(facts, keys, piece))
    return whole.select(*keys, F.col("generation").alias("layer_id"), "written_at", F.col("start").alias("lo"), F.col("end").alias("hi"), "value")


def compact_boxes(facts: DataFrame, keys: list[str], piece: int | None = None) -> DataFrame:
    """The same for facts with further axes (``axes``): disjoint boxes, each with the newest layer's value.

    A generation of more than ``piece`` boxes is cut in time, and so are the boxes at these cuts. In a
    piece, time is swept once; what holds at a time is laid out along the other axes.
    """
    by = [*keys, "generation", "written_at"]
    held = generations(facts, keys).where("lo < hi")
    cols = [*by, "layer_id", "lo", "hi", "axes", "value"]
    schema = held.select(*keys, F.col("generation").alias("layer_id"), "written_at", "lo", "hi", "axes", "value").schema
    placed, edges = boxes.in_time(held.select(*cols), by, piece, segments.any_long(facts, keys, piece or boxes.BOXES))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        for table in in_chunks(batches, ["_h", "_b", *by]):
            firsts = [*groups(table, ["_h", "_b", *by]).tolist(), table.num_rows]
            for a, b in zip(firsts, firsts[1:]):
                own = table.slice(a, b - a)
                start, end = boxes.piece_range(edges, own.column("_h")[0].as_py(), own.column("_b")[0].as_py())
                found = boxes.newest_boxes(own.select(["layer_id", "lo", "hi", "axes", "value"]).to_pylist(), start, end)
                if not found:
                    continue
                fixed = {k: own.column(k)[0].as_py() for k in by}
                fixed["layer_id"] = fixed.pop("generation")
                rows = [fixed | {"lo": lo, "hi": hi, "axes": [{"lo": x, "hi": y} for x, y in axes], "value": value} for lo, hi, axes, value in found]
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return placed.mapInArrow(run, schema)
