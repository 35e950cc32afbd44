"""Overlapping and gapped intervals: periods and gaps by a global sort and a carried state.

The intervals are range-sorted once over all entities by (entity, start), so that an
entity with a third of all rows spans many partitions. A first pass summarises each
partition in one row, the summaries are combined from the left, and a second pass
rescans every partition with the state carried into it.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.operators.sweep import equal_neighbours
from epochal.runtime import cut_lineage, shuffle_width


class _Islands:
    """The islands of batches in order of entity and start; the last one stays open for the next batch.

    The entities of a batch are handled at once: an end is ranked above all ends of the entities before it, so
    that one running maximum gives how far the intervals of each entity reach.
    """

    def __init__(self, entity: list[str]):
        self.entity = entity
        self.last, self.state, self.entities = None, None, 0  # entity of the open island, the island, entities so far

    def add(self, batch: pa.RecordBatch):
        """The entity whose island was carried into the batch, and of each island up to the open one, which is last:
        a row of its entity (-1: the one carried in), start, end, and whether the next is of the same entity.
        """
        import numpy as np

        n = batch.num_rows
        change = np.zeros(n, bool)
        for c in self.entity:
            change[1:] |= ~equal_neighbours(batch.column(c))
        first = tuple(batch.column(c)[0].as_py() for c in self.entity)
        g = np.cumsum(change)
        lo, hi, row = batch.column("lo").to_numpy(), batch.column("hi").to_numpy(), np.arange(n)
        if self.last is not None:
            joined = first == self.last
            g = g + (not joined)
            lo, hi = np.concatenate(([self.state[0]], lo)), np.concatenate(([self.state[1]], hi))
            g, row = np.concatenate(([0], g)), np.concatenate(([-1], row))
        self.entities += int(g[-1]) + (self.last is None)
        ends = np.unique(hi)
        reach = ends[np.maximum.accumulate(g * len(ends) + np.searchsorted(ends, hi)) % len(ends)]
        head = np.concatenate(([True], (g[1:] != g[:-1]) | (lo[1:] > reach[:-1])))
        heads = np.flatnonzero(head)
        tails = np.concatenate((heads[1:], [len(lo)])) - 1
        start, end, own = lo[heads], reach[tails], g[heads]
        before = self.last
        self.last = tuple(batch.column(c)[n - 1].as_py() for c in self.entity)
        self.state = int(start[-1]), int(end[-1])
        return before, row[heads], start, end, np.concatenate((own[1:] == own[:-1], [False]))


def _name(entity) -> str:
    return json.dumps(list(entity), default=str)


def _combine(summaries: list[dict]) -> dict[int, dict]:
    """What each partition is handed: the open island of the entity that it begins with."""
    handed, entity, state = {}, None, None
    for s in sorted(summaries, key=lambda s: s["part"]):
        handed[s["part"]] = {"entity": entity, "state": state}
        last = s["last_entity"]
        start, end = s["open_lo"], s["open_hi"]
        if s["single"] and entity == last and state:
            # the whole partition is the entity that was open: its last island may hang on the carried one
            start, end = (state[0], max(end, state[1])) if start <= state[1] else (start, end)
        entity, state = last, (start, end)
    return handed


def periods_and_gaps(df: DataFrame, entity: list[str], partitions: int | None = None) -> DataFrame:
    """Per entity: the maximal periods that its intervals cover ('period') and the holes between ('gap').

    Intervals are half-open; touching ones join. An interval with a null end or hi <= lo is void.
    Repeated and nested intervals add nothing. Null entity values form an entity of their own.
    Result: entity..., kind, lo, hi. Other columns are ignored; no rows give no rows.
    """
    spark = df.sparkSession
    n = partitions or shuffle_width(spark)
    valid = df.select(*entity, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).where("lo < hi")
    keys = [*entity, "lo", "hi"]
    laid = cut_lineage(valid.repartitionByRange(n, *keys).sortWithinPartitions(*keys))
    types = {f.name: f.dataType for f in valid.schema.fields}

    def summarise(batches):
        from pyspark import TaskContext

        islands = _Islands(entity)
        for batch in batches:
            if batch.num_rows:
                islands.add(batch)
        if islands.state:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "last_entity": _name(islands.last), "open_lo": islands.state[0], "open_hi": islands.state[1], "single": islands.entities == 1}])

    summaries = laid.mapInArrow(summarise, "part long, last_entity string, open_lo long, open_hi long, single boolean")
    handed = _combine([r.asDict() for r in summaries.collect()])  # one row per partition
    shape = pa.schema([("kind", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())])

    def rescan(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        import numpy as np

        carried = handed.get(TaskContext.get().partitionId(), {"entity": None, "state": None})
        schema = pa.schema([pa.field(c, to_arrow_type(types[c])) for c in entity] + list(shape))
        islands = _Islands(entity)

        def rows(batch, before, row, kind, lo, hi):
            names = []
            for i, c in enumerate(entity):
                held = batch.column(c).take(pa.array(np.maximum(row, 0)))
                carried_in = pa.array(row < 0)
                names.append(pc.if_else(carried_in, pa.scalar(before[i], held.type), held) if before is not None else held)
            return pa.RecordBatch.from_arrays([*names, pa.repeat(pa.scalar(kind), len(row)), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if islands.last is None and carried["state"] and _name([batch.column(c)[0].as_py() for c in entity]) == carried["entity"]:
                islands.last, islands.state = tuple(batch.column(c)[0].as_py() for c in entity), tuple(carried["state"])
            before, row, start, end, joined = islands.add(batch)
            yield rows(batch, before, row[:-1], "period", start[:-1], end[:-1])
            at = np.flatnonzero(joined)
            yield rows(batch, before, row[at], "gap", end[at], start[at + 1])
        if islands.last is not None:  # possibly continued in the next partition
            names = [pa.array([x], f.type) for x, f in zip(islands.last, schema)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(["period"]), pa.array([islands.state[0]]), pa.array([islands.state[1]])], schema=schema)

    fields = ", ".join(f"`{c}` {types[c].simpleString()}" for c in entity)
    found = laid.mapInArrow(rescan, f"{fields}, kind string, lo long, hi long")
    # an island that spans partitions was reported by each, under one start
    return found.groupBy(*entity, "kind", "lo").agg(F.max("hi").alias("hi"))
