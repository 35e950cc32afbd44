"""Continuous ingest: each micro-batch is appended once, then views refresh and triggers fire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from epochal.operators import late
from epochal.plans.engine import Engine


def append_stream(engine: Engine, lens: str, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream (lo, hi, value) to a lens, one layer per micro-batch; late rows are never dropped.

    A micro-batch that is delivered again is recognised by its number, which the engine keeps with the
    layer under the name of the checkpoint folder; with an engine that has a path also after a restart.
    """

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.append_batch(lens, batch.select("lo", "hi", "value"), checkpoint, number)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class CounterLog:
    """Counters of late events (see operators.late) as an append-only log of slots.

    Every batch of deliveries writes its slots into a directory of its own number, so that a retry
    overwrites itself; reading merges all of them. Nothing is ever updated in place.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, deliveries: DataFrame, number: int) -> None:
        late.slots(deliveries).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def slots(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")

    def totals(self) -> DataFrame:
        return late.totals(late.merge(self.slots()))

    def write(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


