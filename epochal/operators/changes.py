"""Applying a change feed: per-bucket upserts in an embedded database, published at once.

Slots are hashed into buckets. Every bucket runs conditional upserts that compare the
stored sequence with the incoming one, so changes may repeat and come in any order, and
keeps deletes as tombstones. Each input task first upserts its own part, so that a slot
with a third of all changes reaches its bucket as one row per task.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.runtime import Files, estimated_bytes, scratch

STATE = "lens string, lo long, hi long, value double, layer_id long, feed_pos long, deleted boolean"
ARROW = pa.schema([("lens", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("value", pa.float64()), ("layer_id", pa.int64()), ("feed_pos", pa.int64()), ("deleted", pa.bool_())])
BUCKET_BYTES = 128 << 20  # input per bucket
FLUSH_SLOTS = 100_000  # slots that an embedded table holds at most, but for one batch
ENGINE_MEMORY = "512MB"

# Sequences of a slot are never null here; equal layers are decided by the feed position.
UPSERT = """
INSERT INTO slots
SELECT lens, lo, hi, value, layer_id, feed_pos, deleted FROM incoming
QUALIFY row_number() OVER (PARTITION BY lens, lo ORDER BY layer_id DESC, feed_pos DESC, deleted, hi DESC, value DESC) = 1
ON CONFLICT (lens, lo) DO UPDATE SET hi = excluded.hi, value = excluded.value, layer_id = excluded.layer_id, feed_pos = excluded.feed_pos, deleted = excluded.deleted
WHERE (excluded.layer_id, excluded.feed_pos) > (slots.layer_id, slots.feed_pos)
"""


def is_delete(op: Column) -> Column:
    """Any spelling that begins with d (blanks and case aside); null and unknown words are no deletes."""
    return F.coalesce(F.lower(F.trim(op)).startswith("d"), F.lit(False))


def slot_changes(feed: DataFrame) -> DataFrame:
    """One row per change and slot. Changes without lens, sequence or start cannot be ordered or placed: void."""
    return (
        feed.where("lens is not null and layer_id is not null")
        .select("lens", F.explode("taus").alias("e"), "layer_id", F.coalesce("feed_pos", F.lit(-1).cast("long")).alias("feed_pos"), is_delete(F.col("op")).alias("deleted"))
        .select("lens", "e.lo", "e.hi", "e.value", "layer_id", "feed_pos", "deleted")
        .where("lo is not null")
    )


CREATE = "CREATE OR REPLACE TABLE slots (lens VARCHAR, lo BIGINT, hi BIGINT, value DOUBLE, layer_id BIGINT, feed_pos BIGINT, deleted BOOLEAN, PRIMARY KEY (lens, lo))"


def upsert(batches, ordered: bool = False):
    """Feeds record batches into an embedded table of slots and yields its rows.

    The table is exported and begun anew whenever it holds FLUSH_SLOTS. Input ordered by slot is then
    final but for its last slot, which is carried over; other input is exported in parts, of which a
    later upsert makes one. The table thus stays small whatever the input.
    """
    import duckdb

    with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": ENGINE_MEMORY}) as db:
        db.execute(CREATE)

        def put(rows: pa.Table) -> None:
            db.register("incoming", rows)
            db.execute(UPSERT)
            db.unregister("incoming")

        def export(where: str = "true", key: tuple = ()) -> pa.Table:
            return db.sql(f"SELECT * FROM slots WHERE {where}", params=list(key)).to_arrow_table().cast(ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            put(pa.Table.from_batches([batch.select(ARROW.names)]))
            if db.execute("SELECT count(*) FROM slots").fetchall()[0][0] < FLUSH_SLOTS:
                continue
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in ("lens", "lo"))
            carried = export("(lens, lo) = (?, ?)", last) if ordered else None
            yield from (export("(lens, lo) <> (?, ?)", last) if ordered else export()).to_batches(max_chunksize=65_536)
            db.execute(CREATE)
            if ordered:
                put(carried)
        yield from export().to_batches(max_chunksize=65_536)


def upsert_ordered(batches):
    return upsert(batches, ordered=True)


def bucket_of(buckets: int) -> Column:
    """The bucket of a slot: the same number that a hash partitioning by slot gives it, so that a task holds one bucket."""
    return F.pmod(F.hash("lens", "lo"), F.lit(int(buckets)))


def bucket_count(feed: DataFrame) -> int:
    return int(max(int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(feed) // BUCKET_BYTES))


def apply_changes(feed: DataFrame, buckets: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """The slots after all changes of ``feed`` (and those held in ``state``), tombstones included.

    Per (lens, lo) the change with the highest layer_id counts, whatever the order and number of
    deliveries; of equal layers the one later in the feed. Result columns: see STATE.
    """
    return _upserted(slot_changes(feed).mapInArrow(upsert, STATE), buckets or bucket_count(feed), state)


def _upserted(changes: DataFrame, buckets: int, state: DataFrame | None) -> DataFrame:
    held = changes if state is None else changes.unionAll(state.select(*ARROW.names))
    return held.repartition(int(buckets), "lens", "lo").sortWithinPartitions("lens", "lo").mapInArrow(upsert_ordered, STATE)


def live(state: DataFrame) -> DataFrame:
    """Slots that are not deleted."""
    return state.where("not deleted").drop("deleted")


class StateTable:
    """A table of slots, stored by bucket, whose versions are published atomically.

    A feed rewrites the buckets that it touches and no others. Their results are exported into a new
    directory by Spark's committer, which survives lost executors and repeated tasks. A version is
    one small manifest, which names the directory of every bucket; it appears whole under its number or not at
    all, and of two writers of one number the second fails. The last ``keep`` versions stay readable;
    what only older ones refer to is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.files = Files(spark, self.path)

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.path}/published") if n.endswith(".json")]

    def _manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/published/{version:012d}.json"))

    def manifest(self) -> dict:
        """version, buckets (how many) and data (bucket: directory) of the current version; version 0 is empty."""
        held = self._versions()
        return self._manifest(held[-1]) if held else {"version": 0, "buckets": 0, "data": {}}

    def _read(self, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        data = manifest["data"]
        paths = [f"{data[b]}/bucket={b}" for b in sorted(data, key=int) if only is None or int(b) in only]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else None

    def current(self) -> DataFrame | None:
        return self._read(self.manifest())

    def publish(self, rows: DataFrame, before: dict, buckets: int) -> dict:
        """Writes the buckets of ``rows`` and makes them, with all others of ``before``, the next version."""
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", bucket_of(buckets)).write.partitionBy("bucket").parquet(data)
        written = {n.removeprefix("bucket="): data for n in self.files.names(data) if n.startswith("bucket=")}
        after = {"version": before["version"] + 1, "buckets": buckets, "data": before["data"] | written}
        if not self.files.write_new(f"{self.path}/published/{after['version']:012d}.json", json.dumps(after)):
            self.files.delete(data)
            raise RuntimeError(f"version {after['version']} was published by another writer")
        self._collect_garbage()
        return after

    def _collect_garbage(self) -> None:
        versions = self._versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        used = {d for v in kept for d in self._manifest(v)["data"].values()}
        for v in old:
            for d in set(self._manifest(v)["data"].values()) - used:
                self.files.delete(d)
            self.files.delete(f"{self.path}/published/{v:012d}.json")

    def apply(self, feed: DataFrame, buckets: int | None = None) -> DataFrame | None:
        """The current state after the changes of ``feed``; None if there are no slots at all."""
        before = self.manifest()
        n = before["buckets"] or buckets or bucket_count(feed)
        changes, state = slot_changes(feed), None
        if before["data"]:
            touched = {r[0] for r in changes.select(bucket_of(n).alias("b")).distinct().collect()}  # as many as buckets
            state = self._read(before, touched)
        return self._read(self.publish(_upserted(changes.mapInArrow(upsert, STATE), n, state), before, n))


def rebuild(feed: DataFrame, buckets: int | None = None) -> DataFrame:
    """The current state from the whole feed, published in the shared folder and read from there."""
    spark = feed.sparkSession
    found = StateTable(spark, scratch(spark, "slots")).apply(feed, buckets)
    return spark.createDataFrame([], STATE) if found is None else found
