"""Messages delivered more than once: keep exactly one copy, by deletion vectors.

Only the identifier, the delivery order and the row's position in its file are
shuffled. Each message's winner is the first delivery; the winners of every file
become bitmaps of 32 768 rows (a row that is not in its bitmap is deleted), and
the wide payload is filtered by them while it is scanned. The payload is never
shuffled, and a message with a third of all copies costs one partial aggregate.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.runtime import BROADCAST_LIMIT, scratch

CONTAINER = 32_768  # rows covered by one bitmap; fixed by bitmap_construct_agg
CONTAINER_BYTES = CONTAINER // 8 + 64
FILE, ROW = "_dv_file", "_dv_row"


def positioned(df: DataFrame) -> DataFrame:
    """The scan with two more columns: its file (as a 64-bit hash) and the row's index in it.

    ``df`` must read Parquet files, with at most filters and projections on top.
    """
    return df.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def file_ids_clash(df: DataFrame) -> bool:
    """Whether two of the scanned files have one hash (then positions would be ambiguous)."""
    files = df.inputFiles()
    if len(files) < 2:
        return False
    hashed = df.sparkSession.createDataFrame([(f,) for f in files], "f string").select(F.xxhash64("f").alias("h"))
    return hashed.distinct().count() < len(set(files))


def _order_key(names: list[str]) -> list[Column]:
    """Ascending, a null after every value."""
    return [c for n in names for c in (F.col(n).isNull().alias(f"{n}_null"), F.col(n).alias(n))]


def winners(rows: DataFrame, ids: list[str], order: list[str]) -> DataFrame:
    """Positions (file, row) of the first copy of every message.

    A row with a null in its identifier cannot be matched and wins for itself.
    Equal order keys are decided by position, so that exactly one copy stays.
    """
    unknown = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ids))
    narrow = rows.select(
        *ids,
        *order,
        FILE,
        ROW,
        F.when(unknown, F.col(FILE)).alias("_own_file"),
        F.when(unknown, F.col(ROW)).alias("_own_row"),
    )
    first = F.min(F.struct(*_order_key(order), FILE, ROW)).alias("w")
    return narrow.groupBy(*ids, "_own_file", "_own_row").agg(first).select(f"w.{FILE}", f"w.{ROW}")


def survivor_vectors(positions: DataFrame) -> DataFrame:
    """One bitmap per file and 32 768 rows: bit set = kept, clear = deleted."""
    return (
        positions.select(
            FILE,
            F.shiftright(ROW, 15).alias("_dv_box"),
            F.pmod(F.col(ROW), F.lit(CONTAINER)).cast("long").alias("at"),
        )
        .groupBy(FILE, "_dv_box")
        .agg(F.bitmap_construct_agg("at").alias("_dv_bits"))
    )


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8))) == 1


def apply_vectors(rows: DataFrame, vectors: DataFrame, size_bound: int, deleted: bool = False, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The kept (or, with ``deleted``, the deleted) rows of a positioned scan.

    ``size_bound`` is a proven bound of the vectors' bytes: within ``limit`` they are
    broadcast; beyond, they are written to the shared folder and each scanning task
    reads the few that belong to its own files. The payload is not shuffled either way.
    """
    if size_bound <= limit:
        at = F.pmod(F.col(ROW), F.lit(CONTAINER)).cast("int")
        joined = rows.withColumn("_dv_box", F.shiftright(ROW, 15)).join(F.broadcast(vectors), [FILE, "_dv_box"], "left")
        kept = F.col("_dv_bits").isNotNull() & _bit(F.col("_dv_bits"), at)
        return joined.where(~kept if deleted else kept).drop(FILE, ROW, "_dv_box", "_dv_bits")
    return _apply_from_shared(rows, vectors, deleted)


def _apply_from_shared(rows: DataFrame, vectors: DataFrame, deleted: bool, shards: int = 4096) -> DataFrame:
    spark = rows.sparkSession
    path = scratch(spark, "vectors")
    vectors.withColumn("shard", F.pmod(F.col(FILE), F.lit(shards)).cast("int")).repartition("shard").write.partitionBy("shard").parquet(path)
    schema = rows.drop(FILE, ROW).schema

    def filtered(batches):
        import numpy as np
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path)
        held: dict[int, dict[int, np.ndarray]] = {}

        def load(file: int) -> dict[int, np.ndarray]:
            shard = f"{root}/shard={file % shards}"
            if where.get_file_info(shard).type == fs.FileType.NotFound:
                return {}
            own = ds.dataset(shard, filesystem=where, format="parquet").to_table(filter=pc.field(FILE) == file)
            return {b: np.unpackbits(np.frombuffer(v, "u1"), bitorder="little").astype(bool) for b, v in zip(own["_dv_box"].to_pylist(), own["_dv_bits"].to_pylist())}

        for batch in batches:
            files, at = batch.column(FILE).to_numpy(), batch.column(ROW).to_numpy()
            keep = np.zeros(len(files), bool)
            for file in np.unique(files):
                if file not in held:
                    held.clear()  # a task reads one file after the other
                    held[file] = load(int(file))
                of_file = files == file
                for box in np.unique(at[of_file] >> 15):
                    here = of_file & (at >> 15 == box)
                    if (bits := held[file].get(int(box))) is not None:
                        keep[here] = bits[at[here] & CONTAINER - 1]
            yield batch.filter(pa.array(~keep if deleted else keep)).drop_columns([FILE, ROW])

    return rows.mapInArrow(filtered, schema)


def once(df: DataFrame, ids: list[str], order: list[str], deleted: bool = False, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Exactly one copy of each message in ``df``, the first by ``order``.

    ids: identifying columns; a null in any means that the message is unknown: it is kept.
    order: delivery order, ascending, nulls last; ties are decided by the row's position.
    deleted: return the other copies instead.
    An empty table gives an empty result. All columns are kept; names that begin with
    ``_dv_`` or ``_own_`` are reserved.
    """
    if file_ids_clash(df):
        raise ValueError("two input files have one 64-bit hash; rename one")
    rows = positioned(df)
    vectors = survivor_vectors(winners(rows, ids, order))
    bound = (df.count() // CONTAINER + max(1, len(df.inputFiles())) * 2) * CONTAINER_BYTES  # the count is read from footers
    return apply_vectors(rows, vectors, bound, deleted, limit)
