"""Irregular readings onto a regular grid, with gaps filled by low-rank factorisation.

Every source (series and device) gets one cell per multiple of the series' step, from
its first reading to before its last reading's end. Cells that a reading covers keep the
newest value exactly. The others are predicted by alternating least squares over the
source-by-time matrix of observed cells; a cell whose source or time slot has too little
support stays marked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators.trailing import newest
from epochal.runtime import broadcast_if_small, ceil_to, cut_lineage, shuffle_width

SOURCE = ["lens", "device"]
GRID_BLOCK = 1024  # cells of one source that are laid out by one row
MAX_ID = (1 << 31) - 1


def readings(facts: DataFrame) -> DataFrame:
    """One row per reading and device: lens, device, layer_id, lo, hi, value.

    A device interval [lo, hi) stands for each whole device in it. Null or inverted
    intervals, on either axis, are void; so are readings without a device axis.
    """
    axis = F.get(F.col("axes"), F.lit(0))
    return (
        facts.select("lens", "layer_id", "lo", "hi", "value", axis["lo"].alias("d0"), axis["hi"].alias("d1"))
        .where("lo < hi and d0 < d1 and lens is not null")
        .select("lens", F.explode(F.sequence(F.col("d0"), F.col("d1") - 1)).alias("device"), "layer_id", "lo", "hi", "value")
    )


def steps(catalog: DataFrame) -> DataFrame:
    """lens, step_secs: the declared step; of several the smallest, null and non-positive ones are none."""
    return catalog.where("step_secs > 0").groupBy("lens").agg(F.min("step_secs").cast("long").alias("step"))


def grid(stepped: DataFrame) -> DataFrame:
    """All cells (lens, device, step, t) of every source; laid out in blocks so that a long source spreads."""
    spans = stepped.groupBy(*SOURCE, "step").agg(F.min("lo").alias("a"), F.max("hi").alias("b"))
    first = spans.withColumn("a", ceil_to("a", F.col("step"))).where("a < b")
    blocks = first.select(*SOURCE, "step", "b", F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.col("step") * GRID_BLOCK)).alias("a"))
    last = F.least(F.col("b") - 1, F.col("a") + F.col("step") * (GRID_BLOCK - 1))
    return blocks.repartition(shuffle_width(stepped.sparkSession), *SOURCE, "a").select(*SOURCE, "step", F.explode(F.sequence(F.col("a"), last, F.col("step"))).alias("t"))


def observed(stepped: DataFrame) -> DataFrame:
    """Cells that a reading covers, with the newest layer's value (a stored null covers, and hides)."""
    first = ceil_to("lo", F.col("step"))
    cells = stepped.where(first < F.col("hi")).select(*SOURCE, "layer_id", "value", F.explode(F.sequence(first, F.col("hi") - 1, F.col("step"))).alias("t"))
    return newest(cells, [*SOURCE, "t"])


def numbered(keys: DataFrame, name: str) -> DataFrame:
    """Distinct rows of ``keys`` with a dense long number; no single task sees them all."""
    laid = cut_lineage(keys.distinct().withColumn("_part", F.spark_partition_id()))
    sizes = dict(laid.groupBy("_part").count().collect())  # one row per partition
    before, offsets = 0, {}
    for part in sorted(sizes):
        offsets[part], before = before, before + sizes[part]
    if before > MAX_ID:
        raise ValueError(f"{before} distinct {name} values; factorise by parts")
    if not offsets:
        return laid.select(*keys.columns, F.lit(0).alias(name))
    offset = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*keys.columns))
    return laid.select(*keys.columns, (rank - 1 + F.element_at(offset, F.col("_part"))).cast("int").alias(name))


def factorise(cells: DataFrame, rank: int, iterations: int, ridge: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(source factors, time factors) of the observed cells, each standardised by its source.

    source factors: lens, device, mean, spread, support, u. time factors: step, t, w, v.
    """
    from pyspark.ml.recommendation import ALS

    stats = cells.groupBy(*SOURCE).agg(F.avg("value").alias("mean"), F.coalesce(F.nullif(F.stddev_pop("value"), F.lit(0.0)), F.lit(1.0)).alias("spread"), F.count("value").alias("support"))
    sources = numbered(cells.select(*SOURCE), "row")
    slots = numbered(cells.select("step", "t"), "col")
    ratings = cells.join(sources, SOURCE).join(slots, ["step", "t"]).join(stats, SOURCE)
    ratings = cut_lineage(ratings.select("row", "col", ((F.col("value") - F.col("mean")) / F.col("spread")).cast("float").alias("z")))
    blocks = max(2, min(256, shuffle_width(cells.sparkSession)))
    model = ALS(rank=rank, maxIter=iterations, regParam=ridge, seed=seed, userCol="row", itemCol="col", ratingCol="z", numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=5, intermediateStorageLevel="MEMORY_AND_DISK", finalStorageLevel="MEMORY_AND_DISK").fit(ratings)
    u = model.userFactors.select(F.col("id").alias("row"), F.col("features").alias("u"))
    v = model.itemFactors.select(F.col("id").alias("col"), F.col("features").alias("v"))
    held = cells.groupBy("step", "t").agg(F.count("value").alias("w"))
    return (
        cut_lineage(stats.join(sources, SOURCE).join(u, "row").drop("row")),
        cut_lineage(held.join(slots, ["step", "t"]).join(v, "col").drop("col")),
    )


def regular_series(facts: DataFrame, catalog: DataFrame, rank: int = 3, iterations: int = 6, ridge: float = 0.1, seed: int = 17, min_support: int = 4) -> DataFrame:
    """A regular series per source: lens, device, t, value, status.

    status 'observed': a reading covers t; value is the newest reading's, unchanged (null if that is a
    stored null). 'filled': no reading covers t; value is predicted. 'unsupported': no reading covers t,
    and the source has fewer than ``min_support`` observed values or no other source has one at t; value null.
    Series without a declared step are left out. Repeated readings add nothing; equal layers at one cell
    are decided by the greater value. No rows give no rows.
    """
    stepped = readings(facts).join(broadcast_if_small(steps(catalog)), "lens")
    known = observed(stepped).withColumn("covered", F.lit(True))
    cells = grid(stepped).join(known, [*SOURCE, "t"], "left")
    cells = cut_lineage(cells.withColumn("covered", F.coalesce("covered", F.lit(False))))
    usable = cells.where("covered and value is not null and not isnan(value)").select(*SOURCE, "step", "t", "value")
    if usable.isEmpty():
        status = F.when(F.col("covered"), "observed").otherwise("unsupported")
        return cells.select(*SOURCE, "t", "value", status.alias("status"))
    by_source, by_time = factorise(usable, rank, iterations, ridge, seed)
    holes = cells.where("not covered").drop("value", "covered").join(by_time, ["step", "t"], "left").join(broadcast_if_small(by_source), SOURCE, "left")
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    supported = (F.col("support") >= min_support) & (F.col("w") >= 1)
    guess = F.when(supported, F.col("mean") + F.col("spread") * dot)
    filled = holes.select(*SOURCE, "t", guess.alias("value"), F.when(guess.isNotNull(), "filled").otherwise("unsupported").alias("status"))
    return cells.where("covered").select(*SOURCE, "t", "value", F.lit("observed").alias("status")).unionAll(filled)
