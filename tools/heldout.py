"""python tools/heldout.py SF: how well regular_series fills cells that are hidden from it, against two plainer fillings.

One observed cell in ten is hidden. Median absolute errors, in spreads of the source, over all hidden cells.
"""

import os
import sys

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from epochal.operators import regrid  # noqa: E402


def main(d: str) -> None:
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    steps = regrid.steps(spark.read.parquet(f"{d}/lens_catalog.parquet"))
    cells = regrid.observed(regrid.readings(spark.read.parquet(f"{d}/facts_nd.parquet")).join(F.broadcast(steps), "lens")).join(F.broadcast(steps), "lens")
    cells = cells.where("value is not null").withColumn("hidden", F.pmod(F.xxhash64("lens", "device", "t"), F.lit(10)) == 0).cache()
    by_source, by_time = regrid.factorise(cells.where("not hidden").drop("hidden"), 3, 6, 0.1, 17)
    before = Window.partitionBy("lens", "device").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("carried", F.last(F.when(~F.col("hidden"), F.col("value")), True).over(before)).where("hidden")
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    z = carried.join(by_source, ["lens", "device"]).join(by_time, ["step", "t"]).where("support >= 4 and carried is not null")
    error = lambda c: F.median(F.abs(c - F.col("value")) / F.col("spread"))
    z.agg(F.count(F.lit(1)).alias("hidden"), error(F.col("mean") + F.col("spread") * dot).alias("factorised"), error(F.col("carried")).alias("carried forward"), error(F.col("mean")).alias("mean of the source")).show()


if __name__ == "__main__":
    main(sys.argv[1] if os.path.isdir(sys.argv[1]) else f"/root/testdata/{sys.argv[1]}")
