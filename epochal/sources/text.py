"""Text files of facts: ``start,end,value`` lines, with comments and blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.functions.values import SPARK_TYPES, EngineError

LITERALS = {  # fixed values: what a literal of each type looks like
    "int": r"^-?\d+$",
    "float": r"^-?\d+\.\d+$",
    "bool": r"^(true|false)$",
    "str": r'^"(?:[^"\\]|\\["\\])*"$',
}


def _typed(cell: Column, kind: str) -> Column:
    if kind == "str":
        return F.regexp_replace(F.expr("substring(cell, 2, length(cell) - 2)"), r'\\(["\\])', "$1")
    return F.expr(f"try_cast(cell as {SPARK_TYPES[kind]})")


def read_facts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """lo, hi, value, problem (null where the line is good) of every line that is no comment and not blank.

    A line is cut at its first two commas, so that a value may hold commas. Cells are literals of the
    lens' type, or null; a literal of another type is a problem, too.
    """
    return _parsed(spark.read.text(path), kind)


def _parsed(texts: DataFrame, kind: str) -> DataFrame:
    """The facts of lines (column value); other columns are kept behind them."""
    more = [c for c in texts.columns if c != "value"]
    lines = texts.select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("line"), *more).where("line <> '' and not startswith(line, '#')")
    parts = lines.withColumn("p", F.split("line", ",", 3)).select("line", *more, *[F.trim(F.get(F.col("p"), F.lit(i))).alias(n) for i, n in enumerate(("s", "e", "cell"))])
    lo, hi = F.expr("try_cast(s as bigint)"), F.expr("try_cast(e as bigint)")
    null = F.col("cell") == "null"
    value = F.when(null, None).otherwise(_typed(F.col("cell"), kind))
    literal = null | (F.col("cell").rlike(LITERALS[kind]) & _typed(F.col("cell"), kind).isNotNull())
    known = F.lit(False)
    for pattern in LITERALS.values():
        known = known | F.col("cell").rlike(pattern)
    problem = (
        F.when(F.col("cell").isNull(), F.lit("expected start,end,value"))
        .when(~F.col("s").rlike(r"^[-+]?\d+$") | lo.isNull(), F.concat(F.lit('invalid start "'), "s", F.lit('"')))
        .when(~F.col("e").rlike(r"^[-+]?\d+$") | hi.isNull(), F.concat(F.lit('invalid end "'), "e", F.lit('"')))
        .when(~literal & known, F.lit("type mismatch"))
        .when(~literal, F.concat(F.lit('cannot parse value "'), "cell", F.lit('"')))
    )
    return parts.select("line", lo.alias("lo"), hi.alias("hi"), value.alias("value"), problem.alias("problem"), *more)


def in_order(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows of one file with ``at``, their number in file order from 0, and how many there are.

    Rows are counted per partition; only these counts, one per partition, come to the driver.
    """
    spark = rows.sparkSession
    laid = rows.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    offsets, total = [], 0
    for r in sorted(laid.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["count"]
    before = spark.createDataFrame(offsets, "_part int, _before long")
    return laid.join(F.broadcast(before), "_part").withColumn("at", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before"), total


def first_problem(spark: SparkSession, path: str, facts: DataFrame, kind: str) -> EngineError | None:
    """The error of the first bad line, with its number from 1; None if all are good."""
    if facts.where("problem is not null").isEmpty():
        return None
    lines, _ = in_order(spark.read.text(path))  # only on failure: the least of all bad lines
    at, problem = _parsed(lines, kind).where("problem is not null").agg(F.min(F.struct("at", "problem")).alias("x")).head().x
    if problem == "type mismatch":
        return EngineError(f"type mismatch in line {at + 1}")
    return EngineError(f"storage error: line {at + 1}: {problem}")


def chunked(facts: DataFrame, first_layer: int, chunk: int = 256) -> tuple[DataFrame, int]:
    """facts of one file with layer_id, one layer per ``chunk`` lines in file order, and the number of layers."""
    lines, total = in_order(facts)
    layer = F.call_function("div", F.col("at"), F.lit(chunk).cast("long")) + first_layer
    return lines.withColumn("layer_id", layer).drop("at"), -(-total // chunk)
