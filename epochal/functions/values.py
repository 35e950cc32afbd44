"""Value types of a lens: names, Spark types, literals and the text codec."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

# The declared types and what they are in Spark.
SPARK_TYPES = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}
KINDS = {v: k for k, v in SPARK_TYPES.items()}
LOW, HIGH = -(1 << 63), (1 << 63) - 1

Value = int | float | str | bool | None


class EngineError(Exception):
    """An error that a statement reports to its caller."""


def kind_of(value: Value) -> str | None:
    """int, float, str or bool; None for a null."""
    if value is None:
        return None
    return {bool: "bool", int: "int", float: "float", str: "str"}[type(value)]


def check_type(value: Value, kind: str) -> None:
    """A null fits everywhere; nothing is converted, not even an int into a float."""
    if value is not None and kind_of(value) != kind:
        raise EngineError(f"type mismatch: expected {kind}, got {kind_of(value)}")


def _number(x: float) -> str:
    return str(int(x)) if x == x and abs(x) != float("inf") and x == int(x) and abs(x) < 1e16 else repr(x)


def encode(value: Value) -> str:
    """One word per value: i42, f3.14, b1, n, and text after an s with blank, colon and percent escaped."""
    match value:
        case None:
            return "n"
        case bool():
            return f"b{int(value)}"
        case int():
            return f"i{value}"
        case float():
            return f"f{_number(value)}"
    return "s" + value.replace("%", "%25").replace(" ", "%20").replace(":", "%3A")


def decode(word: str) -> Value:
    """Inverse of :func:`encode`."""
    tag, body = word[:1], word[1:]
    if tag == "n" and not body:
        return None
    if tag == "b" and body in ("0", "1"):
        return body == "1"
    if tag == "i":
        return int(body)
    if tag == "f":
        return float(body)
    if tag == "s":
        return body.replace("%3A", ":").replace("%20", " ").replace("%25", "%")
    raise ValueError(f"invalid value {word!r}")


@contextmanager
def wrapping(spark: SparkSession):
    """Plans analysed inside have integers that wrap and divisions that do not raise by themselves."""
    held = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", held)
