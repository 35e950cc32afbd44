"""Checks of an append, as DataFrame plans: the rows that would break a layer's invariant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.operators import boxes
from epochal.operators.segments import crowded


def inverted(facts: DataFrame) -> DataFrame:
    """Facts without a proper extent on some axis."""
    bad = F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") >= F.col("hi"))
    if "axes" in facts.columns:
        bad = bad | F.exists("axes", lambda a: a["lo"].isNull() | a["hi"].isNull() | (a["lo"] >= a["hi"]))
    return facts.where(bad)


def overlapping(facts: DataFrame, keys: list[str], piece: int | None = None) -> DataFrame:
    """keys, layer_id, start, end: time that more than one fact of a layer covers. A layer of any size is checked in parallel."""
    return crowded(facts, [*keys, "layer_id"], piece)


def colliding_boxes(facts: DataFrame, keys: list[str], piece: int | None = None) -> DataFrame:
    """keys, layer_id, lo, other_lo: boxes of one layer that overlap on every axis; see :func:`boxes.colliding`."""
    return boxes.colliding(facts, keys, piece)
