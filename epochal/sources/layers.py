"""The layer table of a database: Parquet parts per lens, laid out by time, and the list of those that count.

Small appends are held on the driver (and in the engine's journal, if it has one) and written together;
frames are written as they are. A part is sorted by begin, and its extent in time is kept, so that a read
leaves out the parts, and the row groups in a part, that lie elsewhere. A part is visible once its lens lists
it. When a lens has many parts, the smallest are merged into one.
"""

from __future__ import annotations

import copy
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, _parse_datatype_string

from epochal.functions.values import SPARK_TYPES
from epochal.runtime import Files, scratch

HELD_ROWS = 4096  # facts of a lens that are held on the driver before they are written
MOST_PARTS = 32  # of a lens, before the smallest are merged
AXES = ArrayType(StructType([StructField("lo", LongType()), StructField("hi", LongType())]))


def schema_of(kind: str) -> StructType:
    return StructType(
        [StructField(c, LongType()) for c in ("layer_id", "written_at", "lo", "hi")] + [StructField("axes", AXES), StructField("value", _parse_datatype_string(SPARK_TYPES[kind]))]
    )


@dataclass
class Part:
    """A directory of Parquet files: how many facts, and the time from the first begin to the last end."""

    path: str
    rows: int
    lo: int
    hi: int


@dataclass
class Held:
    """parts, the rows held on the driver, and of those how many the journal has."""

    kind: str
    parts: list[Part] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    layers: int = 0
    logged: int = 0

    def state(self, whole: bool) -> dict:
        """What the journal keeps; rows that it has already are left out unless ``whole``."""
        since = 0 if whole else min(self.logged, len(self.rows))
        return {"kind": self.kind, "parts": [asdict(p) for p in self.parts], "layers": self.layers, "since": since, "rows": self.rows[since:]}

    @classmethod
    def of(cls, state: dict, before: Held | None) -> Held:
        rows = (before.rows[: state["since"]] if before else []) + [tuple(r) for r in state["rows"]]
        return cls(state["kind"], [Part(**p) for p in state["parts"]], rows, state["layers"], len(rows))


class LayerTable:
    """changed: the lenses that changed since the engine last looked."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "layers")
        self.lenses: dict[str, Held] = {}
        self.changed: set[str] = set()

    def snapshot(self) -> dict[str, Held]:
        return copy.deepcopy(self.lenses)

    def restore(self, lenses: dict[str, Held]) -> None:
        self.changed |= set(self.lenses) | set(lenses)
        self.lenses = lenses

    def create(self, lens: str, kind: str) -> None:
        self.lenses[lens] = Held(kind)
        self.changed.add(lens)

    def drop(self, lens: str) -> None:
        """Only the list changes: a lens of the same name begins without the old parts."""
        del self.lenses[lens]
        self.changed.add(lens)

    def append_rows(self, lens: str, rows: list[tuple]) -> None:
        """rows: (layer_id, written_at, lo, hi, axes, value) of one layer."""
        held = self.lenses[lens]
        held.rows += rows
        held.layers += bool(rows)
        self.changed.add(lens)
        if len(held.rows) > HELD_ROWS:
            self.flush(lens)

    def _write(self, lens: str, frame: DataFrame, small: bool = False) -> Part:
        """A new part. Facts are laid out by their begin: in files by range, in each file in order."""
        schema = schema_of(self.lenses[lens].kind)
        path = f"{self.path}/{lens}/part-{uuid.uuid4().hex}"
        rows = frame.select([F.col(f.name).cast(f.dataType) for f in schema])
        laid = rows.coalesce(1) if small else rows.repartitionByRange("lo")
        laid.sortWithinPartitions("lo", "hi").write.parquet(path)
        found = self.spark.read.schema(schema).parquet(path).agg(F.count(F.lit(1)), F.min("lo"), F.max("hi")).head()
        return Part(path, found[0], found[1] or 0, found[2] or 0)

    def append_frame(self, lens: str, frame: DataFrame, layers: int = 1) -> int:
        """Writes a frame in the lens' schema as one part; its number of facts."""
        part, held = self._write(lens, frame), self.lenses[lens]
        if part.rows:
            held.parts.append(part)
            held.layers += layers
            self.changed.add(lens)
            self._merge_parts(lens)
        return part.rows

    def flush(self, lens: str) -> None:
        """The rows held on the driver become a part."""
        held = self.lenses[lens]
        if held.rows:
            held.parts.append(self._write(lens, self.spark.createDataFrame(held.rows, schema_of(held.kind)), small=True))
            held.rows, held.logged = [], 0
            self.changed.add(lens)
            self._merge_parts(lens)

    def _merge_parts(self, lens: str) -> None:
        """Many parts become fewer: the smaller three quarters are written as one. The facts stay as they are."""
        held = self.lenses[lens]
        if len(held.parts) <= MOST_PARTS:
            return
        small = sorted(held.parts, key=lambda p: p.rows)[: 3 * len(held.parts) // 4]
        merged = self._write(lens, self._read(held, small))
        held.parts = [p for p in held.parts if p not in small] + [merged]

    def replace(self, lens: str, frame: DataFrame, layers: int) -> None:
        """The lens consists of ``frame`` alone (compaction); the old parts stay until nothing reads them."""
        part = self._write(lens, frame)
        self.lenses[lens] = Held(self.lenses[lens].kind, [part] if part.rows else [], [], layers)
        self.changed.add(lens)

    def _read(self, held: Held, parts: list[Part]) -> DataFrame:
        return self.spark.read.schema(schema_of(held.kind)).parquet(*[p.path for p in parts])

    def facts(self, lens: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """All facts of a lens but those of parts and held rows that lie outside [start, end)."""
        held = self.lenses[lens]
        within = lambda lo, hi: (end is None or lo < end) and (start is None or hi > start)
        parts = [p for p in held.parts if within(p.lo, p.hi)]
        rows = [r for r in held.rows if within(r[2], r[3])]
        small = self.spark.createDataFrame(rows, schema_of(held.kind)) if rows or not parts else None
        if not parts:
            return small
        stored = self._read(held, parts)
        return stored if small is None else stored.unionAll(small)

    def collect_garbage(self) -> int:
        """Deletes the parts that no lens lists; how many. Frames that were made before may still read them."""
        files = Files(self.spark, self.path)
        used = {p.path.rsplit("/", 1)[-1] for held in self.lenses.values() for p in held.parts}
        gone = 0
        for lens in files.names(self.path):
            for part in files.names(f"{self.path}/{lens}"):
                if part not in used:
                    files.delete(f"{self.path}/{lens}/{part}")
                    gone += 1
        return gone
