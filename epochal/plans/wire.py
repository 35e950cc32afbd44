"""Results as one text line each, and back."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from epochal.functions.values import decode, encode


@dataclass
class Result:
    """kind: ok, value, segments, names, grants, layers or status; frame: the lazy rows of a read."""

    kind: str
    frame: DataFrame | None = None
    data: Any = None

    def rows(self) -> list[tuple]:
        """Segments (start, end, value), or layers (id, written_at, min_start, max_end, tau_count), in order."""
        if self.data is None:
            order = ["start"] if self.kind == "segments" else ["_age"] if "_age" in self.frame.columns else ["id"]
            self.data = [tuple(r) for r in self.frame.orderBy(*order).drop("_age").collect()]
        return self.data

    def present(self) -> bool:
        """Whether a point or an aggregate has a value (a stored null is one)."""
        return bool(self._point())

    def scalar(self):
        """The value of a point or an aggregate; None for a null and where there is nothing."""
        held = self._point()
        return held[0][0] if held else None

    def _point(self) -> list[tuple]:
        if self.data is None:
            self.data = [tuple(r) for r in self.frame.limit(1).collect()] if self.frame is not None else []
        return self.data

    def wire(self) -> str:
        match self.kind:
            case "ok":
                return "OK"
            case "value":
                return f"VAL {encode(self.scalar())}" if self.present() else "VAL NIL"
            case "segments":
                return _listed("RANGE", [f"{s}:{e}:{encode(v)}" for s, e, v in self.rows()])
            case "names":
                return _listed("NAMES", self.data)
            case "grants":
                return _listed("GRANTS", [" ".join([u, *(f"{d}:{p}" for d, p in held)]) for u, held in self.data])
            case "layers":
                return _listed("LAYERS", [":".join(map(str, r[:4])) for r in self.rows()])
            case "status":
                return _listed("STATUS", [f"{k}:{v}" for k, v in self.data])
        raise ValueError(self.kind)


def _listed(tag: str, items: list[str]) -> str:
    return "; ".join([f"{tag} {len(items)}", *items])


def parse_line(line: str) -> Result:
    """Inverse of :meth:`Result.wire`; an ERR line raises. Malformed lines raise ValueError."""
    from epochal.functions.values import EngineError

    tag, _, body = line.partition(" ")
    if tag == "ERR":
        raise EngineError(body)
    if tag == "OK" and not body:
        return Result("ok")
    if tag == "VAL":
        return Result("value", data=[] if body == "NIL" else [(decode(body),)])
    count, *items = body.split("; ")
    kinds = {"RANGE": "segments", "NAMES": "names", "GRANTS": "grants", "LAYERS": "layers", "STATUS": "status"}
    if tag not in kinds or not count.isdigit() or int(count) != len(items):
        raise ValueError(f"malformed response: {line!r}")
    match tag:
        case "RANGE":
            data = [(int(s), int(e), decode(v)) for s, e, v in (i.split(":") for i in items)]
        case "LAYERS":
            data = [tuple(map(int, i.split(":"))) for i in items]
        case "GRANTS":
            data = [(w[0], [tuple(g.split(":")) for g in w[1:]]) for w in (i.split(" ") for i in items)]
        case "STATUS":
            data = [tuple(i.split(":", 1)) for i in items]
        case _:
            data = items
    return Result(kinds[tag], data=data)
