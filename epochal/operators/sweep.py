"""The sweep over the facts of many series at once, on Arrow tables with numpy.

Rows of a table are grouped by series (and piece of a long series). Times of all groups are
ranked into one axis, on which every step is one vector operation over all groups:

* cells: the segments between all bounds of a group;
* paint: the newest fact of every cell. A fact covers cells l to r; written as two overlapping
  runs of a power of two it is put into one table per power, and the tables are pushed down from
  the longest runs to the single cells. Work grows with (facts + cells) times the logarithm of
  the cells, however many facts overlap;
* roll: aggregates of the segments that a window meets, by block prefixes and suffixes at doubling
  block lengths (sum, avg) and by runs of powers of two (min, max).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOW, HIGH = -(1 << 63), (1 << 63) - 1
CHUNK = 1 << 18  # rows that are swept together, but for a longer piece


@dataclass(frozen=True)
class Leaf:
    """What one numbered set of rows stands for.

    kind 'value': facts, of which the newest holds; 'roll': facts of a rolling aggregate over
    [t + begin, t + end); 'point': times that are asked for; 'depth': facts that are counted.
    """

    kind: str = "value"
    function: str = ""
    begin: int = 0
    end: int = 0


@dataclass(frozen=True)
class Sweep:
    """keys; leaves by number; the range; whether gaps are laid out, equal neighbours joined, absent cells kept.

    points: times that bound cells in every series.
    """

    keys: tuple[str, ...]
    leaves: tuple[Leaf, ...]
    start: int | None = None
    end: int | None = None
    cover: bool = False
    merge: bool = False
    keep: bool = False
    points: tuple[int, ...] = ()


def equal_neighbours(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it: nulls are equal, and so are NaNs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if n < 2:
        return np.zeros(max(0, n - 1), bool)
    a, b = column.slice(0, n - 1), column.slice(1)
    if pa.types.is_nested(column.type):
        held = column.to_pylist()
        return np.array([x == y for x, y in zip(held, held[1:])], bool)
    same = pc.fill_null(pc.equal(a, b), False)
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.or_(same, pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def groups(table: pa.Table, by: list[str]) -> np.ndarray:
    """The first row of every run of rows that are equal in the columns ``by``."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    same = np.ones(table.num_rows - 1, bool)
    for c in by:
        same &= equal_neighbours(table.column(c))
    return np.concatenate(([0], np.flatnonzero(~same) + 1))


def in_chunks(batches, by: list[str], rows: int = CHUNK):
    """Tables of whole groups, of about ``rows`` rows each, from batches in which equal groups lie together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            last = int(groups(table, by)[-1])
            if last:
                yield table.slice(0, last)
                table = table.slice(last).combine_chunks()
            held, size = table.to_batches(), table.num_rows
            rows = max(rows, 2 * size if size >= rows else 0)  # one group: wait until there is twice as much
    if held:
        yield pa.Table.from_batches(held)


def longs(column, null: int = 0) -> np.ndarray:
    return pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, null).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x + by, held inside the range of a long."""
    moved = x + np.int64(by)  # wraps where it is replaced
    return np.where(x > HIGH - by, HIGH, moved) if by > 0 else np.where(x < LOW - by, LOW, moved)


def _powers(length: np.ndarray) -> np.ndarray:
    """The exponent of the largest power of two that is no more than each length (at least 1)."""
    return np.frexp(length.astype(np.float64))[1] - 1


def paint(cells: int, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Per cell the highest rank of the runs [left, right) that cover it; -1 where none does."""
    cur = np.full(cells, -1, np.int64)
    if not len(left):
        return cur
    power = _powers(right - left)
    order = np.argsort(power, kind="stable")
    edges = np.searchsorted(power[order], np.arange(int(power.max()) + 2))
    for k in range(int(power.max()), -1, -1):
        own = order[edges[k] : edges[k + 1]]
        if len(own):
            np.maximum.at(cur, left[own], rank[own])
            np.maximum.at(cur, right[own] - (1 << k), rank[own])
        if k:
            half = 1 << (k - 1)
            down = cur.copy()
            np.maximum(down[half:], cur[:-half], out=down[half:])
            cur = down
    return cur


def range_best(rank: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The highest rank in each run [first, last), all of which are not empty."""
    out = np.empty(len(first), rank.dtype)
    if not len(first):
        return out
    power = _powers(last - first)
    table = rank
    for k in range(int(power.max()) + 1):
        here = np.flatnonzero(power == k)
        if len(here):
            out[here] = np.maximum(table[first[here]], table[last[here] - (1 << k)])
        if len(table) > 1 << k:
            table = np.maximum(table[: -(1 << k)], table[1 << k :])
    return out


def range_sum(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The sum of each run [first, last); nothing is subtracted, so that no size of a value harms another run.

    Both ends of a run first differ in one bit: the run is a suffix of one block of that length and a
    prefix of the next.
    """
    out = np.zeros(len(first), x.dtype)
    some = last > first
    single = some & (last - first == 1)
    out[single] = x[first[single]]
    many = np.flatnonzero(some & ~single)
    if not len(many):
        return out
    a, b = first[many], last[many] - 1
    bit = _powers(a ^ b)
    for k in np.unique(bit):
        here = np.flatnonzero(bit == k)
        size = 1 << int(k)
        padded = np.concatenate((x, np.zeros(-len(x) % (2 * size), x.dtype))).reshape(-1, 2, size)
        suffix = np.cumsum(padded[:, 0, ::-1], axis=1)[:, ::-1]
        prefix = np.cumsum(padded[:, 1, :], axis=1)
        block = a[here] // (2 * size)
        out[many[here]] = suffix[block, a[here] % size] + prefix[block, b[here] % size]
    return out


class _Axis:
    """Pairs of a group and a time as numbers in their order."""

    def __init__(self, *times: np.ndarray):
        self.times = np.unique(np.concatenate(times)) if times else np.zeros(0, np.int64)
        self.stride = len(self.times) + 1

    def at(self, group: np.ndarray, time: np.ndarray, side: str = "left") -> np.ndarray:
        return group * self.stride + np.searchsorted(self.times, time, side)

    def group(self, key: np.ndarray) -> np.ndarray:
        return key // self.stride

    def time(self, key: np.ndarray) -> np.ndarray:
        return self.times[key % self.stride]


def _ranks(table: pa.Table, value: str) -> np.ndarray:
    """Rank of each row by layer, then value; nulls are lowest."""
    layer = table.column("layer_id")
    held = pa.table({"l": layer, "v": table.column(value)}) if not pa.types.is_nested(table.column(value).type) else pa.table({"l": layer})
    order = pc.sort_indices(held, sort_keys=[(c, "ascending") for c in held.column_names], null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _newest(table: pa.Table, value: str, rows: np.ndarray, cells: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Per cell the row of the newest of ``rows``, which cover cells left to right; -1 where there is none."""
    wide = right > left
    rows, left, right = rows[wide], left[wide], right[wide]
    if not len(rows):
        return np.full(cells, -1, np.int64)
    rank = _ranks(table.select(["layer_id", value]).take(pa.array(rows)), value)
    best = paint(cells, left, right, rank)
    by_rank = np.empty(len(rows), np.int64)
    by_rank[rank] = rows
    return np.where(best >= 0, by_rank[best], -1)


def _taken(column, rows: np.ndarray) -> pa.Array:
    """Values of rows; null where a row is -1."""
    out = column.take(pa.array(rows, pa.int64(), mask=rows < 0))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def _roll(leaf: Leaf, table: pa.Table, value: str, g: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, there: np.ndarray, cg: np.ndarray, at: np.ndarray):
    """(present, value, bad) of a rolling aggregate at the start of each cell."""
    axis = _Axis(lo[rows], hi[rows])
    keys = np.unique(np.concatenate((axis.at(g[rows], lo[rows]), axis.at(g[rows], hi[rows]))))
    held = rows[there[rows] > 0]
    left, right = np.searchsorted(keys, axis.at(g[held], lo[held])), np.searchsorted(keys, axis.at(g[held], hi[held]))
    won = _newest(table, value, held, len(keys), left, right)
    own = np.flatnonzero(won >= 0)
    start, won = axis.time(keys[own]), won[own]
    stop = axis.time(keys[np.minimum(own + 1, len(keys) - 1)]) if len(own) else start
    sg = axis.group(keys[own])
    a, b = shifted(at, leaf.begin), shifted(at, leaf.end)
    first = np.searchsorted(axis.at(sg, stop), axis.at(cg, a, "right"))
    last = np.searchsorted(axis.at(sg, start), axis.at(cg, b))
    last = np.maximum(first, last) if leaf.begin < leaf.end else first
    n = last - first
    present = n > 0
    kind = table.schema.field(value).type
    numeric = pa.types.is_integer(kind) or pa.types.is_floating(kind)
    column = _taken(table.column(value), won)
    null = column.is_null().to_numpy(zero_copy_only=False)
    nulls = np.concatenate(([0], np.cumsum(null)))
    some_null = nulls[last] > nulls[first]
    f = leaf.function
    if f == "count":
        return present, pa.array(n, pa.int64(), mask=~present), np.zeros(len(n), bool)
    bad = present & (some_null | (not numeric))
    if f in ("min", "max"):
        bad &= n > 1
        usable = present & ~bad
        pick = np.full(len(n), -1, np.int64)
        if numeric and usable.any():
            x = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
            x = x.astype(np.float64 if pa.types.is_floating(kind) else np.int64)
            order = np.argsort(x, kind="stable")
            if f == "min":
                order = order[::-1]  # the smallest ranks highest; NaN, which sorts last, ranks lowest
            elif np.isnan(x).any() if x.dtype.kind == "f" else False:
                order = np.concatenate((order[np.isnan(x[order])], order[~np.isnan(x[order])]))
            rank = np.empty(len(x), np.int64)
            rank[order] = np.arange(len(x))
            pick[usable] = order[range_best(rank, first[usable], last[usable])]
        elif usable.any():
            pick[usable] = first[usable]
        return present, _taken(column, pick), bad
    if not numeric:
        return present, pa.nulls(len(n), kind if f == "sum" else pa.float64()), bad
    x = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
    if f == "sum":
        if x.dtype.kind == "f":
            return present, pa.array(range_sum(x.astype(np.float64), first, last), pa.float64(), mask=~present), bad
        whole = np.concatenate(([0], np.cumsum(x.astype(np.int64))))  # wraps, and so does the difference
        return present, pa.array(whole[last] - whole[first], pa.int64(), mask=~present), bad
    x = x.astype(np.float64)
    span = np.concatenate(([0], np.cumsum(stop - start)))
    inner_first, inner_last = np.minimum(first + 1, last), np.maximum(np.minimum(first + 1, last), last - 1)
    top = range_sum(x * (stop - start), inner_first, inner_last)
    below = (span[inner_last] - span[inner_first]).astype(np.float64)
    for edge in (first, last - 1):
        use = present if edge is first else present & (n > 1)
        i = edge[use]
        part = (np.minimum(stop[i], b[use]) - np.maximum(start[i], a[use])).astype(np.float64)
        top[use] += x[i] * part
        below[use] += part
    with np.errstate(invalid="ignore", divide="ignore"):
        return present, pa.array(top / below, pa.float64(), mask=~present), bad


def run(spec: Sweep, table: pa.Table, edges: dict[int, np.ndarray]) -> pa.Table | None:
    """The cells of one table of whole groups (columns: keys, _h, _b, _leaf, _n, layer_id, lo, hi, v0, v1...).

    edges: of each series that is cut (by its hash _h), the times at which it is; piece _b lies between
    the edges b - 1 and b. A row without bounds fills its piece. Columns of the result: keys, _h, _b,
    start, end, split, _edge, and per leaf p (present), x (value) and for rolling ones bad.
    split = false: the cell continues another across a cut. _edge: it touches a cut.
    """
    firsts = groups(table, ["_h", "_b", *spec.keys])
    sizes = np.diff(np.concatenate((firsts, [table.num_rows])))
    g = np.repeat(np.arange(len(firsts)), sizes)
    lowest, highest = LOW if spec.start is None else spec.start, HIGH if spec.end is None else spec.end
    g_lo, g_hi = np.full(len(firsts), lowest, np.int64), np.full(len(firsts), highest, np.int64)
    cut_lo, cut_hi = np.zeros(len(firsts), bool), np.zeros(len(firsts), bool)
    if edges:
        hashes, boxes = longs(table.column("_h"))[firsts], longs(table.column("_b"))[firsts]
        for i in np.flatnonzero(np.isin(hashes, np.fromiter(edges, np.int64, len(edges)))):
            own, b = edges[int(hashes[i])], int(boxes[i])
            if b > 0 and own[b - 1] > lowest:
                g_lo[i], cut_lo[i] = own[b - 1], True
            if b < len(own) and own[b] < highest:
                g_hi[i], cut_hi[i] = own[b], True
    leaf = longs(table.column("_leaf"))
    fills = table.column("lo").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    lo, hi = longs(table.column("lo")), longs(table.column("hi"))
    lo, hi = np.where(fills, g_lo[g], lo), np.where(fills, g_hi[g], hi)
    there = longs(table.column("_n"), 1)

    bounds: list[tuple[np.ndarray, np.ndarray]] = []  # groups and times

    def bound(group: np.ndarray, time: np.ndarray) -> None:
        inside = (time >= g_lo[group]) & (time < g_hi[group]) if spec.cover else (time >= g_lo[group]) & ((time < g_hi[group]) | ~cut_hi[group])
        bounds.append((group[inside], time[inside]))

    real = ~fills
    for i, one in enumerate(spec.leaves):
        mine = np.flatnonzero((leaf == i) & real)
        offsets = (one.begin, one.end) if one.kind == "roll" else (0,)
        for x in (lo,) if one.kind == "point" else (lo, hi):
            for d in offsets:
                bound(g[mine], shifted(x[mine], -d))
    every = np.arange(len(firsts))
    for p in spec.points:
        bound(every, np.full(len(every), p, np.int64))
    true_bounds = len(bounds)
    if spec.cover:
        bounds += [(every[~cut_lo], g_lo[~cut_lo]), (every[~cut_hi], g_hi[~cut_hi])]
        true_bounds += 2
    bounds += [(every[cut_lo], g_lo[cut_lo]), (every[cut_hi], g_hi[cut_hi])]
    axis = _Axis(*[t for _, t in bounds])
    keyed = [axis.at(*b) for b in bounds]
    keys = np.unique(np.concatenate(keyed))
    if len(keys) < 2 and not any(x.kind == "point" for x in spec.leaves):
        return None
    solid = np.isin(keys, np.concatenate(keyed[:true_bounds]))
    cg, start = axis.group(keys), axis.time(keys)
    ended = np.concatenate((cg[1:] != cg[:-1], [True]))
    end = np.concatenate((start[1:], [0]))
    keep = ~ended
    asked = None
    found: list = []
    for i, one in enumerate(spec.leaves):
        mine = np.flatnonzero(leaf == i)
        value = f"v{i}"
        if one.kind == "point":
            asked = np.isin(keys, axis.at(g[mine], lo[mine]))
            continue
        if one.kind == "roll":
            found.append((*_roll(one, table, value, g, mine, lo, hi, there, cg, start), i))
            continue
        a, b = np.maximum(lo[mine], g_lo[g[mine]]), np.minimum(hi[mine], g_hi[g[mine]])
        proper = b > a
        mine, a, b = mine[proper], a[proper], b[proper]
        left, right = np.searchsorted(keys, axis.at(g[mine], a)), np.searchsorted(keys, axis.at(g[mine], b))
        if one.kind == "depth":
            steps = np.zeros(len(keys) + 1, np.int64)
            np.add.at(steps, left, there[mine])
            np.add.at(steps, right, -there[mine])
            depth = np.cumsum(steps)[:-1]
            found.append((depth > 1, pa.array(depth, pa.int64()), None, i))
            continue
        won = _newest(table, value, mine, len(keys), left, right)
        found.append((won >= 0, won, None, i))
    if asked is not None:
        keep = asked
    if not spec.keep:
        keep &= np.logical_or.reduce([p for p, *_ in found]) if found else False
    cells = np.flatnonzero(keep)
    edge = (cut_lo[cg] & (start == g_lo[cg]) | cut_hi[cg] & (end == g_hi[cg]))[cells]
    if spec.merge:
        (_, won, _, i) = found[0]
        column = _taken(table.column(f"v{i}"), won[cells])
        joined = np.concatenate(([False], equal_neighbours(column) & (cg[cells][1:] == cg[cells][:-1]) & (start[cells][1:] == end[cells][:-1]))) if len(cells) else np.zeros(0, bool)
        head = np.flatnonzero(~joined)
        tail = np.concatenate((head[1:], [len(cells)])) - 1
        edge = np.maximum(edge[head], edge[tail]) if len(head) else edge[head]
        stop = end[cells[tail]]
        cells = cells[head]
    else:
        stop = end[cells]
    if not len(cells):
        return None
    own = firsts[cg[cells]]
    out = {k: table.column(k).take(pa.array(own)) for k in (*spec.keys, "_h", "_b")}
    out |= {"start": pa.array(start[cells]), "end": pa.array(stop), "split": pa.array(solid[cells]), "_edge": pa.array(edge)}
    for present, x, bad, i in found:
        out[f"p{i}"] = pa.array(present[cells])
        out[f"x{i}"] = _taken(table.column(f"v{i}"), x[cells]) if isinstance(x, np.ndarray) else x.take(pa.array(cells))
        if bad is not None:
            out[f"bad{i}"] = pa.array(bad[cells])
    return pa.table(out)


def join_equal(table: pa.Table, keys: list[str]) -> pa.Table:
    """Rows (keys, _h, _b, start, end, value, _edge), in order, with touching neighbours of equal value joined."""
    n = table.num_rows
    if n < 2:
        return table
    start, end = longs(table.column("start")), longs(table.column("end"))
    joined = (start[1:] == end[:-1]) & equal_neighbours(table.column("value"))
    for c in ("_h", "_b", *keys):
        joined &= equal_neighbours(table.column(c))
    head = np.flatnonzero(np.concatenate(([True], ~joined)))
    tail = np.concatenate((head[1:], [n])) - 1
    edge = table.column("_edge").combine_chunks().to_numpy(zero_copy_only=False)
    out = table.take(pa.array(head))
    out = out.set_column(out.schema.get_field_index("end"), "end", pa.array(end[tail]))
    return out.set_column(out.schema.get_field_index("_edge"), "_edge", pa.array(edge[head] | edge[tail]))
