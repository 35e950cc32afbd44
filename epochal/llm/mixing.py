"""Mixing sources to target weights by minimum-cost flow over membership patterns.

Texts are grouped by the set of sources that hold a copy. The sizes of these patterns (at
most 2^sources, whatever the corpus) are routed to the sources' quotas; using a text once
more costs more each time, so that repetition is spread before it is deepened. The flow
is then laid around a circle of each pattern's texts, in a seeded order, so that every text
is used equally often but for one.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BUCKETS = 4096  # of the seeded order of each pattern; only one of them is ever sorted in a task
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how text is split before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_SOURCES = 20
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(spark: SparkSession, text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of the whole text; null has none, strings of special tokens are ordinary text.

    path: the rank file, where the driver sees it; it is shipped to the executors.
    """
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        from pyspark import SparkFiles

        encoder = _encoder(SparkFiles.get(name))
        return pd.Series([0 if t is None else len(encoder.encode_ordinary(t)) for t in texts], dtype="int64")

    return count(text)


def source_name(source: Column) -> Column:
    """One spelling per source: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


@dataclass
class Target:
    source: str
    share: float
    repeats: int


def min_cost_flow(supply: dict[int, int], quota: list[int], repeats: list[int]) -> dict[tuple[int, int], int]:
    """Tokens that each pattern (a bit mask of sources) gives each source.

    A pattern may give a source ``repeats`` times its size. Its r-th use in all costs r, so the cost
    is convex. As much quota as can be is filled, at the least cost (successive shortest paths).
    """
    masks = sorted(supply)
    sink, head = len(masks) + len(quota) + 1, len(masks) + 1
    to, room, cost, out = [], [], [], [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, c: int) -> None:
        for x, y, cap in ((a, b, c), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            room.append(cap)
            cost.append(0)

    used, most = [0] * len(masks), []  # arc 2 k is that of pattern k: its flow, and the most there may be

    def reprice(k: int) -> None:
        """The next token of a pattern costs as many uses as all its tokens have had, the last one what it has cost."""
        size, flow = supply[masks[k]], used[k]
        uses, last = flow // size, max(0, flow - 1) // size
        room[2 * k], cost[2 * k] = min(most[k], size * (uses + 1)) - flow, uses
        room[2 * k + 1], cost[2 * k + 1] = flow - size * last if flow else 0, -last

    for k, mask in enumerate(masks):
        most.append(supply[mask] * sum(r for s, r in enumerate(repeats) if mask >> s & 1))
        arc(0, k + 1, 0)
        reprice(k)
    arcs = {}
    for k, mask in enumerate(masks, 1):
        for s in (s for s in range(len(quota)) if mask >> s & 1):
            arcs[mask, s] = len(to)
            arc(k, head + s, supply[mask] * repeats[s])
    for s, q in enumerate(quota):
        arc(head + s, sink, q)
    rank = [0] * (sink + 1)
    while True:
        dist: list[float] = [float("inf")] * (sink + 1)
        via = [-1] * (sink + 1)
        dist[0] = 0
        heap = [(0, 0)]
        while heap:
            d, v = heappop(heap)
            if d > dist[v]:
                continue
            for e in out[v]:
                if room[e] and (new := d + cost[e] + rank[v] - rank[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = new, e
                    heappush(heap, (new, to[e]))
        if via[sink] < 0:
            break
        rank = [r + (d if d < float("inf") else 0) for r, d in zip(rank, dist)]
        path, v = [], sink
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            if e < 2 * len(masks):
                used[e >> 1] += -push if e & 1 else push
                reprice(e >> 1)
            else:
                room[e] -= push
                room[e ^ 1] += push
    return {key: room[e ^ 1] for key, e in arcs.items() if room[e ^ 1]}


def distinct_texts(documents: DataFrame, names: list[str], vocabulary: str) -> DataFrame:
    """One row per distinct text: key, mask (sources that hold it), size in tokens, and its copy per source.

    Documents of other sources and null or empty texts have no place in a mix. A text with a third of
    all copies is pre-aggregated to one row per task.
    """
    bit = F.coalesce(*[F.when(F.col("source") == n, F.lit(1 << k)) for k, n in enumerate(names)])
    known = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where(F.col("source").isin(names) & (F.length("text") > 0))
    held = known.select("doc_id", bit.cast("long").alias("bit"), F.sha2("text", 256).alias("key"), token_count(documents.sparkSession, F.col("text"), vocabulary).alias("size"))
    copies = [F.min(F.when(F.col("bit") == 1 << k, F.col("doc_id"))).alias(f"doc_{k}") for k in range(len(names))]
    return held.groupBy("key").agg(F.bit_or("bit").alias("mask"), F.max("size").alias("size"), *copies).where("size > 0")


def _circle(texts: DataFrame, seed: int) -> DataFrame:
    """texts with ``at``: tokens of the pattern's texts before it, in an order given by the seed."""
    order = F.xxhash64(F.lit(seed), "key")
    placed = texts.withColumn("order", order).withColumn("box", F.pmod(F.shiftrightunsigned("order", 20), F.lit(BUCKETS)).cast("int"))
    boxes = placed.groupBy("mask", "box").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("mask").orderBy("box").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = boxes.select("mask", "box", before.alias("start"))  # at most BUCKETS rows per pattern
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("mask", "box").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("inside", inside).join(starts, ["mask", "box"]).withColumn("at", F.col("start") + F.col("inside"))


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 11, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, source, tokens, repeats: the documents of the mix and how often each is used.

    targets: source, target_share, max_repeats (repeated rows count once; shares are scaled to sum to 1;
    null or non-positive shares or repeats give a source no part). budget: tokens of the mix; by
    default the most that all sources can fill at their shares within their repeats, each on its own.
    A text in several sources is one text: each use takes from one of them. Sources that cannot fill
    their quota give all they may, and :func:`shares` shows it. Nothing to mix gives no rows.
    """
    from epochal.runtime import cut_lineage

    spark = documents.sparkSession
    goals = _targets(targets)
    empty = spark.createDataFrame([], "doc_id long, source string, tokens long, repeats long")
    if not goals:
        return empty
    texts = cut_lineage(distinct_texts(documents, [g.source for g in goals], vocabulary))
    supply = {r["mask"]: int(r["n"]) for r in texts.groupBy("mask").agg(F.sum("size").alias("n")).collect()}  # one row per pattern
    if not supply:
        return empty
    quota = _quotas(supply, goals, budget)
    flow = min_cost_flow(supply, quota, [g.repeats for g in goals])
    arcs, begin = [], {}
    for (mask, s), tokens in sorted(flow.items()):
        start = begin.get(mask, 0)
        arcs.append((mask, s, start, tokens, supply[mask]))
        begin[mask] = (start + tokens) % supply[mask]
    if not arcs:
        return empty
    plan = spark.createDataFrame(arcs, "mask long, s int, arc_start long, arc long, around long")
    ahead = F.pmod(F.col("at") - F.col("arc_start"), F.col("around"))  # from the arc's start to the text
    full = F.call_function("div", F.col("arc"), F.col("around"))
    uses = full + F.when(ahead < F.pmod(F.col("arc"), F.col("around")), 1).otherwise(0)
    doc = F.coalesce(*[F.when(F.col("s") == k, F.col(f"doc_{k}")) for k in range(len(goals))])
    name = F.element_at(F.array(*[F.lit(g.source) for g in goals]), F.col("s") + 1)
    used = _circle(texts, seed).join(F.broadcast(plan), "mask").select(doc.alias("doc_id"), name.alias("source"), F.col("size").alias("tokens"), uses.cast("long").alias("repeats"))
    return used.where("repeats > 0")


def _targets(targets: DataFrame) -> list[Target]:
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    held = {r.source: r for r in rows.orderBy("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()}
    if len(held) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    whole = sum(r.target_share for r in held.values())
    return [Target(r.source, r.target_share / whole, r.max_repeats) for r in held.values()]


def _quotas(supply: dict[int, int], goals: list[Target], budget: int | None) -> list[int]:
    if budget is None:
        reach = [sum(n for m, n in supply.items() if m >> k & 1) * g.repeats / g.share for k, g in enumerate(goals)]
        budget = int(min((r for r in reach if r), default=0))
    return [round(budget * g.share) for g in goals]


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, most_repeats: one row per target source."""
    goals = _targets(targets)
    spark = mixed.sparkSession
    by = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    frame = spark.createDataFrame([(g.source, g.share, g.repeats) for g in goals], "source string, target_share double, max_repeats int")
    joined = F.broadcast(frame).join(by, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy())  # as many rows as sources
    return joined.select("source", "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"), "tokens", "documents", "most_repeats", "max_repeats")
