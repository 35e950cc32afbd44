"""Evaluation texts that leaked into training text.

The passages of all test items form generalised suffix automata over normalised words, each of a
bounded number of words. Every document is streamed through them, whole; the longest matching
lengths over all automata give the exact runs, which nominate passages; a local alignment of each
nominated passage then bridges a few altered words and decides. The corpus is read and spelled once and
never shuffled, and how passages are shared out over automata changes nothing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm.automaton import Automaton
from epochal.llm.words import flat_words, numbers, placed_words, words

SHARD_WORDS = 200_000  # words of passages in one automaton
LABEL = re.compile(r"\s*[^\W\d_][^\s:]{0,30}:(\s|$)")
BLANK = re.compile(r"\n[ \t]*\n")
HELD = 8  # automata that a Python worker keeps; of more, each batch of documents loads one after the other


@dataclass(frozen=True)
class Rules:
    """What counts as a leak and what is removed.

    run: running words of a passage; matched: share of them that must be unaltered.
    weight: the same share with each word weighted by its rarity among the passages, so that wording
    which many passages have in common is no evidence; strict: what it must be where fewer than
    two runs' length of the passage is spanned.
    altered: words altered at most in a shorter piece below ``strict``; it must be ``ahead`` in score (about one
    rare word) of every passage of other wording on its words. An unaltered run of the rule's length needs neither.
    seed: words of an exact run that nominates an item.
    common: share of a suite's items that an instruction has at least.
    cover: a document of which at least this share is leaked is dropped whole.
    """

    run: int = 12
    matched: float = 0.65
    weight: float = 0.65
    strict: float = 0.92
    altered: int = 2
    ahead: float = 1.0
    seed: int = 3
    common: float = 0.1
    cover: float = 0.8


@dataclass
class Index:
    """All passages (each wording once, with the items that hold it), and automata over parts of them.

    shards: (number of the first passage, its automaton). grams: codes of all runs of ``seed`` words.
    """

    items: list[list[int]]
    passages: list[list[int]]
    vocabulary: pa.Array
    rarity: list[float]
    grams: np.ndarray
    shards: list = field(repr=False, default_factory=list)

    def codes(self, spelled: list[str]) -> list[int]:
        return numbers(pa.array(spelled, pa.large_string()), self.vocabulary).tolist() if spelled else []


def asked(block: str) -> bool:
    """Whether a block of an item is what it asks, by form: a question, or a line under a label."""
    return block.rstrip().endswith("?") or LABEL.match(block) is not None


def passages_of(texts: list[str], suites: list[str], rules: Rules) -> list[list[list[str]]]:
    """The passages of each item: all its blocks of text (between blank lines) of at least ``run`` words but two kinds.

    What it asks: the first or last block of several, if it is a question or has a label (:func:`asked`).
    Instructions: blocks that are common in a suite (at least ``common`` of its items, each text once) and stand
    beside differing passages: at least two blocks that are longer and held by fewer items. A passage that
    any number of items share stands beside instructions, which more items hold, beside what they ask, which
    is shorter, or beside the same further paragraphs; so it stays.
    """
    items: dict[tuple, list[tuple[str, ...]]] = {}  # each text of a suite once
    blocks = []
    for text, suite in zip(texts, suites):
        held = [(b, w) for b in BLANK.split(text.replace("\r\n", "\n")) if (w := tuple(words(b)))]
        rim = {0, len(held) - 1} if len(held) > 1 else set()
        own = [w for k, (b, w) in enumerate(held) if not (k in rim and asked(b))]
        blocks.append(own)
        items.setdefault((suite, *(w for _, w in held)), own)
    sizes: dict[str, int] = {}
    spread: dict[tuple, dict[str, int]] = {}
    for key, own in items.items():
        sizes[key[0]] = sizes.get(key[0], 0) + 1
        for b in set(own):
            seen = spread.setdefault(b, {})
            seen[key[0]] = seen.get(key[0], 0) + 1
    held_by = {b: sum(seen.values()) for b, seen in spread.items()}
    frequent = {b for b, seen in spread.items() if held_by[b] > 1 and any(n >= rules.common * sizes[s] for s, n in seen.items())}
    beside: dict[tuple, set[tuple]] = {b: set() for b in frequent}
    for own in items.values():
        for b in frequent.intersection(own):
            beside[b].update(x for x in own if len(x) > len(b) and held_by[x] < held_by[b])
    told = {b for b, others in beside.items() if len(others) > 1}
    return [[list(b) for b in dict.fromkeys(own) if len(b) >= rules.run and b not in told] for own in blocks]


def gram_codes(ids: np.ndarray, seed: int) -> np.ndarray:
    """One number per run of ``seed`` words; different runs may have one number, as only candidates are sought."""
    n = max(0, len(ids) - seed + 1)
    code = np.zeros(n, np.uint64)
    for k in range(seed):
        code = code * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    return code


def build_index(items: list[tuple[int, str]], rules: Rules, shard_words: int = SHARD_WORDS, suites: list[str] | None = None) -> Index:
    """The index of all items (id, text), of one suite unless ``suites`` tells them apart. Items without a passage of at least ``run`` words cannot leak."""
    holders: dict[tuple, set[int]] = {}
    for (i, _), own in zip(items, passages_of([t for _, t in items], suites or [""] * len(items), rules)):
        for p in own:
            holders.setdefault(tuple(p), set()).add(i)
    spread: dict[str, int] = {}
    for p in holders:
        for w in set(p):
            spread[w] = spread.get(w, 0) + 1
    whole = math.log(max(2, len(holders)))
    vocabulary = {w: k for k, w in enumerate(spread)}
    rarity = [max(0.05, math.log(max(2, len(holders)) / spread[w]) / whole) for w in vocabulary]
    passages = [[vocabulary[w] for w in p] for p in holders]
    grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *(gram_codes(np.array(p, np.int64), rules.seed) for p in passages)]))
    index = Index([sorted(own) for own in holders.values()], passages, pa.array(list(vocabulary), pa.large_string()), rarity, grams)
    first, size = 0, 0
    for k, p in enumerate([*passages, None]):
        if k > first and (p is None or size + len(p) > shard_words):
            index.shards.append((first, Automaton(passages[first:k])))
            first, size = k, 0
        size += len(p or ())
    return index


class Walk:
    """Longest matches of one text over all automata: per word the length, and the states of the automata that reach it."""

    def __init__(self, words: int):
        self.length = [0] * words
        self.states: list[list] = [[] for _ in range(words)]  # (automaton, state) of the longest
        self.full: list[list] = [[] for _ in range(words)]  # the same of all that match a whole run

    def add(self, first: int, automaton: Automaton, ids: list[int], rules: Rules) -> None:
        for at, (n, state) in enumerate(automaton.longest(ids)):
            if n < rules.seed:
                continue
            if n > self.length[at]:
                self.length[at], self.states[at] = n, []
            if n == self.length[at]:
                self.states[at].append((first, automaton.places(state)))
            if n >= rules.run:
                self.full[at].append((first, automaton.places(automaton.suffix(state, rules.run))))

    def nominate(self, rules: Rules) -> dict[int, list[tuple[int, int]]]:
        """Passages with exact runs in the text, each with the (first, last) words of those runs, in order.

        A run of the rule's length nominates every passage that holds it, though another matches longer;
        shorter runs nominate the passages of the longest match (a passage that fits worse than another
        on the same words could only count if nearly nothing of it were altered).
        """
        found: dict[int, list[tuple[int, int]]] = {}

        def put(places: list, first: int, last: int) -> None:
            for number in sorted({start + p for start, held in places for p, _ in held}):
                found.setdefault(number, []).append((first, last))

        before = 0
        for at, n in enumerate([*self.length, 0]):
            if rules.seed <= before < rules.run and n != before + 1:
                put(self.states[at - 1], at - before, at - 1)
            if n >= rules.run:
                put(self.full[at], at + 1 - rules.run, at)
            before = n
        return {p: r for p, r in found.items() if _worth(r, rules)}


def nominate(index: Index, ids: list[int], rules: Rules) -> dict[int, list[tuple[int, int]]]:
    walk = Walk(len(ids))
    for first, automaton in index.shards:
        walk.add(first, automaton, ids, rules)
    return walk.nominate(rules)


def _worth(runs: Iterable[tuple[int, int]], rules: Rules) -> bool:
    """Whether runs that lie close together could belong to a leak."""
    total, edge = 0, None
    for first, last in runs:
        if edge is None or first - edge > rules.run:
            total, edge = 0, first - 1
        total += max(0, last - max(first - 1, edge))
        edge = max(edge, last)
        if 2 * total >= rules.run:
            return True
    return False


def align(passage: list[int], rarity: list[float], ids: list[int], reach: int | None = None) -> tuple[float, int, int, int, int, float]:
    """Best local alignment of a passage with a stretch of text.

    (score, first, last, words of the passage spanned, unaltered ones, weighted share of those).
    first and last are positions in the stretch. With ``reach``, what lies so many words after the best is not read.
    """
    p = np.array(passage)
    w = np.array([rarity[x] for x in passage])
    gain, loss = 0.2 + w, 0.45 + 0.55 * w
    skip = np.concatenate(([0.0], np.cumsum(loss)))  # cost of leaving out words of the passage
    score = np.zeros(len(passage) + 1)
    own: dict[int, np.ndarray] = {}  # score of each word of the text against every word of the passage
    scores, opened = [score], []  # of every word: the scores, and those before words of the passage are left out
    top, end, at = 0.0, 0, 0
    for i, x in enumerate(ids):
        if reach is not None and top and i > at + reach:
            break
        if x not in own:
            own[x] = np.where(p == x, gain, -loss)
        pre = score - 0.5  # a word put in
        np.maximum(pre[1:], score[:-1] + own[x], out=pre[1:])
        pre[0] = max(pre[0], 0.0)
        pre += skip
        score = np.maximum.accumulate(pre) - skip
        np.maximum(score, 0.0, out=score)
        scores.append(score)
        opened.append(pre)
        j = int(score.argmax())
        if score[j] > top:
            top, end, at = float(score[j]), j, i
    if not top:
        return 0.0, 0, 0, 0, 0, 0.0
    i, j, hits, weight = at, end, 0, 0.0
    while True:  # back along the best path, to where it began
        pre = opened[i][: j + 1]
        j = len(pre) - 1 - int(pre[::-1].argmax())  # the words after it are left out
        before = scores[i]
        if j and before[j - 1] + own[ids[i]][j - 1] >= before[j] - 0.5:
            j -= 1
            if passage[j] == ids[i]:
                hits, weight = hits + 1, weight + float(w[j])
        if not before[j]:
            break
        i -= 1
    return top, i, at, end - j, hits, weight / max(1e-9, float(w[j:end].sum()))


def piece(passage: list[int], ids: list[int], run: int, altered: int) -> tuple[int, int, int, int] | None:
    """(first, last, unaltered words, place in the passage) of a piece of a passage in a stretch of text, word by word.

    It has at least ``run`` words, the first and last unaltered; of the least altered pieces the longest, or None if
    all have more than ``altered`` altered words.
    """
    same = np.equal.outer(np.array(ids), np.array(passage))
    least = altered + 1
    best = None
    for d in range(run - len(ids), len(passage) - run + 1):
        at = np.flatnonzero(np.diagonal(same, d))
        if len(at) < run - altered:
            continue
        missed = at - np.arange(len(at))
        for k in range(min(least, altered) + 1):
            to = np.searchsorted(missed, missed + k, "right") - 1
            size = at[to] - at + 1
            a = int(size.argmax())
            if size[a] >= run:
                if k < least or size[a] > best[1] - best[0] + 1:
                    first = int(at[a]) + max(0, -d)
                    least, best = k, (first, first + int(size[a]) - 1, int(to[a]) - a + 1, first + d)
                break
    return best


@dataclass(frozen=True)
class Leak:
    """A passage (by number) in words first to last of a text; how much of it, and how well."""

    passage: int
    first: int
    last: int
    spanned: int
    unaltered: int
    score: float
    share: float


def leaks_in(index: Index, ids: list[int], rules: Rules, nominated: dict[int, list[tuple[int, int]]] | None = None) -> list[Leak]:
    """Every leak of the index' passages in one text.

    Where another passage explains the same words better, one that fits them only in part through
    wording common to both does not count; passages that share the words are equal and all count.
    A run of the rule's length without altered words counts whatever lies beside it.
    """
    out, short = [], []
    nominated = nominate(index, ids, rules) if nominated is None else nominated

    def pieced(number: int, a: int, b: int, altered: int) -> tuple[Leak, list[int]] | None:
        """A short piece in words a to b (excluded), and its words in the passage."""
        passage = index.passages[number]
        if (found := piece(passage, ids[a:b], rules.run, altered)) is None:
            return None
        first, last, hits, place = found
        own = passage[place : place + last - first + 1]
        here = ids[a + first : a + last + 1]
        weight = [index.rarity[x] for x in own]
        share = sum(w for w, x, y in zip(weight, own, here) if x == y) / sum(weight)
        return Leak(number, a + first, a + last, len(own), hits, align(passage, index.rarity, here)[0], share), own

    for number, runs in nominated.items():
        passage, margin = index.passages[number], rules.run
        stretches: list[list[int]] = []
        for first, last in runs:
            if stretches and first - margin <= stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], last + margin)
            else:
                stretches.append([first - margin, last + margin])
        lasts = [last for _, last in runs]
        reach = len(passage) + margin
        left = [(max(0, a), min(len(ids), b + 1)) for a, b in stretches]
        while left:  # what no fit has taken yet
            a, b = left.pop()
            own = range(bisect_left(lasts, a), bisect_left(lasts, b + margin))
            if not _worth(((max(a, runs[k][0]), min(b - 1, runs[k][1])) for k in own if runs[k][0] < b), rules):
                continue
            a = max(a, runs[own[0]][0] - margin)
            score, first, last, spanned, hits, share = align(passage, index.rarity, ids[a:b], reach)
            if not score:
                continue
            needed = rules.strict if spanned < 2 * rules.run else rules.weight
            end, first, last = min(b, a + last + 1 + reach), a + first, a + last
            if spanned >= rules.run and hits >= rules.matched * spanned and share >= needed:
                out.append(Leak(number, first, last, spanned, hits, score, share))
            elif (x := pieced(number, a, end, rules.altered)) is not None:
                first, last = x[0].first, x[0].last
                if x[0].unaltered == x[0].spanned:
                    out.append(x[0])
                else:
                    short.append(x)
            left += [(last + 1, b), (a, first)]

    def outdone(x: Leak) -> bool:
        if x.unaltered == x.spanned == x.last - x.first + 1:
            return False
        here = ids[x.first : x.last + 1]
        rivals = {y.passage for y in out if y.score > x.score and 2 * (min(x.last, y.last) - max(x.first, y.first)) >= x.last - x.first}
        return any(align(index.passages[r], index.rarity, here)[0] > 1.001 * x.score for r in rivals)

    def explained(x: Leak, own: list[int]) -> bool:
        here, n = ids[x.first : x.last + 1], len(own)
        for number in nominated:
            passage = index.passages[number]
            if number != x.passage and not any(passage[k : k + n] == own for k in range(len(passage) - n + 1)):
                if align(passage, index.rarity, here)[0] > x.score - rules.ahead:
                    return True
        return False

    kept = []
    for x in out:
        if not outdone(x):
            kept.append(x)
        elif (exact := pieced(x.passage, x.first, x.last + 1, 0)) is not None:
            kept.append(exact[0])
    return kept + [x for x, own in short if not explained(x, own)]


def candidates(index: Index, codes: np.ndarray, counts: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Texts that could hold a leak, and all words' codes with those in no run of ``seed`` words of a passage set to -1.

    codes: of the words of many texts, one after the other. A leak needs half a run's words in such runs.
    """
    text = np.repeat(np.arange(len(counts)), counts)
    n, seed = len(codes), rules.seed
    covered = np.zeros(n, bool)
    if n >= seed and len(index.grams):
        whole = text[: n - seed + 1] == text[seed - 1 :]
        for k in range(seed):
            whole &= codes[k : n - seed + 1 + k] >= 0
        at = np.flatnonzero(whole)
        code = gram_codes(codes.astype(np.int64), seed)[at]
        place = np.minimum(np.searchsorted(index.grams, code), len(index.grams) - 1)
        at = at[index.grams[place] == code]
        for k in range(seed):
            covered[at + k] = True
    enough = 2 * np.bincount(text[covered], minlength=len(counts)) >= rules.run
    return np.flatnonzero(enough), np.where(covered, codes, -1)


def leaks_of(index: Index, shards: list, texts: pa.Array, rules: Rules) -> dict[int, list[tuple[Leak, int, int]]]:
    """Of each text (by place; none is null) that holds any: its leaks, with their first and last characters.

    shards: functions that give (number of the first passage, automaton), called one after the other.
    """
    flat, counts = flat_words(texts)
    likely, codes = candidates(index, numbers(flat, index.vocabulary), counts, rules)
    if not len(likely):
        return {}
    ends = np.cumsum(counts)
    narrow = {int(k): codes[ends[k] - counts[k] : ends[k]].tolist() for k in likely}
    walks = {k: Walk(len(ids)) for k, ids in narrow.items()}
    for shard in shards:
        first, automaton = shard()
        for k, ids in narrow.items():
            walks[k].add(first, automaton, ids, rules)
    out = {}
    for k, walk in walks.items():
        if not (nominated := walk.nominate(rules)):
            continue
        spelled, places = placed_words(texts[k].as_py())
        if found := leaks_in(index, index.codes(spelled), rules, nominated):
            out[k] = [(x, places[x.first][0], places[x.last][1]) for x in found]
    return out


def _scanner(spark, items: DataFrame, rules: Rules, shard_words: int):
    """A function of texts that gives their leaks, for use in tasks; and the index (None: there are no passages)."""
    suite = F.coalesce(F.col("suite").cast("string"), F.lit("")) if "suite" in items.columns else F.lit("")
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", suite.alias("suite")).orderBy("item_id", "text", "suite")
    held = rows.collect()  # the test suites, not the corpus
    index = build_index([(r.item_id, r.text) for r in held], rules, shard_words, [r.suite for r in held])
    if not index.shards:
        return None
    held = [spark.sparkContext.broadcast(s) for s in index.shards]  # each bounded by SHARD_WORDS
    index.shards = []
    bare = spark.sparkContext.broadcast(index)

    def scan(texts: pa.Array) -> dict[int, list[tuple[Leak, int, int]]]:
        def load(b):
            out = b.value
            if len(held) > HELD:
                b.__dict__.pop("_value", None)  # read again from the local copy when it is needed next
            return out

        return leaks_of(bare.value, [lambda b=b: load(b) for b in held], texts, rules)

    def items_of(leak: Leak) -> list[int]:
        return bare.value.items[leak.passage]

    return scan, items_of


def find_leaks(documents: DataFrame, items: DataFrame, rules: Rules = Rules(), shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, spanned, unaltered, first_char, last_char: every leak of every document.

    Items that share a passage are all reported, however many; instructions and what is asked beside the
    passages do not count (:func:`passages_of`). Null and empty texts contain nothing; texts of any length
    are read whole. A document or item given twice is reported once. No rows give no rows.
    """
    whole = ["doc_id", "item_id", "spanned", "unaltered", "first_char", "last_char"]
    shape, schema = pa.schema([(c, pa.int64()) for c in whole]), ", ".join(f"{c} long" for c in whole)
    spark = documents.sparkSession
    scanner = _scanner(spark, items, rules, shard_words)
    if scanner is None:
        return spark.createDataFrame([], schema)
    scan, items_of = scanner

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[k], i, x.spanned, x.unaltered, a, b) for k, held in scan(batch.column("text")).items() for x, a, b in held for i in items_of(x)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=shape)

    narrow = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, schema).distinct()


def leaked_pairs(documents: DataFrame, items: DataFrame, rules: Rules = Rules(), shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id of every document and test item that leaked into it."""
    return find_leaks(documents, items, rules, shard_words).select("doc_id", "item_id").distinct()


def without(text: str, spans: list[tuple[int, int]], cover: float) -> tuple[str | None, int]:
    """What is left of a text without the spans, and how many characters are gone; None if at least ``cover`` of it is."""
    kept, at, removed = [], 0, 0
    for a, b in sorted(spans):
        a = max(at, a)
        if b > a:
            kept.append(text[at:a])
            removed += b - a
            at = b
    return (None, len(text)) if removed >= cover * len(text) else ("".join(kept) + text[at:], removed)


def remove_leaks(documents: DataFrame, items: DataFrame, rules: Rules = Rules(), shard_words: int = SHARD_WORDS) -> DataFrame:
    """The corpus without leaks: spans are cut out; documents covered beyond ``cover`` are dropped.

    All columns are kept; ``removed_chars`` is added (it may not exist before). Documents without leaks,
    those with a null id or text included, pass unchanged; each row is judged by its own text. The corpus is
    read once: what is found in a batch is cut from it.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    scanner = _scanner(documents.sparkSession, items, rules, shard_words)
    if scanner is None:
        return documents.withColumn("removed_chars", F.lit(0).cast("long"))
    scan, _ = scanner
    schema = StructType([*documents.schema.fields, StructField("removed_chars", LongType())])
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            places = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            removed, kept = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
            new: dict[int, str] = {}
            for k, held in scan(texts.drop_null()).items():
                k = int(places[k])
                text, removed[k] = without(texts[k].as_py(), [(a, b) for _, a, b in held], rules.cover)
                if text is None:
                    kept[k] = False
                else:
                    new[k] = text
            if new:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(new)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[k] for k in sorted(new)], texts.type))
            columns = [texts if i == at else c for i, c in enumerate(batch.columns)] + [pa.array(removed)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "removed_chars"]).filter(pa.array(kept))

    return documents.mapInArrow(run, schema)
