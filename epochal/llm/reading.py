"""Reading level of documents by smoothed unigram language models, one per level.

The models are fitted on a bounded sample of rated documents; every document of the corpus
is then scored whole, in one pass without a shuffle. Ratings are noisy, so after a first fit
those that the models contradict are set aside and the models are fitted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm.words import flat_words, numbers, words

MAX_RATED = 20_000  # rated documents used for the fit, chosen by a hash of the id
MAX_RATED_CHARS = 100_000_000  # characters of them in all; the models know every word of the sample


def letters_only(text: str) -> list[str]:
    """Words without digits: numbers, codes and order ids say nothing about the level."""
    return [w for w in words(text) if not any(c.isdigit() for c in w)]


@dataclass
class Models:
    """log P(level) and log P(word | level) for the words of the fit."""

    levels: list[int]
    prior: np.ndarray
    vocabulary: pa.Array
    table: np.ndarray  # float32, words x levels

    def scores(self, codes: np.ndarray, text: np.ndarray, n: np.ndarray | None, texts: int) -> np.ndarray:
        """Unnormalised log posterior, texts x levels, of words (codes) that stand in texts, n times each."""
        out = np.empty((texts, len(self.levels)))
        for c in range(len(self.levels)):
            gain = self.table[codes, c].astype(float)
            out[:, c] = self.prior[c] + np.bincount(text, gain if n is None else gain * n, texts)
        return out


def formula_level(tokens: list[str], sentences: int) -> int:
    """Level 1 to 5 from long words and sentence length alone, for texts of which the models know no word."""
    if not tokens:
        return 1
    score = 0.39 * len(tokens) / max(1, sentences) + 30 * sum(len(w) > 7 for w in tokens) / len(tokens)
    return 1 + sum(score > edge for edge in (4, 7, 11, 16))


def rated_bags(documents: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED, max_chars: int = MAX_RATED_CHARS) -> pa.Table:
    """levels, w, n (words of a document and how often each) of the sample of rated documents with text.

    The sample is taken in the order of a hash of the id, whole documents, up to the two bounds.
    A document's ratings all count, contradicting ones too. Null or out-of-range levels do not.
    """
    rated = labels.where("doc_id is not null and level between 1 and 5").groupBy("doc_id").agg(F.sort_array(F.collect_list("level")).alias("levels"))  # as many as raters
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sizes = texts.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most max_rated
    if sum(r.n for r in sizes) > max_chars:
        upto = np.cumsum([r.n for r in sizes]) <= max_chars
        kept = documents.sparkSession.createDataFrame([(r.doc_id,) for r, k in zip(sizes, upto) if k or r is sizes[0]], "doc_id long")
        texts = texts.join(F.broadcast(kept), "doc_id")
    shape = pa.schema([("levels", pa.list_(pa.int32())), ("w", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])

    def count(batches):
        from collections import Counter

        for batch in batches:
            out = []
            for text, levels in zip(batch.column("text"), batch.column("levels").to_pylist()):
                held = Counter(letters_only(text.as_py()))
                out.append({"levels": levels, "w": list(held), "n": list(held.values())})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return texts.mapInArrow(count, "levels array<int>, w array<string>, n array<long>").toArrow()


def fit(rated: pa.Table, rounds: int = 2, smoothing: float = 0.1) -> Models:
    """Unigram models per level, smoothed towards all levels together.

    rounds: how often the ratings that the models contradict are set aside and the fit repeated.
    """
    bags = rated.column("w").combine_chunks()
    coded = bags.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = rated.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    size = pc.list_value_length(bags).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(bags)), size)
    held = rated.column("levels").to_pylist()
    levels = sorted({level for own in held for level in own})
    of = np.array([k for k, own in enumerate(held) for _ in own], np.int64)
    rating = np.array([levels.index(level) for own in held for level in own], np.int64)
    share = np.array([1 / len(own) for own in held for _ in own])
    kept = len(coded.dictionary)
    use = np.ones(len(of), bool)
    models = Models(levels, np.zeros(0), coded.dictionary, np.zeros((kept, 0), "float32"))
    for turn in range(rounds + 1 if levels else 0):
        weight = np.zeros((len(bags), len(levels)))
        np.add.at(weight, (of[use], rating[use]), share[use])
        count = np.stack([np.bincount(codes, n * weight[text, c], kept) for c in range(len(levels))], axis=1)
        mass = 0.5 + weight.sum(0)
        spread = (count.sum(1) + 1) / (count.sum() + kept + 1)
        strength = smoothing * max(1, kept)
        models.table = np.log((count + strength * spread[:, None]) / (count.sum(0) + strength)).astype("float32")
        models.prior = np.log(mass / mass.sum())
        if turn < rounds:
            guess = models.scores(codes, text, n, len(bags)).argmax(1)
            agreed = guess[of] == rating
            use = agreed if agreed.any() else np.ones(len(of), bool)
    return models


def levels_of(models: Models, texts: pa.Array) -> pa.Array:
    """The level with the highest posterior of each text (none of them null); the lower one of a tie. No word at all: null."""
    flat, counts = flat_words(texts)
    codes = numbers(flat, models.vocabulary) if len(models.vocabulary) else np.full(len(flat), -1)
    text = np.repeat(np.arange(len(counts)), counts)
    known = codes >= 0
    found = np.bincount(text[known], minlength=len(counts)) > 0
    level = np.zeros(len(counts), np.int32)
    none = np.zeros(len(counts), bool)
    if found.any():
        best = models.scores(codes[known], text[known], None, len(counts)).argmax(1)
        level[:] = np.array(models.levels, np.int32)[best]
    for k in np.flatnonzero(~found):  # no word is known
        one = texts[int(k)].as_py()
        tokens = letters_only(one)
        none[k] = not tokens
        level[k] = formula_level(tokens, sum(one.count(c) for c in ".!?;\n") or 1)
    return pa.array(level, pa.int32(), mask=none)


def reading_levels(documents: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED, rounds: int = 2, max_chars: int = MAX_RATED_CHARS) -> DataFrame:
    """doc_id, level (1 to 5) of every document, scored on its whole text.

    Null texts and texts without words have a null level. Texts of which no word is known (also: no
    ratings at all) are graded by a formula of word and sentence length. Repeated rows stay.
    """
    spark = documents.sparkSession
    models = spark.sparkContext.broadcast(fit(rated_bags(documents, labels, max_rated, max_chars), rounds))  # words of the sample at most

    def grade(batches):
        own = models.value
        for batch in batches:
            texts = batch.column("text")
            here = texts.is_valid()
            found = levels_of(own, texts.drop_null())
            levels = pc.replace_with_mask(pa.nulls(batch.num_rows, pa.int32()), here, found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), levels], names=["doc_id", "level"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(grade, "doc_id long, level int")
