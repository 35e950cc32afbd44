"""Words of a text apart from form: markup, case, width, accents, hidden characters and line-end hyphens."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TAG = re.compile(r"<[^<>]*>")
ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
WORD = re.compile(r"[^\W_]+")
BREAK = re.compile(r"(?<=\w)[-‐‑][ \t]*\r?\n[ \t>]*(?=\w)")
LONGEST_ENTITY = 40  # no name or number of a character is longer; what is, stands for none
HARD = r"[^\x00-\x7f]|[<&]|-[ \t]*\r?\n"  # texts that need more than a table of bytes
_HARD = re.compile(HARD)
_PLAIN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))


def _folded(s: str) -> str:
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) not in ("Mn", "Cf")).casefold()


class _Folds(dict):
    """What each character becomes, worked out once."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _folded(chr(code))
        return out


class _Spelling(dict):
    """The same, and a blank for what belongs to no word."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(c if WORD.match(c) else " " for c in FOLDS[code])
        return out


FOLDS, SPELLING = _Folds(), _Spelling()


def _unescaped(m: re.Match) -> str:
    return html.unescape(m[0]) if len(m[0]) <= LONGEST_ENTITY else "\ufffd"


def words(text: str) -> list[str]:
    """Normalised words of the whole text, in order."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = ENTITY.sub(_unescaped, text)
    if "\n" in text:
        text = BREAK.sub("", text.translate(FOLDS))
    return text.translate(SPELLING).split()


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of many texts (none of them null), one after the other, and how many each text has.

    Plain texts are spelled by one table over all their bytes; the others one by one.
    """
    texts = texts.cast(pa.large_string())
    hard = pc.match_substring_regex(texts, HARD)
    table = pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(bytes(texts.buffers()[2] or b"").translate(_PLAIN))], offset=texts.offset)
    if pc.any(hard).as_py():
        spelled = pa.array([" ".join(words(t)) if h else None for t, h in zip(texts.to_pylist(), hard.to_pylist())], pa.large_string())
        table = pc.if_else(hard, spelled, table)
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(table))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    empty = pc.equal(flat, "")
    if pc.any(empty).as_py():  # a text without words
        gone = empty.to_numpy(zero_copy_only=False)
        counts = counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[gone], minlength=len(counts))
        flat = flat.filter(pc.invert(empty))
    return flat, counts


def numbers(flat: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The place of each word in the vocabulary; -1 where it has none."""
    return pc.fill_null(pc.index_in(flat, value_set=vocabulary.cast(flat.type)), -1).to_numpy(zero_copy_only=False)


def placed_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The same words, each with its place (start, end) in the text as given."""
    if not _HARD.search(text):
        found = [(m[0], m.span()) for m in WORD.finditer(text.lower())]
        return [w for w, _ in found], [place for _, place in found]
    out: list[str] = []
    place: list[int] = []
    at = 0

    def put(s: str, i: int) -> None:
        out.append(s)
        place.extend([i] * len(s))

    while at < len(text):
        c = text[at]
        if c == "<" and (m := TAG.match(text, at)):
            put(" ", at)
            at = m.end()
        elif c == "&" and (m := ENTITY.match(text, at)):
            put(_unescaped(m).translate(FOLDS), at)
            at = m.end()
        else:
            put(FOLDS[ord(c)], at)
            at += 1
    joined = "".join(out)
    if "\n" in joined:
        keep, last, parts = [], 0, []
        for m in BREAK.finditer(joined):
            parts.append(joined[last : m.start()])
            keep.extend(range(last, m.start()))
            last = m.end()
        parts.append(joined[last:])
        keep.extend(range(last, len(joined)))
        joined, place = "".join(parts), [place[k] for k in keep]
    spans = [m.span() for m in WORD.finditer(joined)]
    return [joined[a:b] for a, b in spans], [(place[a], place[b - 1] + 1) for a, b in spans]
