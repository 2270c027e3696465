"""Similarity of short texts to label keywords, vectorised over Arrow batches.

A text resembles a keyword when the best of three insert/delete similarities
(whole string, best-aligned part, shared word set) reaches the threshold. The
common-subsequence lengths behind them come from a bit-parallel scan that runs
over all distinct texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import patterns as P

# executors need not have this package installed: the small helper travels whole
for _module in (sys.modules[__name__], P):
    cloudpickle.register_pickle_by_value(_module)

KEYWORD_SETS = [P.MAKER_KEYWORDS, P.AGENT_KEYWORDS, P.CARE_KEYWORDS, P.ORIGIN_KEYWORDS]
MAKER, AGENT, CARE, ORIGIN = 1, 2, 4, 8
MOST_SEEN = 50_000  # texts of up to 40 characters that a task remembers


def _rows(texts: list[str]) -> np.ndarray:
    """Texts as a zero-padded code matrix; characters past one byte become 1."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros((len(texts), sizes.max(initial=0)), dtype=np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.where((codes == 0) | (codes > 255), 1, codes)
    return out


def common_lengths(rows: np.ndarray, word: str) -> np.ndarray:
    """Longest common subsequence of each row with one word (under 64 letters).

    The last axis of `rows` runs over characters; the word is plain ASCII.
    """
    table = np.zeros(256, dtype=np.uint64)
    for i, ch in enumerate(word):
        table[ord(ch)] |= np.uint64(1 << i)
    full = np.uint64((1 << len(word)) - 1)
    state = np.full(rows.shape[:-1], full, dtype=np.uint64)
    for j in range(rows.shape[-1]):
        hit = state & table[rows[..., j]]
        state = (state + hit) | (state - hit)
    return len(word) - np.bitwise_count(state & full).astype(np.int64)


def _ratio(common: np.ndarray, sizes: np.ndarray, word: str) -> np.ndarray:
    return 200.0 * common / (sizes + len(word))


def whole_ratio(rows: np.ndarray, sizes: np.ndarray, word: str) -> np.ndarray:
    return _ratio(common_lengths(rows, word), sizes, word)


def part_ratio(rows: np.ndarray, sizes: np.ndarray, word: str) -> np.ndarray:
    """Best alignment of the shorter string inside the longer, ends included."""
    out = np.zeros(len(rows))
    size = len(word)
    longer = np.flatnonzero(sizes >= size)
    if len(longer):
        # zero padding on both sides turns head and tail parts into windows too
        padded = np.pad(rows[longer], ((0, 0), (size - 1, size - 1)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, size, axis=1)
        lengths = (windows != 0).sum(axis=-1)
        out[longer] = _ratio(common_lengths(windows, word), lengths, word).max(axis=1)
    for length in np.unique(sizes[(sizes <= size) & (sizes > 0)]):
        same = np.flatnonzero(sizes == length)
        inner = [word[i : i + length] for i in range(size - length + 1)]
        ends = [piece for i in range(1, length) for piece in (word[:i], word[-i:])]
        for piece in set(inner + ends):
            out[same] = np.maximum(out[same], whole_ratio(rows[same], sizes[same], piece))
    return out


def word_set_ratio(text: str, word: str) -> float:
    a, b = set(text.split()), set(word.split())
    if not a or not b:
        return 0.0
    both, only_a, only_b = a & b, sorted(a - b), sorted(b - a)
    if both and (not only_a or not only_b):
        return 100.0
    left, right = " ".join(only_a), " ".join(only_b)
    shared = len(" ".join(sorted(both)))
    joint = 1 if shared else 0
    lcs = int(common_lengths(_rows([left]), right)[0]) if left and right else 0
    distance = len(left) + len(right) - 2 * lcs
    size_a, size_b = shared + joint + len(left), shared + joint + len(right)
    best = 100.0 - 100.0 * distance / (size_a + size_b)
    if shared:
        best = max(
            best,
            100.0 - 100.0 * (joint + len(left)) / (shared + size_a),
            100.0 - 100.0 * (joint + len(right)) / (shared + size_b),
        )
    return best


class Batch:
    """Distinct lower-case texts with the encodings that every keyword shares."""

    def __init__(self, texts: list[str]):
        self.texts = [t.lower() for t in texts]
        self.words = [set(t.split()) for t in self.texts]
        ordered = [" ".join(sorted(w)) for w in self.words]
        self.rows, self.sorted_rows = _rows(self.texts), _rows(ordered)
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.sorted_sizes = np.array([len(t) for t in ordered], dtype=np.int64)
        letters = self.rows + 256 * np.arange(len(texts))[:, None]
        counts = np.bincount(letters.ravel(), minlength=256 * len(texts)).reshape(-1, 256)
        self.counts = np.minimum(counts, 100).astype(np.int8)

    def hopeful(self, word: str) -> np.ndarray:
        """Texts that share enough letters with a keyword to reach the threshold.

        A part of length k holds at most min(shared, k) common letters, so the
        best possible ratio against the shorter side of m letters is
        200 * shared / (m + shared).
        """
        letters, need = np.unique(np.frombuffer(word.encode(), dtype=np.uint8), return_counts=True)
        shared = np.minimum(self.counts[:, letters], need.astype(np.int8)).sum(axis=1)
        shorter = np.minimum(self.sizes, len(word))
        return 200.0 * shared >= P.FUZZY_THRESHOLD * (shorter + shared)

    def reaches(self, word: str, at: np.ndarray) -> np.ndarray:
        """Which texts at some places reach the threshold with one keyword, as `scores` tells.

        Alignments are tried only where they can help: a part of length k with l
        common letters has l <= k, and l is at most what the whole text has in
        common, so the bound of `hopeful` holds with that length for `shared`.
        """
        rows, sizes = self.rows[at], self.sizes[at]
        common = common_lengths(rows, word)
        hit = _ratio(common, sizes, word) >= P.FUZZY_THRESHOLD
        shorter = np.minimum(sizes, len(word))
        left = np.flatnonzero(~hit & (200.0 * common >= P.FUZZY_THRESHOLD * (shorter + common)))
        if len(left):
            hit[left] = part_ratio(rows[left], sizes[left], word) >= P.FUZZY_THRESHOLD
        left, parts = np.flatnonzero(~hit), set(word.split())
        if len(left):
            # with no word in common the set similarity is that of the sorted words
            hit[left] = whole_ratio(self.sorted_rows[at[left]], self.sorted_sizes[at[left]], " ".join(sorted(parts))) >= P.FUZZY_THRESHOLD
        for i in left:
            if self.words[at[i]] & parts:
                hit[i] = word_set_ratio(self.texts[at[i]], word) >= P.FUZZY_THRESHOLD
        return hit

    def scores(self, word: str, at: np.ndarray | None = None) -> np.ndarray:
        """Best similarity (0 to 100) of the texts at some places with one keyword."""
        at = np.arange(len(self.texts)) if at is None else at
        parts = set(word.split())
        rows, sizes = self.rows[at], self.sizes[at]
        best = np.maximum(whole_ratio(rows, sizes, word), part_ratio(rows, sizes, word))
        # with no word in common the set similarity is that of the sorted words
        by_words = whole_ratio(self.sorted_rows[at], self.sorted_sizes[at], " ".join(sorted(parts)))
        for i, place in enumerate(at):
            if self.words[place] & parts:
                by_words[i] = word_set_ratio(self.texts[place], word)
        return np.maximum(best, by_words)


def scores(texts: list[str], word: str) -> np.ndarray:
    return Batch(texts).scores(word)


def keyword_bits(texts: list[str]) -> np.ndarray:
    """Bit mask of the keyword sets that each text resembles."""
    bits = np.zeros(len(texts), dtype=np.int32)
    for start in range(0, len(texts), 4096):  # bounds the window matrix, not the input
        batch = Batch(texts[start : start + 4096])
        for n, words in enumerate(KEYWORD_SETS):
            hit = np.zeros(len(batch.texts), dtype=bool)
            for word in words:
                at = np.flatnonzero(batch.hopeful(word) & ~hit)
                if len(at):
                    hit[at] = batch.reaches(word, at)
            bits[start : start + 4096] |= hit.astype(np.int32) << n
    return bits


@F.pandas_udf(IntegerType())
def _bits_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    seen: dict[str, int] = {}  # labels say the same again and again
    for batch in batches:
        codes, distinct = pd.factorize(batch)
        fresh = [t for t in distinct if t not in seen]
        if len(seen) + len(fresh) > MOST_SEEN:
            seen, fresh = {}, list(distinct)
        seen.update(zip(fresh, keyword_bits(fresh).tolist()))
        known = np.array([seen[t] for t in distinct], np.int32)
        yield pd.Series(np.where(codes >= 0, np.append(known, 0)[codes], 0), dtype="int32")


def resembles(text: Column) -> Column:
    """Bit mask (MAKER, AGENT, CARE, ORIGIN) for a line that may be a garbled label.

    Only lines of label length that start no other declaration are compared;
    the rest reach Python as NULL and cost nothing there.
    """
    from .text import found, trimmed

    clean = trimmed(text)
    fits = F.length(clean).between(*P.FUZZY_LENGTH) & ~found(clean, P.OTHER_DECLARATION)
    return F.coalesce(_bits_udf(F.when(fits, clean)), F.lit(0))
