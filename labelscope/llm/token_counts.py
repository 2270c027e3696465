"""Exact token counts of every prefix of a text, by dynamic programming.

For a byte-pair model whose merges depend on the merged piece alone, a text's
encoding is the only one in which every two neighbours would also stay apart
when encoded by themselves. So the last piece of a prefix's encoding is the one
piece p ending there that stands beside the last piece of the prefix before p,
and

    count(prefix) = count(prefix without p) + size(p)

gives all prefixes in one pass. Pieces never hold a word mark (the model's sign
for a space) after another character, so a text falls apart into stretches, and
a stretch's counts are computed once and remembered. Spaces in a row merge last
and are added by a rule of their own.

A text's table is two binary columns: `prefix_words`, pairs (first character,
tokens before it) of little-endian unsigned 32-bit integers for each stretch,
and `prefix_steps`, one signed byte for each character: how many tokens the
prefix with it has more than the prefix before it. Truncation and budget
questions are answered from them; nothing is encoded again.

Results for odd input: a null text counts as empty, the empty text has no
tokens and empty columns; repeated rows are counted each; columns that clash with
a result's name are replaced, all others stay.
Very long texts take time in proportion to their length; a stretch without
spaces is one pass of the programme as well.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import small_batches

MARK = "▁"
#: Stretches remembered by a worker.
REMEMBERED = 400_000


class PrefixCounter:
    """Prefix counts under a sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size())
                     if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.longest = max(map(len, self.rank))
        joins = {c for piece in self.rank if len(piece) > 1 for c in piece} - {MARK}
        body = "[" + re.escape("".join(sorted(joins))) + "]+"
        self.stretches = re.compile(f"{MARK}*{body}|{MARK}+|[^{MARK}]").findall
        self.blank = max(len(p) for p in self.rank if set(p) == {MARK})
        self._run = [len(self.pieces(MARK * n)) for n in range(self.blank + 1)]
        self._ends = {p[-n:] for p in self.rank for n in range(2, len(p) + 1)}
        self._known: dict[str, bytes] = {}
        self._pairs: dict[str, dict[str, bool]] = {}
        self._n_pairs = 0

    def pieces(self, text: str) -> list[str]:
        """Merges of a short string: best rank first, leftmost among equals."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def beside(self, left: str, right: str) -> bool:
        """Whether two pieces stay apart; an empty left asks whether a piece encodes as itself."""
        found = self.pieces(left + right) == ([left, right] if left else [right])
        if self._n_pairs < REMEMBERED:
            self._n_pairs += 1
            self._pairs.setdefault(right, {})[left] = found
        return found

    def run(self, n: int) -> int:
        """Tokens of n word marks in a row: leftmost merges fill longest pieces one after the other."""
        return n // self.blank + self._run[n % self.blank]

    def steps(self, stretches: list[str]) -> dict[str, bytes]:
        """Signed bytes for each stretch: change of the count with each of its characters.

        In sorted order a stretch starts with the state of its common prefix with
        the one before. Marks before the last one of a stretch merge among
        themselves once the rest is done, and with the last one if it is left bare.
        """
        rank, ends, longest, pairs, beside, run = self.rank, self._ends, self.longest, self._pairs, self.beside, self.run
        out, before = {}, ""
        last, counts, bare = [""], [0], [False]
        for stretch in sorted(stretches):
            blanks = len(stretch) - len(stretch.lstrip(MARK))
            text = stretch[blanks - 1:] if blanks > 1 else stretch
            n, i = len(text), 0
            for i, (a, b) in enumerate(zip(text, before)):
                if a != b:
                    break
            else:
                i = min(n, len(before))
            del last[i + 1:], counts[i + 1:], bare[i + 1:]
            before = text
            while i < n:
                i += 1
                size = 1
                while size < i and size < longest and text[i - size - 1:i] in ends:
                    size += 1
                while True:
                    piece = text[i - size:i]
                    if piece in rank or size == 1:
                        left = last[i - size]
                        near = pairs.get(piece)
                        stays = near.get(left) if near else None
                        if stays is None:
                            stays = beside(left, piece)
                        if stays:
                            break
                    size -= 1
                last.append(piece)
                counts.append(counts[i - size] + (1 if piece in rank else len(piece.encode("utf-8", "surrogatepass"))))
                bare.append(piece == MARK if size == i else bare[i - size])
            full = counts
            if blanks > 1:
                full = [run(k) for k in range(blanks)]
                full += [run(blanks) + c - 1 if alone else run(blanks - 1) + c for c, alone in zip(counts[1:], bare[1:])]
            out[stretch] = bytes([(b - a) & 255 for a, b in zip(full, full[1:])])
        return out

    def tables(self, texts: list[str | None]) -> list[tuple[list[str], list[bytes]]]:
        """Stretches of each text (the leading mark included) and their steps."""
        known = self._known
        parts = [self.stretches(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        found = self.steps(list(set().union(*parts).difference(known)))
        if len(known) < REMEMBERED:
            known.update((k, v) for k, v in found.items() if len(k) < 200)
        get = lambda p: known.get(p) or found[p]
        return [(part, list(map(get, part))) for part in parts]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and model."""
    return PrefixCounter(path)


def prefix_tables(docs: DataFrame, model: str, text: str = "text", limits: tuple[int, ...] = (),
                  tables: bool = True) -> DataFrame:
    """All columns of `docs` with n_tokens, fit_<limit> for every limit, prefix_words and prefix_steps.

    fit_<limit> is the length in characters of the longest prefix of at most
    `limit` tokens. With `tables` off, the two binary columns are left out.
    """
    new = ["n_tokens long", *(f"fit_{n} long" for n in limits), *(["prefix_words binary", "prefix_steps binary"] if tables else [])]
    names = [x.split()[0] for x in new]
    clash = [c for c in docs.columns if c.lower() in names]
    docs = docs.drop(*clash)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        prefix = counter(model)
        for batch in batches:
            totals, fits, words, bodies = [], [[] for _ in limits], [], []
            for parts, steps in prefix.tables(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                flat = np.frombuffer(b"".join(steps), np.int8)
                # the first step belongs to the mark in front: a prefix of one character has it too
                upto = np.cumsum(flat, dtype=np.int32)
                total = int(upto[-1]) if len(upto) else 0
                totals.append(total)
                for n, out in zip(limits, fits):
                    inside = np.flatnonzero(upto[1:] <= n)
                    out.append(int(inside[-1]) + 1 if len(inside) else 0)
                if tables:
                    sizes = np.array([len(p) for p in parts], np.int64)
                    first = np.cumsum(sizes) - sizes
                    before = np.where(first > 0, upto[first - 1], 0) if len(parts) else first
                    words.append(np.stack([np.maximum(first - 1, 0), before], 1).astype("<u4").tobytes())
                    body = flat[1:].copy()
                    if len(body):
                        body[0] += flat[0]
                    bodies.append(body.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(totals, pa.int64()), *(pa.array(x, pa.int64()) for x in fits),
                 *([pa.array(words, pa.binary()), pa.array(bodies, pa.binary())] if tables else [])],
                names=[*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *new])
    return small_batches(docs).mapInArrow(count, schema)


def tokens_upto(table: DataFrame, position: str, out: str = "tokens") -> DataFrame:
    """Tokens of the prefix of `position` characters, read from the prefix table."""
    @F.pandas_udf("long")
    def upto(steps: pd.Series, places: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([int(np.frombuffer(s, np.int8, max(0, min(int(p), len(s)))).sum(dtype=np.int64))
                          for s, p in zip(steps, places)])

    return table.withColumn(out, upto("prefix_steps", F.col(position).cast("long")))


def longest_prefix(table: DataFrame, budget: int, out: str = "fit") -> DataFrame:
    """Length in characters of the longest prefix of at most `budget` tokens, read from the prefix table."""
    @F.pandas_udf("long")
    def fit(steps: pd.Series) -> pd.Series:
        import numpy as np

        found = []
        for s in steps:
            inside = np.flatnonzero(np.cumsum(np.frombuffer(s, np.int8), dtype=np.int32) <= budget)
            found.append(int(inside[-1]) + 1 if len(inside) else 0)
        return pd.Series(found, dtype="int64")

    return table.withColumn(out, fit("prefix_steps"))


def truncated(table: DataFrame, budget: int, text: str = "text", out: str = "truncated") -> DataFrame:
    """The longest prefix of a text of at most `budget` tokens, read from the prefix table."""
    fitted = longest_prefix(table, budget, "_fit")
    return fitted.withColumn(out, F.substring(F.coalesce(F.col(text), F.lit("")), F.lit(1), F.col("_fit").cast("int"))).drop("_fit")
