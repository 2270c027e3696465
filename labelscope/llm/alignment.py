"""Alignment of two tokenizations of the same texts by the byte ranges of their tokens.

Both tokenizers' tokens are laid over one byte string, a space and the text.
pandas `merge_asof`, run on a batch and keyed by document, gives for the start
of every token the other side's token that covers it. The later start of two
overlapping ranges lies inside the other one, so the union of both directions is
every overlap. Overlaps whose ends are equal are links; the equal ends cut both
sides into groups.

An id pair's count is the number of its links in all documents. In a link the
shorter token is a suffix of the longer, so the number of different pairs is
bounded by the two vocabularies (`pair_bound`), whatever the corpus holds: that
bound, not the data, decides whether the counts are broadcast.

The first tokenizer is a byte-level BPE file of the tokenizers library. Where
its merges are in the order of their ids and its pattern is the usual one, its
vocabulary is run as ranks by tiktoken, which gives the same ids (tests compare
them) five times faster; texts with very long white space go to the library
itself. The second is a sentencepiece model with byte fallback.

Results for odd input: null and empty texts, and texts that either side's tokens
don't spell byte for byte (a text that holds the sign the second side uses for
spaces, say), have no tokens: zeros and ''. Rows that repeat or share a doc_id
are aligned each; their links are counted each. Very long texts take memory in
proportion to their own tokens; a batch is cut into parts of PART_BYTES. An
empty table gives no rows. Columns of `docs` besides doc_id and text are ignored,
so none can clash.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import materialize, small_batches

#: Text that is aligned at a time.
PART_BYTES = 2 << 20
#: Id pairs that may be broadcast: some 16 MB.
BROADCAST_PAIRS = 1_000_000
#: White space in a row from which texts go to the library itself.
LONG_SPACE = re.compile(r"\s{500}")
#: Ids of either side stay below.
SHIFT = 20
MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Ids, and each id's bytes, of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True  # their strings are ordinary text
        vocab = self._library.get_vocab(with_added_tokens=False)
        letters = byte_letters()
        added = self._library.get_added_tokens_decoder()
        self.bytes = [b""] * (1 + max([*vocab.values(), *added]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(letters.__getitem__, token)) if i not in added else token.encode()
        self._fast = self._as_ranks(path, {i: b for i, b in enumerate(self.bytes) if b and i not in added})

    def _as_ranks(self, path: str, tokens: dict[int, bytes]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        order = [model["vocab"][a + b] for a, b in pairs]
        usual = (split == split | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and not spec["normalizer"]
                 and not model["dropout"] and all(a < b for a, b in zip(order, order[1:])))
        if not usual:
            return None
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks={b: i for i, b in tokens.items()})

    def encode(self, text: str):
        import numpy as np

        if self._fast is None or LONG_SPACE.search(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self._fast.encode_ordinary(text), np.int64)


class Pieces:
    """Ids, and each id's bytes, of a sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self._model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        if self._model.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace(MARK, " ").encode("utf-8")

    def encode(self, text: str):
        import numpy as np

        return np.array(self._model.encode(text), np.int64)


class Aligner:
    """Token ids of both sides and what their byte ranges say."""

    def __init__(self, first: str, second: str):
        import numpy as np

        self.a, self.b = ByteLevel(first), Pieces(second)
        self._sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        # an id's decimal digits with what follows it: the next id, the other side, the next group
        self._printed = [f"{i}{end}".encode() for end in ",|;" for i in range(1 << 16)]

    def pair_bound(self) -> int:
        """Most id pairs that can ever be linked: one token's bytes end with the other's."""
        first, second = set(self.a.bytes), set(self.b.bytes)
        ends = lambda xs, others: sum(x[k:] in others for x in xs for k in range(len(x)))
        repeated = len(self.a.bytes) - len(first) + len(self.b.bytes) - len(second)  # ids with equal bytes
        return (ends(first, second) + ends(second, first)) * (1 + bool(repeated)) + repeated

    def ids(self, text: str | None):
        """Ids of both sides, or None where they don't spell the text."""
        if not text:
            return None
        whole = (" " + text).encode("utf-8")
        a, b = self.a.encode(" " + text), self.b.encode(text)
        for side, ids in ((self.a, a), (self.b, b)):
            if b"".join(map(side.bytes.__getitem__, ids.tolist())) != whole:
                return None
        return a, b

    def overlaps(self, docs: list) -> dict:
        """Overlapping token pairs of a list of ids(): places of both tokens in the list's tokens (at), and all tokens (doc, id, end).

        Starts are counted on through the documents, so both sides are in order.
        """
        import numpy as np
        import pandas as pd

        sides, frames = [], []
        for side in (0, 1):
            ids = np.concatenate([np.zeros(0, np.int64), *(x[side] for x in docs if x)])
            doc = np.repeat(np.arange(len(docs)), [len(x[side]) if x else 0 for x in docs])
            end = np.cumsum(self._sizes[side][ids])
            sides.append({"doc": doc, "id": ids, "end": end, "start": end - self._sizes[side][ids]})
            frames.append(pd.DataFrame({"start": sides[side]["start"], "doc": doc, "at": np.arange(len(ids))}, copy=False))
        keys = ["start", "doc"]
        covering_b = pd.merge_asof(frames[0][keys], frames[1], on="start", by="doc")["at"].to_numpy()
        # tokens that start inside one of the first side; equal starts are in the other direction already
        covering_a = pd.merge_asof(frames[1][keys], frames[0], on="start", by="doc", allow_exact_matches=False)["at"].to_numpy()
        inside = np.flatnonzero(~np.isnan(covering_a))
        covering_a = covering_a[inside].astype(np.int64)
        within = sides[0]["end"][covering_a] > sides[1]["start"][inside]
        at_a = np.concatenate([np.arange(len(covering_b)), covering_a[within]])
        at_b = np.concatenate([covering_b.astype(np.int64), inside[within]])
        return {"a": sides[0], "b": sides[1], "at_a": at_a, "at_b": at_b,
                "same_end": sides[0]["end"][at_a] == sides[1]["end"][at_b]}

    def aligned(self, texts: list) -> dict:
        """Of a list of texts: n_a, n_b, n_groups, n_links and groups of each; its linked id pairs and how often, and where they begin.

        groups is ``a1,a2|b1;a3|b2,b3``: ids of the first side, of the second, group by group.
        """
        import numpy as np

        docs = [self.ids(t) for t in texts]
        n = len(docs)
        found = self.overlaps(docs)
        a, b = found["a"], found["b"]
        linked = found["at_a"][found["same_end"]]
        doc, linked_ends = a["doc"][linked], a["end"][linked]
        pairs = (a["id"][linked] << SHIFT) + b["id"][found["at_b"][found["same_end"]]]
        ends, first = np.unique(linked_ends, return_index=True)
        # groups are printed one after the other, the first side's ids first
        groups = [np.searchsorted(ends, side["end"]) for side in (a, b)]
        counts = [np.bincount(g, minlength=len(ends)) for g in groups]
        upto = [np.cumsum(c) for c in counts]
        codes = np.zeros(len(a["id"]) + len(b["id"]), np.int64)
        for side, ids in enumerate((a["id"], b["id"])):
            g, k = groups[side], np.arange(len(ids))
            place = k + (upto[1] - counts[1] if side == 0 else upto[0])[g]
            codes[place] = ids + np.where(k + 1 == upto[side][g], (1 + side) << 16, 0)
        sizes = [[len(x[side]) if x else 0 for x in docs] for side in (0, 1)]
        cuts = np.cumsum([0, *(x + y for x, y in zip(*sizes))]).tolist()
        codes, printed = codes.tolist(), self._printed
        keyed, times = np.unique((doc << 2 * SHIFT) + pairs, return_counts=True)
        return {
            "n_a": sizes[0], "n_b": sizes[1], "n_groups": np.bincount(doc[first], minlength=n), "n_links": np.bincount(doc, minlength=n),
            "groups": [b"".join(map(printed.__getitem__, codes[i:j]))[:-1] for i, j in zip(cuts, cuts[1:])],
            "pairs": keyed & ((1 << 2 * SHIFT) - 1), "times": times, "first": np.searchsorted(keyed, np.arange(n + 1) << 2 * SHIFT)}


@lru_cache(maxsize=2)
def aligner(first: str, second: str) -> Aligner:
    """One aligner for each worker process and pair of files."""
    return Aligner(first, second)


def parts(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs of rows of at most PART_BYTES together, or of one row."""
    out, first, total = [], 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > PART_BYTES:
            out.append((first, k))
            first, total = k, 0
        total += size
    return [*out, (first, len(sizes))] if sizes else []


def align(docs: DataFrame, first: str, second: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, and the row's linked id pairs with the times each is linked.

    With `digest`, groups are given by their SHA-256 in lower-case hexadecimal digits; '' stays.
    A pair is (first side's id << SHIFT) + second side's id.
    """

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        both = aligner(first, second)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in parts(sizes):
                ids, texts = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).to_pylist()
                x = both.aligned(texts)
                groups = [hashlib.sha256(g).hexdigest() if g else "" for g in x["groups"]] if digest else [g.decode() for g in x["groups"]]
                starts = pa.array(x["first"].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(groups, pa.string()),
                     pa.ListArray.from_arrays(starts, pa.array(x["pairs"])), pa.ListArray.from_arrays(starts, pa.array(x["times"].astype(np.int64)))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    chosen = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<bigint>")


def overlaps(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, a_place, b_place, a_id, b_id, same_end: every pair of tokens whose byte ranges overlap, places from 0.

    Rows of one document follow no order.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        both = aligner(first, second)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in parts(sizes):
                docs = [both.ids(t) for t in batch.column(1).slice(i, j - i).to_pylist()]
                found = both.overlaps(docs)
                doc = found["a"]["doc"][found["at_a"]]
                begin = [np.cumsum([0, *(len(x[side]) if x else 0 for x in docs)])[doc] for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(found["at_a"] - begin[0]), pa.array(found["at_b"] - begin[1]),
                     pa.array(found["a"]["id"][found["at_a"]]), pa.array(found["b"]["id"][found["at_b"]]), pa.array(found["same_end"])],
                    names=["doc_id", "a_place", "b_place", "a_id", "b_id", "same_end"])

    chosen = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, a_place long, b_place long, a_id long, b_id long, same_end boolean")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links that hold it) and best (no pair with its second side's id has more) of aligned rows."""
    counts = materialize(rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
                         .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")))
    second = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    highest = counts.groupBy(second.alias("second")).agg(F.max("n").alias("highest"))
    return counts.join(highest, second == F.col("second")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def scored(docs: DataFrame, first: str, second: str, digest: bool = True) -> DataFrame:
    """Aligned rows with n_best (links whose pair is a best one) and count_sum (counts of the pairs, over links)."""
    # the row number is that of a written table, so it stays the same whenever the table is read
    rows = materialize(align(docs, first, second, digest).withColumn("row", F.monotonically_increasing_id()))
    counts = materialize(pair_counts(rows))
    if Aligner(first, second).pair_bound() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = linked.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").drop("row").withColumns(
        {"n_best": F.coalesce("n_best", none), "count_sum": F.coalesce("count_sum", none)})
