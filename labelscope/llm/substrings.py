"""Substring dedup: windows of `width` words that repeat across documents are cut out.

A window is removed from a document if its words also start, in the same order,
in a document with a smaller doc_id; windows are judged on the input. Removed
windows that touch or overlap merge into maximal intervals.

Rabin-Karp: a word's 64-bit hash is a digit of a polynomial in an odd base
modulo 2**64; differences of prefix sums give the hash of every window of any
width at once. Three steps:

1. Every window names the smallest hash among the grams of half its width inside
   it. Equal windows name equal grams, and neighbours mostly name the same one,
   so a document has one gram for some thirteen words. Spark counts documents
   for each gram. A window whose gram is in one document only cannot repeat.
2. All windows of the other grams are counted in Spark under 96 bits of hash
   (two bases); those that start in more than one document keep their smallest
   doc_id.
3. Documents with a larger doc_id get the places of these windows back and merge
   them into intervals.

Documents with the same words from start to end are one document in these steps;
all but the one with the smallest doc_id lose everything (if a window fits).
Grams and windows are counted with minima that combine before the shuffle, and
the joins that carry them back can be split by adaptive execution, so a passage
that a third of all documents share is dealt out. No group holds more than the
windows of one document.

Results for odd input: a null or empty text has no words and loses none; fewer
words than `width` lose none; rows that repeat with the same doc_id don't count
as one another's source and get a row each; a null doc_id is never a source and
loses nothing; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import materialize, small_batches

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple] = {}


def _powers(base: int, n: int):
    """Powers of a base and of its inverse modulo 2**64, at least n of each."""
    import numpy as np

    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(12, n.bit_length())
        with np.errstate(over="ignore"):
            both = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                    for b in (base, pow(base, -1, 1 << 64))]
        _POWERS[base] = tuple(both)
    return [x[:n] for x in _POWERS[base]]


def word_hashes(words: list[bytes]):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def rolling(hashes, width: int, base: int = BASES[0]):
    """Mixed Rabin-Karp hash of every window of `width` words."""
    import numpy as np

    n = len(hashes)
    up, down = _powers(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    found = (sums[width:] - sums[:-width]) * down[:n - width + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found


def named_grams(hashes, width: int):
    """For every window of `width` words, the smallest hash of a gram of half the width inside it."""
    import numpy as np

    gram = width // 2
    grams = rolling(hashes, gram)
    span, least, reach = width - gram + 1, grams, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[:len(least) - (span - reach)], least[span - reach:])
    return least


def _digest(words: list[bytes]) -> tuple[str, int]:
    found = hashlib.sha256(b" ".join(words))
    return found.hexdigest(), int.from_bytes(found.digest()[:8], "little", signed=True)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_words, sha (of all words), key (64 bits of it) and grams of every row."""

    def profile(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, grams = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.split() if text else []
                rows.append((len(words), *_digest(words)))
                grams.append(np.unique(named_grams(word_hashes(words), width)).view(np.int64)
                             if len(words) >= width else np.zeros(0, np.int64))
            sizes = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            n_words, shas, keys = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), pa.array(keys, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *grams])))],
                names=["doc_id", "n_words", "sha", "key", "grams"])

    return small_batches(docs).mapInArrow(profile, "doc_id long, n_words long, sha string, key long, grams array<bigint>")


def _windows(texts: DataFrame, width: int) -> DataFrame:
    """Windows whose named gram is listed: doc_id, key, place, h1, h2. Input: doc_id, text, key, grams."""

    def windows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for doc, text, key, grams in zip(*(c.to_pylist() for c in (
                    batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2))), batch.column(3)):
                words = text.split()
                if len(words) < width or _digest(words)[1] != key:
                    continue  # another text under the same doc_id
                hashes = word_hashes(words)
                listed = np.sort(grams.values.to_numpy().view(np.uint64))
                named = named_grams(hashes, width)
                at = np.minimum(np.searchsorted(listed, named), len(listed) - 1)
                places = np.flatnonzero(listed[at] == named)
                one = rolling(hashes, width)[places]
                two = rolling(hashes ^ (hashes >> np.uint64(31)), width, BASES[1])[places]
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, doc, np.int64)), pa.array(np.full(n, key, np.int64)), pa.array(places.astype(np.int32)),
                     pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                    names=["doc_id", "key", "place", "h1", "h2"])

    return small_batches(texts).mapInArrow(windows, "doc_id long, key long, place int, h1 long, h2 int")


def _cut(texts: DataFrame, width: int) -> DataFrame:
    """Input doc_id, text, key, places; returns doc_id, key, n_removed, kept (words joined by spaces), intervals."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, text, key, places in zip(*(c.to_pylist() for c in (
                    batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2))), batch.column(3)):
                words = text.split()
                if _digest(words)[1] != key:
                    continue
                change = np.zeros(len(words) + 1, np.int64)
                starts = places.values.to_numpy()
                np.add.at(change, starts, 1)
                np.add.at(change, starts + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((doc, key, int(gone.sum()), kept, edges.reshape(-1, 2).tolist()))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) if i != 3 else pa.array(c, k).cast(pa.string()) for i, (c, k) in enumerate(zip(columns, kinds))],
                names=["doc_id", "key", "n_removed", "kept", "intervals"])

    return small_batches(texts).mapInArrow(
        cut, "doc_id long, key long, n_removed long, kept string, intervals array<array<bigint>>")


def removals(docs: DataFrame, width: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all rows, first documents by sha, and what is cut from first documents.

    For `deduplicated` and `digests`, which put them together.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(profiles(docs, width))
    firsts = materialize(rows.filter((F.col("n_words") >= width) & F.col("doc_id").isNotNull()).groupBy("sha").agg(
        F.min("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("grams").alias("grams")))
    grams = firsts.select("doc_id", "key", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("gram")
    shared = materialize(shared)  # apart from the count, so that a hot gram's rows can be split in the join
    listed = grams.join(shared, "gram").groupBy("doc_id", "key").agg(F.collect_list("gram").alias("grams"))
    windows = materialize(_windows(docs.join(listed, "doc_id").select("doc_id", "text", "key", "grams"), width))
    repeated = materialize(windows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi"))
    places = (windows.join(repeated, ["h1", "h2"]).filter(F.col("doc_id") > F.col("lo"))
              .groupBy("doc_id", "key").agg(F.collect_set("place").alias("places")))
    cuts = materialize(_cut(docs.join(places, "doc_id").select("doc_id", "text", "key", "places"), width)
                       .dropDuplicates(["doc_id", "key"]))
    return rows, firsts.select("sha", F.col("doc_id").alias("first")), cuts


def _joined(rows: DataFrame, firsts: DataFrame, cuts: DataFrame, *columns: str) -> DataFrame:
    """Rows with `copy` (all words go) and the named columns of their cuts."""
    return (rows.drop("grams").join(firsts, "sha", "left").join(cuts.select("doc_id", "key", *columns), ["doc_id", "key"], "left")
            .withColumn("copy", F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") > 0), F.lit(False))))


def digests(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows, firsts, cuts = removals(docs, width)
    cuts = cuts.withColumn("kept_sha", F.sha2(F.encode("kept", "UTF-8"), 256))
    joined = _joined(rows, firsts, cuts, "n_removed", "kept_sha")
    return joined.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))


def intervals(docs: DataFrame, width: int = 50) -> DataFrame:
    """Maximal removal intervals of every row, as pairs (first word, word after the last); none: empty array."""
    rows, firsts, cuts = removals(docs, width)
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    return _joined(rows, firsts, cuts, "intervals").select(
        "doc_id", "n_words", F.when(F.col("copy"), whole).otherwise(
            F.coalesce("intervals", F.expr("cast(array() as array<array<bigint>>)"))).alias("intervals"))
