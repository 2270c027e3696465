"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

A window is `width` consecutive words of a benchmark item (all its words if it
has fewer). The training table is searched in four steps:

1. Occurrences of every benchmark term are counted over all documents. A window
   with a term that never occurs is out.
2. Each window names its two rarest terms. Postings (term, document, positions)
   of the named terms are stored.
3. Postings are moved back by the terms' places in the item: the two lists of a
   window intersect where both name the same start. What remains are candidates
   (document, item, shift).
4. Candidates are compared word by word with the item at that shift, for every
   window of the item.

The benchmark's side of a join is broadcast if a count shows that it is small,
and otherwise joined by shuffles; documents are always complete. A term that is
common in the corpus is never named beside rarer ones, and postings are rows of
one document each, so a hot term makes many rows but no large group.

Results for odd input: a null or empty text has no words, no hits and isn't
contaminated; so has a document without words. A null or empty item is no item;
items of equal text count each by its own id, rows with the same item_id once,
and an item without an id marks words but isn't listed. Rows that repeat or
share a doc_id, null ones included, get a row each by their own text. Empty
tables give no rows, or documents without hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import materialize, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 13


def _low(word: Column) -> Column:
    """A-Z in lower case, all else unchanged; the short ways cover almost all words."""
    return (F.when(F.octet_length(word) == F.char_length(word), F.lower(word))
            .when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the row) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))


def _pieces(text: Column) -> Column:
    """Words in order; the first and the last entry may be empty."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN, -1)


def tokens(keyed: DataFrame) -> DataFrame:
    """doc_id, key, pos, term of every word; positions of a document count from 0 or from 1."""
    return keyed.select("doc_id", "key", F.posexplode(_pieces(F.col("text"))).alias("pos", "word")).select(
        "doc_id", "key", "pos", _low(F.col("word")).alias("term"))


def items(benchmark: DataFrame, width: int) -> DataFrame:
    """item (number), item_id, words and size (words of a window) of every item that has words."""
    words = F.filter(_pieces(F.translate("text", UPPER, LOWER)), lambda w: w != "")
    found = benchmark.select("item_id", words.alias("words")).filter(F.size("words") > 0)
    return materialize(found.select(
        F.monotonically_increasing_id().alias("item"), "item_id", "words",
        F.least(F.size("words"), F.lit(width)).alias("size")))


def anchors(found: DataFrame, counts: DataFrame) -> DataFrame:
    """item, start, size, rank (1 or 2), place, term: the rarest terms of every window that can occur."""
    placed = found.select("item", "size", F.size("words").alias("n"), F.posexplode("words").alias("place", "term"))
    placed = placed.join(small(counts), "term", "left")
    first = F.greatest(F.lit(0), F.col("place") - F.col("size") + 1)
    last = F.least(F.col("place"), F.col("n") - F.col("size"))
    windows = placed.select("item", "size", "place", "term", "n_term", F.explode(F.sequence(first, last)).alias("start"))
    own = Window.partitionBy("item", "start")
    ranked = windows.select(
        "*", F.row_number().over(own.orderBy(F.col("n_term").asc_nulls_first(), "place")).alias("rank"),
        F.count("n_term").over(own).alias("known"))
    return ranked.filter((F.col("known") == F.col("size")) & (F.col("rank") <= 2)).drop("known", "n_term")


def postings(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: term, doc_id, key and positions (within one document) of the given terms."""
    return tokens(keyed).join(small(terms), "term").groupBy("term", "doc_id", "key").agg(
        F.collect_list("pos").alias("positions"))


def _index(keyed: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors of the windows, and the stored postings of their terms."""
    vocabulary = materialize(found.select(F.explode("words").alias("term")).distinct())
    counts = materialize(tokens(keyed.select("doc_id", "key", "text")).select("term").join(small(vocabulary), "term")
                         .groupBy("term").agg(F.count(F.lit(1)).alias("n_term")))
    named = materialize(anchors(found, counts))
    terms = materialize(named.select("term").distinct())
    return named, materialize(postings(keyed, terms))


def _shifted(index: DataFrame, named: DataFrame) -> DataFrame:
    """Postings at the shifts of the items that name their term: doc_id, key, item, place, shift."""
    places = materialize(named.select("item", "place", "term").distinct())
    return index.join(small(places), "term").select(
        "doc_id", "key", "item", "place", F.explode("positions").alias("pos")).select(
        "doc_id", "key", "item", "place", (F.col("pos") - F.col("place")).alias("shift"))


def candidates(index: DataFrame, named: DataFrame) -> DataFrame:
    """Shifts at which an item has at least as many named terms as any of its windows names."""
    needed = materialize(named.groupBy("item", "start").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(F.min("n").alias("needed")))
    met = _shifted(index, named).groupBy("doc_id", "key", "item", "shift").agg(F.count(F.lit(1)).alias("n"))
    return met.join(small(needed), "item").filter("n >= needed").select("doc_id", "key", "item", "shift")


def phrases(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Exact matches: doc_id, key, item_id, first, last (word positions in the document) of every window that occurs."""
    keyed, found = _keyed(docs), items(benchmark, width)
    named, index = _index(keyed, found)
    met = materialize(candidates(index, named))
    sized = met.join(small(found.select("item", F.size("words").alias("n"))), "item")
    wanted = materialize(sized.groupBy(F.col("doc_id").alias("wanted_id"), "key").agg(
        F.collect_list(F.struct("item", "shift", "n")).alias("shifts")))
    both = keyed.join(small(wanted, 50_000), (keyed.key == wanted.key) & keyed.doc_id.eqNullSafe(wanted.wanted_id))
    words = both.select("doc_id", keyed.key, "shifts", _pieces(F.translate("text", UPPER, LOWER)).alias("all"))
    parts = words.select("doc_id", "key", F.explode(F.transform("shifts", lambda s: F.struct(
        s["item"].alias("item"), s["shift"].alias("shift"),
        F.slice("all", F.greatest(s["shift"], F.lit(0)) + 1, s["n"]).alias("part")))).alias("p")).select("doc_id", "key", "p.*")
    compared = parts.join(small(found, 20_000), "item")
    skipped = F.greatest(-F.col("shift"), F.lit(0))  # words of the item before the document begins
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - F.col("size")), lambda s: (s >= skipped) & (
        F.slice("words", s + 1, F.col("size")) == F.slice("part", F.greatest(s - skipped, F.lit(0)) + 1, F.col("size"))))
    return compared.select("doc_id", "key", "item_id", "shift", "size", F.explode(starts).alias("start")).select(
        "doc_id", "key", "item_id", (F.col("shift") + F.col("start")).alias("first"),
        (F.col("shift") + F.col("start") + F.col("size") - 1).alias("last"))


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int, width: int = WIDTH) -> DataFrame:
    """Near matches: doc_id, key, item_id, start and the shifts at which a window's two rarest terms
    both occur, out of place against each other by `slop` words at most."""
    keyed, found = _keyed(docs), items(benchmark, width)
    named, index = _index(keyed, found)
    at = index.join(small(named), "term").select(
        "doc_id", "key", "item", "start", "rank", "place", F.explode("positions").alias("pos")).withColumn(
        "shift", F.col("pos") - F.col("place"))
    band = F.floor(F.col("shift") / (slop + 1))
    one = at.filter("rank = 1").select("doc_id", "key", "item", "start", F.col("shift").alias("shift1"),
                                       F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    two = at.filter("rank = 2").select(F.col("doc_id").alias("d"), "key", "item", "start",
                                       F.col("shift").alias("shift2"), band.alias("band"))
    near = one.join(two, ["key", "item", "start", "band"]).filter(
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.abs(F.col("shift1") - F.col("shift2")) <= slop))
    return near.join(small(found.select("item", "item_id")), "item").select(
        "doc_id", "key", "item_id", "start", "shift1", "shift2")


def word_counts(keyed: DataFrame) -> DataFrame:
    """doc_id, key and n_words of every row."""
    parts = keyed.select("doc_id", "key", _pieces(F.col("text")).alias("all"))
    n, ends = F.size("all"), lambda i: (F.element_at("all", i) == "").cast("long")
    return parts.select("doc_id", "key", (n - ends(1) - F.when(n > 1, ends(-1)).otherwise(0)).cast("long").alias("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, item_ids (sorted strings) and contaminated of every row.

    Contaminated: some words are hit, and they are one in `share` or more.
    """
    met = materialize(phrases(docs, benchmark, width).select(
        "doc_id", "key", F.col("item_id").cast("string").alias("item_id"), "first", "last").distinct())
    hit = met.select("doc_id", "key", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("doc_id", "key").agg(
        F.count(F.lit(1)).alias("n_hit"))
    listed = met.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    hits = hit.join(listed.withColumnRenamed("doc_id", "d"), "key").filter(F.col("doc_id").eqNullSafe(F.col("d"))).select(
        F.col("doc_id").alias("hit_id"), "key", "n_hit", "item_ids")
    rows = word_counts(_keyed(docs))
    joined = rows.join(hits, (rows.key == hits.key) & rows.doc_id.eqNullSafe(hits.hit_id), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    item_ids = F.coalesce("item_ids", F.expr("cast(array() as array<string>)"))
    return joined.select(
        "doc_id", rows.key, "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"),
        item_ids.alias("item_ids"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
