"""Interaction audit of a set of filters: what every order of them removes at every step.

A document's mask says which of the filters it fails. For n filters there are
n! orders of n steps each, and a mask alone decides every step's outcome: kept
after the step, removed by it, or removed earlier while failing this step's
filter too (redundant). So each mask is mapped to one big integer whose fields of
FIELD bits hold 1 for every outcome that comes about: 600 steps for five filters,
a field for each measure of a step. A part's documents are counted by adding
their integers up; a field can't reach the next one, since no table has 2**FIELD
rows. Sums of tasks meet by part and salt first, then by part, so neither many
tasks nor one large part lies behind a single task; a sum has the same size
however many documents it counts. Unpacking a part's sum gives its rows.

The last measure of a step, `shapley`, adds its filter's removals over all orders
at whatever step.

Results for odd input: a null text is empty, a null part is the empty string.
A null doc_id is neither smaller than another nor larger, so such rows never fail
as copies. Rows that repeat, and rows that share doc_id and text, count each;
none is a copy of the other. Several labels of one doc_id count as their largest
values; labels of no document are ignored. Very long texts take time in
proportion to their length. Other columns are ignored, so none can clash. An
empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import materialize, small_batches

FIELD = 64
#: Measures of a step that are packed, in the order of their fields.
MEASURES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
#: Groups of a part whose sums meet before those of the whole part.
SALTS = 16

# Fixed values of the five filters: least words, least share of different words, most share of capitals, marks.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
MARKS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails; words are runs without ASCII white space."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    marked = len(text) != len(text.translate(None, MARKS))
    mask = (n < LEAST_WORDS) | marked << 3
    if 100 * len(set(words)) < LEAST_DISTINCT * n:
        mask |= 2
    if capitals and 100 * capitals > MOST_CAPITALS * len(text.decode("utf-8")):
        mask |= 4
    return mask


def orders(n: int) -> list[tuple[int, ...]]:
    return list(permutations(range(n)))


@lru_cache(maxsize=8)
def _layout(n: int) -> tuple[int, int]:
    """Fields of the steps, and of everything: behind them come unique fails of each filter."""
    steps = len(orders(n)) * n * len(MEASURES)
    return steps, steps + n


@lru_cache(maxsize=4096)
def packed(mask: int, good: bool, toxic: bool, n: int) -> int:
    """The big integer of a document's mask and labels."""
    width = len(MEASURES)
    total = 0
    for k, order in enumerate(orders(n)):
        gone = False
        for step, one in enumerate(order):
            fails = bool(mask >> one & 1)
            removed = fails and not gone
            outcome = (not gone and not fails, removed, fails and gone, removed and good, removed and toxic)
            gone = gone or fails
            at = (k * n + step) * width
            for m, comes in enumerate(outcome):
                if comes:
                    total |= 1 << FIELD * (at + m)
    if mask and not mask & (mask - 1):
        total |= 1 << FIELD * (_layout(n)[0] + mask.bit_length() - 1)
    return total


def unpacked(total: int, letters: str) -> list[tuple]:
    """(filter_order, step, MEASURES, unique_fails, shapley) of all steps of a part's sum."""
    import numpy as np

    n, width = len(letters), len(MEASURES)
    steps, fields = _layout(n)
    flat = np.frombuffer(total.to_bytes(fields * FIELD // 8, "little"), "<u8").astype(object)
    table, unique = flat[:steps].reshape(-1, n, width), flat[steps:]
    every = orders(n)
    removals = [sum(int(table[k, order.index(one), 1]) for k, order in enumerate(every)) for one in range(n)]
    return [("".join(letters[i] for i in order), step + 1, *map(int, table[k, step]), int(unique[one]), removals[one])
            for k, order in enumerate(every) for step, one in enumerate(order)]


def text_masks(docs: DataFrame, part: Column) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text), mask of A to D, of every row."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 pa.array(map(text_mask, texts), pa.int32())], names=["doc_id", "part", "digest", "mask"])

    chosen = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), "text")
    return chosen.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """Rows with a bit of the mask set where a row of a smaller doc_id has the same digest.

    Rows meet their digest's smallest doc_id by (doc_id, digest), which no two
    different documents share: a text that a third of the rows repeat is no hot key.
    """
    smallest = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(smallest, ["doc_id", "digest"], "left").withColumn(
        "mask", F.col("mask") + F.when(later, 1 << bit).otherwise(0)).drop("first")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with `good` and `toxic` of their doc_id's labels; false where it has none."""
    one = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(one, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def _summed(batches, packed_in: bool, n: int):
    """Big integers of a task's rows added up by their leading columns: one row for each."""
    import pyarrow as pa

    fields = _layout(n)[1]
    sums: dict[tuple, int] = {}
    names = ["part"]
    for batch in batches:
        if packed_in:
            names = batch.schema.names[:-1]
            for *key, data in zip(*(c.to_pylist() for c in batch.columns)):
                sums[tuple(key)] = sums.get(tuple(key), 0) + int.from_bytes(data, "little")
        else:
            for part, mask, good, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                sums[part,] = sums.get((part,), 0) + packed(mask, good, toxic, n)
    if sums:
        keys = list(zip(*sums))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(k) for k in keys), pa.array([x.to_bytes(fields * FIELD // 8, "little") for x in sums.values()], pa.binary())],
            names=[*names, "total"])


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, MEASURES, unique_fails, shapley, of rows (part, mask, good, toxic).

    Bit k of a mask says that the document fails the filter letters[k].
    """
    n = len(letters)
    tasks = rows.select("part", F.col("mask").cast("int").alias("mask"), "good", "toxic").mapInArrow(
        lambda batches: _summed(batches, False, n), "part string, total binary")
    salted = tasks.select("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("long").alias("salt"), "total")
    few = salted.repartition("part", "salt").mapInArrow(
        lambda batches: _summed(batches, True, n), "part string, salt long, total binary").drop("salt")
    whole = few.repartition("part").mapInArrow(lambda batches: _summed(batches, True, n), "part string, total binary")

    def rows_of(batches):
        import pyarrow as pa

        for batch in batches:
            for part, total in zip(*(c.to_pylist() for c in batch.columns)):
                found = list(zip(*unpacked(int.from_bytes(total, "little"), letters)))
                columns = [pa.array([part] * len(found[0])), pa.array(found[0]), pa.array(found[1], pa.int32()),
                           *(pa.array(c, pa.int64()) for c in found[2:])]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *MEASURES, "unique_fails", "shapley"])

    counts = ", ".join(f"{m} long" for m in (*MEASURES, "unique_fails", "shapley"))
    return whole.mapInArrow(rows_of, f"part string, filter_order string, step int, {counts}")


def document_audit(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """Audit of the five filters over whole documents."""
    rows = with_copies(materialize(text_masks(docs, part)), LETTERS.index("E"))
    return audit(labelled(rows, labels))
