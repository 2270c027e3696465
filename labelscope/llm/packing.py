"""Packing by shortest-pack-first over the length histogram.

Documents are cut into full sequences and a rest; the rests' lengths form a
histogram of at most `size` entries, whatever the number of documents. The
histogram is packed on the driver, longest lengths first, each into the open
pattern with the most room (the shortest pack), in whole counts at a time, and
the patterns are joined back to the pieces by their rank within their length.

Results for odd input: a null or empty text is a document with the end id
alone; rows that repeat are documents of their own; an empty table gives no
rows; other columns are ignored. Ties in rank are broken by (doc_id, start),
and equal rows may change places, which changes nothing.
"""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import materialize, release, small_batches
from labelscope.llm.tokens import STRETCHES, WORDS, grouped, text_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces of one length that are ranked in one task.
RANKED = 1_000


def cut(docs: DataFrame, size: int, tokenizer: str, end_id: int | None, with_ids: bool = False,
        remember: tuple[int, ...] = (STRETCHES, WORDS), forget: bool = False) -> DataFrame:
    """Pieces of at most `size` ids of every document: PIECES, and the ids themselves if asked for.

    `remember` bounds the stretches and words a worker keeps, and the bytes it encodes
    at a time: fewer cost time, more memory. With `forget`, nothing is kept past a task.
    """

    def encode(batches):
        import pyarrow as pa
        import struct

        encoder = text_ids(tokenizer, *remember)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        step = 4 * size
        for batch in grouped(batches, encoder.part_bytes // 2):
            rows, ids = [], []
            for doc, x in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                x = bytes(x) + end
                for at in range(0, len(x), step):
                    piece = x[at:at + step]
                    rows.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(x) // 4))
                    if with_ids:
                        ids.append(piece)
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if forget:
            encoder.forget()
            release()

    chosen = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(encode, PIECES + ", ids binary" * with_ids)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns of a histogram: (count, [(length, first rank), ...]).

    A pattern's k-th sequence takes, from every length it lists, the piece of
    rank (first rank + k). Work and result depend on the number of lengths, not
    on the number of pieces.
    """
    open_packs: list[tuple[int, int, int, list]] = []  # (-room, tie, count, slots)
    closed: list[tuple[int, list]] = []
    tie = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, count, slots = heapq.heappop(open_packs)
                take = min(count, left)
                if take < count:  # the other sequences of the pattern stay as they are
                    heapq.heappush(open_packs, (room, tie, count - take, [(n, r + take) for n, r in slots]))
                    tie += 1
                room += length
            else:
                take, room, slots = left, length - size, []
            slots = [*slots, (length, rank)]
            if room:
                heapq.heappush(open_packs, (room, tie, take, slots))
                tie += 1
            else:
                closed.append((take, slots))
            left -= take
            rank += take
    return closed + [(count, slots) for _, _, count, slots in sorted(open_packs, key=lambda p: p[:2])]


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Place of every piece: all columns of `pieces`, sequence_id and offset.

    `pieces` must be written already (it is read twice) and have doc_id, start
    and length, from 1 to `size`. Ranks are counted in chunks of a length, so a
    length that holds most pieces is ranked by many tasks.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    known = F.broadcast(spark.createDataFrame(  # at most `size` rows
        [(n, -(-count // RANKED)) for n, count in histogram.items()], "length long, chunks long"))
    chunked = pieces.join(known, "length").withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id", "start"), F.col("chunks"))).drop("chunks")
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = (chunked.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "start")
    ranked = (chunked.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "chunk"])
              .withColumn("rank", F.col("rank") + F.col("base")).drop("base", "chunk"))

    places: dict[int, list[tuple[int, int, int]]] = {}  # length: (first rank, first sequence - first rank, offset)
    sequence = 0
    for count, slots in shortest_pack_first(histogram, size):
        offset = 0
        for length, rank in slots:
            places.setdefault(length, []).append((rank, sequence - rank, offset))
            offset += length
        sequence += count
    for x in places.values():
        x.sort()
    shared = spark.sparkContext.broadcast(places)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        tables = {n: np.array(x, np.int64) for n, x in shared.value.items()}
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            ranks = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            sequences, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                spans = tables[int(lengths[rows[0]])]
                at = np.searchsorted(spans[:, 0], ranks[rows], side="right") - 1
                sequences[rows], offsets[rows] = ranks[rows] + spans[at, 1], spans[at, 2]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequences), pa.array(offsets)],
                names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "sequence_id long", "offset long"])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, size: int, tokenizer: str, end_id: int | None, with_ids: bool = False,
                   remember: tuple[int, ...] = (STRETCHES, WORDS), forget: bool = False) -> DataFrame:
    """Cut and place whole documents; with ids, `sequences` can put them together."""
    return pack(materialize(cut(docs, size, tokenizer, end_id, with_ids, remember, forget)), size)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary, pieces in order), lengths.

    A sequence holds at most `size` ids, so the group behind a row is bounded.
    """
    return (placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
            .select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                    F.transform("p", lambda x: x["length"]).alias("lengths")))
