"""Token ids as length-delimited binary records with an offset index.

File format. Every record is

    length   unsigned 64-bit, little-endian
    check    unsigned 32-bit: masked CRC-32C of the eight length bytes
    data     `length` bytes
    check    unsigned 32-bit: masked CRC-32C of the data

where masked(c) = rotate_right(c, 15) + 0xA282EAD8 modulo 2**32. The data of a
document are a byte with the size of an id (2 or 4 bytes, as its largest id
needs), a byte that is 0 for a null doc_id, the doc_id (signed 64-bit) and its
ids, unsigned, all little-endian. Shards hold documents in
ascending doc_id order (nulls first, ties by a hash of the text), and shards
are numbered in that order.

Offset index. A table beside the shards with one row for each record: doc_id,
shard, path, offset, length, n_tokens. It is written by Spark after the shards;
what it lists is committed, and a shard of a failed or repeated task attempt is
in no row. Shuffled reads seek by it (`read_at`); sequential reads go file by
file (`read_back`).

Results for odd input: a null or empty text is a record with the end id alone;
repeated rows are records of their own; an empty table gives an empty index;
other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import materialize, scratch_dir, small_batches
from labelscope.llm.tokens import grouped, text_ids

HEAD = struct.Struct("<B?q")
INDEX = "doc_id long, shard int, path string, offset long, length long, n_tokens long"
BLOCK = 64


@lru_cache(maxsize=1)
def _tables():
    """(8, 256) CRC-32C tables for eight bytes at once, and (4, 256) tables that pass a block of zeros."""
    import numpy as np

    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1)
    tables = [one]
    for _ in range(7):
        tables.append((tables[-1] >> 8) ^ one[tables[-1] & 255])
    skip = []
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(BLOCK):
            state = (state >> 8) ^ one[state & 255]
        skip.append(state)
    return np.stack(tables), np.stack(skip)


def masked_checks(items: list[bytes]):
    """Masked CRC-32C of each item (of four bytes or more), all items of a batch at once.

    Items get zeros in front up to whole blocks, which leave a zero state as it is;
    the usual initial state is put onto an item's first four bytes instead.
    """
    import numpy as np

    tables, skip = _tables()
    sizes = np.array([len(x) for x in items], np.int64)
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks)
    data = np.zeros((int(ends[-1]) if len(ends) else 0) * BLOCK, np.uint8)
    for item, end, size in zip(items, (ends * BLOCK).tolist(), sizes.tolist()):
        data[end - size:end] = np.frombuffer(item, np.uint8)
    first = ends * BLOCK - sizes
    for k in range(4):
        data[first + k] ^= 255
    data = data.reshape(-1, BLOCK // 8, 8)
    state = np.zeros(len(data), np.uint32)
    for step in range(BLOCK // 8):
        part = data[:, step]
        low = part[:, :4].copy().view("<u4")[:, 0] ^ state
        state = tables[7][low & 255] ^ tables[6][(low >> 8) & 255] ^ tables[5][(low >> 16) & 255] ^ tables[4][low >> 24]
        for k in range(4):
            state ^= tables[3 - k][part[:, 4 + k]]
    total = np.zeros(len(items), np.uint32)
    order = np.argsort(-blocks, kind="stable")
    start, alive = ends - blocks, len(items)
    for step in range(int(blocks.max()) if len(items) else 0):
        while alive and blocks[order[alive - 1]] <= step:
            alive -= 1
        rows = order[:alive]
        old = total[rows]
        total[rows] = (skip[0][old & 255] ^ skip[1][(old >> 8) & 255] ^ skip[2][(old >> 16) & 255]
                       ^ skip[3][old >> 24] ^ state[start[rows] + step])
    total = ~total
    return ((total >> 15) | (total << 17)) + np.uint32(0xA282EAD8)


def framed(items: list[bytes]) -> list[bytes]:
    """Items as records, checks included."""
    lengths = [struct.pack("<Q", len(x)) for x in items]
    checks = masked_checks(lengths + items).astype("<u4").tobytes()
    n = len(items)
    return [b"".join((size, checks[4 * i:4 * i + 4], x, checks[4 * (n + i):4 * (n + i) + 4]))
            for i, (size, x) in enumerate(zip(lengths, items))]


def records(stream, left: int, batch_bytes: int = 1 << 22) -> Iterator[list[bytes]]:
    """Checked data of the records in a stream's next `left` bytes, in lists of some `batch_bytes`."""
    while left:
        heads, items, said, total = [], [], [], 0
        while left and total < batch_bytes:
            head = stream.read(12)
            size = int.from_bytes(head[:8], "little")
            if size + 16 > left:  # a wrong length must not ask for memory
                raise ValueError("record cut short, or wrong length")
            body = stream.read(size + 4)
            heads.append(head)
            items.append(body[:size])
            said.append(body[size:])
            total += size + 16
            left -= size + 16
        found = masked_checks([h[:8] for h in heads] + items).astype("<u4").tobytes()
        if b"".join([h[8:] for h in heads] + said) != found:
            raise ValueError("checksum does not match")
        yield items


def packed(doc: int | None, ids: bytes) -> bytes:
    """Data of a document; `ids` are little-endian unsigned 32-bit integers."""
    import numpy as np

    wide = np.frombuffer(ids, "<u4")
    if not len(wide) or wide.max() < 1 << 16:
        return HEAD.pack(2, doc is not None, doc or 0) + wide.astype("<u2").tobytes()
    return HEAD.pack(4, doc is not None, doc or 0) + ids


def unpacked(data: bytes) -> tuple[int | None, bytes]:
    """doc_id and ids (little-endian unsigned 32-bit integers) of a record's data."""
    import numpy as np

    size, there, doc = HEAD.unpack_from(data)
    ids = np.frombuffer(data, f"<u{size}", offset=HEAD.size).astype("<u4").tobytes()
    return doc if there else None, ids


def open_uri(uri: str):
    """File system and path of a URI; s3a is what Spark calls s3."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri if uri.startswith("/") else uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("file:///", "file:/").replace("file:/", "file:///"))


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None) -> DataFrame:
    """Encode texts, write them as shards below `folder`, and return the offset index (written and reread).

    Documents are dealt by ranges of (doc_id, hash of text): a shard for each partition.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, shard = text_ids(tokenizer), TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        end = b"" if end_id is None else struct.pack("<I", end_id)
        out, at = None, 0
        for batch in grouped(batches, encoder.part_bytes // 2):
            if out is None:
                store, place = open_uri(path)
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(place)
            ids = batch.column(0).to_pylist()
            tokens = [bytes(x) + end for x in encoder.encode(batch.column(1))]
            items = [packed(i, x) for i, x in zip(ids, tokens)]
            rows = framed(items)
            out.write(b"".join(rows))
            offsets = []
            for row in rows:
                offsets.append(at)
                at += len(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([shard] * len(ids), pa.int32()), pa.array([path] * len(ids)),
                pa.array(offsets, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                pa.array([len(x) // 4 for x in tokens], pa.int64())],
                names=["doc_id", "shard", "path", "offset", "length", "n_tokens"])
        if out is not None:
            out.close()

    text_hash = F.xxhash64("text")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        F.col("doc_id"), text_hash).sortWithinPartitions(F.col("doc_id"), text_hash)
    return materialize(small_batches(dealt).mapInArrow(write, INDEX))


def shard_starts(index: DataFrame) -> DataFrame:
    """Shards in order, with the ids that all earlier shards hold. One row for each shard."""
    shards = index.groupBy("shard", "path").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("tokens")


def read_back(index: DataFrame) -> DataFrame:
    """Every record, read from the shards one after the other: doc_id, start (ids of all records before it), ids.

    ids is binary, little-endian unsigned 32-bit integers. A task reads whole
    shards as a stream, and every length and checksum is verified.
    """
    return _scan(index, list, "ids binary")


def read_digests(index: DataFrame) -> DataFrame:
    """As `read_back`, with n_tokens and the CRC-32 of the ids in their place."""
    import zlib

    return _scan(index, lambda ids: [zlib.crc32(x) for x in ids], "ids_crc32 long")


def _scan(index: DataFrame, of, column: str) -> DataFrame:
    kind = column.split()[1]

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = open_uri(path)
                size = store.get_file_info(place).size
                with store.open_input_stream(place, buffer_size=1 << 20) as stream:
                    for data in records(stream, size):
                        docs, ids = zip(*map(unpacked, data))
                        sizes = [len(x) // 4 for x in ids]
                        starts = []
                        for size in sizes:
                            starts.append(base)
                            base += size
                        yield pa.RecordBatch.from_arrays([
                            pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                            pa.array(of(ids), pa.binary() if kind == "binary" else pa.int64())],
                            names=["doc_id", "start", "n_tokens", column.split()[0]])

    shards = materialize(shard_starts(index).select("path", "base"))
    dealt = shards.repartition(max(1, shards.count()))
    return dealt.mapInArrow(read, f"doc_id long, start long, n_tokens long, {column}")


def read_at(wanted: DataFrame) -> DataFrame:
    """Records at given places of the index (path, offset, length), in any order: doc_id, ids. For shuffled reads."""

    def read(batches):
        import pyarrow as pa

        files: dict = {}
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    store, place = open_uri(path)
                    files[path] = store.open_input_file(place)
                files[path].seek(offset)
                rows.append(next(records(files[path], length + 16))[0])
            docs, ids = zip(*map(unpacked, rows)) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        for file in files.values():
            file.close()

    return wanted.select("path", "offset", "length").mapInArrow(read, "doc_id long, ids binary")


def new_folder(spark) -> str:
    """A fresh folder for shards below the shared one."""
    return f"{scratch_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
