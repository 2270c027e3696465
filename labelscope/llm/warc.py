"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

`write` makes an archive of each partition, one gzip stream from start to end.
`normalise` inflates such a file once, front to back, and rewrites every record
as a gzip member of its own; a sidecar beside the archive (`<archive>.idx`, a
line "offset length record-id" for each record) and the returned index table say
where the members are. `read` takes archives and index and gives the records
back, checking lengths and digests.

All three work file by file and hold a block of a file at a time (`read`: a
record). A task writes under a name of its own, and only names listed in the
tables that Spark writes count, so repeated attempts leave no trace in results.

Duplicates: of the pages of equal payload (of at least `min_bytes` bytes) the
one with the smallest page_id is a response; the others are revisits, which keep
the HTTP header and refer to it. Only digests that occur more than once are
joined back, and never the payloads among themselves.

Results for odd input: a null html is an empty payload, a null url is written as
the page's own name; control characters in urls are percent-encoded. Rows that
repeat a page_id and its payload are all responses if that page_id is the
smallest. A null page_id comes after all others. An empty table gives no
archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.binary_records import open_uri
from labelscope.llm.common import materialize, scratch_dir, small, small_batches

DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 18
END = b"\r\n\r\n"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def _page(name: str) -> int | None:
    page = name.split(":")[2]
    return int(page) if page else None


def record(page: int | None, url: str | None, payload: bytes, revisit_of: int | None, revisit: bool) -> bytes:
    """A response, or a revisit of another page's response."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or f"urn:x-page:{page}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page, digest)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{_digest(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_name(revisit_of, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """One record as a row of RECORDS."""
    at = data.index(END)
    head = _headers(data[:at])
    block = data[at + 4:at + 4 + int(head["content-length"])]
    if data[at + 4 + len(block):] != END or head["warc-block-digest"] != "sha1:" + _digest(block):
        raise ValueError("record does not match its header")
    digest, (http, _, payload) = head["warc-payload-digest"].removeprefix("sha1:"), block.partition(END)
    revisit = head["warc-type"] == "revisit"
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if not revisit and (len(payload) != size or _digest(payload) != digest):
        raise ValueError("payload does not match its digest")
    return (_page(head["warc-record-id"]), size, digest, head["warc-type"],
            _page(head["warc-refers-to"]) if revisit else None)


def inflated(stream) -> Iterator[bytes]:
    """Blocks of a gzip file's content, whether it has one member or many."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = inflate.decompress(data, CHUNK)
            if out:
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
    if rest := inflate.flush():
        yield rest


def members(blocks: Iterator[bytes], level: int = 6) -> Iterator[tuple[str | None, bytes]]:
    """Records of a stream of blocks as gzip members: (None, part) for each part, (record id, last part) at its end."""
    buffer = b""
    for block in blocks:
        buffer += block
        while (at := buffer.find(END)) >= 0:
            head = _headers(buffer[:at])
            left = at + 4 + int(head["content-length"]) + 4
            deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
            while left:
                if not buffer:
                    buffer = next(blocks, b"")
                    if not buffer:
                        raise ValueError("record cut short")
                part, buffer = buffer[:left], buffer[left:]
                left -= len(part)
                if out := deflate.compress(part):
                    yield None, out
            yield head["warc-record-id"], deflate.flush()
    if buffer:
        raise ValueError("record cut short")


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, first (page_id of the response) and revisit."""
    digested = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                            F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"),
                            F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    twice = materialize(digested.filter(F.col("n") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1 and first is not null").drop("times"))
    joined = digested.join(small(twice), "digest", "left")
    return joined.select("page_id", "url", "html", "first", F.coalesce(
        (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit"))


def write(chosen: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Archives of the pages of `decided`, a single gzip stream for each partition; returns (path, records)."""

    def out(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        path = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        file, deflate, n = None, zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for batch in batches:
            for page, url, html, first, revisit in zip(
                    *(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), *batch.columns[3:]))):
                if file is None:
                    store, place = open_uri(path)
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    file = store.open_output_stream(place, compression=None)
                file.write(deflate.compress(record(page, url, html or b"", first, revisit)))
                n += 1
        if file is not None:
            file.write(deflate.flush())
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return materialize(small_batches(chosen).mapInArrow(out, "path string, records long"))


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """Index (path, offset, length, record_id) of rewritten archives, a member for each record; written with a sidecar."""

    def rewrite(batches):
        import pyarrow as pa

        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{source.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
                store, place = open_uri(source)
                rows, start, at = [], 0, 0
                with (store.open_input_stream(place, compression=None) as stream, store.open_output_stream(open_uri(target)[1], compression=None) as file,
                      store.open_output_stream(open_uri(target + ".idx")[1], compression=None) as sidecar):
                    for name, part in members(inflated(stream), level):
                        file.write(part)
                        at += len(part)
                        if name is not None:
                            rows.append((target, start, at - start, name))
                            sidecar.write(f"{start} {at - start} {name}\n".encode())
                            start = at
                            if len(rows) >= 4096:
                                yield _index_batch(rows)
                                rows = []
                yield _index_batch(rows)

    dealt = archives.select("path").repartition(max(1, archives.count()))
    return materialize(dealt.mapInArrow(rewrite, "path string, offset long, length long, record_id string"))


def _index_batch(rows):
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
        names=["path", "offset", "length", "record_id"])


def read(index: DataFrame) -> DataFrame:
    """RECORDS of the indexed members, each read at its offset; any part of an index will do."""

    def fetch(batches):
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
                rows.append(parse(zlib.decompress(files[path].read(length), 31)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=[x.split()[0] for x in RECORDS.split(", ")])
        for file in files.values():
            file.close()

    return index.select("path", "offset", "length").mapInArrow(fetch, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written, normalised and read back."""
    folder = f"{scratch_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = normalise(write(decided(pages, min_bytes), folder))
    # an index is small beside what it points to: deal it by archive, a task for some of each
    return read(index.repartition(max(1, index.select("path").distinct().count()), "path", F.floor(F.col("offset") / (8 << 20))))
