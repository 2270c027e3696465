"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints that differ in at most three of 64 bits differ in at most one bit
of their upper or of their lower half. Half a fingerprint has 32 bits: 31 carry
a Hamming code, whose 2**26 words, with the top bit beside them, are the anchors.
The code's covering radius is one, so every half lies within one bit of an
anchor, and halves that differ in one of the 31 bits lie within two bits of the
anchor of either. Each fingerprint is therefore copied to every code word within
two bits (radius plus threshold) of either half with its own top bit, sixteen at
most for a half, and to the nearest one with the other top bit, where halves meet that
differ in the top bit. So any pair to be linked meets at an anchor, where the
whole fingerprints are compared. Shared anchors mean 27 equal bits or more, so
groups stay small unless fingerprints really are close.

Exact copies are one fingerprint from the start. An anchor's fingerprints are
compared by the task that holds them, and only a spanning forest of the links is
kept, never all pairs. A crowded anchor is dealt out in blocks, each pair of
blocks to a group of its own, so no group exceeds twice BLOCK fingerprints.

Results for odd input: a null text has no words, hence fingerprint zero, linked
like any other; so has the empty text. Rows that repeat, and rows that share a
doc_id, each get a row; a null doc_id gets its text's component, and never names
one unless all ids of the component are null. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import components, materialize, small_batches

SEED = 42
#: Most fingerprints of an anchor that are compared in one block.
BLOCK = 4096
THRESHOLD = 3


def majority(seen) -> int:
    """The fingerprint of shingle hashes: a bit is set if more than half of them have it."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for at in range(0, len(seen), 1 << 16):
        part = seen[at:at + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(seen), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, width: int, *extra: str) -> DataFrame:
    """doc_id, the columns named in `extra`, and fp (64 bits as a long) of every text.

    Words are runs without ASCII white space, A-Z in lower case; a shingle is
    `width` words joined by spaces, repeats included, or all words if fewer. A
    bit is set if more than half of the shingles' XXH64 (seed 42) have it.
    """

    def hashed(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for row, text in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
                words = text.lower().split() if text else []
                if not words:
                    continue
                if len(words) <= width:
                    out[row] = xxh64_intdigest(b" ".join(words), SEED)
                    continue
                n = len(words) - width + 1
                shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
                out[row] = majority(np.fromiter((xxh64_intdigest(x, SEED) for x in shingles), np.uint64, n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(out.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return small_batches(chosen).mapInArrow(hashed, schema + ", fp long")


def _anchors(half: Column) -> Column:
    """Code words within two bits of a half's lower 31 bits, with the 32nd bit on top, and the nearest with that bit changed.

    The syndrome of the code is the exclusive or of the places (1 to 31) of the
    bits set: zero for a code word, else the place of the one bit to change. Two
    changes at places p and q lead to a code word if p xor q is the syndrome.
    """
    body, top = half.bitwiseAND(F.lit((1 << 31) - 1)), half.bitwiseAND(F.lit(1 << 31))
    # place p belongs to parity k if bit k of p is set
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    syndrome = sum((F.shiftleft(F.bit_count(body.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)).cast("long"), k)
                    for k, m in enumerate(masks)), F.lit(0).cast("long"))
    flip = lambda p: F.when(p == 0, F.lit(0).cast("long")).otherwise(  # noqa: E731  place 0: no change
        F.call_function("shiftleft", F.lit(1).cast("long"), (p - 1).cast("int")))
    # the two changes {p, p xor syndrome}; with place 0 this holds the one change as well
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)).cast("array<bigint>"),
                        lambda p: F.when((p < p.bitwiseXOR(syndrome)) | (syndrome == 0) & (p == 0),
                                         body.bitwiseXOR(flip(p)).bitwiseXOR(flip(p.bitwiseXOR(syndrome)))))
    nearest = body.bitwiseXOR(flip(syndrome)).bitwiseOR(top).bitwiseXOR(F.lit(1 << 31))
    return F.array_append(F.transform(F.filter(pairs, lambda x: x.isNotNull()), lambda x: x.bitwiseOR(top)), nearest)


def replicas(fps: DataFrame) -> DataFrame:
    """A row (anchor, fp) for every anchor of either half; bit 32 of an anchor tells the half."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    marked = F.transform(_anchors(high), lambda x: x.bitwiseOR(F.lit(1 << 32)))
    return fps.select(F.explode(F.concat(_anchors(low), marked)).alias("anchor"), "fp")


def _forest(batches):
    """Spanning forest of the links of each group in a stream of (anchor, block, fp) sorted by group."""
    import numpy as np
    import pyarrow as pa

    def links(fps):
        waiting = fps.view(np.uint64)
        us, vs = [], []
        while len(waiting) > 1:
            front, waiting = waiting[:1], waiting[1:]
            while len(front) and len(waiting):  # grow one component
                near = np.bitwise_count(waiting ^ front[0]) <= THRESHOLD
                if near.any():
                    us.append(waiting[near])
                    vs.append(np.full(len(us[-1]), front[0]))
                    front = np.concatenate([front[1:], us[-1]])
                    waiting = waiting[~near]
                else:
                    front = front[1:]
        return us, vs

    def packed(us, vs):
        both = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["u", "v"])

    rest = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        part = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns)]
        anchor, block, fp = part
        if not len(fp):
            continue
        change = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(block) != 0)) + 1
        cut = change[-1] if len(change) else 0  # the last group may go on in the next batch
        rest = [x[cut:] for x in part]
        edges = np.concatenate([[0], change])
        sizes = np.diff(edges)
        us, vs = [], []
        twos = edges[:-1][sizes == 2]  # by far the most groups that have pairs at all
        near = np.bitwise_count((fp[twos] ^ fp[twos + 1]).view(np.uint64)) <= THRESHOLD
        us.append(fp[twos][near].view(np.uint64))
        vs.append(fp[twos + 1][near].view(np.uint64))
        for k in np.flatnonzero(sizes > 2):
            u, v = links(fp[edges[k]:edges[k + 1]])
            us += u
            vs += v
        yield packed(us, vs)
    yield packed(*links(rest[2]))


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints within THRESHOLD bits; `fps` is read twice."""
    near = replicas(fps)
    crowded = near.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    near = near.join(materialize(crowded.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))), "anchor", "left")
    # block pairs (low, high) of a crowded anchor; one group for all others
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("long")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    near = near.select("anchor", "fp", own.alias("own"), other.alias("other")).select(
        "anchor", F.when(F.col("other") < 0, F.lit(0).cast("long")).otherwise(
            F.shiftleft(F.least("own", "other"), 31) + F.greatest("own", "other")).alias("block"), "fp")
    dealt = near.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    return dealt.mapInArrow(_forest, "u long, v long")


def near_duplicates(docs: DataFrame, width: int, *extra: str) -> DataFrame:
    """doc_id, `extra` columns, fp and component_id of every row.

    component_id is the smallest doc_id that links lead to.
    """
    rows = materialize(fingerprints(docs, width, *extra))
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(fps.select("fp")))
    named = fps.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    # only components of more than one fingerprint need their smallest doc_id looked up
    grouped = materialize(named)
    first = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(grouped.select("fp", "root").join(first, "root").drop("root"), "fp").select(
        "doc_id", *extra, "fp", "component_id")


def hexed(fp: Column) -> Column:
    """A fingerprint as sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
