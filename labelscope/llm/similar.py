"""Near copies by exact Jaccard similarity of word shingles, found by SimHash and through signatures of parts.

Each text has op3's fingerprint of its shingles, and fingerprints within three bits
are found at op3's anchors. Sets of a component are compared with its smallest
set, and those that are similar are linked. Three bits are less than similarity 4/5
allows, so signatures of parts find the other pairs; what the fingerprints linked
is not compared with its heads again.

A text's set holds the hashes of its runs of WIDTH words. Sets of sizes a <= b whose
Jaccard similarity is at least 4/5 differ in at most (a + b) / 9 hashes, and b is at
most 5a/4. Sizes fall into classes less than 5/4 apart, so such a pair lies in one
class or in two next to each other, and the class of the smaller set bounds the
differences by some k. For that class both sets are cut into k + 1 + spare parts
by the leading bits of their hashes. Differences touch at most k parts, so more than
`spare` parts are alike, and one of these holds something unless both sets have
more than `spare` empty parts. Such sparse sets, which are few, also give their first
n - ceil(4n/5) + 1 hashes one by one, and two of them share one of those. A
signature is a hash of class, part and content: sets to be linked share one. Each
set has signatures for its own class and for the one below.

A common line or word is no hot key, since a part holds some four hashes from all over a
text, and only texts with all of them, and no other in that range, meet. What meets
does not depend on the corpus, so the search behaves alike at every size. A sample
tells which signatures many sets share: these are joined to their heads, not grouped
in one task, with the same result.

The smallest set of a signature is its head. Each set is first compared with the
head that it shares most signatures with, in tasks dealt out by head and salt, in
one pass over sets of any number. Signatures whose sets are all linked by then are
done. Where a head and the sets it shares signatures with are of several groups, the
sets outside the largest are compared with all, in blocks, and only a spanning forest
of the links is kept.

Results for odd input: texts without words have one set, the empty one, and so
one component; texts of fewer words than WIDTH have one shingle. Rows that
repeat, and rows that share a doc_id, each get a row; a null doc_id never names
a component unless all its ids are null. Other columns are ignored, so none can
clash. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm import simhash
from labelscope.llm.common import components, materialize, release, small, small_batches

SEED = 42
WIDTH = 5
#: Signatures that SHARE of a sample of that many sets hold, and most that are listed: they are joined to their heads, not grouped.
SAMPLE, SHARE, LISTED = 20_000, 40, 10_000
#: Shingles of sets that are compared in one block, and sets that are compared with one copy of their head.
BLOCK, COPIES = 1_000_000, 16_384


def shingles(text: bytes | None, width: int):
    """Hashes of the runs of `width` words, repeats included: runs without ASCII white space, A-Z in lower case."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) > width else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(x, SEED) for x in runs), np.uint64)


def shingle_set(text: bytes | None, width: int):
    """Sorted hashes of the runs of `width` words."""
    import numpy as np

    return np.unique(shingles(text, width))


def _sets(docs: DataFrame, width: int, schema: str, made, read=shingle_set) -> DataFrame:
    """Rows that `made` gives for the columns before the text, and what `read` gives of the texts, of each batch; text is the last column."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            yield made(batch.columns[:-1], [read(t, width) for t in texts])
        release()

    return small_batches(docs).mapInArrow(run, schema)


def _classes():
    """Least size of each class, and for each its parts and the spare ones among them."""
    import numpy as np

    least = [1]
    while least[-1] < 1 << 30:  # a text of a billion words
        least.append(max(least[-1] + 1, (5 * least[-1] + 3) // 4))
    largest = np.array(least[1:], np.int64) - 1
    differ = (largest + 5 * largest // 4) // 9
    spare = (differ + 10) // 10
    return np.array(least[:-1], np.int64), differ + 1 + spare, spare


def _mixed(x):
    """A bijective mix of unsigned 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets):
    """(owner, signature) arrays of sets of sorted hashes, sorted by owner."""
    import numpy as np

    least, parts, spare = _classes()
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    mixed = _mixed(flat)
    own = np.searchsorted(least, sizes, side="right") - 1  # -1: the empty set
    row = np.repeat(np.arange(len(sets)), sizes)
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for level in (own, own - 1):
        used = level[row] >= 0
        at, tag = row[used], level[row[used]].astype(np.uint64) << np.uint64(40)
        if not len(at):
            continue
        part = ((flat[used] >> np.uint64(32)) * parts[level[at]].astype(np.uint64)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (part[1:] != part[:-1])]))
        content = np.add.reduceat(mixed[used], starts)
        owners.append(at[starts])
        found.append(_mixed(content ^ _mixed(tag[starts] + part[starts])))
        empty = parts[np.maximum(level, 0)] - np.bincount(at[starts], minlength=len(sets))
        for k in np.flatnonzero((level >= 0) & (empty > spare[np.maximum(level, 0)])):
            n = len(sets[k])
            first = sets[k][:n - (4 * n + 4) // 5 + 1]
            owners.append(np.full(len(first), k))
            found.append(_mixed(first ^ _mixed(np.array([(int(level[k]) << 40) + (1 << 39)], np.uint64))))
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return owners[order], found[order]


def _named(s) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(s.tobytes(), SEED)


def _rows(docs: DataFrame, key: str, width: int) -> DataFrame:
    """doc_id, key, fp (hash of the set), size and mark (op3's fingerprint of the runs) of every row."""

    def read(text, width):
        import numpy as np

        seen = shingles(text, width)
        held = np.unique(seen)
        return _named(held), len(held), simhash.majority(seen)

    def made(columns, found):
        import numpy as np
        import pyarrow as pa

        fps, sizes, marks = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
             pa.array(np.array(marks, np.uint64).view(np.int64))], names=["doc_id", "key", "fp", "size", "mark"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"), "text")
    return _sets(chosen, width, "doc_id long, key long, fp long, size long, mark long", made, read)


def _marked(marks: DataFrame) -> DataFrame:
    """Rows (u, v, n): op3 links the marks of the sets u and v, the smallest set of its component; `marks` has fp and mark."""
    found = components(simhash.links(materialize(marks.select(F.col("mark").alias("fp")).distinct())))
    linked = marks.join(found.select(F.col("node").alias("mark"), "root"), "mark", "left").select(
        "fp", F.coalesce("root", "mark").alias("root"))
    heads = linked.groupBy("root").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return linked.join(heads.drop("_n"), "root").filter("fp <> v").select(F.col("fp").alias("u"), "v", F.lit(1).cast("long").alias("n"))


def _signed(docs: DataFrame, key: str, owners: DataFrame, width: int) -> DataFrame:
    """fp and sig rows of the sets of `owners` (key, own)."""

    def made(columns, sets):
        import numpy as np
        import pyarrow as pa

        owner, sig = signatures(sets)
        ends = np.searchsorted(owner, np.arange(len(sets) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.view(np.int64)))
        return pa.RecordBatch.from_arrays([*columns, lists], names=["fp", "sigs"])

    texts = docs.join(small(owners), docs[key] == owners["key"]).select(F.col("own").alias("fp"), "text")
    return _sets(texts, width, "fp long, sigs array<bigint>", made).select("fp", F.explode("sigs").alias("sig"))


def _stars(docs: DataFrame, key: str, owners: DataFrame, width: int) -> DataFrame:
    """Rows (u, v, n): set u shares n signatures whose head, their smallest set, is v."""
    share = SAMPLE / max(owners.count(), 1)
    part = owners if share >= 1 else owners.filter(F.pmod(F.xxhash64("own"), F.lit(1_000_000)) < int(share * 1_000_000))
    often = _signed(docs, key, part, width).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARE)
    hot = materialize(often.orderBy(F.desc("n"), "sig").limit(LISTED).select("sig"))
    every = _signed(docs, key, owners, width)
    apart = Window.partitionBy("sig")
    stars = every.join(F.broadcast(hot), "sig", "left_anti").select(F.col("fp").alias("u"), F.min("fp").over(apart).alias("v"))
    if hot.limit(1).count():  # LISTED rows at most; their minima are combined before the shuffle
        crowd = materialize(every.join(F.broadcast(hot), "sig"))
        heads = crowd.groupBy("sig").agg(F.min("fp").alias("v"))
        stars = stars.unionByName(crowd.join(F.broadcast(heads), "sig").select(F.col("fp").alias("u"), "v"))
    return stars.filter("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def _held(docs: DataFrame, key: str, owners: DataFrame, roles: DataFrame, width: int) -> DataFrame:
    """The rows of `roles` (fp and a column `to`, an array of groups) one by one, with their sets: group, fp, held."""

    def made(columns, found):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in found], pa.binary())], names=["fp", "to", "held"])

    each = roles.groupBy("fp").agg(F.flatten(F.collect_list("to")).alias("to"))  # at most as many as its signatures, times blocks
    wanted = materialize(each.join(owners, each["fp"] == owners["own"]).select("fp", "to", F.col("key").alias("wanted")))
    near = docs.join(small(wanted), docs[key] == F.col("wanted")).select("fp", "to", "text")
    kind = roles.schema["to"].dataType.simpleString()
    return _sets(near, width, f"fp long, to {kind}, held binary", made).select(F.explode("to").alias("group"), "fp", "held").select("group.*", "fp", "held")


def _with_heads(batches):
    """Links (u, v) of sets with their head in a stream of (head, salt, child, fp, held) sorted by these."""
    import numpy as np
    import pyarrow as pa

    name, head = None, None
    for batch in batches:
        us, vs = [], []
        for at, salt, child, fp, held in zip(*(c.to_pylist() for c in batch.columns)):
            one = np.frombuffer(held, np.uint64)
            if not child:
                name, head = (at, salt), one
            elif (at, salt) == name:
                both = (head[np.minimum(np.searchsorted(head, one), len(head) - 1)] == one).sum()
                if 9 * both >= 4 * (len(head) + len(one)):
                    us.append(fp)
                    vs.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
    release()


def _forest(fps, sets):
    """Spanning forest (us, vs) of the pairs of sets with a similarity of 4/5 or more."""
    import numpy as np

    order = np.argsort([len(s) for s in sets], kind="stable")
    fps, sets = fps[order], [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    shared = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(shared) + 1, np.int32)
    alive, us, vs = np.ones(len(fps), bool), [], []
    for first in range(len(fps)):
        if not alive[first]:
            continue
        alive[first], front = False, [first]
        while front:  # grow one component
            one = front.pop()
            low = np.searchsorted(sizes, (4 * sizes[one] + 4) // 5)
            high = np.searchsorted(sizes, 5 * sizes[one] // 4, side="right")
            rest = np.flatnonzero(alive[low:high]) + low
            if not len(rest):
                continue
            own = shared[at[one]:at[one + 1]]
            mark[own] = 1
            if 4 * len(rest) < high - low:
                both = np.array([mark[shared[at[k]:at[k + 1]]].sum() for k in rest])
            else:
                both = np.add.reduceat(mark[shared[at[low]:at[high]]], at[low:high] - at[low])[rest - low]
            mark[own] = 0
            near = rest[9 * both >= 4 * (sizes[one] + sizes[rest])]
            alive[near] = False
            us.append(fps[near])
            vs.append(np.full(len(near), fps[one]))
            front += near.tolist()
    return us, vs


def _compared(batches):
    """Links (u, v) of each group in a stream of (head, block, other, fp, held) sorted by group."""
    import numpy as np
    import pyarrow as pa

    def links(group):
        us, vs = _forest(np.array(list(group)), [np.frombuffer(s, np.uint64) for s in group.values()]) if len(group) > 1 else ([], [])
        both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["u", "v"])

    name, group = None, {}
    for batch in batches:
        for *at, fp, held in zip(*(c.to_pylist() for c in batch.columns)):
            if at != name:
                if len(group) > 1:
                    yield links(group)
                name, group = at, {}
            group[fp] = held  # rows that repeat have one set
    yield links(group)
    release()


def _rooted(fps: DataFrame, found: DataFrame) -> DataFrame:
    """`fps` with the root that components `found` give their fp, its own where they give none."""
    return fps.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _first_links(docs: DataFrame, key: str, owners: DataFrame, stars: DataFrame, width: int) -> DataFrame:
    """Links of sets with the head that they share most signatures with."""
    best = stars.groupBy("u").agg(F.max(F.struct("n", "v")).alias("b")).select(F.col("u").alias("fp"), F.col("b.v").alias("head"))
    copies = best.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("long").alias("copies"))
    best = best.join(copies, "head")
    child = best.select("fp", F.array(F.struct("head", F.pmod(F.xxhash64("fp"), "copies").alias("salt"), F.lit(1).alias("child"))).alias("to"))
    heads = copies.select(F.col("head").alias("fp"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1),
                          lambda k: F.struct("head", k.alias("salt"), F.lit(0).alias("child"))).alias("to"))
    dealt = _held(docs, key, owners, child.unionByName(heads), width).select("head", "salt", "child", "fp", "held")
    dealt = dealt.repartition("head", "salt").sortWithinPartitions("head", "salt", "child")
    return small_batches(dealt).mapInArrow(_with_heads, "u long, v long")


def _last_links(docs: DataFrame, key: str, owners: DataFrame, stars: DataFrame, linked: DataFrame, width: int) -> DataFrame:
    """Links of the sets around each head that the first links leave in several groups: those outside the largest with all."""
    around = stars.select(F.col("u").alias("fp"), F.col("v").alias("head"))
    around = around.unionByName(around.select(F.col("head").alias("fp"), "head").distinct())
    sized = owners.select(F.col("own").alias("fp"), "size")
    around = materialize(_rooted(around, linked).join(sized, "fp"))
    groups = around.groupBy("head", "root").agg(F.sum("size").alias("size"))
    blocks = lambda size: F.ceil(size / BLOCK).cast("long")
    opened = groups.groupBy("head").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("size").alias("all"), F.max(F.struct("size", "root")).alias("top")).filter("groups > 1").select(
        "head", F.col("top.root").alias("top"), blocks(F.col("all")).alias("over"), blocks(F.col("all") - F.col("top.size")).alias("across"))
    # group (i, j) holds block i of the sets outside the largest group and block j of all sets
    dealt = around.join(materialize(opened), "head")
    span = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    i, j = (F.pmod(F.xxhash64(F.lit(k), "fp"), n) for k, n in ((1, "across"), (2, "over")))
    to = F.transform(span(F.col("across")), lambda k: F.struct("head", k.alias("block"), j.alias("other")))
    also = F.transform(span(F.col("over")), lambda k: F.struct("head", i.alias("block"), k.alias("other")))
    roles = dealt.select("fp", F.when(F.col("root") == F.col("top"), to).otherwise(F.array_union(to, also)).alias("to"))
    sets = _held(docs, key, owners, roles, width).select("head", "block", "other", "fp", "held")
    sets = sets.repartition("head", "block", "other").sortWithinPartitions("head", "block", "other")
    return small_batches(sets).mapInArrow(_compared, "u long, v long")


def near_copies(docs: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """doc_id, key, fp and component_id of every row; `key` names a column with a hash of doc_id and text.

    component_id is the smallest doc_id that pairs of similarity 4/5 or more lead to.
    """
    docs = docs.select("doc_id", key, "text")  # other columns may have any name
    rows = materialize(_rows(docs, key, width))
    sets = materialize(rows.groupBy("fp").agg(
        F.min("doc_id").alias("first"), F.min("key").alias("key"), F.max("size").alias("size"), F.min("mark").alias("mark")))
    owners = sets.select("key", F.col("fp").alias("own"), "size")
    alike = materialize(_first_links(docs, key, owners.drop("size"), materialize(_marked(sets.select("fp", "mark"))), width))
    stars = materialize(_stars(docs, key, owners.drop("size"), width))
    known = materialize(components(alike))
    root = lambda c: F.coalesce(f"_{c}", c)  # noqa: E731  a root is no node of its component
    apart = stars.join(known.select(F.col("node").alias("u"), F.col("root").alias("_u")), "u", "left").join(
        known.select(F.col("node").alias("v"), F.col("root").alias("_v")), "v", "left").filter(root("u") != root("v")).select("u", "v", "n")
    linked = materialize(alike.unionByName(_first_links(docs, key, owners.drop("size"), apart, width)))
    more = _last_links(docs, key, owners, stars, components(linked), width)
    found = components(linked.unionByName(more))
    named = materialize(_rooted(sets.select("fp", "first"), found))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", F.col("key").alias(key), "fp").join(named.select("fp", "root").join(first, "root").drop("root"), "fp").select(
        "doc_id", key, "fp", "component_id")
