"""Order-dependent layout and table jobs against plain folds, and on images too crowded for all pairs or one array."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from labelscope.functions import patterns as P
from labelscope.functions import text as T
from labelscope.operators import grid, layout, prominence, sequence, tables
from labelscope.operators import vocabulary as vocabulary_jobs
from labelscope.session import CLEANUP, materialize

WORDS = ("scan_id long, image_index int, word_ord long, pass_index int, text string, x0 double, y0 double, x1 double, y1 double,"
         " confidence double")
LINES = ("scan_id long, run long, pos long, image_index int, text string, x0 double, y0 double, x1 double, y1 double,"
         " confidence double, ctx2 string")


# --- value candidates -------------------------------------------------------------
def near_lines(lines, count=5):
    """Places of the lines that may hold each line's value, by every pair."""
    out = {}
    for a in lines:
        found = []
        for b in lines:
            if a[:2] == b[:2] and a[2] != b[2]:
                h = max(1.0, a[8] - a[6], b[8] - b[6])
                right, below = (b[5] - a[7]) / h, (b[6] - a[8]) / h
                overlap = min(a[7], b[7]) > max(a[5], b[5])
                if b[5] >= a[7] - .25 * h and abs((b[6] + b[8]) / 2 - (a[6] + a[8]) / 2) <= .6 * h and right <= 4:
                    found.append((round(right, 3), 0, b[2]))
                elif b[6] >= a[8] - .25 * h and (overlap or abs(b[5] - a[5]) <= h) and below <= 2:
                    found.append((round(below, 3), 1, b[2]))
        out[a[:3]] = [p for _, _, p in sorted(found)[:count]]
    return out


def candidates(spark, lines):
    df = materialize(spark.createDataFrame([(*x[:4], "t", *x[5:9], 0.9, "c") for x in lines], LINES).withColumn(
        "following", F.expr("cast(array() as array<struct<pos:bigint,image_index:int,text:string,confidence:double,x0:double,y0:double,x1:double,y1:double,ctx2:string>>)")))
    found = sequence.value_candidates(df, df)
    return {(r.scan_id, r.run, r.pos): r.near for r in found.select("scan_id", "run", "pos", F.col("cands.pos").alias("near")).collect()}


def box(scan, run, pos, x0, y0, w, h):
    return (scan, run, pos, 1, "", float(x0), float(y0), float(x0 + w), float(y0 + h))


def test_value_candidates_by_every_pair(spark):
    rng = random.Random(1)
    lines = [box(s, s % 2, p, rng.randint(0, 500), rng.randint(0, 300), rng.choice([0, 8, 40, 400]), rng.choice([0, 8, 16, 17, 90]))
             for s in range(6) for p in range(80)]
    lines += [box(9, 0, 0, -10, -10, 4e9, 3e9), box(9, 0, 1, 5, 5, 10, 10), box(9, 0, 2, 30, 5, 10, 10), box(9, 0, 3, 2e9, 7, 10, 1e9)]
    lines += [box(10, 0, p, 0, 0, 50, 10) for p in range(4)]  # equal boxes: no geometry
    got, want = candidates(spark, lines), near_lines(lines)
    assert {k: v for k, v in got.items() if k[0] < 10} == {k: v for k, v in want.items() if k[0] < 10}
    assert all(not got[10, 0, p] for p in range(4))


def test_one_long_row_pairs_its_neighbours_only(spark):
    n = 20_000
    lines = [box(1, 0, p, 60 * p, 3 * (p % 2), 50, 12) for p in range(n)] + [box(2, 0, p, 0, 0, 9, 9) for p in range(n)]
    started = time.time()
    got = candidates(spark, lines)
    assert got[1, 0, 5][:2] == [6, 7] or got[1, 0, 5][0] == 6
    assert len(got) == 2 * n and max(len(v) for v in got.values()) <= 5 and time.time() - started < 120


# --- fusion and rows ----------------------------------------------------------------
def key_of(text):
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum())


def folded_rows(words):
    """(row_index, texts from left to right) of one image's words (ord, pass, text, x0, y0, x1, y1, conf) by plain folds."""
    def area(w):
        return (w[5] - w[3]) * (w[6] - w[4])

    def repeats(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        inter = w * h if w > 0 and h > 0 else 0
        if a[1] == b[1] or not inter:
            return False
        union, small = area(a) + area(b) - inter, min(area(a), area(b))
        over = inter / union if union > 0 else 0
        return key_of(a[2]) == key_of(b[2]) and over >= P.SAME_TOKEN_IOU or over >= P.STRONG_IOU or small > 0 and inter / small >= P.CONTAINMENT

    kept = []
    for w in sorted(words, key=lambda w: (w[4], w[3], w[0])):
        at = next((k for k, old in enumerate(kept) if repeats(w, old)), None)
        if at is None:
            kept.append(w)
        elif (len(key_of(w[2])), w[7]) > (len(key_of(kept[at][2])), kept[at][7]):
            kept[at] = w
    rows = []
    for w in sorted(kept, key=lambda w: ((w[4] + w[6]) / 2, w[3], w[0])):
        c, h = (w[4] + w[6]) / 2, max(1.0, w[6] - w[4])
        row = next((r for r in rows if abs(c - r[0]) <= P.ROW_CENTRE_TOLERANCE * min(h, sorted(r[1])[len(r[1]) // 2])), None)
        if row is None:
            rows.append([c, [h], [w]])
        else:
            row[1].append(h)
            row[2].append(w)
            row[0] += (c - row[0]) / len(row[1])
    rows.sort(key=lambda r: r[0])
    return {k: [w[2] for w in sorted(r[2], key=lambda w: w[3])] for k, r in enumerate(rows)}


def test_rows_by_plain_folds(spark):
    rng, images = random.Random(2), {}
    for scan in range(30):
        words = []
        for k in range(rng.randint(1, 70)):
            if k and rng.random() < .4:  # read again, nearly in place
                _, _, t, x0, y0, x1, y1, _ = words[-rng.randint(1, min(k, 6))]
                x0, y0, x1, y1 = (v + rng.randint(-2, 2) for v in (x0, y0, x1, y1))
                t = rng.choice([t, t + "x", t[:-1] or "q"])
            else:
                x0, y0 = rng.randint(0, 400), rng.randint(0, 160)
                x1, y1, t = x0 + rng.randint(5, 60), y0 + rng.randint(6, 25), rng.choice(["MRP", "NET", "12", "ab", "QTY", "-"])
            words.append((k, rng.randint(0, 2 if scan % 3 else 0), t, float(x0), float(y0), float(max(x1, x0 + 1)), float(max(y1, y0 + 1)), rng.randint(1, 99) / 100))
        images[scan] = words
    df = spark.createDataFrame([(s, 1, *w) for s, words in images.items() for w in words], WORDS).repartition(5)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("10000", "7"):  # rows that go on in the next batch
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got = {s: {} for s in images}
            for r in layout.cluster_rows(layout.fuse_passes(layout.upright(df))).collect():
                got[r.scan_id][r.row_index] = [w.text for w in r.words]
            assert got == {s: folded_rows(words) for s, words in images.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_slanted_page(spark):
    """25,000 words, each read twice, on rows that all overlap vertically: one island, small groups, few open rows."""
    n, per = 25_000, 500
    words = spark.range(2 * n).select(
        F.lit(1).cast("long").alias("scan_id"), F.lit(1).alias("image_index"), F.col("id").alias("word_ord"), (F.col("id") % 2).cast("int").alias("pass_index"),
        F.concat(F.lit("w"), F.floor(F.col("id") / 2)).alias("text"), F.floor(F.col("id") / 2).alias("k")).select(
        "*", (F.col("k") % per * 70.0 + F.col("pass_index")).alias("x0"), (F.floor(F.col("k") / per) * 30.0 + F.col("k") % per * 3.0).alias("y0")).select(
        "*", (F.col("x0") + 60).alias("x1"), (F.col("y0") + 14).alias("y1"), F.lit(0.9).alias("confidence"))
    started = time.time()
    fused = materialize(layout.fuse_passes(layout.upright(words)))
    assert fused.count() == n
    rows = layout.cluster_rows(fused).agg(F.sum(F.size("words")).alias("n"), F.max(F.size("words")).alias("most"), F.count_distinct("row_index").alias("rows"),
                                          F.max("row_index").alias("last")).collect()[0]
    assert rows.n == n and rows.rows == rows.last + 1 and time.time() - started < 180


# --- tables ---------------------------------------------------------------------------
def test_greedy_matching(spark):
    rng = random.Random(3)
    claims = [(s, 0, l, v, (rng.choice([.5, .75, 1.0]), -float(rng.randint(0, 3)), v, l, l, v))
              for s in range(40) for l in range(8) for v in range(8) if rng.random() < .5]
    want = set()
    for s in range(40):
        used_l, used_v = set(), set()
        for c in sorted((c for c in claims if c[0] == s), key=lambda c: c[4], reverse=True):
            if c[2] not in used_l and c[3] not in used_v:
                used_l.add(c[2])
                used_v.add(c[3])
                want.add((s, 0, c[2], c[3]))
    df = spark.createDataFrame(claims, "scan_id long, run long, l_pos long, v_pos long, claim struct<overlap:double,near:double,v_rank:long,l_rank:long,l_pos:long,v_pos:long>")
    assert set(map(tuple, tables.dominant_matching(df).collect())) == want
    assert tables.dominant_matching(df.limit(0)).count() == 0


def test_wraps_by_a_plain_fold():
    rng = random.Random(4)
    for _ in range(300):
        hosts = [[float(rng.randint(0, 60)), -k, k, float(x := rng.randint(0, 30)), float(x + rng.randint(1, 20)), float(rng.randint(4, 12)),
                  rng.choice([None, rng.randint(0, 12)])] for k in range(rng.randint(0, 5))]
        loose = sorted([float(rng.randint(0, 90)), 100 + k, 0.0, float(x := rng.randint(0, 30)), float(x + rng.randint(1, 20)), float(rng.randint(4, 12)), rng.randint(0, 12)]
                       for k in range(rng.randint(0, 9)))
        for w in loose:
            w[2] = w[0] + w[5]
        events = sorted([(h[0], 0, h[2], h[2], h[1], h[0], *h[3:7]) for h in hosts] + [(w[0], 1, w[1], None, None, w[2], *w[3:7]) for w in loose], key=lambda e: e[:3])
        sweep = tables.Wraps()
        got = [x[:2] for e in events for x in sweep.add(*e)]
        want, now = [], [list(h) for h in hosts]
        for y0, pos, y1, x0, x1, h, row in loose:
            fits = [p for p in now if 0 <= y0 - p[0] <= P.WRAP_GAP_RATIO * p[5] and min(p[4], x1) > max(p[3], x0)]
            if fits:
                best = max(fits, key=lambda p: p[:3])
                if best[6] is None or not best[6] < row:
                    best[0], best[3], best[4], best[5] = y1, x0, x1, h
                    want.append((best[2], pos))
        assert got == want


# --- phrases ----------------------------------------------------------------------------
def test_phrases_of_a_long_stretch(spark):
    """50,000 lines that touch: some join, some don't; the sweep holds one phrase."""
    n = 50_000
    lines = spark.range(n).select(
        F.lit(1).cast("long").alias("scan_id"), F.lit(1).alias("image_index"), F.col("id").alias("pos"), F.concat(F.lit("t"), "id").alias("text"),
        F.lit(0.0).alias("x0"), (F.col("id") * 10.0).alias("y0"), F.lit(100.0).alias("x1"),
        (F.col("id") * 10.0 + F.when(F.col("id") % 50 == 0, 30).otherwise(10)).alias("y1"), F.lit(0.9).alias("confidence"))
    got = prominence.phrases(lines).orderBy("idx").collect()
    heights, want = None, []
    for k in range(n):  # the same rule, line by line
        y0, y1 = 10.0 * k, 10.0 * k + (30 if k % 50 == 0 else 10)
        if heights:
            top, low = heights
            a, b = low - top, y1 - y0
            if abs(a - b) <= P.JOIN_HEIGHT_TOLERANCE * max(a, b) and -b <= y0 - low <= P.JOIN_GAP_RATIO * min(a, b):
                heights = top, max(low, y1)
                want[-1].append(k)
                continue
        heights = y0, y1
        want.append([k])
    assert [r.text for r in got] == [" ".join(f"t{k}" for k in part) for part in want] and [r.idx for r in got] == list(range(len(want)))


# --- components -----------------------------------------------------------------------
def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(0, k, k + 1) for k in range(300)] + [(1, 0, k) for k in range(1, 200)] + [(2, a, b) for a, b in (rng.sample(range(60), 2) for _ in range(40))]
    got = {(r.page, r.node): r.root for r in grid.components(spark.createDataFrame(edges, "page long, u long, v long"), ["page"]).collect()}
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for p, a, b in edges:
        x, y = find((p, a)), find((p, b))
        root[max(x, y)] = min(x, y)
    assert got == {(p, k): find((p, k))[1] for p, *ends in edges for k in ends}


def test_token_key_is_what_the_folds_use(spark):
    texts = ["MFG:2B/JUL", "é-É", "", "12 ab"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.token_key(F.col("t")).alias("k")).collect()
    assert [r.k for r in got] == [key_of(t) for t in texts]


# --- vocabulary -------------------------------------------------------------------------
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_words_of_a_table(spark):
    """A vocabulary from a table: near misses by the deletion index are those of every pair."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    vocabulary = sorted({word(rng.randint(2, 12)) for _ in range(250)})
    tokens = set(vocabulary[:20])
    for w in vocabulary + [word(rng.randint(1, 15)) for _ in range(100)]:
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(w))
            w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcdef") + w[k:], w[:k] + rng.choice("abcdef") + w[k + 1:]])
        tokens.add(w)
    want = {}
    for t in tokens:
        if t in vocabulary:
            want[t] = t
            continue
        budget = 0 if len(t) < 5 else 1 if len(t) <= 7 else 2
        near = [w for w in vocabulary if len(w) >= 5 and (
            len(t) == 4 and len(w) == 5 and edits(t, w) == 1 if len(t) < 5 else edits(t, w) <= budget)]
        if near:
            want[t] = min(near)
    df = spark.createDataFrame([(t,) for t in tokens] * 2, "token string")
    words = spark.createDataFrame([(w,) for w in vocabulary * 2], "word string")
    got = vocabulary_jobs.match_words(df, vocabulary=words).collect()
    assert {r.token: r.word for r in got} == want and len(got) == len(want)
    assert vocabulary_jobs.match_words(df, vocabulary=words.limit(0)).count() == 0


def test_a_large_vocabulary(spark):
    words = spark.range(300_000).select(F.regexp_replace(F.md5(F.col("id").cast("string")), "[0-9]", "").substr(1, 11).alias("word"))
    tokens = words.limit(2_000).select(F.concat(F.col("word").substr(1, 4), F.lit("z"), F.col("word").substr(6, 20)).alias("token"))
    tokens = materialize(tokens.filter(F.length("token") >= 9))
    started = time.time()
    assert vocabulary_jobs.match_words(tokens, vocabulary=materialize(words)).count() == tokens.distinct().count()
    assert time.time() - started < 150


def test_order_statistics(spark):
    rng = random.Random(7)
    groups = {k: [float(rng.choice([3, 5, 8, rng.randint(0, 99)])) for _ in range(rng.randint(1, 40))] for k in range(60)}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k long, h double")
    for part in (2, 4):
        got = prominence.nth_smallest(rows, ["k"], "h", F.floor(F.col("n") / part), "v").collect()
        assert {r.k: r.v for r in got} == {k: sorted(v)[len(v) // part] for k, v in groups.items()}


# --- round 3: evidence (F3 to F5, F8, F9, F12, F14 to F16) -------------------------
def test_similarity_compares_each_text_of_a_task_once(monkeypatch):
    import pandas as pd

    from labelscope.functions import fuzzy

    compared, real = [], fuzzy.keyword_bits
    monkeypatch.setattr(fuzzy, "keyword_bits", lambda texts: compared.extend(texts) or real(texts))
    batch = pd.Series(["Manufactred by", None, "Salted snack", "Manufactred by"])
    first, second = fuzzy._bits_udf.func(iter([batch, batch]))
    label, other = real(["Manufactred by", "Salted snack"])
    assert first.tolist() == second.tolist() == [label, 0, other, label]
    assert sorted(compared) == ["Manufactred by", "Salted snack"]


def test_similarity_bits_are_those_of_the_whole_scores():
    import random

    import numpy as np

    from labelscope.functions import fuzzy
    from labelscope.functions import patterns as P

    dice, words = random.Random(5), [w for s in fuzzy.KEYWORD_SETS for w in s]

    def garbled():
        text = list(dice.choice(words) + dice.choice(["", "", " India", " of snack", ": x"]))
        for _ in range(dice.randrange(7)):
            text[dice.randrange(len(text))] = dice.choice("abeimnoy 0:\u00e9")
        return "".join(text)[dice.randrange(4):].strip() or "x"

    texts = sorted({garbled() for _ in range(1500)})
    bits = fuzzy.keyword_bits(texts)
    for n, keywords in enumerate(fuzzy.KEYWORD_SETS):
        best = np.max([fuzzy.scores(texts, w) for w in keywords], axis=0)
        assert ((bits >> n & 1) == (best >= P.FUZZY_THRESHOLD)).all()


def test_few_boxes_meet_in_one_cell(spark):
    from pyspark.sql import functions as F

    from labelscope.operators import grid

    boxes = grid.reaching(
        spark.range(10).select(F.lit(1).alias("g"), "id"), F.col("id") * 7, F.col("id") * 7 + 20 * F.col("id"), F.lit(0), F.col("id") * 9)
    cells = grid.in_cells(boxes.join(grid.cell_sizes(boxes, ["g"]), "g"))
    assert cells.count() == 10  # copies in several cells each before
    met = cells.alias("a").join(cells.alias("b"), grid.meeting("a", "b", ["g"]) & (F.col("a.id") < F.col("b.id")))
    assert met.count() == met.select("a.id", "b.id").distinct().count() == 45


def test_fields_of_a_scan_are_chosen_and_assembled_in_one_shuffle(spark):
    from labelscope.operators import extract

    rows = extract.blank_scans(spark.range(3).withColumnRenamed("id", "scan_id"))
    made = extract.assemble(extract.choose(rows))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(made.filter("value is null").groupBy("scan_id").count().collect()) == [(0, 11), (1, 11), (2, 11)]


def test_cheap_tests_pass_every_text_that_folds_to_a_pattern(spark):
    from pyspark.sql import functions as F

    from labelscope.functions import patterns as P
    from labelscope.functions import text as T

    cases = [
        ("MFD BY", P.MAKER_ALONE, P.MAKER_PARTS), ("Manufactured for:", P.MAKER_ALONE, P.MAKER_PARTS),
        ("Pac\u212aer", P.AGENT_ALONE, P.AGENT_PARTS), ("\u0131mporter", P.AGENT_ALONE, P.AGENT_PARTS),
        ("Commod\u0131ty", P.NAME_ALONE, P.NAME_PARTS), ("NET QTY", P.QTY_ALONE, P.QTY_PARTS),
        ("M.R.P. 5", P.MRP_LABEL, P.MRP_PARTS), ("U\u017fP 5", P.USP_VALUE, P.USP_PARTS),
        ("5 PER g", P.PER_UNIT_PRICE, P.PER_UNIT_PARTS), ("\u20b9 5", P.CURRENCY_AMOUNT, P.CURRENCY_PARTS),
        ("SIZE 5x6", P.DIMENSIONS, P.DIMENSION_PARTS), ("Careline", P.CARE_WORDS, P.CARE_PARTS),
        ("Produce of X", P.ORIGIN_VALUE, P.ORIGIN_PARTS), ("Pac\u212aing", P.MFG_WORDS + "|pac", P.MFG_PARTS),
        ("Use By", P.EXP_WORDS, P.EXP_PARTS), ("expiry", P.DURATION_LABEL, P.EXP_PARTS)]
    one = spark.range(1).select(*[
        F.struct(T.found(F.lit(t), p).alias("f"), T.says(F.lower(F.lit(t)), *parts).alias("s")).alias(f"c{i}")
        for i, (t, p, parts) in enumerate(cases)]).first()
    assert all(c["f"] and c["s"] for c in one)
    assert not spark.range(1).select(T.says(F.lit("salted snack"), *P.MAKER_PARTS)).first()[0]
    ends = ["a", " a", "a\u00a0", "\u2003a b\t", "", " ", "a\u0085", "\u00e9 "]
    both = spark.createDataFrame([(t,) for t in ends], "t string").filter(~T.trimmed(F.col("t")).eqNullSafe(T.strip_space(F.col("t"))))
    assert both.count() == 0


def test_only_reads_of_later_passes_look_for_earlier_ones(spark, monkeypatch):
    seen, real = [], grid.meeting
    monkeypatch.setattr(grid, "meeting", lambda *a: seen.append(a) or real(*a))
    made = {}
    monkeypatch.setattr(grid, "components", lambda edges, keys: made.setdefault("edges", edges))
    # 30 words of the first pass, and three of later passes: the first two repeat words, the third a repeat
    rows = [(1, 1, i, 0, f"w{i}", 20.0 * i, 0.0, 20.0 * i + 18, 10.0, 0.9) for i in range(30)]
    rows += [(1, 1, 30, 1, "w3", 61.0, 0.0, 79.0, 10.0, 0.9), (1, 1, 31, 2, "w3", 60.0, 1.0, 78.0, 11.0, 0.9),
             (1, 1, 32, 1, "w5", 100.0, 40.0, 118.0, 50.0, 0.9)]
    words = materialize(layout.upright(spark.createDataFrame(rows, WORDS)))
    try:
        layout.repeated_reads(words)
    except Exception:  # edges go no further here
        pass
    edges = made["edges"]
    assert {frozenset((r["u"], r["v"])) for r in edges.collect()} == {frozenset(p) for p in ((3, 30), (3, 31), (30, 31))}
    assert "pass_index" in edges._jdf.queryExecution().optimizedPlan().toString() and "_first" in edges._jdf.queryExecution().optimizedPlan().toString()


def turned_words(rng, scans):
    """Words of images read in up to three passes, one of them with more words than meet in one cell."""
    rows = []
    for scan in range(scans):
        kept = []
        for k in range(rng.randint(1, 60) if scan else layout.FEW_WORDS + 40):
            if k and rng.random() < .4:
                x0, y0, x1, y1, t = kept[-rng.randint(1, min(k, 5))]
                x0, y0, x1, y1 = (v + rng.randint(-2, 2) for v in (x0, y0, x1, y1))
                t = rng.choice([t, t + "x", t[:-1] or "q"])
            else:
                x0, y0 = rng.randint(0, 400), rng.randint(0, 160)
                x1, y1, t = x0 + rng.randint(5, 60), y0 + rng.randint(6, 25), rng.choice(["MRP", "NET", "12", "ab", "QTY", "-"])
            kept.append((x0, y0, max(x1, x0 + 1), max(y1, y0 + 1), t))
            x0, y0, x1, y1, t = kept[-1]
            rows.append((scan, 1, k, rng.randint(0, 2 if scan % 3 != 1 else 0), t, float(x0), float(y0), float(x1), float(y1), rng.randint(1, 99) / 100))
    return rows


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_are_dealt_out_once_for_lines_of_both_frames(spark):
    rows = turned_words(random.Random(8), 25)
    words = materialize(spark.createDataFrame(rows, WORDS).repartition(5))
    upright = layout.cluster_rows(layout.fuse_passes(layout.upright(words)))
    both = layout.lines_both_ways(words)
    assert shuffles(upright) == shuffles(both) == 1  # words met their extents, groups and rows by a shuffle each before
    got = {(f, s): {} for f in (0, 1) for s in range(25)}
    for r in both.collect():
        got[r.frame, r.scan_id].setdefault(r.row_index, []).extend((r.column_index, w.word_ord) for w in r.words)
    for scan in range(25):
        image = [r[2:] for r in rows if r[0] == scan]
        w, h = max(r[5] for r in image), max(r[6] for r in image)
        turned = [(k, p, t, w - x1, h - y1, w - x0, h - y0, c) for k, p, t, x0, y0, x1, y1, c in image]
        for frame, words_of in enumerate((image, turned)):
            texts = {r[0]: r[2] for r in words_of}
            want = folded_rows(words_of)
            assert got[frame, scan].keys() == want.keys()
            for row, found in got[frame, scan].items():  # stutter goes, so what is read is some of what the row holds
                seen = iter(want[row])
                assert all(texts[k] in seen for _, k in sorted(found, key=lambda f: f[0]))
    framed = layout.detections_to_lines(layout.both_frames(words))
    pick = ["scan_id", "frame", "row_index", "column_index", "text", "x0", "y0"]
    assert sorted(map(tuple, framed.select(*pick).collect())) == sorted(map(tuple, both.select(*pick).collect()))


def test_images_of_moderate_size_meet_in_one_cell(spark, monkeypatch):
    rows = turned_words(random.Random(9), 4)
    words, made, made_cells, real = materialize(layout.upright(spark.createDataFrame(rows, WORDS))), {}, [], grid.in_cells
    monkeypatch.setattr(grid, "in_cells", lambda boxes: made_cells.append(real(boxes)) or made_cells[-1])
    monkeypatch.setattr(grid, "components", lambda edges, keys: made.setdefault("edges", edges).selectExpr(*keys, "u as node", "v as root"))
    layout.repeated_reads(words)
    copies = {r.scan_id: r["count"] for r in made_cells[0].groupBy("scan_id").count().collect()}
    sizes = {s: sum(r[0] == s for r in rows) for s in range(4)}
    assert copies[0] > sizes[0] and all(copies[s] == sizes[s] for s in (1, 2, 3))  # up to four copies of each word before
    by_cells = {(r.scan_id, r.u, r.v) for r in made["edges"].collect()}
    monkeypatch.setattr(layout, "FEW_WORDS", 5)
    made.clear()
    layout.repeated_reads(words)
    assert by_cells == {(r.scan_id, r.u, r.v) for r in made["edges"].collect()}


def test_a_round_of_components_takes_one_shuffle(spark):
    edges = materialize(spark.createDataFrame([(1, k, k + 1) for k in range(0, 40, 2)], "page long, u long, v long"))
    assert shuffles(grid._stars(edges, ["page"])) == 1


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in Path(str(d)).rglob("shuffle_*")}


def test_shuffles_go_with_the_write_that_made_them(spark):
    before, conf = shuffle_files(spark), spark.conf.get(CLEANUP)
    table = materialize(spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).count(), free=True)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and table.count() == 5_000 and spark.conf.get(CLEANUP) == conf


def test_the_choice_of_frames_is_worked_out_once(spark):
    words = materialize(spark.createDataFrame(turned_words(random.Random(10), 6), WORDS))
    assert shuffles(layout.read_labels(words)) <= 3  # lines and choice by page, lines by scan; the scores were in it before, for each use
