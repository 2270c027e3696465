"""History, analytics, sinks, streaming and text helpers."""

import datetime as dt
import json
import random

import numpy as np
from pyspark.sql import functions as F

from labelscope.functions import fuzzy
from labelscope.functions import patterns as P
from labelscope.functions import text as T
from labelscope.operators import analytics, audit, history, vocabulary
from labelscope.session import materialize
from labelscope.sources import catalog, detections, sinks
from labelscope.streaming import history_stream

HISTORY = (
    "id string,name string,category string,status string,score double,raw_date timestamp,"
    "violations_count int,declarations_count int,mean_confidence double,is_demo boolean")


def item(i, status="COMPLIANT", score=90.0, day=1, conf=0.9, demo=False, name="Oats", violations=1):
    return (i, name, "Food", status, score, dt.datetime(2026, 7, day), violations, 3, conf, demo)


def table(spark, *items):
    return spark.createDataFrame(list(items), HISTORY)


def test_kpis_and_trend(spark):
    h = table(spark, item("a"), item("b", "NON_COMPLIANT", day=4, conf=0.0), item("c", "WARNING", day=4))
    row = analytics.compliance_kpis(h).first()
    assert (row.total, row.compliant, row.compliance_rate, row.total_violations) == (3, 1, 33.3, 3)
    assert row.avg_confidence == 90.7
    empty = analytics.compliance_kpis(h.limit(0)).first()
    assert (empty.total, empty.compliance_rate, empty.avg_confidence) == (0, 0.0, 0.0)
    days = analytics.daily_trend(h).orderBy("day").collect()
    assert [(d.total, d.passed, d.failed, d.rate) for d in days] == [
        (1, 1, 0, 100.0), (0, 0, 0, 0.0), (0, 0, 0, 0.0), (2, 0, 1, 0.0)]
    week = analytics.in_period(h, "7d", F.lit(dt.date(2026, 7, 8)))
    assert {r.id for r in week.collect()} == {"b", "c"}


def test_bands(spark):
    scores = [(85.0,), (84.5,), (84.4,), (60.0,), (59.4,), (120.0,)]
    got = [r.b for r in spark.createDataFrame(scores, "s double").select(
        analytics.score_band(F.col("s")).alias("b")).collect()]
    high, mid, low = "High Compliance", "Violations Detected", "Severe Non-Compliance"
    assert got == [high, high, mid, mid, low, high]


def test_upsert_load_search_sort(spark):
    old = table(spark, item("a", score=10.0), item("d", demo=True), item("e", score=50.0))
    new = table(spark, item("a", score=70.0, day=2))
    merged = history.upsert(old, new)
    assert sorted((r.id, r.score) for r in merged.collect()) == [("a", 70.0), ("e", 50.0)]
    loaded = history.load(merged, old.filter("is_demo"))
    assert {(r.id, r.source_rank) for r in loaded.collect()} == {("a", 0), ("e", 0), ("d", 1)}
    assert {r.id for r in history.search(old, " OAT ", source="DEMO").collect()} == {"d"}
    assert [r.id for r in history.sort(merged, "score-asc").collect()] == ["e", "a"]


def test_streamed_upserts_equal_one_batch(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "history")
    source.mkdir()

    def drop(n, *rows):
        keys = [c.split(" ")[0] for c in HISTORY.split(",")]
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(keys, r)), default=str) for r in rows))

    stream = history_stream.read_items(spark, str(source), HISTORY)
    for n, rows in enumerate([[item("a", score=10.0), item("b")], [item("a", score=70.0, day=2), item("c")]]):
        drop(n, *rows)
        history_stream.stream_history(stream, root, str(tmp_path / "ck")).awaitTermination(120)
    final = history_stream.read_history(spark, root)
    assert sorted((r.id, r.score) for r in final.collect()) == [("a", 70.0), ("b", 90.0), ("c", 90.0)]


def test_stream_rewrites_touched_buckets_only_and_replays(spark, tmp_path):
    root = str(tmp_path / "h")
    write = history_stream.upsert_batch(root, buckets=16)

    def files():
        return {str(f.relative_to(root)) for f in (tmp_path / "h" / "items").rglob("*.parquet")}

    def state():
        return sorted((r.id, r.score) for r in history_stream.read_history(spark, root).collect())

    write(table(spark, *[item(f"i{k}", score=float(k)) for k in range(60)]), 0)
    before = files()
    two = table(spark, item("i1", score=70.0, day=2), item("new", score=5.0))
    write(two, 1)
    once, added = state(), files() - before
    assert len({f.split("/")[1] for f in added}) <= 2 and before <= files()
    assert once == sorted([(f"i{k}", 70.0 if k == 1 else float(k)) for k in range(60)] + [("new", 5.0)])
    write(two, 1)  # again, as after a failure
    assert state() == once
    write(table(spark, item("i1", score=80.0, day=3)), 2)
    assert ("i1", 80.0) in state() and len(state()) == 61
    assert len(list((tmp_path / "h" / "items").glob("slot=*/bucket=*"))) <= 32
    write(two.limit(0), 3)
    assert len(state()) == 61
    for n in range(4, 4 + history_stream.MAPS):
        write(table(spark, item("i2", score=float(n), day=n)), n)
    assert dict(state())["i2"] == 3.0 + history_stream.MAPS and len(list((tmp_path / "h" / "maps").iterdir())) == history_stream.MAPS


def test_numbered_history_and_odd_letters(spark):
    rows = table(spark, *[item(f"i{k:03d}", score=float(k % 7)) for k in range(100)])
    got = history.numbered(rows.repartition(5), "score-desc").orderBy("place").collect()
    assert [(r.place, r.id) for r in got] == [
        (n, i) for n, (_, i) in enumerate(sorted((-(k % 7), f"i{k:03d}") for k in range(100)), 1)]
    assert history.numbered(rows.limit(0)).count() == 0
    assert fuzzy._rows(["aé", "", "日\x00🙂z"]).tolist() == [[97, 233, 0, 0], [0, 0, 0, 0], [1, 1, 1, 122]]
    assert fuzzy.keyword_bits([]).tolist() == [] and fuzzy.keyword_bits([""]).tolist() == [0]


def test_csv_and_json(spark, tmp_path):
    evidence = "struct<value:string,image_index:int,bbox:array<double>>"
    result = spark.createDataFrame([(
        7, ("packaged_commodity", 'Oats "A"'), "WARNING", 50,
        [("mrp", "60.00", 0.905, 2, [1.0, 2.5, 3.0, 4.0]), ("dimensions", "1 x 2", 0.0, None, None)],
        [("net_quantity", "WARNING", "PCR-R03", "unit?", None)])],
        "scan_id long,product struct<type:string,name:string>,overall_status string,score int,"
        "declarations array<struct<field:string,value:string,confidence:double,image_index:int,bbox:array<double>>>,"
        f"violations array<struct<field:string,status:string,rule_id:string,reason:string,evidence:{evidence}>>")
    rows = {r["Field"]: r for r in sinks.csv_findings(result).collect()}
    assert rows["Mrp"]["Bounding Box Coordinates"] == "[1; 2.5; 3; 4]" and rows["Mrp"]["Confidence"] == "91%"
    assert rows["Dimensions"]["Confidence"] == "N/A" and rows["Dimensions"]["Surface Index"] == "1"
    assert rows["Net Quantity"]["Record Type"] == "VIOLATION"
    assert rows["Net Quantity"]["Detected Text / Value"] == "N/A"
    sinks.write_csv(result, str(tmp_path / "csv"))
    written = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '"Oats ""A"""' in written and written.startswith('"Record Type"')
    sinks.write_json(result, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().product.name == 'Oats "A"'
    items = history.history_items(result, F.lit("2026-07-01")).first()
    assert (items.id, items.violations_count, items.declarations_count, items.mean_confidence) == ("7", 1, 2, 0.9)


def test_guidance_and_surface(spark):
    df = spark.createDataFrame([
        ("net_quantity", ""), ("mrp", ""), ("expiry_date", ""), ("x", "license gone"), ("consumer_care", ""),
        ("manufacturer", ""), ("x", "y"), ("mrp", "no unit")], "f string,r string")
    got = [r.g for r in df.select(audit.guidance(F.col("f"), F.col("r")).alias("g")).collect()]
    advice = [g[2] for g in audit.GUIDANCE]
    assert got == [*advice, audit.DEFAULT_GUIDANCE, advice[0]]
    box = spark.createDataFrame([(10.0, 20.0, 5.0, 20.0, 100, 50)], "a double,b double,c double,d double,w int,h int")
    row = box.select(T.percent_box(*[F.col(c) for c in "abcdwh"]).alias("p")).first().p
    assert (row.left_pct, row.top_pct, row.width_pct, row.height_pct) == (5.0, 40.0, 5.0, 4.0)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def slow_score(text, word):
    """Brute force: whole, best part of the longer string, and word set."""
    def part(short, long):
        cuts = [long[i:i + len(short)] for i in range(len(long) - len(short) + 1)]
        cuts += [long[:i] for i in range(1, len(short))] + [long[-i:] for i in range(1, len(short))]
        return max(ratio(short, c) for c in cuts)

    best = max(ratio(text, word), part(*sorted((text, word), key=len)))
    if len(text) == len(word):
        best = max(best, part(word, text))
    a, b = set(text.split()), set(word.split())
    both = " ".join(sorted(a & b))
    left, right = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if both and (not left or not right):
        return 100.0
    la, lb = ((both + " " + left) if both else left), ((both + " " + right) if both else right)
    gap = len(left) + len(right) - 2 * lcs(left, right)
    best = max(best, 100 - 100 * gap / (len(la) + len(lb)))
    return max(best, ratio(both, la), ratio(both, lb)) if both else best


def test_similarity_matches_brute_force():
    rng = random.Random(3)
    words = [w for s in fuzzy.KEYWORD_SETS for w in s]
    sample = ["onsen for:", "manufaotured by", "mfd by", "product 0f", "by the packer", "in made of"]
    for _ in range(150):
        base = rng.choice(words + ["salted snack", "best before use", "abc def"])
        letters = [rng.choice("abcdefimnoprtu y") if rng.random() < 0.35 else c for c in base]
        sample.append((" ".join("".join(letters).split()) + rng.choice(["", ":", " x1", " foods"])) or "x")
    for word in words:
        want = [slow_score(t, word) for t in sample]
        assert np.allclose(fuzzy.scores(sample, word), want), word
    bits = fuzzy.keyword_bits(sample)
    for n, group in enumerate(fuzzy.KEYWORD_SETS):
        want = [max(slow_score(t, w) for w in group) >= P.FUZZY_THRESHOLD for t in sample]
        assert [bool(b >> n & 1) for b in bits] == want


def test_vocabulary(spark):
    tokens = ["snack", "snak", "chps", "namkeeh", "bhelpunri", "biscults", "nufs", "care", "oil", "oik", "xyz"]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {r.token: r.word for r in vocabulary.match_words(df).collect()}
    assert got == {"snack": "snack", "snak": "snack", "chps": "chips", "namkeeh": "namkeen",
                   "bhelpunri": "bhelpuri", "biscults": "biscuit", "oil": "oil"}


def test_units(spark):
    pairs = [("400", "g"), ("2", "Ltrs."), ("400", "9"), ("5", "kq"), ("4009", None), ("4000", None), ("3", "zzz")]
    df = spark.createDataFrame(pairs, "n string,u string").withColumn(
        "r", T.resolve_unit(F.col("n"), F.col("u"), True)).select("r.*")
    assert [tuple(r) for r in df.collect()] == [
        ("400", "g", "exact"), ("2", "l", "alias"), ("400", "g", "repaired"), ("5", "kg", "repaired"),
        ("400", "g", "swallowed"), ("4000", None, None), ("3", None, None)]


def test_rescale(spark):
    df = spark.createDataFrame([(5, 7, 11, 13)], "x0 int,y0 int,x1 int,y1 int")
    assert tuple(detections.rescale(df, F.lit(2.0)).first()) == (2, 4, 6, 6)


def test_search_for_several_words_shuffles_no_results(spark):
    """Every result of a rule that some word finds comes once, read in one pass; only rules are made distinct."""
    results = materialize(spark.range(200).selectExpr(
        "id div 10 as scan_id", "format_string('PCR-R%02d', id % 10 + 1) as rule_id", "'f' as field", "'FAIL' as status", "'r' as reason"))
    known = catalog.attach_exceptions(catalog.rules(spark), catalog.exceptions(spark))
    words = ("sale", "retail price", "verified")
    each = [set(audit.search_findings(results, known, w).collect()) for w in words]
    found = audit.search_findings(results, known, words[0], "ALL", "all", *words[1:])
    rows = found.collect()
    assert len(rows) == len(set(rows)) and set(rows) == set.union(*each) and len(set(map(len, each))) > 1
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
