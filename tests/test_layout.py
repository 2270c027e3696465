"""Layout: fusion, rows, columns, orientation, and the readers before them."""

import json
import random

from pyspark.sql import functions as F

from labelscope.operators import layout, sequence
from labelscope.operators.extract import extract
from labelscope.plans import labels
from labelscope.session import materialize
from labelscope.sources import detections
from tests.cases import LINE_SCHEMA, frame, skewed

WORDS = ("scan_id long,image_index int,word_ord long,pass_index int,text string,x0 double,y0 double,"
         "x1 double,y1 double,confidence double")


def words(spark, groups):
    """groups: per scan, (text, x0, y0, x1, y1, confidence, pass)."""
    rows = [(i, 1, k, p, t, float(a), float(b), float(c), float(d), conf)
            for i, g in enumerate(groups) for k, (t, a, b, c, d, conf, p) in enumerate(g)]
    return spark.createDataFrame(rows, WORDS)


def texts(spark, groups):
    lines = layout.detections_to_lines(layout.upright(words(spark, groups)))
    out = {i: [] for i in range(len(groups))}
    for r in lines.orderBy("scan_id", "y0", "x0").collect():
        out[r.scan_id].append(r.text)
    return out


def row(*parts, y=0, h=20, conf=0.9, p=0):
    return [(t, a, y, b, y + h, conf, p) for t, a, b in parts]


def test_lines(spark):
    got = texts(spark, [
        # a wide gap splits columns, word gaps do not
        row(("MRP", 0, 50), ("Rs", 60, 80), ("60.00", 90, 140), ("NET", 550, 590), ("QTY", 600, 640)),
        # a second pass reads the same words, one of them shorter
        row(("SIX", 0, 60), ("MONTHS", 70, 200)) + row(("SI", 1, 60), ("MONTHS", 71, 200), p=1),
        # a part of a word read by another pass
        row(("250g", 0, 40)) + row(("250", 0, 30), ("g", 30, 40), p=1),
        # equal length: the more confident reading wins
        row(("MFG:2B/JUL/26", 0, 130), conf=0.41) + row(("MFG:28/JUL/26", 0, 130), conf=0.88, p=1),
        # neighbours of one pass stay, stutter goes
        row(("NET", 0, 30), ("NET", 32, 62), ("QTY", 64, 90)),
        # two rows of type whose boxes touch
        row(("MIXED", 0, 90), y=0, h=40) + row(("ROASTED", 0, 90), y=38, h=40),
    ])
    assert got == {0: ["MRP Rs 60.00", "NET QTY"], 1: ["SIX MONTHS"], 2: ["250g"], 3: ["MFG:28/JUL/26"],
                   4: ["NET QTY"], 5: ["MIXED", "ROASTED"]}


def test_upside_down_gives_the_same_declarations(spark):
    panel = [(t, x0, y0, x1, y1, 0.88, 0) for t, x0, y0, x1, y1, *_ in skewed()]
    turned = [(t, 350 - c, 200 - d, 350 - a, 200 - b, conf, p) for t, a, b, c, d, conf, p in panel]
    lines = layout.read_labels(words(spark, [panel, turned]))
    kept = lines.select(*[c.split(" ")[0] for c in LINE_SCHEMA.split(",")])
    found = {}
    for r in extract(materialize(kept)).filter("value is not null").collect():
        found.setdefault(r.scan_id, {})[r.field] = r.value
    assert found[0] == found[1]
    assert found[0]["mrp"] == "20.00" and found[0]["unit_sale_price"] == "0.111"
    assert (found[0]["manufacturing_date"], found[0]["expiry_date"]) == ("27/04/26", "23/10/26")


def test_readers(spark, tmp_path):
    box = [[0.9, 0.2], [10.7, 0.2], [10.7, 5.9], [0.9, 5.9]]
    flat = [[0, 0], [0, 0], [0, 5], [0, 5]]
    new = {"scan_id": 1, "image_path": "b.png", "rec_texts": [" a ", "", "c", "d", "e"],
           "rec_scores": [0.5, 0.6], "rec_polys": [box, box, box, flat]}
    old = {"scan_id": 1, "image_path": "a.png", "result": [[[box, ["x", 0.7]], [box], [box, ["y", None]]]]}
    (tmp_path / "new.json").write_text(json.dumps(new))
    (tmp_path / "old.json").write_text(json.dumps(old))
    raw = detections.read_detections(spark, str(tmp_path / "new.json"), "columnar").unionByName(
        detections.read_detections(spark, str(tmp_path / "old.json"), "nested"))
    got = detections.normalise(detections.number_images(raw)).collect()
    assert sorted((r.image_index, r.text, r.x0, r.x1, r.y1, r.confidence) for r in got) == [
        (1, "x", 0, 10, 5, 0.7), (1, "y", 0, 10, 5, 0.9), (2, "a", 0, 10, 5, 0.5), (2, "c", 0, 10, 5, 0.9)]


def test_manifest(spark):
    rows = [(1, None, None, None), (2, "a.jpg", None, 5), (3, "a.gif", "image/gif", 5), (4, "a", "image/PNG;x", 5),
            (5, "a.png", None, 0)] + [(6, f"{i}.png", None, 1) for i in range(4)]
    out = detections.check_manifest(spark.createDataFrame(
        rows, "scan_id long,filename string,content_type string,length long")).collect()
    assert {r.scan_id: r.error_code for r in out} == {
        1: "MISSING_IMAGES", 2: None, 3: "UNSUPPORTED_FORMAT", 4: None, 5: "INVALID_IMAGE", 6: "TOO_MANY_IMAGES"}


def test_manifest_names_the_same_image_whatever_the_order_of_equal_ordinals(spark):
    rows = [(1, "b.png", None, 0, 1), (1, "a.png", None, 0, 1), (1, "c.png", None, 0, 2)]
    for order in (rows, rows[::-1]):
        uploads = spark.createDataFrame(order, "scan_id long,filename string,content_type string,length long,ordinal int")
        assert [r.filename for r in detections.check_manifest(uploads.coalesce(1)).collect()] == ["a.png"]


def test_oversized_scan_matches_small_chunks(spark, monkeypatch):
    """A scan cut into many chunks gives what one chunk gives: runs, context, neighbours."""
    rng = random.Random(7)
    big, small = [], []
    for i in range(90):
        big.append((f"t{i}" if i % 9 else "MFD", rng.randint(0, 300), 12 * (i // 2), 330, 12 * (i // 2) + 10, 0.9,
                    1 + (i // 7) % 3, None, None))
    for i in range(5):
        small.append((f"s{i}", 0, 20 * i, 50, 20 * i + 10, 0.9, 1, None, None))
    lines = materialize(frame(spark, [big, small]))

    def view():
        ready = materialize(sequence.in_sequence(lines))
        labels = ready.filter("text = 'MFD'")
        found = sequence.value_candidates(labels, ready)
        seq = ready.select("scan_id", "pos", "run", "ctx1", "ctx2", "following.pos").collect()
        near = found.select("scan_id", "pos", "cands.pos").collect()
        order = sequence.positions(lines, ["y0", "x0", "pos"], "rank").select("scan_id", "pos", "rank").collect()
        return sorted(map(tuple, seq)), sorted(map(tuple, near)), sorted(map(tuple, order))

    whole = view()
    monkeypatch.setattr(sequence, "CHUNK", 16)
    assert view() == whole
    ranks = [r for s, _, r in whole[2] if s == 0]
    assert sorted(ranks) == list(range(90))


def test_input_order_and_batch_size_do_not_matter(spark):
    from tests.cases import CASES

    picked = [CASES[k][0] for k in ("offset sticker", "chronology", "two prices", "brand and name")]
    lines = frame(spark, picked)
    pick = ["scan_id", "field", "value", "context", "date_role"]
    one = sorted(map(str, extract(materialize(lines)).select(*pick).collect()))
    mixed = materialize(lines.repartition(5).sortWithinPartitions("text"))
    assert sorted(map(str, extract(mixed).select(*pick).collect())) == one
    alone = materialize(lines.filter("scan_id = 3"))
    assert sorted(map(str, extract(alone).select(*pick).collect())) == [r for r in one if "scan_id=3" in r]


def test_order_past_packed_limits(spark):
    rows = [(1, 1, "a", 0, 70_000), (1, 1, "b", 1, 0), (1, 1, "c", 1, 65_536), (1, 1, "d", 1 << 25, 3), (1, 2, "e", 0, 0)]
    lines = spark.createDataFrame(
        [(*r, 5.0, 5.0) for r in rows], "scan_id long,image_index int,text string,row_index long,column_index int,x0 double,y0 double")
    assert [r.text for r in layout.reading_order(lines).orderBy("pos").collect()] == list("abcde")
    words = labels.label_detections(spark.createDataFrame(
        [(1, 1, p, 0.0, 0.9, " ".join(["w"] * 700)) for p in (0, 1)], "scan_id long,image_index int,pos long,y0 double,confidence double,text string"))
    spans = {r.top: (r.lo, r.hi) for r in words.groupBy((F.col("word_ord") / (1 << 32)).cast("int").alias("top")).agg(
        F.min("word_ord").alias("lo"), F.max("word_ord").alias("hi")).collect()}
    assert spans[0][1] < spans[1][0] and words.select("word_ord").distinct().count() == words.count()
