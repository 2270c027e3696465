"""Tables: blocks, pairs and merged lines without joins of a block's lines, and the same rows by either way."""

import pytest
from pyspark.sql import functions as F

from labelscope.operators import grid, sequence, tables
from labelscope.plans import labels
from labelscope.session import materialize

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    """Label tables of 200 scans, a second image with a garbled label, and a block of forty rows without row numbers."""
    lower = lambda c: F.col(c) + F.when(F.col("text") == "13:46", 24).otherwise(0)
    made = labels.label_table(spark, FOLDER).withColumns({"y0": lower("y0"), "y1": lower("y1")})  # wrapped below the last value
    garbled = made.filter("scan_id < 30").withColumns({
        "image_index": F.lit(2), "pos": F.col("pos") + 11, "text": F.regexp_replace("text", "BATCH NO", "MANUFACTURD BY")})
    tall = spark.range(80).select(
        F.lit(1000).cast("long").alias("scan_id"), F.col("id").alias("pos"), F.lit(1).alias("image_index"),
        F.when(F.col("id") % 2 == 0, "MFD.").otherwise(F.concat(F.lit("v"), "id")).alias("text"),
        F.when(F.col("id") % 2 == 0, 50.0).otherwise(180.0).alias("x0"), (F.floor(F.col("id") / 2) * 25.0 + F.col("id") % 2 * 4).alias("y0"),
        F.when(F.col("id") % 2 == 0, 140.0).otherwise(300.0).alias("x1"), (F.floor(F.col("id") / 2) * 25.0 + F.col("id") % 2 * 4 + 16).alias("y1"),
        F.lit(None).cast("int").alias("row_index"), F.lit(None).cast("int").alias("column_index"), F.lit(0.9).alias("confidence"))
    return materialize(made.unionByName(garbled).unionByName(tall))


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of the stage tables that the step writes, joins not broadcast."""
    seen = []

    def noted(df):
        seen.append(plan(df))
        return materialize(df)

    monkeypatch.setattr(tables, "materialize", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


def test_blocks_and_merged_lines_deal_lines_once(spark, lines, plans):
    members = tables.table_blocks(lines)
    assert all("Join" not in p for p in plans)
    assert [p.count("Exchange hashpartitioning") for p in plans[:1]] == [1]
    assert members.filter("scan_id = 1000").count() == 80
    wrong = members.filter("text like 'MANUFACTURD%'").count()
    assert 0 < wrong  # a label read wrongly is still one
    merged = tables.merged_lines(members, materialize(tables.table_pairs(members)))
    assert "Join" not in plan(merged) and plan(merged).count("Exchange hashpartitioning") == 1


def test_merged_columns_of_oversized_scans(lines, monkeypatch):
    whole = rows(tables.merge_columns(lines))
    assert sum("merged=True" in r for r in whole) > 900
    monkeypatch.setattr(sequence, "CHUNK", 16)
    assert rows(tables.merge_columns(lines)) == whole


def test_geometry_and_rank_without_joins(lines, plans, monkeypatch):
    members = materialize(tables.table_blocks(lines))
    del plans[:]
    small = members.filter("scan_id < 1000")
    got = tables.pairs_by_geometry(small)
    assert rows(tables.pairs_by_rank(small)) and "Join" not in plan(tables.pairs_by_rank(small))
    assert all("Join" not in p for p in [*plans, plan(got)])
    every = rows(tables.pairs_by_geometry(members).drop("seq"))
    assert sum("scan_id=1000" in r for r in every) == 40
    monkeypatch.setattr(grid, "FEW", 1)  # every block by the grid
    assert rows(tables.pairs_by_geometry(members).drop("seq")) == every


def test_row_pairs_deal_lines_once(lines, plans):
    members = materialize(tables.table_blocks(lines))
    del plans[:]
    got = tables.pairs_by_row(members)
    assert all("Join" not in p for p in [*plans, plan(got)]) and sum(p.count("Exchange hashpartitioning") for p in plans) == 1
    want = set()
    blocks = {}
    for m in members.collect():
        blocks.setdefault((m.scan_id, m.run), []).append(m)
    for key, block in blocks.items():
        if all(m.row_index is not None for m in block):
            want |= {(*key, l.pos, v.pos) for l in block for v in block
                     if l.is_left and not v.is_left and l.row_index == v.row_index and v.column_index > l.column_index}
    direct = {(r.scan_id, r.run, r.l_pos, r.v_pos) for r in got.collect() if r.seq < 1 << 32}
    assert want and direct == want and got.filter(F.col("seq") >= 1 << 32).count() > 0
