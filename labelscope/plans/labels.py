"""Label texts, tables and detections derived from the star-schema tables.

One scan per part. Texts vary with the part key so that every branch of the
extraction jobs is met; only integer arithmetic and fixed decimals are printed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dated_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Each part with the date of its first order."""
    part = table(spark, folder, "part").select(
        F.col("p_partkey").cast("bigint").alias("key"), F.col("p_name").alias("name"),
        F.col("p_size").alias("size"), F.col("p_type").alias("type"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    first = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").cast("bigint").alias("key")).agg(
        F.min("l_orderkey").alias("o_orderkey"))
    ordered = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("made")).join(
        first, "o_orderkey").select("key", "made")
    return part.join(ordered, "key", "left")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Each part with a supplier, its nation and the date of its first order."""
    supplier = table(spark, folder, "supplier")
    suppliers = supplier.agg(F.count("*").alias("n_suppliers"))  # one row
    part = dated_parts(spark, folder)
    keyed = part.join(F.broadcast(suppliers)).withColumn("s_key", F.col("key") % F.col("n_suppliers"))
    maker = supplier.select(F.col("s_suppkey").cast("bigint").alias("s_key"), "s_name", "s_nationkey")
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return keyed.join(maker, "s_key", "left").join(nation, "s_nationkey", "left")


def _pick(key: Column, options: list) -> Column:
    return F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]),
                        (key % len(options)).cast("int") + 1)


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text per part, in reading order, one box per line."""
    key, price = F.col("key"), F.col("price").cast("string")
    day = F.date_format("made", "dd/MM/yyyy")
    best = F.date_format(F.add_months("made", 12), "dd/MM/yyyy")
    digits = F.lpad((key % 1000).cast("string"), 3, "0")
    loose_dates = key % 7 == 0
    line = {
        0: F.when(key % 5 == 0, F.col("name")).otherwise(F.concat(F.lit("Product Name: "), "name")),
        1: F.concat(F.lit("Net Qty: "), F.col("size").cast("string"),
                    _pick(key, ["g", " kg", " ml", " l", "", " gms", "9", " gn"])),
        2: F.concat(_pick(key, ["MRP Rs. ", "MRP: ", "Rs. ", "Rs. "]), price),
        3: F.concat(_pick(key, ["Mfd By: ", "Marketed By: ", "Manufactured By: "]), "s_name",
                    F.lit(" Foods Private Limited")),
        4: F.when(loose_dates, day).otherwise(F.concat(F.lit("MFG "), day, F.lit(" EXP "), best)),
        5: F.when(key % 6 == 0, F.concat(F.lit("Made in India. Imported by "), "s_name"))
        .when(key % 2 == 1, F.lit("Made in India")).otherwise(F.concat(F.lit("Made in "), "nation")),
        6: F.when(key % 3 == 0, F.concat(F.lit("Consumer Care: 1800 "), digits, F.lit(" 4567")))
        .when(key % 3 == 1, F.concat(F.lit("Please send your questions to: help"), key.cast("string"), F.lit("@example.com"))),
        7: F.when(key % 4 == 3, F.concat(F.lit("Rs. "), (F.col("price") + 10).cast("decimal(12,2)").cast("string"))),
        8: F.when(loose_dates, best),
        9: F.when(key % 8 == 0, F.concat(F.lit("USP Rs. 0."), digits, F.lit(" per g")))
        .when(key % 8 == 1, F.concat(F.lit("Rs.0."), F.substring(digits, 1, 2), F.lit("/ml"))),
        10: F.when(key % 10 == 0, F.concat(F.lit("Size: "), F.col("size").cast("string"), F.lit(" x 20 cm"))),
        11: F.when(key % 10 == 5, _pick(F.floor(key / 10), [
            "Salted Snack", "Cereal based namkeeh", "Roasted Almonds", "wheat biscults",
            "Instant Coffee Powder"])),
    }
    items = F.filter(
        F.array(*[F.struct(F.lit(i).alias("line_ord"), t.alias("text")) for i, t in line.items()]),
        lambda x: x["text"].isNotNull())
    return (
        parts(spark, folder).select(key.alias("scan_id"), F.posexplode(items).alias("pos", "l"))
        .select(
            "scan_id", F.col("pos").cast("bigint").alias("pos"), F.lit(1).alias("image_index"), "l.text",
            F.lit(0.0).alias("x0"), (F.col("l.line_ord") * 20.0).alias("y0"),
            F.lit(300.0).alias("x1"), (F.col("l.line_ord") * 20.0 + 14).alias("y1"),
            ((F.lit(40) + (F.col("scan_id") * 37 + F.col("l.line_ord") * 11) % 60) / 100.0).alias("confidence"),
            F.lit(None).cast("int").alias("row_index"), F.lit(None).cast("int").alias("column_index"))
    )


def label_table(spark: SparkSession, folder: str) -> DataFrame:
    """A five-row declaration table per part.

    The value column is level with the labels, a row above them or a few pixels
    below, by key; every fifth part lacks one value and every seventh has a
    value that wraps.
    """
    key = F.col("key")
    shift = F.when(key % 3 == 0, 0).when(key % 3 == 1, -25).otherwise(4)
    row_shift = F.when(key % 3 == 0, 0).when(key % 3 == 1, -1)
    labels = ["MRP Rs.", "USP Rs.", "BATCH NO.", "MFD.", "USE BY."]
    values = [
        F.col("price").cast("string"), F.lit("0.45/g"), F.concat(F.lit("B"), key.cast("string")),
        F.date_format("made", "dd/MM/yy"), F.date_format(F.add_months("made", 12), "dd/MM/yy"),
    ]

    def item(text: Column, x0: int, x1: int, y: Column, row: Column, column: int) -> Column:
        return F.struct(
            text.alias("text"), F.lit(float(x0)).alias("x0"), y.cast("double").alias("y0"),
            F.lit(float(x1)).alias("x1"), (y + 16).cast("double").alias("y1"),
            row.cast("int").alias("row_index"),
            F.when(row.isNotNull(), column).cast("int").alias("column_index"))

    lines = []
    for i, (label, value) in enumerate(zip(labels, values)):
        row = F.when(key % 3 != 2, i)
        lines.append(item(F.lit(label), 50, 140, F.lit(100 + 25 * i), row, 0))
        shown = F.when((key % 5 == 0) & F.lit(i == 2), None).otherwise(F.coalesce(value, F.lit("-")))
        lines.append(F.when(shown.isNotNull(), item(
            shown, 180, 300, F.lit(100 + 25 * i) + shift, row_shift + i, 1)))
    lines.append(F.when(key % 7 == 0, item(
        F.lit("13:46"), 180, 220, F.lit(194) + shift, F.when(key % 3 != 2, 9), 1)))
    return (
        dated_parts(spark, folder)
        .select(key.alias("scan_id"), F.posexplode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("pos", "l"))
        .select("scan_id", F.col("pos").cast("bigint").alias("pos"), F.lit(1).alias("image_index"), "l.text",
                "l.x0", "l.y0", "l.x1", "l.y1",
                (F.lit(60) + (F.col("scan_id") * 7 + F.col("pos")) % 40).cast("double").alias("_c"),
                "l.row_index", "l.column_index")
        .withColumn("confidence", F.col("_c") / 100.0).drop("_c")
    )


def label_detections(lines: DataFrame) -> DataFrame:
    """Words of the lines as detections: some read twice, some scans upside down."""
    words = lines.select(
        "scan_id", "image_index", "pos", "y0", "confidence",
        F.posexplode(F.split("text", " ")).alias("i", "text"), F.split("text", " ").alias("all"),
    )
    start = F.length(F.concat_ws(" ", F.slice("all", F.lit(1), F.col("i")))) + F.when(F.col("i") > 0, 1).otherwise(0)
    placed = words.filter(F.col("text") != "").withColumn("x0", (start * 10).cast("int")).withColumn(
        "x1", F.col("x0") + F.length("text") * 10).withColumn("top", F.col("y0").cast("int"))
    copies = F.when(
        F.col("i") % 3 == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    read = placed.withColumn("pass_index", F.explode(copies))
    x0, x1 = F.col("x0") + F.col("pass_index"), F.col("x1") + F.col("pass_index")
    y0, y1 = F.col("top"), F.col("top") + 14
    turned = F.col("scan_id") % 4 == 0
    return read.select(
        "scan_id", "image_index", (F.shiftleft("pos", 32) + F.col("i") * 2 + F.col("pass_index")).alias("word_ord"),
        "pass_index", "text",
        F.when(turned, F.lit(4000) - x1).otherwise(x0).alias("x0"),
        F.when(turned, F.lit(4000) - y1).otherwise(y0).alias("y0"),
        F.when(turned, F.lit(4000) - x0).otherwise(x1).alias("x1"),
        F.when(turned, F.lit(4000) - y0).otherwise(y1).alias("y1"),
        F.col("confidence"))


def label_pages(lines: DataFrame) -> DataFrame:
    """Recogniser output of the labels as JSON lines (`layout`, `value`): two images a scan, some records and entries broken by key.

    The image uploaded first has the later name. Scans of every third key were
    read at twice the size.
    """
    key, k = F.col("scan_id"), F.col("scan_id") % 50
    first = F.col("pos") % 3 == 0
    scale = F.when(key % 3 == 0, 2).otherwise(1)
    x0, y0 = F.col("pos") * 10, F.col("y0").cast("bigint")
    edge = lambda v: (v * scale + scale - 1).cast("double") + 0.6
    left, top, right, low = edge(x0), edge(y0), edge(x0 + F.length("text") * 7), edge(y0 + 14)
    entry = F.struct(
        "pos", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"), "confidence",
        F.array(F.array(left, top), F.array(right, top), F.array(right, low), F.array(left, low)).alias("poly"))
    pages = lines.groupBy("scan_id", first.alias("first")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    broken = F.transform("e", lambda e, i: F.when(i > 0, e).otherwise(F.struct(
        e["pos"].alias("pos"), F.when(k == 13, "  ").otherwise(e["text"]).alias("text"), F.when(k != 19, e["confidence"]).alias("confidence"),
        F.when(k == 11, None).when(k == 17, F.array(e["poly"][0], e["poly"][1])).otherwise(e["poly"]).alias("poly"))))
    path = F.when(F.col("first"), "page10.png").otherwise("page2.png")
    order = F.when(F.col("first"), 1).otherwise(2)
    part = lambda name: F.transform(broken, lambda e: e[name])
    columnar = F.to_json(F.struct(
        F.when(k != 23, key).alias("scan_id"), path.alias("image_path"), order.alias("upload_order"), part("text").alias("rec_texts"),
        part("confidence").alias("rec_scores"), part("poly").alias("rec_polys")))
    quoted = lambda text: F.regexp_extract(F.to_json(F.array(text)), r"^\[(.*)\]$", 1)
    rows = F.array_join(F.transform(broken, lambda e: F.concat(
        F.lit("["), F.coalesce(F.to_json(e["poly"]), F.lit("null")), F.lit(",["), quoted(e["text"]), F.lit(","),
        F.coalesce(e["confidence"].cast("string"), F.lit("null")), F.lit("]]"))), ",")
    head = F.to_json(F.struct(F.when(k != 23, key).alias("scan_id"), path.alias("image_path"), order.alias("upload_order")))
    nested = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"result":[['), F.col("rows"), F.lit("]]}"))
    made = pages.withColumns({"head": head, "rows": rows}).select(
        F.when(key % 2 == 0, "columnar").otherwise("nested").alias("layout"), (F.col("first") & (k == 7)).alias("cut"),
        F.when(key % 2 == 0, columnar).otherwise(nested).alias("value"))
    return made.select("layout", F.when(F.col("cut"), F.expr("substring(value, 1, length(value) - 20)")).otherwise(F.col("value")).alias("value"))


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts, one line per row."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("scan_id"), "source", "lang",
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"),
    ).select(
        "scan_id", F.col("pos").cast("bigint").alias("pos"), F.lit(1).alias("image_index"), "text",
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("int").alias("row_index"),
        F.lit(None).cast("int").alias("column_index"))
