"""Readers for recogniser output and for scan manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelscope.session import materialize

DEFAULT_SCORE = 0.9
POLYGON = "array<array<double>>"
PAGE = "scan_id bigint, image_path string, upload_order int"
#: Parallel arrays of texts, scores and polygons, or rows [[polygon, [text, score]], ...] kept as JSON text until unpacked.
LAYOUTS = {
    "columnar": f"{PAGE}, rec_texts array<string>, rec_scores array<double>, rec_polys array<{POLYGON}>, dt_polys array<{POLYGON}>",
    "nested": f"{PAGE}, result array<array<array<string>>>",
}
RECORD = "record"


def _columnar_entries() -> Column:
    polys = F.coalesce("rec_polys", "dt_polys", F.array())
    return F.transform("rec_texts", lambda text, i: F.struct(
        i.alias("i"), text.alias("text"), F.coalesce(F.get("rec_scores", i), F.lit(DEFAULT_SCORE)).alias("score"), F.get(polys, i).alias("poly")))


def _nested_entries() -> Column:
    def entry(e, i):
        payload = F.from_json(F.get(e, F.lit(1)), "array<string>")
        return F.struct(
            i.alias("i"), F.get(payload, F.lit(0)).alias("text"),
            F.coalesce(F.get(payload, F.lit(1)).try_cast("double"), F.lit(DEFAULT_SCORE)).alias("score"),
            F.when(F.size(payload) >= 2, F.from_json(F.get(e, F.lit(0)), POLYGON)).alias("poly"))

    return F.transform(F.get("result", F.lit(0)), entry)


def _trimmed(text: str) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _extent(poly: str) -> dict[str, Column]:
    """Whole-pixel extent of a polygon."""
    xs, ys = F.transform(poly, lambda p: F.get(p, F.lit(0))), F.transform(poly, lambda p: F.get(p, F.lit(1)))
    return {"x0": F.array_min(xs).cast("int"), "y0": F.array_min(ys).cast("int"),
            "x1": F.array_max(xs).cast("int"), "y1": F.array_max(ys).cast("int")}


def tagged_detections(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Entries of JSON lines of a layout, each with the `reason` why it can't be used, or NULL.

    One pass: a record that can't be read, or lacks what every entry needs, is
    one row with its text in `record`.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    pages = spark.read.schema(f"{LAYOUTS[layout]}, {RECORD} string").option("columnNameOfCorruptRecord", RECORD).json(path)
    entries = _columnar_entries() if layout == "columnar" else _nested_entries()
    of_page = (
        F.when(F.col(RECORD).isNotNull(), "unreadable record").when(F.col("scan_id").isNull(), "no scan_id")
        .when(F.col("image_path").isNull(), "no image_path").when(F.col("entries").isNull(), "no results"))
    nothing = F.expr(f"array(cast(null as struct<i:int,text:string,score:double,poly:{POLYGON}>))")
    rows = pages.withColumn("entries", entries).withColumn("of_page", of_page).select(
        "scan_id", "image_path", "upload_order", RECORD, "of_page",
        F.explode(F.when(F.col("of_page").isNull(), F.col("entries")).otherwise(nothing)).alias("e"),
    ).select("scan_id", "image_path", "upload_order", RECORD, "of_page", "e.*")
    box = _extent("poly")
    of_entry = (
        F.when(F.col("poly").isNull(), "no polygon").when(F.col("text").isNull(), "no text").when(_trimmed("text") == "", "blank text")
        .when(~F.coalesce((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), F.lit(False)), "no extent"))
    return rows.withColumn("reason", F.coalesce("of_page", of_entry)).drop("of_page")


def read_checked(spark: SparkSession, path: str, layout: str) -> tuple[DataFrame, DataFrame]:
    """Raw words of a layout's JSON lines, and the error table: scan_id, image_path, i, reason, record of every other row.

    The input is read once; both are parts of one written table.
    """
    rows = materialize(tagged_detections(spark, path, layout))
    words = rows.filter("reason is null").drop("reason", RECORD)
    return words, rows.filter("reason is not null").select("scan_id", "image_path", "i", "reason", RECORD)


def read_detections(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """JSON lines of one recogniser layout ('columnar' or 'nested') to raw words; rows that can't be used are left out."""
    return tagged_detections(spark, path, layout).filter("reason is null").drop("reason", RECORD)


def number_images(words: DataFrame) -> DataFrame:
    """1-based image_index within the scan, at most three: by upload order where it is known, then by path."""
    known = [F.min("upload_order").alias("upload_order")] if "upload_order" in words.columns else [F.lit(None).cast("int").alias("upload_order")]
    images = words.groupBy("scan_id", "image_path").agg(*known)
    order = Window.partitionBy("scan_id").orderBy(F.col("upload_order").asc_nulls_last(), "image_path")
    numbered = images.withColumn("image_index", F.row_number().over(order)).drop("upload_order")
    return words.join(numbered, ["scan_id", "image_path"])


def normalise(words: DataFrame) -> DataFrame:
    """Trim texts, turn polygons into whole-pixel extents, drop unusable words."""
    clean = words.withColumns({
        "text": _trimmed("text"), **_extent("poly"), "confidence": F.coalesce("score", F.lit(DEFAULT_SCORE)),
    })
    return clean.filter(
        (F.col("text") != "") & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    ).select("scan_id", "image_index", F.col("i").cast("bigint").alias("word_ord"), "text",
             "x0", "y0", "x1", "y1", "confidence", F.lit(0).alias("pass_index"))


def rescale(words: DataFrame, scale: Column) -> DataFrame:
    """Bring boxes of a scaled pass back to the pixels of the original image."""
    return words.withColumns({
        c: F.when(scale == 1.0, F.col(c)).otherwise(F.bround(F.col(c) / scale).cast("int"))
        for c in ("x0", "y0", "x1", "y1")})


# --- fixed values: accepted images and error codes ---------------------------
IMAGE_NAME = r"(?i)\.(jpe?g|png|webp)$"
IMAGE_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/webp"]
MAX_IMAGES = 3
ERRORS = {
    "MISSING_IMAGES": "At least 1 image is required.",
    "TOO_MANY_IMAGES": "A maximum of 3 images is allowed.",
    "UNSUPPORTED_FORMAT": "Supported image formats are JPG, JPEG, PNG, and WEBP.",
    "INVALID_IMAGE": "The uploaded image is empty.",
}


def check_manifest(uploads: DataFrame) -> DataFrame:
    """Scans with the first check they fail, NULL error_code when they pass all.

    `uploads` has scan_id, filename, content_type and length, one row per
    image; a scan without images has one row with both names NULL. `filename`
    of the result is the first image that fails, in the order of `ordinal`, or
    of the names where there is no such column or images share an ordinal.
    """
    name, kind = F.trim("filename"), F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    is_image = F.coalesce(name != "", F.lit(False)) | F.coalesce(kind != "", F.lit(False))
    allowed = F.coalesce(name.rlike(IMAGE_NAME), F.lit(False)) | F.coalesce(
        kind.isin(IMAGE_TYPES), F.lit(False))
    c = F.col
    place = c("ordinal") if "ordinal" in uploads.columns else c("filename")
    unsupported, empty = is_image & ~allowed, is_image & (F.coalesce(c("length"), F.lit(0)) <= 0)
    first = F.struct(place.alias("place"), "filename")
    counted = uploads.groupBy("scan_id").agg(
        F.count_if(is_image).alias("images"),
        F.count_if(unsupported).alias("unsupported"), F.count_if(empty).alias("empty"),
        F.min(F.when(unsupported, first))["filename"].alias("first_unsupported"),
        F.min(F.when(empty, first))["filename"].alias("first_empty"))
    code = (
        F.when(c("images") == 0, "MISSING_IMAGES").when(c("images") > MAX_IMAGES, "TOO_MANY_IMAGES")
        .when(c("unsupported") > 0, "UNSUPPORTED_FORMAT").when(c("empty") > 0, "INVALID_IMAGE"))
    message = F.coalesce(*[F.when(code == k, m) for k, m in ERRORS.items()])
    failed = F.when(code == "UNSUPPORTED_FORMAT", c("first_unsupported")).when(code == "INVALID_IMAGE", c("first_empty"))
    return counted.select("scan_id", "images", code.alias("error_code"), message.alias("message"), failed.alias("filename"))
