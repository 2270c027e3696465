"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run`
writes as Parquet and reads again as the next stage's docs. All stages but the
last return the columns they were given; the last returns the packed pieces.

1. quality rules: documents that the base rules or the learned list reject go.
2. near duplicates: texts whose sets of five-word shingles have a Jaccard
   similarity of 0.8 or more are linked; of each group of linked texts the
   smallest doc_id stays (of its repeated rows, one).
3. decontamination: documents that the benchmark contaminates go.
4. secrets: every span found is replaced by a mark; n_chars follows the text.
5. packing: what is left is cut and packed into sequences.

Rows with null or empty texts fail the base rules. Empty tables pass through all
stages. Columns besides doc_id and text are carried along whatever they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import decontamination, packing, quality, secrets, similar
from labelscope.llm.common import materialize, small, table

SHINGLE = 5
SEQUENCE = 2048
END_ID = 1
#: Stretches and words that a worker of the last stage remembers within a task, and bytes it encodes at a time.
REMEMBER = (20_000, 50_000, 1 << 20)
KEY = "_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents with (left_semi) or without (left_anti) a row (row_id, row_key) of a written table."""
    rows = small(rows)
    keyed = _keyed(docs)
    same = (keyed[KEY] == rows["row_key"]) & keyed["doc_id"].eqNullSafe(rows["row_id"])
    return keyed.join(rows, same, how).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judged(_keyed(docs.select("doc_id", "text")), rules).filter("text is not null")
    # verdicts are written before they are used, so that no filter works statistics out again
    verdicts = materialize(judged.select(F.col("doc_id").alias("row_id"), F.col(KEY).alias("row_key"), "kept"))
    return _matched(docs, verdicts.filter("kept").drop("kept"), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = similar.near_copies(_keyed(docs), KEY, SHINGLE)
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    kept = materialize(found.groupBy(group.alias("g")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col(KEY).alias("key"))).alias("w"),
        F.count(F.lit(1)).alias("n")).select(F.col("w.doc_id").alias("row_id"), F.col("w.key").alias("row_key"), "n"))
    out = _matched(docs, kept.drop("n"), "left_semi")
    alone = _matched(docs, kept.filter("n = 1").drop("n"), "left_semi")
    if kept.count() == out.select("doc_id").count():
        return out
    shared = kept.filter("n > 1").drop("n")  # rows that repeat whole
    return alone.unionByName(_keyed(_matched(docs, shared, "left_semi")).dropDuplicates(["doc_id", KEY]).drop(KEY))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = materialize(found.filter("contaminated").select(F.col("doc_id").alias("row_id"), F.col("key").alias("row_key")))
    return _matched(docs, gone, "left_anti")


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clash = {c: f"_kept_{c}" for c in docs.columns if c.lower() in ("base", "spans", "_base", "_more")}
    masked = secrets.redacted(secrets.scan(docs.withColumnsRenamed(clash)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                                   .otherwise(F.col("n_chars")))
    return masked.drop("base", "spans").withColumnsRenamed({new: old for old, new in clash.items()}).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, SEQUENCE, public_tokenizers.path("word_bpe_49k.json"), END_ID, remember=REMEMBER, forget=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", secrets_masked),
    ("packing", packed),
]

#: The learned list and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
