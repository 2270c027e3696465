"""Vocabulary jobs over distinct strings: units, garbled labels, commodity words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.functions import fuzzy
from labelscope.functions import patterns as P
from labelscope.functions import text as T
from labelscope.operators.evidence import candidates, rank
from labelscope.operators.tables import readable
from labelscope.options import DEFAULT, Options

SHORT_WORD = 5  # shorter words match exactly, or with one letter dropped


def resolved_units(lines: DataFrame) -> DataFrame:
    """Distinct (number, unit) readings of labelled quantities and their meaning."""
    text = F.col("text")
    pairs = lines.select(
        T.group(text, P.QTY_VALUE, 1).alias("number"), T.group(text, P.QTY_VALUE, 2).alias("raw_unit")
    ).filter("number is not null").distinct()
    read = pairs.withColumn("r", T.resolve_unit(F.col("number"), F.col("raw_unit"), True))
    return read.select("number", "raw_unit", "r.value", "r.unit", "r.how")


def garbled_labels(lines: DataFrame) -> DataFrame:
    """Distinct texts that resemble a keyword of a label set, with the sets."""
    bits = F.col("bits")
    return (
        lines.select("text").distinct().repartition("text")
        .withColumn("bits", fuzzy.resembles(F.col("text")))
        .filter("bits > 0")
        .select("text", *[(bits.bitwiseAND(bit) > 0).alias(name) for name, bit in (
            ("manufacturer", fuzzy.MAKER), ("agent", fuzzy.AGENT), ("care", fuzzy.CARE),
            ("origin", fuzzy.ORIGIN))])
    )


def words_of(text: Column) -> Column:
    return F.array_distinct(T.matches(F.lower(text), "[a-z]+"))


def vocabulary_of(spark: SparkSession, options: Options = DEFAULT) -> DataFrame:
    """Commodity words of the options as a table (`word`)."""
    return spark.createDataFrame([(w,) for w in options.descriptors], "word string").distinct()


def _deletions(text: Column, most: Column) -> Column:
    """A text and what is left of it without any one letter, or any two where `most` is 2."""
    without = lambda t, i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1))
    places = lambda t: F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.expr("cast(array() as array<int>)"))
    one = lambda t: F.transform(places(t), lambda i: without(t, i))
    # the second letter to go stands before the first, so each pair goes once
    two = F.flatten(F.transform(places(text), lambda i: F.transform(
        F.when(i > 1, F.sequence(F.lit(1), i - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda k: without(without(text, i), k))))
    return F.array_distinct(F.concat(F.array(text), F.when(most >= 1, one(text)).otherwise(F.expr("cast(array() as array<string>)")),
                                     F.when(most >= 2, two).otherwise(F.expr("cast(array() as array<string>)"))))


def deletion_index(vocabulary: DataFrame) -> DataFrame:
    """word, size and `rest`: every word that can be missed by a letter or two, under all it can become by losing them."""
    size = F.length("word")
    long_words = vocabulary.filter(size >= SHORT_WORD).withColumn("size", size)
    # two edits need a token of eight letters, so a word of six at least
    return long_words.withColumn("rest", F.explode(_deletions(F.col("word"), F.when(F.col("size") >= 6, 2).otherwise(1))))


def match_words(tokens: DataFrame, options: Options = DEFAULT, vocabulary: DataFrame | None = None) -> DataFrame:
    """Distinct `token`s to the vocabulary `word` each one stands for.

    Near misses meet in an index of deletions: texts within one or two edits
    have a common rest after as many letters are deleted from either. So a token
    meets words that share a rest with it, whatever the size of the vocabulary
    (a table with `word`), and only these are compared. The edit budget is one up
    to seven letters, two from eight on; four letters only match a word that lost
    one.
    """
    if vocabulary is None:
        vocabulary = vocabulary_of(tokens.sparkSession, options)
    else:
        vocabulary = vocabulary.select("word").distinct()
    distinct = tokens.select("token").distinct()
    exact = distinct.join(vocabulary, F.col("token") == F.col("word")).select("token", "word")
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0] or 0  # one number: longer tokens can't be near
    size = F.length("token")
    budget = F.when(F.col("token_size") < SHORT_WORD, 0).when(F.col("token_size") <= 7, 1).otherwise(2)
    near = (
        distinct.filter((size >= SHORT_WORD - 1) & (size <= longest + 2))
        .join(vocabulary, F.col("token") == F.col("word"), "left_anti")
        .withColumn("token_size", size).withColumn("rest", F.explode(_deletions(F.col("token"), budget)))
        .join(deletion_index(vocabulary), "rest").drop("rest").distinct()
        .filter(F.when(F.col("token_size") < SHORT_WORD, (F.col("size") == F.col("token_size") + 1) & (F.levenshtein("token", "word") <= 1))
                .otherwise(F.levenshtein("token", "word") <= budget))
        .groupBy("token").agg(F.min("word").alias("word"))
    )
    return exact.unionByName(near)


def descriptor_lines(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Legible short lines that are not another declaration."""
    value = T.strip_value(F.col("text"))
    return lines.filter(
        (value != "") & (F.length(value) <= P.DESCRIPTOR_LINE_LENGTH)
        & readable(F.col("confidence"), options) & ~T.found(value, P.NOT_DESCRIPTOR_LINE))


def count_descriptors(items: DataFrame, keys: list[str], text: Column,
                      options: Options = DEFAULT, vocabulary: DataFrame | None = None) -> DataFrame:
    """Number of distinct commodity words (of the options, or of a table) in each item's text, where any (`score`)."""
    tokens = items.select(*keys, F.explode(words_of(text)).alias("token")).filter(
        F.length("token") >= 2)
    return (
        tokens.join(match_words(tokens, options, vocabulary), "token")
        .groupBy(*keys).agg(F.size(F.collect_set("word")).alias("score"))
    )


def descriptor_scores(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    return count_descriptors(
        descriptor_lines(lines, options), ["scan_id", "pos"], F.col("text"), options)


def descriptor_names(ready: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Second-tier common names: the line that names most commodity words."""
    eligible = descriptor_lines(ready, options).withColumn(
        "conf", F.coalesce("confidence", F.lit(0.0)))
    best = (
        count_descriptors(eligible, ["scan_id", "pos", "conf"], F.col("text"), options)
        .groupBy("scan_id")
        .agg(F.min_by("pos", F.struct((-F.col("score")).alias("s"), (-F.col("conf")).alias("c"), "pos")
                      ).alias("pos"))
    )
    rows = ready.join(best, ["scan_id", "pos"])
    return candidates(
        rows, "'common_name'", rank("3", "pos"), value=T.strip_value(F.col("text")),
        raw_text=F.col("text"), context=F.col("ctx2"),
        match_method=F.lit("descriptor_vocabulary"), partial=F.lit(True))
