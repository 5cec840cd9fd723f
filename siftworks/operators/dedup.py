"""Duplicate removal and audits on any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def normal_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the JSON of the columns, with '' equal to null."""
    return F.sha2(F.to_json(F.struct(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row for each key, the first by `order`.

    The first row's order values are found by a partial aggregate, so a hot key is reduced before it is shuffled.
    """
    first = df.groupBy(key.alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    return df.withColumn("_key", key).join(first, "_key").where(F.struct(*order) == F.col("_first")).drop("_key", "_first").dropDuplicates(order)


def cross_split_classes(df: DataFrame, key: Column, split: str, row_id: str) -> DataFrame:
    """(key, split, members, representative) of keys that occur in more than one split; members are never paired."""
    x = df.groupBy(key.alias("key"), split).agg(F.count("*").alias("members"), F.min(row_id).alias("representative"))
    many = x.groupBy("key").agg(F.count("*").alias("splits")).where("splits > 1")
    return x.join(many, "key")


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of [a-z0-9]+ tokens; none for fewer tokens."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.concat_ws(" ", F.slice(t, i, n))))
    # The tokens are an element of an array, so that they are found once and not for each gram.
    return F.element_at(F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= n, grams(t)).otherwise(F.array().cast("array<string>"))), 1)


def contamination(docs: DataFrame, frozen: DataFrame, doc: str, item: str, text: str = "text", least: int = 20) -> DataFrame:
    """(doc, item, shared, containment) of rows that share `least` or more n-grams with a frozen item, or all of a shorter one, by an inverted index."""
    index = frozen.select(item, F.explode(ngrams(F.col(text))).alias("g"))
    sizes = index.groupBy(item).agg(F.count("*").alias("n"))
    hits = docs.select(doc, F.explode(ngrams(F.col(text))).alias("g")).join(index, "g").groupBy(doc, item).agg(F.count("*").alias("shared"))
    return hits.join(sizes, item).where(F.col("shared") >= F.least(F.lit(least), F.col("n"))).select(doc, item, "shared", (F.col("shared") / F.col("n")).alias("containment"))


def rank_first(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
