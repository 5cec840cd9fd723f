"""Mixing sources to target weights by certain whole copies and Pareto order sampling.

A source's target of words is shared among its documents in unequal parts: a document of 2 ** level words or more expects copies in
proportion to 2 ** (FAVOUR * level), MAX_COPIES at most, so that the expected words of all come to the target. The whole part of what it
expects is allocated for certain, the fraction is its inclusion probability p. Documents are ranked by random odds over inclusion
odds, (u / (1 - u)) / (p / (1 - p)), and the first ones, a sample of fixed size in words, that of the rest of the target, get one copy
more. The ranking is never gathered in one task: words are summed in fixed buckets of the rank, and only the bucket
that the target falls into is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, marked, marks

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
BUCKETS = 4096
FAVOUR = 0.25
SEED = 10
MAX_BROADCAST = 50_000  # rows of some numbers and a source's name
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of runs of other characters than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Weights repeat over the sources by code point, null last. Targets share the sum of sizes by weight;
    one that exceeds max_copies times its source's size stops there and the excess is shared by weight
    again. Level by level that fills the sources in order of size over weight, which is what is summed here, over some numbers
    and a name for each source, in one task.
    """
    names = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * max_copies)
    every = W.partitionBy()
    fill = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_weight", F.sum("weight").over(every))
    rest = (F.col("total") - F.coalesce(F.sum("most").over(fill), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    x = x.withColumn("level", rest).withColumn("open", F.col("most") > F.col("level") * F.col("weight"))
    # The first source that is not filled sets the level of all later ones.
    x = x.withColumn("stop", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(every).getField("level"))
    target = F.when(F.col("stop").isNull(), F.col("most")).otherwise(F.least("most", F.col("stop") * F.col("weight")))
    return x.select("source", "source_size", target.alias("target"))


def uniform(*cols, seed: int = SEED):
    """A number in (0, 1) fixed by the columns and the seed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)


def by_key(rows: DataFrame, facts: DataFrame, keys: tuple[str, ...] = ("source",), how: str = "inner") -> DataFrame:
    """rows with the facts of their source, or source and level: one row for each, in columns named with a _ before.

    The facts go to all executors if they are few, which is counted; else AQE splits the join's skewed partitions.
    """
    facts = F.broadcast(facts) if facts.count() <= MAX_BROADCAST else facts
    same = rows[keys[0]].eqNullSafe(F.col(f"_{keys[0]}"))
    for k in keys[1:]:
        same &= rows[k].eqNullSafe(F.col(f"_{k}"))
    return rows.join(facts, same, how).drop(*(f"_{k}" for k in keys))


def expected(levels: DataFrame, aim: DataFrame) -> DataFrame:
    """(_source, _level, source_size, target, whole, p, rest) from (source, level, words) and targets().

    Copies expected are the lesser of MAX_COPIES and c * 2 ** (FAVOUR * level), with the c that makes a source's expected words its target:
    going down from the longest documents, levels are full until c times the next one's share is MAX_COPIES or less.
    """
    down = W.partitionBy("source").orderBy(F.col("level").desc())
    x = by_key(levels, aim.withColumnRenamed("source", "_source")).withColumn("share", F.pow(F.lit(2.0), F.col("level") * FAVOUR))
    full = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * MAX_COPIES
    open_ = F.sum(F.col("words") * F.col("share")).over(down.rowsBetween(0, W.unboundedFollowing))
    x = x.withColumn("c", F.try_divide(F.col("target") - full, open_))
    # The first level that is not full sets c; a hair above it is floating point's.
    fits = F.when(F.col("c") * F.col("share") <= MAX_COPIES * (1 + 1e-12), F.col("level"))
    whole_source = W.partitionBy("source")
    x = x.withColumn("c", F.max(F.when(fits.isNotNull(), F.struct("level", "c"))).over(whole_source).getField("c"))
    copies = F.coalesce(F.least(F.col("c") * F.col("share"), F.lit(float(MAX_COPIES))), F.lit(float(MAX_COPIES)))
    x = x.withColumn("whole", F.floor(copies + 1e-9)).withColumn("p", F.greatest(copies - F.col("whole"), F.lit(0.0)))
    x = x.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole_source))
    return x.select(F.col("source").alias("_source"), F.col("level").alias("_level"), "source_size", "target", "whole", "p", "rest")


def plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, copies) for each row of docs (doc_id, source, text)."""
    size = word_count(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", size.alias("size"), F.xxhash64("text").alias("text_hash"))
    # Numbers only: texts are read once. A row's own number tells rows that repeat another.
    rows = rows.withColumn("u", uniform("doc_id", "text_hash", seed=seed)).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("level", F.length(F.bin("size"))))
    levels = cut(rows.groupBy("source", "level").agg(F.sum("size").alias("words")))
    aim = cut(targets(levels.groupBy("source").agg(F.sum("words").alias("source_size"))))
    x = by_key(rows, cut(expected(levels, aim)), ("source", "level")).drop("level")
    odds = lambda v: v / (1 - v)
    x = x.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds(F.col("u")) / odds(F.col("p"))))
    x = x.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))  # in rank order
    sums = x.where("bucket is not null").groupBy("source", "bucket").agg(F.max("rest").alias("rest"), F.sum("size").alias("words"))
    run = W.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    edge = sums.where("before < rest").groupBy(F.col("source").alias("_source")).agg(F.max("bucket").alias("edge"), F.max("before").alias("before"))
    x = by_key(x, cut(edge), how="left")
    sure = x.where("bucket is null or edge is null or bucket <> edge").withColumn("extra", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    order = W.partitionBy("source").orderBy("rank", "doc_id", "text_hash", "row")
    last = x.where("bucket = edge").withColumn("reach", F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = last.withColumn("extra", F.col("reach") <= F.col("rest")).drop("reach")
    out = cut(sure.unionByName(last).drop("u", "bucket", "edge", "before"))
    # The first document that does not fit leaves a gap; the one of the rest whose size is nearest to it, or none, closes it.
    left = out.groupBy(F.col("source").alias("_source")).agg((F.max("rest") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("gap"))
    free = by_key(out.where("not extra and rank is not null"), cut(left)).where("size <= 2 * gap")
    near = F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "doc_id", "text_hash", "row")
    pick = free.groupBy(F.col("source").alias("_source")).agg(F.min(near).getField("row").alias("pick"))
    out = by_key(out, cut(pick), how="left")
    extra = F.col("extra") | F.coalesce(F.col("row") == F.col("pick"), F.lit(False))
    return out.select("doc_id", "text_hash", "size", "source_size", "target", (F.col("whole") + extra.cast("bigint")).alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    Null sources form one source, null and blank texts have size 0 and take nothing; texts of any length count whole. Equal rows get
    equal copies wherever the sample does not end between them; ties in rank go by doc_id, then by text. An empty table gives an empty
    result. Columns of other names are not looked at.
    """
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the plan says; a copy keeps its doc_id and all columns, whatever their names.

    Documents without words stay once: they have no words to weigh and are not the mix's to drop. Rows that repeat id and text
    share their copies, those that come first in the order of their other columns' hash taking the odd ones. Nulls, ties, long texts
    and empty tables are treated as mix_report says.
    """
    own_id, own_hash, copies, rows, times, nth = fresh(docs.columns, "_id", "_hash", "_copies", "_rows", "_times", "_nth")
    planned = plan(docs.select("doc_id", "source", "text")).groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.when(F.max("size") == 0, F.count("*")).otherwise(F.sum("copies")).alias(copies), F.count("*").alias(rows))
    planned = cut(planned)
    # Rows that stay once each are told by a table of bits; only the others' texts are shuffled.
    table = marks(planned.where(F.col(copies) != F.col(rows)), F.xxhash64(own_id, own_hash))
    place = F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    same = docs.doc_id.cast("bigint").eqNullSafe(F.col(own_id)) & (F.xxhash64(docs.text) == F.col(own_hash))
    joined = marked(docs, place, table).join(planned.where(F.col(copies) > 0).hint("shuffle_hash"), same)
    even = joined.where(F.col(copies) % F.col(rows) == 0).withColumn(times, F.col(copies) / F.col(rows))
    # Only where the sample ends between equal rows, twice a source at most, are rows told apart.
    order = W.partitionBy(own_id, own_hash).orderBy(F.xxhash64(*(docs[c] for c in docs.columns)))
    odd = joined.where(F.col(copies) % F.col(rows) != 0).withColumn(nth, F.row_number().over(order))
    odd = odd.withColumn(times, F.floor(F.col(copies) / F.col(rows)) + (F.col(nth) <= F.col(copies) % F.col(rows)).cast("int")).drop(nth)
    both = even.unionByName(odd).where(F.col(times) > 0)
    both = both.withColumn(nth, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).select(*docs.columns)
    return marked(docs, place, table, "left_anti").unionByName(both)
