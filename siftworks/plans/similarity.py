"""Exact similarity joins over the documents' word n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grams
from ..operators import simjoin
from ..sources.scratch import cut
from .catalogue import register, table
from .dedup import GRAMS, SPLIT3, TOKENS

# The twins count what every two sets share by an inverted index of all grams.
SETS = f"""f as (select doc_id, {SPLIT3} as split, {TOKENS} as t from documents), g as (select doc_id, split, SORTED({GRAMS}) as g from f where SIZE(t) >= 3),
k as (select doc_id, split, min(doc_id) over (partition by g) as class, g from g), s as (select class, any_value(g) as g, len(any_value(g)) as size from k group by class),
e as (select class, size, unnest(g) as m from s), o as (select a.class as a, b.class as b, LONG(count(*)) as shared, any_value(a.size + b.size) as sizes from e a join e b on a.m = b.m and a.class < b.class group by a.class, b.class),
p as (select a, b, shared, DOUBLE(shared) / (sizes - shared) as score from o where shared * 100 > (sizes - shared) * 70)"""


def gram_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, split, class, size), (class, members)) of documents of three words or more: those with the same 3-grams are one class. The classes' grams are made anew from a text each time they are read."""
    d = table(spark, sf_dir, "documents")
    split = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.pmod("id", F.lit(3)) + 1).cast("int"))
    d = d.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("id"), F.lower("text").alias("text"))
    keyed = cut(d.mapInArrow(grams.keys, "id bigint, size int, key binary"))
    least = simjoin.classes(keyed, "id", F.col("key"))
    of = cut(least.withColumnRenamed("id", "doc_id").join(keyed.select(F.col("id").alias("doc_id"), split.alias("split"), "size"), "doc_id").select("doc_id", "split", "class", "size"))
    own = of.where("doc_id = class").select(F.col("doc_id").alias("id")).distinct()
    own = F.broadcast(own) if own.count() <= simjoin.FEW_IDS else own
    return of, d.join(own, "id", "left_semi").mapInArrow(grams.lists, "id bigint, members array<bigint>").withColumnRenamed("id", "class")


@register(
    "similarity_join",
    "J4 D8 X5 X6 X7 B1",
    f"with {SETS}, c as (select class, split, min(doc_id) as doc, LONG(count(*)) as members from k group by class, split), q as (select a, b, shared, score from p union all select class, class, size, 1.0 from s), "
    "r as (select x.doc as doc_x, x.split as split_x, x.members as members_x, y.doc as doc_y, y.split as split_y, y.members as members_y, shared, score, (q.a = q.b) as same from q join c x on x.class = q.a join c y on y.class = q.b where x.split <> y.split) "
    "select doc_x as doc_a, split_x as split_a, members_x as members_a, doc_y as doc_b, split_y as split_b, members_y as members_b, LONG(shared) as shared, round(score, 6) as score from r where not same or split_x < split_y",
)
def similarity_join(spark, sf_dir):
    """Pairs across splits over 0.7, between the documents of a class in a split; a class in several splits is paired with itself."""
    of, sets = gram_classes(spark, sf_dir)
    pairs = simjoin.jaccard_join(sets, "class", "members").unionByName(of.where("doc_id = class").select(F.col("class").alias("a"), F.col("class").alias("b"), F.col("size").cast("bigint").alias("shared"), F.lit(1.0).alias("score")))
    by_split = cut(of.groupBy("class", "split").agg(F.min("doc_id").alias("doc"), F.count("*").alias("members")))
    side = lambda end, tag: by_split.select(F.col("class").alias(end), *(F.col(c).alias(f"{c}_{tag}") for c in ("doc", "split", "members")))
    x = pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").where((F.col("split_a") != F.col("split_b")) & ((F.col("a") != F.col("b")) | (F.col("split_a") < F.col("split_b"))))
    return x.select("doc_a", "split_a", "members_a", "doc_b", "split_b", "members_b", "shared", F.round("score", 6).alias("score"))


@register(
    "similarity_links",
    "J4 D8 D9",
    f"with {SETS}, n as (select class, LONG(count(*)) as members from k group by class), w as (select a as class, b as other from p union all select b, a from p), l as (select w.class, LONG(sum(n.members)) as near from w join n on n.class = w.other group by w.class) select k.doc_id, k.class as class_id, n.members - 1 + coalesce(l.near, 0) as links from k join n using (class) left join l using (class)",
)
def similarity_links(spark, sf_dir):
    """Each document with its class and how many others are over 0.7, copies of its own grams included."""
    of, sets = gram_classes(spark, sf_dir)
    pairs = simjoin.jaccard_join(sets, "class", "members")
    sizes = cut(of.groupBy("class").agg(F.count("*").alias("members")))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("b").alias("other")), F.struct(F.col("b").alias("class"), F.col("a").alias("other")))).alias("e")).select("e.*")
    near = both.join(sizes.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("members").alias("near"))
    facts = cut(sizes.join(near, "class", "left").select("class", (F.col("members") - 1 + F.coalesce("near", F.lit(0))).alias("links")))
    return of.join(facts, "class").select("doc_id", F.col("class").alias("class_id"), "links")
