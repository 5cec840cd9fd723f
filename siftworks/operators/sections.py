"""Markdown read by lines: headings outside fenced blocks, as a tree, with the lines that stand below each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = 6


def sections(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, section, level, title, path, body, items) of each text, section 0 being what stands before any heading, where there is a line.

    A fence opens with ``` or ~~~ and ends with the same mark or the text; headings within it are lines. path: titles from the outermost heading
    above to the section's own, joined by ' / '. body: the lines below the heading, without blank ones at either end. items: lines of lists, without their mark. Null texts
    have no sections. Lines of one text are sorted together; texts are never gathered.
    """
    lines = rows.select(F.col(row_id).alias("id"), F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("at", "line"))
    order = W.partitionBy("id").orderBy("at")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    mark = F.regexp_extract("line", r"^ {0,3}(```|~~~)", 1)
    x = lines.withColumn("mark", mark)
    # A mark of the other kind within a fence is a line: the fence that is open is told by the first mark behind the last that closed one.
    x = x.withColumn("fences", F.aggregate(F.collect_list(F.when(F.col("mark") != "", F.col("mark"))).over(so_far), F.lit(""), lambda now, m: F.when(now == "", m).when(now == m, "").otherwise(now)))
    x = x.withColumn("level", F.when((F.col("fences") == "") & (F.col("mark") == ""), F.length(F.regexp_extract("line", r"^ {0,3}(#{1,6})(?:\s|$)", 1))).otherwise(0))
    x = x.withColumn("title", F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^ {0,3}#{1,6}|\s+#+\s*$", ""))))
    x = x.withColumn("section", F.sum((F.col("level") > 0).cast("bigint")).over(so_far))
    for k in range(1, LEVELS + 1):
        x = x.withColumn(f"h{k}", F.max(F.when(F.col("level") == k, F.struct("at", "title"))).over(so_far))
    heads = F.array(*(F.when(F.lit(k) <= F.col("level"), F.struct(F.lit(k).alias("k"), F.col(f"h{k}.at").alias("at"), F.col(f"h{k}.title").alias("title"))) for k in range(1, LEVELS + 1)))
    # A heading of an outer level ends those within.
    above = F.filter(heads, lambda h: h.isNotNull() & h["at"].isNotNull())
    chain = F.filter(above, lambda h: ~F.exists(above, lambda o: (o["k"] < h["k"]) & (o["at"] > h["at"])))
    x = x.withColumn("path", F.when(F.col("level") > 0, F.array_join(F.transform(chain, lambda h: h["title"]), " / ")))
    body = F.transform(F.filter(F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("at", "line")))), lambda s: s.isNotNull()), lambda s: s["line"])
    out = x.groupBy("id", "section").agg(F.max("level").alias("level"), F.max("title").alias("title"), F.max("path").alias("path"), body.alias("lines"))
    joined = F.regexp_replace(F.array_join("lines", "\n"), r"^(?:[^\S\n]*\n)+|(?:\n[^\S\n]*)+$", "")
    items = F.transform(F.filter("lines", lambda s: s.rlike(r"^\s*[-*+]\s+\S")), lambda s: F.trim(F.regexp_replace(s, r"^\s*[-*+]\s+", "")))
    return out.select(F.col("id").alias(row_id), "section", "level", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("path", F.lit("")).alias("path"), joined.alias("body"), items.alias("items"))
