"""Splits, caps and quotas on any table, in hash mode (distributed) or exact mode (seeded draws over sorted keys)."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut
from .dedup import rank_first


def draw(key: str, seed: int = 42) -> Column:
    """Order of a draw: a hash of seed and key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def ranks(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(df with rank, 1 for the first row by `order`; number of rows). Rows are sorted by ranges, and only the ranges' sizes reach the driver.

    The sorted rows are kept: ranges rest on a sample, and another run would draw others.
    """
    rows = cut(df.orderBy(*order).withColumns({"_at": F.monotonically_increasing_id(), "_p": F.spark_partition_id()}))
    sizes = dict(rows.groupBy("_p").count().collect())
    ahead, total = {}, 0
    for p in sorted(sizes):
        ahead[p], total = total, total + sizes[p]
    base = F.element_at(F.create_map(*(F.lit(x) for kv in (ahead or {0: 0}).items() for x in kv)), F.col("_p"))
    return rows.withColumn("rank", base + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_p"), total


def group_split(df: DataFrame, group: str, fractions: dict[str, float], seed: int = 42, exact: bool = False) -> DataFrame:
    """df with a split column; rows of one group stay together and the last split takes what rounding leaves.

    Sizes are rounded half to even. exact draws with Python's generator over the sorted keys, which go to the driver.
    """
    keys = df.select(group).where(F.col(group).isNotNull()).distinct()
    if exact:
        names = sorted(r[0] for r in keys.collect())
        random.Random(seed).shuffle(names)
        ranked = df.sparkSession.createDataFrame(list(zip(names, range(1, len(names) + 1))), T.StructType([*keys.schema.fields, T.StructField("_rn", T.IntegerType())]))
        n = len(names)
    else:
        rows, n = ranks(keys.withColumn("_draw", draw(group, seed)), ["_draw", group])
        ranked = rows.select(group, F.col("rank").alias("_rn"))
    cut, edge = F.lit(list(fractions)[-1]), 0
    ends = []
    for name in list(fractions)[:-1]:
        edge += round(n * fractions[name])
        ends.append((name, edge))
    for name, e in reversed(ends):
        cut = F.when(F.col("_rn") <= e, name).otherwise(cut)
    return df.join(ranked.select(group, cut.alias("split")), group)


def cap(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    return rank_first(df, group, [F.col(c) for c in order], k)


def allocate(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Shares of total in proportion to the sizes, rounded down; what is left goes to the largest buckets."""
    whole = sum(sizes.values())
    out = {k: total * v // whole if whole else 0 for k, v in sizes.items()}
    rest = total - sum(out.values()) if whole else 0
    for k in sorted(sizes, key=lambda k: (-sizes[k], k))[:rest]:
        out[k] += 1
    return out


def feasible_total(available: dict[str, int], ratios: dict[str, float], tolerance: float) -> tuple[int, dict[str, int]]:
    """(largest total, chosen counts): every bucket within tolerance of its ratio from below, slack filled in order of ratio."""
    total = min(min(math.floor(available[k] / (r - tolerance)) for k, r in ratios.items()), sum(available.values()))
    chosen = {k: min(available[k], math.ceil((r - tolerance) * total)) for k, r in ratios.items()}
    slack = total - sum(chosen.values())
    for k in ratios:
        more = max(0, min(available[k] - chosen[k], math.floor((ratios[k] + tolerance) * total) - chosen[k], slack))
        chosen[k], slack = chosen[k] + more, slack - more
    return total, chosen
