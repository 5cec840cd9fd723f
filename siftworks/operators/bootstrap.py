"""Paired bootstrap intervals from counts: rows with equal outcomes are drawn together, each replicate as many as there are."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replicate_means(delta: np.ndarray, n: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Sorted means of `draws` bootstrap replicates of exactly sum(n) rows, of which n have each value of delta.

    How many rows of each value a replicate has is multinomial, and is drawn value by value: of the rows that are left to draw, a binomial number
    has the next value, by its share in what is left. Memory is that of `draws` numbers, whatever the number of values.
    """
    rng, total = np.random.default_rng(seed), int(n.sum())
    left, rows, sums = np.full(draws, total, np.int64), total, np.zeros(draws)
    for value, count in zip(delta.tolist(), n.tolist()):
        drawn = rng.binomial(left, count / rows) if count < rows else left
        sums += drawn * value
        left, rows = left - drawn, rows - count
    return np.sort(sums / total)


def paired_interval(rows: DataFrame, keys: list[str], a: str, b: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(keys, n, delta, low, high): mean of b - a and its 95 % interval over `draws` bootstrap replicates.

    Rows are counted by value of b - a first, so what a task gets is a few counts a key, however many rows there are. The draws are fixed
    by seed and key.
    """
    counts = rows.groupBy(*keys, (F.col(b) - F.col(a)).cast("double").alias("delta")).agg(F.count("*").alias("n"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("delta")
        key = [pdf[k].iloc[0] for k in keys]
        means = replicate_means(pdf.delta.to_numpy(), pdf.n.to_numpy(), draws, zlib.crc32(repr([seed, *map(str, key)]).encode()))
        low, high = (round(float(means[int(q * draws)]), 6) for q in (0.025, 0.975))
        return pd.DataFrame([[*key, int(pdf.n.sum()), round(float((pdf.delta * pdf.n).sum() / pdf.n.sum()), 6), low, high]], columns=[*keys, "n", "delta", "low", "high"])

    return counts.groupBy(*keys).applyInPandas(interval, ", ".join(f"{k} {types[k]}" for k in keys) + ", n bigint, delta double, low double, high double")
