"""Moments, association measures and two-sample tests as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.functions.ranks import running
from sparkcohort.functions.scalars import safe_ratio


def corrected_skewness(c: str) -> Column:
    """Bias-corrected skewness, null for fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis, null for fewer than four values."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def two_by_two(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row n11, n10, n01, n00 of two conditions."""
    return df.agg(*(F.count_if((a == F.lit(bool(x))) & (b == F.lit(bool(y)))).alias(f"n{x}{y}") for x in (1, 0) for y in (1, 0)))


def chi_square(counts: DataFrame) -> DataFrame:
    """Adds chi2 (continuity-corrected), n and cramers_v to a row of ``two_by_two``; null if a margin is empty."""
    n = sum((F.col(f"n{x}{y}") for x in (1, 0) for y in (1, 0)), F.lit(0)).cast("double")
    total, plain = F.lit(0.0), F.lit(0.0)
    for x in (1, 0):
        for y in (1, 0):
            row = F.col(f"n{x}1") + F.col(f"n{x}0")
            col = F.col(f"n1{y}") + F.col(f"n0{y}")
            expected = row * col / F.nullif(n, F.lit(0.0))
            gap = F.abs(F.col(f"n{x}{y}") - expected)
            total = total + safe_ratio((gap - F.least(F.lit(0.5), gap)) * (gap - F.least(F.lit(0.5), gap)), expected)
            plain = plain + safe_ratio(gap * gap, expected)
    return counts.withColumns({"n": n, "chi2": total, "chi2_plain": plain}).withColumn("cramers_v", F.sqrt(F.col("chi2") / F.nullif(F.col("n"), F.lit(0.0))))


def chi_square_p(statistic: float) -> float:
    """Upper tail at one degree of freedom."""
    return math.erfc(math.sqrt(statistic / 2))


def ks_distance(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row (ks, n1, n2): the largest gap between the distributions of rows where ``first`` holds and others."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    ranked = running(counts, value, ["a", "b"])
    totals = F.broadcast(counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2")))  # one row
    gaps = ranked.join(totals, F.lit(True)).select("n1", "n2", F.abs(safe_ratio("cum_a", "n1") - safe_ratio("cum_b", "n2")).alias("gap"))
    return gaps.groupBy("n1", "n2").agg(F.max("gap").alias("ks"))


def ks_p(statistic: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided p of a KS distance."""
    x = statistic * math.sqrt(n1 * n2 / (n1 + n2))
    if x < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def mutual_information(df: DataFrame, bins: str, target: str) -> DataFrame:
    """One row (mi): plug-in mutual information, in nats, of a binned column and a target."""
    joint = df.groupBy(bins, target).agg(F.count("*").alias("n"))
    x = joint.groupBy(bins).agg(F.sum("n").alias("nx"))
    y = joint.groupBy(target).agg(F.sum("n").alias("ny"))
    total = F.broadcast(joint.agg(F.sum("n").cast("double").alias("t")))
    all_ = joint.join(x, bins).join(F.broadcast(y), target).join(total, F.lit(True))
    return all_.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def pearson_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) for every pair a < b, in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    entries = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("x")
    return row.select(entries).select("x.*")
