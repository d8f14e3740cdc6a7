"""Ranks, running sums and bins over whole tables.

A window without a partition key runs in one task.  ``running`` instead cuts the
value range at approximate quantiles, sums each bucket, and adds the sum of all
lower buckets to a running sum within the bucket: the order of the table costs one
shuffle over many tasks.  The cuts only balance the work; any cuts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 64


def _bucket(df: DataFrame, value: str, buckets: int) -> Column:
    if dict(df.dtypes)[value] in ("string", "date", "timestamp_ntz", "timestamp"):
        return _bucket_of_text(df, value, buckets)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(value, shares, 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.aggregate(F.array(*(F.lit(c) for c in cuts)), F.lit(0), lambda n, c: n + (c < F.col(value)).cast("int")), F.lit(-1))


def _bucket_of_text(df: DataFrame, value: str, buckets: int) -> Column:
    """Cuts of values without arithmetic, from a bounded sample of them."""
    sample = sorted(r[0] for r in df.select(value).dropna().distinct().limit(buckets * 50).collect())
    cuts = sample[50::50]
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.aggregate(F.array(*(F.lit(c) for c in cuts)), F.lit(0), lambda n, c: n + (c < F.col(value)).cast("int")), F.lit(-1))


def running(df: DataFrame, value: str, sums: list[str], by: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``cum_<x>`` for each of ``sums``: its sum over rows of the same ``by`` up to and including this value.

    Rows need different values within ``by``.
    """
    by = by or []
    cut = df.withColumn("__b", _bucket(df, value, buckets))
    totals = cut.groupBy(*by, "__b").agg(*(F.sum(s).alias(f"__t_{s}") for s in sums))
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "__b", *(F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums))  # at most BUCKETS + 1 rows a group
    inside = W.partitionBy(*by, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = cut.join(totals, [*by, "__b"])
    return out.select(*df.columns, *((F.col(f"__o_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums))


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, n, rank): ascending ranks of different values, ties sharing their mean rank."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running(counts, value, ["n"], by)
    return ranked.select(*by, value, "n", (F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)).alias("rank"))


def dense_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): 0-based ids of different key tuples, in key order."""
    one = df.select(*keys).distinct().withColumn("__one", F.lit(1).cast("bigint"))
    if len(keys) == 1:
        numbered = running(one, keys[0], ["__one"])
        return numbered.select(*keys, (F.col("cum___one") - 1).alias(name))
    head = df.select(keys[0]).distinct()
    heads = dense_ids(head, [keys[0]], "__h").withColumnRenamed(keys[0], "__k0")
    inner = W.partitionBy(keys[0]).orderBy(*keys[1:])
    placed = one.withColumn("__i", F.row_number().over(inner))
    sizes = one.groupBy(keys[0]).agg(F.count("*").alias("__n")).withColumnRenamed(keys[0], "__k0").join(heads, "__k0")
    offsets = running(sizes, "__h", ["__n"]).select("__k0", (F.col("cum___n") - F.col("__n")).alias("__o"))
    return placed.join(offsets, F.col(keys[0]).eqNullSafe(F.col("__k0"))).select(*keys, (F.col("__o") + F.col("__i") - 1).alias(name))


def quantile_edges(df: DataFrame, value: str, q: int) -> list[float]:
    """Exact linear-interpolation edges of q bins, duplicates dropped."""
    edges = df.agg(F.percentile(value, [i / q for i in range(q + 1)]).alias("e")).first()["e"]
    return sorted(set(edges or []))


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """0-based bin of edges, right-closed, the lowest edge included; null outside."""
    out = F.when(value.isNull() | (value < edges[0]) | (value > edges[-1]), F.lit(None).cast("int"))
    for i, edge in enumerate(edges[1:]):
        out = out.when(value <= edge, i)
    return out


def equal_width_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    low, high = df.agg(F.min(value), F.max(value)).first()
    return [low + (high - low) * i / bins for i in range(bins)] + [high]
