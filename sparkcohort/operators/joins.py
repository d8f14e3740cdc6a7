"""Joins with checks, and lookups of fitted state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class JoinError(ValueError):
    """A join's sides do not fit together."""


def validated_left_join(left: DataFrame, right: DataFrame, key: str, agree: list[str] | None = None, allow_unmatched: bool = False) -> DataFrame:
    """One-to-one left join.  Repeated keys, unmatched rows and columns that should agree but don't are errors.

    The checks are one aggregate a side and one over the join.
    """
    agree = agree or []
    for name, side in (("left", left), ("right", right)):
        n, distinct = side.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        if n != distinct:
            raise JoinError(f"{name} side: {n - distinct} rows repeat a {key}")
    renamed = right.withColumn("__there", F.lit(True))
    for c in agree:
        renamed = renamed.withColumnRenamed(c, f"__r_{c}")
    joined = left.join(renamed, key, "left")
    checks = [F.count_if(F.col("__there").isNull()).alias("unmatched")]
    checks += [F.count_if(F.col("__there") & ~F.col(c).eqNullSafe(F.col(f"__r_{c}"))).alias(c) for c in agree]
    row = joined.agg(*checks).first()
    if row["unmatched"] and not allow_unmatched:
        raise JoinError(f"{row['unmatched']} rows have no match")
    if bad := {c: row[c] for c in agree if row[c]}:
        raise JoinError(f"columns disagree: {bad}")
    return joined.drop("__there", *(f"__r_{c}" for c in agree))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def only_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (only_a, only_b): keys of either side that the other lacks."""
    x = a.select(key).distinct().withColumn("__a", F.lit(1))
    y = b.select(key).distinct().withColumn("__b", F.lit(1))
    return x.join(y, key, "full_outer").agg(F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b"))


def lookup(df: DataFrame, state: DataFrame, keys: list[str], default: Column, out: str) -> DataFrame:
    """Adds ``out``: the state's column of that name, or the default for keys it lacks.

    ``state`` has one row for a key.  Spark broadcasts it while it is under the
    session's threshold and shuffles both sides beyond; no size is assumed here.
    """
    return df.join(state.select(*keys, F.col(out).alias("__v")), keys, "left").withColumn(out, F.coalesce("__v", default)).drop("__v")


def tiered_lookup(df: DataFrame, fine: DataFrame, coarse: DataFrame, fine_keys: list[str], coarse_keys: list[str], default: Column, value: str, out: str, level: str) -> DataFrame:
    """Adds ``out`` and ``level``: the fine state's value, else the coarse one's, else the default."""
    a = fine.select(*fine_keys, F.col(value).alias("__fine"))
    b = coarse.select(*coarse_keys, F.col(value).alias("__coarse"))
    joined = df.join(a, fine_keys, "left").join(b, coarse_keys, "left")
    name = F.when(F.col("__fine").isNotNull(), "group_month").when(F.col("__coarse").isNotNull(), "group").otherwise("global")
    return joined.withColumn(out, F.coalesce("__fine", "__coarse", default)).withColumn(level, name).drop("__fine", "__coarse")


def overlay(df: DataFrame, columns: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """Columns put in place of, or beside, those of the same frame; no join."""
    out = df.withColumns(columns)
    return out.select(*order) if order else out


def outer_shares(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Two share tables side by side, zero where a key is missing."""
    joined = a.join(b, key, "full_outer")
    return joined.select(key, F.coalesce(left, F.lit(0.0)).alias(left), F.coalesce(right, F.lit(0.0)).alias(right))


def tagged_union(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """Rows of all parts by column name, with the part's name."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (n_shared)."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_shared"))
