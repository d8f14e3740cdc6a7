"""Table contracts: every rule of a table is counted in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcohort.functions.scalars import tidy


class ContractError(ValueError):
    """A table breaks its contract; the message lists every broken rule."""


@dataclass(frozen=True)
class Contract:
    """Columns with types, row rules (name to a condition that must hold), and unique columns."""

    name: str
    schema: T.StructType
    rules: dict[str, Column] = field(default_factory=dict)
    unique: tuple[str, ...] = ()

    def report(self, df: DataFrame) -> DataFrame:
        """(rule, n_bad) for every rule; one scan, whatever the number of rules.  A null breaks a rule."""
        counts = {f"{c} not null": F.count_if(F.col(c).isNull()) for c in (f.name for f in self.schema if not f.nullable)}
        counts |= {k: F.count_if(~F.coalesce(v, F.lit(False))) for k, v in self.rules.items()}
        counts |= {f"{c} unique": F.count(F.lit(1)) - F.count_distinct(c) for c in self.unique}
        row = df.agg(*(v.alias(f"r{i}") for i, v in enumerate(counts.values())))
        pairs = (F.struct(F.lit(k).alias("rule"), F.col(f"r{i}").cast("bigint").alias("n_bad")) for i, k in enumerate(counts))
        return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")

    def check(self, df: DataFrame) -> DataFrame:
        """``df`` itself, or an error that names missing and extra columns, wrong types and broken rules."""
        want, got = {f.name: f.dataType for f in self.schema}, {f.name: f.dataType for f in df.schema}
        wrong = [f"missing {c}" for c in want if c not in got] + [f"extra {c}" for c in got if c not in want]
        wrong += [f"{c} is {got[c].simpleString()}, not {t.simpleString()}" for c, t in want.items() if c in got and got[c] != t]
        if not wrong:
            wrong = [f"{r.rule}: {r.n_bad} rows" for r in self.report(df).filter("n_bad > 0").collect()]
        if wrong:
            raise ContractError(f"{self.name}: " + "; ".join(wrong))
        return df


def require_columns(df: DataFrame, names: list[str]) -> None:
    """KeyError with all missing columns."""
    if missing := sorted(set(names) - set(df.columns)):
        raise KeyError(f"missing columns: {', '.join(missing)}")


def require_no_nulls(df: DataFrame, names: list[str]) -> None:
    """ValueError with all columns that hold a null or NaN."""
    kinds = dict(df.dtypes)
    bad = [F.count_if(F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))).alias(c) for c in names]
    row = df.agg(*bad).first()
    if nulls := [c for c in names if row[c]]:
        raise ValueError(f"nulls in: {', '.join(nulls)}")


def require_no_collision(df: DataFrame, names: list[str]) -> None:
    """ValueError if an output column is there already."""
    if there := sorted(set(names) & set(df.columns)):
        raise ValueError(f"columns exist already: {', '.join(there)}")


def require_whole_ages(df: DataFrame, age: str, highest: float = 130) -> None:
    a = F.col(age)
    row = df.agg(F.count_if(a < 0).alias("negative"), F.count_if(a != F.floor(a)).alias("fractional"), F.count_if(a > highest).alias("too_high")).first()
    if bad := {k: v for k, v in row.asDict().items() if v}:
        raise ValueError(f"{age}: {bad}")


def unexpected_values(df: DataFrame, name: str, expected: list[str]) -> DataFrame:
    """(value) found but not expected, null apart."""
    return df.filter(F.col(name).isNotNull() & ~F.col(name).isin(expected)).select(F.col(name).alias("value")).distinct()


def require_values(df: DataFrame, name: str, expected: list[str]) -> None:
    if found := sorted(r[0] for r in unexpected_values(df, name, expected).limit(100).collect()):
        raise ValueError(f"{name}: unexpected values {found}")


def drop_dead_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Without ``names``, each of which must hold at most one value, null counted as one."""
    require_columns(df, names)
    row = df.agg(*((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in names)).first()
    if alive := [c for c in names if (row[c] or 0) > 1]:
        raise ValueError(f"columns vary: {', '.join(alive)}")
    return df.drop(*names)


def column_health(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, missing_share, n_unique, top_share, mean, sd, low, high, verdict) of numeric columns.

    Fails with over 20 % missing or 95 % one value.
    """
    n = F.count(F.lit(1)).cast("double")
    wide = df.agg(*(F.struct(
        (F.count_if(F.col(c).isNull()) / n).alias("missing_share"), F.count_distinct(c).alias("n_unique"),
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), n.alias("n"),
    ).alias(c) for c in names))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in names))).alias("x")).select("x.name", "x.v.*")
    values = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names))).alias("x")).select("x.*").filter("value IS NOT NULL")
    top = values.groupBy("name", "value").agg(F.count("*").alias("k")).groupBy("name").agg(F.max("k").alias("k"))
    out = long.join(F.broadcast(top), "name", "left").withColumn("top_share", F.coalesce(F.col("k"), F.lit(0)) / F.col("n"))
    verdict = F.when((F.col("missing_share") > 0.2) | (F.col("top_share") >= 0.95), "FAIL").otherwise("PASS")
    return out.select("name", *(tidy(c).alias(c) for c in ("missing_share", "top_share", "mean", "sd", "low", "high")), F.col("n_unique").cast("bigint").alias("n_unique"), verdict.alias("verdict"))


def null_census(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(name, n_null), one row a column."""
    names = names or df.columns
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n_null")) for c in names))).alias("x")).select("x.*")


def variance_audit(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, n_unique, sd, spread, dead) of numeric columns."""
    wide = df.agg(*(F.struct(F.count_distinct(c).alias("n_unique"), F.stddev_samp(c).alias("sd"), (F.max(c) - F.min(c)).cast("double").alias("spread")).alias(c) for c in names))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in names))).alias("x")).select("x.name", "x.v.*")
    return long.select("name", F.col("n_unique").cast("bigint").alias("n_unique"), tidy("sd").alias("sd"), tidy("spread").alias("spread"), (F.col("n_unique") <= 1).alias("dead"))


def out_of_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row (n_falls): neighbours in ``order`` between which ``value`` falls.

    ``order`` must be whole numbers without gaps, so neighbours meet in an equi-join and no global sort is needed.
    """
    after = df.select((F.col(order) - 1).alias(order), F.col(value).alias("__next"))
    return df.select(order, value).join(after, order).agg(F.count_if(F.col("__next") < F.col(value)).alias("n_falls"))
