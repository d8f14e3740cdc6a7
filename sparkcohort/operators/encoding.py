"""Learned lookups: anomalies against tiered baselines, shrunk group means, target encodings.

Fitted state is small: tables with one row a group, written once when learned, and a
few numbers.  Rows the
state was learned on use leave-one-out forms, which follow from sums and counts
and never need a second pass over a group's rows; other rows use the plain lookup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.operators.joins import lookup, tiered_lookup
from sparkcohort.sources.contracts import require_columns, require_no_collision
from sparkcohort.sources.storage import frozen


@dataclass(frozen=True)
class Baseline:
    """Sums, counts and means of a value by group, by group and month, and over all."""

    value: str
    group: list[str]
    date: str
    fine: DataFrame
    coarse: DataFrame
    total: float
    n: int
    min_rows: int

    @property
    def mean(self) -> float:
        return self.total / self.n


def _month(date: str) -> Column:
    return F.month(date).alias("__month")


def fit_baseline(df: DataFrame, value: str, group: list[str], date: str, min_rows: int = 5) -> Baseline:
    """A group and month counts as a tier of its own from ``min_rows`` rows."""
    require_columns(df, [value, *group, date])
    stats = [F.sum(value).alias("s"), F.count(value).alias("n"), F.avg(value).alias("mean")]
    fine = df.groupBy(*group, _month(date)).agg(*stats).filter(F.col("n") >= min_rows)
    coarse = df.groupBy(*group).agg(*stats)
    total, n = df.agg(F.sum(value), F.count(value)).first()
    if not n:
        raise ValueError(f"no {value} to learn from")
    return Baseline(value, group, date, frozen(fine, "baseline"), frozen(coarse, "baseline"), float(total), n, min_rows)


def apply_anomaly(df: DataFrame, state: Baseline) -> DataFrame:
    """Adds <value>_anomaly and <value>_baseline_level: the value less the finest baseline there is."""
    out, level = f"{state.value}_anomaly", f"{state.value}_baseline_level"
    require_no_collision(df, [out, level])
    keyed = df.withColumn("__month", F.month(state.date))
    found = tiered_lookup(keyed, state.fine, state.coarse, [*state.group, "__month"], state.group, F.lit(state.mean), "mean", out, level)
    return found.withColumn(out, F.col(state.value) - F.col(out)).drop("__month")


def fit_rows_anomaly(df: DataFrame, state: Baseline) -> DataFrame:
    """The same for the rows ``state`` was learned on, each left out of its own baseline.

    A tier needs another row besides; a table of one row has its own mean as baseline.
    """
    out, level = f"{state.value}_anomaly", f"{state.value}_baseline_level"
    require_no_collision(df, [out, level])
    x = F.col(state.value)
    fine = state.fine.select(*state.group, "__month", F.col("s").alias("__fs"), F.col("n").alias("__fn"))
    coarse = state.coarse.select(*state.group, F.col("s").alias("__cs"), F.col("n").alias("__cn"))
    joined = df.withColumn("__month", F.month(state.date)).join(fine, [*state.group, "__month"], "left").join(coarse, state.group, "left")
    overall = F.lit(state.mean) if state.n == 1 else (F.lit(state.total) - x) / F.lit(state.n - 1)
    use_fine, use_coarse = F.col("__fn") > 1, F.col("__cn") > 1
    base = F.when(use_fine, (F.col("__fs") - x) / F.nullif(F.col("__fn") - 1, F.lit(0))).when(use_coarse, (F.col("__cs") - x) / F.nullif(F.col("__cn") - 1, F.lit(0))).otherwise(overall)
    name = F.when(use_fine, "group_month").when(use_coarse, "group").otherwise("global")
    return joined.withColumns({out: x - base, level: name}).drop("__month", "__fs", "__fn", "__cs", "__cn")


@dataclass(frozen=True)
class ShrunkMeans:
    """Group sums and counts, and the overall mean they are pulled to with weight k."""

    value: str
    keys: list[str]
    groups: DataFrame
    mean: float
    k: float


def fit_shrunk(df: DataFrame, value: str, keys: list[str], k: float = 5.0) -> ShrunkMeans:
    if k < 0:
        raise ValueError("the weight must not be negative")
    require_columns(df, [value, *keys])
    mean = df.agg(F.avg(value)).first()[0]
    if mean is None:
        raise ValueError(f"no {value} to learn from")
    groups = df.groupBy(*keys).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    groups = groups.withColumn("shrunk", (F.col("s") + F.lit(k * mean)) / F.nullif(F.col("n") + F.lit(float(k)), F.lit(0.0)))
    return ShrunkMeans(value, keys, frozen(groups, "means"), mean, float(k))


def apply_shrunk(df: DataFrame, state: ShrunkMeans, out: str) -> DataFrame:
    """Adds ``out``; groups the state does not know get the overall mean."""
    require_no_collision(df, [out])
    return lookup(df, state.groups.select(*state.keys, F.col("shrunk").alias(out)), state.keys, F.lit(state.mean), out)


def fit_rows_shrunk(df: DataFrame, state: ShrunkMeans, out: str) -> DataFrame:
    """The same for the rows it was learned on, each left out of its group (not of the overall mean)."""
    require_no_collision(df, [out])
    joined = df.join(state.groups.select(*state.keys, F.col("s").alias("__s"), F.col("n").alias("__n")), state.keys, "left")
    own = (F.col("__s") - F.col(state.value) + F.lit(state.k * state.mean)) / F.nullif(F.col("__n") - 1 + F.lit(state.k), F.lit(0.0))
    return joined.withColumn(out, own).drop("__s", "__n")


def fit_target_encoding(df: DataFrame, category: str, target: str, smoothing: float = 10.0) -> ShrunkMeans:
    return fit_shrunk(df, target, [category], smoothing)


def apply_target_encoding(df: DataFrame, state: ShrunkMeans, out: str | None = None) -> DataFrame:
    return apply_shrunk(df, state, out or f"{state.keys[0]}_te")


def out_of_fold_encoding(df: DataFrame, category: str, target: str, fold: str, smoothing: float = 10.0, out: str | None = None) -> DataFrame:
    """Each row's encoding from the other folds: category totals less those of its own fold.

    The mean it is pulled to is over all rows.  Rows without a fold are an error.
    """
    out = out or f"{category}_te"
    require_columns(df, [category, target, fold])
    require_no_collision(df, [out])
    if smoothing < 0:
        raise ValueError("the weight must not be negative")
    by_fold = df.groupBy(category, fold).agg(F.sum(target).alias("__fs"), F.count(target).alias("__fn"))
    both = by_fold.groupBy(category).agg(F.sum("__fs").alias("__s"), F.sum("__fn").alias("__n"))
    mean, missing = df.agg(F.avg(target), F.count_if(F.col(fold).isNull())).first()
    if missing:
        raise ValueError(f"{missing} rows are in no fold")
    others = by_fold.join(both, category)
    n = F.col("__n") - F.col("__fn")
    code = (F.col("__s") - F.col("__fs") + F.lit(smoothing * mean)) / F.nullif(n + F.lit(float(smoothing)), F.lit(0.0))
    table = others.select(category, fold, F.when(n > 0, code).otherwise(F.lit(mean)).alias(out))
    return df.join(table, [category, fold], "left")


def check_folds(assignment: DataFrame, key: str, folds: str = "fold") -> None:
    """Every key in exactly one fold."""
    bad = assignment.groupBy(key).agg(F.count_distinct(folds).alias("n")).filter("n != 1").limit(1).count()
    if bad:
        raise ValueError("folds overlap or leave keys out")


def one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """0/1 columns over a frozen list of categories; unknown values give zeros."""
    return df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c, values in categories.items() for v in values})


def freeze_categories(df: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """Sorted categories of each column, in one pass."""
    row = df.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in names)).first()
    return {c: list(row[c]) for c in names}
