"""Audits as tables: rates, pivots, spreads, shifts, twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.functions.ranks import average_ranks, dense_ids, quantile_edges, right_closed_bin
from sparkcohort.functions.scalars import safe_ratio
from sparkcohort.functions.stats import corrected_kurtosis, corrected_skewness


def rates(df: DataFrame, by: list[str], target: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(target).cast("double")).alias("rate"), F.count(target).alias("n"))


def value_shares(df: DataFrame, name: str, out: str = "share") -> DataFrame:
    """(name, out): share of each value; the total is one aggregated row."""
    counts = df.groupBy(name).agg(F.count("*").alias("__n"))
    total = F.broadcast(df.agg(F.count("*").cast("double").alias("__t")))
    return counts.join(total, F.lit(True)).select(name, (F.col("__n") / F.col("__t")).alias(out))


def pivot(df: DataFrame, rows: str, columns: str, values: list, what: Column) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).agg(what)


def ends(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k largest and k smallest rows, marked by side."""
    top = df.orderBy(F.col(value).desc(), tie).limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy(value, tie).limit(k).withColumn("side", F.lit("bottom")))


def rate_spreads(df: DataFrame, names: list[str], target: str, q: int) -> DataFrame:
    """(name, spread): largest less smallest rate over quantile bins of each column, widest first."""
    bins = [F.struct(F.lit(c).alias("name"), right_closed_bin(F.col(c), quantile_edges(df, c, q)).alias("bin")) for c in names]
    long = df.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*bins)).alias("x")).select("y", "x.*")
    per_bin = long.groupBy("name", "bin").agg(F.avg("y").alias("rate"))
    return per_bin.groupBy("name").agg((F.max("rate") - F.min("rate")).alias("spread")).orderBy(F.col("spread").desc(), "name")


def moments(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, n, mean, sd, skew, kurt, median), corrected for bias, in one pass."""
    wide = df.agg(*(F.struct(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
        corrected_skewness(c).alias("skew"), corrected_kurtosis(c).alias("kurt"), F.percentile(c, 0.5).alias("median"),
    ).alias(c) for c in names))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in names))).alias("x")).select("x.name", "x.v.*")


def shift(df: DataFrame, names: list[str], inside: Column) -> DataFrame:
    """(name, mean_shift, sd_ratio) of rows inside against the others, the mean in pooled deviations; null over zero."""

    def one(c: str) -> Column:
        a, b = F.when(inside, F.col(c)), F.when(~inside, F.col(c))
        return F.struct(safe_ratio(F.avg(a) - F.avg(b), F.stddev_samp(c)).alias("mean_shift"), safe_ratio(F.stddev_samp(a), F.stddev_samp(b)).alias("sd_ratio")).alias(c)

    wide = df.agg(*(one(c) for c in names))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in names))).alias("x")).select("x.name", "x.v.*")


def twin_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1").groupBy("size").agg(F.count("*").alias("n_groups"))


def twin_composition(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """(members, n_groups): which parts the rows of a twin group come from."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set(part))).alias("members")).filter("n > 1")
    return groups.groupBy("members").agg(F.count("*").alias("n_groups"))


def twin_agreement(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """One row (n_groups, agreement, by_chance): twin groups of one label, and how many there would be by chance."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(target).alias("k")).filter("n > 1")
    found = groups.agg(F.count("*").alias("n_groups"), F.avg((F.col("k") == 1).cast("double")).alias("agreement"))
    p = F.avg(F.col(target).cast("double"))
    chance = df.agg((p * p + (1 - p) * (1 - p)).alias("by_chance"))
    return found.join(F.broadcast(chance), F.lit(True))  # one row each


def merged_scores(tables: list[DataFrame], key: str) -> DataFrame:
    """Inner merge of tables with one row a feature."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, key)
    return out


def rank_gap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds <a>_rank and <b>_rank, descending with mean ranks for ties, and rank_gap, the second less the first."""
    n = df.agg(F.count("*").alias("__n"))
    for c in (a, b):
        ranks = average_ranks(df, c).join(F.broadcast(n), F.lit(True)).select(c, (F.col("__n") + 1 - F.col("rank")).alias(f"{c}_rank"))  # one row
        df = df.join(ranks, c, "left")
    return df.withColumn("rank_gap", F.col(f"{b}_rank") - F.col(f"{a}_rank"))


def group_spread(df: DataFrame, by: str, value: str, few: int = 15) -> DataFrame:
    """(by, n, sd, small): rows and sample deviation of a value in each group, and whether the group has few rows."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("small", F.col("n") < few)


def with_position(df: DataFrame, other: DataFrame, key: str, position: str) -> DataFrame:
    """Rows with the place that the other table's file order gives them; null where it lacks the key."""
    return df.join(other.select(key, position), key, "left")


def label_codes(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds 0-based codes of a column's values in their order."""
    return df.join(dense_ids(df, [name], out), name)


def class_report(df: DataFrame, y: str, guess: str) -> DataFrame:
    """(class, precision, recall, f1, support) of each class, from one count of pairs; 0 where nothing is there to divide by."""
    pairs = df.groupBy(F.col(y).alias("y"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.lit(1).alias("actual")), F.struct(F.col("g").alias("class"), F.lit(0).alias("actual")))).alias("x"), "y", "g", "n").select("x.*", "y", "g", "n")
    hit = F.when(F.col("y") == F.col("g"), F.col("n")).otherwise(0)
    sums = sides.groupBy("class").agg(F.sum(hit * F.col("actual")).alias("hits"), F.sum(F.col("n") * F.col("actual")).alias("support"), F.sum(F.col("n") * (1 - F.col("actual"))).alias("guessed"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    out = sums.withColumns({"precision": ratio(F.col("hits"), F.col("guessed")), "recall": ratio(F.col("hits"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("class", "precision", "recall", f1.alias("f1"), "support")
