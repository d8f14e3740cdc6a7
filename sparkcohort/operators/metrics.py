"""Metrics of predictions, exact and in one pass or one ranked pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.functions.ranks import average_ranks, quantile_edges, right_closed_bin
from sparkcohort.functions.scalars import safe_ratio


def f1_parts(y: Column, guess: Column) -> Column:
    """F1 at given 0/1 guesses; 0 without any positive."""
    tp, wrong = F.count_if((y == 1) & (guess == 1)), F.count_if(y != guess)
    return F.coalesce(2 * tp / F.nullif(2 * tp + wrong, F.lit(0)).cast("double"), F.lit(0.0))


def auc(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """(by, auc): rank-sum area with mean ranks for ties; null when one class is absent."""
    by = by or []
    ranks = average_ranks(df.filter(F.col(p).isNotNull()), p, by).select(*by, p, "rank")
    sums = df.groupBy(*by, p).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count("*").alias("n")).join(ranks, [*by, p])
    sums = sums.groupBy(*by).agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("a"), F.sum("n").alias("n"))
    area = (F.col("s") - F.col("a") * (F.col("a") + 1) / 2) / F.nullif(F.col("a") * (F.col("n") - F.col("a")), F.lit(0.0))
    return sums.select(*by, area.alias("auc"))


def score(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """(by, f1, auc, score): 0.6 F1 at 0.5 and 0.4 area."""
    by = by or []
    f1 = df.groupBy(*by).agg(f1_parts(F.col(y), (F.col(p) >= 0.5).cast("int")).alias("f1"))
    area = auc(df, y, p, by)
    both = f1.join(area, by) if by else f1.join(F.broadcast(area), F.lit(True))  # one row each
    return both.withColumn("score", 0.6 * F.col("f1") + 0.4 * F.col("auc"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def confusion(df: DataFrame, y: str, guess: Column) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), guess.alias("guess")).agg(F.count("*").alias("n"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, gap) over quantile bins of p."""
    edges = quantile_edges(df, p, bins)
    out = df.withColumn("bin", right_closed_bin(F.col(p), edges)).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))
    return out.withColumn("gap", F.col("mean_p") - F.col("rate"))


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row (mean, sd, low, high, n); the deviation of one value is 0, none is an error when collected."""
    return df.agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def paired_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (mean, sd over n, wins of a, n)."""
    d = F.col(a) - F.col(b)
    return df.agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.count_if(d > 0).alias("wins"), F.count(d).alias("n"))


def both_wrong(df: DataFrame, y: str, models: list[str]) -> DataFrame:
    """(a, b, share): of rows that either of two models gets wrong, those both do; null if neither errs."""
    wrong = {m: (F.col(m) >= 0.5).cast("int") != F.col(y) for m in models}
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    row = df.agg(*(safe_ratio(F.count_if(wrong[a] & wrong[b]), F.count_if(wrong[a] | wrong[b])).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("share")) for a, b in pairs))).alias("x")).select("x.*")


def rank_average(df: DataFrame, key: str, models: list[str], out: str = "p") -> DataFrame:
    """(key, out): mean over models of the mean rank of a prediction, over the number of rows."""
    n = df.count()
    joined = df
    for m in models:
        ranks = average_ranks(df, m).select(F.col(m).alias(f"__v_{m}"), (F.col("rank") / F.lit(float(n))).alias(f"__r_{m}"))
        joined = joined.join(ranks, F.col(m) == F.col(f"__v_{m}"))
    total = sum((F.col(f"__r_{m}") for m in models), F.lit(0.0))
    return joined.select(key, (total / len(models)).alias(out))


def blend(weights: dict[str, float], models: list[str]) -> Column:
    """Weighted mean of model columns."""
    if set(weights) != set(models):
        raise ValueError("weights and models differ")
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must add up to more than zero")
    return sum((F.col(m) * F.lit(weights[m] / total) for m in models), F.lit(0.0))


def search_weights(df: DataFrame, y: str, models: list[str], draws: int = 2000, seed: int = 42, chunk: int = 50) -> tuple[dict[str, float], float]:
    """The blend with the best score: equal weights, each model alone, then random draws; the first best wins.

    Candidates go over the rows in chunks, each chunk one grouped scoring job.
    """
    import numpy as np

    k = len(models)
    candidates = [[1 / k] * k, *np.eye(k).tolist(), *np.random.RandomState(seed).dirichlet([1.0] * k, size=draws).tolist()]
    best, at = -1.0, 0
    for start in range(0, len(candidates), chunk):
        part = candidates[start : start + chunk]
        each = F.explode(F.array(*(F.struct(F.lit(start + i).alias("w"), blend(dict(zip(models, w, strict=True)), models).alias("p")) for i, w in enumerate(part)))).alias("x")
        scored = score(df.select(y, each).select(y, "x.*"), y, "p", ["w"])
        for r in sorted(scored.collect(), key=lambda r: r["w"]):
            if r["score"] is not None and r["score"] > best + 1e-12:
                best, at = r["score"], r["w"]
    return dict(zip(models, candidates[at], strict=True)), best


def submission(df: DataFrame, key: str, p: str) -> DataFrame:
    return df.select(F.col(key).alias("ID"), (F.col(p) >= 0.5).cast("int").alias("TargetF1"), F.col(p).alias("TargetRAUC"))


def submission_faults(df: DataFrame, sample: DataFrame) -> DataFrame:
    """(rule, n_bad) of an output against the sample: rows, ids either way, values."""
    if df.columns != sample.columns:
        raise ValueError(f"columns are {df.columns}, not {sample.columns}")
    a, b = df.select("ID").withColumn("__a", F.lit(1)), sample.select("ID").withColumn("__b", F.lit(1))
    ids = a.groupBy("ID").agg(F.count("*").alias("na")).join(b.groupBy("ID").agg(F.count("*").alias("nb")), "ID", "full_outer")
    keys = ids.agg(F.count_if(F.col("nb").isNull()).alias("x"), F.count_if(F.col("na").isNull()).alias("y"), F.count_if(F.col("na") > 1).alias("z"))
    values = df.agg(F.count_if(~F.coalesce(F.col("TargetF1").isin(0, 1), F.lit(False))).alias("f"), F.count_if(~F.coalesce(F.col("TargetRAUC").between(0, 1), F.lit(False))).alias("r"))
    named = keys.join(F.broadcast(values), F.lit(True))  # one row each
    pairs = (("id not in sample", "x"), ("sample id missing", "y"), ("id repeated", "z"), ("TargetF1 not 0 or 1", "f"), ("TargetRAUC outside 0..1", "r"))
    return named.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(c).alias("n_bad")) for k, c in pairs))).alias("x")).select("x.*")
