"""Grouped validation splits.

Groups that share a constraint are merged by distributed components.  Group sizes
are aggregated in Spark; the choice of folds is made on the driver
over one number a group, and comes back as a table joined by key.  Groups are
places or days, so there are few; rows never leave the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.functions.ranks import dense_ids
from sparkcohort.operators.components import connected_components
from sparkcohort.sources.storage import Workspace, frozen

MAX_GROUPS = 2_000_000


def _few(df: DataFrame) -> list:
    rows = df.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    return rows


def twin_groups(df: DataFrame, keys: list[str], out: str = "twin_group") -> DataFrame:
    """Adds a dense id for each different tuple of keys (compared as values, never joined as text); null keys are an error."""
    if df.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).limit(1).count():
        raise ValueError("null twin keys")
    return df.join(dense_ids(df, keys, out), keys)


def merged_groups(df: DataFrame, primary: str, constraint: str, out: str = "merged_group") -> DataFrame:
    """(primary, out): primary groups that share a constraint group, directly or in a chain, as one; ids dense by smallest member."""
    ids = frozen(dense_ids(df.select(primary).distinct(), [primary], "__id"), "groups")
    edges = df.select(primary, constraint).distinct().join(ids, primary)
    hubs = edges.groupBy(constraint).agg(F.min("__id").alias("__hub"))
    links = edges.join(hubs, constraint).select(F.col("__hub").alias("a"), F.col("__id").alias("b"))
    roots = connected_components(links, Workspace(df.sparkSession, "components"))
    named = ids.join(roots, ids["__id"] == roots["node"], "left").withColumn("__root", F.coalesce("root", "__id"))
    dense = dense_ids(named.select("__root").distinct(), ["__root"], out)
    return named.join(dense, "__root").select(primary, F.col(out).cast("bigint").alias(out))


def _table(df: DataFrame, group: str, rows: list[tuple], names: str) -> DataFrame:
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"{group} {kind}, {names}")


def stratified_group_folds(df: DataFrame, group: str, target: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, fold): groups go, most unbalanced first, to the fold that keeps class shares most even."""
    if df.filter(F.col(target).isNull()).limit(1).count():
        raise ValueError("null targets")
    counts = _few(df.groupBy(group).agg(F.count_if(F.col(target) == 0).alias("n0"), F.count_if(F.col(target) == 1).alias("n1")).orderBy(group))
    if len(counts) < folds:
        raise ValueError(f"{len(counts)} groups for {folds} folds")
    sizes = np.array([[r["n0"], r["n1"]] for r in counts], dtype=float)
    order = np.random.RandomState(seed).permutation(len(sizes))
    order = order[np.argsort(-sizes[order].std(axis=1), kind="stable")]
    total, held = np.maximum(sizes.sum(axis=0), 1), np.zeros((folds, 2))
    chosen = {}
    for i in order.tolist():
        spread = []
        for f in range(folds):
            held[f] += sizes[i]
            spread.append(((held / total).std(axis=0).mean(), held[f].sum()))
            held[f] -= sizes[i]
        best = min(range(folds), key=lambda f: spread[f])
        held[best] += sizes[i]
        chosen[i] = best
    return _table(df, group, [(counts[i][0], f) for i, f in chosen.items()], "fold int")


def packed_group_folds(df: DataFrame, group: str, folds: int = 5, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(group, repeat, fold): in each repeat groups are shuffled and each goes to the fold with fewest rows, the lowest on ties."""
    counts = _few(df.groupBy(group).agg(F.count("*").alias("n")).orderBy(group))
    state, rows = np.random.RandomState(seed), []
    for repeat in range(repeats):
        order = np.arange(len(counts))
        state.shuffle(order)
        held = np.zeros(folds, dtype=np.int64)
        for i in order.tolist():
            fold = int(held.argmin())
            held[fold] += counts[i]["n"]
            rows.append((counts[i][0], repeat, fold))
    return _table(df, group, rows, "repeat int, fold int")


def open_folds(folds: DataFrame) -> DataFrame:
    """Without the fold that is kept locked."""
    return folds.filter(~((F.col("repeat") == 0) & (F.col("fold") == 0)))


@dataclass(frozen=True)
class Holdout:
    """Places held out, and how near the draw came to its aims."""

    places: list
    share: float
    zone_share: float
    distance: float


def matched_holdout(df: DataFrame, place: str, zone: str, aim_share: float = 0.25, aim_zone: str = "Rural", aim_zone_share: float = 0.7621, draws: int = 3000, seed: int = 42) -> Holdout:
    """Of random orders of places, taken until a share of the rows is held, the first that comes nearest to both aims."""
    counts = _few(df.groupBy(place).agg(F.count_distinct(zone).alias("z"), F.min(zone).alias("zone"), F.count("*").alias("n")).orderBy(place))
    if bad := [r[0] for r in counts if r["z"] > 1]:
        raise ValueError(f"{zone} is not constant in {bad[:5]}")
    n = np.array([r["n"] for r in counts])
    there = np.array([r["zone"] == aim_zone for r in counts])
    state, best = np.random.RandomState(seed), None
    for _ in range(draws):
        order = state.permutation(len(n))
        taken = order[: int(np.searchsorted(np.cumsum(n[order]), aim_share * n.sum())) + 1]
        share, zone_share = n[taken].sum() / n.sum(), n[taken][there[taken]].sum() / n[taken].sum()
        distance = abs(share - aim_share) + abs(zone_share - aim_zone_share)
        if best is None or distance < best[0]:
            best = (distance, taken, share, zone_share)
    return Holdout([counts[i][0] for i in best[1].tolist()], float(best[2]), float(best[3]), float(best[0]))


def holdout_split(df: DataFrame, held: Holdout, place: str) -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out rows)."""
    inside = F.col(place).isin(held.places)
    return df.filter(~inside), df.filter(inside)


def shared_partition(df: DataFrame, group: str, folds: int = 5, seed: int = 99) -> DataFrame:
    """(group, fold) of the one partition that all models' out-of-fold predictions use."""
    return packed_group_folds(df, group, folds, 1, seed).drop("repeat")


def fold_sizes(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """(repeat, fold, n_rows, n_groups)."""
    joined = df.groupBy(group).agg(F.count("*").alias("n")).join(folds, group)
    by = [c for c in ("repeat", "fold") if c in folds.columns]
    return joined.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"))
