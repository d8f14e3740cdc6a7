"""The feature plan: learn state once on training records, apply it verbatim to any others.

``fit`` runs the few small jobs that learn state and writes each learned table once;
``apply`` is a projection with lookups after one check for nulls.  The two share every
stateless step.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.operators import clustering, encoding, features
from sparkcohort.sources.contracts import drop_dead_columns, require_no_nulls

# Columns of the plan.
DEAD, CATEGORIES = ("hot_days_30d",), ("zone", "gender", "age_band")
ANOMALIES, ENCODED, ONE_HOT = ("tavg_30d", "rain_sum_90d"), ("spatial_cluster", "zone"), ("gender", "age_band")
PROFILE = ("tavg_90d", "rain_sum_90d", "elevation", "slope")
EXTRAS = {
    "ndvi_trend": features.add_ndvi_trend,
    "age_climate": features.add_age_climate,
    "cluster_zone": features.add_cluster_zone,
    "anomaly_age": features.add_anomaly_age,
    "elevation_zone": features.add_elevation_zone,
}
#: Needs learned state, so it is not a plain function.
FITTED_EXTRAS = ("ndvi_smooth",)


@dataclass(frozen=True)
class FitState:
    """All that is learned on training records.  DataFrames and tuples: nothing in it changes."""

    target: str
    k: int
    extras: tuple[str, ...]
    reference_year: int
    clusters: clustering.ClusterModel
    heat_threshold: float
    baselines: tuple[encoding.Baseline, ...]
    encodings: tuple[encoding.ShrunkMeans, ...]
    categories: MappingProxyType = field(default_factory=lambda: MappingProxyType({}))
    ndvi: encoding.ShrunkMeans | None = None


def _head(df: DataFrame, year: int, clusters: clustering.ClusterModel, frozen: bool) -> DataFrame:
    df = drop_dead_columns(df, [c for c in DEAD if c in df.columns])
    df = features.add_year_trend(features.add_date_parts(df), year)
    df = features.add_age_transforms(features.add_age_bands(df))
    return features.add_coordinate_polynomials(clustering.assign_clusters(df, clusters, frozen=frozen))


def _check_extras(extras) -> tuple[str, ...]:
    if unknown := sorted(set(extras) - set(EXTRAS) - set(FITTED_EXTRAS)):
        raise ValueError(f"unknown extras: {', '.join(unknown)}")
    return tuple(sorted(set(extras)))


def fit(df: DataFrame, target: str, k: int, extras: tuple[str, ...] = (), oof_fold: str | None = None) -> tuple[DataFrame, FitState]:
    """Features of the training records, and the state learned from them.

    Anomalies (and smoothed NDVI) of these rows leave each row out.  Target
    encodings are in-sample, or out of fold where ``oof_fold`` names a fold column.
    """
    extras = _check_extras(extras)
    require_no_nulls(df, df.columns)
    year = features.reference_year(df)
    clusters = clustering.fit_clusters(df, ["latitude", "longitude"], [c for c in PROFILE if c in df.columns], k)
    out = _head(df, year, clusters, False)
    ndvi = None
    if "ndvi_smooth" in extras:
        ndvi = encoding.fit_shrunk(out, "ndvi_30d", ["spatial_cluster"], 5.0)
        out = encoding.fit_rows_shrunk(out, ndvi, "ndvi_smooth")
    out = features.add_rainfall_rates(out)
    heat = features.heat_threshold(out)
    out = features.add_heat_exceedance(out, heat)
    baselines = []
    for value in ANOMALIES:
        state = encoding.fit_baseline(out, value, ["spatial_cluster"], "deathdate")
        out = encoding.fit_rows_anomaly(out, state)
        baselines.append(state)
    for name in extras:
        if name in EXTRAS:
            out = EXTRAS[name](out)
    codes = []
    for c in ENCODED:
        state = encoding.fit_target_encoding(out, c, target)
        out = encoding.out_of_fold_encoding(out, c, target, oof_fold) if oof_fold else encoding.apply_target_encoding(out, state)
        codes.append(state)
    categories = MappingProxyType(encoding.freeze_categories(out, list(ONE_HOT)))
    return out, FitState(target, k, extras, year, clusters, heat, tuple(baselines), tuple(codes), categories, ndvi)


def apply(df: DataFrame, state: FitState, frozen_places: bool = False) -> DataFrame:
    """The same columns for other records, with nothing learned from them."""
    require_no_nulls(df, [c for c in df.columns if c != state.target])
    out = _head(df, state.reference_year, state.clusters, frozen_places)
    if state.ndvi is not None:
        out = encoding.apply_shrunk(out, state.ndvi, "ndvi_smooth")
    out = features.add_heat_exceedance(features.add_rainfall_rates(out), state.heat_threshold)
    for baseline in state.baselines:
        out = encoding.apply_anomaly(out, baseline)
    for name in state.extras:
        if name in EXTRAS:
            out = EXTRAS[name](out)
    for code in state.encodings:
        out = encoding.apply_target_encoding(out, code)
    return out


def native_branch(df: DataFrame, target: str, key: str = "ID", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Numbers (without target and encodings) and raw categories, for learners that split categories."""
    numbers = [c for c in features.numeric_columns(df, (target, *categories)) if not c.endswith("_te")]
    return df.select(key, *([target] if target in df.columns else []), *numbers, *(F.col(c).cast("string").alias(c) for c in categories))


def category_positions(names: list[str], categories: tuple[str, ...] = CATEGORIES) -> list[int]:
    return [i for i, c in enumerate(names) if c in categories]


def encoded_branch(df: DataFrame, state: FitState, key: str = "ID") -> DataFrame:
    """Numbers (without target and cluster label) and 0/1 columns over the frozen categories; warns of new ones."""
    fresh = encoding.freeze_categories(df, list(state.categories))
    for c, known in state.categories.items():
        if new := sorted(set(fresh[c]) - set(known)):
            warnings.warn(f"{c} has categories not seen in training: {new}", stacklevel=2)
    numbers = features.numeric_columns(df, (state.target, "spatial_cluster"))
    hot = encoding.one_hot(df, dict(state.categories))
    target = [state.target] if state.target in df.columns else []
    return hot.select(key, *target, *numbers, *(f"{c}_{v}" for c, vs in state.categories.items() for v in vs))
