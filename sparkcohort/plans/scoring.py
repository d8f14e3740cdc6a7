"""Batch scoring: fitted state, model and calibrator applied to records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sparkcohort.operators.metrics import submission, submission_faults
from sparkcohort.operators.models import Model, fit_platt
from sparkcohort.plans import pipeline


@dataclass(frozen=True)
class Champion:
    """A model on all training rows, the columns it wants, and a calibrator on out-of-fold predictions."""

    state: pipeline.FitState
    columns: tuple[str, ...]
    predict: Callable[[DataFrame], DataFrame]
    calibrate: Callable[[DataFrame], DataFrame]


def train_champion(df: DataFrame, target: str, k: int, make: Callable[[list[str]], Model], oof: DataFrame | None = None) -> Champion:
    """``make`` builds a model from feature names; ``oof`` has y and p."""
    matrix, state = pipeline.fit(df, target, k)
    branch = pipeline.encoded_branch(matrix, state).withColumnRenamed(target, "y")
    columns = tuple(c for c in branch.columns if c not in ("ID", "y"))
    predict = make(list(columns)).fit(branch)
    calibrate = fit_platt(oof, "p") if oof is not None else (lambda d: d.withColumnRenamed("p", "calibrated"))
    return Champion(state, columns, predict, calibrate)


def score_records(df: DataFrame, champion: Champion, frozen_places: bool = False) -> DataFrame:
    """(ID, calibrated).  Columns that are not as in training are an error."""
    branch = pipeline.encoded_branch(pipeline.apply(df, champion.state, frozen_places), champion.state)
    names = tuple(c for c in branch.columns if c not in ("ID", champion.state.target))
    if names != champion.columns:
        raise ValueError(f"columns differ from training: {sorted(set(names) ^ set(champion.columns))}")
    return champion.calibrate(champion.predict(branch)).select("ID", "calibrated")


def make_submission(df: DataFrame, champion: Champion, sample: DataFrame) -> DataFrame:
    """The output frame, checked against the sample."""
    out = submission(score_records(df, champion), "ID", "calibrated")
    if bad := [r.asDict() for r in submission_faults(out, sample).filter("n_bad > 0").collect()]:
        raise ValueError(f"output breaks its contract: {bad}")
    return out
