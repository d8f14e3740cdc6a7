"""Sinks: output files, run and trial tables, out-of-fold predictions."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def commit_tag(folder: str) -> str:
    """Short commit of a checkout, with -dirty if it has changes; "unknown" outside one."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=False).stdout.strip()
    head = git("rev-parse", "--short", "HEAD")
    return (head + ("-dirty" if git("status", "--porcelain") else "")) if head else "unknown"


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header.  ``single`` gives one file and is only for results known to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_submission(df: DataFrame, folder: str, tag: str) -> None:
    """The output twice: archived under its tag, and at a fixed path."""
    write_csv(df, f"{folder}/archive/submission_{tag}", single=True)
    write_csv(df, f"{folder}/submission", single=True)


def append_run(spark: SparkSession, path: str, model: str, params: dict, metrics: dict[str, float], started: str) -> None:
    """One run to an append-only table."""
    row = [(model, json.dumps(params, sort_keys=True), {k: float(v) for k, v in metrics.items()}, started)]
    df = spark.createDataFrame(row, "model string, params string, metrics map<string,double>, started string")
    df.withColumn("started", F.to_timestamp("started")).write.mode("append").parquet(path)


def latest_runs(runs: DataFrame, key: str = "model", started: str = "started", tie: str | None = None) -> DataFrame:
    """The newest run of each model."""
    newest = F.struct(*([started] + ([tie] if tie else [])))
    last = runs.groupBy(key).agg(F.max_by(F.struct(*runs.columns), newest).alias("last"))  # combined before the shuffle
    return last.select("last.*")


def run_report(runs: DataFrame, metric: str) -> DataFrame:
    """Newest run of each model, best metric first."""
    return latest_runs(runs).withColumn(metric, F.col("metrics")[metric]).orderBy(F.col(metric).desc_nulls_last(), "model")


def append_trials(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def next_trial(spark: SparkSession, path: str) -> int:
    """Where a search goes on: one past the largest trial number."""
    try:
        last = spark.read.parquet(path).agg(F.max("trial")).first()[0]
        return 0 if last is None else last + 1
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return 0
        raise


def write_oof(df: DataFrame, path: str) -> None:
    """Out-of-fold predictions: id, fold_id, y_true and one column for each model."""
    df.write.mode("overwrite").parquet(path)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def markdown_table(rows: list[dict]) -> str:
    """A table of a fixed, small registry."""
    if not rows:
        return ""
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows]) + "\n"
