"""Typed readers with contracts, and the record and climate contracts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcohort.operators.joins import validated_left_join
from sparkcohort.sources.contracts import Contract, ContractError

# The columns of the input files and the ranges their contracts allow.
RECORD_TYPES = "ID string not null, zone string not null, gender string not null, deathdate date not null, age double not null, avg_temperature double not null, max_temperature double not null, min_temperature double not null, precipitation double not null, latitude double not null, longitude double not null, location string not null"
CLIMATE_TYPES = "ID string not null, deathdate date not null, rain_sum_7d double not null, rain_sum_30d double not null, rain_sum_90d double not null, rain_days_30d int not null, max_daily_rain_30d double not null, tavg_7d double not null, tavg_30d double not null, tavg_90d double not null, tmax_30d double not null, tmin_30d double not null, hot_days_30d int not null, temp_range_mean_30d double not null, ndvi_30d double not null, ndvi_90d double not null, elevation double not null, slope double not null"
TARGET = "is_climate_sensitive"
ZONES, GENDERS = ("Rural", "Peri_urban"), ("Male", "Female")
RECORD_RANGES = {"age": (0, 120), "avg_temperature": (-10, 50), "max_temperature": (-10, 55), "min_temperature": (-10, 45), "precipitation": (0, None), "latitude": (-2, 5), "longitude": (29, 36)}
CLIMATE_RANGES = {"rain_sum_7d": (0, None), "rain_sum_30d": (0, None), "rain_sum_90d": (0, None), "rain_days_30d": (0, 30), "max_daily_rain_30d": (0, None), "tavg_7d": (-10, 45), "tavg_30d": (-10, 45), "tavg_90d": (-10, 45), "tmax_30d": (-10, 55), "tmin_30d": (-10, 45), "hot_days_30d": (0, 30), "temp_range_mean_30d": (0, None), "ndvi_30d": (-1, 1), "ndvi_90d": (-1, 1), "elevation": (0, 5200), "slope": (0, 90)}
ID_PATTERN = "^ID_[0-9A-F]{8}$"


def _schema(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(x.split()[0], T._parse_datatype_string(x.split()[1]), "not null" not in x) for x in ddl.split(", ")])


def _ranges(ranges: dict) -> dict:
    out = {}
    for c, (low, high) in ranges.items():
        rule = F.col(c) >= low
        out[f"{c} in range"] = rule if high is None else rule & (F.col(c) <= high)
    return out


def record_contract(target: bool) -> Contract:
    rules = {
        "ID pattern": F.col("ID").rlike(ID_PATTERN),
        "zone known": F.col("zone").isin(*ZONES),
        "gender known": F.col("gender").isin(*GENDERS),
        "date in range": F.col("deathdate").between(F.lit("2000-01-01").cast("date"), F.lit("2026-12-31").cast("date")),
        "temperatures in order": (F.col("max_temperature") >= F.col("avg_temperature")) & (F.col("avg_temperature") >= F.col("min_temperature")),
    } | _ranges(RECORD_RANGES)
    types = RECORD_TYPES
    if target:
        types += f", {TARGET} int not null"
        rules[f"{TARGET} is 0 or 1"] = F.col(TARGET).isin(0, 1)
    return Contract("train" if target else "test", _schema(types), rules, ("ID",))


def climate_contract() -> Contract:
    rain = (F.col("rain_sum_90d") >= F.col("rain_sum_30d")) & (F.col("rain_sum_30d") >= F.col("rain_sum_7d"))
    return Contract("climate", _schema(CLIMATE_TYPES), {"ID pattern": F.col("ID").rlike(ID_PATTERN), "rain in order": rain} | _ranges(CLIMATE_RANGES), ("ID",))


def submission_contract() -> Contract:
    rules = {"TargetF1 is 0 or 1": F.col("TargetF1").isin(0, 1), "TargetRAUC in range": F.col("TargetRAUC").between(0, 1)}
    return Contract("submission", _schema("ID string not null, TargetF1 int not null, TargetRAUC double not null"), rules, ("ID",))


CONTRACTS: dict[str, Callable[[], Contract]] = {
    "Train.csv": lambda: record_contract(True),
    "Test.csv": lambda: record_contract(False),
    "climate_features.csv": climate_contract,
    "SampleSubmission.csv": submission_contract,
}


def read_csv(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """A typed CSV that keeps its contract.  Malformed values, broken rules, and extra or missing columns are errors."""
    head = spark.read.option("header", True).csv(path)  # names only; no data is read
    want = [f.name for f in contract.schema]
    if sorted(head.columns) != sorted(want):
        raise ContractError(f"{contract.name}: columns {sorted(set(head.columns) ^ set(want))} are missing or extra")
    types = {f.name: f for f in contract.schema}
    schema = T.StructType([types[c] for c in head.columns])
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return contract.check(df.select(*want))


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with inferred types and no contract."""
    return spark.read.csv(path, header=True, inferSchema=True)


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_csv(spark, f"{folder}/{name}", make()) for name, make in CONTRACTS.items()}


def load_full(spark: SparkSession, folder: str, name: str = "Train.csv") -> DataFrame:
    """Records joined one to one with their climate; the date the tables share must agree."""
    core = read_csv(spark, f"{folder}/{name}", CONTRACTS[name]())
    climate = read_csv(spark, f"{folder}/climate_features.csv", climate_contract())
    return validated_left_join(core, climate, "ID", agree=["deathdate"])


def validate_folder(spark: SparkSession, folder: str) -> dict[str, str]:
    """PASS, MISSING or FAIL with the reason, for each known file."""
    out = {}
    for name, make in CONTRACTS.items():
        try:
            read_csv(spark, f"{folder}/{name}", make())
            out[name] = "PASS"
        except Exception as e:
            out[name] = "MISSING" if "PATH_NOT_FOUND" in str(e) else f"FAIL: {str(e)[:500]}"
    return out


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON configuration, by Spark's readers."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def row_from_request(spark: SparkSession, payload: dict, contract: Contract) -> DataFrame:
    """A one-row frame of a request, checked."""
    import datetime

    values = dict(payload)
    for f in contract.schema:
        if f.dataType == T.DateType() and isinstance(values.get(f.name), str):
            values[f.name] = datetime.date.fromisoformat(values[f.name])
        if f.dataType == T.DoubleType() and isinstance(values.get(f.name), int):
            values[f.name] = float(values[f.name])
    if missing := [f.name for f in contract.schema if f.name not in values]:
        raise ContractError(f"request lacks {missing}")
    row = [tuple(values[f.name] for f in contract.schema)]
    return contract.check(spark.createDataFrame(row, contract.schema))


def row_to_payload(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*")).alias("payload"))


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup."""
    return df.filter(F.col(key) == value)
