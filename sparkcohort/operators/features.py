"""Stateless feature operators.  Each adds columns in one projection and refuses to overwrite any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcohort.functions.scalars import days_in_year, flag, from_end, phase, safe_ratio
from sparkcohort.functions.stats import chi_square, chi_square_p, two_by_two
from sparkcohort.sources.contracts import require_columns, require_no_collision

# Candidate rainy seasons by month, and age bands with their highest age.
RAINY_SEASONS = {"long_rains": (3, 4, 5), "short_rains": (9, 10, 11), "both_rains": (3, 4, 5, 9, 10, 11)}
AGE_BANDS = (("0-4", 4), ("5-17", 17), ("18-59", 59), ("60+", None))


def _add(df: DataFrame, needs: list[str], columns: dict[str, Column]) -> DataFrame:
    require_columns(df, needs)
    require_no_collision(df, list(columns))
    return df.withColumns(columns)


def add_date_parts(df: DataFrame, date: str = "deathdate") -> DataFrame:
    """Month, day of month, year, and the phases of month (of 12) and day of year (of that year's days)."""
    require_columns(df, [date])
    if not isinstance(df.schema[date].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{date} is not a date")
    d = F.col(date).cast("date")
    month_sin, month_cos = phase(F.month(d), 12)
    day_sin, day_cos = phase(F.dayofyear(d), days_in_year(d))
    columns = {"month": F.month(d), "day_of_month": F.dayofmonth(d), "year": F.year(d), "month_sin": month_sin, "month_cos": month_cos, "day_of_year_sin": day_sin, "day_of_year_cos": day_cos}
    return _add(df, [date], columns)


def reference_year(df: DataFrame, date: str = "deathdate") -> int:
    """The earliest year, learned on training rows only."""
    return df.agg(F.min(F.year(date))).first()[0]


def add_year_trend(df: DataFrame, reference: int, year: str = "year") -> DataFrame:
    return _add(df, [year], {"year_trend": F.col(year) - F.lit(reference)})


def add_season_flag(df: DataFrame, months: tuple[int, ...], date: str = "deathdate", out: str = "is_rainy_season") -> DataFrame:
    if not months or any(m not in range(1, 13) for m in months):
        raise ValueError("months must be some of 1 to 12")
    return _add(df, [date], {out: flag(F.month(date).isin(*months))})


def season_test(df: DataFrame, months: tuple[int, ...], target: str, date: str = "deathdate", alpha: float = 0.05) -> dict:
    """Chi-square of in-season against target, continuity-corrected; an empty margin is an error."""
    counts = two_by_two(df, F.month(date).isin(*months), F.col(target) == 1)
    row = chi_square(counts).first()
    if row["chi2"] is None:
        raise ValueError("the table of season and target is not 2x2")
    inside, outside = row["n11"] + row["n10"], row["n01"] + row["n00"]
    p = chi_square_p(row["chi2"])
    return {"n_in": inside, "n_out": outside, "rate_in": row["n11"] / inside, "rate_out": row["n01"] / outside, "chi2": row["chi2"], "p": p, "alpha": alpha, "significant": p < alpha}


def age_band(age: Column) -> Column:
    out = None
    for name, top in AGE_BANDS[:-1]:
        out = F.when(age <= top, name) if out is None else out.when(age <= top, name)
    return F.when(age.isNotNull(), out.otherwise(AGE_BANDS[-1][0]))


def add_age_bands(df: DataFrame, age: str = "age") -> DataFrame:
    a = F.col(age)
    return _add(df, [age], {"age_band": age_band(a), "is_under5": flag(a <= AGE_BANDS[0][1])})


def add_age_transforms(df: DataFrame, age: str = "age") -> DataFrame:
    return _add(df, [age], {"age_log1p": F.log1p(age), "age_sqrt": F.sqrt(age)})


def add_coordinate_polynomials(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Squares and product; here columns of these names are replaced."""
    require_columns(df, [lat, lon])
    a, b = F.col(lat), F.col(lon)
    return df.withColumns({"lat_sq": a * a, "lon_sq": b * b, "lat_lon": a * b})


def add_location_tokens(df: DataFrame, location: str = "location", max_tokens: int = 3, separator: str = ",") -> DataFrame:
    """The last tokens of a place name, from the end; null where there are fewer."""
    names = {f"location_token_{i}": from_end(F.col(location), i, separator) for i in range(1, max_tokens + 1)}
    return _add(df, [location], names)


def add_rainfall_rates(df: DataFrame, r7="rain_sum_7d", r30="rain_sum_30d", r90="rain_sum_90d", days="rain_days_30d", most="max_daily_rain_30d") -> DataFrame:
    """Daily rates, ratios of windows (null over zero), and the share of rainy days."""
    columns = {
        "rain_rate_7d": F.col(r7) / 7, "rain_rate_30d": F.col(r30) / 30, "rain_rate_90d": F.col(r90) / 90,
        "rain_ratio_7d_30d": safe_ratio(r7, r30), "rain_ratio_30d_90d": safe_ratio(r30, r90),
        "rain_concentration_30d": safe_ratio(most, r30), "rain_day_share_30d": F.col(days) / 30,
    }
    return _add(df, [r7, r30, r90, days, most], columns)


def heat_threshold(df: DataFrame, value: str = "tmax_30d", q: float = 0.9) -> float:
    """Exact quantile with linear interpolation, learned on training rows only."""
    if not 0 < q < 1:
        raise ValueError("q must lie between 0 and 1")
    return df.agg(F.percentile(value, q)).first()[0]


def add_heat_exceedance(df: DataFrame, threshold: float, value: str = "tmax_30d") -> DataFrame:
    """Flag (strictly above) and margin."""
    if threshold is None or threshold != threshold or abs(threshold) == float("inf"):
        raise ValueError("the threshold must be finite")
    columns = {f"{value}_exceeds_flag": flag(F.col(value) > threshold), f"{value}_exceedance": F.col(value) - F.lit(threshold)}
    return _add(df, [value], columns)


def add_ndvi_trend(df: DataFrame, near: str = "ndvi_30d", far: str = "ndvi_90d") -> DataFrame:
    return _add(df, [near, far], {"ndvi_trend": F.col(near) - F.col(far)})


def add_age_climate(df: DataFrame, age: str = "age", climate: str = "tavg_30d") -> DataFrame:
    return _add(df, [age, climate], {f"age_x_{climate}": F.col(age) * F.col(climate)})


def add_cluster_zone(df: DataFrame, cluster: str = "spatial_cluster", zone: str = "zone") -> DataFrame:
    return _add(df, [cluster, zone], {f"{cluster}_x_{zone}": F.concat_ws("_", F.col(cluster).cast("string"), zone)})


def add_anomaly_age(df: DataFrame, anomaly: str = "tavg_30d_anomaly", band: str = "age_band") -> DataFrame:
    """The anomaly of the youngest and of the oldest, zero for others; unknown bands are an error."""
    require_columns(df, [anomaly, band])
    known = [b for b, _ in AGE_BANDS]
    if df.filter(~F.col(band).isin(known)).limit(1).count():
        raise ValueError(f"{band} has unknown bands")
    first, last = known[0], known[-1]
    columns = {f"{anomaly}_x_under5": F.col(anomaly) * flag(F.col(band) == first), f"{anomaly}_x_elderly": F.col(anomaly) * flag(F.col(band) == last)}
    return _add(df, [anomaly, band], columns)


def add_elevation_zone(df: DataFrame, elevation: str = "elevation", zone: str = "zone", where: str = "Peri_urban") -> DataFrame:
    return _add(df, [elevation, zone], {f"{elevation}_x_{where.lower()}": F.col(elevation) * flag(F.col(zone) == where)})


def add_starter_features(df: DataFrame, high="max_temperature", low="min_temperature", rain="precipitation") -> DataFrame:
    columns = {"temperature_range": F.col(high) - F.col(low), "is_rainy_day_current": flag(F.col(rain) > 0)}
    return _add(df, [high, low, rain], columns)


def perturb(df: DataFrame, changes: dict) -> DataFrame:
    """What-if: columns set to literals."""
    require_columns(df, list(changes))
    return df.withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in changes.items()})


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


# What each feature is made of, its reference period, and whether it is known when scoring.
PROVENANCE = [
    ("month, day_of_month, year", "none", "record date"), ("month_sin, month_cos", "none", "record date"),
    ("day_of_year_sin, day_of_year_cos", "none", "record date"), ("year_trend", "earliest training year", "record date, state"),
    ("is_rainy_season", "fixed months", "record date"), ("age_band, is_under5", "fixed bands", "record"),
    ("age_log1p, age_sqrt", "none", "record"), ("spatial_cluster", "training locations", "coordinates, state"),
    ("lat_sq, lon_sq, lat_lon", "none", "coordinates"), ("location_token_*", "none", "place name"),
    ("rain_rate_*", "trailing 7, 30, 90 days", "climate"), ("rain_ratio_*", "trailing 7, 30, 90 days", "climate"),
    ("rain_concentration_30d, rain_day_share_30d", "trailing 30 days", "climate"), ("tmax_30d_exceeds_flag, tmax_30d_exceedance", "training quantile", "climate, state"),
    ("*_anomaly, *_baseline_level", "training group and month", "climate, state"), ("ndvi_trend", "trailing 30, 90 days", "climate"),
    ("ndvi_smooth", "training groups", "climate, state"), ("*_te", "training target", "state"),
]


def provenance() -> list[dict]:
    return [dict(zip(("features", "reference", "needs"), row, strict=True)) for row in PROVENANCE]
