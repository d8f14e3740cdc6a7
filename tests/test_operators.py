"""Hand-computed cases, edges and refusals of the feature and validation operators."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcohort.functions import ranks, stats
from sparkcohort.operators import encoding, features, joins, metrics, splits
from sparkcohort.sources import contracts


def day(text):
    return datetime.date.fromisoformat(text)


def test_rain_rates_and_zero_denominators(spark):
    df = spark.createDataFrame([(7.0, 30.0, 90.0, 10, 5.0), (0.0, 0.0, 0.0, 0, 0.0), (14.0, 60.0, 180.0, 20, 10.0)], "r7 double, r30 double, r90 double, days int, maxd double")
    rows = features.add_rainfall_rates(df, "r7", "r30", "r90", "days", "maxd").collect()
    assert [r.rain_rate_7d for r in rows] == [1, 0, 2]
    assert rows[1].rain_ratio_7d_30d is None and rows[1].rain_concentration_30d is None
    assert rows[0].rain_ratio_30d_90d == pytest.approx(1 / 3)


@pytest.mark.parametrize("age,band", [(0, "0-4"), (4, "0-4"), (5, "5-17"), (17, "5-17"), (18, "18-59"), (59, "18-59"), (60, "60+"), (110, "60+")])
def test_age_band_edges(spark, age, band):
    row = features.add_age_bands(spark.createDataFrame([(float(age),)], "age double")).first()
    assert (row.age_band, row.is_under5) == (band, int(age <= 4))


def test_leap_years_share_the_last_phase(spark):
    df = spark.createDataFrame([(day("2020-12-31"),), (day("2021-12-31"),), (day("2020-02-29"),)], "deathdate date")
    rows = features.add_date_parts(df).collect()
    assert rows[0].day_of_year_sin == pytest.approx(rows[1].day_of_year_sin, abs=1e-12)
    assert rows[2].day_of_year_cos == pytest.approx(math.cos(2 * math.pi * 60 / 366))


def test_refusals(spark):
    df = spark.createDataFrame([(1.0, "x")], "age double, location string")
    with pytest.raises(KeyError, match="deathdate, zone"):
        contracts.require_columns(df, ["zone", "deathdate", "age"])
    with pytest.raises(TypeError):
        features.add_date_parts(df.withColumnRenamed("location", "deathdate"))
    with pytest.raises(ValueError, match="age_band"):
        features.add_age_bands(df.withColumn("age_band", F.lit(1)))
    with pytest.raises(ValueError):
        features.add_season_flag(df.withColumn("deathdate", F.current_date()), (13,))
    with pytest.raises(ValueError):
        features.add_heat_exceedance(df, float("nan"), "age")
    with pytest.raises(ValueError, match="fractional"):
        contracts.require_whole_ages(spark.createDataFrame([(1.5,)], "age double"), "age")
    with pytest.raises(ValueError, match="nulls in: age"):
        contracts.require_no_nulls(spark.createDataFrame([(None,), (2.0,)], "age double"), ["age"])
    with pytest.raises(ValueError, match="not 2x2"):
        features.season_test(spark.createDataFrame([(day("2020-03-01"), 1), (day("2020-04-01"), 0)], "deathdate date, y int"), (3, 4), "y")


def test_dead_columns(spark):
    df = spark.createDataFrame([(0, 1), (0, None)], "a int, b int")
    assert contracts.drop_dead_columns(df, ["a"]).columns == ["b"]
    with pytest.raises(ValueError, match="vary: b"):
        contracts.drop_dead_columns(df, ["b"])


def test_leave_one_out_by_hand(spark):
    df = spark.createDataFrame([(1, 10.0, 0, day("2020-01-01")), (2, 20.0, 0, day("2020-02-01")), (3, 30.0, 0, day("2020-03-01"))], "id int, v double, g int, d date")
    state = encoding.fit_baseline(df, "v", ["g"], "d")
    got = {r.id: r.v_anomaly for r in encoding.fit_rows_anomaly(df, state).collect()}
    assert got == {1: -15.0, 2: 0.0, 3: 15.0}
    plain = {r.id: r.v_anomaly for r in encoding.apply_anomaly(df, state).collect()}
    assert plain == {1: -10.0, 2: 0.0, 3: 10.0}


def test_tiers_fall_through(spark):
    df = spark.createDataFrame([(1, 10.0, 0, day("2020-01-01")), (2, 20.0, 0, day("2020-01-05")), (3, 99.0, 0, day("2020-02-01"))], "id int, v double, g int, d date")
    rows = {r.id: (r.v_anomaly, r.v_baseline_level) for r in encoding.fit_rows_anomaly(df, encoding.fit_baseline(df, "v", ["g"], "d", 2)).collect()}
    assert rows == {1: (-10.0, "group_month"), 2: (10.0, "group_month"), 3: (84.0, "group")}
    one = df.filter("id = 1")
    assert encoding.fit_rows_anomaly(one, encoding.fit_baseline(one, "v", ["g"], "d")).first().v_anomaly == 0
    state = encoding.fit_baseline(df, "v", ["g"], "d", 2)
    new = spark.createDataFrame([(9, 50.0, 7, day("2020-01-01"))], "id int, v double, g int, d date")
    assert encoding.apply_anomaly(new, state).first().v_baseline_level == "global"


def test_shrinkage(spark):
    df = spark.createDataFrame([(0, 1.0)] * 4 + [(1, 0.0)], "g int, v double")
    state = encoding.fit_shrunk(df, "v", ["g"], 5.0)
    got = {r.g: r.s for r in encoding.apply_shrunk(df, state, "s").distinct().collect()}
    assert got == {0: pytest.approx((4 + 5 * 0.8) / 9), 1: pytest.approx(4 / 6)}
    alone = {r.g: r.s for r in encoding.fit_rows_shrunk(df, state, "s").distinct().collect()}
    assert alone[1] == pytest.approx(0.8)
    with pytest.raises(ValueError):
        encoding.fit_shrunk(df, "v", ["g"], -1)


def test_out_of_fold_encoding_ignores_own_fold(spark):
    rows = [(i, "ab"[i % 2], i % 3, (i * 7) % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, c string, fold int, y int")
    flipped = df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    same = df.agg(F.avg("y")).first()[0] == flipped.agg(F.avg("y")).first()[0]
    a = {r.id: r.c_te for r in encoding.out_of_fold_encoding(df, "c", "y", "fold", 0.0).collect()}
    b = {r.id: r.c_te for r in encoding.out_of_fold_encoding(flipped, "c", "y", "fold", 0.0).collect()}
    assert all(a[i] == b[i] for i in a if i % 3 == 0)
    assert same or any(a[i] != b[i] for i in a if i % 3)
    with pytest.raises(ValueError):
        encoding.check_folds(spark.createDataFrame([(1, 0), (1, 1)], "id int, fold int"), "id")


def test_validated_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, d string")
    b = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, d string, v int")
    assert sorted(joins.validated_left_join(a, b, "id", ["d"]).collect()) == [(1, "x", 5), (2, "y", 6)]
    with pytest.raises(joins.JoinError, match="no match"):
        joins.validated_left_join(a, b.filter("id = 1"), "id")
    with pytest.raises(joins.JoinError, match="repeat"):
        joins.validated_left_join(a, b.union(b), "id")
    with pytest.raises(joins.JoinError, match="disagree"):
        joins.validated_left_join(a, b.withColumn("d", F.lit("z")), "id", ["d"])


def test_running_sums_and_ranks(spark):
    values = np.random.RandomState(3).randint(0, 50, 500).tolist()
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.v: r["rank"] for r in ranks.average_ranks(df, "v").collect()}
    ordered = sorted(values)
    for v in set(values):
        places = [i + 1 for i, x in enumerate(ordered) if x == v]
        assert got[float(v)] == pytest.approx(sum(places) / len(places))


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert metrics.auc(df, "y", "p").first().auc == pytest.approx(0.875)
    assert metrics.auc(df.filter("y = 1"), "y", "p").first().auc is None
    assert metrics.score(df.filter("y = 0 AND p < 0.3"), "y", "p").first().f1 == 0


def test_blend_and_output(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 1.0), (3, 0.5, 0.5)], "id int, a double, b double")
    assert [r.p for r in df.select(metrics.blend({"a": 0.75, "b": 0.25}, ["a", "b"]).alias("p")).collect()] == [0.75, 0.25, 0.5]
    with pytest.raises(ValueError):
        metrics.blend({"a": 1}, ["a", "b"])
    out = metrics.submission(spark.createDataFrame([("x", 0.2), ("y", 0.5), ("z", 0.81)], "k string, p double"), "k", "p")
    assert [r.TargetF1 for r in out.collect()] == [0, 1, 1]
    cubed = df.withColumn("c", F.col("a") * F.col("a") * F.col("a"))
    a = sorted(metrics.rank_average(cubed, "id", ["a"]).collect())
    assert a == sorted(metrics.rank_average(cubed, "id", ["c"]).collect())


def test_twins_compare_values_not_text(spark):
    df = spark.createDataFrame([("A||B", "C"), ("A", "B||C"), ("A", "B||C")], "x string, y string")
    assert splits.twin_groups(df, ["x", "y"]).select("twin_group").distinct().count() == 2
    with pytest.raises(ValueError):
        splits.twin_groups(spark.createDataFrame([("A", None)], "x string, y string"), ["x", "y"])


def test_splitters(spark):
    state = np.random.RandomState(1)
    rows = [(i, int(g), int(state.rand() < 0.4), f"p{int(g)}", "Rural" if g % 3 else "Peri_urban") for i, g in enumerate(state.randint(0, 40, 800))]
    df = spark.createDataFrame(rows, "id int, g int, y int, place string, zone string")
    folds = splits.stratified_group_folds(df, "g", "y")
    assert folds.count() == 40 and folds.select("g").distinct().count() == 40
    packed = splits.packed_group_folds(df, "g")
    assert sorted(packed.collect()) == sorted(splits.packed_group_folds(df, "g").collect())
    sizes = splits.fold_sizes(df, packed, "g").collect()
    assert len(sizes) == 25 and max(r.n_rows for r in sizes) < 1.5 * 800 / 5
    assert splits.open_folds(packed).select("repeat", "fold").distinct().count() == 24
    held = splits.matched_holdout(df, "place", "zone", draws=300)
    train, out = splits.holdout_split(df, held, "place")
    assert train.join(out, "place").count() == 0 and abs(held.share - 0.25) < 0.1
    with pytest.raises(ValueError, match="not constant"):
        splits.matched_holdout(df.withColumn("zone", F.col("id").cast("string")), "place", "zone")


def test_chain_of_constraints_merges(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")], "g int, t string")
    assert {r.g: r.merged_group for r in splits.merged_groups(df, "g", "t").collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_correction_of_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    row = df.agg(stats.corrected_skewness("v").alias("s"), stats.corrected_kurtosis("v").alias("k")).first()
    assert row.s == pytest.approx(1.7636, abs=1e-4) and row.k == pytest.approx(3.228, abs=1e-3)
    assert df.limit(2).agg(stats.corrected_skewness("v")).first()[0] is None


def test_contract_reports_everything_at_once(spark):
    from pyspark.sql import types as T

    contract = contracts.Contract("t", T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("v", T.DoubleType())]), {"v positive": F.col("v") > 0}, ("id",))
    df = spark.createDataFrame([(1, -1.0), (1, 2.0), (None, 3.0)], "id int, v double")
    assert {r.rule: r.n_bad for r in contract.report(df).collect()} == {"id not null": 1, "v positive": 1, "id unique": 2}
    with pytest.raises(contracts.ContractError, match="missing v"):
        contract.check(df.drop("v"))


def test_folds_have_even_class_shares(spark):
    """Like frames can't be told apart by folds that one class prevails in."""
    from sparkcohort.operators import models

    df = spark.createDataFrame([(i, i * 7919 % 1000 / 999, i % 2) for i in range(87)], "id long, p double, y int")
    sizes = [r["count"] for r in models.even_folds(df, "id", 3).groupBy("y", "fold").count().collect()]
    assert sorted(sizes) == [14, 14, 14, 15, 15, 15]
    halves = [df.filter(F.col("y") == k).select("id", "p") for k in (0, 1)]
    assert abs(models.output_shift_auc(*halves, "p", "id") - 0.5) < 0.15
