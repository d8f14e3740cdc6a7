"""The feature plan and the files, end to end, on a made-up cohort."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcohort.operators import clustering, models
from sparkcohort.plans import pipeline, scoring
from sparkcohort.sources import readers, writers


def cohort(n, seed):
    s = np.random.RandomState(seed)
    rows, climate = [], []
    places = [(round(0.1 * i, 2), 30 + round(0.3 * i, 2), f"village {i}, parish {i % 4}, district") for i in range(12)]
    for i in range(n):
        lat, lon, name = places[s.randint(12)]
        t = float(20 + s.rand() * 5)
        d = datetime.date(2018 + int(s.randint(4)), int(s.randint(1, 13)), int(s.randint(1, 28)))
        age = float(s.randint(0, 90))
        key = f"ID_{seed * 100000 + i:08X}"
        r7 = float(s.rand() * 30)
        rows.append((key, "Rural" if lat < 0.7 else "Peri_urban", "Male" if s.rand() < 0.5 else "Female", d, age, t, t + 3, t - 3, r7, lat, lon, name, int(s.rand() < (0.8 if age < 5 else 0.3))))
        climate.append((key, d, r7, r7 * 3, r7 * 7, int(s.randint(30)), r7 / 2, t, t, t, t + 5, t - 5, 0, 8.0, 0.4, 0.5, 1000.0 + lat * 100, 5.0))
    return rows, climate


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw"))
    train, a = cohort(300, 1)
    test, b = cohort(60, 2)
    types = readers.RECORD_TYPES.replace(" not null", "")
    write = lambda rows, ddl, name: spark.createDataFrame(rows, ddl).coalesce(1).write.csv(f"{path}/{name}", header=True)
    write(train, types + f", {readers.TARGET} int", "Train.csv")
    write([r[:-1] for r in test], types, "Test.csv")
    write(a + b, readers.CLIMATE_TYPES.replace(" not null", ""), "climate_features.csv")
    write([(r[0], 0, 0.5) for r in test], "ID string, TargetF1 int, TargetRAUC double", "SampleSubmission.csv")
    return path


def test_contract_gate(spark, folder, tmp_path):
    assert set(readers.validate_folder(spark, folder).values()) == {"PASS"}
    assert set(readers.validate_folder(spark, str(tmp_path)).values()) == {"MISSING"}


def test_leaked_target_is_an_error(spark, folder):
    with pytest.raises(readers.ContractError):
        readers.read_csv(spark, f"{folder}/Train.csv", readers.record_contract(False))


def test_batch_scoring_end_to_end(spark, folder):
    train, test = readers.load_full(spark, folder).cache(), readers.load_full(spark, folder, "Test.csv").cache()
    champion = scoring.train_champion(train, readers.TARGET, 3, lambda names: models.logistic([c for c in names], n=300))
    out = scoring.make_submission(test, champion, readers.read_csv(spark, f"{folder}/SampleSubmission.csv", readers.submission_contract()))
    assert out.count() == 60
    matrix, state = pipeline.fit(train, readers.TARGET, 3, ("age_climate", "ndvi_smooth"))
    applied = pipeline.apply(test, state)
    assert set(matrix.columns) - set(applied.columns) == {readers.TARGET}
    with pytest.warns(UserWarning, match="gender"):
        pipeline.encoded_branch(applied.withColumn("gender", F.lit("Other")), state)
    with pytest.raises(ValueError, match="unknown extras"):
        pipeline.fit(train, readers.TARGET, 3, ("nonsense",))
    assert pipeline.category_positions(["a", "zone"]) == [1]
    assert "zone" in pipeline.native_branch(matrix, readers.TARGET).columns


def test_clusters_recover_blobs(spark):
    s = np.random.RandomState(0)
    rows = [(float(a + s.randn() * 0.1), float(b + s.randn() * 0.1), 1.0, k) for k, (a, b) in enumerate(((0, 30), (5, 40))) for _ in range(30)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, v double, k int")
    model = clustering.fit_clusters(df, ["latitude", "longitude"], ["v"], 2)
    got = clustering.assign_clusters(df, model).groupBy("k").agg(F.count_distinct("spatial_cluster").alias("n"), F.min("spatial_cluster").alias("c")).collect()
    assert [r.n for r in got] == [1, 1] and len({r.c for r in got}) == 2
    found = clustering.select_k(df, ["latitude", "longitude"], ["v"], range(2, 4)).collect()
    assert [r.k for r in found if r.best] == [2] and max(r.silhouette for r in found) > 0.9
    with pytest.raises(ValueError, match="smaller than"):
        clustering.select_k(df, ["latitude", "longitude"], ["v"], range(2, 100))


def test_calibration_never_sees_its_own_fold(spark):
    rows = [(i, float((i * 37 % 100) / 100), int(i * 7 % 3 == 0), i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, p double, y int, fold int").cache()
    flipped = df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    pick = lambda d: {r.id: r.calibrated for r in models.cross_calibrate(d, models.fit_platt, "p").filter("fold = 0").collect()}
    assert pick(df) == pytest.approx(pick(flipped))


def test_run_tables(spark, tmp_path):
    path = str(tmp_path / "runs")
    for started, v in (("2024-01-01 00:00:00", 0.5), ("2024-01-02 00:00:00", 0.7)):
        writers.append_run(spark, path, "a", {"k": 1}, {"score": v}, started)
    writers.append_run(spark, path, "b", {}, {"score": 0.6}, "2024-01-01 00:00:00")
    got = writers.run_report(spark.read.parquet(path), "score").collect()
    assert [(r.model, r.score) for r in got] == [("a", 0.7), ("b", 0.6)]
    assert writers.next_trial(spark, str(tmp_path / "none")) == 0


def test_request_round_trip(spark):
    row = dict(zip([f.name for f in readers.record_contract(False).schema], cohort(1, 3)[0][0][:-1], strict=True))
    payload = row | {"deathdate": row["deathdate"].isoformat()}
    df = readers.row_from_request(spark, payload, readers.record_contract(False))
    assert df.count() == 1 and '"zone"' in readers.row_to_payload(df).first().payload
    with pytest.raises(readers.ContractError):
        readers.row_from_request(spark, payload | {"age": 500}, readers.record_contract(False))
    with pytest.raises(readers.ContractError, match="lacks"):
        readers.row_from_request(spark, {"ID": "ID_00000001"}, readers.record_contract(False))


def test_stream_windows(spark, tmp_path):
    from sparkcohort.streaming.scoring import stream_lookup, windowed_rates

    src = str(tmp_path / "events")
    base = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(base + datetime.timedelta(minutes=10 * i), "ab"[i % 2], float(i)) for i in range(12)], "ts timestamp, k string, v double").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(src)
    state = spark.createDataFrame([("a", 10.0)], "k string, code double")
    joined = stream_lookup(stream, state, ["k"], F.lit(0.0), "code")
    q = windowed_rates(joined, "ts", "k", "code").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT k, sum(n) AS n, max(mean) AS m FROM rates GROUP BY k ORDER BY k").collect()
    assert [(r.k, r.n, r.m) for r in got] == [("a", 6, 10.0), ("b", 6, 0.0)]
