"""Further registered queries: file sources, guards, sinks, folds and models, with their SQL.

Files are written from the tables into the shared folder and read back by the
engine's own readers.  For learners and random splits, which SQL cannot rebuild,
a query returns the facts that must hold whatever the random choices are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.functions.scalars import hex_id
from sparkcohort.operators import clustering, features, forensics, joins, metrics, models, splits
from sparkcohort.plans.catalogue import _two, big, q, query, r6
from sparkcohort.plans.frames import D, R, lines, predictions, read, records
from sparkcohort.sources import contracts, readers, writers
from sparkcohort.sources.storage import Workspace

# files -----------------------------------------------------------------------------------------------------------

_ID = "'ID_' || lpad(upper(to_hex(id)), 8, '0')"
T = f"""t AS (SELECT id AS num, {_ID} AS "ID", zone, CASE WHEN id % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender, event_date + INTERVAL 4000 DAY AS deathdate,
  CAST(id % 90 AS DOUBLE) AS age, CAST(20 + id % 5 AS DOUBLE) AS avg_temperature, CAST(25 + id % 5 AS DOUBLE) AS max_temperature,
  CAST(15 + id % 5 AS DOUBLE) AS min_temperature, CAST(id % 7 AS DOUBLE) AS precipitation, longitude AS latitude, 30.0 + longitude AS longitude, location,
  y AS is_climate_sensitive, split FROM r)"""


def _train(spark, d, target: bool = True) -> DataFrame:
    i = F.col("id")
    number = lambda c: c.cast("double")
    out = records(spark, d).select(
        hex_id(i).alias("ID"), "zone", F.when(i % 2 == 0, "Male").otherwise("Female").alias("gender"), F.date_add("event_date", 4000).alias("deathdate"),
        number(i % 90).alias("age"), number(20 + i % 5).alias("avg_temperature"), number(25 + i % 5).alias("max_temperature"), number(15 + i % 5).alias("min_temperature"),
        number(i % 7).alias("precipitation"), F.col("longitude").alias("latitude"), (F.col("longitude") + 30).alias("longitude"), "location",
        F.col("y").alias("is_climate_sensitive"), "split",
    )
    return out if target else out.drop("is_climate_sensitive")


def _climate(spark, d) -> DataFrame:
    n = F.conv(F.substring("ID", 4, 8), 16, 10).cast("bigint")
    number = lambda c: (c if not isinstance(c, (int, float)) else F.lit(c)).cast("double")
    made = {
        "rain_sum_7d": number(n % 7), "rain_sum_30d": number(n % 7 + 10), "rain_sum_90d": number(n % 7 + 20), "rain_days_30d": (n % 30).cast("int"),
        "max_daily_rain_30d": number(n % 9), "tavg_7d": number(25), "tavg_30d": number(24 + n % 3), "tavg_90d": number(25), "tmax_30d": number(30), "tmin_30d": number(20),
        "hot_days_30d": F.lit(0), "temp_range_mean_30d": number(8), "ndvi_30d": (n % 10) / F.lit(10.0), "ndvi_90d": number(0.5), "elevation": number(1100 + n % 100), "slope": number(n % 9),
    }
    return _train(spark, d).select("ID", "deathdate", *(c.alias(k) for k, c in made.items()))


def _folder(spark, d) -> str:
    """The four known files, written as CSV."""
    root = Workspace(spark, "files").root
    train = _train(spark, d)
    writers.write_csv(train.filter("split = 'train'").drop("split"), f"{root}/Train.csv")
    writers.write_csv(_train(spark, d, False).filter("split = 'test'").drop("split"), f"{root}/Test.csv")
    writers.write_csv(_climate(spark, d), f"{root}/climate_features.csv")
    sample = train.filter("split = 'test'").select("ID", F.lit(0).alias("TargetF1"), F.lit(0.5).alias("TargetRAUC"))
    writers.write_csv(sample, f"{root}/SampleSubmission.csv")
    return root


def _load(spark, root: str, name: str) -> DataFrame:
    return readers.read_csv(spark, f"{root}/{name}", readers.CONTRACTS[name]())


_CORE = '"ID", zone, gender, CAST(deathdate AS DATE) AS deathdate, age, avg_temperature, max_temperature, min_temperature, precipitation, latitude, CAST(longitude AS DOUBLE) AS longitude, location'


@query(f"WITH {R}, {T} SELECT {_CORE}, is_climate_sensitive FROM t WHERE split = 'train'")
def load_train(spark, d):
    return _load(spark, _folder(spark, d), "Train.csv")


@query(f"WITH {R}, {T} SELECT {_CORE} FROM t WHERE split = 'test'")
def load_test(spark, d):
    return _load(spark, _folder(spark, d), "Test.csv")


@query(f"""WITH {R}, {T} SELECT "ID", CAST(deathdate AS DATE) AS deathdate, CAST(num % 7 AS DOUBLE) AS rain_sum_7d, CAST(num % 7 + 20 AS DOUBLE) AS rain_sum_90d, CAST(num % 30 AS INTEGER) AS rain_days_30d,
  CAST(24 + num % 3 AS DOUBLE) AS tavg_30d, CAST(num % 10 AS DOUBLE) / 10 AS ndvi_30d, CAST(1100 + num % 100 AS DOUBLE) AS elevation FROM t""")
def load_climate(spark, d):
    return _load(spark, _folder(spark, d), "climate_features.csv").select("ID", "deathdate", "rain_sum_7d", "rain_sum_90d", "rain_days_30d", "tavg_30d", "ndvi_30d", "elevation")


@query(f"WITH {R}, {T} SELECT \"ID\", 0 AS \"TargetF1\", CAST(0.5 AS DOUBLE) AS \"TargetRAUC\" FROM t WHERE split = 'test'")
def load_sample(spark, d):
    return _load(spark, _folder(spark, d), "SampleSubmission.csv")


@query(f"""WITH {R}, n AS (SELECT count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'test') AS b FROM r)
  SELECT 'Train.csv' AS file, a AS n, 13 AS n_columns FROM n UNION ALL SELECT 'Test.csv', b, 12 FROM n
  UNION ALL SELECT 'climate_features.csv', a + b, 18 FROM n UNION ALL SELECT 'SampleSubmission.csv', b, 3 FROM n""")
def load_all_counts(spark, d):
    found = readers.load_all(spark, _folder(spark, d))
    out = None
    for name, df in found.items():
        one = df.agg(F.lit(name).alias("file"), F.count("*").alias("n"), F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {R}, {T} SELECT {_CORE}, is_climate_sensitive, CAST(num % 7 AS DOUBLE) AS rain_sum_7d, CAST(num % 10 AS DOUBLE) / 10 AS ndvi_30d FROM t WHERE split = 'train'""")
def load_train_full(spark, d):
    out = readers.load_full(spark, _folder(spark, d))
    return out.select(*(c for c in out.columns if c in readers.RECORD_TYPES or c == readers.TARGET), "rain_sum_7d", "ndvi_30d")


@query("""SELECT * FROM (VALUES ('Train.csv', 'PASS'), ('Test.csv', 'MISSING'), ('climate_features.csv', 'FAIL'), ('SampleSubmission.csv', 'PASS')) v(file, status)""")
def validate_files(spark, d):
    root = _folder(spark, d)
    ws = Workspace(spark, "files")
    ws.root = root
    ws.drop("Test.csv", "climate_features.csv")
    writers.write_csv(_climate(spark, d).withColumn("slope", F.lit(95.0)), f"{root}/climate_features.csv")
    found = readers.validate_folder(spark, root)
    return spark.createDataFrame([(k, v.split(":")[0]) for k, v in found.items()], "file string, status string")


@query(f"""WITH {R}, {T} SELECT count(*) AS n, count(DISTINCT "ID") AS n_ids, {q('sum(age)', 'ages')}, min(CAST(deathdate AS DATE)) AS first_day FROM t WHERE split = 'train'""")
def raw_scan(spark, d):
    df = readers.read_raw_csv(spark, f"{_folder(spark, d)}/Train.csv")
    return df.agg(F.count("*").alias("n"), F.count_distinct("ID").alias("n_ids"), r6(F.sum("age").cast("double"), "ages"), F.min(F.to_date("deathdate")).alias("first_day"))


@query(f"WITH {R}, {T} SELECT count(*) FILTER (WHERE age % 10 = 3) AS n_bad_temperatures, count(*) FILTER (WHERE age % 10 = 4) AS n_bad_rain FROM t")
def cross_column_checks(spark, d):
    """Maximum below mean in some rows, and 30 days' rain above that of 90 in others, counted by the contracts."""
    train = _train(spark, d).drop("split").withColumn("max_temperature", F.when(F.col("age") % 10 == 3, F.col("min_temperature") - 1).otherwise(F.col("max_temperature")))
    rain = _climate(spark, d).join(train.select("ID", "age"), "ID").withColumn("rain_sum_30d", F.when(F.col("age") % 10 == 4, F.lit(99.0)).otherwise(F.col("rain_sum_30d"))).drop("age")
    a = readers.record_contract(True).report(train).filter("rule = 'temperatures in order'").select(F.col("n_bad").alias("n_bad_temperatures"))
    b = readers.climate_contract().report(rain).filter("rule = 'rain in order'").select(F.col("n_bad").alias("n_bad_rain"))
    return a.join(F.broadcast(b), F.lit(True))  # one row each


@query("""SELECT * FROM (VALUES ('missing columns', 'KeyError'), ('nulls', 'ValueError'), ('output column there', 'ValueError'), ('ages not whole', 'ValueError'),
  ('unknown categories', 'ValueError'), ('dead column varies', 'ValueError'), ('all in order', 'none')) v(guard, raised)""")
def guards(spark, d):
    df = _train(spark, d).limit(200)
    tries = {
        "missing columns": lambda: contracts.require_columns(df, ["age", "absent"]),
        "nulls": lambda: contracts.require_no_nulls(df.withColumn("age", F.nullif("age", F.lit(1.0)).cast("double")).unionByName(df.limit(1).withColumn("age", F.lit(None).cast("double"))), ["age"]),
        "output column there": lambda: contracts.require_no_collision(df, ["age"]),
        "ages not whole": lambda: contracts.require_whole_ages(df.withColumn("age", F.col("age") + 0.5), "age"),
        "unknown categories": lambda: contracts.require_values(df, "zone", ["Elsewhere"]),
        "dead column varies": lambda: contracts.drop_dead_columns(df, ["ID"]),
        "all in order": lambda: (contracts.require_no_nulls(df, ["age"]), contracts.require_whole_ages(df, "age"), contracts.require_values(df, "gender", ["Male", "Female"]), contracts.drop_dead_columns(df.withColumn("k", F.lit(1)), ["k"])),
    }
    out = []
    for name, run in tries.items():
        try:
            run()
            out.append((name, "none"))
        except (KeyError, ValueError) as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "guard string, raised string")


_SEASON = "CAST(month(event_date) IN (3, 4, 5) AS INTEGER)"


@query(f"""WITH {R}, c AS (SELECT count(*) FILTER (WHERE {_SEASON} = 1) AS a, count(*) FILTER (WHERE {_SEASON} = 0) AS b, count(*) FILTER (WHERE {_SEASON} = 1 AND y = 1) AS x,
  count(*) FILTER (WHERE {_SEASON} = 0 AND y = 1) AS z FROM r), e AS (SELECT *, a + b AS n, x + z AS k, abs(CAST(x AS DOUBLE) * (b - z) - CAST(a - x AS DOUBLE) * z) AS d FROM c)
  SELECT a AS n_in, b AS n_out, {q('CAST(x AS DOUBLE) / a', 'rate_in')}, {q('CAST(z AS DOUBLE) / b', 'rate_out')},
  {q('CAST(n AS DOUBLE) * power(greatest(d - n / 2.0, 0), 2) / (CAST(a AS DOUBLE) * b * k * (n - k))', 'chi2')} FROM e""")
def season_test(spark, d):
    x = features.season_test(records(spark, d), (3, 4, 5), "y", "event_date")
    row = (x["n_in"], x["n_out"], round(x["rate_in"], 6), round(x["rate_out"], 6), round(x["chi2"], 6))
    return spark.createDataFrame([row], "n_in bigint, n_out bigint, rate_in double, rate_out double, chi2 double")


@query(f"""WITH {R} SELECT 'ID_' || lpad(upper(to_hex(id)), 8, '0') AS "ID", '{{"ID":"ID_' || lpad(upper(to_hex(id)), 8, '0') || '","zone":"' || zone || '","n":' || nation || '}}' AS payload FROM r""")
def row_payloads(spark, d):
    df = records(spark, d).select(hex_id(F.col("id")).alias("ID"), "zone", F.col("nation").alias("n"))
    return readers.row_to_payload(df).select(F.get_json_object("payload", "$.ID").alias("ID"), "payload")


@query("""SELECT 'ID_000000AB' AS "ID", 'Rural' AS zone, CAST(40 AS DOUBLE) AS age, DATE '2020-03-01' AS deathdate""")
def request_row(spark, d):
    payload = {"ID": "ID_000000AB", "zone": "Rural", "gender": "Male", "deathdate": "2020-03-01", "age": 40, "avg_temperature": 20, "max_temperature": 25, "min_temperature": 15, "precipitation": 0, "latitude": 1, "longitude": 30, "location": "x"}
    return readers.row_from_request(spark, payload, readers.record_contract(False)).select("ID", "zone", "age", "deathdate")


# sinks -----------------------------------------------------------------------------------------------------------


@query("""SELECT place, model, CAST(score AS DOUBLE) AS score FROM (VALUES (1, 'b', 0.9), (2, 'a', 0.7), (3, 'c', 0.2)) v(place, model, score)""")
def run_report(spark, d):
    path = Workspace(spark, "runs").path("runs")
    for model, value, day in (("a", 0.95, 1), ("a", 0.7, 2), ("b", 0.9, 1), ("c", 0.2, 3)):
        writers.append_run(spark, path, model, {"x": 1}, {"score": value}, f"2024-01-0{day}")
    rows = writers.run_report(spark.read.parquet(path), "score").select("model", "score").collect()  # three models
    return spark.createDataFrame([(i, r.model, r.score) for i, r in enumerate(rows, 1)], "place int, model string, score double")


@query("""SELECT * FROM (VALUES ('none', 0), ('trial 0', 1), ('trials 0 to 4', 5)) v(there, next_trial)""")
def trial_numbers(spark, d):
    path = Workspace(spark, "trials").path("trials")
    out = [("none", writers.next_trial(spark, path))]
    for name, numbers in (("trial 0", [0]), ("trials 0 to 4", range(1, 5))):
        writers.append_trials(spark.createDataFrame([(i, 0.5) for i in numbers], "trial int, value double"), path)
        out.append((name, writers.next_trial(spark, path)))
    return spark.createDataFrame(out, "there string, next_trial int")


@query(f"WITH {D} SELECT id, fold AS fold_id, y AS y_true, {q('p1', 'p1')}, {q('p2', 'p2')} FROM d")
def oof_round_trip(spark, d):
    path = Workspace(spark, "oof").path("oof")
    writers.write_oof(predictions(spark, d).select("id", F.col("fold").alias("fold_id"), F.col("y").alias("y_true"), "p1", "p2"), path)
    return writers.read_oof(spark, path).select("id", "fold_id", "y_true", r6("p1"), r6("p2"))


@query(f"WITH {D} SELECT CAST(id AS VARCHAR) AS \"ID\", CAST(p1 >= 0.5 AS BIGINT) AS \"TargetF1\" FROM d")
def submission_files(spark, d):
    root = Workspace(spark, "out").root
    writers.write_submission(metrics.submission(predictions(spark, d), "id", "p1"), root, "t1")
    both = [spark.read.csv(f"{root}/{p}", header=True) for p in ("submission", "archive/submission_t1")]
    return both[0].join(both[1], both[0].columns, "left_semi").select("ID", big("TargetF1"))


# joins and tables ------------------------------------------------------------------------------------------------

_L2 = "l AS (SELECT l_quantity AS tmax, l_tax AS tax, l_discount AS discount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"
_FEATURES = ("tmax", "tax", "discount")


def _feature_tables(spark, d):
    df = lines(spark, d)
    one = df.agg(*(F.struct(F.abs(F.corr(c, "y")).alias("abs_r"), F.stddev_samp(c).alias("sd")).alias(c) for c in _FEATURES))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in _FEATURES))).alias("x")).select("x.feature", r6(F.col("x.v.abs_r"), "abs_r"), r6(F.col("x.v.sd"), "sd"))
    return long.select("feature", "abs_r"), long.select("feature", "sd")


_TABLES = "m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {q(f'abs(corr({c}, y))', 'abs_r')}, {q(f'stddev_samp({c})', 'sd')} FROM l" for c in _FEATURES) + ")"


@query(f"WITH {_L2}, {_TABLES} SELECT feature, abs_r, sd FROM m")
def feature_tables_merged(spark, d):
    return forensics.merged_scores(list(_feature_tables(spark, d)), "feature")


@query(f"""WITH {_L2}, {_TABLES}, k AS (SELECT feature, rank() OVER (ORDER BY sd DESC) + (count(*) OVER (PARTITION BY sd) - 1) / 2.0 AS a, rank() OVER (ORDER BY abs_r DESC) + (count(*) OVER (PARTITION BY abs_r) - 1) / 2.0 AS b FROM m)
  SELECT feature, {q('a', 'sd_rank')}, {q('b', 'abs_r_rank')}, {q('b - a', 'rank_gap')} FROM k""")
def descending_rank_gap(spark, d):
    out = forensics.rank_gap(forensics.merged_scores(list(_feature_tables(spark, d)), "feature"), "sd", "abs_r")
    return out.select("feature", r6("sd_rank"), r6("abs_r_rank"), r6("rank_gap"))


@query(f"WITH {R} SELECT nation, count(*) AS n, {q('stddev_samp(total)', 'sd')}, count(*) < 500 AS small FROM r GROUP BY nation")
def group_spread(spark, d):
    return forensics.group_spread(records(spark, d), "nation", "total", 500).select("nation", "n", r6("sd"), "small")


@query(f"""WITH {R}, o AS (SELECT o_orderkey AS id, o_custkey AS position FROM orders WHERE o_orderstatus <> 'P') SELECT r.id, y, position FROM r LEFT JOIN o ON r.id = o.id""")
def position_provenance(spark, d):
    other = read(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("position"))
    return forensics.with_position(records(spark, d), other, "id", "position").select("id", "y", "position")


@query(f"WITH {R} SELECT id, segment, dense_rank() OVER (ORDER BY segment) - 1 AS code FROM r")
def label_codes(spark, d):
    return forensics.label_codes(records(spark, d), "segment", "code").select("id", "segment", "code")


@query(f"WITH {R} SELECT id, zone || '!' AS zone, {q('total / 1000', 'thousands')} FROM r")
def branch_overlay(spark, d):
    out = joins.overlay(records(spark, d), {"zone": F.concat("zone", F.lit("!")), "thousands": F.col("total") / 1000}, ["id", "zone", "thousands"])
    return out.select("id", "zone", r6("thousands"))


@query(f"WITH {R} SELECT id, {q('balance * balance', 'balance_sq')}, {q('total', 'total')} FROM r")
def row_aligned_join(spark, d):
    df = records(spark, d)
    return joins.overlay(df, {"balance_sq": F.col("balance") * F.col("balance")}).select("id", r6("balance_sq"), r6("total"))


@query(f"WITH {R} SELECT CAST(i AS BIGINT) AS place, id, {q('total', 'total')} FROM (SELECT *, row_number() OVER (ORDER BY total DESC, id) AS i FROM r) WHERE i <= 25")
def sorted_head(spark, d):
    """The largest totals, in order: a limit is the feature."""
    top = records(spark, d).orderBy(F.desc("total"), "id").limit(25)
    return top.select(F.posexplode(F.array(F.struct("id", "total"))).alias("x", "v"), "total", "id").select("id", "total").join(
        top.agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("t"), "id"))).alias("a")).select(F.posexplode("a").alias("i", "y")), F.col("id") == F.col("y.id")
    ).select((F.col("i") + 1).cast("bigint").alias("place"), "id", r6("total"))


@query(f"WITH {R} SELECT location, first(segment ORDER BY id) AS first_segment, first(id ORDER BY id) AS first_id FROM r GROUP BY location")
def first_per_group(spark, d):
    return records(spark, d).groupBy("location").agg(F.min_by("segment", "id").alias("first_segment"), F.min("id").alias("first_id"))


# folds -----------------------------------------------------------------------------------------------------------


def _fold_facts(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """(repeat, n_rows, n_groups, n_folds, n_split_groups, even): what any right assignment of groups to folds has."""
    if "repeat" not in folds.columns:
        folds = folds.withColumn("repeat", F.lit(0))
    split = folds.groupBy("repeat", group).agg(F.count("*").alias("k")).groupBy("repeat").agg(F.count_if(F.col("k") > 1).alias("n_split_groups"))
    sizes = splits.fold_sizes(df, folds, group).groupBy("repeat").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_groups").alias("n_groups"), F.count("*").alias("n_folds"), (F.max("n_rows") < 1.5 * F.min("n_rows")).alias("even"))
    return sizes.join(split, "repeat").select(big("repeat"), "n_rows", "n_groups", "n_folds", "n_split_groups", "even")


@query(f"WITH {R} SELECT 0 AS repeat, count(*) AS n_rows, count(DISTINCT (nation, event_date)) AS n_groups, 5 AS n_folds, 0 AS n_split_groups, true AS even FROM r")
def tier1_facts(spark, d):
    df = splits.twin_groups(records(spark, d), ["nation", "event_date"])
    return _fold_facts(df, splits.stratified_group_folds(df, "twin_group", "y"), "twin_group")


_REPEATS = "SELECT i AS repeat, count(*) AS n_rows, count(DISTINCT customer) AS n_groups, {n} AS n_folds, 0 AS n_split_groups, true AS even FROM r, (SELECT unnest(range({k})) AS i) GROUP BY i"


@query(f"WITH {R} {_REPEATS.format(n=5, k=5)}")
def tier2_facts(spark, d):
    df = records(spark, d)
    return _fold_facts(df, splits.packed_group_folds(df, "customer"), "customer")


@query(f"WITH {R} {_REPEATS.format(n=5, k=1)}")
def shared_partition_facts(spark, d):
    df = records(spark, d)
    return _fold_facts(df, splits.shared_partition(df, "customer"), "customer")


@query("SELECT CASE WHEN i = 0 THEN 4 ELSE 5 END AS n_folds, i AS repeat FROM (SELECT unnest(range(5)) AS i)")
def open_fold_facts(spark, d):
    folds = splits.open_folds(splits.packed_group_folds(records(spark, d), "customer"))
    return folds.groupBy("repeat").agg(F.count_distinct("fold").alias("n_folds")).select("n_folds", big("repeat"))


@query(f"WITH {R} SELECT count(*) AS n_rows, 0 AS n_shared_places, true AS near_aims FROM r")
def tier3_facts(spark, d):
    df = records(spark, d)
    held = splits.matched_holdout(df, "location", "zone", aim_zone_share=0.6)
    train, out = splits.holdout_split(df, held, "location")
    shared = joins.key_overlap(train, out, "location").first()[0]
    return spark.createDataFrame([(train.count() + out.count(), shared, held.distance < 0.1)], "n_rows bigint, n_shared_places bigint, near_aims boolean")


# models ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {D}, g AS (SELECT y, CAST(p1 >= 0.5 AS INTEGER) AS g FROM d), c AS (SELECT unnest([0, 1]) AS c),
  s AS (SELECT c, count(*) FILTER (WHERE y = c AND g = c) AS h, count(*) FILTER (WHERE y = c) AS a, count(*) FILTER (WHERE g = c) AS b FROM g, c GROUP BY c)
  SELECT CAST(c AS BIGINT) AS "class", {q('coalesce(CAST(h AS DOUBLE) / nullif(b, 0), 0)', 'precision')}, {q('coalesce(CAST(h AS DOUBLE) / nullif(a, 0), 0)', 'recall')},
  {q('coalesce(2.0 * h / nullif(a + b, 0), 0)', 'f1')}, a AS support FROM s""")
def class_report(spark, d):
    df = predictions(spark, d).withColumn("g", (F.col("p1") >= 0.5).cast("int"))
    return forensics.class_report(df, "y", "g").select(big("class"), r6("precision"), r6("recall"), r6("f1"), "support")


@query(f"WITH {D} SELECT count(*) AS n, {q('avg(CAST(y = m AS INTEGER))', 'accuracy')} FROM d, (SELECT mode(y) AS m FROM d)")
def majority_baseline(spark, d):
    df = predictions(spark, d)
    out = models.Majority().fit(df)(df)
    return out.agg(F.count("*").alias("n"), r6(F.avg((F.col("y") == F.col("p")).cast("double")), "accuracy"))


@query(f"WITH {D}, n AS (SELECT count(*) AS n, sum(y) AS k FROM d) SELECT y, {q('any_value(CASE WHEN y = 1 THEN n / (2.0 * k) ELSE n / (2.0 * (n - k)) END)', 'weight')} FROM d, n GROUP BY y")
def class_weights(spark, d):
    return models.class_weights(predictions(spark, d), "y").groupBy("y").agg(r6(F.max("weight"), "weight"))


@query("SELECT 3 AS n_models, CAST(1 AS DOUBLE) AS total, true AS beats_each, true AS score_holds")
def weight_search_facts(spark, d):
    df = predictions(spark, d).cache()
    names = ["p1", "p2", "p3"]
    weights, best = metrics.search_weights(df, "y", names, draws=200)
    each = [metrics.score(df, "y", p).first()["score"] for p in names]
    again = metrics.score(df.withColumn("b", metrics.blend(weights, names)), "y", "b").first()["score"]
    return spark.createDataFrame([(len(weights), round(sum(weights.values()), 6), best >= max(each), abs(again - best) < 1e-9)], "n_models int, total double, beats_each boolean, score_holds boolean")


@query(f"""WITH {R}, t AS (SELECT DISTINCT latitude AS a, longitude AS o, min(zone) OVER (PARTITION BY latitude, longitude) AS z FROM r WHERE split = 'train'),
  x AS (SELECT id, z, row_number() OVER (PARTITION BY id ORDER BY (a - latitude) * (a - latitude) + (o - longitude) * (o - longitude), z) AS k FROM r, t WHERE split = 'test')
  SELECT z AS nearest, count(*) AS n FROM x WHERE k = 1 GROUP BY z""")
def nearest_places(spark, d):
    train, test = _two(spark, d)
    return clustering.nearest_place(test, train, "latitude", "longitude", "zone").groupBy("nearest").agg(F.count("*").alias("n"))


@query(f"WITH {R} SELECT count(*) AS n_rows, count(DISTINCT (latitude, longitude)) AS n_places, 5 AS n_clusters, 0 AS n_split_places FROM r")
def cluster_facts(spark, d):
    df = records(spark, d)
    model = clustering.fit_clusters(df, ["latitude", "longitude"], ["total", "balance"], 5)
    out = clustering.assign_clusters(df, model)
    places = out.groupBy("latitude", "longitude").agg(F.count_distinct("spatial_cluster").alias("k"), F.count("*").alias("n"))
    return places.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_places"), F.count_if(F.col("k") != 1).alias("n_split_places")).join(
        F.broadcast(out.agg(F.count_distinct("spatial_cluster").alias("n_clusters"))), F.lit(True)  # one row each
    )


@query(f"WITH {D}, {'n AS (SELECT *, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0 AS k FROM d)'} SELECT {q('avg((p1 - y) * (p1 - y))', 'raw_brier')}, {q('(sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))', 'raw_auc')}, true AS platt_no_worse, true AS isotonic_no_worse, true AS in_range FROM n")
def calibration_facts(spark, d):
    """In-sample fits may not be worse than raw probabilities, and must stay between 0 and 1."""
    df = predictions(spark, d).cache()
    raw = metrics.brier(df, "y", "p1").first()[0]
    fits = {"platt": models.fit_platt(df, "p1")(df), "isotonic": models.fit_isotonic(df, "p1")(df)}
    after = {k: metrics.brier(v, "y", "calibrated").first()[0] for k, v in fits.items()}
    inside = all(v.filter("calibrated < 0 OR calibrated > 1 OR calibrated IS NULL").limit(1).count() == 0 for v in fits.values())
    area = metrics.auc(df, "y", "p1").first()["auc"]
    row = (round(raw, 6), round(area, 6), after["platt"] <= raw + 1e-9, after["isotonic"] <= min(raw, after["platt"]) + 1e-6, inside)
    return spark.createDataFrame([row], "raw_brier double, raw_auc double, platt_no_worse boolean, isotonic_no_worse boolean, in_range boolean")


@query(f"WITH {D} SELECT count(*) AS n, count(DISTINCT id) AS n_ids, 0 AS n_outside FROM d")
def stacking_facts(spark, d):
    out = models.stack(predictions(spark, d).cache(), ["p1", "p2", "p3"], "id")
    return out.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(~F.col("p").between(0, 1)).alias("n_outside"))


@query("SELECT unnest([0, 1, 2, 3, 4]) AS fold, true AS in_range, true AS score_holds")
def logit_facts(spark, d):
    df = records(spark, d).select("id", "y", "fold", "total", "balance", "latitude").cache()
    rows = models.evaluate_folds(df, models.logistic(["total", "balance", "latitude"], n=df.count()), models.fold_pairs(df))
    out = [(i, 0 <= x["f1"] <= 1 and 0 <= x["auc"] <= 1, abs(x["score"] - 0.6 * x["f1"] - 0.4 * x["auc"]) < 1e-12) for i, x in enumerate(rows)]
    return spark.createDataFrame(out, "fold int, in_range boolean, score_holds boolean")


@query("SELECT * FROM (VALUES ('plan', true), ('balance', false)) v(feature, matters)")
def importance_facts(spark, d):
    """A label made of one feature: only that feature's permutation costs area."""
    df = records(spark, d).select("id", "balance", "total").withColumn("plan", (F.col("id") % 2).cast("double")).withColumn("y", (F.col("id") % 2).cast("int")).cache()
    predict = models.logistic(["plan", "balance"], n=df.count()).fit(df)
    out = models.permutation_importance(df, predict, ["plan", "balance"], "id", repeats=2)
    return out.select("feature", (F.col("drop") > 0.2).alias("matters"))


@query("SELECT features, CAST(auc AS DOUBLE) AS auc FROM (VALUES ('a', 1.0), ('b', 0.5), ('a + b', 1.0)) v(features, auc)")
def pair_auc(spark, d):
    """Areas of single features and their pair, for a label that follows the first one; a constant says nothing."""
    i = F.col("id")
    df = records(spark, d).select("id", (i % 2).cast("int").alias("y"), (i % 2).cast("double").alias("a"), F.lit(1.0).alias("b"), (F.floor(i / 2) % 2).cast("int").alias("fold")).cache()
    out = [(name, models.feature_set_auc(df, names)) for name, names in (("a", ["a"]), ("b", ["b"]), ("a + b", ["a", "b"]))]
    return spark.createDataFrame([(n, round(v, 6)) for n, v in out], "features string, auc double")


@query("SELECT true AS alike_is_half, true AS apart_is_one")
def output_shift(spark, d):
    """Whether a model can tell two frames by the engine's own predictions: the same ones, and shifted ones."""
    df = predictions(spark, d).select("id", F.col("p1").alias("p")).cache()
    even, odd = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    alike = models.output_shift_auc(even, odd, "p", "id")
    apart = models.output_shift_auc(even, odd.withColumn("p", F.col("p") + 2), "p", "id")
    return spark.createDataFrame([(abs(alike - 0.5) < 0.15, apart > 0.99)], "alike_is_half boolean, apart_is_one boolean")
