"""The registered queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcohort.functions import ranks, stats
from sparkcohort.functions.scalars import hex_id, hex_value, from_end, safe_ratio, tidy
from sparkcohort.operators import encoding, features, forensics, joins, metrics, splits
from sparkcohort.plans.frames import C, D, L, R, climate, lines, predictions, read, records
from sparkcohort.sources import contracts, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def big(c: str | Column, name: str | None = None) -> Column:
    out = (F.col(c) if isinstance(c, str) else c).cast("bigint")
    return out.alias(name or c)


def r6(c: str | Column, name: str | None = None) -> Column:
    return tidy(c).alias(name or c)


def q(expr: str, name: str) -> str:
    """Rounded like ``tidy``."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


# contracts and joins ---------------------------------------------------------------------------------------------


@query(f"""WITH {R} SELECT rule, CAST(n_bad AS BIGINT) AS n_bad FROM (
  SELECT 'id not null' AS rule, count(*) FILTER (WHERE id IS NULL) AS n_bad FROM r
  UNION ALL SELECT 'zone known', count(*) FILTER (WHERE zone NOT IN ('Rural', 'Peri_urban')) FROM r
  UNION ALL SELECT 'date in range', count(*) FILTER (WHERE event_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') FROM r
  UNION ALL SELECT 'balance not negative', count(*) FILTER (WHERE balance < 0) FROM r
  UNION ALL SELECT 'hex id', count(*) FILTER (WHERE NOT regexp_matches('ID_' || lpad(upper(to_hex(id)), 8, '0'), '^ID_[0-9A-F]{{8}}$')) FROM r
  UNION ALL SELECT 'customer unique', count(*) - count(DISTINCT customer) FROM r)""")
def contract_report(spark, d):
    df = records(spark, d)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType(), False)])
    rules = {
        "zone known": F.col("zone").isin("Rural", "Peri_urban"),
        "date in range": F.col("event_date").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date")),
        "balance not negative": F.col("balance") >= 0,
        "hex id": hex_id(F.col("id")).rlike("^ID_[0-9A-F]{8}$"),
    }
    return contracts.Contract("records", schema, rules, ("customer",)).report(df)


@query(f"""WITH {R}, {C} SELECT r.id, total, rain, most, days FROM r LEFT JOIN c ON r.id = c.id""")
def validated_join_left(spark, d):
    joined = joins.validated_left_join(records(spark, d), climate(spark, d), "id", allow_unmatched=True)
    return joined.select("id", "total", "rain", "most", "days")


@query(f"WITH {R}, {C} SELECT id, total FROM r WHERE id NOT IN (SELECT id FROM c)")
def unmatched_anti(spark, d):
    return joins.unmatched(records(spark, d), climate(spark, d), "id").select("id", "total")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_filter(spark, d):
    return joins.only_keys(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", "n_chars")


@query(f"""WITH {R}, {C} SELECT count(*) FILTER (WHERE c.id IS NULL) AS only_a, count(*) FILTER (WHERE r.id IS NULL) AS only_b
  FROM r FULL JOIN c ON r.id = c.id""")
def key_set_equality(spark, d):
    return joins.same_keys(records(spark, d), climate(spark, d), "id")


def _two(spark, d):
    df = records(spark, d)
    return df.filter("split = 'train'"), df.filter("split = 'test'")


@query(f"WITH {R} SELECT split, count(*) AS n, {q('avg(y)', 'rate')} FROM r GROUP BY split")
def union_splits(spark, d):
    train, test = _two(spark, d)
    both = joins.tagged_union({"train": train.drop("split"), "test": test.drop("split")})
    return both.groupBy("split").agg(F.count("*").alias("n"), r6(F.avg(F.col("y").cast("double")), "rate"))


@query(f"""WITH {R} SELECT count(*) AS n_shared FROM (SELECT DISTINCT segment, fold FROM r WHERE split = 'train'
  INTERSECT SELECT DISTINCT segment, fold FROM r WHERE split = 'test')""")
def id_overlap(spark, d):
    train, test = (x.select(F.struct("segment", "fold").alias("k")) for x in _two(spark, d))
    return joins.key_overlap(train, test, "k")


@query(f"WITH {R} SELECT DISTINCT segment AS value FROM r WHERE segment NOT IN ('AUTOMOBILE', 'BUILDING')")
def unexpected_categories(spark, d):
    return contracts.unexpected_values(records(spark, d), "segment", ["AUTOMOBILE", "BUILDING"])


@query(f"""WITH {R}, a AS (SELECT segment, count(*) / sum(count(*)) OVER () AS s FROM r WHERE split = 'train' AND cluster <> 0 GROUP BY segment),
  b AS (SELECT segment, count(*) / sum(count(*)) OVER () AS s FROM r WHERE split = 'test' GROUP BY segment)
  SELECT coalesce(a.segment, b.segment) AS segment, {q('coalesce(a.s, 0)', 'train_share')}, {q('coalesce(b.s, 0)', 'test_share')}
  FROM a FULL JOIN b ON a.segment = b.segment""")
def outer_shares(spark, d):
    train, test = _two(spark, d)
    a = forensics.value_shares(train.filter("cluster != 0"), "segment", "train_share")
    b = forensics.value_shares(test, "segment", "test_share")
    return joins.outer_shares(a, b, "segment", "train_share", "test_share").select("segment", r6("train_share"), r6("test_share"))


@query(f"WITH {R} SELECT id, location, total FROM r WHERE id = 7")
def point_lookup(spark, d):
    from sparkcohort.sources.readers import by_key

    return by_key(records(spark, d), "id", 7).select("id", "location", "total")


# stateless features ----------------------------------------------------------------------------------------------


@query(f"""WITH {R}, p AS (SELECT id, event_date AS e, month(event_date) AS m, dayofyear(event_date) AS doy,
  dayofyear(make_date(CAST(year(event_date) AS BIGINT), 12, 31)) AS days FROM r)
  SELECT id, CAST(m AS BIGINT) AS "month", CAST(day(e) AS BIGINT) AS day_of_month, CAST(year(e) AS BIGINT) AS "year",
  {q('sin(2 * pi() * m / 12)', 'month_sin')}, {q('cos(2 * pi() * m / 12)', 'month_cos')},
  {q('sin(2 * pi() * doy / days)', 'day_of_year_sin')}, {q('cos(2 * pi() * doy / days)', 'day_of_year_cos')} FROM p""")
def date_decomposition(spark, d):
    df = features.add_date_parts(records(spark, d), "event_date")
    return df.select("id", big("month"), big("day_of_month"), big("year"), *(r6(c) for c in ("month_sin", "month_cos", "day_of_year_sin", "day_of_year_cos")))


@query(f"""WITH {R} SELECT id, CAST(year(event_date) - (SELECT min(year(event_date)) FROM r WHERE split = 'train') AS BIGINT) AS year_trend FROM r""")
def year_trend(spark, d):
    df = features.add_date_parts(records(spark, d), "event_date")
    year = features.reference_year(df.filter("split = 'train'"), "event_date")
    return features.add_year_trend(df, year).select("id", big("year_trend"))


@query(f"WITH {R} SELECT id, CAST(month(event_date) IN (3, 4, 5) AS BIGINT) AS is_rainy_season FROM r")
def season_flag(spark, d):
    return features.add_season_flag(records(spark, d), (3, 4, 5), "event_date").select("id", big("is_rainy_season"))


@query(f"""WITH {L} SELECT age_band, is_under5, count(*) AS n, {q('avg(y)', 'rate')} FROM (
  SELECT *, CASE WHEN age <= 4 THEN '0-4' WHEN age <= 17 THEN '5-17' WHEN age <= 59 THEN '18-59' ELSE '60+' END AS age_band,
  CAST(age <= 4 AS BIGINT) AS is_under5 FROM l) GROUP BY ALL""")
def age_bands(spark, d):
    df = features.add_age_bands(lines(spark, d))
    return df.groupBy("age_band", big("is_under5")).agg(F.count("*").alias("n"), r6(F.avg(F.col("y").cast("double")), "rate"))


@query(f"""WITH {L} SELECT age, {q('ln(1 + age)', 'age_log1p')}, {q('sqrt(age)', 'age_sqrt')}, count(*) AS n FROM l GROUP BY age""")
def age_transforms(spark, d):
    df = features.add_age_transforms(lines(spark, d))
    return df.groupBy("age", r6("age_log1p"), r6("age_sqrt")).agg(F.count("*").alias("n"))


@query(f"""WITH {L} SELECT tax, discount, tmax, price, {q('tax / 7', 'rain_rate_7d')}, {q('tmax / 30', 'rain_rate_30d')}, {q('price / 90', 'rain_rate_90d')},
  {q('tax / nullif(tmax, 0)', 'rain_ratio_7d_30d')}, {q('tmax / nullif(price, 0)', 'rain_ratio_30d_90d')}, {q('age / nullif(tmax, 0)', 'rain_concentration_30d')},
  {q('age / 30', 'rain_day_share_30d')}, {q('tax / nullif(discount, 0)', 'tax_per_discount')} FROM l""")
def rate_and_ratio_features(spark, d):
    df = features.add_rainfall_rates(lines(spark, d), "tax", "tmax", "price", "age", "age").withColumn("tax_per_discount", safe_ratio("tax", "discount"))
    names = ("rain_rate_7d", "rain_rate_30d", "rain_rate_90d", "rain_ratio_7d_30d", "rain_ratio_30d_90d", "rain_concentration_30d", "rain_day_share_30d", "tax_per_discount")
    return df.select("tax", "discount", "tmax", "price", *(r6(c) for c in names))


@query(f"""WITH {L}, t AS (SELECT quantile_cont(price, 0.9) AS t FROM l WHERE status = 'F')
  SELECT price, CAST(price > t AS BIGINT) AS price_exceeds_flag, {q('price - t', 'price_exceedance')} FROM l, t""")
def threshold_exceedance(spark, d):
    df = lines(spark, d)
    t = features.heat_threshold(df.filter("status = 'F'"), "price")
    return features.add_heat_exceedance(df, t, "price").select("price", big("price_exceeds_flag"), r6("price_exceedance"))


@query(f"WITH {R} SELECT DISTINCT location, latitude * latitude AS lat_sq, longitude * longitude AS lon_sq, latitude * longitude AS lat_lon FROM r")
def coordinate_polynomials(spark, d):
    return features.add_coordinate_polynomials(records(spark, d)).select("location", "lat_sq", "lon_sq", "lat_lon").distinct()


@query("""SELECT page_id, nullif(trim(string_split(url, '/')[-1]), '') AS location_token_1, nullif(trim(string_split(url, '/')[-2]), '') AS location_token_2,
  nullif(trim(string_split(url, '/')[-6]), '') AS location_token_6 FROM pages""")
def token_tail(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", *(from_end(u, i, "/").alias(f"location_token_{i}") for i in (1, 2, 6)))


@query(f"""WITH {R} SELECT {q('corr(id, y)', 'r_target')}, {q('corr(id, total)', 'r_total')}, max(id) AS largest FROM r""")
def id_hex_corr(spark, d):
    df = records(spark, d).withColumn("v", hex_value(hex_id(F.col("id"))))
    return df.agg(r6(F.corr("v", "y"), "r_target"), r6(F.corr("v", "total"), "r_total"), F.max("v").alias("largest"))


@query(f"""WITH {L}, b AS (SELECT *, CASE WHEN age <= 4 THEN '0-4' WHEN age <= 17 THEN '5-17' WHEN age <= 59 THEN '18-59' ELSE '60+' END AS age_band FROM l)
  SELECT {q('age * tmax', 'age_x_tmax')}, status || '_' || flag AS status_x_flag, {q("tax * CAST(age_band = '0-4' AS INTEGER)", 'tax_x_under5')},
  {q("tax * CAST(age_band = '60+' AS INTEGER)", 'tax_x_elderly')}, {q("price * CAST(status = 'F' AS INTEGER)", 'price_x_f')} FROM b""")
def interaction_features(spark, d):
    df = features.add_age_bands(lines(spark, d))
    df = features.add_cluster_zone(features.add_age_climate(df, climate="tmax"), "status", "flag")
    df = features.add_elevation_zone(features.add_anomaly_age(df, "tax"), "price", "status", "F")
    return df.select(r6("age_x_tmax"), "status_x_flag", r6("tax_x_under5"), r6("tax_x_elderly"), r6("price_x_f"))


@query(f"""WITH {L} SELECT {q('price - tmax', 'ndvi_trend')}, {q('price - tmax', 'temperature_range')}, CAST(discount > 0 AS BIGINT) AS is_rainy_day_current FROM l""")
def starter_features(spark, d):
    df = features.add_ndvi_trend(lines(spark, d), "price", "tmax")
    df = features.add_starter_features(df, "price", "tmax", "discount")
    return df.select(r6("ndvi_trend"), r6("temperature_range"), big("is_rainy_day_current"))


@query(f"WITH {R} SELECT id, 'MACHINERY' AS segment, 99.5 AS balance, total FROM r WHERE id = 1")
def what_if(spark, d):
    df = records(spark, d).filter("id = 1").select("id", "segment", "balance", "total")
    return features.perturb(df, {"segment": "MACHINERY", "balance": 99.5})


# places and learned state ----------------------------------------------------------------------------------------


@query(f"WITH {R} SELECT latitude, longitude, {q('avg(total)', 'total')}, {q('avg(balance)', 'balance')} FROM r GROUP BY latitude, longitude")
def location_profiles(spark, d):
    from sparkcohort.operators.clustering import location_profiles as profiles

    return profiles(records(spark, d), ["latitude", "longitude"], ["total", "balance"]).select("latitude", "longitude", r6("total"), r6("balance"))


@query(f"""WITH {R}, z AS (SELECT cluster, segment, count(*) AS k FROM r GROUP BY ALL),
  m AS (SELECT cluster, segment, row_number() OVER (PARTITION BY cluster ORDER BY k DESC, segment) AS i FROM z)
  SELECT r.cluster, count(*) AS n_records, count(DISTINCT (latitude, longitude)) AS n_places, any_value(m.segment) AS top_zone,
  {q('avg(total)', 'mean_total')}, {q('avg(balance)', 'mean_balance')} FROM r JOIN m ON m.cluster = r.cluster AND i = 1 GROUP BY r.cluster""")
def cluster_summary(spark, d):
    from sparkcohort.operators.clustering import cluster_summary as summarise

    out = summarise(records(spark, d), "cluster", ["latitude", "longitude"], "segment", ["total", "balance"])
    return out.select("cluster", "n_records", "n_places", "top_zone", r6("mean_total"), r6("mean_balance"))


def _anomaly_sql(group: str, k: int, loo: bool, body: str) -> str:
    minus, less = (" - total", " - 1") if loo else ("", "")
    enough = "> 1" if loo else "IS NOT NULL"
    rows = "WHERE split = 'train'" if loo else ""
    return f"""WITH {R}, t AS (SELECT * FROM r WHERE split = 'train' OR {group} IS NULL),
  f AS (SELECT {group} AS g, month(event_date) AS m, sum(total) AS s, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= {k}),
  h AS (SELECT {group} AS g, sum(total) AS s, count(*) AS n FROM t GROUP BY ALL), a AS (SELECT sum(total) AS s, count(*) AS n FROM t),
  x AS (SELECT id, total - CASE WHEN f.n {enough} THEN (f.s{minus}) / nullif(f.n{less}, 0) WHEN h.n {enough} THEN (h.s{minus}) / nullif(h.n{less}, 0)
    ELSE (a.s{minus}) / (a.n{less}) END AS v, CASE WHEN f.n {enough} THEN 'group_month' WHEN h.n {enough} THEN 'group' ELSE 'global' END AS total_baseline_level
    FROM r CROSS JOIN a LEFT JOIN f ON f.g = r.{group} AND f.m = month(event_date) LEFT JOIN h ON h.g = r.{group} {rows}) {body}"""


# whole cents: their sums are exact in both engines, in any order
@query(_anomaly_sql("nation", 5, False, f"SELECT id, {q('v', 'total_anomaly')}, total_baseline_level FROM x").replace("t AS (SELECT * FROM r", "c AS (SELECT * REPLACE (CAST(round(total * 100) AS BIGINT) AS total) FROM r), t AS (SELECT * FROM c").replace("FROM r CROSS JOIN a", "FROM c r CROSS JOIN a"))
def anomaly_transform(spark, d):
    df = records(spark, d).withColumn("total", F.round(F.col("total") * 100).cast("bigint"))
    state = encoding.fit_baseline(df.filter("split = 'train'"), "total", ["nation"], "event_date", 5)
    return encoding.apply_anomaly(df, state).select("id", r6("total_anomaly"), "total_baseline_level")


@query(_anomaly_sql("customer", 3, True, f"SELECT id, {q('v', 'total_anomaly')}, total_baseline_level FROM x"))
def anomaly_loo(spark, d):
    df = records(spark, d).filter("split = 'train'")
    state = encoding.fit_baseline(df, "total", ["customer"], "event_date", 3)
    return encoding.fit_rows_anomaly(df, state).select("id", r6("total_anomaly"), "total_baseline_level")


@query(_anomaly_sql("customer", 3, False, "SELECT total_baseline_level, count(*) AS n FROM x GROUP BY ALL"))
def anomaly_level_counts(spark, d):
    df = records(spark, d)
    state = encoding.fit_baseline(df.filter("split = 'train'"), "total", ["customer"], "event_date", 3)
    return encoding.apply_anomaly(df, state).groupBy("total_baseline_level").agg(F.count("*").alias("n"))


@query(f"""WITH {R}, m AS (SELECT avg(total) AS mu FROM r WHERE split = 'train'),
  g AS (SELECT customer, (sum(total) + 5 * any_value(mu)) / (count(*) + 5) AS v FROM r, m WHERE split = 'train' GROUP BY customer)
  SELECT id, {q('coalesce(v, mu)', 'smooth')} FROM r CROSS JOIN m LEFT JOIN g ON g.customer = r.customer""")
def shrunk_group_mean(spark, d):
    df = records(spark, d)
    state = encoding.fit_shrunk(df.filter("split = 'train'"), "total", ["customer"], 5.0)
    return encoding.apply_shrunk(df, state, "smooth").select("id", r6("smooth"))


@query(f"""WITH {R}, t AS (SELECT * FROM r WHERE split = 'train'), m AS (SELECT avg(total) AS mu FROM t)
  SELECT id, {q('(sum(total) OVER (PARTITION BY customer) - total + 5 * mu) / (count(*) OVER (PARTITION BY customer) - 1 + 5)', 'smooth')} FROM t, m""")
def shrunk_group_mean_loo(spark, d):
    df = records(spark, d).filter("split = 'train'")
    state = encoding.fit_shrunk(df, "total", ["customer"], 5.0)
    return encoding.fit_rows_shrunk(df, state, "smooth").select("id", r6("smooth"))


@query(f"""WITH {R}, m AS (SELECT avg(y) AS mu FROM r WHERE split = 'train'),
  g AS (SELECT location, (sum(y) + 10 * any_value(mu)) / (count(*) + 10) AS v FROM r, m WHERE split = 'train' GROUP BY location)
  SELECT id, {q('coalesce(v, mu)', 'location_te')} FROM r CROSS JOIN m LEFT JOIN g ON g.location = r.location""")
def target_encode(spark, d):
    df = records(spark, d)
    state = encoding.fit_target_encoding(df.filter("split = 'train'"), "location", "y")
    return encoding.apply_target_encoding(df, state).select("id", r6("location_te"))


@query(f"""WITH {R}, m AS (SELECT avg(y) AS mu FROM r), g AS (SELECT customer, sum(y) AS s, count(*) AS n FROM r GROUP BY customer),
  f AS (SELECT customer, fold, sum(y) AS s, count(*) AS n FROM r GROUP BY ALL)
  SELECT id, {q('CASE WHEN g.n > f.n THEN (g.s - f.s + 10 * mu) / (g.n - f.n + 10) ELSE mu END', 'customer_te')}
  FROM r JOIN g ON g.customer = r.customer JOIN f ON f.customer = r.customer AND f.fold = r.fold CROSS JOIN m""")
def target_encode_oof(spark, d):
    return encoding.out_of_fold_encoding(records(spark, d), "customer", "y", "fold").select("id", r6("customer_te"))


@query(f"""WITH {R} SELECT id, CAST(segment = 'AUTOMOBILE' AS BIGINT) AS auto, CAST(segment = 'BUILDING' AS BIGINT) AS building,
  CAST(segment = 'MACHINERY' AS BIGINT) AS machinery, CAST(zone = 'Rural' AS BIGINT) AS rural FROM r WHERE split = 'test'""")
def onehot_frozen(spark, d):
    df = records(spark, d)
    kinds = encoding.freeze_categories(df.filter("split = 'train'"), ["segment", "zone"])
    hot = encoding.one_hot(df.filter("split = 'test'"), kinds)
    names = {"auto": "segment_AUTOMOBILE", "building": "segment_BUILDING", "machinery": "segment_MACHINERY", "rural": "zone_Rural"}
    return hot.select("id", *(big(c, k) for k, c in names.items()))


# rates, bins, moments --------------------------------------------------------------------------------------------


@query(f"WITH {R} SELECT segment, {q('avg(y)', 'rate')}, count(*) AS n FROM r GROUP BY segment")
def rate_by_category(spark, d):
    return forensics.rates(records(spark, d), ["segment"], "y").select("segment", r6("rate"), "n")


@query(f"""WITH {R} SELECT segment, {q("avg(y) FILTER (WHERE zone = 'Rural')", 'rural')}, {q("avg(y) FILTER (WHERE zone = 'Peri_urban')", 'peri_urban')} FROM r GROUP BY segment""")
def pivot_rate(spark, d):
    out = forensics.pivot(records(spark, d), "segment", "zone", ["Rural", "Peri_urban"], F.avg(F.col("y").cast("double")))
    return out.select("segment", r6("Rural", "rural"), r6("Peri_urban", "peri_urban"))


@query(f"""WITH {R} SELECT segment, count(*) FILTER (WHERE zone = 'Rural') AS rural, count(*) FILTER (WHERE zone = 'Peri_urban') AS peri_urban FROM r GROUP BY segment""")
def pivot_count(spark, d):
    out = forensics.pivot(records(spark, d), "segment", "zone", ["Rural", "Peri_urban"], F.count(F.lit(1)))
    return out.select("segment", F.coalesce("Rural", F.lit(0)).alias("rural"), F.coalesce("Peri_urban", F.lit(0)).alias("peri_urban"))


@query(f"""WITH {R}, g AS (SELECT location, round(avg(y), 6) AS rate, count(*) AS n FROM r GROUP BY location)
  SELECT * FROM (SELECT 'top' AS side, location, rate + 0.0 AS rate, n FROM g ORDER BY rate DESC, location LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'bottom' AS side, location, rate + 0.0 AS rate, n FROM g ORDER BY rate, location LIMIT 5)""")
def top_bottom_rates(spark, d):
    g = forensics.rates(records(spark, d), ["location"], "y").withColumn("rate", tidy("rate"))
    return forensics.ends(g, "rate", "location", 5).select("side", "location", "rate", "n")


@query(f"""WITH {L}, e AS (SELECT list_sort(list_distinct(quantile_cont(price, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM l)
  SELECT bin, count(*) AS n, {q('avg(y)', 'rate')} FROM (
  SELECT y, greatest(len(list_filter(e, lambda v: v < price)) - 1, 0) AS bin FROM l, e) GROUP BY bin""")
def quantile_bin_rates(spark, d):
    df = lines(spark, d)
    edges = ranks.quantile_edges(df, "price", 5)
    out = forensics.rates(df.withColumn("bin", ranks.right_closed_bin(F.col("price"), edges)), ["bin"], "y")
    return out.select(big("bin"), "n", r6("rate"))


_SPREAD = " UNION ALL ".join(f"""SELECT '{c}' AS name, max(rate) - min(rate) AS spread FROM (SELECT bin, avg(y) AS rate FROM (
  SELECT y, greatest(len(list_filter(e.{c}, lambda v: v < l.{c})) - 1, 0) AS bin FROM l, e) GROUP BY bin)""" for c in ("age", "tmax", "price"))


@query(f"""WITH {L}, e AS (SELECT {", ".join(f"list_sort(list_distinct(quantile_cont({c}, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS {c}" for c in ("age", "tmax", "price"))} FROM l)
  SELECT name, {q('spread', 'spread')} FROM ({_SPREAD})""")
def rate_spread_ranked(spark, d):
    return forensics.rate_spreads(lines(spark, d), ["age", "tmax", "price"], "y", 5).select("name", r6("spread"))


@query(f"""WITH {L}, b AS (SELECT y, CASE WHEN age <= 5 THEN 0 WHEN age <= 12 THEN 1 WHEN age <= 18 THEN 2 WHEN age <= 30 THEN 3 WHEN age <= 45 THEN 4
  WHEN age <= 60 THEN 5 WHEN age <= 120 THEN 6 END AS bin FROM l) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, {q('avg(y)', 'rate')} FROM b GROUP BY bin""")
def explicit_bins(spark, d):
    df = lines(spark, d).withColumn("bin", ranks.right_closed_bin(F.col("age"), [0, 5, 12, 18, 30, 45, 60, 120]))
    return forensics.rates(df, ["bin"], "y").select(big("bin"), "n", r6("rate"))


@query(f"""WITH {L}, e AS (SELECT min(tmax) AS lo, max(tmax) AS hi FROM l),
  b AS (SELECT y, CASE WHEN tmax <= lo + (hi - lo) * 1 / 5 THEN 0 WHEN tmax <= lo + (hi - lo) * 2 / 5 THEN 1 WHEN tmax <= lo + (hi - lo) * 3 / 5 THEN 2
  WHEN tmax <= lo + (hi - lo) * 4 / 5 THEN 3 ELSE 4 END AS bin FROM l, e) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, {q('avg(y)', 'rate')} FROM b GROUP BY bin""")
def equal_width_bins(spark, d):
    df = lines(spark, d)
    edges = ranks.equal_width_edges(df, "tmax", 5)
    return forensics.rates(df.withColumn("bin", ranks.right_closed_bin(F.col("tmax"), edges)), ["bin"], "y").select(big("bin"), "n", r6("rate"))


_MOMENTS = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS n, {q(f'avg({c})', 'mean')}, {q(f'stddev_samp({c})', 'sd')}, {q(f'skewness({c})', 'skew')}, {q(f'kurtosis({c})', 'kurt')}, {q(f'quantile_cont({c}, 0.5)', 'median')} FROM l"
    for c in ("age", "tmax", "price", "tax")
)


@query(f"WITH {L} {_MOMENTS}")
def moments_table(spark, d):
    out = forensics.moments(lines(spark, d), ["age", "tmax", "price", "tax"])
    return out.select("name", "n", r6("mean"), r6("sd"), r6("skew"), r6("kurt"), r6("median"))


@query(f"WITH {L} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_unique, {q(f'stddev_samp({c})', 'sd')}, {q(f'max({c}) - min({c})', 'spread')}, count(DISTINCT {c}) <= 1 AS dead FROM l" for c in ("age", "tmax", "tax", "zero")).replace("count(DISTINCT zero)", "count(DISTINCT tax * 0)").replace("(zero)", "(tax * 0)"))
def variance_audit(spark, d):
    df = lines(spark, d).withColumn("zero", F.col("tax") * 0)
    return contracts.variance_audit(df, ["age", "tmax", "tax", "zero"])


def _health(c: str, x: str) -> str:
    return f"""SELECT '{c}' AS name, {q(f'count(*) FILTER (WHERE ({x}) IS NULL) / count(*)', 'missing_share')},
  (SELECT round(CAST(max(k) AS DOUBLE) / (SELECT count(*) FROM r LEFT JOIN c ON r.id = c.id), 6) + 0.0 FROM (SELECT {x} AS v, count(*) AS k FROM r LEFT JOIN c ON r.id = c.id WHERE ({x}) IS NOT NULL GROUP BY 1)) AS top_share,
  {q(f'avg({x})', 'mean')}, {q(f'stddev_samp({x})', 'sd')}, {q(f'min({x})', 'low')}, {q(f'max({x})', 'high')}, count(DISTINCT {x}) AS n_unique FROM r LEFT JOIN c ON r.id = c.id"""


@query(f"""WITH {R}, {C} SELECT *, CASE WHEN missing_share > 0.2 OR top_share >= 0.95 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ({
  " UNION ALL ".join(_health(c, x) for c, x in {"rain": "rain", "total": "total", "mostly": "CASE WHEN r.id % 100 = 0 THEN 1 ELSE 0 END", "gaps": "CASE WHEN r.id % 3 = 0 THEN balance END"}.items())})""")
def column_health(spark, d):
    df = records(spark, d).join(climate(spark, d), "id", "left")
    df = df.withColumn("mostly", F.when(F.col("id") % 100 == 0, 1).otherwise(0)).withColumn("gaps", F.when(F.col("id") % 3 == 0, F.col("balance")))
    return contracts.column_health(df, ["rain", "total", "mostly", "gaps"])


@query(f"""WITH {R}, {C}, j AS (SELECT rain, most, days, total FROM r LEFT JOIN c ON r.id = c.id)
  SELECT 'rain' AS name, count(*) FILTER (WHERE rain IS NULL) AS n_null FROM j UNION ALL SELECT 'most', count(*) FILTER (WHERE most IS NULL) FROM j
  UNION ALL SELECT 'days', count(*) FILTER (WHERE days IS NULL) FROM j UNION ALL SELECT 'total', count(*) FILTER (WHERE total IS NULL) FROM j""")
def null_census(spark, d):
    return contracts.null_census(records(spark, d).join(climate(spark, d), "id", "left"), ["rain", "most", "days", "total"])


@query(f"WITH {L} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {q(f'corr({a}, {b})', 'r')} FROM l" for a, b in (("age", "tmax"), ("age", "price"), ("age", "tax"), ("tmax", "price"), ("tmax", "tax"), ("price", "tax"))))
def corr_matrix_long(spark, d):
    return stats.pearson_matrix(lines(spark, d), ["age", "tmax", "price", "tax"]).select("a", "b", r6("r"))


_SHIFT = " UNION ALL ".join(
    f"SELECT '{c}' AS name, {q(f'''(avg({c}) FILTER (WHERE status = 'F') - avg({c}) FILTER (WHERE status <> 'F')) / nullif(stddev_samp({c}), 0)''', 'mean_shift')}, {q(f'''stddev_samp({c}) FILTER (WHERE status = 'F') / nullif(stddev_samp({c}) FILTER (WHERE status <> 'F'), 0)''', 'sd_ratio')} FROM l"
    for c in ("age", "tmax", "tax")
)


@query(f"WITH {L} {_SHIFT}")
def subpop_shift(spark, d):
    return forensics.shift(lines(spark, d), ["age", "tmax", "tax"], F.col("status") == "F").select("name", r6("mean_shift"), r6("sd_ratio"))


@query("WITH o AS (SELECT event_id, user_id FROM events) SELECT count(*) AS n_falls FROM o a JOIN o b ON b.event_id = a.event_id + 1 WHERE b.user_id < a.user_id")
def order_audit(spark, d):
    return contracts.out_of_order(read(spark, d, "events"), "user_id", "event_id")


# tests of association --------------------------------------------------------------------------------------------

_TABLE = f"""WITH {R}, n AS (SELECT count(*) FILTER (WHERE m AND y = 1) AS n11, count(*) FILTER (WHERE m AND y = 0) AS n10,
  count(*) FILTER (WHERE NOT m AND y = 1) AS n01, count(*) FILTER (WHERE NOT m AND y = 0) AS n00 FROM (SELECT y, month(event_date) IN (3, 4, 5) AS m FROM r)),
  s AS (SELECT *, CAST(n11 + n10 + n01 + n00 AS DOUBLE) AS n FROM n),
  x AS (SELECT *, (n11 + n10) * (n11 + n01) / n AS e11, (n11 + n10) * (n10 + n00) / n AS e10, (n01 + n00) * (n11 + n01) / n AS e01, (n01 + n00) * (n10 + n00) / n AS e00 FROM s),
  z AS (SELECT *, {" + ".join(f"pow(abs(n{k} - e{k}) - least(0.5, abs(n{k} - e{k})), 2) / nullif(e{k}, 0)" for k in ("11", "10", "01", "00"))} AS chi2 FROM x)"""


@query(f"{_TABLE} SELECT n11, n10, n01, n00, {q('chi2', 'chi2')} FROM z")
def crosstab_chi2_yates(spark, d):
    df = records(spark, d)
    return stats.chi_square(stats.two_by_two(df, F.month("event_date").isin(3, 4, 5), F.col("y") == 1)).select("n11", "n10", "n01", "n00", r6("chi2"))


@query(f"{_TABLE} SELECT {q('sqrt(chi2 / n)', 'cramers_v')} FROM z")
def cramers_v(spark, d):
    df = records(spark, d)
    return stats.chi_square(stats.two_by_two(df, F.month("event_date").isin(3, 4, 5), F.col("y") == 1)).select(r6("cramers_v"))


@query(f"""WITH {L}, v AS (SELECT price, count(*) FILTER (WHERE status = 'F') AS a, count(*) FILTER (WHERE status <> 'F') AS b FROM l GROUP BY price),
  k AS (SELECT sum(a) OVER (ORDER BY price) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY price) / sum(b) OVER () AS fb FROM v) SELECT {q('max(abs(fa - fb))', 'ks')} FROM k""")
def ks_two_sample(spark, d):
    return stats.ks_distance(lines(spark, d), "price", F.col("status") == "F").select(r6("ks"))


@query(f"""WITH {L}, j AS (SELECT flag, status, count(*) AS n FROM l GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY flag) AS nx, sum(n) OVER (PARTITION BY status) AS ny, sum(n) OVER () AS t FROM j)
  SELECT {q('sum(n / CAST(t AS DOUBLE) * ln(CAST(n AS DOUBLE) * t / (CAST(nx AS DOUBLE) * ny)))', 'mi')} FROM x""")
def mutual_information(spark, d):
    return stats.mutual_information(lines(spark, d), "flag", "status").select(r6("mi"))


# twins and groups ------------------------------------------------------------------------------------------------


@query(f"WITH {R} SELECT id, dense_rank() OVER (ORDER BY nation, event_date) - 1 AS twin_group FROM r")
def twin_groups(spark, d):
    return splits.twin_groups(records(spark, d), ["nation", "event_date"]).select("id", "twin_group")


@query(f"WITH {R}, g AS (SELECT nation, event_date, count(*) AS size FROM r GROUP BY ALL HAVING count(*) > 1) SELECT size, count(*) AS n_groups FROM g GROUP BY size")
def twin_size_distribution(spark, d):
    return forensics.twin_sizes(records(spark, d), ["nation", "event_date"])


@query(f"""WITH {R}, g AS (SELECT segment, event_date, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM r GROUP BY ALL HAVING count(*) > 1)
  SELECT splits, count(*) AS n_groups FROM g GROUP BY splits""")
def twin_split_composition(spark, d):
    return forensics.twin_composition(records(spark, d), ["segment", "event_date"], "split").select(F.col("members").alias("splits"), "n_groups")


@query(f"""WITH {R}, g AS (SELECT count(DISTINCT y) = 1 AS same FROM r GROUP BY nation, event_date HAVING count(*) > 1), p AS (SELECT avg(y) AS p FROM r)
  SELECT count(*) AS n_groups, {q('avg(CAST(same AS INTEGER))', 'agreement')}, {q('any_value(p * p + (1 - p) * (1 - p))', 'by_chance')} FROM g, p""")
def twin_label_agreement(spark, d):
    return forensics.twin_agreement(records(spark, d), ["nation", "event_date"], "y").select("n_groups", r6("agreement"), r6("by_chance"))


@query(f"WITH {R} SELECT location, count(DISTINCT zone) AS n_zones, min(zone) AS zone, count(DISTINCT segment) AS n_segments FROM r GROUP BY location")
def fd_check_zone(spark, d):
    return records(spark, d).groupBy("location").agg(F.count_distinct("zone").alias("n_zones"), F.min("zone").alias("zone"), F.count_distinct("segment").alias("n_segments"))


@query(f"""WITH RECURSIVE {R}, e AS (SELECT DISTINCT customer AS p, floor(total) AS k FROM r),
  l AS (SELECT DISTINCT a.p AS a, b.p AS b FROM e a JOIN e b ON a.k = b.k AND a.p <> b.p),
  w AS (SELECT DISTINCT p AS a, p AS b FROM e UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b),
  m AS (SELECT a AS customer, min(b) AS root FROM w GROUP BY a) SELECT customer, dense_rank() OVER (ORDER BY root) - 1 AS merged_group FROM m""")
def merged_components(spark, d):
    return splits.merged_groups(records(spark, d).withColumn("dollars", F.floor("total")), "customer", "dollars")


@query()
def tier1_folds(spark, d):
    df = splits.twin_groups(records(spark, d), ["nation", "event_date"])
    return splits.fold_sizes(df, splits.stratified_group_folds(df, "twin_group", "y"), "twin_group")


@query()
def tier2_folds(spark, d):
    df = records(spark, d)
    return splits.fold_sizes(df, splits.packed_group_folds(df, "customer"), "customer")


@query()
def tier3_holdout(spark, d):
    df = records(spark, d)
    held = splits.matched_holdout(df, "location", "zone", draws=500)
    train, out = splits.holdout_split(df, held, "location")
    return joins.tagged_union({"train": train.drop("split"), "holdout": out.drop("split")}, "part").groupBy("part", "zone").agg(F.count("*").alias("n"))


# metrics ---------------------------------------------------------------------------------------------------------

_RANK = """n AS (SELECT *, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0 AS k FROM d)"""


@query(f"""WITH {D}, {_RANK}, s AS (SELECT CAST(2 * count(*) FILTER (WHERE y = 1 AND p1 >= 0.5) AS DOUBLE) / nullif(2 * count(*) FILTER (WHERE y = 1 AND p1 >= 0.5) + count(*) FILTER (WHERE y <> CAST(p1 >= 0.5 AS INTEGER)), 0) AS f1,
  (sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM n)
  SELECT {q('f1', 'f1')}, {q('auc', 'auc')}, {q('0.6 * f1 + 0.4 * auc', 'score')} FROM s""")
def f1_auc_score(spark, d):
    return metrics.score(predictions(spark, d), "y", "p1").select(r6("f1"), r6("auc"), r6("score"))


@query(f"WITH {D} SELECT {q('avg((p1 - y) * (p1 - y))', 'brier')} FROM d")
def brier(spark, d):
    return metrics.brier(predictions(spark, d), "y", "p1").select(r6("brier"))


@query(f"""WITH {D}, e AS (SELECT list_sort(list_distinct(quantile_cont(p1, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM d)
  SELECT bin, count(*) AS n, {q('avg(p1)', 'mean_p')}, {q('avg(y)', 'rate')}, {q('avg(p1) - avg(y)', 'gap')} FROM (
  SELECT y, p1, greatest(len(list_filter(e, lambda v: v < p1)) - 1, 0) AS bin FROM d, e) GROUP BY bin""")
def reliability_bins(spark, d):
    return metrics.reliability(predictions(spark, d), "y", "p1", 5).select(big("bin"), "n", r6("mean_p"), r6("rate"), r6("gap"))


@query(f"WITH {D} SELECT CAST(y AS BIGINT) AS y, CAST(p1 >= 0.5 AS BIGINT) AS guess, count(*) AS n FROM d GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(predictions(spark, d), "y", (F.col("p1") >= 0.5).cast("int")).select(big("y"), big("guess"), "n")


_RANKS = ", ".join(f"(rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0) / count(*) OVER () AS r{m}" for m in ("p1", "p2", "p3"))


@query(f"WITH {D}, k AS (SELECT id, {_RANKS} FROM d) SELECT id, {q('(rp1 + rp2 + rp3) / 3', 'p')} FROM k")
def rank_average(spark, d):
    return metrics.rank_average(predictions(spark, d), "id", ["p1", "p2", "p3"]).select("id", r6("p"))


@query(f"WITH {D} SELECT id, {q('0.5 * p1 + 0.3 * p2 + 0.2 * p3', 'p')} FROM d")
def weighted_blend(spark, d):
    return predictions(spark, d).select("id", r6(metrics.blend({"p1": 5, "p2": 3, "p3": 2}, ["p1", "p2", "p3"]), "p"))


def _wrong(m: str) -> str:
    return f"CAST({m} >= 0.5 AS INTEGER) <> y"


@query(f"WITH {D} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {q(f'count(*) FILTER (WHERE {_wrong(a)} AND {_wrong(b)}) / nullif(CAST(count(*) FILTER (WHERE {_wrong(a)} OR {_wrong(b)}) AS DOUBLE), 0)', 'share')} FROM d" for a, b in (("p1", "p2"), ("p1", "p3"), ("p2", "p3"))))
def both_wrong_matrix(spark, d):
    return metrics.both_wrong(predictions(spark, d), "y", ["p1", "p2", "p3"]).select("a", "b", r6("share"))


_FOLD = "f AS (SELECT fold, avg((p1 - y) * (p1 - y)) AS a, avg((p2 - y) * (p2 - y)) AS b FROM d GROUP BY fold)"


def _by_fold(spark, d):
    gap = lambda p: F.avg((F.col(p) - F.col("y")) * (F.col(p) - F.col("y")))
    return predictions(spark, d).groupBy("fold").agg(gap("p1").alias("a"), gap("p2").alias("b"))


@query(f"WITH {D}, {_FOLD} SELECT {q('avg(a)', 'mean')}, {q('coalesce(stddev_samp(a), 0)', 'sd')}, {q('min(a)', 'low')}, {q('max(a)', 'high')}, count(*) AS n FROM f")
def score_summary(spark, d):
    return metrics.summary(_by_fold(spark, d), "a").select(r6("mean"), r6("sd"), r6("low"), r6("high"), "n")


@query(f"WITH {D}, {_FOLD} SELECT {q('avg(a - b)', 'mean')}, {q('stddev_pop(a - b)', 'sd')}, count(*) FILTER (WHERE a > b) AS wins, count(*) AS n FROM f")
def paired_diff(spark, d):
    return metrics.paired_difference(_by_fold(spark, d), "a", "b").select(r6("mean"), r6("sd"), "wins", "n")


@query()
def weight_search(spark, d):
    weights, best = metrics.search_weights(predictions(spark, d).cache(), "y", ["p1", "p2", "p3"], draws=100)
    return spark.createDataFrame([(k, round(v, 6), round(best, 6)) for k, v in weights.items()], "model string, weight double, score double")


@query(f"""WITH {D} SELECT id AS "ID", CAST(p1 >= 0.5 AS BIGINT) AS "TargetF1", {q('p1', '"TargetRAUC"')} FROM d""")
def submission_frame(spark, d):
    out = metrics.submission(predictions(spark, d), "id", "p1")
    return out.select("ID", big("TargetF1"), r6("TargetRAUC"))


@query(f"""WITH {D}, s AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)
  SELECT 'id not in sample' AS rule, count(*) AS n_bad FROM d WHERE id NOT IN (SELECT doc_id FROM s)
  UNION ALL SELECT 'sample id missing', count(*) FROM s WHERE doc_id NOT IN (SELECT id FROM d) UNION ALL SELECT 'id repeated', 0
  UNION ALL SELECT 'TargetF1 not 0 or 1', 0 UNION ALL SELECT 'TargetRAUC outside 0..1', 0""")
def submission_check(spark, d):
    out = metrics.submission(predictions(spark, d), "id", "p1")
    sample = read(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("ID"), F.lit(0).alias("TargetF1"), F.lit(0.5).alias("TargetRAUC"))
    return metrics.submission_faults(out, sample)


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1""")
def latest_run_per_model(spark, d):
    return writers.latest_runs(read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 6) + 0.0 AS value_7d FROM events""")
def trailing_window(spark, d):
    from sparkcohort.streaming.scoring import trailing_sums

    df = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return trailing_sums(df, "user_id", "day", "value", (7,)).select("user_id", "event_id", r6("value_7d"))


# clusters and models: rows only ----------------------------------------------------------------------------------


@query()
def kmeans_clusters(spark, d):
    from sparkcohort.operators import clustering

    df = records(spark, d)
    model = clustering.fit_clusters(df, ["latitude", "longitude"], ["total", "balance"], 5)
    out = clustering.assign_clusters(df, model)
    return clustering.cluster_summary(out, "spatial_cluster", ["latitude", "longitude"], "zone", ["total"])


@query()
def select_k(spark, d):
    from sparkcohort.operators import clustering

    return clustering.select_k(records(spark, d), ["latitude", "longitude"], ["total"], range(2, 5))


@query(f"""WITH {R}, p AS (SELECT DISTINCT latitude, longitude, zone FROM r), g AS (SELECT a.latitude, a.longitude, a.zone AS z, b.zone AS w,
  avg(sqrt(pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2))) AS m FROM p a JOIN p b ON (a.latitude, a.longitude) <> (b.latitude, b.longitude) GROUP BY ALL),
  s AS (SELECT latitude, longitude, min(m) FILTER (WHERE z = w) AS a, min(m) FILTER (WHERE z <> w) AS b FROM g GROUP BY ALL)
  SELECT {q('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / nullif(greatest(a, b), 0) END)', 'silhouette')} FROM s""")
def silhouette(spark, d):
    from sparkcohort.operators.clustering import silhouette as of

    places = records(spark, d).select("latitude", "longitude", "zone").distinct().select(F.array("latitude", "longitude").alias("x"), "zone")
    return of(places, "x", "zone").select(r6("silhouette"))


def _scores(spark, model, df):
    from sparkcohort.operators import models

    rows = models.evaluate_folds(df, model, models.fold_pairs(df))
    return spark.createDataFrame([(i, x["f1"], x["auc"], x["score"]) for i, x in enumerate(rows)], "fold int, f1 double, auc double, score double")


@query()
def logit_cv(spark, d):
    from sparkcohort.operators import models

    df = records(spark, d).select("id", "y", "fold", "total", "balance", "latitude").cache()
    return _scores(spark, models.logistic(["total", "balance", "latitude"], n=df.count()), df)


@query()
def gbt_cv(spark, d):
    from sparkcohort.operators import models

    df = records(spark, d).select("id", "y", (F.col("fold") % 2).alias("fold"), "total", "balance", "segment").cache()
    return _scores(spark, models.boosted(["total", "balance"], ["segment"], maxIter=5), df)


@query()
def calibration_comparison(spark, d):
    from sparkcohort.operators import models

    return models.compare_calibrations(predictions(spark, d).cache(), "p1")


@query()
def stacking(spark, d):
    from sparkcohort.operators import models

    return models.stack(predictions(spark, d).cache(), ["p1", "p2", "p3"], "id")


@query()
def adversarial_auc(spark, d):
    from sparkcohort.operators import models

    train, test = _two(spark, d)
    return spark.createDataFrame([(models.adversarial_auc(train, test, ["total", "balance"], "id", 2),)], "auc double")


@query()
def permutation_importance(spark, d):
    from sparkcohort.operators import models

    df = records(spark, d).select("id", "y", "total", "balance").cache()
    predict = models.logistic(["total", "balance"], n=df.count()).fit(df)
    return models.permutation_importance(df, predict, ["total", "balance"], "id", repeats=2)


@query()
def feature_ablation(spark, d):
    from sparkcohort.operators import models

    df = records(spark, d).select("id", "y", (F.col("fold") % 2).alias("fold"), "total", "balance").cache()
    return models.ablation(df, lambda names: models.logistic(names), ["total", "balance"], ["balance"])


@query()
def single_feature_auc(spark, d):
    from sparkcohort.operators import models

    df = records(spark, d).select("id", "y", (F.col("fold") % 2).alias("fold"), "total", "balance").cache()
    return models.single_feature_auc(df, ["total", "balance"])


@query()
def nearest_neighbour(spark, d):
    from sparkcohort.operators import clustering

    train, test = _two(spark, d)
    out = clustering.nearest_place(test, train, "latitude", "longitude", "zone")
    return out.groupBy("location", "nearest").agg(F.count("*").alias("n"))


@query()
def provenance(spark, d):
    return spark.createDataFrame(features.provenance())
