"""Spatial clusters of places, each place counted once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.sources.contracts import require_columns, require_no_collision
from sparkcohort.sources.storage import frozen

SEEDS = 10


def location_profiles(df: DataFrame, place: list[str], normals: list[str]) -> DataFrame:
    """One row a place with the means of its normals."""
    require_columns(df, [*place, *normals])
    return df.groupBy(*place).agg(*(F.avg(c).alias(c) for c in normals))


@dataclass(frozen=True)
class ClusterModel:
    """A fitted scaler and centroids; labels are numbered by centroid order."""

    place: list[str]
    normals: list[str]
    scaler: StandardScalerModel
    model: KMeansModel
    order: tuple[int, ...]
    known: DataFrame

    def centers(self) -> list[list[float]]:
        """Centroids on the columns' own scale."""
        mean, sd = self.scaler.mean.toArray(), self.scaler.std.toArray()
        found = [(np.asarray(c) * sd + mean).tolist() for c in self.model.clusterCenters()]
        return [found[i] for i in self.order]


def _inputs(place: list[str], normals: list[str]) -> list[str]:
    return [*place, *normals]


def _scaled(profiles: DataFrame, names: list[str]) -> tuple[DataFrame, StandardScalerModel]:
    vectors = VectorAssembler(inputCols=names, outputCol="__v").transform(profiles)
    scaler = StandardScaler(inputCol="__v", outputCol="__x", withMean=True, withStd=True).fit(vectors)
    return scaler.transform(vectors), scaler


def _best_kmeans(scaled: DataFrame, k: int, seed: int) -> KMeansModel:
    models = [KMeans(featuresCol="__x", predictionCol="__label", k=k, seed=seed + i).fit(scaled) for i in range(SEEDS)]
    return min(models, key=lambda m: m.summary.trainingCost)


def fit_clusters(df: DataFrame, place: list[str], normals: list[str], k: int, seed: int = 42) -> ClusterModel:
    profiles = location_profiles(df, place, normals).cache()
    try:
        scaled, scaler = _scaled(profiles, _inputs(place, normals))
        model = _best_kmeans(scaled, k, seed)
    finally:
        profiles.unpersist()
    order = tuple(sorted(range(len(model.clusterCenters())), key=lambda i: tuple(np.round(model.clusterCenters()[i], 9))))
    fitted = ClusterModel(place, normals, scaler, model, order, profiles)
    return ClusterModel(place, normals, scaler, model, order, frozen(_labels(fitted, profiles, "__known"), "places"))


def _labels(m: ClusterModel, profiles: DataFrame, out: str) -> DataFrame:
    vectors = VectorAssembler(inputCols=_inputs(m.place, m.normals), outputCol="__v").transform(profiles)
    numbered = m.model.transform(m.scaler.transform(vectors))
    rank = {old: new for new, old in enumerate(m.order)}
    label = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))[F.col("__label")]
    return numbered.select(*m.place, label.alias(out))


def assign_clusters(df: DataFrame, m: ClusterModel, out: str = "spatial_cluster", frozen: bool = False) -> DataFrame:
    """Adds each row's cluster.  Places get the profile of the rows at hand, so a place can move between
    calls; ``frozen`` keeps the fitted label of places that were there."""
    require_no_collision(df, [out])
    labels = _labels(m, location_profiles(df, m.place, m.normals), out)
    if frozen:
        labels = labels.join(m.known, m.place, "left").withColumn(out, F.coalesce("__known", out)).drop("__known")
    return df.join(labels, m.place, "left")


def silhouette(df: DataFrame, values: str, label: str) -> DataFrame:
    """One row (silhouette): the mean Euclidean silhouette of labelled vectors (arrays).

    Every vector is compared with all others: for places, not for records.  The
    broadcast side is checked to be at most 20,000 rows.
    """
    n = df.count()
    if n > 20_000:
        raise ValueError("too many vectors for an exact silhouette; cluster places, not records")
    a = df.select(F.monotonically_increasing_id().alias("i"), F.col(values).alias("x"), F.col(label).alias("l"))
    rows = [(r["i"], list(r["x"]), r["l"]) for r in a.collect()]
    right = F.broadcast(df.sparkSession.createDataFrame([(i, [float(v) for v in x], str(g)) for i, x, g in rows], "j bigint, y array<double>, m string"))
    left = df.sparkSession.createDataFrame([(i, [float(v) for v in x], str(g)) for i, x, g in rows], "i bigint, x array<double>, l string").repartition(16)
    gap = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    means = left.join(right, F.col("i") != F.col("j")).groupBy("i", "l", "m").agg(F.avg(gap).alias("d"))
    each = means.groupBy("i", "l").agg(F.min(F.when(F.col("l") == F.col("m"), F.col("d"))).alias("a"), F.min(F.when(F.col("l") != F.col("m"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return each.agg(F.avg(value).alias("silhouette"))


def select_k(df: DataFrame, place: list[str], normals: list[str], ks: range, seed: int = 42) -> DataFrame:
    """(k, silhouette, inertia, best) for each k; the largest silhouette is best, the smaller k on ties."""
    profiles = location_profiles(df, place, normals).cache()
    n = profiles.count()
    if not len(ks):
        raise ValueError("no k to try")
    if max(ks) >= n:
        raise ValueError(f"k must be smaller than the number of places, {n}")
    scaled, _ = _scaled(profiles, _inputs(place, normals))
    scaled = scaled.cache()
    rows = []
    for k in ks:
        model = _best_kmeans(scaled, k, seed)
        labelled = model.transform(scaled).select(vector_to_array("__x").alias("x"), F.col("__label").alias("label"))
        rows.append((k, silhouette(labelled, "x", "label").first()[0], model.summary.trainingCost))
    scaled.unpersist()
    profiles.unpersist()
    if all(r[1] is None for r in rows):
        raise ValueError("no valid silhouette")
    best = min((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, silhouette double, inertia double, best boolean")


def row_clusters(df: DataFrame, lat: str, lon: str, k: int = 8, seed: int = 42, out: str = "spatial_cluster") -> DataFrame:
    """Clusters of raw coordinates of records; fewer where there are fewer records."""
    n = df.limit(k).count()
    vectors = VectorAssembler(inputCols=[lat, lon], outputCol="__v").transform(df)
    model = KMeans(featuresCol="__v", predictionCol=out, k=max(2, min(k, n)), seed=seed).fit(vectors)
    return model.transform(vectors).drop("__v")


def cluster_summary(df: DataFrame, cluster: str, place: list[str], zone: str, means: list[str]) -> DataFrame:
    """(cluster, n_records, n_places, top_zone, means) in one pass."""
    return df.groupBy(cluster).agg(
        F.count("*").alias("n_records"),
        F.count_distinct(*place).alias("n_places"),
        F.mode(zone, deterministic=True).alias("top_zone"),
        *(F.avg(c).alias(f"mean_{c}") for c in means),
    )


def nearest_place(df: DataFrame, reference: DataFrame, lat: str, lon: str, label: str, out: str = "nearest") -> DataFrame:
    """Adds the label of the nearest reference place (the smallest label on ties).

    Reference places are different coordinates, checked to be at most 10,000, and
    broadcast; each row keeps one running minimum.
    """
    places = reference.groupBy(lat, lon).agg(F.min(label).alias(label)).limit(10_001).collect()
    if len(places) > 10_000:
        raise ValueError("too many reference places")
    points = F.array(*(F.struct(F.lit(float(p[0])).alias("a"), F.lit(float(p[1])).alias("o"), F.lit(p[2]).alias("l")) for p in places))
    gaps = F.transform(points, lambda p: F.struct(((p.a - F.col(lat)) * (p.a - F.col(lat)) + (p.o - F.col(lon)) * (p.o - F.col(lon))).alias("d"), p.l.alias("l")))
    return df.withColumn(out, F.array_min(gaps).l)
