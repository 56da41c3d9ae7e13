"""Delay-pattern clustering.

Features (hour, delay, weekday) of rows with all three known are
standardised (mean 0, unit population std) and put into k=3 clusters; per
cluster the delay mean/std/count, hour mean/std and weekday mean are reported
to two decimals.

The feature space is discrete - 24 hours x 7 weekdays x whole-second delays -
so rows are first aggregated to distinct points with their multiplicity (one
partial aggregation; at most a few hundred thousand points however large
the history) and clustered as weighted points: the weighted objective equals the
objective over all rows. Only the points are materialised for the iterations.

``lloyd`` (default) is deterministic: features are whole thousandths of a
standard deviation and centres whole numbers, so every sum is exact and neither
partitioning nor the engine changes a label. It starts from the point nearest
the mean and then, as often as needed, the point farthest from all centres so
far (ties go to the smallest hour, delay, weekday); a point belongs to its nearest centre
(ties to the first), a centre moves to the floor of its points' mean, and one without points
stays. An iteration is one aggregation over the points that returns k rows.
``kmeans`` fits pyspark.ml's k-means instead, whose labels depend on its seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylens import constants as K
from delaylens.functions import columns as C
from delaylens.session import materialise

FEATURES = ("hour", "delay", "weekday")
UNITS = 1000  # of a standard deviation


def delay_features(data: DataFrame) -> DataFrame:
    dep = F.col("current_stop_departure")
    return (data.select(F.hour(dep).cast("double").alias("hour"),
                        F.col("current_stop_dep_delay").cast("double").alias("delay"),
                        C.weekday(dep).cast("double").alias("weekday"))
            .dropna())


def feature_points(data: DataFrame) -> DataFrame:
    """Distinct feature points with their row count ``w``."""
    return delay_features(data).groupBy(*FEATURES).agg(F.count(F.lit(1)).cast("double").alias("w"))


def _wmean(c):
    return F.sum(F.col(c) * F.col("w")) / F.sum("w")


def _wstd(c, ddof: int):
    s1, s2, n = F.sum(F.col(c) * F.col("w")), F.sum(F.col(c) * F.col(c) * F.col("w")), F.sum("w")
    var = (s2 - s1 * s1 / n) / (n - ddof)
    return F.when(n > ddof, F.sqrt(F.greatest(var, F.lit(0.0))))


def _scales(points: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population std of each feature; a feature without spread has scale 1."""
    st = points.agg(*[x for c in FEATURES for x in (_wmean(c).alias(f"m_{c}"), _wstd(c, 0).alias(f"s_{c}"))]).first()
    return {c: (st[f"m_{c}"] or 0.0, st[f"s_{c}"] or 1.0) for c in FEATURES}


def whole_points(points: DataFrame) -> DataFrame:
    """The points with z_<feature>, whole thousandths of a standard deviation, in the checkpoint folder."""
    z = {f"z_{c}": F.floor(F.lit(float(UNITS)) * (F.col(c) - F.lit(m)) / F.lit(s) + 0.5).cast("long")
         for c, (m, s) in _scales(points).items()}
    return materialise(points.withColumns(z), "cluster-points")


def _distance(centre) -> Column:
    """Squared distance of a point from a centre of whole numbers."""
    return sum(((F.col(f"z_{c}") - F.lit(x)) * (F.col(f"z_{c}") - F.lit(x)) for c, x in zip(FEATURES, centre)), F.lit(0))


def _nearest(centres) -> Column:
    return F.array_min(F.array(*[F.struct(_distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))


def lloyd(points: DataFrame, k: int, max_iter: int) -> list[tuple[int, ...]]:
    """The centres of at most ``k`` clusters of ``whole_points``."""
    own = [f"z_{c}" for c in FEATURES]

    def smallest(key: Column):
        return points.agg(F.min(F.struct(key.alias("key"), *FEATURES, *own)).alias("p")).first()["p"]

    first = smallest(_distance((0,) * len(own)))
    if first is None:
        return []
    centres = [tuple(first[c] for c in own)]
    while len(centres) < k:
        far = smallest(-_nearest(centres)["d"])
        if far["key"] == 0:  # fewer points than clusters
            break
        centres.append(tuple(far[c] for c in own))
    for _ in range(max_iter):
        sums = (points.groupBy(_nearest(centres)["i"].alias("i"))
                .agg(F.sum(F.col("w").cast("long")).alias("n"), *[F.sum(F.col("w").cast("long") * F.col(c)).alias(c) for c in own]).collect())
        moved = list(centres)
        for r in sums:
            moved[r.i] = tuple(r[c] // r.n for c in own)
        if moved == centres:
            break
        centres = moved
    return centres


def _cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def delay_clusters(data: DataFrame, k: int = K.KMEANS_K, seed: int = K.KMEANS_SEED,
                   max_iter: int = 20, method: str = "lloyd") -> tuple[DataFrame, DataFrame]:
    """Return (per-cluster summary rounded to 2 digits, points with cluster and weight)."""
    points = materialise(feature_points(data), "feature-points")
    if method == "lloyd":
        points = whole_points(points)
        centres = lloyd(points, k, max_iter)
        label = _nearest(centres)["i"] if centres else F.lit(0)
        labelled = points.select(*FEATURES, "w", label.alias("cluster"))
    elif method == "kmeans":
        labelled = _kmeans(points, k, seed, max_iter)
    else:
        raise ValueError(f"unknown method {method!r}")
    summary = (labelled.groupBy("cluster")
               .agg(_cents(_wmean("delay")).alias("delay_mean"),
                    _cents(_wstd("delay", 1)).alias("delay_std"),
                    F.sum("w").cast("long").alias("delay_count"),
                    _cents(_wmean("hour")).alias("hour_mean"),
                    _cents(_wstd("hour", 1)).alias("hour_std"),
                    _cents(_wmean("weekday")).alias("weekday_mean")))
    return summary, labelled


def _kmeans(points: DataFrame, k: int, seed: int, max_iter: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    scaled = points.withColumns({f"z_{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in _scales(points).items()})
    vec = VectorAssembler(inputCols=[f"z_{c}" for c in FEATURES], outputCol="_z").transform(scaled)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_z", predictionCol="cluster",
                   weightCol="w").fit(vec)
    return model.transform(vec).select(*FEATURES, "w", "cluster")
