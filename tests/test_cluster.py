"""Clusters of weighted distinct points: exact iterations, and invariants of both methods."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from delaylens.operators import cluster as CL
from delaylens.sources import fixtures


@pytest.mark.parametrize("method", ["lloyd", "kmeans"])
def test_cluster_summary_invariants(spark, method):
    st = fixtures.load_views(spark, SF_SMALL)["st"]
    summary, labelled = CL.delay_clusters(st, method=method)
    rows = summary.collect()
    assert 1 <= len(rows) <= 3
    n = CL.delay_features(st).count()
    assert sum(r["delay_count"] for r in rows) == n
    assert labelled.agg(F.sum("w")).first()[0] == n
    # weighted summaries equal plain summaries over the expanded rows
    feats = CL.delay_features(st)
    lab = labelled.select(*CL.FEATURES, "cluster")
    plain = (feats.join(lab, list(CL.FEATURES)).groupBy("cluster")
             .agg(F.round(F.avg("delay"), 2).alias("m"), F.round(F.stddev_samp("hour"), 2).alias("s")))
    got = {r["cluster"]: (r["delay_mean"], r["hour_std"]) for r in rows}
    for r in plain.collect():
        assert got[r["cluster"]][0] == r["m"]
        assert abs(got[r["cluster"]][1] - r["s"]) <= 0.011


def plain_lloyd(points, k, max_iter):
    """The rule of the docstring over a list of ((hour, delay, weekday), weight)."""
    n = sum(w for _, w in points)
    scales = []
    for j in range(3):
        s1, s2 = sum(p[j] * w for p, w in points), sum(p[j] * p[j] * w for p, w in points)
        scales.append((s1 / n, (max((s2 - s1 * s1 / n) / n, 0)) ** 0.5 or 1.0))
    z = {p: tuple(int((1000.0 * (x - m) / s + 0.5) // 1)
                  for x, (m, s) in zip(p, scales)) for p, _ in points}

    def d(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    centres = [z[min((d(z[p], (0, 0, 0)), p) for p, _ in points)[1]]]
    while len(centres) < k:
        far, p = min((-min(d(z[p], c) for c in centres), p) for p, _ in points)
        if far == 0:
            break
        centres.append(z[p])
    for _ in range(max_iter):
        groups = [[] for _ in centres]
        for p, w in points:
            groups[min((d(z[p], c), i) for i, c in enumerate(centres))[1]].append((z[p], w))
        new = [tuple(sum(x[j] * w for x, w in g) // sum(w for _, w in g) for j in range(3)) if g else c
               for g, c in zip(groups, centres)]
        if new == centres:
            break
        centres = new
    return {p: min((d(z[p], c), i) for i, c in enumerate(centres))[1] for p, _ in points}


@pytest.mark.parametrize("k, max_iter", [(3, 20), (5, 2), (1, 3)])
def test_lloyd_equals_plain_loops_whatever_the_partitions(spark, k, max_iter):
    st = fixtures.load_views(spark, SF_SMALL)["st"]
    points = [((r.hour, r.delay, r.weekday), int(r.w)) for r in CL.feature_points(st).collect()]
    want = plain_lloyd(points, k, max_iter)
    for parts in (1, 7):
        _, labelled = CL.delay_clusters(st.repartition(parts), k=k, max_iter=max_iter)
        assert {(r.hour, r.delay, r.weekday): r.cluster for r in labelled.collect()} == want


def test_few_points_and_none(spark):
    st = fixtures.load_views(spark, SF_SMALL)["st"].select("current_stop_departure", "current_stop_dep_delay")
    two = st.where("current_stop_dep_delay IS NOT NULL").orderBy("current_stop_departure").limit(2)
    summary, _ = CL.delay_clusters(two)
    assert sum(r.delay_count for r in summary.collect()) == 2
    summary, labelled = CL.delay_clusters(st.limit(0))
    assert summary.collect() == [] and labelled.collect() == []
