import math

from delaylens.functions import tdist


def test_known_quantiles():
    t = dict(tdist.t975_table())
    assert abs(t[1] - 12.706204736) < 1e-8
    assert abs(t[4] - 2.7764451051977934) < 1e-9
    assert abs(t[30] - 2.0422724563) < 1e-9
    assert abs(t[99] - 1.9842169515) < 1e-9


def test_expansion_joins_table_smoothly():
    for v in (250, 300):
        assert abs(tdist.t_ppf(0.975, v) - tdist.t975_expansion(v)) < 1e-9


def test_tail_is_consistent_with_quantile():
    for v in (4, 7.5, 33.3, 1000):
        q = tdist.t_ppf(0.975, v)
        assert abs(tdist.t_sf(q, v) - 0.025) < 1e-12
        assert abs(tdist.t_sf(-q, v) - 0.975) < 1e-12


def test_column_form(spark):
    from pyspark.sql import functions as F
    rows = spark.range(1, 1000, 37).select(F.col("id").alias("dof"), tdist.t975("dof").alias("t")).collect()
    for r in rows:
        assert math.isclose(r["t"], tdist.t_ppf(0.975, r["dof"]), rel_tol=1e-9)
