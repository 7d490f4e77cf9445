"""Ranks and order statistics, also for a group that holds most rows."""

import random

from pyspark.sql import functions as F

from helpers import rows
from posefarm.functions import ordering as od
from posefarm.operators.ranking import auc_midrank


def skewed(spark, n=3000):
    rnd = random.Random(1)
    data = [("hot" if i % 3 else f"c{i % 7}", i, float(rnd.choice([rnd.gauss(0, 1), 1e6 * rnd.random(), 0.5]))) for i in range(n)]
    return data, spark.createDataFrame(data, "complex_id string, pose_id long, score double")


def brute(data):
    out = {}
    for c in {d[0] for d in data}:
        group = sorted((d for d in data if d[0] == c), key=lambda d: (-d[2], d[1]))
        total = 0.0
        for k, d in enumerate(group, 1):
            total += d[1]
            out[(c, d[1])] = (k, total)
    return out


def test_order_equals_sort(spark):
    data, df = skewed(spark)
    want = brute(data)
    for parts in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = od.with_order(df, "complex_id", "score", "pose_id", descending=True, rank="rank", running={"run": "pose_id"})
        assert {(r.complex_id, r.pose_id): (r["rank"], float(r.run)) for r in got.collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_order_keeps_the_value_type(spark):
    big = [(k % 2, 2**53 + k, f"s{k:02d}") for k in range(40)]
    df = spark.createDataFrame(big, "g int, v long, s string").withColumn("d", F.col("v").cast("decimal(30,3)") / 1000)
    for column in ("v", "s", "d"):
        got = {r.v: r["rank"] for r in od.with_order(df, "g", column).collect()}
        assert got == {2**53 + k: k // 2 + 1 for k in range(40)}
    assert {r.v: r["rank"] for r in od.with_order(df, [], "v", descending=True).collect()} == {2**53 + k: 40 - k for k in range(40)}


def test_null_values_come_last_and_null_keys_are_a_group(spark):
    data = [("a", 1, None), ("a", 2, 5.0), ("a", 3, 1.0)] + [(None, 10 + k, None if k > 3 else float(k)) for k in range(60)]
    df = spark.createDataFrame(data, "complex_id string, pose_id long, score double")
    got = {r.pose_id: r["rank"] for r in od.with_order(df, "complex_id", "score", "pose_id", descending=True).collect()}
    assert [got[k] for k in (2, 3, 1)] == [1, 2, 3]
    assert [got[13 - k] for k in range(4)] == [1, 2, 3, 4] and [got[k] for k in range(14, 70)] == list(range(5, 61))


def test_medians_and_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 7.0)], "k string, v double")
    assert rows(od.upper_median(df, "k", "v"), "k") == [("a", 3.0), ("b", 7.0)]
    assert rows(od.lower_median(df, "k", "v"), "k") == [("a", 2.0), ("b", 7.0)]
    assert rows(od.quantiles_linear(df, "k", "v", {"m": 0.5}), "k") == [("a", 2.5), ("b", 7.0)]


def test_top_k_beyond_the_group_limit(spark):
    data, df = skewed(spark)
    got = od.top_k(df, "complex_id", [F.col("score").desc(), F.col("pose_id")], 1500)
    want = {k: v[0] for k, v in brute(data).items() if v[0] <= 1500}
    assert {(r.complex_id, r.pose_id): r["rank"] for r in got.collect()} == want


def test_auc_does_not_depend_on_partitions(spark):
    _, df = skewed(spark)
    df = df.withColumn("dockq", F.when(F.col("pose_id") % 5 == 0, 0.9).otherwise(0.1))
    assert rows(auc_midrank(df.repartition(1)), "complex_id") == rows(auc_midrank(df.repartition(11)), "complex_id")
