"""Registered queries next to their SQL twins, and plan checks."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

CHECKED = ["linear_score", "standardize", "ranking_report", "auc_midrank", "first_hit", "wilcoxon_signed_rank", "cap_pool", "fresh_rows",
           "pool_composition", "basin_loss", "margin_loss", "hinge_step", "radius_join", "scatter_nearest", "dockq", "near_native_lattice",
           "translation_scan", "top_translations", "search_poses", "build_pool"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, con, name):
    # One pose id repeats at this size, so row-level pose ties are left to larger data.
    status, detail, *_ = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", detail


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.parametrize("name", ["ranking_report", "radius_join", "dockq", "shape_terms", "nearest_rotations", "rotate_poses", "fresh_rows", "cap_pool"])
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from posefarm.plans import views as V
    plan = V.pool(spark, SF).filter(F.col("complex_id") == 3).select("pose_id", "c_pair")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_suppkey,3)" in plan and "l_extendedprice" not in plan


def test_partitions_do_not_change_results(spark):
    from posefarm.operators.ranking import ranking_report
    from posefarm.plans import views as V
    p = V.scored(spark, SF).withColumnRenamed("score_a", "score")
    a = sorted(map(tuple, ranking_report(p.repartition(1)).collect()))
    b = sorted(map(tuple, ranking_report(p.repartition(13)).collect()))
    assert a == b


@pytest.mark.parametrize("name", ["search_poses", "build_pool", "decoys_with_cone", "spacing_sweep", "term_gaps"])
def test_searches_ask_for_every_shift(spark, monkeypatch, name):
    from posefarm.operators import search as se

    class Asked(Exception):
        pass

    def best(rec, lig, names, max_shift, *more):
        raise Asked(max_shift)

    monkeypatch.setattr(se, "_best", best)
    with pytest.raises(Asked) as asked:
        entry.queries()[name](spark, SF)
    assert asked.value.args == (None,)


def test_refinement_takes_every_pose_without_a_number_of_rounds(spark, monkeypatch):
    from posefarm.operators import search as se
    from posefarm.plans import views as V

    asked = {}

    def refine(atoms, poses, weights, rounds=None, deg=4.0, shift=1.0, h=0.0, stop_deg=0.05, grid=None):
        asked.update(poses=poses, rounds=rounds, stop_deg=stop_deg)
        return se.score_poses(atoms, poses.limit(0), weights, h).selectExpr("*", "score AS start_score", "0.0D AS deg")

    monkeypatch.setattr(se, "pattern_refine", refine)
    entry.queries()["pattern_refine"](spark, SF)
    assert asked["poses"].count() == V.poses(spark, SF).count() and asked["rounds"] is None and asked["stop_deg"] == 0.05


def _plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["count_over_distance", "legacy_elec_term", "pair_counts", "shape_terms", "elec_term", "pair_counts_trilinear", "score_poses"])
def test_cells_never_pass_through_the_driver(spark, name):
    import re
    assert not re.search(r"BroadcastHashJoin \[[^\]]*\bix#", _plan(spark, name))


def test_small_complexes_are_scanned_where_they_are(spark):
    assert "Exchange hashpartitioning(complex_id" not in _plan(spark, "translation_scan")


def test_partitions_of_vectors_grow_with_the_table(spark, monkeypatch):
    from posefarm.plans import views as V
    monkeypatch.setattr(V, "PER_TASK", 2)
    rows = V.table(spark, SF, "embeddings").count()
    assert V.vectors(spark, SF).rdd.getNumPartitions() == -(-rows // 2)


def test_shuffles_of_complexes_grow_with_them(spark, monkeypatch):
    from posefarm.plans import views as V
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(V, "PER_TASK", 10)
    try:
        n = V.vectors(spark, SF).count()
        assert int(spark.conf.get(key, "0")) >= n // 10 > 8
    finally:
        spark.conf.unset(key)
