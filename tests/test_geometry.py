"""Features, scatter, rotations, search and refinement against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from posefarm.operators import features as ft
from posefarm.operators import rotations as ro
from posefarm.operators import scoring as sc
from posefarm.operators import search as se
from posefarm.operators import spatial as sp

ATOM = "complex_id long, side string, atom_idx int, x double, y double, z double, radius double, sasa double, type_id int, charge_id int"


def system(spark, seed=3, n_rec=8, n_lig=5):
    rnd = random.Random(seed)
    data = []
    for side, n, spread in (("R", n_rec, 2.0), ("L", n_lig, 1.5)):
        xyz = np.array([[rnd.gauss(0, spread) for _ in range(3)] for _ in range(n)])
        xyz -= xyz.mean(0)
        for i, p in enumerate(xyz):
            data.append((1, side, i, *map(float, p), 1 + rnd.random(), 4 * rnd.random(), rnd.randint(1, 12), rnd.randint(1, 11)))
    return spark.createDataFrame(data, ATOM)


@pytest.mark.parametrize("res,names,want", [
    (["PRO"], ["N"], [7]), (["ALA"], ["N"], [1]), (["ALA", "GLY"], ["N", "N"], [1, 11]), (["PRO", "ALA"], ["N", "N"], [7, 1]),
    (["ALA"], ["OXT"], [2]), (["ALA", "PRO", "GLY", "ALA", "ALA"], ["N", "N", "N", "O", "OXT"], [1, 7, 11, 10, 2])])
def test_charge_types(spark, res, names, want):
    df = spark.createDataFrame([("A", "R", i, r, n) for i, (r, n) in enumerate(zip(res, names))], "complex_id string, side string, atom_idx int, res_name string, atom_name string")
    assert [r[0] for r in ft.with_charge_type(df).orderBy("atom_idx").select("charge_id").collect()] == want


def test_unknown_atom_fails(spark):
    df = spark.createDataFrame([("A", "R", 0, "XYZ", "Q1")], "complex_id string, side string, atom_idx int, res_name string, atom_name string")
    with pytest.raises(Exception, match="no atom type"):
        ft.with_atom_type(df).collect()
    with pytest.raises(Exception, match="no radius"):
        ft.with_radius(df).collect()


def grid(spark, n=10, h=1.2, lo=-5.0):
    return spark.createDataFrame([(1, h, lo, n, lo, n, lo, n)], "complex_id long, h double, x0 double, nx long, y0 double, ny long, z0 double, nz long")


def test_nearest_cell(spark):
    offsets = [-0.59, -0.01, 0.0, 0.01, 0.59, -0.61, 0.61]
    pts = spark.createDataFrame([(1, i, -1.4 + o, 0.0, 0.0) for i, o in enumerate(offsets)], "complex_id long, atom_idx int, x double, y double, z double")
    got = [r.ix for r in sp.nearest_cells(pts, grid(spark)).orderBy("atom_idx").collect()]
    assert got == [3, 3, 3, 3, 3, 2, 4]


def test_point_charge_laws(spark):
    def potential(charges):
        df = spark.createDataFrame([(1, float(x), 0.0, 0.0, float(q)) for x, q in charges], "complex_id long, x double, y double, z double, charge double")
        return {(r.ix, r.iy, r.iz): r.w for r in sp.scatter_inverse_distance(df, grid(spark, 31, 0.5, -7.5), reach=8.0).collect()}

    plus, minus = potential([(0, 1)]), potential([(0, -1)])
    assert all(plus[k] == -minus[k] for k in plus)
    for cells in (2, 4, 8, 12):
        assert plus[(15 + cells, 15, 15)] == pytest.approx(2.0 / cells)
    a, b, both = potential([(-2, 1)]), potential([(2, -1)]), potential([(-2, 1), (2, -1)])
    assert all(both[k] == pytest.approx(a.get(k, 0) + b.get(k, 0)) for k in both)


def test_radius_join_is_exact(spark):
    rnd = random.Random(5)
    pts = [(1, i, *(rnd.uniform(-9, 9) for _ in range(3))) for i in range(120)]
    df = spark.createDataFrame(pts, "complex_id long, atom_idx int, x double, y double, z double")
    got = {(r.a_atom_idx, r.b_atom_idx) for r in sp.radius_join(df, df, 3.0).collect()}
    want = {(a[1], b[1]) for a in pts for b in pts if math.dist(a[2:], b[2:]) < 3.0}
    assert got == want
    plan = sp.radius_join(df, df, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exposed_points_are_those_no_neighbour_covers(spark):
    """Against brute force over all points, with a number of points that fills no whole word; pairs
    are marked in batches, not point by point in an expression of every pair."""
    a = system(spark, seed=7, n_rec=9)
    n, points = 100, []
    for r in spark.range(100).select(*[c.alias(x) for c, x in zip(ft.sphere_point(F.col("id"), 100), "xyz")]).collect():
        points.append(np.array(r, float))
    got = ft.exposed_area(a.drop("sasa"), n=n)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    atoms = a.collect()
    for t in got.collect():
        at, reach = np.array([t.x, t.y, t.z]), t.radius + 1.4
        others = [(np.array([o.x, o.y, o.z]), o.radius + 1.4) for o in atoms if o.side == t.side and o.atom_idx != t.atom_idx]
        free = sum(all(np.linalg.norm(at + reach * p - b) >= r for b, r in others) for p in points)
        assert t.sasa == pytest.approx(free / n * 4 * math.pi * reach ** 2)


def test_exposed_area_of_one_and_two_atoms(spark):
    one = spark.createDataFrame([(1, "R", 0, 0.0, 0.0, 0.0, 1.7)], "complex_id long, side string, atom_idx int, x double, y double, z double, radius double")
    assert ft.exposed_area(one).first()["sasa"] == pytest.approx(4 * math.pi * 3.1 ** 2)
    two = one.unionByName(one.withColumn("atom_idx", F.lit(1)).withColumn("x", F.lit(3.1)))
    cap = 2 * math.pi * 3.1 * (3.1 + 1.55)
    assert all(r.sasa == pytest.approx(cap, rel=0.02) for r in ft.exposed_area(two).collect())


def test_rotation_sets(spark):
    for df, n in ((ro.hopf_rotations(spark, 3), 1944), (ro.random_rotations(spark, 50, 1), 50), (ro.euler_rotations(spark, 60.0), 144)):
        q = np.array([[r.q1, r.q2, r.q3, r.q4] for r in df.collect()])
        assert len(q) == n and np.allclose((q ** 2).sum(1), 1)
    assert rows(ro.random_rotations(spark, 20, 4), "qi") == rows(ro.random_rotations(spark, 60, 4).filter("qi < 20"), "qi")
    cover = ro.covering_radius(spark.range(200), ro.hopf_rotations(spark, 2), 576, key="id").first()
    assert cover.mean < cover.p95 <= cover.max < 45


@pytest.mark.parametrize("k, n", [(1, 3000), (6, 3000), (4, 300), (3, 2)])
def test_nearest_rotations_are_the_nearest(spark, k, n):
    sets = ro.random_rotations(spark, n, 9)
    # Uneven on purpose: a third of the set is one rotation, so some rows look again in wider cells.
    sets = sets.select("qi", *[F.when(F.col("qi") % 3 == 0, v).otherwise(F.col(c)).alias(c) for c, v in zip(ro.Q, (0.5, 0.5, 0.5, 0.5))]).cache()
    asked = ro.random_rotations(spark, 40, 3).withColumnRenamed("qi", "complex_id").cache()
    got = {}
    for r in ro.nearest_rotations(asked, sets, k, n).collect():
        got.setdefault(r.complex_id, []).append((r.place, r.qi))
    pool = {r.qi: np.array([r.q1, r.q2, r.q3, r.q4]) for r in sets.collect()}
    for r in asked.collect():
        q = np.array([r.q1, r.q2, r.q3, r.q4])
        angle = {i: round(2 * math.acos(min(1.0, abs(q @ p))), 9) for i, p in pool.items()}
        want = sorted(angle, key=lambda i: (angle[i], i))[:k]
        assert [angle[i] for _, i in sorted(got[r.complex_id])] == [angle[i] for i in want]


def test_linkage_of_equal_and_near_endpoints(spark):
    """Ten thousand equal endpoints are one node; a chain is one basin, a gap parts two."""
    a = system(spark)
    rnd = random.Random(6)
    spots = [(k, 0.0) for k in range(10_000)] + [(10_000 + k, 0.9 * k) for k in range(12)] + [(20_000 + k, 100.0 + rnd.random()) for k in range(40)] + [(30_000, 104.5)]
    p = spark.createDataFrame([(1, k, 0.0, 0.0, 0.0, 1.0, x, 0.0, 0.0, float(k)) for k, x in spots],
                              "complex_id long, pose_id long, q1 double, q2 double, q3 double, q4 double, tx double, ty double, tz double, score double").repartition(6)
    label = {r.pose_id: r.label for r in se.linked_basins(p, a, 1.0).collect()}
    assert {label[k] for k, _ in spots[:10_012]} == {0} and {label[20_000 + k] for k in range(40)} == {20_000} and label[30_000] == 30_000
    basins = {r.basin: r.size for r in se.cluster_endpoints(p, a, 1.0).collect()}
    assert basins == {0: 10_012, 20_000: 40, 30_000: 1}


def test_linkage_equals_pairs(spark):
    a = system(spark)
    turned = ro.random_rotations(spark, 120, 5).collect()
    p = spark.createDataFrame([(1, r.qi, *(float(x) for x in np.array([0.15 * r.q1, 0.15 * r.q2, 0.15 * r.q3, 1.0]) / np.linalg.norm([0.15 * r.q1, 0.15 * r.q2, 0.15 * r.q3, 1.0])),
                                0.5 * r.q1, 0.0, 0.4 * r.q2) for r in turned], "complex_id long, pose_id long, q1 double, q2 double, q3 double, q4 double, tx double, ty double, tz double")
    for tol in (0.15, 0.3, 0.6):
        pairs = se.pose_pairs_within(p, a, tol)
        want = {r.pose_id: r.label for r in se.connected(p.select("complex_id", "pose_id"), pairs).collect()}
        got = {r.pose_id: r.label for r in se.linked_basins(p, a, tol).collect()}
        assert got == want and (tol > 0.15 or len(set(want.values())) > 5)


def test_cone(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, math.sin(0.3), math.cos(0.3))], "complex_id long, q1 double, q2 double, q3 double, q4 double")
    cone = ro.rotation_cone(c, 40, 15.0).collect()
    angle = [math.degrees(2 * math.acos(min(1, abs(r.q3 * math.sin(0.3) + r.q4 * math.cos(0.3))))) for r in cone]
    assert min(angle) < 1e-5 and max(angle) <= 15.0 + 1e-6 and len(cone) == 40
    assert ro.rotation_cone(c, 0).count() == 0


def test_k_center_order_is_greedy(spark):
    df = ro.random_rotations(spark, 40, 2)
    q = {r.qi: np.array([r.q1, r.q2, r.q3, r.q4]) for r in df.collect()}
    picks, gap = [0], {k: math.inf for k in q}
    for _ in range(5):
        gap = {k: min(v, 2 * math.acos(min(1, abs(q[k] @ q[picks[-1]])))) for k, v in gap.items()}
        picks.append(max((v, -k) for k, v in gap.items() if k not in picks)[1] * -1)
    assert [r.qi for r in ro.k_center_order(df, 6).orderBy("place").collect()] == picks


def test_native_pose_and_frame(spark):
    a = system(spark).filter("side = 'L'")
    q = np.array([0.2, -0.5, 0.3, 0.7])
    q /= np.linalg.norm(q)
    poses = spark.createDataFrame([(1, 0, *map(float, q), 4.0, -2.0, 1.0)], "complex_id long, pose_id long, q1 double, q2 double, q3 double, q4 double, tx double, ty double, tz double")
    placed = ro.rotate_poses(a, poses).select("atom_idx", *[F.col(c).alias(f"n{c}") for c in "xyz"])
    r = ft.native_pose(a.join(placed, "atom_idx")).first()
    assert np.allclose([r.q1, r.q2, r.q3, r.q4], q, atol=1e-9) and np.allclose([r.tx, r.ty, r.tz], [4, -2, 1], atol=1e-9)


@pytest.mark.parametrize("weights", [sc.Weights(1.0, (2.25, 3.375, 5.0625)), sc.Weights(0.5, (0.75, 1.5, 3.0), sc.flat_table(), 2.0)])
def test_search_score_equals_pose_score(spark, weights):
    a = system(spark)
    found = se.search_poses(a, ro.random_rotations(spark, 3, 1), 3, weights, h=2.0, max_shift=4, ntop=3).cache()
    whole = se.search_poses(a, ro.random_rotations(spark, 3, 1), 3, weights, h=2.0, ntop=3)
    assert whole.agg(F.max("score")).first()[0] >= found.agg(F.max("score")).first()[0] - 1e-9
    assert found.count() == 3
    scored = se.score_poses(a, found.drop("score"), weights, h=2.0)
    a_, b_ = ({r.pose_id: r.score for r in df.collect()} for df in (found, scored))
    # Moving by whole cells keeps cells; a pose near the grid edge may lose some.
    assert all(a_[k] == pytest.approx(b_[k], abs=1e-6) for k in a_)


NAMES = ["a", "b", "c"]


def lattice(spark, seed, sizes, spread, keys=("qi",), turns=2):
    """Random sparse cells on three channels, some of them missing, as tables and as dicts."""
    rnd = random.Random(seed)

    def cells(n, far):
        return {tuple(rnd.randrange(x) for x in far): [rnd.gauss(0, 1) if rnd.random() < 0.7 else None for _ in NAMES] for _ in range(n)}

    rec = {c: cells(sizes[0], spread[0]) for c in (1, 2)}
    lig = {(c, q): cells(sizes[1], spread[1]) for c in (1, 2) for q in range(turns)}
    mask = lambda v: sum(1 << i for i, x in enumerate(v) if x is not None)
    flat = lambda key, t: [(*key, *k, *[x or 0.0 for x in v], mask(v)) for k, v in t.items() if mask(v)]
    own = "ix long, iy long, iz long, a double, b double, c double, on int"
    r = spark.createDataFrame([x for c, t in rec.items() for x in flat((c,), t)], f"complex_id long, {own}")
    l = spark.createDataFrame([x for c, t in lig.items() for x in flat(c, t)], f"complex_id long, qi int, {own}")
    want = {}
    for (c, q), t in lig.items():
        for m, x in rec[c].items():
            for k, y in t.items():
                both = [u * v for u, v in zip(x, y) if u is not None and v is not None]
                if both:
                    d = (c, q, *(i - j for i, j in zip(m, k)))
                    want[d] = want.get(d, 0) + sum(both)
    return r, l, want


@pytest.mark.parametrize("spread", [((8, 6, 5), (8, 6, 5)), ((120, 20, 3), (4, 90, 70))])
def test_scan_equals_brute_force(spark, spread):
    r, l, want = lattice(spark, 2, (60, 25), spread)
    got = {(t.complex_id, t.qi, t.cx, t.cy, t.cz): t.score for t in se.translation_scan(r, l, NAMES).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert spread[0][0] == 8 or max(abs(x) for k in want for x in k[2:]) > 40
    near = {k for k in want if max(map(abs, k[2:])) <= 3}
    assert {(t.complex_id, t.qi, t.cx, t.cy, t.cz) for t in se.translation_scan(r, l, NAMES, 3).collect()} == near


def test_a_scan_key_holds_one_pair_of_blocks(spark):
    r, l, _ = lattice(spark, 3, (400, 50), ((100, 100, 100), (40, 40, 40)))
    blocks = r.withColumn("rb", se._packed_block()).groupBy("complex_id", "rb").count()
    assert blocks.count() > 300 and blocks.agg(F.max("count")).first()[0] <= se.BLOCK ** 3


@pytest.mark.parametrize("spread, per, ntop", [(((8, 6, 5), (8, 6, 5)), 1, 1), (((30, 20, 9), (6, 30, 30)), 3, 4), (((90, 20, 3), (4, 60, 70)), 2, 100)])
def test_bounds_leave_the_best(spark, spread, per, ntop):
    r, l, want = lattice(spark, 5, (300, 30), spread)
    bounds = {(t.complex_id, t.qi, t.dx, t.dy, t.dz): t.bound for t in se.shift_bounds(r, l, NAMES).collect()}
    assert all(bounds[(*k[:2], *(x // se.SHIFTS for x in k[2:]))] >= v - 1e-9 for k, v in want.items())
    by = {}
    for k, v in sorted(want.items(), key=lambda x: (-x[1], x[0][2:])):
        by.setdefault(k[:2], []).append((k, v))
    for c in (1, 2):
        best = sorted((x for k, t in by.items() if k[0] == c for x in t[:per]), key=lambda x: (-x[1], x[0][1:]))[:ntop]
        got = se.best_translations(r.filter(F.col("complex_id") == c), l, NAMES, per, ntop).orderBy("rank").collect()
        assert [(t.complex_id, t.qi, t.cx, t.cy, t.cz) for t in got] == [k for k, _ in best]


def test_bounds_spare_most_of_a_scan(spark):
    """One good place among many poor ones: the blocks that cannot reach it are not scanned."""
    r = spark.createDataFrame([(1, x, y, 0, 5.0 if x == y == 30 else 0.1, 0.0, 0.0, 1) for x in range(0, 64) for y in range(0, 64)],
                              "complex_id long, ix long, iy long, iz long, a double, b double, c double, on int")
    l = spark.createDataFrame([(1, 0, 5, 5, 5, 1.0, 0.0, 0.0, 1)], "complex_id long, qi int, ix long, iy long, iz long, a double, b double, c double, on int")
    bounds = se.shift_bounds(r, l, NAMES)
    assert bounds.filter("bound >= 5").count() <= 9 < bounds.count() / 10
    best = se.best_translations(r, l, NAMES, 1, 1).first()
    assert (best.cx, best.cy, best.cz, best.score) == (25, 25, -5, 5.0)


def refined(spark, **how):
    a = system(spark)
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0, 4.0, 0.0, 0.0), (1, 1, 0.5, 0.5, 0.5, 0.5, 3.0, 1.0, -2.0), (1, 2, 0.0, 0.0, 0.0, 1.0, 900.0, 0.0, 0.0)],
                              "complex_id long, pose_id long, q1 double, q2 double, q3 double, q4 double, tx double, ty double, tz double")
    return a, p, se.pattern_refine(a, p, sc.Weights(0.5, (0.75, 1.5, 3.0), sc.flat_table(), 2.0), h=2.0, **how)


def test_refinement_ends_and_scores_its_poses(spark):
    a, p, r = refined(spark)
    got = {t.pose_id: t for t in r.collect()}
    assert all(t.score >= t.start_score and t.deg <= 0.05 for t in got.values()) and len(got) == 3
    again = {t.pose_id: t.score for t in se.score_poses(a, r.drop("score"), sc.Weights(0.5, (0.75, 1.5, 3.0), sc.flat_table(), 2.0), h=2.0).collect()}
    assert all(again[k] == pytest.approx(t.score, abs=1e-6) for k, t in got.items())
    assert got[2].score == 0.0 and got[2].tx == 900.0
    # The step sizes tried together are the ones tried one after the other.
    one = {t.pose_id: t for t in refined(spark, levels=1)[2].collect()}
    for k, t in got.items():
        assert [t[c] for c in ("score", "deg", "q1", "q4", "tx")] == pytest.approx([one[k][c] for c in ("score", "deg", "q1", "q4", "tx")], abs=1e-9)


def test_a_refinement_step_is_the_best_of_twelve(spark):
    a, p, r = refined(spark, rounds=1, levels=1)
    w = sc.Weights(0.5, (0.75, 1.5, 3.0), sc.flat_table(), 2.0)
    moves = ro.axis_probes(ro.placed_centroid(p, a), 4.0, 1.0).withColumn("old", F.col("pose_id")).withColumn("pose_id", F.col("pose_id") * 16 + F.col("probe"))
    tried = se.score_poses(a, moves.select("complex_id", "pose_id", "old", "q1", "q2", "q3", "q4", "tx", "ty", "tz"), w, h=2.0).groupBy("old").agg(F.max("score").alias("best"))
    best = {t.old: t.best for t in tried.collect()}
    for t in r.collect():
        assert t.score == pytest.approx(max(best[t.pose_id], t.start_score), abs=1e-6)
        assert t.deg == (4.0 if best[t.pose_id] > t.start_score + 1e-9 else 2.0)


def test_a_refinement_writes_nothing_between_its_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(se, "cut", lambda df, cut=se.cut: cuts.append(df.columns) or cut(df))
    assert refined(spark)[2].filter("deg <= 0.05").count() == 3 and len(cuts) <= 1


@pytest.mark.parametrize("bound", ["GROUP_ATOMS", "GROUP_CELLS", "GROUP_POSES"])
def test_large_complexes_and_blocks_of_poses_are_refined_alike(spark, monkeypatch, bound):
    """By joins, in groups, or in blocks of one pose: the same poses and scores."""
    want = [tuple(t) for t in refined(spark)[2].orderBy("pose_id").collect()]
    monkeypatch.setattr(se, bound, 1)
    got = [tuple(t) for t in refined(spark)[2].orderBy("pose_id").collect()]
    assert len(got) == 3 and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(got, want))


def test_components(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(8)], "complex_id long, pose_id long")
    edges = spark.createDataFrame([(1, 7, 6), (1, 6, 5), (1, 5, 4), (1, 2, 1)], "complex_id long, i long, j long")
    got = {r.pose_id: r.label for r in se.connected(nodes, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 4}


def test_the_best_sample_is_the_smaller_id_of_equal_scores(spark, monkeypatch):
    from posefarm.operators import diagnostics as dg

    # 0.1 + 0.2 and 0.3 are one score in two roundings; sample 0 has the lower one.
    score = F.when(F.col("pose_id") < 0, 0.0).when(F.col("pose_id") == 0, 0.3).otherwise(F.lit(0.1) + F.lit(0.2))
    seen = []
    monkeypatch.setattr(dg, "score_poses", lambda atoms, rows, *how: seen.append(rows) or rows.withColumn("score", score))
    a = system(spark).select("*", *[F.col(c).alias(f"n{c}") for c in "xyz"])
    home = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "complex_id long, q1 double, q2 double, q3 double, q4 double, tx double, ty double, tz double")
    best = dg.near_native_landscape(a, home, sc.Weights(0.0, (0.0, 0.0, 0.0), (0.0,) * 144), 3, 20.0, 2.0).first()
    assert best["offset"] == pytest.approx(dg.dockq(seen[0], a).filter("pose_id = 0").first()["l_rmsd"])


def _exported(spark, n_poses=3, moved=0.0, side="L"):
    atoms = [(1, s, i, float(i), 0.0, 1.0, float(i) + 2.0 + (moved if (s, i) == ("R", 1) else 0.0), 2.0, 3.0, "ALA", "CA", 1)
             for s, n in (("R", 3), (side, 2)) for i in range(n)]
    a = spark.createDataFrame(atoms, "complex_id long, side string, atom_idx int, x double, y double, z double, nx double, ny double, nz double, res_name string, atom_name string, res_seq int")
    p = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 0.0, 1.0, 10.0 * i, 0.0, 0.0) for i in range(n_poses)],
                              "complex_id long, pose_id long, score double, q1 double, q2 double, q3 double, q4 double, tx double, ty double, tz double")
    from posefarm.sources import export
    return export.top_k_lines(p, a, 2)


def test_every_atom_of_the_top_poses_is_one_line_by_few_joins(spark):
    lines = _exported(spark)
    got = rows(lines, "rank", "line_no")
    assert [(r[1], r[2], float(r[3][30:38])) for r in got] == [
        (k, i, x) for k, t in ((1, 20.0), (2, 10.0)) for i, x in enumerate((0.0, 1.0, 2.0, t, t + 1.0), 1)]
    # Each join of this plan sorts both sides in one task, a memory page at least for each.
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines()) <= 2


@pytest.mark.parametrize("how,says", [({"n_poses": 1}, "fewer than k"), ({"moved": 0.1}, "receptor moved"), ({"side": "X"}, "atom count differs")])
def test_an_export_that_is_not_whole_ends_the_job(spark, how, says):
    with pytest.raises(Exception, match=says):
        _exported(spark, **how).collect()
