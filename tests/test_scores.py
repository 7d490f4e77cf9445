"""Scores, statistics, labels and losses against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from posefarm.functions import fixed
from posefarm.functions.columns import erfc, log_gamma
from posefarm.operators import fitting as fi
from posefarm.operators import losses as lo
from posefarm.operators import quality as ql
from posefarm.operators import ranking as rk
from posefarm.operators import scoring as sc
from posefarm.operators import statistics as st

POOL = "complex_id string, pose_id long, score double, dockq double, rmsd double"


def pool(spark, scores, quality):
    return spark.createDataFrame([("A", i, float(s), float(q), 3.0) for i, (s, q) in enumerate(zip(scores, quality))], POOL)


def test_fixed_tables():
    assert len(fixed.atom_type_rows()) == 167 and len(set(r[1:] for r in fixed.atom_type_rows())) == 167
    assert all(fixed.PAIR_TABLE[i][j] == fixed.PAIR_TABLE[j][i] for i in range(12) for j in range(12))


def test_auc_and_first_hit(spark):
    p = pool(spark, [1, 2, 2, 3], [0, 0, 0.9, 0.9])
    assert rows(rk.auc_midrank(p)) == [("A", 0.875)]
    assert rows(rk.first_hit(pool(spark, [3, 2, 1], [0, 0, 0.5]))) == [("A", 3, 3, 1.0)]
    assert rows(rk.first_hit(pool(spark, [3, 2, 1], [0, 0, 0]))) == [("A", 3, 4, 4 / 3)]
    assert rows(rk.auc_midrank(pool(spark, [1, 2], [0, 0]))) == [("A", None)]


def test_mcnemar(spark):
    def p(b01, b10):
        data = [(0, 1)] * b01 + [(1, 0)] * b10 + [(1, 1)] * 3
        return st.mcnemar_exact(spark.createDataFrame(data, "a_ok int, b_ok int")).first()["p"]

    assert p(9, 1) == pytest.approx(0.021484375, abs=1e-12)
    assert p(0, 0) == 1.0
    exact = 2 * sum(math.comb(150, i) for i in range(61)) / 2 ** 150
    assert p(90, 60) == pytest.approx(exact, rel=1e-9)
    assert p(5, 5) == 1.0


def test_wilcoxon(spark):
    d = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, -6, 0)], "d double")
    r = st.wilcoxon_signed_rank(d).first()
    assert (r.n, r.w_plus, r.w_minus, r.w) == (6, 15.0, 6.0, 6.0)
    assert r.z == pytest.approx(4.0 / math.sqrt(22.75))
    assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-6)
    few = st.wilcoxon_signed_rank(d.limit(3)).first()
    assert few.z is None


def test_holm(spark):
    t = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "id long, p double")
    assert [round(r[0], 9) for r in st.holm_adjust(t).orderBy("id").select("p_adj").collect()] == [0.03, 0.04, 0.06]
    assert [round(r[0], 9) for r in st.holm_adjust(t, monotone=True).orderBy("id").select("p_adj").collect()] == [0.03, 0.06, 0.06]


def test_special_functions(spark):
    df = spark.range(1).select(*[erfc(F.lit(x)).alias(f"e{i}") for i, x in enumerate((-1.0, 0.0, 0.7, 4.0))],
                               *[log_gamma(F.lit(x)).alias(f"g{i}") for i, x in enumerate((1.0, 5.5, 1000.0))]).first()
    for i, x in enumerate((-1.0, 0.0, 0.7, 4.0)):
        assert df[f"e{i}"] == pytest.approx(math.erfc(x), rel=2e-7)
    for i, x in enumerate((1.0, 5.5, 1000.0)):
        assert df[f"g{i}"] == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-9)


def tiny(spark):
    rec = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (5, 0, 0)]
    lig = [(2.5, 0, 0), (2.5, 1, 0), (3, 0, 1)]
    data = [("A", "R", i, *map(float, p), *map(float, p)) for i, p in enumerate(rec)]
    data += [("A", "L", i, *map(float, p), *map(float, p)) for i, p in enumerate(lig)]
    return spark.createDataFrame(data, "complex_id string, side string, atom_idx int, x double, y double, z double, nx double, ny double, nz double")


def moved(spark, *shifts):
    return spark.createDataFrame([("A", i, 0.0, 0.0, 0.0, 1.0, *map(float, s)) for i, s in enumerate(shifts)],
                                 "complex_id string, pose_id long, q1 double, q2 double, q3 double, q4 double, tx double, ty double, tz double")


def test_quality_of_the_tiny_complex(spark):
    got = ql.dockq(moved(spark, (0, 0, 0), (50, 0, 0), (0.5, 0.5, 0), (1.2, -0.4, 0.7)), tiny(spark)).orderBy("pose_id").collect()
    assert got[0].fnat == 1.0 and got[0].dockq == pytest.approx(1.0) and got[0].l_rmsd == pytest.approx(0.0, abs=1e-6)
    assert got[1].fnat == 0.0 and got[1].dockq < 0.23
    assert 0.23 <= got[2].dockq < 1
    r = got[3]
    assert r.l_rmsd == pytest.approx(math.sqrt(1.2 ** 2 + 0.4 ** 2 + 0.7 ** 2))
    assert r.dockq == pytest.approx((r.fnat + 1 / (1 + (r.i_rmsd / 1.5) ** 2) + 1 / (1 + (r.l_rmsd / 8.5) ** 2)) / 3)


def test_quality_without_native_contacts(spark):
    a = tiny(spark)
    for c in ("x", "nx"):
        a = a.withColumn(c, F.when(F.col("side") == "L", F.col(c) + 100).otherwise(F.col(c)))
    r = ql.dockq(moved(spark, (0, 0, 0)), a).first()
    assert (r.n_native, r.fnat) == (0, 0.0) and r.dockq == pytest.approx(1.0)


def test_tier_edges(spark):
    df = spark.createDataFrame([(q,) for q in (0.0, 0.2299, 0.23, 0.49, 0.7999, 0.80, 1.0)], "q double")
    assert [r[0] for r in df.select(ql.quality_tier(F.col("q"))).collect()] == [0, 0, 1, 2, 2, 3, 3]


def test_top_tail_properties(spark):
    def loss(s, q, **k):
        return lo.top_tail_loss(pool(spark, s, q), "score", **k).first()["loss"]

    assert loss(range(20), [0] * 20) == 0 and loss(range(20), [0.9] * 20) == 0
    q = [0.9, 0.5] + [0] * 30
    base = [0, -1, 2] + [-3] * 29
    assert loss([5, -1, 2] + [-3] * 29, q) < loss(base, q)
    deep = loss([1] + [2] * 5 + [-5] * 195, [0.9] + [0] * 200, k=5)
    assert deep == pytest.approx(loss([1] + [2] * 5, [0.9] + [0] * 5, k=5))
    q2 = [0.9, 0.3] + [0] * 30
    near, far = [3, 1] + [0] * 30, [3, -8] + [0] * 30
    assert abs(loss(near, q2) - loss(far, q2)) < 0.2
    m = [lo.margin_loss(pool(spark, s, q2), "score").first()["loss"] for s in (near, far)]
    assert m[1] - m[0] > 1


def test_shape_pairwise_saturates(spark):
    near = pool(spark, [1, 2, 3], [0.0, 0.0, 0.0])
    assert lo.shape_pairwise_loss(near, "score").first()["loss"] == 0
    good = [lo.shape_pairwise_loss(pool(spark, [1, 2], [q, 0.0]), "score").first()["loss"] for q in (0.23, 0.8)]
    assert good[0] == pytest.approx(good[1])


def feature_pool(spark, dead=False):
    data = []
    for c in range(3):
        for i in range(12):
            q = 0.9 if (i % 5 == 0 and not dead) else 0.01 * i
            data.append((c, i, float(i * 7 % 5), float(i % 3), float(i % 2), float(i % 4 == 0), [math.sin(i + c), math.cos(2 * i + c)], 0.1 * i, q))
    return spark.createDataFrame(data, "complex_id long, pose_id long, c_pair double, n_ss double, n_sc double, n_cc double, t array<double>, elec double, dockq double")


@pytest.mark.parametrize("obj,dead", [
    (lo.Objective(), False), (lo.Objective(negatives="toptail", top_k=4), False), (lo.Objective(lambda_shape=1.0, basin=False, negatives="none"), True)])
def test_gradient_matches_differences(spark, obj, dead):
    p = feature_pool(spark, dead).cache()
    start = [1.0, 0.3, 0.4, 0.5, 0.7, -0.6]

    def weights(v):
        return sc.Weights(v[0], tuple(v[1:4]), tuple(v[4:6]), 2.0)

    def value(v):
        return fi.objective_value(p, weights(v), obj).first()["loss"]

    got = {r["k"]: r["grad"] for r in fi.mean_gradient(p, weights(start), obj, 2).collect()}
    for k, sign in ((0, 1), (2, -1), (4, -1)):
        up, down = list(start), list(start)
        up[k] += 1e-5
        down[k] -= 1e-5
        assert sign * got[k] == pytest.approx((value(up) - value(down)) / 2e-5, abs=2e-4)
    p.unpersist()


def test_fits_improve(spark):
    p = feature_pool(spark).cache()
    model = fi.Model(1.0, 1.2, [0.7, -0.6], 2.0)
    got = fi.fit_adam(p, p, model, cfg=fi.AdamConfig(steps=6, val_every=2, table_lr=0.1, alpha_lr=0.05, rho_lr=0.02, min_delta=0.0))
    losses = [x["validation"] for x in got.trajectory]
    assert min(losses) < losses[0]
    a = fi.affine_pool(p, sc.Weights(1.0, (0.3, 0.4, 0.5), beta=2.0)).cache()
    e, history = fi.hinge_fit(a, [0.7, -0.6], 0.1)
    assert min(history) < history[0]
    spot = fi.anchors(a, [0.7, -0.6])
    worth = lambda x: fi.hinge_value(a, spot, x).first()["hinge"] + 0.05 * sum((p - q) ** 2 for p, q in zip(x, (0.7, -0.6)))
    assert abs(worth(e) - min(history)) < 1e-9
    for dx, dy in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02), (0.3, -0.2), (-1, 1)):
        assert worth([e[0] + dx, e[1] + dy]) > min(history) - 2e-6
    many = fi.hinge_fit_many(a, [0.7, -0.6], {"all": (0.1, F.lit(True))})
    assert abs(worth(many["all"]) - min(history)) < 4e-6
    p.unpersist(), a.unpersist()


def test_a_batch_sends_on_the_hardest_negative_of_each_complex(spark):
    import pyarrow as pa
    rows = [(7, 3, 1.0, [1.0, 0.0], True), (7, 2, 1.0, [1.0, 0.0], True), (7, 1, 0.0, [0.0, 1.0], True), (9, 5, 0.0, [2.0, 2.0], False), (9, 4, 9.0, [0.0, 0.0], False)]
    batch = pa.RecordBatch.from_pylist([{"complex_id": c, "pose_id": p, "c": k, "f": f, "_use0": True, "_use1": u} for c, p, k, f, u in rows])
    out, = fi._worst(np.array([[1.0, 0.0], [0.0, 5.0]]), ["_job", "complex_id", "pose_id", "f", "_s"])([batch])
    assert [tuple(r.values())[:3] + (r["_s"],) for r in out.to_pylist()] == [(0, 7, 2, 2.0), (0, 9, 4, 9.0), (1, 7, 1, 5.0)]
    a = fi.affine_pool(feature_pool(spark), sc.Weights(1.0, (0.3, 0.4, 0.5), beta=2.0)).cache()
    spot = fi.anchors(a, [0.7, -0.6])
    jobs = {"all": ([0.1, 0.2], F.lit(True)), "even": ([0.4, -0.9], F.col("complex_id") % 2 == 0)}
    got = fi._batched_hinge(fi._by_complex(a), jobs, spot, 1.0)
    for name, (e, use) in jobs.items():
        want = fi.hinge_value(a.filter(use), spot, e).first()
        assert got[name][0] == pytest.approx(want["hinge"]) and got[name][1] == pytest.approx(list(want["slope"]))
    a.unpersist()


def test_negatives_are_packed_and_a_pass_sees_all_of_them(spark, monkeypatch):
    import pyarrow as pa
    rnd = np.random.default_rng(8)
    # One complex of many packed rows; ties go to the smaller pose, poses without a score are never the hardest.
    rows_ = [(c, p, float(rnd.integers(-9, 9)), [float(x) for x in rnd.integers(-3, 4, 3)], bool(p % 7 == 0), c % 2) for c in range(6) for p in range(900 if c == 4 else 20)]
    rows_ += [(0, 900, None, [1.0, 1.0, 1.0], False, 0), (1, 901, 99.0, None, False, 1), (2, 902, 99.0, [None, 1.0, 1.0], False, 0), (3, None, 1.0, [0.0, 0.0, 0.0], False, 1)]
    kind = "complex_id long, pose_id long, c double, f array<double>, pos boolean, fold int"
    a = spark.createDataFrame(rows_, kind).repartition(7)
    packed = fi._by_complex(a)
    assert packed.count() < 60 and packed.agg(F.sum(F.size("pose_id"))).first()[0] == sum(not r[4] for r in rows_) - 2
    jobs = {"all": ([0.5, -0.25, 2.0], F.lit(True)), "odd": ([0.0, 0.0, 0.0], F.col("fold") == 1)}
    spot = fi.anchors(a, [0.0, 0.0, 0.0])
    got = fi._batched_hinge(packed, jobs, spot, 1.0)
    scored = a.filter("c is not null and f[0] is not null")
    for name, (e, use) in jobs.items():
        want = fi.hinge_value(scored.filter(use), spot, e).first()
        assert got[name][0] == pytest.approx(want["hinge"]) and got[name][1] == pytest.approx(list(want["slope"]))
    monkeypatch.setattr(fi, "PACKED", 100)
    monkeypatch.setattr(fi, "POSES", 7)
    flat = pa.RecordBatch.from_pylist([dict(zip(("complex_id", "pose_id", "c", "f", "fold"), (*r[:4], r[5]))) for r in rows_ if r[2] is not None and r[3] is not None])
    again = [r for b in fi._poses(fi._packed([flat.slice(0, 0), flat.slice(3)]), 3) for r in b.to_pylist()]
    assert all(len(b) <= 3 + 7 for b in fi._poses(fi._packed([flat]), 3))
    assert [(r["complex_id"], r["pose_id"], r["c"], r["fold"]) for r in again] == [(r["complex_id"], r["pose_id"], r["c"], r["fold"]) for r in flat.slice(3).to_pylist()]
    assert [[x if x == x else None for x in r["f"]] for r in again] == [r["f"] for r in flat.slice(3).to_pylist()]


def test_a_pose_is_one_row_when_settings_count_their_best(spark):
    a = fi.affine_pool(feature_pool(spark), sc.Weights(1.0, (0.3, 0.4, 0.5), beta=2.0))
    settings = {str(k): [0.1 * k, -0.2] for k in range(4)}
    table = fi.top1_table(a, settings)
    for name, e in settings.items():
        assert table.filter(F.col("setting") == name).collect() == fi.top1_table(a, {name: e}).collect()
    # The settings fan out after the best pose of a complex is known.
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("max_by")


def test_pair_table_order(spark):
    """An asymmetric table tells (ligand, receptor) from its transpose."""
    table = [[float(10 * i + j) for j in range(12)] for i in range(12)]
    pairs = spark.createDataFrame([("A", 0, 3, 7, 1.0)], "complex_id string, pose_id long, i int, j int, n double")
    packed = sc.pack_pairs(pairs)
    scored = sc.linear_score(packed, sc.Weights(0.0, (0, 0, 0), sc.flat_table(table)))
    assert scored.first()["score"] == -table[2][6]


def test_bases():
    assert len(sc.additive_basis(12)) == 23 and len(sc.symmetric_additive_basis(12)) == 12


def capacity_rows(spark, complexes=8, poses=12):
    rnd = np.random.default_rng(4)
    rows = []
    for c in range(complexes):
        for p in range(poses):
            t = [float(x) for x in rnd.integers(0, 4 + c, 4)]
            rows.append((c, p, *[float(x) for x in rnd.integers(0, 9, 4)], t, float(rnd.normal()), 0.6 if p % 4 == 0 else 0.1))
    return spark.createDataFrame(rows, "complex_id long, pose_id long, c_pair double, n_ss double, n_sc double, n_cc double, t array<double>, elec double, dockq double")


def test_families_of_the_capacity_study(spark):
    pool, w = capacity_rows(spark), sc.Weights(0.5, (0.1, 0.2, 0.4), (0.3, -0.2, 0.1, 0.05), 2.0)
    assert {n: f.size(144) for n, f in fi.capacity_families().items()} == {"shape": 5, "sym": 12, "add": 23, "full": 144, "full+": 149, "bucket2": 288, "bucket4": 576}
    edges = fi.size_edges(pool, 2)
    sizes = {r.complex_id: r["size"] for r in fi.complex_sizes(pool).collect()}
    plain = {}
    for r in pool.collect():
        plain.setdefault(r.complex_id, []).append(sum(r.t))
    assert sizes == {c: sorted(v)[(len(v) - 1) // 2] for c, v in plain.items()} and edges == [pytest.approx(np.quantile(list(sizes.values()), 0.5))]
    raw = {(r.complex_id, r.pose_id): r for r in pool.collect()}
    step = [0.1 * k for k in range(1, 14)]
    for family in (fi.Family(table=False, shape=True), fi.Family(shape=True), fi.Family(buckets=2)):
        d = family.size(4)
        for r in fi.family_pool(pool, w, family, edges if family.buckets > 1 else ()).collect():
            x = raw[r.complex_id, r.pose_id]
            shape = [x.c_pair, -x.n_ss, -x.n_sc, -x.n_cc, x.elec]
            table = [-v for v in x.t]
            if family.buckets > 1:
                table = [0.0] * 4 + table if sizes[r.complex_id] > edges[0] else table + [0.0] * 4
            want = (table if family.table else []) + (shape if family.shape else [])
            assert len(r.f) == d and r.f == pytest.approx(want)
            published = 0.5 * x.c_pair - 0.1 * x.n_ss - 0.2 * x.n_sc - 0.4 * x.n_cc - sum(a * b for a, b in zip((0.3, -0.2, 0.1, 0.05), x.t)) + 2.0 * x.elec
            assert r.c == pytest.approx(published) and len(step) >= d


def test_learning_curve_chooses_lambda_on_the_fitted_set(spark):
    pool, w = capacity_rows(spark), sc.Weights(0.5, (0.1, 0.2, 0.4), (0.3, -0.2, 0.1, 0.05), 2.0)
    folds = pool.select("complex_id").distinct().withColumn("fold", (F.col("complex_id") % 2).cast("int"))
    family = fi.Family(table=False, shape=True)
    got = fi.learning_curve(pool, pool, w, {"shape": family}, (4, 8), 2, (0.01, 1.0), folds, 2, tol=1e-2).collect()
    table, _ = fi.lambda_path_cv(fi.family_pool(pool, w, family), folds, [0.0] * 5, (0.01, 1.0), 2, tol=1e-2)
    top = {r.lam: r.top1 for r in table.collect()}
    assert {r["size"] for r in got} == {4, 8} and {r.lam for r in got} == {0.01 if top[0.01] >= top[1.0] else 1.0} and all(0 <= r.top1 <= 1 for r in got)


def test_a_step_reads_only_its_buckets(spark):
    rows, ids, n = fi.bucketed_pool(capacity_rows(spark, 40, 4), 4)
    few = rows.join(ids.filter("complex_id = 7"), ["bucket", "complex_id"])
    assert n == 40 and few.count() == 4 and ids.select("bucket").distinct().count() > 4
    assert "dynamicpruning" in few._jdf.queryExecution().executedPlan().toString()


def test_one_bucket_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(fi, "STORED_ROWS", 20, raising=False)
    joined, pool = "spark.sql.adaptive.coalescePartitions.enabled", capacity_rows(spark, 40, 4)
    spark.conf.set(joined, "false")
    rows, _, n = fi.bucketed_pool(pool, 1 << 40)
    spark.conf.unset(joined)
    assert n == 40 and len(rows.inputFiles()) > 1 and rows.select("bucket").distinct().count() == 1
    assert sorted(rows.select(pool.columns).collect()) == sorted(pool.collect())


def test_equal_scores_go_to_the_smaller_pose_id_whatever_their_last_bits(spark):
    # 0.1 + 0.2 and 0.3 + 0.0 are one score in two roundings.
    rows_ = [(1, 1, [0.1, 0.2], 0.9), (1, 2, [0.3, 0.0], 0.0), (1, 3, [5.0, 0.0], 0.0)]
    pool = spark.createDataFrame(rows_, "complex_id long, pose_id long, t array<double>, dockq double")
    w = sc.Weights(0.0, (0.0, 0.0, 0.0), (1.0, 1.0))
    assert fi.ranking_shift(pool, {"0": w}).first()["top1"] == 1
    assert fi.top1_count(pool, w).first()["top1"] == 1


def test_the_anchor_of_the_margin_is_the_smaller_id_of_equal_scores(spark):
    # Poses 1 and 2 score the same in two roundings, of which the second is lower; in the other pool it is clearly higher.
    obj = lo.Objective(basin=False, negatives="minanchor", lambda_prior=0.0)
    w = sc.Weights(0.0, (0.0, 0.0, 0.0), (1.0, 1.0))
    grads = []
    for second in ([0.1, 0.2], [0.1, 0.1999]):
        pool = spark.createDataFrame([(1, 1, [0.3, 0.0], 0.9), (1, 2, second, 0.9), (1, 3, [0.0, 0.2], 0.0)],
                                     "complex_id long, pose_id long, t array<double>, dockq double")
        grads.append(fi.complex_gradients(pool, w, obj, 2).first()["grad"])
    assert np.allclose(grads[0], grads[1], atol=1e-2) and np.abs(grads[0]).max() > 1e-3


def test_a_pose_is_one_row_with_all_its_scores_when_rankings_are_compared(spark):
    rows_ = [(c, i, [float(i * (c + 1) % 5), float(i % 3)], 0.9 if i == c else 0.0) for c in range(3) for i in range(4)]
    pool = spark.createDataFrame(rows_, "complex_id long, pose_id long, t array<double>, dockq double")
    settings = {str(k): sc.Weights(0.0, (0.0, 0.0, 0.0), (1.0, float(k))) for k in range(3)}
    shift = fi.ranking_shift(pool, settings)
    assert shift.count() == 3
    # The best scores and ranks of a complex are made from one row a pose, and meet its poses once.
    plan = shift._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines()) <= 2
    assert sum(line.lstrip(" :+-").startswith("Generate") for line in plan.splitlines()) <= 1
