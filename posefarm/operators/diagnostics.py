"""Diagnostics on poses and terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.functions.columns import apply_matrix, dot, geodesic_deg, rotation_matrix
from posefarm.functions.ordering import lower_median, quantiles_linear
from posefarm.operators import rotations as rot
from posefarm.operators.quality import dockq, ligand_rmsd, quality_tier
from posefarm.operators.ranking import auc_midrank
from posefarm.operators.scoring import Weights, settled, term_columns
from posefarm.operators.search import score_poses, search_poses
from posefarm.session import cut

C = "complex_id"
THRESHOLD = fixed.TIERS[0]
Q = ["q1", "q2", "q3", "q4"]
T = ["tx", "ty", "tz"]


def _positive(q_thr: float = THRESHOLD) -> Column:
    return F.col("dockq") >= q_thr


def term_discrimination(pool: DataFrame, terms: Mapping[str, Column], balance: tuple[str, str] | None = None,
                        combine: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """Per complex and term: mean magnitude, AUC, and AUC with the sign turned.

    ``balance`` names two terms; a combined term weighs them to equal mean magnitude.
    ``combine`` adds fixed weightings of the terms, in their order.
    """
    rows = pool.select(C, "pose_id", "dockq", *[v.alias(f"_t_{k}") for k, v in terms.items()])
    named = [F.struct(F.lit(k).alias("term"), F.col(f"_t_{k}").alias("value")) for k in terms]
    if balance:
        a, b = (F.col(f"_t_{k}") for k in balance)
        means = rows.groupBy(C).agg(F.avg(F.abs(a)).alias("_ma"), F.avg(F.abs(b)).alias("_mb"))
        rows = rows.join(means, C)
        alpha = F.col("_mb") / F.greatest(F.col("_ma"), F.lit(1e-12))
        named.append(F.struct(F.lit("balanced").alias("term"), (alpha * a + b).alias("value")))
    for label, ws in (combine or {}).items():
        total = F.lit(0.0)
        for w, k in zip(ws, terms):
            total = total + float(w) * F.col(f"_t_{k}")
        named.append(F.struct(F.lit(label).alias("term"), total.alias("value")))
    long = rows.select(C, "pose_id", "dockq", F.inline(F.array(*named)))
    size = long.groupBy(C, "term").agg(F.avg(F.abs("value")).alias("mean_abs"))
    auc = auc_midrank(long, "value", _positive(), [C, "term"])
    # Turning the sign mirrors every pair, so the flipped AUC is the complement.
    return size.join(auc, [C, "term"]).withColumn("auc_flipped", 1.0 - F.col("auc"))


def balanced_alpha(pool: DataFrame, shape: Column, pair: Column) -> DataFrame:
    """Weight of the shape term that gives both terms the same mean magnitude, per complex."""
    return pool.groupBy(C).agg((F.avg(F.abs(pair)) / F.greatest(F.avg(F.abs(shape)), F.lit(1e-12))).alias("alpha_balanced"))


def matched_band(pool: DataFrame, by: str) -> DataFrame:
    """Rows in the range of ``by`` that both classes reach, with the band and class counts."""
    pos = _positive()
    v = F.col(by)
    band = pool.groupBy(C).agg(
        F.greatest(F.min(F.when(pos, v)), F.min(F.when(~pos, v))).alias("band_lo"),
        F.least(F.max(F.when(pos, v)), F.max(F.when(~pos, v))).alias("band_hi"),
        F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_n")).filter((F.col("_p") > 0) & (F.col("_n") > 0)).drop("_p", "_n")
    return pool.join(band, C).filter(v.between(F.col("band_lo"), F.col("band_hi")))


def matched_band_auc(pool: DataFrame, by: str, scores: Sequence[str], least: int = 15) -> DataFrame:
    """AUC inside the matched band per complex and score; NULL with fewer than ``least`` rows of a class."""
    rows = matched_band(pool, by)
    pos = _positive()
    sizes = rows.groupBy(C).agg(F.max("band_lo").alias("band_lo"), F.max("band_hi").alias("band_hi"),
                                F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"))
    out = sizes
    ok = (F.col("n_pos") >= least) & (F.col("n_neg") >= least)
    for s in scores:
        auc = auc_midrank(rows, s, pos, name=f"auc_{s}")
        out = out.join(auc, C, "left").withColumn(f"auc_{s}", F.when(ok, F.col(f"auc_{s}")))
    return out


def burial_separation(pool: DataFrame, contacts: str = "contacts") -> DataFrame:
    """Per complex: share of negatives within the positives' contact range, ratio of the
    (lower) medians, and whether the ranges are disjoint."""
    pos, v = _positive(), F.col(contacts)
    ends = pool.groupBy(C).agg(F.min(F.when(pos, v)).alias("_lo"), F.max(F.when(pos, v)).alias("_hi"),
                               F.max(F.when(~pos, v)).alias("_nhi"), F.min(F.when(~pos, v)).alias("_nlo"))
    inside = pool.filter(~pos).select(C, v.alias("_v")).join(ends, C).groupBy(C).agg(
        F.avg(F.col("_v").between(F.col("_lo"), F.col("_hi")).cast("int")).alias("inside"))
    classes = pool.select(C, pos.alias("_pos"), v.alias("_v"))
    med = lower_median(classes, [C, "_pos"], "_v", "_m")
    mp = med.filter("_pos").select(C, F.col("_m").alias("_mp"))
    mn = med.filter(~F.col("_pos")).select(C, F.col("_m").alias("_mn"))
    j = ends.join(inside, C).join(mp, C).join(mn, C)
    ratio = F.when(F.col("_mn") != 0, F.col("_mp") / F.col("_mn"))
    return j.select(C, "inside", ratio.alias("median_ratio"),
                    ((F.col("_nhi") < F.col("_lo")) | (F.col("_nlo") > F.col("_hi"))).cast("int").alias("disjoint"))


def _as_poses(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(C, F.col(key).cast("long").alias("pose_id"), *Q, *T)


def rotation_ceiling(atoms: DataFrame, complexes: DataFrame, rotations: DataFrame, n_rotations: int, h: float) -> DataFrame:
    """Quality of the nearest grid rotation with the exact, the snapped and the centroid
    translation, next to its angle."""
    near = rot.nearest_rotations(complexes, rotations, 1, n_rotations).select(C, "qi", "angle", *[F.col(q).alias(f"g{q}") for q in Q])
    j = near.join(complexes.select(C, *Q, *T), C)
    c = atoms.filter(F.col("side") == "L").groupBy(C).agg(*[F.avg(a).alias(f"_c{a}") for a in "xyz"],
                                                          *[F.avg(f"n{a}").alias(f"_m{a}") for a in "xyz"])
    j = j.join(c, C)
    grid_q = [F.col(f"g{q}") for q in Q]
    turned = apply_matrix(rotation_matrix(grid_q), [F.col(f"_c{a}") for a in "xyz"])
    kinds = {
        0: [F.col(t) for t in T],
        1: [F.rint(F.col(t) / h) * h for t in T],
        2: [F.col(f"_m{a}") - m for a, m in zip("xyz", turned)],
    }
    options = F.array(*[F.struct(F.lit(k).alias("kind"), *[c.alias(t) for c, t in zip(v, T)]) for k, v in kinds.items()])
    rows = j.select(C, "qi", "angle", *[q.alias(n) for q, n in zip(grid_q, Q)], F.inline(options))
    labelled = dockq(rows.withColumn("pose_id", F.col("kind").cast("long")), atoms)
    wide = labelled.groupBy(C).agg(*[F.max(F.when(F.col("kind") == k, F.col("dockq"))).alias(n)
                                     for k, n in enumerate(("exact_t", "snapped_t", "centroid_t"))])
    return near.select(C, "qi", "angle").join(wide, C)


def cone_ceiling(atoms: DataFrame, complexes: DataFrame, n: int, deg: float, seed: int = 0) -> DataFrame:
    """Best quality of a rotation cone at the exact translation; the first rotation is exact."""
    cone = rot.rotation_cone(complexes.select(C, *Q, *T), n, deg, seed)
    labelled = dockq(cone.withColumn("pose_id", F.col("cone").cast("long")), atoms)
    return labelled.groupBy(C).agg(F.max("dockq").alias("best"), F.max(F.when(F.col("pose_id") == 0, F.col("dockq"))).alias("exact"))


def reachable_ceiling(atoms: DataFrame, complexes: DataFrame, rotations: DataFrame, n_rotations: int, h: float,
                      k: int = 8, reach: int = 1) -> DataFrame:
    """Best quality over the near-native lattice: what any score could find on this grid."""
    lattice = rot.near_native_lattice(complexes, rotations, n_rotations, h, k, reach)
    lattice = lattice.withColumn("pose_id", F.xxhash64("qi", "cx", "cy", "cz"))
    return dockq(lattice, atoms).groupBy(C).agg(F.max("dockq").alias("ceiling"), F.count(F.lit(1)).alias("poses"))


def angle_quality_curve(atoms: DataFrame, complexes: DataFrame, degrees: Sequence[float], seed: int = 0) -> DataFrame:
    """Quality after turning the native pose about its centroid by exact angles."""
    native = complexes.select(C, F.lit(0).cast("long").alias("pose_id"), *Q, *T)
    turned = rot.exact_angles(rot.placed_centroid(native, atoms), degrees, seed)
    rows = turned.select(C, (F.col("deg") * 1000).cast("long").alias("pose_id"), "deg", *Q, *T)
    q = dockq(rows, atoms).withColumn("tier", quality_tier(F.col("dockq")))
    return q.groupBy("deg").agg(F.count(F.lit(1)).alias("n"), F.avg("dockq").alias("mean_q"),
                                *[F.avg((F.col("tier") >= t).cast("int")).alias(f"rate_{t}") for t in (1, 2, 3)])


def near_native_landscape(atoms: DataFrame, complexes: DataFrame, weights: Weights, n: int, max_deg: float, max_shift: float,
                          h: float = fixed.REFERENCE_SPACING, seed: int = 0) -> DataFrame:
    """Best-scoring sample around the native pose: its distance, its quality and the score gap.
    Of samples of equal score the smaller id is the best."""
    native = complexes.select(C, F.lit(-1).cast("long").alias("pose_id"), *Q, *T)
    around = rot.random_probes(rot.placed_centroid(native, atoms), n, max_deg, max_shift, seed)
    rows = cut(native.unionByName(around.select(C, F.col("probe").cast("long").alias("pose_id"), *Q, *T)))
    scored = score_poses(atoms, rows, weights, h).select(C, "pose_id", "score")
    labelled = cut(dockq(rows, atoms).join(scored, [C, "pose_id"]).select(C, "pose_id", "score", "dockq", "l_rmsd"))
    home = labelled.filter(F.col("pose_id") == -1).select(C, F.col("score").alias("_s0"))
    best = labelled.filter(F.col("pose_id") >= 0).groupBy(C).agg(
        F.max_by(F.struct("score", "dockq", "l_rmsd"), F.struct(settled("score"), -F.col("pose_id"))).alias("_b"))
    return best.join(home, C).select(C, F.col("_b.l_rmsd").alias("offset"), F.col("_b.dockq").alias("dockq"),
                                     (F.col("_b.score") - F.col("_s0")).alias("gap"))


def landscape_summary(landscape: DataFrame) -> DataFrame:
    """Linear quantiles of the offset and share of complexes whose native pose is beaten."""
    out = landscape.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gap") > 0).cast("int")).alias("beaten")).withColumn("_k", F.lit(0))
    ends = quantiles_linear(landscape, [], "offset", {"median_offset": 0.5, "p90_offset": 0.9}).withColumn("_k", F.lit(0))
    return out.join(ends, "_k").drop("_k")


def spacing_sweep(atoms: DataFrame, complexes: DataFrame, rotations: DataFrame, n_rotations: int, weights: Weights,
                  spacings: Sequence[float], reach: float | None = None, ntop: int = 50, round_to: int | None = None) -> DataFrame:
    """Search at several spacings: recall, success at 1 and snap error of the native translation.

    Every shift at which cells meet is scored, or those up to ``reach`` per axis where that is asked for.
    """
    out = None
    for h in spacings:
        found = cut(search_poses(atoms, rotations, n_rotations, weights, h, None if reach is None else int(reach / h), 1, ntop, round_to=round_to))
        q = dockq(found, atoms)
        per = q.groupBy(C).agg(F.max("dockq").alias("_best"), F.max(F.when(F.col("pose_id") == 1, F.col("dockq"))).alias("_top"))
        snap = complexes.select(C, F.sqrt(dot(*[[F.rint(F.col(t) / h) * h - F.col(t) for t in T]] * 2)).alias("_snap"))
        row = snap.join(per, C, "left").agg(
            F.count(F.lit(1)).alias("n"), F.avg((F.coalesce("_best", F.lit(0.0)) >= THRESHOLD).cast("int")).alias("recall"),
            F.avg((F.coalesce("_top", F.lit(0.0)) >= THRESHOLD).cast("int")).alias("success_1"),
            F.avg("_best").alias("mean_best_q"), F.avg("_snap").alias("snap_error")).withColumn("spacing", F.lit(float(h)))
        out = row if out is None else out.unionByName(row)
    return out


def refinement_report(before: DataFrame, after: DataFrame, same: float = 0.01) -> DataFrame:
    """Rank 1 before and after refinement: quality, improved / unchanged / worsened, class
    rates, median rotation and shift.

    Both tables: complex_id, pose_id, score, dockq, pose columns.
    """
    def best(df: DataFrame, tag: str) -> DataFrame:
        cols = ["dockq", *Q, *T, "pose_id"]
        pick = df.groupBy(C).agg(F.max_by(F.struct(*cols), F.struct("score", -F.col("pose_id"))).alias("_b"))
        return pick.select(C, *[F.col(f"_b.{c}").alias(f"{tag}_{c}") for c in cols])

    j = best(before, "a").join(best(after, "b"), C)
    gain = F.col("b_dockq") - F.col("a_dockq")
    # How far the new top pose moved from where it started.
    start = before.select(C, F.col("pose_id").alias("b_pose_id"), *[F.col(q).alias(f"s_{q}") for q in Q], *[F.col(t).alias(f"s_{t}") for t in T])
    moved = j.join(start, [C, "b_pose_id"], "left")
    shift = F.sqrt(sum(((F.col(f"b_{t}") - F.col(f"s_{t}")) * (F.col(f"b_{t}") - F.col(f"s_{t}")) for t in T), F.lit(0.0)))
    moved = moved.withColumn("turn", geodesic_deg([F.col(f"b_{q}") for q in Q], [F.col(f"s_{q}") for q in Q])).withColumn("shift", shift)
    # One row per complex, read by the rates and both medians.
    moved = cut(moved.select(C, "a_dockq", "b_dockq", "turn", "shift"))
    out = moved.agg(
        F.count(F.lit(1)).alias("n"), F.avg("a_dockq").alias("before"), F.avg("b_dockq").alias("after"),
        F.count_if(gain > same).alias("improved"), F.count_if(F.abs(gain) <= same).alias("unchanged"), F.count_if(gain < -same).alias("worsened"),
        *[F.avg((quality_tier(F.col(f"{s}_dockq")) >= t).cast("int")).alias(f"{n}_rate_{t}") for s, n in (("a", "before"), ("b", "after")) for t in (1, 2, 3)],
    ).withColumn("_k", F.lit(0))
    for v in ("turn", "shift"):
        out = out.join(quantiles_linear(moved, [], v, {f"median_{v}": 0.5}).withColumn("_k", F.lit(0)), "_k")
    return out.drop("_k")


def term_gaps(atoms: DataFrame, complexes: DataFrame, rotations: DataFrame, n_rotations: int, won: DataFrame,
              weights: Weights, h: float = fixed.REFERENCE_SPACING) -> DataFrame:
    """Per term and recall group, the mean gap between the winning search pose and the
    reachable pose, and the loss from exact to reachable pose.

    The exact pose is the native one, the reachable one the nearest rotation with the
    snapped translation; ``won``: rank-1 search pose and ``recalled`` per complex.
    """
    from posefarm.operators.search import pose_features

    near = rot.nearest_rotations(complexes, rotations, 1, n_rotations)
    snapped = near.select(C, *Q).join(complexes.select(C, *[(F.rint(F.col(t) / h) * h).alias(t) for t in T]), C)
    poses = complexes.select(C, F.lit(0).cast("long").alias("pose_id"), *Q, *T).unionByName(
        snapped.select(C, F.lit(1).cast("long").alias("pose_id"), *Q, *T)).unionByName(
        won.select(C, F.lit(2).cast("long").alias("pose_id"), *Q, *T))
    terms = term_columns(pose_features(atoms, cut(poses), h), weights)
    names = ("fav", "clash", "shape", "pair", "charge", "total")
    wide = terms.groupBy(C).agg(*[F.max(F.when(F.col("pose_id") == k, F.col(n))).alias(f"{n}_{k}") for n in names for k in range(3)])
    j = wide.join(won.select(C, "recalled"), C)
    rows = F.array(*[F.struct(F.lit(n).alias("term"), (F.col(f"{n}_2") - F.col(f"{n}_1")).alias("gap"),
                              (F.col(f"{n}_1") - F.col(f"{n}_0")).alias("discretisation")) for n in names])
    return j.select("recalled", F.inline(rows)).groupBy("recalled", "term").agg(
        F.count(F.lit(1)).alias("n"), F.avg("gap").alias("gap"), F.avg("discretisation").alias("discretisation"))
