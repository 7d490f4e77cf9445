"""Pool maintenance across mining rounds.

A pose is known by four columns: rotation index and translation cell.  They are
kept apart, since cells may be negative and any packing into one number can
overflow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.functions.ordering import top_k, upper_median
from posefarm.operators.scoring import Weights, score_many, standardize
from posefarm.session import cut

C = "complex_id"
IDENTITY = ["qi", "cx", "cy", "cz"]
THRESHOLD = fixed.TIERS[0]


def pose_identity() -> Column:
    return F.struct(*IDENTITY)


def has_identity(pool: DataFrame) -> DataFrame:
    """Per complex: does every pose carry an identity?  Only the rotation index marks a missing one."""
    return pool.groupBy(C).agg((F.count_if(F.col("qi") < 0) == 0).alias("has_identity"))


def require_identity(pool: DataFrame) -> DataFrame:
    """The same pool; a pose without identity ends the job."""
    text = F.lit("pose without identity: this pool cannot be de-duplicated")
    return pool.withColumn("qi", F.when(F.col("qi") < 0, F.raise_error(text).cast("long")).otherwise(F.col("qi")))


def distinct_poses(rows: DataFrame) -> DataFrame:
    """First occurrence (smallest pose_id) of each identity, as an aggregate with partials."""
    rest = [c for c in rows.columns if c not in (C, *IDENTITY)]
    first = rows.groupBy(C, *IDENTITY).agg(F.min_by(F.struct(*rest), F.col("pose_id")).alias("_row"))
    return first.select(C, *IDENTITY, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def fresh_rows(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates whose identity the pool does not hold, once each."""
    seen = require_identity(pool).select(C, *IDENTITY)
    return distinct_poses(require_identity(candidates)).join(seen, [C, *IDENTITY], "left_anti")


def dropped_counts(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates, kept and dropped per complex."""
    kept = fresh_rows(candidates, pool).groupBy(C).agg(F.count(F.lit(1)).alias("kept"))
    n = candidates.groupBy(C).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(kept, C, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return out.withColumn("dropped", F.col("n") - F.col("kept"))


def cap_pool(pool: DataFrame, cap: int, score: str = "score", q_thr: float = THRESHOLD) -> DataFrame:
    """Above the cap keep all positives and the best-scoring negatives that still fit.

    Positives alone may exceed the cap; a pool within it is not touched.
    """
    pos = F.col("dockq") >= q_thr
    sizes = pool.groupBy(C).agg(F.count(F.lit(1)).alias("_n"), F.count_if(pos).alias("_np"))
    hardest = top_k(pool.filter(~pos), C, [F.col(score).desc(), F.col("pose_id")], cap, "_r")
    room = F.when(F.col("_n") <= cap, F.lit(cap).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), cap - F.col("_np")))
    negatives = hardest.join(sizes, C).filter(F.col("_r") <= room)
    return pool.filter(pos).unionByName(negatives.select(*pool.columns))


def absorb_round(pool: DataFrame, mined: DataFrame, rnd: int, cap: int, score: str = "score",
                 q_thr: float = THRESHOLD) -> DataFrame:
    """Pool after a mining round.

    Round 0 replaces the pool.  Later rounds add fresh negatives only, so the set
    of positives stays, and then cap the pool of complexes that gained any.
    ``origin`` tells new rows (rnd) from old ones.
    """
    if rnd == 0:
        return mined.withColumn("origin", F.lit(0))
    known = pool.select(C).distinct()
    fresh = fresh_rows(mined.filter(F.col("dockq") < q_thr), pool).join(known, C, "left_semi")
    old = pool if "origin" in pool.columns else pool.withColumn("origin", F.lit(0))
    added = fresh.withColumn("origin", F.lit(rnd)).select(*old.columns)
    gained = fresh.select(C).distinct()
    grown = old.join(gained, C, "left_semi").unionByName(added)
    return cap_pool(grown, cap, score, q_thr).unionByName(old.join(gained, C, "left_anti"))


def absorb_stats(pool: DataFrame, mined: DataFrame, after: DataFrame, q_thr: float = THRESHOLD) -> DataFrame:
    """Per complex: proposed, duplicate, added, surviving and evicted negatives, pool sizes.

    A change in the number of positives ends the job.
    """
    neg = F.col("dockq") < q_thr
    cand = mined.filter(neg)
    fresh = fresh_rows(cand, pool).select(C, *IDENTITY, F.lit(1).alias("_fresh"))
    proposed = cand.groupBy(C).agg(F.count(F.lit(1)).alias("proposed"))
    now = after.select(C, *IDENTITY).distinct().withColumn("_now", F.lit(1))
    added = fresh.join(now, [C, *IDENTITY], "left").groupBy(C).agg(
        F.count(F.lit(1)).alias("added"), F.count("_now").alias("survived"))
    before = pool.withColumn("_neg", neg).join(now, [C, *IDENTITY], "left").groupBy(C).agg(
        F.count(F.lit(1)).alias("pool_before"), F.count_if(~F.col("_neg")).alias("_p0"),
        F.count_if(F.col("_neg") & F.col("_now").isNull()).alias("evicted"))
    end = after.groupBy(C).agg(F.count(F.lit(1)).alias("pool_after"), F.count_if(~neg).alias("_p1"))
    out = before.join(end, C).join(proposed, C, "left").join(added, C, "left").fillna(0)
    text = F.concat(F.lit("positives changed in complex "), F.col(C).cast("string"))
    out = out.withColumn("pool_after", F.when(F.col("_p0") != F.col("_p1"), F.raise_error(text).cast("long")).otherwise(F.col("pool_after")))
    return out.select(C, "proposed", (F.col("proposed") - F.col("added")).alias("duplicate"), "added", "survived", "evicted",
                      "pool_before", "pool_after")


def loss_view(pool: DataFrame, prov: str = "search") -> DataFrame:
    """Rows the loss may see: those the search returned, or all of them."""
    return pool if prov == "all" else pool.filter(F.col("prov") == 0)


def pool_composition(pool: DataFrame, q_thr: float = THRESHOLD) -> DataFrame:
    """Per complex: rows, positives by source, negatives of round 0 and of later rounds."""
    pos = F.col("dockq") >= q_thr
    return pool.groupBy(C).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("n_pos"),
        F.count_if(~pos & (F.col("round") == 0)).alias("random_neg"),
        F.count_if(~pos & (F.col("round") > 0)).alias("hard_neg"),
        F.count_if(pos & (F.col("prov") == 0)).alias("pos_searched"),
        F.count_if(pos & (F.col("prov") == 1)).alias("pos_injected"))


def composition_summary(composition: DataFrame) -> DataFrame:
    return composition.agg(
        F.count(F.lit(1)).alias("complexes"), F.sum("n").alias("rows"), F.sum("n_pos").alias("positives"),
        F.count_if(F.col("n_pos") == 0).alias("without_positive"), F.count_if(F.col("pos_searched") == 0).alias("without_searched"))


def pair_coverage(pool: DataFrame, length: int = 144) -> DataFrame:
    """Per feature position: complexes with any mass, and the total mass.

    Array positions are summed in place, so the explode runs on one row per complex.
    """
    sums = pool.groupBy(C).agg(F.array(*[F.sum(F.abs(F.col("t")[k])) for k in range(length)]).alias("_m"))
    cells = sums.select(C, F.posexplode("_m").alias("k", "mass"))
    return cells.groupBy("k").agg(F.count_if(F.col("mass") > 0).alias("coverage"), F.sum("mass").alias("total_mass"))


def coverage_summary(coverage: DataFrame, complexes: DataFrame) -> DataFrame:
    """Positions never seen, seen in fewer than ten or one per cent of complexes; minimum and median."""
    n = complexes.select(C).distinct().agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
    c = coverage.withColumn("_k", F.lit(0)).join(n, "_k")
    stats = c.groupBy("_k").agg(
        F.count_if(F.col("coverage") == 0).alias("zero"), F.count_if(F.col("coverage") < 10).alias("below_10"),
        F.count_if(F.col("coverage") / F.col("_n") < 0.01).alias("below_1pct"), F.min("coverage").alias("min_coverage"),
        F.avg(F.col("coverage") / F.col("_n")).alias("mean_fraction"))
    from posefarm.functions.ordering import lower_median
    med = lower_median(coverage, [], "coverage", "median_coverage").withColumn("_k", F.lit(0))
    return stats.join(med, "_k").drop("_k")


def _band(pool: DataFrame, z: str, margin: float, keys: Sequence[str], q_thr: float) -> DataFrame:
    """Ends of the classes per group: lowest positive, highest negative."""
    pos = F.col("dockq") >= q_thr
    return pool.groupBy(*keys).agg(F.min(F.when(pos, F.col(z))).alias("min_pos"), F.max(F.when(~pos, F.col(z))).alias("max_neg"))


def new_negative_leverage(round0: DataFrame, round1: DataFrame, score: str = "score", margin: float = 1.0,
                          q_thr: float = THRESHOLD) -> DataFrame:
    """Per complex with a searched positive and fresh negatives: how many fresh and old
    negatives lie in the margin band of the merged pool, the shift of the band, and
    whether a fresh negative is the hardest."""
    cols = [C, *IDENTITY, F.col(score).alias("_s"), "dockq"]
    a, b = loss_view(round0).select(*cols), loss_view(round1).filter(F.col("dockq") < q_thr).select(*cols)
    new = b.join(a.select(C, *IDENTITY), [C, *IDENTITY], "left_anti")
    # Written once: two passes read it, and what builds it holds no memory while they run.
    merged = cut(a.select(C, "_s", "dockq", F.lit(False).alias("new")).unionByName(new.select(C, "_s", "dockq", F.lit(True).alias("new"))))
    s, old, neg = F.col("_s"), ~F.col("new"), F.col("dockq") < q_thr
    # Standardising keeps the order within a complex, so the ends of the classes are found on the scores.
    ends = merged.groupBy(C).agg(
        F.count_if("new").alias("fresh"), F.min(F.when(F.col("dockq") >= q_thr, s)).alias("_low"),
        F.avg(F.when(old, s)).alias("_m0"), F.stddev_pop(F.when(old, s)).alias("_d0"), F.avg(s).alias("_m1"), F.stddev_pop(s).alias("_d1"),
        F.max(F.when(neg & F.col("new"), s)).alias("_hn"), F.max(F.when(neg & old, s)).alias("_ho"), F.count_if(F.col("dockq") >= q_thr).alias("_np"))
    ends = ends.filter((F.col("fresh") > 0) & (F.col("_np") > 0))
    z = lambda c, k: (F.col(c) - F.col(f"_m{k}")) / F.greatest(F.coalesce(f"_d{k}", F.lit(0.0)), F.lit(1.0))
    ends = ends.withColumns({"thr0": z("_low", 0) - margin, "thr1": z("_low", 1) - margin, "_zn": z("_hn", 1), "_zo": z("_ho", 1)})
    kept = ["fresh", "thr0", "thr1", "_zn", "_zo"]
    inside = merged.join(ends.select(C, "_m1", "_d1", *kept), C).filter(neg).groupBy(C).agg(
        *[F.any_value(k).alias(k) for k in kept],
        F.count_if(F.col("new") & (z("_s", 1) > F.col("thr1"))).alias("new_in_band"),
        F.count_if(old & (z("_s", 1) > F.col("thr1"))).alias("old_in_band"))
    total = F.col("new_in_band") + F.col("old_in_band")
    return inside.select(C, "fresh", "new_in_band", "old_in_band", F.when(total > 0, F.col("new_in_band") / total).alias("share"),
                         (F.col("thr1") - F.col("thr0")).alias("threshold_shift"),
                         F.when(F.col("_zn").isNotNull() & F.col("_zo").isNotNull(), (F.col("_zn") > F.col("_zo")).cast("int")).alias("new_hardest"),
                         (F.col("_zn") - F.col("_zo")).alias("top_shift"))


def rescue_potential(round0: DataFrame, round1: DataFrame, q_thr: float = THRESHOLD) -> DataFrame:
    """Complexes without a searched positive in round 0: best quality before and after, positives gained."""
    a = loss_view(round0).groupBy(C).agg(F.max("dockq").alias("best_before"))
    b = loss_view(round1).groupBy(C).agg(F.max("dockq").alias("best_after"), F.count_if(F.col("dockq") >= q_thr).alias("gained"))
    known = round0.select(C).distinct()
    dead = known.join(a, C, "left").filter(F.coalesce("best_before", F.lit(0.0)) < q_thr)
    return dead.join(b, C, "left").fillna(0, ["best_after", "gained"])


def negative_hardness(pool: DataFrame, settings: Mapping[str, Weights], margin: float = 1.0,
                      q_thr: float = THRESHOLD) -> DataFrame:
    """The same searched pool under several weight settings: negatives in the margin band,
    and upper medians of the hardest negative and of min positive - max negative."""
    keys = ["condition", C]
    rows = score_many(loss_view(pool), dict(settings), [C, "pose_id", "dockq"])
    z = standardize(rows, "score", "z", keys=keys)
    ends = _band(z, "z", margin, keys, q_thr).filter(F.col("min_pos").isNotNull() & F.col("max_neg").isNotNull())
    inside = z.filter(F.col("dockq") < q_thr).join(ends.select(*keys, "min_pos"), keys).groupBy("condition").agg(
        F.count_if(F.col("z") > F.col("min_pos") - margin).alias("in_band"))
    per = ends.withColumn("gap", F.col("min_pos") - F.col("max_neg"))
    n = per.groupBy("condition").agg(F.count(F.lit(1)).alias("complexes"))
    hardest = upper_median(per, ["condition"], "max_neg", "hardest_median")
    gaps = upper_median(per, ["condition"], "gap", "gap_median")
    return n.join(inside, "condition").join(hardest, "condition").join(gaps, "condition")


def identity_overflow_audit(candidates: DataFrame, pool: DataFrame, bits: Sequence[int] = (10, 10, 10)) -> DataFrame:
    """Candidates kept under a packed key of narrow fields against the four-column key."""
    def packed() -> Column:
        key = F.col("qi").cast("long")
        for c, b in zip(("cx", "cy", "cz"), bits):
            key = key * (1 << b) + F.pmod(F.col(c), F.lit(1 << b))
        return key
    four = candidates.select(C, *IDENTITY).join(pool.select(C, *IDENTITY), [C, *IDENTITY], "left_anti")
    one = candidates.select(C, packed().alias("_k")).join(pool.select(C, packed().alias("_k")), [C, "_k"], "left_anti")
    n = candidates.agg(F.count(F.lit(1)).alias("candidates")).withColumn("_j", F.lit(0))
    a = four.agg(F.count(F.lit(1)).alias("kept_four")).withColumn("_j", F.lit(0))
    b = one.agg(F.count(F.lit(1)).alias("kept_packed")).withColumn("_j", F.lit(0))
    return n.join(a, "_j").join(b, "_j").drop("_j")
