"""Ranking evaluation per complex and over a corpus.

Pools hold (complex_id, pose_id, a score, dockq, rmsd).  Ties in score go to the
smaller pose_id.  Nothing here sorts a whole complex in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.functions.ordering import order_values, rank_of, top_k, upper_median, with_order

KS = fixed.KS
THRESHOLD = fixed.TIERS[0]
C = "complex_id"


def ranking_report(pool: DataFrame, score: str = "score", ks: Sequence[int] = KS, rmsd_thr: float = 5.0,
                   q_thr: float = THRESHOLD) -> DataFrame:
    """One row per complex: counts, success and best labels in the top K, rank of the best pose.

    The top K needs only max(ks) rows per complex; ranks of the two best poses are
    counts of the rows ahead of them.
    """
    lead = top_k(pool.select(C, "pose_id", score, "dockq", "rmsd"), C, [F.col(score).desc(), F.col("pose_id")], max(ks))
    within = lead.groupBy(C).agg(
        *[F.coalesce(F.max(F.when(F.col("rank") <= k, (F.col("rmsd") <= rmsd_thr).cast("int"))), F.lit(0)).alias(f"success_rmsd_{k}") for k in ks],
        *[F.coalesce(F.max(F.when(F.col("rank") <= k, (F.col("dockq") >= q_thr).cast("int"))), F.lit(0)).alias(f"success_q_{k}") for k in ks],
        *[F.max(F.when(F.col("rank") <= k, F.col("dockq"))).alias(f"best_q_{k}") for k in ks],
        *[F.min(F.when(F.col("rank") <= k, F.col("rmsd"))).alias(f"min_rmsd_{k}") for k in ks],
    )
    counts = pool.groupBy(C).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rmsd") <= rmsd_thr).alias("n_hit_rmsd"),
        F.count_if(F.col("dockq") >= q_thr).alias("n_hit_q"))
    best = rank_of(pool, C, score, "pose_id", {
        "rank_best_q": F.when(F.col("dockq").isNotNull(), F.struct(F.col("dockq"), -F.col("pose_id"))),
        "rank_best_rmsd": F.when(F.col("rmsd").isNotNull(), F.struct(-F.col("rmsd"), -F.col("pose_id"))),
    })
    return counts.join(within, C).join(best, C)


def auc_midrank(pool: DataFrame, score: str = "score", positive: Column | None = None, keys: Sequence[str] = (C,),
                name: str = "auc") -> DataFrame:
    """Mann-Whitney AUC with midranks per group; NULL when one class is empty.

    Rows first collapse to one per distinct score, so ties cost nothing, and the
    running count of negatives is built over value ranges.
    """
    keys = list(keys)
    pos = (F.col("dockq") >= THRESHOLD) if positive is None else positive
    by_score = pool.select(*keys, F.col(score).alias("_score"), pos.cast("long").alias("_pos")).groupBy(*keys, "_score").agg(
        F.sum("_pos").alias("_p"), F.sum(1 - F.col("_pos")).alias("_n"))
    ordered = with_order(by_score, keys, "_score", rank=None, running={"_upto": "_n"})
    wins = F.col("_p") * (F.col("_upto") - F.col("_n") / 2.0)
    out = ordered.groupBy(*keys).agg(F.sum(wins).alias("_u"), F.sum("_p").alias("_np"), F.sum("_n").alias("_nn"))
    return out.select(*keys, F.when((F.col("_np") > 0) & (F.col("_nn") > 0),
                                    F.col("_u") / (F.col("_np") * F.col("_nn"))).alias(name))


def first_hit(pool: DataFrame, score: str = "score", positive: Column | None = None, keys: Sequence[str] = (C,)) -> DataFrame:
    """Rank of the first positive (n + 1 if there is none) and that rank over n."""
    keys = list(keys)
    pos = (F.col("dockq") >= THRESHOLD) if positive is None else positive
    rank = rank_of(pool, keys, score, "pose_id", {"_rank": F.when(pos, F.struct(F.col(score), -F.col("pose_id")))})
    n = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce("_rank", F.col("n") + 1)
    return n.join(rank, keys).select(*keys, "n", first.alias("first_hit"), (first / F.col("n")).alias("first_hit_frac"))


def summarise_metrics(metrics: DataFrame, value: str, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """Count, mean, sample deviation and upper median per group; NULL and NaN are left out."""
    keys = list(keys)
    clean = metrics.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    stats = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return stats.join(upper_median(clean, keys, value), keys)


def success_rates(reports: DataFrame, ks: Sequence[int] = KS, keys: Sequence[str] = ()) -> DataFrame:
    """Corpus success@K, mean best quality at 1 and share of complexes with any positive."""
    return reports.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_complexes"),
        *[F.avg(f"success_q_{k}").alias(f"success_{k}") for k in ks],
        F.avg("best_q_1").alias("mean_best_q_1"),
        F.avg((F.col("n_hit_q") > 0).cast("int")).alias("with_positive"),
    )


def aggregate_success(pool: DataFrame, score: str = "score", ks: Sequence[int] = KS, q_thr: float = THRESHOLD) -> DataFrame:
    """Corpus success@K straight from a pool."""
    lead = top_k(pool.select(C, "pose_id", score, "dockq"), C, [F.col(score).desc(), F.col("pose_id")], max(ks))
    per = lead.groupBy(C).agg(*[F.max(F.when(F.col("rank") <= k, F.col("dockq"))).alias(f"b{k}") for k in ks])
    return per.agg(F.count(F.lit(1)).alias("n_complexes"),
                   *[F.avg((F.col(f"b{k}") >= q_thr).cast("int")).alias(f"success_{k}") for k in ks],
                   F.avg(f"b{ks[0]}").alias("mean_best_q"))


def search_summary(metrics: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Ceiling, recall, success overall and given recall, mean best quality and nearest angle.

    ``metrics``: complex_id, ceiling (best reachable quality), best_q (best returned),
    first_hit, angle.
    """
    recalled = F.col("best_q") >= THRESHOLD
    return metrics.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("ceiling") >= THRESHOLD).cast("int")).alias("ceiling_fraction"),
        F.avg(recalled.cast("int")).alias("recall"),
        *[F.avg((recalled & (F.col("first_hit") <= k)).cast("int")).alias(f"success_{k}") for k in ks],
        *[F.avg(F.when(recalled, (F.col("first_hit") <= k).cast("int"))).alias(f"success_given_recall_{k}") for k in ks],
        F.avg("best_q").alias("mean_best_q"), F.avg("angle").alias("mean_angle"),
    )


def rank_bands(metrics: DataFrame, cuts: Sequence[int] = KS, rank: str = "first_hit") -> DataFrame:
    """How many systems first hit within each cut, what each band adds, and how many stay out.

    ``rank`` is NULL for a system without any hit.
    """
    total = metrics.agg(
        F.count(F.lit(1)).alias("n"), F.count(rank).alias("reachable"),
        *[F.count_if(F.col(rank) <= k).alias(f"_c{k}") for k in cuts])
    rows = F.array(*[
        F.struct(F.lit(k).alias("cut"), F.col(f"_c{k}").alias("within"),
                 (F.col(f"_c{k}") - (F.col(f"_c{cuts[i - 1]}") if i else F.lit(0))).alias("gained"))
        for i, k in enumerate(cuts)])
    return total.select(F.inline(rows), "n", "reachable").withColumn("not_retrieved", F.col("reachable") - F.col("within"))


def name_rank(name: Column) -> Column:
    """Rank written at the end of a file name."""
    return F.regexp_extract(name, r"(\d+)$", 1).try_cast("int")


def top_k_max(decoys: DataFrame, systems: DataFrame, k: int) -> DataFrame:
    """Best quality and class within rank k per system; systems without decoys get zero.

    A missing rank is read from the name.
    """
    rank = F.coalesce("rank", name_rank(F.col("name")))
    best = decoys.withColumn("_rank", rank).filter(F.col("_rank") <= k).groupBy("id").agg(
        F.max("dockq").alias("dockq"), F.max("tier").alias("tier"))
    return systems.select("id").join(best, "id", "full").fillna(0, ["dockq", "tier"])


def class_transitions(before: DataFrame, after: DataFrame, cohort: DataFrame | None = None,
                      margin: float = 0.05) -> DataFrame:
    """Per level and cohort: rate before and after, systems won and lost.

    For the acceptable level, ``near`` counts newly acceptable systems within
    ``margin`` of the threshold.
    """
    j = before.select("id", F.col("dockq").alias("q0"), F.col("tier").alias("t0")).join(
        after.select("id", F.col("dockq").alias("q1"), F.col("tier").alias("t1")), "id", "full").fillna(0)
    j = j.join(cohort, "id", "left") if cohort is not None else j.withColumn("cohort", F.lit("all"))
    levels = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("level")
    long = j.select("*", levels)
    was, now = F.col("t0") >= F.col("level"), F.col("t1") >= F.col("level")
    near = ~was & now & (F.col("level") == 1) & (F.abs(F.col("q1") - THRESHOLD) < margin)
    return long.groupBy("cohort", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(was.cast("int")).alias("before"), F.avg(now.cast("int")).alias("after"),
        F.count_if(~was & now).alias("won"), F.count_if(was & ~now).alias("lost"), F.count_if(near).alias("near"))


def changed_systems(before: DataFrame, after: DataFrame) -> DataFrame:
    """Systems whose class differs."""
    j = before.select("id", F.col("tier").alias("tier_before")).join(
        after.select("id", F.col("tier").alias("tier_after")), "id", "full").fillna(0)
    return j.filter(F.col("tier_before") != F.col("tier_after"))


def rank_gap(pool: DataFrame, score: str = "score") -> DataFrame:
    """Per complex: gaps between best negative, best and worst positive in units of the
    score deviation, and the number of negatives above the best positive."""
    pos = F.col("dockq") >= THRESHOLD
    s = F.col(score)
    ends = pool.groupBy(C).agg(
        F.max(F.when(~pos, s)).alias("_bn"), F.max(F.when(pos, s)).alias("_bp"), F.min(F.when(pos, s)).alias("_wp"),
        F.stddev_samp(s).alias("_sd"))
    above = pool.select(C, s.alias("_s"), pos.alias("_pos")).join(ends.select(C, "_bp"), C).groupBy(C).agg(
        F.count_if(~F.col("_pos") & (F.col("_s") > F.col("_bp"))).alias("above"))
    return ends.join(above, C).select(
        C, ((F.col("_bn") - F.col("_bp")) / F.col("_sd")).alias("gap"),
        ((F.col("_bp") - F.col("_wp")) / F.col("_sd")).alias("spread"), "above")


def gap_quantiles(gaps: DataFrame, qs: Sequence[float] = (0.25, 0.5, 0.75), within: Sequence[float] = (0.25, 0.5, 1.0)) -> DataFrame:
    """Quantiles of the gap over missed complexes (gap > 0), and how many lie within each t."""
    missed = gaps.filter(F.col("gap") > 0)
    out = missed.agg(F.count(F.lit(1)).alias("missed"),
                     *[F.count_if(F.col("gap") <= t).alias(f"within_{i}") for i, t in enumerate(within)]).withColumn("_k", F.lit(0))
    places = {f"q{i}": F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(q)))) + 1 for i, q in enumerate(qs)}
    return out.join(order_values(missed, [], "gap", places).drop("n").withColumn("_k", F.lit(0)), "_k").drop("_k")


def top1_given_reachable(pool: DataFrame, score: str = "score") -> DataFrame:
    """Complexes, reachable ones, right at rank 1, and the median rank of the best positive."""
    hits = first_hit(pool, score).withColumn("reach", F.col("first_hit") <= F.col("n"))
    stats = hits.agg(F.count(F.lit(1)).alias("n"), F.count_if("reach").alias("reachable"),
                     F.count_if(F.col("first_hit") == 1).alias("top1")).withColumn("_k", F.lit(0))
    med = upper_median(hits.filter("reach"), [], "first_hit", "median_rank").withColumn("_k", F.lit(0))
    return stats.join(med, "_k").drop("_k")


def oracle_at_k(decoys: DataFrame, ks: Sequence[int] = (1, 5, 50), keys: Sequence[str] = ("condition",)) -> DataFrame:
    """Success when the best of the first k ranks counts, per condition."""
    per = decoys.groupBy(*keys, "id").agg(*[F.max(F.when(F.col("rank") <= k, F.col("dockq"))).alias(f"b{k}") for k in ks])
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg((F.coalesce(f"b{k}", F.lit(0.0)) >= THRESHOLD).cast("int")).alias(f"oracle_{k}") for k in ks])


def leaderboard(decoys: DataFrame, expected: DataFrame, ks: Sequence[int] = (1, 5), levels: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Per method: decoys per class, hit rates in the top k over all expected systems,
    penalty rows (names with ``missing_decoy``) and systems without any decoy."""
    penalty = F.col("name").contains("missing_decoy")
    real = decoys.filter(~penalty)
    classes = real.groupBy("method").pivot("tier", [0, *levels]).count().fillna(0)
    classes = classes.select("method", *[F.col(str(t)).alias(f"class_{t}") for t in (0, *levels)])
    per = decoys.groupBy("method", "id").agg(
        *[F.coalesce(F.max(F.when((F.col("rank") <= k) & ~penalty, F.col("tier"))), F.lit(0)).alias(f"t{k}") for k in ks],
        F.count_if(penalty).alias("_pen"), F.count_if(~penalty).alias("_real"))
    total = expected.select("id").distinct().agg(F.count(F.lit(1)).alias("_total")).withColumn("_k", F.lit(0))
    rates = per.groupBy("method").agg(
        *[F.count_if(F.col(f"t{k}") >= 1).alias(f"_h{k}") for k in ks],
        F.sum("_pen").alias("penalties"), F.count_if(F.col("_real") > 0).alias("_seen")).withColumn("_k", F.lit(0))
    rates = rates.join(total, "_k")
    return classes.join(rates, "method").select(
        "method", *[f"class_{t}" for t in (0, *levels)], *[(F.col(f"_h{k}") / F.col("_total")).alias(f"hit_rate_{k}") for k in ks],
        "penalties", (F.col("_total") - F.col("_seen")).alias("missing"))
