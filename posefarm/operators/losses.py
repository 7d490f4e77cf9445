"""Ranking losses over pose pools.

Each loss is a table with one row per complex.  Because scores are linear in the
weights, the derivative of a loss with respect to a pose score is a column, and a
weight gradient is a sum of that column times the features.  Scores enter as
``z``; groups are reduced with aggregates and joined back, never sorted whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.functions.ordering import top_k
from posefarm.operators.scoring import settled

C = "complex_id"
THRESHOLD = fixed.TIERS[0]


def _pos(q_thr: float) -> Column:
    return F.col("dockq") >= q_thr


def _stored_max(pool: DataFrame, **parts: Column) -> DataFrame:
    """Attach one aggregate per name to every row of its complex."""
    ends = pool.groupBy(C).agg(*[v.alias(k) for k, v in parts.items()])
    return pool.join(ends, C)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def split_mse_loss(pool: DataFrame, score: str = "score") -> DataFrame:
    """Mean squared distance of hits and of misses to their targets, added up.

    Needs ``hit`` and ``target``.
    """
    d2 = (F.col(score) - F.col("target")) * (F.col(score) - F.col("target"))
    return pool.groupBy(C).agg(
        (F.coalesce(F.avg(F.when(F.col("hit"), d2)), F.lit(0.0)) + F.coalesce(F.avg(F.when(~F.col("hit"), d2)), F.lit(0.0))).alias("loss"))


def listnet_loss(pool: DataFrame, score: str = "z", label: str = "rmsd", temperature: float = 5.0, sign: int = -1) -> DataFrame:
    """Cross entropy between the softmax of the label and the softmax of the score.

    sign -1 for labels where less is better (rmsd, T = 5), +1 for quality (T = 0.2).
    """
    rows = pool.select(C, F.col(score).alias("_s"), (F.col(label) * sign / temperature).alias("_l"))
    rows = _stored_max(rows, _ms=F.max("_s"), _ml=F.max("_l"))
    e = F.exp(F.col("_l") - F.col("_ml"))
    sums = rows.groupBy(C).agg(F.max("_ms").alias("_ms"), F.sum(F.exp(F.col("_s") - F.col("_ms"))).alias("_z"),
                               F.sum(e * F.col("_s")).alias("_es"), F.sum(e).alias("_e"))
    return sums.select(C, (F.col("_ms") + F.log("_z") - F.col("_es") / F.col("_e")).alias("loss"))


def margin_loss(pool: DataFrame, score: str = "z", margin: float = 1.0, q_thr: float = THRESHOLD) -> DataFrame:
    """Mean over negatives of max(0, margin + s - lowest positive); zero if a class is empty."""
    rows = _stored_max(pool.select(C, "dockq", F.col(score).alias("_s")), _p=F.min(F.when(_pos(q_thr), F.col("_s"))))
    hinge = F.greatest(F.lit(0.0), margin + F.col("_s") - F.col("_p"))
    return rows.groupBy(C).agg(F.coalesce(F.avg(F.when(~_pos(q_thr), hinge)), F.lit(0.0)).alias("loss"))


def _top_negatives(pool: DataFrame, score: str, k: int, q_thr: float) -> DataFrame:
    return top_k(pool.filter(~_pos(q_thr)).select(C, "pose_id", F.col(score).alias("_s")), C,
                 [F.col("_s").desc(), F.col("pose_id")], k, "_r")


def _log_mean_exp(rows: DataFrame, tau: float, name: str) -> DataFrame:
    """tau * log mean exp(s / tau) per complex, shifted by the maximum."""
    rows = _stored_max(rows, _m=F.max("_s"))
    return rows.groupBy(C).agg(
        (F.max("_m") + tau * F.log(F.avg(F.exp((F.col("_s") - F.col("_m")) / tau)))).alias(name))


def top_tail_loss(pool: DataFrame, score: str = "z", margin: float = 1.0, k: int = 32, tau_pos: float = 0.5,
                  tau_neg: float = 0.5, tau_hinge: float = 1.0, q_thr: float = THRESHOLD) -> DataFrame:
    """Soft maximum of the top k negatives against the soft maximum of the positives."""
    p = _log_mean_exp(pool.filter(_pos(q_thr)).select(C, F.col(score).alias("_s")), tau_pos, "_p")
    n = _log_mean_exp(_top_negatives(pool, score, k, q_thr), tau_neg, "_n")
    both = pool.select(C).distinct().join(p, C, "left").join(n, C, "left")
    loss = softplus((margin + F.col("_n") - F.col("_p")) / tau_hinge)
    return both.select(C, F.coalesce(loss, F.lit(0.0)).alias("loss"))


def _shape_pairs(pool: DataFrame, score: str, n_anchor: int, k_neg: int, delta_q: float, q_thr: float) -> DataFrame:
    """Pairs of a best-quality pose with a best-score pose: at most n_anchor * k_neg per complex."""
    rows = pool.select(C, "pose_id", "dockq", F.col(score).alias("_s"))
    a = top_k(rows, C, [F.col("dockq").desc(), F.col("pose_id")], n_anchor, "_r").select(
        C, F.col("pose_id").alias("i"), F.col("dockq").alias("qi_"), F.col("_s").alias("si"))
    b = top_k(rows, C, [F.col("_s").desc(), F.col("pose_id")], k_neg, "_r").select(
        C, F.col("pose_id").alias("j"), F.col("dockq").alias("qj_"), F.col("_s").alias("sj"))
    gamma = pool.groupBy(C).agg(F.least(F.lit(1.0), F.max("dockq") / q_thr).alias("gamma"))
    pairs = a.join(b, C).filter(F.col("qi_") - F.col("qj_") >= delta_q).join(gamma, C)
    u = F.least(F.lit(1.0), F.col("qi_") / q_thr) - F.least(F.lit(1.0), F.col("qj_") / q_thr)
    return pairs.withColumn("du", u)


def shape_pairwise_loss(pool: DataFrame, score: str = "z", n_anchor: int = 16, k_neg: int = 32, delta_q: float = 0.02,
                        tau: float = 1.0, weight: float = 1.0, q_thr: float = THRESHOLD) -> DataFrame:
    """Ordering of the best-quality poses against the best-scoring ones, weighted by how
    close the complex comes to an acceptable pose."""
    pairs = _shape_pairs(pool, score, n_anchor, k_neg, delta_q, q_thr)
    pen = F.col("du") * softplus((F.col("sj") - F.col("si")) / tau)
    per = pairs.groupBy(C).agg((weight * F.max("gamma") * F.avg(pen)).alias("_l"))
    return pool.select(C).distinct().join(per, C, "left").select(C, F.coalesce("_l", F.lit(0.0)).alias("loss"))


def basin_loss(pool: DataFrame, score: str = "z", temperature: float = 0.5, q_thr: float = THRESHOLD) -> DataFrame:
    """Minus the log share of softmax mass on the positives; zero without any."""
    rows = pool.select(C, (F.col(score) / temperature).alias("_s"), _pos(q_thr).alias("_p"))
    rows = _stored_max(rows, _m=F.max("_s"), _mp=F.max(F.when(F.col("_p"), F.col("_s"))))
    sums = rows.groupBy(C).agg(
        F.max("_m").alias("_m"), F.max("_mp").alias("_mp"), F.sum(F.exp(F.col("_s") - F.col("_m"))).alias("_z"),
        F.sum(F.when(F.col("_p"), F.exp(F.col("_s") - F.col("_mp")))).alias("_zp"))
    loss = (F.col("_m") + F.log("_z")) - (F.col("_mp") + F.log("_zp"))
    return sums.select(C, F.coalesce(loss, F.lit(0.0)).alias("loss"))


@dataclass(frozen=True)
class Objective:
    """Terms of the fitted objective."""

    temperature: float = 0.5
    lambda_margin: float = 0.3
    margin: float = 1.0
    negatives: str = "minanchor"      # or "toptail", or "none"
    top_k: int = 32
    lambda_shape: float = 0.0
    lambda_prior: float = 1e-3
    q_thr: float = THRESHOLD
    basin: bool = True


def complex_losses(z_pool: DataFrame, obj: Objective) -> DataFrame:
    """Data terms per complex: basin + lambda * negatives (+ shape where no positive exists)."""
    total = z_pool.groupBy(C).agg((F.count_if(_pos(obj.q_thr)) > 0).alias("_has"))
    expr = F.lit(0.0)
    terms = []
    if obj.basin:
        terms.append((basin_loss(z_pool, "z", obj.temperature, obj.q_thr), 1.0, None))
    if obj.negatives == "minanchor":
        terms.append((margin_loss(z_pool, "z", obj.margin, obj.q_thr), obj.lambda_margin, None))
    elif obj.negatives == "toptail":
        terms.append((top_tail_loss(z_pool, "z", obj.margin, obj.top_k, q_thr=obj.q_thr), obj.lambda_margin, None))
    if obj.lambda_shape:
        terms.append((shape_pairwise_loss(z_pool, "z", q_thr=obj.q_thr), obj.lambda_shape, "dead"))
    for i, (table, w, gate) in enumerate(terms):
        total = total.join(table.withColumnRenamed("loss", f"_l{i}"), C)
        term = w * F.col(f"_l{i}")
        expr = expr + (F.when(F.col("_has"), 0.0).otherwise(term) if gate else term)
    return total.select(C, expr.alias("loss"))


def pose_gradients(z_pool: DataFrame, obj: Objective) -> DataFrame:
    """Add ``g``: derivative of the data terms of a complex by the standardised score."""
    pos, z = _pos(obj.q_thr), F.col("z")
    t = obj.temperature
    z_pool = _stored_max(
        z_pool, _m=F.max("z"), _mp=F.max(F.when(pos, z)), _np=F.count_if(pos), _nn=F.count_if(~pos),
        _minp=F.min(F.when(pos, F.struct(settled("z").alias("_s"), F.col("pose_id"), z))))
    inner = [
        F.sum(F.exp((z - F.col("_m")) / t)).alias("_z"),
        F.sum(F.when(pos, F.exp((z - F.col("_mp")) / t))).alias("_zp"),
        F.count_if(~pos & (obj.margin + z - F.col("_minp.z") > 0)).alias("_act"),
    ]
    z_pool = z_pool.join(z_pool.groupBy(C).agg(*inner), C)
    both = (F.col("_np") > 0) & (F.col("_nn") > 0)
    g = F.lit(0.0)
    if obj.basin:
        share = F.exp((z - F.col("_m")) / t) / F.col("_z")
        share_pos = F.when(pos, F.exp((z - F.col("_mp")) / t) / F.col("_zp")).otherwise(0.0)
        g = g + F.when(F.col("_np") > 0, (share - share_pos) / t).otherwise(0.0)
    if obj.negatives == "minanchor":
        active = F.when(~pos & (obj.margin + z - F.col("_minp.z") > 0), 1.0 / F.col("_nn")).otherwise(0.0)
        anchor = F.when(pos & (F.col("pose_id") == F.col("_minp.pose_id")), -F.col("_act") / F.col("_nn")).otherwise(0.0)
        g = g + F.when(both, obj.lambda_margin * (active + anchor)).otherwise(0.0)
    out = z_pool.withColumn("g", g).drop("_m", "_mp", "_np", "_nn", "_minp", "_z", "_zp", "_act")
    extra = []
    if obj.negatives == "toptail":
        extra.append(_top_tail_gradient(z_pool, obj))
    if obj.lambda_shape:
        extra.append(_shape_gradient(z_pool, obj))
    for i, e in enumerate(extra):
        out = out.join(e.withColumnRenamed("g", f"_g{i}"), [C, "pose_id"], "left")
        out = out.withColumn("g", F.col("g") + F.coalesce(f"_g{i}", F.lit(0.0))).drop(f"_g{i}")
    return out


def _top_tail_gradient(z_pool: DataFrame, obj: Objective, tau: float = 0.5) -> DataFrame:
    def weights(rows: DataFrame, sign: float) -> DataFrame:
        rows = _stored_max(rows.select(C, "pose_id", "_s"), _x=F.max("_s"))
        e = F.exp((F.col("_s") - F.col("_x")) / tau)
        return rows.join(rows.groupBy(C).agg(F.sum(e).alias("_sum")), C).select(C, "pose_id", (sign * e / F.col("_sum")).alias("w"))

    p_rows = z_pool.filter(_pos(obj.q_thr)).select(C, "pose_id", F.col("z").alias("_s"))
    n_rows = _top_negatives(z_pool, "z", obj.top_k, obj.q_thr)
    u = _log_mean_exp(p_rows, tau, "_lp").join(_log_mean_exp(n_rows, tau, "_ln"), C)
    slope = 1.0 / (1.0 + F.exp(-(obj.margin + F.col("_ln") - F.col("_lp"))))
    w = weights(n_rows, 1.0).unionByName(weights(p_rows, -1.0))
    return w.join(u, C).select(C, "pose_id", (obj.lambda_margin * slope * F.col("w")).alias("g"))


def _shape_gradient(z_pool: DataFrame, obj: Objective, tau: float = 1.0) -> DataFrame:
    live = z_pool.filter(_pos(obj.q_thr)).select(C).distinct()
    dead = z_pool.join(live, C, "left_anti")
    pairs = _shape_pairs(dead, "z", 16, 32, 0.02, obj.q_thr)
    n = pairs.groupBy(C).agg(F.count(F.lit(1)).alias("_n"))
    slope = 1.0 / (1.0 + F.exp(-(F.col("sj") - F.col("si")) / tau)) / tau
    v = obj.lambda_shape * F.col("gamma") * F.col("du") * slope / F.col("_n")
    both = F.array(F.struct(F.col("i").alias("pose_id"), (-v).alias("g")), F.struct(F.col("j").alias("pose_id"), v.alias("g")))
    return pairs.join(n, C).select(C, F.inline(both)).groupBy(C, "pose_id").agg(F.sum("g").alias("g"))
