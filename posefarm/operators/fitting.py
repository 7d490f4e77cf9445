"""Fitting the weights.

The pool stays in Spark.  Per step the driver sends a parameter vector of at most
a few hundred numbers and receives a gradient of the same length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posefarm.functions import fixed
from posefarm.functions.columns import mix, weighted_sum
from posefarm.functions.ordering import lower_median, quantiles_linear, with_one, with_order
from posefarm.operators.losses import Objective, complex_losses, pose_gradients
from posefarm.operators.scoring import Weights, additive_basis, linear_score, settled, standardize, symmetric_additive_basis
from posefarm.session import cut, shared_folder, ship, shuffles_freed, spread

C = "complex_id"
THRESHOLD = fixed.TIERS[0]
#: Hinge fits end within this share of their minimum.
TOLERANCE = 1e-6
SHAPE = ("c_pair", "n_ss", "n_sc", "n_cc")
#: Bytes of the constants and features that a packed row of poses holds; poses that are looked at together.
PACKED, POSES = 4096, 1 << 16
#: Evaluations without any progress after which a hinge fit gives up.
STALLED = 500


@dataclass
class Model:
    """Weights being fitted.  ``mode`` is ``full`` (every table entry) or ``basis``
    (table = start + basis * theta); ``clash`` is ``rho`` or ``free``."""

    alpha: float
    rho: float
    table: list[float]
    beta: float = 3.0
    log_clash: list[float] | None = None
    basis: list[list[float]] | None = None
    freeze_shape: bool = False

    def clash(self) -> tuple[float, float, float]:
        if self.log_clash is not None:
            return tuple(math.exp(v) for v in self.log_clash)
        return tuple(self.alpha * self.rho ** k for k in (2, 3, 4))

    def weights(self) -> Weights:
        return Weights(self.alpha, self.clash(), tuple(self.table), self.beta)

    def vector(self) -> list[float]:
        free = self.log_clash if self.log_clash is not None else [self.rho]
        return [self.alpha, *free, *self.table]


@dataclass(frozen=True)
class AdamConfig:
    steps: int = 20
    batch: int = 16
    table_lr: float = 5e-4
    alpha_lr: float = 1e-2
    rho_lr: float = 1e-2
    clip: float = 1.0
    alpha_max: float = 10.0
    rho_min: float = 0.5
    rho_max: float = 9.0
    val_every: int = 5
    patience: int = 3
    min_delta: float = 1e-4
    seed: int = 0


#: Features up to which the sums of all terms go into one aggregate, six for each feature.
FUSED = 32


def _fused_gradients(pool: DataFrame, weights: Weights, obj: Objective, x: list[Column]) -> DataFrame:
    """:func:`complex_gradients` in two aggregates: extremes and moments of the scores, which a
    second one over the poses turns into all sums the gradient is made of.

    The derivative by a pose's standardised score is a softmax share, less one among the
    positives, plus the margin's active and anchor terms; its products with the features add up
    term by term, so the normalisers need not be known before.
    """
    pos, s, t = F.col("dockq") >= obj.q_thr, F.col("score"), obj.temperature
    scored = linear_score(pool, weights)
    stats = scored.groupBy(C).agg(
        F.avg(s).alias("_mean"), F.coalesce(F.stddev_pop(s), F.lit(0.0)).alias("_sd"), F.max(s).alias("_m"), F.max(F.when(pos, s)).alias("_mp"),
        F.count_if(pos).alias("_np"), F.count_if(~pos).alias("_nn"), F.min(F.when(pos, F.struct(settled("score").alias("_s"), "pose_id", s.alias("score")))).alias("_low"))
    z = lambda c: (c - F.col("_mean")) / F.col("_scale")
    j = scored.join(stats.withColumn("_scale", F.greatest("_sd", F.lit(1.0))), C)
    j = j.select(C, *[v.cast("double").alias(f"_x{i}") for i, v in enumerate(x)], z(s).alias("_z"), pos.alias("_pos"), "_np", "_nn", "_scale", (F.col("_sd") < 1.0).alias("_fixed"),
                 F.exp((z(s) - z(F.col("_m"))) / t).alias("_e"), F.when(pos, F.exp((z(s) - z(F.col("_mp"))) / t)).alias("_ep"),
                 (~pos & (obj.margin + z(s) - z(F.col("_low.score")) > 0)).alias("_on"), (pos & (F.col("pose_id") == F.col("_low.pose_id"))).alias("_at"))
    values = [F.col(f"_x{i}") for i in range(len(x))] + [F.col("_z"), F.lit(1.0)]
    sums = j.groupBy(C).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_scale").alias("_scale"), F.max("_fixed").alias("_fixed"), F.max("_np").alias("_np"), F.max("_nn").alias("_nn"),
        F.array(*[F.sum(F.col("_e") * v) for v in values]).alias("_ex"), F.array(*[F.coalesce(F.sum(F.col("_ep") * v), F.lit(0.0)) for v in values]).alias("_px"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("_on"), v)), F.lit(0.0)) for v in values]).alias("_ax"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("_at"), v)), F.lit(0.0)) for v in values]).alias("_lx"),
        F.array(*[F.sum(v) for v in values]).alias("_sx"), F.array(*[F.sum(F.col("_z") * v) for v in values]).alias("_zx"))
    last = len(values)
    of = lambda name: F.element_at(name, last)
    live, both = F.col("_np") > 0, (F.col("_np") > 0) & (F.col("_nn") > 0)

    def total(k: Column) -> Column:
        """Sum of g times value k."""
        g = F.lit(0.0)
        if obj.basin:
            g = g + F.when(live, (F.get("_ex", k) / of("_ex") - F.get("_px", k) / of("_px")) / t).otherwise(0.0)
        if obj.negatives == "minanchor":
            g = g + F.when(both, obj.lambda_margin * (F.get("_ax", k) - of("_ax") * F.get("_lx", k)) / F.col("_nn")).otherwise(0.0)
        return g

    mean_g = total(F.lit(last - 1)) / F.col("_n")
    mean_gz = F.when(F.col("_fixed"), F.lit(0.0)).otherwise(total(F.lit(last - 2)) / F.col("_n"))
    sums = sums.withColumns({"_mg": mean_g, "_mgz": mean_gz})
    grad = F.transform(F.sequence(F.lit(0), F.lit(last - 3)), lambda k: (
        total(k) - F.col("_mg") * F.get("_sx", k) - F.col("_mgz") * F.get("_zx", k)) / F.col("_scale"))
    return sums.select(C, grad.alias("grad"))


def complex_gradients(pool: DataFrame, weights: Weights, obj: Objective, length: int) -> DataFrame:
    """Gradient of the data loss of every complex by (c_pair, n_ss, n_sc, n_cc, t...) coefficients.

    The chain through the standardisation needs only sums of g, z and the features,
    so one aggregate per complex yields the whole vector as an array ``grad``.
    """
    cols = [c for c in SHAPE if c in pool.columns]
    if len(cols) + length <= FUSED and obj.negatives in ("minanchor", "none") and not obj.lambda_shape:
        return _fused_gradients(pool, weights, obj, [F.col(c) for c in cols] + [F.col("t")[k] for k in range(length)])
    scored = standardize_with_scale(linear_score(pool, weights))
    g = pose_gradients(scored, obj)
    x = [F.col(c) for c in cols] + [F.col("t")[k] for k in range(length)]
    sums = g.groupBy(C).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("g").alias("_g"), F.sum(F.col("g") * F.col("z")).alias("_gz"),
        F.max("_scale").alias("_scale"), F.max("_fixed").alias("_fixed"),
        F.array(*[F.sum(F.col("g") * v) for v in x]).alias("_gx"), F.array(*[F.sum(v) for v in x]).alias("_x"),
        F.array(*[F.sum(F.col("z") * v) for v in x]).alias("_zx"))
    mean_g = F.col("_g") / F.col("_n")
    mean_gz = F.when(F.col("_fixed"), F.lit(0.0)).otherwise(F.col("_gz") / F.col("_n"))
    parts = F.arrays_zip("_gx", "_x", "_zx")
    grad = F.transform(parts, lambda p: (p["_gx"] - mean_g * p["_x"] - mean_gz * p["_zx"]) / F.col("_scale"))
    return sums.select(C, grad.alias("grad"))


def standardize_with_scale(pool: DataFrame, score: str = "score", floor: float = 1.0) -> DataFrame:
    """z with the scale used, and whether the floor fixed it."""
    m = pool.groupBy(C).agg(F.avg(score).alias("_mean"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("_sd"))
    out = pool.join(m, C).withColumn("_scale", F.greatest("_sd", F.lit(float(floor)))).withColumn("_fixed", F.col("_sd") < floor)
    return out.withColumn("z", (F.col(score) - F.col("_mean")) / F.col("_scale")).drop("_mean", "_sd")


def mean_gradient(pool: DataFrame, weights: Weights, obj: Objective, length: int) -> DataFrame:
    """Mean over complexes of the gradient, in long form (k, grad)."""
    per = complex_gradients(pool, weights, obj, length)
    return per.select(F.posexplode("grad").alias("k", "_g")).groupBy("k").agg(F.avg("_g").alias("grad"))


def objective_value(pool: DataFrame, weights: Weights, obj: Objective) -> DataFrame:
    """Mean data loss over complexes."""
    z = standardize(linear_score(pool, weights))
    return complex_losses(z, obj).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("complexes"))


def prior(model: Model, start: Model) -> float:
    """Squared distance of the table and of the log clash weights from the start."""
    table = sum((a - b) ** 2 for a, b in zip(model.table, start.table))
    clash = sum((math.log(max(a, 1e-12)) - math.log(max(b, 1e-12))) ** 2 for a, b in zip(model.clash(), start.clash()))
    return table + clash


def _chain(model: Model, start: Model, grad: list[float], obj: Objective) -> tuple[list[float], list[float]]:
    """(shape gradient, table gradient) from coefficient gradients, prior included.

    Coefficients: alpha on c_pair, minus the clash weights, minus the table.
    """
    w = model.clash()
    w0 = start.clash()
    d_alpha = grad[0]
    d_w = [-g for g in grad[1:4]]
    log_gap = [2 * obj.lambda_prior * (math.log(max(a, 1e-12)) - math.log(max(b, 1e-12))) for a, b in zip(w, w0)]
    if model.log_clash is not None:
        shape = [d_alpha] + [dw * wk + lg for dw, wk, lg in zip(d_w, w, log_gap)]
    else:
        d_alpha += sum(dw * model.rho ** k for dw, k in zip(d_w, (2, 3, 4))) + sum(log_gap) / max(model.alpha, 1e-12)
        d_rho = sum(dw * model.alpha * k * model.rho ** (k - 1) for dw, k in zip(d_w, (2, 3, 4)))
        d_rho += sum(lg * k / model.rho for lg, k in zip(log_gap, (2, 3, 4)))
        shape = [d_alpha, d_rho]
    table = [-g + 2 * obj.lambda_prior * (a - b) for g, a, b in zip(grad[4:], model.table, start.table)]
    if model.basis is not None:
        step = [sum(b * t for b, t in zip(row, table)) for row in model.basis]
        table = [sum(s * row[k] for s, row in zip(step, model.basis)) for k in range(len(table))]
    return shape, table


#: Folders of a stored pool at most.
MOST_BUCKETS = 4096
#: Rows of a stored pool that go into one file.
STORED_ROWS = 250_000


def bucketed_pool(pool: DataFrame, batch: int) -> tuple[DataFrame, DataFrame, int]:
    """The pool, written by buckets of about ``batch`` complexes; (bucket, complex) of every
    complex; and the number of complexes.

    A step that joins the pool with its complexes reads their buckets only: the folders are
    pruned at run time by the join itself.  A bucket of many rows is dealt to several tasks.
    """
    spark = pool.sparkSession
    n, size = pool.groupBy(C).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    spread(spark, size)
    buckets = max(1, min(MOST_BUCKETS, -(-n // max(1, batch))))
    keyed = pool.withColumn("bucket", F.pmod(F.xxhash64(C), F.lit(buckets)).cast("int"))
    share = F.pmod(F.xxhash64(*pool.columns), F.lit(max(1, -(-size // (buckets * STORED_ROWS)))))
    path = shared_folder(spark, "fit")
    keyed.withColumn("_share", share).repartition("bucket", "_share").drop("_share").write.partitionBy("bucket").parquet(path)
    rows = spark.read.schema(keyed.schema).parquet(path)
    return rows, cut(rows.select("bucket", C).distinct()), n


@dataclass
class FitResult:
    model: Model
    trajectory: list[dict] = field(default_factory=list)


def fit_adam(fit: DataFrame, validation: DataFrame, start: Model, obj: Objective = Objective(),
             cfg: AdamConfig = AdamConfig()) -> FitResult:
    """Adam over minibatches of complexes with early stopping on the validation data loss.

    Both pools are written once, the fitted one by buckets of complexes.  A minibatch is a
    hashed set of complexes that meets the pool in a join, so a step reads only their buckets
    and no id list leaves the driver.  The best checkpoint is restored at the end.
    """
    length = len(start.table)
    fit, ids, n_complexes = bucketed_pool(fit, cfg.batch)
    validation = cut(validation)
    share = min(1.0, cfg.batch / max(1, n_complexes))
    key = fit.schema[C].dataType.typeName()
    hashed = F.col(C) if key in ("long", "integer") else F.xxhash64(C)
    model = replace(start, table=list(start.table))
    # Place of every gradient entry, also where a pool lacks some of the shape columns.
    place = [i for i, c in enumerate(SHAPE) if c in fit.columns] + list(range(4, 4 + length))
    n_shape = 1 + (3 if start.log_clash is not None else 1)
    m = [0.0] * (n_shape + length)
    v = [0.0] * (n_shape + length)
    best, best_model = _value(validation, model, obj), replace(model, table=list(model.table))
    log = [{"step": 0, "validation": best, "gradient": None, "accepted": True}]
    stale = 0
    for step in range(1, cfg.steps + 1):
        take = mix(hashed, cfg.seed * 100_003 + step) < int(share * 2147483647)
        few = fit if share >= 1.0 else fit.join(ids.filter(take), ["bucket", C])
        rows = mean_gradient(few, model.weights(), obj, length).collect()
        if not rows:
            continue
        grad = [0.0] * (4 + length)
        for r in rows:
            grad[place[r["k"]]] = r["grad"]
        shape, table = _chain(model, start, grad, obj)
        if model.freeze_shape:
            shape = [0.0] * n_shape
        g = shape + table
        norm = math.sqrt(sum(x * x for x in g))
        if norm > cfg.clip:
            g = [x * cfg.clip / norm for x in g]
        rates = [cfg.alpha_lr] + [cfg.rho_lr] * (n_shape - 1) + [cfg.table_lr] * length
        m = [0.9 * a + 0.1 * x for a, x in zip(m, g)]
        v = [0.999 * a + 0.001 * x * x for a, x in zip(v, g)]
        move = [r * (a / (1 - 0.9 ** step)) / (math.sqrt(b / (1 - 0.999 ** step)) + 1e-8) for r, a, b in zip(rates, m, v)]
        if not model.freeze_shape:
            model.alpha = min(cfg.alpha_max, max(0.0, model.alpha - move[0]))
            if model.log_clash is not None:
                low = min(math.log(max(model.alpha, 1e-12)) + k * math.log(cfg.rho_min) for k in (2, 3, 4))
                high = max(math.log(max(model.alpha, 1e-12)) + k * math.log(cfg.rho_max) for k in (2, 3, 4))
                model.log_clash = [min(high, max(low, c - d)) for c, d in zip(model.log_clash, move[1:4])]
            else:
                model.rho = min(cfg.rho_max, max(cfg.rho_min, model.rho - move[1]))
        model.table = [t - d for t, d in zip(model.table, move[n_shape:])]
        if step % cfg.val_every == 0 or step == cfg.steps:
            loss = _value(validation, model, obj)
            good = loss < best - cfg.min_delta
            log.append({"step": step, "validation": loss, "gradient": norm, "accepted": good})
            if good:
                best, stale = loss, 0
                best_model = replace(model, table=list(model.table), log_clash=list(model.log_clash) if model.log_clash else None)
            else:
                stale += 1
                if stale >= cfg.patience:
                    break
    return FitResult(best_model, log)


def _value(pool: DataFrame, model: Model, obj: Objective) -> float:
    row = objective_value(pool, model.weights(), obj).first()
    return float("inf") if row["loss"] is None else float(row["loss"])


# --- convex fit -----------------------------------------------------------------

def affine_pool(pool: DataFrame, weights: Weights, q_thr: float = THRESHOLD) -> DataFrame:
    """Poses as score = c + f . e: the constant c holds shape and charge, the features are -t.

    Only complexes with both classes remain.
    """
    base = linear_score(pool, replace(weights, table=()), "c")
    classes = base.groupBy(C).agg(F.count_if(F.col("dockq") >= q_thr).alias("_p"), F.count(F.lit(1)).alias("_n"))
    both = classes.filter((F.col("_p") > 0) & (F.col("_p") < F.col("_n"))).select(C)
    return base.join(both, C).select(C, "pose_id", "c", F.transform("t", lambda x: -x).alias("f"), (F.col("dockq") >= q_thr).alias("pos"))


def _affine(e: Sequence[float]) -> Column:
    return F.col("c") + weighted_sum(F.col("f"), e)


def anchors(affine: DataFrame, e: Sequence[float]) -> DataFrame:
    """Best positive of every complex under e."""
    s = affine.filter("pos").withColumn("_s", _affine(e))
    best = s.groupBy(C).agg(F.max_by(F.struct("pose_id", "c", "f"), F.struct("_s", -F.col("pose_id"))).alias("_a"))
    return best.select(C, F.col("_a.pose_id").alias("anchor"), F.col("_a.c").alias("ca"), F.col("_a.f").alias("fa"))


def hinge_terms(affine: DataFrame, anchor: DataFrame, e: Sequence[float], eps: float = 1.0) -> DataFrame:
    """Hinge and subgradient of every complex: hardest negative against the anchor."""
    s = affine.filter(~F.col("pos")).withColumn("_s", _affine(e))
    worst = s.groupBy(C).agg(F.max_by(F.struct("pose_id", "f", "_s"), F.struct("_s", -F.col("pose_id"))).alias("_w"))
    j = worst.join(anchor, C)
    target = F.col("ca") + weighted_sum(F.col("fa"), e)
    gap = F.col("_w._s") - target + eps
    slope = F.when(gap > 0, F.zip_with(F.col("_w.f"), F.col("fa"), lambda a, b: a - b)).otherwise(
        F.transform("fa", lambda x: F.lit(0.0)))
    return j.select(C, F.greatest(F.lit(0.0), gap).alias("hinge"), slope.alias("slope"))


def hinge_value(affine: DataFrame, anchor: DataFrame, e: Sequence[float], eps: float = 1.0) -> DataFrame:
    """Mean hinge and mean subgradient (one row)."""
    d = len(e)
    return hinge_terms(affine, anchor, e, eps).agg(
        F.avg("hinge").alias("hinge"), F.array(*[F.avg(F.col("slope")[k]) for k in range(d)]).alias("slope"))


class Bundle:
    """Minimum of a convex mean hinge plus lam/2 |e - e0|^2 by cutting planes.

    Every evaluation adds a plane below the hinge; the planes' own minimum is the next
    point and bounds the wanted minimum from below, so the gap to the best value so far
    certifies it.  All of it is vectors of the size of ``e`` on the driver.  ``basis``
    (orthonormal rows) limits the move to e0 + B theta.
    """

    def __init__(self, e0: Sequence[float], lam: float, basis: Sequence[Sequence[float]] | None = None, tol: float = TOLERANCE):
        if lam <= 0:
            raise ValueError("the fit needs lam > 0: without it the minimum need not exist")
        self.e0, self.lam, self.tol = np.array(e0, float), float(lam), tol
        self.basis = None if basis is None else np.array(basis, float)
        self.move = np.zeros(len(self.e0) if basis is None else len(self.basis))
        self.slopes, self.heights, self.shares = np.zeros((0, len(self.move))), np.zeros(0), np.zeros(0)
        self.best, self.best_e, self.bound = float("inf"), self.e0, -float("inf")
        self.stalled = 0

    @property
    def point(self) -> list[float]:
        return (self.e0 + (self.move if self.basis is None else self.move @ self.basis)).tolist()

    @property
    def settled(self) -> bool:
        return math.isfinite(self.best) and self.best - self.bound <= self.tol * max(1.0, abs(self.best))

    def add(self, hinge: float, slope: Sequence[float]) -> float:
        """The objective at the current point; moves on to the next one."""
        value, gap = hinge + 0.5 * self.lam * float(self.move @ self.move), self.best - self.bound
        if value < self.best:
            self.best, self.best_e = value, np.array(self.point)
        g = np.array(slope, float)
        g = g if self.basis is None else self.basis @ g
        self.slopes = np.vstack([self.slopes, g])
        self.heights = np.append(self.heights, hinge - g @ self.move)
        self.shares = np.append(self.shares, 0.0 if len(self.shares) else 1.0)
        for _ in range(20_000):  # weight moves from the lowest plane in use to the highest
            self.move = -self.shares @ self.slopes / self.lam
            level = self.heights + self.slopes @ self.move
            up, down = int(level.argmax()), int(np.where(self.shares > 0, level, np.inf).argmin())
            apart = self.slopes[up] - self.slopes[down]
            if level[up] - level[down] <= 1e-3 * self.tol or not apart.any():
                break
            step = min(self.shares[down], (level[up] - level[down]) * self.lam / float(apart @ apart))
            self.shares[up] += step
            self.shares[down] -= step
        self.move = -self.shares @ self.slopes / self.lam
        self.bound = max(self.bound, float(self.shares @ self.heights) - 0.5 * self.lam * float(self.move @ self.move))
        self.stalled = 0 if not math.isfinite(gap) or self.best - self.bound < gap else self.stalled + 1
        if self.stalled > STALLED and not self.settled:
            raise RuntimeError(f"the gap of {self.best - self.bound:g} no longer closes; ask for a larger tol than {self.tol:g}")
        return value


def hinge_fit(affine: DataFrame, e0: Sequence[float], lam: float, steps: int | None = None, eps: float = 1.0,
              basis: Sequence[Sequence[float]] | None = None, reanchor: int = 1, tol: float = TOLERANCE) -> tuple[list[float], list[float]]:
    """Minimise mean hinge + lam/2 |e - e0|^2; one pass over the pool for each evaluation.

    Goes on until the objective is within ``tol`` of its minimum, or for ``steps``
    evaluations where that is asked for.  With ``reanchor`` > 1 the anchors are chosen
    again at the solution until none moves.  Returns the best e and the objective after
    each evaluation.
    """
    e = list(map(float, e0))
    history: list[float] = []
    affine = cut(affine)
    spot = cut(anchors(affine, e))
    for turn in range(reanchor):
        fit = Bundle(e0, lam, basis, tol)
        done = 0
        while not fit.settled and (steps is None or done < steps):
            row = hinge_value(affine, spot, fit.point, eps).first()
            history.append(fit.add(row["hinge"], row["slope"]))
            done += 1
        e = fit.best_e.tolist()
        if turn + 1 < reanchor:
            again = anchors(affine, e)
            moved = spot.join(again.select(C, F.col("anchor").alias("_b")), C).filter(F.col("anchor") != F.col("_b")).limit(1).count()
            if not moved:
                break
            spot = cut(again)
    return e, history


def top1_table(affine: DataFrame, settings: dict[str, Sequence[float]]) -> DataFrame:
    """Per setting: complexes whose best pose is positive; every setting in one pass."""
    best = affine.groupBy(C).agg(*[F.max_by("pos", F.struct(_affine(e).alias("_s"), -F.col("pose_id"))).alias(f"_ok{i}") for i, e in enumerate(settings.values())])
    rows = best.select(F.inline(F.array(*[F.struct(F.lit(k).alias("setting"), F.col(f"_ok{i}").alias("_ok")) for i, k in enumerate(settings)])))
    return rows.groupBy("setting").agg(F.count_if("_ok").alias("top1"), F.count(F.lit(1)).alias("complexes"))


def top1_count(pool: DataFrame, weights: Weights, q_thr: float = THRESHOLD) -> DataFrame:
    """Complexes whose best-scoring pose is positive, and all complexes."""
    s = linear_score(pool, weights, "_s")
    best = s.groupBy(C).agg(F.max_by(F.col("dockq") >= q_thr, F.struct(settled("_s"), -F.col("pose_id"))).alias("_ok"))
    return best.agg(F.count_if("_ok").alias("top1"), F.count(F.lit(1)).alias("complexes"))


def _worst(vectors: np.ndarray, columns: Sequence[str]):
    """Of the runs of each complex in a batch, the highest row under every vector; of equal ones that of the smallest pose."""

    def worst(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.asarray(batch[C].dictionary_encode().indices)
            starts = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
            run = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(code)))
            length = vectors.shape[1]
            f = np.asarray(batch["f"].flatten().to_numpy(zero_copy_only=False), float).reshape(-1, length).T.copy()
            c = batch["c"].to_numpy(zero_copy_only=False)
            # A pose without an id comes after the others.
            pose = np.asarray(pc.rank(batch["pose_id"], "ascending", null_placement="at_end") if batch["pose_id"].null_count else batch["pose_id"])
            job, row, score = [], [], []
            for j, e in enumerate(vectors):
                # The order of the terms is that of weighted_sum.
                total = np.zeros(len(c))
                for k in range(length):
                    total += f[k] * e[k]
                s = c + total
                ranked = np.where(batch[f"_use{j}"].fill_null(False).to_numpy(zero_copy_only=False) & ~np.isnan(s), s, -np.inf)
                at = np.flatnonzero((ranked == np.maximum.reduceat(ranked, starts)[run]) & (ranked > -np.inf))
                at = at[np.lexsort((pose[at], run[at]))]
                at = at[np.diff(run[at], prepend=-1) != 0]
                job.append(np.full(len(at), j, np.int32))
                row.append(at)
                score.append(s[at])
            kept = batch.take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(job)), *[kept[x] for x in (C, "pose_id", "f")], pa.array(np.concatenate(score))], list(columns))

    return worst


def _packed(batches):
    """Neighbouring poses of one complex as a row: their ids, and their constants and features as 64-bit floats."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [x for x in batch.schema.names if x not in ("pose_id", "c", "f")]
        length = len(batch["f"][0])
        code = np.stack([np.asarray(batch[x].dictionary_encode().indices.fill_null(-1)) for x in keys])
        new = np.append(True, (np.diff(code) != 0).any(0))
        first = np.flatnonzero(new)
        place = np.arange(batch.num_rows) - np.repeat(first, np.diff(first, append=batch.num_rows))
        at = np.flatnonzero(place % max(1, PACKED // (8 * (length + 1))) == 0)
        ends = np.append(at, batch.num_rows).astype(np.int32)

        def blob(values, width):
            data = np.ascontiguousarray(values.to_numpy(zero_copy_only=False), float)
            return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends * np.int32(8 * width)), pa.py_buffer(data)])

        own = batch.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([*[own[x] for x in keys], pa.ListArray.from_arrays(pa.array(ends), batch["pose_id"]), blob(batch["c"], 1),
                                          blob(batch["f"].flatten(), length)], [*keys, "pose_id", "c", "f"])


def _floats(blobs) -> np.ndarray:
    """All of a column of blobs, as they lie."""
    kind = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
    ends = np.frombuffer(blobs.buffers()[1], kind)[blobs.offset:blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(float)


def _poses(batches, length: int):
    """The poses of packed rows, one a row again, some tens of thousands at a time."""
    for batch in batches:
        many = np.diff(np.asarray(batch["pose_id"].offsets))
        piece = np.cumsum(many) // POSES
        for start in np.flatnonzero(np.diff(piece, prepend=-1)).tolist():
            part = batch.slice(start, int(np.searchsorted(piece, piece[start], "right")) - start)
            at = pa.array(np.repeat(np.arange(part.num_rows), many[start:start + part.num_rows]))
            c = _floats(part["c"])
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * np.int32(length)), pa.array(_floats(part["f"])))
            own = part.select([x for x in part.schema.names if x not in ("pose_id", "c", "f")]).take(at)
            yield pa.RecordBatch.from_arrays([*own.columns, part["pose_id"].flatten(), pa.array(c), f], [*own.schema.names, "pose_id", "c", "f"])


def _batched_hinge(packed: DataFrame, jobs: dict[str, tuple[list[float], Column]], anchor: DataFrame, eps: float) -> dict:
    """Mean hinge and slope of several parameter vectors, each on its own complexes, in one pass.

    ``packed`` are the negatives of :func:`_by_complex`; every batch of them sends on the
    hardest one of each complex and vector only."""
    names, vectors = list(jobs), np.array([e for e, _ in jobs.values()], float)
    d = vectors.shape[1]
    kind = {f.name: f.dataType for f in packed.schema}
    columns = ["_job", C, "pose_id", "f", "_s"]
    worst = _worst(vectors, columns)
    ship(packed.sparkSession)
    rows = packed.select(C, "pose_id", "c", "f", *[use.alias(f"_use{j}") for j, (_, use) in enumerate(jobs.values())]).mapInArrow(
        lambda batches: worst(_poses(batches, d)),
        f"_job int, `{C}` {kind[C].simpleString()}, pose_id {kind['pose_id'].elementType.simpleString()}, f array<double>, _s double")
    worst = rows.groupBy("_job", C).agg(F.max_by(F.struct("f", "_s"), F.struct("_s", -F.col("pose_id"))).alias("_w"))
    # One literal holds all vectors, so that passes share their generated code.
    e = F.slice(F.lit(vectors.ravel()), F.col("_job") * d + 1, F.lit(d))
    j = worst.join(anchor, C).withColumn("_gap", F.col("_w._s") - (F.col("ca") + F.aggregate(F.zip_with("fa", e, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)) + eps)
    slope = F.when(F.col("_gap") > 0, F.zip_with("_w.f", "fa", lambda a, b: a - b)).otherwise(F.transform("fa", lambda v: F.lit(0.0)))
    parts = j.select("_job", F.posexplode(F.concat(F.array(F.greatest(F.lit(0.0), F.col("_gap"))), slope)).alias("k", "_v"))
    out: dict = {}
    for r in sorted(parts.groupBy("_job", "k").agg(F.avg("_v").alias("_v")).collect()):
        out.setdefault(names[r["_job"]], []).append(r["_v"])
    return {name: (v[0], v[1:]) for name, v in out.items()}


def _by_complex(affine: DataFrame) -> DataFrame:
    """The negatives, packed and stored in the order of (complex, pose): a hot complex still spreads over many files.

    A pass reads all of them, and numbers in blobs pass from file to Python as they are.
    Poses without a score are left out: they are never the hardest.
    """
    spark = affine.sparkSession
    neg = affine.filter(~F.col("pos") & F.col("c").isNotNull() & F.col("f").isNotNull()).drop("pos").withColumns(
        {"c": F.col("c").cast("double"), "f": F.col("f").cast("array<double>")})
    keys = [f.name for f in neg.schema if f.name not in ("pose_id", "c", "f") and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    kind = {f.name: f.dataType.simpleString() for f in neg.schema}
    path = shared_folder(spark, "hinge")
    ship(spark)
    with shuffles_freed(spark):
        rows = neg.repartitionByRange(C, "pose_id").sortWithinPartitions(C, F.col("pose_id").asc_nulls_last()).select(*keys, "pose_id", "c", "f").mapInArrow(
            _packed, ", ".join(f"`{x}` {kind[x]}" for x in keys) + f", pose_id array<{kind['pose_id']}>, c binary, f binary")
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _kept_fit(affine: DataFrame, e0: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    return _by_complex(affine), cut(anchors(affine, list(map(float, e0))))


def hinge_fit_many(affine: DataFrame, e0: Sequence[float], jobs: dict[str, tuple[float, Column]], steps: int | None = None,
                   eps: float = 1.0, bases: dict[str, Sequence[Sequence[float]]] | None = None, tol: float = TOLERANCE,
                   kept: tuple[DataFrame, DataFrame] | None = None) -> dict[str, list[float]]:
    """Several hinge fits side by side: job name -> (lambda, condition on the complex).

    Every evaluation is one pass over the negatives for all jobs that have not settled.
    ``kept``: the pool's :func:`_by_complex` and anchors, where other fits of it use them, too.
    """
    e0 = list(map(float, e0))
    fits = {name: Bundle(e0, lam, (bases or {}).get(name), tol) for name, (lam, _) in jobs.items()}
    packed, spot = kept or _kept_fit(affine, e0)
    open_jobs, done = dict(jobs), 0
    while open_jobs and (steps is None or done < steps):
        got = _batched_hinge(packed, {n: (fits[n].point, use) for n, (_, use) in open_jobs.items()}, spot, eps)
        for name in got:
            fits[name].add(*got[name])
        open_jobs = {n: job for n, job in open_jobs.items() if n in got and not fits[n].settled}
        done += 1
    return {name: fit.best_e.tolist() for name, fit in fits.items()}


def lambda_path_cv(affine: DataFrame, folds: DataFrame, e0: Sequence[float], lambdas: Sequence[float], k: int,
                   steps: int | None = None, tol: float = TOLERANCE, kept: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, float]:
    """Cross-validated top-1 per lambda over whole-cluster folds, and the best lambda.

    ``folds``: (complex_id, fold).  All (lambda, fold) fits share each pass.  ``kept`` as in
    :func:`hinge_fit_many`, with the fold of each complex.
    """
    rows = affine.join(folds.select(C, "fold"), C)
    jobs = {f"{i}:{f}": (lam, F.col("fold") != f) for i, lam in enumerate(lambdas) for f in range(k)}
    fits = hinge_fit_many(rows, e0, jobs, steps, tol=tol, kept=kept)

    def score(i: int) -> Column:
        held = [F.when(F.col("fold") == f, _affine(fits[f"{i}:{f}"])) for f in range(k)]
        return F.coalesce(*held).alias("_s")

    best = rows.filter(F.col("fold").isin(*range(k))).groupBy(C).agg(
        *[F.max_by("pos", F.struct(score(i), -F.col("pose_id"))).alias(f"_ok{i}") for i in range(len(lambdas))])
    top = best.select(F.inline(F.array(*[F.struct(F.lit(i).alias("li"), F.col(f"_ok{i}").alias("_ok")) for i in range(len(lambdas))])))
    lut = F.array(*[F.lit(float(x)) for x in lambdas])
    table = top.groupBy("li").agg(F.count_if("_ok").alias("top1"), F.count(F.lit(1)).alias("complexes")).select(
        F.element_at(lut, F.col("li") + 1).alias("lam"), "top1", "complexes")
    ranked = sorted(((-r["top1"], -r["lam"]) for r in table.collect()))
    return table, -ranked[0][1]


@dataclass(frozen=True)
class Family:
    """A family of models affine in its parameters, which are zero at the published weights.

    ``table`` features are the (negated) table counts, projected on ``basis`` where one is
    given; ``shape`` adds the five of c_pair, the clash counts and the charge term; with
    ``buckets`` > 1 every size class of complexes has table parameters of its own.
    """

    table: bool = True
    basis: Sequence[Sequence[float]] | None = None
    shape: bool = False
    buckets: int = 1

    def size(self, length: int) -> int:
        own = 0 if not self.table else length if self.basis is None else len(self.basis)
        return own * self.buckets + (5 if self.shape else 0)


#: The families of the capacity study for a table of size x size.
def capacity_families(size: int = 12) -> dict[str, Family]:
    return {"shape": Family(table=False, shape=True), "sym": Family(basis=symmetric_additive_basis(size)), "add": Family(basis=additive_basis(size)),
            "full": Family(), "full+": Family(shape=True), "bucket2": Family(buckets=2), "bucket4": Family(buckets=4)}


def complex_sizes(pool: DataFrame) -> DataFrame:
    """complex_id, size: the lower median of the contacts that a pose makes, known before any ranking."""
    contacts = pool.select(C, F.aggregate("t", F.lit(0.0), lambda a, v: a + v).alias("_contacts"))
    return lower_median(contacts, C, "_contacts", "size")


def size_edges(pool: DataFrame, buckets: int) -> list[float]:
    """Edges of equally filled size classes; taken from the fitted set and used for any other."""
    if buckets < 2:
        return []
    row = quantiles_linear(complex_sizes(pool), [], "size", {f"e{k}": k / buckets for k in range(1, buckets)}).first()
    return [float(row[f"e{k}"]) for k in range(1, buckets)]


def family_pool(pool: DataFrame, weights: Weights, family: Family, edges: Sequence[float] = (), q_thr: float = THRESHOLD) -> DataFrame:
    """Poses as score = c + f . theta under a family: c is the published score, f the features.

    Only complexes with both classes remain.
    """
    base = linear_score(pool, weights, "c")
    classes = base.groupBy(C).agg(F.count_if(F.col("dockq") >= q_thr).alias("_p"), F.count(F.lit(1)).alias("_n"))
    base = base.join(classes.filter((F.col("_p") > 0) & (F.col("_p") < F.col("_n"))).select(C), C)
    parts = []
    if family.table:
        own = F.transform("t", lambda x: -x) if family.basis is None else F.array(*[-weighted_sum(F.col("t"), row) for row in family.basis])
        base = base.withColumn("_own", own)
        if family.buckets > 1:
            base = base.join(complex_sizes(pool), C)
            slot = sum((F.when(F.col("size") > float(e), 1).otherwise(0) for e in edges), F.lit(0))
            none = F.transform("_own", lambda x: F.lit(0.0))
            parts = [F.when(slot == b, F.col("_own")).otherwise(none) for b in range(family.buckets)]
        else:
            parts = [F.col("_own")]
    if family.shape:
        parts.append(F.array(F.col("c_pair"), *[-F.col(n) for n in ("n_ss", "n_sc", "n_cc")], F.col("elec")))
    return base.select(C, "pose_id", "c", F.concat(*parts).alias("f"), (F.col("dockq") >= q_thr).alias("pos"))


def learning_curve(fit: DataFrame, validation: DataFrame, weights: Weights, families: dict[str, Family], sizes: Sequence[int], repeats: int,
                   lambdas: Sequence[float], folds: DataFrame, k: int, steps: int | None = None, seed: int = 0, tol: float = TOLERANCE) -> DataFrame:
    """family, size, lam, top1: mean validation top-1 over random subsets of complexes.

    Per family the lambda of the best cross-validated top-1 over whole-cluster folds (the first
    of equal ones) is chosen on the fitted set; the subsets are refitted with it.  A subset is
    the first ``size`` complexes in a hashed order of the repeat.  All fits of a family share
    each pass over its stored pool.
    """
    length = len(weights.table)
    ids = fit.select(C).distinct()
    for r in range(repeats):
        ids = with_order(ids.withColumn("_h", mix(F.col(C), seed + 31 * r)), [], "_h", C, rank=f"_o{r}").drop("_h")
    ids = cut(ids)
    out = None
    for name, family in families.items():
        edges = size_edges(fit, family.buckets)
        own = cut(family_pool(fit, weights, family, edges).join(ids, C))
        start = [0.0] * family.size(length)
        kept = _kept_fit(own.join(folds.select(C, "fold"), C, "left"), start)
        table, _ = lambda_path_cv(own, folds, start, lambdas, k, steps, tol, kept)
        got = {row["lam"]: row["top1"] for row in table.collect()}
        lam = max(lambdas, key=lambda x: (got.get(float(x), -1), -list(lambdas).index(x)))
        jobs = {f"{s}:{r}": (lam, F.col(f"_o{r}") <= s) for s in sizes for r in range(repeats)}
        fits = hinge_fit_many(own, start, jobs, steps, tol=tol, kept=kept)
        top = top1_table(family_pool(validation, weights, family, edges), fits)
        rows = top.select(F.lit(name).alias("family"), F.split("setting", ":")[0].cast("int").alias("size"), F.lit(float(lam)).alias("lam"),
                          (F.col("top1") / F.col("complexes")).alias("_t")).groupBy("family", "size", "lam").agg(F.avg("_t").alias("top1"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- where the gradient comes from --------------------------------------------------

def gradient_norms(pool: DataFrame, weights: Weights, obj: Objective, length: int, sample_sd: bool = False) -> DataFrame:
    """Norm of the table gradient per complex."""
    skip = len([c for c in SHAPE if c in pool.columns])
    per = complex_gradients(pool, weights, obj, length)
    part = F.slice("grad", skip + 1, length)
    return per.select(C, F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, v: s + v * v)).alias("norm"))


def gradient_share(norms: DataFrame, fractions: Sequence[float] = (0.05, 0.10, 0.25, 0.50),
                   levels: Sequence[float] = (0.5, 0.8, 0.9)) -> DataFrame:
    """Share of the total norm in the top complexes, and complexes needed for a share of it."""
    key = norms.schema[C].dataType.typeName()
    tie = C if key in ("long", "integer") else "_tie"
    rows = norms if tie == C else norms.withColumn("_tie", F.xxhash64(C))
    ordered = with_order(rows, [], "norm", tie, descending=True, rank="_r", running={"_run": "norm"})
    total = norms.agg(F.sum("norm").alias("_tot"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("norm") == 0).alias("zero"),
                      F.max("norm").alias("_max"))
    j = with_one(ordered, total)
    top = [F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(f))) for f in fractions]
    return j.agg(
        F.max("n").alias("n"), F.max("zero").alias("zero"), F.count_if(F.col("norm") < 0.01 * F.col("_max")).alias("below_1pct"),
        *[(F.sum(F.when(F.col("_r") <= t, F.col("norm"))) / F.max("_tot")).alias(f"top_{int(f * 100)}") for t, f in zip(top, fractions)],
        *[F.count_if(F.col("_run") - F.col("norm") < F.col("_tot") * l).alias(f"needed_{int(l * 100)}") for l in levels])


def _kept(rows: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder."""
    path = shared_folder(rows.sparkSession, "kept")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def virtual_step_report(pool: DataFrame, start: Model, steps: Sequence[int], lr: float = 5e-4, batch: int = 16,
                        q_thr: float = THRESHOLD, seed: int = 0) -> DataFrame:
    """Effect of a few shaping-only steps (from complexes without positives) on the ranking.

    One row per step count: mean gap, top-1, flips, and how the best pose of the
    complexes without positives moves.
    """
    # Stored, so that Spark knows how few the ids are and need not deal the pool out to find their rows.
    pool = _kept(pool)
    live = F.coalesce(F.max(F.col("dockq") >= q_thr), F.lit(False))
    dead = pool.join(_kept(pool.groupBy(C).agg(live.alias("_live")).filter(~F.col("_live")).select(C)), C, "left_semi")
    obj = Objective(basin=False, negatives="none", lambda_shape=1.0, lambda_prior=0.0, q_thr=q_thr)
    dead, dead_ids, n_dead = bucketed_pool(dead, batch)
    share = min(1.0, batch / max(1, n_dead))
    model = replace(start, table=list(start.table), freeze_shape=True)
    length = len(model.table)
    m, v = [0.0] * length, [0.0] * length
    settings = {"0": model.weights()}
    for step in range(1, max(steps) + 1):
        picked = dead if share >= 1.0 else dead.join(dead_ids.filter(mix(F.col(C), seed + step) < int(share * 2147483647)), ["bucket", C])
        grad = [0.0] * length
        skip = len([c for c in SHAPE if c in pool.columns])
        for r in mean_gradient(picked, model.weights(), obj, length).collect():
            if r["k"] >= skip:
                grad[r["k"] - skip] = -(r["grad"] or 0.0)
        m = [0.9 * a + 0.1 * g for a, g in zip(m, grad)]
        v = [0.999 * a + 0.001 * g * g for a, g in zip(v, grad)]
        model.table = [t - lr * (a / (1 - 0.9 ** step)) / (math.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
                       for t, a, b in zip(model.table, m, v)]
        if step in steps:
            settings[str(step)] = model.weights()
    return ranking_shift(pool, settings, q_thr)


def ranking_shift(pool: DataFrame, settings: dict[str, Weights], q_thr: float = THRESHOLD) -> DataFrame:
    """Margins, top-1 and flips of every weight setting against the setting named "0".

    A pose is one row with a score for each setting.  Scores are standardised by complex, which
    keeps their order, so the margin follows from the best scores and the moments alone.
    """
    rows = pool
    for i, weights in enumerate(settings.values()):
        rows = linear_score(rows, weights, f"_score_{i}")
    rows = rows.select(C, "pose_id", "dockq", *[f"_score_{i}" for i in range(len(settings))])
    pos = F.col("dockq") >= q_thr

    each = range(len(settings))
    score = [F.col(f"_score_{i}") for i in each]
    best = F.col("dockq").eqNullSafe(F.col("_q"))
    top = [settled(f"_score_{i}").eqNullSafe(F.col(f"_top_{i}")) for i in each]

    def gap(s: Column) -> Column:
        scale = F.greatest(F.coalesce(F.stddev_pop(s), F.lit(0.0)), F.lit(1.0))
        return (F.max(F.when(pos, s)) - F.avg(s)) / scale - (F.max(F.when(~pos, s)) - F.avg(s)) / scale

    # Plain numbers in every aggregate: Spark hashes them, where it would sort rows for structs.
    per = rows.groupBy(C).agg(F.max(pos).alias("live"), F.max("dockq").alias("_q"), *[gap(s).alias(f"_gap_{i}") for i, s in zip(each, score)],
                              *[settled(F.max(s)).alias(f"_top_{i}") for i, s in zip(each, score)])
    marked = rows.join(per, C).groupBy(C).agg(
        F.max("live").alias("live"), *[F.max(f"_gap_{i}").alias(f"_gap_{i}") for i in each],
        *[F.coalesce(F.min(F.when(t & pos, F.col("pose_id"))) == F.min(F.when(t, F.col("pose_id"))), F.lit(False)).alias(f"_ok_{i}") for i, t in zip(each, top)],
        *[F.min_by(settled(f"_score_{i}"), F.when(best, F.col("pose_id"))).alias(f"_sb_{i}") for i in each])
    j = rows.select(C, *score).join(marked, C).groupBy(C).agg(
        F.max("live").alias("live"), *[F.max(f"_{c}_{i}").alias(f"_{c}_{i}") for c in ("gap", "ok") for i in each],
        *[(F.count_if(settled(f"_score_{i}") > F.col(f"_sb_{i}")) + 1).alias(f"_rank_{i}") for i in each])
    base = list(settings).index("0")
    j = j.select("live", F.col(f"_ok_{base}").alias("_ok0"), F.col(f"_rank_{base}").alias("_r0"), F.inline(F.array(*[
        F.struct(F.lit(name).alias("condition"), F.col(f"_gap_{i}").alias("gap"), F.col(f"_ok_{i}").alias("ok"), F.col(f"_rank_{i}").alias("best_rank"))
        for i, name in enumerate(settings)])))
    live = F.col("live")
    return j.groupBy("condition").agg(
        F.count_if(live).alias("live"), F.count_if(live & F.col("ok")).alias("top1"), F.avg(F.when(live, F.col("gap"))).alias("mean_gap"),
        F.count_if(live & F.col("ok") & ~F.col("_ok0")).alias("won"), F.count_if(live & ~F.col("ok") & F.col("_ok0")).alias("lost"),
        F.count_if(~live).alias("dead"), F.count_if(~live & (F.col("best_rank") < F.col("_r0"))).alias("dead_better"),
        F.count_if(~live & (F.col("best_rank") > F.col("_r0"))).alias("dead_worse"))
