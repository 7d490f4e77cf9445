"""Pose scores: linear in the weights, with the counts as features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.functions.columns import weighted_sum


@dataclass(frozen=True)
class Weights:
    """One weight setting; ``table`` is flat, in the order of the feature array.

    For a pair table use :func:`flat_table`.
    """

    alpha: float
    clash: tuple[float, float, float]
    table: tuple[float, ...] = ()
    beta: float = 0.0


def clash_weights(alpha: float, rho: float) -> tuple[float, float, float]:
    """alpha * rho**k for surface-surface, surface-core and core-core overlaps."""
    return tuple(alpha * rho ** k for k in (2, 3, 4))


def volume_factor(h: float, reference: float | None = fixed.REFERENCE_SPACING) -> float:
    """Scale of cell counts relative to the reference spacing."""
    return 1.0 if reference is None else h ** 3 / reference ** 3


def flat_table(table: Sequence[Sequence[float]] = fixed.PAIR_TABLE) -> tuple[float, ...]:
    """Pair table as a feature-order vector: column by column, so position
    12 * receptor type + ligand type holds entry (ligand type, receptor type)."""
    size = len(table)
    return tuple(table[i][j] for j in range(size) for i in range(size))


def shape_score(weights: Weights, k_vol: float = 1.0, legacy_volume: bool = False) -> Column:
    w1, w2, w3 = (float(w) for w in weights.clash)
    clash = w1 * F.col("n_ss") + w2 * F.col("n_sc") + w3 * F.col("n_cc")
    gain = weights.alpha * F.col("c_pair")
    if legacy_volume:
        return k_vol * (gain - clash)
    return gain - (clash if k_vol == 1.0 else k_vol * clash)


def linear_score(pool: DataFrame, weights: Weights, name: str = "score", *, k_vol: float = 1.0,
                 legacy_volume: bool = False) -> DataFrame:
    """Score every pose from its stored counts; a projection, no shuffle.

    A pool that only holds a collapsed shape term (column ``sc``) is scored from
    that term instead of the four counts.
    """
    if "sc" in pool.columns and "n_ss" not in pool.columns:
        shape = weights.alpha * F.col("sc")
    elif "c_pair" in pool.columns:
        shape = shape_score(weights, k_vol, legacy_volume)
    else:
        shape = F.lit(0.0)
    score = shape
    if "t" in pool.columns and weights.table:
        score = score - weighted_sum(F.col("t"), weights.table)
    if "elec" in pool.columns:
        score = score + weights.beta * F.col("elec")
    return pool.withColumn(name, score)


def settled(score: str | Column) -> Column:
    """A score as it orders poses: the last bits of a sum of terms depend on which terms make it
    up, so poses of equal score would be told apart by them and not by their ids."""
    return F.round(score, 9)


def score_many(pool: DataFrame, settings: dict[str, Weights], keep: Sequence[str]) -> DataFrame:
    """Long form (condition, score): every pose under several weight settings in one scan."""
    scores = pool
    for name, weights in settings.items():
        scores = linear_score(scores, weights, f"_score_{name}")
    pairs = F.array(*[
        F.struct(F.lit(name).alias("condition"), F.col(f"_score_{name}").alias("score")) for name in settings
    ])
    return scores.select(*keep, F.inline(pairs))


def term_columns(pool: DataFrame, weights: Weights, k_vol: float = 1.0) -> DataFrame:
    """Per-pose contribution of every term and their total."""
    w = weights.clash
    pool = pool.withColumn("fav", weights.alpha * F.col("c_pair"))
    pool = pool.withColumn("clash", -k_vol * (w[0] * F.col("n_ss") + w[1] * F.col("n_sc") + w[2] * F.col("n_cc")))
    pool = pool.withColumn("shape", F.col("fav") + F.col("clash"))
    pool = pool.withColumn("pair", -weighted_sum(F.col("t"), weights.table))
    pool = pool.withColumn("charge", weights.beta * F.col("elec"))
    return pool.withColumn("total", F.col("shape") + F.col("pair") + F.col("charge"))


def standardize(pool: DataFrame, score: str = "score", name: str = "z", *, floor: float = 1.0,
                sample: bool = False, keys=("complex_id",)) -> DataFrame:
    """(score - mean) / max(sd, floor) within each complex.

    The moments are an aggregate joined back, so one large complex is never
    gathered in one task.
    """
    spread = F.stddev_samp(score) if sample else F.stddev_pop(score)
    moments = pool.groupBy(*keys).agg(F.avg(score).alias("_mean"), spread.alias("_sd"))
    z = (F.col(score) - F.col("_mean")) / F.greatest(F.coalesce("_sd", F.lit(0.0)), F.lit(float(floor)))
    return pool.join(moments, list(keys)).withColumn(name, z).drop("_mean", "_sd")


def parameter_free_rankers(pool: DataFrame) -> DataFrame:
    """Scores that need no weights: contact count, shape count, charge term."""
    contacts = F.aggregate("t", F.lit(0.0), lambda s, v: s + v)
    return pool.withColumn("rank_contacts", contacts).withColumn("rank_shape", F.col("c_pair")).withColumn(
        "rank_charge", F.col("elec"))


def affine_features(pool: DataFrame, basis: Sequence[Sequence[float]], name: str = "features") -> DataFrame:
    """Project the feature array onto the rows of a basis: one value per row."""
    rows = [weighted_sum(F.col("t"), row) for row in basis]
    return pool.withColumn(name, F.array(*rows))


def additive_basis(size: int = 12) -> list[list[float]]:
    """Orthonormal rows spanning tables of the form a_i + b_j: 2 * size - 1 of them."""
    raw = []
    for i in range(size):
        raw.append([1.0 if k // size == i else 0.0 for k in range(size * size)])
    for j in range(size):
        raw.append([1.0 if k % size == j else 0.0 for k in range(size * size)])
    return orthonormal(raw)


def symmetric_additive_basis(size: int = 12) -> list[list[float]]:
    """Orthonormal rows spanning tables a_i + a_j: ``size`` of them."""
    return orthonormal([
        [float(k // size == i) + float(k % size == i) for k in range(size * size)] for i in range(size)
    ])


def orthonormal(rows: Sequence[Sequence[float]], tol: float = 1e-9) -> list[list[float]]:
    """Gram-Schmidt over a handful of parameter vectors."""
    basis: list[list[float]] = []
    for row in rows:
        v = list(map(float, row))
        for b in basis:
            d = sum(x * y for x, y in zip(v, b))
            v = [x - d * y for x, y in zip(v, b)]
        norm = sum(x * x for x in v) ** 0.5
        if norm > tol:
            basis.append([x / norm for x in v])
    return basis


def size_bucket_features(pool: DataFrame, edges: Sequence[float], size: str = "n_atoms") -> DataFrame:
    """Block features: the feature array placed in the block of the complex size,
    zeros elsewhere, so each size bucket gets its own weights."""
    slot = F.lit(0)
    for e in edges:
        slot = slot + F.when(F.col(size) > float(e), 1).otherwise(0)
    zeros = F.transform("t", lambda v: F.lit(0.0))
    blocks = [F.when(slot == b, F.col("t")).otherwise(zeros) for b in range(len(edges) + 1)]
    return pool.withColumn("bucket", slot).withColumn("features", F.concat(*blocks))


# --- counts from grid cells ---------------------------------------------------

CELL = ["complex_id", "ix", "iy", "iz"]

# Cells are exploded atoms, which Spark's estimates take for a few bytes: without the merge
# hints below it sends whole cell tables through the driver.


def shape_terms(points: DataFrame, layers: DataFrame, rec_open: DataFrame, rec_layers: DataFrame) -> DataFrame:
    """c_pair, n_ss, n_sc and n_cc per pose.

    ``points``: nearest cell of every ligand atom with its count (complex, pose, cell, w);
    ``layers``: ligand surface or core cells (complex, pose, cell, surface);
    ``rec_open``: receptor open-space counts (cell, w); ``rec_layers``: receptor
    surface or core cells (cell, surface).  Both joins are on the cell, so a large
    complex spreads over its cells.
    """
    r = rec_open.select(*CELL, F.col("w").alias("_r")).hint("merge")
    gain = points.join(r, CELL).groupBy("complex_id", "pose_id").agg(F.sum(F.col("w") * F.col("_r")).alias("c_pair"))
    s = rec_layers.select(*CELL, F.col("surface").alias("_s")).hint("merge")
    both = layers.join(s, CELL)
    clash = both.groupBy("complex_id", "pose_id").agg(
        F.count_if(F.col("surface") & F.col("_s")).cast("double").alias("n_ss"),
        F.count_if(F.col("surface") != F.col("_s")).cast("double").alias("n_sc"),
        F.count_if(~F.col("surface") & ~F.col("_s")).cast("double").alias("n_cc"),
    )
    out = gain.join(clash.hint("merge"), ["complex_id", "pose_id"], "full")
    return out.fillna(0.0, ["c_pair", "n_ss", "n_sc", "n_cc"])


def pair_counts(points: DataFrame, type_layers: DataFrame) -> DataFrame:
    """Contacts between ligand type i and receptor type j per pose, in long form.

    A ligand type counts once per cell however many of its atoms share it.
    """
    lig = points.filter(F.col("w") > 0).select("complex_id", "pose_id", "ix", "iy", "iz", F.col("grp").alias("i")).distinct()
    rec = type_layers.select(*CELL, F.col("grp").alias("j"), F.col("w").alias("_h"))
    return lig.join(rec.hint("merge"), CELL).groupBy("complex_id", "pose_id", "i", "j").agg(F.sum("_h").alias("n"))


def pair_counts_weighted(points: DataFrame, type_layers: DataFrame) -> DataFrame:
    """As :func:`pair_counts` for corner-weighted points: each type layer saturates at one per cell."""
    lig = points.groupBy("complex_id", "pose_id", "ix", "iy", "iz", F.col("grp").alias("i")).agg(
        F.least(F.lit(1.0), F.sum("w")).alias("_l"))
    rec = type_layers.select(*CELL, F.col("grp").alias("j"), F.col("w").alias("_h"))
    return lig.join(rec.hint("merge"), CELL).groupBy("complex_id", "pose_id", "i", "j").agg(F.sum(F.col("_l") * F.col("_h")).alias("n"))


def pack_pairs(pairs: DataFrame, size: int = 12) -> DataFrame:
    """Pair counts as one array per pose, position size * (j-1) + (i-1).

    At most size*size entries exist per pose, so the array is bounded.
    """
    entry = F.struct((size * (F.col("j") - 1) + F.col("i") - 1).alias("key"), F.col("n").alias("value"))
    packed = pairs.groupBy("complex_id", "pose_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    array = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.col("_m")[k], F.lit(0.0)))
    return packed.select("complex_id", "pose_id", array.alias("t"))


def elec_term(points: DataFrame, potential: DataFrame, occupied: DataFrame) -> DataFrame:
    """Sum of potential times ligand charge; the potential is zero inside the receptor."""
    v = potential.join(occupied.select(*CELL).distinct().hint("merge"), CELL, "left_anti").select(*CELL, F.col("w").alias("_v"))
    return points.join(v.hint("merge"), CELL).groupBy("complex_id", "pose_id").agg(F.sum(F.col("w") * F.col("_v")).alias("elec"))


def legacy_elec_term(points: DataFrame, ratio_layers: DataFrame, charges=fixed.CHARGES) -> DataFrame:
    """Older charge term: squared charge of the type times the count-over-distance layer of that type."""
    u = ratio_layers.select(*CELL, "grp", F.col("w").alias("_u"))
    lut = F.array(*[F.lit(float(c)) for c in charges])
    q = F.element_at(lut, F.col("grp"))
    return points.join(u.hint("merge"), [*CELL, "grp"]).groupBy("complex_id", "pose_id").agg(F.sum(F.col("w") * F.col("_u") * q * q).alias("elec"))
