"""Pose generation: translation scan, search, pools, refinement and clustering.

The scan is a join of sparse cells, so the difference of two cells is the
translation and nothing wraps around.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.functions.columns import apply_matrix, dot, quat_mul, rotation_matrix
from posefarm.functions.ordering import top_k
from posefarm.operators import cells as cl
from posefarm.operators import moves
from posefarm.operators import rotations as rot
from posefarm.operators import spatial as sp
from posefarm.operators.features import grid_axes, with_partial_charge
from posefarm.operators.quality import label_poses
from posefarm.operators.scoring import (
    Weights, elec_term, legacy_elec_term, linear_score, pack_pairs, pair_counts, pair_counts_weighted, settled, shape_terms,
)
from posefarm.operators.spatial import radius_join
from posefarm.session import cut, ship

C = "complex_id"
CELL = ["ix", "iy", "iz"]
POSE = [C, "pose_id"]
Q = ["q1", "q2", "q3", "q4"]
T = ["tx", "ty", "tz"]


def pose_features(atoms: DataFrame, poses: DataFrame, h: float = fixed.REFERENCE_SPACING, grid: DataFrame | None = None,
                  charges: str = "coulomb", scatter: str = "nearest") -> DataFrame:
    """Counts of every pose: c_pair, n_ss, n_sc, n_cc, the packed pair counts t, and elec.

    The receptor's cells are one wide table, met once on (complex, cell).  The older charge
    term and corner weights keep tables of their own.
    """
    grid = grid_axes(atoms, h) if grid is None else grid
    if charges == "coulomb" and scatter == "nearest":
        lig = rot.rotate_poses(atoms.filter(F.col("side") == "L"), poses)
        met = cl.met_counts(cl.receptor_cells(atoms, grid), cl.ligand_cells(lig, grid))
        return _filled(poses.join(met.hint("merge"), POSE, "left"))
    atoms = with_partial_charge(atoms)
    rec = atoms.filter(F.col("side") == "R")
    lig = rot.rotate_poses(atoms.filter(F.col("side") == "L"), poses)
    rec_layers = sp.surface_core_layers(rec, grid)
    rec_open = sp.open_space_count(rec, grid, rec_layers)
    types = sp.type_layers(rec, grid)
    at = sp.nearest_cells(lig, grid)
    points = at.groupBy(*POSE, *CELL).agg(F.count(F.lit(1)).cast("double").alias("w"))
    shape = shape_terms(points, sp.surface_core_layers(lig, grid, keys=["pose_id"]), rec_open, rec_layers)
    if scatter == "trilinear":
        pairs = pair_counts_weighted(sp.scatter_trilinear(lig, grid, keys=["pose_id"], group="type_id"), types)
        charged = sp.scatter_trilinear(lig, grid, F.col("charge"), keys=["pose_id"])
    else:
        pairs = pair_counts(at.groupBy(*POSE, *CELL, F.col("type_id").alias("grp")).agg(F.count(F.lit(1)).cast("double").alias("w")), types)
        charged = at.groupBy(*POSE, *CELL).agg(F.sum("charge").alias("w"))
    if charges == "legacy":
        ratio = sp.count_over_distance(rec, grid)
        known = at.filter(F.col("type_id").between(1, 11)).groupBy(*POSE, *CELL, F.col("type_id").alias("grp")).agg(
            F.count(F.lit(1)).cast("double").alias("w"))
        elec = legacy_elec_term(known, ratio)
    else:
        elec = elec_term(charged, sp.scatter_inverse_distance(rec, grid), rec_layers)
    return _filled(poses.join(shape, POSE, "left").join(pack_pairs(pairs), POSE, "left").join(elec, POSE, "left"))


def _filled(out: DataFrame) -> DataFrame:
    """Poses that meet nothing count nothing."""
    zeros = F.transform(F.sequence(F.lit(0), F.lit(143)), lambda k: F.lit(0.0))
    return out.fillna(0.0, ["c_pair", "n_ss", "n_sc", "n_cc", "elec"]).withColumn("t", F.coalesce("t", zeros))


def score_poses(atoms: DataFrame, poses: DataFrame, weights: Weights, h: float = fixed.REFERENCE_SPACING,
                k_vol: float = 1.0, **how) -> DataFrame:
    """Score of every pose from atoms, end to end."""
    return linear_score(pose_features(atoms, poses, h, **how), weights, "score", k_vol=k_vol)


def receptor_layers(atoms: DataFrame, grid: DataFrame, weights: Weights) -> DataFrame:
    """Receptor side of the scan: (complex, cell, on, channels)."""
    return cl.receptor_channels(cl.receptor_cells(atoms, grid), weights)


def ligand_layers(turned: DataFrame, grid: DataFrame, weights: Weights, k_vol: float = 1.0) -> DataFrame:
    """Ligand side of the scan per rotation (key ``qi``), carrying the weights of the score."""
    return cl.ligand_channels(cl.ligand_cells(turned, grid, ["qi"]), weights, k_vol, ["qi"])


#: Side, in cells, of the blocks that meet in a scan, and of the blocks of shifts that a
#: search bounds as one.  A pair of blocks meets in at most (2 * BLOCK / SHIFTS) ** 3 = 512 of these.
BLOCK, SHIFTS = 16, 4
STEP = ("cx", "cy", "cz")
_AXIS = "xyz"


def _packed_block(names: Sequence[str] = CELL) -> Column:
    """The block of a cell in one BIGINT; cells count from zero on every axis."""
    b = [F.floor(F.col(c) / BLOCK).cast("long") for c in names]
    return F.shiftleft(b[0], 40) + F.shiftleft(b[1], 20) + b[2]


def _lattice(block: str) -> list[Column]:
    mask = F.lit((1 << 20) - 1).cast("long")
    return [F.shiftright(block, 40), F.shiftright(block, 20).bitwiseAND(mask), F.col(block).bitwiseAND(mask)]


def translation_scan(rec_cells: DataFrame, lig_cells: DataFrame, names: Sequence[str], max_shift: int | None = None,
                     alive: DataFrame | None = None) -> DataFrame:
    """score(d) = sum over channels and cells of receptor(m) * ligand(m - d), over every shift at
    which cells meet, or |d| <= max_shift per axis where that is asked for.

    Cells count from zero.  Both sides are cut into blocks of BLOCK cells a side, whatever the
    size of the molecules, and meet in an equi-join on (complex, receptor block, ligand block):
    a key holds one pair of blocks.  ``alive`` (complex, qi, step of blocks x, y, z, words of 64
    bits) leaves only the blocks of shifts whose bits are set.
    """
    rec = rec_cells.withColumn("rb", _packed_block())
    lig = lig_cells.withColumn("lb", _packed_block())
    rec_blocks, lig_blocks = rec.select(C, "rb").distinct(), lig.select(C, "lb").distinct()
    rec = rec.join(lig_blocks.hint("merge"), C)
    lig = lig.join(rec_blocks.hint("merge"), C)
    if alive is not None:
        lig = lig.withColumns({f"_s{a}": r - l for a, r, l in zip(_AXIS, _lattice("rb"), _lattice("lb"))}).join(
            alive, [C, "qi", *[f"_s{a}" for a in _AXIS]])
    met = lig.alias("l").join(rec.alias("r").hint("merge"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (C, "rb", "lb")])
    met = met.filter(F.col("l.on").bitwiseAND(F.col("r.on")) != 0)
    step = [(F.col(f"r.{c}") - F.col(f"l.{c}")).alias(n) for c, n in zip(CELL, STEP)]
    kept = [] if alive is None else [F.col(f"l._s{a}").alias(f"_s{a}") for a in _AXIS] + [F.col("l.words").alias("words")]
    met = met.select(F.col(f"l.{C}").alias(C), F.col("l.qi").alias("qi"), *step, *kept, cl.gained(names, "l", "r").alias("_w"))
    if alive is not None:
        bit = _bit([F.floor(F.col(n) / SHIFTS).cast("long") for n in STEP], [F.col(f"_s{a}") for a in _AXIS])
        met = met.filter(F.call_function("shiftright", F.get("words", F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) != 0)
    if max_shift is not None:
        for n in STEP:
            met = met.filter(F.col(n).between(-max_shift, max_shift))
    return met.groupBy(C, "qi", *STEP).agg(F.sum("_w").alias("score"))


def _bit(shift_block: Sequence[Column], step: Sequence[Column]) -> Column:
    """Number of a block of shifts among the 8 x 8 x 8 that a step between blocks can reach."""
    per = BLOCK // SHIFTS
    place = [(d - s * per + per).cast("int") for d, s in zip(shift_block, step)]
    return (place[0] * (2 * per) + place[1]) * (2 * per) + place[2]


def _alive(blocks: DataFrame) -> DataFrame:
    """Blocks of shifts (complex, qi, dx, dy, dz) as sets of bits, one for each step between
    blocks of cells that reaches them: at most two steps an axis."""
    per = BLOCK // SHIFTS
    for a in _AXIS:
        first = F.floor(F.col(f"d{a}") / per).cast("long")
        blocks = blocks.withColumn(f"_s{a}", F.explode(F.array(first, first + 1)))
    bit = _bit([F.col(f"d{a}") for a in _AXIS], [F.col(f"_s{a}") for a in _AXIS])
    marked = blocks.select(C, "qi", *[f"_s{a}" for a in _AXIS], F.shiftright(bit, 6).alias("_word"),
                           F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63))).alias("_mark"))
    n = (2 * per) ** 3 // 64
    words = [F.bit_or(F.when(F.col("_word") == k, F.col("_mark")).otherwise(F.lit(0).cast("long"))) for k in range(n)]
    return marked.groupBy(C, "qi", *[f"_s{a}" for a in _AXIS]).agg(F.array(*words).alias("words"))


def shift_bounds(rec_cells: DataFrame, lig_cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """(complex, qi, dx, dy, dz, bound): the most that any shift in a block of SHIFTS a side can
    score; blocks in which no cells can meet have no row.

    Where a ligand cell meets a receptor cell at a shift of the block, the receptor cell lies in
    a window of 2 * SHIFTS - 1 cells a side, which depends on their blocks alone.  So a channel
    gains at most the window's largest value for what the ligand's block has of it above zero,
    and its smallest for what it has below, and the bound is a scan of blocks instead of cells.
    """
    windows = rec_cells
    for c in CELL:
        b = F.floor(F.col(c) / SHIFTS).cast("long")
        inner = F.pmod(F.col(c), F.lit(SHIFTS)) <= SHIFTS - 2
        windows = windows.withColumn(f"_b{c}", F.explode(F.when(inner, F.array(b, b - 1)).otherwise(F.array(b))))
    zero = F.lit(0.0)
    windows = windows.groupBy(C, *[f"_b{c}" for c in CELL]).agg(
        F.bit_or("on").alias("on"), *[F.greatest(F.max(n), zero).alias(f"hi_{n}") for n in names], *[F.least(F.min(n), zero).alias(f"lo_{n}") for n in names])
    own = [F.floor(F.col(c) / SHIFTS).cast("long").alias(f"_b{c}") for c in CELL]
    blocks = lig_cells.select(C, "qi", "on", *names, *own).groupBy(C, "qi", *[f"_b{c}" for c in CELL]).agg(
        F.bit_or("on").alias("on"), *[F.sum(F.greatest(F.col(n), zero)).alias(f"up_{n}") for n in names],
        *[F.sum(F.least(F.col(n), zero)).alias(f"down_{n}") for n in names])
    met = blocks.alias("l").join(windows.alias("r"), [F.col(f"l.{C}") == F.col(f"r.{C}"), F.col("l.on").bitwiseAND(F.col("r.on")) != 0])
    most = zero
    for n in names:
        most = most + F.col(f"l.up_{n}") * F.col(f"r.hi_{n}") + F.col(f"l.down_{n}") * F.col(f"r.lo_{n}")
    met = met.select(F.col(f"l.{C}").alias(C), F.col("l.qi").alias("qi"),
                     *[(F.col(f"r._b{c}") - F.col(f"l._b{c}")).alias(f"d{a}") for c, a in zip(CELL, _AXIS)], most.alias("_m"))
    return met.groupBy(C, "qi", *[f"d{a}" for a in _AXIS]).agg(F.sum("_m").alias("bound"))


#: A complex of no more pairs of blocks is scanned whole: a scan spares pairs of blocks, and
#: finding out which would cost as much as those few.
FEW_PAIRS = 8


def best_translations(rec_cells: DataFrame, lig_cells: DataFrame, names: Sequence[str], per_rotation: int = 1, ntop: int = 2000,
                      round_to: int | None = None) -> DataFrame:
    """What :func:`top_translations` finds in the whole scan, without summing most of it where
    molecules are large.  Both cell tables are read several times, so pass stored ones.
    """
    rounded = (lambda s: s) if round_to is None else (lambda s: s.withColumn("score", F.round("score", round_to)))
    sides = [t.select(C, _packed_block().alias("b")).distinct().groupBy(C).agg(F.count(F.lit(1)).alias(n)) for t, n in ((rec_cells, "_r"), (lig_cells, "_l"))]
    large = cut(sides[0].join(sides[1], C).filter(F.col("_r") * F.col("_l") > FEW_PAIRS).select(C))
    if large.isEmpty():
        return top_translations(rounded(translation_scan(rec_cells, lig_cells, names)), per_rotation, ntop)
    split = [(t.join(large, C, "left_anti"), t.join(large, C, "left_semi")) for t in (rec_cells, lig_cells)]
    scan = rounded(translation_scan(split[0][0], split[1][0], names))
    bounded = _bounded_scan(cut(split[0][1]), cut(split[1][1]), names, per_rotation, ntop, rounded, 1e-6 + (0.0 if round_to is None else 10.0 ** -round_to))
    return top_translations(scan.unionByName(bounded), per_rotation, ntop)


def _bounded_scan(rec_cells: DataFrame, lig_cells: DataFrame, names: Sequence[str], per_rotation: int, ntop: int, rounded, slack: float) -> DataFrame:
    """The part of a scan that can hold the best translations.

    Every block of shifts is bounded first.  The blocks of highest bound are scanned exactly;
    their scores tell what a shift has to reach to be among the best of its rotation and of its
    complex, and only blocks whose bound reaches that are scanned as well.
    """
    place = [F.col(f"d{a}") for a in _AXIS]
    bounds = cut(shift_bounds(rec_cells, lig_cells, names))
    # A block's bound may be reached by a single shift, so as many blocks as shifts are wanted.
    first = top_k(bounds, [C, "qi"], [F.col("bound").desc(), *place], per_rotation, "_r").select(C, "qi", *place)
    seen = cut(rounded(translation_scan(rec_cells, lig_cells, names, alive=_alive(first))))
    best = top_k(seen, [C, "qi"], [F.col("score").desc(), *[F.col(c) for c in STEP]], per_rotation, "_r")
    in_rotation = best.groupBy(C, "qi").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_need")).filter(F.col("_n") >= per_rotation)
    in_complex = top_k(best.select(C, "qi", "score", *STEP), C, [F.col("score").desc(), F.col("qi"), *[F.col(c) for c in STEP]], ntop, "_r").groupBy(C).agg(
        F.count(F.lit(1)).alias("_m"), F.min("score").alias("_least")).filter(F.col("_m") >= ntop)
    asked = bounds.join(in_rotation.select(C, "qi", "_need"), [C, "qi"], "left").join(in_complex.select(C, "_least"), C, "left")
    open_ = asked.filter((F.col("_need").isNull() | (F.col("bound") >= F.col("_need") - slack))
                         & (F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - slack))).select(C, "qi", *place)
    rest = open_.join(first, [C, "qi", *[f"d{a}" for a in _AXIS]], "left_anti")
    return seen.unionByName(rounded(translation_scan(rec_cells, lig_cells, names, alive=_alive(rest))))


def top_translations(scan: DataFrame, per_rotation: int = 1, ntop: int = 2000) -> DataFrame:
    """Best translations of every rotation, then the best ``ntop`` of the complex.

    Ties go to the smaller rotation, then the smaller cell.
    """
    cells = [F.col("cx"), F.col("cy"), F.col("cz")]
    best = top_k(scan, [C, "qi"], [F.col("score").desc(), *cells], per_rotation, "_r").drop("_r")
    return top_k(best, C, [F.col("score").desc(), F.col("qi"), *cells], ntop, "rank")


def turned_ligands(atoms: DataFrame, rotations: DataFrame, n_rotations: int) -> DataFrame:
    """Ligand atoms under every rotation of a set: fan-out by index, equi-join on it."""
    lig = atoms.filter(F.col("side") == "L").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_rotations - 1))).alias("qi"))
    m = rotations.select("qi", *[x.alias(f"m{i}") for i, x in enumerate(rotation_matrix([F.col(q) for q in Q]))])
    j = lig.join(m, "qi")
    v = apply_matrix([F.col(f"m{i}") for i in range(9)], [F.col(a) for a in "xyz"])
    rest = [c for c in atoms.columns if c not in ("x", "y", "z")]
    return j.select(*rest, "qi", *[c.alias(a) for c, a in zip(v, "xyz")])


def _best(rec: DataFrame, lig: DataFrame, names: Sequence[str], max_shift: int | None, per_rotation: int, ntop: int, round_to: int | None = None) -> DataFrame:
    """Best translations over every shift, or by the whole scan of a window where one is asked for."""
    if max_shift is None:
        return best_translations(cut(rec), cut(lig), names, per_rotation, ntop, round_to)
    scan = translation_scan(rec, lig, names, max_shift)
    if round_to is not None:
        scan = scan.withColumn("score", F.round("score", round_to))
    return top_translations(scan, per_rotation, ntop)


def search_poses(atoms: DataFrame, rotations: DataFrame, n_rotations: int, weights: Weights,
                 h: float = fixed.REFERENCE_SPACING, max_shift: int | None = None, per_rotation: int = 1, ntop: int = 2000,
                 k_vol: float = 1.0, round_to: int | None = None) -> DataFrame:
    """Search over rotations and translations; needs no known answer.

    Result per pose: score, qi, cell shift cx, cy, cz, rotation and translation.
    ``round_to`` rounds scores before ranking, which makes ties reproducible.
    """
    grid = grid_axes(atoms, h)
    turned = turned_ligands(atoms, rotations, n_rotations)
    best = _best(receptor_layers(atoms, grid, weights), ligand_layers(turned, grid, weights, k_vol), cl.channel_names(weights),
                 max_shift, per_rotation, ntop, round_to)
    return best.join(rotations.select("qi", *Q), "qi").select(
        C, F.col("rank").cast("long").alias("pose_id"), "score", "qi", "cx", "cy", "cz", *Q,
        *[(F.col(c) * float(h)).alias(t) for c, t in zip(("cx", "cy", "cz"), T)])


def build_pool(atoms: DataFrame, complexes: DataFrame, rotations: DataFrame, n_rotations: int, weights: Weights,
               h: float = fixed.REFERENCE_SPACING, max_shift: int | None = None, ntop: int = 2000, k: int = 8, reach: int = 1) -> DataFrame:
    """Searched poses (prov 0) and near-native lattice poses the search did not return (prov 1),
    with features and labels."""
    found = cut(search_poses(atoms, rotations, n_rotations, weights, h, max_shift, 1, ntop))
    near = rot.near_native_lattice(complexes, rotations, n_rotations, h, k, reach)
    key = [C, "qi", "cx", "cy", "cz"]
    extra = near.join(found.select(*key), key, "left_anti").withColumn("prov", F.lit(1))
    both = found.select(*key, *Q, *T, F.lit(0).alias("prov")).unionByName(extra.select(*key, *Q, *T, "prov"))
    # An id from the identity, so that it does not depend on row order.
    both = cut(both.withColumn("pose_id", F.xxhash64("qi", "cx", "cy", "cz")))
    return pool_from_poses(atoms, both, h)


def pool_from_poses(atoms: DataFrame, poses: DataFrame, h: float = fixed.REFERENCE_SPACING) -> DataFrame:
    """Features and labels for given poses (a frozen test pool, refined poses).

    Several branches read the poses, so pass a stored or checkpointed table.
    """
    labels = label_poses(poses.select(*POSE, *Q, *T), atoms).select(*POSE, "rmsd", "dockq")
    return pose_features(atoms, poses, h).join(labels, POSE)


def decoys_with_cone(atoms: DataFrame, complexes: DataFrame, n_random: int, n_cone: int, weights: Weights,
                     h: float = fixed.REFERENCE_SPACING, max_shift: int | None = None, cone_deg: float = 15.0, seed: int = 0,
                     round_to: int | None = None) -> DataFrame:
    """Older recipe: best translation for random and cone rotations, plus cone rotations
    at the exact native translation (score NULL)."""
    spark = atoms.sparkSession
    base = rot.random_rotations(spark, n_random, seed)
    cone = rot.rotation_cone(complexes.select(C, *Q, *T), n_cone, cone_deg, seed).withColumn("qi", F.col("cone") + n_random)
    free = complexes.select(C, F.explode(F.sequence(F.lit(0), F.lit(n_random - 1))).alias("qi")).join(base, "qi").select(C, "qi", *Q)
    sets = free.unionByName(cone.select(C, "qi", *Q))
    grid = grid_axes(atoms, h)
    turned = rot.rotate_poses(
        atoms.filter(F.col("side") == "L"),
        sets.select(C, F.col("qi").alias("pose_id"), *Q, *[F.lit(0.0).alias(t) for t in T])).withColumnRenamed("pose_id", "qi")
    best = _best(receptor_layers(atoms, grid, weights), ligand_layers(turned, grid, weights), cl.channel_names(weights), max_shift, 1,
                 n_random + n_cone, round_to).join(sets, [C, "qi"])
    searched = best.select(C, "qi", "score", *Q, *[(F.col(c) * float(h)).alias(t) for c, t in zip(("cx", "cy", "cz"), T)])
    injected = cone.select(C, (F.col("qi") + n_cone).alias("qi"), F.lit(None).cast("double").alias("score"), *Q, *T)
    return searched.unionByName(injected)


MOVE = [f"x{i}" for i in range(6)]
START = [f"b_{c}" for c in (*Q, *T)]
#: Step sizes tried at once.  A pose that no move of its step improves goes on with half the
#: step from where it is, so those moves can be scored in the same round.
LEVELS = 3


def _moved(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Poses at x0 .. x5 from their starts: one turn about the starting centroid (a vector whose
    length is the angle in degrees) and one shift."""
    turn = F.sqrt(dot([F.col(m) for m in MOVE[:3]], [F.col(m) for m in MOVE[:3]]))
    rows = rows.withColumn("_turn", turn)
    axis = [F.when(F.col("_turn") > 0, F.col(m) / F.col("_turn")).otherwise(0.0) for m in MOVE[:3]]
    rows = rows.withColumns({f"_e{i}": c for i, c in enumerate(rot.axis_angle(axis, F.col("_turn")))})
    e = [F.col(f"_e{i}") for i in range(4)]
    q = quat_mul([F.col(f"b_{c}") for c in Q], e)
    arm = apply_matrix(rotation_matrix(e), [F.col(f"b_t{a}") - F.col(f"g{a}") for a in "xyz"])
    return rows.select(*keep, *[c.alias(n) for c, n in zip(q, Q)],
                       *[(c + F.col(f"g{a}") + F.col(f"x{3 + i}")).alias(f"t{a}") for i, (a, c) in enumerate(zip("xyz", arm))])


#: Complexes up to so many atoms a side and so many grid cells are searched in a task, so many poses at a time.
GROUP_ATOMS, GROUP_CELLS, GROUP_POSES = 5_000, 1 << 22, 256


def pattern_refine(atoms: DataFrame, poses: DataFrame, weights: Weights, rounds: int | None = None, deg: float = 4.0, shift: float = 1.0,
                   h: float = fixed.REFERENCE_SPACING, stop_deg: float = 0.05, grid: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """Pattern search over the six parameters of a rigid move from each pose's start.

    In a step every parameter is moved up and down by its step size, the turn about the
    starting centroid as one vector; the best of the twelve is taken if it scores more (by
    1e-9 at least), otherwise the step is halved.  A pose stops when its step is at most
    ``stop_deg``.  Of equal moves the first counts; scores equal to nine digits are equal.

    Steps go on until every pose has stopped, or for ``rounds`` rounds: a round tries ``levels``
    step sizes, each half the one before, and ends with the first that improves.

    The receptor's cells are built once.  A pose depends on nothing but its complex, so blocks of
    poses meet the cells of their complex in one co-grouping and are searched to their end there
    (``moves``).  Complexes too large for that (``GROUP_ATOMS``, ``GROUP_CELLS``) are searched
    by joins on cells, a round at a time.
    """
    grid = grid_axes(atoms, h) if grid is None else grid
    small = F.col("_atoms") <= GROUP_ATOMS
    size = atoms.groupBy(C).agg(F.greatest(*[F.count_if(F.col("side") == s) for s in "RL"]).alias("_atoms"))
    size = size.join(grid, C).select(C, (small & (F.col("nx") * F.col("ny") * F.col("nz") <= GROUP_CELLS)).alias("_small"))
    large = cut(size.filter(~F.col("_small")).select(C))
    how = {"deg": deg, "shift": shift, "stop_deg": stop_deg, "rounds": rounds, "levels": levels}
    if large.isEmpty():
        return _refine_in_groups(atoms, poses, grid, weights, how)
    near = [t.join(large, C, "left_anti") for t in (atoms, poses, grid)]
    far = [t.join(large, C, "left_semi") for t in (atoms, poses, grid)]
    return _refine_in_groups(*near, weights, how).unionByName(_refine_by_joins(*far, weights, **how))


def _refine_in_groups(atoms: DataFrame, poses: DataFrame, grid: DataFrame, weights: Weights, how: dict) -> DataFrame:
    """Blocks of at most ``GROUP_POSES`` poses (about), each searched by one call."""
    ship(atoms.sparkSession)
    names = cl.channel_names(weights)
    ligand = with_partial_charge(atoms.filter(F.col("side") == "L")).groupBy(C).agg(
        F.array_sort(F.collect_list(F.struct("atom_idx", "x", "y", "z", "radius", "sasa", "charge", "type_id"))).alias("lig"))
    base = rot.placed_centroid(poses.select(*POSE, *Q, *T), atoms)
    count = base.groupBy(C).agg(F.ceil(F.count(F.lit(1)) / GROUP_POSES).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64("pose_id"), F.col("_blocks")).cast("int")
    base = base.join(count, C).withColumn("block", block)
    cells = receptor_layers(atoms, grid, weights).join(base.select(C, F.col("block").alias("of")).distinct(), C)
    blocks = base.groupBy(C, "block").agg(F.collect_list(F.struct("pose_id", *Q, *T, "gx", "gy", "gz")).alias("poses"))
    blocks = blocks.join(ligand, C).join(grid.select(C, "x0", "y0", "z0", "h"), C)
    kind = {f.name: f.dataType.simpleString() for f in poses.schema}
    schema = ", ".join([f"`{k}` {kind[k]}" for k in POSE] + [f"{c} double" for c in ("score", "start_score", "deg", "shift", *Q, *T)])

    def refine(block, cells):
        return moves.refine_block(block, cells, weights, names, fixed.SURFACE_AREA, how)

    met = blocks.groupBy(C, "block").cogroup(cells.select(C, "of", *CELL, *names).groupBy(C, "of"))
    return met.applyInArrow(refine, schema)


def _refine_by_joins(atoms: DataFrame, poses: DataFrame, grid: DataFrame, weights: Weights, rounds: int | None, deg: float, shift: float,
                     stop_deg: float, levels: int) -> DataFrame:
    """The search of any complex: a round scores the moves of ``levels`` step sizes of every live
    pose with one join on cells, and a step that improves takes the largest of them that does, as
    if they had been tried one after the other.  The state is written every round."""
    grid = cut(grid)
    names = cl.channel_names(weights)
    rec = cut(receptor_layers(atoms, grid, weights))
    lig = cut(atoms.filter(F.col("side") == "L"))

    def score(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
        cells = cl.ligand_cells(rot.rotate_poses(lig, placed, keys[1:]), grid, keys)
        return cl.met_scores(rec, cl.ligand_channels(cells, weights, keys=keys), names, keys)

    base = rot.placed_centroid(poses.select(*POSE, *Q, *T), atoms)
    start = base.join(score(base, ["pose_id"]), POSE, "left").fillna(0.0, ["score"])
    state = cut(start.select(
        *POSE, *[F.col(c).alias(f"b_{c}") for c in (*Q, *T)], *[f"g{a}" for a in "xyz"], *[F.lit(0.0).alias(m) for m in MOVE], "score",
        F.col("score").alias("start_score"), F.lit(float(deg)).alias("deg"), F.lit(float(shift)).alias("shift")))
    stopped, done = state.limit(0), 0
    while rounds is None or done < rounds:
        done += 1
        live = state.filter(F.col("deg") > stop_deg)
        if live.isEmpty():
            break
        stopped = stopped.unionByName(state.filter(F.col("deg") <= stop_deg))
        fan = F.explode(F.sequence(F.lit(0), F.lit(12 * levels - 1))).alias("probe")
        tried = live.select(*POSE, *START, *[f"g{a}" for a in "xyz"], *MOVE, "deg", "shift", fan)
        scale = F.pow(F.lit(0.5), F.floor(F.col("probe") / 12).cast("double"))
        tried = tried.filter(F.col("deg") * scale > stop_deg)
        parameter, sign = F.floor(F.col("probe") % 12 / 2), F.when(F.col("probe") % 2 == 0, 1.0).otherwise(-1.0)
        size = F.when(parameter < 3, F.col("deg")).otherwise(F.col("shift")) * scale * sign
        tried = tried.withColumns({m: F.col(m) + F.when(parameter == i, size).otherwise(0.0) for i, m in enumerate(MOVE)})
        found = score(_moved(tried, [*POSE, "probe"]), ["pose_id", "probe"])
        best = found.groupBy(*POSE).agg(*[
            F.max_by(F.struct("score", "probe"), F.when(F.floor(F.col("probe") / 12) == k, F.struct(settled("score"), -F.col("probe")))).alias(f"_best{k}")
            for k in range(levels)])
        # Moves that leave the receptor's cells altogether score nothing, which has no row.
        j = live.join(best, POSE, "left")
        allowed = sum((F.when(F.col("deg") * 0.5 ** k > stop_deg, 1).otherwise(0) for k in range(levels)), F.lit(0))
        pick = F.lit(None).cast("struct<score:double,probe:int>")
        for k in reversed(range(levels)):
            none = F.struct(F.lit(0.0).alias("score"), F.lit(12 * k).alias("probe"))
            top = F.coalesce(F.col(f"_best{k}"), none)
            pick = F.when((F.lit(k) < allowed) & (top["score"] > F.col("score") + 1e-9), top).otherwise(pick)
        j = j.withColumns({"_pick": pick, "_allowed": allowed}).withColumn("_scale", F.coalesce(F.pow(F.lit(0.5), F.floor(F.col("_pick.probe") / 12).cast("double")), F.pow(F.lit(0.5), F.col("_allowed").cast("double"))))
        took, sign = F.floor(F.col("_pick.probe") % 12 / 2), F.when(F.col("_pick.probe") % 2 == 0, 1.0).otherwise(-1.0)
        state = cut(j.select(
            *POSE, *START, *[f"g{a}" for a in "xyz"],
            *[(F.col(m) + F.when(took == i, sign * F.col("deg" if i < 3 else "shift") * F.col("_scale")).otherwise(0.0)).alias(m) for i, m in enumerate(MOVE)],
            F.coalesce("_pick.score", "score").alias("score"), "start_score", (F.col("deg") * F.col("_scale")).alias("deg"), (F.col("shift") * F.col("_scale")).alias("shift")))
    return _moved(stopped.unionByName(state), [*POSE, "score", "start_score", "deg", "shift"])


def _spread_poses(poses: DataFrame, atoms: DataFrame, keys: Sequence[str] = (C,)) -> DataFrame:
    """Poses as points (e0 .. e11) whose distances are the ligand RMSD between them.

    The mean squared distance between two placements of the same atoms is that of their
    centroids plus that of their matrices times any square root of the atoms' covariance; the
    root taken here is the triangular one.
    """
    lig = atoms.filter(F.col("side") == "L")
    pair = [(i, j) for i in range(3) for j in range(i + 1)]
    m = lig.groupBy(C).agg(*[F.avg(a).alias(f"_r{i}") for i, a in enumerate("xyz")],
                           *[(F.avg(F.col("xyz"[i]) * F.col("xyz"[j])) - F.avg("xyz"[i]) * F.avg("xyz"[j])).alias(f"_c{i}{j}") for i, j in pair])
    # Flat ligands have a covariance of lower rank: a column without length is left out.
    for j in range(3):
        own = F.col(f"_c{j}{j}") - sum((F.col(f"_l{j}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))
        m = m.withColumn(f"_l{j}{j}", F.sqrt(F.greatest(F.lit(0.0), own)))
        for i in range(j + 1, 3):
            mixed = F.col(f"_c{i}{j}") - sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))
            m = m.withColumn(f"_l{i}{j}", F.when(F.col(f"_l{j}{j}") > 1e-6, mixed / F.col(f"_l{j}{j}")).otherwise(0.0))
    turned = poses.select(*keys, "pose_id", *[x.alias(f"_m{i}") for i, x in enumerate(rotation_matrix([F.col(q) for q in Q]))], *T).join(m, C)
    centre = apply_matrix([F.col(f"_m{i}") for i in range(9)], [F.col(f"_r{i}") for i in range(3)])
    spread = [sum((F.col(f"_m{3 * r + i}") * F.col(f"_l{i}{j}") for i in range(j, 3)), F.lit(0.0)) for r in range(3) for j in range(3)]
    return turned.select(*keys, "pose_id", *[(c + F.col(t)).alias(f"e{i}") for i, (c, t) in enumerate(zip(centre, T))],
                         *[c.alias(f"e{3 + i}") for i, c in enumerate(spread)])


WIDE = [f"e{i}" for i in range(12)]


def _close_pairs(points: DataFrame, tol: float, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Pairs of points (by ``pose_id``) closer than ``tol``; those have centroids as close, so
    only points in neighbouring bins of centroids meet."""
    placed = points.select(*keys, "pose_id", *keep, *WIDE, *[F.col(f"e{i}").alias(a) for i, a in enumerate("xyz")])
    kept = ["pose_id", *keep, *WIDE]
    pairs = radius_join(placed, placed, tol, keys, kept, kept).filter(F.col("a_pose_id") < F.col("b_pose_id"))
    gap = sum(((F.col(f"a_{e}") - F.col(f"b_{e}")) * (F.col(f"a_{e}") - F.col(f"b_{e}")) for e in WIDE), F.lit(0.0))
    return pairs.withColumn("rmsd", F.sqrt(gap)).filter(F.col("rmsd") < tol)


def pose_pairs_within(poses: DataFrame, atoms: DataFrame, tol: float, keys: Sequence[str] = (C,)) -> DataFrame:
    """Pairs of poses of one complex whose ligands lie within ``tol`` RMSD of each other."""
    return _close_pairs(_spread_poses(poses, atoms, keys), tol, keys).select(
        *keys, F.col("a_pose_id").alias("i"), F.col("b_pose_id").alias("j"), "rmsd")


def linked_basins(poses: DataFrame, atoms: DataFrame, tol: float) -> DataFrame:
    """complex_id, pose_id, label: single linkage of poses at ``tol`` RMSD.

    Poses are points at distances of their RMSD.  Points of one fine cell are closer than
    ``tol`` to each other and count as one node, however many there are.  Nodes whose first
    points are close are linked; of the other neighbouring nodes only pairs that are still in
    different clusters, and whose boxes come closer than ``tol``, compare their points, each
    distinct point once.
    """
    side = tol / math.sqrt(len(WIDE)) * (1 - 1e-9)
    points = _spread_poses(poses, atoms).withColumn("_cell", F.concat_ws(",", *[F.floor(F.col(e) / side).cast("string") for e in WIDE]))
    points = cut(points)
    nodes = points.groupBy(C, "_cell").agg(
        F.min(F.struct("pose_id", *WIDE)).alias("_p"), *[f(e).alias(f"{n}_{e}") for e in WIDE for n, f in (("lo", F.min), ("hi", F.max))])
    nodes = cut(nodes.select(C, "_cell", "_p.*", *[f"{n}_{e}" for e in WIDE for n in ("lo", "hi")]))
    # First points of two nodes are at most a cell's diagonal each from any other, so three times tol reaches every pair that may link.
    box = [f"{n}_{e}" for e in WIDE for n in ("lo", "hi")]
    near = _close_pairs(nodes, 3.0 * tol, [C], box)
    apart = F.lit(0.0)
    for e in WIDE:
        gap = F.greatest(F.lit(0.0), F.col(f"a_lo_{e}") - F.col(f"b_hi_{e}"), F.col(f"b_lo_{e}") - F.col(f"a_hi_{e}"))
        apart = apart + gap * gap
    near = cut(near.filter(F.sqrt(apart) < tol).select(C, F.col("a_pose_id").alias("i"), F.col("b_pose_id").alias("j"), (F.col("rmsd") < tol).alias("sure")))
    first = connected(nodes.select(C, "pose_id"), near.filter("sure").select(C, "i", "j"))
    label = lambda n: first.select(C, F.col("pose_id").alias(n), F.col("label").alias(f"_l{n}"))
    open_ = near.filter("NOT sure").join(label("i"), [C, "i"]).join(label("j"), [C, "j"]).filter("_li <> _lj")
    named = points.join(nodes.select(C, "_cell", F.col("pose_id").alias("node")), [C, "_cell"])
    distinct = named.groupBy(C, "node", *WIDE).agg(F.min("pose_id").alias("pose_id"))
    sides = [distinct.select(C, F.col("node").alias(n), *[F.col(e).alias(f"{n}_{e}") for e in WIDE]) for n in ("i", "j")]
    met = open_.select(C, "i", "j", "_li", "_lj").join(sides[0], [C, "i"]).join(sides[1], [C, "j"])
    gap = sum(((F.col(f"i_{e}") - F.col(f"j_{e}")) * (F.col(f"i_{e}") - F.col(f"j_{e}")) for e in WIDE), F.lit(0.0))
    bridges = met.filter(F.sqrt(gap) < tol).select(C, F.col("_li").alias("i"), F.col("_lj").alias("j")).distinct()
    second = connected(first.select(C, F.col("label").alias("pose_id")).distinct(), bridges)
    final = first.join(second.select(C, F.col("pose_id").alias("label"), F.col("label").alias("_all")), [C, "label"])
    return named.select(C, "pose_id", "node").join(final.select(C, F.col("pose_id").alias("node"), F.col("_all").alias("label")), [C, "node"]).select(
        C, "pose_id", "label")


def connected(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (C,)) -> DataFrame:
    """Smallest pose_id of the component of every node: minimum labels spread along edges,
    with a jump to the label's own label in each round."""
    keys = list(keys)
    both = edges.select(*keys, "i", "j").unionByName(edges.select(*keys, F.col("j").alias("i"), F.col("i").alias("j")))
    both = cut(both)
    labels = cut(nodes.select(*keys, "pose_id", F.col("pose_id").alias("label")))
    while True:
        spread = both.join(labels.select(*keys, F.col("pose_id").alias("j"), "label"), [*keys, "j"]).groupBy(
            *keys, F.col("i").alias("pose_id")).agg(F.min("label").alias("_l"))
        step = labels.join(spread, [*keys, "pose_id"], "left").withColumn("_l", F.least("label", "_l"))
        jump = step.select(*keys, F.col("pose_id").alias("_l"), F.col("_l").alias("_ll"))
        new = step.join(jump, [*keys, "_l"], "left").select(
            *keys, "pose_id", F.least("_l", F.coalesce("_ll", "_l")).alias("_new"), "label")
        new = cut(new)
        moved = new.filter(F.col("_new") < F.col("label")).limit(1).count()
        labels = new.select(*keys, "pose_id", F.col("_new").alias("label"))
        if not moved:
            return labels


def cluster_endpoints(poses: DataFrame, atoms: DataFrame, tol: float, start: int | None = None) -> DataFrame:
    """Basins of scored endpoints: single linkage on ligand RMSD.

    One row per basin: size, best-scoring member, score spread, and the share of the
    complex's endpoints in the basin (of ``start`` when that pose is the start: its
    return rate).
    """
    labels = linked_basins(poses, atoms, tol)
    members = poses.join(labels, POSE)
    basins = members.groupBy(C, F.col("label").alias("basin")).agg(
        F.count(F.lit(1)).alias("size"), F.max_by("pose_id", F.struct("score", -F.col("pose_id"))).alias("representative"),
        F.max("score").alias("best_score"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("dispersion"),
        *([F.max((F.col("pose_id") == start).cast("int")).alias("holds_start")] if start is not None else []))
    n = poses.groupBy(C).agg(F.count(F.lit(1)).alias("_n"))
    out = basins.join(n, C)
    if start is not None:
        out = out.withColumn("return_rate", F.when(F.col("holds_start") == 1, (F.col("size") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)))
    return out.withColumn("share", F.col("size") / F.col("_n")).drop("_n")
