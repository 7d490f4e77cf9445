"""Spatial joins and scatter onto sparse grid cells.

Cell tables hold (complex_id, ix, iy, iz, w) and, where layers are kept apart,
``grp``.  Extra key columns (such as a pose) pass through ``keys``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions import fixed

XYZ = ("x", "y", "z")
CELL = ["ix", "iy", "iz"]


def radius_join(a: DataFrame, b: DataFrame, r: float, keys: Sequence[str] = ("complex_id",),
                keep_a: Sequence[str] = ("atom_idx",), keep_b: Sequence[str] = ("atom_idx",)) -> DataFrame:
    """All pairs closer than ``r`` (strict) that agree on ``keys``.

    Space is cut into bins of side r; each row of ``b``, the smaller side, visits
    its 27 bins and meets ``a`` in a hash join on (keys, bin).  Kept columns come
    back with the prefixes ``a_`` and ``b_``, with the distance ``d``.
    """
    keys = list(keys)
    bins = [F.floor(F.col(c) / float(r)).cast("long") for c in XYZ]
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in (*XYZ, *keep_a) if c in a.columns],
                    *[v.alias(f"_b{c}") for c, v in zip(XYZ, bins)])
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in (*XYZ, *keep_b)],
                     *[v.alias(f"_b{c}") for c, v in zip(XYZ, bins)])
    for c in XYZ:
        right = right.withColumn(f"_b{c}", F.explode(F.sequence(F.col(f"_b{c}") - 1, F.col(f"_b{c}") + 1)))
    gap = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in XYZ[1:]),
              (F.col("a_x") - F.col("b_x")) * (F.col("a_x") - F.col("b_x")))
    joined = left.join(right, [*keys, *[f"_b{c}" for c in XYZ]])
    return joined.withColumn("d", F.sqrt(gap)).filter(F.col("d") < float(r)).drop(*[f"_b{c}" for c in XYZ])


def _on_grid(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Points with their grid; native coordinates share names with cell counts and go."""
    return points.drop("nx", "ny", "nz").join(grid, "complex_id")


def _inside(columns: Sequence[Column]) -> Column:
    ok = F.lit(True)
    for c, axis in zip(columns, XYZ):
        ok = ok & (c >= 0) & (c < F.col(f"n{axis}"))
    return ok


def nearest_cells(points: DataFrame, grid: DataFrame, legacy_floor: bool = False) -> DataFrame:
    """Add the nearest cell of every point; points outside the grid are dropped.

    Halves round to the even cell.  ``legacy_floor`` uses the cell below instead.
    """
    j = _on_grid(points, grid)
    cells = []
    for c, axis in zip(CELL, XYZ):
        u = (F.col(axis) - F.col(f"{axis}0")) / F.col("h")
        cells.append(((F.ceil(u) - 1) if legacy_floor else F.rint(u)).cast("long").alias(c))
    j = j.select("*", *cells).filter(_inside([F.col(c) for c in CELL]))
    return j.drop(*[c for c in grid.columns if c != "complex_id"])


def scatter_nearest(points: DataFrame, grid: DataFrame, weight: Column | None = None, keys: Sequence[str] = (),
                    group: str | None = None, mode: str = "add", legacy_floor: bool = False) -> DataFrame:
    """Weights gathered at the nearest cell: their sum, or the last atom's (``mode='last'``)."""
    w = F.lit(1.0) if weight is None else weight
    at = nearest_cells(points, grid, legacy_floor).withColumn("_w", w)
    cols = ["complex_id", *keys, *([F.col(group).alias("grp")] if group else []), *CELL]
    value = F.sum("_w") if mode == "add" else F.max_by("_w", "atom_idx")
    return at.groupBy(*cols).agg(value.alias("w"))


def cells_within(points: DataFrame, grid: DataFrame, reach: Column | float, nearest: str | None = None) -> DataFrame:
    """One row per (point, cell) whose centre is closer than the point's reach (strict).

    Each axis visits only the cells its own distance allows, so a point expands to
    a small box and never to the whole grid.  ``nearest`` names a column that tells
    whether the cell is the point's nearest one (halves round to the even cell).
    """
    r = reach if isinstance(reach, Column) else F.lit(float(reach))
    j = _on_grid(points, grid).withColumn("_r", r).withColumn("_d2", F.lit(0.0))
    if nearest:
        j = j.withColumn(nearest, F.lit(True))
    for c, axis in zip(CELL, XYZ):
        u = (F.col(axis) - F.col(f"{axis}0")) / F.col("h")
        span = F.col("_r") / F.col("h")
        lo = F.greatest(F.lit(0).cast("long"), F.floor(u - span))
        hi = F.least(F.col(f"n{axis}") - 1, F.ceil(u + span))
        j = j.filter(lo <= hi).withColumn(c, F.explode(F.sequence(lo, hi)))
        if nearest:
            j = j.withColumn(nearest, F.col(nearest) & (F.col(c) == F.rint(u).cast("long")))
        gap = F.col(axis) - (F.col(f"{axis}0") + F.col(c) * F.col("h"))
        j = j.withColumn("_d2", F.col("_d2") + gap * gap).filter(F.col("_d2") < F.col("_r") * F.col("_r"))
    j = j.withColumn("d", F.sqrt("_d2")).filter(F.col("d") < F.col("_r"))
    return j.drop("_r", "_d2", *[c for c in grid.columns if c != "complex_id"])


def scatter_within(points: DataFrame, grid: DataFrame, reach: Column | float, weight: Column | None = None,
                   keys: Sequence[str] = (), group: str | None = None, agg: str = "sum") -> DataFrame:
    """Gather at every cell within reach: sum of weights, count, or mere presence (``any``)."""
    at = cells_within(points, grid, reach)
    w = F.lit(1.0) if weight is None else weight
    cols = ["complex_id", *keys, *([F.col(group).alias("grp")] if group else []), *CELL]
    if agg == "any":
        return at.select(*cols).distinct().withColumn("w", F.lit(1.0))
    value = F.sum(w) if agg == "sum" else F.count(F.lit(1)).cast("double")
    return at.groupBy(*cols).agg(value.alias("w"))


def scatter_inverse_distance(points: DataFrame, grid: DataFrame, charge: str = "charge",
                             reach: float = fixed.CHARGE_REACH, keys: Sequence[str] = ()) -> DataFrame:
    """Potential at every cell: sum of charge over distance."""
    near = cells_within(points, grid, reach)
    return near.groupBy("complex_id", *keys, *CELL).agg(
        F.sum(F.col(charge) / F.greatest(F.col("d"), F.lit(1e-6))).alias("w"))


def scatter_distance(points: DataFrame, grid: DataFrame, reach: float = fixed.CHARGE_REACH,
                     group: str | None = None) -> DataFrame:
    """Sum of distances from each cell to the points in reach."""
    cols = ["complex_id", *([F.col(group).alias("grp")] if group else []), *CELL]
    return cells_within(points, grid, reach).groupBy(*cols).agg(F.sum("d").alias("w"))


def count_over_distance(points: DataFrame, grid: DataFrame, reach: float = fixed.CHARGE_REACH,
                        group: str = "type_id", types: int = 11) -> DataFrame:
    """Older potential: number of atoms at a cell over the distances within reach, per type."""
    known = points.filter(F.col(group).between(1, types))
    num = scatter_nearest(known, grid, group=group)
    # Distances are asked for at cells that hold atoms only, from there to the atoms of the type.
    centre = num.join(grid.hint("merge"), "complex_id").select(
        "complex_id", "grp", *CELL, "w", *[(F.col(f"{a}0") + F.col(c) * F.col("h")).alias(a) for c, a in zip(CELL, XYZ)])
    near = radius_join(centre, known.select("complex_id", F.col(group).alias("grp"), *XYZ).hint("merge"), reach, ["complex_id", "grp"], [*CELL, "w"], [])
    den = near.groupBy("complex_id", "grp", *[F.col(f"a_{c}").alias(c) for c in CELL]).agg(F.sum("d").alias("_d"))
    j = num.join(den.hint("merge"), ["complex_id", "grp", *CELL], "left")
    value = F.when(F.col("_d") > 0, F.col("w") / F.col("_d")).otherwise(F.lit(0.0))
    return j.select("complex_id", "grp", *CELL, value.alias("w"))


def scatter_trilinear(points: DataFrame, grid: DataFrame, weight: Column | None = None, keys: Sequence[str] = (),
                      group: str | None = None) -> DataFrame:
    """Weights shared among the eight corners; a point without all eight is dropped."""
    j = _on_grid(points, grid)
    base, frac = [], []
    for axis in XYZ:
        u = (F.col(axis) - F.col(f"{axis}0")) / F.col("h")
        base.append(F.floor(u).cast("long").alias(f"_i{axis}"))
        frac.append((u - F.floor(u)).alias(f"_f{axis}"))
    j = j.select("*", *base, *frac)
    ok = F.lit(True)
    for axis in XYZ:
        ok = ok & (F.col(f"_i{axis}") >= 0) & (F.col(f"_i{axis}") + 1 < F.col(f"n{axis}"))
    j = j.filter(ok).withColumn("_w0", F.lit(1.0) if weight is None else weight)
    corners = []
    for k in range(8):
        bits = [k & 1, (k >> 1) & 1, (k >> 2) & 1]
        share = F.col("_w0")
        for bit, axis in zip(bits, XYZ):
            share = share * (F.col(f"_f{axis}") if bit else 1.0 - F.col(f"_f{axis}"))
        corners.append(F.struct(*[(F.col(f"_i{axis}") + bit).alias(c) for bit, axis, c in zip(bits, XYZ, CELL)],
                                share.alias("_w")))
    grp = [F.col(group).alias("grp")] if group else []
    out = j.select("complex_id", *keys, *grp, F.inline(F.array(*corners)))
    names = ["complex_id", *keys, *(["grp"] if group else []), *CELL]
    return out.groupBy(*names).agg(F.sum("_w").alias("w"))


def surface_core_layers(atoms: DataFrame, grid: DataFrame, threshold: float = fixed.SURFACE_AREA,
                        keys: Sequence[str] = ()) -> DataFrame:
    """Occupied cells with ``surface``: true where any exposed atom covers the cell,
    false for the core that is left.  One aggregate settles the precedence."""
    at = cells_within(atoms, grid, F.col("radius"))
    return at.groupBy("complex_id", *keys, *CELL).agg(F.bool_or(F.col("sasa") > threshold).alias("surface"))


def encode_layers(layers: DataFrame, rho: float) -> DataFrame:
    """Clash value of a layer cell: rho on the surface, rho squared in the core."""
    return layers.withColumn("w", F.when(F.col("surface"), float(rho)).otherwise(float(rho) ** 2))


def open_space_count(atoms: DataFrame, grid: DataFrame, occupied: DataFrame,
                     reach: float = fixed.OPEN_SPACE_REACH) -> DataFrame:
    """Number of atoms within radius + reach of each cell that no atom occupies."""
    counts = scatter_within(atoms, grid, F.col("radius") + reach, agg="count")
    return counts.join(occupied.select("complex_id", *CELL).hint("merge"), ["complex_id", *CELL], "left_anti")


def boundary_to_surface(layers: DataFrame, grid: DataFrame) -> DataFrame:
    """A core cell with two or more empty face neighbours becomes surface; edges wrap."""
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    j = layers.join(grid.select("complex_id", "nx", "ny", "nz"), "complex_id")
    around = F.array(*[
        F.struct(*[F.pmod(F.col(c) + s, F.col(f"n{a}")).alias(f"_{c}") for c, a, s in zip(CELL, XYZ, step)])
        for step in steps
    ])
    core = j.filter(~F.col("surface")).select("complex_id", *CELL, F.inline(around))
    full = layers.select("complex_id", *[F.col(c).alias(f"_{c}") for c in CELL], F.lit(1).alias("_full"))
    empty = core.join(full.hint("merge"), ["complex_id", *[f"_{c}" for c in CELL]], "left").groupBy("complex_id", *CELL).agg(
        F.count_if(F.col("_full").isNull()).alias("_empty"))
    out = layers.join(empty.hint("merge"), ["complex_id", *CELL], "left")
    return out.withColumn("surface", F.col("surface") | (F.coalesce("_empty", F.lit(0)) >= 2)).drop("_empty")


def type_layers(atoms: DataFrame, grid: DataFrame, reach: float = fixed.PAIR_REACH) -> DataFrame:
    """Number of atoms of each type within reach of a cell (``grp`` is the type)."""
    return scatter_within(atoms, grid, reach, group="type_id", agg="count")


def weighted_type_layers(layers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Layer i = sum over j of energy(i, j) times layer j; the pair table has 144 rows."""
    p = F.broadcast(pairs.select(F.col("i"), F.col("j").alias("grp"), "energy"))
    return layers.join(p, "grp").groupBy("complex_id", F.col("i").alias("grp"), *CELL).agg(
        F.sum(F.col("w") * F.col("energy")).alias("w"))
