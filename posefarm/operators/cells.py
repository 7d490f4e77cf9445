"""Wide cell tables: all that a score needs of a grid cell in one row.

The receptor's table has one row for each (complex, cell) that any of its atoms reaches:
occupied or not and how, atoms near enough to count as open space, atoms of each type within
pair reach, and the potential.  One explode of the atoms to their widest reach and one
aggregate build it.  The ligand's table has one row for each (complex, keys, cell).  A score is
then one join on (complex, cell) and one sum, and a scan is one join of blocks of cells.

For a given set of weights both tables are turned into *channels*, columns of equal name and
number on both sides, so that the score gained where two cells meet is the sum of the
products of their channels.  ``on`` has a bit for every channel that a cell has at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.operators import spatial as sp
from posefarm.operators.features import with_partial_charge
from posefarm.operators.scoring import Weights

C = "complex_id"
CELL = ["ix", "iy", "iz"]
TYPES = 12
#: A nearest cell's centre is never farther away than this many cell sides.
NEAREST = 0.87


def receptor_cells(atoms: DataFrame, grid: DataFrame, threshold: float = fixed.SURFACE_AREA) -> DataFrame:
    """(complex, cell, surface, open, v, h1 .. h12): ``surface`` is null where no atom covers the
    cell, ``open`` and ``v`` where one does or none is in reach; ``near`` counts atoms in pair reach."""
    rec = with_partial_charge(atoms.filter(F.col("side") == "R"))
    free = F.col("radius") + fixed.OPEN_SPACE_REACH
    at = sp.cells_within(rec, grid, F.greatest(free, F.lit(fixed.PAIR_REACH), F.lit(fixed.CHARGE_REACH)))
    d, covers, paired, felt = F.col("d"), F.col("d") < F.col("radius"), F.col("d") < fixed.PAIR_REACH, F.col("d") < fixed.CHARGE_REACH
    cells = at.groupBy(C, *CELL).agg(
        F.bool_or(F.when(covers, F.col("sasa") > threshold)).alias("surface"), F.count_if(d < free).alias("_open"),
        F.sum(F.when(felt, F.col("charge") / F.greatest(d, F.lit(1e-6)))).alias("_v"), F.count_if(paired).alias("near"),
        *[F.count_if(paired & (F.col("type_id") == t)).cast("double").alias(f"h{t}") for t in range(1, TYPES + 1)])
    empty = F.col("surface").isNull()
    return cells.select(
        C, *CELL, "surface", F.when(empty & (F.col("_open") > 0), F.col("_open").cast("double")).alias("open"),
        F.when(empty, F.col("_v")).alias("v"), "near", *[f"h{t}" for t in range(1, TYPES + 1)])


def ligand_cells(placed: DataFrame, grid: DataFrame, keys: Sequence[str] = ("pose_id",), threshold: float = fixed.SURFACE_AREA) -> DataFrame:
    """(complex, keys, cell, w, q, types, surface): atoms whose nearest cell it is, their charge and
    types (bit t - 1 for type t), and whether the ligand covers the cell (null if not)."""
    points = with_partial_charge(placed)
    at = sp.cells_within(points, grid, F.greatest(F.col("radius"), F.lit(NEAREST) * F.col("h")), nearest="_here")
    here = F.col("_here")
    cells = at.groupBy(C, *keys, *CELL).agg(
        F.count_if(here).cast("double").alias("w"), F.sum(F.when(here, F.col("charge"))).alias("q"),
        F.bit_or(F.when(here, F.call_function("shiftleft", F.lit(1), (F.col("type_id") - 1).cast("int"))).otherwise(0)).alias("types"),
        F.bool_or(F.when(F.col("d") < F.col("radius"), F.col("sasa") > threshold)).alias("surface"))
    return cells.filter((F.col("w") > 0) | F.col("surface").isNotNull())


def channel_names(weights: Weights) -> list[str]:
    """Channels that the weights ask for."""
    return ["open", "outer", "inner", *(["charge"] if weights.beta else []), *([f"pair{i}" for i in range(1, TYPES + 1)] if weights.table else [])]


def _masked(rows: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Channels without a value become zero and lose their bit in ``on``."""
    rows = rows.select(*keys, *[v.cast("double").alias(n) for n, v in values.items()])
    on = F.lit(0)
    for bit, n in enumerate(values):
        on = on + F.when(F.col(n).isNotNull(), 1 << bit).otherwise(0)
    return rows.withColumn("on", on).fillna(0.0, list(values)).filter("on <> 0")


def receptor_channels(cells: DataFrame, weights: Weights) -> DataFrame:
    """The receptor's side: counts and potential, and for each ligand type the energy of the types near."""
    one = F.lit(1.0)
    values = {"open": F.col("open"), "outer": F.when(F.col("surface"), one), "inner": F.when(~F.col("surface"), one)}
    if weights.beta:
        values["charge"] = F.col("v")
    if weights.table:
        for i in range(TYPES):
            energy = sum((F.col(f"h{j + 1}") * -float(weights.table[TYPES * j + i]) for j in range(1, TYPES)), F.col("h1") * -float(weights.table[i]))
            values[f"pair{i + 1}"] = F.when(F.col("near") > 0, energy)
    return _masked(cells, [C, *CELL], values)


def ligand_channels(cells: DataFrame, weights: Weights, k_vol: float = 1.0, keys: Sequence[str] = ("pose_id",)) -> DataFrame:
    """The ligand's side, which carries the weights."""
    both, one_inside, inside = (-k_vol * float(w) for w in weights.clash)
    here = F.col("w") > 0
    values = {"open": F.when(here, weights.alpha * F.col("w")),
              "outer": F.when(F.col("surface"), both).when(~F.col("surface"), one_inside),
              "inner": F.when(F.col("surface"), one_inside).when(~F.col("surface"), inside)}
    if weights.beta:
        values["charge"] = F.when(here, weights.beta * F.col("q"))
    if weights.table:
        for i in range(TYPES):
            values[f"pair{i + 1}"] = F.when(F.col("types").bitwiseAND(F.lit(1 << i)) != 0, F.lit(1.0))
    return _masked(cells, [C, *keys, *CELL], values)


def gained(names: Sequence[str], left: str, right: str) -> Column:
    """Sum of the products of the channels of two aliased tables."""
    terms = [F.col(f"{left}.{n}") * F.col(f"{right}.{n}") for n in names]
    return sum(terms[1:], terms[0])


def met_scores(rec: DataFrame, lig: DataFrame, names: Sequence[str], keys: Sequence[str] = ("pose_id",)) -> DataFrame:
    """Score of every (complex, keys) whose ligand cells lie on receptor cells: one join, one sum."""
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (C, *CELL)]
    met = lig.alias("l").join(rec.alias("r").hint("merge"), same)
    return met.groupBy(F.col(f"l.{C}").alias(C), *[F.col(f"l.{k}").alias(k) for k in keys]).agg(F.sum(gained(names, "l", "r")).alias("score"))


def met_counts(rec: DataFrame, lig: DataFrame) -> DataFrame:
    """c_pair, n_ss, n_sc, n_cc, elec and the packed pair counts t of every pose that meets the
    receptor: one join, one aggregate over (pose, ligand type), and one over the at most 13 rows
    of a pose.  Type 0 stands for what belongs to no type."""
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (C, *CELL)]
    kinds = F.filter(F.sequence(F.lit(0), F.lit(TYPES)), lambda k: (k == 0) | F.call_function("getbit", F.col("l.types"), F.greatest(k - 1, F.lit(0))).cast("boolean"))
    s, t = F.col("l.surface"), F.col("r.surface")
    met = lig.alias("l").join(rec.alias("r").hint("merge"), same).select(
        F.col(f"l.{C}").alias(C), "l.pose_id", F.explode(kinds).alias("i"), (F.col("l.w") * F.col("r.open")).alias("gain"),
        (F.col("l.q") * F.col("r.v")).alias("pull"), (s & t).alias("ss"), (s != t).alias("sc"), (~s & ~t).alias("cc"),
        *[F.col(f"r.h{j}").alias(f"h{j}") for j in range(1, TYPES + 1)])
    none = F.col("i") == 0
    by_type = met.groupBy(C, "pose_id", "i").agg(
        F.sum(F.when(none, F.col("gain"))).alias("gain"), F.sum(F.when(none, F.col("pull"))).alias("pull"),
        *[F.count_if(none & F.col(n)).cast("double").alias(n) for n in ("ss", "sc", "cc")],
        F.array(*[F.sum(f"h{j}") for j in range(1, TYPES + 1)]).alias("h"))
    out = by_type.groupBy(C, "pose_id").agg(
        F.coalesce(F.sum("gain"), F.lit(0.0)).alias("c_pair"), *[F.sum(n).alias(f"n_{n}") for n in ("ss", "sc", "cc")],
        F.coalesce(F.sum("pull"), F.lit(0.0)).alias("elec"),
        F.map_from_entries(F.collect_list(F.when(F.col("i") > 0, F.struct("i", "h")))).alias("_h"))
    zero = F.lit(0.0)
    flat = F.transform(F.sequence(F.lit(0), F.lit(TYPES * TYPES - 1)), lambda k: F.coalesce(
        F.get(F.col("_h")[(k % TYPES + 1).cast("int")], F.floor(k / TYPES).cast("int")), zero))
    return out.withColumn("t", flat).drop("_h")
