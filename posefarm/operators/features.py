"""Atom features and reference frames."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.functions.columns import apply_matrix, cross, dot, rotation_matrix
from posefarm.operators.spatial import radius_join
from posefarm.session import ship

MOLECULE = ["complex_id", "side"]


def with_atom_type(atoms: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``type_id`` by (residue, atom name); OXT counts as O.

    An unknown pair fails the job, or gives NULL when ``strict`` is off.
    """
    rules = fixed.atom_type_table(atoms.sparkSession).withColumnRenamed("atom_name", "_name")
    name = F.when(F.col("atom_name") == "OXT", "O").otherwise(F.col("atom_name"))
    out = atoms.withColumn("_name", name).join(F.broadcast(rules), ["res_name", "_name"], "left").drop("_name")
    if strict:
        bad = F.concat(F.lit("no atom type for "), F.col("res_name"), F.lit(" "), F.col("atom_name"))
        out = out.withColumn("type_id", F.coalesce("type_id", F.raise_error(bad).cast("int")))
    return out


def element(name: Column) -> Column:
    """First character that is not a digit."""
    return F.regexp_extract(name, r"^[0-9]*([^0-9])", 1)


def with_radius(atoms: DataFrame, strict: bool = True) -> DataFrame:
    radii = fixed.radius_table(atoms.sparkSession).withColumnRenamed("element", "_element")
    out = atoms.withColumn("_element", element(F.col("atom_name"))).join(F.broadcast(radii), "_element", "left")
    if strict:
        bad = F.concat(F.lit("no radius for atom "), F.col("atom_name"))
        out = out.withColumn("radius", F.coalesce("radius", F.raise_error(bad).cast("double")))
    return out.drop("_element")


def with_charge_type(atoms: DataFrame) -> DataFrame:
    """Add ``charge_id``.  The first backbone N of a molecule that is not a proline
    is terminal; the position of that atom is an aggregate, not a sort."""
    plain_n = (F.col("atom_name") == "N") & (F.col("res_name") != "PRO")
    first = atoms.groupBy(*MOLECULE).agg(F.min(F.when(plain_n, F.col("atom_idx"))).alias("_first"))
    a, r = F.col("atom_name"), F.col("res_name")
    rule = (
        F.when((r == "PRO") & (a == "N"), 7)
        .when((a == "N") & (F.col("atom_idx") == F.col("_first")), 1)
        .when(a == "N", 11)
        .when(a == "O", 10)
        .when(a == "OXT", 2)
        .when((r == "ARG") & a.isin("NH1", "NH2"), 3)
        .when((r == "GLU") & a.isin("OE1", "OE2"), 4)
        .when((r == "ASP") & a.isin("OD1", "OD2"), 5)
        .when((r == "LYS") & (a == "NZ"), 6)
        .otherwise(8)
    )
    return atoms.join(first, MOLECULE).withColumn("charge_id", rule).drop("_first")


def charge_of(charge_id: Column, charges=fixed.CHARGES) -> Column:
    """Partial charge of a charge type; zero outside the table."""
    lut = F.array(*[F.lit(float(c)) for c in charges])
    return F.when(charge_id.between(1, len(charges)), F.element_at(lut, charge_id)).otherwise(F.lit(0.0))


def with_partial_charge(atoms: DataFrame, charges=fixed.CHARGES) -> DataFrame:
    """Add ``charge``; the ligand side carries the opposite sign, so attraction scores."""
    q = charge_of(F.col("charge_id"), charges)
    return atoms.withColumn("charge", F.when(F.col("side") == "L", -q).otherwise(q))


def centroids(atoms: DataFrame, weight: str | None = None, keys=MOLECULE) -> DataFrame:
    if weight:
        w = F.col(weight)
        cols = [(F.sum(w * F.col(c)) / F.sum(w)).alias(f"c{c}") for c in "xyz"]
    else:
        cols = [F.avg(c).alias(f"c{c}") for c in "xyz"]
    return atoms.groupBy(*keys).agg(*cols)


def decenter(atoms: DataFrame, weight: str | None = None, keys=MOLECULE) -> DataFrame:
    """Move the (weighted) centroid of each molecule to the origin."""
    out = atoms.join(centroids(atoms, weight, keys), list(keys))
    for c in "xyz":
        out = out.withColumn(c, F.col(c) - F.col(f"c{c}"))
    return out.drop("cx", "cy", "cz")


def _with_eigenvalues(t: DataFrame) -> DataFrame:
    """Eigenvalues e0 >= e1 >= e2 of the symmetric matrix in columns xx .. yz, in closed form."""
    xx, yy, zz, xy, xz, yz = (F.col(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz"))
    t = t.withColumn("_mean", (xx + yy + zz) / 3.0)
    t = t.withColumns({"_dx": xx - F.col("_mean"), "_dy": yy - F.col("_mean"), "_dz": zz - F.col("_mean")})
    dx, dy, dz = F.col("_dx"), F.col("_dy"), F.col("_dz")
    t = t.withColumns({
        "_p": F.sqrt((dx * dx + dy * dy + dz * dz + 2.0 * (xy * xy + xz * xz + yz * yz)) / 6.0),
        "_det": dx * (dy * dz - yz * yz) - xy * (xy * dz - yz * xz) + xz * (xy * yz - dy * xz),
    })
    p = F.col("_p")
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_det") / (2.0 * p * p * p)))
    t = t.withColumn("_phi", F.acos(F.when(p > 0, r).otherwise(F.lit(1.0))) / 3.0)
    t = t.withColumns({"e0": F.col("_mean") + 2.0 * p * F.cos("_phi"), "e2": F.col("_mean") + 2.0 * p * F.cos(F.col("_phi") + 2.0 * math.pi / 3.0)})
    return t.withColumn("e1", 3.0 * F.col("_mean") - F.col("e0") - F.col("e2"))


def _with_eigenvector(t: DataFrame, value: str, out: str) -> DataFrame:
    """Columns out0..out2: eigenvector for a known eigenvalue, the longest cross product of
    two rows of (matrix - value)."""
    lam = F.col(value)
    t = t.withColumns({"_mx": F.col("xx") - lam, "_my": F.col("yy") - lam, "_mz": F.col("zz") - lam})
    rows = [[F.col(c) for c in r] for r in (("_mx", "xy", "xz"), ("xy", "_my", "yz"), ("xz", "yz", "_mz"))]
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        t = t.withColumns({f"_v{k}{i}": c for i, c in enumerate(cross(rows[a], rows[b]))})
    v = [[F.col(f"_v{k}{i}") for i in range(3)] for k in range(3)]
    packed = [F.struct(dot(x, x).alias("n"), *[c.alias(f"e{i}") for i, c in enumerate(x)]) for x in v]
    t = t.withColumn("_best", F.greatest(*packed))
    t = t.withColumns({f"{out}{i}": F.col(f"_best.e{i}") for i in range(3)})
    return t.drop("_mx", "_my", "_mz", "_best", *[f"_v{k}{i}" for k in range(3) for i in range(3)])


def inertia(atoms: DataFrame, weight: str = "weight", keys=("complex_id",)) -> DataFrame:
    """Weighted inertia tensor about the plain centroid: six sums per molecule."""
    centred = decenter(atoms, None, keys)
    w, x, y, z = (F.col(c) for c in (weight, "x", "y", "z"))
    return centred.groupBy(*keys).agg(
        F.sum(w * (y * y + z * z)).alias("xx"), F.sum(w * (x * x + z * z)).alias("yy"),
        F.sum(w * (x * x + y * y)).alias("zz"), F.sum(-w * x * y).alias("xy"),
        F.sum(-w * x * z).alias("xz"), F.sum(-w * y * z).alias("yz"),
    )


def frame_weight(type_id: Column) -> Column:
    """Inertia weight of an atom type: first column of the pair table."""
    lut = F.array(*[F.lit(float(row[0])) for row in fixed.PAIR_TABLE])
    return F.element_at(lut, type_id)


def principal_axes(atoms: DataFrame, weight: str = "weight", keys=("complex_id",)) -> DataFrame:
    """Right-handed principal axes per molecule, smallest magnitude of inertia first.

    Columns a0..a8 hold the rows of the projection.  The sign of the second and
    third axis makes their largest component positive; the first follows from
    handedness.  Runs on one row per molecule.
    """
    keys = list(keys)
    names = ("xx", "yy", "zz", "xy", "xz", "yz")
    t = _with_eigenvalues(inertia(atoms, weight, keys))
    values = [F.col(f"e{i}") for i in range(3)]
    t = t.select(*keys, *names, F.array_sort(F.array(*[F.struct(F.abs(v).alias("m"), v.alias("v")) for v in values])).alias("_e"))
    t = t.select("*", *[F.col("_e")[i]["v"].alias(f"_l{i}") for i in range(3)])

    def signed(t: DataFrame, raw: str, out: str) -> DataFrame:
        v = [F.col(f"{raw}{i}") for i in range(3)]
        size = F.greatest(*[F.abs(c) for c in v])
        lead = F.when(F.abs(v[0]) == size, v[0]).when(F.abs(v[1]) == size, v[1]).otherwise(v[2])
        t = t.withColumn("_norm", F.sqrt(dot(v, v)) * F.when(lead < 0, -1.0).otherwise(1.0))
        return t.withColumns({f"{out}{i}": c / F.col("_norm") for i, c in enumerate(v)})

    t = signed(_with_eigenvector(t, "_l2", "_p"), "_p", "_c")
    third = [F.col(f"_c{i}") for i in range(3)]
    t = _with_eigenvector(t, "_l1", "_r")
    # Remove what is left of the third axis before normalising.
    t = t.withColumn("_along", dot([F.col(f"_r{i}") for i in range(3)], third))
    t = t.withColumns({f"_q{i}": F.col(f"_r{i}") - F.col("_along") * third[i] for i in range(3)})
    t = signed(t, "_q", "_b")
    second = [F.col(f"_b{i}") for i in range(3)]
    first = cross(second, third)
    axes = first + second + third
    return t.select(*keys, *[c.alias(f"a{i}") for i, c in enumerate(axes)],
                    *[F.col(f"_l{i}").alias(f"moment{i}") for i in range(3)])


def principal_frame(atoms: DataFrame, weight: str = "weight", keys=("complex_id",)) -> DataFrame:
    """Coordinates about the centroid, in the principal axes."""
    keys = list(keys)
    axes = principal_axes(atoms, weight, keys).drop("moment0", "moment1", "moment2")
    j = decenter(atoms, None, keys).join(axes, keys)
    v = apply_matrix([F.col(f"a{i}") for i in range(9)], [F.col("x"), F.col("y"), F.col("z")])
    drop = [f"a{i}" for i in range(9)]
    return j.select("*", *[c.alias(f"_n{a}") for a, c in zip("xyz", v)]).drop("x", "y", "z", *drop).withColumnsRenamed(
        {f"_n{a}": a for a in "xyz"})


def native_pose(atoms: DataFrame, rounds: int = 30) -> DataFrame:
    """Best rotation and translation from the reference ligand (x, y, z) onto the
    native one (nx, ny, nz).

    Nine cross sums per complex give a 4x4 matrix whose dominant eigenvector is
    the rotation; the eigenvector comes from repeated squaring, on one row per
    complex.
    """
    means = atoms.groupBy("complex_id").agg(
        *[F.avg(c).alias(f"m{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    j = atoms.join(means, "complex_id")
    a = {c: F.col(c) - F.col(f"m{c}") for c in ("x", "y", "z", "nx", "ny", "nz")}
    sums = j.groupBy("complex_id").agg(
        *[F.sum(a[p] * a["n" + q]).alias(f"s{p}{q}") for p in "xyz" for q in "xyz"],
        *[F.first(f"m{c}").alias(f"m{c}") for c in ("x", "y", "z", "nx", "ny", "nz")],
    )
    s = {p + q: F.col(f"s{p}{q}") for p in "xyz" for q in "xyz"}
    # Rows and columns in the order w, x, y, z.
    k = [
        [s["xx"] + s["yy"] + s["zz"], s["yz"] - s["zy"], s["zx"] - s["xz"], s["xy"] - s["yx"]],
        [s["yz"] - s["zy"], s["xx"] - s["yy"] - s["zz"], s["xy"] + s["yx"], s["zx"] + s["xz"]],
        [s["zx"] - s["xz"], s["xy"] + s["yx"], s["yy"] - s["xx"] - s["zz"], s["yz"] + s["zy"]],
        [s["xy"] - s["yx"], s["zx"] + s["xz"], s["yz"] + s["zy"], s["zz"] - s["xx"] - s["yy"]],
    ]
    flat = F.array(*[c for row in k for c in row])

    def bind(value: Column, use) -> Column:
        """Evaluate a value once and use it as often as needed."""
        return F.transform(F.array(value), use)[0]

    def norm(m: Column) -> Column:
        return F.sqrt(F.aggregate(m, F.lit(0.0), lambda t, v: t + v * v))

    def scaled(m: Column) -> Column:
        return bind(m, lambda x: bind(F.greatest(norm(x), F.lit(1e-300)), lambda n: F.transform(x, lambda v: v / n)))

    def squared(m: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(15)),
            lambda e: F.aggregate(
                F.sequence(F.lit(0), F.lit(3)), F.lit(0.0),
                lambda t, c: t + m[F.floor(e / 4).cast("int") * 4 + c] * m[c * 4 + e % 4]),
        )

    sums = sums.withColumn("_k", flat).withColumn("_n", norm(F.col("_k")))
    shifted = F.transform("_k", lambda v, i: v + F.when(i % 5 == 0, F.col("_n")).otherwise(F.lit(0.0)))
    sums = sums.withColumn("_m", scaled(shifted))
    sums = sums.withColumn(
        "_m", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("_m"), lambda m, _: scaled(squared(m))))
    diag = [F.struct(F.col("_m")[5 * i].alias("d"), F.lit(i).alias("i")) for i in range(4)]
    sums = sums.withColumn("_i", F.greatest(*diag)["i"])
    v = [F.col("_m")[F.col("_i") * 4 + c] for c in range(4)]
    size = F.sqrt(dot(v, v))
    sign = F.when(v[0] < 0, -1.0).otherwise(1.0)
    # The library's rotation is the transpose of the usual one: conjugate the vector part.
    out = sums.select("*", (-v[1] * sign / size).alias("q1"), (-v[2] * sign / size).alias("q2"),
                      (-v[3] * sign / size).alias("q3"), (v[0] * sign / size).alias("q4"))
    moved = apply_matrix(rotation_matrix([F.col(f"q{i}") for i in range(1, 5)]), [F.col("mx"), F.col("my"), F.col("mz")])
    return out.select("complex_id", "q1", "q2", "q3", "q4",
                      *[(F.col(f"mn{c}") - m).alias(f"t{c}") for c, m in zip("xyz", moved)])


def recenter_frame(complexes: DataFrame, atoms: DataFrame, tol: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Move the ligand reference frame to its centroid c and add the rotated c to the
    native translation; the native pose stays the same.  No change when |c| <= tol."""
    lig = F.col("side") == "L"
    c = atoms.filter(lig).groupBy("complex_id").agg(*[F.avg(a).alias(f"_c{a}") for a in "xyz"])
    far = F.sqrt(dot([F.col(f"_c{a}") for a in "xyz"], [F.col(f"_c{a}") for a in "xyz"])) > tol
    c = c.select("complex_id", *[F.when(far, F.col(f"_c{a}")).otherwise(0.0).alias(f"_c{a}") for a in "xyz"])
    moved = atoms.join(c, "complex_id", "left")
    for a in "xyz":
        moved = moved.withColumn(a, F.when(lig, F.col(a) - F.coalesce(f"_c{a}", F.lit(0.0))).otherwise(F.col(a)))
    shift = apply_matrix(rotation_matrix([F.col(f"q{i}") for i in range(1, 5)]), [F.col(f"_c{a}") for a in "xyz"])
    poses = complexes.join(c, "complex_id")
    poses = poses.select(*[x for x in complexes.columns if x not in ("tx", "ty", "tz")],
                         *[(F.col(f"t{a}") + s).alias(f"t{a}") for a, s in zip("xyz", shift)])
    return poses, moved.drop("_cx", "_cy", "_cz")


GOLDEN = math.pi * (3.0 - math.sqrt(5.0))


def sphere_point(k: Column, n: int) -> list[Column]:
    """Point k of n on a golden-angle spiral over the unit sphere."""
    y = k * (2.0 / n) - 1.0 + 1.0 / n
    r = F.sqrt(F.greatest(F.lit(0.0), 1.0 - y * y))
    phi = F.pmod(k * GOLDEN, F.lit(2.0 * math.pi))
    return [F.cos(phi) * r, y, F.sin(phi) * r]


#: Surface points in one word of a bitmap, and pairs whose bitmaps are made together.
WORD, CAPS = 64, 2048


def _marked(points: np.ndarray, own: list[str], words: list[str]):
    """Batches of caps (direction u, edge) as words of a bitmap of the points they cover."""
    x, y, z = np.pad(points.T, ((0, 0), (0, len(words) * WORD - len(points))), constant_values=np.nan)

    def mark(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CAPS):
                some = batch.slice(start, CAPS)
                ux, uy, uz, edge = (np.asarray(some[c], float)[:, None] for c in ("ux", "uy", "uz", "edge"))
                bits = np.packbits(x * ux + y * uy + z * uz > edge, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[some[c] for c in own], *[pa.array(np.ascontiguousarray(w)) for w in bits.T]], [*own, *words])

    return mark


def exposed_area(atoms: DataFrame, probe: float = 1.4, n: int = 960) -> DataFrame:
    """Solvent-exposed area per atom.

    Neighbour pairs come from a binned radius join.  A neighbour covers a cap of the atom's
    sphere: the points whose direction is closer to the neighbour's than an angle both radii
    give.  A pair makes one bitmap of all points, batches of pairs at a time, and an atom's
    bitmaps are or-ed.
    """
    a = atoms.select("complex_id", "side", "atom_idx", "x", "y", "z", (F.col("radius") + probe).alias("reach"))
    widest = 2.0 * (a.agg(F.max("reach")).first()[0] or probe)   # two spheres of the largest reach in the table
    pairs = radius_join(a, a, widest, keys=MOLECULE, keep_a=["atom_idx", "reach"], keep_b=["atom_idx", "reach"])
    near = pairs.filter((F.col("a_atom_idx") != F.col("b_atom_idx")) & (F.col("d") < F.col("a_reach") + F.col("b_reach")))
    ra, rb, d = F.col("a_reach"), F.col("b_reach"), F.col("d")
    # |a + ra u - b| < rb is u . (b - a) / d > edge; atoms at one place cover all or nothing.
    edge = F.when(d > 0, (ra * ra + d * d - rb * rb) / (2.0 * ra * d)).when(ra < rb, -2.0).otherwise(2.0)
    aim = [F.when(d > 0, (F.col(f"b_{c}") - F.col(f"a_{c}")) / d).otherwise(0.0).alias(f"u{c}") for c in "xyz"]
    caps = near.select(*MOLECULE, F.col("a_atom_idx").alias("atom_idx"), edge.alias("edge"), *aim).filter("edge < 1")
    points = atoms.sparkSession.range(n).orderBy("id").select(*[c.alias(x) for c, x in zip(sphere_point(F.col("id"), n), "xyz")]).collect()
    words = [f"w{i}" for i in range(-(-n // WORD))]
    kind = {f.name: f.dataType.simpleString() for f in caps.schema}
    own = [*MOLECULE, "atom_idx"]
    ship(atoms.sparkSession)
    marked = caps.mapInArrow(_marked(np.array(points, float), own, words), ", ".join([f"`{c}` {kind[c]}" for c in own] + [f"{w} long" for w in words]))
    hidden = marked.groupBy(*own).agg(*[F.bit_or(w).alias(w) for w in words]).select(
        *own, sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).alias("_hidden"))
    share = (n - F.coalesce("_hidden", F.lit(0))) / float(n)
    area = 4.0 * math.pi * F.pow(F.col("radius") + probe, 2.0)
    return atoms.join(hidden, [*MOLECULE, "atom_idx"], "left").withColumn("sasa", share * area).drop("_hidden")


def grid_axes(atoms: DataFrame, h: float = fixed.REFERENCE_SPACING) -> DataFrame:
    """Origin and size of the grid of every complex.

    The margin on all axes is the x extent of the ligand plus one cell.
    """
    rec, lig = F.col("side") == "R", F.col("side") == "L"
    box = atoms.groupBy("complex_id").agg(
        (F.max(F.when(lig, F.col("x"))) - F.min(F.when(lig, F.col("x")))).alias("_l"),
        *[f(F.when(rec, F.col(a))).alias(f"_{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))],
    )
    out = [F.col("complex_id"), F.lit(float(h)).alias("h")]
    for a in "xyz":
        lo = F.col(f"_lo{a}") - F.col("_l") - h
        hi = F.col(f"_hi{a}") + F.col("_l") + h
        out += [lo.alias(f"{a}0"), (F.floor((hi - lo) / h) + 1).cast("long").alias(f"n{a}")]
    return box.select(*out)


def grid_volume(atoms: DataFrame, h: float = fixed.REFERENCE_SPACING) -> DataFrame:
    """Number of grid cells per complex, without any grid."""
    g = grid_axes(atoms, h)
    return g.select("complex_id", F.col("h").alias("spacing"), (F.col("nx") * F.col("ny") * F.col("nz")).alias("voxels"))
