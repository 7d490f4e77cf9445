"""Queries on atoms and poses: features, scatter, rotations, scores, labels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.functions.ordering import top_k
from posefarm.operators import curation as cu
from posefarm.operators import diagnostics as dg
from posefarm.operators import features as ft
from posefarm.operators import quality as ql
from posefarm.operators import rotations as ro
from posefarm.operators import scoring as sc
from posefarm.operators import search as se
from posefarm.operators import spatial as sp
from posefarm.plans import views as V
from posefarm.plans.evaluation import r
from posefarm.plans.registry import query
from posefarm.plans.views import rnd

C = "complex_id"
D = "::DOUBLE"
PI = math.pi
H = 1.5          # spacing of scored grids
HC = V.COARSE    # spacing of scans


# --- SQL pieces -----------------------------------------------------------------

def grid_sql(h: float, src: str = "atoms", name: str = "grids") -> str:
    box = ", ".join(f"min(CASE WHEN side='R' THEN {a} END) AS lo{a}, max(CASE WHEN side='R' THEN {a} END) AS hi{a}" for a in "xyz")
    out = ", ".join(
        f"lo{a}-l-{h}{D} AS {a}0, (floor(((hi{a}+l+{h}{D})-(lo{a}-l-{h}{D}))/{h}{D})+1)::BIGINT AS n{a}" for a in "xyz")
    return f"""{name} AS MATERIALIZED (SELECT complex_id, {h}{D} AS h, {out} FROM (SELECT complex_id,
      max(CASE WHEN side='L' THEN x END)-min(CASE WHEN side='L' THEN x END) AS l, {box} FROM {src} GROUP BY 1))"""


def within_sql(src: str, reach: str, name: str, cols: str, grid: str = "grids") -> str:
    """Rows of ``src`` (columns x, y, z and ``cols``) with every cell in reach."""
    q = f"(SELECT s.*, x0, y0, z0, nx, ny, nz, h, {reach} AS rr, 0.0{D} AS d2 FROM {src} s JOIN {grid} USING (complex_id))"
    for i, a in zip(("ix", "iy", "iz"), "xyz"):
        lo = f"greatest(0, floor(({a}-{a}0)/h - rr/h))::BIGINT"
        hi = f"least(n{a}-1, ceil(({a}-{a}0)/h + rr/h))::BIGINT"
        q = f"(SELECT *, unnest(range({lo}, {hi}+1)) AS {i} FROM {q})"
        q = f"(SELECT * REPLACE (d2 + ({a}-({a}0+{i}*h))*({a}-({a}0+{i}*h)) AS d2) FROM {q})"
    return f"{name} AS MATERIALIZED (SELECT complex_id, {cols}, ix, iy, iz, sqrt(d2) AS d FROM {q} WHERE d2 < rr*rr AND sqrt(d2) < rr)"


def nearest_sql(src: str, name: str, cols: str, grid: str = "grids", floor: bool = False) -> str:
    def cell(a):
        return f"(ceil(({a}-{a}0)/h)-1)::BIGINT" if floor else f"round_even(({a}-{a}0)/h, 0)::BIGINT"
    return f"""{name} AS (SELECT complex_id, {cols}, ix, iy, iz FROM (SELECT s.*, nx, ny, nz, {cell('x')} AS ix, {cell('y')} AS iy, {cell('z')} AS iz
      FROM {src} s JOIN {grid} USING (complex_id)) WHERE ix>=0 AND ix<nx AND iy>=0 AND iy<ny AND iz>=0 AND iz<nz)"""


# A digest of a cell table per complex: number of cells, total, and a position-weighted total.
def digest_sql(src: str, w: str = "w", extra: str = "") -> str:
    return f"""SELECT complex_id, {extra} count(*) AS cells, {r(f'sum({w})')} AS total, {r(f'sum({w}*(ix+3*iy+7*iz))', 4)} AS moment FROM {src} GROUP BY ALL"""


def digest(cells, w="w", keys=()):
    w = F.col(w)
    return cells.groupBy(C, *keys).agg(F.count(F.lit(1)).alias("cells"), rnd(F.sum(w)).alias("total"),
                                       rnd(F.sum(w * (F.col("ix") + 3 * F.col("iy") + 7 * F.col("iz"))), 4).alias("moment"))


CHARGE_LUT = "[" + ",".join(f"{c}{D}" for c in fixed.CHARGES) + "]"
CHARGED = f"(SELECT *, CASE WHEN side='L' THEN -{CHARGE_LUT}[charge_id] ELSE {CHARGE_LUT}[charge_id] END AS charge FROM atoms)"
REC = f"rec AS (SELECT * FROM {CHARGED} WHERE side='R')"


# --- atom features ------------------------------------------------------------------

RESIDUES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
NAMES = "N CA C O CB OXT NZ NH1 OE1 OD1".split()


def named_atoms(spark, sf):
    return with_names(V.atoms(spark, sf)).select(C, "side", "atom_idx", "x", "y", "z", "res_name", "atom_name")


def with_names(a):
    """Residue and atom names from the place of an atom."""
    order = F.col("atom_idx") + F.when(F.col("side") == "L", V.REC_ATOMS).otherwise(0)
    res = F.element_at(F.array(*[F.lit(x) for x in RESIDUES]), ((F.col(C) + F.floor(F.col("atom_idx") / 5)) % 20 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), ((order * 3 + F.col(C)) % 10 + 1).cast("int"))
    return a.select("*", res.alias("res_name"), name.alias("atom_name"))


NAMED_ONLY = f"""named AS (SELECT complex_id, side, atom_idx, x, y, z, {RESIDUES!r}[(complex_id + atom_idx//5) % 20 + 1] AS res_name,
  {NAMES!r}[((atom_idx + CASE WHEN side='L' THEN {V.REC_ATOMS} ELSE 0 END)*3 + complex_id) % 10 + 1] AS atom_name FROM atoms)"""
NAMED = V.ATOMS + "," + NAMED_ONLY
RULES = "rules(type_id, res_name, atom_name) AS (VALUES " + ",".join(f"({t},'{x}','{a}')" for t, x, a in fixed.atom_type_rows()) + ")"


@query("atom_types", f"""WITH {NAMED}, {RULES} SELECT n.complex_id, n.side, n.atom_idx, rules.type_id::INTEGER AS type_id FROM named n LEFT JOIN rules
  ON rules.res_name=n.res_name AND rules.atom_name = CASE WHEN n.atom_name='OXT' THEN 'O' ELSE n.atom_name END""")
def atom_types(spark, sf):
    return ft.with_atom_type(named_atoms(spark, sf), strict=False).select(C, "side", "atom_idx", "type_id")


RADIUS_CASE = "CASE regexp_extract(atom_name, '^[0-9]*([^0-9])', 1) " + " ".join(f"WHEN '{e}' THEN {v}{D}" for e, v in fixed.RADII.items()) + " END"


@query("atom_radii", f"WITH {NAMED} SELECT complex_id, side, atom_idx, {RADIUS_CASE} AS radius FROM named")
def atom_radii(spark, sf):
    return ft.with_radius(named_atoms(spark, sf)).select(C, "side", "atom_idx", "radius")


CHARGE_CASE = """CASE WHEN res_name='PRO' AND atom_name='N' THEN 7 WHEN atom_name='N' AND k=1 THEN 1 WHEN atom_name='N' THEN 11 WHEN atom_name='O' THEN 10 WHEN atom_name='OXT' THEN 2
  WHEN res_name='ARG' AND atom_name IN ('NH1','NH2') THEN 3 WHEN res_name='GLU' AND atom_name IN ('OE1','OE2') THEN 4 WHEN res_name='ASP' AND atom_name IN ('OD1','OD2') THEN 5
  WHEN res_name='LYS' AND atom_name='NZ' THEN 6 ELSE 8 END"""
CHARGE_TYPES = NAMED + f""",
ct AS (SELECT complex_id, side, atom_idx, {CHARGE_CASE} AS charge_id FROM (SELECT *, row_number() OVER (PARTITION BY complex_id, side, atom_name='N' AND res_name<>'PRO' ORDER BY atom_idx) AS k FROM named))"""


@query("charge_types", f"WITH {CHARGE_TYPES} SELECT complex_id, side, atom_idx, charge_id::INTEGER AS charge_id FROM ct")
def charge_types(spark, sf):
    return ft.with_charge_type(named_atoms(spark, sf)).select(C, "side", "atom_idx", "charge_id")


@query("partial_charges", f"WITH {CHARGE_TYPES} SELECT complex_id, side, atom_idx, (CASE WHEN side='L' THEN -{CHARGE_LUT}[charge_id] ELSE {CHARGE_LUT}[charge_id] END)+0.0{D} AS charge FROM ct")
def partial_charges(spark, sf):
    a = ft.with_partial_charge(ft.with_charge_type(named_atoms(spark, sf)))
    return a.select(C, "side", "atom_idx", (F.col("charge") + F.lit(0.0)).alias("charge"))


@query("decenter", f"""WITH {V.ATOMS} SELECT complex_id, side, atom_idx, {", ".join(r(f"{a}-avg({a}) OVER w") + f" AS {a}" for a in "xyz")},
  {", ".join(r(f"{a}-(sum(radius*{a}) OVER w)/(sum(radius) OVER w)") + f" AS w{a}" for a in "xyz")} FROM atoms WINDOW w AS (PARTITION BY complex_id, side)""")
def decenter(spark, sf):
    a = V.atoms(spark, sf)
    key = [C, "side", "atom_idx"]
    plain = ft.decenter(a).select(*key, *[rnd(F.col(x)).alias(x) for x in "xyz"])
    heavy = ft.decenter(a, "radius").select(*key, *[rnd(F.col(x)).alias(f"w{x}") for x in "xyz"])
    return plain.join(heavy, key)


WEIGHT = "[" + ",".join(f"{row[0]}{D}" for row in fixed.PAIR_TABLE) + "][type_id]"


@query("principal_frame", f"""WITH {V.ATOMS}, c AS (SELECT complex_id, {WEIGHT} AS w, {", ".join(f"{a}-avg({a}) OVER (PARTITION BY complex_id) AS {a}" for a in "xyz")} FROM atoms WHERE side='L')
 SELECT complex_id, count(*) AS n, {r('sum(x*x+y*y+z*z)')} AS spread, {r('sum(w*(x*x+y*y+z*z))*2')} AS trace, 0.0{D} AS off_diagonal, true AS ordered, 1.0{D} AS handed FROM c GROUP BY 1""")
def principal_frame(spark, sf):
    lig = V.atoms(spark, sf).filter(F.col("side") == "L").withColumn("weight", ft.frame_weight(F.col("type_id")))
    p = ft.principal_frame(lig)
    w, x, y, z = (F.col(c) for c in ("weight", "x", "y", "z"))
    xx, yy, zz = F.sum(w * (y * y + z * z)), F.sum(w * (x * x + z * z)), F.sum(w * (x * x + y * y))
    s = p.groupBy(C).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(x * x + y * y + z * z)).alias("spread"), xx.alias("_x"), yy.alias("_y"), zz.alias("_z"),
                         (F.abs(F.sum(w * x * y)) + F.abs(F.sum(w * x * z)) + F.abs(F.sum(w * y * z))).alias("_o"))
    axes = ft.principal_axes(lig)
    a = [F.col(f"a{i}") for i in range(9)]
    det = a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])
    ordered = (F.abs("_x") <= F.abs("_y") + 1e-6) & (F.abs("_y") <= F.abs("_z") + 1e-6)
    return s.join(axes.select(C, rnd(det).alias("handed")), C).select(
        C, "n", "spread", rnd(F.col("_x") + F.col("_y") + F.col("_z")).alias("trace"), rnd(F.col("_o"), 4).alias("off_diagonal"), ordered.alias("ordered"), "handed")


@query("native_pose", f"WITH {V.COMPLEXES} SELECT complex_id, {', '.join(r(c, 5) + f' AS {c}' for c in ('q1', 'q2', 'q3', 'q4', 'tx', 'ty', 'tz'))} FROM complexes")
def native_pose(spark, sf):
    lig = V.native_atoms(spark, sf).filter(F.col("side") == "L")
    p = ft.native_pose(lig)
    return p.select(C, *[rnd(F.col(c), 5).alias(c) for c in ("q1", "q2", "q3", "q4", "tx", "ty", "tz")])


@query("recenter_frame", f"""WITH {V.NATIVE}, m AS (SELECT complex_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz FROM native WHERE side='L' GROUP BY 1)
 SELECT complex_id, {r('nx')} AS tx, {r('ny')} AS ty, {r('nz')} AS tz, 0.0{D} AS off FROM m""")
def recenter_frame(spark, sf):
    poses, atoms = ft.recenter_frame(V.complexes(spark, sf), V.atoms(spark, sf))
    off = atoms.filter(F.col("side") == "L").groupBy(C).agg(rnd(F.abs(F.avg("x")) + F.abs(F.avg("y")) + F.abs(F.avg("z"))).alias("off"))
    return poses.join(off, C).select(C, *[rnd(F.col(t)).alias(t) for t in ("tx", "ty", "tz")], "off")


N_SPHERE = 960


@query("exposed_area", f"""WITH {V.ATOMS}, a AS (SELECT *, radius+1.4{D} AS reach FROM atoms),
 sphere AS (SELECT k, cos(phi)*rr AS ux, y AS uy, sin(phi)*rr AS uz FROM (SELECT k, y, sqrt(greatest(0.0{D}, 1.0{D}-y*y)) AS rr, (k*{ft.GOLDEN!r}{D}) % {2 * PI!r}{D} AS phi FROM (SELECT k, k*{2 / N_SPHERE!r}{D} - 1.0{D} + {1 / N_SPHERE!r}{D} AS y FROM (SELECT unnest(range(0,{N_SPHERE})) AS k)))),
 near AS (SELECT a.complex_id, a.side, a.atom_idx, a.x, a.y, a.z, a.reach, b.x AS bx, b.y AS b_y, b.z AS bz, b.reach AS breach FROM a JOIN a b ON a.complex_id=b.complex_id AND a.side=b.side AND a.atom_idx<>b.atom_idx
   WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < a.reach+b.reach),
 hidden AS (SELECT complex_id, side, atom_idx, count(DISTINCT k) AS hid FROM near CROSS JOIN sphere WHERE (x+reach*ux-bx)*(x+reach*ux-bx)+(y+reach*uy-b_y)*(y+reach*uy-b_y)+(z+reach*uz-bz)*(z+reach*uz-bz) < breach*breach GROUP BY ALL)
 SELECT a.complex_id, a.side, a.atom_idx, {r(f"({N_SPHERE}-coalesce(hid,0))/{N_SPHERE}.0{D} * {4 * PI!r}{D}*reach*reach")} AS sasa FROM a LEFT JOIN hidden USING (complex_id, side, atom_idx)""")
def exposed_area(spark, sf):
    a = ft.exposed_area(V.atoms(spark, sf).drop("sasa"), n=N_SPHERE)
    return a.select(C, "side", "atom_idx", rnd(F.col("sasa")).alias("sasa"))


@query("grid_axes", f"WITH {V.ATOMS}, {grid_sql(1.2)} SELECT complex_id, {', '.join(r(f'{a}0') + f' AS {a}0, n{a}' for a in 'xyz')}, nx*ny*nz AS voxels FROM grids")
def grid_axes(spark, sf):
    g = ft.grid_axes(V.atoms(spark, sf))
    return g.select(C, *[x for a in "xyz" for x in (rnd(F.col(f"{a}0")).alias(f"{a}0"), F.col(f"n{a}"))], (F.col("nx") * F.col("ny") * F.col("nz")).alias("voxels"))


@query("grid_volume_percentiles", f"""WITH {V.ATOMS}, {grid_sql(1.2)}, v AS (SELECT nx*ny*nz AS v, row_number() OVER (ORDER BY nx*ny*nz) AS i, count(*) OVER () AS n FROM grids)
 SELECT {", ".join(f"max(CASE WHEN i=least(n-1, floor({q}{D}*n)::BIGINT)+1 THEN v END) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.9, 0.99))}, max(v) AS largest FROM v""")
def grid_volume_percentiles(spark, sf):
    from posefarm.functions.ordering import order_values
    v = ft.grid_volume(V.atoms(spark, sf)).select("voxels")
    p = {f"p{int(q * 100)}": F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))) + 1 for q in (0.25, 0.5, 0.9, 0.99)}
    return order_values(v, [], "voxels", {**p, "largest": F.col("n")}).drop("n")


# --- scatter --------------------------------------------------------------------------

G15 = V.ATOMS + "," + grid_sql(H)


@query("scatter_nearest", f"WITH {G15}, {nearest_sql('atoms', 'spot', 'type_id, radius')}, s AS (SELECT complex_id, type_id AS grp, ix, iy, iz, sum(radius) AS w FROM spot GROUP BY ALL) {digest_sql('s')}")
def scatter_nearest(spark, sf):
    a = V.atoms(spark, sf)
    return digest(sp.scatter_nearest(a, ft.grid_axes(a, H), F.col("radius"), group="type_id"))


@query("scatter_nearest_last", f"WITH {V.ATOMS},{grid_sql(HC)}, {nearest_sql("(SELECT * FROM atoms WHERE side='R')", "spot", 'atom_idx, radius', floor=True)}, s AS (SELECT complex_id, ix, iy, iz, arg_max(radius, atom_idx) AS w FROM spot GROUP BY ALL) {digest_sql('s')}")
def scatter_nearest_last(spark, sf):
    a = V.atoms(spark, sf)
    rec = a.filter(F.col("side") == "R")
    return digest(sp.scatter_nearest(rec, ft.grid_axes(a, HC), F.col("radius"), mode="last", legacy_floor=True))


@query("radius_join", f"""WITH {V.NATIVE} SELECT a.complex_id, a.atom_idx AS rec_idx, b.atom_idx AS lig_idx, {r('sqrt((a.nx-b.nx)*(a.nx-b.nx)+(a.ny-b.ny)*(a.ny-b.ny)+(a.nz-b.nz)*(a.nz-b.nz))')} AS d
 FROM native a JOIN native b ON a.complex_id=b.complex_id AND a.side='R' AND b.side='L' WHERE sqrt((a.nx-b.nx)*(a.nx-b.nx)+(a.ny-b.ny)*(a.ny-b.ny)+(a.nz-b.nz)*(a.nz-b.nz)) < 6.5{D}""")
def radius_join(spark, sf):
    n = ql.native_contacts(V.native_atoms(spark, sf), 6.5)
    return n.select(C, "rec_idx", "lig_idx", rnd(F.col("d")).alias("d"))


@query("scatter_within", f"WITH {G15}, {within_sql('atoms', f'radius+1.0{D}', 'near', 'type_id, sasa')}, s AS (SELECT complex_id, type_id AS grp, ix, iy, iz, sum(sasa) AS w FROM near GROUP BY ALL) {digest_sql('s')}")
def scatter_within(spark, sf):
    a = V.atoms(spark, sf)
    return digest(sp.scatter_within(a, ft.grid_axes(a, H), F.col("radius") + 1.0, F.col("sasa"), group="type_id"))


@query("scatter_any", f"WITH {G15}, {within_sql('atoms', f'2.0{D}', 'near', 'side')}, s AS (SELECT DISTINCT complex_id, ix, iy, iz, 1.0{D} AS w FROM near) {digest_sql('s')}")
def scatter_any(spark, sf):
    a = V.atoms(spark, sf)
    return digest(sp.scatter_within(a, ft.grid_axes(a, H), 2.0, agg="any"))


@query("scatter_inverse_distance", f"WITH {G15}, {REC}, {within_sql('rec', f'8.0{D}', 'near', 'charge')}, s AS (SELECT complex_id, ix, iy, iz, sum(charge/greatest(d,1e-6{D})) AS w FROM near GROUP BY ALL) {digest_sql('s')}")
def scatter_inverse_distance(spark, sf):
    a = ft.with_partial_charge(V.atoms(spark, sf))
    return digest(sp.scatter_inverse_distance(a.filter(F.col("side") == "R"), ft.grid_axes(a, H)))


LEGACY = f"""num AS (SELECT complex_id, type_id AS grp, ix, iy, iz, count(*)::DOUBLE AS w FROM atr GROUP BY ALL), den AS (SELECT complex_id, type_id AS grp, ix, iy, iz, sum(d) AS dd FROM neard GROUP BY ALL),
 ratio AS (SELECT complex_id, grp, ix, iy, iz, CASE WHEN dd>0 THEN w/dd ELSE 0.0{D} END AS w FROM num LEFT JOIN den USING (complex_id, grp, ix, iy, iz))"""
REC11 = "rec11 AS (SELECT * FROM atoms WHERE side='R' AND type_id BETWEEN 1 AND 11)"


@query("scatter_distance", f"WITH {G15}, {REC11}, {within_sql('rec11', f'8.0{D}', 'near', 'type_id')}, s AS (SELECT complex_id, type_id AS grp, ix, iy, iz, sum(d) AS w FROM near GROUP BY ALL) {digest_sql('s')}")
def scatter_distance(spark, sf):
    a = V.atoms(spark, sf)
    rec = a.filter((F.col("side") == "R") & F.col("type_id").between(1, 11))
    return digest(sp.scatter_distance(rec, ft.grid_axes(a, H), group="type_id"))


@query("count_over_distance", f"WITH {G15}, {REC11}, {nearest_sql('rec11', 'atr', 'type_id')}, {within_sql('rec11', f'8.0{D}', 'neard', 'type_id')}, {LEGACY} {digest_sql('ratio')}")
def count_over_distance(spark, sf):
    a = V.atoms(spark, sf)
    return digest(sp.count_over_distance(a.filter(F.col("side") == "R"), ft.grid_axes(a, H)))


def trilinear_sql(src: str, name: str, cols: str, weight: str = f"1.0{D}") -> str:
    base = ", ".join(f"floor(({a}-{a}0)/h)::BIGINT AS i{a}, ({a}-{a}0)/h - floor(({a}-{a}0)/h) AS f{a}" for a in "xyz")
    ok = " AND ".join(f"i{a}>=0 AND i{a}+1<n{a}" for a in "xyz")
    share = "*".join(f"(CASE WHEN b{a}=1 THEN f{a} ELSE 1.0{D}-f{a} END)" for a in "xyz")
    return f"""{name} AS (SELECT complex_id, {cols}, ix+bx AS ix, iy+b_y AS iy, iz+bz AS iz, w0*{share.replace('by=1', 'b_y=1')} AS w FROM
      (SELECT s.*, nx, ny, nz, {base}, {weight} AS w0 FROM {src} s JOIN grids USING (complex_id)) CROSS JOIN (SELECT (k&1)::BIGINT AS bx, ((k>>1)&1)::BIGINT AS b_y, ((k>>2)&1)::BIGINT AS bz FROM (SELECT unnest(range(0,8)) AS k)) WHERE {ok})"""


@query("scatter_trilinear", f"WITH {G15}, {trilinear_sql('atoms', 'corner', 'type_id')}, s AS (SELECT complex_id, type_id AS grp, ix, iy, iz, sum(w) AS w FROM corner GROUP BY ALL) {digest_sql('s')}")
def scatter_trilinear(spark, sf):
    a = V.atoms(spark, sf)
    return digest(sp.scatter_trilinear(a, ft.grid_axes(a, H), group="type_id"))


LAYERS = within_sql("rec", "radius", "cover", "sasa") + f", layers AS MATERIALIZED (SELECT complex_id, ix, iy, iz, bool_or(sasa > 1.0{D}) AS surface FROM cover GROUP BY ALL)"


@query("surface_core_layers", f"WITH {G15}, {REC}, {LAYERS}, s AS (SELECT *, CASE WHEN surface THEN 1.5{D} ELSE 2.25{D} END AS w FROM layers) {digest_sql('s', extra='surface,')}")
def surface_core_layers(spark, sf):
    a = V.atoms(spark, sf)
    layers = sp.surface_core_layers(a.filter(F.col("side") == "R"), ft.grid_axes(a, H))
    return digest(sp.encode_layers(layers, 1.5), keys=["surface"])


OPEN = within_sql("rec", f"radius+3.6{D}", "reachable", "side") + """, open_ AS MATERIALIZED (SELECT complex_id, ix, iy, iz, w FROM (SELECT complex_id, ix, iy, iz, count(*)::DOUBLE AS w FROM reachable GROUP BY ALL) ANTI JOIN layers USING (complex_id, ix, iy, iz))"""


@query("open_space_count", f"WITH {G15}, {REC}, {LAYERS}, {OPEN} {digest_sql('open_')}")
def open_space_count(spark, sf):
    a = V.atoms(spark, sf)
    rec, g = a.filter(F.col("side") == "R"), ft.grid_axes(a, H)
    return digest(sp.open_space_count(rec, g, sp.surface_core_layers(rec, g)))


@query("boundary_to_surface", f"""WITH {G15}, {REC}, {LAYERS}, steps(sx,sy,sz) AS (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)),
 nb AS (SELECT l.complex_id, l.ix, l.iy, l.iz, ((l.ix+sx)+nx)%nx AS jx, ((l.iy+sy)+ny)%ny AS jy, ((l.iz+sz)+nz)%nz AS jz FROM layers l JOIN grids USING (complex_id) CROSS JOIN steps WHERE NOT surface),
 e AS (SELECT nb.complex_id, nb.ix, nb.iy, nb.iz, count(*) FILTER (o.ix IS NULL) AS empty FROM nb LEFT JOIN layers o ON o.complex_id=nb.complex_id AND o.ix=jx AND o.iy=jy AND o.iz=jz GROUP BY ALL),
 s AS (SELECT complex_id, ix, iy, iz, surface OR coalesce(empty,0)>=2 AS surface, 1.0{D} AS w FROM layers LEFT JOIN e USING (complex_id, ix, iy, iz)) {digest_sql('s', extra='surface,')}""")
def boundary_to_surface(spark, sf):
    a = V.atoms(spark, sf)
    g = ft.grid_axes(a, H)
    layers = sp.surface_core_layers(a.filter(F.col("side") == "R"), g)
    return digest(sp.boundary_to_surface(layers, g).withColumn("w", F.lit(1.0)), keys=["surface"])


# An asymmetric table shows a wrong transpose.
SKEWED = [[((i * 5 + j * 3) % 13 - 6) / 8.0 for j in range(12)] for i in range(12)]
SKEWED_SQL = "[" + ",".join(str(v) + D for row in SKEWED for v in row) + "]"
TYPES = within_sql("rec", f"6.0{D}", "typed_near", "type_id") + ", types AS MATERIALIZED (SELECT complex_id, type_id AS grp, ix, iy, iz, count(*)::DOUBLE AS w FROM typed_near GROUP BY ALL)"
MIXED = f", mixed AS (SELECT complex_id, i AS grp, ix, iy, iz, sum(w*{SKEWED_SQL}[(i-1)*12+grp]) AS w FROM types CROSS JOIN (SELECT unnest(range(1,13)) AS i) GROUP BY ALL)"


@query("type_layers", f"WITH {G15}, {REC}, {TYPES} {digest_sql('types', extra='grp,')}")
def type_layers(spark, sf):
    a = V.atoms(spark, sf)
    return digest(sp.type_layers(a.filter(F.col("side") == "R"), ft.grid_axes(a, H)), keys=["grp"])


@query("weighted_type_layers", f"WITH {V.ATOMS},{grid_sql(HC)}, {REC}, {TYPES}{MIXED} SELECT complex_id, grp::INTEGER AS grp, cells, total, moment FROM ({digest_sql('mixed', extra='grp,')})")
def weighted_type_layers(spark, sf):
    a = V.atoms(spark, sf)
    t = sp.type_layers(a.filter(F.col("side") == "R"), ft.grid_axes(a, HC))
    return digest(sp.weighted_type_layers(t, fixed.pair_table(spark, SKEWED)), keys=["grp"])


# --- rotations ---------------------------------------------------------------------------

def _hopf_values(nside: int):
    """The grid again from its definition, ring by ring, for the SQL side."""
    n_psi = 6 * nside
    centres = []
    for ring in range(1, 4 * nside):
        if ring < nside:
            z, count, start = 1 - ring ** 2 / (3 * nside ** 2), 4 * ring, 0.5
        elif ring <= 3 * nside:
            z, count = (2 * nside - ring) * 2 / (3 * nside), 4 * nside
            start = 0.0 if (ring + nside) % 2 else 0.5
        else:
            back = 4 * nside - ring
            z, count, start = -1 + back ** 2 / (3 * nside ** 2), 4 * back, 0.5
        centres += [(math.acos(z), (j + start) * 2 * PI / count) for j in range(count)]
    out = []
    for theta, phi in centres:
        for k in range(n_psi):
            psi = (k + 0.5) * 2 * PI / n_psi
            out.append((math.cos(theta / 2) * math.cos(psi / 2), math.cos(theta / 2) * math.sin(psi / 2),
                        math.sin(theta / 2) * math.cos(phi + psi / 2), math.sin(theta / 2) * math.sin(phi + psi / 2)))
    return out


def rotation_values(quats, name="rset"):
    rows = ",".join(f"({i},{a!r}{D},{b!r}{D},{c!r}{D},{d!r}{D})" for i, (a, b, c, d) in enumerate(quats))
    return f"{name}(qi,q1,q2,q3,q4) AS (VALUES {rows})"


def angle_sql(a: str, b: str) -> str:
    return f"degrees(2.0{D}*acos(least(1.0{D}, abs({a}.q1*{b}.q1+{a}.q2*{b}.q2+{a}.q3*{b}.q3+{a}.q4*{b}.q4))))"


NSIDE = 2
NEAR = V.COMPLEXES + "," + rotation_values(_hopf_values(NSIDE)) + f""",
near AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY angle, qi) AS place FROM (SELECT c.complex_id, s.qi, s.q1, s.q2, s.q3, s.q4, {angle_sql('c', 's')} AS angle FROM complexes c CROSS JOIN rset s))"""


@query("nearest_rotations", f"WITH {NEAR} SELECT complex_id, qi::INTEGER AS qi, place::INTEGER AS place, {r('angle')} AS angle FROM near WHERE place<=4")
def nearest_rotations(spark, sf):
    n = ro.hopf_size(NSIDE)
    near = ro.nearest_rotations(V.complexes(spark, sf), ro.hopf_rotations(spark, NSIDE), 4, n)
    return near.select(C, "qi", "place", rnd(F.col("angle")).alias("angle"))


def _sql_quantile(v: str, q: float, src: str) -> str:
    return f"(SELECT quantile_cont({v}, {q}) FROM {src})"


@query("covering_angles", f"WITH {NEAR}, g AS (SELECT angle FROM near WHERE place=1) SELECT {r('avg(angle)')} AS mean, {r(_sql_quantile('angle', 0.5, 'g'))} AS median, {r(_sql_quantile('angle', 0.95, 'g'))} AS p95, {r('max(angle)')} AS max FROM g")
def covering_angles(spark, sf):
    near = ro.nearest_rotations(V.complexes(spark, sf), ro.hopf_rotations(spark, NSIDE), 1, ro.hopf_size(NSIDE))
    s = ro.angle_summary(near)
    return s.select(*[rnd(F.col(c)).alias(c) for c in s.columns])


def _euler_values(deg):
    turn, half = round(360 / deg), round(180 / deg) + 1
    out = []
    for i in range(turn):
        for j in range(half):
            for k in range(turn):
                phi, theta, psi = i * 2 * PI / turn, j * PI / (half - 1), k * 2 * PI / turn
                # z-y-z composition in closed form
                s, c = math.sin(theta / 2), math.cos(theta / 2)
                out.append((s * math.sin((phi - psi) / 2), s * math.cos((phi - psi) / 2), c * math.sin((phi + psi) / 2), c * math.cos((phi + psi) / 2)))
    return out


@query("euler_rotations", f"""WITH {V.COMPLEXES}, {rotation_values(_euler_values(60.0))}, n AS (SELECT complex_id, min({angle_sql('c', 's')}) AS angle FROM complexes c CROSS JOIN rset s GROUP BY 1) SELECT complex_id, {r('angle')} AS angle FROM n""")
def euler_rotations(spark, sf):
    near = ro.nearest_rotations(V.complexes(spark, sf), ro.euler_rotations(spark, 60.0), 1, len(_euler_values(60.0)))
    return near.select(C, rnd(F.col("angle")).alias("angle"))


def uniform_sql(value: str, seed: int) -> str:
    return f"({V.mix_sql(value, seed)}/2147483647.0{D})"


def random_quat_sql(key: str, seed: int) -> list[str]:
    u = [uniform_sql(f"({key})*3+{i}", seed) for i in range(3)]
    a, b = f"sqrt(1.0{D}-{u[0]})", f"sqrt({u[0]})"
    t1, t2 = f"({2 * PI!r}{D}*{u[1]})", f"({2 * PI!r}{D}*{u[2]})"
    return [f"{a}*sin{t1}", f"{a}*cos{t1}", f"{b}*sin{t2}", f"{b}*cos{t2}"]


FINE = 3


@query("covering_radius", f"""WITH {V.COMPLEXES}, {rotation_values(_hopf_values(FINE))}, drawn AS (SELECT complex_id, {", ".join(f"{x} AS q{i + 1}" for i, x in enumerate(random_quat_sql("complex_id", 1)))} FROM complexes),
 g AS (SELECT complex_id, min({angle_sql('c', 's')}) AS angle FROM drawn c CROSS JOIN rset s GROUP BY 1)
 SELECT {r('avg(angle)')} AS mean, {r(_sql_quantile('angle', 0.5, 'g'))} AS median, {r(_sql_quantile('angle', 0.95, 'g'))} AS p95, {r('max(angle)')} AS max FROM g""")
def covering_radius(spark, sf):
    s = ro.covering_radius(V.complexes(spark, sf), ro.hopf_rotations(spark, FINE), ro.hopf_size(FINE))
    return s.select(*[rnd(F.col(c)).alias(c) for c in s.columns])


@query("random_rotations", f"""WITH q AS (SELECT vec_id AS complex_id, {', '.join(f'{e} AS q{i + 1}' for i, e in enumerate(random_quat_sql('vec_id', 5)))} FROM embeddings)
 SELECT complex_id, {', '.join(r(f'q{i}') + f' AS q{i}' for i in range(1, 5))}, {r('q1*q1+q2*q2+q3*q3+q4*q4')} AS norm FROM q""")
def random_rotations(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias(C))
    q = e.select(C, *[c.alias(f"q{i + 1}") for i, c in enumerate(ro.random_quaternion(F.col(C), 5))])
    cols = [F.col(f"q{i}") for i in range(1, 5)]
    return q.select(C, *[rnd(c).alias(f"q{i + 1}") for i, c in enumerate(cols)], rnd(ro.dot(cols, cols)).alias("norm"))


CONE_KEY = V.mix2_sql('c.complex_id', 'cone', 4)


@query("rotation_cone", f"""WITH {V.COMPLEXES} SELECT complex_id, cone::INTEGER AS cone, {r(f"CASE WHEN cone=0 THEN 0.0{D} ELSE {uniform_sql(CONE_KEY, 6)}*15.0{D} END", 4)} AS angle FROM complexes c CROSS JOIN (SELECT unnest(range(0,5)) AS cone)""")
def rotation_cone(spark, sf):
    c = V.complexes(spark, sf)
    cone = ro.rotation_cone(c, 5, 15.0, 4).select(C, "cone", "q1", "q2", "q3", "q4")
    centre = c.select(C, *[F.col(f"q{i}").alias(f"c{i}") for i in range(1, 5)])
    # The angle from the chord stays exact near zero, where acos does not.
    j = cone.join(centre, C)
    sign = F.when(ro.dot([F.col(f"q{i}") for i in range(1, 5)], [F.col(f"c{i}") for i in range(1, 5)]) < 0, -1.0).otherwise(1.0)
    chord = F.sqrt(sum(((F.col(f"q{i}") * sign - F.col(f"c{i}")) * (F.col(f"q{i}") * sign - F.col(f"c{i}")) for i in range(1, 5)), F.lit(0.0)))
    return j.select(C, "cone", rnd(F.degrees(4.0 * F.asin(chord / 2.0)), 4).alias("angle"))


@query("rotate_poses", f"WITH {V.PLACED} SELECT complex_id, pose_id, atom_idx, {r('px')} AS x, {r('py')} AS y, {r('pz')} AS z FROM placed")
def rotate_poses(spark, sf):
    lig = V.atoms(spark, sf).filter(F.col("side") == "L")
    p = ro.rotate_poses(lig, V.poses(spark, sf))
    return p.select(C, "pose_id", "atom_idx", *[rnd(F.col(a)).alias(a) for a in "xyz"])


# Pose lists: one header and eight poses per embedding.
LIST_ANGLES = ("tx*0.3", "tx*0.2", "tx*0.1")


def pose_lists(spark, sf):
    c = V.complexes(spark, sf)
    head = c.select(C, F.lit(96).alias("cells"), F.lit(1.2).alias("spacing"), *[(F.col("tx") * k).alias(f"init{i + 1}") for i, k in enumerate((0.3, 0.2, 0.1))],
                    *[F.lit(v).alias(f"rc_{a}") for a, v in zip("xyz", (1.0, 2.0, 3.0))], *[F.lit(v).alias(f"lc_{a}") for a, v in zip("xyz", (0.5, -0.5, 0.25))])
    p = V.poses(spark, sf)
    rows = p.select(C, "pose_id", (F.col("q1") * 2).alias("a1"), (F.col("q2") + 0.5).alias("a2"), (F.col("q3") * 3).alias("a3"),
                    (F.col("qi") * 13 % 96).cast("int").alias("t1"), (F.col("qi") * 29 % 96).cast("int").alias("t2"), (F.col("qi") * 53 % 96).cast("int").alias("t3"))
    return head, rows


def _euler_sql(psi: str, theta: str, phi: str) -> list[str]:
    cp, sp_, ct, st, cf, sf_ = f"cos({psi})", f"sin({psi})", f"cos({theta})", f"sin({theta})", f"cos({phi})", f"sin({phi})"
    return [f"({cp}*{cf}-{sp_}*{ct}*{sf_})", f"(-{cp}*{sf_}-{sp_}*{ct}*{cf})", f"({sp_}*{st})", f"({sp_}*{cf}+{cp}*{ct}*{sf_})", f"(-{sp_}*{sf_}+{cp}*{ct}*{cf})",
            f"(-{cp}*{st})", f"({st}*{sf_})", f"({st}*{cf})", ct]


_I, _P = _euler_sql("tx*0.3", "tx*0.2", "tx*0.1"), _euler_sql("q1*2", "q2+0.5", "q3*3")


def _wrap(t: str) -> str:
    return f"(CASE WHEN {t}>=48 THEN {t}-96 ELSE {t} END)"


@query("poses_from_list", f"""WITH {V.ATOMS},{V.POSES}, f AS (SELECT a.complex_id, a.atom_idx, c.tx, {", ".join(f"{_I[3 * i]}*(a.x-0.5{D})+{_I[3 * i + 1]}*(a.y+0.5{D})+{_I[3 * i + 2]}*(a.z-0.25{D}) AS {a}" for i, a in enumerate("xyz"))}
   FROM atoms a JOIN complexes c USING (complex_id) WHERE side='L'),
 g AS (SELECT f.complex_id, p.pose_id, f.atom_idx, {", ".join(f"{_P[3 * i]}*f.x+{_P[3 * i + 1]}*f.y+{_P[3 * i + 2]}*f.z - {_wrap(f'(p.qi*{k}%96)')}*1.2{D} + {c}{D} AS {a}" for i, (a, k, c) in enumerate(zip("xyz", (13, 29, 53), (1.0, 2.0, 3.0))))}
   FROM f JOIN poses p USING (complex_id)) SELECT complex_id, pose_id, atom_idx, {", ".join(r(a) + f" AS {a}" for a in "xyz")} FROM g""")
def poses_from_list(spark, sf):
    head, rows = pose_lists(spark, sf)
    lig = V.atoms(spark, sf).filter(F.col("side") == "L")
    p = ro.poses_from_list(lig, head, rows)
    return p.select(C, "pose_id", "atom_idx", *[rnd(F.col(a)).alias(a) for a in "xyz"])


_TURN = f"degrees(2.0{D}*acos(least(1.0{D}, abs(a.q1*b.q1 + a.q2*b.q2 + a.q3*b.q3 + a.q4*b.q4))))"


@query("k_center_order", f"""WITH RECURSIVE {V.COMPLEXES}, points AS (SELECT complex_id AS qi, q1,q2,q3,q4 FROM complexes),
 steps AS (SELECT 0 AS place, a.*, {_TURN} AS gap, a.qi=b.qi AS done, b.qi AS pick, 'nan'::DOUBLE AS pick_gap FROM points a, points b WHERE b.qi=0
  UNION ALL SELECT a.place+1, a.qi, a.q1,a.q2,a.q3,a.q4, least(a.gap, {_TURN}), a.done OR a.qi=b.qi, b.qi, b.gap
   FROM steps a, (SELECT * FROM steps WHERE NOT done ORDER BY gap DESC, qi LIMIT 1) b WHERE a.place<7)
 SELECT DISTINCT place::INTEGER AS place, pick AS qi, {r("pick_gap")} AS gap FROM steps""")
def k_center_order(spark, sf):
    points = V.complexes(spark, sf).select(F.col(C).alias("qi"), "q1", "q2", "q3", "q4")
    return ro.k_center_order(points, 8).withColumn("gap", rnd(F.col("gap")))


PROBE_CENTROID = """cen AS (SELECT complex_id, pose_id, avg(px) AS gx, avg(py) AS gy, avg(pz) AS gz FROM placed GROUP BY 1,2)"""


def _probe_sql(deg: float, shift: float) -> str:
    """Placed atoms after each of the twelve moves."""
    c, s = f"cos(radians({deg}{D}))", f"(CASE WHEN probe%2=0 THEN 1 ELSE -1 END)*sin(radians({deg}{D}))"
    u = {a: f"(p{a}-g{a})" for a in "xyz"}
    ax = "(probe%6//2)"
    # A turn by +deg about an axis in the usual sense.
    turn = {
        "x": f"CASE {ax} WHEN 0 THEN {u['x']} WHEN 1 THEN {c}*{u['x']}+{s}*{u['z']} ELSE {c}*{u['x']}-{s}*{u['y']} END",
        "y": f"CASE {ax} WHEN 0 THEN {c}*{u['y']}-{s}*{u['z']} WHEN 1 THEN {u['y']} ELSE {s}*{u['x']}+{c}*{u['y']} END",
        "z": f"CASE {ax} WHEN 0 THEN {s}*{u['y']}+{c}*{u['z']} WHEN 1 THEN -{s}*{u['x']}+{c}*{u['z']} ELSE {u['z']} END",
    }
    cols = []
    for i, a in enumerate("xyz"):
        move = f"(CASE WHEN {ax}={i} THEN (CASE WHEN probe%2=0 THEN 1 ELSE -1 END)*{shift}{D} ELSE 0 END)"
        cols.append(f"CASE WHEN probe<6 THEN ({turn[a]})+g{a} ELSE p{a}+{move} END AS {a}")
    return ", ".join(cols)


@query("axis_probes", f"""WITH {V.PLACED}, {PROBE_CENTROID}, m AS (SELECT p.complex_id, p.pose_id, probe, p.atom_idx, {_probe_sql(4.0, 0.75)} FROM placed p JOIN cen USING (complex_id, pose_id) CROSS JOIN (SELECT unnest(range(0,12)) AS probe))
 SELECT complex_id, pose_id, probe::INTEGER AS probe, {r('sum(x*(atom_idx+1))', 5)} AS sx, {r('sum(y*(atom_idx+1))', 5)} AS sy, {r('sum(z*(atom_idx+1))', 5)} AS sz FROM m GROUP BY ALL""")
def axis_probes(spark, sf):
    a = V.atoms(spark, sf)
    moved = ro.axis_probes(ro.placed_centroid(V.poses(spark, sf), a), 4.0, 0.75)
    at = ro.rotate_poses(a.filter(F.col("side") == "L"), moved, keep=["probe"])
    return at.groupBy(C, "pose_id", "probe").agg(*[rnd(F.sum(F.col(x) * (F.col("atom_idx") + 1)), 5).alias(f"s{x}") for x in "xyz"])


@query("random_probes", f"""WITH {V.POSES}, k AS (SELECT complex_id, pose_id, probe, {V.mix2_sql(V.mix2_sql('complex_id', 'pose_id', 2), 'probe', 2)} AS key FROM poses CROSS JOIN (SELECT unnest(range(0,3)) AS probe))
 SELECT complex_id, pose_id, probe::INTEGER AS probe, {r(f"{uniform_sql('key', 5)}*20.0{D}", 4)} AS angle, {", ".join(r(f"(2.0{D}*{uniform_sql(f'key*3+{i}', 6)}-1.0{D})*2.0{D}", 5) + f" AS d{a}" for i, a in enumerate("xyz"))} FROM k""")
def random_probes(spark, sf):
    a = V.atoms(spark, sf)
    start = ro.placed_centroid(V.poses(spark, sf), a)
    keep = start.select(C, "pose_id", *[F.col(f"q{i}").alias(f"o{i}") for i in range(1, 5)], *[F.col(f"g{x}").alias(f"h{x}") for x in "xyz"])
    moved = ro.random_probes(start, 3, 20.0, 2.0, 2).drop("gx", "gy", "gz")
    again = ro.placed_centroid(moved, a).join(keep, [C, "pose_id"])
    dotq = F.abs(ro.dot([F.col(f"q{i}") for i in range(1, 5)], [F.col(f"o{i}") for i in range(1, 5)]))
    return again.select(C, "pose_id", "probe", rnd(F.degrees(2.0 * F.acos(F.least(F.lit(1.0), dotq))), 4).alias("angle"),
                        *[rnd(F.col(f"g{x}") - F.col(f"h{x}"), 5).alias(f"d{x}") for x in "xyz"])


def touching_sql(n: int, draws: int, push: tuple[float, float], contact: tuple[float, float], seed: int) -> str:
    """``touch``: the first ``n`` of ``draws`` decoys of every complex that touch."""
    turn = random_quat_sql("key", seed + 1)
    return f"""dr AS (SELECT complex_id, pose_id, {V.mix2_sql('complex_id', 'pose_id', seed)} AS key FROM (SELECT DISTINCT complex_id FROM atoms) CROSS JOIN (SELECT unnest(range(0,{draws})) AS pose_id)),
 du AS (SELECT *, {", ".join(f"{e} AS q{i + 1}" for i, e in enumerate(turn))}, 2.0{D}*{uniform_sql('key*2', seed + 2)}-1.0{D} AS uz, {2 * PI!r}{D}*{uniform_sql('key*2+1', seed + 2)} AS uphi, {push[0]}{D}+{push[1] - push[0]}{D}*{uniform_sql('key', seed + 3)} AS gap FROM dr),
 dd AS MATERIALIZED (SELECT * EXCLUDE (uphi), sqrt(greatest(0.0{D},1.0{D}-uz*uz))*cos(uphi) AS ux, sqrt(greatest(0.0{D},1.0{D}-uz*uz))*sin(uphi) AS uy FROM du),
 dl AS MATERIALIZED (SELECT d.complex_id, d.pose_id, ux, uy, uz, gap, {V.rotated_sql('d', 'a', False)} FROM dd d JOIN atoms a ON a.complex_id=d.complex_id AND a.side='L'),
 dm AS (SELECT complex_id, pose_id, max(-(px*ux+py*uy+pz*uz)) AS l FROM dl GROUP BY 1,2),
 dn AS (SELECT d.complex_id, d.pose_id, max(x*ux+y*uy+z*uz) AS rr FROM dd d JOIN atoms a ON a.complex_id=d.complex_id AND a.side='R' GROUP BY 1,2),
 dc AS (SELECT l.complex_id, l.pose_id, min(sqrt((px+(l+rr+gap)*ux-a.x)*(px+(l+rr+gap)*ux-a.x)+(py+(l+rr+gap)*uy-a.y)*(py+(l+rr+gap)*uy-a.y)+(pz+(l+rr+gap)*uz-a.z)*(pz+(l+rr+gap)*uz-a.z))) AS closest
   FROM dl l JOIN dm USING (complex_id, pose_id) JOIN dn USING (complex_id, pose_id) JOIN atoms a ON a.complex_id=l.complex_id AND a.side='R' GROUP BY 1,2),
 touch AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY pose_id) AS place FROM dc WHERE closest BETWEEN {contact[0]}{D} AND {contact[1]}{D} QUALIFY place<={n})"""


N_TOUCH = 2


@query("surface_touching_decoys", f"WITH {V.ATOMS}, {touching_sql(N_TOUCH, 4 * N_TOUCH * 8, (-1.0, 3.0), (3.0, 6.0), 9)} SELECT complex_id, place::INTEGER AS place, {r('closest')} AS closest FROM touch")
def surface_touching_decoys(spark, sf):
    d = ro.surface_touching_decoys(V.atoms(spark, sf), N_TOUCH, seed=9)
    return d.select(C, "place", rnd(F.col("closest")).alias("closest"))


@query("touching_shortfall", f"""WITH {V.ATOMS}, {touching_sql(N_TOUCH, 4 * N_TOUCH * 2, (-1.0, 3.0), (3.0, 6.0), 9)}, f AS (SELECT complex_id, count(*) AS n FROM touch GROUP BY 1)
 SELECT complex_id, coalesce(n, 0) AS found, {N_TOUCH}-coalesce(n, 0) AS missing FROM (SELECT DISTINCT complex_id FROM atoms) LEFT JOIN f USING (complex_id)""")
def touching_shortfall(spark, sf):
    """What two rounds of draws leave missing."""
    a = V.atoms(spark, sf)
    return ro.touching_shortfall(a, ro.surface_touching_decoys(a, N_TOUCH, rounds=2, seed=9), N_TOUCH)


LATTICE = NEAR + f""",
lattice AS (SELECT n.complex_id, n.qi, round_even(tx/{HC}{D},0)::BIGINT+dx AS cx, round_even(ty/{HC}{D},0)::BIGINT+dy AS cy, round_even(tz/{HC}{D},0)::BIGINT+dz AS cz, n.q1, n.q2, n.q3, n.q4
  FROM (SELECT * FROM near WHERE place<=2) n JOIN complexes c USING (complex_id) CROSS JOIN (SELECT unnest(range(-1,2)) AS dx) CROSS JOIN (SELECT unnest(range(-1,2)) AS dy) CROSS JOIN (SELECT unnest(range(-1,2)) AS dz))"""


def _lattice(spark, sf):
    return ro.near_native_lattice(V.complexes(spark, sf), ro.hopf_rotations(spark, NSIDE), ro.hopf_size(NSIDE), HC, k=2)


@query("near_native_lattice", f"WITH {LATTICE} SELECT complex_id, qi::INTEGER AS qi, cx, cy, cz FROM lattice")
def near_native_lattice(spark, sf):
    return _lattice(spark, sf).select(C, "qi", "cx", "cy", "cz")


# --- pose scores from atoms ------------------------------------------------------------------

LIG = f"lig AS MATERIALIZED (SELECT complex_id, pose_id, atom_idx, radius, sasa, type_id, charge_id, -{CHARGE_LUT}[charge_id] AS charge, px AS x, py AS y, pz AS z FROM placed)"
SCENE = V.PLACED + "," + grid_sql(H) + "," + REC + "," + LIG
POINTS = nearest_sql("lig", "spot", "pose_id, type_id, charge") + ", points AS (SELECT complex_id, pose_id, ix, iy, iz, count(*)::DOUBLE AS w, sum(charge) AS q FROM spot GROUP BY ALL)"
LIG_LAYERS = within_sql("lig", "radius", "lig_cover", "pose_id, sasa") + f", lig_layers AS (SELECT complex_id, pose_id, ix, iy, iz, bool_or(sasa>1.0{D}) AS surface FROM lig_cover GROUP BY ALL)"
SHAPE = f"""gain AS (SELECT p.complex_id, p.pose_id, sum(p.w*o.w) AS c_pair FROM points p JOIN open_ o USING (complex_id, ix, iy, iz) GROUP BY 1,2),
 clash AS (SELECT l.complex_id, l.pose_id, count(*) FILTER (l.surface AND s.surface)::DOUBLE AS n_ss, count(*) FILTER (l.surface<>s.surface)::DOUBLE AS n_sc, count(*) FILTER (NOT l.surface AND NOT s.surface)::DOUBLE AS n_cc
   FROM lig_layers l JOIN layers s USING (complex_id, ix, iy, iz) GROUP BY 1,2),
 shape AS (SELECT complex_id, pose_id, coalesce(c_pair,0) AS c_pair, coalesce(n_ss,0) AS n_ss, coalesce(n_sc,0) AS n_sc, coalesce(n_cc,0) AS n_cc FROM poses LEFT JOIN gain USING (complex_id, pose_id) LEFT JOIN clash USING (complex_id, pose_id))"""
PAIR_N = """pairn AS (SELECT l.complex_id, l.pose_id, l.type_id AS i, t.grp AS j, sum(t.w) AS n FROM (SELECT DISTINCT complex_id, pose_id, type_id, ix, iy, iz FROM spot) l JOIN types t USING (complex_id, ix, iy, iz) GROUP BY ALL)"""
POTENTIAL = within_sql("rec", f"8.0{D}", "vnear", "charge") + f""", v AS (SELECT complex_id, ix, iy, iz, w FROM (SELECT complex_id, ix, iy, iz, sum(charge/greatest(d,1e-6{D})) AS w FROM vnear GROUP BY ALL) ANTI JOIN layers USING (complex_id, ix, iy, iz)),
 elec AS (SELECT p.complex_id, p.pose_id, sum(p.q*v.w) AS elec FROM points p JOIN v USING (complex_id, ix, iy, iz) GROUP BY 1,2)"""


def scene(spark, sf, h=H):
    a = ft.with_partial_charge(V.atoms(spark, sf))
    g = ft.grid_axes(a, h)
    rec = a.filter(F.col("side") == "R")
    lig = ro.rotate_poses(a.filter(F.col("side") == "L"), V.poses(spark, sf))
    return g, rec, lig, sp.nearest_cells(lig, g)


@query("shape_terms", f"WITH {SCENE}, {LAYERS}, {OPEN}, {POINTS}, {LIG_LAYERS}, {SHAPE} SELECT complex_id, pose_id, c_pair, n_ss, n_sc, n_cc FROM shape WHERE c_pair+n_ss+n_sc+n_cc>0")
def shape_terms(spark, sf):
    g, rec, lig, at = scene(spark, sf)
    layers = sp.surface_core_layers(rec, g)
    points = at.groupBy(C, "pose_id", "ix", "iy", "iz").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return sc.shape_terms(points, sp.surface_core_layers(lig, g, keys=["pose_id"]), sp.open_space_count(rec, g, layers), layers)


@query("pair_counts", f"WITH {SCENE}, {TYPES}, {POINTS}, {PAIR_N} SELECT complex_id, pose_id, i, j, n FROM pairn")
def pair_counts(spark, sf):
    g, rec, lig, at = scene(spark, sf)
    points = at.groupBy(C, "pose_id", "ix", "iy", "iz", F.col("type_id").alias("grp")).agg(F.count(F.lit(1)).alias("w"))
    return sc.pair_counts(points, sp.type_layers(rec, g))


@query("pair_counts_trilinear", f"""WITH {SCENE}, {TYPES}, {trilinear_sql('lig', 'corner', 'pose_id, type_id')}, l AS (SELECT complex_id, pose_id, type_id AS i, ix, iy, iz, least(1.0{D}, sum(w)) AS lw FROM corner GROUP BY ALL)
 SELECT l.complex_id, l.pose_id, l.i, t.grp AS j, {r('sum(lw*t.w)')} AS n FROM l JOIN types t USING (complex_id, ix, iy, iz) GROUP BY ALL""")
def pair_counts_trilinear(spark, sf):
    g, rec, lig, at = scene(spark, sf)
    corner = sp.scatter_trilinear(lig, g, keys=["pose_id"], group="type_id")
    return sc.pair_counts_weighted(corner, sp.type_layers(rec, g)).withColumn("n", rnd(F.col("n")))


@query("elec_term", f"WITH {SCENE}, {LAYERS}, {POINTS}, {POTENTIAL} SELECT complex_id, pose_id, {r('elec')} AS elec FROM elec")
def elec_term(spark, sf):
    g, rec, lig, at = scene(spark, sf)
    charged = at.groupBy(C, "pose_id", "ix", "iy", "iz").agg(F.sum("charge").alias("w"))
    return sc.elec_term(charged, sp.scatter_inverse_distance(rec, g), sp.surface_core_layers(rec, g)).withColumn("elec", rnd(F.col("elec")))


@query("legacy_elec_term", f"""WITH {SCENE}, {REC11}, {nearest_sql('rec11', 'atr', 'type_id')}, {within_sql('rec11', f'8.0{D}', 'neard', 'type_id')}, {LEGACY}, {POINTS},
 lp AS (SELECT complex_id, pose_id, type_id AS grp, ix, iy, iz, count(*)::DOUBLE AS w FROM spot WHERE type_id BETWEEN 1 AND 11 GROUP BY ALL)
 SELECT lp.complex_id, lp.pose_id, {r(f'sum(lp.w*ratio.w*{CHARGE_LUT}[grp]*{CHARGE_LUT}[grp])')} AS elec FROM lp JOIN ratio USING (complex_id, grp, ix, iy, iz) GROUP BY 1,2""")
def legacy_elec_term(spark, sf):
    g, rec, lig, at = scene(spark, sf)
    points = at.filter(F.col("type_id").between(1, 11)).groupBy(C, "pose_id", "ix", "iy", "iz", F.col("type_id").alias("grp")).agg(F.count(F.lit(1)).alias("w"))
    return sc.legacy_elec_term(points, sp.count_over_distance(rec, g)).withColumn("elec", rnd(F.col("elec")))


ATOM_WEIGHTS = sc.Weights(alpha=0.5, clash=(0.75, 1.5, 3.0), table=sc.flat_table(SKEWED), beta=2.0)
FEATURES = f"""{LAYERS}, {OPEN}, {TYPES}, {POINTS}, {LIG_LAYERS}, {SHAPE}, {PAIR_N}, {POTENTIAL},
 pairs_ AS (SELECT complex_id, pose_id, sum(n*{SKEWED_SQL}[(i-1)*12+j]) AS pe FROM pairn GROUP BY 1,2),
 scores AS (SELECT complex_id, pose_id, c_pair, n_ss, n_sc, n_cc, coalesce(pe,0) AS pe, coalesce(elec,0) AS elec, 0.5{D}*c_pair - (0.75{D}*n_ss+1.5{D}*n_sc+3.0{D}*n_cc) - coalesce(pe,0) + 2.0{D}*coalesce(elec,0) AS score
   FROM shape LEFT JOIN pairs_ USING (complex_id, pose_id) LEFT JOIN elec USING (complex_id, pose_id))"""


@query("score_poses", f"WITH {SCENE}, {FEATURES} SELECT complex_id, pose_id, c_pair, n_ss, n_sc, n_cc, {r('elec')} AS elec, {r('score')} AS score FROM scores")
def score_poses(spark, sf):
    s = se.score_poses(V.atoms(spark, sf), V.poses(spark, sf), ATOM_WEIGHTS, H)
    return s.select(C, "pose_id", "c_pair", "n_ss", "n_sc", "n_cc", rnd(F.col("elec")).alias("elec"), rnd(F.col("score")).alias("score"))


# --- labels ---------------------------------------------------------------------------------

NAT_D = "sqrt((a.nx-b.nx)*(a.nx-b.nx)+(a.ny-b.ny)*(a.ny-b.ny)+(a.nz-b.nz)*(a.nz-b.nz))"
CONTACTS = f"contacts AS MATERIALIZED (SELECT a.complex_id, a.atom_idx AS rec_idx, b.atom_idx AS lig_idx, a.nx AS rx, a.ny AS ry, a.nz AS rz, {NAT_D} AS d FROM native a JOIN native b ON a.complex_id=b.complex_id AND a.side='R' AND b.side='L' WHERE {NAT_D} < 8.0{D})"


@query("native_contacts", f"WITH {V.NATIVE}, {CONTACTS} SELECT complex_id, count(*) AS contacts, count(DISTINCT rec_idx) AS rec_atoms, count(DISTINCT lig_idx) AS lig_atoms, {r('avg(d)')} AS mean_d FROM contacts WHERE d<5.0{D} GROUP BY 1")
def native_contacts(spark, sf):
    n = ql.native_contacts(V.native_atoms(spark, sf))
    return n.groupBy(C).agg(F.count(F.lit(1)).alias("contacts"), F.count_distinct("rec_idx").alias("rec_atoms"), F.count_distinct("lig_idx").alias("lig_atoms"), rnd(F.avg("d")).alias("mean_d"))


@query("interface_atoms", f"WITH {V.NATIVE}, {CONTACTS} SELECT DISTINCT complex_id, 'R' AS side, rec_idx AS atom_idx FROM contacts UNION ALL SELECT DISTINCT complex_id, 'L', lig_idx FROM contacts")
def interface_atoms(spark, sf):
    return ql.interface_atoms(V.native_atoms(spark, sf))


DOCKQ = f"""lab AS MATERIALIZED (SELECT complex_id, pose_id, (px-nx)*(px-nx)+(py-ny)*(py-ny)+(pz-nz)*(pz-nz) AS d2, atom_idx FROM placed),
 inner_ AS (SELECT DISTINCT complex_id, lig_idx AS atom_idx FROM contacts),
 lr AS (SELECT complex_id, pose_id, sqrt(avg(d2)) AS l_rmsd FROM lab GROUP BY 1,2), ir AS (SELECT complex_id, pose_id, sqrt(avg(d2)) AS i_rmsd FROM lab JOIN inner_ USING (complex_id, atom_idx) GROUP BY 1,2),
 nn AS (SELECT complex_id, count(*) AS n_native FROM contacts WHERE d<5.0{D} GROUP BY 1),
 fn AS (SELECT p.complex_id, p.pose_id, count(*) AS kept FROM placed p JOIN contacts c ON c.complex_id=p.complex_id AND c.lig_idx=p.atom_idx AND c.d<5.0{D}
   WHERE (px-rx)*(px-rx)+(py-ry)*(py-ry)+(pz-rz)*(pz-rz) < 25.0{D} GROUP BY 1,2),
 dq AS MATERIALIZED (SELECT *, CASE WHEN n_native>0 THEN (fnat + 1.0{D}/(1.0{D}+(i_rmsd/1.5{D})*(i_rmsd/1.5{D})) + 1.0{D}/(1.0{D}+(l_rmsd/8.5{D})*(l_rmsd/8.5{D})))/3.0{D}
    ELSE (1.0{D}/(1.0{D}+(i_rmsd/1.5{D})*(i_rmsd/1.5{D})) + 1.0{D}/(1.0{D}+(l_rmsd/8.5{D})*(l_rmsd/8.5{D})))/2.0{D} END AS dockq FROM (
  SELECT complex_id, pose_id, coalesce(n_native,0) AS n_native, CASE WHEN coalesce(n_native,0)>0 THEN coalesce(kept,0)/n_native::DOUBLE ELSE 0.0{D} END AS fnat, coalesce(i_rmsd,l_rmsd) AS i_rmsd, l_rmsd
  FROM lr LEFT JOIN ir USING (complex_id, pose_id) LEFT JOIN nn USING (complex_id) LEFT JOIN fn USING (complex_id, pose_id)))"""


@query("ligand_rmsd", f"WITH {V.PLACED}, {CONTACTS}, {DOCKQ} SELECT complex_id, pose_id, {r('l_rmsd')} AS l_rmsd, {r('ir.i_rmsd')} AS masked FROM lr LEFT JOIN ir USING (complex_id, pose_id)")
def ligand_rmsd(spark, sf):
    a = V.native_atoms(spark, sf)
    p = V.poses(spark, sf)
    whole = ql.ligand_rmsd(p, a).select(C, "pose_id", rnd(F.col("l_rmsd")).alias("l_rmsd"))
    part = ql.ligand_rmsd(p, a, ql.interface_atoms(a), "masked").select(C, "pose_id", rnd(F.col("masked")).alias("masked"))
    return whole.join(part, [C, "pose_id"], "left")


@query("dockq", f"""WITH {V.PLACED}, {CONTACTS}, {DOCKQ} SELECT complex_id, pose_id, {r('fnat')} AS fnat, {r('i_rmsd')} AS i_rmsd, {r('l_rmsd')} AS l_rmsd, {r('dockq')} AS dockq, n_native,
  (CASE WHEN dockq>=0.80{D} THEN 3 WHEN dockq>=0.49{D} THEN 2 WHEN dockq>=0.23{D} THEN 1 ELSE 0 END)::INTEGER AS tier FROM dq""")
def dockq(spark, sf):
    d = ql.dockq(V.poses(spark, sf), V.native_atoms(spark, sf))
    return d.select(C, "pose_id", *[rnd(F.col(c)).alias(c) for c in ("fnat", "i_rmsd", "l_rmsd", "dockq")], "n_native", ql.quality_tier(F.col("dockq")).alias("tier"))


@query("label_poses", f"WITH {V.PLACED}, {CONTACTS}, {DOCKQ} SELECT complex_id, pose_id, {r('l_rmsd')} AS rmsd, {r('dockq')} AS dockq FROM dq")
def label_poses(spark, sf):
    d = ql.label_poses(V.poses(spark, sf), V.native_atoms(spark, sf))
    return d.select(C, "pose_id", rnd(F.col("rmsd")).alias("rmsd"), rnd(F.col("dockq")).alias("dockq"))


@query("split_targets", f"""WITH {V.SCORED} SELECT complex_id, pose_id, rmsd<=2.5{D} AS hit, {r(f"CASE WHEN rmsd<=2.5{D} THEN max(score_a) OVER w ELSE min(score_a) OVER w END")} AS target FROM scored WINDOW w AS (PARTITION BY complex_id)""")
def split_targets(spark, sf):
    p = ql.split_targets(ql.hit_mask(V.scored(spark, sf)), "score_a")
    return p.select(C, "pose_id", "hit", rnd(F.col("target")).alias("target"))


@query("geometry_audit", f"""WITH {V.NATIVE}, {CONTACTS}, t AS (SELECT complex_id, min(d) AS closest, count(*) FILTER (d<2.0{D}) AS below_2, count(DISTINCT rec_idx) AS touched FROM contacts WHERE d<4.5{D} GROUP BY 1),
 f AS (SELECT complex_id, sqrt(avg(x)*avg(x)+avg(y)*avg(y)+avg(z)*avg(z)) AS centroid_offset FROM native WHERE side='L' GROUP BY 1),
 o AS (SELECT complex_id, closest, coalesce(below_2,0) AS below_2, coalesce(touched,0)/{V.REC_ATOMS}.0{D} AS engulfed, centroid_offset FROM f LEFT JOIN t USING (complex_id))
 SELECT complex_id, {r('closest')} AS closest, below_2, {r('engulfed')} AS engulfed, 0.0{D} AS native_error, {r('centroid_offset')} AS centroid_offset,
  (coalesce(closest,9.0{D})<2.0{D} OR engulfed>0.9{D} OR centroid_offset>10.0{D}) AS violation FROM o""")
def geometry_audit(spark, sf):
    g = cu.geometry_audit(V.native_atoms(spark, sf), V.complexes(spark, sf))
    return g.select(C, rnd(F.col("closest")).alias("closest"), "below_2", *[rnd(F.col(c)).alias(c) for c in ("engulfed", "native_error", "centroid_offset")], "violation")


@query("frame_collapse_filter", f"WITH {V.NATIVE}, {CONTACTS} SELECT complex_id, {r(f'coalesce(b,0)/{V.LIG_ATOMS}.0{D}')} AS share, coalesce(b,0)/{V.LIG_ATOMS}.0{D} <= 0.05{D} AS keep FROM complexes LEFT JOIN (SELECT complex_id, count(DISTINCT lig_idx) AS b FROM contacts WHERE d<2.0{D} GROUP BY 1) USING (complex_id)")
def frame_collapse_filter(spark, sf):
    f = cu.frame_collapse_filter(V.native_atoms(spark, sf))
    return f.withColumn("share", rnd(F.col("share")))
