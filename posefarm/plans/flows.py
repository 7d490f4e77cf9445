"""Queries on search, refinement, text sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from posefarm.functions.ordering import with_one
from posefarm.operators import cells as cl
from posefarm.operators import diagnostics as dg
from posefarm.operators import features as ft
from posefarm.operators import quality as ql
from posefarm.operators import search as se
from posefarm.plans import corpus as co
from posefarm.plans import geometry as g
from posefarm.plans import views as V
from posefarm.plans.evaluation import REPORT_SQL, TH, r
from posefarm.plans.registry import query
from posefarm.plans.views import rnd
from posefarm.session import cut, shared_folder
from posefarm.sources import export, structures
from posefarm.sources import pools as src
from posefarm.streaming import incremental as inc

C = "complex_id"
D = "::DOUBLE"
H = V.COARSE
NTOP = 6
Q = ["q1", "q2", "q3", "q4"]
T = ["tx", "ty", "tz"]


# --- search ------------------------------------------------------------------------------

TURNED = f"""lig AS MATERIALIZED (SELECT a.complex_id, rot.qi, rot.qi AS pose_id, atom_idx, radius, sasa, type_id, charge_id, -{g.CHARGE_LUT}[charge_id] AS charge, px AS x, py AS y, pz AS z FROM (
   SELECT a.*, rot.qi AS qi, {V.rotated_sql('rot', 'a', False)} FROM atoms a CROSS JOIN rotations rot WHERE side='L') a JOIN rotations rot ON rot.qi=a.qi)"""
def scan_sql(h: float = H, turned: str = TURNED) -> str:
    return V.ATOMS + "," + V.POSES + "," + g.grid_sql(h) + "," + g.REC + "," + turned + f""", {g.LAYERS}, {g.OPEN}, {g.TYPES}{g.MIXED}, {g.POINTS}, {g.LIG_LAYERS}, {g.POTENTIAL.split(', elec AS', 1)[0].rstrip().rstrip(',')},
 rl AS (SELECT complex_id, 'open' AS layer, ix, iy, iz, w FROM open_ UNION ALL SELECT complex_id, CASE WHEN surface THEN 'surface' ELSE 'core' END, ix, iy, iz, 1.0{D} FROM layers
   UNION ALL SELECT complex_id, 'pair'||grp, ix, iy, iz, -w FROM mixed UNION ALL SELECT complex_id, 'charge', ix, iy, iz, w FROM v),
 ll AS (SELECT complex_id, pose_id AS qi, 'open' AS layer, ix, iy, iz, 0.5{D}*w AS w FROM points UNION ALL SELECT complex_id, pose_id, 'charge', ix, iy, iz, 2.0{D}*q FROM points
   UNION ALL SELECT complex_id, pose_id, 'surface', ix, iy, iz, CASE WHEN surface THEN -0.75{D} ELSE -1.5{D} END FROM lig_layers UNION ALL SELECT complex_id, pose_id, 'core', ix, iy, iz, CASE WHEN surface THEN -1.5{D} ELSE -3.0{D} END FROM lig_layers
   UNION ALL SELECT DISTINCT complex_id, pose_id, 'pair'||type_id, ix, iy, iz, 1.0{D} FROM spot),
 scan AS MATERIALIZED (SELECT ll.complex_id, ll.qi, rl.ix-ll.ix AS cx, rl.iy-ll.iy AS cy, rl.iz-ll.iz AS cz, round(sum(rl.w*ll.w), 6) AS score FROM rl JOIN ll ON rl.complex_id=ll.complex_id AND rl.layer=ll.layer GROUP BY ALL),
 found AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY score DESC, qi, cx, cy, cz) AS rank FROM (SELECT * FROM scan QUALIFY row_number() OVER (PARTITION BY complex_id, qi ORDER BY score DESC, cx, cy, cz)=1) QUALIFY rank<={NTOP})"""


SCAN = scan_sql()


def _scan(spark, sf):
    a = V.atoms(spark, sf)
    grid = ft.grid_axes(a, H)
    turned = se.turned_ligands(a, V.rotations(spark), V.ROTATIONS)
    s = se.translation_scan(se.receptor_layers(a, grid, g.ATOM_WEIGHTS), se.ligand_layers(turned, grid, g.ATOM_WEIGHTS), cl.channel_names(g.ATOM_WEIGHTS))
    return s.withColumn("score", F.round("score", 6))


@query("translation_scan", f"WITH {SCAN} SELECT complex_id, qi, count(*) AS cells, {r('sum(score)')} AS total, {r('sum(score*(cx+3*cy+7*cz))')} AS moment, {r('max(score)')} AS best FROM scan GROUP BY 1,2")
def translation_scan(spark, sf):
    s = F.col("score")
    return _scan(spark, sf).groupBy(C, "qi").agg(F.count(F.lit(1)).alias("cells"), rnd(F.sum(s)).alias("total"),
                                                 rnd(F.sum(s * (F.col("cx") + 3 * F.col("cy") + 7 * F.col("cz")))).alias("moment"), rnd(F.max(s)).alias("best"))


@query("top_translations", f"WITH {SCAN} SELECT complex_id, qi, cx, cy, cz, {r('score')} AS score, rank::INTEGER AS rank FROM found")
def top_translations(spark, sf):
    t = se.top_translations(_scan(spark, sf), 1, NTOP)
    return t.withColumn("score", rnd(F.col("score")))


def found(spark, sf):
    return se.search_poses(V.atoms(spark, sf), V.rotations(spark), V.ROTATIONS, g.ATOM_WEIGHTS, H, ntop=NTOP, round_to=6)


@query("search_poses", f"WITH {SCAN} SELECT complex_id, rank AS pose_id, qi, {r('score')} AS score, {', '.join(r(f'{c}*{H}{D}') + f' AS {t}' for c, t in zip(('cx', 'cy', 'cz'), T))} FROM found")
def search_poses(spark, sf):
    s = found(spark, sf)
    return s.select(C, "pose_id", "qi", rnd(F.col("score")).alias("score"), *[rnd(F.col(t)).alias(t) for t in T])


ROT_NEAR = f"""rnear AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY angle, qi) AS place FROM (SELECT c.complex_id, c.tx, c.ty, c.tz, s.qi, s.q1, s.q2, s.q3, s.q4, {g.angle_sql('c', 's')} AS angle FROM complexes c CROSS JOIN rotations s)),
 rlattice AS (SELECT n.complex_id, n.qi, round_even(tx/{H}{D},0)::BIGINT+dx AS cx, round_even(ty/{H}{D},0)::BIGINT+dy AS cy, round_even(tz/{H}{D},0)::BIGINT+dz AS cz, q1, q2, q3, q4
  FROM rnear n CROSS JOIN (SELECT unnest(range(-1,2)) AS dx) CROSS JOIN (SELECT unnest(range(-1,2)) AS dy) CROSS JOIN (SELECT unnest(range(-1,2)) AS dz) WHERE place<=1)"""


@query("build_pool", f"""WITH {SCAN}, {ROT_NEAR}, b AS (SELECT complex_id, qi, cx, cy, cz, 0::INTEGER AS prov FROM found UNION ALL SELECT complex_id, qi, cx, cy, cz, 1 FROM rlattice ANTI JOIN found USING (complex_id, qi, cx, cy, cz))
 SELECT complex_id, qi, cx, cy, cz, prov FROM b""")
def build_pool(spark, sf):
    p = se.build_pool(V.native_atoms(spark, sf), V.complexes(spark, sf), V.rotations(spark), V.ROTATIONS, g.ATOM_WEIGHTS, H, ntop=NTOP, k=1)
    return p.select(C, "qi", "cx", "cy", "cz", "prov")


def quat_mul_sql(a: list[str], b: list[str]) -> list[str]:
    vector = [f"{a[3]}*{b[i]}+{b[3]}*{a[i]}+{a[(i + 1) % 3]}*{b[(i + 2) % 3]}-{a[(i + 2) % 3]}*{b[(i + 1) % 3]}" for i in range(3)]
    return vector + [f"{a[3]}*{b[3]}-{a[0]}*{b[0]}-{a[1]}*{b[1]}-{a[2]}*{b[2]}"]


def axis_sql(key: str, seed: int) -> str:
    """Columns uz, uphi of a drawn direction."""
    return f"2.0{D}*{g.uniform_sql(f'{key}*2', seed)}-1.0{D} AS uz, {2 * g.PI!r}{D}*{g.uniform_sql(f'{key}*2+1', seed)} AS uphi"


def cone_sql(n: int, deg: float, seed: int = 0) -> str:
    """``cone``: rotations around every complex's own, with its translation."""
    d, q = [f"d{i}" for i in range(1, 5)], list(Q)
    return f"""cone_k AS (SELECT c.*, cone, {V.mix2_sql('c.complex_id', 'cone', seed)} AS key FROM complexes c CROSS JOIN (SELECT unnest(range(0,{n})) AS cone)),
 cone_h AS (SELECT *, CASE WHEN cone=0 THEN 0.0{D} ELSE {g.uniform_sql('key', seed + 2)}*radians({deg}{D}) END/2 AS half, {axis_sql('key', seed + 1)} FROM cone_k),
 cone_d AS (SELECT *, rr*cos(uphi)*sin(half) AS d1, rr*sin(uphi)*sin(half) AS d2, uz*sin(half) AS d3, cos(half) AS d4 FROM (SELECT *, sqrt(greatest(0.0{D}, 1.0{D}-uz*uz)) AS rr FROM cone_h)),
 cone_p AS (SELECT complex_id, cone, tx, ty, tz, {", ".join(f"{e} AS p{i + 1}" for i, e in enumerate(quat_mul_sql(d, q)))} FROM cone_d),
 cone AS MATERIALIZED (SELECT complex_id, cone, tx, ty, tz, {", ".join(f"p{i}/sqrt(p1*p1+p2*p2+p3*p3+p4*p4) AS q{i}" for i in range(1, 5))} FROM cone_p)"""


N_RANDOM, N_CONE = 4, 2
SETS = f"""{cone_sql(N_CONE, 15.0)}, sets AS MATERIALIZED (SELECT c.complex_id, qi, {", ".join(f"{e} AS q{i + 1}" for i, e in enumerate(g.random_quat_sql('qi', 0)))} FROM complexes c CROSS JOIN (SELECT unnest(range(0,{N_RANDOM})) AS qi)
   UNION ALL SELECT complex_id, cone+{N_RANDOM}, {", ".join(Q)} FROM cone),
 lig AS MATERIALIZED (SELECT complex_id, qi, qi AS pose_id, atom_idx, radius, sasa, type_id, charge_id, -{g.CHARGE_LUT}[charge_id] AS charge, px AS x, py AS y, pz AS z FROM (
   SELECT a.*, s.qi AS qi, {V.rotated_sql('s', 'a', False)} FROM atoms a JOIN sets s USING (complex_id) WHERE side='L'))"""


@query("decoys_with_cone", f"""WITH {scan_sql(turned=SETS)}
 SELECT f.complex_id, f.qi::INTEGER AS qi, {r('score')} AS score, {', '.join(r(f'{c}*{H}{D}') + f' AS {t}' for c, t in zip(('cx', 'cy', 'cz'), T))} FROM found f
 UNION ALL SELECT complex_id, (cone+{N_RANDOM + N_CONE})::INTEGER, NULL, {", ".join(r(t) for t in T)} FROM cone""")
def decoys_with_cone(spark, sf):
    d = se.decoys_with_cone(V.atoms(spark, sf), V.complexes(spark, sf), N_RANDOM, N_CONE, g.ATOM_WEIGHTS, H, round_to=6)
    return d.select(C, "qi", rnd(F.col("score")).alias("score"), *[rnd(F.col(t)).alias(t) for t in T])


@query("pattern_refine")
def pattern_refine(spark, sf):
    out = se.pattern_refine(V.atoms(spark, sf), V.poses(spark, sf), g.ATOM_WEIGHTS, h=H)
    return out.select(C, "pose_id", rnd(F.col("start_score")).alias("start_score"), rnd(F.col("score")).alias("score"), "deg")


STEP = f"""{V.ATOMS}, {g.grid_sql(H)}, {g.REC},
moved AS MATERIALIZED (WITH {V.PLACED}, {g.PROBE_CENTROID}, m AS (SELECT p.complex_id, p.pose_id*16+probe AS pose_id, p.atom_idx, {g._probe_sql(4.0, 1.0)} FROM placed p JOIN cen USING (complex_id, pose_id) CROSS JOIN (SELECT unnest(range(0,12)) AS probe))
   SELECT * FROM m UNION ALL SELECT complex_id, pose_id*16+12, atom_idx, px, py, pz FROM placed),
lig AS MATERIALIZED (SELECT m.complex_id, m.pose_id, m.atom_idx, a.radius, a.sasa, a.type_id, a.charge_id, -{g.CHARGE_LUT}[a.charge_id] AS charge, m.x, m.y, m.z FROM moved m JOIN atoms a ON a.complex_id=m.complex_id AND a.atom_idx=m.atom_idx AND a.side='L'),
poses AS (SELECT DISTINCT complex_id, pose_id FROM moved), {g.FEATURES},
step AS (SELECT complex_id, pose_id//16 AS pose_id, max(score) FILTER (pose_id%16=12) AS start_score, max(score) FILTER (pose_id%16<12) AS best FROM scores GROUP BY 1,2)"""


@query("refinement_step", f"WITH {STEP} SELECT complex_id, pose_id, {r('start_score')} AS start_score, {r(f'CASE WHEN best>start_score+1e-9{D} THEN best ELSE start_score END')} AS score, CASE WHEN best>start_score+1e-9{D} THEN 4.0{D} ELSE 2.0{D} END AS deg FROM step")
def refinement_step(spark, sf):
    out = se.pattern_refine(V.atoms(spark, sf), V.poses(spark, sf), g.ATOM_WEIGHTS, rounds=1, h=H, levels=1)
    return out.select(C, "pose_id", rnd(F.col("start_score")).alias("start_score"), rnd(F.col("score")).alias("score"), "deg")


# A set of endpoints: the eight poses, pulled towards the native translation.
TOL = 4.0
ENDS = V.ATOMS + "," + V.POSES + f""",
ends AS (SELECT complex_id, pose_id, (pose_id*7%8)::DOUBLE AS score, q1*0.3{D}/n AS q1, q2*0.3{D}/n AS q2, q3*0.3{D}/n AS q3, q4/n AS q4, tx, ty, tz FROM (SELECT *, sqrt(0.09{D}*(q1*q1+q2*q2+q3*q3)+q4*q4) AS n FROM poses)),
at_ AS MATERIALIZED (SELECT p.complex_id, p.pose_id, a.atom_idx, {V.rotated_sql('p', 'a')} FROM ends p JOIN atoms a ON a.complex_id=p.complex_id AND a.side='L'),
edge AS MATERIALIZED (SELECT a.complex_id, a.pose_id AS i, b.pose_id AS j, sqrt(avg((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)+(a.pz-b.pz)*(a.pz-b.pz))) AS rmsd FROM at_ a JOIN at_ b ON a.complex_id=b.complex_id AND a.atom_idx=b.atom_idx AND a.pose_id<b.pose_id GROUP BY 1,2,3 HAVING rmsd<{TOL}{D})"""


def endpoints(spark, sf):
    p = V.poses(spark, sf)
    n = F.sqrt(0.09 * (F.col("q1") * F.col("q1") + F.col("q2") * F.col("q2") + F.col("q3") * F.col("q3")) + F.col("q4") * F.col("q4"))
    p = p.withColumn("_n", n)
    return p.select(C, "pose_id", (F.col("pose_id") * 7 % 8).cast("double").alias("score"), *[(F.col(f"q{i}") * 0.3 / F.col("_n")).alias(f"q{i}") for i in (1, 2, 3)],
                    (F.col("q4") / F.col("_n")).alias("q4"), *T)


@query("pose_pairs_within", f"WITH {ENDS} SELECT complex_id, i, j, {r('rmsd')} AS rmsd FROM edge")
def pose_pairs_within(spark, sf):
    e = se.pose_pairs_within(endpoints(spark, sf), V.atoms(spark, sf), TOL)
    return e.withColumn("rmsd", rnd(F.col("rmsd")))


@query("cluster_endpoints", f"""WITH RECURSIVE {ENDS}, both_ AS (SELECT complex_id, i, j FROM edge UNION ALL SELECT complex_id, j, i FROM edge), reach AS (SELECT complex_id, pose_id AS a, pose_id AS b FROM ends UNION SELECT r.complex_id, r.a, e.j FROM reach r JOIN both_ e ON e.complex_id=r.complex_id AND e.i=r.b),
 lab AS (SELECT complex_id, a AS pose_id, min(b) AS basin FROM reach GROUP BY 1,2)
 SELECT complex_id, basin, count(*) AS size, arg_max(pose_id, (score,-pose_id)) AS representative, max(score) AS best_score, {r('coalesce(stddev_pop(score),0)')} AS dispersion, max((pose_id=0)::INTEGER) AS holds_start,
   CASE WHEN max((pose_id=0)::INTEGER)=1 THEN {r(f'(count(*)-1)/7.0{D}')} END AS return_rate, {r(f'count(*)/8.0{D}')} AS share FROM lab JOIN ends USING (complex_id, pose_id) GROUP BY 1,2""")
def cluster_endpoints(spark, sf):
    c = se.cluster_endpoints(endpoints(spark, sf), V.atoms(spark, sf), TOL, start=0)
    return c.withColumns({k: rnd(F.col(k)) for k in ("dispersion", "return_rate", "share")})


# --- ceilings and curves -----------------------------------------------------------------------

def labels_sql(poses: str, out: str) -> str:
    """Quality of a pose table; needs ``native`` and ``contacts``."""
    t = lambda x, s: f"1.0{D}/(1.0{D}+({x}/{s}{D})*({x}/{s}{D}))"
    return f"""{out}_at AS MATERIALIZED (SELECT a.complex_id, p.pose_id, a.atom_idx, a.nx, a.ny, a.nz, {V.rotated_sql('p', 'a')} FROM {poses} p JOIN native a ON a.complex_id=p.complex_id AND a.side='L'),
 {out}_lr AS (SELECT complex_id, pose_id, sqrt(avg((px-nx)*(px-nx)+(py-ny)*(py-ny)+(pz-nz)*(pz-nz))) AS l FROM {out}_at GROUP BY 1,2),
 {out}_ir AS (SELECT complex_id, pose_id, sqrt(avg((px-nx)*(px-nx)+(py-ny)*(py-ny)+(pz-nz)*(pz-nz))) AS i FROM {out}_at JOIN (SELECT DISTINCT complex_id, lig_idx AS atom_idx FROM contacts) USING (complex_id, atom_idx) GROUP BY 1,2),
 {out}_nn AS (SELECT complex_id, count(*) AS nn FROM contacts WHERE d<5.0{D} GROUP BY 1),
 {out}_fn AS (SELECT p.complex_id, p.pose_id, count(*) AS kept FROM {out}_at p JOIN contacts c ON c.complex_id=p.complex_id AND c.lig_idx=p.atom_idx AND c.d<5.0{D} WHERE (px-rx)*(px-rx)+(py-ry)*(py-ry)+(pz-rz)*(pz-rz)<25.0{D} GROUP BY 1,2),
 {out} AS MATERIALIZED (SELECT complex_id, pose_id, l AS l_rmsd, CASE WHEN coalesce(nn,0)>0 THEN (coalesce(kept,0)/nn::DOUBLE + {t('coalesce(i,l)', 1.5)} + {t('l', 8.5)})/3.0{D} ELSE ({t('coalesce(i,l)', 1.5)} + {t('l', 8.5)})/2.0{D} END AS dockq
   FROM {out}_lr LEFT JOIN {out}_ir USING (complex_id, pose_id) LEFT JOIN {out}_nn USING (complex_id) LEFT JOIN {out}_fn USING (complex_id, pose_id))"""


@query("rotation_ceiling", f"""WITH {V.NATIVE}, {g.CONTACTS}, {ROT_NEAR}, n1 AS (SELECT * FROM rnear WHERE place=1), cen AS (SELECT complex_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM native WHERE side='L' GROUP BY 1),
 ct AS (SELECT n1.complex_id, {V.rotated_sql('n1', 'cen', False)}, mx, my, mz FROM n1 JOIN cen USING (complex_id)),
 kinds AS (SELECT complex_id, 0::BIGINT AS pose_id, q1,q2,q3,q4, tx,ty,tz FROM n1 UNION ALL SELECT complex_id, 1, q1,q2,q3,q4, {", ".join(f"round_even({t}/{H}{D},0)*{H}{D}" for t in T)} FROM n1
   UNION ALL SELECT n1.complex_id, 2, q1,q2,q3,q4, mx-px, my-py, mz-pz FROM n1 JOIN ct USING (complex_id)), {labels_sql('kinds', 'lq')}
 SELECT lq.complex_id, max(n1.qi)::INTEGER AS qi, {r('max(n1.angle)')} AS angle, {", ".join(r(f"max(CASE WHEN pose_id={k} THEN dockq END)") + f" AS {n}" for k, n in enumerate(("exact_t", "snapped_t", "centroid_t")))} FROM lq JOIN n1 USING (complex_id) GROUP BY 1""")
def rotation_ceiling(spark, sf):
    c = dg.rotation_ceiling(V.native_atoms(spark, sf), V.complexes(spark, sf), V.rotations(spark), V.ROTATIONS, H)
    return c.select(C, "qi", *[rnd(F.col(x)).alias(x) for x in ("angle", "exact_t", "snapped_t", "centroid_t")])


@query("cone_ceiling", f"""WITH {V.NATIVE}, {g.CONTACTS}, {cone_sql(4, 15.0)}, cp AS (SELECT complex_id, cone::BIGINT AS pose_id, {", ".join(Q)}, {", ".join(T)} FROM cone), {labels_sql('cp', 'lq')}
 SELECT complex_id, {r('max(dockq)')} AS best, {r('max(CASE WHEN pose_id=0 THEN dockq END)')} AS exact FROM lq GROUP BY 1""")
def cone_ceiling(spark, sf):
    c = dg.cone_ceiling(V.native_atoms(spark, sf), V.complexes(spark, sf), 4, 15.0)
    return c.select(C, rnd(F.col("best")).alias("best"), rnd(F.col("exact")).alias("exact"))


@query("reachable_ceiling", f"""WITH {V.NATIVE}, {g.CONTACTS}, {ROT_NEAR.replace('place<=1', 'place<=2')}, rp AS (SELECT complex_id, ((qi*100+cx)*100+cy)*100+cz AS pose_id, q1,q2,q3,q4, cx*{H}{D} AS tx, cy*{H}{D} AS ty, cz*{H}{D} AS tz FROM rlattice), {labels_sql('rp', 'lq')}
 SELECT complex_id, {r('max(dockq)')} AS ceiling, count(*) AS poses FROM lq GROUP BY 1""")
def reachable_ceiling(spark, sf):
    c = dg.reachable_ceiling(V.native_atoms(spark, sf), V.complexes(spark, sf), V.rotations(spark), V.ROTATIONS, H, k=2)
    return c.withColumn("ceiling", rnd(F.col("ceiling")))


_U1, _U2 = g.uniform_sql("complex_id*2", 0), g.uniform_sql("complex_id*2+1", 0)
_UX = ["rr*cos(phi)", "rr*sin(phi)", "uz"]
ANGLES = (0.0, 5.0, 10.0, 20.0)


@query("angle_quality_curve", f"""WITH {V.NATIVE}, {g.CONTACTS}, ax AS (SELECT complex_id, sqrt(greatest(0.0{D},1.0{D}-uz*uz)) AS rr, uz, phi FROM (SELECT complex_id, 2.0{D}*{_U1}-1.0{D} AS uz, {2 * g.PI!r}{D}*{_U2} AS phi FROM complexes)),
 ax3 AS (SELECT complex_id, {", ".join(f"{e} AS u{a}" for a, e in zip("xyz", _UX))} FROM ax), cen AS (SELECT complex_id, avg(nx) AS gx, avg(ny) AS gy, avg(nz) AS gz FROM native WHERE side='L' GROUP BY 1),
 tu AS MATERIALIZED (SELECT a.complex_id, deg, atom_idx, nx, ny, nz, {", ".join(f"g{p}+c*(n{p}-g{p})+s*(u{q_}*(n{s_}-g{s_})-u{s_}*(n{q_}-g{q_}))+(1.0{D}-c)*u{p}*(ux*(nx-gx)+uy*(ny-gy)+uz*(nz-gz)) AS p{p}" for p, q_, s_ in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")))}
   FROM native a JOIN ax3 USING (complex_id) JOIN cen USING (complex_id) CROSS JOIN (SELECT deg, cos(radians(deg)) AS c, sin(radians(deg)) AS s FROM (SELECT unnest([{",".join(f"{d}{D}" for d in ANGLES)}]) AS deg)) WHERE side='L'),
 lr AS (SELECT complex_id, deg, sqrt(avg((px-nx)*(px-nx)+(py-ny)*(py-ny)+(pz-nz)*(pz-nz))) AS l FROM tu GROUP BY 1,2), ir AS (SELECT complex_id, deg, sqrt(avg((px-nx)*(px-nx)+(py-ny)*(py-ny)+(pz-nz)*(pz-nz))) AS i FROM tu JOIN (SELECT DISTINCT complex_id, lig_idx AS atom_idx FROM contacts) USING (complex_id, atom_idx) GROUP BY 1,2),
 nn AS (SELECT complex_id, count(*) AS nn FROM contacts WHERE d<5.0{D} GROUP BY 1), fn AS (SELECT p.complex_id, deg, count(*) AS kept FROM tu p JOIN contacts c ON c.complex_id=p.complex_id AND c.lig_idx=p.atom_idx AND c.d<5.0{D} WHERE (px-rx)*(px-rx)+(py-ry)*(py-ry)+(pz-rz)*(pz-rz)<25.0{D} GROUP BY 1,2),
 q AS (SELECT deg, CASE WHEN coalesce(nn,0)>0 THEN (coalesce(kept,0)/nn::DOUBLE+1/(1+(coalesce(i,l)/1.5{D})**2)+1/(1+(l/8.5{D})**2))/3 ELSE (1/(1+(coalesce(i,l)/1.5{D})**2)+1/(1+(l/8.5{D})**2))/2 END AS q FROM lr LEFT JOIN ir USING (complex_id,deg) LEFT JOIN nn USING (complex_id) LEFT JOIN fn USING (complex_id,deg))
 SELECT deg, count(*) AS n, {r('avg(q)', 5)} AS mean_q, {", ".join(r(f"avg((q>={c}{D})::INTEGER)", 5) + f" AS rate_{k}" for k, c in ((1, 0.23), (2, 0.49), (3, 0.80)))} FROM q GROUP BY 1""")
def angle_quality_curve(spark, sf):
    c = dg.angle_quality_curve(V.native_atoms(spark, sf), V.complexes(spark, sf), ANGLES)
    return c.select("deg", "n", *[rnd(F.col(x), 5).alias(x) for x in ("mean_q", "rate_1", "rate_2", "rate_3")])


def landscape_sql(n: int, deg: float, shift: float, seed: int = 0) -> str:
    """``land``: offset, quality and score gap of the best of ``n`` samples around every native pose."""
    e = ["-ux*sin(half)", "-uy*sin(half)", "-uz*sin(half)", "cos(half)"]
    return f"""near_ AS MATERIALIZED (WITH {V.NATIVE},
   cen AS (SELECT complex_id, avg(nx) AS gx, avg(ny) AS gy, avg(nz) AS gz FROM native WHERE side='L' GROUP BY 1),
   k AS (SELECT c.*, gx, gy, gz, probe, {V.mix2_sql(V.mix2_sql('c.complex_id', '(-1)', seed), 'probe', seed)} AS key FROM complexes c JOIN cen USING (complex_id) CROSS JOIN (SELECT unnest(range(0,{n})) AS probe)),
   h AS (SELECT *, radians({g.uniform_sql('key', seed + 3)}*{deg}{D})/2 AS half, {axis_sql('key', seed + 2)}, {", ".join(f"(2.0{D}*{g.uniform_sql(f'key*3+{i}', seed + 4)}-1.0{D})*{shift}{D} AS m{a}" for i, a in enumerate("xyz"))} FROM k),
   a AS (SELECT * EXCLUDE (uphi, rr), rr*cos(uphi) AS ux, rr*sin(uphi) AS uy FROM (SELECT *, sqrt(greatest(0.0{D}, 1.0{D}-uz*uz)) AS rr FROM h)),
   t AS (SELECT *, {", ".join(f"({x}) AS e{i + 1}" for i, x in enumerate(e))}, tx-gx AS x, ty-gy AS y, tz-gz AS z FROM a),
   w AS (SELECT t.*, {", ".join(f"({x}) AS c{i + 1}" for i, x in enumerate(quat_mul_sql(["q1", "q2", "q3", "q4"], ["e1", "e2", "e3", "e4"])))} FROM t),
   v AS (SELECT w.*, {V.rotated_sql('u', 'w', False)} FROM w JOIN (SELECT complex_id AS uc, probe AS up, e1 AS q1, e2 AS q2, e3 AS q3, e4 AS q4 FROM t) u ON uc=w.complex_id AND up=w.probe)
   SELECT complex_id, probe::BIGINT AS pose_id, c1 AS q1, c2 AS q2, c3 AS q3, c4 AS q4, px+gx+mx AS tx, py+gy+my AS ty, pz+gz+mz AS tz FROM v
   UNION ALL SELECT complex_id, -1, {", ".join(Q)}, {", ".join(T)} FROM complexes),
 {V.ATOMS}, {g.grid_sql(H)}, {g.REC}, poses AS (SELECT * FROM near_),
 lig AS MATERIALIZED (SELECT complex_id, pose_id, atom_idx, radius, sasa, type_id, charge_id, -{g.CHARGE_LUT}[charge_id] AS charge, px AS x, py AS y, pz AS z FROM (
   SELECT a.*, p.pose_id, {V.rotated_sql('p', 'a')} FROM atoms a JOIN poses p USING (complex_id) WHERE side='L')), {g.FEATURES},
 native AS MATERIALIZED (WITH {V.NATIVE} SELECT * FROM native), {g.CONTACTS}, {labels_sql('poses', 'lq')},
 both_ AS (SELECT l.complex_id, l.pose_id, l_rmsd, dockq, score FROM lq l JOIN scores USING (complex_id, pose_id)),
 land AS (SELECT b.complex_id, o, q, s-score AS gap FROM (SELECT complex_id, arg_max(l_rmsd, (score, -pose_id)) AS o, arg_max(dockq, (score, -pose_id)) AS q, max(score) AS s FROM both_ WHERE pose_id>=0 GROUP BY 1) b JOIN both_ h ON h.complex_id=b.complex_id AND h.pose_id=-1)"""


@query("near_native_landscape", f"WITH {landscape_sql(6, 20.0, 2.0)} SELECT complex_id, {r('o', 4)} AS offset, {r('q', 4)} AS dockq, {r('gap', 4)} AS gap FROM land")
def near_native_landscape(spark, sf):
    l = dg.near_native_landscape(V.native_atoms(spark, sf), V.complexes(spark, sf), g.ATOM_WEIGHTS, 6, 20.0, 2.0, H)
    return l.select(C, *[rnd(F.col(x), 4).alias(x) for x in ("offset", "dockq", "gap")])


@query("landscape_summary", f"WITH {landscape_sql(4, 20.0, 2.0)} SELECT count(*) AS n, {r('avg((gap>1e-6)::INTEGER)')} AS beaten, {r('quantile_cont(o, 0.5)')} AS median_offset, {r('quantile_cont(o, 0.9)')} AS p90_offset FROM land")
def landscape_summary(spark, sf):
    l = dg.near_native_landscape(V.native_atoms(spark, sf), V.complexes(spark, sf), g.ATOM_WEIGHTS, 4, 20.0, 2.0, H)
    s = dg.landscape_summary(cut(l.select(C, "offset", rnd(F.col("gap")).alias("gap"))))
    return s.select("n", *[rnd(F.col(c)).alias(c) for c in ("beaten", "median_offset", "p90_offset")])


def sweep_sql(h: float) -> str:
    return f"""SELECT * FROM (WITH {scan_sql(h)}, fp AS (SELECT f.complex_id, f.rank AS pose_id, {", ".join(f"s.{q}" for q in Q)}, cx*{h}{D} AS tx, cy*{h}{D} AS ty, cz*{h}{D} AS tz FROM found f JOIN rotations s ON s.qi=f.qi),
 native AS MATERIALIZED (WITH {V.NATIVE} SELECT * FROM native), {g.CONTACTS}, {labels_sql('fp', 'lq')},
 per AS (SELECT complex_id, max(dockq) AS best, max(CASE WHEN pose_id=1 THEN dockq END) AS top FROM lq GROUP BY 1),
 snap AS (SELECT complex_id, sqrt({"+".join(f"(round_even({t}/{h}{D},0)*{h}{D}-{t})*(round_even({t}/{h}{D},0)*{h}{D}-{t})" for t in T)}) AS snap FROM complexes)
 SELECT {h}{D} AS spacing, count(*) AS n, {r(f'avg((coalesce(best,0)>={TH})::INTEGER)')} AS recall, {r(f'avg((coalesce(top,0)>={TH})::INTEGER)')} AS success_1, {r('avg(best)')} AS mean_best_q, {r('avg(snap)')} AS snap_error FROM snap LEFT JOIN per USING (complex_id))"""


@query("spacing_sweep", " UNION ALL ".join(sweep_sql(h) for h in (3.0, 4.0)))
def spacing_sweep(spark, sf):
    s = dg.spacing_sweep(V.native_atoms(spark, sf), V.complexes(spark, sf), V.rotations(spark), V.ROTATIONS, g.ATOM_WEIGHTS, (3.0, 4.0), ntop=NTOP, round_to=6)
    return s.select("spacing", "n", *[rnd(F.col(x)).alias(x) for x in ("recall", "success_1", "mean_best_q", "snap_error")])


AFTER = f"moved AS (SELECT complex_id, pose_id, q1,q2,q3,q4, tx-0.25{D}*(pose_id%3) AS tx, ty-0.5{D} AS ty, tz FROM poses)"


@query("refinement_report", f"""WITH {V.NATIVE}, {g.CONTACTS}, {AFTER}, {labels_sql('poses', 'lb')}, {labels_sql('moved', 'la')},
 b AS (SELECT complex_id, arg_max(dockq, (pose_id*5%8, -pose_id)) AS q0 FROM lb GROUP BY 1), a AS (SELECT complex_id, arg_max(dockq, (pose_id*3%8, -pose_id)) AS q1, arg_max(pose_id, (pose_id*3%8, -pose_id)) AS p FROM la GROUP BY 1),
 m AS (SELECT a.*, q0, sqrt((0.25{D}*(p%3))*(0.25{D}*(p%3))+0.25{D}) AS shift, {g.angle_sql('s', 's')} AS turn FROM a JOIN b USING (complex_id) JOIN poses s ON s.complex_id=a.complex_id AND s.pose_id=p)
 SELECT count(*) AS n, {r('avg(q0)')} AS before, {r('avg(q1)')} AS after, count(*) FILTER (q1-q0>0.01{D}) AS improved, count(*) FILTER (abs(q1-q0)<=0.01{D}) AS unchanged, count(*) FILTER (q1-q0< -0.01{D}) AS worsened,
  {", ".join(r(f"avg(({x}>={c}{D})::INTEGER)") + f" AS {n}_rate_{k}" for n, x in (("before", "q0"), ("after", "q1")) for k, c in ((1, 0.23), (2, 0.49), (3, 0.80)))}, {r('quantile_cont(shift, 0.5)')} AS median_shift, round(quantile_cont(turn, 0.5), 3) AS median_turn FROM m""")
def refinement_report(spark, sf):
    a, p = V.native_atoms(spark, sf), V.poses(spark, sf)
    moved = p.withColumn("tx", F.col("tx") - 0.25 * (F.col("pose_id") % 3)).withColumn("ty", F.col("ty") - 0.5)
    before = ql.dockq(p, a).withColumn("score", F.col("pose_id") * 5 % 8)
    after = ql.dockq(moved, a).withColumn("score", F.col("pose_id") * 3 % 8)
    out = dg.refinement_report(before, after)
    ints = ("n", "improved", "unchanged", "worsened")
    return out.select(*[F.col(c) if c in ints else rnd(F.col(c), 3 if c == "median_turn" else 6).alias(c) for c in out.columns])


TERM_NAMES = ("fav", "clash", "shape", "pair", "charge", "total")
GAPS = f"""won_ AS MATERIALIZED (WITH {SCAN}, {ROT_NEAR}, w AS (SELECT f.complex_id, 2::BIGINT AS pose_id, {", ".join(f"s.{q}" for q in Q)}, cx*{H}{D} AS tx, cy*{H}{D} AS ty, cz*{H}{D} AS tz FROM found f JOIN rotations s ON s.qi=f.qi WHERE rank=1)
   SELECT * FROM w UNION ALL SELECT complex_id, 0, {", ".join(Q)}, {", ".join(T)} FROM complexes
   UNION ALL SELECT complex_id, 1, {", ".join(Q)}, {", ".join(f"round_even({t}/{H}{D},0)*{H}{D}" for t in T)} FROM rnear WHERE place=1),
 {V.ATOMS}, {g.grid_sql(H)}, {g.REC}, poses AS (SELECT * FROM won_),
 lig AS MATERIALIZED (SELECT complex_id, pose_id, atom_idx, radius, sasa, type_id, charge_id, -{g.CHARGE_LUT}[charge_id] AS charge, px AS x, py AS y, pz AS z FROM (
   SELECT a.*, p.pose_id, {V.rotated_sql('p', 'a')} FROM atoms a JOIN poses p USING (complex_id) WHERE side='L')), {g.FEATURES},
 native AS MATERIALIZED (WITH {V.NATIVE} SELECT * FROM native), {g.CONTACTS}, {labels_sql('poses', 'lq')},
 tm AS (SELECT complex_id, pose_id, 0.5{D}*c_pair AS fav, -(0.75{D}*n_ss+1.5{D}*n_sc+3.0{D}*n_cc) AS clash, 0.5{D}*c_pair-(0.75{D}*n_ss+1.5{D}*n_sc+3.0{D}*n_cc) AS shape, -pe AS pair, 2.0{D}*elec AS charge, score AS total FROM scores),
 tw AS (SELECT a.complex_id, q.dockq>={TH} AS recalled, {", ".join(f"a.{n}-b.{n} AS gap_{n}, b.{n}-c.{n} AS dis_{n}" for n in TERM_NAMES)} FROM tm a JOIN tm b ON b.complex_id=a.complex_id AND b.pose_id=1 JOIN tm c ON c.complex_id=a.complex_id AND c.pose_id=0
   JOIN lq q ON q.complex_id=a.complex_id AND q.pose_id=2 WHERE a.pose_id=2)"""


@query("term_gaps", f"WITH {GAPS} " + " UNION ALL ".join(f"SELECT recalled, '{n}' AS term, count(*) AS n, {r(f'avg(gap_{n})', 4)} AS gap, {r(f'avg(dis_{n})', 4)} AS discretisation FROM tw GROUP BY 1" for n in TERM_NAMES))
def term_gaps(spark, sf):
    a = V.native_atoms(spark, sf)
    s = cut(found(spark, sf))
    won = ql.dockq(s.filter(F.col("pose_id") == 1), a).withColumn("recalled", F.col("dockq") >= 0.23)
    t = dg.term_gaps(a, V.complexes(spark, sf), V.rotations(spark), V.ROTATIONS, won, g.ATOM_WEIGHTS, H)
    return t.select("recalled", "term", "n", rnd(F.col("gap"), 4).alias("gap"), rnd(F.col("discretisation"), 4).alias("discretisation"))


# --- text sources and sinks ----------------------------------------------------------------------

def molecule_lines(spark, sf):
    """One molecule per (label, side): the atoms of all vectors of the label, in order."""
    a = g.named_atoms(spark, sf)
    lab = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias(C), F.col("label"))
    a = a.join(lab, C).withColumn("res_seq", F.col(C) % 10000).withColumn("place", F.col(C) * 32 + F.col("atom_idx"))
    return a


MOL = g.NAMED + f""",
mol AS (SELECT n.*, label::VARCHAR AS mol, row_number() OVER (PARTITION BY label, side ORDER BY n.complex_id, atom_idx)-1 AS idx FROM named n JOIN embeddings e ON e.vec_id=n.complex_id)"""


def _write_lines(lines, out):
    """Text in one folder per molecule; every file holds one molecule in order."""
    lines.repartition("complex_id", "side").sortWithinPartitions("complex_id", "side", "place").select(
        "complex_id", "side", "line").write.mode("overwrite").partitionBy("complex_id", "side").text(out)


@query("read_atoms_ms", f"""WITH {MOL} SELECT mol AS complex_id, side, count(*) AS n, {", ".join(r(f"sum(round({a},3))", 3) + f" AS {a}" for a in "xyz")}, {r('sum(round(x,3)*(idx%101))', 3)} AS ordered,
  count(*) FILTER (side='R') AS tagged, sum(complex_id%10000)::BIGINT AS res_sum, arg_min(res_name||'/'||atom_name, idx) AS first_atom, {r(f"sum((atom_idx%3)*0.25{D}-0.25{D})", 2)} AS charge FROM mol GROUP BY 1,2""")
def read_atoms_ms(spark, sf):
    """Atoms written as fixed-width text with tail columns and read back."""
    a = molecule_lines(spark, sf).withColumns({
        "occupancy": F.lit(2), "tempfactor": F.lit(1), "radius_col": F.lit(1.7), "ace_type": F.when(F.col("side") == "R", F.lit("1PPI")),
        "charge_col": (F.col("atom_idx") % 3) * 0.25 - 0.25})
    lines = a.select(F.col("label").cast("string").alias("complex_id"), "side", "place", export.ms_line(F.col("place") % 100000, F.lit("A")).alias("line"))
    out = shared_folder(spark, "atoms")
    _write_lines(lines, out)
    b = structures.read_atoms_ms(spark, out)
    return b.groupBy("complex_id", "side").agg(
        F.count(F.lit(1)).alias("n"), *[rnd(F.sum(c), 3).alias(c) for c in "xyz"], rnd(F.sum(F.col("x") * (F.col("atom_idx") % 101)), 3).alias("ordered"),
        F.count("ace_type").alias("tagged"), F.sum("res_seq").alias("res_sum"), F.min_by(F.concat_ws("/", "res_name", "atom_name"), F.col("atom_idx")).alias("first_atom"),
        rnd(F.sum(F.col("charge_col").cast("double")), 2).alias("charge"))


@query("read_atoms_pdb", f"""WITH {MOL}, {g.RULES}, first_ AS (SELECT m.*, rules.type_id, (complex_id+atom_idx)%11=0 AS other FROM mol m LEFT JOIN rules ON rules.res_name=m.res_name AND rules.atom_name=CASE WHEN m.atom_name='OXT' THEN 'O' ELSE m.atom_name END WHERE atom_idx<7)
 SELECT mol AS complex_id, side, count(*) FILTER (NOT other AND type_id IS NOT NULL) AS n, {r('sum(CASE WHEN NOT other AND type_id IS NOT NULL THEN round(x,3) END)', 3)} AS x, count(*) FILTER (other) AS other_place, count(*) FILTER (NOT other AND type_id IS NULL) AS unknown FROM first_ GROUP BY 1,2""")
def read_atoms_pdb(spark, sf):
    """Plain text with alternate places and a second model, read back."""
    a = molecule_lines(spark, sf)
    model = (F.col("atom_idx") >= 7).cast("int")
    line = export.atom_line(F.col("place") % 100000, F.lit("A"))
    line = F.when((F.col(C) + F.col("atom_idx")) % 11 == 0, F.concat(F.substring(line, 1, 16), F.lit("B"), F.substring(line, 18, 100))).otherwise(line)
    rows = a.select(F.col("label").cast("string").alias("complex_id"), "side", (model * 10 ** 12 + F.col("place")).alias("place"), line.alias("line"))
    ends = rows.select("complex_id", "side").distinct().select("complex_id", "side", F.lit(10 ** 12 - 1).alias("place"), F.lit("ENDMDL").alias("line"))
    out = shared_folder(spark, "plain")
    _write_lines(rows.unionByName(ends), out)
    b = structures.read_atoms_pdb(spark, out).groupBy("complex_id", "side").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("x"), 3).alias("x"))
    d = structures.dropped_atoms(spark, out)
    d = d.groupBy(structures.complex_of(F.col("file")).alias("complex_id"), structures.side_of(F.col("file")).alias("side")).agg(
        F.coalesce(F.sum(F.when(F.col("reason") == "alternate place", F.col("n"))), F.lit(0)).alias("other_place"),
        F.coalesce(F.sum(F.when(F.col("reason") == "unknown atom", F.col("n"))), F.lit(0)).alias("unknown"))
    return b.join(d, ["complex_id", "side"])


@query("read_pose_list", f"""WITH {V.POSES}, p AS (SELECT e.label::VARCHAR AS complex_id, row_number() OVER (PARTITION BY e.label ORDER BY p.complex_id, p.pose_id)-1 AS i, p.* EXCLUDE (complex_id) FROM poses p JOIN embeddings e ON e.vec_id=p.complex_id)
 SELECT complex_id, 96::INTEGER AS cells, count(*) AS n, {r('sum(round(q1*2,6)*(i%7))', 4)} AS a1, sum((qi*13%96)*(i%5))::BIGINT AS t1, {r('sum(round(tx,3))', 3)} AS score FROM p GROUP BY 1""")
def read_pose_list(spark, sf):
    """Pose lists written as text, one file per label, and read back."""
    _, rows = g.pose_lists(spark, sf)
    p = rows.join(V.poses(spark, sf).select(C, "pose_id", "tx"), [C, "pose_id"])
    p = p.join(V.table(spark, sf, "embeddings").select(F.col("vec_id").alias(C), F.col("label").cast("string").alias("label")), C)
    line = F.format_string("%.6f\t%.6f\t%.6f\t%d\t%d\t%d\t%.3f", "a1", "a2", "a3", "t1", "t2", "t3", "tx")
    body = p.select(F.col("label").alias("complex_id"), F.lit("R").alias("side"), (F.col(C) * 16 + F.col("pose_id") + 10).alias("place"), line.alias("line"))
    head = body.select("complex_id").distinct().select("complex_id", F.lit("R").alias("side"), F.inline(F.array(*[
        F.struct(F.lit(i).cast("long").alias("place"), F.lit(t).alias("line")) for i, t in enumerate(
            ("96\t1.2", "0.1\t0.2\t0.3", "rec.pdb\t1.0\t2.0\t3.0", "lig.pdb\t0.5\t-0.5\t0.25"))])))
    out = shared_folder(spark, "poses")
    _write_lines(body.unionByName(head), out)
    headers, poses = structures.read_pose_list(spark, out)
    j = poses.join(headers.select("complex_id", "cells"), "complex_id")
    return j.groupBy("complex_id", "cells").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(F.col("a1") * (F.col("pose_id") % 7)), 4).alias("a1"),
                                                F.sum(F.col("t1") * (F.col("pose_id") % 5)).alias("t1"), rnd(F.sum("raw_score"), 3).alias("score"))


@query("export_top_k", f"""WITH {V.PLACED}, {g.NAMED_ONLY}, best AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY pose_id*5%8 DESC, pose_id) AS rank FROM poses QUALIFY rank<=2),
 al AS (SELECT b.complex_id, b.rank, n.atom_idx+CASE WHEN n.side='L' THEN {V.REC_ATOMS} ELSE 0 END+1 AS line_no, n.side, res_name, atom_name, CASE WHEN n.side='R' THEN n.x ELSE px END AS x, CASE WHEN n.side='R' THEN n.y ELSE py END AS y, CASE WHEN n.side='R' THEN n.z ELSE pz END AS z
   FROM best b JOIN named n USING (complex_id) LEFT JOIN placed p ON p.complex_id=b.complex_id AND p.pose_id=b.pose_id AND p.atom_idx=n.atom_idx AND n.side='L')
 SELECT complex_id, rank::INTEGER AS rank, line_no::BIGINT AS line_no, printf('ATOM  %5d %4s %3s %1s%4d    %8.3f%8.3f%8.3f', line_no::INTEGER, CASE WHEN length(atom_name)<4 THEN rpad(' '||atom_name,4,' ') ELSE atom_name END, res_name, side, (complex_id%10000)::INTEGER, x, y, z) AS line FROM al""")
def export_top_k(spark, sf):
    """Structure text of the two best poses of every complex."""
    a = g.with_names(V.native_atoms(spark, sf)).select(C, "side", "atom_idx", "x", "y", "z", "nx", "ny", "nz", "res_name", "atom_name")
    a = a.withColumn("res_seq", F.col(C) % 10000)
    p = V.poses(spark, sf).withColumn("score", F.col("pose_id") * 5 % 8)
    return export.top_k_lines(p, a, 2)


@query("write_metrics", f"WITH {REPORT_SQL} SELECT complex_id, n, n_hit_q, {r('best_q_1')} AS best_q_1, (SELECT {r('avg(success_q_1)')} FROM report) AS success_1 FROM report")
def write_metrics(spark, sf):
    """Per-complex CSV and summary JSON, written and read back."""
    from posefarm.operators import ranking as rk
    report = rk.ranking_report(V.scored(spark, sf).withColumn("score", F.col("score_a")))
    out = shared_folder(spark, "metrics")
    export.write_metrics(report, rk.success_rates(report), out)
    rows = spark.read.schema(report.schema).option("header", True).csv(f"{out}/per_complex")
    summary = spark.read.schema("n_complexes long, success_1 double").json(f"{out}/summary").agg(rnd(F.max("success_1")).alias("success_1"))
    return with_one(rows, summary).select(C, "n", "n_hit_q", rnd(F.col("best_q_1")).alias("best_q_1"), "success_1")


@query("read_corpus_index", f"WITH {V.SYSTEMS} SELECT split, count(*) AS n, count(DISTINCT cluster) AS clusters, count(*) FILTER (chain='UNDEFINED') AS undefined FROM systems GROUP BY 1")
def read_corpus_index(spark, sf):
    s = V.systems(spark, sf)
    out = shared_folder(spark, "index")
    s.select("id", "split", F.col("cluster").alias("cluster_id"), F.col("chain").alias("chain_R"), "name", "voxels").write.mode("overwrite").parquet(out)
    i = src.read_corpus_index(spark, out)
    return i.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster_id").alias("clusters"), F.count_if(F.col("chain_R") == "UNDEFINED").alias("undefined"))


# --- streams ------------------------------------------------------------------------------------------

@query("absorb_stream", f"WITH {co.FRESH_NEG} SELECT complex_id, pose_id, origin FROM after_")
def absorb_stream(spark, sf):
    """Mined poses arrive as files and are absorbed into a kept pool."""
    a, b = co.rounds(spark, sf)
    out, mined = shared_folder(spark, "absorb"), shared_folder(spark, "mined")
    inc.start_pool(a.withColumn("origin", F.lit(0)), out)
    b.write.mode("overwrite").parquet(mined)
    stream = spark.readStream.schema(b.schema).parquet(mined)
    q = inc.absorb_stream(stream, out, shared_folder(spark, "absorb-state"), co.ABSORB_CAP)
    q.awaitTermination()
    return inc.kept_pool(spark, out).select(C, "pose_id", "origin")


@query("manifest_stream", "SELECT status, count(*) AS n FROM (SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1) GROUP BY 1")
def manifest_stream(spark, sf):
    """Latest status per id from the event stream."""
    batch = V.table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    latest = inc.manifest_stream(stream.select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))
    out = shared_folder(spark, "manifest")
    q = (latest.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", shared_folder(spark, "manifest-state"))
         .foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{out}/batch={b}")).start())
    q.awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("id").agg(F.max_by("status", "seq").alias("status"))
    return inc.status_counts(last)


@query("dedup_stream", f"WITH {V.POOL} SELECT DISTINCT complex_id, qi, cx, cy, cz FROM pool")
def dedup_stream(spark, sf):
    """First row of every pose identity from a stream of poses."""
    schema = V.table(spark, sf, "lineitem").schema
    li = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    keys = li.select(F.to_timestamp("l_shipdate").alias("arrival"), F.col("l_suppkey").alias(C), (F.col("l_partkey") % 1944).alias("qi"), (F.col("l_linenumber") - 4).cast("long").alias("cx"),
                     ((F.col("l_quantity") % 9).cast("long") - 4).alias("cy"), (F.col("l_orderkey") % 9 - 4).alias("cz"))
    out = shared_folder(spark, "dedup")
    # Shipping dates of the table span less than the delay, so no repeat is too late to be known.
    q = inc.dedup_stream(keys, "arrival", "4000 days").drop("arrival").writeStream.outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", shared_folder(spark, "dedup-state")).format("parquet").start(out)
    q.awaitTermination()
    return spark.read.parquet(out)
