"""Queries on losses, fitting and term diagnostics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from posefarm.operators import diagnostics as dg
from posefarm.operators import fitting as fi
from posefarm.operators import losses as lo
from posefarm.operators.curation import cluster_folds
from posefarm.operators.quality import hit_mask, split_targets
from posefarm.operators.scoring import Weights, linear_score, standardize
from posefarm.plans import views as V
from posefarm.plans.evaluation import AUC_SQL, TH, r
from posefarm.plans.registry import query
from posefarm.plans.views import rnd

C = "complex_id"
D = "::DOUBLE"
W = "OVER (PARTITION BY complex_id)"
Z = V.SCORED + f""",
z AS MATERIALIZED (SELECT *, (score_a-avg(score_a) {W})/greatest(stddev_pop(score_a) {W},1.0{D}) AS z, greatest(stddev_pop(score_a) {W},1.0{D}) AS sc, stddev_pop(score_a) {W} < 1.0{D} AS fx, dockq>={TH} AS pos FROM scored)"""


def z_pool(spark, sf):
    return standardize(V.scored(spark, sf), "score_a", "z")


def _out(df):
    return df.select(C, rnd(F.col("loss"), 5).alias("loss"))


# --- losses ------------------------------------------------------------------------

@query("split_mse_loss", f"""WITH {V.SCORED}, m AS (SELECT complex_id, max(score_a) AS hi, min(score_a) AS lo FROM scored GROUP BY 1)
 SELECT complex_id, {r(f"coalesce(avg(CASE WHEN rmsd<=5.0{D} THEN (score_a-hi)*(score_a-hi) END),0)+coalesce(avg(CASE WHEN rmsd>5.0{D} THEN (score_a-lo)*(score_a-lo) END),0)", 5)} AS loss FROM scored JOIN m USING (complex_id) GROUP BY 1""")
def split_mse_loss(spark, sf):
    return _out(lo.split_mse_loss(split_targets(hit_mask(V.scored(spark, sf), 5.0), "score_a"), "score_a"))


def _listnet_sql(label: str) -> str:
    return f"""SELECT complex_id, {r('ms + ln(sum(exp(z-ms))) - sum(exp(l-ml)*z)/sum(exp(l-ml))', 5)} AS loss FROM (SELECT complex_id, z, l, max(z) {W} AS ms, max(l) {W} AS ml FROM (SELECT *, {label} AS l FROM z)) GROUP BY complex_id, ms, ml"""


@query("listnet_rmsd_loss", f"WITH {Z} {_listnet_sql(f'-rmsd/5.0{D}')}")
def listnet_rmsd_loss(spark, sf):
    return _out(lo.listnet_loss(z_pool(spark, sf)))


@query("listnet_quality_loss", f"WITH {Z} {_listnet_sql(f'dockq/0.2{D}')}")
def listnet_quality_loss(spark, sf):
    return _out(lo.listnet_loss(z_pool(spark, sf), label="dockq", temperature=0.2, sign=1))


MARGIN = f"SELECT complex_id, coalesce(avg(CASE WHEN NOT pos THEN greatest(0.0{D}, 1.0{D}+z-mp) END),0) AS loss FROM (SELECT *, min(CASE WHEN pos THEN z END) {W} AS mp FROM z) GROUP BY 1"


@query("margin_loss", f"WITH {Z} SELECT complex_id, {r('loss', 5)} AS loss FROM ({MARGIN})")
def margin_loss(spark, sf):
    return _out(lo.margin_loss(z_pool(spark, sf)))


@query("top_tail_loss", f"""WITH {Z}, k AS (SELECT complex_id, z, pos, row_number() OVER (PARTITION BY complex_id, pos ORDER BY z DESC, pose_id) AS i FROM z), m AS (SELECT *, max(z) OVER (PARTITION BY complex_id, pos) AS mx FROM k WHERE pos OR i<=32),
  s AS (SELECT complex_id, pos, max(mx)+0.5{D}*ln(avg(exp((z-mx)/0.5{D}))) AS v FROM m GROUP BY 1,2), b AS (SELECT complex_id, 1.0{D}+max(CASE WHEN NOT pos THEN v END)-max(CASE WHEN pos THEN v END) AS x FROM s GROUP BY 1)
 SELECT complex_id, {r(f'coalesce(greatest(x,0)+ln(1+exp(-abs(x))),0.0{D})', 5)} AS loss FROM b""")
def top_tail_loss(spark, sf):
    return _out(lo.top_tail_loss(z_pool(spark, sf)))


SHAPE_Z = V.POOL_WIDE + f""",
wide AS (SELECT complex_id, pose_id, dockq*0.2{D} AS dockq, round(t[1]*10+t[2], 9) AS z FROM pool_wide)"""


def _wide_z(spark, sf):
    p = V.pool_wide(spark, sf)
    return p.select(C, "pose_id", (F.col("dockq") * 0.2).alias("dockq"), F.round(F.col("t")[0] * 10 + F.col("t")[1], 9).alias("z"))


@query("shape_pairwise_loss", f"""WITH {SHAPE_Z}, a AS (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY complex_id ORDER BY dockq DESC, pose_id)<=16), b AS (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY complex_id ORDER BY z DESC, pose_id)<=32),
  p AS (SELECT a.complex_id, least(1.0{D},a.dockq/{TH})-least(1.0{D},b.dockq/{TH}) AS du, b.z-a.z AS ds FROM a JOIN b USING (complex_id) WHERE a.dockq-b.dockq>=0.02{D}), g AS (SELECT complex_id, least(1.0{D},max(dockq)/{TH}) AS gamma FROM wide GROUP BY 1)
 SELECT g.complex_id, {r(f"coalesce(max(gamma)*avg(du*(greatest(ds,0)+ln(1+exp(-abs(ds))))),0.0{D})", 5)} AS loss FROM g LEFT JOIN p USING (complex_id) GROUP BY 1""")
def shape_pairwise_loss(spark, sf):
    return _out(lo.shape_pairwise_loss(_wide_z(spark, sf)))


BASIN = f"""SELECT complex_id, coalesce((m+ln(sum(exp(z/0.5{D}-m))))-(mp+ln(sum(CASE WHEN pos THEN exp(z/0.5{D}-mp) END))),0) AS loss FROM (SELECT *, max(z/0.5{D}) {W} AS m, max(CASE WHEN pos THEN z/0.5{D} END) {W} AS mp FROM z) GROUP BY complex_id, m, mp"""


@query("basin_loss", f"WITH {Z} SELECT complex_id, {r('loss', 5)} AS loss FROM ({BASIN})")
def basin_loss(spark, sf):
    return _out(lo.basin_loss(z_pool(spark, sf)))


OBJ = lo.Objective(lambda_margin=0.3)


@query("objective", f"WITH {Z}, b AS ({BASIN}), m AS ({MARGIN}) SELECT {r(f'avg(b.loss+0.3{D}*m.loss)', 5)} AS loss, count(*) AS complexes FROM b JOIN m USING (complex_id)")
def objective(spark, sf):
    pool = V.pool(spark, sf)
    o = fi.objective_value(pool, V.weights_a(), OBJ)
    return o.select(rnd(F.col("loss"), 5).alias("loss"), "complexes")


# --- gradients and fits -------------------------------------------------------------------

FEATS = ["c_pair", "n_ss", "n_sc", "n_cc", "t[1]", "t[2]", "t[3]", "t[4]"]
GRAD = Z + f""",
gm AS (SELECT *, max(z) {W} AS m, max(CASE WHEN pos THEN z END) {W} AS mp, count(*) FILTER (pos) {W} AS np, count(*) FILTER (NOT pos) {W} AS nn, min(CASE WHEN pos THEN z END) {W} AS minp, count(*) {W} AS n FROM z),
gs AS (SELECT *, sum(exp((z-m)/0.5{D})) {W} AS sz, sum(CASE WHEN pos THEN exp((z-mp)/0.5{D}) END) {W} AS szp, count(*) FILTER (NOT pos AND 1.0{D}+z-minp>0) {W} AS act, row_number() OVER (PARTITION BY complex_id, pos ORDER BY z, pose_id) AS k FROM gm),
gg AS (SELECT *, CASE WHEN np>0 THEN (exp((z-m)/0.5{D})/sz - CASE WHEN pos THEN exp((z-mp)/0.5{D})/szp ELSE 0 END)/0.5{D} ELSE 0 END
  + CASE WHEN np>0 AND nn>0 THEN 0.3{D}*(CASE WHEN NOT pos AND 1.0{D}+z-minp>0 THEN 1.0{D}/nn WHEN pos AND k=1 THEN -act/nn::DOUBLE ELSE 0 END) ELSE 0 END AS g FROM gs),
gr AS (SELECT complex_id, {", ".join(f"(sum(g*{x}) - avg(g)*sum({x}) - CASE WHEN max(fx) THEN 0 ELSE avg(g*z) END*sum(z*{x}))/max(sc) AS g{i}" for i, x in enumerate(FEATS))} FROM gg GROUP BY 1)"""


@query("mean_gradient", f"WITH {GRAD} " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS k, {r(f'avg(g{i})', 5)} AS grad FROM gr" for i in range(8)))
def mean_gradient(spark, sf):
    g = fi.mean_gradient(V.pool(spark, sf), V.weights_a(), OBJ, 4)
    return g.select("k", rnd(F.col("grad"), 5).alias("grad"))


@query("gradient_share", f"""WITH {GRAD}, nm AS (SELECT complex_id, round(sqrt({"+".join(f"g{i}*g{i}" for i in range(4, 8))}), 8) AS norm FROM gr), o AS (SELECT *, row_number() OVER (ORDER BY norm DESC, complex_id) AS i, sum(norm) OVER (ORDER BY norm DESC, complex_id ROWS UNBOUNDED PRECEDING) AS run,
   sum(norm) OVER () AS tot, count(*) OVER () AS n, max(norm) OVER () AS mx FROM nm)
 SELECT max(n) AS n, count(*) FILTER (norm=0) AS zero, count(*) FILTER (norm<0.01{D}*mx) AS below_1pct, {", ".join(r(f"sum(CASE WHEN i<=greatest(1,floor(n*{f}{D})) THEN norm END)/max(tot)", 5) + f" AS top_{int(f * 100)}" for f in (0.05, 0.10, 0.25, 0.50))},
  {", ".join(f"count(*) FILTER (run-norm<tot*{l}{D}) AS needed_{int(l * 100)}" for l in (0.5, 0.8, 0.9))} FROM o""")
def gradient_share(spark, sf):
    norms = fi.gradient_norms(V.pool(spark, sf), V.weights_a(), OBJ, 4).withColumn("norm", F.round("norm", 8))
    s = fi.gradient_share(norms)
    return s.select("n", "zero", "below_1pct", *[rnd(F.col(c), 5).alias(c) for c in s.columns if c.startswith("top_")], *[c for c in s.columns if c.startswith("needed_")])


@query("top1_count", f"WITH {V.SCORED} SELECT count(*) FILTER (ok) AS top1, count(*) AS complexes FROM (SELECT complex_id, arg_max(dockq>={TH}, (round(score_a,6), -pose_id)) AS ok FROM scored GROUP BY 1)")
def top1_count(spark, sf):
    return fi.top1_count(V.pool(spark, sf), V.weights_a())


def _model():
    return fi.Model(V.ALPHA, V.RHO, list(V.TABLE_A), V.BETA)


@query("fit_adam")
def fit_adam(spark, sf):
    """Fitted on even complexes, validated on odd ones."""
    pool = V.pool(spark, sf)
    fit, val = pool.filter(F.col(C) % 2 == 0), pool.filter(F.col(C) % 2 == 1)
    got = fi.fit_adam(fit, val, _model(), OBJ, fi.AdamConfig(steps=4, batch=16, val_every=2, table_lr=0.05, alpha_lr=0.05, rho_lr=0.02))
    rows = [(x["step"], float(x["validation"]), bool(x["accepted"])) for x in got.trajectory]
    return spark.createDataFrame(rows, "step int, validation double, accepted boolean")


ADAM = fi.AdamConfig(steps=1, batch=1 << 40, val_every=1, table_lr=0.05, alpha_lr=0.05, rho_lr=0.02)
_A, _R = f"{V.ALPHA}{D}", f"{V.RHO}{D}"
_MOVE = lambda g, lr: f"{lr}{D}*(({g})/n)/(abs(({g})/n)+1e-8)"
_VALUE = f"(WITH z AS MATERIALIZED (SELECT * FROM {{src}}), b AS ({BASIN}), m AS ({MARGIN}) SELECT avg(b.loss+0.3{D}*m.loss) FROM b JOIN m USING (complex_id))"
ADAM_SQL = GRAD + f""",
ga AS (SELECT {", ".join(f"avg(g{i}) AS g{i}" for i in range(8))} FROM gr WHERE complex_id%2=0),
ch AS (SELECT g0-(g1*{_R}**2+g2*{_R}**3+g3*{_R}**4) AS da, -(2*g1*{_A}*{_R}+3*g2*{_A}*{_R}**2+4*g3*{_A}*{_R}**3) AS dr, {", ".join(f"-g{4 + k} AS d{k}" for k in range(4))} FROM ga),
nr AS (SELECT *, greatest(1.0{D}, sqrt(da*da+dr*dr+d0*d0+d1*d1+d2*d2+d3*d3)) AS n FROM ch),
mv AS (SELECT least(10.0{D}, greatest(0.0{D}, {_A}-{_MOVE('da', 0.05)})) AS a, least(9.0{D}, greatest(0.5{D}, {_R}-{_MOVE('dr', 0.02)})) AS rho, {", ".join(f"{t}{D}-{_MOVE(f'd{k}', 0.05)} AS w{k}" for k, t in enumerate(V.TABLE_A))} FROM nr),
z_odd AS MATERIALIZED (SELECT * FROM z WHERE complex_id%2=1),
sn AS (SELECT complex_id, pose_id, dockq, a*c_pair-a*(rho**2*n_ss+rho**3*n_sc+rho**4*n_cc)-(w0*t[1]+w1*t[2]+w2*t[3]+w3*t[4])+{V.BETA}{D}*elec AS s FROM pool, mv WHERE complex_id%2=1),
z_new AS MATERIALIZED (SELECT *, (s-avg(s) {W})/greatest(stddev_pop(s) {W},1.0{D}) AS z, dockq>={TH} AS pos FROM sn),
vals AS (SELECT {_VALUE.format(src='z_odd')} AS v0, {_VALUE.format(src='z_new')} AS v1)"""


@query("fit_adam_step", f"WITH {ADAM_SQL} SELECT 0::INTEGER AS step, {r('v0', 5)} AS validation, true AS accepted FROM vals UNION ALL SELECT 1, {r('v1', 5)}, v1<v0-1e-4 FROM vals")
def fit_adam_step(spark, sf):
    """One step over all even complexes, judged on the odd ones."""
    pool = V.pool(spark, sf)
    got = fi.fit_adam(pool.filter(F.col(C) % 2 == 0), pool.filter(F.col(C) % 2 == 1), _model(), OBJ, ADAM)
    rows = [(x["step"], float(x["validation"]), bool(x["accepted"])) for x in got.trajectory]
    return spark.createDataFrame(rows, "step int, validation double, accepted boolean").withColumn("validation", rnd(F.col("validation"), 5))


E0 = [((k * 5) % 7 - 3) / 16.0 for k in range(V.WIDE)]
E0_SQL = "[" + ",".join(f"{v}{D}" for v in E0) + "]"
AFF = V.POOL_WIDE + f""",
aff AS MATERIALIZED (SELECT complex_id, pose_id, t, dockq>={TH} AS pos, {"-(" + "+".join(f"t[{k + 1}]*({v}{D})" for k, v in enumerate(E0)) + ")"} AS s FROM pool_wide WHERE complex_id IN (SELECT complex_id FROM pool_wide GROUP BY 1 HAVING count(*) FILTER (dockq>={TH})>0 AND count(*) FILTER (dockq<{TH})>0)),
anc AS (SELECT complex_id, arg_max(pose_id, (s,-pose_id)) AS pose_id, arg_max(t, (s,-pose_id)) AS ta, max(s) AS sa FROM aff WHERE pos GROUP BY 1),
neg AS (SELECT complex_id, arg_max(t, (s,-pose_id)) AS tn, max(s) AS sn FROM aff WHERE NOT pos GROUP BY 1),
hg AS (SELECT complex_id, greatest(0.0{D}, sn-sa+1.0{D}) AS hinge, ta, tn, sn-sa+1.0{D}>0 AS act FROM anc JOIN neg USING (complex_id))"""


def affine(spark, sf):
    return fi.affine_pool(V.pool_wide(spark, sf), Weights(0.0, (0.0, 0.0, 0.0)))


@query("hinge_terms", f"WITH {AFF} SELECT complex_id, {r('hinge')} AS hinge FROM hg")
def hinge_terms(spark, sf):
    a = affine(spark, sf)
    return fi.hinge_terms(a, fi.anchors(a, E0), E0).select(C, rnd(F.col("hinge")).alias("hinge"))


@query("hinge_step", f"WITH {AFF} " + " UNION ALL ".join(f"SELECT {k}::INTEGER AS k, {r('avg(hinge)')} AS hinge, {r(f'avg(CASE WHEN act THEN ta[{k + 1}]-tn[{k + 1}] ELSE 0 END)')} AS slope FROM hg" for k in range(V.WIDE)))
def hinge_step(spark, sf):
    a = affine(spark, sf)
    h = fi.hinge_value(a, fi.anchors(a, E0), E0)
    return h.select("hinge", F.posexplode("slope").alias("k", "slope")).select("k", rnd(F.col("hinge")).alias("hinge"), rnd(F.col("slope")).alias("slope"))


@query("hinge_fit")
def hinge_fit(spark, sf):
    e, history = fi.hinge_fit(affine(spark, sf), E0, 0.1, tol=1e-4)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(history)], "step int, objective double")


@query("hinge_fit_steps", f"""WITH {AFF}, gv AS (SELECT [{", ".join(f"avg(CASE WHEN act THEN ta[{k + 1}]-tn[{k + 1}] ELSE 0 END)" for k in range(V.WIDE))}] AS g, avg(hinge) AS h FROM hg),
 e1 AS (SELECT g, h, [{", ".join(f"{v}{D}-g[{k + 1}]/0.1{D}" for k, v in enumerate(E0))}] AS e FROM gv),
 n1 AS (SELECT complex_id, max(-list_inner_product(t::DOUBLE[], e)) AS sn FROM aff, e1 WHERE NOT pos GROUP BY 1), a1 AS (SELECT complex_id, -list_inner_product(ta::DOUBLE[], e) AS sa FROM anc, e1)
 SELECT 0::INTEGER AS step, {r('h', 5)} AS objective FROM e1 UNION ALL SELECT 1, {r('h1+0.05*list_inner_product(g, g)/0.01', 5)} FROM e1, (SELECT avg(greatest(0.0{D}, sn-sa+1.0{D})) AS h1 FROM n1 JOIN a1 USING (complex_id))""")
def hinge_fit_steps(spark, sf):
    """The fit's first two evaluations: at the start, and at the minimum of its first plane."""
    _, history = fi.hinge_fit(affine(spark, sf), E0, 0.1, steps=2)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(history)], "step int, objective double")
    return rows.withColumn("objective", rnd(F.col("objective"), 5))


E1 = [v * 0.5 for v in E0]


@query("top1_table", f"""WITH {AFF}, b AS (SELECT complex_id, arg_max(pos, (s,-pose_id)) AS a, arg_min(pos, (s,pose_id)) AS c FROM aff GROUP BY 1)
 SELECT 'forward' AS setting, count(*) FILTER (a) AS top1, count(*) AS complexes FROM b UNION ALL SELECT 'reverse', count(*) FILTER (c), count(*) FROM b""")
def top1_table(spark, sf):
    return fi.top1_table(affine(spark, sf), {"forward": E0, "reverse": [-v for v in E0]})


@query("lambda_path_cv")
def lambda_path_cv(spark, sf):
    a = affine(spark, sf)
    folds = cluster_folds(a.select(C).distinct(), 3, 4, C)
    table, best = fi.lambda_path_cv(a, folds, E0, (0.01, 0.1, 1.0), 3, tol=1e-3)
    return table.withColumn("best", F.col("lam") == best)


@query("learning_curve")
def learning_curve(spark, sf):
    """Fitted on even complexes, judged on odd ones, lambda by cross-validation."""
    pool = V.pool(spark, sf)
    fit, val = pool.filter(F.col(C) % 2 == 0), pool.filter(F.col(C) % 2 == 1)
    folds = cluster_folds(fit.select(C).distinct(), 2, 4, C)
    families = {"shape": fi.Family(table=False, shape=True), "full+": fi.Family(shape=True)}
    return fi.learning_curve(fit, val, V.weights_a(), families, (2, 4), 2, (0.1, 1.0), folds, 2, tol=1e-2)


SHIFT = V.SCORED + f""",
sl AS (SELECT complex_id, pose_id, dockq, '0' AS condition, score_a AS s FROM scored UNION ALL SELECT complex_id, pose_id, dockq, '1', score_b FROM scored),
sz AS (SELECT *, (s-avg(s) OVER w)/greatest(stddev_pop(s) OVER w,1.0{D}) AS z, dockq>={TH} AS pos FROM sl WINDOW w AS (PARTITION BY condition, complex_id)),
sp AS (SELECT condition, complex_id, max(CASE WHEN pos THEN z END)-max(CASE WHEN NOT pos THEN z END) AS gap, arg_max(pos, (round(z,9),-pose_id)) AS ok, bool_or(pos) AS live FROM sz GROUP BY 1,2)"""


@query("ranking_shift", f"""WITH {SHIFT} SELECT a.condition, count(*) FILTER (a.live) AS live, count(*) FILTER (a.live AND a.ok) AS top1, {r('avg(CASE WHEN a.live THEN a.gap END)')} AS mean_gap, count(*) FILTER (a.live AND a.ok AND NOT b.ok) AS won, count(*) FILTER (a.live AND NOT a.ok AND b.ok) AS lost
 FROM sp a JOIN sp b ON b.complex_id=a.complex_id AND b.condition='0' GROUP BY 1""")
def ranking_shift(spark, sf):
    s = fi.ranking_shift(V.pool(spark, sf), {"0": V.weights_a(), "1": V.weights_b()})
    return s.select("condition", "live", "top1", rnd(F.col("mean_gap")).alias("mean_gap"), "won", "lost")


@query("virtual_step_report")
def virtual_step_report(spark, sf):
    """Small complexes (one per supplier and order slot), so that some lack a positive."""
    p = V.pool(spark, sf)
    order = F.floor(F.floor(F.col("pose_id") / 8) / 10000019)
    p = p.withColumn(C, F.col(C) * 50 + order % 50)
    return fi.virtual_step_report(p, _model(), (1, 2), lr=0.05, batch=200)


# --- term diagnostics -----------------------------------------------------------------------

TERMS = V.POOL + f""",
tt AS (SELECT complex_id, pose_id, dockq, round(0.75{D}*c_pair-(1.6875{D}*n_ss+2.53125{D}*n_sc+3.796875{D}*n_cc), 6) AS shape, round(-(2.0{D}*t[1]-1.5{D}*t[2]+0.25{D}*t[3]-0.125{D}*t[4]), 6) AS pair, round(3.0{D}*elec, 6) AS charge FROM pool)"""


def _terms(spark, sf):
    from posefarm.operators.scoring import term_columns
    t = term_columns(V.pool(spark, sf), V.weights_a())
    return t.select(C, "pose_id", "dockq", "c_pair", *[F.round(c, 6).alias(c) for c in ("shape", "pair", "charge")])


@query("term_discrimination", f"""WITH {TERMS}, lg AS (SELECT complex_id, dockq, 'shape' AS term, shape AS v FROM tt UNION ALL SELECT complex_id, dockq, 'pair', pair FROM tt UNION ALL SELECT complex_id, dockq, 'charge', charge FROM tt UNION ALL
   SELECT complex_id, dockq, 'sum', 1.0{D}*shape+2.0{D}*pair+0.5{D}*charge FROM tt),
 src AS (SELECT complex_id, term, v AS s, dockq>={TH} AS pos FROM lg), {AUC_SQL.format(k='complex_id, term', src='src')}
 SELECT complex_id, term, {r('mean_abs', 9)} AS mean_abs, {r('auc', 9)} AS auc, {r('1.0-auc', 9)} AS auc_flipped FROM auc JOIN (SELECT complex_id, term, avg(abs(v)) AS mean_abs FROM lg GROUP BY 1,2) USING (complex_id, term)""")
def term_discrimination(spark, sf):
    t = _terms(spark, sf)
    d = dg.term_discrimination(t, {k: F.col(k) for k in ("shape", "pair", "charge")}, None, {"sum": (1.0, 2.0, 0.5)})
    return d.select(C, "term", rnd(F.col("mean_abs"), 9).alias("mean_abs"), rnd(F.col("auc"), 9).alias("auc"), rnd(F.col("auc_flipped"), 9).alias("auc_flipped"))


@query("balanced_alpha", f"WITH {TERMS} SELECT complex_id, {r('avg(abs(pair))/greatest(avg(abs(shape)),1e-12)')} AS alpha_balanced FROM tt GROUP BY 1")
def balanced_alpha(spark, sf):
    return dg.balanced_alpha(_terms(spark, sf), F.col("shape"), F.col("pair")).withColumn("alpha_balanced", rnd(F.col("alpha_balanced")))


BAND = V.SCORED + f""",
bd AS (SELECT complex_id, greatest(min(CASE WHEN dockq>={TH} THEN c_pair END), min(CASE WHEN dockq<{TH} THEN c_pair END)) AS lo, least(max(CASE WHEN dockq>={TH} THEN c_pair END), max(CASE WHEN dockq<{TH} THEN c_pair END)) AS hi FROM scored GROUP BY 1),
bb AS (SELECT s.*, lo, hi FROM scored s JOIN bd USING (complex_id) WHERE c_pair BETWEEN lo AND hi), bs AS (SELECT complex_id, max(lo) AS band_lo, max(hi) AS band_hi, count(*) FILTER (dockq>={TH}) AS n_pos, count(*) FILTER (dockq<{TH}) AS n_neg FROM bb GROUP BY 1)"""


@query("matched_band_auc", f"""WITH {BAND}, src AS (SELECT complex_id, score_a AS s, dockq>={TH} AS pos FROM bb), {AUC_SQL.format(k='complex_id', src='src')}
 SELECT complex_id, band_lo, band_hi, n_pos, n_neg, CASE WHEN n_pos>=15 AND n_neg>=15 THEN {r('auc', 9)} END AS auc_score_a FROM bs LEFT JOIN auc USING (complex_id)""")
def matched_band_auc(spark, sf):
    m = dg.matched_band_auc(V.scored(spark, sf), "c_pair", ["score_a"])
    return m.withColumn("auc_score_a", rnd(F.col("auc_score_a"), 9))


@query("burial_separation", f"""WITH {V.POOL}, o AS (SELECT complex_id, c_pair AS v, dockq>={TH} AS pos, row_number() OVER (PARTITION BY complex_id, dockq>={TH} ORDER BY c_pair) AS i, count(*) OVER (PARTITION BY complex_id, dockq>={TH}) AS n FROM pool),
 e AS (SELECT complex_id, min(CASE WHEN pos THEN v END) AS lo, max(CASE WHEN pos THEN v END) AS hi, max(CASE WHEN NOT pos THEN v END) AS nhi, min(CASE WHEN NOT pos THEN v END) AS nlo, max(CASE WHEN pos AND i=(n-1)//2+1 THEN v END) AS mp, max(CASE WHEN NOT pos AND i=(n-1)//2+1 THEN v END) AS mn FROM o GROUP BY 1)
 SELECT complex_id, {r('avg((v BETWEEN lo AND hi)::INTEGER)')} AS inside, {r('max(CASE WHEN mn<>0 THEN mp/mn END)')} AS median_ratio, max((nhi<lo OR nlo>hi)::INTEGER) AS disjoint FROM o JOIN e USING (complex_id) WHERE NOT pos GROUP BY 1""")
def burial_separation(spark, sf):
    b = dg.burial_separation(V.pool(spark, sf), "c_pair")
    return b.select(C, rnd(F.col("inside")).alias("inside"), rnd(F.col("median_ratio")).alias("median_ratio"), "disjoint")
