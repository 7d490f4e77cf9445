"""Queries on scored pools: scoring, ranking, paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.operators import ranking as rk
from posefarm.operators import scoring as sc
from posefarm.operators import statistics as st
from posefarm.plans import views as V
from posefarm.plans.registry import query
from posefarm.plans.views import rnd
from posefarm.session import cut

C = "complex_id"
KS = fixed.KS
TH = "0.23::DOUBLE"


def r(x: str, d: int = 6) -> str:
    return f"(round({x}, {d}) + 0.0::DOUBLE)"


# --- scoring -----------------------------------------------------------------

@query("linear_score", f"WITH {V.POOL} SELECT complex_id, pose_id, {r(V.SCORE_A)} AS score_a, {r(V.SCORE_B)} AS score_b FROM pool")
def linear_score(spark, sf):
    df = V.scored(spark, sf)
    return df.select(C, "pose_id", rnd(F.col("score_a")).alias("score_a"), rnd(F.col("score_b")).alias("score_b"))


WIDE_W = [((k * 7) % 11 - 5) / 8.0 for k in range(V.WIDE)]
WIDE_SUM = "+".join(f"t[{k + 1}]*({w}::DOUBLE)" for k, w in enumerate(WIDE_W))


@query("linear_score_wide", f"WITH {V.POOL_WIDE} SELECT complex_id, pose_id, {r(f'-({WIDE_SUM})')} AS score FROM pool_wide")
def linear_score_wide(spark, sf):
    w = sc.Weights(0.0, (0.0, 0.0, 0.0), tuple(WIDE_W))
    return sc.linear_score(V.pool_wide(spark, sf), w).select(C, "pose_id", rnd(F.col("score")).alias("score"))


K_VOL = (1.3 / 1.2) ** 3


@query("shape_score_volume", f"""WITH {V.POOL} SELECT complex_id, pose_id,
  {r(f"0.75::DOUBLE*c_pair - {K_VOL!r}::DOUBLE*(1.6875::DOUBLE*n_ss + 2.53125::DOUBLE*n_sc + 3.796875::DOUBLE*n_cc)")} AS clash_only,
  {r(f"{K_VOL!r}::DOUBLE*(0.75::DOUBLE*c_pair - (1.6875::DOUBLE*n_ss + 2.53125::DOUBLE*n_sc + 3.796875::DOUBLE*n_cc))")} AS whole_term FROM pool""")
def shape_score_volume(spark, sf):
    p = V.pool(spark, sf)
    k = sc.volume_factor(1.3)
    w = sc.Weights(V.ALPHA, sc.clash_weights(V.ALPHA, V.RHO))
    return p.select(C, "pose_id", rnd(sc.shape_score(w, k)).alias("clash_only"), rnd(sc.shape_score(w, k, True)).alias("whole_term"))


@query("term_table", f"""WITH {V.POOL}, terms AS (SELECT complex_id, pose_id, 0.75::DOUBLE*c_pair AS fav,
   -(1.6875::DOUBLE*n_ss + 2.53125::DOUBLE*n_sc + 3.796875::DOUBLE*n_cc) AS clash,
   -(2.0::DOUBLE*t[1] - 1.5::DOUBLE*t[2] + 0.25::DOUBLE*t[3] - 0.125::DOUBLE*t[4]) AS pair, 3.0::DOUBLE*elec AS charge FROM pool)
 SELECT complex_id, count(*) AS n, {r('avg(fav)')} AS fav, {r('avg(clash)')} AS clash, {r('avg(fav+clash)')} AS shape, {r('avg(pair)')} AS pair,
   {r('avg(charge)')} AS charge, {r('avg(fav+clash+pair+charge)')} AS total FROM terms GROUP BY complex_id""")
def term_table(spark, sf):
    t = sc.term_columns(V.pool(spark, sf), V.weights_a())
    return t.groupBy(C).agg(F.count(F.lit(1)).alias("n"), *[rnd(F.avg(c)).alias(c) for c in ("fav", "clash", "shape", "pair", "charge", "total")])


@query("standardize", f"""WITH {V.SCORED}, m AS (SELECT complex_id, avg(score_a) AS mu, stddev_pop(score_a) AS sp, stddev_samp(score_a) AS ss FROM scored GROUP BY 1)
 SELECT complex_id, pose_id, {r('(score_a-mu)/greatest(sp,1.0::DOUBLE)')} AS z, {r('(score_a-mu)/greatest(ss,1e-8::DOUBLE)')} AS z_sample
 FROM scored JOIN m USING (complex_id)""")
def standardize(spark, sf):
    z = sc.standardize(V.scored(spark, sf).select(C, "pose_id", "score_a"), "score_a", "z")
    z = sc.standardize(z, "score_a", "z_sample", floor=1e-8, sample=True)
    return z.select(C, "pose_id", rnd(F.col("z")).alias("z"), rnd(F.col("z_sample")).alias("z_sample"))


@query("parameter_free_rankers", f"""WITH {V.POOL}, b AS (SELECT complex_id, dockq, row_number() OVER (PARTITION BY complex_id ORDER BY round(t[1]+t[2]+t[3]+t[4],6) DESC, pose_id) AS rc,
   row_number() OVER (PARTITION BY complex_id ORDER BY c_pair DESC, pose_id) AS rs, row_number() OVER (PARTITION BY complex_id ORDER BY elec DESC, pose_id) AS re FROM pool)
 SELECT count(*) FILTER (rc=1 AND dockq>={TH}) AS contacts, count(*) FILTER (rs=1 AND dockq>={TH}) AS shape, count(*) FILTER (re=1 AND dockq>={TH}) AS charge, count(DISTINCT complex_id) AS n FROM b""")
def parameter_free_rankers(spark, sf):
    p = sc.parameter_free_rankers(V.pool(spark, sf)).withColumn("rank_contacts", F.round("rank_contacts", 6))
    pos = F.col("dockq") >= 0.23
    top = p.groupBy(C).agg(*[F.max_by(pos, F.struct(f"rank_{n}", -F.col("pose_id"))).alias(n) for n in ("contacts", "shape", "charge")])
    return top.agg(*[F.count_if(n).alias(n) for n in ("contacts", "shape", "charge")], F.count(F.lit(1)).alias("n"))


def _block_rows(size: int):
    return sc.additive_basis(size), sc.symmetric_additive_basis(size)


@query("affine_features", f"""WITH {V.POOL_WIDE}, e AS (SELECT complex_id, pose_id, {", ".join(f"({'+'.join(f't[{k + 1}]' for k in range(64) if k // 8 == i)})/sqrt(8.0::DOUBLE) AS f{i}" for i in range(8))} FROM pool_wide)
 SELECT complex_id, pose_id, {", ".join(r(f"f{i}") + f" AS f{i}" for i in range(8))}, {r("(" + "+".join(f"f{i}*f{i}" for i in range(8)) + ")")} AS energy FROM e""")
def affine_features(spark, sf):
    rows, _ = _block_rows(8)
    df = sc.affine_features(V.pool_wide(spark, sf), rows[:8])
    energy = F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v)
    return df.select(C, "pose_id", *[rnd(F.col("features")[i]).alias(f"f{i}") for i in range(8)], rnd(energy).alias("energy"))


@query("size_bucket_features", f"""WITH {V.POOL}, s AS (SELECT *, CASE WHEN c_pair > 35 THEN 2 WHEN c_pair > 15 THEN 1 ELSE 0 END AS b FROM pool)
 SELECT complex_id, b AS bucket, count(*) AS n, {", ".join(r(f"sum(CASE WHEN b={k // 4} THEN t[{k % 4 + 1}] ELSE 0 END)", 4) + f" AS f{k}" for k in range(12))} FROM s GROUP BY ALL""")
def size_bucket_features(spark, sf):
    df = sc.size_bucket_features(V.pool(spark, sf), (15.0, 35.0), "c_pair")
    return df.groupBy(C, "bucket").agg(F.count(F.lit(1)).alias("n"), *[rnd(F.sum(F.col("features")[k]), 4).alias(f"f{k}") for k in range(12)])


# --- ranking -----------------------------------------------------------------

def ranked_sql(score: str = "score_a") -> str:
    return V.SCORED + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY {score} DESC, pose_id) AS rank FROM scored)"""


REPORT_SQL = ranked_sql() + f""",
report AS (SELECT complex_id, count(*) AS n, count(*) FILTER (rmsd<=5) AS n_hit_rmsd, count(*) FILTER (dockq>={TH}) AS n_hit_q,
  {", ".join(f"max(CASE WHEN rank<={k} THEN (rmsd<=5)::INTEGER END) AS success_rmsd_{k}" for k in KS)},
  {", ".join(f"max(CASE WHEN rank<={k} THEN (dockq>={TH})::INTEGER END) AS success_q_{k}" for k in KS)},
  {", ".join(f"max(CASE WHEN rank<={k} THEN dockq END) AS best_q_{k}" for k in KS)},
  {", ".join(f"min(CASE WHEN rank<={k} THEN rmsd END) AS min_rmsd_{k}" for k in KS)},
  arg_max(rank, (dockq, -pose_id)) AS rank_best_q, arg_min(rank, (rmsd, pose_id)) AS rank_best_rmsd
 FROM ranked GROUP BY complex_id)"""


def _scored(spark, sf):
    return V.scored(spark, sf).withColumn("score", F.col("score_a"))


def _report(spark, sf):
    return rk.ranking_report(_scored(spark, sf))


@query("ranking_report", f"WITH {REPORT_SQL} SELECT * FROM report")
def ranking_report(spark, sf):
    return _report(spark, sf)


AUC_SQL = """
auc AS (SELECT {k}, CASE WHEN np>0 AND nn>0 THEN (sr - np*(np+1)/2.0::DOUBLE)/(np*nn) END AS auc FROM (
  SELECT {k}, sum(CASE WHEN pos THEN mid ELSE 0 END) AS sr, count(*) FILTER (pos)::DOUBLE AS np, count(*) FILTER (NOT pos)::DOUBLE AS nn FROM (
    SELECT {k}, pos, rank() OVER (PARTITION BY {k} ORDER BY s) + (count(*) OVER (PARTITION BY {k}, s) - 1)/2.0::DOUBLE AS mid FROM {src}) GROUP BY {k}))"""


@query("auc_midrank", f"""WITH {V.SCORED}, src AS (SELECT complex_id, score_a AS s, dockq>={TH} AS pos FROM scored),
 {AUC_SQL.format(k='complex_id', src='src')} SELECT complex_id, {r('auc', 9)} AS auc FROM auc""")
def auc_midrank(spark, sf):
    return rk.auc_midrank(_scored(spark, sf)).select(C, rnd(F.col("auc"), 9).alias("auc"))


FIRST_SQL = f"""
first_hit AS (SELECT complex_id, n, f AS first_hit, f/n::DOUBLE AS frac FROM (
   SELECT complex_id, count(*) AS n, coalesce(min(CASE WHEN dockq>={TH} THEN rank END), count(*)+1) AS f FROM ranked GROUP BY complex_id))"""


@query("first_hit", f"WITH {ranked_sql()}, {FIRST_SQL} SELECT complex_id, n, first_hit, {r('frac', 9)} AS first_hit_frac FROM first_hit")
def first_hit(spark, sf):
    return rk.first_hit(_scored(spark, sf)).withColumn("first_hit_frac", rnd(F.col("first_hit_frac"), 9))


@query("summarise_metrics", f"""WITH {V.CONDITIONS}, o AS (SELECT condition, metric, row_number() OVER (PARTITION BY condition ORDER BY metric) AS i, count(*) OVER (PARTITION BY condition) AS n FROM conditions)
 SELECT condition, max(n) AS n, {r('avg(metric)')} AS mean, {r('stddev_samp(metric)')} AS sd, {r('max(CASE WHEN i = n//2+1 THEN metric END)')} AS median FROM o GROUP BY condition""")
def summarise_metrics(spark, sf):
    s = rk.summarise_metrics(V.conditions(spark, sf), "metric")
    return s.select("condition", "n", *[rnd(F.col(c)).alias(c) for c in ("mean", "sd", "median")])


@query("aggregate_success", f"""WITH {REPORT_SQL} SELECT count(*) AS n_complexes, {", ".join(r(f"avg(success_q_{k})") + f" AS success_{k}" for k in KS)}, {r("avg(best_q_1)")} AS mean_best_q FROM report""")
def aggregate_success(spark, sf):
    s = rk.aggregate_success(_scored(spark, sf))
    return s.select("n_complexes", *[rnd(F.col(f"success_{k}")).alias(f"success_{k}") for k in KS], rnd(F.col("mean_best_q")).alias("mean_best_q"))


@query("success_rates", f"""WITH {REPORT_SQL} SELECT count(*) AS n_complexes, {", ".join(r(f"avg(success_q_{k})") + f" AS success_{k}" for k in KS)},
  {r("avg(best_q_1)")} AS mean_best_q_1, {r("avg((n_hit_q>0)::INTEGER)")} AS with_positive FROM report""")
def success_rates(spark, sf):
    s = rk.success_rates(_report(spark, sf))
    return s.select("n_complexes", *[rnd(F.col(c)).alias(c) for c in s.columns[1:]])


SEARCH_METRICS = f"""
sm AS (SELECT r.complex_id, max(dockq) AS ceiling, max(CASE WHEN rank<=20 THEN dockq END) AS best_q, min(CASE WHEN dockq>={TH} THEN rank END) AS first_hit, min(rmsd) AS angle
  FROM ranked r GROUP BY 1)"""


@query("search_summary", f"""WITH {ranked_sql()}, {SEARCH_METRICS} SELECT count(*) AS n, {r(f"avg((ceiling>={TH})::INTEGER)")} AS ceiling_fraction, {r(f"avg((best_q>={TH})::INTEGER)")} AS recall,
  {", ".join(r(f"avg((best_q>={TH} AND first_hit<={k})::INTEGER)") + f" AS success_{k}" for k in KS)},
  {", ".join(r(f"avg(CASE WHEN best_q>={TH} THEN (first_hit<={k})::INTEGER END)") + f" AS success_given_recall_{k}" for k in KS)},
  {r("avg(best_q)")} AS mean_best_q, {r("avg(angle)")} AS mean_angle FROM sm""")
def search_summary(spark, sf):
    p = _scored(spark, sf)
    first = rk.first_hit(p).select(C, "first_hit")
    from posefarm.functions.ordering import top_k
    best = top_k(p, C, [F.col("score").desc(), F.col("pose_id")], 20).groupBy(C).agg(F.max("dockq").alias("best_q"))
    m = p.groupBy(C).agg(F.max("dockq").alias("ceiling"), F.min("rmsd").alias("angle")).join(first, C).join(best, C)
    s = rk.search_summary(m)
    return s.select("n", *[rnd(F.col(c)).alias(c) for c in s.columns[1:]])


@query("rank_bands", f"""WITH {ranked_sql()}, h AS (SELECT complex_id, min(CASE WHEN dockq>={TH} AND prov=0 THEN rank END) AS f FROM ranked GROUP BY 1),
  c AS (SELECT unnest([1,5,10,50,100])::INTEGER AS cut), w AS (SELECT cut, count(*) FILTER (f<=cut) AS within, count(*) AS n, count(f) AS reachable FROM h CROSS JOIN c GROUP BY cut)
 SELECT cut, within, (within - coalesce(lag(within) OVER (ORDER BY cut),0))::BIGINT AS gained, n, reachable, reachable-within AS not_retrieved FROM w""")
def rank_bands(spark, sf):
    p = _scored(spark, sf)
    hit = (F.col("dockq") >= 0.23) & (F.col("prov") == 0)
    h = rk.first_hit(p, "score", hit).select(C, F.when(F.col("first_hit") <= F.col("n"), F.col("first_hit")).alias("first_hit"))
    return rk.rank_bands(h).withColumn("gained", F.col("gained").cast("long"))


# Decoy tables: one system per part, with ranks and classes read from lineitem.
DECOYS = """
decoys AS (SELECT l_partkey AS id, 'pose_' || l_orderkey || '_' || (l_orderkey % 40 + 1) AS name, CASE WHEN l_linenumber > 2 THEN (l_orderkey % 40 + 1)::INTEGER END AS rank,
   q AS dockq, CASE WHEN q>=0.80::DOUBLE THEN 3 WHEN q>=0.49::DOUBLE THEN 2 WHEN q>={TH} THEN 1 ELSE 0 END AS tier,
   CASE WHEN l_returnflag='R' THEN 'after' ELSE 'before' END AS condition, l_linenumber AS ln, l_linestatus AS ls, l_returnflag AS rf FROM (
   SELECT *, u*u*u*u AS q FROM (SELECT *, ((l_partkey * 31 + l_orderkey * 17) % 1000)::DOUBLE / 1000.0::DOUBLE AS u FROM lineitem)))""".replace("{TH}", TH)


def decoys(spark, sf):
    from posefarm.operators.quality import quality_tier
    li = V.table(spark, sf, "lineitem")
    u = F.pmod(F.col("l_partkey") * 31 + F.col("l_orderkey") * 17, F.lit(1000)) / F.lit(1000.0)
    place = F.col("l_orderkey") % 40 + 1
    d = li.select(F.col("l_partkey").alias("id"), F.concat(F.lit("pose_"), F.col("l_orderkey"), F.lit("_"), place).alias("name"),
                  F.when(F.col("l_linenumber") > 2, place.cast("int")).alias("rank"), (u * u * u * u).alias("dockq"),
                  F.when(F.col("l_returnflag") == "R", "after").otherwise("before").alias("condition"), F.col("l_linenumber").alias("ln"),
                  F.col("l_linestatus").alias("ls"), F.col("l_returnflag").alias("rf"))
    return d.withColumn("tier", quality_tier(F.col("dockq")))


def _systems(spark, sf):
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


BEST_SQL = DECOYS + """,
ranked_decoys AS (SELECT *, coalesce(rank, regexp_extract(name, '(\\d+)$', 1)::INTEGER) AS rk FROM decoys),
best AS (SELECT coalesce(p.p_partkey, b.id) AS id, c.condition, coalesce(dockq, 0) AS dockq, coalesce(tier, 0) AS tier FROM
  (SELECT unnest(['before','after']) AS condition) c CROSS JOIN part p LEFT JOIN
  (SELECT id, condition, max(dockq) AS dockq, max(tier) AS tier FROM ranked_decoys WHERE rk<=10 GROUP BY 1,2) b ON p.p_partkey=b.id AND b.condition=c.condition)"""


@query("top_k_max", f"WITH {BEST_SQL} SELECT id, dockq, tier FROM best WHERE condition='before'")
def top_k_max(spark, sf):
    return rk.top_k_max(decoys(spark, sf).filter(F.col("condition") == "before"), _systems(spark, sf), 10)


def _before_after(spark, sf):
    d, s = decoys(spark, sf), _systems(spark, sf)
    return tuple(rk.top_k_max(d.filter(F.col("condition") == c), s, 10) for c in ("before", "after"))


@query("class_transitions", f"""WITH {BEST_SQL}, w AS (SELECT b.id, b.tier AS t0, a.tier AS t1, a.dockq AS q1, CASE WHEN b.id%3=0 THEN 'x' ELSE 'y' END AS cohort FROM best b JOIN best a ON a.id=b.id AND a.condition='after' WHERE b.condition='before'),
  l AS (SELECT w.*, level FROM w CROSS JOIN (SELECT unnest([1,2,3])::INTEGER AS level))
 SELECT cohort, level, count(*) AS n, {r("avg((t0>=level)::INTEGER)")} AS before, {r("avg((t1>=level)::INTEGER)")} AS after, count(*) FILTER (t0<level AND t1>=level) AS won,
   count(*) FILTER (t0>=level AND t1<level) AS lost, count(*) FILTER (level=1 AND t0<1 AND t1>=1 AND abs(q1-{TH})<0.05::DOUBLE) AS near FROM l GROUP BY ALL""")
def class_transitions(spark, sf):
    b, a = _before_after(spark, sf)
    cohort = _systems(spark, sf).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("cohort"))
    t = rk.class_transitions(b, a, cohort)
    return t.withColumn("before", rnd(F.col("before"))).withColumn("after", rnd(F.col("after")))


@query("changed_systems", f"WITH {BEST_SQL} SELECT b.id, b.tier AS tier_before, a.tier AS tier_after FROM best b JOIN best a ON a.id=b.id AND a.condition='after' WHERE b.condition='before' AND a.tier<>b.tier")
def changed_systems(spark, sf):
    return rk.changed_systems(*_before_after(spark, sf))


GAP_SQL = V.SCORED + f""",
g AS (SELECT complex_id, (bn-bp)/sd AS gap, (bp-wp)/sd AS spread, above FROM (SELECT s.complex_id, max(bn) AS bn, max(bp) AS bp, max(wp) AS wp, max(sd) AS sd, count(*) FILTER (dockq<{TH} AND score_a>bp) AS above
  FROM scored s JOIN (SELECT complex_id, max(CASE WHEN dockq<{TH} THEN score_a END) AS bn, max(CASE WHEN dockq>={TH} THEN score_a END) AS bp, min(CASE WHEN dockq>={TH} THEN score_a END) AS wp,
    stddev_samp(score_a) AS sd FROM scored GROUP BY 1) m USING (complex_id) GROUP BY 1))"""


@query("rank_gap", f"WITH {GAP_SQL} SELECT complex_id, {r('gap')} AS gap, {r('spread')} AS spread, above FROM g")
def rank_gap(spark, sf):
    g = rk.rank_gap(_scored(spark, sf))
    return g.select(C, rnd(F.col("gap")).alias("gap"), rnd(F.col("spread")).alias("spread"), "above")


@query("rank_gap_quantiles", f"""WITH {GAP_SQL}, m AS (SELECT gap, row_number() OVER (ORDER BY gap) AS i, count(*) OVER () AS n FROM g WHERE gap>0)
 SELECT count(*) AS missed, count(*) FILTER (gap<=0.25) AS within_0, count(*) FILTER (gap<=0.5) AS within_1, count(*) FILTER (gap<=1.0) AS within_2,
  {", ".join(r(f"max(CASE WHEN i=least(n-1, floor({q}::DOUBLE*n)::BIGINT)+1 THEN gap END)") + f" AS q{k}" for k, q in enumerate((0.25, 0.5, 0.75)))} FROM m""")
def rank_gap_quantiles(spark, sf):
    s = rk.gap_quantiles(rk.rank_gap(_scored(spark, sf)))
    return s.select("missed", "within_0", "within_1", "within_2", *[rnd(F.col(f"q{k}")).alias(f"q{k}") for k in range(3)])


@query("top1_given_reachable", f"""WITH {ranked_sql()}, {FIRST_SQL}, h AS (SELECT first_hit, row_number() OVER (ORDER BY first_hit) AS i, count(*) OVER () AS m FROM first_hit WHERE first_hit<=n)
 SELECT (SELECT count(*) FROM first_hit) AS n, count(*) AS reachable, count(*) FILTER (first_hit=1) AS top1, max(CASE WHEN i=m//2+1 THEN first_hit END) AS median_rank FROM h""")
def top1_given_reachable(spark, sf):
    return rk.top1_given_reachable(_scored(spark, sf))


@query("oracle_at_k", f"""WITH {BEST_SQL}, p AS (SELECT condition, id, {", ".join(f"coalesce(max(CASE WHEN rk<={k} THEN dockq END),0) AS b{k}" for k in (1, 5, 50))} FROM ranked_decoys GROUP BY 1,2)
 SELECT condition, count(*) AS n, {", ".join(r(f"avg((b{k}>={TH})::INTEGER)") + f" AS oracle_{k}" for k in (1, 5, 50))} FROM p GROUP BY 1""")
def oracle_at_k(spark, sf):
    d = decoys(spark, sf).withColumn("rank", F.coalesce("rank", rk.name_rank(F.col("name"))))
    o = rk.oracle_at_k(d)
    return o.select("condition", "n", *[rnd(F.col(f"oracle_{k}")).alias(f"oracle_{k}") for k in (1, 5, 50)])


@query("leaderboard", f"""WITH {BEST_SQL}, d AS (SELECT *, rf AS method, ln=7 AS pen FROM ranked_decoys), tot AS (SELECT count(*)::DOUBLE AS total FROM part),
  p AS (SELECT method, id, {", ".join(f"coalesce(max(CASE WHEN rk<={k} AND NOT pen THEN tier END),0) AS t{k}" for k in (1, 5))}, count(*) FILTER (pen) AS pens, count(*) FILTER (NOT pen) AS reals FROM d GROUP BY 1,2),
  c AS (SELECT method, {", ".join(f"count(*) FILTER (tier={t}) AS class_{t}" for t in range(4))} FROM d WHERE NOT pen GROUP BY 1)
 SELECT c.*, {", ".join(r(f"hits_{k}/total") + f" AS hit_rate_{k}" for k in (1, 5))}, penalties::BIGINT AS penalties, (total - seen)::BIGINT AS missing FROM c JOIN
  (SELECT method, {", ".join(f"count(*) FILTER (t{k}>=1) AS hits_{k}" for k in (1, 5))}, sum(pens) AS penalties, count(*) FILTER (reals>0) AS seen FROM p GROUP BY 1) USING (method) CROSS JOIN tot""")
def leaderboard(spark, sf):
    d = decoys(spark, sf).withColumn("rank", F.coalesce("rank", rk.name_rank(F.col("name")))).withColumn("method", F.col("rf"))
    d = d.withColumn("name", F.when(F.col("ln") == 7, F.concat("name", F.lit("_missing_decoy"))).otherwise(F.col("name")))
    out = rk.leaderboard(d, _systems(spark, sf))
    return out.select("method", *[f"class_{t}" for t in range(4)], *[rnd(F.col(f"hit_rate_{k}")).alias(f"hit_rate_{k}") for k in (1, 5)], "penalties", "missing")


# --- paired statistics ----------------------------------------------------------

PAIRS = V.CONDITIONS + """,
pairs AS (SELECT a.complex_id, a.metric AS a, b.metric AS b, round(b.metric-a.metric, 9) AS d, a.success AS a_ok, b.success AS b_ok FROM conditions a JOIN conditions b USING (complex_id)
  WHERE a.condition='click' AND b.condition='purchase')"""


def pairs(spark, sf):
    p = st.pair_conditions(V.conditions(spark, sf), "click", "purchase", "metric", "success").filter(~F.col("dropped"))
    return p.withColumn("d", F.round("d", 9))


@query("pair_conditions", f"WITH {PAIRS} SELECT complex_id, a, b, {r('d', 9)} AS d, a_ok, b_ok, false AS dropped FROM pairs")
def pair_conditions(spark, sf):
    p = st.pair_conditions(V.conditions(spark, sf), "click", "purchase", "metric", "success")
    return p.withColumn("d", rnd(F.col("d"), 9))


@query("mcnemar_exact", f"""WITH {PAIRS}, c AS (SELECT count(*) FILTER (a_ok=0 AND b_ok=1) AS b01, count(*) FILTER (a_ok=1 AND b_ok=0) AS b10 FROM pairs),
  t AS (SELECT b01, b10, b01+b10 AS n, least(b01,b10) AS k FROM c)
 SELECT b01, b10, {r("CASE WHEN n=0 THEN 1.0 ELSE least(1.0::DOUBLE, 2*(SELECT sum(exp(lgamma(n+1.0)-lgamma(i+1.0)-lgamma(n-i+1.0)-n*ln(2.0))) FROM (SELECT unnest(range(0, (k+1)::BIGINT)) AS i))) END")} AS p FROM t""")
def mcnemar_exact(spark, sf):
    return st.mcnemar_exact(pairs(spark, sf)).withColumn("p", rnd(F.col("p")))


def wilcoxon_sql(src: str) -> str:
    return f"""wd AS (SELECT d, abs(d) AS m FROM {src} WHERE d<>0), wr AS (SELECT d, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m)-1)/2.0::DOUBLE AS mid FROM wd),
 wt AS (SELECT count(*) AS n, sum(CASE WHEN d>0 THEN mid ELSE 0 END) AS w_plus, sum(CASE WHEN d<0 THEN mid ELSE 0 END) AS w_minus FROM wr)"""


@query("wilcoxon_signed_rank", f"""WITH {PAIRS}, {wilcoxon_sql('pairs')} SELECT n, w_plus, w_minus, least(w_plus,w_minus) AS w,
  {r("(abs(least(w_plus,w_minus) - n*(n+1)/4.0::DOUBLE) - 0.5::DOUBLE)/sqrt(n*(n+1)*(2*n+1)/24.0::DOUBLE)")} AS z FROM wt""")
def wilcoxon_signed_rank(spark, sf):
    return st.wilcoxon_signed_rank(pairs(spark, sf)).select("n", "w_plus", "w_minus", "w", rnd(F.col("z")).alias("z"))


@query("paired_t", f"WITH {PAIRS} SELECT count(d) AS n, {r('avg(d)')} AS mean, {r('avg(d)/sqrt(var_samp(d)/count(d))')} AS t FROM pairs")
def paired_t(spark, sf):
    t = st.paired_t(pairs(spark, sf))
    return t.select("n", rnd(F.col("mean")).alias("mean"), rnd(F.col("t")).alias("t"))


N_BOOT = 200


def boot_sql(src: str, column: str, key: str, seed: int, n_boot: int) -> str:
    return f"""numbered AS (SELECT {column} AS v, row_number() OVER (ORDER BY {key}) AS pos, count(*) OVER () AS n FROM {src}),
 draws AS (SELECT boot, {V.mix2_sql('boot', 'pos', seed)} % n + 1 AS pick FROM numbered CROSS JOIN (SELECT unnest(range(0,{n_boot})) AS boot)),
 boots AS (SELECT boot, sum(v)/count(*) AS m FROM draws JOIN (SELECT pos, v FROM numbered) x ON x.pos=draws.pick GROUP BY boot)"""


@query("bootstrap_ci", f"""WITH {PAIRS}, {boot_sql('pairs', 'd', 'complex_id', 7, N_BOOT)}, o AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM boots)
 SELECT {r(f"max(CASE WHEN i={int(.025 * N_BOOT) + 1} THEN m END)")} AS low, {r(f"max(CASE WHEN i={int(.975 * N_BOOT) + 1} THEN m END)")} AS high FROM o""")
def bootstrap_ci(spark, sf):
    ci = st.bootstrap_ci(pairs(spark, sf), n_boot=N_BOOT, seed=7)
    return ci.select(rnd(F.col("low")).alias("low"), rnd(F.col("high")).alias("high"))


CELLS = V.CONDITIONS + """,
cells AS (SELECT complex_id AS id, round((tap-bap)-(tho-bho), 9) AS contrast, bap, bho, tap, tho FROM (SELECT complex_id, max(CASE WHEN condition='click' THEN metric END) AS bap,
  max(CASE WHEN condition='view' THEN metric END) AS bho, max(CASE WHEN condition='purchase' THEN metric END) AS tap, max(CASE WHEN condition='signup' THEN metric END) AS tho
  FROM conditions GROUP BY 1) WHERE bap IS NOT NULL AND bho IS NOT NULL AND tap IS NOT NULL AND tho IS NOT NULL)"""


def _cells(spark, sf):
    names = {"click": ("base", "apo"), "view": ("base", "holo"), "purchase": ("test", "apo"), "signup": ("test", "holo")}
    c = V.conditions(spark, sf).filter(F.col("condition").isin(*names))
    method, setting = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (m, s) in names.items():
        method = F.when(F.col("condition") == k, m).otherwise(method)
        setting = F.when(F.col("condition") == k, s).otherwise(setting)
    return c.select(F.col("complex_id").alias("id"), method.alias("method"), setting.alias("setting"), F.col("metric").alias("value"))


@query("interaction_contrast", f"""WITH {CELLS}, {boot_sql('cells', 'contrast', 'id', 3, N_BOOT)}, o AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM boots),
  c AS (SELECT count(*) AS n, avg(contrast) AS contrast, count(*) FILTER (tap>bap) AS won_apo, count(*) FILTER (tho>bho) AS won_holo, count(*) FILTER (tap<bap) AS lost_apo, count(*) FILTER (tho<bho) AS lost_holo FROM cells)
 SELECT n, {r('contrast')} AS contrast, won_apo, won_holo, lost_apo, lost_holo, {r('avg((m<0)::INTEGER)')} AS p_negative, {r(f"max(CASE WHEN i={int(.025 * N_BOOT) + 1} THEN m END)")} AS low,
  {r(f"max(CASE WHEN i={int(.975 * N_BOOT) + 1} THEN m END)")} AS high FROM o CROSS JOIN c GROUP BY ALL""")
def interaction_contrast(spark, sf):
    d = _cells(spark, sf)
    out = st.interaction_contrast(d, n_boot=N_BOOT, seed=3)
    return out.select("n", rnd(F.col("contrast")).alias("contrast"), "won_apo", "won_holo", "lost_apo", "lost_holo",
                      *[rnd(F.col(c)).alias(c) for c in ("p_negative", "low", "high")])


# One test per user: how the share of large values differs between two event types.
TESTS = """
tests AS (SELECT user_id AS id, 1.0::DOUBLE/(1+count(*)) + (user_id%97)::DOUBLE/100000 AS p FROM events GROUP BY 1)"""


def _tests(spark, sf):
    e = V.table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("id")).agg((1.0 / (1 + F.count(F.lit(1)))).alias("_p")).select(
        "id", (F.col("_p") + (F.col("id") % 97).cast("double") / 100000).alias("p"))


HOLM_SQL = TESTS + """, h AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS m FROM tests)"""


@query("holm_adjust", f"WITH {HOLM_SQL} SELECT id, {r('p', 9)} AS p, {r('least(1.0::DOUBLE, p*(m-i+1))')} AS p_adj FROM h")
def holm_adjust(spark, sf):
    return st.holm_adjust(_tests(spark, sf)).select("id", rnd(F.col("p"), 9).alias("p"), rnd(F.col("p_adj")).alias("p_adj"))


@query("holm_monotone", f"WITH {HOLM_SQL} SELECT id, {r('max(least(1.0::DOUBLE, p*(m-i+1))) OVER (ORDER BY i)')} AS p_adj FROM h")
def holm_monotone(spark, sf):
    return st.holm_adjust(_tests(spark, sf), monotone=True).select("id", rnd(F.col("p_adj")).alias("p_adj"))


RUNS = """
runs AS (SELECT event_type AS condition, (event_id % 5)::INTEGER AS seed, avg(value) AS value, min(value)/1000.0::DOUBLE AS p, count(*) FILTER (value>30) AS won, count(*) FILTER (value<5) AS lost, (event_id%2)::INTEGER AS half
  FROM events GROUP BY ALL)"""


def _runs(spark, sf):
    e = V.table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("condition"), (F.col("event_id") % 5).cast("int").alias("seed"), (F.col("event_id") % 2).cast("int").alias("half")).agg(
        F.avg("value").alias("value"), (F.min("value") / 1000.0).alias("p"), F.count_if(F.col("value") > 30).alias("won"), F.count_if(F.col("value") < 5).alias("lost"))


@query("seed_summary", f"WITH {RUNS} SELECT condition, count(*) AS seeds, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS sd, {r('max(p)')} AS p, {r('avg(won)')} AS won, {r('avg(lost)')} AS lost FROM runs GROUP BY 1")
def seed_summary(spark, sf):
    s = st.seed_summary(_runs(spark, sf))
    return s.select("condition", "seeds", *[rnd(F.col(c)).alias(c) for c in ("mean", "sd", "p", "won", "lost")])


@query("factor_table", f"WITH {RUNS} SELECT condition, half, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS sd FROM runs GROUP BY CUBE (condition, half)")
def factor_table(spark, sf):
    s = st.factor_table(_runs(spark, sf), "condition", "half")
    return s.select("condition", "half", "n", rnd(F.col("mean")).alias("mean"), rnd(F.col("sd")).alias("sd"))


@query("pool_invariance", f"""WITH {V.SCORED}, o AS (SELECT * FROM scored WHERE NOT (prov=1 AND dockq<{TH} AND round=1)), n AS (SELECT * EXCLUDE (score_a), score_a + CASE WHEN round=1 THEN 0.5::DOUBLE ELSE 0 END AS score_a FROM scored),
 rows_ AS (SELECT n.complex_id, count(o.pose_id) AS n_old, count(*) AS n_new, count(o.pose_id) AS shared, count(*) FILTER (o.dockq>={TH}) AS pos_old, count(*) FILTER (n.dockq>={TH}) AS pos_new, count(*) FILTER (n.dockq>={TH} AND n.prov=0) AS pos_new_searched,
   max(CASE WHEN o.pose_id IS NOT NULL THEN greatest(abs(o.score_a-n.score_a),0.0::DOUBLE) END) AS max_gap, count(*) FILTER (o.pose_id IS NOT NULL AND o.score_a=n.score_a) AS identical,
   (arg_max(o.pose_id, (o.score_a, -o.pose_id)) = arg_max(n.pose_id, (n.score_a, -n.pose_id)))::INTEGER AS same_top FROM n LEFT JOIN o ON o.complex_id=n.complex_id AND o.pose_id=n.pose_id GROUP BY 1),
 mv AS (SELECT complex_id, count(*) FILTER (ro<>rn) AS moved FROM (SELECT complex_id, pose_id, row_number() OVER (PARTITION BY complex_id ORDER BY score_a DESC, pose_id) AS ro FROM o) JOIN
   (SELECT complex_id, pose_id, row_number() OVER (PARTITION BY complex_id ORDER BY score_a DESC, pose_id) AS rn FROM n) USING (complex_id, pose_id) GROUP BY 1),
 so AS (SELECT complex_id, score_a AS s, dockq>={TH} AS pos FROM o), sn AS (SELECT complex_id, score_a AS s, dockq>={TH} AS pos FROM n),
 {AUC_SQL.format(k='complex_id', src='so').replace('auc AS (SELECT', 'ao AS (SELECT', 1)}, {AUC_SQL.format(k='complex_id', src='sn').replace('auc AS (SELECT', 'an AS (SELECT', 1)}
 SELECT complex_id, n_old, n_new, shared, {r('max_gap')} AS max_gap, identical, pos_old, pos_new, pos_new_searched, same_top, moved, {r('ao.auc', 9)} AS auc_old, {r('an.auc', 9)} AS auc_new
 FROM rows_ JOIN mv USING (complex_id) JOIN ao USING (complex_id) JOIN an USING (complex_id)""")
def pool_invariance(spark, sf):
    p = V.scored(spark, sf)
    old = p.filter(~((F.col("prov") == 1) & (F.col("dockq") < 0.23) & (F.col("round") == 1)))
    new = p.withColumn("score_a", F.col("score_a") + F.when(F.col("round") == 1, 0.5).otherwise(0.0))
    out = st.pool_invariance(
        old.withColumn("feature", F.col("score_a")), new.withColumn("feature", F.col("score_a")), ["feature"], "score_a", ["pose_id"])
    return out.withColumns({c: rnd(F.col(c), d) for c, d in (("max_gap", 6), ("auc_old", 9), ("auc_new", 9))})


# --- the flagship: two conditions, end to end ------------------------------------------

PER = V.SCORED + f""",
long AS (SELECT complex_id, pose_id, dockq, 'a' AS condition, score_a AS score FROM scored UNION ALL SELECT complex_id, pose_id, dockq, 'b', score_b FROM scored),
src AS (SELECT complex_id, condition, score AS s, dockq>={TH} AS pos FROM long), {AUC_SQL.format(k='complex_id, condition', src='src')},
rl AS (SELECT *, row_number() OVER (PARTITION BY condition, complex_id ORDER BY score DESC, pose_id) AS rank FROM long),
per AS (SELECT condition, complex_id, coalesce(min(CASE WHEN dockq>={TH} THEN rank END), count(*)+1) AS first_hit FROM rl GROUP BY 1,2),
pm AS (SELECT condition, complex_id, round(auc, 9) AS auc, first_hit FROM per JOIN auc USING (condition, complex_id)),
pairs AS (SELECT a.complex_id, round(b.auc-a.auc, 9) AS d, (a.first_hit=1) AS a_ok, (b.first_hit=1) AS b_ok FROM pm a JOIN pm b USING (complex_id) WHERE a.condition='a' AND b.condition='b' AND a.auc IS NOT NULL AND b.auc IS NOT NULL)"""


@query("compare_conditions", f"""WITH {PER}, {wilcoxon_sql('pairs')}
 SELECT (SELECT count(*) FROM pairs) AS n, {", ".join(r(f"(SELECT avg((first_hit<={k})::INTEGER) FROM pm WHERE condition='{c}')") + f" AS success_{k}_{c}" for c in "ab" for k in KS)},
  (SELECT {r('avg(d)')} FROM pairs) AS mean_gain, (SELECT count(*) FILTER (NOT a_ok AND b_ok) FROM pairs) AS won, (SELECT count(*) FILTER (a_ok AND NOT b_ok) FROM pairs) AS lost,
  w_plus, w_minus, {r("(abs(least(w_plus,w_minus) - n*(n+1)/4.0::DOUBLE) - 0.5::DOUBLE)/sqrt(n*(n+1)*(2*n+1)/24.0::DOUBLE)")} AS z FROM wt""")
def compare_conditions(spark, sf):
    rows = V.scored(spark, sf).select(
        C, "pose_id", "dockq",
        F.inline(F.array(F.struct(F.lit("a").alias("condition"), F.col("score_a").alias("score")),
                         F.struct(F.lit("b").alias("condition"), F.col("score_b").alias("score")))))
    keys = ["condition", C]
    auc = rk.auc_midrank(rows, "score", keys=keys).withColumn("auc", F.round("auc", 9))
    first = rk.first_hit(rows, "score", keys=keys)
    per = auc.join(first, keys).withColumn("ok", (F.col("first_hit") == 1).cast("int"))
    per = cut(per)
    rates = per.groupBy().pivot("condition", ["a", "b"]).agg(*[F.avg((F.col("first_hit") <= k).cast("int")).alias(f"s{k}") for k in KS]).withColumn("_k", F.lit(0))
    p = st.pair_conditions(per, "a", "b", "auc", "ok").filter(~F.col("dropped")).withColumn("d", F.round("d", 9))
    tests = st.mcnemar_exact(p).withColumn("_k", F.lit(0)).join(
        st.wilcoxon_signed_rank(p).drop("n", "p").withColumn("_k", F.lit(0)), "_k").join(
        st.paired_t(p).select("n", "mean").withColumn("_k", F.lit(0)), "_k")
    return rates.join(tests, "_k").select(
        "n", *[rnd(F.col(f"{c}_s{k}")).alias(f"success_{k}_{c}") for c in "ab" for k in KS], rnd(F.col("mean")).alias("mean_gain"),
        F.col("b01").alias("won"), F.col("b10").alias("lost"), "w_plus", "w_minus", rnd(F.col("z")).alias("z"))
