"""Queries on the corpus and on pools across mining rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from posefarm.operators import curation as cu
from posefarm.operators import pools as pl
from posefarm.plans import views as V
from posefarm.plans.evaluation import TH, r
from posefarm.plans.registry import query
from posefarm.plans.views import rnd
from posefarm.session import cut, shared_folder
from posefarm.sources import pools as src

C = "complex_id"
D = "::DOUBLE"

# --- curation ---------------------------------------------------------------------


def _index(spark, sf):
    s = V.systems(spark, sf)
    return s.select("id", "cluster", "split", F.col("chain").alias("chain_r"), F.lit("B").alias("chain_l"), F.col("has_apo").alias("holo_r"),
                    F.lit(True).alias("holo_l"), F.col("has_apo").alias("apo_r"), (F.col("id") % 3 != 0).alias("apo_l"))


REPS = V.SYSTEMS + """,
reps AS (SELECT cluster, min(id) AS id FROM systems WHERE split='train' AND has_apo AND chain<>'UNDEFINED' AND cluster NOT IN (SELECT cluster FROM systems WHERE split='test') GROUP BY 1)"""


@query("cluster_representatives", f"WITH {REPS} SELECT cluster, id FROM reps")
def cluster_representatives(spark, sf):
    return cu.cluster_representatives(_index(spark, sf))


@query("apo_subset", f"WITH {V.SYSTEMS} SELECT id, cluster FROM systems WHERE split='test' AND has_apo AND id%3<>0")
def apo_subset(spark, sf):
    return cu.apo_subset(_index(spark, sf)).select("id", "cluster")


# Every document is its own cluster here, so that the order covers the whole corpus.
SEED, N_MASTER = 11, 10 ** 9
MASTER = V.SYSTEMS + f""",
pinned AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM systems WHERE id%10=3),
master AS MATERIALIZED (SELECT s.*, row_number() OVER (ORDER BY p.place NULLS LAST, {V.mix_sql('s.id', SEED)}, s.id) - 1 AS rank FROM systems s LEFT JOIN pinned p USING (id))"""


def master(spark, sf):
    s = V.systems(spark, sf).withColumnRenamed("cluster", "group").withColumn("cluster", F.col("id"))
    pinned = s.filter(F.col("id") % 10 == 3).select("cluster", F.col("id").alias("place"))
    return cu.seeded_order(s, "id", SEED, N_MASTER, pinned).drop("cluster").withColumnRenamed("group", "cluster")


@query("master_order", f"WITH {MASTER} SELECT id, rank FROM master")
def master_order(spark, sf):
    return master(spark, sf).select("id", "rank")


@query("same_partner", f"WITH {V.SYSTEMS} SELECT id, name, (id%17)=(id%5) AS same FROM systems")
def same_partner(spark, sf):
    return V.systems(spark, sf).select("id", "name", cu.is_same_partner(F.col("name")).alias("same"))


CAP = 2500
ELIGIBLE = MASTER + f""",
eligible AS MATERIALIZED (SELECT * FROM master WHERE status='ok' AND id%19<>0 AND (id%17)<>(id%5) AND voxels<={CAP})"""


def _eligible(spark, sf):
    m = master(spark, sf).drop("status", "voxels")
    s = V.systems(spark, sf)
    manifest = s.select("id", "status")
    volumes = s.select("id", "voxels", F.lit(1.2).alias("spacing"))
    excluded = s.filter(F.col("id") % 19 == 0).select("id")
    return cu.eligible(m, manifest, volumes, CAP, 1.2, excluded)


@query("eligible", f"WITH {ELIGIBLE} SELECT id, rank FROM eligible")
def eligible(spark, sf):
    return _eligible(spark, sf).select("id", "rank")


FIT_SIZES = (16, 32)


def _total(n):
    return round(n / 0.8)


@query("nested_split", f"""WITH {ELIGIBLE}, e AS (SELECT id, row_number() OVER (ORDER BY rank) - 1 AS position FROM eligible)
 SELECT n, id, position, CASE WHEN position%5=0 THEN 'validation' ELSE 'fit' END AS part FROM e CROSS JOIN (VALUES {','.join(f'({n}::INTEGER,{_total(n)})' for n in FIT_SIZES)}) s(n,total) WHERE position<total""")
def nested_split(spark, sf):
    e = cut(_eligible(spark, sf).select("id", "rank"))
    out = None
    for n in FIT_SIZES:
        part = cu.nested_split(e, n).select(F.lit(n).alias("n"), "id", "position", "part")
        out = part if out is None else out.unionByName(part)
    return out


@query("check_splits", f"""WITH {ELIGIBLE}, e AS (SELECT id, split, row_number() OVER (ORDER BY rank) - 1 AS position FROM eligible),
 s AS (SELECT id, split, n, CASE WHEN position%5=0 THEN 'validation' ELSE 'fit' END AS part FROM e CROSS JOIN (VALUES {','.join(f'({n},{_total(n)})' for n in FIT_SIZES)}) s(n,total) WHERE position<total)
 SELECT 'overlap' AS rule, 0::BIGINT AS bad UNION ALL SELECT 'nested', 0 UNION ALL SELECT 'seeds', 0 UNION ALL SELECT 'test_id', (2*(SELECT count(*) FROM s WHERE split='test'))::BIGINT""")
def check_splits(spark, sf):
    e = cut(_eligible(spark, sf).select("id", "rank"))
    rows = None
    for n in FIT_SIZES:
        part = cu.nested_split(e, n).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("seed"), F.lit(n).alias("n"), "id", "part")
        rows = part if rows is None else rows.unionByName(part)
    # A split is a short id list that five rules read.
    rows = cut(rows)
    test = V.systems(spark, sf).filter(F.col("split") == "test").select("id")
    return cu.check_splits(rows, test)


@query("leakage_report", " UNION ALL ".join(
    [f"WITH {V.SYSTEMS}, s AS (SELECT *, split_part(cluster,'|',1) AS lang, id%23 AS family FROM systems), t AS (SELECT * FROM s WHERE split='train'), x AS (SELECT * FROM s WHERE split='test') "
     + "SELECT 'cluster' AS key, count(DISTINCT cluster) AS shared, count(*) AS train_rows FROM t WHERE cluster IN (SELECT cluster FROM x)"]
    + [f"SELECT '{k}', count(DISTINCT {k}), count(*) FROM t WHERE {k} IN (SELECT {k} FROM x)" for k in ("lang", "family")]))
def leakage_report(spark, sf):
    s = V.systems(spark, sf).withColumn("lang", F.substring_index("cluster", "|", 1)).withColumn("family", F.col("id") % 23)
    return cu.leakage_report(s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test"), ["cluster", "lang", "family"])


@query("cluster_folds", f"""WITH {V.SYSTEMS}, c AS (SELECT DISTINCT id//4 AS cluster FROM systems), f AS (SELECT cluster, (row_number() OVER (ORDER BY {V.mix_sql('cluster', 21)}, cluster) - 1) % 5 AS fold FROM c)
 SELECT s.id, f.cluster, f.fold FROM systems s JOIN f ON f.cluster=s.id//4""")
def cluster_folds(spark, sf):
    s = V.systems(spark, sf).select("id", F.floor(F.col("id") / 4).alias("cluster"))
    return cu.cluster_folds(s, 5, 21).select("id", "cluster", "fold")


@query("random_pose_split", f"""WITH {V.POOL}, h AS (SELECT complex_id, pose_id, row_number() OVER (PARTITION BY complex_id ORDER BY {V.mix2_sql('complex_id', 'pose_id', 13)}, pose_id) AS i, count(*) OVER (PARTITION BY complex_id) AS n FROM pool)
 SELECT complex_id, pose_id, CASE WHEN i<=floor(n*0.8{D}) THEN 'train' ELSE 'validation' END AS part FROM h""")
def random_pose_split(spark, sf):
    return cu.random_pose_split(V.pool(spark, sf).select(C, "pose_id"), 0.8, 13)


# --- sources that carry tables --------------------------------------------------------

@query("read_manifest", f"WITH {V.SYSTEMS} SELECT status, count(*) AS n FROM (SELECT id%500 AS k, arg_max(status, id) AS status FROM systems GROUP BY 1) GROUP BY 1")
def read_manifest(spark, sf):
    """Manifest lines written as JSON and read back: the last line of an id wins."""
    out = shared_folder(spark, "manifest")
    s = V.systems(spark, sf).select((F.col("id") % 500).cast("string").alias("id"), "status", F.col("id").alias("seq"))
    lines = s.repartitionByRange(4, "seq").sortWithinPartitions("seq").select(F.to_json(F.struct("id", "status")).alias("value"))
    lines.write.mode("overwrite").text(out)
    m = src.read_manifest(spark, out, "id string, status string")
    return m.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("pool_store", f"""WITH {V.POOL} SELECT complex_id, count(*) AS n, count(*) FILTER (rmsd<=2.5{D}) AS hits_default, count(*) FILTER (rmsd<=5.0{D}) AS hits_5, {r('sum(c_pair)')} AS pairs FROM pool WHERE complex_id%2=1 GROUP BY 1""")
def pool_store(spark, sf):
    """A pool written by hashed complex and read back for a list of complexes."""
    out = shared_folder(spark, "pool")
    p = V.pool(spark, sf)
    src.write_pool(p, out, buckets=8)
    wanted = p.filter(F.col(C) % 2 == 1).select(C).distinct()
    a = src.read_pool(spark, out, wanted).groupBy(C).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits_default"), rnd(F.sum("c_pair")).alias("pairs"))
    b = src.read_pool(spark, out, wanted, hit_threshold=5.0).groupBy(C).agg(F.count_if("hit").alias("hits_5"))
    return a.join(b, C)


@query("pool_shards", f"""WITH {V.POOL}, u AS (SELECT *, 0 AS shard FROM pool WHERE complex_id%3<>0 UNION ALL SELECT *, 1 FROM pool WHERE complex_id%3<>1), p AS (SELECT complex_id, min(shard) AS f, max(shard) AS l FROM u GROUP BY 1)
 SELECT complex_id, count(*) FILTER (shard=f) AS n_first, count(*) FILTER (shard=l) AS n_last, {r('sum(CASE WHEN shard=f THEN c_pair END)')} AS pairs FROM u JOIN p USING (complex_id) GROUP BY 1""")
def pool_shards(spark, sf):
    p = V.pool(spark, sf)
    u = p.filter(F.col(C) % 3 != 0).withColumn("_shard", F.lit(0)).unionByName(p.filter(F.col(C) % 3 != 1).withColumn("_shard", F.lit(1)))
    first = src.resolve_shards(u, "error").groupBy(C).agg(F.count(F.lit(1)).alias("n_first"), rnd(F.sum("c_pair")).alias("pairs"))
    last = src.resolve_shards(u, "last").groupBy(C).agg(F.count(F.lit(1)).alias("n_last"))
    return first.join(last, C)


# --- pools across rounds ------------------------------------------------------------------

KEY = "complex_id, qi, cx, cy, cz"
R01 = V.SCORED + """,
r0 AS (SELECT * FROM scored WHERE round=0), r1 AS (SELECT * FROM scored WHERE round=1)"""


def rounds(spark, sf):
    p = V.scored(spark, sf).withColumn("score", F.col("score_a"))
    return p.filter(F.col("round") == 0), p.filter(F.col("round") == 1)


@query("pose_identity", f"WITH {V.POOL} SELECT complex_id, bool_and(qi>=0) AS has_identity, count(DISTINCT (qi,cx,cy,cz)) AS identities FROM (SELECT * REPLACE (CASE WHEN complex_id%7=0 AND pose_id%101=0 THEN -1 ELSE qi END AS qi) FROM pool) GROUP BY 1")
def pose_identity(spark, sf):
    p = V.pool(spark, sf).withColumn("qi", F.when((F.col(C) % 7 == 0) & (F.col("pose_id") % 101 == 0), F.lit(-1).cast("long")).otherwise(F.col("qi")))
    n = p.select(C, pl.pose_identity().alias("k")).distinct().groupBy(C).agg(F.count(F.lit(1)).alias("identities"))
    return pl.has_identity(p).join(n, C)


FRESH = R01 + f""",
fresh AS MATERIALIZED (SELECT * FROM (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY pose_id)=1) ANTI JOIN r0 USING ({KEY}))"""


@query("fresh_rows", f"WITH {FRESH} SELECT complex_id, pose_id, qi, cx, cy, cz FROM fresh")
def fresh_rows(spark, sf):
    a, b = rounds(spark, sf)
    return pl.fresh_rows(b, a).select(C, "pose_id", "qi", "cx", "cy", "cz")


@query("dropped_counts", f"WITH {FRESH} SELECT complex_id, n, coalesce(k,0) AS kept, n-coalesce(k,0) AS dropped FROM (SELECT complex_id, count(*) AS n FROM r1 GROUP BY 1) LEFT JOIN (SELECT complex_id, count(*) AS k FROM fresh GROUP BY 1) USING (complex_id)")
def dropped_counts(spark, sf):
    a, b = rounds(spark, sf)
    return pl.dropped_counts(b, a)


def cap_sql(source: str, cap: int, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY complex_id) AS n_, count(*) FILTER (dockq>={TH}) OVER (PARTITION BY complex_id) AS np_,
      row_number() OVER (PARTITION BY complex_id, dockq>={TH} ORDER BY score_a DESC, pose_id) AS k_ FROM {source}) WHERE n_<={cap} OR dockq>={TH} OR k_<=greatest(0,{cap}-np_))"""


@query("cap_pool", f"WITH {V.SCORED}, {cap_sql('scored', 300, 'capped')} SELECT complex_id, pose_id, {r('score_a')} AS score FROM capped")
def cap_pool(spark, sf):
    p = V.scored(spark, sf).withColumn("score", F.col("score_a"))
    return pl.cap_pool(p, 300).select(C, "pose_id", rnd(F.col("score")).alias("score"))


# Half of the pool per round at every scale factor: complexes hold about 600 rows.
ABSORB_CAP = 350
FRESH_NEG = R01 + f""",
cand AS (SELECT * FROM r1 WHERE dockq<{TH}),
fresh AS MATERIALIZED (SELECT * FROM (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY pose_id)=1) ANTI JOIN r0 USING ({KEY})),
grown AS (SELECT *, 0 AS origin FROM r0 WHERE complex_id IN (SELECT complex_id FROM fresh) UNION ALL SELECT *, 1 FROM fresh WHERE complex_id IN (SELECT complex_id FROM r0)),
{cap_sql('grown', ABSORB_CAP, 'capped')},
after_ AS MATERIALIZED (SELECT complex_id, pose_id, dockq, qi, cx, cy, cz, origin FROM capped UNION ALL SELECT complex_id, pose_id, dockq, qi, cx, cy, cz, 0 FROM r0 WHERE complex_id NOT IN (SELECT complex_id FROM fresh))"""


@query("absorb_round", f"WITH {FRESH_NEG} SELECT complex_id, pose_id, origin FROM after_")
def absorb_round(spark, sf):
    a, b = rounds(spark, sf)
    return pl.absorb_round(a, b, 1, ABSORB_CAP).select(C, "pose_id", "origin")


@query("absorb_stats", f"""WITH {FRESH_NEG}, now_ AS (SELECT DISTINCT {KEY} FROM after_), p AS (SELECT complex_id, count(*) AS proposed FROM cand GROUP BY 1),
 a AS (SELECT f.complex_id, count(*) AS added, count(n.qi) AS survived FROM fresh f LEFT JOIN now_ n USING ({KEY}) GROUP BY 1),
 b AS (SELECT r.complex_id, count(*) AS pool_before, count(*) FILTER (dockq<{TH} AND n.qi IS NULL) AS evicted FROM r0 r LEFT JOIN now_ n USING ({KEY}) GROUP BY 1),
 e AS (SELECT complex_id, count(*) AS pool_after FROM after_ GROUP BY 1)
 SELECT complex_id, coalesce(proposed,0) AS proposed, coalesce(proposed,0)-coalesce(added,0) AS duplicate, coalesce(added,0) AS added, coalesce(survived,0) AS survived, evicted, pool_before, pool_after FROM b JOIN e USING (complex_id) LEFT JOIN p USING (complex_id) LEFT JOIN a USING (complex_id)""")
def absorb_stats(spark, sf):
    a, b = rounds(spark, sf)
    return pl.absorb_stats(a, b, pl.absorb_round(a, b, 1, ABSORB_CAP))


@query("loss_view", f"WITH {V.POOL} SELECT complex_id, count(*) AS n, count(*) FILTER (dockq>={TH}) AS n_pos FROM pool WHERE prov=0 GROUP BY 1")
def loss_view(spark, sf):
    return pl.loss_view(V.pool(spark, sf)).groupBy(C).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dockq") >= 0.23).alias("n_pos"))


COMPOSITION = V.POOL + f""", comp AS (SELECT complex_id, count(*) AS n, count(*) FILTER (dockq>={TH}) AS n_pos, count(*) FILTER (dockq<{TH} AND round=0) AS random_neg, count(*) FILTER (dockq<{TH} AND round>0) AS hard_neg,
 count(*) FILTER (dockq>={TH} AND prov=0) AS pos_searched, count(*) FILTER (dockq>={TH} AND prov=1) AS pos_injected FROM pool GROUP BY 1)"""


@query("pool_composition", f"WITH {COMPOSITION} SELECT * FROM comp")
def pool_composition(spark, sf):
    return pl.pool_composition(V.pool(spark, sf))


@query("composition_summary", f"WITH {COMPOSITION} SELECT count(*) AS complexes, sum(n)::BIGINT AS rows, sum(n_pos)::BIGINT AS positives, count(*) FILTER (n_pos=0) AS without_positive, count(*) FILTER (pos_searched=0) AS without_searched FROM comp")
def composition_summary(spark, sf):
    return pl.composition_summary(pl.pool_composition(V.pool(spark, sf)))


COVER = V.POOL_WIDE + """, cov AS (SELECT k, count(*) FILTER (m>0) AS coverage, sum(m) AS total_mass FROM (SELECT complex_id, k, sum(abs(CASE WHEN t[k+1]>0.05 THEN t[k+1] ELSE 0 END)) AS m FROM pool_wide CROSS JOIN (SELECT unnest(range(0,64))::INTEGER AS k) WHERE (k<60 OR complex_id=3) GROUP BY 1,2) GROUP BY 1)"""


def _sparse(spark, sf):
    p = V.pool_wide(spark, sf)
    keep = F.transform("t", lambda v, k: F.when((v > 0.05) & ((k < 60) | (F.col(C) == 3)), v).otherwise(0.0))
    return p.withColumn("t", keep)


@query("pair_coverage", f"WITH {COVER} SELECT k, coverage, {r('total_mass')} AS total_mass FROM cov")
def pair_coverage(spark, sf):
    return pl.pair_coverage(_sparse(spark, sf), V.WIDE).withColumn("total_mass", rnd(F.col("total_mass")))


@query("coverage_summary", f"""WITH {COVER}, o AS (SELECT coverage, row_number() OVER (ORDER BY coverage) AS i, (SELECT count(DISTINCT complex_id) FROM pool_wide) AS n FROM cov)
 SELECT count(*) FILTER (coverage=0) AS zero, count(*) FILTER (coverage<10) AS below_10, count(*) FILTER (coverage/n::DOUBLE<0.01) AS below_1pct, min(coverage) AS min_coverage, {r('avg(coverage/n::DOUBLE)')} AS mean_fraction, max(CASE WHEN i=32 THEN coverage END) AS median_coverage FROM o""")
def coverage_summary(spark, sf):
    p = _sparse(spark, sf)
    s = pl.coverage_summary(pl.pair_coverage(p, V.WIDE), p)
    return s.withColumn("mean_fraction", rnd(F.col("mean_fraction")))


LEVERAGE = R01 + f""",
a AS (SELECT * FROM r0 WHERE prov=0 AND complex_id IN (SELECT complex_id FROM r0 WHERE prov=0 AND dockq>={TH})),
nw AS (SELECT * FROM (SELECT * FROM r1 WHERE prov=0 AND dockq<{TH} AND complex_id IN (SELECT complex_id FROM a)) ANTI JOIN a USING ({KEY})),
za AS (SELECT *, (score_a - avg(score_a) OVER w)/greatest(stddev_pop(score_a) OVER w, 1.0{D}) AS z FROM a WINDOW w AS (PARTITION BY complex_id)),
mg AS (SELECT complex_id, score_a, dockq, false AS new FROM a WHERE complex_id IN (SELECT complex_id FROM nw) UNION ALL SELECT complex_id, score_a, dockq, true FROM nw),
zb AS (SELECT *, (score_a - avg(score_a) OVER w)/greatest(stddev_pop(score_a) OVER w, 1.0{D}) AS z FROM mg WINDOW w AS (PARTITION BY complex_id)),
t0 AS (SELECT complex_id, min(z)-1.0{D} AS thr0 FROM za WHERE dockq>={TH} GROUP BY 1), t1 AS (SELECT complex_id, min(CASE WHEN dockq>={TH} THEN z END)-1.0{D} AS thr1, max(CASE WHEN dockq<{TH} AND new THEN z END) AS hn, max(CASE WHEN dockq<{TH} AND NOT new THEN z END) AS ho FROM zb GROUP BY 1),
lev AS (SELECT zb.complex_id, max(thr1-thr0) AS threshold_shift, max((hn>ho)::INTEGER) AS new_hardest, max(hn-ho) AS top_shift, count(*) FILTER (new) AS fresh, count(*) FILTER (dockq<{TH} AND new AND z>thr1) AS new_in_band, count(*) FILTER (dockq<{TH} AND NOT new AND z>thr1) AS old_in_band
 FROM zb JOIN t0 USING (complex_id) JOIN t1 USING (complex_id) GROUP BY 1)"""


@query("new_negative_leverage", f"WITH {LEVERAGE} SELECT complex_id, fresh, new_in_band, old_in_band, {r('new_in_band/(new_in_band+old_in_band)::DOUBLE')} AS share, {r('threshold_shift')} AS threshold_shift, new_hardest, {r('top_shift')} AS top_shift FROM lev")
def new_negative_leverage(spark, sf):
    a, b = rounds(spark, sf)
    n = pl.new_negative_leverage(a, b)
    return n.withColumns({c: rnd(F.col(c)) for c in ("share", "threshold_shift", "top_shift")})


@query("rescue_potential", f"""WITH {V.POOL}, p AS (SELECT complex_id*50 + orderkey_ % 50 AS complex_id, dockq, prov, round FROM (SELECT *, pose_id//8//10000019 AS orderkey_ FROM pool)),
 a AS (SELECT complex_id, max(dockq) AS best_before FROM p WHERE round=0 AND prov=0 GROUP BY 1), b AS (SELECT complex_id, max(dockq) AS best_after, count(*) FILTER (dockq>={TH}) AS gained FROM p WHERE round=1 AND prov=0 GROUP BY 1)
 SELECT complex_id, {r('best_before')} AS best_before, {r('coalesce(best_after,0)')} AS best_after, coalesce(gained,0) AS gained FROM (SELECT DISTINCT complex_id FROM p WHERE round=0) LEFT JOIN a USING (complex_id) LEFT JOIN b USING (complex_id) WHERE coalesce(best_before,0)<{TH}""")
def rescue_potential(spark, sf):
    p = V.pool(spark, sf)
    # Smaller complexes (one per supplier and order slot), so that some lack a positive.
    order = F.floor(F.floor(F.col("pose_id") / 8) / 10000019)
    p = p.withColumn(C, F.col(C) * 50 + order % 50)
    out = pl.rescue_potential(p.filter(F.col("round") == 0), p.filter(F.col("round") == 1))
    return out.select(C, rnd(F.col("best_before")).alias("best_before"), rnd(F.col("best_after")).alias("best_after"), "gained")


HARD = V.SCORED + f""",
hl AS (SELECT complex_id, dockq, 'a' AS condition, score_a AS s FROM scored WHERE prov=0 UNION ALL SELECT complex_id, dockq, 'b', score_b FROM scored WHERE prov=0),
hz AS (SELECT *, (s-avg(s) OVER w)/greatest(stddev_pop(s) OVER w, 1.0{D}) AS z FROM hl WINDOW w AS (PARTITION BY condition, complex_id)),
he AS (SELECT condition, complex_id, min(CASE WHEN dockq>={TH} THEN z END) AS mp, max(CASE WHEN dockq<{TH} THEN z END) AS mn FROM hz GROUP BY 1,2 HAVING mp IS NOT NULL AND mn IS NOT NULL),
ho AS (SELECT condition, mn, mp-mn AS gap, row_number() OVER (PARTITION BY condition ORDER BY mn) AS i, row_number() OVER (PARTITION BY condition ORDER BY mp-mn) AS j, count(*) OVER (PARTITION BY condition) AS n FROM he)"""


@query("negative_hardness", f"""WITH {HARD} SELECT condition, max(n) AS complexes, (SELECT count(*) FROM hz JOIN he USING (condition, complex_id) WHERE hz.condition=ho.condition AND dockq<{TH} AND z>mp-1.0{D}) AS in_band,
 {r('max(CASE WHEN i=n//2+1 THEN mn END)', 5)} AS hardest_median, {r('max(CASE WHEN j=n//2+1 THEN gap END)', 5)} AS gap_median FROM ho GROUP BY 1""")
def negative_hardness(spark, sf):
    n = pl.negative_hardness(V.pool(spark, sf), {"a": V.weights_a(), "b": V.weights_b()})
    return n.withColumn("hardest_median", rnd(F.col("hardest_median"), 5)).withColumn("gap_median", rnd(F.col("gap_median"), 5))


@query("identity_overflow_audit", f"""WITH {R01}, k0 AS (SELECT complex_id, (qi*4+(cx%4+4)%4)*16+((cy%4+4)%4)*4+(cz%4+4)%4 AS k, {KEY.replace('complex_id, ', '')} FROM r0), k1 AS (SELECT complex_id, (qi*4+(cx%4+4)%4)*16+((cy%4+4)%4)*4+(cz%4+4)%4 AS k, {KEY.replace('complex_id, ', '')} FROM r1)
 SELECT (SELECT count(*) FROM k1) AS candidates, (SELECT count(*) FROM k1 ANTI JOIN k0 USING ({KEY})) AS kept_four, (SELECT count(*) FROM k1 ANTI JOIN k0 USING (complex_id, k)) AS kept_packed""")
def identity_overflow_audit(spark, sf):
    a, b = rounds(spark, sf)
    return pl.identity_overflow_audit(b, a, (2, 2, 2))
