"""Domain views over the given star-schema tables.

Every view comes as a DataFrame function and as the SQL that gives the same rows,
so that a query and its SQL twin start from the same data.  All of them use whole
tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posefarm.functions.columns import apply_matrix, rotation_matrix
from posefarm.session import ROWS_PER_TASK, spread

WIDE = 64          # length of an embedding
REC_ATOMS = 10     # triples 0..9 of an embedding are receptor atoms
LIG_ATOMS = 11     # triples 10..20 are ligand atoms
ROTATIONS = 8
SPACING = 1.2
COARSE = 3.0
PER_TASK = 200     # complexes dealt to one task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings spread by id: every row grows into thousands of cells and poses, so the
    few bytes are dealt out before the work starts, in a number of partitions that adaptive
    execution does not take back and that grows with the table, so that a task's share does not.
    A complex of this view is 21 atoms, so joins on (complex, cell) or (complex, pose) stay
    where its rows are instead of dealing its cells out again."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    e = table(spark, sf_dir, "embeddings")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-e.count() // PER_TASK))
    # What is stored and met again is dealt out as widely.
    spread(spark, n * ROWS_PER_TASK)
    return e.repartition(n, "vec_id")


def rnd(column: Column, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(column, digits) + F.lit(0.0)


# --- pose pool from lineitem -------------------------------------------------

def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features per pose (t) next to the shape counts; two rounds, two sources.  Shuffles
    of the pool take partitions in proportion to it."""
    li = table(spark, sf_dir, "lineitem")
    spread(spark, li.count())
    u = F.pmod(F.col("l_partkey") * 31 + F.col("l_orderkey") * 17, F.lit(1000)) / F.lit(1000.0)
    return li.select(
        F.col("l_suppkey").alias("complex_id"),
        ((F.col("l_orderkey") * 10000019 + F.col("l_partkey")) * 8 + F.col("l_linenumber")).alias("pose_id"),
        F.col("l_quantity").alias("c_pair"),
        F.col("l_linenumber").cast("double").alias("n_ss"),
        (F.col("l_partkey") % 5).cast("double").alias("n_sc"),
        (F.col("l_orderkey") % 3).cast("double").alias("n_cc"),
        F.array(
            F.col("l_discount"), F.col("l_tax"),
            (F.col("l_partkey") % 7).cast("double"), (F.col("l_orderkey") % 11).cast("double"),
        ).alias("t"),
        (F.col("l_tax") - 0.04).alias("elec"),
        (F.col("l_extendedprice") / 5000.0).alias("rmsd"),
        (u * u * u * u).alias("dockq"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("round"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("prov"),
        (F.col("l_partkey") % 1944).alias("qi"),
        (F.col("l_linenumber") - 4).cast("long").alias("cx"),
        ((F.col("l_quantity") % 9).cast("long") - 4).alias("cy"),
        (F.col("l_orderkey") % 9 - 4).alias("cz"),
    )


POOL = """
pool AS (
  SELECT l_suppkey AS complex_id,
    (l_orderkey * 10000019 + l_partkey) * 8 + l_linenumber AS pose_id,
    l_quantity AS c_pair, l_linenumber::DOUBLE AS n_ss,
    (l_partkey % 5)::DOUBLE AS n_sc, (l_orderkey % 3)::DOUBLE AS n_cc,
    [l_discount, l_tax, (l_partkey % 7)::DOUBLE, (l_orderkey % 11)::DOUBLE] AS t,
    l_tax - 0.04::DOUBLE AS elec, l_extendedprice / 5000.0::DOUBLE AS rmsd,
    u * u * u * u AS dockq,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS round,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS prov,
    l_partkey % 1944 AS qi, (l_linenumber - 4)::BIGINT AS cx,
    ((l_quantity % 9)::BIGINT - 4) AS cy, l_orderkey % 9 - 4 AS cz
  FROM (SELECT *, ((l_partkey * 31 + l_orderkey * 17) % 1000)::DOUBLE / 1000.0::DOUBLE AS u FROM lineitem)
)"""

# Weights of the two conditions compared on the pool.
ALPHA, RHO, BETA = 0.75, 1.5, 3.0
TABLE_A = (2.0, -1.5, 0.25, -0.125)
TABLE_B = (1.0, 0.5, -0.25, 0.375)

SCORE_A = ("(0.75::DOUBLE*c_pair - (1.6875::DOUBLE*n_ss + 2.53125::DOUBLE*n_sc + 3.796875::DOUBLE*n_cc) "
           "- (2.0::DOUBLE*t[1] - 1.5::DOUBLE*t[2] + 0.25::DOUBLE*t[3] - 0.125::DOUBLE*t[4]) + 3.0::DOUBLE*elec)")
SCORE_B = ("(0.5::DOUBLE*c_pair - (0.5::DOUBLE*n_ss + 1.0::DOUBLE*n_sc + 2.0::DOUBLE*n_cc) "
           "- (1.0::DOUBLE*t[1] + 0.5::DOUBLE*t[2] - 0.25::DOUBLE*t[3] + 0.375::DOUBLE*t[4]) + 1.0::DOUBLE*elec)")

# Scores are rounded before they order rows, so that both engines see the same ties.
SCORED = POOL + f""",
scored AS MATERIALIZED (
  SELECT *, round({SCORE_A}, 6) AS score_a, round({SCORE_B}, 6) AS score_b FROM pool
)"""


def weights_a():
    from posefarm.operators.scoring import Weights, clash_weights
    return Weights(alpha=ALPHA, clash=clash_weights(ALPHA, RHO), table=TABLE_A, beta=BETA)


def weights_b():
    from posefarm.operators.scoring import Weights
    return Weights(alpha=0.5, clash=(0.5, 1.0, 2.0), table=TABLE_B, beta=1.0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from posefarm.operators.scoring import linear_score
    df = linear_score(pool(spark, sf_dir), weights_a(), "score_a")
    df = linear_score(df, weights_b(), "score_b")
    return df.withColumn("score_a", F.round("score_a", 6)).withColumn("score_b", F.round("score_b", 6))


# --- wide pool from embeddings -----------------------------------------------

def pool_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten complexes of long feature vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").cast("long").alias("complex_id"),
        F.col("vec_id").alias("pose_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("t"),
        (F.pmod(F.col("vec_id") * 37, F.lit(1000)) / F.lit(1000.0)).alias("dockq"),
        F.pmod(F.col("vec_id"), F.lit(2)).cast("int").alias("prov"),
    )


POOL_WIDE = """
pool_wide AS (
  SELECT label::BIGINT AS complex_id, vec_id AS pose_id, embedding::DOUBLE[] AS t,
    (vec_id * 37 % 1000)::DOUBLE / 1000.0::DOUBLE AS dockq, (vec_id % 2)::INTEGER AS prov
  FROM embeddings
)"""


# --- atoms and poses from embeddings -----------------------------------------

RADIUS_CYCLE = (1.20, 1.70, 1.55, 1.52, 1.80)
HEAVY_NAMES = ("N", "CA", "C", "O", "CB")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per atom: receptor side R in place, ligand side L in its own frame."""
    e = vectors(spark, sf_dir).select(
        F.col("vec_id").alias("complex_id"),
        F.transform("embedding", lambda x: x.cast("double") * 20.0).alias("v"),
    )
    idx = F.explode(F.sequence(F.lit(0), F.lit(REC_ATOMS + LIG_ATOMS - 1)))
    a = e.select("complex_id", "v", idx.alias("idx"))
    radius = F.lit(RADIUS_CYCLE[0])
    for k, r in enumerate(RADIUS_CYCLE[1:], start=1):
        radius = F.when(F.col("idx") % 5 == k, F.lit(r)).otherwise(radius)
    return a.select(
        "complex_id",
        F.when(F.col("idx") < REC_ATOMS, "R").otherwise("L").alias("side"),
        F.when(F.col("idx") < REC_ATOMS, F.col("idx")).otherwise(F.col("idx") - REC_ATOMS).alias("atom_idx"),
        F.col("v")[F.col("idx") * 3].alias("x"),
        F.col("v")[F.col("idx") * 3 + 1].alias("y"),
        F.col("v")[F.col("idx") * 3 + 2].alias("z"),
        radius.alias("radius"),
        (F.col("idx") * 7 % 5 / F.lit(2.0)).alias("sasa"),
        (F.col("idx") % 12 + 1).alias("type_id"),
        (F.col("idx") % 11 + 1).alias("charge_id"),
    )


ATOMS = f"""
atoms AS (
  SELECT vec_id AS complex_id, CASE WHEN idx < {REC_ATOMS} THEN 'R' ELSE 'L' END AS side,
    (CASE WHEN idx < {REC_ATOMS} THEN idx ELSE idx - {REC_ATOMS} END)::INTEGER AS atom_idx,
    embedding[idx*3+1]::DOUBLE * 20.0::DOUBLE AS x, embedding[idx*3+2]::DOUBLE * 20.0::DOUBLE AS y,
    embedding[idx*3+3]::DOUBLE * 20.0::DOUBLE AS z,
    ([1.20,1.70,1.55,1.52,1.80]::DOUBLE[])[idx%5+1] AS radius, (idx*7%5)::DOUBLE / 2.0::DOUBLE AS sasa,
    (idx%12+1)::INTEGER AS type_id, (idx%11+1)::INTEGER AS charge_id
  FROM embeddings CROSS JOIN (SELECT unnest(range(0, {REC_ATOMS + LIG_ATOMS}))::BIGINT AS idx)
)"""


def unit(parts: list[Column]) -> list[Column]:
    norm = F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2] + parts[3] * parts[3])
    return [p / norm for p in parts]


def complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native pose of each complex: quaternion q1..q4 and translation tx, ty, tz."""
    e = vectors(spark, sf_dir)
    v = [F.col("embedding")[i].cast("double") for i in range(3)]
    q = unit([v[0] * 4.0, v[1] * 4.0, v[2] * 4.0, F.lit(1.0)])
    return e.select(
        F.col("vec_id").alias("complex_id"),
        *[c.alias(f"q{i + 1}") for i, c in enumerate(q)],
        (F.col("embedding")[63].cast("double") * 8.0 + 5.0).alias("tx"),
        F.lit(1.0).alias("ty"), F.lit(-0.5).alias("tz"),
    )


COMPLEXES = """
complexes AS (
  SELECT vec_id AS complex_id, a/n AS q1, b/n AS q2, c/n AS q3, 1.0::DOUBLE/n AS q4,
    embedding[64]::DOUBLE * 8.0::DOUBLE + 5.0::DOUBLE AS tx, 1.0::DOUBLE AS ty, -0.5::DOUBLE AS tz
  FROM (SELECT *, sqrt(a*a + b*b + c*c + 1.0::DOUBLE) AS n FROM (
    SELECT vec_id, embedding, embedding[1]::DOUBLE*4.0::DOUBLE AS a, embedding[2]::DOUBLE*4.0::DOUBLE AS b,
      embedding[3]::DOUBLE*4.0::DOUBLE AS c FROM embeddings))
)"""


def _rotation_parts(qi: Column) -> list[Column]:
    return unit([
        (qi % 2).cast("double"), (F.floor(qi / 2) % 2).cast("double"),
        (F.floor(qi / 4) % 2).cast("double"), F.lit(1.0),
    ])


def rotations(spark: SparkSession) -> DataFrame:
    """Eight rational rotations."""
    r = spark.range(ROTATIONS).select(F.col("id").cast("int").alias("qi"))
    return r.select("qi", *[c.alias(f"q{i + 1}") for i, c in enumerate(_rotation_parts(F.col("qi")))])


ROTATIONS_SQL = f"""
rotations AS (
  SELECT qi, a/n AS q1, b/n AS q2, c/n AS q3, 1.0::DOUBLE/n AS q4 FROM (
    SELECT qi, a, b, c, sqrt(a*a + b*b + c*c + 1.0::DOUBLE) AS n FROM (
      SELECT qi, (qi%2)::DOUBLE AS a, ((qi//2)%2)::DOUBLE AS b, ((qi//4)%2)::DOUBLE AS c
      FROM (SELECT unnest(range(0, {ROTATIONS}))::INTEGER AS qi)))
)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight poses of every complex around its native translation."""
    c = complexes(spark, sf_dir).select("complex_id", "tx", "ty", "tz")
    p = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(ROTATIONS - 1))).alias("qi"))
    return p.select(
        "complex_id", F.col("qi").cast("long").alias("pose_id"), "qi",
        *[q.alias(f"q{i + 1}") for i, q in enumerate(_rotation_parts(F.col("qi")))],
        (F.col("tx") + (F.col("qi") % 3 - 1) * 1.0).alias("tx"),
        (F.col("ty") + (F.col("qi") % 2) * 0.5).alias("ty"),
        (F.col("tz") - (F.col("qi") % 4) * 0.25).alias("tz"),
    )


POSES = COMPLEXES + "," + ROTATIONS_SQL + """,
poses AS (
  SELECT complex_id, r.qi::BIGINT AS pose_id, r.qi, r.q1, r.q2, r.q3, r.q4,
    tx + (r.qi % 3 - 1)::DOUBLE AS tx, ty + (r.qi % 2)::DOUBLE * 0.5::DOUBLE AS ty,
    tz - (r.qi % 4)::DOUBLE * 0.25::DOUBLE AS tz
  FROM complexes CROSS JOIN rotations r
)"""


def rotated_sql(p: str, a: str, with_shift: bool = True) -> str:
    """SQL columns px, py, pz: atom row ``a`` placed by pose row ``p``."""
    m = [
        f"(1.0::DOUBLE - 2*{p}.q2*{p}.q2 - 2*{p}.q3*{p}.q3)", f"(2*({p}.q1*{p}.q2 + {p}.q3*{p}.q4))",
        f"(2*({p}.q1*{p}.q3 - {p}.q2*{p}.q4))", f"(2*({p}.q1*{p}.q2 - {p}.q3*{p}.q4))",
        f"(1.0::DOUBLE - 2*{p}.q1*{p}.q1 - 2*{p}.q3*{p}.q3)", f"(2*({p}.q2*{p}.q3 + {p}.q1*{p}.q4))",
        f"(2*({p}.q1*{p}.q3 + {p}.q2*{p}.q4))", f"(2*({p}.q2*{p}.q3 - {p}.q1*{p}.q4))",
        f"(1.0::DOUBLE - 2*{p}.q1*{p}.q1 - 2*{p}.q2*{p}.q2)",
    ]
    out = []
    for i, axis in enumerate("xyz"):
        s = f"{m[3*i]}*{a}.x + {m[3*i+1]}*{a}.y + {m[3*i+2]}*{a}.z"
        if with_shift:
            s = f"({s}) + {p}.t{axis}"
        out.append(f"{s} AS p{axis}")
    return ", ".join(out)


def native_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms with native coordinates nx, ny, nz (the receptor does not move)."""
    a, c = atoms(spark, sf_dir), complexes(spark, sf_dir)
    j = a.join(c, "complex_id")
    moved = apply_matrix(rotation_matrix([F.col(f"q{i}") for i in range(1, 5)]), [F.col("x"), F.col("y"), F.col("z")])
    cols = []
    for axis, m in zip("xyz", moved):
        cols.append(F.when(F.col("side") == "R", F.col(axis)).otherwise(m + F.col(f"t{axis}")).alias(f"n{axis}"))
    return j.select(*a.columns, *cols)


NATIVE = ATOMS + "," + POSES + f""",
native AS MATERIALIZED (
  SELECT a.*, CASE WHEN side='R' THEN x ELSE px END AS nx, CASE WHEN side='R' THEN y ELSE py END AS ny,
    CASE WHEN side='R' THEN z ELSE pz END AS nz
  FROM (SELECT a.*, {rotated_sql('c', 'a')} FROM atoms a JOIN complexes c USING (complex_id)) a
)"""

PLACED = NATIVE + f""",
placed AS MATERIALIZED (
  SELECT a.complex_id, p.pose_id, a.atom_idx, a.radius, a.sasa, a.type_id, a.charge_id, a.nx, a.ny, a.nz,
    {rotated_sql('p', 'a')}
  FROM (SELECT * FROM native WHERE side='L') a JOIN poses p USING (complex_id)
)"""


# --- conditions, systems -----------------------------------------------------

def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (complex, condition): a metric, a success flag."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("complex_id"), F.col("event_type").alias("condition")).agg(
        rnd(F.avg("value"), 9).alias("metric"), F.max("value").alias("best"),
        (F.max("value") > 40.0).cast("int").alias("success"), F.count(F.lit(1)).alias("n"),
    )


CONDITIONS = """
conditions AS (
  SELECT user_id AS complex_id, event_type AS condition, round(avg(value), 9) AS metric,
    max(value) AS best, (max(value) > 40.0)::INTEGER AS success, count(*) AS n
  FROM events GROUP BY ALL
)"""


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus entries: id, cluster, split, status and grid volume."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.select("doc_id", "lang", "source", "n_chars").join(l, "doc_id", "left")
    half = F.concat(F.lit("s"), F.col("doc_id"), F.lit("__A1_P"), F.col("doc_id") % 17)
    other = F.concat(F.lit("s"), F.col("doc_id"), F.lit("__B1_P"), F.col("doc_id") % 5)
    return j.select(
        F.col("doc_id").alias("id"),
        F.concat(half, F.lit("--"), other).alias("name"),
        F.concat_ws("|", "lang", "source").alias("cluster"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "test").otherwise("train").alias("split"),
        F.when(F.coalesce("quality", F.lit(1)) == 1, "ok").otherwise("fail").alias("status"),
        F.col("n_chars").alias("voxels"),
        (F.col("doc_id") % 7 != 0).alias("has_apo"),
        F.when(F.col("doc_id") % 13 == 0, "UNDEFINED").otherwise("A").alias("chain"),
    )


SYSTEMS = """
systems AS (
  SELECT d.doc_id AS id, 's'||d.doc_id||'__A1_P'||(d.doc_id%17)||'--s'||d.doc_id||'__B1_P'||(d.doc_id%5) AS name,
    lang||'|'||source AS cluster, CASE WHEN coalesce(toxic,0)=1 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN coalesce(quality,1)=1 THEN 'ok' ELSE 'fail' END AS status, n_chars AS voxels,
    d.doc_id%7<>0 AS has_apo, CASE WHEN d.doc_id%13=0 THEN 'UNDEFINED' ELSE 'A' END AS chain
  FROM documents d LEFT JOIN labels USING (doc_id)
)"""


def mix2_sql(a: str, b: str, seed: int) -> str:
    """SQL of ``functions.columns.mix2``."""
    return mix_sql(f"{mix_sql(a, seed)} + {mix_sql(b, seed + 1)}", seed + 2)


def mix_sql(value: str, seed: int) -> str:
    """SQL of ``functions.columns.mix``."""
    x = f"((({value})::BIGINT % 2147483647 + {seed * 7919}) % 2147483647)"
    x = f"(({x} * 48271) % 2147483647)"
    x = f"xor({x}, {x} >> 15)"
    x = f"(({x} * 69621) % 2147483647)"
    x = f"xor({x}, {x} >> 13)"
    return f"(({x} * 16807) % 2147483647)"
