"""Columnar pose stores, corpus index, manifests and shard unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.sources.structures import numbered_lines

C = "complex_id"
BUCKETS = 64
INDEX_COLUMNS = ["id", "split", "cluster_id", "chain_R", "chain_L", "holo_R", "holo_L", "apo_R", "apo_L", "pdb_id"]


def write_pool(pool: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Store a pool in folders by hashed complex, rows sorted by (complex, pose).

    Sorting lets a reader that wants the first poses skip row groups.  Rows spread
    over (bucket, hashed pose) so that a large complex does not end in one task.
    """
    rows = pool.withColumn("bucket", F.pmod(F.xxhash64(C), F.lit(buckets)).cast("int"))
    spread = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(C, "pose_id"), F.lit(8)))
    spread = spread.withColumn("buckets", F.lit(buckets))
    spread.sortWithinPartitions("bucket", C, "pose_id").write.mode(mode).partitionBy("buckets", "bucket").parquet(path)


def read_pool(spark: SparkSession, path: str, names: Sequence | DataFrame | None = None, max_poses: int | None = None,
              hit_threshold: float | None = None, default_threshold: float = 2.5) -> DataFrame:
    """Read a pool, or the named complexes of it (a missing name is an error).

    ``max_poses`` keeps pose_id below it, a pushed-down filter.  ``hit`` is the stored
    flag, or rmsd within the default threshold where no flag is stored; a given
    threshold replaces both and needs rmsd.  Names in a list open only their own bucket
    folders; names in a table prune at run time.
    """
    pool = spark.read.parquet(path)
    if max_poses is not None:
        pool = pool.filter(F.col("pose_id") < max_poses)
    if names is not None:
        wanted = names if isinstance(names, DataFrame) else spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{C} {pool.schema[C].dataType.simpleString()}, place int")
        stored = pool.select("buckets").first() if "buckets" in pool.columns else None
        bucketed = stored is not None
        if bucketed:
            wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64(C), F.lit(stored[0])).cast("int"))
            if not isinstance(names, DataFrame):
                pool = pool.filter(F.col("bucket").isin([r[0] for r in wanted.select("bucket").distinct().collect()]))
        # Looked for now: an optimizer that sees an empty side would never meet a later check.
        missing = wanted.join(pool.select(C).distinct(), C, "left_anti").select(C).limit(5).collect()
        if missing:
            raise ValueError(f"no such complex: {', '.join(str(m[0]) for m in missing)}")
        pool = pool.join(wanted, [C, "bucket"] if bucketed else C)
    if "rmsd" in pool.columns or hit_threshold is not None:
        if hit_threshold is not None:
            text = F.lit("hit threshold given, but rmsd is not stored")
            rmsd = F.col("rmsd") if "rmsd" in pool.columns else F.lit(None).cast("double")
            hit = F.when(rmsd.isNull(), F.raise_error(text).cast("boolean")).otherwise(rmsd <= hit_threshold)
        elif "hit" in pool.columns:
            hit = F.coalesce(F.col("hit"), F.col("rmsd") <= default_threshold)
        else:
            hit = F.col("rmsd") <= default_threshold
        pool = pool.withColumn("hit", hit)
    return pool.drop("buckets", "bucket")


def list_complexes(pool: DataFrame) -> DataFrame:
    return pool.select(C).distinct().orderBy(C)


def read_corpus_index(spark: SparkSession, path: str) -> DataFrame:
    """Corpus index with only the columns curation needs."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in INDEX_COLUMNS if c in df.columns])


def read_manifest(spark: SparkSession, path: str, schema: str = "rank int, id string, status string") -> DataFrame:
    """Preparation log (JSON lines); the last line of an id wins.

    Lines are numbered inside their file; a later file name beats an earlier one.
    """
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    rows = lines.select(F.col("file").alias("_f"), F.col("line_no").alias("_n"), F.from_json("line", schema).alias("r"))
    last = rows.groupBy(F.col("r.id").alias("id")).agg(F.max_by("r", F.struct("_f", "_n")).alias("r"))
    return last.select("r.*")


def read_pool_shards(spark: SparkSession, paths: Sequence[str], policy: str = "error") -> DataFrame:
    """Union of shards.  Where several shards hold one complex, ``first`` or ``last`` keeps
    that shard's rows; ``error`` ends the job if their pose identities differ."""
    union = None
    for i, p in enumerate(paths):
        part = spark.read.parquet(p).withColumn("_shard", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return resolve_shards(union, policy)


def resolve_shards(union: DataFrame, policy: str = "error") -> DataFrame:
    """As :func:`read_pool_shards` for rows that carry the shard number ``_shard``.

    The identities of a shard are compared through an order-free checksum and a count,
    so no key list is gathered.
    """
    key = F.xxhash64("qi", "cx", "cy", "cz")
    # Two independent checksums; wide decimals keep the sums exact.
    prints = union.groupBy(C, "_shard").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(key.cast("decimal(38,0)")).alias("_h"),
        F.sum(F.xxhash64("cz", "cy", "cx", "qi").cast("decimal(38,0)")).alias("_h2"))
    pick = F.max("_shard") if policy == "last" else F.min("_shard")
    chosen = prints.groupBy(C).agg(pick.alias("_shard"), F.count_distinct("_n", "_h", "_h2").alias("_kinds"))
    if policy == "error":
        text = F.concat(F.lit("shards disagree on complex "), F.col(C).cast("string"))
        chosen = chosen.withColumn("_shard", F.when(F.col("_kinds") > 1, F.raise_error(text).cast("int")).otherwise(F.col("_shard")))
    return union.join(chosen.drop("_kinds"), [C, "_shard"]).drop("_shard")
