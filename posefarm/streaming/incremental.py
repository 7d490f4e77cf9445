"""Incremental versions: mined shards, manifests and poses that arrive as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from posefarm.operators.pools import IDENTITY, absorb_round
from posefarm.session import remove_folder, shared_folder, shuffles_freed

C = "complex_id"


#: Folders of a kept pool.
BUCKETS = 64
#: Rows of the pool and of a batch that are absorbed at a time, in whole buckets.
ABSORBED = 8_000_000


def _bucket() -> Column:
    return F.pmod(F.xxhash64(C), F.lit(BUCKETS)).cast("int")


def start_pool(pool: DataFrame, path: str) -> None:
    """Write a pool to be absorbed into, by buckets of complexes."""
    with shuffles_freed(pool.sparkSession):
        pool.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def kept_pool(spark: SparkSession, path: str) -> DataFrame:
    """The pool as it is now."""
    return spark.read.parquet(path).drop("bucket")


def _turns(pool: DataFrame, batch: DataFrame) -> list[list[int]]:
    """The buckets of a batch, dealt to turns of at most ABSORBED rows where a bucket is not larger."""
    rows = dict(pool.groupBy("bucket").count().collect())
    turns: list[list[int]] = []
    held = 0
    for bucket, n in sorted(batch.groupBy("bucket").count().collect()):
        n += rows.get(bucket, 0)
        if not turns or held + n > ABSORBED:
            turns.append([])
            held = 0
        turns[-1].append(bucket)
        held += n
    return turns


def absorb_stream(mined: DataFrame, path: str, checkpoint: str, cap: int, rnd: int = 1, score: str = "score") -> StreamingQuery:
    """Absorb mined shards batch by batch into the pool under ``path`` (see :func:`start_pool`).

    A batch reads and rewrites the buckets of its complexes and no others, by overwriting
    their partitions; nothing older stays.  Buckets take turns, so that the shuffles of a
    batch need disk for a turn's rows and not for the whole pool; a batch of several turns is
    stored by buckets while they last.  Rows the pool has are not added again and rows over the
    cap leave again, so a batch that runs twice, or a second time after some of its turns,
    leaves the same pool.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", _bucket())
        with shuffles_freed(spark):
            turns = _turns(spark.read.parquet(path), batch)
            aside = shared_folder(spark, "batch")
            if len(turns) > 1:
                # No shuffle: every task sorts its own rows by bucket.
                batch.write.partitionBy("bucket").parquet(aside)
                batch = spark.read.schema(batch.schema).parquet(aside)
            for turn in turns:
                old, own = (rows.filter(F.col("bucket").isin(turn)).drop("bucket") for rows in (spark.read.parquet(path), batch))
                new = absorb_round(old, own, rnd, cap, score).withColumn("bucket", _bucket())
                # Folders are replaced when all tasks have ended, so the pool is read and overwritten in one pass.
                share = F.pmod(F.xxhash64(C, F.lit(1)), F.lit(-(-BUCKETS // len(turn))))
                new.repartition("bucket", share).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
            if len(turns) > 1:
                remove_folder(spark, aside)

    return mined.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest_stream(lines: DataFrame) -> DataFrame:
    """Latest status per id from a stream of manifest rows (id, status, seq); update mode."""
    return lines.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def status_counts(latest: DataFrame) -> DataFrame:
    """Ids per latest status; for the result table of :func:`manifest_stream`."""
    return latest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def dedup_stream(poses: DataFrame, arrival: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First row of every (complex, identity).

    With an arrival time the state is dropped once the watermark passes.
    """
    if arrival is None:
        return poses.dropDuplicates([C, *IDENTITY])
    return poses.withWatermark(arrival, delay).dropDuplicatesWithinWatermark([C, *IDENTITY])
