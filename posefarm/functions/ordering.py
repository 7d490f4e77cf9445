"""Order statistics for groups of any size.

Rows are range-partitioned by (group, value, tie) with Spark's own range exchange, in the
value's own type, and cut there once.  Rows are numbered inside their partition and the
counts of the partitions before are added, so a group that holds most rows spreads over
many tasks and every size takes the same path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posefarm.session import cut

def _as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def with_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate (one without grouping) to every row."""
    return df.crossJoin(F.broadcast(one))


def top_k(df: DataFrame, keys, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group with their 1-based rank.

    Spark trims each group to ``k`` rows before the shuffle as long as ``k`` is
    within its group-limit threshold; above it a salted first pass does the same.
    """
    keys = _as_list(keys)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_r", F.row_number().over(first))
            .filter(F.col("_r") <= k)
            .drop("_salt", "_r")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def with_order(
    df: DataFrame,
    keys,
    value: str,
    tie: str | Sequence[str] | None = None,
    *,
    descending: bool = False,
    rank: str | None = "rank",
    running: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add the 1-based position in the group and running sums up to the row.

    ``running`` maps an output name to the column to add up; the sum includes the
    row itself.  ``tie`` names the columns that order rows of equal value; leave it
    out only when values are distinct within the group.  Rows without a value come last.
    """
    keys = _as_list(keys)
    running = dict(running or {})
    first = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    order = [first, *[F.col(t) for t in _as_list(tie or [])]]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut(ranged).withColumn("_row_at", F.monotonically_increasing_id())
    rows = rows.withColumn("_row_part", F.shiftright("_row_at", 33))
    sums = [F.sum(c).alias(f"_sum{i}") for i, c in enumerate(running.values())]
    parts = rows.groupBy(*keys, "_row_part").agg(F.min("_row_at").alias("_first_at"), F.count(F.lit(1)).alias("_rows"), *sums)
    # At most one row for each group and partition that meet.
    before = Window.partitionBy(*keys).orderBy("_row_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_row_part").alias("_in_part"), "_first_at",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in [("_rows", "_rows_before"), *[(f"_sum{i}", f"_sum_before{i}") for i in range(len(running))]]])
    if running:
        upto = Window.partitionBy("_row_part", *keys).orderBy("_row_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for name, column in running.items():
            rows = rows.withColumn(name, F.coalesce(F.sum(column).over(upto), F.lit(0)))
    same = F.col("_row_part") == F.col("_in_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    rows = rows.join(offsets, same)
    if rank:
        rows = rows.withColumn(rank, F.col("_row_at") - F.col("_first_at") + 1 + F.col("_rows_before"))
    for i, name in enumerate(running):
        rows = rows.withColumn(name, F.col(name) + F.col(f"_sum_before{i}"))
    return rows.drop("_row_at", "_row_part", "_in_part", "_first_at", "_rows_before", *[f"_key{i}" for i in range(len(keys))], *[f"_sum_before{i}" for i in range(len(running))])


def rank_of(df: DataFrame, keys, score: str, tie: str, marks: Mapping[str, Column]) -> DataFrame:
    """Rank, by score descending, of one marked row per group, without sorting.

    ``marks`` maps an output name to an order expression (a struct whose maximum
    is the row wanted, NULL for rows that do not qualify).  The rank is one more
    than the number of rows that come before the marked row; both steps are
    aggregates with map-side partials.
    """
    keys = _as_list(keys)
    rows = df.select(*keys, F.col(score).alias("_s"), F.col(tie).alias("_p"),
                     *[m.alias(f"_m{i}") for i, m in enumerate(marks.values())])
    picked = rows.groupBy(*keys).agg(
        *[F.max_by(F.struct("_s", "_p"), F.col(f"_m{i}")).alias(f"_x{i}") for i in range(len(marks))]
    )
    joined = rows.select(*keys, "_s", "_p").join(picked, keys)

    def ahead(i: int) -> Column:
        s, p = F.col(f"_x{i}._s"), F.col(f"_x{i}._p")
        return (F.col("_s") > s) | ((F.col("_s") == s) & (F.col("_p") < p))

    return joined.groupBy(*keys).agg(
        *[
            F.when(F.max(F.col(f"_x{i}").isNotNull()), F.count_if(ahead(i)) + 1).alias(name)
            for i, name in enumerate(marks)
        ]
    )


def order_values(df: DataFrame, keys, value: str, positions: Mapping[str, Column]) -> DataFrame:
    """Values at 1-based ascending positions (expressions over the group size ``n``)."""
    keys = _as_list(keys)
    # Read by the order and the group sizes, so written once.
    distinct = cut(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    upto = with_order(distinct, keys, value, rank=None, running={"_upto": "_c"})
    sizes = distinct.groupBy(*keys).agg(F.sum("_c").alias("n"))
    if keys:
        upto = upto.join(sizes, keys)
    else:
        upto = with_one(upto, sizes)

    def hit(position: Column) -> Column:
        return (F.col("_upto") >= position) & (F.col("_upto") - F.col("_c") < position)

    return upto.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(hit(p), F.col(value))).alias(name) for name, p in positions.items()])


def upper_median(df: DataFrame, keys, value: str, name: str = "median") -> DataFrame:
    """Element n//2 (0-based) of the sorted values."""
    return order_values(df, keys, value, {name: F.floor(F.col("n") / 2) + 1}).drop("n")


def lower_median(df: DataFrame, keys, value: str, name: str = "median") -> DataFrame:
    """Element (n-1)//2 (0-based) of the sorted values."""
    return order_values(df, keys, value, {name: F.floor((F.col("n") - 1) / 2) + 1}).drop("n")


def quantiles_linear(df: DataFrame, keys, value: str, qs: Mapping[str, float]) -> DataFrame:
    """Quantiles with linear interpolation between neighbouring order statistics."""
    keys = _as_list(keys)
    places = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in qs.items()}
    ends = {}
    for name, place in places.items():
        ends[f"_lo_{name}"] = F.floor(place) + 1
        ends[f"_hi_{name}"] = F.ceil(place) + 1
    got = order_values(df, keys, value, ends)
    return got.select(*keys, *[
        (F.col(f"_lo_{n}") + (p - F.floor(p)) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n, p in places.items()])
