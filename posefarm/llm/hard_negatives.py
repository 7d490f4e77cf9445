"""Hard negatives for contrastive training, by lists that a cluster of anchors shares.

Anchors are clustered by direction.  For a cluster and a set of candidates the list is
sorted once by the most that any member's score could be: with t the angle between
candidate and centroid and w the widest angle between a member and the centroid, a member's
score is at most |anchor| |candidate| cos(max(0, t - w)).  Every member walks the list until
that bound falls below what it still needs; then the rest of the list is certified not to
matter.  Results are exact whatever the clusters are.

Anchors meet the candidates in tiles of at most about TILE candidates and TILE anchors, all
of them, in blocks; a tile yields each member's few best, and a window keeps the best of
those.  The lists are walked twice: once for an anchor's positives, among candidates of its
label, and once, when the positives' scores are known, for the negatives of each positive,
among candidates of other labels whose scores lie in its band.  Centroids are fitted on at
most SAMPLE anchors of smallest hash (a bound that does not depend on the input); they only
decide how early a walk may end.

Scores are inner products of integer vectors, exact in double precision or, where they might
not be, in 64-bit integers; a table whose scores might leave those raises an error.

Cases: rows without a vec_id or label, and vectors that are null or hold a null, infinite or
undefined component, take no part.  Of rows that share a vec_id the one with the smallest
label, then vector, counts.  A shorter vector counts as filled up with zeros.  Equal scores
go by the smaller vec_id.  An anchor without positives, and a positive without negatives in
its band, has no rows; neither has an empty table.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posefarm.llm.store import stored

#: Candidates, and anchors, that one task compares.
TILE = 60_000
CLUSTERS, SAMPLE, ROUNDS = 32, 2048, 8
#: Candidates of a list that are scored in one go.
STEP = 1024
N_POSITIVES, N_NEGATIVES = 5, 3
#: A negative's score lies between LOW and HIGH hundredths of its positive's.
LOW, HIGH = 50, 95
#: No score is as large.
EDGE = 2**62
#: The label of every SHIFT-th row moves on by one of LABELS first; every ANCHOR-th is an anchor.
SHIFT, LABELS, ANCHOR = 7, 10, 50


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector (array of long) of the rows that take part, one for each vec_id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("vector"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % SHIFT == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    first = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v"))
    return first.select("vec_id", "v.label", "v.vector")


def matrix(vectors: list, width: int | None = None) -> np.ndarray:
    """Rows of integers as doubles, or as 64-bit integers where products might be inexact."""
    width = max((len(v) for v in vectors), default=0) if width is None else width
    if all(len(v) == width for v in vectors):
        out = np.array(vectors, np.int64).reshape(len(vectors), width)
    else:
        out = np.zeros((len(vectors), width), np.int64)
        for row, v in zip(out, vectors):
            row[:min(len(v), width)] = v[:width]
    return out


def arithmetic(a: np.ndarray, b: np.ndarray) -> type:
    """The type in which all inner products of rows of ``a`` and ``b`` are exact."""
    most = float(np.abs(a).astype(float).max(initial=0)) * float(np.abs(b).astype(float).max(initial=0)) * max(1, a.shape[1])
    if most >= 2.0**55:
        raise ValueError("scores of these vectors may not fit into 64 bits, a hundred times over")
    return np.float64 if most < 2.0**53 else np.int64


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((x * x).sum(1))
    return x / np.where(length > 0, length, 1.0)[:, None], length


def centroids(anchors: DataFrame) -> np.ndarray:
    """Directions of clusters, fitted on a bounded sample of anchors."""
    rows = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    if not rows:
        return np.zeros((1, 1))
    points, _ = _unit(matrix([r["vector"] for r in rows]).astype(float))
    found = points[:CLUSTERS]
    for _ in range(ROUNDS):
        near = (points @ found.T).argmax(1)
        found = np.stack([points[near == c].sum(0) if (near == c).any() else found[c] for c in range(len(found))])
        found, _ = _unit(found)
    return found


def walk(anchors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[np.ndarray]:
    """Member, band, score and id of each band's best ``k`` candidates.

    ``reach`` are the candidates' bounds, which fall along the list; a member's score is at
    most its own length times that.  Band j of member m takes scores of low[m, j] to
    high[m, j]; an empty one has low above high.
    """
    kind = arithmetic(anchors, vectors)
    anchors, vectors = anchors.astype(kind), vectors.astype(kind)
    length = np.sqrt((anchors.astype(float) ** 2).sum(1))
    need = np.where(low <= high, low, EDGE)  # a lower score is of no use
    best = [np.zeros(0, np.int64)] * 4
    live = np.arange(len(anchors))
    for at in range(0, len(ids), STEP):
        bound = length[live] * reach[at] * (1 + 1e-9) + 1e-6
        live = live[((need[live] < EDGE) & (need[live] <= bound[:, None])).any(1)]
        if not len(live):
            break
        scores = anchors[live] @ vectors[at:at + STEP].T
        hit = (scores >= need[live].min(1)[:, None]) & (scores <= high[live].max(1)[:, None])
        m, c = np.nonzero(hit)
        if not len(m):
            continue
        value = scores[m, c].astype(np.int64)
        member = live[m]
        h, j = np.nonzero((value[:, None] >= need[member]) & (value[:, None] <= high[member]))
        rows = [np.concatenate([b, x]) for b, x in zip(best, (member[h], j, value[h], ids[at:at + STEP][c[h]]))]
        order = np.lexsort((rows[3], -rows[2], rows[1], rows[0]))
        rows = [r[order] for r in rows]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        place = np.arange(len(order)) - first
        best = [r[place < k] for r in rows]
        full = place[place < k] == k - 1
        need[best[0][full], best[1][full]] = best[2][full]
    return best


def _tile(found: np.ndarray, k: int, same: bool):
    """Walks of all anchors of a tile along their clusters' lists of its candidates."""
    columns = ["anchor_id", "slot", "score", "vec_id"]

    def run(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(anchors):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        width = max(max(map(len, candidates["vector"])), max(map(len, anchors["vector"])), found.shape[1])
        own, label, ids = (matrix(candidates["vector"].tolist(), width), candidates["label"].to_numpy(np.int64), candidates["vec_id"].to_numpy(np.int64))
        them, their_label, their_id = matrix(anchors["vector"].tolist(), width), anchors["label"].to_numpy(np.int64), anchors["vec_id"].to_numpy(np.int64)
        low = np.stack([np.asarray(v, np.int64) for v in anchors["low"]])
        high = np.stack([np.asarray(v, np.int64) for v in anchors["high"]])
        centre = np.zeros((len(found), width))
        centre[:, :found.shape[1]] = found
        unit, length = _unit(own.astype(float))
        their_unit, _ = _unit(them.astype(float))
        nearness = their_unit @ centre.T
        cluster = nearness.argmax(1)
        out = []
        for c in np.unique(cluster):
            members = np.flatnonzero(cluster == c)
            angle = np.arccos(np.clip(unit @ centre[c], -1, 1))
            widest = np.arccos(np.clip(nearness[members, c], -1, 1)).max()
            reach = length * np.cos(np.maximum(0.0, angle - widest - 1e-7))
            listed = np.lexsort((ids, -reach))
            for one in np.unique(their_label[members]):
                mine = members[their_label[members] == one]
                kept = listed[(label[listed] == one) == same]
                m, j, s, i = walk(them[mine], ids[kept], own[kept], reach[kept], low[mine], high[mine], k)
                out.append(np.stack([their_id[mine[m]], j, s, i], 1))
        return pd.DataFrame(np.concatenate(out), columns=columns)

    return run


def _best(candidates: DataFrame, anchors: DataFrame, sizes: tuple[int, int], found: np.ndarray, k: int, same: bool) -> DataFrame:
    """anchor_id, slot, score, vec_id, rank: the best ``k`` of every anchor's bands, over all tiles."""
    spark = candidates.sparkSession
    # No tile is larger than TILE; small tables are still cut into a tile for every task slot.
    blocks = max(-(-sizes[0] // TILE), min(spark.sparkContext.defaultParallelism, -(-sizes[0] // STEP)))
    parts = -(-sizes[1] // TILE)
    fan = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    deal = lambda n, seed, name: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int").alias(name)
    tile = ["block", "part"]
    left = candidates.select("*", deal(blocks, 1, "block"), fan(parts, "part")).repartition(blocks * parts, *tile).groupBy(*tile)
    right = anchors.select("*", fan(blocks, "block"), deal(parts, 2, "part")).repartition(blocks * parts, *tile).groupBy(*tile)
    met = left.cogroup(right).applyInPandas(_tile(found, k, same), "anchor_id long, slot long, score long, vec_id long")
    on = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(on)).filter(F.col("rank") <= k)


def mined(rows: DataFrame, anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id (distinct), label, vector; ``anchor`` tells which rows are anchors.
    """
    rows = stored(rows, "vectors")
    anchors = stored(rows.filter(anchor), "anchors")
    sizes = rows.count(), anchors.count()
    if not sizes[1]:
        return rows.limit(0).select(*[F.col("vec_id").alias(c) for c in ("anchor_id", "positive_id")], F.lit(1).alias("rank"),
                                    *[F.col("vec_id").alias(c) for c in ("negative_id", "positive_score", "negative_score")])
    found = centroids(anchors)
    # One more than asked for: an anchor is the best match of its own label, as a rule.
    first = _best(rows, anchors.withColumns({"low": F.array(F.lit(-EDGE)), "high": F.array(F.lit(EDGE))}), sizes, found, N_POSITIVES + 1, True)
    again = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    positives = first.filter("vec_id <> anchor_id").withColumn("slot", F.row_number().over(again) - 1).filter(F.col("slot") < N_POSITIVES)
    positives = stored(positives.select("anchor_id", F.col("slot").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("p.positive_score")
    bands = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("ps"))

    def bands_of(hundredths: int, sign: int, none: int) -> Column:
        """Whole numbers: 100 n >= 50 p is -n <= floor(-50 p / 100); slots without a positive have an empty band."""
        x = lambda p: p * (sign * hundredths)
        least = lambda p: ((x(p) - F.pmod(x(p), F.lit(100))) / 100 * sign).cast("long")
        return F.transform(F.sequence(F.lit(0), F.lit(N_POSITIVES - 1)), lambda k: F.coalesce(least(F.get("ps", k)["positive_score"]), F.lit(none)))

    asked = anchors.join(bands, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "vector", bands_of(LOW, -1, EDGE).alias("low"), bands_of(HIGH, 1, -EDGE).alias("high"))
    second = _best(rows, stored(asked, "asked"), sizes, found, N_NEGATIVES, False)
    return second.alias("n").join(positives.alias("p"), ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("n.vec_id").alias("negative_id"), score.alias("positive_score"), F.col("n.score").alias("negative_score"))
