"""Quality classifier: learned vectors of hashed word and character n-grams, averaged over a
document, with a softmax on top.

Four families of features (words, word pairs, runs of three and of four bytes within a word
and its borders) have BUCKETS vectors each.  A document is the mean of its families' mean
vectors; vectors and softmax weights are learned by numpy gradient steps on small batches.
Since the softmax of a mean needs only each vector's share of the logit, scoring is one
lookup a feature.

The classifier learns from at most SAMPLE labelled documents, those of smallest hash; the
bound does not depend on the input.  Everything else covers all rows and whole texts.

Cases: a null or empty text has no feature and scores by the bias alone.  Labels that are
null or contradict each other for a doc_id are left out.  Without labels of both kinds every
score is the share of good ones, 0.5 if there are none.  Repeated rows share their result.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.llm import text

BUCKETS = 1 << 13
FAMILIES, DIMENSIONS = 4, 12
SAMPLE = 4000
EPOCHS, BATCH, RATE = 12, 32, 0.25
THRESHOLD = 0.7

_BLANK = text.DELIMITER


def held_out(doc_id: Column) -> Column:
    """Rows that labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def families(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family: feature numbers, and the place of each text's first one (one more at the end)."""
    hashes, place = text.words(raw, at, lower=False)
    shift = np.uint64(64 - 13)
    yield (hashes >> shift).astype(np.int64), place
    pairs = text.grams(hashes, 2)
    pairs[hashes[:len(pairs)] == hashes[1:]] = 0  # any word said twice is one feature
    row = np.repeat(np.arange(len(at) - 1), np.diff(place))
    same = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    kept = np.flatnonzero(same)
    yield (pairs[kept] >> shift).astype(np.int64), np.searchsorted(kept, place)
    blank = _BLANK[raw]
    code = np.where(blank, 32, raw).astype(np.uint32)
    for n in (3, 4):
        size = max(0, len(raw) - n + 1)
        total = code[:size].copy()
        ok = np.ones(size, bool)
        for k in range(1, n):
            total = total * np.uint32(0x01000193) + code[k:size + k]
            if k < n - 1:
                ok &= ~blank[k:size + k]
        for edge in range(1, n):  # runs that would leave their text
            last = at[1:-1] - edge
            ok[last[(last >= 0) & (last < size)]] = False
        kept = np.flatnonzero(ok)
        yield ((total[kept] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64), np.searchsorted(kept, at)


def _counts(docs: DataFrame) -> DataFrame:
    """label, feature numbers and their weights, for rows of label and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, at in text.slices(batch.column(1)):
                parts = [list() for _ in range(end - first)]
                for f, (ids, place) in enumerate(families(raw, at)):
                    for r in range(end - first):
                        own = ids[place[r]:place[r + 1]]
                        if len(own):
                            known, n = np.unique(own, return_counts=True)
                            parts[r].append((known + f * BUCKETS, n / (FAMILIES * len(own))))
                which = [np.concatenate([p[0] for p in x]) if x else np.zeros(0, np.int64) for x in parts]
                weight = [np.concatenate([p[1] for p in x]) if x else np.zeros(0) for x in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([w.astype(np.int32) for w in which], pa.list_(pa.int32())),
                                                  pa.array([w.astype(np.float32) for w in weight], pa.list_(pa.float32()))], ["label", "which", "weight"])

    return docs.mapInArrow(run, "label int, which array<int>, weight array<float>")


def fit(label: np.ndarray, which: list[np.ndarray], weight: list[np.ndarray], seed: int = 11) -> tuple[np.ndarray, float]:
    """(each feature's share of the logit, bias)."""
    draw = np.random.default_rng(seed)
    share = float(label.mean()) if len(label) else 0.5
    if not 0 < share < 1:
        return np.zeros(FAMILIES * BUCKETS, np.float32), 30.0 * np.sign(share - 0.5)
    vectors = draw.normal(0, 0.1, (FAMILIES * BUCKETS, DIMENSIONS)).astype(np.float32)
    top = draw.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    seen_v, seen_t, seen_b = np.full(len(vectors), 1e-6, np.float32), np.full_like(top, 1e-6), np.full_like(bias, 1e-6)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = draw.permutation(len(label))
        for at in range(0, len(order), BATCH):
            few = order[at:at + BATCH]
            ids, place = np.unique(np.concatenate([which[i] for i in few]), return_inverse=True)
            x = np.zeros((len(few), len(ids)), np.float32)
            x[np.repeat(np.arange(len(few)), [len(which[i]) for i in few]), place] = np.concatenate([weight[i] for i in few])
            own = vectors[ids]
            mean = x @ own
            logit = mean @ top + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(few)), label[few]] -= 1
            p /= len(few)
            slope = x.T @ (p @ top.T)
            for value, seen, g, rows in ((top, seen_t, mean.T @ p, slice(None)), (bias, seen_b, p.sum(0), slice(None))):
                seen[rows] += g * g
                value[rows] -= rate * g / np.sqrt(seen[rows])
            seen_v[ids] += (slope * slope).mean(1)
            vectors[ids] = own - rate * slope / np.sqrt(seen_v[ids])[:, None]
    return vectors @ (top[:, 1] - top[:, 0]), float(bias[1] - bias[0])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of labelled rows; only that sample meets in one task."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other AND label IN (0, 1)")
    few = known.select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    counted = _counts(texts.select("label", "text"))

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label, which, weight = [], [], []
        for f in frames:
            label += f["label"].tolist()
            which += [np.asarray(w) for w in f["which"]]
            weight += [np.asarray(w) for w in f["weight"]]
        order = sorted(range(len(label)), key=lambda i: (label[i], len(which[i]), float(weight[i].sum()), which[i].tobytes()))
        shares, bias = fit(np.array([label[i] for i in order], int), [which[i] for i in order], [weight[i] for i in order])
        yield pd.DataFrame({"shares": [shares.astype(np.float32).tobytes()], "bias": [bias]})

    row = counted.repartition(1).mapInPandas(train, "shares binary, bias double").first()
    return np.frombuffer(row["shares"], np.float32), row["bias"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, bias = known.value
        for batch in batches:
            for first, end, raw, at in text.slices(batch.column(1)):
                logit = np.full(end - first, bias)
                for f, (ids, place) in enumerate(families(raw, at)):
                    sums = np.concatenate([[0.0], np.cumsum(shares[ids + f * BUCKETS], dtype=np.float64)])
                    n = np.diff(place)
                    logit += (sums[place[1:]] - sums[place[:-1]]) / np.maximum(n, 1) / FAMILIES
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))],
                                                 ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
