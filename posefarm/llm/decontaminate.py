"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased.  The document frequency of every
3-word gram of the benchmark is counted over all documents.  Within each SPAN
neighbouring grams of an item the rarest is a seed, so every stretch of SPAN + 2 words of an
item holds one and no part of an item goes unseeded, however common its words are.  Around
every place where a document has a seed, the document's words and the item are aligned
locally: a match scores 2, a mismatch or a gap costs 1.

A document is contaminated by an item of m words if the best score is at least
2 * m * RATIO and at least 2 * min(m, LEAST): half of the item, edits included, or all of a
very short one.

The items travel to the tasks as a broadcast of at most BLOCK bytes of text; a larger
benchmark is worked off in such blocks, one pass over the documents each.

Cases: null or empty texts have no seeds and are clean; items of fewer than SEED words have
no seed and match nothing; an empty benchmark leaves all documents clean.  Repeated rows
share their result.  Ties between items go to the smaller item_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posefarm.llm import text
from posefarm.llm.store import packed, unpacked

SEED, SPAN = 3, 4
RATIO, LEAST = 0.5, 8
BLOCK = 8 << 20
_RESULT = [("seed_hits", T.LongType()), ("item_id", T.LongType()), ("score", T.LongType()), ("ratio", T.DoubleType()), ("contaminated", T.BooleanType())]


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word fingerprints, places) of slices of a text column."""
    for first, end, raw, at in text.slices(pc.utf8_lower(column)):
        yield first, end, *text.words(raw, at, False, text.MARKS)


def _gram_rows(place: np.ndarray, n: int) -> np.ndarray:
    """The text of every gram start, -1 where a gram would leave its text."""
    size = max(0, place[-1] - n + 1)
    row = np.repeat(np.arange(len(place) - 1), np.diff(place))[:size]
    row[np.arange(size) + n > place[1:][row]] = -1
    return row


def item_words(items: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, hashes, place in _words(pa.array(items, pa.string())):
        out += [hashes[a:b] for a, b in zip(place[:-1], place[1:])]
    return out


def item_grams(items: list[np.ndarray]) -> np.ndarray:
    """All different grams of a block of items, sorted."""
    return np.unique(np.concatenate([text.grams(w, SEED) for w in items] + [np.zeros(0, np.uint64)]))


def document_frequency(docs: DataFrame, grams: np.ndarray) -> np.ndarray:
    """How many documents have each gram; tasks send counts of a block's grams only."""
    known = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, _, hashes, place in _words(batch.column(0)):
                row = _gram_rows(place, SEED)
                found = text.grams(hashes, SEED)
                at = np.searchsorted(wanted, found)
                at[at == len(wanted)] = 0
                hit = (wanted[at] == found) & (row >= 0)
                pairs = np.unique(np.stack([row[hit], at[hit]], 1), axis=0)
                total += np.bincount(pairs[:, 1], minlength=len(wanted))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(len(grams), np.int64)
    if len(grams):
        counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        for gram, n in counted.toLocalIterator():
            out[gram] = n
    return out


def seeds(items: list[np.ndarray], grams: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, item, place) of the rarest gram within every SPAN neighbours, sorted by gram."""
    found = []
    for i, words in enumerate(items):
        own = text.grams(words, SEED)
        if not len(own):
            continue
        # Equally rare grams are told apart by their fingerprint, so that neighbours agree on one.
        n = frequency[np.searchsorted(grams, own)] + own.astype(np.float64) / 2.0**65
        width = min(SPAN, len(own))
        least = np.lib.stride_tricks.sliding_window_view(n, width).argmin(1)
        at = np.unique(least + np.arange(len(least)))
        found.append(np.stack([own[at], np.full(len(at), i, np.uint64), at.astype(np.uint64)], 1))
    table = np.concatenate(found) if found else np.zeros((0, 3), np.uint64)
    table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
    return table[:, 0], table[:, 1].astype(np.int64), table[:, 2].astype(np.int64)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of every (item, passage): all in step, one item word a time."""
    rows, wide = max(map(len, items)), max(map(len, passages))
    left = np.zeros((len(items), rows), np.uint64)
    right = np.ones((len(items), wide), np.uint64)
    for k, (a, b) in enumerate(zip(items, passages)):
        left[k, :len(a)], right[k, :len(b)] = a, b
    steps = np.arange(wide, dtype=np.int32)
    above = np.zeros((len(items), wide + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    for r in range(rows):
        here = np.maximum(above[:, :-1] + np.where(right == left[:, r:r + 1], 3, 0).astype(np.int32) - 1, above[:, 1:] - 1)
        np.maximum(here, 0, out=here)
        # A gap in the item: the best earlier cell less the distance to it.
        here = np.maximum.accumulate(here + steps, 1) - steps
        above[:, 1:] = here
        np.maximum(best, here.max(1), out=best)
    return best


def _windows(hits: np.ndarray, lengths: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, word after the last) around hits (text, item, first word of
    the item's diagonal), overlapping ones merged."""
    out: list[tuple[int, int, int, int]] = []
    for row, item, start in hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))].tolist():
        slack = 4 + lengths[item] // 3
        a, b = max(int(place[row]), start - slack), min(int(place[row + 1]), start + lengths[item] + slack)
        if out and out[-1][:2] == (row, item) and a <= out[-1][3]:
            out[-1] = (row, item, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((row, item, a, int(b)))
    return out


def _best(hashes: np.ndarray, place: np.ndarray, items: list[np.ndarray], table) -> dict[int, tuple]:
    """text -> (seed hits, item, score, ratio, contaminated) for texts with a seed."""
    gram, of, at = table
    found, row = text.grams(hashes, SEED), _gram_rows(place, SEED)
    low, high = np.searchsorted(gram, found), np.zeros(0)
    probe = np.minimum(low, max(0, len(gram) - 1))
    hit = np.flatnonzero((gram[probe] == found) & (row >= 0)) if len(gram) else np.zeros(0, np.int64)
    if not len(hit):
        return {}
    high = np.searchsorted(gram, found[hit], "right")
    many = high - low[hit]
    entry = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    spot = np.repeat(hit, many)
    lengths = np.array([len(x) for x in items])
    windows = _windows(np.unique(np.stack([row[spot], of[entry], spot - at[entry]], 1), axis=0), lengths, place)
    seen = np.bincount(row[hit], minlength=len(place) - 1)
    out: dict[int, tuple] = {}
    order = sorted(windows, key=lambda w: w[3] - w[2])
    step = 0
    while step < len(order):
        few = max(1, min(256, (1 << 18) // (order[min(step + 255, len(order) - 1)][3] - order[min(step + 255, len(order) - 1)][2] + 1)))
        part = order[step:step + few]
        step += few
        for (r, i, a, b), score in zip(part, align([items[w[1]] for w in part], [hashes[w[2]:w[3]] for w in part]).tolist()):
            m = len(items[i])
            bad = score >= 2 * m * RATIO and score >= 2 * min(m, LEAST)
            new = (int(seen[r]), i, score, score / (2 * m), bad)
            old = out.get(r)
            if old is None or (new[4], new[3], -new[1]) > (old[4], old[3], -old[1]):
                out[r] = new
    return out


def _later(item: int | None) -> tuple[bool, int]:
    """Order of items of equal score: a null comes first, then the smaller item_id."""
    return item is not None, item or 0


def with_overlap(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``rows`` (any columns, ``text`` among them) with seed_hits, item_id, score, ratio and
    contaminated: the best aligned item, nulls and 0 where no seed is found."""
    sc = rows.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    out = rows.withColumns({"seed_hits": F.lit(0).cast("long"), "item_id": F.lit(None).cast("long"), "score": F.lit(0).cast("long"),
                            "ratio": F.lit(0.0), "contaminated": F.lit(False)})
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in _RESULT]])
    keep = len(rows.columns)
    where = rows.columns.index("text")
    for block in range(blocks):
        few = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        ids, words = [r[0] for r in few], item_words([r[1] for r in few])
        grams = item_grams(words)
        known = sc.broadcast((ids, words, seeds(words, grams, document_frequency(rows, grams))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, words, table = known.value
            for batch in batches:
                hits, item, score, ratio, bad = [batch.column(keep + k).to_pylist() for k in range(5)]
                for first, _, hashes, place in _words(batch.column(where)):
                    for r, (n, i, s, share, verdict) in _best(hashes, place, words, table).items():
                        r += first
                        hits[r] += n
                        if not score[r] or (verdict, share, _later(item[r])) > (bad[r], ratio[r], _later(ids[i])):
                            item[r], score[r], ratio[r], bad[r] = ids[i], s, share, verdict
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(hits, pa.int64()), pa.array(item, pa.int64()),
                                                  pa.array(score, pa.int64()), pa.array(ratio, pa.float64()), pa.array(bad, pa.bool_())], batch.schema.names)

        if len(grams):
            out = out.mapInArrow(run, schema)
    return out


def overlap(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id with the best aligned item of every row of ``docs`` (doc_id, text)."""
    return with_overlap(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark).drop("text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean rows of ``docs``, with all their columns."""
    rows = packed(docs, docs["text"].cast("string").alias("text"))
    return unpacked(with_overlap(rows, benchmark).filter("NOT contaminated"), docs.columns)
