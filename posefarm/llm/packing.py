"""Order-preserving packing: the tokens of a stream of documents are cut into sequences of
at most LENGTH tokens, at document or sentence ends, by dynamic programming.

For cut places p[0] < p[1] < ... of the stream, the least cost up to p[j] is the least of
cost[i] + padding(p[j] - p[i]) + penalty(j) over the i within LENGTH tokens.  Padding is
LENGTH minus the window, so the least cost[i] + p[i] of a sliding window is wanted, which a
monotone queue yields in constant time a place.  A window of a power of two needs no
padding; these few transitions are looked up by place.  Cutting a document costs
AT_SENTENCE at a sentence end and INSIDE within a sentence; places within a sentence are
offered every STRIDE tokens where a sentence is longer than that.

Documents keep the order of their partition; every partition is a stream of its own, worked
off in blocks of BLOCK tokens whose last sequence is carried over.  No text is shuffled.

Cases: a null or empty text is its end mark alone.  Repeated rows are packed each by
itself.  Extra columns are not read.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posefarm.llm.text import buffers
from posefarm.llm.tokens import word_ids

LENGTH = 2048
BLOCK = 128 * LENGTH
STRIDE = 256
AT_SENTENCE, INSIDE = 4, 24
END_MARK = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(place: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices of the chosen places, the first and last included.  ``place`` rises from 0 in
    steps of at most ``length``."""
    n = len(place)
    jumps: dict[int, list[int]] = {}
    k = 1
    while k < length:
        at = np.searchsorted(place, place - k)
        for j in np.flatnonzero((place >= k) & (place[at] == place - k)).tolist():
            jumps.setdefault(j, []).append(int(at[j]))
        k *= 2
    whole = length & (length - 1) == 0
    p, pen = place.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    keys, spots, head = [0], [0], 0  # a queue of rising cost + place, and its places' indices
    add_key, add_spot = keys.append, spots.append
    for j in range(1, n):
        here = p[j]
        while p[spots[head]] < here - length:
            head += 1
        least, i = keys[head], spots[head]
        best = least - p[i] if whole and here - p[i] == length else least + length - here
        if j in jumps:
            for o in jumps[j]:
                if cost[o] < best:
                    best, i = cost[o], o
        best += pen[j]
        cost[j], back[j] = best, i
        key = best + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            spots.pop()
        add_key(key)
        add_spot(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def places(docs: list[np.ndarray], ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut places of joined documents and the penalty of each."""
    flat = np.concatenate(docs)
    ends = np.cumsum([len(d) for d in docs])
    cost = np.full(len(flat) + 1, -1, np.int64)
    cost[1:][ends_sentence[flat]] = AT_SENTENCE
    cost[0] = 0
    cost[ends] = 0
    known = np.flatnonzero(cost >= 0)
    gaps = np.diff(known)
    for a, gap in zip(known[:-1][gaps > STRIDE].tolist(), gaps[gaps > STRIDE].tolist()):
        cost[a + STRIDE:a + gap:STRIDE] = INSIDE
    place = np.flatnonzero(cost >= 0)
    return place, cost[place]


class Packer:
    """Turns a stream of (doc_id, ids) into pieces."""

    def __init__(self, ends_sentence: np.ndarray, base: int, length: int = LENGTH, block: int = BLOCK):
        self.ends_sentence, self.sequence, self.length, self.block = ends_sentence, base, length, block
        self.waiting: list[tuple] = []  # (doc_id, all ids, first waiting id)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.waiting.append((doc_id, ids, 0))
        self.size += len(ids)
        return self.flush(False) if self.size >= self.block else []

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of all sequences, but for the last one unless nothing follows."""
        if not self.waiting:
            return []
        place, penalty = places([ids[at:] for _, ids, at in self.waiting], self.ends_sentence)
        cuts = place[best_cuts(place, penalty, self.length)].tolist()
        if not last and len(cuts) > 2:
            cuts.pop()
        out, base, k = [], 0, 0
        kept: list[tuple] = []
        for doc_id, ids, at in self.waiting:
            end = base + len(ids) - at
            here = base
            while here < end and here < cuts[-1]:
                while cuts[k + 1] <= here:
                    k += 1
                stop = min(end, cuts[k + 1])
                s = at + here - base
                out.append((doc_id, s, stop - here, zlib.crc32(ids[s:s + stop - here].tobytes()), len(ids), self.sequence + k, here - cuts[k]))
                here = stop
            if here < end:
                kept.append((doc_id, ids, at + here - base))
            base = end
        self.waiting, self.size = kept, sum(len(ids) - at for _, ids, at in kept)
        self.sequence += len(cuts) - 1
        return out


def sentence_ends(tokenizer) -> np.ndarray:
    """For every id whether it is a word-ending full stop, exclamation or question mark."""
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.endswith("</w>") and token[:-4] and not token[:-4].strip(".!?")]] = True
    out[END_MARK] = False
    return out


def pack(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text); every row ends with END_MARK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_file, False)
        packer = Packer(sentence_ends(ids_of.tokenizer), TaskContext.get().partitionId() << 40)
        mark = np.array([END_MARK], "<u4").tobytes()
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names)

        for batch in batches:
            raw, at = buffers(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of.many([raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:])])):
                pieces = packer.add(doc_id, np.frombuffer(ids + mark, "<u4"))
                if pieces:
                    yield table(pieces)
        pieces = packer.flush(True)
        if pieces:
            yield table(pieces)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
