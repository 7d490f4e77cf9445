"""Token files: ids in blocks, each coded by an adaptive context-mixing range coder.

A block holds whole documents.  Its ids are cut into LANES stretches that are coded in step,
so every operation is one numpy call over all lanes; they share the models of their block,
which start afresh in every block.  For each id the models predict

  * the id that last followed the two ids before it (order 2), with a count of its successes,
  * the id that last followed the id before it (order 1), likewise,
  * and a distribution of all ids by frequency (order 0).

Whether the first guess holds, and else whether the second does, are two probabilities, each
mixed in the logistic domain from adaptive tables of both orders with weights that learn
from the outcome.  Guesses and frequencies together give the interval of the id for the
range coder (carry-less, 64 bits).  All arithmetic is in integers, so a file reads back the
same anywhere.

Layout of a block: magic, number of ids, documents and lanes, CRC-32 of the ids, sizes; then
doc_ids and lengths, lengths of the lanes' codes, the codes; last a CRC-32 of all of that.

A file is one range of doc_ids, as Parquet rows of one block each, written and committed by
Spark; the manifest has the number of ids of every file, so a document's start is known.

Cases: a null or empty text is its end id alone.  Repeated rows are written each, rows of
one doc_id in order of their text; null ids come first.  An empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posefarm.llm.store import stored
from posefarm.llm.text import buffers
from posefarm.llm.tokens import word_ids

MAGIC = b"CMIX\x01"
END_ID = 2
#: Ids after which a block is closed; lanes of a full block.
BLOCK, LANES = 1 << 20, 4096
SLOTS = 1 << 18
REFRESH, STEP, MOST = 8, 24, 1 << 22
_TOP, _BOTTOM = np.uint64(1 << 56), np.uint64(1 << 48)
_EIGHT = np.uint64(8)

#: Logistic table over -2047 .. 2047 (1/256 units) to 16 bits, and its inverse by 12-bit probability.
_SQUASH = np.array([round(65536 / (1 + np.exp(-x / 256.0))) for x in range(-2047, 2048)], np.int64).clip(48, 65536 - 48)
_STRETCH = np.array([round(256 * np.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int64).clip(-2047, 2047)


class Mixer:
    """Probability (16 bits) of a yes from two contexts."""

    def __init__(self, first: int, second: int):
        self.tables = [np.full(first, 32768, np.int64), np.full(second, 32768, np.int64)]
        self.weights = [38000, 28000]

    def predict(self, contexts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        self.contexts = contexts
        self.inputs = [_STRETCH[t[c] >> 4] for t, c in zip(self.tables, contexts)]
        total = (self.inputs[0] * self.weights[0] + self.inputs[1] * self.weights[1]) >> 16
        self.said = _SQUASH[total.clip(-2047, 2047) + 2047]
        return self.said

    def learn(self, yes: np.ndarray) -> None:
        n = len(yes)
        off = (yes.astype(np.int64) << 16) - self.said
        for k, (table, context) in enumerate(zip(self.tables, self.contexts)):
            seen = np.bincount(context, minlength=len(table))
            hits = np.bincount(context[yes], minlength=len(table))
            goal = (hits * 65535) // np.maximum(seen, 1)
            table += np.where(seen > 0, (goal - table) >> 3, 0)
            np.clip(table, 16, 65519, out=table)
            self.weights[k] = min(131072, max(0, self.weights[k] + (int((off * self.inputs[k]).sum()) // n >> 10)))


class Model:
    """What the coder and the reader know alike after the same ids."""

    def __init__(self, size: int, lanes: int):
        self.size = size
        self.guess2, self.count2 = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.guess1, self.count1 = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.second, self.first = Mixer(32, 32), Mixer(16, 16)
        self.frequency = np.ones(size, np.int64)
        self.waiting: list[np.ndarray] = []
        self._sum()
        self.before1, self.before2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def _sum(self) -> None:
        self.upto = np.concatenate([[0], np.cumsum(self.frequency)]).astype(np.uint64)

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order-2 guess, order-1 guess, 16-bit widths of both) of the first m lanes."""
        b1, b2 = self.before1[:m], self.before2[:m]
        self.slot = ((b2 * 0x9E3779B1 + b1 * 0x85EBCA6B) >> 7) & (SLOTS - 1)
        self.g2, self.n2 = self.guess2[self.slot], self.count2[self.slot]
        self.g1, self.n1 = self.guess1[b1], self.count1[b1]
        self.same = self.g1 == self.g2
        wide2 = self.second.predict((self.n2 * 2 + self.same, self.n1 * 2 + self.same))
        wide1 = ((65536 - wide2) * self.first.predict((self.n1, self.n2))) >> 16
        return self.g2, self.g1, wide2, np.where(self.same, 0, wide1)

    def learn(self, ids: np.ndarray) -> None:
        m = len(ids)
        hit2, hit1 = ids == self.g2, ids == self.g1
        self.second.learn(hit2)
        self.first.learn(hit1)
        for guess, count, where, g, n, hit in ((self.guess2, self.count2, self.slot, self.g2, self.n2, hit2),
                                               (self.guess1, self.count1, self.before1[:m], self.g1, self.n1, hit1)):
            n = np.where(hit, np.minimum(n + 1, 15), n >> 1)
            new = ~hit & (n == 0)
            guess[where] = np.where(new, ids, g)
            count[where] = n
        self.waiting.append(ids)
        if len(self.waiting) == REFRESH:
            self.frequency += STEP * np.bincount(np.concatenate(self.waiting), minlength=self.size)
            if self.frequency.sum() > MOST:
                self.frequency = (self.frequency + 1) >> 1
            self.waiting = []
            self._sum()
        self.before2[:m], self.before1[:m] = self.before1[:m].copy(), ids


def _lanes(n: int) -> tuple[int, int]:
    """(lanes, steps) of n ids; the last step may have fewer lanes."""
    lanes = min(LANES, max(1, n // 32))
    return lanes, -(-n // lanes)


def _layout(n: int) -> tuple[int, int, np.ndarray]:
    lanes, steps = _lanes(n)
    long = n - lanes * (steps - 1)  # lanes that have all steps
    starts = np.arange(lanes) * steps - np.maximum(0, np.arange(lanes) - long)
    return long, steps, starts


def encode(ids: np.ndarray, size: int) -> tuple[np.ndarray, bytes]:
    """(length of each lane's code, codes)."""
    ids = ids.astype(np.int64)
    long, steps, starts = _layout(len(ids))
    lanes = len(starts)
    model = Model(size, lanes)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    room = steps * 4 + 64
    out, at = np.zeros((lanes, room), np.uint8), np.zeros(lanes, np.int64)
    for t in range(steps):
        m = lanes if t < steps - 1 else long
        x = ids[starts[:m] + t]
        g2, g1, w2, w1 = model.predict(m)
        hit2 = x == g2
        hit1 = (x == g1) & ~hit2
        begin = np.where(hit2, 0, np.where(hit1, w2, w2 + w1)).astype(np.uint64)
        width = np.where(hit2, w2, np.where(hit1, w1, 65536 - w2 - w1)).astype(np.uint64)
        lo, r = low[:m], wide[:m] >> np.uint64(16)
        lo += r * begin
        r *= width
        rest = np.flatnonzero(~(hit2 | hit1))
        y = x[rest]
        part = r[rest] // model.upto[-1]
        lo[rest] += part * model.upto[y]
        r[rest] = part * (model.upto[y + 1] - model.upto[y])
        wide[:m] = r
        todo = np.arange(m)
        while True:
            a, b = low[todo], wide[todo]
            equal = (a ^ (a + b)) < _TOP
            small = ~equal & (b < _BOTTOM)
            go = equal | small
            todo, a, b, small = todo[go], a[go], b[go], small[go]
            if not len(todo):
                break
            b = np.where(small, (~a + np.uint64(1)) & (_BOTTOM - np.uint64(1)), b)
            if (at[todo] >= room).any():
                out, room = np.concatenate([out, np.zeros_like(out)], 1), room * 2
            out[todo, at[todo]] = (a >> np.uint64(56)).astype(np.uint8)
            at[todo] += 1
            low[todo], wide[todo] = a << _EIGHT, b << _EIGHT
        model.learn(x)
    if (at + 8 > room).any():
        out = np.concatenate([out, np.zeros_like(out)], 1)
    for k in range(8):
        out[np.arange(lanes), at + k] = (low >> np.uint64(56 - 8 * k)).astype(np.uint8)
    at += 8
    return at, out[np.arange(out.shape[1]) < at[:, None]].tobytes()


def decode(n: int, size: int, lengths: np.ndarray, codes: bytes) -> np.ndarray:
    ids = np.zeros(n, np.int64)
    long, steps, starts = _layout(n)
    lanes = len(starts)
    model = Model(size, lanes)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    data = np.frombuffer(codes + bytes(16), np.uint8).astype(np.uint64)
    at = np.cumsum(lengths) - lengths
    code = np.zeros(lanes, np.uint64)
    for _ in range(8):
        code = (code << _EIGHT) | data[at]
        at = at + 1
    for t in range(steps):
        m = lanes if t < steps - 1 else long
        g2, g1, w2, w1 = model.predict(m)
        lo, r = low[:m], wide[:m] >> np.uint64(16)
        spot = np.minimum((code[:m] - lo) // r, np.uint64(65535)).astype(np.int64)
        hit2 = spot < w2
        hit1 = ~hit2 & (spot < w2 + w1)
        x = np.where(hit2, g2, g1)
        begin = np.where(hit2, 0, np.where(hit1, w2, w2 + w1)).astype(np.uint64)
        width = np.where(hit2, w2, np.where(hit1, w1, 65536 - w2 - w1)).astype(np.uint64)
        lo += r * begin
        r *= width
        rest = np.flatnonzero(~(hit2 | hit1))
        part = r[rest] // model.upto[-1]
        place = np.minimum((code[rest] - lo[rest]) // part, model.upto[-1] - np.uint64(1))
        y = np.searchsorted(model.upto, place, "right") - 1
        x[rest] = y
        lo[rest] += part * model.upto[y]
        r[rest] = part * (model.upto[y + 1] - model.upto[y])
        wide[:m] = r
        todo = np.arange(m)
        while True:
            a, b = low[todo], wide[todo]
            equal = (a ^ (a + b)) < _TOP
            small = ~equal & (b < _BOTTOM)
            go = equal | small
            todo, a, b, small = todo[go], a[go], b[go], small[go]
            if not len(todo):
                break
            b = np.where(small, (~a + np.uint64(1)) & (_BOTTOM - np.uint64(1)), b)
            code[todo] = (code[todo] << _EIGHT) | data[at[todo]]
            at[todo] += 1
            low[todo], wide[todo] = a << _EIGHT, b << _EIGHT
        ids[starts[:m] + t] = x
        model.learn(x)
    return ids


_HEAD = struct.Struct("<5sIIIIII")


def write_block(doc_ids: list, docs: list[np.ndarray], size: int) -> bytes:
    """One block of whole documents; a doc_id of None is allowed."""
    ids = np.concatenate(docs)
    lengths, codes = encode(ids, size)
    names = zlib.compress(np.array([-1 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
                          + np.array([len(d) for d in docs], "<u4").tobytes(), 1)
    sizes = zlib.compress(lengths.astype("<u4").tobytes(), 1)
    body = _HEAD.pack(MAGIC, len(ids), len(docs), len(lengths), zlib.crc32(ids.astype("<u4").tobytes()), len(names), len(sizes)) + names + sizes + codes
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes, size: int) -> tuple[list, list[np.ndarray]]:
    """(doc_ids, ids of each document); an error if a checksum does not fit."""
    body = block[:-4]
    if zlib.crc32(body) != struct.unpack("<I", block[-4:])[0] or body[:5] != MAGIC:
        raise ValueError("damaged block")
    _, n, many, _, check, name_size, size_size = _HEAD.unpack_from(body)
    at = _HEAD.size
    names = zlib.decompress(body[at:at + name_size])
    at += name_size
    lengths = np.frombuffer(zlib.decompress(body[at:at + size_size]), "<u4").astype(np.int64)
    ids = decode(n, size, lengths, body[at + size_size:]).astype("<u4")
    if zlib.crc32(ids.tobytes()) != check:
        raise ValueError("ids do not fit their checksum")
    known = np.frombuffer(names, "<i8", many).tolist()
    null = np.frombuffer(names, np.uint8, many, 8 * many).tolist()
    ends = np.cumsum(np.frombuffer(names, "<u4", many, 9 * many).astype(np.int64))
    return [None if z else d for d, z in zip(known, null)], np.split(ids, ends[:-1])


def write(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Token files of all rows of ``docs`` (doc_id, text), as a table of file, block, start (ids before it in
    the file), n_tokens, payload; stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_file, True)
        size = max(ids_of.tokenizer.get_vocab_size(), END_ID + 1)
        end = np.array([END_ID], "<u4").tobytes()
        file, block, start = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []
        many = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([start], pa.int64()),
                                               pa.array([many], pa.int64()), pa.array([write_block(names, held, size)], pa.binary())],
                                              ["file", "block", "start", "n_tokens", "payload"])

        for batch in batches:
            raw, at = buffers(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of.many([raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:])])):
                ids = np.frombuffer(ids + end, "<u4")
                names.append(doc_id)
                held.append(ids)
                many += len(ids)
                if many >= BLOCK:
                    yield row()
                    start, block, names, held, many = start + many, block + 1, [], [], 0
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "file long, block long, start long, n_tokens long, payload binary"), "tokens")


def manifest(files: DataFrame) -> DataFrame:
    """(file, first): ids of all files before it; one row a file."""
    sizes = files.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def read(files: DataFrame, size: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, payload in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, docs = read_block(payload, size)
                n = np.array([len(d) for d in docs])
                yield pa.RecordBatch.from_arrays([
                    pa.array([file] * len(docs), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n),
                    pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64())], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.select("file", "start", "payload").mapInArrow(run, "file long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(manifest(files), "file").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary_size(tokenizer_file: str) -> int:
    return max(word_ids(tokenizer_file, True).tokenizer.get_vocab_size(), END_ID + 1)


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write the token files of ``docs`` and read them back."""
    return read(write(docs, tokenizer_file), vocabulary_size(tokenizer_file))
