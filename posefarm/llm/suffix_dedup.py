"""Removal of repeated passages: every byte covered by a SPAN-byte string that also starts
in a document of smaller id, by a distributed merge sort of suffixes.

  1. Seeds.  The hash-least GRAM-byte piece of a SPAN-byte string is its anchor.  Equal
     strings have equal anchors at the same place, so a string can only repeat if its
     anchor does.  Every slice of the documents sends the distinct fingerprints of its
     anchors; those of two slices, or of two documents of one, come back as live.
  2. Runs.  A slice looks at the strings with a live anchor.  Where a document of the slice
     has a smaller id than another with the same string, the other's bytes are removed at
     once.  What is left goes out once a string: neighbouring strings with one anchor make a
     record, the suffix at the anchor and the few bytes before it.  Records are sorted by
     suffix and front-coded, a run for each bucket of anchors.
  3. Merge.  A bucket's runs are combined by a loser tree that keeps, for every waiting
     record, the length of the prefix it is known to share with the last one put out:
     unequal lengths decide without a look at the bytes, equal ones compare behind them.
     Records with one anchor are then neighbours; for each string the smallest id is found
     and every other record learns which of its strings to remove.
     A bucket has as many records as its anchors, so an anchor in more than HOT documents (a
     phrase with other words after it in each) goes another way: its strings become rows, by
     128-bit fingerprints, an aggregate finds the smallest id of each, and a join tells the rest.
  4. Removed ranges meet their documents by a join, and the rest is hashed.

Slices are bounded in bytes, but for a single longer text; parts and buckets by HOT records
for each of the anchors that fall to them.  A string that very many documents share is one
record a slice.

Cases: null counts as empty; shorter texts than SPAN lose nothing.  A row whose doc_id is
null comes after all others: it causes no removal elsewhere.  Rows with one doc_id do not
remove each other's bytes.  Extra columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posefarm.llm import text
from posefarm.llm.store import stored
from posefarm.session import remove_folder, shared_folder, shuffles_freed

SPAN, GRAM = 50, 32
#: Bytes of the number that a suffix (of SPAN bytes at most) is compared by.
WIDE = 56
#: Bytes of text of a slice, of a part of the fingerprints, of a bucket of anchors.
SLICE, PART = 4 << 20, 16 << 20
#: Bytes of text whose fingerprints are gathered before they are sent.
GATHERED = 24 << 20
NO_ID = 2**63 - 1
_INDEX = np.uint64((1 << 24) - 1)
#: Starts of strings whose places are counted from one base.
STRETCH = 1 << 23
#: An anchor in more documents than this is settled string by string, by an aggregate.
HOT = 1 << 14


def strings(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor start, text number) of every SPAN-byte string inside a text, and running sums of the bytes.

    Of pieces of equal hash the leftmost in the string is the anchor, so equal strings have
    it at the same place.  Places are told apart by their distance from a start that is less
    than 2 ** 24 bytes away: longer buffers are looked at in stretches.
    """
    sums = text.running(raw)
    count = np.maximum(0, np.diff(at) - SPAN + 1)
    if not count.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, sums
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + at[:-1][row]
    anchor = np.empty(len(start), np.int64)
    for base in range(int(start[0]), int(start[-1]) + 1, STRETCH):
        a, b = np.searchsorted(start, [base, base + STRETCH])
        if a == b:
            continue
        begin = np.arange(base, int(start[b - 1]) + SPAN - GRAM + 1)
        value = (text.range_hash(sums, begin, begin + GRAM) & ~_INDEX) | (begin - base).astype(np.uint64)
        width = 1
        while width * 2 <= SPAN - GRAM + 1:
            value = np.minimum(value[:-width], value[width:])
            width *= 2
        more = SPAN - GRAM + 1 - width
        value = np.minimum(value[:len(value) - more], value[more:]) if more else value
        anchor[a:b] = (value[start[a:b] - base] & _INDEX).astype(np.int64) + base
    return start, anchor, row, sums


def fingerprints(sums: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return text.mix(text.range_hash(sums, anchor, anchor + GRAM) + np.uint64(77))


def _squeezed(values: np.ndarray) -> bytes:
    """Sorted 32-bit values: differences, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unsqueezed(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _sent(rows: DataFrame, parts: int) -> DataFrame:
    """(slice, part, prints, known, others): distinct fingerprints, those that two documents of
    a task's slice share, and how many documents beside the first have each of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def send() -> pa.RecordBatch:
            prints, piece, row = (np.concatenate(c) for c in zip(*held))
            group = piece * parts + (prints >> np.uint64(32)).astype(np.int64) % parts
            key = group.astype(np.uint64) << np.uint64(32) | prints.astype(np.uint32)
            order = np.argsort(key, kind="stable")  # rows rise already
            key, row = key[order], row[order]
            group, value = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
            new = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(new)
            others = np.add.reduceat(np.append(False, (row[1:] != row[:-1]) & ~new[1:]).astype(np.int64), first)
            twice = others > 0
            edge = np.flatnonzero(np.append(True, np.diff(group[first]) != 0))
            ends = np.append(edge[1:], len(first))
            g = group[first][edge]
            values = value[first]
            return pa.RecordBatch.from_arrays([
                pa.array(g // parts), pa.array(g % parts), pa.array([_squeezed(values[a:b]) for a, b in zip(edge, ends)], pa.binary()),
                pa.array([_squeezed(values[a:b][twice[a:b]]) for a, b in zip(edge, ends)], pa.binary()),
                pa.array([_packed(others[a:b][twice[a:b]]) for a, b in zip(edge, ends)], pa.binary())], ["slice", "part", "prints", "known", "others"])

        base = 0
        for batch in batches:
            piece = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, raw, at in text.slices(batch.column(1)):
                start, anchor, row, sums = strings(raw, at)
                if len(start):
                    pair = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(row) != 0)))
                    held.append((fingerprints(sums, anchor[pair]), piece[first + row[pair]], base + first + row[pair]))
                size += len(raw)
                if size >= GATHERED and held:
                    yield send()
                    held, size = [], 0
            base += batch.num_rows
        if held:
            yield send()

    return rows.select("slice", "text").mapInArrow(run, "slice long, part long, prints binary, known binary, others binary")


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(values.astype("<i8").tobytes())


def _unpacked(blob: bytes, rows: int = 1) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8").reshape(rows, -1)


def _live(sent: DataFrame) -> DataFrame:
    """(slice, part, live, hot): which of a slice's fingerprints two senders have, or two of its
    documents; and which of those more than HOT documents have."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        own = [_unsqueezed(b) for b in frame["prints"]]
        every, documents = np.unique(np.concatenate(own), return_counts=True)
        for known, others in zip(frame["known"], frame["others"]):
            np.add.at(documents, np.searchsorted(every, _unsqueezed(known)), _unpacked(others)[0])

        def of(chosen: np.ndarray) -> list[bytes]:
            ends = np.append(chosen, np.uint32(0))  # a value past the last one is looked up here
            return [_squeezed(o[(ends[spot] == o) & (spot < len(chosen))]) for o, spot in ((o, np.searchsorted(chosen, o)) for o in own)]

        return frame[["slice", "part"]].assign(live=of(every[documents > 1]), hot=of(every[documents > HOT]))

    return sent.groupBy("part").applyInPandas(meet, "slice long, part long, live binary, hot binary")


def encode_run(records: list[tuple[bytes, bytes, int]]) -> bytes:
    """A sorted run of (suffix, bytes before it, id), front-coded."""
    size = np.array([len(r[0]) for r in records])
    wide = np.frombuffer(b"".join([r[0].ljust(WIDE, b"\0") for r in records]), np.uint8).reshape(-1, WIDE)
    apart = np.append(wide[1:] != wide[:-1], np.ones((len(records) - 1, 1), bool), 1).argmax(1)
    prefix = np.append(0, np.minimum(apart, np.minimum(size[1:], size[:-1])))
    rest = [r[0][h:] for r, h in zip(records, prefix.tolist())]
    head = np.array([prefix, size, [len(r[1]) for r in records]], np.uint8).tobytes()
    ids = np.array([r[2] for r in records], "<i8").tobytes()
    body = len(records).to_bytes(4, "little") + head + ids + b"".join(rest) + b"".join([r[1] for r in records])
    return zstandard.ZstdCompressor(1).compress(body)


def decode_run(blob: bytes) -> Iterator[tuple[bytes, int, bytes, int, int]]:
    """(suffix, prefix shared with the one before, bytes before it, id, the suffix as a number of WIDE bytes)."""
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(body[:4], "little")
    prefix, size, before = (np.frombuffer(body, np.uint8, n, 4 + k * n) for k in range(3))
    ids = np.frombuffer(body, "<i8", n, 4 + 3 * n)
    at = 4 + 11 * n
    left = at + int((size.astype(np.int64) - prefix).sum())
    last = b""
    for h, s, b, i in zip(prefix.tolist(), size.tolist(), before.tolist(), ids.tolist()):
        last = last[:h] + body[at:at + s - h]
        yield last, h, body[left:left + b], i, int.from_bytes(last, "big") << 8 * (WIDE - s)
        at += s - h
        left += b


def merged(runs: list[Iterator[tuple[bytes, int, bytes, int, int]]]) -> Iterator[tuple[bytes, int, bytes, int, int]]:
    """All records in order with the prefix shared with the one before, and the number of
    their run: a loser tree over (record, known prefix with the last record put out)."""
    k = 1
    while k < len(runs):
        k *= 2
    now: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0 if x else -1 for x in now]  # a run that has ended knows -1 and loses to all others
    tree = [-1] * k  # losers at 1 .. k-1, the winner at 0

    def beats(a: int, b: int) -> bool:
        """Whether a's record is not after b's, of equal known prefixes; the loser's becomes the one with the winner."""
        x, y = now[a], now[b]
        p, q = len(x[0]), len(y[0])
        apart = x[4] ^ y[4]
        # Numbers are filled up with zeros, so a difference can lie behind the end of a record.
        h = min(p, q, WIDE - 1 - (apart.bit_length() - 1) // 8) if apart else min(p, q)
        if x[4] > y[4] or not apart and p > q:
            known[a] = h
            return False
        known[b] = h
        return True

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        if known[a] > known[b] or known[a] == known[b] and (known[a] < 0 or beats(a, b)):
            a, b = b, a
        tree[node] = a
        return b

    w = build(1)
    while known[w] >= 0:
        suffix, _, before, i, _ = now[w]
        yield suffix, known[w], before, i, w
        x = now[w] = next(runs[w], None)
        mine = known[w] = x[1] if x else -1
        node = (w + k) >> 1
        while node:
            other = tree[node]
            least = known[other]
            if mine < least:
                tree[node], w, mine = w, other, least
            elif mine == least and mine >= 0 and not beats(w, other):
                tree[node], w = w, other
            node >>= 1


def _settle(group: list[tuple[bytes, bytes, int, int, int]], masks: list[list[int]]) -> None:
    """Records (suffix, bytes before, id, run, place) of one anchor: mark the strings that a smaller id has."""
    suffix, before = group[0][:2]
    if all([x[0] == suffix and x[1] == before for x in group]):  # copies of one record: all its strings stand or fall together
        every, lowest_id = (1 << (len(before) - max(0, SPAN - len(suffix)) + 1)) - 1, min([x[2] for x in group])
        for _, _, i, run, place in group:
            if i > lowest_id:
                masks[run][place] = every
        return
    least: dict[tuple[bytes, bytes], int] = {}
    for suffix, before, i, _, _ in group:
        key = (before, suffix)
        if i < least.get(key, NO_ID + 1):
            least[key] = i
    first: dict[tuple[int, bytes], int] = {}
    for (before, suffix), i in least.items():
        n = len(before)
        for o in range(max(0, SPAN - len(suffix)), n + 1):
            key = (o, before[n - o:] + suffix[:SPAN - o])
            if i < first.get(key, NO_ID + 1):
                first[key] = i
    lowest = {}
    for before, suffix in least:
        n = len(before)
        lowest[before, suffix] = [(n - o, first[o, before[n - o:] + suffix[:SPAN - o]]) for o in range(max(0, SPAN - len(suffix)), n + 1)]
    for suffix, before, i, run, place in group:
        masks[run][place] = sum(1 << bit for bit, j in lowest[before, suffix] if j < i)


def _merge(runs: DataFrame) -> DataFrame:
    """(slice, bucket, masks): for every record of a run, which of its strings to remove."""

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        blobs = list(frame["run"])
        masks: list[list[int]] = [[0] * int.from_bytes(zstandard.ZstdDecompressor().decompress(b)[:4], "little") for b in blobs]
        place = [0] * len(blobs)
        group: list[tuple] = []
        for suffix, h, before, i, run in merged([decode_run(b) for b in blobs]):
            if group and h < GRAM:
                if len(group) > 1:
                    _settle(group, masks)
                group = []
            group.append((suffix, before, i, run, place[run]))
            place[run] += 1
        if len(group) > 1:
            _settle(group, masks)
        return frame[["slice", "bucket"]].assign(masks=[np.array(m, "<u4").tobytes() for m in masks])

    def uncollected(frame: pd.DataFrame) -> pd.DataFrame:
        gc.disable()  # millions of tuples, none of them in a cycle
        try:
            return combine(frame)
        finally:
            gc.enable()

    return runs.select("slice", "bucket", "run").groupBy("bucket").applyInPandas(uncollected, "slice long, bucket long, masks binary")


def _runs(rows: DataFrame, live: DataFrame, parts: int, buckets: int) -> DataFrame:
    """(slice, bucket, run, state): a run for every bucket; bucket -1 holds what the slice settles
    itself, bucket -2 the strings of hot anchors.

    ``state`` has for every record, or settled stretch, its document, start and number of strings;
    for a hot string its document, start and 128-bit fingerprint.
    """

    def look(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["id", "print"], ignore_index=True)
        # A slice has as many rows a part as tasks that sent some of it.
        live, hot = ([_unsqueezed(b).astype(np.uint64) | (np.uint64(p) << np.uint64(32)) for p, b in zip(known["part"], known[c])] for c in ("live", "hot"))
        if docs.empty or not any(map(len, live)):
            return pd.DataFrame({"slice": [], "bucket": [], "run": [], "state": []})
        live, hot = np.unique(np.concatenate(live)), np.unique(np.concatenate(hot))
        found: list[tuple[np.ndarray, ...]] = []
        column, base = pa.array(docs["text"], pa.binary()), 0
        for first, _, raw, at in text.slices(column):
            start, anchor, row, sums = strings(raw, at)
            if len(start):
                # What hangs on the anchor alone is looked up once for neighbours that share it.
                pair = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(row) != 0)))
                prints = fingerprints(sums, anchor[pair])
                key = (prints & np.uint64(0xFFFFFFFF)) | (((prints >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32))
                spot = np.minimum(np.searchsorted(live, key), len(live) - 1)
                many = np.diff(pair, append=len(anchor)) * (live[spot] == key)
                each = np.repeat(np.arange(len(pair)), many)
                ok = pair[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                prints = prints[each]
                common = np.isin(key, hot)[each] if len(hot) else np.zeros(len(ok), bool)
                halves = np.zeros((2, len(ok)), np.uint64)
                middle = start[ok][common] + SPAN // 2
                halves[0, common] = text.range_hash(sums, start[ok][common], middle)
                halves[1, common] = text.range_hash(sums, middle, start[ok][common] + SPAN)
                found.append((text.range_hash(sums, start[ok], start[ok] + SPAN), first + row[ok], base + start[ok], base + anchor[ok], prints, common, *halves))
            base += len(raw)
        out: list[tuple] = []
        if found:
            whole, offsets = text.buffers(column)
            out = _records(*(np.concatenate(c) for c in zip(*found)), whole, offsets, docs, buckets)
        piece = int(docs["slice"].iloc[0])
        return pd.DataFrame({"slice": [piece] * len(out), "bucket": [o[0] for o in out], "run": [o[1] for o in out], "state": [o[2] for o in out]})

    return rows.groupBy("slice").cogroup(live.groupBy("slice")).applyInPandas(look, "slice long, bucket long, run binary, state binary")


def _state(ids: np.ndarray, prints: np.ndarray, start: np.ndarray, many: np.ndarray) -> bytes:
    return _packed(np.stack([ids, prints, start, many]))


def _records(string, row, start, anchor, prints, common, left, right, whole, offsets, docs, buckets) -> list[tuple]:
    ids, own = docs["id"].to_numpy(np.int64), docs["print"].to_numpy(np.int64)
    order = np.argsort(string, kind="stable")  # documents rise within a string
    new = np.append(True, np.diff(string[order].view(np.int64)) != 0)
    least = np.empty(len(order), np.int64)
    least[order] = ids[row[order]][np.flatnonzero(new)[np.cumsum(new) - 1]]
    late = least < ids[row]

    def stretches(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last string of neighbours in one document with one anchor."""
        if not len(chosen):
            return chosen, chosen
        cut = (np.diff(start[chosen]) != 1) | (np.diff(row[chosen]) != 0) | (np.diff(anchor[chosen]) != 0)
        return chosen[np.append(True, cut)], chosen[np.append(cut, True)]

    out = []
    a, b = stretches(np.flatnonzero(late))
    if len(a):
        r = row[a]
        out.append((-1, None, _state(ids[r], own[r], start[a] - offsets[r], start[b] - start[a] + 1)))
    each = np.flatnonzero(~late & common)
    if len(each):
        r = row[each]
        out.append((-2, None, _packed(np.stack([ids[r], own[r], start[each] - offsets[r], left[each].view(np.int64), right[each].view(np.int64)]))))
    a, b = stretches(np.flatnonzero(~late & ~common))
    bucket = ((prints[a] >> np.uint64(36)) % np.uint64(buckets)).astype(np.int64)
    data = whole.tobytes()
    for k in np.unique(bucket).tolist():
        mine = np.flatnonzero(bucket == k)
        first, last = a[mine], b[mine]
        r = row[first]
        records = [(data[c:e + SPAN], data[s:c], i) for s, c, e, i in zip(start[first].tolist(), anchor[first].tolist(), start[last].tolist(), ids[r].tolist())]
        rank = sorted(range(len(records)), key=records.__getitem__)
        at = np.array(rank)
        out.append((k, encode_run([records[i] for i in rank]),
                    _state(ids[r][at], own[r][at], (start[first] - offsets[r])[at], (start[last] - start[first] + 1)[at])))
    return out


def _hot(runs: DataFrame) -> DataFrame:
    """(slice, id, print, start) of strings of hot anchors that a smaller id has, too."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for piece, state in zip(frame["slice"], frame["state"]):
                ids, prints, start, left, right = _unpacked(state, 5)
                yield pd.DataFrame({"slice": piece, "id": ids, "print": prints, "start": start, "a": left, "b": right})

    rows = runs.filter("bucket = -2").select("slice", "state").mapInPandas(spread, "slice long, id long, print long, start long, a long, b long")
    least = rows.groupBy("a", "b").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("a", "b", "least")
    return rows.join(least, ["a", "b"]).filter("least < id").select("slice", "id", "print", "start")


def _ranges(runs: DataFrame, masks: DataFrame) -> DataFrame:
    """(id, print, ranges): pairs of start and end of removed bytes, as 32-bit integers; a
    row for every document that loses some, since its slice knows all of them."""

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        single = frame[frame["state"].isna()]
        parts = [np.stack([single[c].to_numpy(np.int64) for c in ("id", "print", "start")] + [single["start"].to_numpy(np.int64) + SPAN])]
        for state, mask in zip(frame["state"], frame["masks"]):
            if state is None:
                continue
            ids, prints, start, many = _unpacked(state, 4)
            if mask is None:
                parts.append(np.stack([ids, prints, start, start + many - 1 + SPAN]))
                continue
            bits = np.frombuffer(mask, "<u4")
            for k in range(SPAN - GRAM + 1):
                hit = np.flatnonzero(bits >> np.uint32(k) & np.uint32(1))
                parts.append(np.stack([ids[hit], prints[hit], start[hit] + k, start[hit] + k + SPAN]))
        ids, prints, begin, end = np.concatenate(parts, 1)
        order = np.lexsort((begin, prints, ids))
        ids, prints, pairs = ids[order], prints[order], np.stack([begin[order], end[order]], 1)
        edge = np.flatnonzero(np.append(True, (np.diff(ids) != 0) | (np.diff(prints) != 0))) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(edge[1:], len(ids))
        return pd.DataFrame({"id": ids[edge], "print": prints[edge], "ranges": [joined(pairs[x:y]).tobytes() for x, y in zip(edge, ends)]})

    none = F.lit(None)
    met = runs.filter("bucket > -2").select("slice", "bucket", "state").join(masks, ["slice", "bucket"], "left")
    met = met.select("slice", "state", "masks", *[F.lit(0).cast("long").alias(c) for c in ("id", "print", "start")]).unionByName(
        _hot(runs).withColumns({"state": none.cast("binary"), "masks": none.cast("binary")}))
    return met.groupBy("slice").applyInPandas(gather, "id long, print long, ranges binary")


def joined(pairs: np.ndarray) -> np.ndarray:
    """Touching ranges as one; ``pairs`` rise by start."""
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.append(True, pairs[1:, 0] > ends[:-1])
    first = np.flatnonzero(new)
    return np.stack([pairs[first, 0], ends[np.append(first[1:], len(pairs)) - 1]], 1).astype("<i4")


def _kept(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, digest = [], [], [], []
            for body, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                pairs = np.frombuffer(ranges or b"", "<i4").reshape(-1, 2)
                kept, at = hashlib.sha256(), 0
                for a, b in pairs.tolist():
                    kept.update(body[at:a])
                    at = b
                kept.update(body[at:])
                size.append(len(body))
                gone.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
                spans.append(len(pairs))
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                                              pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _of_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.schema("slice long, bucket long, data binary, kind string").parquet(path)
    return rows.filter(F.col("kind") == kind).select("slice", "bucket", F.col("data").alias(kind))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(body).alias("print"), body.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, parts = max(1, -(-size // SLICE)), max(6, -(-size // PART))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id", "print"), F.lit(slices)))
    spark, parted = docs.sparkSession, shared_folder(docs.sparkSession, "runs")
    with shuffles_freed(spark):
        # A task sends what lies together: dealt by slice, a fingerprint of a slice goes out once, with the others of its part.
        live = stored(_live(_sent(rows.repartition("slice").sortWithinPartitions("slice"), parts)), "live")
        # The runs apart from their states, so that they can go once they are merged.
        both = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("data")) for c in ("run", "state")])
        split = _runs(rows.select("slice", "id", "print", "text"), live, parts, parts).select("slice", "bucket", F.inline(both)).filter("data is not null")
        split.write.partitionBy("kind").parquet(parted)
        masks = stored(_merge(_of_kind(spark, parted, "run")), "masks")
        remove_folder(spark, f"{parted}/kind=run")
    ranges = _ranges(_of_kind(spark, parted, "state"), masks)
    return _kept(rows.join(ranges, ["id", "print"], "left").select("doc_id", "text", "ranges"))
