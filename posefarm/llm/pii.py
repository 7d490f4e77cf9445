"""Personal data: patterns, and a linear-chain conditional random field on top of them.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers.  The
field labels the pieces of a text (runs of letters, runs of digits, single marks) from
word-shape features of a piece and its neighbours; it is trained on a small labelled table
and decoded by Viterbi, many stretches in step.  It adds what the patterns miss: written-out
addresses, numbers with a wrong check digit, secrets.

Only stretches around a trigger (a digit, an @ or its spelled form) are decoded, since all
labels but "other" need one nearby; a stretch reaches REACH characters to either side, and
touching stretches are one.  Every text is read whole.

Cases: null counts as empty and has no spans.  Repeated rows share their result.  Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posefarm.llm.store import packed, unpacked

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: the kinds of the patterns, and what only the field finds.
LABELS = ("other", *KINDS, "secret")
REACH = 32

# ------------------------------------------------------------------ patterns
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """A match holds one @ and starts at the first character of the run before it, so it is
    looked for from each @ in turn."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _NUMBERS.finditer(text):
        if run.end() - run.start() >= 7:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out.append(m.span())
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by start, then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in addresses(text)]
        out += [("card", a, b) for a, b in cards(text)]
        if "+" in text:
            out += [("phone", a, b) for a, b in phones(text)]
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], LABELS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ------------------------------------------------------------------ features
_PIECE = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_TRIGGER = re.compile(r"[0-9@]|[(\[{<]\s?at\s?[)\]}>]", re.I)
BUCKETS = 1 << 13
_WORDS = {"at", "dot", "mail", "email", "phone", "tel", "call", "fax", "ip", "host", "server", "card", "visa", "token", "key", "secret",
          "password", "version", "license", "page", "com", "org", "net", "example"}


def shape(piece: str) -> str:
    if piece[0].isdigit():
        n = len(piece)
        return f"9{n if n <= 4 else '5-7' if n < 8 else '8-12' if n < 13 else '13-19' if n < 20 else '20+'}"
    if piece.isalpha():
        case = "X" if piece.isupper() else "x" if piece.islower() else "Xx"
        return case + ("1" if len(piece) == 1 else "2-3" if len(piece) < 4 else "4+")
    return piece


def features(pieces: list[re.Match]) -> list[list[int]]:
    """Hashed feature numbers of every piece of a stretch."""
    said = [m.group() for m in pieces]
    shapes = [shape(p) for p in said]
    words = [p.lower() if p.lower() in _WORDS else "" for p in said]
    glued = [k > 0 and pieces[k - 1].end() == m.start() for k, m in enumerate(pieces)]
    # The shape of the blank-free word that a piece is part of.
    whole, first = [""] * len(said), 0
    for k in range(1, len(said) + 1):
        if k == len(said) or not glued[k]:
            joint = "".join(s if len(s) == 1 else s[0] for s in shapes[first:k])
            joint = re.sub(r"(.{1,2}?)\1+", r"\1+", joint)[:12]
            whole[first:k] = [joint] * (k - first)
            first = k
    long_mix = [bool(w) and w.count("9") + w.count("x") + w.count("X") == len(w.replace("+", "")) and "9" in w and ("x" in w.lower()) for w in whole]
    out = []
    for k in range(len(said)):
        near = lambda o: shapes[k + o] if 0 <= k + o < len(said) else "|"  # noqa: B023, E731
        word = lambda o: words[k + o] if 0 <= k + o < len(said) else ""  # noqa: B023, E731
        g = "g" if glued[k] else "s"
        h = "g" if k + 1 < len(said) and glued[k + 1] else "s"
        names = ["b", "s" + shapes[k] + g + h, "w" + words[k], "W" + whole[k], "S" + shapes[k] + whole[k], f"m{long_mix[k]}",
                 "p" + near(-1) + g + shapes[k], "n" + shapes[k] + h + near(1), "q" + near(-2) + near(-1) + shapes[k],
                 "o" + shapes[k] + near(1) + near(2), "v" + word(-1), "u" + word(-2) + word(-3), "x" + word(1) + word(2)]
        out.append([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=4).digest(), "little") % BUCKETS for n in names])
    return out


N_FEATURES = 13

# ------------------------------------------------------------------ labelled table
# Patterns of the labelled table.  {kind|...} marks a labelled span.  A Greek
# letter stands for something drawn: omega a word, delta a digit, chi a hexadecimal digit,
# upsilon a capital letter or digit, lambda a small letter.
PATTERNS = """
ω ω {email|ω.δδ@ω.ω.com} ω ω
ω ω, {email|ω.ω@ωδ.example.com}, ω ω
write to {email|ω@ω.org}. ω ω
mail {email|ω_δδ@ω.co.net} ω
ω ω {email|ω.ω [at] ω [dot] org}, ω
ω ω {email|ω.δδ (at) ω (dot) com} ω ω
contact ω {email|ω [at] ω.net} ω
ω {email|ω.δ@ω-ω.com}! ω
ω {email|ω+ω@ω.ω.ω} ω
ω ω {ip|δδδ.δδ.δδδ.δ} ω ω
ω, {ip|δδ.δδδ.δδ.δδδ}, ω
server {ip|δδδ.δδδ.δδ.δδ}. ω ω
host {ip|δδ.δ.δ.δδδ} ω
ω {ip|δδδ[.]δδ[.]δ[.]δδ} ω
ω {ip|δδδ.δδδ.δδδ.δδδ}!! ω!!
ω at ω {ip|δδδ.δδδ.δδδ.δδδ} ω
ω ω {card|δδδδδδδδδδδδδδδδ} ω ω
ω, {card|δδδδ δδδδ δδδδ δδδδ} ω
card {card|δδδδ-δδδδ-δδδδ-δδδδ}, ω
ω. {card|δδδδδδδδδδδδδδδδ} ω ω
ω {card|δδδδδδδδδδδδδδδ}. ω
ω {card|δδδδ δδδδδδ δδδδδ} ω
visa {card|δδδδδδδδδδδδδδδδ}!! ω!!
ω$$$ {card|δδδδδδδδδδδδδδδδ}### ω$$$
ω | {card|δδδδδδδδδδδδδδδδ} | ω
ω {phone|+δ (δδδ) δδδ-δδδδ} {card|δδδδδδδδδδδδδδδδ} ω
{card|δδδδδδδδδδδδδδδδ} {ip|δδ.δδδ.δδ.δδδ} ω ω
ω ω {phone|+δ (δδδ) δδδ-δδδδ} ω ω
ω, {phone|+δδ δδδ δδδ δδδδ}, ω
tel {phone|(δδδ) δδδ-δδδδ} ω
call {phone|δδδ-δδδ-δδδδ} ω ω
ω {phone|+δ-δδδ-δδδ-δδδδ}. ω
ω {phone|+δδδ δδ δδδ δδ δδ} ω
phone: {phone|δδδ.δδδ.δδδδ} ω
ω {phone|+δ (δδδ) δδδ-δδδδ}!! ω!!
token = "{secret|χχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχ}" ω ω
ω ω token = "{secret|χχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχ}" ω
key: {secret|χχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχχ} ω
ω ω password={secret|χχχχχχχχχχχχχχχχχχ} ω ω
ω ω password={secret|χχχχχχχχχχχχχχχχχχ}, ω
ω secret={secret|χχχχχχχχχχχχχχχχχχχχ}. ω
password = "{secret|λδλλδδλδλδλλδλδδ}" ω
ω ω {secret|AKIAυυυυυυυυυυυυυυυυ} ω ω
ω, {secret|AKIAυυυυυυυυυυυυυυυυ}. ω
ω ω, version δ. ω ω
ω License, Version δ.δ. ω ω
CC BY-NC δ.δ. ω ω
ω ω δδδδ ω ω
ω δδ ω, δδδ ω
ω in δδδδ-δδ-δδ ω ω
ω δδ.δδ.δδδδ ω
ω δ,δδδ,δδδ ω
ω $δδδ.δδ ω
page δδ of δδδ ω
ω (δδδδ) ω. ω
ω δ.δ.δ ω ω
ω δδ:δδ ω ω
ω δ/δ ω ω
ω @ ω
ω ω at ω ω, ω
ω at ω dot ω δδ
ω ω at the ω δδδδ ω
ω!! ω!! δ!! ω!!
ω δδδδδ ω δδδδδδ ω
ω #δδδ ω
ω §δδ ω
δδth ω δδδδs
ω λδλ ω ωδ
ω υυ-δδδ ω
""".strip().split("\n")
_SYLLABLES = "th on ing er an re at es en or ed is it al ar te se co de ou la le ver ein che".split()
_SPAN = re.compile(r"\{(email|ip|card|phone|secret)\|([^{}]+)\}")


def labelled_table(spark: SparkSession, copies: int = 12, seed: int = 5) -> DataFrame:
    """(text, spans): every pattern filled in ``copies`` times."""
    draw = random.Random(seed)

    def word() -> str:
        w = "".join(draw.choice(_SYLLABLES) for _ in range(draw.randint(1, 4)))
        return w.capitalize() if draw.random() < 0.2 else w

    def fill(pattern: str) -> str:
        drawn = {"ω": word, "δ": lambda: draw.choice("0123456789"), "χ": lambda: draw.choice("0123456789abcdef"),
                 "υ": lambda: draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "λ": lambda: draw.choice("abcdefghijkmnpqrstuvwxyz")}
        return "".join(drawn[c]() if c in drawn else c for c in pattern)

    rows = []
    for pattern in PATTERNS:
        for _ in range(copies):
            text, spans, at = "", [], 0
            for m in _SPAN.finditer(pattern):
                text += fill(pattern[at:m.start()])
                inner = fill(m.group(2))
                spans.append((m.group(1), len(text), len(text) + len(inner)))
                text += inner
                at = m.end()
            rows.append((text + fill(pattern[at:]), joined(spans)))
    return spark.createDataFrame(rows, "text string, spans string")


# ------------------------------------------------------------------ the field
class Field:
    """weights: feature x label; moves: label x label; starts: label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, starts: np.ndarray):
        self.weights, self.moves, self.starts = weights, moves, starts

    def scores(self, stretches: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores, padded, and lengths."""
        size = np.array([len(s) for s in stretches])
        out = np.zeros((len(stretches), size.max(), len(LABELS)))
        flat = np.array([f for s in stretches for f in s])
        out[np.arange(size.max()) < size[:, None]] = self.weights[flat].sum(1)
        return out, size

    def decode(self, stretches: list[list[list[int]]]) -> list[np.ndarray]:
        """Viterbi, all stretches in step."""
        emit, size = self.scores(stretches)
        n, longest, _ = emit.shape
        best = self.starts + emit[:, 0]
        back = np.zeros((n, longest, len(LABELS)), np.int8)
        for t in range(1, longest):
            options = best[:, :, None] + self.moves
            back[:, t] = options.argmax(1)
            new = options.max(1) + emit[:, t]
            best = np.where((t < size)[:, None], new, best)
        label = best.argmax(1)
        out = np.zeros((n, longest), np.int8)
        for t in range(longest - 1, -1, -1):
            inside = t < size
            out[inside, t] = label[inside]
            if t:
                label = np.where(inside, back[np.arange(n), t, label], label)
        return [row[:k] for row, k in zip(out, size)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(labelled: DataFrame, rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximum likelihood by gradient steps with per-weight rates, over a labelled table
    (text, spans) small enough for the driver."""
    stretches, truth = [], []
    for text, spans in labelled.orderBy("text").collect():
        pieces = list(_PIECE.finditer(text))
        marks = [s.split(":") for s in spans.split(",") if s]
        stretches.append(features(pieces))
        truth.append([next((LABELS.index(k) for k, a, b in marks if int(a) <= m.start() < int(b)), 0) for m in pieces])
    n, L = len(stretches), len(LABELS)
    field = Field(np.zeros((BUCKETS, L)), np.zeros((L, L)), np.zeros(L))
    size = np.array([len(s) for s in stretches])
    longest = size.max()
    inside = np.arange(longest) < size[:, None]
    flat = np.array([f for s in stretches for f in s])
    gold = np.zeros((n, longest, L))
    gold[inside, np.array([y for t in truth for y in t])] = 1
    pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    sums = [np.zeros_like(field.weights), np.zeros_like(field.moves), np.zeros_like(field.starts)]
    for _ in range(rounds):
        emit, _ = field.scores(stretches)
        ahead = np.zeros_like(emit)
        ahead[:, 0] = field.starts + emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = _log_sum(ahead[:, t - 1][:, :, None] + field.moves, 1) + emit[:, t]
        behind = np.zeros_like(emit)
        for t in range(longest - 2, -1, -1):
            step = _log_sum(field.moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(inside[:, t + 1][:, None], step, 0)
        total = _log_sum(ahead[np.arange(n), size - 1], 1)
        share = np.where(inside[:, :, None], np.exp(ahead + behind - total[:, None, None]), 0)
        joint = np.zeros((L, L))
        for t in range(1, longest):
            p = np.exp(ahead[:, t - 1][:, :, None] + field.moves + (emit[:, t] + behind[:, t])[:, None, :] - total[:, None, None])
            joint += p[inside[:, t]].sum(0)
        off = (gold - share)[inside]
        slope = np.stack([np.bincount(flat.ravel(), np.repeat(off[:, y], N_FEATURES), BUCKETS) for y in range(L)], 1)
        for value, s, g in zip((field.weights, field.moves, field.starts), sums, (slope, pairs - joint, (gold[:, 0] - share[:, 0]).sum(0))):
            g = g / n - decay * value
            s += g * g
            value += rate * g / np.sqrt(s + 1e-12)
    return field


def stretches_of(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, extended to blanks."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    wide = []
    for a, b in out:
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if wide and a <= wide[-1][1]:
            wide[-1] = (wide[-1][0], max(b, wide[-1][1]))
        else:
            wide.append((a, b))
    return wide


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans of the field alone."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    todo = []
    for r, text in enumerate(texts):
        for a, b in stretches_of(text):
            pieces = list(_PIECE.finditer(text, a, b))
            if pieces:
                todo.append((len(pieces), r, pieces))
    todo.sort(key=lambda x: x[0])
    at = 0
    while at < len(todo):
        n = max(1, min(512, 50_000 // todo[min(at + 511, len(todo) - 1)][0]))
        part, at = todo[at:at + n], at + n
        for (_, r, pieces), labels in zip(part, field.decode([features(p) for _, _, p in part])):
            k = 0
            while k < len(pieces):
                e = k + 1
                while e < len(pieces) and labels[e] == labels[k]:
                    e += 1
                if labels[k]:
                    a, b = pieces[k].start(), pieces[e - 1].end()
                    if LABELS[labels[k]] == "secret":  # up to the ends of its run of letters and digits
                        while a > 0 and texts[r][a - 1].isalnum():
                            a -= 1
                        while b < len(texts[r]) and texts[r][b].isalnum():
                            b += 1
                    if not found[r] or a >= found[r][-1][2]:
                        found[r].append((LABELS[labels[k]], a, b))
                k = e
    return found


def all_spans(texts: list[str], field: Field) -> tuple[list, list]:
    """Base spans, and base spans with what the field adds clear of them."""
    base = [base_spans(t) for t in texts]
    out = []
    for own, more in zip(base, field_spans(texts, field)):
        out.append(ordered(own + [s for s in more if all(s[2] <= a or s[1] >= b for _, a, b in own)]))
    return base, out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span (overlapping ones as one) replaced by its kind in brackets."""
    out, at, end = [], 0, -1
    for kind, a, b in spans:
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        end = at = max(end, b)
    return "".join(out) + text[at:]


_ADDED = [*[(f"n_{k}", T.LongType()) for k in KINDS], ("base_sha256", T.StringType()), ("spans", T.StringType()), ("clean_text", T.StringType())]


def with_spans(rows: DataFrame, field: Field) -> DataFrame:
    """``rows`` (any columns, the last one the text) with counts, digests, spans and redacted text."""
    known = rows.sparkSession.sparkContext.broadcast(field)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in _ADDED]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            base, spans = all_spans([t or "" for t in texts], known.value)
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, *counts, pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                pa.array([joined(s) for s in spans], pa.string()),
                pa.array([None if t is None else redacted(t, s) for t, s in zip(texts, spans)], pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts, digests and spans of every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return with_spans(rows, field).drop("text", "clean_text")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with redacted texts; n_chars, if there is one, follows the text."""
    rows = with_spans(packed(docs, F.lit(0).alias("_")).withColumn("_text", F.col("__row.text").cast("string")), field)
    out = unpacked(rows.withColumn("__row", F.col("__row").withField("text", F.col("clean_text"))), docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
