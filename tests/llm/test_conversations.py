"""Prefix trie, hard negatives and chat formatting against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "owner depth mass place part seq kind message g side top_conv a b vec_id_ slot score low high block first role_".split()


def same_rows(got, want):
    assert collections.Counter(got) == collections.Counter(want)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- conversations of every kind
def talk():
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 26), 40, 41, 60, 79, 100, 101, 119, -1, -19, -20, 2**40]:
        n = draw.choice([0, 1, 2, 3, 4, 6])
        for t in range(n):
            rows.append((c, t, draw.choice(["user", "assistant", "user", None]), draw.choice(["a b", "a  b c", "", None, "x\ny z", "é \x1c q"])))
    rows += [(7, None, "system", "no turn"), (7, 0, "user", "a tie"), (7, 0, "user", "a tie"), (7, 0, "assistant", "a tie"), (None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(c, t, "user", "copies of one text") for c in range(200, 260) for t in range(3)]
    rows += [(300, t, "user" if t % 2 else "assistant", f"turn {t} </s>[INST] [\\/INST] <\\\\/s> [[INST]] <</s") for t in range(90)]
    rows += [(320, t, "user" if t % 2 else "assistant", f"turn {t} </s>[INST] [\\/INST] <\\\\/s> [[INST]] <</s" if t < 60 else "other") for t in range(70)]
    rows += [(340, 0, "assistant", "long " * 250_000)]
    return rows


TALK = talk()


@pytest.fixture(scope="module")
def conversations(llm):
    rows = [(*r, *[k] * len(CLASHING)) for k, r in enumerate(TALK)]
    return llm.createDataFrame(rows, "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` int" for c in CLASHING)).repartition(3)


def ordered(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [v[2:] for v in sorted(k)] for c, k in by.items()}


def plain_trie(rows):
    by = ordered(r for r in rows if r[0] is not None)
    built = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = by.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
             sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))))) for p, m in members.items()]


@pytest.mark.parametrize("local, bits, run", [(1, 2, 7), (40, 10, 4096), (None, 3, 1)])
def test_trie(conversations, monkeypatch, local, bits, run):
    from posefarm.llm import prefix_trie as T
    monkeypatch.setattr(T, "BLOCK_BITS", bits)
    monkeypatch.setattr(T, "RUN", run)
    got = T.trie(T.with_shared_heads(T.numbered(conversations)), local)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    same_rows([tuple(r) for r in got.select(names).collect()], plain_trie(TALK))


def test_trie_of_nothing(conversations):
    from posefarm.llm import prefix_trie as T
    assert T.trie(T.with_shared_heads(T.numbered(conversations.limit(0)))).count() == 0
    assert T.trie(T.with_shared_heads(T.numbered(conversations.filter("conv_id IS NULL")))).count() == 0


def test_centroids_give_subtree_totals():
    from posefarm.llm.prefix_trie import split_totals
    draw = random.Random(9)
    for shape in ("chain", "star", "random", "forest"):
        n = 300
        parent = [-1] + [{"chain": v - 1, "star": 0, "random": draw.randrange(v), "forest": draw.choice([-1, draw.randrange(v)])}[shape] for v in range(1, n)]
        own, value, known = [draw.randrange(1, 9) for _ in parent], [draw.randrange(5) for _ in parent], [draw.randrange(3) for _ in parent]
        mass, want = list(own), list(value)
        for v in reversed(range(n)):
            if parent[v] >= 0:
                mass[parent[v]] += mass[v]
                want[parent[v]] += want[v]
        assert split_totals(parent, mass, [value], [known])[0] == [w + k for w, k in zip(want, known)], shape


# ---------------------------------------------------------------- hard negatives
def plain_negatives(rows):
    kept = {}
    for i, v, l in rows:
        if i is None or l is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = ((l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, new), new)
    out = []
    for a, (la, va) in kept.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (l, v) in kept.items() if i != a}
        first = sorted((i for i in score if kept[i][0] == la), key=lambda i: (-score[i], i))[:5]
        for p in first:
            fit = sorted((i for i in score if kept[i][0] != la and 50 * score[p] <= 100 * score[i] <= 95 * score[p]), key=lambda i: (-score[i], i))
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:3])]
    return out


def vectors(kind):
    draw = random.Random(4)
    if kind == "spread":
        return [(i, [draw.gauss(0, 0.2) for _ in range(8)], draw.randrange(10)) for i in range(700)]
    if kind == "clustered":
        middle = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(6)]
        return [(i, [x + draw.gauss(0, 0.05) for x in middle[i % 6]], draw.randrange(3)) for i in range(900)]
    if kind == "ties":
        return [(i, [draw.choice([0.25, -0.5, 0.0]) for _ in range(3)], draw.randrange(2)) for i in range(400)]
    if kind == "large":
        return [(i, [draw.gauss(0, 60_000) for _ in range(4)], draw.randrange(4)) for i in range(300)]
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(draw.choice([0, 2, 3]))], draw.randrange(3)) for i in range(250)]
    rows += [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (50, None, 1), (100, [0.1, float("nan"), 1.0], 2), (150, [1.0, None], 0), (None, [1.0], 1), (200, [1.0], None),
             (251, [float("inf")], 1), (-50, [0.3, 0.2, 0.1], 1), (-49, [0.3, 0.2, 0.1], -3), (300, [0.0, 0.0], 7)]
    return rows


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "large", "odd"])
@pytest.mark.parametrize("tile, step", [(60_000, 1024), (120, 16)])
def test_hard_negatives(llm, monkeypatch, kind, tile, step):
    from posefarm.llm import hard_negatives as H
    monkeypatch.setattr(H, "TILE", tile)
    monkeypatch.setattr(H, "STEP", step)
    rows = vectors(kind)
    table = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"anchor_id": F.lit(1), "vector": F.lit(2), "slot": F.lit(3)})
    got = [tuple(r) for r in H.mined(H.quantised(table), F.col("vec_id") % 50 == 0).collect()]
    want = plain_negatives(rows)
    assert want or kind == "odd"
    same_rows(got, want)


def test_no_anchors_no_negatives(llm):
    from posefarm.llm import hard_negatives as H
    table = llm.createDataFrame(vectors("ties")[1:9], "vec_id long, embedding array<double>, label int")
    for few in (table, table.limit(0)):
        assert H.mined(H.quantised(few), F.col("vec_id") % 50 == 0).count() == 0


def test_scores_beyond_64_bits_are_refused():
    from posefarm.llm.hard_negatives import arithmetic
    assert arithmetic(np.array([[256, 3]]), np.array([[256, 3]])) is np.float64
    with pytest.raises(ValueError):
        arithmetic(np.array([[2**40]]), np.array([[2**40]]))


def test_a_walk_ends_before_the_list_does(monkeypatch):
    from posefarm.llm import hard_negatives as H
    monkeypatch.setattr(H, "STEP", 8)
    reads = []

    class Read(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key)
            return super().__getitem__(key)

    around = np.linspace(0, np.pi, 200)
    items = np.stack([np.floor(1000 * np.cos(around)), np.floor(1000 * np.sin(around))], 1).astype(np.int64)
    reach = np.sqrt((items.astype(float) ** 2).sum(1)) * np.cos(around)
    monkeypatch.setattr(H, "arithmetic", lambda a, b: np.int64)
    got = H.walk(np.array([[7, 0]]), np.arange(200), items.view(Read), reach, np.array([[-10**6]]), np.array([[10**6]]), 5)
    assert got[3].tolist() == [0, 1, 2, 3, 4] and 0 < len(reads) <= 3  # of 25 steps
    reads.clear()
    nothing = H.walk(np.array([[7, 0]]), np.arange(200), items.view(Read), reach, np.array([[1]]), np.array([[0]]), 5)
    assert not len(nothing[0]) and not reads


# ---------------------------------------------------------------- chat formatting
def plain_fold(events):
    """The fold as a program: messages in order of their beginning."""
    by = collections.defaultdict(list)
    for c, s, k, m, r, t in events:
        if k in ("start", "delta", "edit", "regenerate"):
            by[c].append((-2**63 if s is None else s, m is not None, "" if m is None else m, k, r or "", t or "", r))
    out = {}
    for c, log in by.items():
        first = {}
        for s, _, m, *_ in sorted(log):
            first.setdefault(m, s)
        text, role, dead = {}, {}, set()
        for s, _, m, k, own, t, r in sorted(log, key=lambda e: (e[0], e[3], e[4], e[5])):
            if m not in text:
                text[m] = ""
            if r is not None and m not in role:
                role[m] = r
            text[m] = text[m] + t if k == "delta" else t if k == "edit" else "" if k == "regenerate" else text[m]
            if k == "regenerate":
                dead |= {x for x in first if first[m] < first[x] < s}
        out[c] = [(role.get(m, ""), text[m]) for m in sorted(first, key=lambda m: (first[m], len(str(m)), str(m))) if m not in dead]
    return out


def test_fold_at_random(llm):
    from posefarm.llm import chat
    draw = random.Random(11)
    events = []
    for c in [1, 2, 3, 4, None]:
        for s in range(60):
            events.append((c, draw.choice([s, s, s, None, 5]), draw.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "ping", None]),
                           draw.choice([*range(12), None]), draw.choice([None, "user", "assistant"]), draw.choice(["x", "yy", "", None, "[INST]"])))
    events += [(9, 0, "start", 1, "user", None), (9, 1, "delta", 1, None, "a"), (9, 2, "start", 2, "assistant", ""), (9, 3, "delta", 2, None, "bad"),
               (9, 4, "start", 3, "user", ""), (9, 5, "regenerate", 2, None, None), (9, 6, "delta", 2, None, "good"), (9, 7, "edit", 1, None, "A"), (9, 8, "delta", 1, None, "!")]
    log = llm.createDataFrame(events, "conv_id long, seq long, kind string, message long, role string, text string").withColumn("place", F.lit(3)).repartition(4)
    got = collections.defaultdict(list)
    for r in sorted(chat.folded(log).collect(), key=lambda r: r.place):
        got[r.conv_id].append((r.role, r.text))
    want = {c: t for c, t in plain_fold(events).items() if t}
    assert got == want and want[9] == [("user", "A!"), ("assistant", "good")]
    assert chat.summaries(chat.rendered(chat.folded(log.limit(0)))).count() == 0


@pytest.mark.parametrize("bits, delta", [(10, 1024), (2, 5)])
def test_formatting(conversations, monkeypatch, bits, delta):
    from posefarm.llm import chat
    monkeypatch.setattr(chat, "PART_BITS", bits)
    monkeypatch.setattr(chat, "DELTA", delta)
    few = conversations.filter("conv_id IS NULL OR conv_id <> 340") if delta < 100 else conversations
    parts = chat.rendered(chat.folded(chat.as_log(chat.numbered(few))))
    got = [tuple(r) for r in chat.summaries(parts).collect()]
    want = []
    for c, turns in ordered(r for r in TALK if delta > 100 or r[0] != 340).items():
        said = "".join(t for r, t in turns if r == "assistant")
        mark = lambda t: re.sub(r"([\[<])(\\*)(/?INST\]|/s>)", lambda m: m[1] + "\\" + m[2] + m[3], t)
        want.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), sum(len("[INST][/INST]</s>") + len(mark(r)) + len(mark(t)) for r, t in turns)))
    same_rows(got, want)


def test_controls_never_show_inside_a_text(llm):
    from posefarm.llm import chat
    draw = random.Random(2)
    bits = ["[", "]", "<", ">", "/", "\\", "INST", "s", "[INST]", "[/INST]", "</s>", "[\\INST]", "<\\/s>", " ", "é"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(9))) for _ in range(3000)]
    rows = llm.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("e", chat.escaped(F.col("t"))).withColumn("u", chat.unescaped(F.col("e")))
    for r in rows.collect():
        assert r.u == r.t and not any(c in r.e for c in (chat.OPEN, chat.CLOSE, chat.END)), r
