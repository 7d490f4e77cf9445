"""The operators against plain versions of themselves, on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same_rows(got, want):
    assert collections.Counter(got) == collections.Counter(want)


# ---------------------------------------------------------------- 1 quality rules
def plain_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    five = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if five[tuple(w[i:i + 5])] > 1 for k in range(5)}
    n, repeat = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


def test_quality_counts(messy, texts):
    from posefarm.llm.quality_rules import quality_rules
    out = quality_rules(messy)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    same_rows(got, [(d, *plain_counts(t)) for d, t in texts])
    assert not out.filter("kept AND base_failed").count()


def test_quality_em_is_plain_em(llm):
    from posefarm.llm import quality_rules as Q
    draw, k = random.Random(3), len(Q.RULES)
    rows = [([draw.choice([1, 1, 0]) for _ in range(k)], 40) for _ in range(6)] + [([draw.choice([-1, -1, 1, 0]) for _ in range(k)], 7) for _ in range(6)]
    share, right, wrong = Q.estimate(llm.createDataFrame(rows, "votes array<int>, n long"))
    p, a, b = Q.SHARE, [Q.RIGHT] * k, [Q.WRONG] * k
    for _ in range(3000):
        q = []
        for v, _n in rows:
            good, bad = p, 1 - p
            for r in range(k):
                good *= a[r] if v[r] == 1 else 1 - a[r] if v[r] == -1 else 1
                bad *= 1 - b[r] if v[r] == 1 else b[r] if v[r] == -1 else 1
            q.append(good / (good + bad))
        s = lambda f, w, start: (sum(n * f(v) * x for (v, n), x in zip(rows, w)) + start * Q.WEIGHT)
        not_q = [1 - x for x in q]
        p = s(lambda v: 1, q, Q.SHARE) / (sum(n for _, n in rows) + Q.WEIGHT)
        a = [s(lambda v: v[r] == 1, q, Q.RIGHT) / (s(lambda v: v[r] != 0, q, 1)) for r in range(k)]
        b = [s(lambda v: v[r] == -1, not_q, Q.WRONG) / (s(lambda v: v[r] != 0, not_q, 1)) for r in range(k)]
    assert abs(share - p) < 1e-6 and np.allclose(right, a, atol=1e-6) and np.allclose(wrong, b, atol=1e-6)


# ---------------------------------------------------------------- 2 near duplicates
def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_groups(texts):
    sets = [(d, shingles(t)) for d, t in texts]
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets]


def test_near_duplicates(messy, texts):
    from posefarm.llm.near_dedup import keep_first, near_duplicates
    want = plain_groups(texts)
    same_rows([tuple(r) for r in near_duplicates(messy).collect()], want)
    kept = keep_first(messy)
    assert kept.columns == messy.columns
    same_rows([r[0] for r in kept.select("doc_id").collect()], list({d for d, _, _, k in want if k and d is not None}) + [None, None])


def test_texts_of_one_id_are_kept_apart(llm):
    from posefarm.llm.near_dedup import keep_first, near_duplicates
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey")
    rows = [(1, a), (1, b), (1, b), (2, c), (3, b), (4, a), (5, ""), (5, None), (5, " ")]
    table = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, (r.text or "").strip()) for r in keep_first(table).collect()}
    assert got == {(1, a), (1, b), (2, c), (5, "")}
    assert {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(table).collect()} == {(1, 1, True), (2, 2, True), (3, 1, False), (4, 1, False), (5, 5, True)}


def test_the_threshold_is_an_argument(llm):
    from posefarm.llm.near_dedup import near_duplicates
    words = [f"w{k}" for k in range(64)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-5] + ["x"] * 2 + words[-3:])), (3, " ".join(words[:-6]))]
    for percent in (70, 80, 90):
        sets = [shingles(t) for _, t in rows]
        close = [[100 * len(s & t) >= percent * len(s | t) for t in sets] for s in sets]
        got = {r.doc_id: r.component_id for r in near_duplicates(llm.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
        for i in range(3):
            for j in range(3):
                assert not close[i][j] or got[i + 1] == got[j + 1]
        assert got[3] == (1 if close[0][2] or (close[1][2] and close[0][1]) else 3)


def family(seed, templates, copies, size):
    """Edited copies of templates that all share one passage, and loners with the passage."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(size)]
    out = []
    for _ in range(templates):
        body = passage + [word() for _ in range(size)]
        for _ in range(copies):
            new = list(body)
            for _ in range(draw.randint(0, 3)):
                new[draw.randrange(len(new))] = word()
            out.append(" ".join(new))
    out += [" ".join(passage + [word() for _ in range(draw.randint(2, size))]) for _ in range(3 * copies)]
    draw.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("small", [2, 32])
def test_near_duplicates_in_large_buckets(llm, monkeypatch, small):
    from posefarm.llm import near_dedup
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rows = family(5, 3, 14, 40)
    out = near_dedup.near_duplicates(llm.createDataFrame(rows, "doc_id long, text string"))
    same_rows([tuple(r) for r in out.collect()], plain_groups(rows))


def test_components_of_a_chain(llm):
    from posefarm.llm.graph import components
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (95, 90), (7, 7)]
    got = dict(map(tuple, components(llm.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}


# ---------------------------------------------------------------- 3 classifier
def test_classifier_learns_and_holds_out(llm, messy, texts):
    from posefarm.llm import classifier
    draw = random.Random(1)
    word = lambda a: "".join(draw.choice(a) for _ in range(5))
    docs, labels = [], []
    for k in range(240):
        good = k % 3 > 0
        docs.append((k, " ".join(word("abcde") + ("" if good else draw.choice(["###", "$$$"])) for _ in range(30))))
        labels.append((k, int(good), 0))
    docs, labels = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = classifier.scored(docs, classifier.learn(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    far = [r for r in out if r.held_out]
    assert sum(r.predicted == r.quality for r in far) >= 0.95 * len(far)
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classifier.scored(docs, classifier.learn(docs, flipped)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in out)
    some = classifier.scored(messy, classifier.learn(messy, labels.limit(0))).collect()
    same_rows([r.doc_id for r in some], [d for d, _ in texts])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in some)


# ---------------------------------------------------------------- 4 personal data
def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def test_base_patterns_at_random():
    from posefarm.llm import pii
    draw = random.Random(9)
    bits = ["a", "b.c", "@", ".", "-", "x9", "1", "12", "300", "4539578763621486", " ", "+1 (555) 555-1234", "+", "(", "é", "%", "1.2.3.4", "\n", "00", "@d.e", "255."]
    for _ in range(4000):
        t = "".join(draw.choice(bits) for _ in range(draw.randint(1, 14)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.fixture(scope="module")
def field(llm):
    from posefarm.llm import pii
    return pii.train(pii.labelled_table(llm))


def test_personal_data(messy, texts, field):
    from posefarm.llm import pii
    got = {(r.doc_id, r.base_sha256): r for r in pii.find(messy, field).collect()}
    for d, t in texts:
        base = plain_spans(t or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        row = got[d, hashlib.sha256(said.encode()).hexdigest()]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(said.split(",")) - {""} <= set(row.spans.split(","))


def test_field_on_held_out_fillings(llm, field):
    from posefarm.llm import pii
    rows = pii.labelled_table(llm, 3, seed=77).collect()
    found = [pii.joined(s) for s in pii.field_spans([r.text for r in rows], field)]
    assert sum(a == r.spans for a, r in zip(found, rows)) >= 0.93 * len(rows)


def test_viterbi_is_the_best_path(field):
    from itertools import product

    from posefarm.llm import pii
    pieces = list(pii._PIECE.finditer("call +1 (555)"))
    emit, _ = field.scores([pii.features(pieces)])
    n = len(pieces)
    worth = lambda y: field.starts[y[0]] + sum(emit[0, t, y[t]] for t in range(n)) + sum(field.moves[y[t - 1], y[t]] for t in range(1, n))
    best = max(product(range(len(pii.LABELS)), repeat=n), key=worth)
    assert tuple(field.decode([pii.features(pieces)])[0]) == best


def test_a_stretch_is_decoded_whatever_else_the_text_holds(field):
    from posefarm.llm.pii import field_spans
    far = " and so on" * 60
    for at in ("[AT]", "{at}", "<at>", "( At )"):
        alone = f"write to joe.smith{at}mail[DOT]com today" + far
        (a,), (b,) = (field_spans([t], field) for t in (alone, alone + " 7"))
        assert [s for s in b if s[2] <= 60] == [s for s in a if s[2] <= 60] and any(s[0] == "email" for s in a), at


def test_redaction(messy, field):
    from posefarm.llm import pii
    out = pii.redact(messy, field)
    assert out.columns == messy.columns and out.count() == messy.count()
    row = out.filter("doc_id = 7").first()
    assert "@" not in row.text and "<CARD>" in row.text and "<IP>" in row.text and "555-1234" not in row.text and row.n_chars == len(row.text)
    assert out.filter("doc_id = 3").first().text is None


# ---------------------------------------------------------------- 5 packing
def test_cuts_are_the_cheapest():
    from posefarm.llm.packing import best_cuts
    draw = random.Random(4)
    for _ in range(150):
        n, length = draw.randint(2, 14), 16
        place = np.cumsum([0] + [draw.randint(1, 9) for _ in range(n)])
        pen = np.array([0] + [draw.choice([0, 1, 5]) for _ in range(n)])
        width = lambda w: 0 if w & (w - 1) == 0 else length - w
        best = [0] + [10**9] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + width(place[j] - place[i]) + pen[j] for i in range(j) if place[j] - place[i] <= length)
        cuts = best_cuts(place, pen, length)
        assert cuts[0] == 0 and cuts[-1] == n
        assert sum(width(place[b] - place[a]) + pen[b] for a, b in zip(cuts, cuts[1:])) == best[n]


def encoded(name, text, end):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("block", [300, 1 << 18])
def test_packing(messy, texts, monkeypatch, block):
    from posefarm.llm import packing
    monkeypatch.setattr(packing.Packer.__init__, "__defaults__", (2048, block))
    pieces = packing.pack(messy, public_tokenizers.path("word_bpe_49k.json")).collect()
    left = collections.Counter((d, encoded("word_bpe_49k.json", t, 1).tobytes()) for d, t in texts)
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    ids = {d: encoded("word_bpe_49k.json", t, 1) for d, t in texts if d is not None}
    for d, own in ids.items():
        count = sum(n for (e, _), n in left.items() if e == d)
        mine = [r for r in pieces if r.doc_id == d]
        assert sum(r.length for r in mine) == len(own) * count and all(r.doc_tokens == len(own) for r in mine)
        assert all(zlib.crc32(own[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
        assert sorted(r.start for r in mine)[0] == 0


# ---------------------------------------------------------------- 6 URL filter
def test_url_filter(llm, monkeypatch):
    from posefarm.llm import queries, url_filter
    urls = ["http://Www.Spam.org/a/", "http://spam.org/a?x", "https://x.example.NET/en/1", "https://example.net/en/", "http://a.net", "http://a.net/", "ftp://b.net/x#y",
            "http://example.com/de/1", "http://badexample.com/de/1", "http://q.org/fr/", "http://spam.org/fr/", None, "", "no scheme.net/", "://net/", "http://?a", "http://net/a://b"]
    pages = llm.createDataFrame(list(enumerate(urls)) + [(0, urls[0]), (None, urls[0])], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("hit", F.lit(2))
    listed = llm.createDataFrame([("http://spam.org/a",), ("http://spam.org/fr",), (None,), ("zz",)], "url string")

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.translate(LOWER)
        fits = [r for r in queries.URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        address = re.sub(r"^www\.", "", host) + path.rstrip("/")
        return host, path, best and best[0] + best[1], best[2] if best else "block" if address in ("spam.org/a", "spam.org/fr") else "allow"

    for bits in (12, 1):  # with hardly any bits the exact join has to do the work
        monkeypatch.setattr(url_filter, "BITS", bits)
        got = [tuple(r) for r in url_filter.judged(pages, queries.URL_RULES, listed).collect()]
        same_rows(got, [(i, *plain(u)) for i, u in [*enumerate(urls), (0, urls[0]), (None, urls[0])]])
    assert url_filter.judged(pages.limit(0), queries.URL_RULES, listed.limit(0)).count() == 0


def test_url_list_covers_every_junk_host(llm, tmp_path):
    from posefarm.llm import queries
    labels = ["casino-win", "cheap-pills", "spam-farm", "adult-x", "ads-track", "free-bets", "never-seen-before"]
    urls = [f"https://{w}{x}.example.com/en/{k}" for k, x in enumerate(labels) for w in ("", "www.", "m.")]
    urls += ["https://thther.example.com/en/1", "https://xn--bcher-kva.example.com/en/1", "https://free-bets.example.net/en/1", "https://-.example.com/", "https://a--b.example.com/"]
    llm.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in queries.QUERIES["op6_url_filter"](llm, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(urls))] == ["block"] * 21 + ["allow"] * 5


# ---------------------------------------------------------------- 7 token files
@pytest.mark.parametrize("block", [700, 1 << 20])
def test_token_files(messy, texts, monkeypatch, block):
    from posefarm.llm import token_output
    monkeypatch.setattr(token_output, "BLOCK", block)
    got = token_output.round_trip(messy, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want, start = [], 0
    for d, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = encoded("byte_bpe_50k.json", t, 2)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    same_rows([tuple(r) for r in got], want)


def test_coder_at_random():
    from posefarm.llm import token_output as T
    draw = np.random.default_rng(8)
    for n, size in [(1, 5), (2, 3), (63, 50), (1000, 40), (40_000, 700), (9_000, 50_257)]:
        for ids in (draw.integers(0, size, n), np.minimum(draw.geometric(0.2, n), size - 1), np.zeros(n, np.int64), np.arange(n) % min(size, 7)):
            lengths, codes = T.encode(ids, size)
            assert (T.decode(n, size, lengths, codes) == ids).all()
    block = T.write_block([3, None], [np.array([1, 2], "<u4"), np.array([4], "<u4")], 10)
    assert T.read_block(block, 10)[0] == [3, None]
    with pytest.raises(ValueError):
        T.read_block(block[:20] + bytes([block[20] ^ 1]) + block[21:], 10)


def test_tokenizer_pieces_are_whole_text_ids():
    from posefarm.llm.tokens import WordIds
    draw = random.Random(2)
    bits = ["word", " ", "  ", "\n", " \n", "\t", "'s", "don't", "é", "日本", "\u00a0", "\u2003", "\x1c", "123", "...", "<|endoftext|>", "<|startoftext|>", "A", "\u0301", "ﬁ", "İ", "Σ"]
    for name, joins in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        ids = WordIds(public_tokenizers.path(name), joins)
        for _ in range(500):
            t = "".join(draw.choice(bits) for _ in range(draw.randint(0, 15)))
            want = ids.tokenizer.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids(t.encode()), "<u4").tolist() == want, (name, t)


# ---------------------------------------------------------------- 8 sharding
def test_sharding(messy, texts, monkeypatch):
    from posefarm.llm import sharding
    monkeypatch.setattr(sharding, "GROUPS_PER_BUCKET", 4)
    monkeypatch.setattr(sharding, "FAN", 2)
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 5)
    got = sharding.sharded(messy, 3).collect()
    same_rows([(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got],
              [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None) for d, t in texts])
    for s in range(3):
        slots = [r.slot for r in got if r.shard == s]
        assert sorted(slots) == list(range(len(slots)))
    of = collections.defaultdict(set)
    for r in got:
        of[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_differencing_is_tight():
    from posefarm.llm.sharding import difference
    draw = random.Random(6)
    sizes = [draw.randint(1, 10_000) for _ in range(2000)]
    final = difference([[s, 0, 0, 0, 0] for s in sizes])
    sums = [0] * 5
    for s, f in zip(sizes, final):
        assert sorted(f) == list(range(5))
        sums[f[0]] += s
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 3


def test_differencing_next_to_the_best_partition():
    import itertools

    from posefarm.llm.sharding import difference
    draw = random.Random(8)
    best, found, greedy = 0, 0, 0
    for k, n in [(2, 9), (3, 7)] * 12:
        sizes = [draw.randint(1, 100) for _ in range(n)]
        spread = lambda where: max(sums := [sum(s for s, w in zip(sizes, where) if w == p) for p in range(k)]) - min(sums)
        least = min(spread(where) for where in itertools.product(range(k), repeat=n))
        got = spread([f[0] for f in difference([[s] + [0] * (k - 1) for s in sizes])])
        sums, where = [0] * k, {}
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            where[i] = sums.index(min(sums))
            sums[where[i]] += sizes[i]
        assert least <= got <= max(sizes)
        best, found, greedy = best + least, found + got, greedy + spread([where[i] for i in range(n)])
    # Over all cases nearer to the best partitions than the largest-first rule.
    assert best <= found < greedy


# ---------------------------------------------------------------- 9 repeated passages
def plain_removal(texts):
    docs = [((d if d is not None else 2**63 - 1), d, (t or "").encode()) for d, t in texts]
    first = {}
    for i, _, b in docs:
        for p in range(len(b) - 49):
            s = b[p:p + 50]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, d, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("slice_bytes", [2000, 12 << 20])
def test_repeated_passages(messy, texts, monkeypatch, slice_bytes):
    from posefarm.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_bytes)
    same_rows([tuple(r) for r in suffix_dedup.without_repeats(messy).collect()], plain_removal(texts))


def test_repeated_passages_at_random(llm, monkeypatch):
    from posefarm.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "SLICE", 3000)
    draw = random.Random(12)
    pool = ["".join(draw.choice("ab") for _ in range(draw.randint(20, 90))) for _ in range(12)] + ["a" * 70, "ab" * 45, "é" * 33]
    rows = [(draw.randint(0, 60), "".join(draw.choice(pool) for _ in range(draw.randint(0, 9)))) for _ in range(70)]
    out = suffix_dedup.without_repeats(llm.createDataFrame(rows, "doc_id long, text string").repartition(4))
    same_rows([tuple(r) for r in out.collect()], plain_removal(rows))


@pytest.mark.parametrize("hot, stretch", [(1, 1 << 23), (5, 70), (1024, 51)])
def test_a_phrase_in_all_documents(llm, monkeypatch, hot, stretch):
    """One phrase with other words around it in each document: its strings are rows, not one bucket."""
    from posefarm.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "SLICE", 3000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 6)))
    phrase = "all rights reserved, printed by " + "no one at all"
    tails = [word() + " " + word() + " " + word() for _ in range(9)]
    rows = [(draw.randint(0, 90), " ".join([word() for _ in range(6)] + [phrase, draw.choice(tails)] + [word() for _ in range(4)])) for _ in range(150)]
    rows += [(200, "ab" * 300), (201, "ab" * 200), (None, rows[0][1])]
    table = llm.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = []
    if hot == 1:
        merge = suffix_dedup._merge
        monkeypatch.setattr(suffix_dedup, "_merge", lambda runs: kept.append(runs.count()) or merge(runs))
    same_rows([tuple(r) for r in suffix_dedup.without_repeats(table).collect()], plain_removal(rows))
    assert hot > 1 or kept == [0] or kept[0] < 40


def test_places_in_a_long_text(monkeypatch):
    from posefarm.llm import suffix_dedup, text
    raw = np.frombuffer(b"abcab" * 4000 + b"x" * 200, np.uint8)
    at = np.array([0, len(raw)])
    whole = suffix_dedup.strings(raw, at)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 777)
    for a, b in zip(whole, suffix_dedup.strings(raw, at)):
        assert (a == b).all()
    # Equal strings have their anchor at the same place in them, wherever they stand.
    distance = {}
    for s, a in zip(whole[0].tolist(), whole[1].tolist()):
        assert distance.setdefault(raw[s:s + 50].tobytes(), a - s) == a - s


def test_loser_tree_merges():
    from posefarm.llm.suffix_dedup import decode_run, encode_run, merged
    draw = random.Random(1)
    for k in (1, 2, 3, 7):
        runs = [sorted((bytes(draw.choice(b"ab") for _ in range(draw.randint(32, 50))), b"x" * draw.randint(0, 3), draw.randint(0, 9)) for _ in range(draw.randint(1, 60)))
                for _ in range(k)]
        out = list(merged([decode_run(encode_run(r)) for r in runs]))
        assert [o[0] for o in out] == sorted(s for r in runs for s, _, _ in r)
        for a, b in zip(out, out[1:]):
            n = next((i for i in range(min(len(a[0]), len(b[0]))) if a[0][i] != b[0][i]), min(len(a[0]), len(b[0])))
            assert b[1] == n


def test_a_slice_sends_its_fingerprints_once_a_part(llm, monkeypatch):
    """However many tasks its documents were read by: rows sent grow with slices and parts alone."""
    import pathlib

    from posefarm.llm import suffix_dedup
    from posefarm.session import checkpoint_dir
    monkeypatch.setattr(suffix_dedup, "SLICE", 3000)
    draw = random.Random(3)
    rows = [(k, "".join(draw.choice("abcdef ") for _ in range(draw.randint(60, 400))) + "the same passage of more than fifty bytes in many a document" * (k % 3 == 0)) for k in range(120)]
    seen, live = [], suffix_dedup._live

    def counted(sent):
        seen.append((sent.count(), sent.select("slice", "part").distinct().count()))
        return live(sent)

    monkeypatch.setattr(suffix_dedup, "_live", counted)
    same_rows([tuple(r) for r in suffix_dedup.without_repeats(llm.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()], plain_removal(rows))
    assert seen[0][0] == seen[0][1] > 6
    # The runs are gone once they are merged, their states stay.
    kept = {k.name for f in pathlib.Path(checkpoint_dir(llm).removeprefix("file:")).glob("posefarm-runs-*") for k in f.glob("kind=*")}
    assert kept == {"kind=state"}


def test_loser_tree_merges_records_that_end_in_zeros():
    from posefarm.llm.suffix_dedup import decode_run, encode_run, merged
    draw = random.Random(5)
    stem = [b"a" * 32, b"a" * 31 + b"\0", b"\0" * 32, b"\xff" * 32]
    runs = [sorted((draw.choice(stem) + bytes(draw.choice(b"\0\0\1") for _ in range(draw.randint(0, 18))), b"", draw.randint(0, 9)) for _ in range(40)) for _ in range(5)]
    assert [[(x[0], x[2], x[3]) for x in decode_run(encode_run(r))] for r in runs] == runs
    out = list(merged([decode_run(encode_run(r)) for r in runs]))
    assert [o[0] for o in out] == sorted(s for r in runs for s, _, _ in r)
    for a, b in zip(out, out[1:]):
        assert b[1] == next((i for i in range(min(len(a[0]), len(b[0]))) if a[0][i] != b[0][i]), min(len(a[0]), len(b[0])))


# ---------------------------------------------------------------- 10 decontamination
def plain_alignment(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        here = [0]
        for k, y in enumerate(b):
            here.append(max(0, above[k] + (2 if x == y else -1), above[k + 1] - 1, here[k] - 1))
        best, above = max(best, *here), here
    return best


def test_alignment_is_smith_waterman():
    from posefarm.llm.decontaminate import align
    draw = np.random.default_rng(5)
    left = [draw.integers(10, 15, draw.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    right = [draw.integers(10, 15, draw.integers(1, 20)).astype(np.uint64) + np.uint64(2) for _ in range(60)]
    assert align(left, right).tolist() == [plain_alignment(a.tolist(), b.tolist()) for a, b in zip(left, right)]


def test_decontamination(llm, messy, texts, monkeypatch):
    from posefarm.llm import decontaminate
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(30)] for _ in range(6)]
    docs = []
    for k in range(60):
        body = [word() for _ in range(60)]
        if k % 3 == 0:
            hurt = list(items[k % 6])
            for _ in range(draw.randint(0, 4)):
                hurt[draw.randrange(len(hurt))] = word()
            if k % 2:
                hurt.pop(10)
            body[20:20] = hurt
        elif k % 3 == 1:
            body[10:10] = items[k % 6][:6]
        docs.append((k, " ".join(w.upper() if k % 4 == 0 else w + "," for w in body)))
    bench = llm.createDataFrame([*enumerate(map(" ".join, items)), (7, None), (8, ""), (None, "two words")], "item_id long, text string")
    frame = llm.createDataFrame(docs, "doc_id long, text string")
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = {d: max((plain_alignment(i, plain(t)), -k) for k, i in enumerate(items)) for d, t in docs}
    for block in (8 << 20, 400):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        for r in decontaminate.overlap(frame, bench).collect():
            score, item = want[r.doc_id]
            assert r.contaminated == (score >= 30)
            if r.contaminated:
                assert (r.score, r.item_id) == (score, -item)
    # Equal items: the smaller id, however the benchmark is cut.
    same = llm.createDataFrame([(k, " ".join(items[0])) for k in (5, 3, 9, 2, 7)], "item_id long, text string")
    for block in (8 << 20, 100):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert decontaminate.overlap(llm.createDataFrame([(1, " ".join(items[0]))], "doc_id long, text string"), same).first().item_id == 2
    clean = decontaminate.drop_contaminated(messy, bench)
    assert clean.columns == messy.columns and clean.count() == len(texts)
    assert decontaminate.overlap(messy, bench.limit(0)).filter("contaminated").count() == 0


# ---------------------------------------------------------------- empty tables
def test_empty_tables(nothing, field):
    from posefarm.llm import classifier, near_dedup, packing, pii, quality_rules, sharding, suffix_dedup, token_output
    file = public_tokenizers.path("byte_bpe_50k.json")
    model = (np.zeros(classifier.FAMILIES * classifier.BUCKETS, np.float32), 0.0)
    for out in (quality_rules.quality_rules(nothing), near_dedup.near_duplicates(nothing), classifier.scored(nothing, model), pii.find(nothing, field),
                packing.pack(nothing, public_tokenizers.path("word_bpe_49k.json")), token_output.round_trip(nothing, file), sharding.sharded(nothing),
                suffix_dedup.without_repeats(nothing)):
        assert out.count() == 0
