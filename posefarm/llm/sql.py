"""DuckDB forms of the queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from posefarm.llm import quality_rules as Q

_BLANK = r"[\x20\x09-\x0D]"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_BLANK}+'), lambda w: w <> '')"


def quality() -> str:
    rules = range(1, len(Q.RULES) + 1)
    votes = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END" for _, good, bad in Q.RULES)
    odds = ("ln({m}.p) - ln(1 - {m}.p) + list_sum(list_transform(range(1, " + str(len(Q.RULES) + 1) + "), lambda r: "
            "CASE {v}.votes[r] WHEN 1 THEN ln({m}.a[r]) - ln(1 - {m}.b[r]) WHEN -1 THEN ln(1 - {m}.a[r]) - ln({m}.b[r]) ELSE 0 END))")

    def smooth(hits: str, of: str, start: float) -> str:
        return f"(coalesce(sum({hits}), 0) + {start * Q.WEIGHT}) / (coalesce(sum({of}), 0) + {Q.WEIGHT})"

    new_a = ", ".join(smooth(f"CASE WHEN v[{r}] = 1 THEN n * q END", f"CASE WHEN v[{r}] <> 0 THEN n * q END", Q.RIGHT) for r in rules)
    new_b = ", ".join(smooth(f"CASE WHEN v[{r}] = -1 THEN n * (1 - q) END", f"CASE WHEN v[{r}] <> 0 THEN n * (1 - q) END", Q.WRONG) for r in rules)
    start = f"0 AS it, {Q.SHARE}::DOUBLE AS p, {[Q.RIGHT] * len(Q.RULES)}::DOUBLE[] AS a, {[Q.WRONG] * len(Q.RULES)}::DOUBLE[] AS b, 1.0::DOUBLE AS moved"
    return f"""
WITH RECURSIVE base AS (
    SELECT doc_id, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS s
    FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 4] AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) AS f(k) GROUP BY doc_id),
counted AS (
    SELECT b.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(s) - len(list_distinct(s)))::BIGINT AS n_dup_lines,
        len(s)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_distinct(w)) AS n_distinct,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim,
        len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_marked
    FROM base b LEFT JOIN covered c USING (doc_id)),
voted AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, [{votes}] AS votes FROM counted),
patterns AS (SELECT votes, count(*) AS n FROM voted GROUP BY votes),
em AS (
    SELECT {start}
    UNION ALL
    SELECT it + 1, p1, a1, b1, greatest(abs(p1 - p0), list_max(list_transform(range(1, {len(Q.RULES) + 1}), lambda r: greatest(abs(a1[r] - a0[r]), abs(b1[r] - b0[r])))))
    FROM (SELECT it, p0, a0, b0, {smooth('n * q', 'n', Q.SHARE)} AS p1, [{new_a}] AS a1, [{new_b}] AS b1
          FROM (SELECT em.it, em.p AS p0, em.a AS a0, em.b AS b0, x.votes AS v, x.n, 1 / (1 + exp(-({odds.format(m="em", v="x")}))) AS q
                FROM em, patterns x WHERE em.moved >= {Q.TOLERANCE}) GROUP BY it, p0, a0, b0)),
model AS (SELECT p, a, b FROM em ORDER BY it DESC LIMIT 1),
judged AS (SELECT voted.*, 1 / (1 + exp(-({odds.format(m="model", v="voted")}))) AS q FROM voted, model)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND q >= 0.5) AS kept, round(q, 4) AS posterior
FROM judged"""


def near_duplicates(percent: int) -> str:
    return f"""
WITH RECURSIVE base AS (SELECT doc_id, {_words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, w FROM base WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x, least(x, min(y)) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id)::BIGINT AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.x = d.doc_id"""


def url_filter(rules: list[tuple[str, str, str]], listed_host: str) -> str:
    def choose(value) -> str:
        cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'"
                         for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])))
        return f"CASE {cases} END"

    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS address FROM split),
listed AS (SELECT DISTINCT address FROM named WHERE address <> '' AND regexp_matches(host, '{listed_host}'))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, {choose(lambda h, p, v: h + p)} AS rule,
    coalesce({choose(lambda h, p, v: v)}, CASE WHEN address IN (SELECT address FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named"""


def repeats(span: int) -> str:
    return f"""
WITH base AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * span}) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {span} + 1)) AS p FROM base)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS m FROM starts) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM late, range({span}) AS f(k)),
marked AS (SELECT g.doc_id, g.p, lag(g.p) OVER (PARTITION BY g.doc_id ORDER BY g.p) AS before FROM gone g),
counted AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans, list(p) AS places FROM marked GROUP BY doc_id),
places AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM base WHERE doc_id IN (SELECT doc_id FROM counted)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) AS rest FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT b.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(rest, '') END)) AS kept_sha256
FROM base b LEFT JOIN counted c USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII string, bit by bit."""
    bit = "CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384::BIGINT) ELSE u >> 1 END"
    step = f"list_reduce(range(8)::BIGINT[], lambda u, v: {bit}, xor(x, y))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda x, y: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def prefix_trie() -> str:
    return f"""
WITH numbered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM numbered)),
head AS (SELECT c.conv_id, n.place AS depth, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.place <= c.h),
taken AS (SELECT c.conv_id, c.h, count(d.depth) AS n FROM convs c LEFT JOIN head d USING (conv_id) GROUP BY ALL),
turns AS (
    SELECT * FROM head UNION ALL
    SELECT n.conv_id, n.place - t.h + t.n, n.role, n.text FROM numbered n JOIN taken t USING (conv_id) WHERE n.place > t.h),
paths AS (
    SELECT conv_id, 0 AS depth, []::STRUCT(r VARCHAR, t VARCHAR)[] AS path, 0 AS words FROM convs UNION ALL
    SELECT conv_id, depth, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY depth),
        len({_words("text")}) FROM turns),
member AS (
    SELECT conv_id, depth, words, min(conv_id) OVER w AS owner, count(*) OVER w AS n_convs, max(depth) OVER (PARTITION BY conv_id) AS length
    FROM paths WINDOW w AS (PARTITION BY depth, path)),
nodes AS (SELECT owner AS conv_id, depth, any_value(words) AS words, any_value(n_convs) AS n_convs FROM member GROUP BY ALL),
parents AS (
    SELECT n.conv_id, n.depth, n.words, n.n_convs, p.owner AS parent_conv_id
    FROM nodes n LEFT JOIN member p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM parents WHERE depth > 0 GROUP BY ALL),
own AS (SELECT p.*, coalesce(c.n, 0) AS n_children FROM parents p LEFT JOIN children c USING (conv_id, depth)),
totals AS (
    SELECT m.owner AS conv_id, m.depth, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.words) AS saved_tokens
    FROM own o JOIN member m ON m.conv_id = o.conv_id AND m.depth <= o.depth GROUP BY ALL),
ends AS (SELECT owner AS conv_id, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM member WHERE depth = length GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
    sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN totals USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)"""


def hard_negatives() -> str:
    return """
WITH finite AS (
    SELECT vec_id, label, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM finite),
scores AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank,
        n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3"""


def chat_formatting(extra: str) -> str:
    control = r"([\[<])(\\*)(/?INST\]|/s>)"
    longer = f"length(regexp_replace({{0}}, '{control}', '\\1\\\\\\2\\3', 'g'))"
    marks = len("[INST][/INST]</s>")
    return f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 9223372036854775806, 'user', '{extra}' UNION ALL SELECT -1, 9223372036854775807, 'assistant', '{extra}'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({marks} + {longer.format('role')} + {longer.format('text')})::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id"""
