"""Weak supervision: rules vote on every document, expectation-maximisation finds how
far each rule can be trusted, and the posterior probability decides.

Only DataFrame functions are used.  A rule votes 1 (good), -1 (bad) or 0 (abstains).
For each rule two accuracies are estimated: how often a vote on a good document is 1
and how often a vote on a bad document is -1.  EM needs no more than the number of
documents per vote pattern, at most 3 ** len(RULES) rows whatever the input.

Cases: a text that is null or empty has no words, fails the base and is not kept; its
rules that need words abstain.  Repeated rows each get the same result.  An empty table
gives an empty result.  A posterior of exactly 0.5 is kept.  A very long text is one row
like any other; its windows are built only if one of them comes twice.  Columns beside
doc_id and text are never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.llm.store import ROW, packed, stored, unpacked

#: Words are runs of anything but these ASCII blanks.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

#: name, condition for a good vote, condition for a bad vote.  Whole numbers only.
RULES = [
    ("length", "n_words >= 30", "n_words < 15"),
    ("symbols_per_word", "n_words > 0 AND 50 * n_symbols <= n_words", "n_words > 0 AND 8 * n_symbols > n_words"),
    ("symbols_per_character", "n_words > 0 AND 200 * n_symbols <= word_chars", "n_words > 0 AND 30 * n_symbols > word_chars"),
    ("marked_words", "n_words > 0 AND 50 * n_marked <= n_words", "n_words > 0 AND 6 * n_marked > n_words"),
    ("duplicate_lines", "n_lines > 1 AND n_dup_lines = 0", "3 * n_dup_lines > n_lines"),
    ("repeated_words", "n_words >= 30 AND n_repeat_words = 0", "n_words > 0 AND 100 * n_repeat_words > 20 * n_words"),
    ("capitals", "n_words > 0 AND 8 * n_upper <= word_chars", "n_words > 0 AND 4 * n_upper > word_chars"),
    ("exclamations", "n_words > 0 AND 50 * n_exclaim <= n_words", "n_words > 0 AND 6 * n_exclaim > n_words"),
    ("distinct_words", "n_words >= 30 AND 10 * n_distinct >= 4 * n_words", "n_words >= 15 AND 10 * n_distinct < 3 * n_words"),
]

#: Where EM starts, with the weight of so many votes: four in five documents are good, a
#: rule seldom blames a good one, and a bad one is mostly blamed by few of the rules.
SHARE, RIGHT, WRONG, WEIGHT = 0.8, 0.99, 0.3, 10.0
TOLERANCE = 1e-9


def _count(text: Column, characters: str) -> Column:
    """Code points of ``text`` among ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _mixed(turn: int):
    """Two hashes in one; which is left and which is right matters."""
    return lambda a, b: a.bitwiseXOR(F.shiftleft(b, 8 * turn + 1)).bitwiseXOR(F.shiftrightunsigned(b, 63 - 8 * turn))


def _fold(hashes: str, step: int, turn: int) -> Column:
    """Every hash with the one ``step`` places on; the last ones, which have none, are null."""
    return F.zip_with(hashes, F.expr(f"slice({hashes}, {step + 1}, size({hashes}))"), _mixed(turn))


def features(docs: DataFrame, *carry: Column) -> DataFrame:
    """doc_id, the counts the rules read, and what is carried along.

    A window of five words is compared by its 64-bit hash first; only texts in which a
    hash comes twice build the windows themselves, sort them and mark equal neighbours.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(
        docs["doc_id"].alias("doc_id"), *carry,
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0).alias("lines"),
        (F.length(F.translate(text, BLANKS, ""))).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"), _count(text, UPPER).alias("n_upper"), _count(text, "!").alias("n_exclaim"),
    )
    kept = [c for c in base.columns if c not in ("words", "lines")]
    hashed = base.select(
        *kept, "words",
        F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.when(F.col("n_symbols") > 0, F.size(F.filter("words", lambda w: F.length(F.translate(w, SYMBOLS, "")) < F.length(w))))
        .otherwise(0).cast("long").alias("n_marked"),
        F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("_one"),
    )
    kept = [c for c in hashed.columns if c not in ("words", "_one")]
    # Neighbours are folded two, four and then five at a time, by bits alone.
    wide = hashed.select(*kept, "words", _fold("_one", 1, 1).alias("_two"), "_one")
    wide = wide.select(*kept, "words", _fold("_two", 2, 2).alias("_four"), "_one")
    hashed = wide.select(*kept, "words", F.slice(F.zip_with("_four", F.expr(f"slice(_one, {WINDOW}, size(_one))"), _mixed(3)),
                                                 F.lit(1), F.size("_one") - WINDOW + 1).alias("_h"))
    ordered = hashed.select(*kept, F.expr(f"""
        CASE WHEN size(array_distinct(_h)) < size(_h) THEN
            sort_array(transform(sequence(0, size(words) - {WINDOW}), i -> struct(concat_ws(' ', slice(words, i + 1, {WINDOW})) AS w, i AS i)))
        END""").alias("_s"))
    starts = ordered.select(*kept, F.expr("""
        sort_array(filter(transform(_s, (x, k) -> CASE WHEN get(_s, k - 1).w = x.w OR get(_s, k + 1).w = x.w THEN x.i END),
                          i -> i IS NOT NULL))""").alias("_at"))
    return starts.select(*kept, F.expr(f"""
        coalesce(aggregate(transform(_at, (s, k) -> least({WINDOW}, coalesce(get(_at, k + 1), s + {WINDOW}) - s)),
                           0L, (a, b) -> a + b), 0L)""").alias("n_repeat_words"))


def voted(counted: DataFrame) -> DataFrame:
    """Add base_failed and the array of votes."""
    votes = [F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for _, good, bad in RULES]
    return counted.withColumns({
        "base_failed": F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"), "votes": F.array(*votes)})


def _posterior(share: float, right: list[float], wrong: list[float]) -> Column:
    """Probability of a good document given the column ``votes``."""
    odds = F.lit(math.log(share) - math.log(1 - share))
    for r, (a, b) in enumerate(zip(right, wrong)):
        v = F.col("votes")[r]
        odds = odds + F.when(v == 1, math.log(a) - math.log(1 - b)).when(v == -1, math.log(1 - a) - math.log(b)).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-odds))


def estimate(patterns: DataFrame) -> tuple[float, list[float], list[float]]:
    """EM over (votes, n): share of good documents, accuracies on good and on bad ones.

    The table of patterns comes to the driver once: at most 3 ** len(RULES) rows whatever
    the input, so a round costs no Spark job.  With the prior counts EM climbs a bounded
    likelihood, and it ends when no number moves by TOLERANCE any more.
    """
    rules = range(len(RULES))
    rows = sorted((tuple(r["votes"]), r["n"]) for r in patterns.select("votes", "n").collect())
    if not rows:
        return SHARE, [RIGHT] * len(RULES), [WRONG] * len(RULES)
    # For each pattern, the rules that vote on it, split by their vote.
    voters = [(n, [r for r in rules if v[r] == 1], [r for r in rules if v[r] == -1]) for v, n in rows]
    total = sum(n for _, n in rows)
    share, right, wrong = SHARE, [RIGHT] * len(RULES), [WRONG] * len(RULES)
    moved = 1.0
    while moved >= TOLERANCE:
        prior = math.log(share) - math.log(1 - share)
        up = [math.log(a) - math.log(1 - b) for a, b in zip(right, wrong)]
        down = [math.log(1 - a) - math.log(b) for a, b in zip(right, wrong)]
        all_good = 0.0
        good_up, good_down, bad_up, bad_down = ([0.0] * len(RULES) for _ in range(4))
        for n, for_it, against in voters:
            odds = prior + sum(up[r] for r in for_it) + sum(down[r] for r in against)
            good = n / (1.0 + math.exp(-odds))
            bad = n - good
            all_good += good
            for r in for_it:
                good_up[r] += good
                bad_up[r] += bad
            for r in against:
                good_down[r] += good
                bad_down[r] += bad

        def smooth(hits: float, of: float, start: float) -> float:
            return (hits + start * WEIGHT) / (of + WEIGHT)

        new = (smooth(all_good, total, SHARE),
               [smooth(good_up[r], good_up[r] + good_down[r], RIGHT) for r in rules],
               [smooth(bad_down[r], bad_up[r] + bad_down[r], WRONG) for r in rules])
        moved = max(abs(x - y) for x, y in zip([new[0], *new[1], *new[2]], [share, *right, *wrong]))
        share, right, wrong = new
    return share, right, wrong


def _judged(docs: DataFrame, *carry: Column) -> DataFrame:
    counted = stored(voted(features(docs, *carry)), "quality")
    posterior = _posterior(*estimate(counted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))))
    return counted.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, votes, posterior and verdict for every row of ``docs`` (doc_id, text)."""
    return _judged(docs)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias(ROW)
    return unpacked(_judged(docs, row).filter("kept"), docs.columns)
