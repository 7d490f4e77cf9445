"""Verdicts on page addresses: host rules, and a list of addresses behind a blocked Bloom
filter.

A rule is a host and the start of a path; it fits the host and its subdomains, and of the
rules that fit the longest wins.  Addresses without a rule are looked up, in canonical form,
in a list of any size: a Bloom filter of 512-bit blocks (one bit in each of eight words)
passes possible hits, and an exact join with the list removes the false ones.  The filter is
a table of blocks, so it is built by an aggregate and met by a join; nothing is sent to all
tasks unless Spark finds it small.

Cases: an address that is null or has no "://" has an empty host and path, fits no rule and
is allowed.  Repeated rows share their result.  With an empty list nothing is blocked by it.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.llm.store import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are spelled out in the plan; longer lists belong in the list of addresses.
MOST_RULES = 1000
WORDS = 8
#: Bits of the filter for each listed address: one in 200 others passes.
BITS = 12


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., path without slashes at its end, no query or fragment."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # later ones are asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _bits(address: Column) -> list[Column]:
    """One bit for each word of a block."""
    h = F.xxhash64(F.lit("bits"), address)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * w).bitwiseAND(F.lit(63)).cast("int")) for w in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the addresses in ``listed`` (address)."""
    rows = listed.select(F.pmod(F.xxhash64("address"), F.lit(blocks)).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("address")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``listed`` (url) holds the addresses to block.
    """
    host, path = host_and_path(listed["url"])
    listed = stored(listed.select(canonical(host, path).alias("address")).filter("address <> ''").distinct(), "listed")
    blocks = max(1, -(-listed.count() * BITS // (64 * WORDS)))
    host, path = host_and_path(pages["url"])
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"), canonical(F.col("host"), F.col("path")).alias("address"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("address"), F.lit(blocks)))
    passes = F.lit(True)
    for k, bit in enumerate(_bits(F.col("address"))):
        passes = passes & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    met = rows.join(bloom(listed, blocks), "block", "left").withColumn("possible", F.coalesce(passes, F.lit(False)) & F.col("rule").isNull())
    met = stored(met.select("page_id", "host", "path", "rule", "verdict", "address", "possible"), "filtered")
    hits = met.filter("possible").join(listed.withColumn("hit", F.lit(True)), "address", "left")
    out = hits.select("page_id", "host", "path", "rule", "verdict", "hit").unionByName(
        met.filter("NOT possible").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("boolean").alias("hit")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
