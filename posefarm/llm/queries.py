"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from posefarm.llm import (
    chat, classifier, decontaminate, hard_negatives, near_dedup, packing, pii, prefix_trie, quality_rules, sharding, sql, suffix_dedup, token_output, url_filter,
)
from posefarm.llm.store import documents, prepared, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepared(spark), sf_dir)
    return fn


@query
def op1_quality_rules(spark, sf_dir):
    """Weak supervision over all documents."""
    return quality_rules.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("posterior", 4).alias("posterior"))


@query
def op2_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query
def op10_benchmark_decontamination(spark, sf_dir):
    """Best aligned benchmark item of every document."""
    return decontaminate.overlap(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op5_sequence_packing(spark, sf_dir):
    """Sequences of at most 2048 tokens of all documents."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_personal_data(spark, sf_dir):
    """Personal data in every document: pattern spans, and the field's on top."""
    return pii.find(documents(spark, sf_dir), pii.train(pii.labelled_table(spark)))


@query
def op3_quality_classifier(spark, sf_dir):
    """Quality score of every document."""
    docs = documents(spark, sf_dir)
    return classifier.scored(docs, classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: Host, start of the path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: What makes a host listed, with all its addresses: a label put together from words by
#: hyphens, the way keyword farms name their sites.  Punycode labels (xn--) do not count.
KEYWORD_HOST = r"(^|\.)[a-z0-9]+(-[a-z0-9]+)+(\.|$)"


@query
def op6_url_filter(spark, sf_dir):
    """Verdict on every page address."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.filter(url_filter.host_and_path(F.col("url"))[0].rlike(KEYWORD_HOST))
    return url_filter.judged(pages, URL_RULES, listed.select("url"))


@query
def op8_byte_sharding(spark, sf_dir):
    """Shards of near equal bytes for all documents."""
    return sharding.sharded(documents(spark, sf_dir), 24)


@query
def op9_repeated_passages(spark, sf_dir):
    """What is left of every document without passages of smaller ids."""
    return suffix_dedup.without_repeats(documents(spark, sf_dir))


@query
def op7_token_files(spark, sf_dir):
    """Ids of all documents through token files."""
    return token_output.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_prefix_trie(spark, sf_dir):
    """Every node of the trie of all conversations, rebuilt on shared heads."""
    turns = prefix_trie.with_shared_heads(prefix_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie.trie(turns)


@query
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every fiftieth vector."""
    rows = hard_negatives.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.mined(rows, F.col("vec_id") % hard_negatives.ANCHOR == 0)


#: What both turns of conversation -1 say: every control string of the template.
CONTROLS = f"{chat.END}{chat.OPEN} ok {chat.CLOSE}"


@query
def op13_chat_formatting(spark, sf_dir):
    """All conversations as event logs, folded, formatted, written and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), (F.lit(2**63 - 2) + F.col("id")).alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROLS).alias("text"))
    messages = chat.folded(chat.as_log(chat.numbered(rows.unionByName(extra))))
    return chat.summaries(stored(chat.rendered(messages), "chat"))


SQL["op1_quality_rules"] = sql.quality()
SQL["op2_minhash_near_dedup"] = sql.near_duplicates(near_dedup.PERCENT)
SQL["op6_url_filter"] = sql.url_filter(URL_RULES, KEYWORD_HOST)
SQL["op11_prefix_trie"] = sql.prefix_trie()
SQL["op12_hard_negatives"] = sql.hard_negatives()
SQL["op13_chat_formatting"] = sql.chat_formatting(CONTROLS)
SQL["op9_repeated_passages"] = sql.repeats(suffix_dedup.SPAN)
