"""The pipeline against its stages' plain versions, and the registered queries' SQL twins."""

import collections
import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_minhash_near_dedup", "op6_url_filter", "op9_repeated_passages",
                                  "op11_prefix_trie", "op12_hard_negatives", "op13_chat_formatting"])
def test_same_as_sql(llm, con, name):
    status, detail, *_ = compare(llm, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", detail


def test_names_of_the_queries():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_keep_the_columns(llm, messy):
    import corpus_pipeline

    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(llm, docs, SF)
        assert docs.columns == messy.columns, name
        docs = llm.createDataFrame(docs.collect(), messy.schema)
    kept = collections.Counter(r.doc_id for r in docs.collect())
    assert kept[1] == 1 and not kept[2] and not kept[6] and not kept[9]
    pieces = corpus_pipeline.STAGES[-1][1](llm, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_on_an_empty_table(llm, nothing):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(llm, nothing, SF).count() == 0, name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_classifier_ranks_the_held_out_labels(llm):
    sf = "/root/testdata/sf0.01"
    scores = entry.queries()["op3_quality_classifier"](llm, sf).filter("held_out")
    rows = scores.join(llm.read.parquet(f"{sf}/labels.parquet").filter("quality IS NOT NULL"), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(good) > 20 and len(bad) > 2
    ahead = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ahead >= 0.95 and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
