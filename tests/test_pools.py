"""Pools, splits, sources and plans on hand-made fixtures."""

import functools
import json

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpers import rows
from posefarm.operators import curation as cu
from posefarm.operators import pools as pl
from posefarm.sources import pools as src
from posefarm.sources import structures as so

POOL = "complex_id string, pose_id long, score double, dockq double, prov int, round int, qi long, cx long, cy long, cz long"


def pool(spark, keys, dockq=0.0, score=None, c="A", start=0):
    return spark.createDataFrame([(c, start + i, float(i if score is None else score), float(dockq), 0, 0, k, 0, -5, 0) for i, k in enumerate(keys)], POOL)


def kept(spark, cand, have):
    return [r[0] for r in pl.fresh_rows(pool(spark, cand), pool(spark, have)).orderBy("pose_id").select("pose_id").collect()]


def test_fresh_rows(spark):
    assert kept(spark, [20, 21, 22, 23], [10, 11, 12, 13]) == [0, 1, 2, 3]
    assert kept(spark, [11, 99, 10, 98], [10, 11, 12]) == [1, 3]
    assert kept(spark, [7, 7, 8, 7], [1]) == [0, 2]
    with pytest.raises(Exception, match="without identity"):
        pl.fresh_rows(pool(spark, [1]), pool(spark, [-1])).collect()


def test_cap_keeps_positives(spark):
    p = pool(spark, range(40), 0.5).unionByName(pool(spark, range(40, 300), 0.0, start=40))
    c = pl.cap_pool(p, 100)
    assert (c.count(), c.filter("dockq > 0.23").count()) == (100, 40)
    assert c.filter("dockq < 0.23").agg(F.min("score")).first()[0] == 200.0
    assert pl.cap_pool(p, 30).count() == 40


def test_absorb(spark):
    p = pool(spark, range(10), 0.5).unionByName(pool(spark, range(10, 100), 0.0, start=10))
    mined = pool(spark, range(200, 260), 0.0, start=500).withColumn("round", F.lit(1))
    after = pl.absorb_round(p, mined, 1, 4000)
    r = pl.pool_composition(after).first()
    assert (r.n, r.n_pos, r.random_neg, r.hard_neg) == (160, 10, 90, 60)
    s = pl.absorb_stats(p, mined, after).first()
    assert (s.proposed, s.duplicate, s.added, s.survived, s.evicted, s.pool_before, s.pool_after) == (60, 0, 60, 60, 0, 100, 160)
    assert pl.absorb_round(p, pool(spark, range(200, 260), 0.6, start=500), 1, 4000).count() == 100


def test_leverage_meets_its_rows_once(spark):
    old = pool(spark, range(4), 0.5).unionByName(pool(spark, range(10, 14), score=2.5, start=10))
    got = pl.new_negative_leverage(old, pool(spark, [10, 30, 31], score=9.0, start=20))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    r = got.first()
    assert (r.fresh, r.new_in_band, r.old_in_band, r.new_hardest) == (2, 2, 4, 1)


def test_shuffles_of_the_pool_grow_with_it(spark, monkeypatch):
    from posefarm import session
    from posefarm.plans import views as V
    key, sf = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "/root/testdata/sf0.001"
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100, raising=False)
    try:
        n = V.pool(spark, sf).count()
        assert int(spark.conf.get(key, "0")) >= n // 100 > 8
    finally:
        spark.conf.unset(key)


def test_coverage(spark):
    def t(**cells):
        return [float(cells.get(f"k{i}", 0)) for i in range(144)]
    p = spark.createDataFrame([("A", t(k0=1)), ("B", t(k0=2, k37=1))], "complex_id string, t array<double>")
    c = {r.k: r.coverage for r in pl.pair_coverage(p).collect()}
    assert (c[0], c[37], sum(v == 0 for v in c.values())) == (2, 1, 142)


def corpus(spark):
    ids = [f"sys{i:03d}__A1_X--sys{i:03d}__B1_Y" for i in range(60)]
    order = spark.createDataFrame(list(enumerate(ids)), "rank int, id string")
    manifest = spark.createDataFrame([(i, x, "fail" if i in (3, 11) else "ok") for i, x in enumerate(ids)], "rank int, id string, status string")
    volumes = spark.createDataFrame([(x, 1.2, 10_000_000 if i in (5, 20) else 1000) for i, x in enumerate(ids)], "id string, spacing double, voxels long")
    return ids, order, manifest, volumes


def test_nested_split(spark):
    ids, order, manifest, volumes = corpus(spark)
    ok = cu.eligible(order, manifest, volumes, 5000, 1.2)
    parts = {n: {r.id: r.part for r in cu.nested_split(ok, n).collect()} for n in (8, 16, 32)}
    for n, p in parts.items():
        assert sum(v == "validation" for v in p.values()) / len(p) == pytest.approx(0.2) and sum(v == "fit" for v in p.values()) == n
        assert not {ids[i] for i in (3, 11, 5, 20)} & set(p)
    assert parts[8].items() <= parts[16].items() <= parts[32].items()


def test_eligible_fails_closed(spark):
    ids, order, manifest, volumes = corpus(spark)
    with pytest.raises(Exception, match="no volume recorded"):
        cu.eligible(order, manifest, volumes.filter(F.col("id") != ids[7]), 5000, 1.2).collect()
    with pytest.raises(Exception, match="spacing"):
        cu.eligible(order, manifest, volumes, 5000, 3.0).collect()


def test_same_partner(spark):
    df = spark.createDataFrame([("a__A1_P1--b__B1_P1",), ("a__A1_P1--b__B1_P2",), ("nohalves_P1",)], "id string")
    assert [r[0] for r in df.select(cu.is_same_partner(F.col("id"))).collect()] == [True, False, False]


def test_pool_store(spark, tmp_path):
    data = [(c, i, float(i + 1 + k), f) for k, c in enumerate(("PRT1", "PRT2")) for i, f in enumerate((True, False, True, False, False))]
    src.write_pool(spark.createDataFrame(data, "complex_id string, pose_id int, rmsd double, hit boolean"), str(tmp_path / "p"), 4)
    read = lambda **k: [r.hit for r in src.read_pool(spark, str(tmp_path / "p"), ["PRT1"], **k).orderBy("pose_id").collect()]
    assert read() == [True, False, True, False, False] and read(hit_threshold=2.5) == [True, True, False, False, False]
    assert len(read(max_poses=2)) == 2
    with pytest.raises(Exception, match="no such complex"):
        src.read_pool(spark, str(tmp_path / "p"), ["NOPE"]).collect()


def test_shards_conflict(spark):
    a = pool(spark, [1, 2]).withColumn("_shard", F.lit(0))
    b = pool(spark, [1, 3]).withColumn("_shard", F.lit(1))
    with pytest.raises(Exception, match="shards disagree"):
        src.resolve_shards(a.unionByName(b)).collect()
    assert rows(src.resolve_shards(a.unionByName(b), "last").select("qi"), "qi") == [(1,), (3,)]


def test_manifest_last_line_wins(spark, tmp_path):
    lines = [{"rank": 0, "id": "a", "status": "fail"}, {"rank": 1, "id": "b", "status": "ok"}, {"rank": 0, "id": "a", "status": "ok"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert rows(src.read_manifest(spark, str(tmp_path / "m.jsonl")).select("id", "status"), "id") == [("a", "ok"), ("b", "ok")]


REC = "ATOM      1  N   GLN     1      14.376  -5.731  -7.538  2     1 1.63    1PPI -0.15"
LIG = "ATOM      1  N   GLN H   1     -28.292   9.602  -1.827  2     1 1.63 -0.15"


def test_structure_text(spark, tmp_path):
    (tmp_path / "1ABC_r_u.pdb.ms").write_text("REMARK\n" + REC + "\n")
    (tmp_path / "1ABC_l_u.pdb.ms").write_text(LIG + "\n")
    r, l = sorted(so.read_atoms_ms(spark, str(tmp_path)).collect(), key=lambda x: x.side, reverse=True)
    assert (r.complex_id, r.side, r.atom_name, r.res_name, r.chain, r.res_seq, r.x, r.y, r.z) == ("1ABC", "R", "N", "GLN", "", 1, 14.376, -5.731, -7.538)
    assert (r.ace_type, l.ace_type, l.chain, l.occupancy, l.tempfactor, round(l.radius_col, 2), round(l.charge_col, 2)) == ("1PPI", None, "H", 2, 1, 1.63, -0.15)


@pytest.mark.parametrize("text,message", [(LIG[:54] + "  1 2", "tail of 2 tokens"), ("REMARK nothing", "no atom records"), ("ATOM      1  N   GLN", "truncated")])
def test_bad_structure_text(spark, tmp_path, text, message):
    (tmp_path / "1BAD_r_u.pdb.ms").write_text(text + "\n")
    with pytest.raises(Exception, match=message):
        so.read_atoms_ms(spark, str(tmp_path)).collect()
    assert [r.reason for r in so.rejected_lines(spark, str(tmp_path)).collect()][0].startswith(message.split(" tokens")[0])


def test_stored_pools_are_sorted_and_pruned(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from posefarm.sources import pools
    rows = [(c, p, 1.0) for c in range(30) for p in range(40)]
    df = spark.createDataFrame(rows, "complex_id long, pose_id long, rmsd double").orderBy("rmsd")
    path = str(tmp_path / "pool")
    pools.write_pool(df, path, buckets=5)
    for f in glob.glob(f"{path}/*/*/*.parquet"):
        got = pq.ParquetFile(f).read(["complex_id", "pose_id"]).to_pylist()
        assert [tuple(r.values()) for r in got] == sorted(tuple(r.values()) for r in got)
    one = pools.read_pool(spark, path, names=[3, 4])
    assert sorted({r.complex_id for r in one.collect()}) == [3, 4] and one.count() == 80
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan
    assert {r.complex_id for r in pools.read_pool(spark, path, names=spark.createDataFrame([(7, 0)], "complex_id long, place int")).collect()} == {7}


def test_a_batch_is_absorbed_without_checkpoints(spark, tmp_path):
    import os

    from posefarm.session import checkpoint_dir
    from posefarm.streaming import incremental as inc
    stored = lambda: {d for d in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if d.startswith("rdd-")}
    inc.start_pool(pool(spark, range(20)).withColumn("origin", F.lit(0)), f"{tmp_path}/pool")
    mined = pool(spark, range(15, 40), start=100)
    mined.write.parquet(f"{tmp_path}/mined")
    before = stored()
    inc.absorb_stream(spark.readStream.schema(mined.schema).parquet(f"{tmp_path}/mined"), f"{tmp_path}/pool", f"{tmp_path}/state", 100).awaitTermination()
    assert stored() == before and inc.kept_pool(spark, f"{tmp_path}/pool").count() == 40


def test_absorbing_rewrites_only_its_buckets(spark, tmp_path):
    import os

    from posefarm.streaming import incremental as inc

    start = None
    for c in "ABCDEFGH":
        one = pool(spark, range(20), 0.0, c=c).withColumn("dockq", F.when(F.col("pose_id") < 3, 0.5).otherwise(0.0))
        start = one if start is None else start.unionByName(one)
    kept_at, mined_at = f"{tmp_path}/pool", f"{tmp_path}/mined"
    inc.start_pool(start.withColumn("origin", F.lit(0)), kept_at)
    before = {f: os.stat(f"{kept_at}/{f}").st_mtime_ns for f in os.listdir(kept_at) if f.startswith("bucket")}
    mined = pool(spark, range(15, 40), 0.0, c="B", start=100)
    mined.write.parquet(mined_at)

    def absorbed(state):
        stream = spark.readStream.schema(mined.schema).parquet(mined_at)
        inc.absorb_stream(stream, kept_at, f"{tmp_path}/{state}", 30).awaitTermination()
        return sorted(map(tuple, inc.kept_pool(spark, kept_at).select("complex_id", "pose_id", "origin").collect()))

    first = absorbed("one")
    want = pl.absorb_round(start.withColumn("origin", F.lit(0)), mined, 1, 30)
    assert first == sorted(map(tuple, want.select("complex_id", "pose_id", "origin").collect()))
    after = {f: os.stat(f"{kept_at}/{f}").st_mtime_ns for f in os.listdir(kept_at) if f.startswith("bucket")}
    assert sum(after[f] != before[f] for f in before) == 1 and set(after) == set(before)
    assert absorbed("again") == first  # the same batch a second time


def test_buckets_are_absorbed_in_turns_and_leave_nothing_behind(spark, tmp_path, monkeypatch):
    import os

    from posefarm.session import checkpoint_dir
    from posefarm.streaming import incremental as inc

    names = [*"ABCDEFGH", None]
    every = lambda ids, start: functools.reduce(DataFrame.unionByName, [pool(spark, ids, c=c, start=start) for c in names])
    old = every(range(20), 0).withColumn("dockq", F.when(F.col("pose_id") < 3, 0.5).otherwise(0.0)).withColumn("origin", F.lit(0))
    mined = every(range(15, 40), 100).unionByName(pool(spark, range(50), c="Z", start=100))
    kept_at, mined_at, seen = f"{tmp_path}/pool", f"{tmp_path}/mined", []
    whole = inc.absorb_round
    monkeypatch.setattr(inc, "ABSORBED", 100)
    monkeypatch.setattr(inc, "absorb_round", lambda a, b, *rest: seen.append(a.count() + b.count()) or whole(a, b, *rest))
    stored = lambda: set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))
    inc.start_pool(old, kept_at)
    mined.write.parquet(mined_at)
    before = stored()
    inc.absorb_stream(spark.readStream.schema(mined.schema).parquet(mined_at), kept_at, f"{tmp_path}/state", 30).awaitTermination()
    show = lambda df: sorted(map(str, df.select("complex_id", "pose_id", "origin").collect()))
    assert show(inc.kept_pool(spark, kept_at)) == show(whole(old, mined, 1, 30))
    assert sum(seen) == old.count() + mined.count() and len(seen) > 3
    assert stored() == before


def test_lines_are_numbered_across_splits(spark, tmp_path):
    want = {}
    for name, n in (("a.txt", 4000), ("b.txt", 3), ("c.txt", 900), ("empty.txt", 0)):
        lines = [f"{name} {k} " + "x" * (k % 37) for k in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        want |= {(name, k): x for k, x in enumerate(lines)}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        lines = so.numbered_lines(spark, str(tmp_path))
        got = {(r.file, r.line_no): r.line for r in lines.collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == want and {r.file for r in so.listed_files(spark, str(tmp_path)).collect()} == {"a.txt", "b.txt", "c.txt"}
