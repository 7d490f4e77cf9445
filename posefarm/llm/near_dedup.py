"""Near-duplicate groups by MinHash with tensored banding.

Two collections of half keys are drawn, each half key a run of minhashes.  A table is keyed
by a pair of halves, one of each collection, so 14 ** 2 tables of 6 minhashes cost only
2 * 14 * 3 of them.  Two sets meet in a table unless all halves of one collection differ:
at a similarity of 0.85 that happens to about 3 in a million pairs, at 0.80 to 9 in 100,000.

  1. Equal shingle sets form classes; only the class with its smallest doc_id goes on.
  2. A half key that a single class has cannot be part of a shared table key; only the
     halves that two classes share are paired up.
  3. In every bucket the members are checked against the bucket's smallest id, on the full
     sets, and joined into components; a bucket whose members are one component is done.
  4. In open buckets of at most SMALL members, all pairs of different components are checked,
     in larger ones the members against a drawn one.  The members of large buckets that stay
     open, which mostly share one passage, go on to exact keys:
     with shingles in order of rarity, two similar sets share one of the first
     n - ceil(percent * n / 100) + 1, and a shared passage is not among them.  Steps 3 and 4
     are repeated with these keys; what is large and open then has its pairs checked in
     blocks, so none is lost.

Cases: a null or empty text, or one of blanks alone, has an empty set and links with
nothing.  A row whose doc_id is null is linked with nothing, its component_id is null and
kept is true.  Repeated rows share their result.  Rows of one doc_id with different texts are
classes of their own.  A text of any length is sketched alone; an empty table gives an empty result.  Columns beside doc_id and text are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.llm import text
from posefarm.llm.graph import components
from posefarm.llm.store import ROW, packed, stored, unpacked

SHINGLE = 5
#: 100 * intersection >= PERCENT * union links two sets.
PERCENT = 85
#: Half keys of a collection, minhashes of a half key.
HALVES, ROWS = 14, 3
#: Members of a bucket whose pairs are looked at within the bucket, and of a block of a larger one.
SMALL, BLOCK = 32, 2048

_FACTORS = np.random.default_rng(7919).integers(0, 2**63, (2 * HALVES * ROWS, 2), dtype=np.uint64)


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of half keys, of either collection, for every set; none is empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.zeros((len(sets), 2 * HALVES), np.uint64)
    for k, (a, b) in enumerate(_FACTORS):
        least = np.minimum.reduceat((flat ^ b) * (a | np.uint64(1)), starts)
        out[:, k // ROWS] = text.mix(out[:, k // ROWS] * np.uint64(3) + least)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, print of the text, n, two fingerprints of the set (s1, s2), and the half keys."""
    width = 2 * HALVES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, at in text.slices(batch.column(1)):
                sets = text.shingle_sets(raw, at, SHINGLE)
                n = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                halves = np.zeros((len(sets), width), np.uint64)
                if full:
                    halves[n > 0] = half_keys(full)
                sums = [np.array([int(f(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                        for f in (lambda s: s, lambda s: text.mix(s * np.uint64(5)))]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                    pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * width, width, dtype=np.int32), halves.ravel().view(np.int64)),
                ], ["doc_id", "print", "n", "s1", "s2", "halves"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _print(F.col("text")).alias("print")).mapInArrow(
        run, "doc_id long, print long, n long, s1 long, s2 long, halves array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """id and the full set of shingle fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, at in text.slices(batch.column(1)):
                sets = text.shingle_sets(raw, at, SHINGLE)
                ends = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first),
                    pa.ListArray.from_arrays(ends, np.concatenate(sets).view(np.int64)),
                ], ["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "id long, shingles array<long>")


def _buckets(halves: DataFrame) -> DataFrame:
    """(id, n, c, key) of the tables that at least two members may share; c is n here.

    ``halves`` has id, n and halves.
    """
    rows = halves.select("id", "n", F.posexplode("halves").alias("h", "value")).select("id", "n", "h", F.xxhash64("h", "value").alias("half"))
    shared = rows.groupBy("half").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("half")
    # At most as many values a member as it has half keys.
    sides = rows.join(shared, "half").groupBy("id", "n").agg(
        F.collect_list(F.when(F.col("h") < HALVES, F.col("half"))).alias("left"),
        F.collect_list(F.when(F.col("h") >= HALVES, F.col("half"))).alias("right"))
    return sides.select("id", "n", F.explode("left").alias("a"), "right").select(
        "id", "n", "a", F.explode("right").alias("b")).select("id", "n", F.col("n").alias("c"), F.xxhash64("a", "b").alias("key"))


def _prefixes(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(id, n, c, key): the rarest shingles of every member, as many as similar sets cannot
    all lack, without those that no other member has.  c is the most that the set can share with one
    whose first shingle in common is the key: what is left of the set from there on, less the
    shingles that no other member has."""
    own = sets.join(members.select("id").distinct(), "id").select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("key"))
    common = own.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    lists = own.join(common, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("members", "key"))).alias("m"))
    wanted = F.expr(f"greatest(0, n - ({percent} * n + 99) div 100 + 1 - (n - size(m)))").cast("int")
    return lists.select("id", "n", F.size("m").cast("long").alias("c"), F.posexplode(F.slice("m", F.lit(1), wanted)).alias("at", "m")).select(
        "id", "n", (F.col("c") - F.col("at")).alias("c"), F.col("m.key").alias("key"))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that the full sets confirm."""
    a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(a, "u").join(b, "v").withColumn("both", both).filter(
        100 * F.col("both") >= percent * (F.size("su") + F.size("sv") - F.col("both"))).select("u", "v")


def _may_link(n: str, c: str, n2: str, c2: str, percent: int) -> str:
    """Whether sets of n and n2 shingles that share at most c and c2 can be similar enough."""
    return f"100 * least({c}, {c2}) >= {percent} * ({n} + {n2} - least({c}, {c2}))"


def _labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts.select("id", F.col("component").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))


def _small_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within buckets of at most SMALL members."""
    lists = rows.groupBy("key").agg(F.collect_list(F.struct("id", "n", "c", "part")).alias("m"))
    pairs = lists.select(F.explode(F.expr(f"""
        flatten(transform(m, x -> transform(filter(m, y -> y.id > x.id AND y.part <> x.part AND {_may_link('x.n', 'x.c', 'y.n', 'y.c', percent)}),
                                            y -> struct(y.id AS u, x.id AS v))))""")).alias("p"))
    return pairs.select("p.u", "p.v").distinct()


def _stars(rows: DataFrame, order, percent: int) -> DataFrame:
    """Every member of a bucket paired with the bucket's first member by ``order``."""
    head = F.struct(F.col("id").alias("v"), F.col("n").alias("vn"), F.col("c").alias("vc"), F.col("part").alias("vpart"))
    heads = rows.groupBy("key").agg(F.min_by(head, order).alias("head")).select("key", "head.*")
    pairs = rows.join(heads, "key").filter(f"part <> vpart AND {_may_link('n', 'c', 'vn', 'vc', percent)}")
    return pairs.select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).distinct()


def _open(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """The buckets whose members are of more than one component: id, n, key, part, size."""
    rows = _labelled(buckets, parts)
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q")
    return rows.join(keys.select("key", "size"), "key")


def link(docs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, component) of all class representatives that have a link.

    ``sketches`` has id, first and print (of a document of the class), n and halves of one row
    per class; ``docs`` the texts.
    """
    buckets = stored(_shared(_buckets(sketches)), "buckets")
    sets = stored(full_sets(_of(docs, buckets, sketches)), "sets")
    links = None
    parts = sketches.select("id", F.col("id").alias("component")).limit(0)

    def confirm(pairs: DataFrame) -> None:
        nonlocal links, parts
        more = stored(_similar(pairs, sets, percent), "links")
        if not more.isEmpty():
            links = more if links is None else links.union(more)
            parts = stored(components(links), "parts")

    by_id, drawn = F.col("id"), F.xxhash64("id", "key")
    confirm(_stars(_labelled(buckets, parts), by_id, percent))
    rows = stored(_open(buckets, parts), "open")
    small, large = F.col("size") <= SMALL, F.col("size") > SMALL
    confirm(_stars(rows.filter(large), drawn, percent).union(_small_pairs(rows.filter(small), percent)).distinct())
    rows = stored(_open(buckets, parts).filter(large), "open")
    if rows.isEmpty():
        return parts
    buckets = stored(_shared(_prefixes(sets, rows, percent)), "buckets")
    rows = _labelled(buckets, parts)
    confirm(_stars(rows, by_id, percent).union(_stars(rows, drawn, percent)).distinct())
    rows = stored(_open(buckets, parts), "open")
    confirm(_small_pairs(rows.filter(small), percent).union(_block_pairs(rows.filter(large), percent)).distinct())
    return parts


def _shared(buckets: DataFrame) -> DataFrame:
    """The rows whose key another member has too."""
    return buckets.join(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key"), "key")


def _print(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _of(docs: DataFrame, rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(doc_id, text) of the classes whose ids ``rows`` has, each once, under the class's id."""
    wanted = sketches.join(rows.select("id").distinct(), "id", "left_semi").select("id", "first", "print")
    texts = docs.select("doc_id", "text", _print(F.col("text")).alias("own_print"))
    met = texts.join(wanted, (F.col("doc_id") == F.col("first")) & (F.col("own_print") == F.col("print")))
    return met.dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), "text")


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in large buckets that may be similar, cut into
    blocks of about BLOCK members: every pair of blocks is a group of its own."""
    n = F.ceil(F.col("size") / BLOCK)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("id", "key"), n))
    others = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    a = blocks.select("key", F.col("block").alias("i"), others.alias("j"), "id", "n", "c", "part")
    b = blocks.select("key", F.col("block").alias("j"), others.alias("i"), *[F.col(x).alias(x + "2") for x in ("id", "n", "c", "part")])
    return a.join(b, ["key", "i", "j"]).filter(f"id > id2 AND part <> part2 AND {_may_link('n', 'c', 'n2', 'c2', percent)}").select(
        F.col("id").alias("u"), F.col("id2").alias("v")).distinct()


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, print (of the text), n, s1, s2, group, component_id for every row.

    A class of equal sets goes by its smallest doc_id.  Where rows of one doc_id have several
    texts, so that several classes would go by it, the others get numbers of their own below
    all ids; ``group`` is such a number, ``component_id`` the smallest doc_id of the group.
    """
    rows = stored(sketch(docs), "sketch")
    kind = ["n", "s1", "s2"]
    known = rows.filter("doc_id IS NOT NULL AND n > 0")
    classes = stored(known.groupBy(*kind).agg(F.min(F.struct("doc_id", "print")).alias("f"), F.min_by("halves", F.struct("doc_id", "print")).alias("halves")).select(
        *kind, F.col("f.doc_id").alias("first"), F.col("f.print").alias("print"), "halves"), "classes")
    twice = classes.groupBy("first").agg(F.count(F.lit(1)).alias("classes"), F.min(F.struct(*kind)).alias("own")).filter("classes > 1")
    extra = stored(classes.join(twice, "first").filter(F.struct(*kind) != F.col("own")).select(*kind), "extra")
    if extra.isEmpty():
        classes = classes.withColumn("id", F.col("first"))
    else:
        lowest = classes.agg(F.min("first")).first()[0]
        numbers = stored(extra.withColumn("own_id", F.lit(lowest - 1) - F.monotonically_increasing_id()), "numbers")
        classes = stored(classes.join(numbers, kind, "left").withColumn("id", F.coalesce("own_id", "first")).drop("own_id"), "classes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = link(texts, classes.select("id", "first", "print", "n", "halves"), percent)
    named = classes.select(*kind, "id", "first").join(parts, "id", "left").withColumn("group", F.coalesce("component", "id"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    named = named.join(least, "group").select(*kind, "group", "component_id")
    out = rows.select("doc_id", "print", *kind).join(named, kind, "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Sets are linked where 100 * intersection >= ``percent`` * union.
    """
    return _grouped(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of every group, with all its columns: one of the smallest doc_id.  Different
    texts of one doc_id are in one group only if they are linked."""
    rows = stored(_grouped(docs.select("doc_id", "text"), percent).filter("doc_id IS NOT NULL"), "groups")
    linked = rows.filter("n > 0 AND doc_id = component_id").groupBy("group").agg(F.min(F.struct("doc_id", "n", "s1", "s2", "print")).alias("f"))
    chosen = linked.select(F.col("f.doc_id").alias("__id"), F.col("f.print").alias("__print")).unionByName(
        rows.filter("n = 0").select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"))).distinct()
    whole = packed(docs, docs["doc_id"].cast("long").alias("__id"), _print(docs["text"]).alias("__print"))
    kept = whole.join(chosen, ["__id", "__print"], "left_semi").dropDuplicates(["__id", "__print"])
    return unpacked(kept, docs.columns).unionByName(docs.filter("doc_id IS NULL"))
