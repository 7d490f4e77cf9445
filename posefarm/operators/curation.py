"""Corpus curation: representatives, splits, leakage checks, geometry filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions.columns import apply_matrix, mix, mix2, rotation_matrix
from posefarm.functions.ordering import with_one, with_order
from posefarm.operators.spatial import radius_join


def cluster_representatives(index: DataFrame) -> DataFrame:
    """Smallest usable training id per cluster that no test row shares.

    ``index``: id, cluster, split, chain_r, chain_l, holo_r, holo_l.
    """
    bad = (F.col("chain_r") == "UNDEFINED") | (F.col("chain_l") == "UNDEFINED") | F.col("id").cast("string").contains("UNDEFINED")
    train = index.filter((F.col("split") == "train") & F.col("holo_r") & F.col("holo_l") & ~bad)
    test = index.filter(F.col("split") == "test").select("cluster").distinct()
    return train.join(test, "cluster", "left_anti").groupBy("cluster").agg(F.min("id").alias("id"))


def apo_subset(index: DataFrame) -> DataFrame:
    """Test systems with both unbound structures."""
    return index.filter((F.col("split") == "test") & F.col("apo_r") & F.col("apo_l"))


def master_order(reps: DataFrame, seed: int, n: int, pinned: DataFrame | None = None) -> DataFrame:
    """First n clusters in a seeded order with a 0-based rank; pinned clusters lead.

    ``pinned`` has (cluster, place).  The order is a keyed hash, so it does not
    depend on how rows are spread.
    """
    key = F.xxhash64("cluster")
    rows = reps.withColumn("_key", key).withColumn("_place", mix(F.col("_key"), seed).cast("double"))
    return _place_pinned(rows, pinned, n)


def _place_pinned(rows: DataFrame, pinned: DataFrame | None, n: int) -> DataFrame:
    if pinned is not None:
        lead = pinned.select("cluster", (F.col("place") - 1e15).alias("_lead"))
        rows = rows.join(lead, "cluster", "left").withColumn("_place", F.coalesce("_lead", "_place"))
        rows = rows.drop("_lead")
    ordered = with_order(rows, [], "_place", "_key", rank="rank").filter(F.col("rank") <= n)
    return ordered.withColumn("rank", F.col("rank") - 1).drop("_place", "_key")


def seeded_order(rows: DataFrame, key: str, seed: int, n: int, pinned: DataFrame | None = None) -> DataFrame:
    """As :func:`master_order` for clusters that carry a numeric key."""
    rows = rows.withColumn("_key", F.col(key).cast("long")).withColumn("_place", mix(F.col(key), seed).cast("double"))
    return _place_pinned(rows, pinned, n)


def nested_split(order: DataFrame, n_fit: int, val_frac: float = 0.2, require_all: bool = True) -> DataFrame:
    """First round(n_fit / (1 - f)) eligible rows by rank; every round(1/f)-th is validation.

    Both rules depend on the prefix only, so a larger split contains a smaller one.
    """
    stride = round(1.0 / val_frac)
    total = round(n_fit / (1.0 - val_frac))
    placed = with_order(order, [], "rank", rank="_pos").filter(F.col("_pos") <= total)
    part = F.when(F.pmod(F.col("_pos") - 1, F.lit(stride)) == 0, "validation").otherwise("fit")
    out = placed.withColumn("part", part)
    if require_all:
        have = order.agg(F.count(F.lit(1)).alias("_have"))
        short = F.concat(F.lit(f"need {total} usable ids, have "), F.col("_have"))
        out = with_one(out, have).withColumn(
            "part", F.when(F.col("_have") < total, F.raise_error(short).cast("string")).otherwise(F.col("part")))
        out = out.drop("_have")
    return out.withColumn("position", F.col("_pos") - 1).drop("_pos")


def eligible(order: DataFrame, manifest: DataFrame, volumes: DataFrame | None = None, max_voxels: int = 0,
             spacing: float | None = None, excluded: DataFrame | None = None,
             same_partner: bool = True) -> DataFrame:
    """Rows that are prepared, not excluded, not a pair of one partner, and small enough.

    Fails closed: a prepared id without a volume, or a volume taken at another
    spacing, ends the job.
    """
    out = order.join(manifest.select("id", "status"), "id").filter(F.col("status") == "ok").drop("status")
    if excluded is not None:
        out = out.join(excluded.select("id"), "id", "left_anti")
    if same_partner:
        out = out.filter(~is_same_partner(F.col("name") if "name" in order.columns else F.col("id")))
    if max_voxels:
        if volumes is None:
            raise ValueError("a size cap needs the volume table")
        v = volumes.select("id", F.col("voxels").alias("_v"), F.col("spacing").alias("_h"))
        no_volume = F.concat(F.lit("no volume recorded for "), F.col("id").cast("string"))
        other = F.lit(f"volumes were not computed at spacing {spacing}")
        checked = (
            F.when(F.col("_v").isNull(), F.raise_error(no_volume).cast("boolean"))
            .when(F.col("_h").isNull() | (F.abs(F.col("_h") - F.lit(float(spacing))) > 1e-9), F.raise_error(other).cast("boolean"))
            .otherwise(F.col("_v") <= max_voxels)
        )
        out = out.join(v, "id", "left").filter(checked).drop("_v", "_h")
    return out


def is_same_partner(name: Column) -> Column:
    """The last field of the two halves of an id is equal; false without exactly two halves."""
    halves = F.split(name, "--")
    last = [F.element_at(F.split(halves[i], "_"), -1) for i in (0, 1)]
    return F.when(F.size(halves) == 2, last[0] == last[1]).otherwise(F.lit(False))


def check_splits(splits: DataFrame, test: DataFrame) -> DataFrame:
    """Violations of split rules, one row per rule with its count.

    ``splits``: seed, n, id, part.  Rules: an id on both sides, a test id used, a
    smaller split not inside the next one, seeds that disagree.
    """
    both = splits.groupBy("seed", "n", "id").agg(F.count_if(F.col("part") == "fit").alias("f"),
                                                 F.count_if(F.col("part") == "validation").alias("v"))
    both = both.agg(F.count_if((F.col("f") > 0) & (F.col("v") > 0)).alias("bad")).withColumn("rule", F.lit("overlap"))
    leak = splits.join(test.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("bad")).withColumn("rule", F.lit("test_id"))
    # The rows of each n must reappear, on the same side, in the next larger n.
    from pyspark.sql import Window
    sizes = splits.select("n").distinct()
    following = sizes.withColumn("next", F.lead("n").over(Window.orderBy("n"))).filter(F.col("next").isNotNull())
    need = splits.join(following, "n").select("seed", F.col("next").alias("n"), "id", "part")
    nested = need.join(splits, ["seed", "n", "id", "part"], "left_anti").agg(F.count(F.lit(1)).alias("bad")).withColumn("rule", F.lit("nested"))
    seeds = splits.agg(F.count_distinct("seed").alias("_s"))
    per = splits.groupBy("n", "id", "part").agg(F.count_distinct("seed").alias("s"))
    agree = with_one(per, seeds).agg(F.count_if(F.col("s") != F.col("_s")).alias("bad")).withColumn("rule", F.lit("seeds"))
    return both.unionByName(leak).unionByName(nested).unionByName(agree).select("rule", "bad")


def require_clean(violations: DataFrame) -> DataFrame:
    """The same table, but any violation ends the job."""
    text = F.concat(F.lit("split rule broken: "), F.col("rule"))
    return violations.withColumn("bad", F.when(F.col("bad") > 0, F.raise_error(text).cast("long")).otherwise(F.col("bad")))


def leakage_report(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared values and training rows they touch, for each key."""
    out = None
    for key in keys:
        seen = test.select(key).filter(F.col(key).isNotNull()).distinct()
        rows = train.join(seen, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.count(F.lit(1)).alias("shared"), F.coalesce(F.sum("_n"), F.lit(0)).alias("train_rows")).withColumn("key", F.lit(key))
        out = rows if out is None else out.unionByName(rows)
    return out.select("key", "shared", "train_rows")


def _native_side(atoms: DataFrame, side: str) -> DataFrame:
    return atoms.filter(F.col("side") == side).select("complex_id", "atom_idx", *[F.col(f"n{c}").alias(c) for c in "xyz"])


def geometry_audit(atoms: DataFrame, complexes: DataFrame) -> DataFrame:
    """Per complex: closest contact, pairs below 2, share of receptor atoms within 4.5,
    native reconstruction error, ligand centroid offset, and whether any rule is broken."""
    pairs = radius_join(_native_side(atoms, "R"), _native_side(atoms, "L"), 4.5)
    touch = pairs.groupBy("complex_id").agg(F.min("d").alias("closest"), F.count_if(F.col("d") < 2.0).alias("below_2"))
    engulfed = pairs.select("complex_id", "a_atom_idx").distinct().groupBy("complex_id").agg(F.count(F.lit(1)).alias("_touched"))
    n_rec = atoms.filter(F.col("side") == "R").groupBy("complex_id").agg(F.count(F.lit(1)).alias("_n"))
    lig = atoms.filter(F.col("side") == "L").join(complexes.select("complex_id", "q1", "q2", "q3", "q4", "tx", "ty", "tz"), "complex_id")
    moved = apply_matrix(rotation_matrix([F.col(f"q{i}") for i in range(1, 5)]), [F.col(c) for c in "xyz"])
    miss = F.greatest(*[F.abs(m + F.col(f"t{c}") - F.col(f"n{c}")) for m, c in zip(moved, "xyz")])
    frame = lig.groupBy("complex_id").agg(
        F.max(miss).alias("native_error"),
        F.sqrt(F.avg("x") * F.avg("x") + F.avg("y") * F.avg("y") + F.avg("z") * F.avg("z")).alias("centroid_offset"))
    out = n_rec.join(frame, "complex_id").join(touch, "complex_id", "left").join(engulfed, "complex_id", "left")
    share = F.coalesce("_touched", F.lit(0)) / F.col("_n")
    out = out.select("complex_id", "closest", F.coalesce("below_2", F.lit(0)).alias("below_2"), share.alias("engulfed"),
                     "native_error", "centroid_offset")
    broken = (F.coalesce("closest", F.lit(9.0)) < 2.0) | (F.col("engulfed") > 0.9) | (F.col("native_error") > 1e-2) | (F.col("centroid_offset") > 10.0)
    return out.withColumn("violation", broken)


def frame_collapse_filter(atoms: DataFrame, floor: float = 2.0, max_share: float = 0.05) -> DataFrame:
    """Share of ligand atoms with a receptor atom below the floor, and whether the complex stays."""
    pairs = radius_join(_native_side(atoms, "R"), _native_side(atoms, "L"), floor)
    buried = pairs.select("complex_id", "b_atom_idx").distinct().groupBy("complex_id").agg(F.count(F.lit(1)).alias("_buried"))
    n = atoms.filter(F.col("side") == "L").groupBy("complex_id").agg(F.count(F.lit(1)).alias("_n"))
    share = F.coalesce("_buried", F.lit(0)) / F.col("_n")
    return n.join(buried, "complex_id", "left").select("complex_id", share.alias("share"), (share <= max_share).alias("keep"))


def cluster_folds(rows: DataFrame, k: int, seed: int, cluster: str = "cluster") -> DataFrame:
    """Whole clusters dealt to k folds in a seeded order."""
    key = rows.schema[cluster].dataType.typeName()
    numeric = F.col(cluster).cast("long") if key in ("long", "integer", "short") else F.xxhash64(cluster)
    ids = rows.select(cluster).distinct().withColumn("_key", numeric).withColumn("_place", mix(F.col("_key"), seed).cast("double"))
    dealt = with_order(ids, [], "_place", "_key", rank="_r").select(cluster, F.pmod(F.col("_r") - 1, F.lit(k)).alias("fold"))
    return rows.join(dealt, cluster)


def random_pose_split(pool: DataFrame, frac: float, seed: int) -> DataFrame:
    """Per complex int(n * frac) poses, in a hashed order, for training; the rest for validation."""
    n = pool.groupBy("complex_id").agg(F.floor(F.count(F.lit(1)) * F.lit(float(frac))).alias("_take"))
    key = pool.schema["complex_id"].dataType.typeName()
    complex_key = F.col("complex_id").cast("long") if key in ("long", "integer", "short") else F.xxhash64("complex_id")
    placed = with_order(pool.withColumn("_h", mix2(complex_key, F.col("pose_id"), seed)), "complex_id", "_h", "pose_id", rank="_r")
    part = F.when(F.col("_r") <= F.col("_take"), "train").otherwise("validation")
    return placed.join(n, "complex_id").withColumn("part", part).drop("_h", "_r", "_take")
