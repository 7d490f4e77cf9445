"""Sinks: structure text of the top poses, metric tables and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posefarm.functions.ordering import top_k
from posefarm.operators.rotations import rotate_poses

C = "complex_id"


def atom_line(serial: Column, chain: Column) -> Column:
    """Fixed-width atom record."""
    name = F.when(F.length("atom_name") < 4, F.rpad(F.concat(F.lit(" "), F.col("atom_name")), 4, " ")).otherwise(F.col("atom_name"))
    return F.format_string("ATOM  %5d %4s %3s %1s%4d    %8.3f%8.3f%8.3f", serial.cast("int"), name, F.col("res_name"), chain,
                           F.col("res_seq").cast("int"), F.col("x"), F.col("y"), F.col("z"))


def ms_line(serial: Column, chain: Column) -> Column:
    """Atom record with tail columns (the type tag only where it is present)."""
    tag = F.when(F.col("ace_type").isNull(), "").otherwise(F.concat(F.lpad("ace_type", 7, " "), F.lit(" ")))
    tail = F.format_string("%3d %5d %4.2f %s%5.2f", F.col("occupancy"), F.col("tempfactor"), F.col("radius_col"), tag, F.col("charge_col"))
    return F.concat(atom_line(serial, chain), tail)


def top_k_lines(poses: DataFrame, atoms: DataFrame, k: int, score: str = "score", tolerance: float = 1e-2) -> DataFrame:
    """Text lines of the top k poses: (complex_id, rank, line_no, line), receptor before ligand.

    Ends the job when a complex has fewer than k poses, when a pose loses atoms, or
    when receptor coordinates drift from their native place beyond the tolerance
    after the common shift is taken out.
    """
    best = top_k(poses, C, [F.col(score).desc(), F.col("pose_id")], k)
    few = F.concat(F.lit("fewer than k poses for complex "), F.col(C).cast("string"))
    lost = F.concat(F.lit("atom count differs for complex "), F.col(C).cast("string"))
    off = F.concat(F.lit("receptor moved in complex "), F.col(C).cast("string"))
    # At most k rows of a complex meet in this window, in the order top_k left them in.
    best = best.withColumn("_have", F.count(F.lit(1)).over(Window.partitionBy(C))).join(_sides(atoms), C)
    best = best.withColumn("rank", F.when(F.col("_have") < k, F.raise_error(few).cast("int"))
                           .when(F.col("_placed") != F.col("_atoms"), F.raise_error(lost).cast("int"))
                           .when(F.coalesce("_drift", F.lit(0.0)) > tolerance, F.raise_error(off).cast("int")).otherwise(F.col("rank")))
    # Every atom meets its poses once; the receptor's stay where they are.
    both = rotate_poses(atoms.select("*", *[F.col(a).alias(f"_{a}") for a in "xyz"]), best, keep=["rank", "_nrec"])
    receptor = F.col("side") == "R"
    both = both.withColumns({a: F.when(receptor, F.col(f"_{a}")).otherwise(F.col(a)) for a in "xyz"})
    serial = F.col("atom_idx") + F.when(F.col("side") == "L", F.col("_nrec")).otherwise(0) + 1
    chain = F.when(receptor, "R").otherwise("L")
    return both.select(C, "rank", serial.alias("line_no"), atom_line(serial, chain).alias("line"))


def _sides(atoms: DataFrame) -> DataFrame:
    """Per complex: atoms, those of a known side, receptor atoms, and how far any of these is
    from its native place beyond the common shift, which follows from the ends of the shifts."""
    receptor = F.col("side") == "R"
    drift = F.lit(0.0)
    if "nx" in atoms.columns:
        shifts = [F.when(receptor, F.col(f"n{a}") - F.col(a)) for a in "xyz"]
        drift = F.greatest(*[gap for s in shifts for gap in (F.max(s) - F.avg(s), F.avg(s) - F.min(s))])
    return atoms.groupBy(C).agg(F.count(F.lit(1)).alias("_atoms"), F.count_if(receptor | (F.col("side") == "L")).alias("_placed"),
                                F.count_if(receptor).alias("_nrec"), drift.alias("_drift"))


def export_top_k(poses: DataFrame, atoms: DataFrame, k: int, path: str, score: str = "score") -> None:
    """Write the lines as text, one folder per (complex, rank)."""
    lines = top_k_lines(poses, atoms, k, score)
    lines.repartition(C, "rank").sortWithinPartitions(C, "rank", "line_no").select(C, "rank", "line").write.mode(
        "overwrite").partitionBy(C, "rank").text(path)


def write_metrics(metrics: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-complex rows as CSV and the summary as JSON."""
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/per_complex")
    summary.write.mode("overwrite").json(f"{path}/summary")
