"""Readers for structure text and pose lists.

Files are read as lines and parsed with column expressions; no file passes through the
driver, and none is held as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posefarm.functions import fixed
from posefarm.operators.features import element

XYZ = ("x", "y", "z")


def _slice(line: str, start: int, end: int) -> Column:
    """Characters start .. end-1 (0-based) without surrounding blanks."""
    return F.trim(F.substring(line, start + 1, end - start))


def file_name() -> Column:
    """File name, or the partition folders and the name for partitioned text."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"((?:[^/=]+=[^/]+/)*[^/]+)$", 1)


def complex_of(name: Column) -> Column:
    """Complex id from a folder complex_id=..., or from a name such as 1ABC_r_u.pdb.ms."""
    folder = F.regexp_extract(name, r"complex_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(name, r"^([^_.]+)", 1))


def side_of(name: Column) -> Column:
    """R or L from a folder side=..., or from the name."""
    folder = F.regexp_extract(name, r"side=([^/]+)/", 1)
    return F.when(folder != "", folder).when(name.rlike(r"_r_|-R\."), "R").when(name.rlike(r"_l_|-L\."), "L")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file name and 0-based line number.

    Files are read line by line, and a large one in several splits: lines are numbered by their
    place in the split, and the lines of the file's splits before are added.
    """
    split = ["file", "_start"]
    lines = spark.read.text(path).select(file_name().alias("file"), F.col("_metadata.file_block_start").alias("_start"),
                                         F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    blocks = lines.groupBy(*split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row for each split of a file.
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*split, (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_base"))
    return lines.join(blocks, split).select("file", (F.col("_id") - F.col("_base")).cast("int").alias("line_no"), "line")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path``; contents are not read.  Spark passes over files of no bytes."""
    return spark.read.format("binaryFile").load(path).select(file_name().alias("file"))


def _parse_ms(lines: DataFrame) -> DataFrame:
    tail = F.filter(F.split(F.substring("line", 55, 1_000_000), r"\s+"), lambda w: w != "")
    rows = lines.filter(F.col("line").rlike("^(ATOM|HETATM)")).withColumn("_tail", tail)
    n = F.size("_tail")
    # A line counts its newline towards the 54 characters it needs.
    reason = (
        F.when(F.length("line") < 54, "truncated line")
        .when(~n.isin(4, 5), F.concat(F.lit("tail of "), n, F.lit(" tokens")))
    )
    value = {
        "res_seq": _slice("line", 22, 26).try_cast("int"),
        **{c: _slice("line", 30 + 8 * i, 38 + 8 * i).try_cast("double") for i, c in enumerate(XYZ)},
        "occupancy": F.try_element_at("_tail", F.lit(1)).try_cast("int"),
        "tempfactor": F.try_element_at("_tail", F.lit(2)).try_cast("int"),
        "radius_col": F.try_element_at("_tail", F.lit(3)).try_cast("float"),
        "charge_col": F.try_element_at("_tail", F.lit(-1)).try_cast("float"),
    }
    rows = rows.withColumns(value)
    missing = F.lit(False)
    for c in value:
        missing = missing | F.col(c).isNull()
    rows = rows.withColumn("reason", F.coalesce(reason, F.when(missing, "unreadable number")))
    return rows.withColumns({
        "atom_name": _slice("line", 12, 16), "res_name": _slice("line", 17, 20), "chain": _slice("line", 21, 22),
        "ace_type": F.when(n == 5, F.try_element_at("_tail", F.lit(4))),
    })


MS_COLUMNS = ["file", "complex_id", "side", "atom_idx", "atom_name", "res_name", "chain", "res_seq", "x", "y", "z",
              "occupancy", "tempfactor", "radius_col", "ace_type", "charge_col"]


def _atom_index(rows: DataFrame) -> DataFrame:
    """Position among the atoms of the file, which is one molecule."""
    w = Window.partitionBy("file").orderBy("line_no")
    return rows.withColumn("atom_idx", F.row_number().over(w) - 1)


def read_atoms_ms(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Atoms from structure text with tail columns.

    Strict mode ends the job on a bad line or a file without atoms; otherwise bad
    lines are left out (see :func:`rejected_lines`).
    """
    lines = numbered_lines(spark, path)
    rows = _parse_ms(lines)
    if strict:
        text = F.concat(F.col("file"), F.lit(":"), F.col("line_no") + 1, F.lit(": "), F.col("reason"))
        rows = rows.withColumn("res_seq", F.when(F.col("reason").isNotNull(), F.raise_error(text).cast("int")).otherwise(F.col("res_seq")))
    else:
        rows = rows.filter(F.col("reason").isNull())
    out = _atom_index(rows.withColumns({"complex_id": complex_of(F.col("file")), "side": side_of(F.col("file"))})).select(*MS_COLUMNS)
    return _fail_on_empty(listed_files(spark, path), out) if strict else out


def _fail_on_empty(files: DataFrame, atoms: DataFrame) -> DataFrame:
    """The atoms; a file without any fails the job."""
    empty = files.join(atoms.select("file").distinct(), "file", "left_anti")
    text = F.concat(F.col("file"), F.lit(": no atom records"))
    # No row passes the filter; over an aggregate it is not asked before the join has been.
    none = empty.agg(F.min("file").alias("file")).filter(F.when(F.col("file").isNotNull(), F.raise_error(text).cast("string")).isNotNull())
    return atoms.unionByName(none.select("file", *[F.lit(None).cast(f.dataType).alias(f.name) for f in atoms.schema.fields if f.name != "file"]))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines the lenient reader leaves out, with the reason, and files without atoms."""
    lines = numbered_lines(spark, path)
    rows = _parse_ms(lines)
    bad = rows.filter(F.col("reason").isNotNull()).select("file", "line_no", "reason")
    empty = listed_files(spark, path).join(rows.select("file").distinct(), "file", "left_anti").select(
        "file", F.lit(None).cast("int").alias("line_no"), F.lit("no atom records").alias("reason"))
    return bad.unionByName(empty)


def _plain_lines(spark: SparkSession, path: str, chains: str | None) -> DataFrame:
    lines = numbered_lines(spark, path)
    end = lines.filter(F.col("line").startswith("ENDMDL")).groupBy("file").agg(F.min("line_no").alias("_end"))
    rows = lines.join(end, "file", "left").filter(
        (F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))) & F.col("line").startswith("ATOM")).drop("_end")
    rows = rows.withColumns({
        "alt": F.substring("line", 17, 1), "chain": F.substring("line", 22, 1), "atom_name": _slice("line", 12, 16),
        "res_name": _slice("line", 17, 20), "res_seq": _slice("line", 22, 26).try_cast("int"),
        **{c: _slice("line", 30 + 8 * i, 38 + 8 * i).try_cast("double") for i, c in enumerate(XYZ)},
    })
    other_place = ~F.col("alt").isin(" ", "A")
    if chains is not None:
        # Alternate places are counted before the chain filter applies.
        rows = rows.filter(other_place | F.col("chain").isin(*chains))
    rules = fixed.atom_type_table(spark).select("res_name", F.col("atom_name").alias("_name"), F.lit(True).alias("_known"))
    rows = rows.withColumn("_name", F.when(F.col("atom_name") == "OXT", "O").otherwise(F.col("atom_name")))
    rows = rows.join(F.broadcast(rules), ["res_name", "_name"], "left")
    unknown = F.col("_known").isNull() | ~element(F.col("atom_name")).isin(*fixed.RADII)
    return rows.withColumn("reason", F.when(other_place, "alternate place").when(unknown, "unknown atom"))


def read_atoms_pdb(spark: SparkSession, path: str, chains: str | None = None, strict: bool = True) -> DataFrame:
    """Heavy protein atoms of the first model of plain structure files."""
    rows = _plain_lines(spark, path, chains).filter(F.col("reason").isNull())
    rows = rows.withColumns({"complex_id": complex_of(F.col("file")), "side": side_of(F.col("file"))})
    out = _atom_index(rows).select("file", "complex_id", "side", "atom_idx", "atom_name", "res_name", F.trim("chain").alias("chain"),
                                   "res_seq", *XYZ)
    return _fail_on_empty(listed_files(spark, path), out) if strict else out


def dropped_atoms(spark: SparkSession, path: str, chains: str | None = None) -> DataFrame:
    """Number of atoms the plain reader drops, by file and reason."""
    rows = _plain_lines(spark, path, chains).filter(F.col("reason").isNotNull())
    return rows.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))


def read_pose_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, poses) of pose list files.

    Lines 1 to 4 are size and spacing, initial angles, receptor centre and ligand
    centre; every further line is one pose of seven fields.
    """
    lines = numbered_lines(spark, path).withColumn("line", F.trim("line")).filter(
        (F.col("line") != "") | (F.col("line_no") < 4))
    words = lines.select("file", "line_no", F.split("line", r"\s+").alias("w"))
    bad = F.concat(F.col("file"), F.lit(":"), F.col("line_no") + 1, F.lit(": malformed line"))
    want = F.when(F.col("line_no") == 0, 2).when(F.col("line_no") == 1, 3).when(F.col("line_no") < 4, 4).otherwise(7)
    switched = F.concat(F.col("file"), F.lit(": switched-ligand files are not supported"))
    checked = words.withColumn(
        "w", F.when((F.col("line_no") == 0) & (F.size("w") == 3), F.raise_error(switched).cast("array<string>"))
        .when(F.size("w") != want, F.raise_error(bad).cast("array<string>")).otherwise(F.col("w")))
    name = complex_of(F.col("file"))

    def at(line: int, i: int, kind: str) -> Column:
        return F.max(F.when(F.col("line_no") == line, F.col("w")[i])).cast(kind)

    headers = checked.filter(F.col("line_no") < 4).groupBy("file").agg(
        at(0, 0, "int").alias("cells"), at(0, 1, "double").alias("spacing"),
        *[at(1, i, "double").alias(f"init{i + 1}") for i in range(3)],
        at(2, 0, "string").alias("rec_file"), *[at(2, i + 1, "double").alias(f"rc_{a}") for i, a in enumerate(XYZ)],
        at(3, 0, "string").alias("lig_file"), *[at(3, i + 1, "double").alias(f"lc_{a}") for i, a in enumerate(XYZ)],
    ).withColumn("complex_id", name)
    poses = checked.filter(F.col("line_no") >= 4).select(
        name.alias("complex_id"), (F.col("line_no") - 4).alias("pose_id"),
        *[F.col("w")[i].cast("double").alias(f"a{i + 1}") for i in range(3)],
        *[F.col("w")[3 + i].cast("int").alias(f"t{i + 1}") for i in range(3)], F.col("w")[6].cast("double").alias("raw_score"))
    return headers, poses
