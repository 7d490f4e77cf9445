"""Fixed values of the scoring model, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Atom type, residue name, atom name.
ATOM_TYPES = """
1 ARG CZ, 1 ARG NE, 1 ARG NH1, 1 ARG NH2, 1 LYS CG,
2 ASN C, 2 ASN CA, 2 ASN CB, 2 ASN CG, 2 ASN N, 2 ASN ND2, 2 ASN O, 2 ASN OD1,
2 GLN CD, 2 GLN CG, 2 GLN N, 2 GLN NE2, 2 GLN OE1, 2 LYS O,
2 SER C, 2 SER CA, 2 SER CB, 2 SER N, 2 SER O, 2 SER OG,
2 THR C, 2 THR CA, 2 THR CB, 2 THR CG2, 2 THR N, 2 THR O, 2 THR OG1,
3 ARG O, 3 GLN C, 3 GLN CA, 3 GLN CB, 3 GLN O, 3 HIS C, 3 HIS CA, 3 HIS CB, 3 HIS O,
3 MET C, 3 MET CA, 3 MET N, 3 PHE C, 3 PHE CA, 3 PHE N, 3 PHE O,
3 PRO C, 3 PRO CA, 3 PRO CB, 3 PRO CD, 3 PRO CG, 3 PRO N, 3 PRO O,
3 TRP CD2, 3 TRP CG, 3 TRP O,
3 TYR C, 3 TYR CA, 3 TYR CB, 3 TYR CG, 3 TYR N, 3 TYR O,
4 ARG C, 4 ARG CA, 4 ARG CB, 4 ARG CD, 4 ARG CG, 4 ARG N,
4 HIS CD2, 4 HIS CE1, 4 HIS CG, 4 HIS N, 4 HIS ND1, 4 HIS NE2,
4 LYS C, 4 LYS CA, 4 LYS CB, 4 LYS N,
5 CYS C, 5 CYS CA, 5 CYS CB, 5 CYS N, 5 CYS O, 5 CYS SG,
5 GLY C, 5 GLY CA, 5 GLY N, 5 GLY O,
6 TRP CD1, 6 TRP CE2, 6 TRP CZ2, 6 TRP NE1,
6 TYR CD1, 6 TYR CD2, 6 TYR CE1, 6 TYR CE2, 6 TYR CZ, 6 TYR OH,
7 MET CB, 7 MET CE, 7 MET CG, 7 MET SD,
7 PHE CB, 7 PHE CD1, 7 PHE CD2, 7 PHE CE1, 7 PHE CE2, 7 PHE CG, 7 PHE CZ,
7 TRP CE3, 7 TRP CH2, 7 TRP CZ3,
8 ASP C, 8 ASP N, 8 ASP O, 8 GLU C, 8 GLU CA, 8 GLU CB, 8 GLU CG, 8 GLU N, 8 GLU O,
9 ASP CA, 9 ASP CB, 9 ASP CG, 9 ASP OD1, 9 ASP OD2, 9 GLU CD, 9 GLU OE1, 9 GLU OE2,
10 ILE CB, 10 ILE CD1, 10 ILE CG1, 10 ILE CG2,
10 LEU CB, 10 LEU CD1, 10 LEU CD2, 10 LEU CG, 10 VAL CB, 10 VAL CG1, 10 VAL CG2,
11 LYS CD, 11 LYS CE, 11 LYS NZ,
12 ALA C, 12 ALA CA, 12 ALA CB, 12 ALA N, 12 ALA O,
12 ILE C, 12 ILE CA, 12 ILE N, 12 ILE O, 12 LEU C, 12 LEU CA, 12 LEU N, 12 LEU O,
12 MET O, 12 TRP C, 12 TRP CA, 12 TRP CB, 12 TRP N,
12 VAL C, 12 VAL CA, 12 VAL N, 12 VAL O
"""

# Contact energy between the twelve atom types, in the order
# R+, polar, mc, RHK_mc, CG, WY_sc, MFW_sc, DE-, DE_mc, ILV_sc, K+, AILMV_mc.
PAIR_TABLE = (
    (0.678, 0.133, -0.007, 0.727, 0.091, -0.742, -0.625, -0.064, -0.382, -0.302, 1.221, 0.187),
    (0.133, 0.180, 0.065, 0.295, 0.057, -0.631, -0.663, 0.612, 0.342, -0.275, 0.604, 0.248),
    (-0.007, 0.065, -0.145, 0.093, -0.265, -1.078, -1.176, 0.636, 0.355, -0.552, 0.483, 0.109),
    (0.727, 0.295, 0.093, 0.696, -0.016, -0.735, -0.804, 0.525, 0.144, -0.202, 1.116, 0.477),
    (0.091, 0.057, -0.265, -0.016, -0.601, -0.928, -1.046, 0.644, 0.615, -0.573, 0.062, -0.034),
    (-0.742, -0.631, -1.078, -0.735, -0.928, -0.914, -1.696, -0.577, -0.430, -1.495, -0.303, -0.867),
    (-0.625, -0.663, -1.176, -0.804, -1.046, -1.696, -1.938, -0.214, 0.015, -1.771, 0.092, -1.040),
    (-0.064, 0.612, 0.636, 0.525, 0.644, -0.577, -0.214, 1.620, 1.233, -0.001, 0.368, 0.822),
    (-0.382, 0.342, 0.355, 0.144, 0.615, -0.430, 0.015, 1.233, 1.090, 0.050, -0.024, 0.757),
    (-0.302, -0.275, -0.552, -0.202, -0.573, -1.495, -1.771, -0.001, 0.050, -1.606, 0.253, -0.572),
    (1.221, 0.604, 0.483, 1.116, 0.062, -0.303, 0.092, 0.368, -0.024, 0.253, 1.884, 0.731),
    (0.187, 0.248, 0.109, 0.477, -0.034, -0.867, -1.040, 0.822, 0.757, -0.572, 0.731, 0.399),
)

# Partial charge of the charge types 1 to 11.
CHARGES = (1.0, -1.0, 0.5, -0.5, -0.5, 1.0, -0.1, 0.0, 0.0, -0.5, 0.5)

# Atomic contact energies of the eighteen atom classes
# N CA C O GCA CB KNZ KCD DOD RNH NND RNE SOG HNE YCZ FCZ LCD CSG.
CONTACT_ENERGIES = (
    -0.495, -0.553, -0.464, -0.079, 0.008, -0.353, 1.334, 1.046, 0.933,
    0.726, 0.693, 0.606, 0.232, 0.061, -0.289, -0.432, -0.987, -1.827,
)

# Van der Waals radius by element.
RADII = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80}

# Fixed values of the scoring and labelling rules.
REFERENCE_SPACING = 1.2
OPEN_SPACE_REACH = 3.6
PAIR_REACH = 6.0
CHARGE_REACH = 8.0
SURFACE_AREA = 1.0
CONTACT_REACH = 5.0
INTERFACE_REACH = 8.0
INTERFACE_SCALE = 1.5
LIGAND_SCALE = 8.5
TIERS = (0.23, 0.49, 0.80)
KS = (1, 5, 10, 50, 100)


def atom_type_rows() -> list[tuple[int, str, str]]:
    rows = (entry.split() for entry in ATOM_TYPES.replace("\n", " ").split(","))
    return [(int(t), res, atom) for t, res, atom in rows]


def atom_type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(atom_type_rows(), "type_id int, res_name string, atom_name string")


def radius_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RADII.items()), "element string, radius double")


def pair_table(spark: SparkSession, table=PAIR_TABLE) -> DataFrame:
    """One row per (i, j) with the energy, both 1-based."""
    rows = [(i + 1, j + 1, float(v)) for i, row in enumerate(table) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "i int, j int, energy double")
