"""Structure texts: parsing and validation; geometry is in `neighbours`.

Symmetry finding, cell reduction and energies need libraries or models that are not part of this package;
`scored` takes them as functions of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelode.functions.expressions import char_ratio
from tidelode.operators.neighbours import CELL

_SITE = T.StructType([T.StructField("el", T.StringType()), *(T.StructField(k, T.DoubleType()) for k in "xyz")])
STRUCTURE = T.StructType([*(T.StructField(k, T.DoubleType()) for k in ("a", "b", "c", "alpha", "beta", "gamma")), T.StructField("spacegroup", T.StringType()), T.StructField("sites", T.ArrayType(_SITE))])
#: Sites that a valid structure has at least and at most, and the share of one character that is garbage.
LEAST_SITES, MOST_SITES, MOST_REPEATED = 2, 300, 0.5

#: Atomic masses of the elements up to lead, in order of atomic number: fixed values.
_ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba "
    "La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb"
).split()
_MASSES = (
    1.008, 4.0026, 6.94, 9.0122, 10.81, 12.011, 14.007, 15.999, 18.998, 20.180, 22.990, 24.305, 26.982, 28.085, 30.974, 32.06, 35.45, 39.948, 39.098, 40.078, 44.956, 47.867, 50.942, 51.996, 54.938,
    55.845, 58.933, 58.693, 63.546, 65.38, 69.723, 72.630, 74.922, 78.971, 79.904, 83.798, 85.468, 87.62, 88.906, 91.224, 92.906, 95.95, 98.0, 101.07, 102.91, 106.42, 107.87, 112.41, 114.82, 118.71,
    121.76, 127.60, 126.90, 131.29, 132.91, 137.33, 138.91, 140.12, 140.91, 144.24, 145.0, 150.36, 151.96, 157.25, 158.93, 162.50, 164.93, 167.26, 168.93, 173.05, 174.97, 178.49, 180.95, 183.84,
    186.21, 190.23, 192.22, 195.08, 196.97, 200.59, 204.38, 207.2,
)
MASS = dict(zip(_ELEMENTS, _MASSES, strict=True))


def _number(text: str) -> float | None:
    """A number with an optional uncertainty in parentheses."""
    try:
        return float(re.sub(r"\([^)]*\)", "", text))
    except ValueError:
        return None


def parse(text: str | None) -> dict | None:
    """The cell, declared space group and sites of a structure text; None if they cannot be read."""
    lines = (text or "").splitlines()
    tags, sites, k = {}, [], 0
    while k < len(lines):
        line = lines[k].strip()
        k += 1
        if line.lower() == "loop_":
            heads = []
            while k < len(lines) and lines[k].strip().startswith("_"):
                heads.append(lines[k].strip().lower())
                k += 1
            want = ["_atom_site_fract_x", "_atom_site_fract_y", "_atom_site_fract_z"]
            own = all(w in heads for w in want)
            label = next((heads.index(h) for h in ("_atom_site_type_symbol", "_atom_site_label") if h in heads), None)
            while k < len(lines) and lines[k].strip() and not lines[k].strip().startswith(("_", "loop_", "data_", "#")):
                cells = lines[k].split()
                k += 1
                if own and label is not None and len(cells) >= len(heads):
                    xyz = [_number(cells[heads.index(w)]) for w in want]
                    element = re.match(r"[A-Z][a-z]?", cells[label])
                    if None in xyz or not element:
                        return None
                    sites.append({"el": element.group(), **dict(zip("xyz", xyz, strict=True))})
        elif line.startswith("_"):
            name, _, value = line.partition(" ")
            tags.setdefault(name.lower(), value.strip().strip("'\""))
    cell = [_number(tags.get(f"_cell_{n}", "")) for n in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")]
    if None in cell or not sites:
        return None
    return dict(zip(("a", "b", "c", "alpha", "beta", "gamma"), cell, strict=True)) | {"spacegroup": tags.get("_symmetry_space_group_name_h-m"), "sites": sites}


@F.pandas_udf(STRUCTURE)
def parsed(texts: pd.Series) -> pd.DataFrame:
    """A column of structure texts as structures; rows that cannot be read are null in every field."""
    names = ("a", "b", "c", "alpha", "beta", "gamma", "spacegroup", "sites")
    found = {t: parse(t) or dict.fromkeys(names) for t in set(texts)}  # equal texts of a batch are parsed once
    rows = [found[t] for t in texts]
    return pd.DataFrame(rows, columns=list(names))


def invalid_reason(text: Column, structure: Column) -> Column:
    """Why a text is no valid structure, null if it is one; the first of the rules that fails."""
    s = structure
    lengths, angles = [s.a, s.b, s.c], [s.alpha, s.beta, s.gamma]
    bad = lambda cs, test: F.greatest(*[test(c).cast("int") for c in cs]) == 1
    odd = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    sites = F.size(s.sites)
    return (
        F.when(~F.lower(F.coalesce(text, F.lit(""))).contains("data_"), "no_data_block")
        .when(s.sites.isNull(), "parse_error")
        .when((sites < LEAST_SITES) | (sites > MOST_SITES), F.concat(F.lit("n_sites_out_of_range_"), sites.cast("string")))
        .when(bad(lengths, lambda c: c <= 0), "negative_lattice_length")
        .when(bad(angles, lambda c: (c <= 0) | (c >= 180)), "invalid_lattice_angle")
        .when(F.exists(s.sites, lambda p: odd(p.x) | odd(p.y) | odd(p.z)), "non_finite_coords")
        .when(char_ratio(text) > MOST_REPEATED, "high_repetition")
    )


def wrapped(structure: Column) -> Column:
    """A structure with its coordinates in [0, 1)."""
    return structure.withField("sites", F.transform(structure.sites, lambda p: F.struct(p.el.alias("el"), F.pmod(p.x, F.lit(1.0)).alias("x"), F.pmod(p.y, F.lit(1.0)).alias("y"), F.pmod(p.z, F.lit(1.0)).alias("z"))))


def volume(s: Column) -> Column:
    """The volume of a cell by its lengths and angles."""
    ca, cb, cg = (F.cos(F.radians(x)) for x in (s.alpha, s.beta, s.gamma))
    return s.a * s.b * s.c * F.sqrt(F.greatest(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg, F.lit(0.0)))


def density(s: Column) -> Column:
    """Grams per cubic centimetre, null with an element of unknown mass."""
    masses = F.create_map(*[F.lit(x) for p in MASS.items() for x in p])
    total = F.aggregate(s.sites, F.lit(0.0), lambda t, p: t + F.try_element_at(masses, p.el))
    return total * 1.66053906660 / volume(s)


def n_elements(s: Column) -> Column:
    return F.size(F.array_distinct(F.transform(s.sites, lambda p: p.el)))


def exploded_sites(rows: DataFrame, keys: list[str], structure: str) -> DataFrame:
    """A row for each site of structures with as many sites as valid ones have: keys, the cell, site, x, y, z."""
    s = F.col(structure)
    valid = rows.where(F.size(s.sites).between(LEAST_SITES, MOST_SITES))
    sites = valid.select(*keys, *[s[c].alias(c) for c in CELL], F.posexplode(s.sites).alias("site", "p"))
    return sites.select(*keys, *CELL, "site", "p.x", "p.y", "p.z")


def scored(df: DataFrame, score: Callable[[pd.DataFrame], pd.Series], name: str = "score_e_per_atom") -> DataFrame:
    """df with a score from a function of a batch, and error_type and error where it fails for a row.

    The function is the seam for energy models: a batch goes to it whole, and row by row if that fails.
    """
    schema = df.select("*", F.lit(0.0).alias(name), F.lit("").alias("error_type"), F.lit("").alias("error")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield batch.assign(**{name: score(batch), "error_type": None, "error": None})
            except Exception:  # noqa: BLE001  the failing rows are found one by one
                rows = []
                for k in range(len(batch)):
                    one = batch.iloc[k : k + 1]
                    try:
                        rows.append(one.assign(**{name: score(one), "error_type": None, "error": None}))
                    except Exception as e:  # noqa: BLE001
                        rows.append(one.assign(**{name: None, "error_type": type(e).__name__, "error": str(e)[:500]}))
                yield pd.concat(rows)

    for f in schema:
        f.nullable = True
    return df.mapInPandas(run, schema)
