"""Protein features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT
from .constants import CODONS, HELIX, PROPERTIES, RESIDUES, SHEET, TURN
from .dna import literal_map, places


def search_window(allele: Column, flank_1: Column, flank_2: Column, buffer: int = DEFAULT.protein_buffer) -> Column:
    """The window that is searched for proteins: the left flank without its first bases, as the definition has it."""
    return F.concat(F.substr(flank_1, F.lit(buffer + 1)), allele, F.left(flank_2, F.lit(buffer)))


def frame_0(s: Column) -> Column:
    """Residues of the first frame up to the first stop after a residue; X for codons with other symbols."""
    codons = F.transform(places(F.floor(F.length(s) / 3)), lambda i: F.substr(s, 3 * i - 2, F.lit(3)))
    read = F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(literal_map(CODONS), c), F.lit("X"))), "")
    return F.regexp_extract(F.regexp_replace(read, "^_+", ""), "^[^_]*", 0)


def property_sum(protein: Column, name: str) -> Column:
    """Sum of a residue property; unknown residues count nothing."""
    values = literal_map({r: float(v) for r, v in zip(RESIDUES, PROPERTIES[name])})
    return F.aggregate(places(F.length(protein)), F.lit(0.0), lambda a, i: a + F.coalesce(F.try_element_at(values, F.substr(protein, i, F.lit(1))), F.lit(0.0)))


def residues_property_sum(residues: Column, name: str) -> Column:
    """The same over places that may hold several residues: a place counts its residues' mean."""
    values = literal_map({r: float(v) for r, v in zip(RESIDUES, PROPERTIES[name])})
    value = lambda r: F.coalesce(F.try_element_at(values, r), F.lit(0.0))
    return F.aggregate(residues, F.lit(0.0), lambda a, p: a + F.aggregate(p, F.lit(0.0), lambda b, r: b + value(r)) / F.greatest(F.size(p), F.lit(1)))


def share(protein: Column, residues: str) -> Column:
    """Share of the protein's residues that are among the given ones; 0 for an empty protein."""
    n = F.length(protein)
    return F.when(n > 0, (n - F.length(F.translate(protein, residues, ""))) / n).otherwise(0.0)


def aliphatic_index(protein: Column) -> Column:
    return 100 * (share(protein, "A") + 2.9 * share(protein, "V") + 3.9 * share(protein, "IL"))


def structure_propensity(protein: Column) -> Column:
    return share(protein, HELIX) + share(protein, TURN) + share(protein, SHEET)


def prolines(protein: Column) -> Column:
    return F.length(protein) - F.length(F.translate(protein, "P", ""))


def kozak_score(s: Column, start: Column) -> Column:
    """Context of a start codon at a place from 0; see operators.orf.kozak."""
    near = F.when(F.substr(s, start - 2, F.lit(1)).isin("A", "G"), 3).otherwise(0) + F.when(F.substr(s, start + 5, F.lit(1)) == "G", 2).otherwise(0)
    return F.when((start < 3) | (start + 6 >= F.length(s)), 0).otherwise(near)


def over(top: Column, bottom: Column) -> Column:
    """A quotient; 0 where the divisor is 0."""
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def interactions(f: dict[str, Column], ref_length: Column) -> dict[str, Column]:
    """Features made of the others; quotients by an empty protein's length are 0."""
    charge, iso, hydro, weight = (f[k] for k in ("Net_charge_delta", "Isoelectric_delta", "Hydrophobicity_delta", "Molecular_weight_delta"))
    structure = f["Secondary_struct_propensity"]
    return {
        "FI_charge_composite": charge * iso,
        "FI_fold_composite": f["Aliphatic_delta"] * hydro,
        "FI_Relative_weight": over(weight, ref_length),
        "FI_Stability_composite": charge * hydro,
        "FI_Charge_Hydro": charge * hydro,
        "FI_Weight_life": f["Half_life_delta"] * weight,
        "FI_Iso_Hydro": iso * hydro,
        "relative_local": over(f["AA_Local_score"], ref_length),
        "FI_relative_global": over(f["AA_Global_score"], ref_length),
        "FI_Secondary_Global": structure * f["AA_Global_pct"],
        "FI_Hydro_Structs": structure * hydro,
        "FI_Proline_Structs": structure * f["Proline_delta"],
    }
