"""DNA features of alleles and their windows as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .constants import GENE_DENSITY, INTRON, POLY_TRACTS, START, STOP, stacking_energies


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def length_change(ref: Column, alt: Column) -> Column:
    """Change of length in percent, doubled where it shifts the reading frame; null for an empty reference."""
    shift = F.length(alt) - F.length(ref)
    return F.try_divide(shift, F.length(ref)) * 100 * F.when(F.abs(shift) % 3 != 0, 2.0).otherwise(1.0)


def gene_density(chromosome: Column) -> Column:
    """Genes per megabase of the chromosome; null if it is unknown."""
    return F.try_element_at(literal_map(GENE_DENSITY), chromosome.cast("int"))


def gc_fraction(s: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    return F.try_divide(F.length(s) - F.length(F.translate(s, "GC", "")), F.length(s))


def cpg_fraction(s: Column) -> Column:
    return F.regexp_count(s, F.lit("CG")) / F.greatest(F.length(s) - 1, F.lit(1))


def gc_context(ref: Column, alt: Column) -> Column:
    """GC and CpG change; the reference's GC is its CpG fraction, as the definition has it."""
    return (gc_fraction(alt) - cpg_fraction(ref)) + (cpg_fraction(alt) - cpg_fraction(ref))


def places(n: Column) -> Column:
    """1 to n, empty below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def stacking_energy(s: Column) -> Column:
    """Sum of nearest-neighbour energies; 0 for fewer than two bases."""
    energies = literal_map(stacking_energies())
    return F.aggregate(places(F.length(s) - 1), F.lit(0.0), lambda a, i: a + F.coalesce(F.try_element_at(energies, F.substr(s, i, F.lit(2))), F.lit(0.0)))


def kmers(s: Column, config: Config = DEFAULT) -> Column:
    """All substrings of k_min to k_max bases, repeats included."""
    n = F.length(s)
    return F.flatten(F.transform(F.sequence(F.lit(config.k_min), F.lit(config.k_max)), lambda k: F.transform(places(n - k + 1), lambda i: F.substr(s, i, k))))


def left_window(flank: Column, keep: int) -> Column:
    """The end of the left flank that a window keeps.

    A flank shorter than the window keeps window - length bases (all of them below half a window), as the
    definition's negative slice does.
    """
    n = F.length(flank)
    kept = F.when(n >= keep, keep).otherwise(F.least(n, keep - n))
    return F.when(kept <= 0, F.lit("")).otherwise(F.right(flank, kept))


def buffered(allele: Column, flank_1: Column, flank_2: Column, keep: int = DEFAULT.dna_buffer) -> Column:
    return F.concat(left_window(flank_1, keep), allele, F.left(flank_2, F.lit(keep)))


def count_delta(ref: Column, alt: Column, pattern: str) -> Column:
    return F.regexp_count(alt, F.lit(pattern)) - F.regexp_count(ref, F.lit(pattern))


def motif_count_deltas(ref: Column, alt: Column) -> dict[str, Column]:
    """Changes of the number of start and stop codons, introns and poly-tracts in windows."""
    patterns = {"Start_codons": START, "Stop_codons": STOP, "Introns": INTRON, "Poly_tracts": POLY_TRACTS}
    return {name: count_delta(ref, alt, p) for name, p in patterns.items()}


def duplications(ref: Column, alt: Column, config: Config = DEFAULT) -> Column:
    """Number of distinct adjacent duplications of the alternate window whose unit the reference window lacks."""
    n = F.length(alt)

    def units(k: Column) -> Column:
        starts = F.filter(places(n - 2 * k + 1), lambda i: F.substr(alt, i, k) == F.substr(alt, i + k, k))
        return F.transform(starts, lambda i: F.substr(alt, i, k))

    found = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(config.min_repeat), F.lit(config.max_repeat)), units)))
    return F.size(F.filter(found, lambda u: ~F.contains(ref, u)))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ATCG", "TAGC"))


def interactions(f: dict[str, Column]) -> dict[str, Column]:
    """Features made of the others: length and stability against gene density, mutation propensity, stability, composite."""
    density = f["Chromosome_density"]
    stability = f["Thermodynamic_stability"] * density
    propensity = f["Tandem_Duplications"] + f["Hairpins"] + f["tr_base_composite"] + f["Poly_tracts"]
    return {
        "FI_Relative_length_context": f["Length_change_context"] / density,
        "FI_Relative_stability": stability,
        "FI_Mutation_propensity": propensity,
        "FI_General_Stability": stability * propensity / density,
        "FI_Mutation_composite": propensity + f["SNVs"] + f["Insertion_length"],
    }
