"""Fixed values of the feature definitions."""

from __future__ import annotations

from itertools import product

# IUPAC nucleotide codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ATCG",
}
SYMBOLS = "".join(IUPAC)

# Unified nearest-neighbour free energies at 37 degrees, kcal/mol.
STACKING = {
    "AA": -1.02, "AT": -0.73, "TA": -0.60, "CA": -1.38, "GT": -1.43, "CT": -1.16, "GA": -1.46, "CG": -2.09, "GC": -2.28,
    "GG": -1.77, "TT": -1.02, "TG": -1.38, "AC": -1.43, "AG": -1.16, "TC": -1.46, "CC": -1.77,
}

# Genes per megabase of chromosomes 1 to 22, X (23) and Y (24).
GENE_DENSITY = {
    1: 8.85, 2: 5.47, 3: 5.57, 4: 4.17, 5: 4.99, 6: 6.62, 7: 6.44, 8: 5.11, 9: 6.22, 10: 6.12, 11: 10.3, 12: 8.16,
    13: 3.16, 14: 6.29, 15: 6.39, 16: 10.41, 17: 15.69, 18: 3.88, 19: 22.61, 20: 9.88, 21: 6.05, 22: 10.44, 23: 5.75,
    24: 1.38,
}

# Patterns that are counted in a window, and start codons with their scores.
START, STOP, INTRON = "ATG", "TAA|TAG|TGA", "GT[ATCG]{1,10}TACTAAC[ATCG]{1,10}AC"
POLY_TRACTS = "A{6,}|C{6,}|G{6,}|T{6,}|(?:AT){4,}"
START_SCORES = {"ATG": 4, "CTC": 3, "CTG": 2, "TTG": 1}
NUCLEAR_LOCALIZATION = [
    "[KR]{4,}", "K[KR].[KR]", "[KR]{2}.{10,12}(?:[KR]{3}[A-Z]{2}|[KR]{4}[A-Z]|[KR]{5})", "KR.[WFY]..AF", "[PR]..KR[KR]",
    "R{3,}", "[KRH].{2,5}PY",
]
NUCLEAR_EXPORT = ["L.{2,3}[LIVFM].{2,3}L.[LI]"]

# The standard genetic code in the order T, C, A, G of each place; _ is a stop.
CODONS = dict(zip(map("".join, product("TCAG", repeat=3)), "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"))
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Residue properties, in the order of RESIDUES.
PROPERTIES = {
    "Molecular_weight": [0.09, 0.12, 0.13, 0.15, 0.17, 0.08, 0.16, 0.13, 0.15, 0.13, 0.15, 0.13, 0.12, 0.15, 0.17, 0.11, 0.12, 0.12, 0.20, 0.18],
    "Net_charge": [0, 0, -1, -1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0],
    "Isoelectric": [6.02, 5.02, 2.98, 3.22, 5.48, 5.97, 7.59, 5.98, 9.47, 5.98, 5.75, 5.41, 6.30, 5.65, 10.76, 5.68, 5.60, 5.97, 5.94, 5.66],
    "Hydrophobicity": [41, 49, -55, -31, 100, 0, 8, 100, -23, 97, 74, -28, -46, -10, -14, -5, 13, 76, 97, 63],
    "Half_life": [4.4, 1.2, 1.1, 1, 1, 30, 3.5, 20, 1.3, 5.5, 30, 1.4, 21, 0.8, 1, 1.9, 7.2, 100, 2.8, 2.8],
}
#: Residues counted as helix, turn and sheet formers; the sum of their fractions is the structure propensity.
HELIX, TURN, SHEET = "VIYFWL", "NPGS", "EMAL"

# Hidden Markov model of genomic domains; rows are origins, columns destinations, both in this order.
STATES = ["3UTR", "5UTR", "CDS", "Exon", "Intergenic", "Intron"]
INITIAL = [0.075, 0.075, 0.015, 0.03, 0.67, 0.27]
EMISSION = [  # A, C, G, T
    [0.25, 0.25, 0.25, 0.25],
    [0.25, 0.25, 0.25, 0.25],
    [0.268820, 0.253455, 0.258194, 0.219532],
    [0.270445, 0.233545, 0.237919, 0.258092],
    [0.298139, 0.200534, 0.201782, 0.299545],
    [0.280442, 0.200074, 0.209608, 0.309875],
]
TRANSITION = [
    [0.166667] * 6,
    [0.166667] * 6,
    [0, 0, 0.142494, 0, 0, 0.857506],
    [0, 0, 0.836724, 0, 0, 0.163276],
    [0.166667] * 6,
    [0, 0, 0, 1.0, 0, 0],
]
SUBGROUPS = {
    "coding": ["CDS", "Exon"],
    "noncoding": ["3UTR", "5UTR", "Intergenic", "Intron"],
    "regulatory": ["3UTR", "5UTR", "Intron"],
    "transcribable": ["3UTR", "5UTR", "CDS", "Exon"],
    "processing": ["3UTR", "5UTR", "Exon"],
}


def stacking_energies() -> dict[str, float]:
    """Energy of every pair of symbols; an ambiguous pair has its bases' mean, to three places."""
    mean = lambda x, y: round(sum(STACKING[a + b] for a in IUPAC[x] for b in IUPAC[y]) / (len(IUPAC[x]) * len(IUPAC[y])), 3)
    return {x + y: mean(x, y) for x in SYMBOLS for y in SYMBOLS}
