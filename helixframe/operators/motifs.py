"""Position-weight matrices: motif tables, scores of every window of a batch of sequences, and motif profiles."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.constants import IUPAC, NUCLEAR_EXPORT, NUCLEAR_LOCALIZATION, RESIDUES, SYMBOLS
from ..functions.dna import buffered
from .texts import Texts, over_texts

DNA_THRESHOLD, PROTEIN_THRESHOLD = 0.9, 0.7
#: Entries of a table of scores of several symbols together.
WORDS = 1 << 14


@dataclass(frozen=True)
class Motif:
    """A matrix with a row for each place and a column for each letter of the alphabet."""

    name: str
    domain: str
    rows: tuple[tuple[float, ...], ...]
    alphabet: str = "ACGT"

    @property
    def size(self) -> int:
        return len(self.rows)

    @property
    def background(self) -> float:
        return 1 / len(self.alphabet)

    def threshold(self, share: float) -> float:
        """The score at a share of the way from the smallest to the largest one; probabilities count as 1e-10 at least."""
        odds = np.log2(np.maximum(np.array(self.rows), 1e-10) / self.background)
        low, high = odds.min(1).sum(), odds.max(1).sum()
        return float(low + share * (high - low))

    def odds(self) -> tuple[np.ndarray, np.ndarray]:
        """(log odds, whether they void the window) of each place and symbol.  Ambiguous bases have their bases' mean."""
        p = np.array(self.rows)
        if self.alphabet == "ACGT":
            p = np.stack([p[:, ["ACGT".index(b) for b in IUPAC[s]]].mean(1) for s in SYMBOLS], axis=1)
            void = p <= 0
        else:
            p = np.c_[p, np.full(len(p), self.background)]  # other symbols say nothing
            void = p <= 1e-9
        return np.log2(np.where(void, 1.0, p) / self.background), void

    @property
    def symbols(self) -> str:
        return SYMBOLS if self.alphabet == "ACGT" else self.alphabet


def from_consensus(name: str, domain: str, consensus: str, alphabet: str = "ACGT", sure: float = 0.91) -> Motif:
    """A matrix by rule: a place's named letters share `sure`, the others the rest; one that names all is even.

    DNA places are IUPAC symbols; protein places are residues, [classes] or x for any.
    """
    if alphabet == "ACGT":
        named = [IUPAC[c] for c in consensus]
    else:
        named = [alphabet if m == "x" else m.strip("[]") for m in re.findall(r"\[[A-Z]+\]|[A-Zx]", consensus)]
    rows = []
    for letters in named:
        rest = len(alphabet) - len(letters)
        rows.append(tuple((sure if rest else 1.0) / len(letters) if a in letters else (1 - sure) / rest for a in alphabet))
    return Motif(name, domain, tuple(rows), alphabet)


#: Consensus sequences from the literature; matrices read from files can take their place under the same names.
DNA_MOTIFS = [
    from_consensus(*m)
    for m in (
        ("inr", "init", "YYANWYY"), ("tata", "init", "TATAWAWR"), ("kozak", "init", "GCCRCCATGG"),
        ("ctcf", "TF", "CCGCGNGGNGGCAG"), ("caat", "TF", "GGCCAATCT"), ("sp1", "TF", "GGGGCGGGG"), ("nfkb", "TF", "GGGRNNYYCC"), ("ap1", "TF", "TGASTCA"), ("creb", "TF", "TGACGTCA"),
        ("sp3", "PTR", "YYYYNCAGG"), ("sp5", "PTR", "MAGGTRAGT"), ("branch_pt", "PTR", "YNYTRAY"), ("polyad", "PTR", "AATAAA"),
    )
]
PROTEIN_MOTIFS = [
    from_consensus(*m, alphabet=RESIDUES)
    for m in (
        ("cdk", "phos", "xx[ST]Px[KR]x"), ("pka", "phos", "x[KR][KR]x[ST]xx"), ("ck2", "phos", "xx[ST]xx[DE]x"), ("tyr_csk", "phos", "xx[DE]xYxxxx"),
        ("ngly_1", "glyc", "xNx[ST]xx"), ("ngly_2", "glyc", "NxC"), ("dbox", "ubiq", "RxxLxxxxN"), ("kenbox", "ubiq", "xKENx"),
        ("grb2", "SH2", "YxNx"), ("sfk", "SH2", "xYEEIxx"), ("stat3", "SH2", "YxxQ"), ("stat5", "SH2", "Y[VLFI]xL"),
        ("f1433_1", "1433", "RSxSxP"), ("f1433_2", "1433", "R[ST]x[ST]"),
    )
]
STAT6 = "GYKAF"
#: Ends that PDZ domains bind: classes 1 and 2, a tryptophan before the last residue, and the inner motif of one family.
PDZ_MOTIFS = [
    from_consensus(*m, alphabet=RESIDUES)
    for m in (("pdz_dvl", "PDZ", "xxxKTxxxWxx"), ("pdz_class1", "PDZ", "xxx[ST]x[VLI]"), ("pdz_class2", "PDZ", "xxx[VLIMFYW]x[VLIMFYW]"), ("pdz_wminus1", "PDZ", "[ST]W[VLI]"))
]


class Batch:
    """Sequences end to end, as numbers of a motif's symbols; unknown symbols are the last one.

    strict: windows with unknown symbols score 0, as impossible ones do.
    """

    def __init__(self, sequences: list[str] | Texts, symbols: str, strict: bool = False):
        texts = sequences if isinstance(sequences, Texts) else Texts.of(sequences)
        number, self.strict = np.full(256, len(symbols) - (symbols == SYMBOLS and not strict), dtype=np.intp), strict
        for i, s in enumerate(symbols):
            number[ord(s)] = i
        self.n, self.sizes, self.starts = len(texts), texts.sizes, texts.starts
        self.codes = number[texts.bytes]
        self.of = np.repeat(np.arange(self.n), self.sizes)
        self.place = np.arange(len(self.codes)) - self.starts[self.of]
        #: Symbols from a place to the end of its sequence.
        self.rest = self.sizes[self.of] - self.place
        self.present = np.flatnonzero(np.bincount(self.codes, minlength=len(symbols) + 1))
        self.words: dict[int, np.ndarray] = {}

    def word(self, size: int) -> np.ndarray:
        """The symbols from every place on, that many, as one number."""
        if size not in self.words:
            rank, n = np.zeros(self.present.max(initial=0) + 1, dtype=np.intp), max(len(self.codes) - size + 1, 0)
            rank[self.present] = np.arange(len(self.present))
            codes = rank[self.codes]
            out = np.zeros(n, dtype=np.intp)
            for k in range(size):
                out = out * len(self.present) + codes[k : k + n]
            self.words[size] = out
        return self.words[size]

    def scores(self, motif: Motif) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether it ends within its sequence) of the window from every place on that has enough symbols behind it.

        The first symbols' scores are looked up together, summed in the same order.
        """
        n = max(len(self.codes) - motif.size + 1, 0)
        odds, void = motif.odds()
        table = np.where(void, -np.inf, odds)
        if self.strict:
            table = np.c_[table[:, : len(motif.symbols)], np.full(motif.size, -np.inf)]
        size = 1
        while size < motif.size and len(self.present) ** (size + 1) <= WORDS:
            size += 1
        known = np.zeros(1)
        for row in table[:size]:
            known = (known[:, None] + row[self.present]).ravel()
        total = known.take(self.word(size)[:n]) if n else np.zeros(0)
        for k in range(size, motif.size):
            total += table[k].take(self.codes[k : k + n])
        total[total == -np.inf] = 0.0
        return total, self.rest[:n] >= motif.size

    def windows(self, motif: Motif) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, place, score) of every window, in order."""
        score, inside = self.scores(motif)
        at = np.flatnonzero(inside)
        return self.of[at], self.place[at], score[at]

    def counts(self, motif: Motif) -> np.ndarray:
        """Windows of each sequence."""
        return np.maximum(self.sizes - motif.size + 1, 0)

    def hits(self, score: np.ndarray, inside: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, place, score) of the windows from a score on, in order."""
        at = np.flatnonzero(score >= least)
        at = at[inside[at]]
        return self.of[at], self.place[at], score[at]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Each sequence's sum of values of its places, in order; those behind the last given one count nothing."""
        return np.bincount(self.of[: len(values)], values, minlength=self.n)


def clusters(of: np.ndarray, place: np.ndarray, score: np.ndarray, n: int, far: int) -> np.ndarray:
    """Each sequence's cluster score: neighbours in the given order add their scores over their distance plus one."""
    gap = np.diff(place)
    on = (of[1:] == of[:-1]) & (gap > 0) & (gap <= far)
    value = (score[1:][on] + score[:-1][on]) / (gap[on] + 1)
    return np.bincount(of[1:][on], value, minlength=n)


def in_motif_order(parts: list[tuple[np.ndarray, ...]], n: int, far: int) -> np.ndarray:
    """Cluster score of several motifs' filtered windows, each sequence's windows motif by motif."""
    of = np.concatenate([p[0] for p in parts])
    order = np.argsort(of, kind="stable")
    return clusters(of[order], np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order], n, far)


def window_statistics(s: Column, motifs: list[Motif]) -> Column:
    """A struct of each motif's number of windows, largest score (null without any) and sum of scores.  Nulls count as empty."""

    def run(texts: Texts) -> dict:
        batch, out = Batch(texts, motifs[0].symbols, strict=True), {}
        for m in motifs:
            score, inside = batch.scores(m)
            count = batch.counts(m)
            largest, some = np.full(len(texts), np.nan), count > 0
            if some.any():
                largest[some] = np.maximum.reduceat(np.where(inside, score, -np.inf), batch.starts[some])
            out |= {f"{m.name}_n": count, f"{m.name}_max": largest, f"{m.name}_sum": batch.sums(np.where(inside, score, 0.0))}
        return out

    return over_texts(run, {f"{m.name}_{what}": kind for m in motifs for what, kind in (("n", "long"), ("max", "double"), ("sum", "double"))}, [s])


def gaussian_deltas(ref: Column, alt: Column, sizes: tuple[Column, Column], flank: int, motifs: list[Motif]) -> Column:
    """A struct of each motif's change of the sum of scores, weighted by a Gaussian of the distance to the allele.

    ref, alt: alleles of these sizes between flanks, the left one of so many bases.  Nulls count as empty.
    """

    def run(r: Texts, a: Texts, nr: np.ndarray, na: np.ndarray) -> dict:
        sums = []
        for texts, size in ((r, nr), (a, na)):
            batch = Batch(texts, motifs[0].symbols, strict=True)
            far = distances(batch, np.full(len(texts), flank), flank + np.nan_to_num(size).astype(np.intp))
            sums.append([batch.sums(np.where(inside, score, 0.0) * weights(far, m.size)[: len(score)]) for m in motifs for score, inside in [batch.scores(m)]])
        return {m.name: x - y for m, y, x in zip(motifs, *sums)}

    return over_texts(run, {m.name: "double" for m in motifs}, [ref, alt], list(sizes))


def distances(batch: Batch, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Distance of every place to [start, end] of its sequence."""
    return np.maximum(np.maximum(start[batch.of] - batch.place, batch.place - end[batch.of]), 0)


def weights(far: np.ndarray, sigma: float) -> np.ndarray:
    """gaussian() of whole distances, each distinct one once."""
    return np.exp(-(np.arange(far.max(initial=0) + 1) ** 2) / (2 * sigma**2))[far]


def hit_deltas(ref: Column, alt: Column, motifs: list[Motif], share: float, far: int) -> Column:
    """A struct of the changes of each motif's clusters, of all motifs' clusters together and of the number of hits.

    share: of the way to a motif's largest score, from where on windows are hits.  Nulls count as empty.
    """

    def run(*sides: Texts) -> dict:
        found = []
        for texts in sides:
            batch = Batch(texts, motifs[0].symbols, strict=True)
            found.append([batch.hits(*batch.scores(m), m.threshold(share)) for m in motifs])
        n = len(sides[0])
        change = lambda f: f(found[1]) - f(found[0])
        out = {m.name: change(lambda hits, i=i: clusters(*hits[i], n, far)) for i, m in enumerate(motifs)}
        count = change(lambda hits: np.bincount(np.concatenate([h[0] for h in hits]), minlength=n))
        return out | {"together": change(lambda hits: in_motif_order(hits, n, far)), "hits": count}

    return over_texts(run, {m.name: "double" for m in motifs} | {"together": "double", "hits": "long"}, [ref, alt])


def score_deltas(ref: Column, alt: Column, motifs: list[Motif], share: float) -> Column:
    """A struct of each motif's changes: of its number of windows, the sum of their scores, and the number of hits.  Nulls count as empty."""

    def run(r: Texts, a: Texts) -> dict:
        sides = []
        for texts in (r, a):
            batch = Batch(texts, motifs[0].symbols, strict=True)
            side = []
            for m in motifs:
                score, inside = batch.scores(m)
                high = batch.hits(score, inside, m.threshold(share))[0]
                side += [batch.counts(m), batch.sums(np.where(inside, score, 0.0)), np.bincount(high, minlength=len(texts))]
            sides.append(side)
        return dict(zip(fields, (y - x for x, y in zip(*sides))))

    fields = {f"{m.name}_{what}": kind for m in motifs for what, kind in (("count", "long"), ("score", "double"), ("hits", "long"))}
    return over_texts(run, fields, [ref, alt])


def gaussian(place: np.ndarray, start: np.ndarray, end: np.ndarray, sigma: float) -> np.ndarray:
    far = np.maximum(np.maximum(start - place, place - end), 0)
    return np.exp(-(far**2) / (2 * sigma**2))


def domain_names(domain: str) -> tuple[str, str, str, str]:
    return (f"{domain}_motif_count", f"{domain}_score_shift", f"{domain}_cluster_shift", f"{domain}_domain_cluster_shift")


def by_domain(motifs: list[Motif]) -> dict[str, list[int]]:
    """Places of the motifs of each domain, domains in the order of their first motif."""
    out: dict[str, list[int]] = {}
    for i, m in enumerate(motifs):
        out.setdefault(m.domain, []).append(i)
    return out


TOTALS = {d: domain_names(d) for d in by_domain(DNA_MOTIFS)}
ALL = ("TOTAL_DNA_MOTIF_COUNT", "TOTAL_DNA_MOTIF_SCORE", "TOTAL_DNA_MOTIF_CLUSTER", "TOTAL_DNA_MOTIF_DOMAIN_CLUSTER")


def dna_changes(windows: tuple[Texts, Texts], sizes: tuple[np.ndarray, np.ndarray], motifs: list[Motif], config: Config) -> dict[str, np.ndarray]:
    """Counts, Gaussian scores and clusters of each motif, each domain and all, alternate less reference.

    windows: alleles of these sizes, behind so many bases as the radius has; a shorter flank counts as if it had them.
    """
    n, sides = len(windows[0]), []
    for texts, size in zip(windows, sizes):
        batch, side = Batch(texts, SYMBOLS), []
        far, weight = distances(batch, np.full(n, config.motif_radius), config.motif_radius + size), {}
        for m in motifs:
            score, inside = batch.scores(m)
            if m.size not in weight:
                weight[m.size] = weights(far, m.size)
            picked = batch.hits(score, inside, m.threshold(DNA_THRESHOLD))
            score *= weight[m.size][: len(score)]
            score *= inside
            side.append((batch.counts(m), batch.sums(score), clusters(*picked, n, config.dna_cluster), picked))
        sides.append(side)
    out: dict[str, np.ndarray] = {}
    totals = np.zeros((4, n))
    for domain, mine in by_domain(motifs).items():
        sums = np.zeros((4, n))
        for i in mine:
            shift = [sides[1][i][k] - sides[0][i][k] for k in range(3)]
            out |= {f"{motifs[i].name}_{what}": x for what, x in zip(("count", "score", "cluster"), shift)}
            sums[:3] += shift
        sums[3] = np.subtract(*(in_motif_order([side[i][3] for i in mine], n, config.dna_cluster) for side in sides[::-1]))
        out |= dict(zip(domain_names(domain), sums))
        totals += sums
    return {k: x.astype(float) for k, x in (out | dict(zip(ALL, totals))).items()}


def dna_profile(ref: pd.Series, alt: pd.Series, flank_1: pd.Series, flank_2: pd.Series, motifs: list[Motif], config: Config) -> pd.DataFrame:
    """dna_changes() of alleles and their flanks."""
    kept = [f[len(f) - config.motif_radius :] for f in flank_1]  # a negative start keeps the end, as the definition has it
    right = flank_2.str[: config.motif_radius]
    windows = tuple(Texts.of([a + x + b for a, x, b in zip(kept, allele, right)]) for allele in (ref, alt))
    return pd.DataFrame(dna_changes(windows, tuple(x.str.len().to_numpy() for x in (ref, alt)), motifs, config))


@cache
def ahead(patterns: tuple[str, ...]) -> re.Pattern:
    return re.compile("(?=" + "|".join(f"(?:{p})" for p in patterns) + ")")


def regex_places(s: str, patterns: list[str]) -> list[int]:
    """Places where any of the patterns matches, overlapping matches included."""
    return [m.start() for m in ahead(tuple(patterns)).finditer(s)]


def regex_clusters(places: list[int], far: int) -> int:
    """Neighbours in the given order that are near; steps back don't count."""
    return sum(0 < b - a <= far for a, b in zip(places, places[1:]))


PTM = ("phos", "glyc", "ubiq")
PROTEIN_FEATURES = [
    *(f"{d}_{w}" for d in PTM for w in ("score_delta", "count_delta", "clusters_composite_delta", "domain_cluster_delta")), "Total_PTM_cluster_composite_delta",
    "NLS_count_delta", "NES_count_delta", "Nuclear_Signal_delta", "NLS_cluster_delta", "NES_cluster_delta", "Total_Nuclear_Cluster_delta",
    "SH2_count_delta", "SH2_score_delta", "SH2_clusters_delta", "SH2_domain_cluster_score", "1433_count_delta", "1433_score_delta", "1433_clusters_delta", "1433_cluster_domain_delta",
]


def protein_sides(ref: Texts, alt: Texts, motifs: list[Motif], far: int) -> list[list[tuple]]:
    """For both proteins, each motif's counts, scores, clusters and high windows."""
    n, sides = len(ref), []
    for p in (ref, alt):
        batch, side = Batch(p, RESIDUES), []
        for m in motifs:
            score, inside = batch.scores(m)
            picked = batch.hits(score, inside, m.threshold(PROTEIN_THRESHOLD))
            side.append((batch.counts(m), batch.sums(score * inside), clusters(*picked, n, far), picked))
        sides.append(side)
    return sides


def where_changed(run, names: list[str]):
    """run() of the pairs of texts that differ, and 0 for the others: what it gives are changes."""

    def over(ref: Texts, alt: Texts) -> dict[str, np.ndarray]:
        at = np.flatnonzero(ref.differ(alt))
        made = run(ref.take(at), alt.take(at))
        out = {k: np.zeros(len(ref)) for k in names}
        for k in names:
            out[k][at] = made[k]
        return out

    return over


def domain_shift(sides: list[list[tuple]], mine: list[int], n: int, far: int) -> list[np.ndarray]:
    """Count, score, clusters of each motif and clusters of the domain, alternate less reference."""
    sums = [sum((sides[1][i][k] - sides[0][i][k] for i in mine), np.zeros(n)) for k in range(3)]
    whole = np.subtract(*(in_motif_order([side[i][3] for i in mine], n, far) for side in sides[::-1])) if mine else np.zeros(n)
    return [*sums, whole]


PDZ_FEATURES = ["PDZ_count_delta", "PDZ_score_delta", "PDZ_clusters_delta", "PDZ_domain_cluster_delta"]


def pdz_motifs(ref: Column, alt: Column, motifs: list[Motif] | None = None, config: Config = DEFAULT) -> Column:
    """A struct of PDZ_FEATURES of two proteins.  Nulls count as empty."""
    motifs, far = motifs or PDZ_MOTIFS, config.protein_cluster

    def run(a: Texts, b: Texts) -> dict:
        return dict(zip(PDZ_FEATURES, domain_shift(protein_sides(a, b, motifs, far), list(range(len(motifs))), len(a), far)))

    return over_texts(where_changed(run, PDZ_FEATURES), dict.fromkeys(PDZ_FEATURES, "double"), [ref, alt])


def protein_changes(ref: Texts, alt: Texts, motifs: list[Motif], config: Config) -> dict[str, np.ndarray]:
    """Motif features of two proteins, alternate less reference."""
    n, far = len(ref), config.protein_cluster
    sides = protein_sides(ref, alt, motifs, far)
    out: dict[str, np.ndarray] = {}
    for domain in (*PTM, "SH2", "1433"):
        mine = [i for i, m in enumerate(motifs) if m.domain == domain]
        count, score, cluster, whole = domain_shift(sides, mine, n, far)
        names = {"SH2": ("clusters_delta", "domain_cluster_score"), "1433": ("clusters_delta", "cluster_domain_delta")}.get(domain, ("clusters_composite_delta", "domain_cluster_delta"))
        out |= {f"{domain}_score_delta": score, f"{domain}_count_delta": count, f"{domain}_{names[0]}": cluster, f"{domain}_{names[1]}": whole}
    out["Total_PTM_cluster_composite_delta"] = sum(out[f"{d}_clusters_composite_delta"] for d in PTM)
    found = [[(regex_places(s, NUCLEAR_LOCALIZATION), regex_places(s, NUCLEAR_EXPORT), regex_places(s, [STAT6])) for s in p.strings()] for p in (ref, alt)]
    shift = lambda f: np.array([f(b) - f(a) for a, b in zip(*found)], dtype=float)
    out["NLS_count_delta"], out["NES_count_delta"] = shift(lambda x: len(x[0])), shift(lambda x: len(x[1]))
    out["Nuclear_Signal_delta"] = out["NLS_count_delta"] + out["NES_count_delta"]
    out["NLS_cluster_delta"], out["NES_cluster_delta"] = shift(lambda x: regex_clusters(x[0], far)), shift(lambda x: regex_clusters(x[1], far))
    out["Total_Nuclear_Cluster_delta"] = shift(lambda x: regex_clusters(x[0] + x[1], far))
    stat6 = shift(lambda x: regex_clusters(x[2], far))
    out["SH2_count_delta"] = out["SH2_count_delta"] + shift(lambda x: len(x[2]))
    out["SH2_score_delta"], out["SH2_clusters_delta"] = out["SH2_score_delta"] + stat6, out["SH2_clusters_delta"] + stat6
    return {k: out[k].astype(float) for k in PROTEIN_FEATURES}


def protein_profile(ref: pd.Series, alt: pd.Series, motifs: list[Motif], config: Config) -> pd.DataFrame:
    """protein_changes() of two proteins."""
    return pd.DataFrame(protein_changes(Texts.of(ref.tolist()), Texts.of(alt.tolist()), motifs, config))


def dna_names(motifs: list[Motif]) -> list[str]:
    out = []
    for domain, mine in by_domain(motifs).items():
        out += [f"{motifs[i].name}_{w}" for i in mine for w in ("count", "score", "cluster")]
        out += domain_names(domain)
    return [*out, *ALL]


def dna_motifs(ref: Column, alt: Column, flank_1: Column, flank_2: Column, motifs: list[Motif] | None = None, config: Config = DEFAULT) -> Column:
    """A struct of dna_names.  Nulls count as empty."""
    motifs = motifs or DNA_MOTIFS

    def run(a: Texts, b: Texts, na: np.ndarray, nb: np.ndarray) -> dict:
        return dna_changes((a, b), (na, nb), motifs, config)

    texts = [F.coalesce(x, F.lit("")) for x in (F.col(x) if isinstance(x, str) else x for x in (ref, alt, flank_1, flank_2))]
    windows = [buffered(x, *texts[2:], config.motif_radius) for x in texts[:2]]
    return over_texts(run, dict.fromkeys(dna_names(motifs), "double"), windows, [F.length(x) for x in texts[:2]])


def protein_motifs(ref: Column, alt: Column, motifs: list[Motif] | None = None, config: Config = DEFAULT) -> Column:
    """A struct of PROTEIN_FEATURES.  Nulls count as empty."""
    motifs = motifs or PROTEIN_MOTIFS

    def run(a: Texts, b: Texts) -> dict:
        return protein_changes(a, b, motifs, config)

    return over_texts(where_changed(run, PROTEIN_FEATURES), dict.fromkeys(PROTEIN_FEATURES, "double"), [ref, alt])
