"""DuckDB oracles of the sequence algorithms, each a statement that follows the CTE `v`.

They are written from the definitions, not from the Arrow-batched functions: tables grow row by row in recursive SQL,
frames and repeats are found by regular expressions, hairpins by the last place of each pair of bases.
"""

from __future__ import annotations

import numpy as np

from ..config import DEFAULT
from ..functions.constants import CODONS, IUPAC, NUCLEAR_EXPORT, NUCLEAR_LOCALIZATION, RESIDUES, START_SCORES, STATES, SYMBOLS
from ..operators import motifs
from ..operators.viterbi import _tables

# ---- alignment: a table's next row from its last one, then a walk back ----

GAP = DEFAULT.mismatch
ALIGNED = f""", pairs AS (SELECT DISTINCT ref_allele AS a, alt_allele AS b, length(ref_allele) AS m, length(alt_allele) AS n FROM v),
grow(local, a, b, m, n, i, t) AS (
  SELECT local, a, b, m, n, 0::BIGINT, [list_transform(range(0, n + 1), lambda j: CASE WHEN local THEN 0 ELSE {GAP} * j END)] FROM pairs, (VALUES (false), (true)) AS kinds(local)
  UNION ALL
  SELECT local, a, b, m, n, i + 1, list_append(t, list_transform(range(0, n + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda h: reached[h + 1] + {GAP} * (j - h)))))
  FROM (SELECT *, list_concat([CASE WHEN local THEN 0 ELSE {GAP} * (i + 1) END], list_transform(range(1, n + 1), lambda j: greatest(
      t[i + 1][j] + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN {DEFAULT.match} ELSE {DEFAULT.mismatch} END, t[i + 1][j + 1] + {GAP}, CASE WHEN local THEN 0 END))) AS reached
    FROM grow WHERE i < m)),
ends AS (SELECT *, CASE WHEN local THEN list_position(flatten(t), list_max(flatten(t))) - 1 ELSE m * (n + 1) + n END AS cell FROM grow WHERE i = m),
walk(local, a, b, t, top, i, j, x, y) AS (
  SELECT local, a, b, t, t[cell // (n + 1) + 1][cell % (n + 1) + 1], (cell // (n + 1))::BIGINT, (cell % (n + 1))::BIGINT, '', '' FROM ends
  UNION ALL
  SELECT local, a, b, t, top, CASE move WHEN 'left' THEN i ELSE i - 1 END, CASE move WHEN 'up' THEN j ELSE j - 1 END,
    CASE move WHEN 'left' THEN '-' ELSE substr(a, i, 1) END || x, CASE move WHEN 'up' THEN '-' ELSE substr(b, j, 1) END || y
  FROM (SELECT *, CASE WHEN j > 0 AND t[i + 1][j] + {GAP} = t[i + 1][j + 1] THEN 'left' WHEN i > 0 AND t[i][j + 1] + {GAP} = t[i + 1][j + 1] THEN 'up' ELSE 'diagonal' END AS move
    FROM walk WHERE (i > 0 OR j > 0) AND NOT (local AND t[i + 1][j + 1] = 0))),
done AS (SELECT * FROM walk WHERE CASE WHEN local THEN t[i + 1][j + 1] = 0 ELSE i = 0 AND j = 0 END),
aligned AS (SELECT variant_id, local, a, top, x, y, list_transform(range(1, length(x) + 1), lambda q: CASE WHEN substr(x, q, 1) = substr(y, q, 1) THEN '=' WHEN substr(x, q, 1) = '-' THEN 'i' WHEN substr(y, q, 1) = '-' THEN 'd' ELSE 'x' END) AS kinds
  FROM v JOIN done ON ref_allele = a AND alt_allele = b)
"""
_count = lambda kind: f"len(list_filter(kinds, lambda q: q = '{kind}'))"
NW_DNA = ALIGNED + f"SELECT variant_id, top::INT AS Global_score, round(100.0 * {_count('=')} / length(x), 6) AS Global_pct, x AS global_ref, y AS global_alt FROM aligned WHERE NOT local"
SW_DNA = ALIGNED + "SELECT variant_id, top::INT AS Local_score, round(100.0 * length(x) / length(a), 6) AS Local_pct, x AS local_ref, y AS local_alt FROM aligned WHERE local"
SNV_FLAG = ALIGNED + f"SELECT variant_id, ({_count('x')} = 1 AND {_count('i')} + {_count('d')} = 0)::INT AS SNVs FROM aligned WHERE NOT local"
INSERTION_LEN = ALIGNED + f"SELECT variant_id, {_count('i')}::INT AS Insertion_length FROM aligned WHERE NOT local"

# ---- windows of both alleles, a row for each ----


def sides(window: str) -> str:
    """The CTE w: (variant_id, side, size, lead, s) of the window around x, which stands for either allele."""
    one = lambda side, x: f"SELECT variant_id, '{side}' AS side, length({x}) AS size, length(flank_1) AS lead, {window.replace('{x}', x)} AS s FROM v"
    return f", w AS ({one('r', 'ref_allele')} UNION ALL {one('a', 'alt_allele')})\n"


BUFFERED = sides(f"right(flank_1, {DEFAULT.dna_buffer}) || {{x}} || left(flank_2, {DEFAULT.dna_buffer})")

# Two stems of four agree in two places at least: in one of six pairs of places.
PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
HAIRPINS = (
    BUFFERED
    + f""", stems AS (SELECT variant_id, side, length(s) AS n, p, unnest([{', '.join(f"'{a}{b}'" for a, b in PAIRS)}]) AS z, unnest([{', '.join(f'substr(s, p + {a + 1}, 1) || substr(s, p + {b + 1}, 1)' for a, b in PAIRS)}]) AS bases
  FROM (SELECT *, unnest(range(0, length(s) - 3)) AS p FROM w)),
farthest AS (SELECT variant_id, side, z, bases, max(p) AS far FROM stems GROUP BY ALL),
wanted AS (SELECT variant_id, side, z, p, translate(bases, 'ATCG', 'TAGC') AS bases FROM stems WHERE p <= n - 12),
found AS (SELECT variant_id, side, p FROM wanted JOIN farthest USING (variant_id, side, z, bases) GROUP BY ALL HAVING max(far) >= p + 7),
counted AS (SELECT variant_id, count(*) FILTER (side = 'a') - count(*) FILTER (side = 'r') AS d FROM found GROUP BY variant_id)
SELECT variant_id, coalesce(d, 0)::INT AS hairpins FROM v LEFT JOIN counted USING (variant_id)"""
)

_least = DEFAULT.min_repeats
_units = ", ".join(
    f"list_transform(list_filter(range(1, length(s) - {_least * k} + 2), lambda p: substr(s, p, {(_least - 1) * k}) = substr(s, p + {k}, {(_least - 1) * k})), lambda p: substr(s, p, {k}))" for k in range(DEFAULT.k_min, DEFAULT.k_max)
)
_SUMS = {
    "Microsat_delta": "count(after) - count(before)", "tr_loci_lost": "count(*) FILTER (after IS NULL)", "tr_loci_gain": "count(*) FILTER (before IS NULL)",
    "tr_bp_gain": "sum(after) FILTER (before IS NULL)", "tr_bp_loss": "sum(before) FILTER (after IS NULL)",
    "tr_expansion_score": "sum(after - before) FILTER (after > before)", "tr_contraction_score": "sum(before - after) FILTER (after <= before)",
    "tr_weighted_bploss": "sum(before * k) FILTER (after IS NULL)", "tr_weighted_bpgain": "sum(after * k) FILTER (before IS NULL)",
    "tr_weighted_expansion_score": "sum((after - before) * k) FILTER (after > before)", "tr_weighted_contraction_score": "sum((before - after) * k) FILTER (after <= before)",
}
_zero = lambda *names: "(" + " + ".join(f"coalesce({c}, 0)" for c in names) + ")::INT"
REPEAT_RUNS = (
    BUFFERED
    + f""", units AS (SELECT DISTINCT variant_id, side, s, unnest(flatten([{_units}])) AS unit FROM w),
runs AS (SELECT variant_id, side, unit, list_sum(list_transform(regexp_extract_all(s, '(?:' || unit || '){{{_least},}}'), lambda q: length(q))) AS n FROM units),
both_sides AS (SELECT variant_id, length(unit) AS k, r.n AS before, a.n AS after FROM (FROM runs WHERE side = 'r') AS r FULL JOIN (FROM runs WHERE side = 'a') AS a USING (variant_id, unit))
"""
)
REPEATS = (
    REPEAT_RUNS
    + f""", sums AS (SELECT variant_id, {', '.join(f'{x} AS {c}' for c, x in _SUMS.items())}, sum(after - before) AS shift FROM both_sides GROUP BY variant_id)
SELECT variant_id, {', '.join(f'{_zero(c)} AS {c}' for c in _SUMS)}, {_zero('tr_bp_gain', 'tr_bp_loss', 'shift')} AS tr_base_composite,
  {_zero('tr_loci_lost', 'tr_loci_gain', *[c for c in _SUMS if 'weighted' in c])} AS tr_composite_score FROM v LEFT JOIN sums USING (variant_id)"""
)

# ---- open reading frames of both strands, and their proteins ----

_RESIDUE = dict(CODONS)
for _at in range(3):  # an ambiguous base stands for the first of its bases that makes a residue
    for _codon in CODONS:
        _key = _codon[:_at] + "N" + _codon[_at + 1 :]
        _may = [CODONS[_codon[:_at] + b + _codon[_at + 1 :]] for b in IUPAC["N"]]
        _RESIDUE[_key] = next((r for r in _may if r != "_"), "_")
_codon_map = "MAP {" + ", ".join(f"'{k}': '{r}'" for k, r in _RESIDUE.items()) + "}"
_start_score = "CASE substr(s, a + 1, 3) " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in START_SCORES.items()) + " END"
FRAMES = (
    sides(f"substr(flank_1, {DEFAULT.protein_buffer + 1}) || {{x}} || left(flank_2, {DEFAULT.protein_buffer})")
    + f""", strands AS (SELECT variant_id, side, false AS turned, s FROM w UNION ALL SELECT variant_id, side, true, translate(reverse(s), 'ATCG', 'TAGC') FROM w),
starts AS (SELECT variant_id, side, turned, s, unnest(list_transform(range(1, len(parts)), lambda q: list_sum(list_transform(parts[1:q], lambda t: length(t))) + 3 * (q - 1)))::BIGINT AS a
  FROM (SELECT *, string_split_regex(s, '{'|'.join(START_SCORES)}') AS parts FROM strands)),
frames AS (SELECT *, length(regexp_extract(substr(s, a + 4), '^(?:...)*?(?:TAA|TAG|TGA)')) AS n FROM starts),
scored AS (SELECT variant_id, side, turned, a, a + n + 3 AS e, substr(s, a + 1, n + 3) AS orf, {_start_score}
    + CASE WHEN a < 3 OR a + 6 >= length(s) THEN 0 ELSE 3 * (substr(s, a - 2, 1) IN ('A', 'G'))::INT + 2 * (substr(s, a + 5, 1) = 'G')::INT END + (n + 3) / {DEFAULT.min_protein}::DOUBLE * 100 AS score
  FROM frames WHERE n >= {3 * DEFAULT.min_protein}),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY variant_id, side ORDER BY score DESC, turned, a) = 1),
chosen AS (SELECT variant_id, side, coalesce(a, 0) AS a, coalesce(e, length(s)) AS e, coalesce(score, 0) AS score, coalesce(turned, false) AS turned, coalesce(orf, s) AS orf FROM w LEFT JOIN best USING (variant_id, side)),
proteins AS MATERIALIZED (SELECT *, regexp_extract(ltrim(array_to_string(list_transform(range(0, length(orf) // 3), lambda q: ({_codon_map})[substr(orf, 3 * q + 1, 3)]), ''), '_'), '^[^_]*') AS protein FROM chosen)
"""
)
BEST_ORF = FRAMES + """SELECT variant_id, a::INT AS start, e::INT AS "end", score::DOUBLE AS score, turned AS "reverse", protein FROM proteins WHERE side = 'r'"""

# ---- domains: scores step by step, the ways back in text, folded from the end ----


def decoded(sequences: str) -> str:
    """CTEs after a query of (key, s): decoded (key, path, log_probability), paths of one digit a base."""
    start, emit, move = _tables()
    number = lambda x: f"{float(x)!r}::DOUBLE"
    k = range(len(STATES))
    emits = "[" + ", ".join("[" + ", ".join(number(x) for x in row) + "]" for row in emit) + "]"
    from_ = lambda j: [f"s{i} + {number(move[i, j])}" for i in k if np.isfinite(move[i, j])]
    first = lambda values, names: "CASE " + " ".join(f"WHEN {v} >= greatest({', '.join(values)}) THEN '{i}'" for v, i in zip(values, names)) + " END"
    backs = " || ".join(first(from_(j), [i for i in k if np.isfinite(move[i, j])]) for j in k)
    symbol = lambda t: f"({emits})[coalesce(nullif(instr('{SYMBOLS}', substr(s, {t}, 1)), 0), {SYMBOLS.index('N') + 1})]"
    columns = ", ".join(f"s{j}" for j in k)
    ends = [f"s{j}" for j in k]
    return f""", seqs AS MATERIALIZED ({sequences}),
steps(key, s, n, t, back, {columns}) AS (
  SELECT key, s, length(s), 1::BIGINT, '', {", ".join(f"{number(start[j])} + e[{j + 1}]" for j in k)} FROM (SELECT *, {symbol("1")} AS e FROM seqs WHERE s <> '')
  UNION ALL
  SELECT key, s, n, t + 1, {backs}, {", ".join(f"greatest({', '.join(from_(j))}) + e[{j + 1}]" for j in k)} FROM (SELECT *, {symbol("t + 1")} AS e FROM steps WHERE t < n)),
ended AS (SELECT key, {first(ends, k)} AS last, greatest({", ".join(ends)}) AS log_probability FROM steps WHERE t = n),
ways AS (SELECT key, list(back ORDER BY t DESC) AS backs FROM steps WHERE t > 1 GROUP BY key),
decoded AS MATERIALIZED (SELECT key, list_reduce(list_prepend(last, coalesce(backs, [])), lambda path, b: substr(b, left(path, 1)::INT + 1, 1) || path) AS path, log_probability
  FROM ended LEFT JOIN ways USING (key))
"""


VITERBI = decoded("SELECT variant_id AS key, flank_1 || ref_allele || flank_2 AS s FROM v") + "SELECT key AS variant_id, path, round(log_probability, 6) AS log_probability FROM decoded"

# ---- motif profiles ----


def score_list(codes: str, m: motifs.Motif) -> str:
    """Scores of all windows; a window with an impossible symbol scores 0."""
    odds, void = m.odds()
    place = lambda k: "[" + ", ".join("NULL::DOUBLE" if void[k, i] else f"{float(odds[k, i])!r}::DOUBLE" for i in range(odds.shape[1])) + "]"
    total = " + ".join(f"({place(k)})[{codes}[i + {k}]]" for k in range(m.size))
    return f"list_transform(range(1, greatest(len({codes}) - {m.size - 1}, 0) + 1), lambda i: coalesce({total}, 0))"


def hit_list(scores: str, least: float) -> str:
    return f"list_filter(list_transform(range(1, len({scores}) + 1), lambda i: {{'place': i, 'score': {scores}[i]}}), lambda h: h.score >= {least!r})"


def cluster_sum(hits: str, far: int) -> str:
    a, b = f"{hits}[i]", f"{hits}[i + 1]"
    return f"coalesce(list_sum(list_transform(range(1, len({hits})), lambda i: CASE WHEN {b}.place - {a}.place BETWEEN 1 AND {far} THEN ({a}.score + {b}.score) / ({b}.place - {a}.place + 1) ELSE 0 END)), 0)"


def found_in(s: str, all_motifs: list[motifs.Motif], symbols: str, share: float, source: str, keep: str) -> str:
    """CTEs up to h: for each side the scores s_<motif>, the hits h_<motif> and the hits d_<domain> motif by motif."""
    code = f"list_transform(range(1, length({s}) + 1), lambda q: coalesce(nullif(instr('{symbols}', substr({s}, q, 1)), 0), {len(symbols) + 1}))"
    domains = dict.fromkeys(m.domain for m in all_motifs)
    return (
        f", coded AS MATERIALIZED (SELECT {keep}, {code} AS codes FROM {source})\n"
        + f", scores AS MATERIALIZED (SELECT {keep}, {', '.join(f'{score_list("codes", m)} AS s_{m.name}' for m in all_motifs)} FROM coded)\n"
        + f", hits AS MATERIALIZED (SELECT *, {', '.join(f'{hit_list(f"s_{m.name}", m.threshold(share))} AS h_{m.name}' for m in all_motifs)} FROM scores)\n"
        + f", h AS MATERIALIZED (SELECT *, {', '.join(f'flatten([{", ".join(f"h_{m.name}" for m in all_motifs if m.domain == d)}]) AS d_{d}' for d in domains)} FROM hits)\n"
    )


def shifts(names: dict[str, str], source: str) -> str:
    """Alternate less reference of named expressions, of which later ones may use earlier ones."""
    body = ", ".join(f'({x})::DOUBLE AS "{c}"' for c, x in names.items())
    return f', g AS MATERIALIZED (SELECT variant_id, side, {body} FROM {source})\nSELECT variant_id, {", ".join(f"""round(a."{c}" - r."{c}", 6) AS "{c}" """ for c in names)} FROM (FROM g WHERE side = \'r\') AS r JOIN (FROM g WHERE side = \'a\') AS a USING (variant_id)'


def dna_profile() -> str:
    radius, names = DEFAULT.motif_radius, {}
    window = f"(CASE WHEN length(flank_1) >= {radius} THEN right(flank_1, {radius}) ELSE right(flank_1, {radius} - length(flank_1)) END) || {{x}} || left(flank_2, {radius})"
    far = f"greatest(lead - (i - 1 + lead - {radius}), (i - 1 + lead - {radius}) - (lead + size), 0)"
    for domain, totals in motifs.TOTALS.items():
        mine = [m.name for m in motifs.DNA_MOTIFS if m.domain == domain]
        for m in motifs.DNA_MOTIFS:
            if m.domain == domain:
                names[f"{m.name}_count"] = f"len(s_{m.name})"
                names[f"{m.name}_score"] = f"coalesce(list_sum(list_transform(range(1, len(s_{m.name}) + 1), lambda i: s_{m.name}[i] * exp(-{far} * {far} / {2.0 * m.size**2!r}::DOUBLE))), 0)"
                names[f"{m.name}_cluster"] = cluster_sum(f"h_{m.name}", DEFAULT.dna_cluster)
        for what, c in zip(("count", "score", "cluster"), totals):
            names[c] = " + ".join(f'"{m}_{what}"' for m in mine)
        names[totals[3]] = cluster_sum(f"d_{domain}", DEFAULT.dna_cluster)
    for k, c in enumerate(motifs.ALL):
        names[c] = " + ".join(f'"{totals[k]}"' for totals in motifs.TOTALS.values())
    return sides(window) + found_in("s", motifs.DNA_MOTIFS, SYMBOLS, motifs.DNA_THRESHOLD, "w", "variant_id, side, size, lead") + shifts(names, "h")


def protein_profile() -> str:
    far, names = DEFAULT.protein_cluster, {}
    signals = {"nls": NUCLEAR_LOCALIZATION, "nes": NUCLEAR_EXPORT, "stat6": [motifs.STAT6]}
    place = lambda ps: f"list_filter(range(1, length(protein) + 1), lambda q: regexp_matches(substr(protein, q), '^(?:{'|'.join(f'(?:{p})' for p in ps)})'))"
    near = lambda x: f"len(list_filter(range(1, len({x})), lambda q: {x}[q + 1] - {x}[q] BETWEEN 1 AND {far}))"
    more = {"SH2": ("len(stat6)", near("stat6"), near("stat6")), "1433": ("0", "0", "0")}
    last = {"SH2": ("clusters_delta", "domain_cluster_score"), "1433": ("clusters_delta", "cluster_domain_delta")}
    for d in (*motifs.PTM, "SH2", "1433"):
        mine = [m.name for m in motifs.PROTEIN_MOTIFS if m.domain == d]
        cluster, whole = last.get(d, ("clusters_composite_delta", "domain_cluster_delta"))
        plus = more.get(d, ("0", "0", "0"))
        names[f"{d}_count_delta"] = " + ".join([f"len(s_{m})" for m in mine] + [plus[0]])
        names[f"{d}_score_delta"] = " + ".join([f"coalesce(list_sum(s_{m}), 0)" for m in mine] + [plus[1]])
        names[f"{d}_{cluster}"] = " + ".join([cluster_sum(f"h_{m}", far) for m in mine] + [plus[2]])
        names[f"{d}_{whole}"] = cluster_sum(f"d_{d}", far)
    names["Total_PTM_cluster_composite_delta"] = " + ".join(f'"{d}_clusters_composite_delta"' for d in motifs.PTM)
    names |= {"NLS_count_delta": "len(nls)", "NES_count_delta": "len(nes)", "Nuclear_Signal_delta": "len(nls) + len(nes)", "NLS_cluster_delta": near("nls"), "NES_cluster_delta": near("nes"), "Total_Nuclear_Cluster_delta": near("signals")}
    found = f", found AS (SELECT variant_id, side, protein, {', '.join(f'{place(ps)} AS {k}' for k, ps in signals.items())} FROM proteins), joined AS (SELECT *, list_concat(nls, nes) AS signals FROM found)\n"
    return FRAMES + found + found_in("protein", motifs.PROTEIN_MOTIFS, RESIDUES, motifs.PROTEIN_THRESHOLD, "joined", "variant_id, side, nls, nes, stat6, signals") + shifts(names, "h")


def pdz_profile() -> str:
    far, mine = DEFAULT.protein_cluster, [m.name for m in motifs.PDZ_MOTIFS]
    names = dict(zip(motifs.PDZ_FEATURES, (" + ".join(f"len(s_{m})" for m in mine), " + ".join(f"coalesce(list_sum(s_{m}), 0)" for m in mine), " + ".join(cluster_sum(f"h_{m}", far) for m in mine), cluster_sum("d_PDZ", far))))
    return FRAMES + found_in("protein", motifs.PDZ_MOTIFS, RESIDUES, motifs.PROTEIN_THRESHOLD, "proteins", "variant_id, side") + shifts(names, "h")
