"""Registered queries that go through files: what they read was written from the given tables, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.constants import IUPAC, RESIDUES, SYMBOLS
from ..operators import align, motifs
from ..scratch import new_path
from ..sources import genome, matrices, variant_fasta
from ..sources.variants import VARIANTS_SQL, fasta_text, from_orders
from . import features
from .base import FASTA_SQL, GENOME_SQL, placed_variants
from .sequence_sql import FRAMES, cluster_sum, hit_list, sides

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def on_variants(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(from_orders(spark, sf_dir))
        if oracle:
            ORACLES[name] = VARIANTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + oracle
        return f

    return register


#: So small that a file spans many splits, which begin within records and within variants.
SPLIT = 150_000


@on_variants("fasta_files", FASTA_SQL)
def _(v: DataFrame) -> DataFrame:
    """The variants written as FASTA files and read back, over many splits of each file."""
    path = new_path(v.sparkSession, "fasta")
    v.select(fasta_text()).write.text(path)
    return variant_fasta.read_variants(v.sparkSession, path, SPLIT)


@on_variants("indexed_context", "")
def _(v: DataFrame) -> DataFrame:
    """Context from genome files by their index, of which only the bytes around variants are read."""
    path = new_path(v.sparkSession, "genome")
    sequences, at = placed_variants(v)
    lines = F.rtrim(F.regexp_replace("sequence", "(.{60})", "$1\n"))
    sequences.select(F.concat(F.lit(">"), "accession", F.lit(" a sequence\n"), lines)).write.text(path)
    index = genome.genome_index(v.sparkSession, path, SPLIT)
    return genome.with_context(at, index, path, 50).select("variant_id", "position", "flank_1", "flank_2", "ref_matches")


ORACLES["indexed_context"] = VARIANTS_SQL + ", " + GENOME_SQL[5:]


# ---- motifs of matrix files ----

PLACES = 5
DOMAIN_OF = {1: "init", 2: "init", 3: "TF", 4: "TF", 5: "PTR"}


def part_matrices(spark, sf_dir: str) -> DataFrame:
    """(domain, name, text): a matrix for each of five groups of parts, from how its parts' keys are spread over remainders."""
    n = [F.count_if(F.col("p_partkey") % 4 == i) / F.count("*") for i in range(4)]
    maker = (F.floor(F.col("p_partkey") / 4) % 5 + 1).cast("int").alias("maker")
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(maker, (F.col("p_size") % PLACES).alias("pos")).agg(F.concat_ws("  ", *[x.cast("string") for x in n]).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))  # PLACES lines
    text = F.concat_ws("\n", F.transform(ordered, lambda x: x["line"]))
    domain = F.create_map(*[F.lit(x) for pair in DOMAIN_OF.items() for x in pair])
    return lines.groupBy("maker").agg(text.alias("text")).select(domain[F.col("maker")].alias("domain"), F.concat(F.lit("m"), F.col("maker").cast("string")).alias("name"), "text")


def write_matrices(table: DataFrame, folder: str) -> None:
    """A file of text for each matrix of (domain, name, text), in folders of its domain and its name."""
    table.repartition("domain", "name").write.partitionBy("domain", "name").text(folder)


_all = ", ".join(f"('m{k}', '{d}')" for k, d in DOMAIN_OF.items())
_p = lambda s: " + ".join(f"(p{'ACGT'.index(b) + 1})" for b in IUPAC[s])
_odds = ", ".join(f"CASE WHEN ({_p(s)}) <= 0 THEN NULL ELSE log2(({_p(s)}) / {len(IUPAC[s])} / 0.25) END" for s in SYMBOLS)
_clip = [f"log2(greatest(p{i}, 1e-10) / 0.25)" for i in range(1, 5)]
_radius = DEFAULT.motif_radius
_window = f"(CASE WHEN length(flank_1) >= {_radius} THEN right(flank_1, {_radius}) ELSE right(flank_1, {_radius} - length(flank_1)) END) || {{x}} || left(flank_2, {_radius})"
_far = f"greatest(lead - (i - 1 + lead - {_radius}), (i - 1 + lead - {_radius}) - (lead + size), 0)"
_total = " + ".join(f"odds[{k + 1}][codes[i + {k}]]" for k in range(PLACES))
_value = lambda what, where: f"coalesce(sum({what}) FILTER (side = 'a' AND {where}), 0) - coalesce(sum({what}) FILTER (side = 'r' AND {where}), 0)"
_of_domain = {d: f"domain = '{d}'" for d in sorted(set(DOMAIN_OF.values()))}
_columns = {f"m{k}_{w}": _value(w, f"motif = 'm{k}'") for k in DOMAIN_OF for w in ("count", "score", "cluster")}
for _d, _where in _of_domain.items():
    _names = motifs.domain_names(_d)
    _columns |= {c: _value(w, _where) for c, w in zip(_names, ("count", "score", "cluster"))} | {_names[3]: f"max(w_{_d}) FILTER (side = 'a') - max(w_{_d}) FILTER (side = 'r')"}
_columns |= {c: _value(w, "true") for c, w in zip(motifs.ALL, ("count", "score", "cluster"))}
_columns[motifs.ALL[3]] = " + ".join(f"max(w_{d}) FILTER (side = 'a') - max(w_{d}) FILTER (side = 'r')" for d in _of_domain)
MATRIX_SQL = (
    sides(_window)
    + f""", cells AS (SELECT 'm' || (p_partkey // 4 % 5 + 1) AS motif, p_size % {PLACES} AS pos, {", ".join(f"count(*) FILTER (p_partkey % 4 = {i}) / count(*) AS p{i + 1}" for i in range(4))} FROM part GROUP BY ALL),
mats AS MATERIALIZED (SELECT motif, domain, list([{_odds}] ORDER BY pos) AS odds, sum(least({", ".join(_clip)})) AS low, sum(greatest({", ".join(_clip)})) AS high
  FROM cells JOIN (VALUES {_all}) AS d(motif, domain) USING (motif) GROUP BY ALL),
coded AS MATERIALIZED (SELECT variant_id, side, size, lead, list_transform(range(1, length(s) + 1), lambda q: instr('{SYMBOLS}', substr(s, q, 1))) AS codes FROM w),
scored AS (SELECT variant_id, side, size, lead, motif, domain, low + {motifs.DNA_THRESHOLD} * (high - low) AS least,
  list_transform(range(1, greatest(len(codes) - {PLACES - 1}, 0) + 1), lambda i: coalesce({_total}, 0)) AS s FROM coded, mats),
h AS MATERIALIZED (SELECT variant_id, side, motif, domain, len(s) AS count, {hit_list("s", "LEAST").replace("'LEAST'", "least")} AS hits,
  coalesce(list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i] * exp(-{_far} * {_far} / {2.0 * PLACES**2!r}::DOUBLE))), 0) AS score FROM scored),
f AS (SELECT *, {cluster_sum("hits", DEFAULT.dna_cluster)} AS cluster FROM h),
j AS (SELECT variant_id, side, {", ".join(f"flatten(list(hits ORDER BY motif) FILTER (domain = '{d}')) AS all_{d}" for d in _of_domain)} FROM h GROUP BY ALL),
k AS (SELECT variant_id, side, {", ".join(f"{cluster_sum(f'all_{d}', DEFAULT.dna_cluster)} AS w_{d}" for d in _of_domain)} FROM j),
g AS (SELECT f.*, {", ".join(f"w_{d}" for d in _of_domain)} FROM f JOIN k USING (variant_id, side))
SELECT variant_id, {", ".join(f'round(({x})::DOUBLE, 6) AS "{c}"' for c, x in _columns.items())} FROM g GROUP BY variant_id"""
)


def matrix_profile(spark, sf_dir: str) -> DataFrame:
    """The motif profile by matrices read from files, whose domains come with them."""
    folder = new_path(spark, "matrices")
    write_matrices(part_matrices(spark, sf_dir), folder)
    found = matrices.read_motifs(spark, folder)
    v = from_orders(spark, sf_dir)
    made = v.select("variant_id", motifs.dna_motifs(F.col("ref_allele"), F.col("alt_allele"), F.col("flank_1"), F.col("flank_2"), found).alias("m")).select("variant_id", "m.*")
    return made.select("variant_id", *[F.round(f"`{c}`", 6).alias(c) for c in made.columns[1:]])


QUERIES["matrix_profile"] = matrix_profile
ORACLES["matrix_profile"] = VARIANTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + MATRIX_SQL


# ---- protein alignment by a matrix file ----


def similarity_lines(spark) -> DataFrame:
    """The substitution matrix by rule, as the text of a matrix file in one partition."""
    scores = align.similarity()
    lines = ["# by rule", "  " + " ".join(RESIDUES)] + [f"{a} " + " ".join(str(scores[a, b]) for b in RESIDUES) for a in RESIDUES]
    return spark.createDataFrame(list(enumerate(lines)), "i int, value string").coalesce(1).sortWithinPartitions("i").select("value")


def protein_aligned(v: DataFrame) -> DataFrame:
    """Alignment features of both proteins, by a matrix read from a file."""
    path = new_path(v.sparkSession, "substitutions")
    similarity_lines(v.sparkSession).write.text(path)
    scores = matrices.read_substitutions(v.sparkSession, path)
    p = features.with_proteins(v)
    return p.select("variant_id", align.protein_alignments(F.col("ref_orf.protein"), F.col("alt_orf.protein"), scores).alias("a")).select("variant_id", "a.*")


_gap = DEFAULT.protein_gap
_scores = "[" + ", ".join(str(align.similarity()[a, b]) for a in RESIDUES for b in RESIDUES) + "]"
_letters = lambda s: f"list_transform(range(1, length({s}) + 1), lambda q: coalesce(nullif(instr('{RESIDUES}', substr({s}, q, 1)), 0), -999))"
_cell = "{{'s': ({s})::INT, 'e': ({e})::INT, 'z': ({z})::INT}}".format
_from = lambda cell, s, e: _cell(s=f"{cell}.s + {s}", e=f"{cell}.e + {e}", z=f"{cell}.z + 1")
_sub = f"coalesce({_scores}[(x[i] - 1) * {len(RESIDUES)} + y[d + 1 - i]], {_gap})"
# a table is filled by its falling diagonals: the cells of one need those of the last two only; a cell is its score,
# the matches and the steps of the way to it
PROTEIN_SQL = (
    FRAMES
    + f""", both_proteins AS (SELECT r.variant_id, r.protein AS a, t.protein AS b FROM (FROM proteins WHERE side = 'r') AS r JOIN (FROM proteins WHERE side = 'a') AS t USING (variant_id)),
pairs AS (SELECT DISTINCT a, b, length(a) AS m, length(b) AS n, {_letters("a")} AS x, {_letters("b")} AS y FROM both_proteins),
grow(a, b, m, n, x, y, d, last, before, l_last, l_before, best) AS (
  SELECT a, b, m, n, x, y, 0::BIGINT, list_transform(range(0, m + 1), lambda i: CASE WHEN i = 0 THEN {_cell(s=0, e=0, z=0)} END), list_transform(range(0, m + 1), lambda i: CASE WHEN i < 0 THEN {_cell(s=0, e=0, z=0)} END),
    list_transform(range(0, m + 1), lambda i: 0), list_transform(range(0, m + 1), lambda i: 0), 0 FROM pairs
  UNION ALL
  SELECT a, b, m, n, x, y, d + 1, list_transform(range(0, m + 1), lambda i: CASE
      WHEN i > d + 1 OR d + 1 - i > n THEN NULL
      WHEN i = 0 THEN {_cell(s=f"{_gap} * (d + 1)", e=0, z="d + 1")}
      WHEN i = d + 1 THEN {_cell(s=f"{_gap} * i", e=0, z="i")}
      WHEN last[i + 1].s + {_gap} >= greatest(last[i].s + {_gap}, before[i].s + {_sub}) THEN {_from("last[i + 1]", _gap, 0)}
      WHEN last[i].s + {_gap} >= before[i].s + {_sub} THEN {_from("last[i]", _gap, 0)}
      ELSE {_from("before[i]", _sub, "(substr(a, i, 1) = substr(b, d + 1 - i, 1))::INT")} END), last,
    local, l_last, greatest(best, list_max(local))
  FROM (SELECT *, list_transform(range(0, m + 1), lambda i: CASE WHEN i = 0 OR i >= d + 1 OR d + 1 - i > n THEN 0
      ELSE greatest(0, l_last[i + 1] + {_gap}, l_last[i] + {_gap}, l_before[i] + {_sub}) END) AS local FROM grow WHERE d < m + n)),
done AS (SELECT a, b, last[m + 1] AS c, best FROM grow WHERE d = m + n)
"""
)


@on_variants("nw_protein", PROTEIN_SQL + "SELECT variant_id, c.s AS AA_Global_score, round(100.0 * c.e / greatest(c.z, 1), 6)::DOUBLE AS AA_Global_pct FROM both_proteins JOIN done USING (a, b)")
def _(v):
    return protein_aligned(v).select("variant_id", "AA_Global_score", F.round("AA_Global_pct", 6).alias("AA_Global_pct"))


@on_variants("sw_protein", PROTEIN_SQL + "SELECT variant_id, best::INT AS AA_Local_score FROM both_proteins JOIN done USING (a, b)")
def _(v):
    return protein_aligned(v).select("variant_id", "AA_Local_score")
