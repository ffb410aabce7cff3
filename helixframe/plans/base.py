"""Registered queries over the etl, dna, protein, motif and path functions, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, motif, paths, protein
from ..functions.constants import CODONS, GENE_DENSITY, HELIX, INTRON, NUCLEAR_EXPORT, NUCLEAR_LOCALIZATION, POLY_TRACTS, PROPERTIES, RESIDUES, SHEET, START, STOP, SUBGROUPS, TURN, stacking_energies
from ..operators import motifs, orf
from ..operators.motifs import DNA_MOTIFS, PROTEIN_MOTIFS, PROTEIN_THRESHOLD
from ..operators.structure import duplications, entropy_delta, tandem_units
from ..operators.viterbi import viterbi
from ..sources import fasta, matrices
from ..sources.variants import CLINICAL_COLUMNS, VARIANTS_SQL, chromosome_number, clinical_filter, drop_literal_na, from_orders, label
from .sequence_sql import REPEAT_RUNS, decoded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, variants: bool = True):
    """Register a function of the variants (or of spark and the folder) and its oracle, which may use the CTE v."""

    def register(f):
        QUERIES[name] = (lambda spark, sf_dir: f(from_orders(spark, sf_dir))) if variants else f
        if oracle:
            ORACLES[name] = (VARIANTS_SQL + (", " + oracle[5:] if oracle.startswith("WITH ") else oracle)) if variants else oracle
        return f

    return register


def on_variants(name: str, columns, sql: dict[str, str], extra: str = "v"):
    """Register variant_id and some columns, rounded where they are not whole, beside SQL for the same."""
    body = ", ".join(f"{x} AS {c}" for c, x in sql.items())

    @query(name, f"SELECT variant_id, {body} FROM {extra}")
    def run(v: DataFrame) -> DataFrame:
        return v.select("variant_id", *[x.alias(c) for c, x in columns().items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ref, alt, left, right = "ref_allele", "alt_allele", "flank_1", "flank_2"
c = lambda name: F.col(name)
r6 = lambda x: F.round(x, 6)


# ---- sources, projections and filters ----

RAW_SQL = """WITH raw AS (SELECT CASE WHEN variant_id % 9 = 0 THEN 'GRCh37' ELSE 'GRCh38' END AS "Assembly",
    CASE chromosome WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE chromosome::VARCHAR END || CASE WHEN variant_id % 31 = 0 THEN 'MT' WHEN variant_id % 37 = 0 THEN '_Un' ELSE '' END AS "Chromosome",
    'NC_' || chromosome AS "ChromosomeAccession", variant_id AS "PositionVCF", CASE WHEN variant_id % 11 = 0 THEN 'NA' ELSE ref_allele END AS "ReferenceAlleleVCF",
    CASE WHEN variant_id % 13 = 0 THEN NULL ELSE alt_allele END AS "AlternateAlleleVCF", clinical_significance AS "ClinicalSignificance" FROM v)
"""


def raw_clinical(v: DataFrame) -> DataFrame:
    """A clinical table as it might be read: with other assemblies, unplaced chromosomes, `NA` cells and nulls."""
    k = c("variant_id")
    number = F.when(c("chromosome") == 23, "X").when(c("chromosome") == 24, "Y").otherwise(c("chromosome").cast("string"))
    return v.select(
        F.when(k % 9 == 0, "GRCh37").otherwise("GRCh38").alias("Assembly"),
        F.concat(number, F.when(k % 31 == 0, "MT").when(k % 37 == 0, "_Un").otherwise("")).alias("Chromosome"),
        F.concat(F.lit("NC_"), c("chromosome").cast("string")).alias("ChromosomeAccession"), k.alias("PositionVCF"),
        F.when(k % 11 == 0, "NA").otherwise(c(ref)).alias("ReferenceAlleleVCF"), F.when(k % 13 != 0, c(alt)).alias("AlternateAlleleVCF"),
        c("clinical_significance").alias("ClinicalSignificance"),
    )


NOT_NA = " AND ".join(f"""lower("{x}") <> 'na'""" for x in CLINICAL_COLUMNS if x != "PositionVCF")


@query("clinical_filter", RAW_SQL + f"""SELECT * FROM raw WHERE {NOT_NA} AND "Chromosome" NOT LIKE '%MT%' AND "Chromosome" NOT LIKE '%Un%'
  AND "Assembly" NOT LIKE '%GRCh37%' AND "ClinicalSignificance" IN ('Pathogenic', 'Benign')""")
def _(v):
    return clinical_filter(raw_clinical(v))


@query("literal_na_filter", RAW_SQL + f"SELECT * FROM raw WHERE {NOT_NA}")
def _(v):
    return drop_literal_na(raw_clinical(v))


on_variants("label_recode", lambda: {"label": label(c("clinical_significance"))}, {"label": "CASE clinical_significance WHEN 'Benign' THEN 0 WHEN 'Pathogenic' THEN 1 END"})


@query("chrom_recode", RAW_SQL + """SELECT "PositionVCF", CASE "Chromosome" WHEN 'X' THEN 23 WHEN 'Y' THEN 24 ELSE try_cast("Chromosome" AS INT) END AS chromosome FROM raw""")
def _(v):
    return raw_clinical(v).select("PositionVCF", chromosome_number(c("Chromosome")).alias("chromosome"))


@query("numeric_coerce", "SELECT event_id, try_cast(regexp_extract(props, '[-0-9.]+', 0) AS DOUBLE) AS number, try_cast(event_type AS DOUBLE) AS none FROM events", variants=False)
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", "[-0-9.]+", 0).try_cast("double").alias("number"), c("event_type").try_cast("double").alias("none"))


@query("projection_dedupe", "SELECT DISTINCT ref_allele, alt_allele, chromosome FROM v")
def _(v):
    return v.select(ref, alt, "chromosome").dropDuplicates()


@query("threshold_classify", "SELECT l_orderkey, l_linenumber, l_discount * 10 AS p, (l_discount * 10 >= 0.513)::INT AS predicted FROM lineitem", variants=False)
def _(spark, sf_dir):
    from .learning import classify

    return classify(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_discount") * 10).alias("p")), "p").select("l_orderkey", "l_linenumber", "p", "predicted")


FASTA_SQL = "SELECT 'v' || variant_id AS name, chromosome, ref_allele, alt_allele, flank_1, flank_2, 'N/A' AS clinical_significance FROM v"


@query("fasta_parse", FASTA_SQL)
def _(v):
    """The variants as FASTA text, flanks before alleles, read back."""
    tags = [("flank_2", right), ("alt", alt), ("flank1", left), ("ref", ref)]
    text = [
        F.concat(F.lit("chr"), c("chromosome").cast("string"), F.lit(f"|{tag}|v"), c("variant_id").cast("string"), F.lit("\n"), F.left(c(col), F.lit(60)), F.lit("\n"), F.lower(F.substr(c(col), F.lit(61))), F.lit("\n"))
        for tag, col in tags
    ]
    raw = v.select("variant_id", F.posexplode(F.array(*text)).alias("i", "value")).select((c("variant_id") * 4 + c("i")).alias("seq"), "value")
    return fasta.parse_variants(fasta.split_records(raw))


GENOME_SQL = """WITH genome AS (SELECT variant_id // 64 AS accession, string_agg(flank_1, '' ORDER BY variant_id) AS sequence FROM v GROUP BY ALL),
placed AS (SELECT variant_id, sequence, length(sequence) AS total, 1 + (variant_id * 7919) % length(sequence) AS position, length(ref_allele) AS n, ref_allele FROM v JOIN genome ON variant_id // 64 = accession),
spans AS (SELECT *, greatest(1, position - 50) AS s1, greatest(greatest(1, position - 50), position - 1) AS e1, least(total, position + n) AS s2,
  least(total, greatest(least(total, position + n), least(total, position + n + 49))) AS e2 FROM placed)
SELECT variant_id, position, substr(sequence, s1, e1 - s1 + 1) AS flank_1, substr(sequence, s2, e2 - s2 + 1) AS flank_2, substr(sequence, position, n) = ref_allele AS ref_matches FROM spans"""


def placed_variants(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((accession, sequence), variants with an accession and a position): an accession for each 64 keys."""
    own = F.floor(c("variant_id") / 64).cast("string").alias("accession")
    pieces = F.array_sort(F.collect_list(F.struct("variant_id", left)))  # 64 at most
    genome = v.groupBy(own).agg(F.array_join(F.transform(pieces, lambda x: x[left]), "").alias("sequence"))
    sizes = genome.select("accession", F.length("sequence").alias("size"))
    return genome, v.select("variant_id", own, ref).join(sizes, "accession").select("variant_id", "accession", (1 + c("variant_id") * 7919 % c("size")).alias("position"), ref)


@query("flank_extract", GENOME_SQL)
def _(v):
    """Context from a genome of one accession for each 64 keys, cut in chunks."""
    genome, at = placed_variants(v)
    return fasta.with_context(at, fasta.chunks(genome, 1000), 50, 1000).select("variant_id", "position", left, right, "ref_matches")


@query("pwm_parse", """WITH lines AS (SELECT p_brand AS motif, p_size AS pos, count(*) FILTER (WHERE p_partkey % 4 = 0) AS a, count(*) FILTER (WHERE p_partkey % 4 = 1) AS c,
  count(*) FILTER (WHERE p_partkey % 4 = 2) AS g, count(*) FILTER (WHERE p_partkey % 4 = 3) AS t, count(*) AS n FROM part GROUP BY ALL),
cells AS (SELECT motif, pos, unnest(['A', 'C', 'G', 'T']) AS symbol, unnest([a / n, c / n, g / n, t / n]) AS p FROM lines)
SELECT motif, pos, symbol, round(p, 6) AS p FROM cells""", variants=False)
def _(spark, sf_dir):
    """Matrix text made of each brand's parts of each size, read back."""
    return matrices.parse_pwm(part_matrices(spark, sf_dir)).withColumn("p", r6(c("p")))


def part_matrices(spark, sf_dir) -> DataFrame:
    n = [F.count_if(c("p_partkey") % 4 == i) / F.count("*") for i in range(4)]
    return table(spark, sf_dir, "part").groupBy(c("p_brand").alias("motif"), c("p_size").alias("pos")).agg(F.concat_ws("  ", *[x.cast("string") for x in n]).alias("line"))


@query("pwm_threshold", """WITH cells AS (SELECT p_brand AS motif, p_size AS pos, (p_partkey % 4) AS symbol, count(*) AS k FROM part GROUP BY ALL),
full_ AS (SELECT x.motif, x.pos, s.symbol, coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY x.motif, x.pos) AS p FROM (SELECT DISTINCT motif, pos FROM cells) x CROSS JOIN range(4) s(symbol) LEFT JOIN cells USING (motif, pos, symbol)),
ends AS (SELECT motif, pos, min(log2(greatest(p, 1e-10) * 4)) AS low, max(log2(greatest(p, 1e-10) * 4)) AS high FROM full_ GROUP BY ALL)
SELECT motif, round(sum(low) + 0.9 * (sum(high) - sum(low)), 6) AS threshold FROM ends GROUP BY motif""", variants=False)
def _(spark, sf_dir):
    return matrices.thresholds(matrices.parse_pwm(part_matrices(spark, sf_dir)), 0.9).withColumn("threshold", r6(c("threshold")))


@query("submat_parse", """WITH n AS (SELECT s_nationkey % 4 AS f, s_suppkey % 4 AS s, count(*) AS k FROM supplier GROUP BY ALL)
SELECT substr('ACGT', (f.i + 1)::INT, 1) AS first, substr('ACGT', (s.i + 1)::INT, 1) AS second, coalesce(k, 0)::INT AS score FROM range(4) f(i) CROSS JOIN range(4) s(i) LEFT JOIN n ON n.f = f.i AND n.s = s.i""", variants=False)
def _(spark, sf_dir):
    """A matrix text of suppliers by remainders of their keys, read back."""
    n = [F.count_if(c("s_suppkey") % 4 == i).cast("string") for i in range(4)]
    lines = table(spark, sf_dir, "supplier").groupBy(F.substr(F.lit("ACGT"), (c("s_nationkey") % 4 + 1).cast("int"), F.lit(1)).alias("first")).agg(F.concat_ws(" ", *n).alias("line"))
    return matrices.parse_substitutions(lines, "ACGT")


@query("profile_concat", "SELECT variant_id, length(ref_allele) AS ref_length, length(alt_allele) AS alt_length FROM v")
def _(v):
    """Two profiles of the same variants, joined by key instead of position."""
    a, b = v.select("variant_id", F.length(ref).alias("ref_length")), v.select("variant_id", F.length(alt).alias("alt_length"))
    return a.join(b, "variant_id")


# ---- DNA ----

DENSITY_SQL = "MAP {" + ", ".join(f"{k}: {v}::DOUBLE" for k, v in GENE_DENSITY.items()) + "}"
ENERGY_SQL = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in stacking_energies().items()) + "}"
energy = lambda s: f"coalesce(list_sum(list_transform(range(1, length({s})), lambda i: ({ENERGY_SQL})[substr({s}, i::INT, 2)])), 0)"
gc = lambda s: f"((length({s}) - length(translate({s}, 'GC', ''))) / length({s}))"
cpg = lambda s: f"(len(regexp_extract_all({s}, 'CG')) / greatest(length({s}) - 1, 1))"
window_sql = lambda s: f"(right(flank_1, 100) || {s} || left(flank_2, 100))"
window = lambda s: dna.buffered(c(s), c(left), c(right))

on_variants("density_lookup", lambda: {"density": dna.gene_density(c("chromosome"))}, {"density": f"({DENSITY_SQL})[chromosome]"})
LENGTH_SQL = "(length(alt_allele) - length(ref_allele)) / length(ref_allele) * 100 * CASE WHEN abs(length(alt_allele) - length(ref_allele)) % 3 <> 0 THEN 2 ELSE 1 END"
on_variants("len_change", lambda: {"change": r6(dna.length_change(c(ref), c(alt)))}, {"change": f"round({LENGTH_SQL}, 6)"})
on_variants("gc_context", lambda: {"change": r6(dna.gc_context(c(ref), c(alt)))}, {"change": f"round({gc('alt_allele')} - {cpg('ref_allele')} + {cpg('alt_allele')} - {cpg('ref_allele')}, 6)"})
on_variants("cpg_content", lambda: {"ref_cpg": r6(dna.cpg_fraction(window(ref))), "alt_cpg": r6(dna.cpg_fraction(window(alt)))}, {"ref_cpg": f"round({cpg(window_sql(ref))}, 6)", "alt_cpg": f"round({cpg(window_sql(alt))}, 6)"})
on_variants("thermo_delta", lambda: {"delta": r6(dna.stacking_energy(c(alt)) - dna.stacking_energy(c(ref)))}, {"delta": f"round({energy('alt_allele')} - {energy('ref_allele')}, 6)"})
for _name, _pattern in (("start_codon_delta", START), ("stop_codon_delta", STOP), ("poly_tract_delta", POLY_TRACTS), ("intron_delta", INTRON)):
    on_variants(_name, lambda p=_pattern: {"delta": dna.count_delta(window(ref), window(alt), p).cast("long")}, {"delta": f"len(regexp_extract_all({window_sql(alt)}, '{_pattern}')) - len(regexp_extract_all({window_sql(ref)}, '{_pattern}'))"})
on_variants("revcomp", lambda: {"back": dna.reverse_complement(F.concat(left, ref, right))}, {"back": "reverse(translate(flank_1 || ref_allele || flank_2, 'ATCG', 'TAGC'))"})

KMER_SQL = """WITH sides AS (SELECT variant_id, 'ref' AS side, ref_allele AS s FROM v UNION ALL SELECT variant_id, 'alt', alt_allele FROM v),
kmers AS (SELECT variant_id, side, unnest(flatten(list_transform(range(2, 8), lambda k: list_transform(range(1, greatest(length(s) - k + 2, 1)), lambda i: substr(s, i::INT, k::INT))))) AS kmer FROM sides),
counts AS (SELECT variant_id, side, kmer, count(*) AS n FROM kmers GROUP BY ALL)
"""


def kmer_counts(v: DataFrame) -> DataFrame:
    sides = F.array(F.struct(F.lit("ref").alias("side"), c(ref).alias("s")), F.struct(F.lit("alt").alias("side"), c(alt).alias("s")))
    exploded = v.select("variant_id", F.explode(sides).alias("x")).select("variant_id", "x.side", F.explode(dna.kmers(c("x.s"))).alias("kmer"))
    return exploded.groupBy("variant_id", "side", "kmer").agg(F.count("*").alias("n"))


@query("kmer_counts", KMER_SQL + "SELECT side, kmer, sum(n)::BIGINT AS n FROM counts GROUP BY ALL")
def _(v):
    return kmer_counts(v).groupBy("side", "kmer").agg(F.sum("n").alias("n"))


@query("kmer_entropy_delta", KMER_SQL + """, t AS (SELECT *, n / sum(n) OVER (PARTITION BY variant_id, side) AS p FROM counts), e AS (SELECT variant_id, -sum(CASE side WHEN 'alt' THEN p * log2(p) ELSE -p * log2(p) END) AS delta FROM t GROUP BY ALL)
SELECT v.variant_id, round(coalesce(delta, 0), 6) + 0.0 AS delta FROM v LEFT JOIN e USING (variant_id)""")
def _(v):
    return v.select("variant_id", (r6(entropy_delta(ref, alt)) + 0.0).alias("delta"))


@query("tandem_duplications", f"""WITH w AS (SELECT variant_id, {window_sql(ref)} AS r, {window_sql(alt)} AS a FROM v)
SELECT variant_id, len(list_filter(list_distinct(flatten(list_transform(range(2, 11), lambda k: list_transform(list_filter(range(1, greatest(length(a) - 2 * k + 2, 1)), lambda i: substr(a, i::INT, k::INT) = substr(a, (i + k)::INT, k::INT)), lambda i: substr(a, i::INT, k::INT))))), lambda u: NOT contains(r, u))) AS duplications FROM w""")
def _(v):
    w = v.select("variant_id", window(ref).alias("r"), window(alt).alias("a"))
    return w.select("variant_id", duplications(c("r"), c("a")).cast("long").alias("duplications"))


# ---- repeats: units and their bases as arrays of a row ----


def over_runs(text: str) -> str:
    """SQL over the runs of both windows."""
    return "WITH " + REPEAT_RUNS[2:] + text


def repeat_units(v: DataFrame) -> DataFrame:
    """variant_id and the runs of both windows, `r` and `a`: maps from unit to bases."""
    units = lambda s: F.map_from_entries(tandem_units(window(s)))
    return v.select("variant_id", units(ref).alias("r"), units(alt).alias("a"))


@query("tandem_repeats", over_runs("SELECT variant_id, CASE side WHEN 'r' THEN 'ref' ELSE 'alt' END AS side, unit, n::BIGINT AS bases FROM runs"))
def _(v):
    sides = F.array(F.struct(F.lit("ref").alias("side"), c("r").alias("units")), F.struct(F.lit("alt").alias("side"), c("a").alias("units")))
    rows = repeat_units(v).select("variant_id", F.explode(sides).alias("x"))
    return rows.select("variant_id", "x.side", F.explode("x.units").alias("unit", "bases"))


@query("repeat_sets", over_runs("""SELECT variant_id, count(*) FILTER (unit IS NOT NULL AND after IS NULL) AS lost, count(*) FILTER (unit IS NOT NULL AND before IS NULL) AS gained, count(*) FILTER (before IS NOT NULL AND after IS NOT NULL) AS shared
  FROM v LEFT JOIN (SELECT variant_id, k AS unit, before, after FROM both_sides) USING (variant_id) GROUP BY variant_id"""))
def _(v):
    r, a = F.map_keys("r"), F.map_keys("a")
    sizes = {"lost": F.array_except(r, a), "gained": F.array_except(a, r), "shared": F.array_intersect(r, a)}
    return repeat_units(v).select("variant_id", *[F.size(x).cast("long").alias(k) for k, x in sizes.items()])


@query("repeat_instability", over_runs("""SELECT variant_id, (count(after) - count(before))::BIGINT AS microsatellites,
  coalesce(sum(CASE WHEN unit IS NOT NULL THEN coalesce(after, 0) - coalesce(before, 0) + 2 * CASE WHEN after IS NULL THEN before ELSE 0 END END), 0)::BIGINT AS base_composite,
  coalesce(sum(greatest(after - before, 0)) FILTER (before IS NOT NULL AND after IS NOT NULL), 0)::BIGINT AS expansion, coalesce(sum(greatest(before - after, 0)) FILTER (before IS NOT NULL AND after IS NOT NULL), 0)::BIGINT AS contraction,
  coalesce(count(unit) FILTER (before IS NULL OR after IS NULL) + sum(unit * abs(coalesce(after, 0) - coalesce(before, 0))), 0)::BIGINT AS composite
  FROM v LEFT JOIN (SELECT variant_id, k AS unit, before, after FROM both_sides) USING (variant_id) GROUP BY variant_id"""))
def _(v):
    units = F.array_union(F.map_keys("r"), F.map_keys("a"))
    pairs = F.transform(units, lambda u: F.struct(F.length(u).cast("long").alias("k"), F.try_element_at("r", u).alias("before"), F.try_element_at("a", u).alias("after")))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    both = lambda p: p["before"].isNotNull() & p["after"].isNotNull()
    shift = lambda p: zero(p["after"]) - zero(p["before"])
    total = lambda f: F.aggregate("pairs", F.lit(0).cast("long"), lambda t, p: t + f(p))
    return repeat_units(v).select("variant_id", "r", "a", pairs.alias("pairs")).select(
        "variant_id", (F.size("a") - F.size("r")).cast("long").alias("microsatellites"),
        total(lambda p: shift(p) + 2 * F.when(p["after"].isNull(), p["before"]).otherwise(0)).alias("base_composite"),
        total(lambda p: F.when(both(p), F.greatest(shift(p), F.lit(0))).otherwise(0)).alias("expansion"),
        total(lambda p: F.when(both(p), F.greatest(-shift(p), F.lit(0))).otherwise(0)).alias("contraction"),
        total(lambda p: F.when(both(p), 0).otherwise(1) + p["k"] * F.abs(shift(p))).alias("composite"),
    )


FI_SQL = f"(({energy('alt_allele')} - {energy('ref_allele')}) * ({DENSITY_SQL})[chromosome])"
on_variants(
    "dna_feature_interactions",
    lambda: {
        "relative_length": r6(dna.length_change(c(ref), c(alt)) / dna.gene_density(c("chromosome"))),
        "relative_stability": r6((dna.stacking_energy(c(alt)) - dna.stacking_energy(c(ref))) * dna.gene_density(c("chromosome"))),
    },
    {"relative_length": f"round({LENGTH_SQL} / ({DENSITY_SQL})[chromosome], 6)", "relative_stability": f"round({FI_SQL}, 6)"},
)

# ---- proteins ----

CODON_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CODONS.items()) + "}"
frame_sql = lambda s: f"regexp_extract(regexp_replace(array_to_string(list_transform(range(0, length({s}) // 3), lambda i: coalesce(({CODON_SQL})[substr({s}, (3 * i + 1)::INT, 3)], 'X')), ''), '^_+', ''), '^[^_]*')"
PROTEIN_SQL = f"WITH p AS (SELECT variant_id, {frame_sql('(ref_allele || flank_2)')} AS r, {frame_sql('(alt_allele || flank_2)')} AS a FROM v)\n"


def proteins(v: DataFrame) -> DataFrame:
    """First-frame proteins of both alleles with what follows them."""
    whole = v.select("variant_id", F.concat(ref, right).alias("rs"), F.concat(alt, right).alias("as"))
    return whole.select("variant_id", orf.first_frames(c("rs"))["protein"].alias("r"), orf.first_frames(c("as"))["protein"].alias("a"))


@query("translate_frame0", PROTEIN_SQL + "SELECT * FROM p")
def _(v):
    return proteins(v)


sum_sql = lambda s, name: f"coalesce(list_sum(list_transform(range(1, length({s}) + 1), lambda i: coalesce((MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {float(x)}::DOUBLE' for k, x in zip(RESIDUES, PROPERTIES[name]))}}})[substr({s}, i::INT, 1)], 0))), 0)"
share_sql = lambda s, x: f"CASE WHEN length({s}) > 0 THEN (length({s}) - length(translate({s}, '{x}', ''))) / length({s}) ELSE 0 END"


@query("aa_property_deltas", PROTEIN_SQL + "SELECT variant_id, " + ", ".join(f"round({sum_sql('a', k)} - {sum_sql('r', k)}, 6) AS {k.lower()}" for k in PROPERTIES) + " FROM p")
def _(v):
    return proteins(v).select("variant_id", *[r6(protein.property_sum(c("a"), k) - protein.property_sum(c("r"), k)).alias(k.lower()) for k in PROPERTIES])


aliphatic_sql = lambda s: f"100 * ({share_sql(s, 'A')} + 2.9 * {share_sql(s, 'V')} + 3.9 * {share_sql(s, 'IL')})"
structure_sql = lambda s: " + ".join(share_sql(s, x) for x in (HELIX, TURN, SHEET))
for _name, _f, _sql in (
    ("aliphatic_delta", protein.aliphatic_index, aliphatic_sql),
    ("proline_delta", protein.prolines, lambda s: f"(length({s}) - length(translate({s}, 'P', '')))"),
    ("secondary_structure_delta", protein.structure_propensity, structure_sql),
):
    query(_name, PROTEIN_SQL + f"SELECT variant_id, round((({_sql('a')}) - ({_sql('r')}))::DOUBLE, 6) AS delta FROM p")(lambda v, f=_f: proteins(v).select("variant_id", r6((f(c("a")) - f(c("r"))).cast("double")).alias("delta")))

KOZAK_SQL = "CASE WHEN k < 3 OR k + 6 >= length(s) THEN 0 ELSE CASE WHEN substr(s, k - 2, 1) IN ('A', 'G') THEN 3 ELSE 0 END + CASE WHEN substr(s, k + 5, 1) = 'G' THEN 2 ELSE 0 END END"


@query("kozak_score", f"WITH w AS (SELECT variant_id, ref_allele || flank_2 AS s FROM v), k AS (SELECT variant_id, s, (instr(s, 'ATG') - 1)::INT AS k FROM w WHERE instr(s, 'ATG') > 0) SELECT variant_id, {KOZAK_SQL} AS kozak FROM k")
def _(v):
    w = v.select("variant_id", F.concat(ref, right).alias("s")).withColumn("k", F.instr("s", "ATG") - 1).where("k >= 0")
    return w.select("variant_id", protein.kozak_score(c("s"), c("k")).alias("kozak"))


# ---- motifs ----

MOTIF_WINDOW = lambda s: F.concat(F.right(c(left), F.lit(20)), c(s), F.left(c(right), F.lit(20)))
motif_sql = lambda s: f"(right(flank_1, 20) || {s} || left(flank_2, 20))"
INIT = [m for m in DNA_MOTIFS if m.domain == "init"]


def scores_sql(s: str, m) -> str:
    odds, void = m.odds()
    cells = ", ".join(f"'{k}{x}': {'NULL::DOUBLE' if void[k, i] else repr(float(odds[k, i])) + '::DOUBLE'}" for k in range(m.size) for i, x in enumerate(m.symbols))
    total = " + ".join(f"(MAP {{{cells}}})['{k}' || substr({s}, (i + {k})::INT, 1)]" for k in range(m.size))
    return f"list_transform(range(1, greatest(length({s}) - {m.size - 1}, 0) + 1), lambda i: coalesce({total}, 0))"


def window_scores_sql() -> str:
    cols = ", ".join(f"{scores_sql(x, m)} AS {m.name}_{x}" for m in INIT for x in ("r", "a"))
    return f"WITH w AS (SELECT variant_id, {motif_sql(ref)} AS r, {motif_sql(alt)} AS a, length(ref_allele) AS nr, length(alt_allele) AS na FROM v), s AS MATERIALIZED (SELECT variant_id, nr, na, {cols} FROM w)\n"


def motif_windows(v: DataFrame) -> DataFrame:
    return v.select("variant_id", MOTIF_WINDOW(ref).alias("r"), MOTIF_WINDOW(alt).alias("a"), F.length(ref).alias("nr"), F.length(alt).alias("na"))


@query("pwm_window_scores", window_scores_sql() + "SELECT variant_id, " + ", ".join(f"len({m.name}_r) AS {m.name}_n, round(list_max({m.name}_r), 6) AS {m.name}_max, round(list_sum({m.name}_r), 6) AS {m.name}_sum" for m in INIT) + " FROM s")
def _(v):
    m = motif_windows(v).select("variant_id", motifs.window_statistics(c("r"), INIT).alias("m")).select("variant_id", "m.*")
    return m.select("variant_id", *[x for i in INIT for x in (f"{i.name}_n", r6(c(f"{i.name}_max")).alias(f"{i.name}_max"), r6(c(f"{i.name}_sum")).alias(f"{i.name}_sum"))])


def gauss_sql(x: str, n: str, size: int) -> str:
    far = f"greatest(20 - (i - 1), (i - 1) - (20 + {n}), 0)"
    return f"coalesce(list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * exp(-{far} * {far} / (2.0 * {size * size})))), 0)"


@query("pwm_gaussian_delta", window_scores_sql() + "SELECT variant_id, " + ", ".join(f"round({gauss_sql(m.name + '_a', 'na', m.size)} - {gauss_sql(m.name + '_r', 'nr', m.size)}, 6) AS {m.name}" for m in INIT) + " FROM s")
def _(v):
    m = motif_windows(v).select("variant_id", motifs.gaussian_deltas(c("r"), c("a"), (c("nr"), c("na")), 20, INIT).alias("m"))
    return m.select("variant_id", *[r6(c("m")[i.name]).alias(i.name) for i in INIT])


hits_sql = lambda x, m: f"list_filter(list_transform(range(1, len({x}) + 1), lambda i: {{'place': i - 1, 'score': {x}[i]}}), lambda h: h.score >= {m.threshold(CLUSTER_SHARE)!r})"
#: Share of the way to the largest score for these short windows, so that clusters occur.
CLUSTER_SHARE = 0.7
HITS = window_scores_sql() + ", h AS MATERIALIZED (SELECT variant_id, " + ", ".join(f"{hits_sql(f'{m.name}_{x}', m)} AS {m.name}_{x}" for m in INIT for x in ("r", "a")) + " FROM s)\n"
cluster_sql = lambda x: f"coalesce(list_sum(list_transform(range(1, len({x})), lambda i: CASE WHEN ({x})[i + 1].place - ({x})[i].place BETWEEN 1 AND 50 THEN (({x})[i].score + ({x})[i + 1].score) / (({x})[i + 1].place - ({x})[i].place + 1) ELSE 0 END)), 0)"


def hit_changes(v: DataFrame) -> DataFrame:
    return motif_windows(v).select("variant_id", motifs.hit_deltas(c("r"), c("a"), INIT, CLUSTER_SHARE, 50).alias("m")).select("variant_id", "m.*")


@query("pwm_cluster_delta", HITS + "SELECT variant_id, " + ", ".join(f"round({cluster_sql(m.name + '_a')} - {cluster_sql(m.name + '_r')}, 6) AS {m.name}" for m in INIT) + " FROM h")
def _(v):
    return hit_changes(v).select("variant_id", *[r6(c(m.name)).alias(m.name) for m in INIT])


DOMAIN = HITS + ", d AS MATERIALIZED (SELECT variant_id, " + ", ".join("flatten([" + ", ".join(f"{m.name}_{x}" for m in INIT) + f"]) AS {x}" for x in ("r", "a")) + " FROM h)\n"


@query("pwm_domain_cluster", DOMAIN + f"SELECT variant_id, round({cluster_sql('a')} - {cluster_sql('r')}, 6) AS delta FROM d")
def _(v):
    return hit_changes(v).select("variant_id", r6(c("together")).alias("delta"))


@query("pwm_totals", HITS + "SELECT variant_id, " + " + ".join(f"len({m.name}_a) - len({m.name}_r)" for m in INIT) + " AS hits_delta FROM h")
def _(v):
    return hit_changes(v).select("variant_id", c("hits").alias("hits_delta"))


SIGNALS = {"nls": NUCLEAR_LOCALIZATION, "nes": NUCLEAR_EXPORT}
places_sql = lambda s, ps: f"list_filter(range(1, length({s}) + 1), lambda i: regexp_matches(substr({s}, i::INT), '^(?:{'|'.join(f'(?:{p})' for p in ps)})'))"
SIGNAL_SQL = PROTEIN_SQL + ", n AS MATERIALIZED (SELECT variant_id, " + ", ".join(f"{places_sql(x, ps)} AS {k}_{x}" for k, ps in SIGNALS.items() for x in ("r", "a")) + " FROM p)\n"
near_sql = lambda x: f"len(list_filter(range(1, len({x})), lambda i: ({x})[i + 1] - ({x})[i] BETWEEN 1 AND 30))"


def signals(v: DataFrame) -> DataFrame:
    return proteins(v).select("variant_id", *[motif.pattern_places(c(x), ps).alias(f"{k}_{x}") for k, ps in SIGNALS.items() for x in ("r", "a")])


@query("nuclear_signals", SIGNAL_SQL + "SELECT variant_id, len(nls_a) - len(nls_r) AS nls, len(nes_a) - len(nes_r) AS nes FROM n")
def _(v):
    return signals(v).select("variant_id", *[(F.size(f"{k}_a") - F.size(f"{k}_r")).cast("long").alias(k) for k in SIGNALS])


@query("regex_cluster_delta", SIGNAL_SQL + f", j AS (SELECT variant_id, nls_a, nls_r, nls_a || nes_a AS a, nls_r || nes_r AS r FROM n) SELECT variant_id, {near_sql('nls_a')} - {near_sql('nls_r')} AS nls, {near_sql('a')} - {near_sql('r')} AS total FROM j")
def _(v):
    j = signals(v).select("variant_id", "nls_a", "nls_r", F.concat("nls_a", "nes_a").alias("a"), F.concat("nls_r", "nes_r").alias("r"))
    near = lambda x: motif.place_clusters(c(x), 30)
    return j.select("variant_id", (near("nls_a") - near("nls_r")).cast("long").alias("nls"), (near("a") - near("r")).cast("long").alias("total"))


def domain_sql(domain: str) -> str:
    mine = [m for m in PROTEIN_MOTIFS if m.domain == domain]
    cols = ", ".join(f"{scores_sql(x, m)} AS {m.name}_{x}" for m in mine for x in ("r", "a"))
    high = lambda m, x: f"len(list_filter({m.name}_{x}, lambda y: y >= {m.threshold(PROTEIN_THRESHOLD)!r}))"
    one = lambda m: f"len({m.name}_a) - len({m.name}_r) AS {m.name}_count, round(coalesce(list_sum({m.name}_a), 0) - coalesce(list_sum({m.name}_r), 0), 6) AS {m.name}_score, {high(m, 'a')} - {high(m, 'r')} AS {m.name}_hits"
    return PROTEIN_SQL + f", s AS MATERIALIZED (SELECT variant_id, {cols} FROM p) SELECT variant_id, {', '.join(map(one, mine))} FROM s"


def domain_query(domain: str):
    def run(v: DataFrame) -> DataFrame:
        mine = [m for m in PROTEIN_MOTIFS if m.domain == domain]
        s = proteins(v).select("variant_id", motifs.score_deltas(c("r"), c("a"), mine, PROTEIN_THRESHOLD).alias("m")).select("variant_id", "m.*")
        return s.select("variant_id", *[r6(c(x)).alias(x) if x.endswith("_score") else c(x) for x in s.columns[1:]])

    return run


query("aa_pwm_stats", domain_sql("glyc"))(domain_query("glyc"))
query("sh2_profile", domain_sql("SH2"))(domain_query("SH2"))

# ---- state paths: statistics over the decoded paths of both alleles ----

#: Bases of either flank that are decoded with an allele.
PATH_FLANK = 40
_path_window = lambda s: f"right(flank_1, {PATH_FLANK}) || {s} || left(flank_2, {PATH_FLANK})"
PATH_SQL = (
    decoded(f"SELECT variant_id * 2 AS key, {_path_window(ref)} AS s FROM v UNION ALL SELECT variant_id * 2 + 1, {_path_window(alt)} FROM v")
    + ", q AS (SELECT v.*, r.path AS r, a.path AS a FROM v JOIN decoded AS r ON r.key = variant_id * 2 JOIN decoded AS a ON a.key = variant_id * 2 + 1)\n"
)


def decoded_paths(v: DataFrame) -> DataFrame:
    around = lambda s: F.concat(F.right(c(left), F.lit(PATH_FLANK)), c(s), F.left(c(right), F.lit(PATH_FLANK)))
    return v.withColumns({"r": viterbi(around(ref))["path"], "a": viterbi(around(alt))["path"]})


def path_query(name: str, sql: str):
    """Like query(), for SQL over the CTE q of decoded paths."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(from_orders(spark, sf_dir))
        ORACLES[name] = VARIANTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + PATH_SQL + sql
        return f

    return register


count_sql = lambda p, x: f"(length({p}) - length(translate({p}, '{x}', '')))"


@path_query("state_composition_delta", "SELECT variant_id, " + ", ".join(f"round({count_sql('r', x)} / length(r) - {count_sql('a', x)} / length(a), 6) AS s_{s.lower()}" for s, x in paths.LETTER.items()) + " FROM q")
def _(v):
    return decoded_paths(v).select("variant_id", *[r6(x).alias(f"s_{s.lower()}") for s, x in paths.composition_deltas(c("r"), c("a")).items()])


moved_sql = lambda p, x, y: f"((length({p}) - length(replace({p}, '{x}{y}', ''))) // 2)"


@path_query("transition_delta", "SELECT variant_id, " + ", ".join(f"({moved_sql('r', x, y)} - {moved_sql('a', x, y)})::INT AS t_{s.lower()}_{t.lower()}" for s, x in paths.LETTER.items() for t, y in paths.LETTER.items() if s != t) + " FROM q")
def _(v):
    made = paths.transition_deltas(c("r"), c("a"))
    return decoded_paths(v).select("variant_id", *[x.alias("t_" + k.lower().replace("_to_", "_")) for k, x in made.items()])


@path_query("subgroup_stats", "SELECT variant_id, " + ", ".join(
    f"{count_sql('r', x)} AS {g}_rawc, round(log2(({count_sql('r', x)} + 1) / length(r)), 6) AS {g}_log2, round({count_sql('r', x)} / length(r), 6) AS {g}_pctg" for g, x in paths.groups().items() if g in SUBGROUPS) + " FROM q")
def _(v):
    names = {g: x for g, x in paths.groups().items() if g in SUBGROUPS}
    made = paths.statistics(c("r"), names)
    return decoded_paths(v).select("variant_id", *[(x.cast("long") if k.endswith("rawc") else r6(x)).alias(k) for k, x in made.items()])


_far = f"greatest({PATH_FLANK} - (i - 1), (i - 1) - ({PATH_FLANK} + n), 0)"


@path_query("boundary_gaussian", f""", b AS (SELECT variant_id, r, length(ref_allele) AS n FROM q)
SELECT variant_id, round(coalesce(list_sum(list_transform(list_filter(range(1, length(r)), lambda i: substr(r, i::INT, 1) <> substr(r, (i + 1)::INT, 1)), lambda i: exp(-{_far} * {_far} / (2.0 * n * n)))), 0), 6) AS closeness FROM b""")
def _(v):
    b = decoded_paths(v).withColumn("n", F.length(ref))
    return b.select("variant_id", r6(paths.gaussian_boundaries(c("r"), F.lit(PATH_FLANK), c("n"))).alias("closeness"))
