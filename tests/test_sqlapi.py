import pytest
from pyspark.sql import functions as F

from helixframe import sqlapi
from helixframe.functions import dna
from helixframe.operators import repair

ROWS = [(1, "ACGTNACGTT", "ACGT", "A" * 250, "C" * 250, 3), (2, "", None, "", None, 30), (3, None, "", "G" * 60, "T" * 40, 24), (4, "CGCG", "ATATATATATA", "A" * 120, "C", 1)]


@pytest.fixture(scope="module")
def table(spark):
    sqlapi.register(spark)
    sqlapi.register(spark)  # once more does no harm
    return spark.createDataFrame(ROWS, "variant_id long, ref_allele string, alt_allele string, flank_1 string, flank_2 string, chromosome int")


def same(a, b):
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]


def test_sql_functions_as_columns(spark, table):
    got = spark.sql(
        """SELECT gc_fraction(ref_allele), cpg_fraction(ref_allele), length_change(ref_allele, alt_allele), gene_density(chromosome), reverse_complement(ref_allele), stacking_energy(alt_allele),
        variant_window(flank_1, ref_allele, flank_2) FROM {t} ORDER BY variant_id""", t=table)  # fmt: skip
    r, a = F.col("ref_allele"), F.col("alt_allele")
    want = table.orderBy("variant_id").select(
        dna.gc_fraction(r), dna.cpg_fraction(r), dna.length_change(r, a), dna.gene_density(F.col("chromosome")), dna.reverse_complement(r), F.when(a.isNotNull(), dna.stacking_energy(a)).otherwise(dna.stacking_energy(a)),
        dna.buffered(r, F.col("flank_1"), F.col("flank_2")),
    )
    same(got, want)


def test_candidates(spark, table):
    got = spark.sql("SELECT v.variant_id, e.candidate FROM {t} AS v, LATERAL guided_edits(v.alt_allele) AS e WHERE v.alt_allele IS NOT NULL ORDER BY ALL", t=table)
    want = table.where("alt_allele IS NOT NULL").select("variant_id", F.explode(repair.guided_edits(F.col("alt_allele"))).alias("candidate")).orderBy("variant_id", "candidate")
    same(got, want)
    made = spark.sql("SELECT * FROM edited(TABLE(SELECT variant_id, alt_allele FROM {t})) WHERE variant_id <> 2 ORDER BY variant_id, candidate", t=table)
    same(made.select("variant_id", "candidate"), want.join(table.select("variant_id", "alt_allele"), "variant_id").where("candidate <> alt_allele").select("variant_id", "candidate").orderBy("variant_id", "candidate"))


def test_vectorised_nulls(spark, table):
    got = spark.sql("SELECT dna_alignment(ref_allele, alt_allele) a, dna_alignment_texts(ref_allele, alt_allele) t, sequence_entropy(ref_allele) e, hairpins(flank_1) h, domain_path(ref_allele) d, best_protein(flank_1) p, protein_alignment(ref_allele, alt_allele) q FROM {t} ORDER BY variant_id", t=table).collect()
    assert [r.a.Global_score for r in got][1:3] == [0, 0] and got[1].t.global_ref == "" and got[2].e == 0 and got[1].d.path == "" and got[1].p.protein == "" and got[1].q.AA_Global_score == 0
