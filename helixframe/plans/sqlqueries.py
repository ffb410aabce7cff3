"""Registered queries written in Spark SQL, over the functions of sqlapi."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import sqlapi
from ..sources.variants import VARIANTS_SQL, from_orders
from .base import DENSITY_SQL, LENGTH_SQL, energy, gc
from .modeling import EDITS_SQL
from .sequence_sql import ALIGNED, FRAMES, HAIRPINS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def in_sql(name: str, text: str, oracle: str) -> None:
    """Register a statement over the view {v} of the variants."""

    def run(spark, sf_dir: str) -> DataFrame:
        sqlapi.register(spark)
        return spark.sql(text, v=from_orders(spark, sf_dir))

    QUERIES[name] = run
    ORACLES[name] = VARIANTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + oracle


in_sql(
    "sql_features",
    """SELECT variant_id, a.Global_score, a.Local_score, round(gc_fraction(alt_allele), 6) AS gc, round(length_change(ref_allele, alt_allele), 6) AS change, gene_density(chromosome) AS density,
      round(stacking_energy(alt_allele) - stacking_energy(ref_allele), 6) AS energy, reverse_complement(alt_allele) AS back, length(variant_window(flank_1, alt_allele, flank_2)) AS window_size
    FROM (SELECT *, dna_alignment(ref_allele, alt_allele) AS a FROM {v})""",
    ALIGNED + f"""SELECT variant_id, max(top) FILTER (NOT local)::INT AS Global_score, max(top) FILTER (local)::INT AS Local_score, round({gc("any_value(v.alt_allele)")}, 6) AS gc,
      round(any_value({LENGTH_SQL}), 6) AS change, any_value(({DENSITY_SQL})[chromosome]) AS density, round(any_value({energy("v.alt_allele")} - {energy("v.ref_allele")}), 6) AS energy,
      any_value(reverse(translate(v.alt_allele, 'ATCG', 'TAGC'))) AS back, any_value(200 + length(v.alt_allele))::INT AS window_size FROM aligned JOIN v USING (variant_id) GROUP BY variant_id""",
)
in_sql("sql_candidates", "SELECT v.variant_id, e.candidate FROM {v} AS v, LATERAL guided_edits(v.alt_allele) AS e", EDITS_SQL + "SELECT variant_id, candidate FROM e")
in_sql(
    "sql_edited",
    "SELECT * FROM edited(TABLE(SELECT variant_id, alt_allele FROM {v}))",
    EDITS_SQL + "SELECT variant_id, candidate, (length(candidate) - length(alt_allele))::INT AS growth FROM e JOIN v USING (variant_id) WHERE candidate <> alt_allele",
)
in_sql(
    "sql_sequences",
    """SELECT variant_id, p.protein, p.score, hairpins(variant_window(flank_1, alt_allele, flank_2)) - hairpins(variant_window(flank_1, ref_allele, flank_2)) AS hairpins
    FROM (SELECT *, best_protein(concat(substr(flank_1, 301), ref_allele, left(flank_2, 300))) AS p FROM {v})""",
    f"""SELECT variant_id, protein, score::DOUBLE AS score, hairpins FROM (WITH {FRAMES[2:]} SELECT * FROM proteins WHERE side = 'r') JOIN (WITH {HAIRPINS[2:]}) USING (variant_id)""",
)
