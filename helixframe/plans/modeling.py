"""Registered queries over the vectorised operators, the feature plan, models and the allele optimizer."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import dna
from ..operators import align, incremental, motifs, orf, repair, structure, viterbi
from ..scratch import cut, new_path
from ..sources import variant_fasta
from ..sources.variants import VARIANTS_SQL, fasta_text, from_orders, label, spread
from . import features, learning
from . import sequence_sql as sql
from .base import energy

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ref, alt, left, right = "ref_allele", "alt_allele", "flank_1", "flank_2"


def on_variants(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(from_orders(spark, sf_dir))
        if oracle:
            ORACLES[name] = VARIANTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + oracle
        return f

    return register


# ---- sequence algorithms, each beside SQL of its own ----


def aligned(v: DataFrame) -> DataFrame:
    return v.select("variant_id", align.dna_alignments(ref, alt).alias("a")).select("variant_id", "a.*")


def with_texts(v: DataFrame) -> DataFrame:
    both = v.select("variant_id", align.dna_alignments(ref, alt).alias("a"), align.dna_alignment_texts(ref, alt).alias("t"))
    return both.select("variant_id", "a.*", "t.*")


@on_variants("nw_dna", sql.NW_DNA)
def _(v):
    return with_texts(v).select("variant_id", "Global_score", F.round("Global_pct", 6).alias("Global_pct"), "global_ref", "global_alt")


@on_variants("sw_dna", sql.SW_DNA)
def _(v):
    return with_texts(v).select("variant_id", "Local_score", F.round("Local_pct", 6).alias("Local_pct"), "local_ref", "local_alt")


@on_variants("snv_flag", sql.SNV_FLAG)
def _(v):
    return aligned(v).select("variant_id", "SNVs")


@on_variants("insertion_len", sql.INSERTION_LEN)
def _(v):
    return aligned(v).select("variant_id", "Insertion_length")


@on_variants("hairpin_delta", sql.HAIRPINS)
def _(v):
    return v.select("variant_id", structure.hairpin_delta(dna.buffered(ref, left, right), dna.buffered(alt, left, right)).alias("hairpins"))


@on_variants("repeat_changes", sql.REPEATS)
def _(v):
    return v.select("variant_id", structure.repeat_changes(dna.buffered(ref, left, right), dna.buffered(alt, left, right)).alias("r")).select("variant_id", "r.*")


@on_variants("best_orf", sql.BEST_ORF)
def _(v):
    p = features.with_proteins(v)
    return p.select("variant_id", F.col("ref_orf.start").alias("start"), F.col("ref_orf.end").alias("end"), F.col("ref_orf.score").alias("score"), F.col("ref_orf.reverse").alias("reverse"), F.col("ref_orf.protein").alias("protein"))


@on_variants("viterbi_path", sql.VITERBI)
def _(v):
    return v.select("variant_id", viterbi.viterbi(F.concat(left, ref, right)).alias("p")).select("variant_id", "p.path", F.round("p.log_probability", 6).alias("log_probability"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select("variant_id", *[F.round(f"`{c}`", 6).alias(c) for c in df.columns[1:]])


@on_variants("dna_motif_profile", sql.dna_profile())
def _(v):
    return rounded(v.select("variant_id", motifs.dna_motifs(ref, alt, left, right).alias("m")).select("variant_id", "m.*"))


@on_variants("protein_motif_profile", sql.protein_profile())
def _(v):
    p = features.with_proteins(v)
    return rounded(p.select("variant_id", motifs.protein_motifs(F.col("ref_orf.protein"), F.col("alt_orf.protein")).alias("m")).select("variant_id", "m.*"))


@on_variants("pdz_profile", sql.pdz_profile())
def _(v):
    p = features.with_proteins(v)
    return rounded(p.select("variant_id", motifs.pdz_motifs(F.col("ref_orf.protein"), F.col("alt_orf.protein")).alias("m")).select("variant_id", "m.*"))


@on_variants("fingerprint_all")
def _(v):
    """The flagship: all 552 features of every variant."""
    return features.fingerprint(v)


# ---- models ----

MODEL_FEATURES = list(incremental.FEATURES)


def quick_features(v: DataFrame) -> DataFrame:
    """Features of the alleles alone, for models that score many candidates."""
    df = v.withColumn("_a", align.dna_alignments(ref, alt)).withColumn("_e", structure.entropy_delta(ref, alt))
    made = {k: F.col(f"_a.{k}") for k in ("Global_score", "Local_score", "SNVs", "Insertion_length")}
    made |= {
        "Length_change_context": dna.length_change(ref, alt), "GC_context_delta": dna.gc_context(ref, alt), "Thermodynamic_stability": dna.stacking_energy(alt) - dna.stacking_energy(ref),
        "Shannon_entropy": F.col("_e"), "Poly_tracts": dna.count_delta(ref, alt, dna.POLY_TRACTS), "tr_base_composite": F.length(alt) - F.length(F.regexp_replace(alt, "(CA){5,}", "")),
    }
    return df.withColumns({k: x.cast("double") for k, x in made.items()}).drop("_a", "_e")


def labelled(v: DataFrame) -> DataFrame:
    """Features of benign and pathogenic variants; the class hangs on the allele, so that there is something to learn.

    Checkpointed, as every round of a fit reads them anew.
    """
    known = v.where(F.col("clinical_significance").isin("Benign", "Pathogenic"))
    shifted = known.withColumn("label", F.when((F.length(alt) - F.length(ref)) % 3 != 0, 1).otherwise(label(F.col("clinical_significance"))))
    return cut(quick_features(shifted).select("variant_id", "label", *MODEL_FEATURES))


@on_variants("train_score")
def _(v):
    """Train on four fifths of the variants of each class, score the rest."""
    split = learning.stratified_split(labelled(v), "variant_id", "label")
    model = learning.train(split.where("not is_test"), MODEL_FEATURES)
    return learning.score(model, split.where("is_test"), MODEL_FEATURES).select("variant_id", "label", "prob_benign", "prob_pathogenic", "predicted")


@on_variants("class_ratio", "SELECT clinical_significance AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM v GROUP BY 1")
def _(v):
    return learning.class_ratio(v, "clinical_significance").select(F.col("clinical_significance").alias("label"), "n", F.round("share", 6).alias("share"))


@on_variants("preview", "SELECT variant_id, chromosome, ref_allele, alt_allele FROM v ORDER BY variant_id LIMIT 5")
def _(v):
    """The first rows; a limit is what a preview is."""
    return v.select("variant_id", "chromosome", ref, alt).orderBy("variant_id").limit(5)


@on_variants("evaluate_model")
def _(v):
    """Fold metrics, errors of each kind, the best threshold and the rounds that early stopping left."""
    made = learning.evaluate(labelled(v), MODEL_FEATURES)
    return v.sparkSession.createDataFrame(sorted(made.summary.items()), "metric string, value double")


@on_variants("feature_importance")
def _(v):
    """Mean importances over stratified folds, largest first."""
    spark = v.sparkSession
    found = learning.cross_validation(labelled(v), MODEL_FEATURES, 5, rounds=20).importance
    return spark.createDataFrame(sorted(found.items(), key=lambda x: (-x[1], x[0])), "feature string, importance double")


@on_variants("backward_elimination")
def _(v):
    """Backward elimination from all model features until its own rule stops it."""
    _, steps = learning.backward_elimination(labelled(v), MODEL_FEATURES)
    return v.sparkSession.createDataFrame(steps, "dropped string, features int, roc_auc double, pr_auc double, f1 double")


@on_variants("variance_search")
def _(v):
    """The variance threshold whose features have the best mean metrics over folds, and how many they are."""
    table = labelled(v)
    found = {r["feature"]: r["variance"] for r in learning.variances(table, MODEL_FEATURES).collect()}
    at = lambda t: [c for c in MODEL_FEATURES if found[c] is not None and found[c] >= t]
    threshold, score = learning.binary_variance_search(lambda kept: learning.cross_validation(table, kept).total, at)
    return v.sparkSession.createDataFrame([(threshold, score, len(at(threshold)))], "threshold double, score double, features int")


@on_variants("hyper_search")
def _(v):
    """Parameters by successive halving: nine seeded draws with 2 rounds, the best three with 6, the best one with 18."""
    rows = learning.successive_halving(labelled(v), MODEL_FEATURES, rounds=2, k=2)
    return v.sparkSession.createDataFrame(rows, "rung int, trial int, rounds int, depth int, step double, share double, f1 double, kept boolean")


# ---- models on the whole profile ----

#: The least variance of a feature that a model of the profile tries.
PROFILE_VARIANCE = 0.1125


def profile(v: DataFrame) -> DataFrame:
    """The whole fingerprint, by name of the variant."""
    return features.fingerprint(v)


def profile_model(v: DataFrame, rounds: int = 5) -> tuple[PipelineModel, list[str], DataFrame]:
    """(model, its features, labelled fingerprints): features of enough variance that a first fit uses, then a fit on them."""
    known = v.where(F.col("clinical_significance").isin("Benign", "Pathogenic"))
    shifted = known.withColumn("label", F.when((F.length(alt) - F.length(ref)) % 3 != 0, 1).otherwise(label(F.col("clinical_significance"))))
    table = cut(profile(shifted))
    names = [c for c in table.columns if c not in ("variant_id", "chromosome", "clinical_significance", "label")]
    varied = learning.variance_sift(table, names, PROFILE_VARIANCE)
    first = learning.train(table, varied, rounds=rounds)
    weights = dict(zip(varied, first.stages[-1].featureImportances.toArray()))
    chosen = [c for c in varied if weights[c] > 0] or varied[:1]
    return learning.train(table, chosen, rounds=rounds), chosen, table


@on_variants("profile_selection")
def _(v):
    """The features that a model of the whole profile keeps, and their importances in it."""
    model, chosen, _table = profile_model(v)
    weights = model.stages[-1].featureImportances.toArray()
    return v.sparkSession.createDataFrame([(c, float(w)) for c, w in zip(chosen, weights)], "feature string, importance double")


def screen(spark, fasta: str, model: str, listed: str) -> DataFrame:
    """name, predicted, prob_benign and prob_pathogenic of the variants of FASTA files, by a saved model and its feature list."""
    chosen = learning.read_feature_list(learning.read_text(spark, listed))
    made = profile(spread(variant_fasta.read_variants(spark, fasta)))
    features.select_features(made, chosen)  # names what is missing
    return learning.score(PipelineModel.load(model), made, chosen).select("name", "predicted", "prob_benign", "prob_pathogenic")


@on_variants("fasta_predictions")
def _(v):
    """FASTA to predictions: the benign and pathogenic variants train a model that is saved with its list; all are written as FASTA and scored."""
    spark = v.sparkSession
    fasta, model, listed = (new_path(spark, n) for n in ("screen", "model", "features"))
    made, chosen, _table = profile_model(v)
    made.write().save(model)
    learning.write_text(spark, learning.feature_list_json("profile", "", PROFILE_VARIANCE, chosen), listed)
    v.select(fasta_text()).write.text(fasta)
    return screen(spark, fasta, model, listed)


# ---- the allele optimizer ----

EDITS_SQL = (
    ", e AS (SELECT variant_id, ref_allele, unnest(list_distinct(list_transform(["
    + ", ".join(f"'{s}'" for s in repair.appended())
    + "], lambda s: alt_allele || s) || CASE WHEN length(alt_allele) >= 7 THEN flatten(list_transform(range(4, length(alt_allele) - 2), lambda p: "
    + "list_transform([0, 1, 2], lambda k: left(alt_allele, p::INT) || substr(alt_allele, (p + k + 1)::INT)))) ELSE [] END)) AS candidate FROM v)\n"
)


def candidates(v: DataFrame) -> DataFrame:
    return v.select("variant_id", "ref_allele", F.explode(repair.guided_edits(alt)).alias("candidate"))


@on_variants("candidate_mutations", EDITS_SQL + "SELECT variant_id, candidate FROM e")
def _(v):
    return candidates(v).select("variant_id", "candidate")


BEST_SQL = EDITS_SQL + f", s AS (SELECT variant_id, candidate, round({energy('candidate')} - {energy('ref_allele')}, 6) AS score FROM e) SELECT variant_id, candidate, score FROM s QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY score DESC, candidate) = 1"


@on_variants("best_candidate", BEST_SQL)
def _(v):
    """The candidate of the weakest stacking, as a score that SQL has too."""
    own = v.withColumn("_own", dna.stacking_energy(ref))
    loss = lambda c: F.lit(0.0) - F.round(dna.stacking_energy(c) - F.col("_own"), 6)
    best = F.array_min(F.transform(repair.guided_edits(alt), lambda c: F.struct(loss(c).alias("loss"), c.alias("candidate"))))
    return own.select("variant_id", best.alias("b")).select("variant_id", "b.candidate", (F.lit(0.0) - F.col("b.loss")).alias("score"))


@on_variants("repair_loop")
def _(v):
    """Repair of every pathogenic variant by a model of the alleles' features: copies at the end, and the alleles that reached the goal."""
    model = learning.train(labelled(v), MODEL_FEATURES)
    return incremental.repaired(v.where("clinical_significance = 'Pathogenic'"), incremental.compiled(model), DEFAULT)
