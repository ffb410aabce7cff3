import math

import duckdb
import pytest
from pyspark.sql import functions as F

from helixframe import catalog
from helixframe.functions import dna, paths
from helixframe.operators import domains, repair, viterbi
from helixframe.plans import features, learning
from helixframe.sources import fasta, matrices, variant_fasta, variants
from helixframe.streaming import scoring

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(x):
    return f"{x + 0.0:.6g}" if isinstance(x, float) else repr(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_as_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(norm(r[columns.index(c)]) for c in names) for r in cursor.fetchall())
    assert sorted(tuple(norm(r[c]) for c in names) for r in got.collect()) == want and want


def test_fingerprint(spark):
    made = features.fingerprint(variants.from_orders(spark, SF).limit(200))
    assert len(made.columns) == 3 + 552
    row = made.first().asDict()
    assert all(v is None or not math.isnan(v) for k, v in row.items() if isinstance(v, float))
    same = variants.from_orders(spark, SF).limit(50).withColumn("alt_allele", F.col("ref_allele"))
    deltas = [c for c in made.columns if c.endswith("_delta") or "_shift" in c or c.startswith("tr_")]
    for r in features.fingerprint(same).select(*[F.col(f"`{c}`") for c in deltas if c != "GC_context_delta"]).collect():
        assert not any(r)


def test_native_forms_as_vectorised(spark):
    v = variants.from_orders(spark, SF).limit(100)
    whole = lambda s: F.concat("flank_1", s, "flank_2")
    p = v.select("variant_id", viterbi.viterbi(whole("ref_allele")).alias("r"), viterbi.viterbi(whole("alt_allele")).alias("a"))
    p = p.select("variant_id", F.col("r.path").alias("r"), F.col("a.path").alias("a"))
    native = p.select("r", "a", *[x.alias(k) for k, x in (paths.composition_deltas(F.col("r"), F.col("a")) | paths.transition_deltas(F.col("r"), F.col("a"))).items()])
    for row in native.collect():
        want = dict(zip(domains._OF_SCALE, domains.changes(row["r"], row["a"], 0.0, 128)))
        assert all(row[k] == pytest.approx(want[k]) for k in native.columns if k not in ("r", "a"))


def test_windows_and_edges(spark):
    rows = [("A" * 150, 100), ("A" * 70, 30), ("A" * 40, 40), ("", 0)]
    got = spark.createDataFrame([(s,) for s, _ in rows], "s string").select(F.length(dna.left_window(F.col("s"), 100)).alias("n")).collect()
    assert [r.n for r in got] == [n for _, n in rows]
    odd = spark.createDataFrame([(1, 9, None, None, None, None, "Benign"), (2, 30, "", "N", "", "", None)], scoring.VARIANT_SCHEMA)
    assert features.fingerprint(odd).count() == 2 and len(features.fingerprint(odd).collect()) == 2
    assert features.fingerprint(odd.where("false")).collect() == []


def test_context_at_the_ends(spark):
    genome = fasta.chunks(spark.createDataFrame([("acc", "ACGTACGTAC")], "accession string, sequence string"), 4)
    rows = [(1, "acc", 1, "A"), (2, "acc", 5, "AC"), (3, "acc", 10, "C"), (4, "acc", 5, "G"), (5, "none", 5, "G")]
    got = {r.variant_id: r for r in fasta.with_context(spark.createDataFrame(rows, "variant_id long, accession string, position long, ref_allele string"), genome, 3, 4).collect()}
    assert (got[1].flank_1, got[1].flank_2) == ("A", "CGT") and (got[2].flank_1, got[2].flank_2) == ("CGT", "GTA")
    assert (got[3].flank_1, got[3].flank_2) == ("GTA", "C") and not got[4].ref_matches and 5 not in got


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">chr9|ref|gene1\nGCT\nGCT\n>chr9|alt|gene1\ng\n>chr9|flank1|gene1\nAA\n>chr9|flank_2|gene1\nCC\n>chr23|alt|g2\nT\n>chr23|ref|g2\nA\n>chr23|ref|g2\nC\n")
    got = {r.name: r for r in variant_fasta.read_variants(spark, str(tmp_path / "a.fasta")).collect()}
    assert (got["gene1"].ref_allele, got["gene1"].alt_allele, got["gene1"].flank_1, got["gene1"].flank_2) == ("GCTGCT", "G", "AA", "CC")
    assert got["g2"].chromosome == 23 and got["g2"].ref_allele == "C"
    (tmp_path / "b.fasta").write_text(">chrX|ref|gene1\nGCT\n")
    with pytest.raises(Exception, match="not a variant record"):
        variant_fasta.read_variants(spark, str(tmp_path / "b.fasta")).collect()


def test_files_of_matrices_and_variants(spark, tmp_path):
    import gzip

    (tmp_path / "pwm").mkdir()
    (tmp_path / "pwm" / "box.txt").write_text("0.7 0.1 0.1 0.1\n\n0.25 0.25 0.25 0.25\n")
    table = matrices.read_pwms(spark, str(tmp_path / "pwm"))
    assert table.count() == 8 and matrices.motifs(table, {"box": "init"})[0].rows == ((0.7, 0.1, 0.1, 0.1), (0.25,) * 4)
    (tmp_path / "m.mat").write_text("# note\n  A R\nA 4 -1\nR -1 5\n")
    assert matrices.read_substitutions(spark, str(tmp_path / "m.mat")) == {("A", "A"): 4, ("A", "R"): -1, ("R", "A"): -1, ("R", "R"): 5}
    head = "Extra\t" + "\t".join(variants.CLINICAL_COLUMNS)
    lines = ["x\tGRCh38\t1\tNC\t5\tA\tC\tBenign", "x\tGRCh37\t1\tNC\t5\tA\tC\tBenign", "x\tGRCh38\tMT\tNC\t5\tA\tC\tBenign", "x\tGRCh38\tX\tNC\t5\tna\tC\tPathogenic", "x\tGRCh38\tY\tNC\t7\tA\tC\tUncertain significance", "x\tGRCh38\tUn\tNC\t7\tA\tC\tBenign", "x\tGRCh38\tX\tNC\t\tA\tC\tBenign"]
    with gzip.open(tmp_path / "v.tsv.gz", "wt") as f:
        f.write("\n".join([head, *lines]) + "\n")
    assert [r.PositionVCF for r in variants.clinical_filter(variants.read_clinical(spark, str(tmp_path / "v.tsv.gz"))).collect()] == [5]


def test_metrics_and_search(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    pairs = [(a > b) + (a == b) / 2 for a, x in rows for b, y in rows if x and not y]
    assert learning.roc_auc(df, "p", "y").first()[0] == pytest.approx(sum(pairs) / len(pairs))
    assert learning.best_f1(df, "p", "y").first()["f1"] == pytest.approx(0.75, abs=1e-6)
    assert learning.roc_auc(df.where("y = 1"), "p", "y").first()[0] is None
    best, value = learning.binary_variance_search(lambda kept: -abs(len(kept) - 3), lambda t: [i for i in range(10) if i / 30 >= t])
    assert value == 0 and sum(i / 30 >= best for i in range(10)) == 3
    assert learning.read_feature_list(learning.feature_list_json("m", "t", 0.1, ["a", "b"])) == ["a", "b"]
    with pytest.raises(ValueError, match="missing features: q"):
        features.select_features(df, ["p", "q"])


def test_evaluation(spark):
    """Early stopping learns from neither test nor held rows."""
    df = spark.range(400).select(F.col("id").alias("variant_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.rand(1)).alias("x"), F.rand(2).alias("y"))
    made = learning.evaluate(df, ["x", "y"], k=2, rounds=8)
    assert made.summary["roc_auc"] > 0.95 and 1 <= made.summary["rounds"] <= 8 and sum(n for *_, n in made.confusion) == 80
    assert made.summary["false_negatives"] == sum(n for y, p, n in made.confusion if (y, p) == (1, 0))


def test_filtered_variants_as_csv(spark, tmp_path):
    rows = spark.createDataFrame([("X", 5, "A"), ("1", 7, None)], "Chromosome string, PositionVCF int, ReferenceAlleleVCF string")
    variants.write_clinical(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == rows.columns and sorted(r.PositionVCF for r in back.collect()) == ["5", "7"]


def test_repair_raises_the_score(spark):
    start = spark.createDataFrame([(1, "ACGT"), (2, "GGGGGGGG")], "variant_id long, alt_allele string")
    score = lambda df: df.withColumn("score", F.length(F.regexp_replace("alt_allele", "[^A]", "")) / (F.length("alt_allele") + 1))
    done = repair.repair(start, score, repair.Config(iterations=3, benign_goal=0.3))
    got = {r.variant_id: r for r in done.copies.collect()}
    assert got[1].score > 0.5 and got[2].score > 0.2 and got[1].alt_allele.startswith("ACGT")
    assert done.reached.count() > 0 and "% benign" in repair.report([r.asDict() for r in done.copies.collect()])
    assert len(repair.appended()) == 84


def test_stream_as_table(spark, tmp_path):
    v = variants.from_orders(spark, SF).limit(60)
    v.write.parquet(str(tmp_path / "in"))
    plan = lambda df: features.fingerprint(df, families=("dna_motifs",))
    scoring.run_to_table(scoring.variant_stream(spark, str(tmp_path / "in")), plan, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_whole_elimination_and_search(spark, monkeypatch):
    """Elimination starts from all model features and ends by its own rule; the variance search has a query."""
    from helixframe.plans import modeling

    def scores(df, names, k=3, **_):
        return learning.Scores(0.9, 0.9, 0.9, {c: float(i) for i, c in enumerate(names)})

    monkeypatch.setattr(learning, "cross_validation", scores)
    steps = modeling.QUERIES["backward_elimination"](spark, SF).collect()
    assert [r.features for r in steps] == list(range(len(modeling.MODEL_FEATURES) - 1, 0, -1))
    (found,) = modeling.QUERIES["variance_search"](spark, SF).collect()
    assert 0 <= found.threshold <= 0.3 and 0 < found.features <= len(modeling.MODEL_FEATURES)
