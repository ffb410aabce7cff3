import pytest
from pyspark.sql import functions as F

from helixframe.plans import features, learning, modeling
from helixframe.scratch import new_path
from helixframe.sources import variants

SF = "/root/testdata/sf0.001"


def test_halving(spark):
    """Each rung gives the best third more rounds; the same seed draws and finds the same."""
    df = spark.range(240).select(F.col("id").alias("variant_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.rand(1)).alias("0.5x"), F.rand(2).alias("y"))
    rows = learning.successive_halving(df, ["0.5x", "y"], trials=4, keep=2, rounds=1, k=2)
    assert [(r["rung"], r["rounds"]) for r in rows] == [(0, 1)] * 4 + [(1, 2)] * 2 + [(2, 4)]
    for rung in (0, 1):
        mine = [r for r in rows if r["rung"] == rung]
        best = sorted(mine, key=lambda r: (-r["f1"], r["trial"]))[: len(mine) // 2]
        assert {r["trial"] for r in best} == {r["trial"] for r in mine if r["kept"]} == {r["trial"] for r in rows if r["rung"] == rung + 1}
    assert rows[-1]["kept"] and rows[-1]["f1"] > 0.9
    assert learning.successive_halving(df, ["0.5x", "y"], trials=4, keep=2, rounds=1, k=2) == rows


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 2.0, 5.0), (3, 4.0, float("nan"))], "variant_id long, `a.b` double, c double")
    assert {r.feature: r.variance for r in learning.variances(df.where("variant_id < 3"), ["a.b"]).collect()} == {"a.b": 2.0}
    assert [list(r.features) for r in learning.assembled(df, ["a.b", "c"]).orderBy("variant_id").collect()] == [[0.0, 0.0], [2.0, 5.0], [4.0, 0.0]]


def test_screening_files_as_scoring_tables(spark):
    """A saved model and its list give variants of FASTA files the scores that the model gives the table they came from."""
    v = variants.from_orders(spark, SF).where("variant_id % 4 = 3")
    model, chosen, table = modeling.profile_model(v, rounds=2)
    assert set(chosen) <= set(table.columns) and 0 < len(chosen) < 100
    fasta, saved, listed = (new_path(spark, n) for n in ("fasta", "model", "list"))
    model.write().save(saved)
    learning.write_text(spark, learning.feature_list_json("m", "now", 0.1, chosen), listed)
    v.select(variants.fasta_text()).write.text(fasta)
    got = {r.name: (r.predicted, r.prob_pathogenic) for r in modeling.screen(spark, fasta, saved, listed).collect()}
    want = learning.score(model, features.fingerprint(v), chosen).select("variant_id", "predicted", "prob_pathogenic").collect()
    assert got == {f"v{r.variant_id}": (r.predicted, pytest.approx(r.prob_pathogenic)) for r in want}
    learning.write_text(spark, learning.feature_list_json("m", "now", 0.1, ["none such"]), listed)
    with pytest.raises(ValueError, match="none such"):
        modeling.screen(spark, fasta, saved, listed)
