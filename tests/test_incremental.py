import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.config import DEFAULT
from helixframe.operators import align, incremental, repair, structure
from helixframe.plans import learning, modeling
from helixframe.sources import variants

SF = "/root/testdata/sf0.001"
ALLELE = st.text("ACGTN", max_size=12)


@pytest.fixture(scope="module")
def model(spark):
    table = modeling.labelled(variants.from_orders(spark, SF))
    return learning.train(table, modeling.MODEL_FEATURES, rounds=3)


class ByAllele:
    """A model that tells alleles apart by a hash of their features, so that ties are rare."""

    def benign(self, rows):
        return np.round((np.abs(np.nan_to_num(rows)) @ np.arange(1, rows.shape[1] + 1) * 0.61803) % 1, 6)


def plain_entropy(s, low=2, high=7):
    found = [s[i : i + k] for k in range(low, high + 1) for i in range(len(s) - k + 1)]
    p = np.array([found.count(x) for x in set(found)]) / max(len(found), 1)
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ACGTNé", max_size=30), max_size=6), st.sampled_from([1 << 20, 50]))
def test_entropies_as_counts(sequences, cells):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(structure, "SORTED", cells)
        assert structure.entropies(sequences) == pytest.approx([plain_entropy(s) for s in sequences], abs=1e-9)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(ALLELE, ALLELE), min_size=1, max_size=5), st.integers(0, 99), st.sampled_from([1 << 22, 1]))
def test_edits_scored_as_whole_alignments(pairs, seed, cells):
    """Every edit's features, from the column of what it keeps, are those of aligning the edited allele anew."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(incremental, "CELLS", cells)
        run = incremental.Search(list(range(len(pairs))), [r for r, _ in pairs], [a for _, a in pairs], ByAllele(), DEFAULT, {})
        edits = [(i, e) for i, (_, a) in enumerate(pairs) for e in incremental.guided(a) + incremental.drawn(a, seed, 10)]
        alleles = [run.alts[i][:p] + t for i, (p, t) in edits]
        got = run.aligned(edits, alleles)
    want = align.dna_rows([pairs[i][0] for i, _ in edits], alleles)
    for c in got:
        assert got[c].tolist() == want[c].tolist(), c


def test_trees_as_spark(spark, model):
    v = variants.from_orders(spark, SF)
    scored = learning.score(model, modeling.quick_features(v), modeling.MODEL_FEATURES).orderBy("variant_id").toPandas()
    trees = incremental.compiled(model)
    assert trees.benign(scored[modeling.MODEL_FEATURES].to_numpy()) == pytest.approx(scored["prob_benign"].to_numpy())
    run = incremental.Search(list(scored["variant_id"]), list(scored["ref_allele"]), list(scored["alt_allele"]), trees, DEFAULT, {})
    assert run.score == pytest.approx(scored["prob_benign"].tolist())


def test_guided_search_as_dataframe_loop(spark, model):
    """The same copies as the loop that scores whole tables, an iteration at a time."""
    config = replace(DEFAULT, iterations=4, retain_threshold=99)
    v = variants.from_orders(spark, SF).where("variant_id % 40 = 1").select("variant_id", "ref_allele", "alt_allele")

    def benign(df):
        from pyspark.sql import functions as F

        scored = learning.score(model, modeling.quick_features(df), modeling.MODEL_FEATURES)
        return scored.withColumn("score", F.round("prob_benign", 9)).drop(*modeling.MODEL_FEATURES, "prob_benign", "prob_pathogenic", "predicted")

    class Rounded(incremental.Trees):
        def benign(self, rows):
            return np.round(super().benign(rows), 9)

    made = repair.repair(v, benign, config)
    trees = incremental.compiled(model)
    got = incremental.repaired(v, Rounded(**trees.__dict__), config).toPandas()
    copies = got[~got.reached].set_index("variant_id")
    want = made.copies.toPandas().set_index("variant_id")
    assert len(copies) == len(want) > 20
    assert copies["alt_allele"].sort_index().tolist() == want["alt_allele"].sort_index().tolist()
    assert copies["score"].sort_index().tolist() == pytest.approx(want["score"].sort_index().tolist())
    assert copies["retain"].sort_index().tolist() == want["retain"].sort_index().tolist()
    reached = {(r.variant_id, r.alt_allele): r.score for r in made.reached.collect()}
    assert {(r.variant_id, r.alt_allele): r.score for r in got[got.reached].itertuples()} == pytest.approx(reached)


def plain_search(key, ref, alt, config):
    """One copy, an edit at a time, every score from scratch."""
    def score(a):
        run = incremental.Search([0], [ref], [a], ByAllele(), config, {})
        return run.score[0]

    now, best_score, retain, reached = alt, score(alt), 0, {}
    if best_score > config.benign_goal:
        reached[alt] = best_score
    import zlib

    for i in range(1, config.iterations + 1):
        free = retain >= config.retain_threshold
        edits = incremental.drawn(now, zlib.crc32(f"{key}:{i}".encode()), config.random_choices) if free else incremental.guided(now)
        found = sorted((-score(now[:p] + t), now[:p] + t) for p, t in edits)
        top = (-found[0][0], found[0][1]) if found else None
        if top and top[0] > config.benign_goal:
            reached[top[1]] = top[0]
        if top and top[0] > best_score + (config.decrease_threshold * config.scale_factor * retain if free else 0):
            best_score, now, retain = *top, 0
        else:
            retain += 1
    return now, best_score, retain, reached


def test_whole_search_as_plain():
    rng = random.Random(5)
    config = replace(DEFAULT, iterations=12, copies=2, random_choices=6)
    rows = [(i, "".join(rng.choices("ACGT", k=rng.randrange(9))), "".join(rng.choices("ACGT", k=rng.randrange(9)))) for i in range(6)] + [(9, None, None)]
    got = incremental.search(pd.DataFrame(rows, columns=["variant_id", "ref_allele", "alt_allele"]), ByAllele(), config, {})
    for i, ref, alt in rows:
        found = [plain_search(f"{i}:{k}", ref or "", alt or "", config) for k in (1, 2)]
        mine = got[(got.variant_id == i) & ~got.reached]
        assert list(zip(mine.alt_allele, mine.retain)) == [(f[0], f[2]) for f in found]
        assert mine.score.tolist() == pytest.approx([f[1] for f in found], abs=1e-5)
        assert dict(zip(*got[(got.variant_id == i) & got.reached][["alt_allele", "score"]].to_numpy().T)) == pytest.approx(found[0][3] | found[1][3], abs=1e-5)


def test_few_kept_scores(monkeypatch):
    monkeypatch.setattr(incremental, "KEPT_SCORES", 50)
    frame = pd.DataFrame([(1, "ACG", "ACGTACGT"), (2, "A", "AC")], columns=["variant_id", "ref_allele", "alt_allele"])
    config = replace(DEFAULT, iterations=6)
    few = incremental.search(frame, ByAllele(), config, {})
    monkeypatch.undo()
    assert few.equals(incremental.search(frame, ByAllele(), config, {}))


def test_repair_query(spark):
    """The whole query with its own configuration: every pathogenic variant is there, and no score fell far."""
    got = modeling.QUERIES["repair_loop"](spark, SF).toPandas()
    copies = got[~got.reached]
    v = variants.from_orders(spark, SF).where("clinical_significance = 'Pathogenic'")
    assert sorted(copies.variant_id) == sorted(r.variant_id for r in v.select("variant_id").collect())
    assert (copies.iteration == 50).all() and (got[got.reached].score > DEFAULT.benign_goal).all()
    assert modeling.QUERIES["repair_loop"](spark, SF).where("reached").count() == int(got.reached.sum())
