"""Splits, metrics, feature selection, training and scoring over feature tables, and their registered queries."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..config import DEFAULT, Config


def classify(df: DataFrame, probability: str, threshold: float = DEFAULT.threshold) -> DataFrame:
    """df with the predicted class: 1 from the threshold on."""
    return df.withColumn("predicted", (F.col(probability) >= threshold).cast("int"))


# ---- splits ----


def shuffled_place(df: DataFrame, key: str, label: str, seed: int, digits: int = 3) -> DataFrame:
    """df with each row's place, from 1, in a seeded order of its label's rows, `_place`, and their number, `_n`.

    Places are counted in two steps, within ranges of the order and over ranges, so no label is one task's.  digits: hex
    digits of the order that tell ranges apart, so 4,096 ranges of each label if not given.
    """
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    ranged = df.withColumn("_order", order).withColumn("_range", F.substring("_order", 1, digits))
    sizes = ranged.groupBy(label, "_range").agg(F.count("*").alias("_k"))
    over = Window.partitionBy(label)
    before = F.sum("_k").over(over.orderBy("_range")) - F.col("_k")
    sizes = sizes.select(label, "_range", before.alias("_before"), F.sum("_k").over(over).alias("_n"))
    within = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_order", key))
    return ranged.withColumn("_within", within).join(sizes, [label, "_range"]).withColumn("_place", F.col("_before") + F.col("_within")).drop("_order", "_range", "_within", "_before")


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: the first share of each label's rows in a seeded order, rounded up."""
    return shuffled_place(df, key, label, seed).withColumn("is_test", F.col("_place") <= F.ceil(F.col("_n") * share)).drop("_place", "_n")


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 7) -> DataFrame:
    """df with fold: from 0, dealt in a seeded order of each label's rows."""
    return shuffled_place(df, key, label, seed).withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place", "_n")


# ---- metrics, exact, from counts by score ----


#: Ranges of scores that are summed apart: each has about as many distinct scores, however they are spread.
RANGES = 256


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg, tp, fp): labels at a score, and at it or above; a row for each distinct score.

    NaN ranks above all numbers, as Spark sorts it, and null below them; -0.0 is 0.0.  Rows with a null label are left out.
    Scores are counted first.  Sums over them run in ranges, then over ranges; a range is what lies between two
    quantiles of the distinct scores, so crowded or far scores do not come to one task.
    """
    known = df.where(F.col(label).isNotNull())
    counts = known.groupBy((F.col(score).cast("double") + 0.0).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    number = F.when(~F.isnan("score"), F.col("score"))
    bounds = counts.agg(F.percentile_approx(number, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(50 * RANGES)).alias("_bounds"))
    place = F.when(F.col("score").isNull(), -1).when(F.isnan("score"), RANGES + 1).otherwise(F.size(F.filter("_bounds", lambda b: b <= F.col("score"))))
    ranged = counts.crossJoin(F.broadcast(bounds)).withColumn("_range", place).drop("_bounds")  # bounds are one row
    sums = ranged.groupBy("_range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    over = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", F.coalesce(F.sum("p").over(over), F.lit(0)).alias("_p"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("_n"))
    within = Window.partitionBy("_range").orderBy(F.desc("score"))
    out = ranged.withColumn("tp", F.sum("pos").over(within)).withColumn("fp", F.sum("neg").over(within)).join(before, "_range")
    return out.select("score", "pos", "neg", (F.col("tp") + F.col("_p")).alias("tp"), (F.col("fp") + F.col("_n")).alias("fp"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the share of pairs of labels that the score orders, ties half; null with one label only."""
    s = by_score(df, score, label)
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return s.agg((pairs / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc"))


def pr_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under precision over recall by trapezoids, from precision 1 at recall 0."""
    s = by_score(df, score, label)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    earlier_tp, earlier_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    earlier = F.when(earlier_tp + earlier_fp > 0, earlier_tp / (earlier_tp + earlier_fp)).otherwise(1.0)
    return s.agg((F.sum(F.col("pos") * (precision + earlier) / 2) / F.nullif(F.sum("pos"), F.lit(0))).alias("pr_auc"))


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the largest F1 over all thresholds, and the largest threshold that reaches it."""
    s = by_score(df, score, label)
    total = s.agg(F.sum("pos").alias("all_pos"))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_pos"))
    made = s.join(total).select("score", F.round(f1, 9).alias("f1"))  # total is one row
    return made.agg(F.max(F.struct("f1", "score")).alias("m")).select(F.col("m.f1").alias("f1"), F.col("m.score").alias("threshold"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


# ---- feature selection and training ----


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, variance) from one pass."""
    one = df.agg(*[F.var_samp(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("variance")) for i, c in enumerate(features)])
    return one.select(F.explode(pairs).alias("p")).select("p.feature", "p.variance")


def variance_sift(df: DataFrame, features: list[str], least: float) -> list[str]:
    """Features with a variance of at least so much, in the given order; the driver holds one number for each."""
    kept = {r["feature"] for r in variances(df, features).collect() if r["variance"] is not None and r["variance"] >= least}
    return [c for c in features if c in kept]


def train(df: DataFrame, features: list[str], label: str = "label", rounds: int = 20, depth: int = 4, seed: int = 42, step: float = 0.1, share: float = 0.8, held: str | None = None) -> PipelineModel:
    """A gradient-boosted classifier; nulls and NaN in features count as 0.

    held: a boolean column; its rows are not learned from, and boosting stops when their loss no longer falls.
    """
    trees = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=share, seed=seed)
    if held:
        trees = trees.setValidationIndicatorCol(held)
    return Pipeline(stages=[trees]).fit(assembled(df, features))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """df with the features as one vector; their names may hold dots."""
    values = [F.nanvl(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features]
    return df.withColumn("features", array_to_vector(F.array(*values)))


def score(model: PipelineModel, df: DataFrame, features: list[str], threshold: float = DEFAULT.threshold) -> DataFrame:
    """df with prob_benign, prob_pathogenic and predicted."""
    p = vector_to_array("probability")
    out = model.transform(assembled(df, features))
    return classify(out.withColumns({"prob_benign": p[0], "prob_pathogenic": p[1]}), "prob_pathogenic", threshold).drop("features", "rawPrediction", "probability", "prediction")


@dataclass
class Scores:
    roc: float
    pr: float
    f1: float
    importance: dict[str, float] = field(default_factory=dict)

    @property
    def total(self) -> float:
        return self.roc + self.pr + self.f1


#: Fits that are driven at once; each is a sequence of small jobs, between which executors would idle.
FITS_AT_ONCE = 4


def at_once(spark: SparkSession, f, items) -> list:
    """f of each item, several at a time, in threads that share the session."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(f), items))


def cross_validation(df: DataFrame, features: list[str], k: int = 3, key: str = "variant_id", label: str = "label", rounds: int = 10, **parameters) -> Scores:
    """Mean metrics and importances over stratified folds.  parameters: of train()."""
    dealt = folds(df, key, label, k).cache()

    def one(i: int) -> Scores:
        model = train(dealt.where(F.col("fold") != i), features, label, rounds, **parameters)
        held = score(model, dealt.where(F.col("fold") == i), features).select(label, "prob_pathogenic").cache()
        parts = [f(held, "prob_pathogenic", label).first() for f in (roc_auc, pr_auc, best_f1)]
        weight = model.stages[-1].featureImportances.toArray()
        held.unpersist()
        return Scores(*[p[0] or 0.0 for p in parts if p], dict(zip(features, map(float, weight))))

    found = at_once(df.sparkSession, one, range(k))
    dealt.unpersist()
    mean = lambda f: sum(map(f, found)) / len(found)
    return Scores(mean(lambda s: s.roc), mean(lambda s: s.pr), mean(lambda s: s.f1), {c: mean(lambda s, c=c: s.importance[c]) for c in features})


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of each class, nulls included."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("_total")).alias("share"))  # one row


@dataclass
class Evaluation:
    model: PipelineModel
    summary: dict[str, float]
    confusion: list[tuple[int, int, int]]


def evaluate(df: DataFrame, features: list[str], key: str = "variant_id", label: str = "label", k: int = 5, rounds: int = 20) -> Evaluation:
    """Metrics over folds, then a fit with early stopping, judged on a test set that neither saw.

    A fifth of each class is the test set; of the others, a fifth of each class decides when boosting stops.
    """
    split = stratified_split(df, key, label)
    learned, test = split.where("not is_test").drop("is_test"), split.where("is_test")
    folds_ = cross_validation(learned, features, k, key, label, rounds)
    held = stratified_split(learned, key, label, seed=7)
    model = train(held, features, label, rounds, held="is_test")
    scored = score(model, test, features).select(label, "prob_pathogenic", "predicted").cache()
    table = [tuple(r) for r in confusion(scored, label, "predicted").collect()]
    f1 = best_f1(scored, "prob_pathogenic", label).first()
    parts = {"roc_auc": roc_auc(scored, "prob_pathogenic", label).first()[0], "pr_auc": pr_auc(scored, "prob_pathogenic", label).first()[0]}
    scored.unpersist()
    wrong = {"false_negatives": float(sum(n for y, p, n in table if y == 1 and p == 0)), "false_positives": float(sum(n for y, p, n in table if y == 0 and p == 1))}
    means = {"fold_roc_auc": folds_.roc, "fold_pr_auc": folds_.pr, "fold_f1": folds_.f1}
    best = {"f1": f1["f1"] if f1 else None, "best_threshold": f1["threshold"] if f1 else None}
    return Evaluation(model, means | parts | wrong | best | {"rounds": float(model.stages[-1].getNumTrees)}, table)


def successive_halving(df: DataFrame, features: list[str], trials: int = 9, keep: int = 3, rounds: int = 3, k: int = 3, seed: int = 42, **columns) -> list[dict]:
    """A row for each trial at each rung, with its parameters of train() and its mean F1 over folds.

    The first rung tries seeded random parameters with few rounds of boosting; each next one gives the best 1 / keep of them
    keep times the rounds, until one is left.  Of equal ones the first drawn goes on.
    """
    draw = random.Random(seed)
    tried = {i: {"depth": draw.randint(2, 6), "step": 10 ** draw.uniform(-2, -0.3), "share": draw.uniform(0.5, 1.0)} for i in range(trials)}
    alive, rows, rung = list(tried), [], 0
    while alive:
        one = lambda i, rounds=rounds: cross_validation(df, features, k, rounds=rounds, **columns, **tried[i]).f1
        scores = dict(zip(alive, at_once(df.sparkSession, one, alive)))
        ranked = sorted(alive, key=lambda i: (-scores[i], i))
        going = ranked[: max(len(ranked) // keep, 1)] if len(ranked) > 1 else []
        rows += [{"rung": rung, "trial": i, "rounds": rounds, **tried[i], "f1": scores[i], "kept": i in going or len(ranked) == 1} for i in alive]
        alive, rounds, rung = going, rounds * keep, rung + 1
    return rows


def binary_variance_search(trial, features_at, low: float = 0.0, high: float = 0.3, runs: int = 10, plateau: float = 0.005) -> tuple[float, float]:
    """(threshold, score): a search for the variance threshold of the best score.

    trial: from features to a score; features_at: from a threshold to its features.  Each round tries the middle and a
    quarter of the range to either side, moves towards the best of them, and ends on a plateau of three middles.
    """
    best, known, mids = (-1.0, 0.0), {}, []

    def value(t: float) -> float:
        kept = tuple(features_at(t))
        if kept and kept not in known:
            known[kept] = trial(list(kept))
        return known.get(kept, -1.0)

    for _ in range(runs):
        mid, step = (low + high) / 2, (high - low) / 4
        tried = {t: value(t) for t in (mid, mid - step, mid + step)}
        top = max(tried, key=lambda t: (tried[t], -t))
        best = max(best, (tried[top], top), key=lambda x: x[0])
        low, high = max(low, top - step), min(high, top + step)
        mids.append(mid)
        if len(mids) >= 3 and max(mids[-3:]) - min(mids[-3:]) < plateau:
            break
    return best[1], best[0]


def backward_elimination(df: DataFrame, features: list[str], drop: float = 0.01, patience: int = 3, rounds: int = 10, most: int | None = None, k: int = 3) -> tuple[list[str], list[dict]]:
    """(features, steps): leaves out the least important feature while no metric falls by `drop`."""
    base = cross_validation(df, features, k, rounds=rounds)
    best, kept, steps, misses, now = base, list(features), [], 0, list(features)
    scores = base
    while len(now) > 1 and misses < patience and (most is None or len(steps) < most):
        least = min(now, key=lambda c: (scores.importance[c], c))
        now = [c for c in now if c != least]
        scores = cross_validation(df, now, k, rounds=rounds)
        steps.append({"dropped": least, "features": len(now), "roc_auc": scores.roc, "pr_auc": scores.pr, "f1": scores.f1})
        if scores.total <= best.total - drop or min(best.roc - scores.roc, best.pr - scores.pr, best.f1 - scores.f1) >= drop:
            break
        if scores.total >= best.total:
            best, kept, misses = scores, list(now), 0
        else:
            misses += 1
    return kept, steps


def feature_list_json(name: str, time: str, threshold: float, features: list[str]) -> str:
    return json.dumps({"ModelName": name, "Time": time, "Optimal_var_threshold": threshold, "n_features": len(features), "features": features}, indent=2)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text as a folder with one file, in any store that Spark writes to."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0].strip()


def read_feature_list(text: str) -> list[str]:
    return list(json.loads(text)["features"])


def stats_report(model: PipelineModel, features: list[str], metrics: dict[str, float], table: list[tuple[int, int, int]]) -> str:
    """Parameters, metrics, confusion and importances, smallest first, as text."""
    weights = dict(zip(features, model.stages[-1].featureImportances.toArray()))
    lines = [f"{k}: {v:.6f}" for k, v in metrics.items()] + [f"label {a}, predicted {b}: {n}" for a, b, n in sorted(table)]
    return "\n".join([*lines, *(f"{c} {w:.6f}" for c, w in sorted(weights.items(), key=lambda x: (x[1], x[0])))]) + "\n"


def write_predictions(scored: DataFrame, path: str) -> None:
    """Name, class and probabilities as CSV with a header."""
    out = scored.select(F.col("name").alias("Name"), F.col("predicted").alias("Predicted_Class"), F.col("prob_benign").alias("Prob_Benign"), F.col("prob_pathogenic").alias("Prob_Pathogenic"))
    out.write.mode("overwrite").csv(path, header=True)


# ---- registered queries ----

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LABELLED_SQL = "WITH s AS (SELECT d.doc_id, toxic AS label, n_chars / (n_chars + 1000.0) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)\n"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.join(labels, "doc_id").select("doc_id", F.col("toxic").alias("label"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))


def register(name: str, oracle: str | None = None):
    def inner(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return inner


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("variance_sift", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_samp({c}), 4) AS variance, var_samp({c}) >= 0.1125 AS kept FROM lineitem" for c in NUMBERS))
def _(spark, sf_dir):
    v = variances(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), NUMBERS)
    return v.select("feature", F.round("variance", 4).alias("variance"), (F.col("variance") >= 0.1125).alias("kept"))


def shuffled_sql(seed: int) -> str:
    return f"SELECT doc_id, toxic AS label, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || ':{seed}'), doc_id) AS place, count(*) OVER (PARTITION BY toxic) AS n FROM labels"


@register("stratified_split", f"SELECT doc_id, label, place <= ceil(n * 0.2) AS is_test FROM ({shuffled_sql(42)})")
def _(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return stratified_split(labels, "doc_id", "label").select("doc_id", "label", "is_test")


@register("fold_assign", f"SELECT doc_id, label, ((place - 1) % 5)::INT AS fold FROM ({shuffled_sql(7)})")
def _(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return folds(labels, "doc_id", "label").select("doc_id", "label", "fold")


CURVE = LABELLED_SQL + """, c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
r AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM c)
"""


@register("roc_auc", CURVE + "SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM r")
def _(spark, sf_dir):
    return roc_auc(labelled(spark, sf_dir), "score", "label").select(F.round("roc_auc", 9).alias("roc_auc"))


@register("pr_auc", CURVE + "SELECT round(sum(pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END) / 2) / sum(pos), 9) AS pr_auc FROM r")
def _(spark, sf_dir):
    return pr_auc(labelled(spark, sf_dir), "score", "label").select(F.round("pr_auc", 9).alias("pr_auc"))


@register("best_f1", CURVE + ", f AS (SELECT round(2 * tp / (tp + fp + sum(pos) OVER ()), 9) AS f1, score FROM r) SELECT f1, round(score, 9) AS threshold FROM f ORDER BY f1 DESC, score DESC LIMIT 1")
def _(spark, sf_dir):
    return best_f1(labelled(spark, sf_dir), "score", "label").select("f1", F.round("threshold", 9).alias("threshold"))


@register("confusion_matrix", LABELLED_SQL + "SELECT label, (score >= 0.513)::INT AS predicted, count(*) AS n FROM s GROUP BY ALL")
def _(spark, sf_dir):
    return confusion(classify(labelled(spark, sf_dir), "score"), "label", "predicted")
