"""Toxicity by multiple-instance learning.

A document is a bag of sentences; each sentence's score is logistic in its words' weights, and the document's
is their noisy-or.  The weights are trained from document labels alone, so a trained model also tells which
sentences make a document toxic.

A word's features are the word and its beginnings.  Texts that are null, empty or without words have no
sentence and score 0.  Texts of any length are scored whole.  Without toxic rows to learn from all scores are 0.
Scoring reads doc_id and text only, so names of other columns cannot clash; repeated rows give repeated, equal rows, and an
empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, remainder, share_of, small_batches, table

#: The model is fitted on about so many labelled documents of each label, picked by a hash of the id.
TOXIC_DOCS, CLEAN_DOCS = 4000, 6000
#: Features kept, the documents that must have one, and rounds of the fit.
FEATURES, LEAST_DOCS, ROUNDS, RIDGE = 2048, 4, 400, 2e-4
#: Letters of the beginnings that are features.
BEGINNINGS = (4, 5, 6)
CUTOFF, CACHE_WORDS, CACHE_CHARS = 0.3, 300_000, 32

TOKEN = re.compile(r"[^\W_]+|[.!?\n]+")
ENDS = ".!?\n"


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]


class Words(dict):
    """Weight of each word, a bounded cache; what ends a sentence has the weight NaN."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        w = math.nan if word[0] in ENDS else sum(self.model.weights.get(f, 0.0) for f in features(word))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = w
        return w


def sentence_logits(text: str, words: Words) -> np.ndarray:
    """Logit of each sentence that has a word."""
    w = np.array(list(map(words.__getitem__, TOKEN.findall(text.lower()))))
    w = w[np.argmin(np.isnan(w)) :] if len(w) else w  # an end that comes first ends nothing
    end = np.isnan(w)
    if end.all():
        return np.zeros(0)
    starts = np.flatnonzero(np.r_[True, end[:-1]] & ~end)
    return words.model.bias + np.add.reduceat(np.where(end, 0.0, w), starts)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def noisy_or(z: np.ndarray) -> float:
    return float(-np.expm1(-softplus(z).sum())) if len(z) else 0.0


def offending(text: str, words: Words, least: float) -> str:
    """start:end of the sentences whose own score is a least one, comma-joined, in code points of the lower-cased text."""
    z, spans, at, end = sentence_logits(text, words), [], None, 0
    for m in TOKEN.finditer(text.lower()):
        if m[0][0] in ENDS:
            if at is not None:
                spans.append((at, m.end()))
            at = None
        else:
            at, end = (m.start() if at is None else at), m.end()
    if at is not None:
        spans.append((at, end))
    return ",".join(f"{a}:{b}" for (a, b), x in zip(spans, z) if 1 / (1 + math.exp(-x)) >= least)


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model:
    """A model from document labels.  docs: doc_id, text; labels: doc_id, toxic (0, 1 or null for unknown).

    Fitted on a bounded sample of labelled rows, weighted back to all of them.
    """
    small_batches(docs.sparkSession)
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(-math.inf, {})
    share = {1: min(1.0, toxic_docs / sizes[1]), 0: min(1.0, clean_docs / sizes[0])}
    shares = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    picked = known.where(share_of(F.col("doc_id"), 3, shares))
    # about toxic_docs + clean_docs pairs of numbers, whatever the corpus
    bags = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def count(batch: dict) -> dict:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            words = set(TOKEN.findall((text or "").lower()))
            seen[y].update({f for w in words if w[0] not in ENDS for f in features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        return {"feature": names, "toxic": [seen[1][f] for f in names], "clean": [seen[0][f] for f in names]}

    counts = per_batch(bags.select("text", "toxic"), count, "feature string, toxic long, clean long")
    sums = counts.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    rate = lambda n, of: (F.col(n) + 0.5) / (of + 1.0)
    p, q = rate("a", share[1] * sizes[1]), rate("b", share[0] * sizes[0])
    worth = F.abs(p - q) / F.sqrt(p + q)
    kept = [r["feature"] for r in sums.orderBy(worth.desc(), "feature").limit(FEATURES).collect()]
    number = {f: i for i, f in enumerate(kept)}

    def bag(batch: dict) -> dict:
        out: dict[str, list] = {"toxic": batch["toxic"], "sentences": [], "sentence": [], "feature": []}
        for text in batch["text"].to_pylist():
            n, at, has, sentence, feature = 0, -1, False, [], []
            for w in TOKEN.findall((text or "").lower()):
                if w[0] in ENDS:
                    has = False
                    continue
                n, has = n + (not has), True
                for f in features(w):
                    if (k := number.get(f)) is not None:
                        sentence.append(n - 1)
                        feature.append(k)
            out["sentences"].append(n)
            out["sentence"].append(sentence)
            out["feature"].append(feature)
        return out

    made = per_batch(bags.select("text", "toxic"), bag, "toxic int, sentences int, sentence array<int>, feature array<int>").toArrow()
    return train(
        kept,
        np.array(made["toxic"].to_pylist()),
        np.array(made["sentences"].to_pylist()),
        [np.array(x, dtype=np.intp) for x in made["sentence"].to_pylist()],
        [np.array(x, dtype=np.intp) for x in made["feature"].to_pylist()],
        {y: 1 / s for y, s in share.items()},
    )


def train(names: list[str], y: np.ndarray, sizes: np.ndarray, sentence: list, feature: list, weight: dict[int, float]) -> Model:
    """Noisy-or likelihood of the labels by full-batch Adam, with a ridge penalty."""
    if not len(y) or y.min() == y.max():
        return Model(-math.inf, {})
    # sentences that have features, numbered through; the others of a document count together
    key = np.concatenate([np.full(len(s), d) * (sizes.max() + 1) + s for d, s in enumerate(sentence)])
    cols = np.concatenate(feature)
    of, row = np.unique(key, return_inverse=True)
    doc = (of // (sizes.max() + 1)).astype(np.intp)
    plain = sizes - np.bincount(doc, minlength=len(y))
    c = np.where(y == 1, weight[1], weight[0])
    c = c / c.sum()
    theta = np.zeros(len(names) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, ROUNDS + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(row, w[cols], minlength=len(of))
        log_clean = -(np.bincount(doc, softplus(z), minlength=len(y)) + plain * softplus(np.array(b)))
        p = np.clip(-np.expm1(log_clean), 1e-9, 1.0)
        g = c * np.where(y == 1, -(1 - p) / p, 1.0)  # times the sentence's own score
        g_z = g[doc] / (1 + np.exp(-z))
        grad = np.r_[np.bincount(cols, g_z[row], minlength=len(w)) + RIDGE * w, g_z.sum() + (g * plain).sum() / (1 + math.exp(-b))]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(theta[-1]), {f: float(x) for f, x in zip(names, theta) if abs(x) > 1e-3})


def score(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, score, predicted, sentences) of each document; sentences: spans of the offending ones if predicted.

    docs: doc_id, text; other columns are not read.  Each document is scored where it is read.
    """
    small_batches(docs.sparkSession)
    made = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def rows(batch: dict) -> dict:
        words = cached(made.value)
        texts = [t.as_py() or "" for t in batch["text"]]
        p = [noisy_or(sentence_logits(t, words)) for t in texts]
        spans = [offending(t, words, cutoff) if x >= cutoff else "" for t, x in zip(texts, p)]
        return {"doc_id": batch["doc_id"], "score": p, "predicted": [int(x >= cutoff) for x in p], "sentences": spans}

    schema = "doc_id long, score double, predicted int, sentences string"
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)


_WORDS: list[Words] = []


def cached(model: Model) -> Words:
    """The worker's words, kept as long as the model is the same."""
    if not _WORDS or _WORDS[0].model != model:
        _WORDS[:] = [Words(model)]
    return _WORDS[0]


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = remainder(F.col("doc_id"), 4) != 2
    model = fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "sentences")
