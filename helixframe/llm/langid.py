"""Language identification by multilingual mixtures.

Every word's likelihood in each language comes from hashed character trigrams.  Expectation-maximisation
estimates each document's language proportions over its words; languages are then taken away, smallest
first, and the set with the best likelihood less a penalty for each language is kept.

A text that is null or has no letter gets `und` and score 0, as every text does if there is nothing to
learn from.  A text of any length is used whole.  Ties go to the language that sorts first.
Prediction reads doc_id and text only, so names of other columns cannot clash; repeated rows give repeated, equal rows, and an
empty table gives an empty one.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, remainder, share_of, small_batches, table

UNDETERMINED = "und"
BUCKETS = 1 << 16
#: The likelihoods are fitted on about so many documents of each language, picked by a hash of the id; of so many languages at most.
DOCS_PER_LANGUAGE, MOST_LANGUAGES = 3000, 256
SMOOTHING, ROUNDS, MORE_ROUNDS, PENALTY, NEGLIGIBLE = 0.2, 6, 3, 1.0, 1e-3
#: Characters worked on at once.
CHUNK = 1 << 20

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, zero for what is no letter, and where each text starts; texts end with zeros."""
    parts = [t.lower().encode("utf-32-le", "surrogatepass") + bytes(8) for t in texts]
    c = np.frombuffer(b"".join([bytes(4), *parts]), dtype=np.uint32)
    c = np.where(letters()[c], c, np.uint32(0))
    return c, np.cumsum([1, *(len(p) // 4 for p in parts)])


def trigrams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the middle letter, bucket) of every trigram whose middle is a letter."""
    at = np.flatnonzero(c)
    h = c[at - 1] * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA77) + c[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return at, (h >> np.uint32(16)).astype(np.intp)


def chunks(texts: list[str | None], most: int = CHUNK):
    """Runs of texts of about so many characters together."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= most:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the log likelihood of each bucket in them.  docs: doc_id, text, lang.

    Fitted on a bounded sample: about docs_per_language documents of each of the most_languages commonest languages.
    """
    small_batches(docs.sparkSession)
    known = docs.where("text is not null and lang is not null")
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    sizes = {r["lang"]: r["n"] for r in common.collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, float(min(1.0, docs_per_language / sizes[k])))])
    picked = known.where(share_of(F.col("doc_id"), 5, share[F.col("lang")]))

    def count(batch: dict) -> dict:
        out: dict[str, list] = {"lang": [], "bucket": [], "n": []}
        of = np.array(batch["lang"].to_pylist(), dtype=object)
        for lang in set(of):
            texts = batch["text"].filter(_mask(of == lang)).to_pylist()
            total = np.zeros(BUCKETS, dtype=np.int64)
            for a, b in chunks(texts):
                total += np.bincount(trigrams(codes(texts[a:b])[0])[1], minlength=BUCKETS)
            seen = np.flatnonzero(total)
            out["lang"] += [lang] * len(seen)
            out["bucket"] += seen.tolist()
            out["n"] += total[seen].tolist()
        return out

    rows = per_batch(picked.select("text", "lang"), count, "lang string, bucket int, n long")
    made = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS for each language
    n = np.zeros((len(langs), BUCKETS))
    place = {k: i for i, k in enumerate(langs)}
    which = np.array([place[k] for k in made["lang"].to_pylist()], dtype=np.intp)
    n[which, made["bucket"].to_numpy()] = made["n"].to_numpy()
    seen = n.sum(0) > 0
    table = np.log((n + SMOOTHING) / (n.sum(1, keepdims=True) + SMOOTHING * max(1, seen.sum())))
    table[:, ~seen] = 0.0  # says nothing about any language
    return langs, table.astype(np.float32)


def _mask(which: np.ndarray):
    import pyarrow as pa

    return pa.array(which)


def mixture(like: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(full, chosen): proportions with all languages, and of the best set, each languages x documents.

    like: log likelihood, languages x words, a document's words together; every document has words.
    """
    top = like.max(0)
    e = np.exp(like - top)
    base = np.add.reduceat(top.astype(np.float64), starts)
    n_langs = len(like)

    def step(pi: np.ndarray) -> np.ndarray:
        t = np.repeat(pi, sizes, axis=1) * e
        t /= np.maximum(t.sum(0), 1e-30)
        return np.add.reduceat(t, starts, axis=1) / sizes.astype(np.float32)

    def score(pi: np.ndarray) -> np.ndarray:
        mixed = np.log(np.maximum((np.repeat(pi, sizes, axis=1) * e).sum(0), 1e-30))
        return 2 * (base + np.add.reduceat(mixed.astype(np.float64), starts)) - penalty * np.log(sizes + 1.0) * ((pi > 0).sum(0) - 1)

    pi = np.full((n_langs, len(starts)), 1 / n_langs, dtype=np.float32)
    for _ in range(ROUNDS):
        pi = step(pi)
    full, best, chosen = pi, score(pi), pi
    pi = np.where((pi < NEGLIGIBLE) & (pi < pi.max(0)), 0, pi)
    columns = np.arange(len(starts))
    while ((pi > 0).sum(0) > 1).any():
        # the smallest goes, of equal ones the last
        drop = n_langs - 1 - np.where(pi > 0, pi, np.inf)[::-1].argmin(0)
        drop, where = drop[several := (pi > 0).sum(0) > 1], columns[several]
        pi[drop, where] = 0
        pi /= pi.sum(0)
        for _ in range(MORE_ROUNDS):
            pi = step(pi)
        now = score(pi)
        better = now >= best
        chosen, best = np.where(better, pi, chosen), np.where(better, now, best)
    return full, chosen


def identify(texts: list[str | None], model: tuple[list[str], np.ndarray]) -> tuple[list, list, list]:
    """(lang_pred, score, lang_set) of each text."""
    langs, table = model
    pred, score, sets = [UNDETERMINED] * len(texts), [0.0] * len(texts), [""] * len(texts)
    for a, b in chunks(texts) if langs else ():
        c, first = codes([t or "" for t in texts[a:b]])
        at, gram = trigrams(c)
        if not len(at):
            continue
        new = np.flatnonzero(c[at - 1] == 0)  # each word's first letter
        like = np.add.reduceat(table[:, gram], new, axis=1)
        doc = np.searchsorted(first, at[new], side="right") - 1
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        full, chosen = mixture(like, starts, np.diff(starts, append=len(doc)))
        win = chosen.argmax(0)
        for j, d in enumerate(doc[starts].tolist()):
            w = win[j]
            pred[a + d], score[a + d] = langs[w], float(min(1.0, full[w, j]))
            sets[a + d] = ",".join(f"{langs[k]}:{chosen[k, j]:.3f}" for k in np.flatnonzero(chosen[:, j] > 0))
    return pred, score, sets


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, lang_set) of each document.  docs: doc_id, text; other columns are not read.

    score: the share of the document's words in lang_pred; lang_set: the chosen languages with their shares.
    """
    small_batches(docs.sparkSession)
    made = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS, whatever the corpus

    def rows(batch: dict) -> dict:
        pred, score, sets = identify(batch["text"].to_pylist(), made.value)
        return {"doc_id": batch["doc_id"], "lang_pred": pred, "score": score, "lang_set": sets}

    schema = "doc_id long, lang_pred string, score double, lang_set string"
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)


def scorer(spark: SparkSession, model: tuple[list[str], np.ndarray]):
    """A column function from a text to the score of its predicted language."""
    made = spark.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(identify([t if isinstance(t, str) else None for t in texts], made.value)[1], dtype=float)

    return F.pandas_udf(score, "double")


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    out = predict(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "lang_set")


def keep_identified(docs: DataFrame, least: float) -> DataFrame:
    """docs without those whose language is undetermined or holds less than a share of the words.

    The model is learned from docs' own labels and applied in the same pass that reads each text, so no text
    is shuffled.  All columns stay as they are; none is named like a result of predict.
    """
    small_batches(docs.sparkSession)
    score = scorer(docs.sparkSession, fit(docs))
    return docs.where(F.coalesce(score(F.col("text")), F.lit(0.0)) >= least)
