"""Toxic passages: maximum-scoring segments over word log-odds, calibrated by extreme values."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, cut, hash_words, slices, split_words, tidy

#: A word is known by its first bytes too, so that inflected forms share what is known of their stem; 0: the whole word.
STEMS = (4, 6, 0)


class Settings(NamedTuple):
    """sample: most labelled rows that the model is fitted on, those of smallest hash. prior: weight of the Dirichlet
    prior, as a share of the documents learnt from. deviations: how far a log-odds is lowered for its uncertainty. drift: what each word costs
    a passage. significant: most expected passages as good by chance. cap: most nats that a document's evidence counts."""

    sample: int = 20_000
    prior: float = 0.05
    deviations: float = 1.96
    drift: float = 0.5
    significant: float = 0.05
    cap: float = 60.0


class Model(NamedTuple):
    """features: sorted hashes; odds: their log-odds; rate, decay: K and lambda of the law that chance passages follow;
    slope and intercept: from a document's evidence to the logit of its score."""

    features: np.ndarray
    odds: np.ndarray
    rate: float
    decay: float
    slope: float
    intercept: float


def _features(w: Words) -> list[np.ndarray]:
    """One hash per word for each of STEMS."""
    return [hash_words(w, np.minimum(w.end, w.start + k) if k else None) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in STEMS]


def word_odds(w: Words, model: Model, drift: float) -> np.ndarray:
    """Each word's score: the largest log-odds known of it or its stems, or none, less drift."""
    best = np.zeros(len(w.start))
    if len(model.features):
        for h in _features(w):
            at = np.minimum(np.searchsorted(model.features, h), len(model.features) - 1)
            np.maximum(best, np.where(model.features[at] == h, model.odds[at], 0), out=best)
    return best - drift


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in linear time: each candidate joins the nearest one before it
    that began lower, if it also reaches higher. Runs without a positive score are stepped over in one."""
    at = np.flatnonzero(scores > 0)
    total = np.concatenate(([0.0], np.cumsum(scores)))
    held: list[list] = []  # start, end, total before it, total at its end, index of the nearest one that begins lower
    for i in at.tolist():
        new = [i, i + 1, total[i], total[i + 1], -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                new[4] = j
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3], -1]
            del held[j:]
    return [(h[0], h[1], float(h[3] - h[2])) for h in held]


def _evidence(n: int, found: list[tuple[int, int, float]], model: Model, settings: Settings) -> tuple[float, list]:
    """A document's evidence and significant passages (start, end, score, expected). By Karlin and Altschul's law about
    rate * n * exp(-decay * score) passages score as well by chance; -log of that, summed over significant ones, is evidence."""
    rated = [(a, b, s, model.rate * n * float(np.exp(-model.decay * s))) for a, b, s in found]
    good = [r for r in rated if r[3] <= settings.significant]
    return min(settings.cap, sum(-np.log(max(r[3], 1e-300)) for r in good)), good


def chance_law(scores: np.ndarray, words: int) -> tuple[float, float]:
    """(rate, decay): K and lambda of the law of chance passages, from the maximal segments of clean texts of `words` words.

    Above one nat the excess of a chance segment is exponential, so lambda is the number of such segments over their
    summed excess (with one segment of one nat put to both), and K makes as many expected to reach one nat as do."""
    excess = scores[scores >= 1.0] - 1.0
    decay = float((len(excess) + 1) / (excess.sum() + 1))
    return (len(excess) + 1) / max(1, words) * float(np.exp(decay)), decay


def _scan(w: Words, model: Model, settings: Settings) -> Iterator[tuple[int, list]]:
    """Each text's number of words and segments."""
    odds = word_odds(w, model, settings.drift)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        part = odds[a:b]
        yield b - a, segments(part) if (part > 0).any() else []


def fit(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str, text: str, settings: Settings) -> Model:
    """Log-odds from three quarters of the sample; chance rate and final scale from the last, which they haven't seen.

    Only labelled rows with toxic 0 or 1 count; if both labels aren't there, the model knows no word. At most
    settings.sample rows are drawn, so what is broadcast and collected is bounded by them. Of an id with several texts
    the one of the smallest hash is learnt from.
    """
    drawn = (
        labels.where(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
        .select(F.col("doc_id").alias("labelled"), "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("scale")), F.lit(4)) == 0).alias("held"))
    )
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # One text for each labelled id, so what is kept here, and what of it is collected, is bounded by the sample.
    found = texts.join(F.broadcast(drawn), F.col("id") == F.col("labelled"))
    known = cut(found.groupBy("labelled", "toxic", "held").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("x")).select(F.col("x.t").alias("text"), "toxic", "held"))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                toxic = part.column(1).to_numpy().astype(np.int64)
                w = split_words(part.column(0), ALNUM)
                pairs = np.unique(np.concatenate([np.stack([h, w.doc.astype(np.uint64)], 1) for h in _features(w)]), axis=0) if len(w.start) else np.zeros((0, 2), np.uint64)
                feature, back = np.unique(pairs[:, 0], return_inverse=True)
                bad = np.bincount(back, toxic[pairs[:, 1].astype(np.int64)], len(feature)).astype(np.int64)
                every = np.bincount(back, minlength=len(feature))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*feature.view(np.int64), 0]), pa.array([*bad, toxic.sum()]), pa.array([*(every - bad), (1 - toxic).sum()])], names=["feature", "bad", "good"]
                )

    counted = known.where("not held").select("text", "toxic").mapInArrow(count, "feature long, bad long, good long")
    # At most settings.sample documents' words can come here, and only those of two toxic ones do.
    counts = counted.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad >= 2 or feature = 0").toPandas()
    total = counts[counts["feature"] == 0]
    n_bad, n_good = (int(total["bad"].sum()), int(total["good"].sum())) if len(total) else (0, 0)
    counts = counts[counts["feature"] != 0]
    if not n_bad or not n_good:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, 1.0, -3.0)
    bad, good = counts["bad"].to_numpy(float), counts["good"].to_numpy(float)
    weight = settings.prior * (n_bad + n_good)
    prior = weight * (bad + good) / (n_bad + n_good)

    def logit(y: np.ndarray, n: int) -> np.ndarray:
        return np.log(y + prior) - np.log(np.maximum(n + weight - y - prior, 1e-9))

    odds = logit(bad, n_bad) - logit(good, n_good) - settings.deviations * np.sqrt(1 / (bad + prior) + 1 / (good + prior))
    features = counts["feature"].to_numpy(np.int64).view(np.uint64)[odds > 0]
    order = np.argsort(features)
    model = Model(features[order], odds[odds > 0][order], 1.0, 1.0, 1.0, 0.0)

    @tidy
    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                rows = [(n, [s for _, _, s in found]) for n, found in _scan(split_words(part.column(0), ALNUM), model, settings)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).cast(pa.int64()), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.float64()))], names=["toxic", "n", "scores"]
                )

    seen = known.where("held").select("text", "toxic").mapInArrow(trial, "toxic long, n long, scores array<double>").toPandas()
    clean = seen[seen["toxic"] == 0]
    rate, decay = chance_law(np.array([s for scores in clean["scores"] for s in scores]), int(clean["n"].sum()))
    model = model._replace(rate=rate, decay=decay)
    x = np.array([_evidence(n, [(0, 0, s) for s in scores], model, settings)[0] for n, scores in zip(seen["n"], seen["scores"], strict=True)])
    y = seen["toxic"].to_numpy(float)
    slope, intercept = _scale(x, y)
    # No evidence says no more than that a document is one of the sample.
    return model._replace(slope=slope, intercept=min(intercept, float(np.log((n_bad + 1) / (n_good + 1)))))


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of y on x, slightly ridged; targets as Platt draws them in, so that separable cases stay finite."""
    if not len(y) or y.min() == y.max():
        return 1.0, -3.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.stack([x, np.ones(len(x))], 1)
    beta = np.array([0.1, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (target - p) - 1e-3 * beta)
        beta += np.clip(step, -1, 1)
    return max(float(beta[0]), 1e-3), float(beta[1])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, settings: Settings = Settings()
) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted, n_words, passages.

    labels: (doc_id, toxic); train: which of its rows may be learnt from (all). Words are runs of letters, digits and
    non-ASCII characters after lower-casing A-Z. passages lists each significant toxic passage as (first word, word
    after its last, score in nats, expected number by chance). score, from 0 to 1, rises with their joint evidence;
    predicted is 1 at threshold and above. Null and empty texts have no passages and the score of no evidence, as have
    all texts if the labels are all alike or missing. A text of any length is read whole, in time and memory that grow
    with it. Null ids are scored like others. Repeated rows score alike; no rows give no rows; other columns, whatever
    their names, and labels of documents that aren't there play no part.
    """
    model = fit(docs, labels, F.lit(True) if train is None else train, doc_id, text, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                ns, scores, passages = [], [], []
                for n, found in _scan(split_words(part.column(1), ALNUM), model, settings):
                    evidence, good = _evidence(n, found, model, settings)
                    ns.append(n)
                    scores.append(1 / (1 + np.exp(-(model.slope * evidence + model.intercept))))
                    passages.append([dict(zip(("start", "end", "score", "expected"), g, strict=True)) for g in good])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(ns, pa.int64()), pa.array(passages, kind)], names=["doc_id", "score", "n_words", "passages"])

    id_type = docs.select(doc_id).schema.fields[0].dataType.simpleString()
    made = docs.select(doc_id, text).mapInArrow(run, f"doc_id {id_type}, score double, n_words long, passages array<struct<start:long,end:long,score:double,expected:double>>")
    return made.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """docs, all columns, without the rows that score_toxicity predicts toxic. Texts don't move: each task scores its own rows.

    Nulls, empty and very long texts, repeated rows and empty tables as there; repeated rows stay or go together.
    """
    model = fit(docs, labels, F.lit(True), doc_id, text, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, at):
                evidence = np.array([_evidence(n, found, model, settings)[0] for n, found in _scan(split_words(part.column(at), ALNUM), model, settings)])
                keep = 1 / (1 + np.exp(-(model.slope * evidence + model.intercept))) < threshold
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
