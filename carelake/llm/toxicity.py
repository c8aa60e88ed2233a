"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 toxic and of low quality. One weight
vector is shared by all thresholds: P(grade > k) = sigmoid(w x - t_k) with
t_0 < t_1, so a text that is more likely past one threshold is so past all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import map_text, utf8, words_of
from carelake.session import staged

GRADES = 3
#: Labelled texts of each grade in the training sample, at most.
SAMPLE = 2000
#: Features of the model at most, and the least chi-square by which one must tell toxic from clean.
FEATURES, LEAST_CHI2 = 4096, 30.0
#: Bytes of word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: Steps of training, and what keeps weights small.
STEPS, PENALTY = 1000, 0.01
_KNOWN = 1 << 19


def _features(word: bytes) -> list[str]:
    """A word and its beginnings; bytes are written one to one, so cut characters do no harm."""
    text = word.decode("latin-1")
    return [f"={text}", *(f"{n}{text[:n]}" for n in PREFIXES if len(text) > n)]


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of the labelled documents; of several labels the most severe counts, a null one never."""
    low = F.when(F.col("quality") == 0, 1).otherwise(0)
    grade = F.when(F.col("toxic") > 0, F.lit(1) + low).otherwise(0)
    return labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(grade).alias("grade"))


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``grade, features`` of the sample: per grade the documents of the smallest hashes, equal texts once."""
    grades = graded(labels)
    ids = None
    for g in range(GRADES):
        own = grades.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        ids = own if ids is None else ids.unionByName(own)
    # At most GRADES * SAMPLE ids.
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text IS NOT NULL").groupBy(
        F.xxhash64("text").alias("key"), "grade").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({f for w in set(words_of(t)) for f in _features(w)}) for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))],
                                             names=["key", "grade", "features"])
    return staged(map_text(texts.select("key", "grade", "text"), run, "key long, grade int, features array<string>"),
                  "toxic-sample")


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[bytes, tuple] = {}

    def score(self, words: set[bytes]) -> float:
        """Sum of the weights of the features that a text has, each once."""
        have: set[str] = set()
        for word in words:
            own = self.known.get(word)
            if own is None:
                if len(self.known) >= _KNOWN:
                    self.known.clear()
                own = self.known[word] = tuple(f for f in _features(word) if f in self.weights)
            if own:
                have.update(own)
        return float(sum(self.weights[f] for f in sorted(have)))

    def past(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), one column per k."""
        return _sigmoid(np.asarray(scores, float)[:, None] - self.thresholds)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, weights: np.ndarray, size: int,
        steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood of the graded rows.

    ``rows`` and ``columns`` list the features that are present; ``weights``
    is what each graded row counts. Thresholds are a first one and positive
    gaps, so they stay ordered; a grade that never occurs only moves its gap.
    """
    w, first, gaps = np.zeros(size), np.zeros(1), np.zeros(GRADES - 2)
    values = [w, first, gaps]
    mean, square = ([np.zeros_like(v) for v in values] for _ in range(2))
    for step in range(1, steps + 1):
        thresholds = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        eta = np.bincount(rows, w[columns], len(grades))
        past = np.hstack([np.ones((len(grades), 1)), _sigmoid(eta[:, None] - thresholds), np.zeros((len(grades), 1))])
        at = np.arange(len(grades))
        upper, lower = past[at, grades], past[at, grades + 1]
        chance = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / chance * weights, lower * (1 - lower) / chance * weights
        slope_t = np.zeros(GRADES + 1)
        np.add.at(slope_t, grades, -up)
        np.add.at(slope_t, grades + 1, down)
        slope_t = slope_t[1:-1]
        slopes = [np.bincount(columns, (up - down)[rows], size) - penalty * w, np.array([slope_t.sum()]),
                  np.cumsum(slope_t[::-1])[::-1][1:] * np.exp(gaps) - penalty * gaps]
        for i, slope in enumerate(slopes):
            mean[i] += 0.1 * (slope - mean[i])
            square[i] += 0.01 * (slope ** 2 - square[i])
            values[i] += 0.05 * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.99 ** step)) + 1e-8)
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the model to a bounded sample of labelled documents.

    The sample holds at most ``SAMPLE`` documents of each grade; each counts
    as many as its grade has labels behind it, so chances are those of all
    labels. Features are chosen over the sample in Spark; what reaches the
    driver is bounded by the sample and ``FEATURES``. Without toxic or without
    clean examples no text is toxic.
    """
    sample = _sampled(docs, labels)
    counts = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = counts.get(0, 0), sum(n for g, n in counts.items() if g)
    if not clean or not toxic:
        return Model({}, np.arange(1, GRADES) * 50.0)
    seen = sample.select("grade", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("t"), F.count(F.lit(1)).alias("n"))
    share = F.col("n") / (clean + toxic)
    gap = F.col("t") / toxic - (F.col("n") - F.col("t")) / clean
    chi2 = gap * gap / (share * (1 - share)) * (clean * toxic / (clean + toxic))
    chosen = seen.where("n > 2").withColumn("chi2", F.when(share < 1, chi2).otherwise(0.0)).where(
        F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "f").limit(FEATURES).select("f")
    names = {r["f"]: i for i, r in enumerate(chosen.orderBy("f").collect())}
    have = F.filter("features", lambda f: F.array_contains(F.lit(sorted(names)), f)) if names else F.array()
    texts = sample.select("key", "grade", have.cast("array<string>").alias("f")).orderBy("key", "grade").collect()
    grades = np.array([r["grade"] for r in texts])
    rows = np.array([i for i, r in enumerate(texts) for _ in r["f"]], np.int64)
    columns = np.array([names[f] for r in texts for f in r["f"]], np.int64)
    behind = {r["grade"]: r["n"] for r in graded(labels).groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.array([behind[g] / counts[g] for g in grades])
    weights, thresholds = fit(rows, columns, grades, weight * len(grades) / weight.sum(), len(names))
    return Model({f: float(weights[i]) for f, i in names.items()}, thresholds)


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, key, grade, severity, p_toxic``: one row per row of ``docs``.

    ``severity`` is the expected grade, the sum of P(grade > k); ``grade`` the
    number of thresholds the text is more likely past than not; ``key`` is
    ``xxhash64(text)``. Null and empty texts have no features and the grade of
    a text without any. Whole texts are read; a feature counts once however
    often it occurs, so repeats and length change nothing by themselves.
    Other columns are not read; empty tables give no rows. The model, at most
    ``FEATURES`` weights, is what tasks are sent.
    """
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, thresholds)
        for batch in batches:
            past = own.past([own.score(set(words_of(t))) for t in utf8(batch.column(1))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array((past > 0.5).sum(axis=1).astype(np.int32)),
                 pa.array(past.sum(axis=1)), pa.array(past[:, 0])], names=["doc_id", "key", "grade", "severity", "p_toxic"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), run,
                    f"doc_id {kind}, key long, grade int, severity double, p_toxic double")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows of grade 1 and above; all columns pass through as they are.

    Texts are graded where they are read, so nothing is shuffled.
    """
    weights, thresholds = model.weights, model.thresholds
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, thresholds)
        for batch in batches:
            past = own.past([own.score(set(words_of(t))) for t in utf8(batch.column(text))])
            yield batch.filter(pa.array(past[:, 0] <= 0.5, pa.bool_()))
    return map_text(docs, run, docs.schema)
