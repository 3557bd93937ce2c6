"""Quality by Bradley-Terry ranking.

Labelled texts give preference pairs, a text of label 1 over one of label 0. A linear score of
text features is learned by logistic loss on the pairs' feature differences; the threshold is the
quantile of the labelled scores that parts the labels best, and a score of `cut` lies exactly there.
Features are shares and ratios of the whole text, so its length is no quality of its own.

The model is fitted on at most `sample` labelled rows, those of smallest hash: a documented bound.

Defined results: null and empty texts have all-zero features and are scored like any other; rows
without usable labels do not teach; without two classes of labels every score is `cut`; an empty
table gives an empty result; columns other than doc_id and text are never read by the score, and columns of
docs named score or predicted are replaced."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sieveline.llm._shared import ensure_workers, with_row_text
from sieveline.llm._text import rows_of

SAMPLE = 20_000
PAIRS = 200_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
NAMES = ("symbols", "bangs", "bars", "upper", "digits", "repeats", "lines", "top", "variety", "short", "long", "stops", "size")


def features(text: bytes) -> np.ndarray:
    """Shares and ratios of a text, in the order of NAMES."""
    words = text.split()
    n = len(words)
    out = np.zeros(len(NAMES))
    if not n:
        return out
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = len(text) - int(count[9:14].sum() + count[32])
    letters = int(count[65:91].sum() + count[97:123].sum() + count[192:].sum())
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, n)
    out[0] = count[SYMBOLS].sum() / solid
    out[1] = count[33] / n
    out[2] = count[124] / n
    out[3] = count[65:91].sum() / max(letters, 1)
    out[4] = count[48:58].sum() / solid
    out[5] = sum(map(eq, words, words[1:])) / n
    out[6] = 1 - len(set(lines)) / len(lines)
    out[7] = (max(seen.values()) - 1) / (n + 10)
    out[8] = 1 - (np.log(len(seen)) / np.log(n) if n > 1 else 1)
    out[9] = (lengths <= 3).mean()
    out[10] = (lengths > 14).mean()
    out[11] = min(1.0, (count[46] + count[63]) / n)
    out[12] = 1 / (1 + n / 8)
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.raw(x) - self.threshold, -60, 60) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-z))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, decay: float = 1e-3, cut: float = 0.7, seed: int = 5) -> QualityModel:
    """Weights by Newton's method on pairs' differences, threshold at the best quantile of the scores."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1] if x.ndim == 2 else len(NAMES))
    if not len(good) or not len(bad):
        return QualityModel(mean, scale, w, 0.0, cut)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        grad = -(d * p[:, None]).mean(0) + decay * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + decay * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    ranked, labels = s[order], y[order]
    low, high = np.cumsum(labels == 0) / len(bad), np.cumsum(labels == 1) / len(good)
    gain = np.where(np.append(ranked[1:] > ranked[:-1], False), low - high, -1)  # a cut lies between different scores
    k = int(np.argmax(gain))
    at = (ranked[k] + ranked[min(k + 1, len(ranked) - 1)]) / 2 if gain[k] >= 0 else ranked[-1]
    return QualityModel(mean, scale, w, float(at), cut)


def learns(doc_id: Column, parts: int = 4, held: int = 2) -> Column:
    """Whether a row may teach: crc32 of its id as text, mod parts, is not held."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != held, F.lit(True))


def labelled_sample(labels: DataFrame, label: str, sample: int, parts: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, label) of at most `sample` teaching rows of smallest hash; differing labels of an id are averaged and rounded."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learns(F.col("doc_id"), parts, held)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg(F.round(F.avg(label)).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = 0.7) -> QualityModel:
    """The model of at most `sample` labelled rows of docs; only their features reach the driver."""
    ensure_workers(docs.sparkSession)
    rows = with_row_text(docs.select(F.col("doc_id").cast("long"), "text")).join(F.broadcast(labelled_sample(labels, "quality", sample)), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1000):
            x = [features(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = rows.select("doc_id", "text", "label").mapInArrow(measure, "doc_id long, label int, x array<double>")
    got = got.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).orderBy("doc_id").select("r.*").toPandas()  # an id counts once; in order, so that reruns draw the same pairs
    x = np.array(got["x"].tolist(), float).reshape(-1, len(NAMES))
    return bradley_terry(x, got["label"].to_numpy(), cut=cut)


def scorer(spark, model: QualityModel):
    """A column function: text -> score in 0..1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def quality(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype=float)
        return pd.Series(shared.value.score(np.array([features(t.encode()) for t in text])))

    return lambda c: quality(F.coalesce(c.cast("string"), F.lit("")))


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """docs with `score` and `predicted` (1 where score >= cut)."""
    model = fit(docs, labels, sample, cut)
    out = docs.withColumn("score", scorer(docs.sparkSession, model)(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
