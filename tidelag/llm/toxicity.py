"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = 1 / (1 + exp(threshold_k - weights . x)): one weight vector serves all thresholds. The
features are all words of a text, hashed into a fixed number of buckets, x the log(1 + count) of each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows used for the fit at most, those with the lowest hash of their key.
MAX_LABELLED = 5_000
#: Buckets that words are hashed into; the weights that tasks get are 8 bytes a bucket.
BUCKETS = 1 << 20
GRADES = 3
#: A feature's G-squared at which its weight costs four times as much as with no end of evidence.
PRIOR = 20.0
#: Words whose buckets a worker remembers at most.
REMEMBERED = 300_000

_words = re.compile(r"[^\W\d_]+").findall
_known: dict[str, int] = {}


def buckets_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's words, lower-cased, and log(1 + occurrences) of each."""
    if not text or not (words := _words(text.lower())):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    found = list(map(_known.get, words))
    if None in found:
        if len(_known) > REMEMBERED:
            _known.clear()
        for w in set(words):
            if w not in _known:
                _known[w] = zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS
        found = list(map(_known.__getitem__, words))
    at, n = np.unique(np.array(found, dtype=np.int64), return_counts=True)
    return at, np.log1p(n)


@dataclass(frozen=True)
class SeverityModel:
    """A weight for each bucket; thresholds rise, one fewer than there are grades; cutoff is on P(grade > 0)."""

    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float = 0.5

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """Probability, for each score, that the grade exceeds 0, 1, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


@dataclass(frozen=True)
class Rows:
    """Sparse features: entry i is val[i] in bucket col[i] of row row[i]; n rows."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Rows:
        found = list(texts)
        sizes = [len(at) for at, _ in found]
        none = [np.zeros(0)]
        return cls(np.repeat(np.arange(len(found)), sizes), np.concatenate([np.zeros(0, dtype=np.int64), *[at for at, _ in found]]), np.concatenate([*none, *[x for _, x in found]]), len(found))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * weights[self.col], minlength=self.n)

    def where(self, wanted: np.ndarray) -> Rows:
        keep, place = wanted[self.row], np.cumsum(wanted) - 1
        return Rows(place[self.row[keep]], self.col[keep], self.val[keep], int(wanted.sum()))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, toxic of `most` labelled documents at most; the rest of the labels is not used.

    Of several labels of a document the highest counts; null keys or labels give no row. What is
    broadcast has `most` rows of a key and a grade.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def association(col: np.ndarray, row: np.ndarray, size: int, toxic: np.ndarray) -> np.ndarray:
    """For each feature, g / (g + PRIOR), g the G-squared of its presence and a toxic label: how far its weight may go."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    a = np.bincount(col, toxic[row], minlength=size)
    b = np.bincount(col, minlength=size) - a
    rate = (a + b) / max(n1 + n0, 1)
    term = lambda x, n, share: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(n * share, 1e-300)), 0.0)
    g = 2 * (term(a, n1, rate) + term(b, n0, rate) + term(n1 - a, n1, 1 - rate) + term(n0 - b, n0, 1 - rate))
    return np.maximum(g, 0) / (np.maximum(g, 0) + PRIOR)


def fit(rows: Rows, y: np.ndarray, grades: int = GRADES, steps: int = 120, l2: float = 1e-3) -> SeverityModel:
    """Maximum likelihood with an L2 penalty, least on the features most associated with toxic labels, by full-batch Adam on bounded rows and their grades."""
    used, col = np.unique(rows.col, return_inverse=True)
    row, size = rows.row, len(used)
    scale = association(col, row, size, y > 0) if rows.n else np.zeros(0)
    val = rows.val * scale[col]
    n, k = max(rows.n, 1), grades - 1
    above = np.array([(y > j).mean() if len(y) else 0.5 for j in range(k)]).clip(1e-4, 1 - 1e-4)
    first = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    p = np.concatenate([np.zeros(size), first[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)

    def thresholds() -> np.ndarray:
        return np.cumsum(np.concatenate([p[size : size + 1], np.exp(p[size + 1 :])]))

    for step in range(1, steps + 1 if rows.n else 1):
        w, t = p[:size], thresholds()
        s = np.bincount(row, val * w[col], minlength=rows.n)
        below = 1 / (1 + np.exp(np.clip(s[:, None] - t[None, :], -50, 50)))
        low = np.concatenate([np.zeros((rows.n, 1)), below], axis=1)[np.arange(rows.n), y]
        high = np.concatenate([below, np.ones((rows.n, 1))], axis=1)[np.arange(rows.n), y]
        prob, slope = np.maximum(high - low, 1e-12), below * (1 - below)
        by_score = (1 - high - low) / n  # of the loss, negated
        gt = np.array([(slope[y == j + 1, j] / prob[y == j + 1]).sum() - (slope[y == j, j] / prob[y == j]).sum() for j in range(k)]) / n
        gp = np.array([gt[j:].sum() * (1 if j == 0 else np.exp(p[size + j])) for j in range(k)])
        g = np.concatenate([-np.bincount(col, val * -by_score[row], minlength=size) + l2 * w, gp])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = p[:size] * scale
    return SeverityModel(weights, thresholds())


def best_cutoff(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cutoff between two probabilities that has the best F1; 0.5 without both kinds."""
    if not toxic.any() or toxic.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    q, hits = p[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(q) + 1) + toxic.sum())
    last = np.append(q[1:] < q[:-1], True)  # a cutoff can't part equal probabilities
    k = int(np.flatnonzero(last)[np.argmax(f1[last])])
    return float((q[k] + (q[k + 1] if k + 1 < len(q) else 0.0)) / 2)


def out_of_fold(rows: Rows, toxic: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """P(toxic) of each row from a model of two grades that is fitted on the rows of the other fold."""
    p = np.zeros(rows.n)
    for f in (False, True):
        model = fit(rows.where(fold != f), toxic[fold != f].astype(np.int64), 2)
        p[fold == f] = model.exceed(rows.where(fold == f).scores(model.weights))[:, 0]
    return p


def train(docs: DataFrame, labels: DataFrame) -> SeverityModel:
    """A model of three grades from labels that say only toxic or not, or have grades of their own.

    Labels above 1 are grades as they stand. With labels of 0 and 1 alone the grades of toxic texts are score
    bands: of the toxic rows, the half that a model fitted on the other fold, which never saw them, finds
    likelier toxic has grade 2, the rest 1. The flag's cutoff has the best F1 on the same
    out-of-fold probabilities. The sample's features, MAX_LABELLED rows, come to the driver as arrays. Rows
    that share a key are rows of their own with one label; without labels of both kinds every score is the prior's.
    """
    sample = labelled_sample(docs, labels)

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [buckets_of(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "at": [a.astype("<i4").tobytes() for a, _ in found], "x": [x.astype("<f4").tobytes() for _, x in found]})

    found = sample.mapInPandas(featurize, "doc_id long, toxic int, at binary, x binary").toLocalIterator()
    found = sorted((zlib.crc32(str(r["doc_id"]).encode()), r["toxic"], r["at"], r["x"]) for r in found)
    rows = Rows.of((np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for _, _, a, x in found)
    y = np.array([max(t, 0) for _, t, *_ in found], dtype=np.int64)
    toxic = y > 0
    if not toxic.any() or toxic.all():
        return fit(Rows.of([]), np.zeros(0, dtype=np.int64))
    p = out_of_fold(rows, toxic, np.arange(rows.n) % 2 == 1)
    if y.max() == 1:
        y = np.where(toxic, 1 + (p >= np.median(p[toxic])), 0)
    y = np.minimum(y, GRADES - 1)
    return replace(fit(rows, y), cutoff=best_cutoff(p, toxic))


def severity(text: Column, model: SeverityModel) -> Column:
    """Struct of a text's expected severity (0 to grades - 1), its likeliest grade (ties to the lower), and toxic: P(grade > 0) above the cutoff.

    Whole texts are read, however long; texts without any word, such as null and empty ones, score as the
    prior and are not toxic. Equal texts score alike.
    """

    @F.pandas_udf("expected_severity double, grade int, toxic boolean")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = Rows.of(map(buckets_of, texts))
        p = model.exceed(rows.scores(model.weights))
        each = np.concatenate([np.ones((rows.n, 1)), p], axis=1) - np.concatenate([p, np.zeros((rows.n, 1))], axis=1)
        worded = np.bincount(rows.row, minlength=rows.n) > 0
        return pd.DataFrame({"expected_severity": p.sum(axis=1), "grade": each.argmax(axis=1).astype("int32"), "toxic": (p[:, 0] > model.cutoff) & worded})

    return score(text)
