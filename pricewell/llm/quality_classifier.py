"""Quality scores by positive-unlabelled learning with a non-negative risk.

Trusted positives are labelled texts of label 1; the unlabelled sample is web text as it comes. With the class
prior p the risk p*E+[l(f)] + max(0, E_u[l(-f)] - p*E+[l(-f)]) is minimised: when the estimate of
the negative part falls below zero, a step goes back up it instead of fitting it further. The
model is logistic in piecewise-linear measures of the text, so features and fit are small arrays.

Fitting uses at most ``sample`` positives and ``sample`` unlabelled texts, chosen by a hash of doc_id. Scoring
is one pass over all whole texts with a few kilobytes of weights. The class prior is estimated from positives and unlabelled texts alone
(labels of 0 teach nothing): a classifier that tells them apart ranks held-out texts, and above a threshold the unlabelled texts' share
over the positives' share bounds the prior from above; the threshold with the least upper confidence bound gives the estimate.

Cases: null or empty text is scored like any other (all measures zero). Labels that are null or of unknown
documents teach nothing; a document labelled both ways counts as label 0. Without enough positives for an estimate the prior is a half, and
without any the score is the prior. Repeated rows have equal scores; a null doc_id is in no held-out fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.llm.common import per_bytes, texts
from pricewell.llm.quality_rules import base_counts, line_fails, symbol_count

KNOTS = 6
MEASURES = (
    "log_words", "word_length", "symbols", "separators", "upper", "digits", "marks", "exclaims",
    "line_words", "closed_lines", "dup_lines", "repeats", "distinct", "longest", "failing", "worst_symbols",
)
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"


def measures(text: bytes) -> list[float]:
    """Shares and lengths that describe how a text is written, not what it says."""
    n, chars, symbols, dup, repeat = base_counts(text)
    if not n:
        return [0.0] * len(MEASURES)
    words = text.split()
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    count = lambda chars: len(text) - len(text.translate(None, chars))
    upper, lower = count(_UPPER), count(_LOWER)
    return [
        np.log1p(n), chars / n, symbols / n, words.count(b"|") / n, upper / max(1, upper + lower), count(_DIGIT) / n, count(b".,;:") / n, text.count(b"!!") / n,
        n / len(lines), sum(x[-1:] in b".!?\"')" for x in lines) / len(lines), dup / len(lines), repeat / n, len(set(words)) / n, max(map(len, words)),
        sum(len(x) for x in lines if line_fails(x)) / len(text), max(symbol_count(x) / len(x) for x in lines),
    ]


@dataclass
class Model:
    knots: np.ndarray  # (measures, KNOTS)
    weights: np.ndarray
    bias: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Piecewise-linear terms: each measure's place between its knots, 0 to 1 for each piece."""
        low, high = self.knots[:, :-1], self.knots[:, 1:]
        width = np.where(high > low, high - low, 1.0)
        piece = np.clip((x[:, :, None] - low) / width, 0.0, 1.0)
        step = (x[:, :, None] >= high) & (high <= low)
        return np.where(high > low, piece, step).reshape(len(x), -1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.expand(x) @ self.weights + self.bias, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Minimise the non-negative risk with Adam; all rows in every step, so the result is fixed."""
    prior = float(np.clip(prior, 0.01, 0.99))
    d = len(MEASURES)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((d, KNOTS)), np.zeros(d * (KNOTS - 1)), float(np.log(prior / (1 - prior))))
    both = np.concatenate((positive, unlabelled))
    q = np.linspace(0, 1, KNOTS)
    # half of the knots by rank, for the bulk, and a straight line to the extremes
    knots = np.quantile(both, q, axis=0).T
    knots[:, -2] = (knots[:, -1] + knots[:, -3]) / 2
    model = Model(knots, np.zeros(d * (KNOTS - 1)), float(np.log(prior / (1 - prior))))
    p, u = model.expand(positive), model.expand(unlabelled)
    w, b = model.weights, model.bias
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # logistic loss: l(z) = log(1 + exp(-z)); gradients with respect to z
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp, gu = prior * (sp - 1) - prior * sp, su
        else:
            gp, gu = prior * sp, -su
        gw = p.T @ gp / len(p) + u.T @ gu / len(u) + decay * w
        g = np.append(gw, gp.mean() + gu.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(knots, w, float(b))


def _apart(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """A logistic model that tells positives from unlabelled texts, both classes of equal weight."""
    d = len(MEASURES)
    knots = np.quantile(np.concatenate((positive, unlabelled)), np.linspace(0, 1, KNOTS), axis=0).T
    model = Model(knots, np.zeros(d * (KNOTS - 1)), 0.0)
    p, u = model.expand(positive), model.expand(unlabelled)
    w, b, m, v = model.weights, 0.0, np.zeros(d * (KNOTS - 1) + 1), np.zeros(d * (KNOTS - 1) + 1)
    for t in range(1, steps + 1):
        gp, gu = (_sigmoid(p @ w + b) - 1) / len(p), _sigmoid(u @ w + b) / len(u)
        g = np.append(p.T @ gp + u.T @ gu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(knots, w, float(b))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, gamma: float = 0.01, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: the mean of two halves' estimates (each half ranks the other)."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    found = []
    for a in (0, 1):
        model = _apart(positive[a::2], unlabelled[a::2])
        sp, su = np.sort(model.score(positive[1 - a :: 2])), np.sort(model.score(unlabelled[1 - a :: 2]))
        cut = np.concatenate((sp, su))
        qp, qu = 1 - np.searchsorted(sp, cut) / len(sp), 1 - np.searchsorted(su, cut) / len(su)
        some = qp > 0
        qp, qu = qp[some], qu[some]
        slack = np.sqrt(np.log(4 / delta) / 2 / len(sp)) + np.sqrt(np.log(4 / delta) / 2 / len(su))
        best = int(np.argmin(qu / qp + (1 + gamma) / qp * slack))
        found.append(qu[best] / qp[best])
    return float(np.clip(np.mean(found), 0.01, 0.99))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the checksum of doc_id as text falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _features(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.array([measures(t) for t in texts(batch)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return per_bytes(docs, run, "doc_id long, x binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, prior: float | None = None) -> Model:
    """Fit on the training folds; at most ``sample`` positives and ``sample`` unlabelled texts reach the driver."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    mix = F.xxhash64("doc_id")
    positive = known.filter("quality = 1").orderBy(mix, "doc_id").limit(sample).select("doc_id", F.lit(True).alias("p"))
    unlabelled = source.select("doc_id").filter("doc_id IS NOT NULL").orderBy(mix, "doc_id").limit(sample).select("doc_id", F.lit(False).alias("p"))
    # at most 2 * sample ids of eight bytes: a bounded side
    chosen = F.broadcast(positive.unionByName(unlabelled).groupBy("doc_id").agg(F.bool_or("p").alias("p"), F.bool_or(~F.col("p")).alias("u")))
    rows = _features(source.join(chosen.select("doc_id"), "doc_id", "left_semi")).join(chosen, "doc_id").select("x", "p", "u").collect()
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(-1, len(MEASURES))
    p, u = np.array([r["p"] for r in rows], bool), np.array([r["u"] for r in rows], bool)
    order = np.lexsort(x.T[::-1]) if len(x) else np.zeros(0, np.int64)  # sums do not depend on arrival
    x, p, u = x[order], p[order], u[order]
    return fit(x[p], x[u], class_prior(x[p], x[u]) if prior is None else prior)


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None) with ``score`` and ``predicted``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    carry = [c for c in docs.columns if c not in ("score", "predicted")] if carry is None else carry

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = held.value.score(np.array([measures(t) for t in texts(batch)]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*carry, "score", "predicted"])

    source = docs.select(*dict.fromkeys([*carry, "text"]))
    kinds = T.StructType([f for c in carry for f in source.schema if f.name == c])
    return per_bytes(source, run, kinds.add("score", T.DoubleType()).add("predicted", T.IntegerType()))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_quality(source, train(source, labels), threshold, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
