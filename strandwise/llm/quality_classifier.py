"""Quality classifier learned from positives and unlabelled text.

The model is logistic over shape features of a text (pairs of byte classes, repetition,
lengths) and minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)):

when the second part falls below zero, the step goes back on that part alone. Positives are
the trusted labels; unlabelled rows stand for the web text. The class prior is estimated from
the two samples: over the best-ranked bins of a first model, the least ratio of unlabelled to
positive mass, with a confidence margin.

The fit uses a bounded sample (``MAX_POSITIVE``, ``MAX_UNLABELLED`` rows of least hash, whole
texts); every document is scored.

Defined cases: a null or empty text has zero features and is scored like any other; rows with
equal text have equal scores; several labels of one document count as their least; without
positives or unlabelled rows nothing can be learned: every score is 0.5, and ``keep`` then
rejects nothing; empty tables give empty tables; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, lookup, settled

MAX_POSITIVE, MAX_UNLABELLED = 3_000, 6_000
HOLD_OUT_MOD, HOLD_OUT_REST = 4, 2
THRESHOLD = 0.7
STEPS, RATE, DECAY = 300, 0.02, 1e-3

#: Classes of bytes: lower, upper, digit, blank, line end, stops, exclamation, bar, symbols, other, lead, continuation.
N_CLASSES = 12
_CLASS = np.full(256, 9, dtype=np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c",
                             b".,;:?'", b"!", b"|", b"#$%&*<>")):
    _CLASS[list(_bytes)] = _k
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 10, 11
N_PAIRS = N_CLASSES**2
N_FEATURES = N_PAIRS + 7


def features(text: str | None) -> np.ndarray:
    """Shape features of a whole text; zeros for an empty one."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    c = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    if len(c) > 1:
        counts = np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_PAIRS)
        out[:N_PAIRS] = np.log1p(counts * (1000.0 / len(c)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, kinds = len(words), len(set(words))
    out[N_PAIRS:] = (
        np.log1p(n),
        np.log1p(kinds) / np.log1p(n),
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        1 - len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2) if n > 2 else 0.0,
        len(raw) / n / 10,
        np.log1p(n / len(lines)),
    )
    return out


@dataclass
class Model:
    """Weights over the features in use, after centring and scaling."""

    used: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x[..., self.used] - self.mean) / self.scale, -8, 8)
        return z @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from the scores of both samples.

    Bins hold the best-ranked scores; there the unlabelled are positives almost only, so
    unlabelled mass over positive mass is close to the share from above.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.quantile(p, np.linspace(0.02, 0.7, 35))
    mass_p = 1 - np.searchsorted(p, cuts) / len(p)
    mass_u = 1 - np.searchsorted(u, cuts) / len(u)
    margin = (1 + mass_u / mass_p) * np.sqrt(np.log(40) / 2) * (len(p) ** -0.5 + len(u) ** -0.5) / mass_p
    at = int(np.argmin(mass_u / mass_p + margin))
    return float(np.clip(mass_u[at] / mass_p[at], 0.05, 0.98))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, plain: bool) -> tuple[np.ndarray, float]:
    """Adam on the risk; ``plain`` separates positives from unlabelled, for the prior."""
    theta = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    with_one = lambda x: np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    p, u = with_one(p), with_one(u)
    sigma = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0.0, z)
    for k in range(1, STEPS + 1):
        zp, zu = p @ theta, u @ theta
        sp, su = sigma(zp), sigma(zu)
        if plain:
            grad = (sp - 1) @ p / len(p) + su @ u / len(u)
        else:
            negative = softplus(zu).mean() - prior * softplus(zp).mean()
            g_neg = su @ u / len(u) - prior * (sp @ p) / len(p)
            grad = prior * ((sp - 1) @ p) / len(p) + g_neg if negative >= 0 else -g_neg
        grad = grad + DECAY * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    """Model from the features of the two samples; ``None`` if either is empty."""
    if not len(positive) or not len(unlabelled):
        return None
    both = np.vstack([positive, unlabelled])
    used = np.flatnonzero((both != 0).mean(axis=0) >= 0.002)
    both = both[:, used]
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    z = np.clip((both - mean) / scale, -8, 8).astype(np.float32)
    p, u = z[: len(positive)], z[len(positive) :]
    found_p, found_u = np.zeros(len(p)), np.zeros(len(u))
    for fold in (0, 1) if min(len(p), len(u)) > 1 else ():
        w, b = _descend(p[1 - fold :: 2], u[1 - fold :: 2], 0.5, plain=True)
        found_p[fold::2], found_u[fold::2] = p[fold::2] @ w + b, u[fold::2] @ w + b
    prior = estimate_prior(found_p, found_u)
    w, b = _descend(p, u, prior, plain=False)
    return Model(used, mean, scale, w, b, prior)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Bounded sample of trusted positives and unlabelled rows: doc_id, positive."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), HOLD_OUT_MOD) != HOLD_OUT_REST)).distinct()
    marked = settled(ids.join(known, "doc_id", "left"))
    pick = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return pick(marked.where("quality = 1"), MAX_POSITIVE).select("doc_id", F.lit(True).alias("positive")).unionByName(
        pick(marked.where("quality is null"), MAX_UNLABELLED).select("doc_id", F.lit(False).alias("positive"))
    )


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the bounded sample; held-out documents and their labels are not used.

    Of rows that share a doc_id the text of least hash stands for all, so the sample is bounded by
    ids and by rows.
    """
    rows = lookup(docs.select("doc_id", "text"), settled(_sample(docs, labels)), ["doc_id"], "inner")
    one = F.min_by(F.struct("text", "positive"), F.xxhash64("text")).alias("x")
    rows = rows.groupBy("doc_id").agg(one).select("doc_id", "x.text", "x.positive")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).astype(np.float16).tobytes())

    got = rows.select("doc_id", "positive", packed("text").alias("x")).toPandas()  # one row for each id of the sample
    got = got.sort_values("doc_id")
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float16).reshape(-1, N_FEATURES).astype(np.float32)
    flag = got["positive"].to_numpy(bool)
    return fit(x[flag], x[~flag])


def scored(docs: DataFrame, model: Model | None) -> Column:
    """The score of ``docs.text`` under the model."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = held.value
        if m is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series([float(m.score(features(t).astype(np.float16).astype(np.float32))) for t in texts])

    return score(F.col("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return docs.select(
        "doc_id", (bucket_of(F.col("doc_id"), HOLD_OUT_MOD) == HOLD_OUT_REST).alias("held_out"),
        scored(docs, learn(docs, labels)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted to be good, with all their columns."""
    model = learn(docs, labels)
    return docs if model is None else docs.where(scored(docs, model) >= THRESHOLD)
