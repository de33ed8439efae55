"""Toxicity: non-negative positive-unlabelled learning.

A linear classifier over the hashed distinct words of a text is fitted in numpy from
two samples: texts confirmed as toxic (P) and texts taken from all documents whatever
their label (U). With the class prior pi, the risk of the negative class is estimated
without negatives as ``mean_U l(-z) - pi * mean_P l(-z)``; where a mini-batch drives
that estimate below ``-BETA`` (which no true risk can be) the step goes against its
gradient instead, so the model can't fit U's hidden positives as negatives. Only words
whose share of texts differs between P and U beyond chance have a weight, and a proximal
L1 step keeps weak ones at exactly zero, so long texts aren't scored by the sum of many
small weights.

Labels are read from rows whose fold (crc32 of the id as text, mod 5) is not 0; the
score depends on the text alone. P and U are bounded samples (``FIT_P``, ``FIT_U``
rows by a hash of the id); the prior is counted over all labelled rows. Every whole
text is scored in Arrow batches where it lies, without a shuffle of texts. Broadcast:
``2**BITS`` float32 weights, a fixed size, and at most ``FIT_P + FIT_U`` ids.

Defined results: null and empty texts have no words and score the bias alone; repeated
rows and ids are scored row by row; label rows with a null id, a null or other label or
no document are not used, conflicting labels of one id count as the greatest; without
a confirmed toxic text every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.common import batches_of, bounded, doc_bytes, fold, rows_of, small_batches, stored, table

BITS = 18
FIT_P, FIT_U = 4_000, 8_000
MIN_DOCS, MIN_Z = 5, 4.0
BETA, GAMMA = 0.0, 1.0
_EDGE = bytes(i for i in range(128) if not chr(i).isalpha())


class Buckets(dict):
    """Word -> bucket of its lower-cased core, without ASCII marks at its ends; -1
    where nothing is left. Emptied when it holds ``room`` words."""

    room = 300_000

    def __missing__(self, word: bytes) -> int:
        core = word.lower().strip(_EDGE)
        at = xxhash.xxh3_64_intdigest(core) & ((1 << BITS) - 1) if core else -1
        self[word] = at
        return at

    def distinct(self, text: bytes) -> np.ndarray:
        words = set(text.split())
        at = np.unique(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        if len(self) > self.room:
            self.clear()
        return at[at >= 0]


def screened(p: list[np.ndarray], u: list[np.ndarray], min_docs: int = MIN_DOCS, z: float = MIN_Z) -> np.ndarray:
    """Which buckets may have a weight: those in at least ``min_docs`` texts whose share of
    texts differs between P and U by ``z`` standard errors."""
    in_p, in_u = (np.bincount(np.concatenate([*x, np.zeros(0, np.int32)]), minlength=1 << BITS) for x in (p, u))
    pooled = (in_p + in_u) / (len(p) + len(u))
    error = np.sqrt(pooled * (1 - pooled) * (1 / len(p) + 1 / len(u))) + 1e-12
    return (in_p + in_u >= min_docs) & (np.abs(in_p / len(p) - in_u / len(u)) >= z * error)


def fit(p: list[np.ndarray], u: list[np.ndarray], prior: float, epochs: int = 100, rate: float = 0.1,
        l1: float = 1e-4, seed: int = 3, min_docs: int = MIN_DOCS) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier, from the distinct buckets of each text."""
    size = 1 << BITS
    keep = screened(p, u, min_docs)
    p, u = [x[keep[x]] for x in p], [x[keep[x]] for x in u]
    rng = np.random.default_rng(seed)
    w, g2, b, gb2 = np.zeros(size), np.full(size, 1e-6), math.log(prior / (1 - prior)), 1e-6
    steps = max(1, math.ceil(max(len(p), len(u)) / 256))
    for _ in range(epochs):
        at_p, at_u = (np.array_split(rng.permutation(max(len(x), steps)) % len(x), steps) for x in (p, u))
        for i, j in zip(at_p, at_u, strict=True):
            idx = np.concatenate([*(p[k] for k in i), *(u[k] for k in j)])
            sizes = [len(p[k]) for k in i] + [len(u[k]) for k in j]
            of = np.repeat(np.arange(len(sizes)), sizes)
            z = np.clip(np.bincount(of, w[idx], len(sizes)) + b, -30, 30)
            s = 1 / (1 + np.exp(-z))
            zp, zu, sp, su = z[:len(i)], z[len(i):], s[:len(i)], s[len(i):]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            d_neg = np.concatenate([-prior * sp / len(i), su / len(j)])
            if negative < -BETA:
                d = -GAMMA * d_neg
            else:
                d = d_neg + np.concatenate([prior * (sp - 1) / len(i), np.zeros(len(j))])
            g = np.bincount(idx, d[of], size)
            g2 += g * g
            step = rate / np.sqrt(g2)
            w -= step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            gb2 += d.sum() ** 2
            b -= rate * d.sum() / math.sqrt(gb2)
    return w.astype(np.float32), float(b)


def _distinct(batches):
    known = Buckets()
    yield from batches_of(((i, t, known.distinct(x).astype(np.int32).tobytes())
                           for i, t, x in rows_of(batches, "__id", "toxic", "text")),
                          pa.schema([("__id", pa.int64()), ("toxic", pa.bool_()), ("at", pa.binary())]), 200)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_p: int = FIT_P,
          fit_u: int = FIT_U) -> tuple[np.ndarray, float] | None:
    """The fitted model, or None without a confirmed toxic text."""
    known = (labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y"))
             .where(F.col("__id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("__id"), 5) != 0))
             .groupBy("__id").agg(F.max("y").alias("y")))
    prior = known.agg(F.avg("y")).first()[0]
    if not prior:
        return None
    positive = bounded(known.where("y = 1"), "__id", fit_p).select("__id", F.lit(True).alias("toxic"))
    ids = docs.select(F.col("doc_id").alias("__id")).where(fold(F.col("doc_id"), 5) != 0).distinct()
    unlabelled = bounded(ids, "__id", fit_u).select("__id", F.lit(False).alias("toxic"))
    chosen = stored(positive.union(unlabelled), "pu-sample")
    d = doc_bytes(docs)
    got = (d.join(F.broadcast(chosen), d["doc_id"] == F.col("__id")).select("__id", "toxic", "text")
           .mapInArrow(_distinct, "__id long, toxic boolean, at binary")
           # one row a sampled id, however often it is repeated, so the bound on ids is the bound on rows
           .groupBy("__id", "toxic").agg(F.min("at").alias("at")).collect())
    got.sort(key=lambda r: (r["__id"] is None, r["__id"] or 0))
    of = {y: [np.frombuffer(r["at"], np.int32) for r in got if r["toxic"] == y] for y in (True, False)}
    if not of[True] or not of[False]:
        return None
    return fit(of[True], of[False], min(max(float(prior), 1e-4), 0.9))


def scores(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m, known = sent.value, Buckets()

        def rows():
            for doc_id, held, text in rows_of(batches, "doc_id", "held_out", "text"):
                s = 0.0
                if m:
                    z = m[1] + math.fsum(m[0][known.distinct(text)].tolist())
                    s = 1 / (1 + math.exp(-min(30, max(-30, z))))
                yield doc_id, held, s, int(s >= 0.5)

        yield from batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()),
                                                 ("score", pa.float64()), ("predicted", pa.int32())]))

    return doc_bytes(docs, (fold(F.col("doc_id"), 5) == 0).alias("held_out")).mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
