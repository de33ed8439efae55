"""Quality rules: counted base rules and a calibrated n-gram logistic regression.

Base rules count, for every whole text, words, their characters, symbols, repeated
lines and words in repeated three-word windows. The verdict on a text that passes
them is a logistic regression over hashed words and hashed character 3- and 4-grams
(of the word with a mark at both ends), whose value for a text is the mean over its
words; Platt scaling on rows kept out of the fit turns it into a probability, which is
held against a fixed threshold. Texts are scored in Arrow batches where they lie; there
is no shuffle of texts.

The regression is fitted on at most ``FIT_ROWS`` labelled rows (a bound, chosen by a
hash of the id). Broadcast: 2 x 2**16 weights, a fixed size.

Defined results: a null or empty text has no words and fails the base rules; ties,
repeated rows and repeated ids are scored row by row; label rows with a null id, a
null label or no document are not used, conflicting labels of one id count as the
least; without labelled rows of both classes the base rules alone decide; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.common import WordIds, batches_of, bounded, doc_bytes, fold, gram_hashes, rows_of, small_batches, table

BITS = 16
FIT_ROWS = 4_000
THRESHOLD = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(i for i in range(256) if i not in SYMBOLS)
_CONT = bytes(range(0x80, 0xC0))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of distinct words, as (position of the word, feature) arrays: the
    word itself, and its character 3- and 4-grams with a mark before and after it."""
    m = (1 << BITS) - 1
    of = [np.arange(len(words))]
    at = [np.fromiter((xxhash.xxh3_64_intdigest(w) & m for w in words), np.int64, len(words))]
    chars = np.frombuffer("".join(f"\x02{w.decode('utf-8', 'replace')}\x03" for w in words).encode("utf-32-le"),
                          np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w.translate(None, _CONT)) + 2 for w in words])
    for n in (3, 4):
        k = len(chars) - n + 1
        if k > 0:
            inside = np.flatnonzero(word[:k] == word[n - 1:])
            h = gram_hashes(chars, n)[inside]
            of.append(word[inside])
            at.append((h & np.uint64(m)).astype(np.int64) + m + 1)
    return np.concatenate(of), np.concatenate(at)


def base_counts(text: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONT))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if len(ids) >= 3:
        _, local = np.unique(ids, return_inverse=True)
        local = local.astype(np.int64)
        _, a = np.unique(local[:-1] << 32 | local[1:], return_inverse=True)
        key = a[:-1].astype(np.int64) << 32 | local[2:]
        _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
        twice = cnt[inv] > 1
        if twice.any():
            hit = np.zeros(len(ids), bool)
            for j in range(3):
                hit[j:len(ids) - 2 + j] |= twice
            repeat = int(hit.sum())
    return chars, symbols, dup, repeat


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 40, rate: float = 0.5,
        l2: float = 1e-6, seed: int = 8) -> dict | None:
    """Logistic regression on (features, weights, label) rows by mini-batch Adagrad on
    four fifths of them, Platt scaling on the rest. None if a class is missing."""
    y = np.array([r[2] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) // 5)
    held, train = order[:cut], order[cut:]
    if len(set(y[train].tolist())) < 2:
        train = order
    if len(set(y[held].tolist())) < 2:
        held = order
    w, g2 = np.zeros(2 << BITS), np.full(2 << BITS, 1e-8)
    b, gb2 = 0.0, 1e-8
    for _ in range(epochs):
        rng.shuffle(train)
        for s in range(0, len(train), 256):
            part = train[s:s + 256]
            idx = np.concatenate([rows[i][0] for i in part])
            val = np.concatenate([rows[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            z = np.bincount(of, w[idx] * val, len(part)) + b
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            g = np.bincount(idx, e[of] * val, len(w)) + l2 * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            gb2 += e.sum() ** 2
            b -= rate * e.sum() / np.sqrt(gb2)
    z = np.array([w[rows[i][0]] @ rows[i][1] + b for i in held])
    a, c = platt(z, y[held])
    return {"w": w.astype(np.float32), "b": float(b), "a": a, "c": c}


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate scores ``z`` (Newton steps on smoothed targets)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        r, v = p - t, p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, np.array([(r * z).sum(), r.sum()]))
        a, c = a - np.clip(d[0], -1, 1), c - np.clip(d[1], -1, 1)
    return float(max(a, 1e-3)), float(c)


def _features(batches):
    def rows():
        for doc_id, text, label in rows_of(batches, "doc_id", "text", "label"):
            n = Counter(text.split())
            if n:
                of, at = word_features(list(n))
                at, inv = np.unique(at, return_inverse=True)
                val = np.bincount(inv, np.fromiter(n.values(), float, len(n))[of]) / n.total()
                yield doc_id, at.astype(np.int32).tobytes(), val.astype(np.float32).tobytes(), label

    yield from batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("at", pa.binary()), ("val", pa.binary()),
                                             ("label", pa.int32())]), 200)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> dict | None:
    """Fit on at most ``rows`` labelled documents whose fold is not 0."""
    known = (labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label"))
             .where(F.col("__id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("__id"), 5) != 0))
             .groupBy("__id").agg(F.min("label").alias("label")))
    chosen = bounded(known, "__id", rows)
    d = doc_bytes(docs)
    got = (d.join(F.broadcast(chosen), d["doc_id"] == F.col("__id")).select("doc_id", "text", "label")
           .mapInArrow(_features, "doc_id long, at binary, val binary, label int")
           # one row a sampled id, however often it is repeated, so the bound on ids is the bound on rows
           .groupBy("doc_id").agg(F.min(F.struct("at", "val", "label")).alias("r")).select("doc_id", "r.*").collect())
    got.sort(key=lambda r: r["doc_id"])
    return fit([(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["val"], np.float32).astype(float),
                 r["label"]) for r in got])


def verdicts(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: the base counts, the probability and the verdict."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = sent.value
        known: dict[bytes, float] = {}
        ids = WordIds(300_000)

        def rows():
            for batch in batches:
                texts = batch.column("text").to_pylist()
                split = [t.split() for t in texts]
                if m:
                    if len(known) > 300_000:
                        known.clear()
                    new = [x for x in set().union(*split) if x not in known]
                    of, at = word_features(new)
                    known.update(zip(new, np.bincount(of, m["w"][at], len(new)).tolist(), strict=True))
                for doc_id, text, words in zip(batch.column("doc_id").to_pylist(), texts, split, strict=True):
                    chars, symbols, dup, repeat = base_counts(text, words, ids.ids(words))
                    n = len(words)
                    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                    p = None
                    if m and n:
                        z = m["b"] + math.fsum(map(known.__getitem__, words)) / n
                        p = 1 / (1 + math.exp(-min(30, max(-30, m["a"] * z + m["c"]))))
                    yield doc_id, n, chars, symbols, dup, repeat, failed, not failed and (p is None or p >= threshold), p
                    ids.trim()

        yield from batches_of(rows(), pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
            ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
            ("kept", pa.bool_()), ("probability", pa.float64())]))

    return doc_bytes(docs).mapInArrow(
        score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
               "base_failed boolean, kept boolean, probability double")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and calibrated verdict of every document."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return verdicts(docs, train(docs, table(spark, sf_dir, "labels")))
