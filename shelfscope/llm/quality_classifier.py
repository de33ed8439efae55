"""Quality classifier: random-indexing word vectors and a two-layer network.

1. *Random indexing.* Each word counts as two tokens, its core (lower-cased, without
   marks at the ends) and its shape (the marks and the case, or that it repeats the
   word before it). Tokens are hashed to ``2**BITS`` rows. Every token has a sparse random index vector (``NONZERO`` entries
   of +1 or -1 among ``DIM``), and its word vector is the sum, over the whole corpus, of
   the index vectors of the tokens up to ``WINDOW`` places away. Each task adds up
   its own table; the tables are added by one hash aggregate, so what moves is one
   table of fixed size for each task, not the texts.
2. *Pooling.* Word vectors are scaled to length 1 and weighted down by their share of
   all tokens; a text's vector is their mean.
3. *Network.* A two-layer numpy network is fitted on at most ``FIT_ROWS`` labelled rows;
   a temperature fitted on rows kept out of the fit calibrates its probability.

Labels are read from rows whose fold (crc32 of the id as text, mod 5) is not 0; the
score depends on the text alone. Broadcast: the ``2**BITS x DIM`` float32 table (2 MB)
and the network, both of fixed size.

Defined results: null and empty texts have the zero vector and get its score; repeated
rows and ids are scored row by row; label rows with a null id, a null or other label
or no document are not used, conflicting labels of one id count as the least; without
labelled rows of both classes every score is 1 (nothing is rejected without evidence);
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.common import batches_of, bounded, doc_bytes, fold, released, rows_of, small_batches, stored, table

BITS, DIM, NONZERO, WINDOW = 14, 32, 4, 2
FIT_ROWS = 20_000
HIDDEN = 32
THRESHOLD = 0.3
_EDGE = bytes(i for i in range(128) if not chr(i).isalpha())
_LETTERS = bytes(i for i in range(256) if i >= 128 or chr(i).isalnum())


#: The shape row of a word that repeats the word before it.
REPEAT = xxhash.xxh3_64_intdigest(b"repeated", seed=2) & ((1 << BITS) - 1)


class Tokens(dict):
    """Word -> row of its core and row of its shape, packed in one integer."""

    room = 60_000

    def __missing__(self, word: bytes) -> int:
        m = (1 << BITS) - 1
        core = word.strip(_EDGE)
        case = b"U" if len(core) > 1 and core.isupper() else b"T" if core[:1].isupper() else b"l"
        shape = case + word.translate(None, _LETTERS)[:8]
        at = (xxhash.xxh3_64_intdigest(core.lower()) & m) | (xxhash.xxh3_64_intdigest(shape, seed=1) & m) << BITS
        self[word] = at
        return at

    def rows(self, text: bytes) -> np.ndarray:
        """The token rows of a text in order: core, shape, core, shape ..."""
        words = text.split()
        if len(self) > self.room:
            self.clear()
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        out = np.empty(2 * len(words), np.int64)
        out[::2] = both & ((1 << BITS) - 1)
        out[1::2] = both >> BITS
        out[3::2][both[1:] == both[:-1]] = REPEAT
        return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors' entries, the same everywhere."""
    rng = np.random.default_rng(9)
    return rng.integers(0, DIM, (1 << BITS, NONZERO)), rng.choice([-1.0, 1.0], (1 << BITS, NONZERO))


def _context_sums(batches):
    """One table for the task: for each token row, its count and its vector."""
    place, sign = index_vectors()
    known = Tokens()
    total, seen = np.zeros((1 << BITS) * DIM), np.zeros(1 << BITS, np.int64)

    def add(texts: list[np.ndarray]) -> None:
        gap = np.full(WINDOW, -1, np.int64)  # so that no window spans two texts
        t = np.concatenate([x for r in texts for x in (r, gap)])
        np.add(seen, np.bincount(t[t >= 0], minlength=1 << BITS), out=seen)
        for d in range(1, WINDOW + 1):
            a, b = t[:-d], t[d:]
            both = (a >= 0) & (b >= 0)
            a, b = a[both], b[both]
            for k in range(NONZERO):
                for x, y in ((a, b), (b, a)):
                    np.add(total, np.bincount(x * DIM + place[y, k], sign[y, k], len(total)), out=total)

    held, size = [], 0
    for (text,) in rows_of(batches, "text"):
        r = known.rows(text)
        held.append(r)
        size += len(r)
        if size > 500_000:
            add(held)
            held, size = [], 0
    if held:
        add(held)
    at = np.flatnonzero(seen)
    names = ["row", "n", *(f"v{k}" for k in range(DIM))]
    v = total.reshape(-1, DIM)[at].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at]),
                                      *(pa.array(v[:, k]) for k in range(DIM))], names=names)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The pooled table: a row for each token row, scaled and weighted, from all texts."""
    sums = [f"v{k}" for k in range(DIM)]
    got = (doc_bytes(docs).select("text")
           .mapInArrow(released(_context_sums), "row int, n long, " + ", ".join(f"{c} long" for c in sums))
           .groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))
           .toPandas())
    out = np.zeros((1 << BITS, DIM), np.float32)
    if len(got):
        v = got[sums].to_numpy(float)
        n = got["n"].to_numpy(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        weight = 1 / (1 + n / n.sum() * 1e3)
        out[got["row"].to_numpy()] = v * weight[:, None]
    return out


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, held_out and the mean word vector (float32 bytes) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        v, known = sent.value, Tokens()

        def rows():
            for doc_id, held, text in rows_of(batches, "doc_id", "held_out", "text"):
                at = known.rows(text)
                n = np.bincount(at, minlength=1 << BITS) if len(at) > 20_000 else None
                mean = (np.zeros(DIM) if not len(at) else v[at].mean(0, dtype=np.float64) if n is None
                        else n @ v.astype(np.float64) / len(at))
                yield doc_id, held, mean.astype(np.float32).tobytes()

        yield from batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("vec", pa.binary())]))

    return doc_bytes(docs, (fold(F.col("doc_id"), 5) == 0).alias("held_out")).mapInArrow(
        released(pool), "doc_id long, held_out boolean, vec binary")


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, l2: float = 1e-4, seed: int = 9) -> dict | None:
    """The network, its input scaling and its temperature; None if a class is missing."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = len(y) // 5
    held, train = order[:cut], order[cut:]
    if len(set(y[held].tolist())) < 2 or len(set(y[train].tolist())) < 2:
        held = train = order
    mean, sd = x[train].mean(0), x[train].std(0) + 1e-6
    x = (x - mean) / sd
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    m1, m2, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        rng.shuffle(train)
        for s in range(0, len(train), 128):
            a, b = x[train[s:s + 128]], y[train[s:s + 128]]
            h = np.tanh(a @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - b) / len(b)
            dh = np.outer(e, p[2]) * (1 - h * h)
            grads = [a.T @ dh + l2 * p[0], dh.sum(0), h.T @ e + l2 * p[2], np.array([e.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.999 ** t)) + 1e-8)
    z = np.tanh(x[held] @ p[0] + p[1]) @ p[2] + p[3]
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, np.where(y[held] > 0, -z, z) / c).mean() for c in grid]
    return {"mean": mean, "sd": sd, "p": p, "temperature": float(grid[int(np.argmin(loss))])}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    p = model["p"]
    z = np.tanh((x - model["mean"]) / model["sd"] @ p[0] + p[1]) @ p[2] + p[3]
    return 1 / (1 + np.exp(-np.clip(z / model["temperature"], -30, 30)))


def sample(labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> DataFrame:
    """(__id, y) of at most ``rows`` labelled ids whose fold is not 0."""
    known = (labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y"))
             .where(F.col("__id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("__id"), 5) != 0))
             .groupBy("__id").agg(F.min("y").alias("y")))
    return bounded(known, "__id", rows)


def train(vectors: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> dict | None:
    """Fit on the ``sample`` of the labels."""
    joined = vectors.join(sample(labels, label, rows), F.col("doc_id") == F.col("__id")).select("__id", "vec", "y")
    # one row a sampled id, however often it is repeated, so the bound on ids is the bound on rows
    got = joined.groupBy("__id").agg(F.min(F.struct("vec", "y")).alias("r")).select("__id", "r.*").collect()
    got.sort(key=lambda r: r["__id"])
    if not got:
        return None
    return fit(np.array([np.frombuffer(r["vec"], np.float32) for r in got], float), np.array([r["y"] for r in got], float))


def scores(vectors: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every pooled vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float32).reshape(-1, DIM).astype(float)
                s = probability(sent.value, x) if sent.value else np.ones(len(x))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s),
                                                  pa.array((s >= threshold).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    return vectors.mapInArrow(released(score), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, vectors: np.ndarray, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """Those rows of ``docs``, with all their columns, whose text the network doesn't reject."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors.astype(np.float64), model))

    def keep(batches):
        (v, m), known = sent.value, Tokens()
        for b in batches:
            x = np.zeros((b.num_rows, DIM), np.float32)
            for i, text in enumerate(b.column("text").to_pylist()):
                at = known.rows((text or "").encode())
                if len(at):
                    x[i] = np.bincount(at, minlength=1 << BITS) @ v / len(at) if len(at) > 20_000 else v[at].mean(0)
            yield b.filter(pa.array(probability(m, x.astype(float)) >= threshold)) if m else b

    return docs.mapInArrow(released(keep), docs.schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole operator: fit on ``labels``, score every row of ``docs``."""
    vectors = stored(pooled(docs, word_vectors(docs)), "doc-vectors")
    return scores(vectors, train(vectors, labels))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    small_batches(spark)
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
