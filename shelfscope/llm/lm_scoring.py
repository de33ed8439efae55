"""Language-model scoring by logistic context mixing.

The model gives a probability to a text's words (lower-cased A-Z, then one end). A word is
coded as its bytes and a closing byte, bit by bit:

* *Bit predictors.* Each predicts the next bit by the training occurrences of its context:
  ``ORDERS`` hashed byte contexts (the last one to four bytes of the word); the word's bytes
  so far, in all training words and in those of a class (a hash of the training documents'
  ``lang``); for the first byte, the hashed previous word and the hashed previous two words.
* *Gated mixing.* The predictors' logits are combined by weights that a gate selects (the
  bit's place in the byte and how much its longest context has seen), in two layers: the
  byte contexts by stochastic passes over all training contexts, weights averaged over partitions,
  then their mixture with the other predictors by Newton steps over all training words, whose
  inputs are counted in cells of ``GRAIN``. Each prediction leaves out the occurrence that it predicts.
* *Adaptive refinement.* There is a mixer for each class and each gain of ``GAINS``. Along a
  document, the mixers' weight follows Bayes' rule, and with them that of small shares for
  the words the document has had so far and for the byte contexts alone, so a document's
  probability is exactly that of coding it word after word with weights that adapt. The
  scored document's own ``lang`` isn't used.

How it scales: documents are dealt by a hash into blocks of about ``BLOCK_BYTES``. A block
emits one row for each distinct word and class, byte context, and pair of previous words'
hashes and first byte, with its training occurrences. Words meet by their first two bytes,
in order, so the counts of all their beginnings are exact whatever the blocks are; a word's
probability after its first byte is found there, once, and sent to the blocks that have it.
No vocabulary is broadcast or collected. Tables of fixed size are: the byte contexts' ``ORDERS x
2**SLOT_BITS`` pairs of counts (16 MB), the counts of the first two bytes, the first
byte's probabilities after ``PAIRS`` pairs of previous words, the gates and the cells that
their weights are learnt from.

Defined results: null and empty texts are the end alone; rows alike in id and text are
scored alike; a null ``doc_id`` counts as the empty text in the fold (so it is
trained on); without training rows the base counts are 0 and the mixers have their
uniform start; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.common import doc_bytes, fold, give_back, id_text, mixed, small_batches, stored, table

BLOCK_BYTES = 24 << 20
ORDERS, SLOT_BITS = 4, 19
CLASSES = 8
GATES = 8 * 4
PASSES, RATE = 3, 0.02
WORD, CONTEXT, FIRST = 0, 1, 2
END = b"\n"
#: Hashes of the previous word, and of it with the one before.
PREVIOUS, PAIRS = 1 << 8, 1 << 11
#: Start weights of the word's mixer (byte contexts, all words, words of the class) and of the
#: first byte's (previous two words, previous word, all words, words of the class).
START, START_FIRST = (0.5, 0.5, 0.2), (0.3, 0.3, 0.1, 0.3)
#: Step and number of the values of an input that a mixer learns from.
GRAIN, CELLS = 0.5, 33
#: What a mixer's weights are multiplied by.
GAINS = (1.0, 0.8)
#: Shares of the document's own words and of the byte contexts alone; the rest goes to
#: the mixers.
GRID = [(c, 0.01) for c in (0.02, 0.15)]
#: Rows of words that are taken together, and bytes of words that are mixed together.
ROWS, PIECE = 40_000, 1 << 13
#: Words of a block in a row of costs, and tokens whose probabilities are multiplied before
#: their logarithm is taken.
PACK, RUN = 96, 8
#: Byte contexts in a partition that learns, in the mean.
TAUGHT = 50_000


def byte_contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its closing byte: the word's index, and the
    ``ORDERS`` bytes before it in the word (spaces before its start) with the byte."""
    closed = [w + b" " if w != END else w for w in words]
    size = np.fromiter(map(len, closed), np.int64, len(closed))
    of = np.repeat(np.arange(len(closed)), size)
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    b = np.frombuffer(b"".join(closed), np.uint8).astype(np.int64)
    key = np.zeros(len(b), np.int64)
    for back in range(ORDERS, 0, -1):
        key = key << 8 | np.where(place >= back, np.roll(b, back), 32)
    return of, key << 8 | b


def bit_slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, bits) of the 8 bits of each context's byte: slots has a row for each order."""
    byte = (key & 255).astype(np.int32)
    bits = byte[:, None] >> np.arange(7, -1, -1, dtype=np.int32) & 1
    node = np.int32(1) << np.arange(8, dtype=np.int32) | byte[:, None] >> np.arange(8, 0, -1, dtype=np.int32)
    slots = np.empty((ORDERS, len(key), 8), np.int32)
    for k in range(ORDERS):
        # a context's nodes lie side by side from a hashed place
        context = (key >> 8 & (1 << 8 * (k + 1)) - 1).astype(np.uint64) + np.uint64((k + 1) << 56)
        first = (mixed(context) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int32)
        np.add(first[:, None], node, out=slots[k])
        slots[k] &= (1 << SLOT_BITS) - 1
        slots[k] += k << SLOT_BITS
    return slots, bits


def _level(n: np.ndarray) -> np.ndarray:
    """How much the longest context has seen, as one of four levels."""
    return (n >= 1).astype(np.int32) + (n >= 4) + (n >= 32)


def _gate(level: np.ndarray) -> np.ndarray:
    """Gate of each bit from its place in the byte and the level."""
    return np.arange(8, dtype=np.int32) * 4 + level


class Mixer:
    """Slot counts and gated weights; the log2 probability of words."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, weights: np.ndarray | None = None):
        self.n0, self.n1 = n0, n1
        self.weights = np.full((GATES, ORDERS), 0.3) if weights is None else weights
        self.logit = self.seen = None
        self.left: dict[int, np.ndarray] = {}

    def learn(self, key: np.ndarray, times: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
        """One online pass over contexts that occurred ``times``, in random order."""
        order = rng.permutation(len(key))
        for s in range(0, len(order), 256):
            part = order[s:s + 256]
            slots, bits = bit_slots(key[part])
            x = np.log((self.n1[slots] - bits + 0.4).clip(0.4) / (self.n0[slots] - (1 - bits) + 0.4).clip(0.4))
            gate = _gate(_level(self.n0[slots[-1]] + self.n1[slots[-1]] - 1))
            p = 1 / (1 + np.exp(-np.clip((self.weights[gate] * np.moveaxis(x, 0, -1)).sum(-1), -20, 20)))
            e = (bits - p) * times[part, None]
            total = np.bincount(gate.ravel(), np.broadcast_to(times[part, None], gate.shape).ravel(), GATES)
            for k in range(ORDERS):
                g = np.bincount(gate.ravel(), (e * x[k]).ravel(), GATES)
                self.weights[:, k] += rate * g / np.maximum(total, 1)

    def signed(self, key: np.ndarray, out: int = 0) -> np.ndarray:
        """Logit of the 8 actual bits of each context's byte, but for ``out`` occurrences of it."""
        slots, bits = bit_slots(key)
        last = slice((ORDERS - 1) << SLOT_BITS, None)
        if self.logit is None:
            self.logit = np.log((self.n1 + np.float32(0.4)) / (self.n0 + np.float32(0.4))).astype(np.float32)
            self.seen = (self.n0[last] + self.n1[last]).astype(np.float32)
        if out and out not in self.left:
            # of each slot with a 0 and with a 1
            self.left[out] = np.stack([_ratio(self.n0 - out, self.n1), _ratio(self.n1 - out, self.n0)], -1).ravel()
        gate = _gate(_level(self.seen.take(slots[-1] - last.start) - out)).astype(np.intp)
        weights = self.weights.T.astype(np.float32)
        z = np.zeros(gate.shape, np.float32)
        for k in range(ORDERS):
            z += weights[k].take(gate) * (self.left[out].take(slots[k] * 2 + bits) if out else self.logit.take(slots[k]))
        if not out:
            np.negative(z, out=z, where=bits == 0)
        return z

    def word_bits(self, words: list[bytes], chunk: int = 1 << 13) -> np.ndarray:
        """-log2 of each word's probability."""
        of, key = byte_contexts(words)
        out = np.zeros(len(words))
        for s in range(0, len(key), chunk):
            np.add.at(out, of[s:s + chunk], _cost(self.signed(key[s:s + chunk])))
        return out / math.log(2)


def _ratio(same: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Logit of what was seen ``same`` times against ``other`` times."""
    return np.log((np.maximum(same, 0) + 0.4) / (other + 0.4)).astype(np.float32)


def _cell(x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
    """Gates (or gates and inputs before these) and inputs, to the nearest ``GRAIN``, as one number."""
    cell = gate.astype(np.int64)
    for y in x:
        cell = cell * CELLS + (np.clip(np.rint(y / np.float32(GRAIN)), -(CELLS // 2), CELLS // 2).astype(np.int32) + CELLS // 2)
    return cell


def _cells(x: list[np.ndarray], gate: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gates and inputs as one number, and how often."""
    cell = _cell(x, gate)
    return cell.ravel(), np.broadcast_to(times[:, None], cell.shape).ravel()


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    cell, times = (np.concatenate(x) for x in zip(*found, strict=True))
    cell, inv = np.unique(cell, return_inverse=True)
    return cell, np.bincount(inv, times, len(cell))


def _cost(z: np.ndarray) -> np.ndarray:
    """-log of the probability of each byte from the logits of its bits."""
    odds = 1 + np.exp(-np.clip(z, -80, 80), dtype=np.float32)
    product = odds[..., 0].astype(np.float64)
    for j in range(1, odds.shape[-1]):
        product *= odds[..., j]
    return np.log(product)


class Gated:
    """Gated weights for inputs that are signed by the actual bit."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def start(cls, weights: tuple[float, ...]) -> Gated:
        return cls(np.tile(weights, (GATES, 1)))

    def fit(self, cell: np.ndarray, times: np.ndarray, steps: int = 10) -> None:
        """Newton steps over all cells, with a weak pull to where the weights are."""
        k = self.weights.shape[1]
        gate, x = cell // CELLS ** k, np.empty((len(cell), k))
        for i in range(k):
            x[:, i] = (cell // CELLS ** (k - 1 - i) % CELLS - CELLS // 2) * GRAIN
        start, pull = self.weights, np.eye(k) * 10
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip((self.weights[gate] * x).sum(-1), -20, 20)))
            slope = times * p * (1 - p)
            g = np.stack([np.bincount(gate, times * (1 - p) * x[:, i], GATES) for i in range(k)], -1)
            h = np.stack([np.bincount(gate, slope * x[:, i] * x[:, j], GATES) for i in range(k) for j in range(k)], -1)
            g = g - (self.weights - start) @ pull
            move = np.linalg.solve(h.reshape(GATES, k, k) + pull, g[..., None])[..., 0]
            self.weights = self.weights + np.clip(move, -0.5, 0.5)

    def at(self, gate: np.ndarray) -> list[np.ndarray]:
        """The weights of each input."""
        gate = gate.astype(np.intp)
        return [np.ascontiguousarray(w).take(gate) for w in self.weights.T.astype(np.float32)]

    def costs(self, x: list[np.ndarray], gate: np.ndarray) -> list[np.ndarray]:
        """-log of each byte's probability, for each gain."""
        return _gained(sum(w * y for w, y in zip(self.at(gate), x, strict=True)))


def _gained(z: np.ndarray) -> list[np.ndarray]:
    return [_cost(np.float32(gain) * z) for gain in GAINS]


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, class (-1: not trained on), block; dealt out by block."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    kind = F.pmod(F.crc32(F.coalesce(lang, F.lit("")).cast("binary")), F.lit(CLASSES)).cast("int")
    d = doc_bytes(docs, F.when(fold(F.col("doc_id"), 7) != 2, kind).otherwise(-1).alias("class"))
    return (d.withColumn("block", F.pmod(F.xxhash64(id_text(F.col("doc_id")), "text"), F.lit(n)).cast("int"))
            .repartition(n, "block"))


def tokens(texts: pa.Array) -> pa.ListArray:
    """The lower-cased words of each text (bytes) and after them the end as an empty word."""
    texts = texts.cast(pa.binary())
    # spaces and letters of ASCII are told by their bytes, whether a text is UTF-8 or not
    text = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
    text = pc.ascii_lower(pc.ascii_trim_whitespace(text))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(text, "", " ")))


def numbered(found: list[pa.ListArray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens in order of appearance, the place of each token among them, and where each text
    begins and the last one ends."""
    flat = pa.chunked_array([x.flatten() for x in found], pa.string()).dictionary_encode()  # of all chunks at once
    names = [w or END for w in flat.chunk(0).dictionary.cast(pa.binary()).to_pylist()]
    size = np.concatenate([pc.list_value_length(x).to_numpy() for x in found])
    return names, np.concatenate([x.indices.to_numpy() for x in flat.chunks]), np.append(0, np.cumsum(size, dtype=np.int64))


def hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def pair_parts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What words with the hashes ``h``, and after them one end, add to the hash of a pair as its later
    and as its earlier word."""
    h = np.append(h, np.uint64(xxhash.xxh3_64_intdigest(END)))
    per = np.uint64(PAIRS // PREVIOUS)
    return (h % np.uint64(PREVIOUS) * per).astype(np.int64), ((h >> np.uint64(32)) % per).astype(np.int64)


def previous(parts: tuple[np.ndarray, np.ndarray], at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each token of documents side by side, which begin at ``start``, the hash of its previous two words,
    below ``PAIRS``. Before the first word there are ends."""
    out = np.zeros(len(at), np.int64)
    for back, part in enumerate(parts, 1):
        one = np.empty(len(at), np.int64)
        one[back:] = part[at[:-back]]
        for skip in range(back):
            # where a document is shorter, the next one's first tokens are set after
            one[np.minimum(start + skip, len(at) - 1)] = part[-1]
        out += one
    return out


def gathered(dealt: DataFrame) -> DataFrame:
    """What each block has: (block, kind, word, key, class, n): a word (closed) with its training
    count in a class (class -1 and 0 where the block has it in other documents only), a byte
    context with its training count, or the hash of the previous two words with the first byte
    and its training count in a class."""
    def gather(batches):
        now, found, kinds = None, [], []
        for b in batches:
            block, kind = (b.column(c).to_numpy() for c in ("block", "class"))
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1)).tolist()
            for s, e in itertools.pairwise(edges):
                if found and block[s] != now:
                    yield from _block_rows(now, found, kinds)
                    found, kinds = [], []
                now = int(block[s])
                found.append(tokens(b.column("text").slice(s, e - s)))
                kinds.append(kind[s:e])
        if found:
            yield from _block_rows(now, found, kinds)
        give_back()

    return (dealt.select("text", "class", "block").sortWithinPartitions("block")  # one block at a time
            .mapInArrow(gather, "block int, kind int, word binary, key long, class int, n long"))


def _block_rows(block: int, found: list[pa.ListArray], kinds: list[np.ndarray]):
    """The rows of one block from its documents' tokens and classes."""
    words, ids, start = numbered(found)
    del found[:]
    give_back()
    kind_of = np.repeat(np.concatenate(kinds).astype(np.int8), np.diff(start))
    pairs, first = pair_parts(hashes(words, len(words))), np.fromiter(map(itemgetter(0), words), np.int64, len(words))
    after = (previous(pairs, ids, start[:-1]) << 8 | first[ids]).astype(np.int32)
    closed = pa.array([w + b" " if w != END else w for w in words], pa.binary())
    trained = np.zeros(len(words), np.int64)
    for kind in sorted(set(np.unique(kind_of).tolist()) - {-1}):
        own = kind_of == kind
        n = np.bincount(ids[own], minlength=len(words))
        trained += n
        yield from _rows(block, WORD, kind, n[n > 0], word=closed.take(pa.array(np.flatnonzero(n))))
        n = np.bincount(after[own], minlength=PAIRS << 8)
        yield from _rows(block, FIRST, kind, n[n > 0], key=np.flatnonzero(n))
    del after, ids, kind_of
    others = np.flatnonzero(trained == 0)
    yield from _rows(block, WORD, -1, np.zeros(len(others), np.int64), word=closed.take(pa.array(others)))
    held = []
    at = np.flatnonzero(trained)
    for s in range(0, len(at), 50_000):
        part = at[s:s + 50_000]
        of, key = byte_contexts([words[i] for i in part])
        key, inv = np.unique(key, return_inverse=True)
        held.append((key, np.bincount(inv, trained[part][of], len(key))))
    if held:
        key, inv = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(inv, np.concatenate([c for _, c in held]), len(key)).astype(np.int64)
        yield from _rows(block, CONTEXT, 0, n, key=key)


def _rows(block: int, kind: int, class_: int, n: np.ndarray, word: pa.Array | None = None, key: np.ndarray | None = None):
    for s in range(0, len(n), 50_000):
        m = len(n[s:s + 50_000])
        same = [pa.array(np.full(m, x, np.int32)) for x in (block, kind, class_)]
        yield pa.RecordBatch.from_arrays(
            [same[0], same[1], pa.nulls(m, pa.binary()) if word is None else word.slice(s, m),
             pa.nulls(m, pa.int64()) if key is None else pa.array(key[s:s + m]), same[2], pa.array(n[s:s + m])],
            names=["block", "kind", "word", "key", "class", "n"])


def vocabulary(rows: DataFrame, n: int) -> DataFrame:
    """(word, block, class, n): the rows of the words that begin with the same two bytes in one
    task, in order; in ``n`` partitions."""
    return (rows.select("word", "block", "class", "n")
            .repartition(n, F.substring("word", 1, 2)).sortWithinPartitions("word", "block", "class"))


def _chapters(batches: Iterable[pa.RecordBatch], used: list[int]) -> Iterator[tuple]:
    """Of sorted words, (words, n, of, blocks) at a time, never parting words that begin with the
    same two bytes: the distinct words, their counts by class, and the word and block
    of each of their rows."""
    column = np.full(CLASSES + 1, -1)
    column[used] = np.arange(len(used))

    def made(held):
        word = pa.concat_arrays([w for w, *_ in held])
        block, kind, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        new = np.append(True, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False))
        of = np.cumsum(new) - 1
        some = np.flatnonzero(kind >= 0)
        counts = np.bincount(of[some] * len(used) + column[kind[some]], n[some], (of[-1] + 1) * len(used))
        once = np.append(True, (of[1:] != of[:-1]) | (block[1:] != block[:-1]))
        return word.filter(pa.array(new)).to_pylist(), counts.reshape(-1, len(used)), of[once], block[once]

    held, size = [], 0
    for b in batches:
        if not len(b):
            continue
        got = [b.column("word"), *(b.column(c).to_numpy() for c in ("block", "class", "n"))]
        if size >= ROWS:
            last = held[-1][0][-1].as_py()[:2]
            lead = pc.not_equal(pc.binary_slice(got[0], 0, 2), pa.scalar(last, pa.binary())).to_numpy(zero_copy_only=False)
            cut = int(lead.argmax()) if lead.any() else len(lead)
            if cut:
                held.append([g[:cut] for g in got])
            got = [g[cut:] for g in got]
            if len(got[0]):
                yield made(held)
                held, size = [], 0
        if len(got[0]):
            held.append(got)
            size += len(got[0])
    if held:
        yield made(held)


def byte_counts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the counts of the 256 bytes (last axis), for each bit of each byte how often what is
    like it so far went on with the same bit and with the other one."""
    parts = [n.reshape(*n.shape[:-1], 1 << j, 256 >> j).sum(-1).repeat(256 >> j, -1) for j in range(9)]
    same = np.stack(parts[1:], -1)
    return same, np.stack(parts[:-1], -1) - same


def begun(words: list[bytes], n: np.ndarray, second: np.ndarray) -> Iterator[tuple]:
    """(word, at, same, other) of the bytes after the first of sorted closed words: the words'
    numbers, the places in the joined words, and for each bit and class how often words that begin
    alike went on with the same bit and with the other one. ``second`` has the counts by class
    of all words' first two bytes."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    off = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(words), np.uint8)
    active = np.flatnonzero(size > 1)
    lead = flat[off[active]].astype(np.int64)
    for b in np.unique(lead):
        same, other = (np.moveaxis(x, 0, -1) for x in byte_counts(second[:, b]))
        own = active[lead == b]
        for s in range(0, len(own), PIECE):
            i = own[s:s + PIECE]
            yield i, off[i] + 1, same[flat[off[i] + 1]], other[flat[off[i] + 1]]
    active = active[size[active] > 2]
    two = flat[off[active]].astype(np.int64) << 8 | flat[off[active] + 1]
    node, place, alone = np.cumsum(np.append(0, two[1:] != two[:-1])) if len(two) else two, 2, []
    while len(active):
        new = np.append(True, node[1:] != node[:-1])
        start = np.flatnonzero(new)
        single = (np.diff(np.append(start, len(active))) == 1)[np.cumsum(new) - 1]
        alone.append((active[single], np.full(single.sum(), place)))
        active, node = active[~single], node[~single]
        if not len(active):
            break
        byte, own = flat[off[active] + place], n[active]
        new, levels = np.append(True, node[1:] != node[:-1]), []
        for j in range(9):
            if j:
                new[1:] |= byte[1:] >> (8 - j) != byte[:-1] >> (8 - j)
            levels.append((np.cumsum(new) - 1, np.add.reduceat(own, np.flatnonzero(new), axis=0)))
        for s in range(0, len(active), PIECE):
            count = np.stack([c[run[s:s + PIECE]] for run, c in levels], 1)
            yield active[s:s + PIECE], off[active[s:s + PIECE]] + place, count[:, 1:], count[:, :-1] - count[:, 1:]
        node, place = levels[-1][0], place + 1
        on = size[active] > place
        active, node = active[on], node[on]
    if alone:
        # no other word begins like these
        i, place = (np.concatenate(x) for x in zip(*alone, strict=True))
        ends = np.cumsum(size[i] - place)
        for s in range(0, int(ends[-1]) if len(ends) else 0, PIECE):
            j = np.arange(s, min(s + PIECE, ends[-1]))
            w = np.searchsorted(ends, j, side="right")
            same = np.broadcast_to(n[i[w]][:, None, :], (len(j), 8, n.shape[1]))
            yield i[w], off[i[w]] + size[i[w]] - (ends[w] - j), same, np.zeros((1, 8, n.shape[1]))


def _total(n: np.ndarray) -> np.ndarray:
    """Counts of all classes."""
    return sum(n[..., k] for k in range(n.shape[-1]))


def _bits(same: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts that are the same for all bits of a byte, for one of them."""
    return (same, other) if same.strides[1] else (same[:, :1], other[:, :1])


def _inputs(same: np.ndarray, other: np.ndarray, out: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Logits by all training words and gates, leaving out ``out`` occurrences."""
    all_same, all_other = _total(same) - out, _total(other)
    return _ratio(all_same, all_other), _gate(_level(all_same + all_other))


def bit_tables(contexts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and 1 of each slot over all training contexts: ``ORDERS * 2**SLOT_BITS``
    rows at most come back."""
    def expand(batches):
        n0, n1 = (np.zeros(ORDERS << SLOT_BITS) for _ in range(2))
        for b in batches:
            key, n = b.column("key").to_numpy(), b.column("n").to_numpy().astype(float)
            slots, bits = bit_slots(key)
            for k in range(ORDERS):
                one = (bits * n[:, None]).ravel()
                n1 += np.bincount(slots[k].ravel(), one, len(n1))
                n0 += np.bincount(slots[k].ravel(), np.repeat(n, 8) - one, len(n0))
        at = np.flatnonzero(n0 + n1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n0[at]), pa.array(n1[at])],
                                         names=["slot", "n0", "n1"])

    got = (contexts.mapInArrow(expand, "slot int, n0 double, n1 double").groupBy("slot")
           .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow())
    n0, n1 = (np.zeros(ORDERS << SLOT_BITS) for _ in range(2))
    n0[got["slot"].to_numpy()], n1[got["slot"].to_numpy()] = got["n0"].to_numpy(), got["n1"].to_numpy()
    return n0, n1


def train(contexts: DataFrame, passes: int = PASSES) -> Mixer:
    """Slot counts and weights from all training contexts."""
    sc = contexts.sparkSession.sparkContext
    n0, n1 = bit_tables(contexts)
    tables = sc.broadcast((n0, n1))
    weights = None
    for i in range(passes):
        def learn(batches, weights=weights, seed=i):
            m = Mixer(*tables.value, None if weights is None else weights.copy())
            rng = np.random.default_rng(seed)
            total = 0.0
            for b in batches:
                key, n = b.column("key").to_numpy(), b.column("n").to_numpy().astype(float)
                m.learn(key, n, rng)
                total += n.sum()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([m.weights.ravel().tolist()])],
                                                 names=["total", "weights"])

        got = (contexts.mapInArrow(learn, "total double, weights array<double>")
               .select("total", F.posexplode("weights").alias("i", "w"))
               .groupBy("i").agg((F.sum(F.col("total") * F.col("w")) / F.sum("total")).alias("w")).toPandas())
        if len(got):
            weights = np.zeros(GATES * ORDERS)
            weights[got["i"].to_numpy()] = got["w"].to_numpy()
            weights = weights.reshape(GATES, ORDERS)
    return Mixer(n0, n1, weights)


def first_bytes(n: np.ndarray, contexts: Mixer) -> tuple[np.ndarray, np.ndarray]:
    """-log of each first byte's probability after each hash of the previous two words, by the mixer
    of each class and gain, and by the byte contexts alone. ``n`` are the counts by class,
    hash and byte."""
    used = len(n)
    per = PAIRS // PREVIOUS
    alone = contexts.signed(byte_contexts([bytes([b, b]) for b in range(256)])[1][::3])
    total = n.sum(0)
    one = total.reshape(PREVIOUS, per, 256).sum(1)
    seen = byte_counts(total.sum(0)), [byte_counts(n[k].sum(0)) for k in range(used)]

    def inputs(p: int, k: int, out: int):
        both, own = byte_counts(total[p * per:(p + 1) * per]), byte_counts(one[p])
        x = [_ratio(a - out, b) for a, b in (both, own, seen[0], seen[1][k])]
        return [np.broadcast_to(y, x[0].shape) for y in x], _gate(_level(both[0] + both[1] - out))

    mixer, found = Gated.start(START_FIRST), []
    for p in range(PREVIOUS):
        for k in range(used):
            times = n[k, p * per:(p + 1) * per]
            some = times > 0
            if some.any():
                x, gate = inputs(p, k, 1)
                found.append(_summed([_cells([y[some] for y in x], gate[some], times[some].astype(float))]))
    mixer.fit(*_summed(found))
    out = np.empty((used * len(GAINS), PAIRS, 256))
    for p in range(PREVIOUS):
        for k in range(used):
            for g, x in enumerate(mixer.costs(*inputs(p, k, 0))):
                out[k * len(GAINS) + g, p * per:(p + 1) * per] = x
    return out.reshape(len(out), -1), _cost(alone)


def learnt(words: DataFrame, used: list[int], tables, second) -> tuple[Gated, int, int]:
    """The weights of the words' mixer from all training words, these words' number and that of
    their occurrences."""
    def learn(batches):
        m, count, total = Mixer(*tables.value), 0, 0
        sums = np.zeros(GATES * CELLS ** len(START))
        for names, n, _, _ in _chapters(batches, used):
            key = byte_contexts([w if w == END else w[:-1] for w in names])[1]
            count, total = count + len(names), total + int(n.sum())
            for i, at, same, other in begun(names, n, second.value):
                same, other = _bits(same, other)
                all_words, gate = _inputs(same, other, 1)
                both = _cell([m.signed(key[at], 1), all_words], gate)
                for k in range(len(used)):
                    some = np.flatnonzero(n[i, k] > 0)
                    if len(some):
                        own = _ratio(same[some, :, k] - 1, other[..., k] if len(other) == 1 else other[some, :, k])
                        np.add.at(sums, _cell([own], both[some]).ravel(), n[i[some], k].repeat(8))
        at = np.flatnonzero(sums)
        for s in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[s:s + 50_000]), pa.array(sums[at[s:s + 50_000]])], names=["cell", "times"])
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array([float(count), float(total)])], names=["cell", "times"])

    got = words.mapInArrow(learn, "cell long, times double").groupBy("cell").agg(F.sum("times").alias("times")).orderBy("cell").toArrow()
    cell, times = got.column("cell").to_numpy(), got.column("times").to_numpy()
    mixer = Gated.start(START)
    mixer.fit(cell[cell >= 0], times[cell >= 0])
    return mixer, int(times[cell == -1].sum()), int(times[cell == -2].sum())


def spelled(words: DataFrame, used: list[int], tables, second, weights: np.ndarray) -> DataFrame:
    """(block, key, c, costs) of ``PACK`` words of a block at most, side by side in numbers of 8, 8 and 4
    bytes: the words' hashes, their training counts, -log of their probabilities after the first
    byte by the mixer of each class and gain and by the byte contexts alone."""
    def spell(batches):
        m, mixer = Mixer(*tables.value), Gated(weights)
        for names, n, of, block in _chapters(batches, used):
            plain = [w if w == END else w[:-1] for w in names]
            key = byte_contexts(plain)[1]
            cost = np.zeros((len(names), len(used) * len(GAINS) + 1))
            for i, at, same, other in begun(names, n, second.value):
                z = m.signed(key[at])
                np.add.at(cost[:, -1], i, _cost(z))
                same, other = _bits(same, other)
                all_words, gate = _inputs(same, other)
                w = mixer.at(gate)
                both = w[0] * z + w[1] * all_words
                for k in range(len(used)):
                    for g, x in enumerate(_gained(both + w[2] * _ratio(same[..., k], other[..., k]))):
                        np.add.at(cost[:, k * len(GAINS) + g], i, x)
            h, c, cost = hashes(plain, len(plain)).view(np.int64), n.sum(1).astype(np.int64), cost.astype(np.float32)
            order = np.argsort(block, kind="stable")
            of, block = of[order], block[order].astype(np.int32)
            for s in range(0, len(of), 50_000):
                w, b = of[s:s + 50_000], block[s:s + 50_000]
                edges = packs(b)
                yield pa.RecordBatch.from_arrays([pa.array(b[edges[:-1]]), *(packed(x[w], edges) for x in (h, c, cost))],
                                                 names=["block", "key", "c", "costs"])

    return words.mapInArrow(spell, "block int, key binary, c binary, costs binary")


def packs(block: np.ndarray) -> np.ndarray:
    """Where sorted blocks' rows are parted so that ``PACK`` of one block stay together at most, and their end."""
    new = np.append(True, block[1:] != block[:-1])
    place = np.arange(len(block))
    place -= np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.append(np.flatnonzero(place % PACK == 0), len(block))


def packed(x: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The rows of ``x`` between two edges as one binary value each."""
    x = np.ascontiguousarray(x)
    at = (edges * (x.nbytes // max(1, len(x)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(x)])


def unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def document_log10(at: np.ndarray, counted: np.ndarray, coder: np.ndarray) -> float:
    """log10 of a document's probability from its tokens' ids ``at``, the probability of
    each id by the mixers (a row for each) and by the bit coder; the weights adapt along
    the document."""
    return float(refined(at, np.zeros(1, np.int64), np.append(counted, coder[None], axis=0).T[at])[0])


def repeats(at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each token how often its id was in its document before. Documents lie side by side."""
    n = len(at)
    shift = n.bit_length()
    key = np.sort(at.astype(np.int64) << shift | np.arange(n))
    place = key & (1 << shift) - 1
    key >>= shift
    same = np.append(False, (key[1:] == key[:-1]) & (doc[place[1:]] == doc[place[:-1]]))
    out = np.empty(n)
    out[place] = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    return out


def refined(at: np.ndarray, start: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """``document_log10`` of documents side by side, which begin at ``start``, from their tokens' ids and
    the probabilities of each token by the mixers and, last, by the bit coder."""
    n = len(at)
    size = np.diff(np.append(start, n))
    doc = np.repeat(np.arange(len(start)), size)
    place = np.arange(n) - start[doc]
    mixed_, coder = chances[:, :-1], chances[:, -1]
    pc = repeats(at, doc) / np.maximum(place, 1)
    pc[start] = coder[start]
    # one logarithm for RUN tokens of a document
    run = np.flatnonzero(place % RUN == 0)
    of = np.searchsorted(run, start)
    total = np.empty((len(start), len(GRID) * mixed_.shape[1]))
    for i, (c, b) in enumerate(GRID):
        p = (1 - c - b) * mixed_
        p += (c * pc + b * coder)[:, None]
        product = np.multiply.reduceat(p, run, axis=0)
        if product.min() > 1e-290:
            found = np.add.reduceat(np.log(product), of, axis=0)
        else:
            found = np.add.reduceat(np.log(p), start, axis=0)
        total[:, i * mixed_.shape[1]:(i + 1) * mixed_.shape[1]] = found
    return (np.logaddexp.reduce(total, axis=1) - math.log(total.shape[1])) / math.log(10)


def scored(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and the bits
    a byte of the words with one space after each."""
    spark = docs.sparkSession
    dealt = blocks(docs, block_bytes)
    rows = stored(gathered(dealt), "lm-rows", "kind")
    contexts = stored(rows.where(F.col("kind") == CONTEXT).groupBy("key").agg(F.sum("n").alias("n")), "lm-contexts")
    # in an order that doesn't depend on the blocks
    m = train(stored(contexts.repartition(max(1, contexts.count() // TAUGHT), "key").sortWithinPartitions("key"), "lm-taught"))

    def counts(kind: int, key: Column, size: int) -> dict[int, np.ndarray]:
        """The counts by class of a key below ``size``."""
        got = rows.where((F.col("kind") == kind) & (F.col("class") >= 0)).groupBy("class", key.alias("key")).agg(F.sum("n").alias("n")).toArrow()
        kind, key, n = (got.column(c).to_numpy() for c in ("class", "key", "n"))
        out = {int(k): np.zeros(size, np.int64) for k in np.unique(kind)}
        for k in out:
            out[k][key[kind == k]] = n[kind == k]
        return out

    first = counts(FIRST, F.col("key"), PAIRS << 8)
    used = sorted(first) or [0]
    lead = F.conv(F.hex(F.substring("word", 1, 2)), 16, 10).cast("long")  # the end is alone and has no second byte
    two = counts(WORD, F.when(F.octet_length("word") > 1, lead).otherwise(0), 1 << 16)
    none = np.zeros(PAIRS << 8, np.int64)
    second = spark.sparkContext.broadcast(np.stack([two.get(k, none[:1 << 16]) for k in used]).reshape(len(used), 256, 256))
    by_first = first_bytes(np.stack([first.get(k, none) for k in used]).reshape(len(used), PAIRS, 256), m)
    sent = spark.sparkContext.broadcast((np.ascontiguousarray(by_first[0].T, np.float32), by_first[1].astype(np.float32)))
    tables = spark.sparkContext.broadcast((m.n0.astype(np.float32), m.n1.astype(np.float32), m.weights))
    # learning sees each word once and in an order that doesn't depend on the blocks
    words = stored(rows.where((F.col("kind") == WORD) & (F.col("n") > 0)).groupBy("word", "class").agg(F.sum("n").alias("n"))
                   .withColumn("block", F.lit(0)), "lm-words")
    mixer, n_words, n_train = learnt(vocabulary(words, 1 + words.count() // ROWS), used, tables, second)
    of_blocks = rows.where(F.col("kind") == WORD)
    back = spelled(vocabulary(of_blocks, 1 + of_blocks.count() // ROWS), used, tables, second, mixer.weights)
    base = math.log10(n_train + n_words + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                        ("bits_per_byte", pa.float64())])

    def score(block: pa.Table, counts: pa.Table) -> pa.Table:
        names, at, start = numbered([tokens(text) for text in block.column("text").chunks])
        give_back()
        h = hashes(names, len(names))
        pairs, lead = pair_parts(h), np.fromiter(map(itemgetter(0), names), np.int64, len(names))
        size = np.fromiter(map(len, names), np.int64, len(names)) + 1
        size[names.index(END)] = 0
        del names
        key = unpacked(counts.column("key"), np.int64)
        order = np.argsort(key)
        found = order[np.searchsorted(key[order], h.view(np.int64))]
        c = unpacked(counts.column("c"), np.int64)[found]
        costs = unpacked(counts.column("costs"), np.float32).reshape(len(order), -1)[found]
        log_base = np.log10(c + 1) - base
        first, alone = sent.value
        ends, log10s = start[1:], []
        # documents with about PIECE tokens at a time
        for docs in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // PIECE)) + 1):
            every, begin = at[start[docs[0]]:ends[docs[-1]]], start[docs] - start[docs[0]]
            cost = costs[every]
            cost[:, :-1] += first[previous(pairs, every, begin) << 8 | lead[every]]
            cost[:, -1] += alone[lead[every]]
            # a word's cost is at most 1000 bits
            log10s.append(refined(every, begin, np.exp(-np.minimum(cost, 1000 * math.log(2), dtype=np.float64))))
        s = np.concatenate(log10s)
        known, log_base, size = (np.add.reduceat(x[at], start[:-1]) for x in ((c > 0).astype(np.int64), log_base, size))
        return pa.table([block.column("doc_id").cast(pa.int64()), pc.equal(block.column("class"), -1), pa.array(np.diff(start)),
                         pa.array(known), pa.array(np.full(len(s), n_train, np.int64)), pa.array(log_base), pa.array(s),
                         pa.array(-s / math.log10(2) / np.maximum(1, size))], schema=schema)

    return (dealt.groupBy("block").cogroup(back.groupBy("block"))
            .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                 "base_score double, score double, bits_per_byte double"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    small_batches(spark)
    return scored(table(spark, sf_dir, "documents"))
