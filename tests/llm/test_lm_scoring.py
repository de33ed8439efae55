import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from shelfscope.llm import lm_scoring
from tests.llm.support import ROWS, edge_docs, fold, lower, rows_of, small, small_texts, space_words


def brute(docs):
    """The base model: add-one unigrams of the training documents, with an end token."""
    tokens = [(i, [*space_words(lower(t)), None]) for i, t in docs]
    c = Counter(w for i, ws in tokens if fold(i, 7) != 2 for w in ws)
    n, v = c.total(), len(c)
    return sorted(((i, fold(i, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n,
                    round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens), key=repr)


def got_of(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                   for r in df.collect()), key=repr)


def test_base_on_edge_rows_in_many_blocks(spark):
    for size in (1 << 24, 20_000):
        assert got_of(lm_scoring.scored(edge_docs(spark), size)) == brute(ROWS)


def test_small_tables(spark):
    df = lm_scoring.scored(small(spark, "documents"), 60_000).cache()
    assert got_of(df) == brute(small_texts(spark).items())
    rows = df.collect()
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    trained = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] for r in trained) > sum(r["base_score"] for r in trained)
    one = rows_of(lm_scoring.scored(small(spark, "documents"), 1 << 30), "doc_id", "n_known")
    assert one == rows_of(df, "doc_id", "n_known")


def test_empty_and_untrained_tables(spark):
    assert lm_scoring.scored(edge_docs(spark, [])).count() == 0
    held = [i for i in range(100) if fold(i, 7) == 2][:3]
    rows = [(i, "some words here") for i in held]
    got = lm_scoring.scored(edge_docs(spark, rows)).collect()
    assert len(got) == 3 and all(r["train_tokens"] == 0 and r["base_score"] == 0.0 and math.isfinite(r["score"]) for r in got)


def test_bit_coder_is_a_distribution():
    """The words over two letters of up to four bytes, and all that begin like one of them."""
    n0, n1 = (np.zeros(lm_scoring.ORDERS << lm_scoring.SLOT_BITS) for _ in range(2))
    _, key = lm_scoring.byte_contexts([b"ab", b"abba", b"baab"])
    slots, bits = lm_scoring.bit_slots(key)
    for k in range(lm_scoring.ORDERS):
        np.add.at(n1, slots[k], bits)
        np.add.at(n0, slots[k], 1 - bits)
    m = lm_scoring.Mixer(n0, n1)
    m.learn(key, np.ones(len(key)), np.random.default_rng(0))
    # one byte and the closing byte: every byte value but the closing one, then any byte
    first = m.word_bits([bytes([b]) for b in range(256) if b not in (9, 10, 11, 12, 13, 32)])
    assert 0 < np.exp2(-first).sum() < 1
    _, key = lm_scoring.byte_contexts([b"a"])
    every = (key[0] >> 8 << 8) + np.arange(256)
    slots, bits = lm_scoring.bit_slots(every)
    gate = lm_scoring._gate(lm_scoring._level((m.n0 + m.n1)[slots[-1]]))
    logit = np.log((m.n1 + 0.4) / (m.n0 + 0.4))
    z = (m.weights[gate] * np.moveaxis(logit[slots], 0, -1)).sum(-1)
    assert abs(np.exp(-np.logaddexp(0, np.where(bits, -z, z)).sum(1)).sum() - 1) < 1e-9


def test_adaptive_mixture_is_sequential_bayes():
    rng = np.random.default_rng(1)
    counted, coder = rng.dirichlet(np.ones(6), 2), rng.dirichlet(np.ones(6))
    at = rng.integers(0, 6, 40)
    weights = np.full(len(lm_scoring.GRID) * 2, 1 / (len(lm_scoring.GRID) * 2))
    total = 0.0
    for i, t in enumerate(at):
        cache = coder[t] if i == 0 else (at[:i] == t).sum() / i
        p = np.array([c * cache + b * coder[t] + (1 - c - b) * row[t] for c, b in lm_scoring.GRID for row in counted])
        total += math.log10(weights @ p)
        weights = weights * p / (weights @ p)
    assert abs(total - lm_scoring.document_log10(at, counted, coder)) < 1e-9


def test_contexts_are_counted_by_occurrence(spark):
    trained = [i for i in range(100) if fold(i, 7) != 2][:2]
    docs = edge_docs(spark, [(trained[0], "ab ab ab ab cd"), (trained[1], "ab")])
    rows = lm_scoring.gathered(lm_scoring.blocks(docs)).where(f"kind = {lm_scoring.CONTEXT}").collect()
    _, key = lm_scoring.byte_contexts([b"ab"])
    got = {r["key"]: r["n"] for r in rows}
    assert [got[k] for k in key.tolist()] == [5, 5, 5]


def test_scores_do_not_depend_on_blocks(spark):
    one, many = ({r["doc_id"]: r["score"] for r in lm_scoring.scored(small(spark, "documents"), size).collect()}
                 for size in (1 << 30, 20_000))
    assert one.keys() == many.keys()
    assert all(math.isclose(one[i], many[i], rel_tol=1e-6) for i in one)


def test_order_of_words_matters(spark):
    trained = [i for i in range(3000) if fold(i, 7) != 2]
    held = [i for i in range(3000) if fold(i, 7) == 2][:2]
    rows = [(i, "red wine white bread " * 5) for i in trained[:40]]
    rows += [(held[0], "red wine white bread red wine white bread"), (held[1], "wine wine white white red red bread bread")]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.scored(edge_docs(spark, rows)).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_beginnings_of_words_are_counted_exactly():
    r = random.Random(5)
    words = sorted({bytes(r.choice(b"ab\xc3z") for _ in range(r.randint(1, 6))) + b" " for _ in range(300)} | {b"q" * 40 + b" "})
    n = np.array([[r.randint(0, 3), r.randint(0, 2)] for _ in words], float)
    second = np.zeros((2, 256, 256))
    for w, c in zip(words, n, strict=True):
        second[:, w[0], w[1]] += c
    size = [len(w) for w in words]
    off = np.cumsum(size) - size
    seen = set()

    def bits(w):
        return "".join(f"{b:08b}" for b in w)

    for word, at, same, other in lm_scoring.begun(words, n, second):
        other = np.broadcast_to(other, same.shape)
        for i, p, s, o in zip(word.tolist(), (at - off[word]).tolist(), same, other, strict=True):
            seen.add((i, p))
            for j in range(8):
                own = bits(words[i])[:8 * p + j + 1]
                turned = own[:-1] + ("1" if own[-1] == "0" else "0")
                assert s[j].tolist() == sum((c for w, c in zip(words, n, strict=True) if bits(w).startswith(own)), np.zeros(2)).tolist()
                assert o[j].tolist() == sum((c for w, c in zip(words, n, strict=True) if bits(w).startswith(turned)), np.zeros(2)).tolist()
    assert seen == {(i, p) for i in range(len(words)) for p in range(1, size[i])}


def test_first_byte_is_a_distribution():
    r = np.random.default_rng(3)
    n = r.integers(0, 3, (2, lm_scoring.PAIRS, 256)) * (r.random((2, lm_scoring.PAIRS, 256)) < 0.02)
    empty = np.zeros(lm_scoring.ORDERS << lm_scoring.SLOT_BITS)
    after, alone = lm_scoring.first_bytes(n, lm_scoring.Mixer(empty, empty))
    assert np.allclose(np.exp(-after).reshape(4, lm_scoring.PAIRS, 256).sum(-1), 1, atol=1e-4)
    assert np.allclose(np.exp(-alone).sum(), 1)


def test_logits_without_an_occurrence_are_taken_once(monkeypatch):
    """Each slot's logit is taken once a mixer, not for every bit of every context."""
    r = np.random.default_rng(4)
    n0, n1 = (r.integers(0, 5, lm_scoring.ORDERS << lm_scoring.SLOT_BITS).astype(np.float32) for _ in range(2))
    m, taken = lm_scoring.Mixer(n0, n1), []
    _, key = lm_scoring.byte_contexts([b"some", b"words", b"of", b"these"])
    slots, bits = lm_scoring.bit_slots(key)
    want = np.zeros(bits.shape)
    gate = lm_scoring._gate(lm_scoring._level((n0 + n1)[slots[-1]] - 1))
    for k in range(lm_scoring.ORDERS):
        same, other = np.where(bits, n1[slots[k]], n0[slots[k]]), np.where(bits, n0[slots[k]], n1[slots[k]])
        want += m.weights[gate, k] * np.log((np.maximum(same - 1, 0) + 0.4) / (other + 0.4))
    ratio = lm_scoring._ratio
    monkeypatch.setattr(lm_scoring, "_ratio", lambda *a: taken.append(1) or ratio(*a))
    assert np.allclose(m.signed(key, 1), want, atol=1e-4)
    first = len(taken)
    assert np.allclose(m.signed(key, 1), want, atol=1e-4) and len(taken) == first


def test_documents_side_by_side_are_refined_alike():
    """Several documents at once, also where products of probabilities leave the range of a double."""
    r = np.random.default_rng(8)
    for least in (1e-3, 1e-300):
        chances = r.uniform(least, 3 * least, (3, 50)) if least < 1e-9 else r.dirichlet(np.ones(50), 3)
        docs = [r.integers(0, 50, n) for n in (1, 30, 8, 9, 400)]
        start = np.cumsum([0] + [len(d) for d in docs])[:-1]
        at = np.concatenate(docs)
        got = lm_scoring.refined(at, start, chances.T[at])
        assert np.isfinite(got).all()
        for d, s in zip(docs, got, strict=True):
            assert math.isclose(s, lm_scoring.document_log10(d, chances[:-1], chances[-1]), rel_tol=1e-12)
            n = np.arange(len(d))
            cache = np.array([(d[:i] == t).sum() / i if i else chances[-1, t] for i, t in enumerate(d)])
            total = [np.log(c * cache + b * chances[-1, d] + (1 - c - b) * row[d]).sum() for c, b in lm_scoring.GRID for row in chances[:-1]]
            assert len(n) and math.isclose(s, (np.logaddexp.reduce(total) - math.log(len(total))) / math.log(10), rel_tol=1e-9)


def test_costs_of_a_block_lie_side_by_side():
    block = np.repeat([0, 2, 3], [lm_scoring.PACK * 2 + 1, 1, lm_scoring.PACK])
    edges = lm_scoring.packs(block)
    assert edges.tolist() == [0, lm_scoring.PACK, lm_scoring.PACK * 2, lm_scoring.PACK * 2 + 1, lm_scoring.PACK * 2 + 2, len(block)]
    x = np.random.default_rng(9).random((len(block), 5)).astype(np.float32)
    column = lm_scoring.packed(x, edges)
    assert len(column) == 5 and (lm_scoring.unpacked(column, np.float32).reshape(-1, 5) == x).all()


def test_words_are_parted_and_numbered_like_bytes():
    """All texts' words are numbered at once, whatever their bytes and the batches they come in."""
    r = random.Random(6)
    texts = [bytes(r.choice(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x00\x85\xa0AbZ\xc3\x89\xff") for _ in range(r.randint(0, 12))) for _ in range(500)]
    texts += [bytes(range(256)), b"", b"  ", b" a", b"a "]
    column = pa.array(texts, pa.binary())
    names, at, start = lm_scoring.numbered([lm_scoring.tokens(column[s:s + 37]) for s in range(0, len(texts), 37)])
    assert len(set(names)) == len(names) and len(start) == len(texts) + 1
    for t, s, e in zip(texts, start[:-1], start[1:], strict=True):
        assert [names[i] for i in at[s:e]] == [*t.lower().split(), lm_scoring.END]
    h = np.random.default_rng(7).integers(0, 1 << 63, len(names)).astype(np.uint64)
    one, two = parts = lm_scoring.pair_parts(h)
    got = lm_scoring.previous(parts, at, start[:-1])
    for s, e in zip(start[:-1], start[1:], strict=True):
        ids = [-1, -1, *at[s:e]]
        assert got[s:e].tolist() == [one[b] + two[a] for a, b in zip(ids[:-2], ids[1:-1], strict=True)]
