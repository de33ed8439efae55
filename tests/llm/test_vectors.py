"""Product codes and exact search against brute force, on awkward tables."""

import hashlib
import math

import numpy as np
import pytest

from shelfscope.llm import vector_codes, vector_search
from tests.llm.support import CLASH

SCHEMA = "vec_id long, embedding array<float>, label int" + "".join(f", `{c}` string" for c in CLASH if c != "label")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (len(CLASH) - 1)) for r in rows], SCHEMA)


def vectors(n, dim, seed, levels=None):
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.2, (n, dim)) if levels is None else r.integers(0, levels, (n, dim)) / 16
    return x.astype(np.float32).tolist()


def awkward(dim, n=300):
    x = vectors(n, dim, 1)
    rows = [(3 * i - 60, v, i % 4 if i % 7 else None) for i, v in enumerate(x)]
    rows += [(5000 + i, x[0], 1) for i in range(120)]                      # one vector held by many rows
    rows += [(50, x[5], 2)] * 3 + [(50, x[6], 2), (None, x[7], 3), (None, x[0], None)]
    rows += [(9000, None, 1), (9050, [None] * dim, 1), (9100, [math.nan] * dim, 1), (9150, [math.inf] + [0.0] * (dim - 1), 1)]
    return rows


def usable(rows):
    return [(i, [math.floor(256.0 * float(np.float32(c))) for c in v], label) for i, v, label in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def id_key(i):
    return (i is None, i or 0)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(usable(rows), key=lambda r: (id_key(r[0]), r[1]))
    cut = [[tuple(v[p * (len(v) // parts):(p + 1) * (len(v) // parts)]) for _, v, _ in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for x in cut[p]:
                mine.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [tuple(sum(c) // len(c) for c in zip(*mine[k])) if k in mine else e for k, e in enumerate(books[p])]
    found = [[nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
    error = [sum(found[p][i][0] for p in range(parts)) for i in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{found[p][n][1]:02x}" for p in range(parts)), error[n], by_label[label], digest)
                   for n, (i, _, label) in enumerate(kept)), key=repr)


def run_codes(df):
    coded, books = vector_codes.compressed(df)
    digest = vector_codes.books_sha256(books)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], digest)
                   for r in vector_codes.with_label_error(coded).collect()), key=repr)


@pytest.mark.parametrize("block, hot", [(8192, 1000), (37, 3)])
def test_codes_equal_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    monkeypatch.setattr(vector_codes, "HOT", hot)
    rows = awkward(64)
    assert run_codes(frame(spark, rows)) == brute_codes(rows)


def test_codes_with_ties_and_few_rows(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(90, 32, 2, levels=3))]
    assert run_codes(frame(spark, rows)) == brute_codes(rows)
    assert run_codes(frame(spark, rows[:5])) == brute_codes(rows[:5])


def test_codes_of_nothing_and_of_unequal_vectors(spark):
    coded, books = vector_codes.compressed(frame(spark, [(1, None, 1)]))
    assert books is None and vector_codes.with_label_error(coded).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compressed(frame(spark, [(1, [0.5] * 12, 1)]))


def test_a_tree_assigns_whole_subtrees():
    """Well separated clusters: whole subtrees go to their entry, none of their rows is compared."""
    r = np.random.default_rng(3)
    centres = np.array([[-4000, 0], [4000, 0], [0, 4000]])
    x = (centres[r.integers(0, 3, 600)] + r.integers(-30, 30, (600, 2))).astype(np.int64)
    order, nodes = vector_codes.Tree.grown(x, 1)
    tree = vector_codes.Tree.stored(x, order, nodes, 1)
    start, end, entry = tree.assigned(centres[None])
    assert (end - start).sum() == 600 and len(start) < 10
    d = ((x[order][:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert all((d[s:e] == k).all() for s, e, k in zip(start, end, entry))
    # children cover their node's rows within half its radius, and are further apart than that
    for n in np.flatnonzero(nodes["child"] >= 0):
        kids = np.arange(nodes["child"][n], nodes["child"][n] + nodes["children"][n])
        assert nodes["start"][kids[0]] == nodes["start"][n] and nodes["end"][kids[-1]] == nodes["end"][n]
        assert (4 * nodes["radius2"][kids] <= nodes["radius2"][n]).all()
        c = x[nodes["centre"][kids]]
        apart = ((c[:, None] - c[None]) ** 2).sum(2)[np.triu_indices(len(kids), 1)]
        assert (4 * apart > nodes["radius2"][n]).all()


def brute_search(rows, k=5):
    kept = sorted({(i, tuple(v)) for i, v, _ in usable(rows)}, key=lambda r: (id_key(r[0]), r[1]))
    out = []
    for i, q in kept:
        if i is None or i % 50:
            continue
        best = sorted((-sum(a * b for a, b in zip(q, v)), id_key(j), j) for j, v in kept if j != i and len(v) == len(q))[:k]
        out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(best, 1)]
    return sorted(out, key=repr)


def run_search(spark, rows, **k):
    from pyspark.sql import functions as F
    got = vector_search.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, **k)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("tile, dim", [(4096, 64), (16, 64), (16, 7)])
def test_search_equals_brute_force(spark, monkeypatch, tile, dim):
    monkeypatch.setattr(vector_search, "TILE_ROWS", tile)
    monkeypatch.setattr(vector_search, "LEAST_ROWS", 100)
    rows = awkward(dim) + [(100, vectors(1, 5, 9)[0], 1), (101, vectors(1, 5, 8)[0], 1), (10_000, [], 1)]
    assert run_search(spark, rows) == brute_search(rows)


def test_search_with_ties_few_rows_and_none(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(400, 8, 5, levels=2))]
    assert run_search(spark, rows) == brute_search(rows)
    assert run_search(spark, rows[:3]) == brute_search(rows[:3])
    assert run_search(spark, []) == []


def test_bounds_hold_and_prune():
    r = np.random.default_rng(7)
    x = np.cumsum(r.integers(-40, 41, (3000, 64)), axis=1)  # smooth rows: what segment statistics are for
    q = x[:40]
    exact = q @ x.T
    for s in vector_search.LEVELS:
        bound = vector_search.statistics(q, s) @ vector_search.statistics(x, s).T
        assert (bound >= exact - 1e-6 * np.abs(exact).max()).all()
    fifth = -np.sort(-exact, axis=1)[:, 4:5]
    coarse = vector_search.statistics(q, 4) @ vector_search.statistics(x, 4).T
    assert (coarse >= fifth).mean() < 0.25


def test_components_out_of_range_are_refused():
    import pyarrow as pa
    from shelfscope.llm.vectors import whole
    with pytest.raises(ValueError):
        whole(pa.array([[3e30, 1.0]], pa.list_(pa.float32())), 2)
