import math
from collections import Counter
from itertools import combinations

import corpus_pipeline
from shelfscope.llm import near_duplicates
from shelfscope.llm.graph import components
from tests.llm.support import BASE, ROWS, edge_docs, lower, prose, rows_of, small, small_texts, space_words


def shingles(text, k=5):
    w = space_words(lower(text))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if a is not None and b is not None and s and 100 * len(s & t) >= 75 * len(s | t):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=repr)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_edge_rows(spark):
    assert rows_of(near_duplicates.near_duplicates(edge_docs(spark)), *COLUMNS) == brute(ROWS)


def test_small_tables(spark):
    got = rows_of(near_duplicates.near_duplicates(small(spark, "documents")), *COLUMNS)
    assert got == brute(list(small_texts(spark).items()))
    assert not all(r[-1] for r in got)


def test_large_region_of_near_copies(spark):
    """More near copies than ``SMALL`` and a chain of texts of which only neighbours are alike."""
    rows = [(100 + i, f"{BASE} end{i}") for i in range(60)]
    chain = prose(77, 120).split()
    rows += [(500 + i, " ".join(chain[4 * i:4 * i + 80])) for i in range(10)]
    assert rows_of(near_duplicates.near_duplicates(edge_docs(spark, rows)), *COLUMNS) == brute(rows)


def test_sub_regions(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BIG", 16)
    rows = [(100 + i, f"{BASE} end{i}") for i in range(60)]
    assert rows_of(near_duplicates.near_duplicates(edge_docs(spark, rows)), *COLUMNS) == brute(rows)


def family(n=240, form=420, own=82, common=14):
    """Texts that share a form (similarity 0.72) and are linked only in pairs (0.755) by a
    few more shingles of their own."""
    rows, base = [], [f"form{i}" for i in range(form)]
    for i in range(n):
        pair = [f"pair{i // 2}x{j}" for j in range(common)] if i % 4 < 2 else []
        rows.append((1000 + (i * 101) % n, " ".join(base + pair + [f"own{i}x{j}" for j in range(own - len(pair))])))
    return rows


def test_links_inside_a_family(spark):
    rows = family()
    want = brute(rows)
    assert sum(not r[-1] for r in want) == len(rows) // 4
    assert rows_of(near_duplicates.near_duplicates(edge_docs(spark, rows)), *COLUMNS) == want


def test_family_in_a_grid(spark, monkeypatch):
    """Cut in many places, counted on a part of the texts, beside near copies in one component."""
    monkeypatch.setattr(near_duplicates, "SIDE", 3)
    monkeypatch.setattr(near_duplicates, "SKETCH_TEXTS", 20)
    rows = family(120)
    rows += [(5000 + i, rows[0][1] + f" more{i}") for i in range(30)]
    assert rows_of(near_duplicates.near_duplicates(edge_docs(spark, rows)), *COLUMNS) == brute(rows)


def test_empty_tables(spark):
    assert near_duplicates.near_duplicates(edge_docs(spark, [])).count() == 0
    blank = [(1, None), (2, ""), (3, " ")]
    assert rows_of(near_duplicates.near_duplicates(edge_docs(spark, blank)), *COLUMNS) == brute(blank)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (70, 70), (81, 80), (80, 81)] + [(100, k) for k in range(101, 160)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 55: 50, 80: 80, 81: 80, **{k: 100 for k in range(100, 160)}}


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c, d = (prose(seed, 40) for seed in (91, 92, 93, 94))
    rows = [(3, a), (10, a), (10, b), (5, b), (20, c), (20, d), (20, ""), (20, None), (21, c + " tail"), (22, d), (30, prose(95, 40)),
            (None, a), (None, b)]
    assert rows_of(near_duplicates.near_duplicates(edge_docs(spark, rows)), *COLUMNS) == brute(rows)
    lone = [(1, a), (1, b), (2, c)]
    assert rows_of(near_duplicates.near_duplicates(edge_docs(spark, lone)), *COLUMNS) == brute(lone)


def test_shingles_are_counted_in_all_texts(spark, monkeypatch):
    """However many members there are, those shingles are left out that no other set has."""
    monkeypatch.setattr(near_duplicates, "SKETCH_TEXTS", 2, raising=False)
    texts = {i: f"common words that all of the sets have {'again ' * (i % 3)}own{i} tail{i % 4} end" for i in range(1, 41)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    members = spark.createDataFrame([(i, i) for i in texts], "id long, c long")
    sets = {i: near_duplicates.shingle_set(t.encode(), near_duplicates.WordHashes()).view("int64").tolist() for i, t in texts.items()}
    in_sets = Counter(s for own in sets.values() for s in own)
    slots = Counter(s >> 64 - near_duplicates.SKETCH_BITS for own in sets.values() for s in own)
    assert all(slots[s >> 64 - near_duplicates.SKETCH_BITS] == n for s, n in in_sets.items())  # no two in one slot
    got = {}
    for r in near_duplicates.prefixes(members, docs, 75, 5).collect():
        got.setdefault(r["id"], set()).add(r["token"])
    for i, own in sets.items():
        rare = sorted(own, key=lambda s: (int(4 * math.log2(in_sets[s])), s % (1 << 64)))[:len(own) + (-75 * len(own) // 100) + 1]
        assert got.get(i, set()) == {s for s in rare if in_sets[s] > 1}


def test_no_task_has_two_python_workers_for_the_rare_shingles(spark, capsys):
    texts = {i: f"words that both sets have here own{i}" for i in range(1, 5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    near_duplicates.prefixes(spark.createDataFrame([(i, 1) for i in texts], "id long, c long"), docs, 75, 5).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_common_shingles_come_to_the_driver_by_runs_of_slots(spark, monkeypatch):
    """A row a slot on the driver would be millions of objects on large tables."""
    texts = {i: f"{prose(seed, 300)} own{i}" for i, seed in enumerate([1, 1, 2, 2, 2, 3, 4])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    slots = Counter(int(s) >> 64 - near_duplicates.SKETCH_BITS for t in texts.values()
                    for s in near_duplicates.shingle_set(t.encode(), near_duplicates.WordHashes()))
    monkeypatch.setattr(near_duplicates, "SKETCH_RUN", 1 << 13, raising=False)
    cells = 0

    def counted(frame, f):
        def run(*a, **b):
            nonlocal cells
            got = f(frame, *a, **b)
            cells += len(got)
            return got
        return run

    for kind, name in ((type(docs), "collect"), (type(docs), "toPandas"), (type(docs), "toArrow")):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), **b: counted(self, f)(*a, **b))
    got = near_duplicates.common_shingles(docs, 5)
    assert {int(s): int(got[s]) for s in got.nonzero()[0]} == {s: int(4 * math.log2(n)) for s, n in slots.items() if n > 1}
    assert 0 < cells <= 1 << near_duplicates.SKETCH_BITS - 13 < sum(n > 1 for n in slots.values())


def test_pipeline_stage_gathers_few_rows_on_the_driver(spark, monkeypatch):
    """What comes as Python rows follows neither the texts nor their shingles."""
    monkeypatch.setattr(near_duplicates, "SKETCH_RUN", 1 << 16, raising=False)
    docs, rows = edge_docs(spark, family(40)), []
    for name in ("collect", "toPandas"):
        def noted(self, *a, f=getattr(type(docs), name), **b):
            rows.append(len(got := f(self, *a, **b)))
            return got
        monkeypatch.setattr(type(docs), name, noted)
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert rows and max(rows) <= 1 << near_duplicates.SKETCH_BITS - 16
    assert kept.count() == 30
