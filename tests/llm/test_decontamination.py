import re

from shelfscope.llm import decontamination
from tests.llm.support import BASE, ROWS, edge_docs, lower, prose, rows_of, sha, small, small_texts

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
ITEMS = [(1, " ".join(BASE.split()[5:30])), (2, "one TWO"), (3, None), (4, ""), (None, BASE), (5, "alpha"), (1, "漢字 é́"),
         (6, " ".join(prose(14, 12).split()[:10])), (7, "never seen words " * 6)]


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(docs, items, width=10):
    wins = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for s in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[s:s + width]), set()).add(item)
    sizes = {len(k) for k in wins}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return sorted(out, key=repr)


def bench(spark, items):
    return spark.createDataFrame([(*x, "?") for x in items], "item_id long, text string, win string")


def test_edge_rows(spark):
    got = rows_of(decontamination.contamination(edge_docs(spark), bench(spark, ITEMS)), *COLUMNS)
    assert got == brute(ROWS, ITEMS)


def test_small_tables(spark):
    items = [tuple(r) for r in small(spark, "benchmark").select("item_id", "text").collect()]
    got = rows_of(decontamination.contamination(small(spark, "documents"), small(spark, "benchmark")), *COLUMNS)
    assert got == brute(small_texts(spark).items(), items)
    assert any(r[-1] for r in got)


def test_empty_tables(spark):
    clean = decontamination.contamination(edge_docs(spark), bench(spark, []))
    assert rows_of(clean, *COLUMNS) == brute(ROWS, [])
    assert decontamination.contamination(edge_docs(spark, []), bench(spark, ITEMS)).count() == 0


def test_clean_keeps_columns_and_rows(spark):
    docs = edge_docs(spark)
    got = decontamination.clean(docs, bench(spark, ITEMS[:1]))
    assert got.columns == docs.columns
    bad = {r[0] for r in brute(ROWS, ITEMS[:1]) if r[-1]}
    assert sorted(map(repr, (r["doc_id"] for r in got.collect()))) == sorted(repr(i) for i, _ in ROWS if i not in bad)
