"""The audit against brute force, its vectors against pyspark.ml's estimator."""

import re
from collections import Counter

import pyarrow as pa
import pytest

from shelfscope.llm import source_divergence
from tests.llm.support import BASE, CLASH, lower, prose, small, small_texts

SCHEMA = "doc_id long, text string, lang string, source string" + "".join(f", `{c}` string" for c in CLASH)
ROWS = [(1, BASE, "en", "a"), (2, BASE + " Tail tail été", "en", "b"), (2, BASE + " Tail tail été", "en", "b"),
        (3, prose(3, 60), "en", None), (None, prose(4, 30), "en", "a"), (None, None, None, None), (5, None, "en", "only"),
        (6, "", "fr", "a"), (7, " \n\t 12 @[`{\x7f", "fr", "b"), (8, "漢字 漢字 ÉTÉ", "fr", "a"), (8, "漢字 x", "fr", "b"),
        (9, "漢字", "fr", "c"), (10, prose(11, 20_000), "de", "x"), (11, "solo", "xx", "one"), (12, "x" * 50_000, "de", "y"),
        (13, "a B c\x00d", "en", "a"), (14, "a b", "en", "c"), (15, "B a", "en", "c"), (16, prose(3, 40), "de", "y"),
        (17, prose(3, 40), "de", "z")]


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", terms_of(text)) for _, text, lang, source in rows]
    groups = {(lang, source) for lang, source, _ in docs}
    out = []
    for lang in {d[0] for d in docs}:
        frequency = Counter(t for x, _, terms in docs if x == lang for t in set(terms))
        kept = {t for t, n in frequency.items() if n >= min_docs}
        sources = {s for x, s in groups if x == lang}
        n = {s: Counter(t for x, y, terms in docs if (x, y) == (lang, s) for t in terms if t in kept) for s in sources}
        whole = sum(n.values(), Counter())

        def weights(c):
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p, q = {s: weights(n[s]) for s in sources}, weights(whole)
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources - {s}]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                ordered = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def audited(spark, rows, **options):
    df = spark.createDataFrame([(*r, *(None,) * len(CLASH)) for r in rows], SCHEMA)
    return sorted(map(tuple, source_divergence.audit(df, **options).collect()))


@pytest.mark.parametrize("held, pairs", [(1 << 20, 1 << 20), (5, 3)])
def test_audit_equals_brute_force(spark, monkeypatch, held, pairs):
    monkeypatch.setattr(source_divergence, "HELD", held)
    monkeypatch.setattr(source_divergence, "PAIRS", pairs)
    assert audited(spark, ROWS) == brute(ROWS)


def test_options_and_empty_table(spark):
    assert audited(spark, ROWS, min_docs=1, top_terms=2) == brute(ROWS, 1, 2)
    assert audited(spark, []) == []


def test_vectors_are_those_of_the_estimator(spark):
    from pyspark.ml.feature import CountVectorizer

    texts = [t or "" for t in small_texts(spark).values()]
    words, doc, term, count = source_divergence.document_vectors(pa.array(texts, pa.string()))
    words = words.to_pylist()
    mine = {}
    for d, t, n in zip(doc.tolist(), term.tolist(), count.tolist()):
        mine.setdefault(d, {})[words[t]] = n
    rows = spark.createDataFrame([(i, terms_of(t)) for i, t in enumerate(texts)], "i int, terms array<string>")
    model = CountVectorizer(inputCol="terms", outputCol="v", minDF=1.0, vocabSize=2 ** 31 - 1).fit(rows)
    names = model.vocabulary
    for r in model.transform(rows).collect():
        assert {names[k]: int(v) for k, v in zip(r["v"].indices, r["v"].values)} == mine.get(r["i"], {})


def test_kept_terms_are_those_of_the_estimator(spark):
    from pyspark.ml.feature import CountVectorizer
    from pyspark.sql import functions as F

    docs = small(spark, "documents").where("lang = 'en'")
    rows = spark.createDataFrame([(terms_of(r["text"]),) for r in docs.collect()], "terms array<string>")
    model = CountVectorizer(inputCol="terms", outputCol="v", minDF=3.0, vocabSize=2 ** 31 - 1).fit(rows)
    got = source_divergence.term_counts(docs.select(F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("tongue"), "text"))
    assert {r["term"] for r in got.collect()} == set(model.vocabulary)
