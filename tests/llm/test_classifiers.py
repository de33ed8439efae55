"""Quality rules, quality classifier and toxicity: base counts by brute force, held-out
accuracy on the small labelled table, and the awkward cases."""

import re
from collections import Counter

import pytest

from shelfscope.llm import common, quality_classifier, quality_rules, toxicity
from tests.conftest import MEDIUM
from tests.llm.support import ROWS, edge_docs, fold, labels, prose, rows_of, small, small_texts, space_words

BASE_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_rules(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = space_words(t)
        lines = [x for x in t.split("\n") if space_words(x)]
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        repeat = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
        out.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat),
                    len(w) < 50 or 100 * len(repeat) > 50 * len(w)))
    return sorted(out, key=repr)


def test_base_rules(spark):
    hard = [(1, "a b c a b c a"), (2, "x\n\nx\n y\nx "), (3, "# | <a> $%&*"), (4, "é " * 60), (5, "a b " * 40), (6, prose(5, 80))]
    for rows in (ROWS, hard):
        got = quality_rules.verdicts(edge_docs(spark, rows), None)
        assert rows_of(got, *BASE_COLUMNS) == base_rules(rows)
        assert all(r["kept"] != r["base_failed"] and r["probability"] is None for r in got.collect())
    assert rows_of(quality_rules.verdicts(small(spark, "documents"), None), *BASE_COLUMNS) == base_rules(small_texts(spark).items())


def junk(spark, n=240):
    """Labelled rows of which every third is junk by its marks, and toxic every fourth."""
    rows, marks = [], []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 4 == 0
        text = prose(1000 + i, 70)
        text = " ".join(w + "%%%" for w in text.split()) if bad else text
        rows.append((i, text + (" you worthless idiot" if toxic else "")))
        marks.append((i, int(not bad), int(toxic)))
    extra = [(None, 0, 1), (5, None, None), (10_000, 0, 1), (7, marks[7][1], marks[7][2])]
    return rows, edge_docs(spark, rows), labels(spark, marks + extra), {i: (q, t) for i, q, t in marks}


def share_right(got, want, column, which):
    held = [r for r in got if fold(r["doc_id"], 5) == 0]
    return sum(int(r[column]) == want[r["doc_id"]][which] for r in held) / len(held)


def test_verdicts_on_made_rows(spark):
    _, docs, marks, want = junk(spark)
    got = quality_rules.verdicts(docs, quality_rules.train(docs, marks)).collect()
    assert share_right(got, want, "kept", 0) > 0.95
    assert all(0 <= r["probability"] <= 1 for r in got)


def test_quality_on_made_rows(spark):
    _, docs, marks, want = junk(spark)
    common.small_batches(spark)
    got = quality_classifier.classified(docs, marks).collect()
    assert share_right(got, want, "predicted", 0) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (fold(r["doc_id"], 5) == 0)
               for r in got)
    vectors = quality_classifier.word_vectors(docs)
    model = quality_classifier.train(quality_classifier.pooled(docs, vectors), marks)
    kept = quality_classifier.accepted(docs, vectors, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_toxicity_on_made_rows(spark):
    _, docs, marks, want = junk(spark)
    got = toxicity.scores(docs, toxicity.train(docs, marks)).collect()
    assert share_right(got, want, "predicted", 1) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_held_out_accuracy_on_the_labelled_table(spark):
    docs, marks = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    want = {r["doc_id"]: (r["quality"], r["toxic"]) for r in marks.collect()}
    got = [r for r in quality_classifier.classified(docs, marks).collect() if r["doc_id"] in want]
    assert share_right(got, want, "predicted", 0) > 0.85
    clean = [r for r in got if r["held_out"] and want[r["doc_id"]][0] == 1]
    assert sum(r["predicted"] for r in clean) >= 0.95 * len(clean)
    tox = [r for r in toxicity.scores(docs, toxicity.train(docs, marks)).collect() if r["doc_id"] in want]
    assert share_right(tox, want, "predicted", 1) > 0.85


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (3, 1, 0)], [(None, 0, 1), (2, None, None)]])
def test_without_both_classes(spark, marks):
    docs, known = edge_docs(spark), labels(spark, marks)
    assert quality_rules.train(docs, known) is None
    assert {r["score"] for r in quality_classifier.classified(docs, known).collect()} == {1.0}
    assert {r["score"] for r in toxicity.scores(docs, toxicity.train(docs, known)).collect()} == {0.0}


def test_edge_rows_are_scored_one_by_one(spark):
    _, docs, marks, _ = junk(spark)
    edge = edge_docs(spark)
    model = toxicity.train(docs, marks)
    got = toxicity.scores(edge, model).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(i) for i, _ in ROWS)
    assert len({r["score"] for r in got if r["doc_id"] in (5, 6, 7)}) == 1
    none = edge_docs(spark, [])
    assert toxicity.scores(none, model).count() == 0 and toxicity.train(none, marks) is None
    assert quality_classifier.classified(none, marks).count() == 0
    assert quality_rules.verdicts(none, quality_rules.train(none, marks)).count() == 0


def test_risk_never_falls_to_memorised_positives():
    """U holds the positives themselves: without the non-negative correction they would be
    fitted as negatives."""
    import numpy as np

    rng = np.random.default_rng(0)
    clean = [np.unique(rng.integers(100, 400, 40)).astype(np.int32) for _ in range(400)]
    toxic = [np.unique(np.append(rng.integers(100, 400, 40), rng.integers(0, 10, 3))).astype(np.int32) for _ in range(80)]
    w, b = toxicity.fit(toxic[:60], clean + toxic, 80 / 480)
    z = [b + w[x].sum() for x in toxic[60:]], [b + w[x].sum() for x in clean]
    assert np.mean(np.array(z[0]) > 0) > 0.9 and np.mean(np.array(z[1]) > 0) < 0.05


def test_a_repeated_id_does_not_fill_the_sample(spark):
    """One id with very many rows counts once, whatever the bounds."""
    rows = [(i, ("awful vile " if i % 2 else "kind calm ") + prose(i, 30)) for i in range(1, 60)]
    rows += [(1000, "plain " + prose(1000, 20))] * 400 + [(2, rows[1][1])] * 400
    docs = edge_docs(spark, rows)
    marks = labels(spark, [(i, i % 2, i % 2) for i in range(1, 60)])
    once = edge_docs(spark, sorted(set(rows)))
    for module, bound in ((toxicity, {"fit_p": 60, "fit_u": 100}), (quality_rules, {"rows": 60})):
        many, one = module.train(docs, marks, **bound), module.train(once, marks, **bound)
        assert many is not None and repr(many) == repr(one)
    vectors = quality_classifier.word_vectors(once)
    many, one = (quality_classifier.train(quality_classifier.pooled(d, vectors), marks, rows=60) for d in (docs, once))
    assert many is not None and repr(many) == repr(one)
