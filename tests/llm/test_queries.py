"""Registered queries against their DuckDB SQL, the licence scan's cases and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from shelfscope.llm import license_scan, registry
from tests.conftest import SMALL
from tests.llm.support import ROWS, edge_docs, rows_of, small

COLUMNS = ("doc_id", "n_matches", "best_licence", "best_dice", "licences")


def oracle(sql, **tables):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "embeddings"):
        if name in tables:
            con.register(name, tables[name])
        else:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con.execute(sql).to_arrow_table()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, name):
    want = oracle(registry.ORACLE[name])
    got = registry.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.column_names)
    assert rows_of(got, *want.column_names) == sorted(zip(*(c.to_pylist() for c in want.columns)), key=repr)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))


def test_licences_on_edge_rows(spark):
    rows = [*ROWS, (20, "some text\nLicensed under the Apache License, Version 2.0.\nmore"), (21, "RELEASED under the mit license"),
            (22, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (23, "Licensed under nothing at all of that sort"),
            (24, "This work is licensed under the GNU General\nPublic License, version 3.")]
    docs = edge_docs(spark, rows)
    want = oracle(license_scan.SQL, documents=docs.select("doc_id", "text").toArrow())
    got = license_scan.licences(docs)
    assert rows_of(got, *COLUMNS) == sorted(zip(*(want.column(c).to_pylist() for c in COLUMNS)), key=repr)
    by_id = {r["doc_id"]: r["licences"] for r in got.collect()}
    assert (by_id[20], by_id[21], by_id[22], by_id[23], by_id[24]) == ("Apache-2.0", "MIT", "CC-BY-NC-4.0,MIT", "", "GPL-3.0")
    assert license_scan.licences(edge_docs(spark, [])).count() == 0


def test_pipeline_stages(spark):
    """Each stage against its operator on what it was given; all but the last keep the columns."""
    from shelfscope.llm import byte_bpe, decontamination, near_duplicates, pii

    docs = small(spark, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    given, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SMALL).cache()
        assert out.columns == columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        before = {r["doc_id"] for r in given.select("doc_id").collect()}
        assert ids <= before and ids
        kept[name] = (given, out, ids, before)
        given = out
    labels = {r["doc_id"]: r["quality"] for r in small(spark, "labels").collect()}
    _, _, ids, before = kept["quality"]
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in ids for i in good) >= 0.95 * len(good)
    g, _, ids, _ = kept["near_duplicates"]
    assert ids == {r["doc_id"] for r in near_duplicates.near_duplicates(g).collect() if r["kept"]}
    g, _, ids, _ = kept["decontamination"]
    assert ids == {r["doc_id"] for r in decontamination.contamination(g, small(spark, "benchmark")).collect() if not r["contaminated"]}
    g, out, ids, before = kept["personal_data"]
    assert ids == before
    left = pii.digests(out).selectExpr("sum(n_email) e", "sum(n_phone) p").first()
    assert (left["e"], left["p"]) == (0, 0)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, given, SMALL)
    assert rows_of(last, "doc_id", "decoded_sha256") == rows_of(
        byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(given))), "doc_id", "decoded_sha256")
