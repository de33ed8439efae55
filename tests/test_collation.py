"""Keys that ignore case, accents and edge spaces; step counts taken while the steps run."""

import pytest
from pyspark.sql import functions as F

from shelfscope.functions.text import ACCENTED, PLAIN, ieq, ine, match_key, match_text
from shelfscope.operators.conform import one_spelling
from shelfscope.operators.reshape import Observed, counted
from shelfscope.params import DEFAULT
from shelfscope.plans import etl as ETL
from shelfscope.plans import outlook
from shelfscope.queries import _spec
from shelfscope.sources import proxy
from tests.conftest import SMALL

SAME = ["Ch\u00e2teau", "CHATEAU ", " chateau", "Cha\u0302teau", "CH\u00c2TEAU"]


def test_spellings_compare_equal(spark):
    rows = spark.createDataFrame([(s,) for s in SAME], "s string")
    assert {r[0] for r in rows.select(match_key("s")).collect()} == {"CHATEAU"}
    assert {match_text(s) for s in SAME} == {"CHATEAU"}
    for literal in SAME:
        assert rows.where(ieq("s", literal)).count() == len(SAME) and rows.where(ine("s", literal)).count() == 0
    other = spark.createDataFrame([("Ch\u00e2telet",), ("",), (None,)], "s string")
    assert [r[0] for r in other.select(match_key("s")).collect()] == ["CHATELET", "", None]
    assert other.where(ine("s", "chateau")).count() == 2


def test_keys_agree_with_the_engines_collation(spark):
    """Every folded letter equals its plain form under Spark's own collation without case and accents."""
    pairs = list(zip(ACCENTED, PLAIN, strict=False))
    assert len(pairs) == len(PLAIN) > 400
    rows = spark.createDataFrame(pairs, "a string, b string")
    same = F.collate("a", "UNICODE_CI_AI") == F.collate("b", "UNICODE_CI_AI")
    assert rows.where(~same).count() == 0
    assert rows.where(match_key("a") != match_key("b")).count() == 0


def test_one_spelling_keeps_rows_and_takes_the_dims(spark):
    rows = [(i, s, "x") for i, s in enumerate(SAME)] + [(9, None, "x"), (10, "Merlot", "x"), (11, "Merlot", "x")]
    products = spark.createDataFrame(rows, "id int, varietal string, __extra string")
    dim = spark.createDataFrame([("Ch\u00e2teau",), ("Malbec",)], "varietal string")
    got = one_spelling(products, ["varietal"], {"varietal": dim})
    assert got.columns == products.columns
    assert sorted(map(tuple, got.collect())) == [(i, "Ch\u00e2teau" if i < 5 else None if i == 9 else "Merlot", "x")
                                                 for i in (0, 1, 2, 3, 4, 9, 10, 11)]
    first = one_spelling(products, ["varietal"]).where("id < 5").select("varietal").distinct().collect()
    assert [r[0] for r in first] == [min(SAME, key=lambda s: s.encode())]
    assert one_spelling(products.limit(0), ["varietal"]).count() == 0


def test_market_filter_by_accented_parameters(spark):
    periods, varietals = proxy.report_periods(spark), proxy.varietal_dim(spark, SMALL)
    sales = proxy.calc_sales(spark, SMALL, window=True)
    accented = sales.withColumn("origin", F.translate("origin", "AE", "\u00c0\u00c9"))
    want = outlook.brand_base(sales, periods, varietals, DEFAULT)
    got = outlook.brand_base(accented, periods, varietals, DEFAULT.with_(origin="Am\u00e9rica "))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 0


def test_steps_are_counted_by_the_write_itself(spark, tmp_path):
    raw, spec = proxy.raw_wide(spark, SMALL, "M"), _spec("M")
    observed = Observed()
    products, sales = ETL.clean(raw, proxy.color_map(spark), proxy.price_band_rows(), spec, observed=observed)
    products.write.parquet(str(tmp_path / "products"))
    steps = {"raw": ETL.keyed(raw)}
    steps["positive_total"] = ETL.C.filter_positive(steps["raw"], list(spec.period_labels))
    steps["required_attributes"] = ETL.C.require(steps["positive_total"])
    want = {r["step"]: r["rows"] for r in counted(steps).collect()}
    got = observed.counts()
    assert {step: n["rows"] for step, n in got.items()} == want
    assert want["raw"] > want["positive_total"] > 0
    plain, _ = ETL.clean(raw, proxy.color_map(spark), proxy.price_band_rows(), spec)
    assert spark.read.parquet(str(tmp_path / "products")).count() == plain.count() == want["required_attributes"]


def test_observed_sees_a_broken_step_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    observed = Observed()
    twice = observed.watch("joined", rows.join(spark.createDataFrame([(1,), (1,)], "k int"), "k", "left"), ("v",))
    observed.watch("read", twice.where("k > 1"), ("k", "v")).collect()
    assert observed.counts() == {"joined": {"rows": 4, "rows_with_null": 1}, "read": {"rows": 2, "rows_with_null": 1}}
    with pytest.raises(ValueError, match="watched already"):
        observed.watch("read", rows)
