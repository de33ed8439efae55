"""Golden micro-fixtures: hand-worked expected values for each semantic trap."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import calendar as CAL
from shelfscope.functions import numeric as N
from shelfscope.functions import text as X
from shelfscope.operators import clean as C
from shelfscope.operators import measures as M
from shelfscope.operators import position as POS
from shelfscope.operators.conform import period_analogy, with_relative_year
from shelfscope.operators.reshape import melt


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def col_values(df, c="r"):
    return [r[c] for r in df.collect()]


def test_title_case_matches_python(spark):
    raw = ["o'brien's 1st pre-mix", "  SALT & PEPPER ", "ÉCOLE du VIN", "", None]
    got = col_values(one_col(spark, raw).select(X.py_title(X.py_strip("v")).alias("r")))
    assert got == [None if s is None else s.strip().title() for s in raw]
    assert got[0] == "O'Brien'S 1St Pre-Mix"


def test_strip_then_comma_then_space(spark):
    got = col_values(one_col(spark, [" foo ,", "a,b  c"]).select(X.clean_attribute("v").alias("r")))
    assert got == ["Foo ", "AB C"]   # "a,b  c".title() == "A,B  C"


def test_lead_strip_is_one_ordered_pass(spark):
    got = col_values(one_col(spark, [">>#-*«Foo", "->Foo", "Foo>"]).select(X.lead_strip("v").alias("r")))
    assert got == ["Foo", ">Foo", "Foo>"]


def test_positive_total_keeps_only_positive(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 0.0, 0.0), (3, -2.0, None), (4, None, None)],
                               "k int, a double, b double")
    assert sorted(r.k for r in C.filter_positive(df, ["a", "b"]).collect()) == [1]


def test_price_band_null_and_last(spark):
    bands = [("D", 0.0, 9.99), ("E", 10.0, 19.99)]
    prices = spark.createDataFrame([(1, 5.0), (2, 9.995), (3, None), (4, 25.0)], "k int, p double")
    null_mode = {r.k: r.price_segment_retail for r in C.price_band(prices, bands, "p").collect()}
    last_mode = {r.k: r.price_segment_retail for r in C.price_band(prices, bands, "p", unmatched="last").collect()}
    assert null_mode == {1: "D", 2: None, 3: None, 4: None}
    assert last_mode == {1: "D", 2: "E", 3: "E", 4: "E"}


def test_overlapping_bands_rejected():
    with pytest.raises(ValueError):
        C.validate_bands([("A", 0.0, 10.0), ("B", 10.0, 20.0)])
    C.validate_bands([("A", 0.0, 9.99), ("B", 10.0, 20.0)])


def test_round2_is_numpy_style(spark):
    got = col_values(one_col(spark, [1.005, 0.125, 0.375, 0.285], "double").select(N.round2("v").alias("r")))
    assert got == [1.0, 0.12, 0.38, 0.28]


def test_numeric_coercion(spark):
    got = col_values(one_col(spark, ["12d", " 12 ", "$12", "1e3", None]).select(N.coerce_numeric("v").alias("r")))
    assert got == [0.0, 12.0, 0.0, 1000.0, 0.0]


def test_melt_keeps_nulls(spark):
    df = spark.createDataFrame([("A", 1.0, None), ("B", None, 2.0)], "global_code string, p1 double, p2 double")
    rows = melt(df, ["global_code"], ["p1", "p2"]).collect()
    assert len(rows) == 4
    assert sum(r.sale_actual_cases is None for r in rows) == 2


def test_fiscal_period(spark):
    df = spark.createDataFrame([("2022-04-01",), ("2022-11-11",), ("2023-03-31",)], "d string")
    got = col_values(df.select(CAL.fiscal_period(F.to_date("d")).alias("r")))
    assert got == ["2022P01", "2022P09", "2022P13"]


def test_period_analogy_both_calendars(spark):
    labels = CAL.python_labels("M", "2024M10", 24) + CAL.python_labels("P", "2024P08", 26)
    assert labels[0] == "2022M11" and labels[24] == "2022P09" and labels[-1] == "2024P08"
    df = spark.createDataFrame([(x,) for x in labels + ["2021M01"]], "period_code string")
    out = {r.period_code: r.relative_year for r in period_analogy(df, {"M": "2024M10", "P": "2024P08"}).collect()}
    assert "2021M01" not in out
    assert out["2022M11"] == "LRY" and out["2023M10"] == "LRY" and out["2023M11"] == "TRY"
    assert out["2023P08"] == "LRY" and out["2023P09"] == "TRY" and out["2024P08"] == "TRY"


def _market(spark, vols):
    rows = [("P", "V", f"B{i}", None if v is None else Decimal(v), Decimal(0)) for i, v in enumerate(vols)]
    return spark.createDataFrame(rows, "province_code string, varietal string, brand string, "
                                       "sale_vol_ty decimal(18,4), revenue_ty decimal(18,4)")


def _tiers(spark, vols, inclusive):
    o = M.order_desc("sale_vol_ty", "revenue_ty", tiebreak=("brand",))
    mk = ["province_code", "varietal"]
    df = _market(spark, vols).withColumn("cum", M.cum_share("sale_vol_ty", mk, o))
    lag = M.lagged("cum", mk, o, default0=inclusive)
    return [r.t for r in df.select("brand", M.tier(lag, inclusive=inclusive).alias("t")).orderBy("brand").collect()]


def test_tiers_strict_and_inclusive(spark):
    assert _tiers(spark, [50, 30, 15, 5], inclusive=False) == [1, 2, 3, 3]
    assert _tiers(spark, [50, 30, 15, 5], inclusive=True) == [1, 1, 2, 3]


def test_hhi_and_concentration(spark):
    mk = ["province_code", "varietal"]
    o = M.order_desc("sale_vol_ty", "revenue_ty", tiebreak=("brand",))
    df = _market(spark, [50, 30, 15, 5]).select("*", M.share("sale_vol_ty", mk).alias("s"),
                                                 M.row_number(mk, o).alias("rk"))
    r = df.groupBy(*mk).agg(M.hhi("s").alias("hhi"), *[M.concentration_ratio(k, "rk", "sale_vol_ty").alias(f"cr{k}")
                                                      for k in (3, 5, 10)]).first()
    assert (r.hhi, r.cr3, r.cr5, r.cr10) == (3650.0, 95.0, 100.0, 100.0)
    seg = spark.createDataFrame([(3650.0,), (1500.0,), (1501.0,), (10000.0,), (None,)], "h double")
    assert col_values(seg.select(POS.hhi_segment("h").alias("r"))) == [
        "Highly concentrated", "Competitive", "Moderately concentrated", "Monopoly", "Unknown"]


def test_hhi_rounding_before_segment(spark):
    df = spark.createDataFrame([(1500.4,), (1500.5,)], "x double")
    got = df.select(N.dec0("x").alias("h")).select("h", POS.hhi_segment("h").alias("s")).collect()
    assert [(r.h, r.s) for r in got] == [(1500.0, "Competitive"), (1501.0, "Moderately concentrated")]


def test_yoy_absent_years_are_zero(spark):
    df = spark.createDataFrame([(None, Decimal(10)), (Decimal(10), None), (Decimal(40), Decimal(50))],
                               "ly decimal(18,4), ty decimal(18,4)")
    assert col_values(df.select(N.yoy("ty", "ly").alias("r"))) == [0.0, 0.0, 25.0]


def test_zero_denominator_share_is_null(spark):
    df = spark.createDataFrame([(Decimal(0), Decimal(0))], "x decimal(18,4), t decimal(18,4)")
    assert df.select(N.ratio("x", "t", 100.0).alias("r")).first().r is None


@pytest.mark.parametrize("yoy,mkt,growth,rank,tier,label,first", [
    (0.0, 2.0, 0.0, 0, 0, "Pipeline", None),
    (10.0, 2.0, 1.0, 2, 1, "Expanding Leader", "Expanding"),
    (1.0, 2.0, 0.1, 9, 3, "Steady Niche", "Steady"),
    (1.0, 2.0, -0.5, 5, 2, "Contracting Challenger", "Contracting"),
])
def test_archetype(spark, yoy, mkt, growth, rank, tier, label, first):
    df = spark.createDataFrame([(yoy, mkt, growth, rank, tier)], "y double, m double, g double, r int, t int")
    r = df.select(POS.archetype("y", "m", "g", "r", "t").alias("a"), POS.momentum("y", "m", "g").alias("f")).first()
    assert (r.a, r.f) == (label, first)


def test_flagship_tie_keeps_both(spark):
    from shelfscope.plans.flagship import flagship_candidates

    rows = [("P", "V", 750, "B", code, "n", 10.0, "D", Decimal(1), Decimal(5), Decimal(1), Decimal(5))
            for code in ("1", "2")]
    base = spark.createDataFrame(rows, "province_code string, varietal string, unit_size int, brand string, "
                                       "product_code string, product_name string, retail_price double, "
                                       "price_segment string, sale_ly decimal(18,4), sale_ty decimal(18,4), "
                                       "revenue_ly decimal(18,4), revenue_ty decimal(18,4)")
    ranks = [r.sku_rank_by_volume for r in flagship_candidates(base).collect()]
    assert ranks == [1, 1]


def test_unmapped_period_inner_vs_left(spark):
    sales = spark.createDataFrame([("X", "2030M01", Decimal(3))], "k string, period_code string, v decimal(18,4)")
    dim = spark.createDataFrame([("2001M10", "TRY")], "period_code string, relative_year string")
    assert with_relative_year(sales, dim).count() == 0
    left = M.rolling_year(with_relative_year(sales, dim, "left"), ["k"], {"ty": ("v", "TRY")}).collect()
    assert [(r.k, r.ty) for r in left] == [("X", None)]


def test_global_row_number_matches_single_window(spark):
    import random

    from pyspark.sql import Window

    rnd = random.Random(7)
    rows = [(f"b{i:04d}", None if i % 29 == 0 else (Decimal(500) if i % 3 == 0 else Decimal(rnd.randint(0, 10_000))))
            for i in range(2000)]                   # a third of the rows share one hot value
    df = spark.createDataFrame(rows, "brand string, v decimal(18,4)")
    got = {r.brand: r.rn for r in M.global_row_number(df, "v", ("brand",), buckets=16).collect()}
    w = Window.orderBy(F.col("v").desc_nulls_last(), F.col("brand").asc())
    want = {r.brand: r.rn for r in df.select("brand", F.row_number().over(w).alias("rn")).collect()}
    assert got == want


def test_two_decimal_percentages_are_exact(spark):
    from decimal import Decimal

    from shelfscope.functions.numeric import percent2

    rows = [("1.0050", "100.0000", 1.01), ("-1.0050", "100.0000", -1.01), ("1.0049", "100.0000", 1.0), ("1.0000", "3.0000", 33.33),
            ("2.0000", "0.0000", 0.0), (None, "1.0000", 0.0), ("1.0000", None, 0.0), ("123456789012.0000", "7.0000", 1763668414457.14)]
    df = spark.createDataFrame([(None if a is None else Decimal(a), None if b is None else Decimal(b), w) for a, b, w in rows],
                               "a decimal(28,4), b decimal(28,4), w double")
    assert [r["g"] for r in df.select(percent2("a", "b").alias("g")).collect()] == [w for *_, w in rows]


def test_forecast_gives_every_step_and_uses_the_fit(spark):
    from shelfscope.plans import forecast

    rows = [("s", 2023 * 12 + m, m + 1, 2023, 100.0 + m, float(m % 2)) for m in range(6)]
    pts = spark.createDataFrame(rows, "series string, period_no int, season int, year int, y double, promo double")
    got = {r["step"]: r for r in forecast.organic_forecast(pts).collect()}
    assert sorted(got) == list(range(1, 14))
    assert [k for k in got if got[k]["forecast_median"] is None] == [1, 2, 3, 4, 5, 6, 13]
    assert got[7]["target_period"] == "2024-01" and got[7]["forecast_median"] == 100.0
    fit = spark.createDataFrame([("s", 1000.0, 2.0)], "series string, promo_slope double, resid_se double")
    got = {r["step"]: r for r in forecast.organic_forecast(pts, fit).collect()}
    assert got[8]["forecast_median"] == 101.0 - 1000.0 and got[8]["forecast_high"] > got[8]["forecast_low"]


def test_row_numbers_of_skewed_values(spark):
    from shelfscope.operators import measures as M

    df = spark.createDataFrame([(f"b{i:04d}", 1e12 if i == 7 else float(i % 50) if i % 9 else None) for i in range(2000)],
                               "brand string, v double")
    rows = df.collect()
    want = sorted(rows, key=lambda r: (r["v"] is None, -(r["v"] or 0), r["brand"]))
    got = {r["brand"]: r["rn"] for r in M.global_row_number(df, "v", ("brand",), buckets=16).collect()}
    assert got == {r["brand"]: i + 1 for i, r in enumerate(want)}


def test_match_keys_ignore_case_and_edges(spark):
    from shelfscope.functions.text import ieq, ine
    from shelfscope.operators.conform import canonical_keys

    df = spark.createDataFrame([(" Usa ",), ("usa",), ("uk",), (None,)], "origin string")
    assert df.filter(ieq("origin", "USA")).count() == 2 and df.filter(ine("origin", "USA")).count() == 1
    assert [r["origin_key"] for r in canonical_keys(df, ["origin"]).collect()] == ["USA", "USA", "UK", None]
