"""Sinks round trip and the incremental (streaming) ingestion."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.plans import etl as ETL
from shelfscope.queries import _spec
from shelfscope.sources import proxy
from shelfscope.sources.sinks import BENCHMARK_LABELS, presentation, publish, write_products, write_sales
from shelfscope.sources.tables import read_wide
from tests.conftest import SMALL


def test_csv_round_trip(spark):
    out = tempfile.mkdtemp(prefix="shelfscope-io-")
    e = ETL.enriched(ETL.cleaned_attributes(ETL.keyed(proxy.raw_wide(spark, SMALL, "M")), _spec("M")),
                     proxy.color_map(spark), proxy.price_band_rows(), _spec("M"))
    prods = ETL.conform_products(ETL.products_of(e))
    write_products(prods, f"{out}/products", fmt="csv")
    back = spark.read.option("header", True).csv(f"{out}/products")
    assert back.count() == prods.count()
    sales = ETL.sales_of(e, _spec("M")).join(prods.select("global_code", "province_code"), "global_code")
    write_sales(sales, f"{out}/sales")
    parts = sorted(p for p in os.listdir(f"{out}/sales") if p.startswith("province_code="))
    assert parts and spark.read.parquet(f"{out}/sales").count() == sales.count()


def test_publish_presentation_names(spark):
    out = tempfile.mkdtemp(prefix="shelfscope-pub-")
    df = spark.createDataFrame([("x", "PROMO")], "province_name string, varietal string")
    publish(df, f"{out}/t", BENCHMARK_LABELS)
    assert spark.read.parquet(f"{out}/t").columns == ["Province", "Varietal"]
    assert presentation(df, {}).columns == df.columns


def test_streaming_ingest_matches_batch(spark):
    from shelfscope.streaming.incremental import ingest_wide

    root = tempfile.mkdtemp(prefix="shelfscope-stream-")
    raw = proxy.raw_wide(spark, SMALL, "M")
    raw.write.option("header", True).csv(f"{root}/landing")
    q = ingest_wide(spark, f"{root}/landing", f"{root}/out", _spec("M"), proxy.color_map(spark),
                    proxy.price_band_rows(), checkpoint=f"{root}/ckpt")
    q.awaitTermination()
    streamed = spark.read.parquet(f"{root}/out/sales")
    _, batch = ETL.clean(raw, proxy.color_map(spark), proxy.price_band_rows(), _spec("M"))
    key = ["global_code", "sale_period"]
    a = streamed.groupBy().agg(F.count(F.lit(1)), F.sum("sale_actual_cases")).first()
    b = batch.groupBy().agg(F.count(F.lit(1)), F.sum("sale_actual_cases")).first()
    assert tuple(a) == tuple(b)
    assert streamed.select(*key).distinct().count() == batch.select(*key).distinct().count()


def test_materialised_view_prunes_periods_and_matches(spark):
    from shelfscope.params import DEFAULT
    from shelfscope.plans import outlook
    from shelfscope.sources.warehouse import read_conformed_sales, write_conformed_sales

    path = tempfile.mkdtemp(prefix="shelfscope-wh-") + "/calc_sales"
    write_conformed_sales(proxy.calc_sales(spark, SMALL), path)
    stored = read_conformed_sales(spark, path, proxy.report_period_labels())
    periods, varietals = proxy.report_periods(spark), proxy.varietal_dim(spark, SMALL)
    from_table = outlook.market_outlook(stored, periods, varietals, DEFAULT)
    direct = outlook.market_outlook(proxy.calc_sales(spark, SMALL, window=True), periods, varietals, DEFAULT)
    assert sorted(map(tuple, from_table.collect())) == sorted(map(tuple, direct.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = outlook.market_outlook(read_conformed_sales(spark, path, proxy.report_period_labels()),
                                       periods, varietals, DEFAULT)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scan = [line for line in plan.splitlines() if "calc_sales]" in line][0]
    assert "PartitionFilters: [period_code" in scan and "INSET" in scan


def test_read_wide_batch_round_trip(spark):
    from pyspark.sql import types as T

    from shelfscope.sources.tables import RAW_ATTRIBUTES, read_wide

    root = tempfile.mkdtemp(prefix="shelfscope-wide-")
    raw = proxy.raw_wide(spark, SMALL, "M")
    raw.write.option("header", True).csv(f"{root}/wide")
    back = read_wide(spark, f"{root}/wide", list(_spec("M").period_labels),
                     attributes={"province_code": T.StringType(), **RAW_ATTRIBUTES})
    assert back.schema["code"].dataType == T.StringType()
    assert back.schema["retail_price_last_year"].dataType == T.StringType()
    assert back.count() == raw.count()
    label = _spec("M").period_labels[0]
    assert back.agg(F.sum(label)).first()[0] == raw.agg(F.sum(label)).first()[0]


def _wide_file(root, lines):
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/f{len(os.listdir(root))}.csv", "w") as f:
        f.write("\n".join(lines) + "\n")


ATTRS = {"code": T.StringType()}


def test_read_wide_goes_by_name(spark):
    root = tempfile.mkdtemp(prefix="shelfscope-wide-")
    _wide_file(root, ["code,2024M02,2024M01,extra", "a,2,1,x", "b,,3,y"])
    got = read_wide(spark, root, ["2024M01", "2024M02"], ATTRS).orderBy("code")
    assert [tuple(r) for r in got.collect()] == [("a", 1.0, 2.0), ("b", 3.0, None)]


def test_read_wide_refuses_bad_files(spark):
    root = tempfile.mkdtemp(prefix="shelfscope-wide-")
    _wide_file(f"{root}/missing", ["code,2024M01", "a,1"])
    with pytest.raises(ValueError, match="2024M02"):
        read_wide(spark, f"{root}/missing", ["2024M01", "2024M02"], ATTRS)
    _wide_file(f"{root}/value", ["code,2024M01", "a,x"])
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_wide(spark, f"{root}/value", ["2024M01"], ATTRS).collect()
    _wide_file(f"{root}/other", ["code,2024M01,2024M02", "a,1,2"])
    _wide_file(f"{root}/other", ["code,2024M02,2024M01", "b,2,1"])
    with pytest.raises(Exception, match="header|schema"):
        read_wide(spark, f"{root}/other", ["2024M01", "2024M02"], ATTRS).collect()


def test_read_dim_keeps_the_files_order(spark):
    from shelfscope.operators.clean import band_rows, lookup
    from shelfscope.sources.tables import COLOR_SCHEMA, PRICE_BAND_SCHEMA, read_dim

    root = tempfile.mkdtemp(prefix="shelfscope-dim-")
    _wide_file(f"{root}/c", ["color_five,color", *(f"{x},Red" for x in "abcdefghij"), '"Pi,nk",Rose'])
    colors = read_dim(spark, f"{root}/c", COLOR_SCHEMA)
    rows = spark.createDataFrame([("Red",), ("Rose",), ("Blue",)], "color string")
    got = {r["color"]: r["color_five"] for r in lookup(rows, colors, "color", "color_five", "ord").collect()}
    assert got == {"Red": "j", "Rose": "Pi,nk", "Blue": None}
    _wide_file(f"{root}/b", ["price_segment,price_range_start,price_range_end", "D,0,9.99", "E,10,19.99"])
    assert band_rows(read_dim(spark, f"{root}/b", PRICE_BAND_SCHEMA)) == [("D", 0.0, 9.99), ("E", 10.0, 19.99)]
    _wide_file(f"{root}/o", ["price_segment,price_range_start,price_range_end", "D,0,10", "E,10,20"])
    with pytest.raises(ValueError, match="overlap"):
        band_rows(read_dim(spark, f"{root}/o", PRICE_BAND_SCHEMA))


def test_write_sales_spreads_a_province(spark):
    out = tempfile.mkdtemp(prefix="shelfscope-sales-")
    df = spark.range(5000).selectExpr("cast(id as string) global_code", "'ON' province_code", "1.0 sale_actual_cases")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")  # 5,000 rows would fit one task
    try:
        write_sales(df, f"{out}/s")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in os.listdir(f"{out}/s/province_code=ON") if f.endswith(".parquet")]
    assert len(files) > 1 and spark.read.parquet(f"{out}/s").count() == 5000
    with pytest.raises(ValueError, match="province_code"):
        write_sales(df.drop("province_code"), f"{out}/t")


def test_appended_files_are_read(spark):
    from shelfscope.sources.tables import read_table

    out = tempfile.mkdtemp(prefix="shelfscope-append-")
    spark.range(5).write.parquet(f"{out}/t.parquet")
    assert read_table(spark, out, "t").count() == 5
    spark.range(7).write.mode("append").parquet(f"{out}/t.parquet")
    assert read_table(spark, out, "t").count() == 12


def test_published_benchmark_has_every_label(spark):
    from shelfscope.params import DEFAULT
    from shelfscope.sources.sinks import TOP_SKU_LABELS, labels_for

    out = tempfile.mkdtemp(prefix="shelfscope-labels-")
    df = spark.createDataFrame([tuple("x" for _ in BENCHMARK_LABELS)], list(BENCHMARK_LABELS))
    publish(df, f"{out}/b", labels_for(DEFAULT))
    got = spark.read.parquet(f"{out}/b").columns
    assert len(got) == 26 and "AMERICA Origin Top Brand - Market Share %" in got and "Brand#7 - Presence" in got
    assert set(TOP_SKU_LABELS) == {"volume_growth_frac", "market_share_pct"}


def _labelled(spark, province, rows):
    """A monthly file's rows: (code, first period's value), with a header in the schema's order."""
    from shelfscope.sources.tables import RAW_ATTRIBUTES
    labels = proxy.wide_labels("M")
    text = {"description": "Some Wine", "brand": "B", "category_prov": "c", "color": "red", "country_of_origin": "usa", "varietal": "v",
            "size_ml_per_unit": "750", "units_per_case": "12", "retail_price_this_year": "10"}
    header = ["province_code", *RAW_ATTRIBUTES, *labels]
    return header, [{"province_code": province, "code": c, labels[0]: v, **text} for c, v in rows]


def _deliver(folder, header, rows):
    _wide_file(folder, [",".join(header), *[",".join(r.get(c, "") for c in header) for r in rows]])


def _ingest(spark, root):
    from shelfscope.streaming.incremental import ingest_wide
    ingest_wide(spark, f"{root}/landing", f"{root}/out", _spec("M"), proxy.color_map(spark), proxy.price_band_rows(),
                checkpoint=f"{root}/ckpt", max_files_per_trigger=1).awaitTermination()
    first = proxy.wide_labels("M")[0]
    sales = spark.read.parquet(f"{root}/out/sales").where(F.col("sale_period") == first)
    return sorted((r["global_code"], r["sale_actual_cases"]) for r in sales.collect())


def test_a_corrected_delivery_counts_once(spark):
    root = tempfile.mkdtemp(prefix="shelfscope-again-")
    header, rows = _labelled(spark, "ON", [("1", "5"), ("2", "6")])
    _deliver(f"{root}/landing", header, rows)
    assert _ingest(spark, root) == [("ON1", 5.0), ("ON2", 6.0)]
    _deliver(f"{root}/landing", header, rows)                               # the same again
    _deliver(f"{root}/landing", *_labelled(spark, "ON", [("2", "8")]))      # corrected
    _deliver(f"{root}/landing", *_labelled(spark, "QC", [("2", "1")]))
    assert _ingest(spark, root) == [("ON1", 5.0), ("ON2", 8.0), ("QC2", 1.0)]
    assert spark.read.parquet(f"{root}/out/products").count() == 3
    assert spark.read.parquet(f"{root}/out/sales").count() == 3 * len(proxy.wide_labels("M"))


def test_stream_goes_by_the_header_and_refuses_bad_values(spark):
    root = tempfile.mkdtemp(prefix="shelfscope-swap-")
    header, rows = _labelled(spark, "ON", [("1", "5")])
    _deliver(f"{root}/landing", [*header[:-24], *reversed(header[-24:])], rows)
    assert _ingest(spark, root) == [("ON1", 5.0)]
    root = tempfile.mkdtemp(prefix="shelfscope-bad-")
    _deliver(f"{root}/landing", *_labelled(spark, "ON", [("1", "bad")]))
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        _ingest(spark, root)


def test_rejected_rows_are_set_aside_with_reasons(spark):
    from shelfscope.sources.tables import RAW_ATTRIBUTES, read_wide_checked
    root = tempfile.mkdtemp(prefix="shelfscope-reject-")
    header, rows = _labelled(spark, "ON", [("1", "5"), ("2", "bad"), ("", "7"), (" ", "x"), ("5", ""), ("6", " 3 "), ("7", "1e2")])
    header, rows = header[1:], [{k: v for k, v in r.items() if k != "province_code"} for r in rows]
    lines = [",".join(header), *[",".join(r.get(c, "") for c in header) for r in rows], "8,too,few"]
    _wide_file(f"{root}/w", lines)
    labels = proxy.wide_labels("M")
    accepted, rejected = read_wide_checked(spark, f"{root}/w", labels)
    assert accepted.schema.names == [*RAW_ATTRIBUTES, *labels]
    assert {r["code"]: r[labels[0]] for r in accepted.collect()} == {"1": 5.0, "5": None, "6": 3.0, "7": 100.0}
    got = sorted(tuple(r["reasons"]) for r in rejected.collect())
    assert got == [(f"{labels[0]}: not double",), ("code: empty",), ("code: empty", f"{labels[0]}: not double"), ("row: number of values",)]
    assert accepted.count() + rejected.count() == 8 and rejected.where("file LIKE '%/w/%'").count() == 4


def test_counted_steps_show_a_broken_step(spark):
    from shelfscope.operators.clean import filter_positive
    from shelfscope.operators.reshape import counted
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "total_sale double")
    rows = {r["step"]: r["rows"] for r in counted({"raw": df, "kept": filter_positive(df, []), "broken": filter_positive(df, []).union(df)}).collect()}
    assert rows == {"raw": 3, "kept": 1, "broken": 4}
