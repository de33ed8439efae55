"""Readers for parquet tables, wide period files and small dimension files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, base_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting ``cols`` here lets Catalyst prune the ReadSchema. Files are
    listed anew at each call, so appended files are seen; only the schema (read from
    one footer) is remembered for the session."""
    path = f"{base_dir.rstrip('/')}/{name}.parquet"
    schemas = spark.__dict__.setdefault("_shelfscope_schemas", {})
    if path not in schemas:
        schemas[path] = spark.read.parquet(path).schema
    df = spark.read.schema(schemas[path]).parquet(path)
    return df.select(*cols) if cols else df


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small fixed table (dimension parameters) as a SQL ``VALUES`` local relation:
    size statistics are exact at planning time, so joins to it are planned as
    broadcasts without a shuffle or an extra job."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)

    names = [f.strip().split()[0] for f in schema.split(",")]
    types = [" ".join(f.strip().split()[1:]) for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(names)})")


def wide_schema(attributes: dict[str, T.DataType], period_labels: list[str]) -> T.StructType:
    """Explicit schema for a wide provincial sales file: attributes + one double per
    period label. No inference pass over the data; every period column has one type so
    the unpivot has a common value type."""
    fields = [T.StructField(n, t, True) for n, t in attributes.items()]
    fields += [T.StructField(p, T.DoubleType(), True) for p in period_labels]
    return T.StructType(fields)


# Fixed attribute layout of the raw provincial files. ``code`` is read as text so
# surrogate keys never carry a float suffix; retail price columns are text because
# they may hold invalid entries that are coerced later.
RAW_ATTRIBUTES: dict[str, T.DataType] = {
    "code": T.StringType(),
    "description": T.StringType(),
    "brand": T.StringType(),
    "category": T.StringType(),
    "category_prov": T.StringType(),
    "color": T.StringType(),
    "country_of_origin": T.StringType(),
    "listing_type": T.StringType(),
    "status": T.StringType(),
    "varietal": T.StringType(),
    "size_ml_per_unit": T.IntegerType(),
    "units_per_case": T.IntegerType(),
    "wholesale_price_last_year": T.DoubleType(),
    "wholesale_price_this_year": T.DoubleType(),
    "retail_price_last_year": T.StringType(),
    "retail_price_this_year": T.StringType(),
    "retail_price_current": T.StringType(),
    "price_segment": T.StringType(),
    "promos_list_this_year": T.StringType(),
}


def require_columns(found: list[str], required: list[str], what: str) -> None:
    """Fail before any data is read where a required column is missing."""
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")


#: Columns as the header says, in every file; bad values fail the read. Column pruning would
#: hide bad values and other headers in columns that a query doesn't use.
CHECKED_CSV = {"header": "true", "enforceSchema": "false", "mode": "FAILFAST", "columnPruning": "false"}


def file_schema(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """``schema`` in the order of the header at ``path``, with the header's other columns as text."""
    header = spark.read.option("header", True).csv(path).columns
    require_columns(header, schema.names, path)
    return T.StructType([schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in header])


def read_wide(spark: SparkSession, path: str, period_labels: list[str],
              attributes: dict[str, T.DataType] | None = None, fmt: str = "csv") -> DataFrame:
    """Read one provincial wide sales file (13-period or monthly layout), columns by name.

    The header decides the order: columns may come in any, but all must be there, and
    every file of the folder must have the same header. A value that doesn't fit its
    column's type fails the read (FAILFAST); nothing becomes NULL or moves silently.
    ``read_wide_checked`` sets such rows aside instead.
    """
    schema = wide_schema(attributes or RAW_ATTRIBUTES, period_labels)
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        require_columns(df.columns, schema.names, path)
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    return spark.read.schema(file_schema(spark, path, schema)).options(**CHECKED_CSV).csv(path).select(*schema.names)


def checked(rows: DataFrame, schema: T.StructType, required: tuple[str, ...] = ("code",), row_error: str | None = None):
    """(accepted, rejected) of rows that are all text: C6 as data instead of a failure.

    Accepted rows have the types of ``schema``. A row is rejected if a value doesn't fit its
    column's type, a required column is empty, or ``row_error`` (a condition) holds; it is
    kept as it came, with its ``reasons`` in column order. Every row is in one of the two.
    """
    def bad(f: T.StructField):
        c = F.col(f"`{f.name}`")
        empty = c.isNull() | (F.trim(c) == "")
        wrong = ~empty & c.try_cast(f.dataType).isNull() if not isinstance(f.dataType, T.StringType) else F.lit(False)
        return [F.when(wrong, F.lit(f"{f.name}: not {f.dataType.simpleString()}")),
                *([F.when(empty, F.lit(f"{f.name}: empty"))] if f.name in required else [])]

    found = [r for f in schema for r in bad(f)]
    if row_error:
        found.insert(0, F.when(F.expr(row_error), F.lit("row: number of values")))
    # one generated value a row, so that the conditions on some forty columns aren't pushed below and
    # propagated: Catalyst would try each of them under every alias of every column
    one = F.explode(F.array(F.struct(F.array_compact(F.array(*found)).alias("reasons"))))
    marked = rows.select("*", one.alias("__r")).withColumn("reasons", F.col("__r.reasons")).drop("__r")
    accepted = marked.where(F.size("reasons") == 0).select(
        *[F.when(F.trim(f"`{f.name}`") != "", F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name)
          if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in schema])
    return accepted, marked.where(F.size("reasons") > 0)


def read_wide_checked(spark: SparkSession, path: str, period_labels: list[str], attributes: dict[str, T.DataType] | None = None):
    """``read_wide`` for CSV files that may hold bad rows: (accepted, rejected). Rejected rows
    keep every value as text, with ``reasons`` and ``file``; one with too few or too many
    values is rejected too. accepted + rejected = delivered."""
    schema = wide_schema(attributes or RAW_ATTRIBUTES, period_labels)
    header = file_schema(spark, path, schema).names
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "__corrupt"]])
    rows = (spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt")
            .option("columnPruning", False).option("enforceSchema", True).csv(path).withColumn("file", F.col("_metadata.file_path")))
    accepted, rejected = checked(rows, schema, row_error="__corrupt IS NOT NULL")
    return accepted, rejected.drop("__corrupt")


COLOR_SCHEMA = T.StructType([T.StructField("color", T.StringType()), T.StructField("color_five", T.StringType())])
PRICE_BAND_SCHEMA = T.StructType([
    T.StructField("price_segment", T.StringType()),
    T.StructField("price_range_start", T.DoubleType()),
    T.StructField("price_range_end", T.DoubleType()),
])


def read_dim(spark: SparkSession, path: str, schema: T.StructType, order_col: str = "ord") -> DataFrame:
    """Small dimension CSV (colour map, price bands) with the row's place in the file as
    ``order_col``. The file is read as one text, so its order doesn't depend on splits;
    a quoted value can't hold a line break."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias(order_col, "line"))
    header = lines.where(F.col(order_col) == 0).select("line").limit(1).collect()
    names = [c.strip().strip('"') for c in header[0]["line"].split(",")] if header else []
    require_columns(names, schema.names, path)
    in_file = T.StructType([schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in names])
    row = F.from_csv("line", in_file.simpleString()[7:-1].replace(":", " "), {"mode": "FAILFAST"})
    return (lines.where((F.col(order_col) > 0) & (F.trim("line") != "")).select(F.col(order_col), row.alias("r"))
            .select(order_col, *[f"r.{c}" for c in schema.names]))
