"""Readers and writers for the seven tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType, TimestampType

from storelens.functions.exprs import pct
from storelens.sources.schemas import SCHEMAS, TABLES

Tables = Mapping[str, DataFrame]


def read_csv_tables(
    spark: SparkSession,
    folder: str,
    files: Mapping[str, str] | None = None,
    multi_line: Sequence[str] = ("reviews",),
) -> Tables:
    """Read one CSV file (or folder of files) per table under its declared schema.

    A multi-line file cannot be split, so only tables holding free text are read that
    way; all others are split across tasks. A field that does not fit its type is null.
    """
    names = {table: f"{table}.csv" for table in TABLES} | dict(files or {})
    return {
        table: _csv(spark, SCHEMAS[table], table in multi_line).csv(f"{folder}/{names[table]}") for table in TABLES
    }


def _csv(spark: SparkSession, schema: StructType, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    )


def read_csv_rejects(
    spark: SparkSession,
    folder: str,
    files: Mapping[str, str] | None = None,
    multi_line: Sequence[str] = ("reviews",),
) -> Tables:
    """The records of each CSV table that ``read_csv_tables`` can't read in full, as they are, in ``record``.

    A record is listed if a field doesn't fit its type, or if it has too many or too few fields; beside
    it stand the values that could be read. All fields are parsed, whatever the query selects.
    """
    names = {table: f"{table}.csv" for table in TABLES} | dict(files or {})
    found = {}
    for table in TABLES:
        kept = StructType([*SCHEMAS[table].fields, StructField("record", StringType())])
        reader = _csv(spark, kept, table in multi_line).option("columnNameOfCorruptRecord", "record")
        # Only fields that a query reads are converted, so the filter reads them all.
        looked = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in SCHEMAS[table].names])) >= 0
        found[table] = reader.csv(f"{folder}/{names[table]}").filter(F.col("record").isNotNull() & looked)
    return found


def read_parquet_tables(spark: SparkSession, folder: str) -> Tables:
    return {table: spark.read.parquet(f"{folder}/{table}") for table in TABLES}


def read_catalog_tables(
    spark: SparkSession, namespace: str, names: Mapping[str, str] | None = None
) -> Tables:
    """The seven catalog tables, lazily; ``names`` maps a table to another catalog name."""
    names = names or {}
    return {t: lower_names(spark.table(f"{namespace}.{names.get(t, t)}")) for t in TABLES}


def read_sql(spark: SparkSession, query: str) -> DataFrame:
    return lower_names(spark.sql(query))


def read_warehouse(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query run by an external warehouse; pass the ``partitionColumn`` options for big results."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if "partitionColumn" in options:
        return lower_names(reader.option("dbtable", f"({query}) q").load())
    return lower_names(reader.option("query", query).load())


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _casts(df: DataFrame, schema: StructType) -> dict[str, Column]:
    """The columns named in ``schema`` as their declared types; null where a value does not fit."""
    casts = {}
    for field in schema.fields:
        if field.name not in df.columns:
            continue
        if isinstance(field.dataType, (TimestampNTZType, TimestampType)):
            casts[field.name] = F.try_to_timestamp(F.col(field.name).cast("string")).cast(field.dataType)
        else:
            casts[field.name] = F.col(field.name).try_cast(field.dataType)
    return casts


def coerce(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast the columns named in ``schema``; a value that does not fit becomes null."""
    return df.withColumns(_casts(df, schema))


def _rejected(df: DataFrame, schema: StructType) -> dict[str, Column]:
    """By column: whether a value is there but does not fit. Blank text is no value."""
    filled = {c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in _casts(df, schema)}
    return {c: filled[c] & cast.isNull() for c, cast in _casts(df, schema).items()}


def coercion_report(df: DataFrame, schema: StructType, table: str) -> DataFrame:
    """A row per declared column: values that ``coerce`` keeps and turns into null, and the least of the latter.

    One pass over ``df``, whatever the number of columns.
    """
    bad = _rejected(df, schema)
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    sides = [
        F.struct(
            F.lit(c).alias("col"),
            F.lit(types[c]).alias("declared"),
            F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias("n_values"),
            F.count_if(b).alias("rejected"),
            F.min(F.when(b, F.col(c).cast("string"))).alias("example"),
        )
        for c, b in bad.items()
    ]
    row = df.agg(F.array(*sides).alias("_columns"))
    return row.select(F.lit(table).alias("tbl"), F.inline("_columns")).withColumn("rejected_pct", pct(F.col("rejected"), F.col("n_values")))


def rejected_rows(df: DataFrame, schema: StructType) -> DataFrame:
    """Rows that lose a value when coerced, as they came, with ``rejects``: the columns and values lost."""
    each = [F.when(b, F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))) for c, b in _rejected(df, schema).items()]
    return df.withColumn("rejects", F.array_compact(F.array(*each))).filter(F.size("rejects") > 0)


def append_rows(df: DataFrame, rows: Iterable[tuple]) -> DataFrame:
    """``df`` with a few literal rows added, as a dimension fix-up does."""
    return df.unionByName(df.sparkSession.createDataFrame(list(rows), df.schema))


def overwrite_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full reload: replace whatever ``path`` holds."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_tables(tables: Tables, folder: str) -> None:
    for name, df in tables.items():
        overwrite_table(df, f"{folder}/{name}")


def save_bucketed_tables(tables: Tables, namespace: str, buckets: int) -> None:
    """Save to the catalog with the order-keyed tables bucketed and sorted on ``order_id``.

    Reducing items, payments and reviews per order and joining them to their orders then
    needs no shuffle. Choose ``buckets`` so that one bucket of items fits a task.
    """
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet")
        if "order_id" in df.columns:
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        writer.saveAsTable(f"{namespace}.{name}")
