"""Files and databases in and out, with schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many tasks as there are cores, if they come in fewer splits than that (a small file is one split).
    Tables with more splits than cores stay as they are, unshuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_sheet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV sheet: UTF-8 with or without a byte-order mark, quoted cells over several lines, unnamed columns dropped, blanks as empty text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    rows = (reader.schema(schema) if schema is not None else reader).csv(path)
    named = [c for c in rows.columns if c.strip() and not c.startswith("_c")]
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if rows.schema[c].dataType == T.StringType() else F.col(f"`{c}`") for c in named))


def write_sheet(rows: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """columns in their order, quoted where need be; white space at the ends of cells stays."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(*columns).write.mode(mode).options(header=True, quote='"', escape='"', **kept).csv(path)


def read_samples(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """A JSON array of samples, or an object that holds them under `samples`; with `lines`, one such document a line."""
    wrapped = spark.read.schema(T.StructType([*schema.fields, T.StructField("samples", T.ArrayType(schema))])).json(path, multiLine=not lines)
    bare = wrapped.where("samples is null").drop("samples")
    return bare.unionByName(wrapped.where("samples is not null").select(F.explode("samples").alias("s")).select("s.*"))


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, or no rows of the schema if nothing is there or it can't be read as such."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines: what doesn't parse is set aside, so that it can be counted."""
    tolerant = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", tolerant, options).alias("r")).select("r.*")
    return parsed.where("_corrupt_record is null").drop("_corrupt_record"), parsed.where("_corrupt_record is not null").select("_corrupt_record")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A relational table; with a key and its bounds, read in parts by range. Filters on the result reach the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def write_database(rows: DataFrame, url: str, table: str, key: str, parts: int = 8, batch: int = 5000, mode: str = "append", types: str | None = None, **options: str) -> None:
    """rows into a relational table, over `parts` connections at once: rows are dealt by the key's hash, and each part is one
    transaction of batched inserts. types: column types to create the table with where Spark's own don't suit."""
    writer = rows.repartition(parts, key).write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), numPartitions=str(parts), **options)
    (writer.option("createTableColumnTypes", types) if types else writer).mode(mode).save()


def manifest(rows: DataFrame, provenance: list[str]) -> DataFrame:
    """One row: number of rows, and sorted distinct values of each provenance column (few, by their nature)."""
    return rows.agg(F.count("*").alias("rows"), *(F.array_sort(F.collect_set(F.nullif(F.col(c).cast("string"), F.lit("")))).alias(c) for c in provenance))


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "append") -> None:
    """Each table as Parquet under its name."""
    for name, rows in tables.items():
        rows.write.mode(mode).parquet(f"{folder}/{name}")
