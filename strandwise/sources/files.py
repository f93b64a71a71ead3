"""CSV, JSON and XML files as DataFrames, nested frames, and row binding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.skew import cut_lineage, running_total


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, header: bool = True, multiline: bool = False
) -> DataFrame:
    """CSV with names by position from the schema; the header line, if any, is skipped.

    Files are split over tasks. ``multiline`` is needed where quoted text holds line
    breaks, and keeps each file in one task.
    """
    reader = spark.read.schema(schema).option("header", header).option("enforceSchema", True)
    return reader.option("multiLine", multiline).option("quote", '"').option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = False) -> DataFrame:
    """JSON, one object per line. With ``multiline`` a file is one document, in one task;
    a top-level array gives one row per element."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_records_xml(spark: SparkSession, path: str, tag: str, schema: StructType | str) -> DataFrame:
    """One row per element with this tag, its attributes as columns.

    Declare the columns as strings and cast them afterwards, so that dates keep
    their written zone.
    """
    parsed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    attrs = StructType()
    for f in parsed.fields:
        attrs = attrs.add(f"_{f.name}", f.dataType, True)
    rows = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(attrs).load(path)
    return rows.toDF(*parsed.names)


def flatten_frames(df: DataFrame, col: str, keep: list[str] | None = None) -> DataFrame:
    """Array of structs to one row per element."""
    return df.select(*(keep or []), F.inline(col))


def stack_frames(frames: list[DataFrame]) -> DataFrame:
    """Tables with differing columns stacked, missing cells null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def bind_by_key(frames: list[DataFrame], key: str) -> DataFrame:
    """Tables with the same row key side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key)
    return out


def numbered_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """Number the rows of a file source in reading order, from 0, once at ingest.

    Files count in path order and rows in file order: a split is known by its file and
    start, a row by its place in the split, and one offset per split is added. Row-aligned
    files without a key get one here; from then on they join by it. The result is
    written once, so numbers stay.
    """
    placed = cut_lineage(df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
    ))
    splits = placed.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    offsets = running_total(splits, ["_file", "_start"], "_n", "_before")
    return (
        placed.join(offsets, ["_file", "_start"])
        .withColumn(name, F.col("_before") + F.col("_place") - F.col("_first"))
        .drop("_file", "_start", "_place", "_n", "_first", "_before")
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition, replacing the folder."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
