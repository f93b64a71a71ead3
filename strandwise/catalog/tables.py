"""Access to the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table. Its timestamps carry no zone, so the session reads them as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


TEXT_TABLES = ("documents", "conversations", "pages")


def spread(df: DataFrame) -> DataFrame:
    """Deal out text that sits in fewer file splits than there are cores; larger
    inputs, which have splits enough, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def r6(col: Column | str) -> Column:
    """Doubles are compared to six decimals."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c).cast("double")) for c in cols})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed state records: each lasts ``value`` minutes from its timestamp."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    length = F.round(F.col("value") * 60_000_000).cast("long")
    return e.select(
        "user_id", "event_id", F.col("event_type").alias("state"), start.alias("start_us"), (start + length).alias("end_us")
    )
