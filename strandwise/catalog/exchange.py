"""Tables written as files of each kind, read by the sources and compared with the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.skew import checkpoint_dir
from ..sources import files
from .tables import rounded, table

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def csv_round_trip(spark, d):
    """Customers as CSV with a header, and read again."""
    path = _folder(spark)
    files.write_csv(table(spark, d, "customer"), path)
    return rounded(files.read_csv(spark, path, CUSTOMER), "c_acctbal")


def csv_by_position(spark, d):
    """CSV without a header, names by position; texts hold quotes, commas and line breaks."""
    path = _folder(spark)
    told = F.concat(F.lit('He said "'), F.col("c_name"), F.lit('",\nthen left'))
    rows = table(spark, d, "customer").select("c_custkey", told.alias("told"))
    rows.write.option("header", False).option("escape", '"').csv(path)
    return files.read_csv(spark, path, "key long, told string", header=False, multiline=True)


def json_round_trip(spark, d):
    """Orders as JSON lines with a nested part, and read again."""
    path = _folder(spark)
    o = table(spark, d, "orders")
    o.select("o_orderkey", F.struct("o_orderstatus", "o_totalprice").alias("head")).write.json(path)
    back = files.read_json(spark, path, "o_orderkey long, head struct<o_orderstatus: string, o_totalprice: double>")
    return rounded(back.select("o_orderkey", "head.o_orderstatus", "head.o_totalprice"), "o_totalprice")


def xml_records(spark, d):
    """Events as XML records whose attributes are texts, read by their tag and cast afterwards."""
    path = _folder(spark)
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    texts = e.select(*[F.col(c).cast("string").alias(f"_{c}") for c in e.columns])
    texts.write.format("xml").option("rootTag", "Data").option("rowTag", "Record").option("attributePrefix", "_").save(path)
    back = files.read_records_xml(spark, path, "Record", "event_id string, user_id string, event_type string, us string")
    return back.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("us").cast("long").alias("us"))


def bound_rows(spark, d):
    """Two files whose rows belong together by place: rows are numbered once, then joined by number."""
    names, money = _folder(spark), _folder(spark)
    c = table(spark, d, "customer").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey")
    c.select("c_custkey", "c_name").write.parquet(names)
    c.select(F.col("c_acctbal").alias("money")).write.parquet(money)
    sides = [files.numbered_rows(spark.read.parquet(p)) for p in (names, money)]
    return rounded(files.bind_by_key(sides, "row"), "money").withColumn("row", F.col("row").cast("long"))


QUERIES = {f.__name__: f for f in (csv_round_trip, csv_by_position, json_round_trip, xml_records, bound_rows)}

SQL = {
    "csv_round_trip": "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer",
    "csv_by_position": """SELECT c_custkey AS key, 'He said "' || c_name || '",' || chr(10) || 'then left' AS told FROM customer""",
    "json_round_trip": "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders",
    "xml_records": "SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events",
    "bound_rows": """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, c_custkey, c_name, round(c_acctbal, 6) AS money FROM customer""",
}
