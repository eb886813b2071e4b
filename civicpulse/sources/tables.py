"""Fixed mapping of the driver's tables to the request schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 nations with their region: a fixed-size dimension."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def requests_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order: priority is the type, segment the descriptor, nation the district."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        _places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return df.select(
        F.col("o_orderkey").cast("string").alias("service_request_id"), F.col("o_orderdate").cast("date").alias("created_date"),
        F.col("o_orderpriority").alias("complaint_type"), F.col("c_mktsegment").alias("descriptor"), F.col("r_name").alias("borough"),
        F.col("n_name").alias("community_district"), F.when(F.col("o_orderstatus") == "F", "F").alias("resolution_description"),
        F.lit(None).cast("date").alias("closed_date"), (40.5 + F.col("o_custkey") % 400 / 1000.0).alias("latitude"),
        (-74.2 + F.col("o_custkey") % 500 / 1000.0).alias("longitude"),
    )


def requests_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per line item: part type and name, the supplier's place."""
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    df = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    df = df.join(_places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    return df.select(
        F.lit(None).cast("string").alias("service_request_id"), F.col("l_shipdate").cast("date").alias("created_date"),
        F.col("p_type").alias("complaint_type"), F.col("p_name").alias("descriptor"), F.col("r_name").alias("borough"),
        F.col("n_name").alias("community_district"), F.when(F.col("l_linestatus") == "F", "F").alias("resolution_description"),
        F.lit(None).cast("date").alias("closed_date"), (40.5 + F.col("l_suppkey") % 400 / 1000.0).alias("latitude"),
        (-74.2 + F.col("l_suppkey") % 500 / 1000.0).alias("longitude"),
    )
