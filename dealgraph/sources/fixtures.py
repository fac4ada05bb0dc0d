"""Adapters: business records as views of the driver tables, and the same as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stage of a deal by its order's status, and its priority by the first letter of the order's.
STAGES = {"O": "quote", "P": "rfq", "F": "po_in_progress"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deal registrations: the vendor is the order's smallest supplier, the name that of its smallest part."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_suppkey").alias("vendor_id"), F.min("l_partkey").alias("part_id"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_name", "p_type")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"))
    stage = F.when(F.col("o_orderstatus") == "O", "quote").when(F.col("o_orderstatus") == "P", "rfq").otherwise("po_in_progress")
    rank = F.substring("o_orderpriority", 1, 1)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), stage.alias("stage"),
        F.when(rank.isin("1", "2"), "high").when(rank == "3", "medium").otherwise("low").alias("priority"),
        F.col("o_totalprice").alias("deal_value"), F.col("o_orderdate").alias("created_at"))
    return (orders.join(lines, "id", "left").join(customers, "customer_id", "left").join(parts, "part_id", "left")
            .select("id", "customer_id", "customer_name", "vendor_id", F.col("p_name").alias("deal_name"), F.col("p_type").alias("product_type"),
                    "status", "stage", "priority", "deal_value", "created_at"))


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"),
                                                   F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"))


def deal_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The many-to-many link of deals and vendors."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_id"), F.col("l_suppkey").alias("vendor_id")).distinct()


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(deal_id, file_id): the files that a deal was seen in, by the month of its lines."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_id"), F.date_format("l_shipdate", "yyyy-MM").alias("file_id")).distinct()


#: The same as common table expressions, to put before an oracle's query.
SQL = """
WITH deals AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id, c_name AS customer_name, vendor_id, p_name AS deal_name, p_type AS product_type,
    o_orderstatus AS status, CASE o_orderstatus WHEN 'O' THEN 'quote' WHEN 'P' THEN 'rfq' ELSE 'po_in_progress' END AS stage,
    CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'low' END AS priority,
    o_totalprice AS deal_value, o_orderdate AS created_at
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS vendor_id, min(l_partkey) AS part_id FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = part_id),
vendors AS (SELECT s_suppkey AS vendor_id, s_name AS vendor_name, s_nationkey AS nation_id, s_acctbal AS balance FROM supplier),
deal_vendors AS (SELECT DISTINCT l_orderkey AS deal_id, l_suppkey AS vendor_id FROM lineitem),
source_files AS (SELECT DISTINCT l_orderkey AS deal_id, strftime(l_shipdate, '%Y-%m') AS file_id FROM lineitem)
"""
