"""The base entity: classified-ad style items, as a view over the star-schema test tables.

The library works on any frame with these columns; this module builds one from the given tables
so that every query runs on data that grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_COLUMNS = [
    "item_id", "user_id", "region", "city", "parent_category_name", "category_name",
    "param_1", "param_2", "param_3", "title", "description", "price", "item_seq_number",
    "activation_date", "user_type", "image", "image_top_1", "deal_probability",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, dressed as an item with NULLs in every nullable column.

    Dimension joins carry no hints: their sizes are known from file statistics, and Spark
    broadcasts those under its threshold and shuffles the others.
    """
    def text(col):
        return F.col(col).cast("string")

    # Few rows are joined to few: buyers to orders, before the lines come in.
    buyers = (
        read_table(spark, sf_dir, "customer")
        .join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    bought = read_table(spark, sf_dir, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        read_table(spark, sf_dir, "lineitem")
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    return joined.select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"),
                    text("l_suppkey"), cents).alias("item_id"),
        text("o_custkey").alias("user_id"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("city"),
        F.col("p_type").alias("parent_category_name"),
        F.col("p_brand").alias("category_name"),
        F.nullif("l_returnflag", F.lit("R")).alias("param_1"),
        F.nullif("p_name", F.lit("blue anvil")).alias("param_2"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("param_3"),
        F.col("p_name").alias("title"),
        F.nullif("o_orderstatus", F.lit("P")).alias("description"),
        F.nullif("l_quantity", F.lit(13.0)).alias("price"),
        F.col("l_linenumber").cast("bigint").alias("item_seq_number"),
        F.col("l_shipdate").cast("date").alias("activation_date"),
        F.col("c_mktsegment").alias("user_type"),
        F.when(F.col("l_suppkey") % 12 != 0, text("l_suppkey")).alias("image"),
        F.nullif(F.col("p_size").cast("double"), F.lit(7.0)).alias("image_top_1"),
        F.when(F.col("o_orderstatus") != "P", F.col("l_discount") * 10).alias("deal_probability"),
    )


# The same view for the SQL check, as a common table expression body.
ITEMS_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                 CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS item_id,
       CAST(o_custkey AS VARCHAR) AS user_id, r_name AS region, n_name AS city,
       p_type AS parent_category_name, p_brand AS category_name,
       nullif(l_returnflag, 'R') AS param_1, nullif(p_name, 'blue anvil') AS param_2,
       nullif(o_orderpriority, '5-LOW') AS param_3, p_name AS title, nullif(o_orderstatus, 'P') AS description,
       nullif(l_quantity, CAST(13 AS DOUBLE)) AS price, CAST(l_linenumber AS BIGINT) AS item_seq_number,
       CAST(l_shipdate AS DATE) AS activation_date, c_mktsegment AS user_type,
       CASE WHEN l_suppkey % 12 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS image,
       nullif(CAST(p_size AS DOUBLE), CAST(7 AS DOUBLE)) AS image_top_1,
       CASE WHEN o_orderstatus <> 'P' THEN l_discount * 10 END AS deal_probability
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey
"""
