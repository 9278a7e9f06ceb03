"""The ``bookings`` table derived from the TPC-H-like driver tables.

The reference reads a hotel-booking CSV.  Our inputs are orders / customer /
nation / lineitem, so the booking view maps them onto the booking schema
(one row per order).  The same view exists as DuckDB SQL (``BOOKINGS_CTE``)
for the oracle; both are kept column-for-column and type-for-type equal.

Plan shape: lineitem is aggregated per order first (partial aggregation on
the map side, one shuffle on ``l_orderkey``), then joined to orders on the same
key.  customer and nation are dimension tables; the optimizer broadcasts them
when their size is under the broadcast threshold and sort-merges otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def lineitem_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_quantity")
    one_if = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0))
    return li.groupBy("l_orderkey").agg(
        F.sum(one_if(F.col("l_linestatus") == "F")).cast("bigint").alias("we"),
        F.sum(one_if(F.col("l_linestatus") == "O")).cast("bigint").alias("wk"),
        # the suppliers of one order are few: a set per order keeps the plan at one
        # exchange, where a distinct count would shuffle (order, supplier) first
        F.size(F.collect_set("l_suppkey")).cast("bigint").alias("n_supp"),
        F.sum(one_if(F.col("l_returnflag") == "R")).cast("bigint").alias("pc"),
        F.sum(one_if(F.col("l_returnflag") == "N")).cast("bigint").alias("pnc"),
        F.min("l_returnflag").alias("rr"),
        F.max("l_returnflag").alias("ar"),
        F.max("l_quantity").alias("lead"),
    )


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One booking per order, with the booking column names."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = lineitem_per_order(spark, sf_dir)
    j = (orders.join(customer, orders.o_custkey == customer.c_custkey)
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left"))
    od = F.col("o_orderdate")
    status = (F.when(F.col("o_orderstatus") == "F", "Check-Out")
              .when(F.col("o_orderstatus") == "O", "Cancel")
              .otherwise("No-Show"))
    return j.select(
        F.col("o_orderkey").alias("row_id"),
        status.alias("reservation_status"),
        F.year(od).cast("int").alias("arrival_date_year"),
        F.date_format(od, "MMMM").alias("arrival_date_month"),
        F.dayofmonth(od).cast("int").alias("arrival_date_day_of_month"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("market_segment"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Non Refund")
         .otherwise("No Deposit").alias("deposit_type"),
        (F.col("o_totalprice") / 1000.0).alias("adr"),
        F.col("lead").alias("lead_time"),
        F.col("we").alias("stays_in_weekend_nights"),
        F.col("wk").alias("stays_in_week_nights"),
        F.col("n_supp").alias("adults"),
        F.nullif(F.col("o_orderkey") % 4, F.lit(3)).cast("bigint").alias("children"),
        F.col("pc").alias("previous_cancellations"),
        F.col("pnc").alias("previous_bookings_not_canceled"),
        F.col("rr").alias("reserved_room_type"),
        F.col("ar").alias("assigned_room_type"),
        F.nullif(F.col("o_custkey") % 7, F.lit(0)).cast("bigint").alias("agent"),
    )


# DuckDB text of the same view, for ``oracle_sql``.  Integer widths are cast
# to match Spark (DuckDB sums integers into HUGEINT, year() into BIGINT).
BOOKINGS_CTE = """
li AS (
  SELECT l_orderkey,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS we,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS wk,
    CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_supp,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS pc,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS pnc,
    min(l_returnflag) AS rr, max(l_returnflag) AS ar, max(l_quantity) AS lead
  FROM lineitem GROUP BY l_orderkey),
bookings AS (
  SELECT o_orderkey AS row_id,
    CASE o_orderstatus WHEN 'F' THEN 'Check-Out' WHEN 'O' THEN 'Cancel' ELSE 'No-Show' END
      AS reservation_status,
    CAST(year(o_orderdate) AS INTEGER) AS arrival_date_year,
    monthname(o_orderdate) AS arrival_date_month,
    CAST(day(o_orderdate) AS INTEGER) AS arrival_date_day_of_month,
    n_name AS country, c_mktsegment AS market_segment,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Non Refund' ELSE 'No Deposit' END AS deposit_type,
    o_totalprice / 1000.0 AS adr, lead AS lead_time,
    we AS stays_in_weekend_nights, wk AS stays_in_week_nights, n_supp AS adults,
    CAST(nullif(o_orderkey % 4, 3) AS BIGINT) AS children,
    pc AS previous_cancellations, pnc AS previous_bookings_not_canceled,
    rr AS reserved_room_type, ar AS assigned_room_type,
    CAST(nullif(o_custkey % 7, 0) AS BIGINT) AS agent
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN li ON l_orderkey = o_orderkey)"""


def with_bookings(*ctes: str) -> str:
    """``WITH <bookings>, <ctes...>`` prefix for oracle SQL."""
    parts = [BOOKINGS_CTE.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n"
