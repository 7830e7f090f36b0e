"""The relations of the matcher, taken from the tables at hand: orders as bank lines, lineitem as pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, and its SQL if there is any."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("bank_id"), F.col("o_custkey").alias("account"), F.col("o_totalprice").cast("decimal(18,2)").alias("bank_amount"), F.col("o_orderdate").cast("date").alias("bank_date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


BANKS = "SELECT o_orderkey AS bank_id, o_custkey AS account, CAST(o_totalprice AS DECIMAL(18,2)) AS bank_amount, CAST(o_orderdate AS DATE) AS bank_date, o_orderstatus AS status, o_orderpriority AS priority FROM orders"


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    item = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), amount.cast("string"), F.col("l_shipdate").cast("date").cast("string"))
    return rows.select(item.alias("item_id"), F.col("l_orderkey").alias("document"), amount.alias("amount"), F.col("l_shipdate").cast("date").alias("item_date"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"))


PIECES = "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS item_id, l_orderkey AS document, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_shipdate AS DATE) AS item_date, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_returnflag AS flag FROM lineitem"


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, money as double, dates as text, so that both engines show the same types."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "date": "string"}
    return df.select(*[F.col(f"`{c}`").cast("double" if t.startswith("decimal") else kinds.get(t, t)).alias(c) for c, t in df.dtypes])
