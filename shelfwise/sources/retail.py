"""The nine tables derived from the retail test tables (customer, part, orders, lineitem, events).

The order lines carry what the item rows need, so no derived table joins two
large inputs. Modulo terms only shape the data (roles, flags, parts that are
never sold); every input row is kept.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfwise.model import SCHEMAS
from shelfwise.sources.tables import Tables, with_subtotal

EPOCH = "timestamp_ntz'1995-01-01 00:00:00'"
TYPE_OF = "CASE {key} % 5 WHEN 0 THEN 'RESTOCK' WHEN 1 THEN 'RETURN' ELSE 'SALE' END"


_SCHEMAS: dict[str, T.StructType] = {}


def _file_schema(spark: SparkSession, path: str) -> T.StructType:
    """The file's schema, read from its footer once per process: inference is a job of its own."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return _SCHEMAS[path]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_file_schema(spark, path)).parquet(path)


def _typed(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])


class RetailTables(Mapping):
    """The nine tables, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._source = partial(_read, spark, sf_dir)
        self._spark = spark
        self._built: Tables = {}

    def __iter__(self):
        return iter(SCHEMAS)

    def __len__(self):
        return len(SCHEMAS)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = _typed(getattr(self, f"_{name}")(), name)
        return self._built[name]

    def _users(self) -> DataFrame:
        return self._source("customer").selectExpr(
            "c_custkey AS UserID",
            "c_name AS Username",
            "concat(lower(c_name), '@example.com') AS Email",
            "CASE WHEN c_custkey % 10 = 0 THEN 'ADMIN' WHEN c_custkey % 10 < 3 THEN 'MANAGER' ELSE 'STAFF' END AS Role",
            "IF(c_custkey % 8 = 0, 0, 1) AS Is_Active",
            f"{EPOCH} AS Created_At",
        )

    def _category(self) -> DataFrame:
        brands = self._source("part").select(F.col("p_brand").alias("Name")).distinct().selectExpr(
            "CAST(substring(Name, 7) AS bigint) AS CategoryID", "Name"
        )
        unused = self._spark.range(99, 100, 1, 1).selectExpr("id AS CategoryID", "concat('Brand#', id) AS Name")
        return brands.unionByName(unused).selectExpr(
            "CategoryID", "Name", "CAST(NULL AS string) AS Description",
            "IF(CategoryID % 5 = 0, 0, 1) AS IS_ACTIVE", f"{EPOCH} AS Created_At",
        )

    def _suppliers(self) -> DataFrame:
        return self._source("supplier").selectExpr(
            "s_suppkey AS SupplierID", "s_name AS Name", "concat('N', s_nationkey) AS Contact",
            "concat(lower(s_name), '@example.com') AS Email", "CAST(NULL AS string) AS Address",
            "IF(s_suppkey % 9 = 0, 0, 1) AS Is_Active", f"{EPOCH} AS Created_At",
        )

    def _products(self) -> DataFrame:
        n_suppliers = self._source("supplier").agg(F.count(F.lit(1))).scalar()
        return self._source("part").select(
            F.col("p_partkey").alias("ProductID"),
            F.col("p_name").alias("Name"),
            F.expr("CAST(substring(p_brand, 7) AS bigint)").alias("CategoryID"),
            (F.col("p_partkey") % n_suppliers).alias("SupplierID"),
            F.col("p_retailprice").alias("Unit_Price"),
            F.expr("IF(p_partkey % 23 = 0, 0, 1)").alias("Is_Active"),
            F.expr(EPOCH).alias("Created_At"),
        )

    def _stock_management(self) -> DataFrame:
        return self._source("part").selectExpr(
            "p_partkey AS StockID", "p_partkey AS ProductID", "IF(p_partkey % 29 = 0, 0, p_size) AS Quantity",
            "p_partkey % 40 AS Restock_Level", f"{EPOCH} AS Last_Updated",
        )

    def _transactions(self) -> DataFrame:
        return self._source("orders").selectExpr(
            "o_orderkey AS TransactionID",
            "IF(o_custkey % 7 = 5, o_custkey - 1, o_custkey) AS UserID",
            f"{TYPE_OF.format(key='o_orderkey')} AS Trans_Type",
            "o_orderdate AS Trans_Date",
            "IF(o_orderkey % 5 = 0, CAST(0 AS decimal(12,2)), CAST(o_totalprice AS decimal(12,2))) AS Total_Amount",
            "IF(o_orderkey % 3 = 0, NULL, concat('Order ', o_orderkey)) AS Notes",
        )

    def _transaction_items(self) -> DataFrame:
        return with_subtotal(
            self._source("lineitem").selectExpr(
                "l_orderkey * 8 + l_linenumber AS ItemID",
                "l_orderkey AS TransactionID",
                "IF(l_partkey % 11 = 5, l_partkey - 1, l_partkey) AS ProductID",
                "CAST(l_quantity AS bigint) AS Quantity",
                "IF(l_orderkey % 5 = 0, CAST(0 AS decimal(10,2)), CAST(l_extendedprice AS decimal(10,2))) AS Unit_Price",
            )
        )

    def _reports(self) -> DataFrame:
        return self._source("events").selectExpr(
            "event_id AS ReportID",
            "CASE event_id % 4 WHEN 0 THEN 'DAILY_SALES' WHEN 1 THEN 'STOCK_ALERT' "
            "WHEN 2 THEN 'RESTOCK_SUMMARY' ELSE 'CATEGORY_SUMMARY' END AS Report_Type",
            "user_id AS Generated_By", "ts AS Generated_At", "props AS Report_Data",
        )

    def _audit_log(self) -> DataFrame:
        return self._source("events").selectExpr(
            "event_id AS LogID",
            "CASE event_type WHEN 'purchase' THEN 'TRANSACTIONS' WHEN 'view' THEN 'PRODUCTS' "
            "WHEN 'click' THEN 'CATEGORY' WHEN 'error' THEN 'STOCK_MANAGEMENT' ELSE 'USERS' END AS Table_Name",
            "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'view' THEN 'SELECT' "
            "WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS Operation",
            "user_id AS Record_ID",
            "concat('U', user_id) AS Changed_By",
            "ts AS Change_Date",
            "IF(event_id % 4 = 0, NULL, concat('Qty=', event_id % 50)) AS Old_Value",
            "concat('Qty=', event_id % 60) AS New_Value",
            "props AS Description",
        )


def retail_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return RetailTables(spark, sf_dir)


def retail_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands_from(_read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders"))


def commands_from(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One ledger command per order line, some with an unknown product, user, type or quantity.

    The lines may be a stream.
    """
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    heads = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "l_orderkey * 8 + l_linenumber AS cmd_id",
        "o_orderdate AS event_ts",
        "IF(l_orderkey % 97 = 3, -1, o_custkey) AS user_id",
        "IF(l_orderkey % 101 = 4, -5, l_partkey) AS product_id",
        "IF(l_orderkey % 89 = 2, 0, CAST(l_quantity AS bigint)) AS quantity",
        f"IF(l_orderkey % 83 = 1, 'GIFT', {TYPE_OF.format(key='l_orderkey')}) AS cmd_type",
        "IF(l_orderkey % 2 = 0, NULL, concat('Line ', l_linenumber)) AS notes",
        "concat('U', o_custkey) AS actor",
    )
