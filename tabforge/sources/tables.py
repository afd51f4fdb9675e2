"""The benchmark tables and the fixture views built on them.

The tables have no missing values, so fixtures put nulls in by fixed rules
written once in SQL that both Spark (``spark.sql``) and DuckDB run, which
keeps the two sides of every oracle check on the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# The fixture rules (columns and null patterns).
FIXTURE_SQL = {
    "lineitem_gaps": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
               l_extendedprice,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount,
               CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS l_tax,
               CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
               l_linestatus, l_shipdate
        FROM lineitem""",
    "orders_gaps": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
               o_orderdate,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    "customer_gaps": """
        SELECT c_custkey, c_name, c_nationkey,
               CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
               CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
        FROM customer""",
    "events_gaps": """
        SELECT event_id, user_id, ts, event_type,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value
        FROM events""",
    "lineitem_charges": """
        SELECT *, l_extendedprice * (1 - l_discount) AS disc_price,
               l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
        FROM (SELECT l_quantity, l_extendedprice,
                     CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount,
                     CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS l_tax
              FROM lineitem) g""",
    "lineitem_int_gaps": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS qty
        FROM lineitem""",
    "lineitem_spikes": """
        SELECT l_orderkey, l_linenumber,
               CAST(CASE WHEN l_partkey % 40 = 0 THEN l_quantity * 9 ELSE l_quantity END AS INT) AS qty
        FROM lineitem""",
    "lineitem_large_ids": """
        SELECT CAST(9007199254740992 + l_orderkey AS BIGINT) AS id FROM lineitem""",
    "orders_typed": """
        SELECT o_orderkey, o_totalprice,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority = '1-URGENT' END AS urgent,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day
        FROM orders""",
    "orders_scores": """
        SELECT o_orderpriority AS model_name, CASE WHEN MIN(o_orderkey) % 3 = 0 THEN 'failed' ELSE 'ok' END AS status,
               MAX(o_totalprice) / 500000.0 AS train_f1, AVG(o_totalprice) / 500000.0 AS val_f1
        FROM orders GROUP BY o_orderpriority""",
}


def register_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    for t in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the parquet tables (lazy; the scan is pruned/pushed)."""
    needed = [t for t in TABLES if f" {t}" in FIXTURE_SQL[name]]
    register_tables(spark, sf_dir, needed)
    return spark.sql(FIXTURE_SQL[name])


def fixture_cte(*names: str) -> str:
    """``WITH`` clause defining the fixture views, for the oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in names) + "\n"


# A selection fixture with a rare flag (99.5 % one value), a
# rare text value (98 % one value) and an exact copy of a column.
FIXTURE_SQL["lineitem_selection"] = """
        SELECT l_quantity, l_extendedprice, l_discount, l_linestatus,
               CASE WHEN l_orderkey % 200 = 0 THEN 1.0 ELSE 0.0 END AS flag_rare,
               CASE WHEN l_orderkey % 50 = 0 THEN 'x' ELSE 'y' END AS rare_txt,
               l_quantity * 1.0 AS qty_copy,
               l_extendedprice + 0.0 AS price_copy
        FROM lineitem"""
