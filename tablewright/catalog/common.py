"""Tables, fixtures and output helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import is_datetime, is_float
from ..sources.tables import read_table as table

STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "%Y-%m-%d %H:%M:%S"

COLUMNS = {
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]

# Words in RE2, with every Unicode space as a separator.
SQL_WORDS = r"[^\s\x{0B}\x{85}\p{Z}]+"


def sql_words(column: str) -> str:
    return f"len(regexp_extract_all(coalesce({column}, ''), '{SQL_WORDS}'))"


def gaps(spark, d: str) -> DataFrame:
    """``lineitem`` with gaps in a number, a rate and a flag."""
    return table(spark, d, "lineitem").withColumns(
        {
            "l_quantity": F.expr("nullif(l_quantity, 10.0D)"),
            "l_discount": F.expr("nullif(l_discount, 0.05D)"),
            "l_returnflag": F.expr("nullif(l_returnflag, 'R')"),
        }
    )


SQL_GAPS = (
    "(SELECT * REPLACE (nullif(l_quantity, 10.0) AS l_quantity, nullif(l_discount, 0.05) AS l_discount, "
    "nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem)"
)


def event_gaps(spark, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("event_type", F.expr("nullif(event_type, 'view')"))


SQL_EVENT_GAPS = "(SELECT * REPLACE (nullif(event_type, 'view') AS event_type) FROM events)"


def repeated_orders(spark, d: str) -> DataFrame:
    """``orders`` with all finished orders twice."""
    orders = table(spark, d, "orders")
    return orders.unionAll(orders.filter("o_orderstatus = 'F'"))


SQL_REPEATED = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F')"


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Timestamps as text and doubles rounded, for comparison between engines."""
    out = []
    for f in df.schema:
        value = F.col(f"`{f.name}`")
        if is_datetime(f.dataType):
            value = F.date_format(value, STAMP)
        elif is_float(f.dataType):
            value = F.round(value.cast("double"), digits)
        out.append(value.alias(f.name))
    return df.select(*out)


def sql_stamp(column: str) -> str:
    return f"strftime({column}, '{SQL_STAMP}') AS {column}"


def modeling_table(spark, d: str) -> DataFrame:
    """``lineitem`` joined with its order, customer and part."""
    from ..operators.assemble import join_dimensions

    pick = lambda name, *cols: table(spark, d, name).select(*cols)
    return join_dimensions(
        table(spark, d, "lineitem"),
        [
            (pick("orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), "l_orderkey", "o_orderkey"),
            (pick("customer", "c_custkey", "c_mktsegment", "c_acctbal"), "o_custkey", "c_custkey"),
            (pick("part", "p_partkey", "p_type", "p_size", "p_retailprice"), "l_partkey", "p_partkey"),
        ],
    )
