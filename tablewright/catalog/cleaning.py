"""Cleaning steps and the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from .common import (
    COLUMNS,
    SQL_EVENT_GAPS,
    SQL_GAPS,
    SQL_REPEATED,
    event_gaps,
    gaps,
    plain,
    repeated_orders,
    sql_stamp,
    table,
)

RULES = [
    {"column": "event_type", "value": "click"},
    {"column": "user_id", "value": "7"},
    {"column": "event_type", "value": "nan"},
    {"column": "absent", "value": "x"},
]
ORDER_RULES = [{"column": "o_orderstatus", "value": "P"}]


def clean_drop_columns(spark, d):
    return plain(clean.drop_columns(table(spark, d, "events"), "props, ts, absent"))


def clean_drop_rows(spark, d):
    return plain(clean.drop_rows(event_gaps(spark, d), RULES))


def clean_dedup(spark, d):
    return plain(clean.drop_duplicates(repeated_orders(spark, d)))


def clean_target_null(spark, d):
    return plain(clean.drop_null_target(event_gaps(spark, d), "event_type"))


def _numbers(df):
    return plain(df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))


def fill_median(spark, d):
    return _numbers(clean.fill_median(gaps(spark, d), ["l_quantity", "l_discount"]))


def fill_mean(spark, d):
    return _numbers(clean.fill_mean(gaps(spark, d), ["l_quantity", "l_discount"]))


def fill_mode(spark, d):
    return clean.fill_mode(event_gaps(spark, d), ["event_type"]).select("event_id", "event_type")


def fill_constant(spark, d):
    return clean.fill_constant(event_gaps(spark, d), ["event_type"], "none given").select("event_id", "event_type")


def clip_iqr(spark, d):
    return plain(clean.clip_iqr(table(spark, d, "events"), ["value"]).select("event_id", "value"))


def chain_input(spark, d):
    """Repeated orders with gaps, and a text column dropped by the chain."""
    return repeated_orders(spark, d).withColumns(
        {
            "o_totalprice": F.expr("nullif(o_totalprice, 0.0D)"),
            "o_custkey": F.expr("nullif(o_custkey, 7L)"),
            "o_orderpriority": F.expr("nullif(o_orderpriority, '5-LOW')"),
        }
    )


SQL_CHAIN = (
    "(SELECT * REPLACE (nullif(o_totalprice, 0.0) AS o_totalprice, nullif(o_custkey, 7) AS o_custkey, "
    f"nullif(o_orderpriority, '5-LOW') AS o_orderpriority) FROM {SQL_REPEATED})"
)


def _config(numeric="median"):
    return clean.CleanConfig(
        drop_columns=["o_orderdate"], drop_rows=ORDER_RULES, numeric_fill=numeric, reason="finished and open orders only"
    )


def clean_chain(spark, d):
    return plain(clean.clean(chain_input(spark, d), _config(), target="o_orderstatus").data, 4)


def clean_report(spark, d):
    return clean.clean(chain_input(spark, d), _config(), target="o_orderstatus").report


def _clip(name: str) -> str:
    low, high = "(q1 - 1.5 * (q3 - q1))", "(q3 + 1.5 * (q3 - q1))"
    return f"CASE WHEN q3 > q1 AND {name} < {low} THEN {low} WHEN q3 > q1 AND {name} > {high} THEN {high} ELSE {name} END"


SQL_KEPT = f"(SELECT DISTINCT * EXCLUDE (o_orderdate) FROM {SQL_CHAIN} WHERE o_orderstatus <> 'P')"


def _chain_number(name: str) -> str:
    filled = f"coalesce(CAST({name} AS DOUBLE), (SELECT median({name}) FROM kept))"
    return (
        f"{name}_f AS (SELECT quantile_cont({filled}, 0.25) AS q1, quantile_cont({filled}, 0.75) AS q3, "
        f"(SELECT median({name}) FROM kept) AS m FROM kept)"
    )


def _chain_value(name: str) -> str:
    value = f"coalesce(CAST({name} AS DOUBLE), {name}_f.m)"
    low, high = f"({name}_f.q1 - 1.5 * ({name}_f.q3 - {name}_f.q1))", f"({name}_f.q3 + 1.5 * ({name}_f.q3 - {name}_f.q1))"
    return f"round(CASE WHEN {value} < {low} THEN {low} WHEN {value} > {high} THEN {high} ELSE {value} END, 4) AS {name}"


CHAIN_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
EVENTS = ", ".join(sql_stamp(c) if c == "ts" else "round(value, 6) AS value" if c == "value" else c for c in COLUMNS["events"])
ORDERS = ", ".join(sql_stamp(c) if c == "o_orderdate" else c for c in COLUMNS["orders"])

QUERIES = {
    "clean_drop_columns": clean_drop_columns,
    "clean_drop_rows": clean_drop_rows,
    "clean_dedup": clean_dedup,
    "clean_target_null": clean_target_null,
    "fill_median": fill_median,
    "fill_mean": fill_mean,
    "fill_mode": fill_mode,
    "fill_constant": fill_constant,
    "clip_iqr": clip_iqr,
    "clean_chain": clean_chain,
    "clean_report": clean_report,
}

ORACLE = {
    "clean_drop_columns": "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events",
    "clean_drop_rows": f"SELECT {EVENTS} FROM {SQL_EVENT_GAPS} WHERE event_type <> 'click' AND user_id <> 7 AND event_type IS NOT NULL",
    "clean_dedup": f"SELECT {ORDERS} FROM (SELECT DISTINCT * FROM {SQL_REPEATED})",
    "clean_target_null": f"SELECT {EVENTS} FROM {SQL_EVENT_GAPS} WHERE event_type IS NOT NULL",
    "fill_median": "SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM "
    f"{SQL_GAPS})), 6) AS l_quantity, round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {SQL_GAPS})), 6) "
    f"AS l_discount FROM {SQL_GAPS}",
    "fill_mean": "SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM "
    f"{SQL_GAPS})), 6) AS l_quantity, round(coalesce(l_discount, (SELECT avg(l_discount) FROM {SQL_GAPS})), 6) "
    f"AS l_discount FROM {SQL_GAPS}",
    "fill_mode": "SELECT event_id, coalesce(event_type, (SELECT event_type FROM (SELECT event_type, count(*) AS n FROM "
    f"{SQL_EVENT_GAPS} WHERE event_type IS NOT NULL GROUP BY 1) ORDER BY n DESC, event_type LIMIT 1)) AS event_type FROM {SQL_EVENT_GAPS}",
    "fill_constant": f"SELECT event_id, coalesce(event_type, 'none given') AS event_type FROM {SQL_EVENT_GAPS}",
    "clip_iqr": f"SELECT event_id, round({_clip('value')}, 6) AS value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, "
    "quantile_cont(value, 0.75) AS q3 FROM events)",
    "clean_chain": f"WITH kept AS {SQL_KEPT}, "
    + ", ".join(_chain_number(c) for c in CHAIN_NUMBERS)
    + ", common AS (SELECT o_orderpriority AS p FROM (SELECT o_orderpriority, count(*) AS n FROM kept WHERE o_orderpriority "
    "IS NOT NULL GROUP BY 1) ORDER BY n DESC, o_orderpriority LIMIT 1) SELECT "
    + ", ".join(_chain_value(c) for c in CHAIN_NUMBERS)
    + ", o_orderstatus, coalesce(o_orderpriority, p) AS o_orderpriority FROM kept, common, "
    + ", ".join(f"{c}_f" for c in CHAIN_NUMBERS),
    "clean_report": f"SELECT (SELECT count(*) FROM {SQL_CHAIN}) AS rows_before, (SELECT count(*) FROM {SQL_KEPT}) AS rows_after, "
    "'finished and open orders only' AS reason",
}
