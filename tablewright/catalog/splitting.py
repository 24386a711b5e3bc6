"""Splits and model columns, imputers, scales, label codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep
from ..operators.clean import fill_mode
from ..operators.prep import class_codes, encode_labels, model_columns, standardize
from ..operators.profile import infer_roles
from ..operators.split import exact_split, parts, split_manifest
from .common import SQL_EVENT_GAPS, SQL_GAPS, event_gaps, gaps, plain, table


def _split(spark, d, **kw):
    return exact_split(table(spark, d, "orders"), key="o_orderkey", **kw)


def split_exact(spark, d):
    return _split(spark, d).select("o_orderkey", "split")


def split_stratified(spark, d):
    return _split(spark, d, stratify="o_orderstatus").select("o_orderkey", "o_orderstatus", "split")


def split_rows(spark, d):
    """Whole rows as keys, on a table with equal rows: part sizes per copy count."""
    doubled = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax")
    return split_manifest(exact_split(doubled))


def split_manifest_query(spark, d):
    return split_manifest(_split(spark, d, test_size=0.25, val_size=0.15))


def split_union(spark, d):
    return parts(_split(spark, d), "train", "val").select("o_orderkey", "o_totalprice")


def model_columns_query(spark, d):
    df = table(spark, d, "customer")
    kept = model_columns(df, "c_acctbal", infer_roles(df, "c_acctbal"))
    stats = [F.count(F.col(c)).alias(c) for c in kept]
    return df.agg(*stats).unpivot([], kept, "column", "present")


def prep_median(spark, d):
    """The fitted constants: median, mean after filling, population deviation."""
    stats = prep.numeric_stats(gaps(spark, d), ["l_quantity", "l_discount", "l_extendedprice"])
    rows = [(c, *map(float, s)) for c, s in stats.items()]
    return plain(spark.createDataFrame(rows, "column string, median double, mean double, deviation double"), 4)


def prep_standardize(spark, d):
    scaled = standardize(gaps(spark, d), ["l_quantity", "l_discount"])
    return plain(scaled.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), 4)


def prep_mode(spark, d):
    filled = fill_mode(gaps(spark, d), ["l_returnflag"])
    return filled.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def prep_one_hot(spark, d):
    """Ones per level of the encoded flag, gaps filled with the mode; positions follow the levels."""
    from pyspark.ml.functions import vector_to_array

    df = gaps(spark, d).select("l_returnflag", "l_linestatus")
    fitted = prep.fit_preprocessor(df, None, {"l_returnflag": "categorical", "l_linestatus": "categorical"})
    vectors = fitted.model.transform(df).select(F.posexplode(vector_to_array("features")).alias("position", "one"))
    return vectors.groupBy("position").agg(F.sum("one").alias("ones"))


def label_codes(spark, d):
    df = table(spark, d, "orders")
    text = encode_labels(df, "o_orderpriority", class_codes(df, "o_orderpriority"), "priority_code")
    both = encode_labels(text, "o_custkey", class_codes(df, "o_custkey"), "customer_code")
    return both.select("o_orderkey", "priority_code", "customer_code")


def event_labels(spark, d):
    """Label codes of a target whose gaps are dropped first."""
    df = event_gaps(spark, d).filter("event_type IS NOT NULL")
    return encode_labels(df, "event_type", class_codes(df, "event_type"), "code").select("event_id", "code")


def _parts_sql(test: str, val: str) -> str:
    cut = f"ceil(n * {test})"
    return (
        f"CASE WHEN r <= {cut} THEN 'test' WHEN r <= {cut} + ceil((n - {cut}) * ({val} / (1 - {test}))) THEN 'val' ELSE 'train' END"
    )


RANKED = "(SELECT *, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS r, count(*) OVER () AS n FROM orders)"
SPLIT = _parts_sql("CAST(0.2 AS DOUBLE)", "CAST(0.1 AS DOUBLE)")
SPLIT_25 = _parts_sql("CAST(0.25 AS DOUBLE)", "CAST(0.15 AS DOUBLE)")


def _quota(name: str, source: str, counts: str, draws: str) -> str:
    """Largest remainder shares of ``draws`` over the classes of ``source``."""
    exact = f"CAST({counts} AS DOUBLE) / sum({counts}) OVER () * ({draws})"
    return (
        f"{name}_e AS (SELECT *, {exact} AS e FROM {source}), "
        f"{name} AS (SELECT * EXCLUDE (e), floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, s) <= "
        f"({draws}) - (SELECT sum(floor(e)) FROM {name}_e) THEN 1 ELSE 0 END AS {name}_n FROM {name}_e)"
    )


TOTAL = "(SELECT count(*) FROM orders)"
TEST = f"ceil({TOTAL} * CAST(0.2 AS DOUBLE))"
VAL = f"ceil(({TOTAL} - {TEST}) * (CAST(0.1 AS DOUBLE) / (1 - CAST(0.2 AS DOUBLE))))"
SPLIT_STRATIFIED = (
    "WITH classes AS (SELECT o_orderstatus AS s, count(*) AS c FROM orders GROUP BY 1), "
    + _quota("keep", "classes", "c", f"{TOTAL} - {TEST}")
    + ", "
    + _quota("train", "keep", "keep_n", f"{TOTAL} - {TEST} - {VAL}")
    + " SELECT o_orderkey, o_orderstatus, CASE WHEN r <= c - keep_n THEN 'test' WHEN r <= c - train_n THEN 'val' ELSE 'train' END "
    "AS split FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey)) AS r FROM orders) "
    "JOIN train ON o_orderstatus = s"
)

QUERIES = {
    "split_exact": split_exact,
    "split_stratified": split_stratified,
    "split_rows": split_rows,
    "split_manifest": split_manifest_query,
    "split_union": split_union,
    "model_columns": model_columns_query,
    "prep_median": prep_median,
    "prep_standardize": prep_standardize,
    "prep_mode": prep_mode,
    "prep_one_hot": prep_one_hot,
    "label_codes": label_codes,
    "event_labels": event_labels,
}

_FILLED = {c: f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {SQL_GAPS}))" for c in ["l_quantity", "l_discount", "l_extendedprice"]}


def _scaled(c: str) -> str:
    f = _FILLED[c]
    return f"round(({f} - (SELECT avg({f}) FROM {SQL_GAPS})) / (SELECT stddev_pop({f}) FROM {SQL_GAPS}), 4) AS {c}"


_MODE = (
    f"(SELECT l_returnflag FROM (SELECT l_returnflag, count(*) AS n FROM {SQL_GAPS} WHERE l_returnflag IS NOT NULL GROUP BY 1) "
    "ORDER BY n DESC, l_returnflag LIMIT 1)"
)

ORACLE = {
    "split_exact": f"SELECT o_orderkey, {SPLIT} AS split FROM {RANKED}",
    "split_stratified": SPLIT_STRATIFIED,
    "split_rows": f"SELECT split, count(*) AS rows FROM (SELECT {SPLIT} AS split FROM (SELECT row_number() OVER () AS r, "
    "count(*) OVER () AS n FROM lineitem)) GROUP BY split",
    "split_manifest": f"SELECT split, count(*) AS rows FROM (SELECT {SPLIT_25} AS split FROM {RANKED}) GROUP BY split",
    "split_union": f"SELECT o_orderkey, o_totalprice FROM {RANKED} WHERE {SPLIT} <> 'test'",
    "model_columns": "SELECT 'c_custkey' AS \"column\", count(c_custkey) AS present FROM customer UNION ALL "
    "SELECT 'c_nationkey', count(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal) FROM customer "
    "UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM customer",
    "prep_median": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.5), 4) AS median, round(avg({f}), 4) AS mean, "
        f"round(stddev_pop({f}), 4) AS deviation FROM {SQL_GAPS}"
        for c, f in _FILLED.items()
    ),
    "prep_standardize": f"SELECT l_orderkey, l_linenumber, {_scaled('l_quantity')}, {_scaled('l_discount')} FROM {SQL_GAPS}",
    "prep_mode": f"SELECT coalesce(l_returnflag, {_MODE}) AS l_returnflag, count(*) AS n FROM {SQL_GAPS} GROUP BY 1",
    "prep_one_hot": "SELECT CAST(row_number() OVER (ORDER BY col, level) - 1 AS INTEGER) AS position, CAST(n AS DOUBLE) AS ones FROM ("
    f"SELECT 1 AS col, coalesce(l_returnflag, {_MODE}) AS level, count(*) AS n FROM {SQL_GAPS} GROUP BY ALL UNION ALL "
    f"SELECT 2, l_linestatus, count(*) FROM {SQL_GAPS} GROUP BY ALL)",
    "label_codes": "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS priority_code, "
    "CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS DOUBLE) AS customer_code FROM orders",
    "event_labels": "SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS code FROM "
    f"{SQL_EVENT_GAPS} WHERE event_type IS NOT NULL",
}
