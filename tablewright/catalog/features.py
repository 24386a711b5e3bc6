"""Derived features and the modelling table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import FeatureSpec, derive_features, feature_report
from .common import event_gaps, gaps, modeling_table, plain, sql_words, table
from .common import SQL_EVENT_GAPS, SQL_GAPS
from .profiling import SQL_DATED, dated_orders


def _one(df, spec, *keep, digits=6):
    out, _ = derive_features(df, [spec])
    return plain(out.select(*keep, spec.name), digits)


def feat_ratio(spark, d):
    spec = FeatureSpec("unit_price", "ratio", ["l_extendedprice", "l_tax"])
    # Millions with two digits: more would compare the last bits of two engines' rounding.
    return _one(table(spark, d, "lineitem"), spec, "l_orderkey", "l_linenumber", digits=2)


def feat_difference(spark, d):
    spec = FeatureSpec("spread", "difference", ["l_discount", "l_tax"])
    return _one(gaps(spark, d), spec, "l_orderkey", "l_linenumber")


def feat_product(spark, d):
    spec = FeatureSpec("rebate", "product", ["l_extendedprice", "l_discount"])
    return _one(gaps(spark, d), spec, "l_orderkey", "l_linenumber")


def feat_sum(spark, d):
    spec = FeatureSpec("keys", "sum", ["l_partkey", "l_suppkey"])
    return _one(gaps(spark, d), spec, "l_orderkey", "l_linenumber")


def feat_text_length(spark, d):
    df = table(spark, d, "conversations").withColumn("text", F.expr("nullif(text, '')"))
    return _one(df, FeatureSpec("chars", "text_length", ["text"]), "conv_id", "turn", "role")


def feat_word_count(spark, d):
    return _one(table(spark, d, "documents"), FeatureSpec("words", "text_word_count", ["text"]), "doc_id")


PARTS = ["year", "month", "day", "dayofweek", "quarter"]


def feat_date_parts(spark, d):
    """Parts of a typed date and of the same date as text, some of it unreadable."""
    df = dated_orders(spark, d).withColumns(
        {
            "placed": F.col("o_orderdate").cast("timestamp_ntz"),
            "o_orderdate": F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE o_orderdate END"),
        }
    )
    specs = [FeatureSpec(f"typed_{p}", "date_part", ["placed"], p) for p in PARTS]
    specs += [FeatureSpec(f"text_{p}", "date_part", ["o_orderdate"], p) for p in PARTS]
    out, names = derive_features(df, specs)
    return out.select("o_orderkey", *names)


def feat_is_missing(spark, d):
    return _one(event_gaps(spark, d), FeatureSpec("no_type", "is_missing", ["event_type"]), "event_id")


def feat_category_frequency(spark, d):
    return _one(event_gaps(spark, d), FeatureSpec("type_share", "category_frequency", ["event_type"]), "event_id")


FEATURE_SET = [
    FeatureSpec("net", "difference", ["l_extendedprice", "rebate_missing"]),  # skipped: no such source yet
    FeatureSpec("rebate", "product", ["l_extendedprice", "l_discount"]),
    FeatureSpec("net", "difference", ["l_extendedprice", "rebate"]),
    FeatureSpec("net_per_unit", "ratio", ["net", "l_quantity"]),
    FeatureSpec("l_tax", "sum", ["l_quantity", "l_discount"]),  # skipped: the name exists
    FeatureSpec("cheat", "sum", ["l_quantity", "l_linenumber"]),  # skipped: uses the target
    FeatureSpec("flag_share", "category_frequency", ["l_returnflag"]),
    FeatureSpec("share_gap", "is_missing", ["l_discount"]),
    FeatureSpec("ship_day", "date_part", ["l_shipdate"], "dayofweek"),
]


def feat_set(spark, d):
    out, names = derive_features(gaps(spark, d), FEATURE_SET, target="l_linenumber")
    return plain(out.select("l_orderkey", "l_linenumber", *names))


def feature_report_query(spark, d):
    out, names = derive_features(gaps(spark, d), FEATURE_SET, target="l_linenumber")
    return feature_report(out, names, "orders")


def modeling_table_query(spark, d):
    out = modeling_table(spark, d)
    return plain(out.drop("l_shipdate"))


KEYS = "l_orderkey, l_linenumber"
SQL_MODELING = (
    "(SELECT lineitem.*, o_custkey, o_orderpriority, o_totalprice, c_mktsegment, c_acctbal, p_type, p_size, p_retailprice "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN part ON l_partkey = p_partkey)"
)


def _ratio(a: str, b: str) -> str:
    return f"{a} / (nullif({b}, 0) + 1e-6)"


def _parts(prefix: str, value: str) -> str:
    names = {"year": "year", "month": "month", "day": "day", "quarter": "quarter"}
    lines = [f"CAST({f}({value}) AS INTEGER) AS {prefix}_{p}" for p, f in names.items()]
    return ", ".join([*lines, f"CAST(isodow({value}) - 1 AS INTEGER) AS {prefix}_dayofweek"])


QUERIES = {
    "feat_ratio": feat_ratio,
    "feat_difference": feat_difference,
    "feat_product": feat_product,
    "feat_sum": feat_sum,
    "feat_text_length": feat_text_length,
    "feat_word_count": feat_word_count,
    "feat_date_parts": feat_date_parts,
    "feat_is_missing": feat_is_missing,
    "feat_category_frequency": feat_category_frequency,
    "feat_set": feat_set,
    "feature_report": feature_report_query,
    "modeling_table": modeling_table_query,
}

ORACLE = {
    "feat_ratio": f"SELECT {KEYS}, round({_ratio('l_extendedprice', 'l_tax')}, 2) AS unit_price FROM lineitem",
    "feat_difference": f"SELECT {KEYS}, round(l_discount - l_tax, 6) AS spread FROM {SQL_GAPS}",
    "feat_product": f"SELECT {KEYS}, round(l_extendedprice * l_discount, 6) AS rebate FROM {SQL_GAPS}",
    "feat_sum": f"SELECT {KEYS}, CAST(l_partkey + l_suppkey AS DOUBLE) AS keys FROM lineitem",
    "feat_text_length": "SELECT conv_id, turn, role, CAST(length(coalesce(text, '')) AS INTEGER) AS chars FROM conversations",
    "feat_word_count": f"SELECT doc_id, CAST({sql_words('text')} AS INTEGER) AS words FROM documents",
    "feat_date_parts": f"SELECT o_orderkey, {_parts('typed', 'placed')}, {_parts('text', 'readable')} FROM (SELECT o_orderkey, "
    "CAST(o_orderdate AS TIMESTAMP) AS placed, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS TIMESTAMP) END "
    f"AS readable FROM {SQL_DATED})",
    "feat_is_missing": f"SELECT event_id, CAST(event_type IS NULL AS INTEGER) AS no_type FROM {SQL_EVENT_GAPS}",
    "feat_category_frequency": "SELECT event_id, round(count(*) OVER (PARTITION BY event_type) / CAST(count(*) OVER () AS DOUBLE), 6) "
    f"AS type_share FROM {SQL_EVENT_GAPS}",
    "feat_set": f"SELECT {KEYS}, round(l_extendedprice * l_discount, 6) AS rebate, "
    "round(l_extendedprice - l_extendedprice * l_discount, 6) AS net, "
    f"round({_ratio('(l_extendedprice - l_extendedprice * l_discount)', 'l_quantity')}, 6) AS net_per_unit, "
    "round(count(*) OVER (PARTITION BY l_returnflag) / CAST(count(*) OVER () AS DOUBLE), 6) AS flag_share, "
    "CAST(l_discount IS NULL AS INTEGER) AS share_gap, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS ship_day "
    f"FROM {SQL_GAPS}",
    "modeling_table": f"SELECT * EXCLUDE (l_shipdate) FROM {SQL_MODELING}",
}
