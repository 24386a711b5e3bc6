"""Value distributions, missing values, correlations, leakage, balance, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions, eda
from .common import COLUMNS, LINEITEM_NUMBERS, SQL_EVENT_GAPS, SQL_GAPS, event_gaps, gaps, plain, table


def measured_documents(spark, d):
    """``documents`` with the length of its text as one more column."""
    return table(spark, d, "documents").select(
        "doc_id", "n_chars", F.length("text").cast("bigint").alias("text_chars"), F.size(F.split("text", " ")).alias("pieces")
    )


SQL_MEASURED = (
    "(SELECT doc_id, n_chars, length(text) AS text_chars, len(string_split(text, ' ')) AS pieces FROM documents)"
)


def top_values(spark, d):
    return distributions.top_values(table(spark, d, "part"))


def distribution_report(spark, d):
    return distributions.distribution_report(event_gaps(spark, d).select("event_type", "user_id"))


def missing_counts(spark, d):
    return eda.missing_counts(gaps(spark, d))


def target_correlations(spark, d):
    return plain(eda.top_correlations(gaps(spark, d), "l_extendedprice"))


def correlation_matrix(spark, d):
    return plain(eda.correlation_matrix(gaps(spark, d)))


def leakage_columns(spark, d):
    return plain(eda.leakage_columns(measured_documents(spark, d), "n_chars"))


def class_balance(spark, d):
    return eda.class_balance(gaps(spark, d), "l_returnflag")


def iqr_outliers(spark, d):
    return eda.iqr_outliers(table(spark, d, "events"))


def eda_report(spark, d):
    return plain(eda.eda_report(event_gaps(spark, d), "event_type", "classification"))


def _corr(x: str, y: str) -> str:
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) {both} * stddev_samp({y}) {both}, 0)"


def _corr_list(source: str, names: list[str], target: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_corr(c, target)} AS corr FROM {source}" for c in names if c != target
    )


def _outliers(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE b.q3 > b.q1 AND ({c} < b.q1 - 1.5 * (b.q3 - b.q1) OR "
        f"{c} > b.q3 + 1.5 * (b.q3 - b.q1))) AS outliers FROM {source}, (SELECT quantile_cont({c}, 0.25) AS q1, "
        f"quantile_cont({c}, 0.75) AS q3 FROM {source}) b"
        for c in names
    )


def _top(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(rank AS INTEGER) AS rank, value, n, share FROM (SELECT value, n, "
        f"round(n / (SELECT count(*) FROM {source}), 4) AS share, row_number() OVER (ORDER BY n DESC, value NULLS FIRST) AS rank "
        f"FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} GROUP BY 1)) WHERE rank <= 20"
        for c in columns
    )


def _missing(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM {source}" for c in columns
    )


EVENT_NUMBERS = ["event_id", "user_id", "value"]

QUERIES = {
    "top_values": top_values,
    "distribution_report": distribution_report,
    "missing_counts": missing_counts,
    "target_correlations": target_correlations,
    "correlation_matrix": correlation_matrix,
    "leakage_columns": leakage_columns,
    "class_balance": class_balance,
    "iqr_outliers": iqr_outliers,
    "eda_report": eda_report,
}

ORACLE = {
    "top_values": _top("part", COLUMNS["part"]),
    "distribution_report": "SELECT s.*, t.rank, t.value, t.n, t.share FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({i} AS INTEGER) AS position, '{t}' AS dtype, count(*) - count({c}) AS missing, "
        f"count(DISTINCT {c}) AS \"distinct\" FROM {SQL_EVENT_GAPS}"
        for i, (c, t) in enumerate([("event_type", "string"), ("user_id", "bigint")])
    )
    + f") s JOIN ({_top(SQL_EVENT_GAPS, ['event_type', 'user_id'])}) t ON s.\"column\" = t.\"column\"",
    "missing_counts": _missing(SQL_GAPS, COLUMNS["lineitem"]),
    "target_correlations": f"SELECT \"column\", round(corr, 6) AS corr FROM ({_corr_list(SQL_GAPS, LINEITEM_NUMBERS, 'l_extendedprice')}) "
    "ORDER BY abs(corr) DESC, \"column\" LIMIT 10",
    "correlation_matrix": " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round({_corr(x, y)}, 6) AS corr FROM {SQL_GAPS}"
        for x in LINEITEM_NUMBERS
        for y in LINEITEM_NUMBERS
    ),
    "leakage_columns": "SELECT \"column\", round(corr, 6) AS corr FROM ("
    f"{_corr_list(SQL_MEASURED, ['doc_id', 'text_chars', 'pieces'], 'n_chars')}) WHERE abs(corr) > 0.98",
    "class_balance": f"SELECT l_returnflag AS value, count(*) AS n FROM {SQL_GAPS} GROUP BY 1",
    "iqr_outliers": _outliers("events", EVENT_NUMBERS),
    "eda_report": "SELECT 'shape' AS metric, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM events "
    "UNION ALL SELECT 'shape', 'columns', 6.0 "
    f"UNION ALL SELECT 'missing', \"column\", CAST(missing AS DOUBLE) FROM ({_missing(SQL_EVENT_GAPS, COLUMNS['events'])}) "
    f"UNION ALL SELECT 'outliers', \"column\", CAST(outliers AS DOUBLE) FROM ({_outliers(SQL_EVENT_GAPS, EVENT_NUMBERS)}) "
    f"UNION ALL SELECT 'class_balance', event_type, CAST(count(*) AS DOUBLE) FROM {SQL_EVENT_GAPS} GROUP BY event_type",
}
