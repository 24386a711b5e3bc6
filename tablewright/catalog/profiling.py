"""Shape, profile, samples, duplicates, roles, candidate targets, schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile
from .common import COLUMNS, SQL_GAPS, SQL_REPEATED, gaps, repeated_orders, sql_words, table

DTYPES = {
    "lineitem": ["bigint"] * 3 + ["int"] + ["double"] * 4 + ["string"] * 2 + ["timestamp_ntz"],
    "orders": ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"],
    "customer": ["bigint", "string", "int", "double", "string"],
    "documents": ["bigint", "string", "string", "string", "bigint"],
}


def dated_orders(spark, d):
    """``orders`` with its date as text."""
    return table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


SQL_DATED = "(SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM orders)"
ROLE_TABLES = {
    "orders": (dated_orders, SQL_DATED, ["bigint", "bigint", "string", "double", "string", "string"]),
    "customer": (lambda s, d: table(s, d, "customer"), "customer", DTYPES["customer"]),
    "documents": (lambda s, d: table(s, d, "documents"), "documents", DTYPES["documents"]),
}


def _each(frames):
    return reduce(DataFrame.unionAll, [f.select(F.lit(name).alias("tbl"), "*") for name, f in frames])


def profile_shape(spark, d):
    return profile.shape(table(spark, d, "lineitem"))


def profile_columns(spark, d):
    return profile.column_profile(gaps(spark, d))


def profile_samples(spark, d):
    return profile.column_samples(table(spark, d, "orders"), order_by="o_orderkey")


def profile_duplicates(spark, d):
    return profile.duplicate_count(repeated_orders(spark, d))


def roles_inferred(spark, d):
    return _each([(n, profile.roles_frame(make(spark, d))) for n, (make, _, _) in ROLE_TABLES.items()])


def roles_grouped(spark, d):
    frames = [
        (n, profile.columns_by_role(profile.roles_frame(make(spark, d)))) for n, (make, _, _) in ROLE_TABLES.items()
    ]
    return _each(frames).withColumn("columns", F.array_join("columns", ","))


def candidate_targets(spark, d):
    return profile.candidate_targets(gaps(spark, d))


def schema_snapshot(spark, d):
    snap = profile.schema_snapshot(table(spark, d, "documents"), "n_chars")
    lists = [r for r in profile.ROLES if r != "target"]
    return snap.withColumns({r: F.array_join(r, ",") for r in lists})


def _sql_stats(source: str, columns: list[str], dtypes: list[str]) -> str:
    lines = []
    for i, (c, t) in enumerate(zip(columns, dtypes)):
        text = t == "string"
        family = "other" if text else "datetime" if t.startswith("timestamp") else "number"
        length, words, dates = (
            (f"avg(length({c}))", f"avg({sql_words(c)}) FILTER (WHERE {c} IS NOT NULL)", f"avg(CAST(try_cast({c} AS TIMESTAMP) IS NOT NULL AS INT)) FILTER (WHERE {c} IS NOT NULL)")
            if text
            else ("0", "0", "0")
        )
        lines.append(
            f"SELECT '{c}' AS \"column\", CAST({i} AS INTEGER) AS position, '{t}' AS dtype, '{family}' AS family, "
            f"count(*) - count({c}) AS missing, count({c}) AS present, count(DISTINCT {c}) AS \"distinct\", "
            f"{length} AS avg_len, {words} AS avg_words, {dates} AS parse_ratio FROM {source}"
        )
    return " UNION ALL ".join(lines)


def _sql_roles(source: str, columns: list[str], dtypes: list[str], target: str = "") -> str:
    ratio = '("distinct" / greatest(present, 1))'
    hinted = f"{ratio} > 0.98 AND regexp_matches(lower(\"column\"), 'id|uuid|code|number')"
    return (
        f"SELECT *, CASE WHEN \"column\" = '{target}' THEN 'target' WHEN family = 'datetime' THEN 'datetime' "
        f"WHEN {hinted} THEN 'identifier' WHEN family = 'number' THEN 'numeric' "
        "WHEN parse_ratio >= 0.8 AND avg_len >= 6 THEN 'datetime_candidate' "
        f"WHEN avg_len >= 35 OR avg_words >= 4 OR {ratio} >= 0.5 THEN 'text' ELSE 'categorical' END AS role "
        f"FROM ({_sql_stats(source, columns, dtypes)})"
    )


SQL_ROLES = " UNION ALL ".join(
    f"SELECT '{n}' AS tbl, * FROM ({_sql_roles(sql, COLUMNS[n], types)})" for n, (_, sql, types) in ROLE_TABLES.items()
)
SQL_LINE_ROLES = _sql_roles(SQL_GAPS, COLUMNS["lineitem"], DTYPES["lineitem"])
SQL_DOC_ROLES = _sql_roles("documents", COLUMNS["documents"], DTYPES["documents"], "n_chars")

QUERIES = {
    "profile_shape": profile_shape,
    "profile_columns": profile_columns,
    "profile_samples": profile_samples,
    "profile_duplicates": profile_duplicates,
    "roles_inferred": roles_inferred,
    "roles_grouped": roles_grouped,
    "candidate_targets": candidate_targets,
    "schema_snapshot": schema_snapshot,
}

ORACLE = {
    "profile_shape": "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem",
    "profile_columns": f'SELECT "column", position, dtype, role, missing, "distinct" FROM ({SQL_LINE_ROLES})',
    "profile_samples": " UNION ALL ".join(
        f"(SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY o_orderkey, CAST({c} AS VARCHAR)) AS INTEGER) AS rank, "
        f"CAST({c} AS VARCHAR) AS value FROM orders ORDER BY o_orderkey, value LIMIT 3)"
        for c in COLUMNS["orders"]
    ),
    "profile_duplicates": "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM "
    f"{SQL_REPEATED})) AS BIGINT) AS duplicates FROM {SQL_REPEATED}",
    "roles_inferred": f'SELECT tbl, "column", position, role FROM ({SQL_ROLES})',
    "roles_grouped": f"SELECT tbl, role, string_agg(\"column\", ',' ORDER BY \"column\") AS columns FROM ({SQL_ROLES}) GROUP BY tbl, role",
    "candidate_targets": "SELECT task, CAST(rank AS INTEGER) AS rank, \"column\" FROM (SELECT *, "
    "row_number() OVER (PARTITION BY task ORDER BY position) AS rank FROM (SELECT *, CASE WHEN role = 'numeric' AND "
    "\"distinct\" > 10 THEN 'regression' WHEN role = 'categorical' AND \"distinct\" BETWEEN 2 AND 25 THEN 'classification' END "
    f"AS task FROM ({SQL_LINE_ROLES})) WHERE task IS NOT NULL) WHERE rank <= 10",
    "schema_snapshot": "SELECT (SELECT count(*) FROM documents) AS rows, count(*) AS columns, 'n_chars' AS target, "
    + ", ".join(
        f"coalesce(string_agg(\"column\", ',' ORDER BY position) FILTER (WHERE role = '{r}'), '') AS {r}"
        for r in profile.ROLES
        if r != "target"
    )
    + f" FROM ({SQL_DOC_ROLES})",
}
