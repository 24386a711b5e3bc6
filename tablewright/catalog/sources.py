"""Scans and sinks: each query writes a table below the shared folder and reads it back."""

from __future__ import annotations


from ..operators.profile import column_profile
from ..operators.split import exact_split
from ..session import scratch_path
from ..sources.artifacts import read_artifact, write_artifact
from ..sources.csv import read_csv
from ..sources.tables import read_split, write_csv, write_splits, write_stage
from .common import COLUMNS, gaps, plain, sql_stamp, table

LINES = [c for c in COLUMNS["lineitem"] if c != "l_shipdate"]


def scan_parquet(spark, d):
    return plain(table(spark, d, "lineitem").select("l_orderkey", "l_quantity").filter("l_quantity > 45"))


def _csv(spark, d, sep):
    path = scratch_path(spark, "csv")
    gaps(spark, d).write.option("header", True).option("sep", sep).csv(path)
    return read_csv(spark, path)


def csv_scan(spark, d):
    return plain(_csv(spark, d, ";").select(*LINES))


def csv_text(spark, d):
    """Texts with line breaks, commas and quotes, to CSV and back."""
    path = scratch_path(spark, "csv")
    write_csv(table(spark, d, "documents"), path)
    return read_csv(spark, path)


def csv_types(spark, d):
    df = _csv(spark, d, ",")
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema]
    types = spark.createDataFrame(rows, "column string, dtype string")
    return types.join(column_profile(df).select("column", "missing"), "column")


def stage_table(spark, d):
    path = scratch_path(spark, "stage")
    return plain(write_stage(table(spark, d, "orders"), path))


def split_table(spark, d):
    path = scratch_path(spark, "splits")
    write_splits(exact_split(table(spark, d, "orders"), key="o_orderkey"), path)
    return plain(read_split(spark, path, "val", "test"))


def artifact_table(spark, d):
    path = scratch_path(spark, "artifact")
    found = column_profile(gaps(spark, d)).select("column", "missing", "distinct")
    write_artifact(found, path)
    return read_artifact(spark, path, found.schema)


GAPS = {"l_quantity": ("nullif(l_quantity, 10.0)"), "l_discount": "nullif(l_discount, 0.05)", "l_returnflag": "nullif(l_returnflag, 'R')"}
CSV_TYPES = dict(zip(COLUMNS["lineitem"], ["bigint"] * 4 + ["double"] * 4 + ["string"] * 3))
ORDERS = ", ".join(sql_stamp(c) if c == "o_orderdate" else c for c in COLUMNS["orders"])
RANKED_ORDERS = "(SELECT *, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS r, count(*) OVER () AS n FROM orders)"

QUERIES = {
    "scan_parquet": scan_parquet,
    "csv_scan": csv_scan,
    "csv_text": csv_text,
    "csv_types": csv_types,
    "stage_table": stage_table,
    "split_table": split_table,
    "artifact_table": artifact_table,
}

ORACLE = {
    "scan_parquet": "SELECT l_orderkey, round(l_quantity, 6) AS l_quantity FROM lineitem WHERE l_quantity > 45",
    "csv_scan": "SELECT "
    + ", ".join(
        f"CAST({GAPS.get(c, c)} AS BIGINT) AS {c}" if CSV_TYPES[c] == "bigint" else f"{GAPS.get(c, c)} AS {c}" for c in LINES
    )
    + " FROM lineitem",
    "csv_text": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "csv_types": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({GAPS.get(c, c)}) AS missing FROM lineitem"
        for c, t in CSV_TYPES.items()
    ),
    "stage_table": f"SELECT {ORDERS} FROM orders",
    "split_table": f"SELECT {ORDERS} FROM {RANKED_ORDERS} "
    "WHERE r <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * (0.1 / (1 - 0.2)))",
    "artifact_table": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({GAPS.get(c, c)}) AS missing, count(DISTINCT {GAPS.get(c, c)}) AS \"distinct\" "
        "FROM lineitem"
        for c in COLUMNS["lineitem"]
    ),
}
