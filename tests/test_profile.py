import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.dates import parse_datetime
from tablewright.functions.text import word_count
from tablewright.operators import distributions, eda, profile
from tablewright.operators.quantiles import iqr_bounds, quantiles


def roles(spark, values, name="c", dtype="string", target=None):
    df = spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")
    return profile.infer_roles(df, target)[name]


def test_roles(spark):
    assert roles(spark, [1, 2, 3], dtype="int") == "numeric"
    assert roles(spark, [1, 2, 3], name="user_id", dtype="int") == "identifier"
    assert roles(spark, [1, 1, 3], name="user_id", dtype="int") == "numeric"
    assert roles(spark, [1, 2, 3], name="width", dtype="int") == "identifier"  # "width" holds "id"
    assert roles(spark, [True, False], dtype="boolean") == "categorical"
    assert roles(spark, ["a", "b"] * 5) == "categorical"
    assert roles(spark, ["a", "b"]) == "text"  # nearly unique
    assert roles(spark, ["a b c d"] * 5) == "text"
    assert roles(spark, ["x" * 35] * 5) == "text"
    assert roles(spark, ["2024-01-0%d" % (1 + i % 3) for i in range(10)]) == "datetime_candidate"
    assert roles(spark, ["2024-01-01"] * 8 + ["zz"] * 2) == "datetime_candidate"
    assert roles(spark, ["2024-01-01"] * 7 + ["zz"] * 3) == "categorical"
    assert roles(spark, ["a"], target="c") == "target"
    assert roles(spark, [None, None]) == "categorical"
    assert roles(spark, [None, None], dtype="double") == "numeric"


def test_roles_of_dates(spark):
    df = spark.sql("SELECT DATE'2024-01-01' AS d, TIMESTAMP'2024-01-01 00:00:00' AS t, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS n")
    assert set(profile.infer_roles(df).values()) == {"datetime"}


def test_dates_are_read(spark):
    texts = {
        "2024-02-29": "2024-02-29", "2024-02-30": None, "2024-02-29T10:11:12Z": "2024-02-29", "2024/3/1": "2024-03-01",
        "03/04/2024": "2024-03-04", "13.01.2024 10:30": "2024-01-13", "5 Mar 2024": "2024-03-05",
        "March 5, 2024": "2024-03-05", "20240305": "2024-03-05", "1999": "1999-01-01", "0999": None, "n/a": None,
        "hello 5": None, "": None, "9" * 50: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", parse_datetime(F.col("t")).cast("date").cast("string").alias("d")).collect()}
    assert got == texts


def test_words(spark):
    texts = {"": 0, "a  b": 2, " a\tb\n c ": 3, "a b": 2, "one": 1}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", word_count(F.col("t")).alias("n")).collect()} == texts


def test_profile_counts(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, "a"), (nan, "a"), (None, None), (0.0, "b"), (-0.0, "b")], "x double, s string")
    for method in ("exact", "approx"):
        got = {r["column"]: (r["missing"], r["distinct"]) for r in profile.column_profile(df, method).collect()}
        assert got == {"x": (2, 2), "s": (1, 2)}
    assert profile.shape(df).first() == (5, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    got = {r["column"]: (r["missing"], r["distinct"], r["role"]) for r in profile.column_profile(df).collect()}
    assert got == {"x": (0, 0, "numeric"), "s": (0, 0, "categorical")}
    assert profile.duplicate_count(df).first()[0] == 0
    assert eda.missing_counts(df).count() == 2
    assert distributions.top_values(df).count() == 0
    assert quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_duplicates_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), ("a", None), ("a", "a"), (None, None)], "x string, y string")
    assert profile.duplicate_count(df).first()[0] == 2


def test_samples_and_snapshot(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b"), (4, "d"), (5, "e")], "k int, v string")
    got = [(r["rank"], r["value"]) for r in profile.column_samples(df, order_by="k").filter("column = 'v'").orderBy("rank").collect()]
    assert got == [(1, "b"), (2, "c"), (3, "d")]
    snap = profile.schema_snapshot(df, "k").first()
    assert snap["target"] == "k" and snap["text"] == ["v"] and snap["rows"] == 5


def test_candidate_targets_keep_column_order(spark):
    rows = [(i, i * 2, "ab"[i % 2], "x") for i in range(12)]
    df = spark.createDataFrame(rows, "b int, a int, c string, d string")
    got = [(r["task"], r["rank"], r["column"]) for r in profile.candidate_targets(df).orderBy("task", "rank").collect()]
    assert got == [("classification", 1, "c"), ("regression", 1, "b"), ("regression", 2, "a")]


def test_top_values_ties_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("c",)], "s string")
    got = [(r["value"], r["n"], r["share"]) for r in distributions.top_values(df, 3).orderBy("rank").collect()]
    assert got == [("c", 2, 0.4), (None, 1, 0.2), ("a", 1, 0.2)]
    assert distributions.modes(spark.createDataFrame([("b",), ("a",)], "s string"), ["s"]) == {"s": "a"}
    assert distributions.modes(spark.createDataFrame([(None,)], "s string"), ["s"]) == {}


def test_correlations(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0, None, True), (2.0, 4.0, 5.0, 1.0, False), (3.0, 6.5, 5.0, 3.0, True), (None, 1.0, 5.0, 2.0, True)],
        "y double, x double, flat double, gap double, flag boolean",
    )
    got = {r["column"]: r["corr"] for r in eda.target_correlations(df, "y").collect()}
    assert got["x"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])
    assert got["flat"] is None and got["gap"] == pytest.approx(1.0) and "flag" in got
    assert [r["column"] for r in eda.leakage_columns(df, "y").orderBy("column").collect()] == ["gap", "x"]
    assert eda.target_correlations(df, "absent").count() == 0
    assert eda.correlation_matrix(df, ["y", "x", "flat"]).count() == 9


def test_outliers_need_spread(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in [1, 2, 3, 4, 100]], "a double, b double")
    got = {r["column"]: r["outliers"] for r in eda.iqr_outliers(df).collect()}
    assert got == {"a": 1, "b": 0}
    assert iqr_bounds(df, ["b"]) == {}


@pytest.mark.parametrize("kind", ["spread", "ties", "mixed"])
def test_wide_quantiles_are_exact(spark, kind):
    rng = random.Random(5)
    draw = {
        "spread": lambda: rng.gauss(0, 1),
        "ties": lambda: float(rng.randint(0, 60)),
        "mixed": lambda: 0.5 if rng.random() < 0.4 else rng.random(),
    }[kind]
    values = [draw() for _ in range(4001)]
    df = spark.createDataFrame([(v, -v) for v in values], "a double, b double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, ["a", "b"], probs)
    for name, sign in (("a", 1), ("b", -1)):
        assert got[name] == pytest.approx(list(np.quantile(sign * np.array(values), probs)), abs=1e-12)
