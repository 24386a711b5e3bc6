"""Splits whose strata are a table: the same split as with listed strata, and shares like the plain ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import split
from tablewright.session import cut_lineage


def rows(spark, n, classes, copies=False):
    i = F.col("id")
    kind = F.when(i % 3 == 0, "hot").when(i % 50 == 1, None).otherwise(F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(classes)).cast("string")))
    df = spark.range(n).select(i.alias("k"), kind.alias("kind"), (i % 7).alias("v"))
    return cut_lineage(df.drop("k") if copies else df)


@pytest.mark.parametrize("key", ["k", None])
@pytest.mark.parametrize("val_size", [0.1, 0.0])
def test_same_split_as_with_listed_strata(spark, monkeypatch, key, val_size):
    df = rows(spark, 4000, 60, copies=key is None)
    want = Counter(map(tuple, split.exact_split(df, 0.2, val_size, key, "kind").collect()))
    monkeypatch.setattr(split, "MAX_STRATA", 3)
    got = split.exact_split(df, 0.2, val_size, key, "kind")
    assert got.columns == [*df.columns, "split"] and Counter(map(tuple, got.collect())) == want


def test_small_classes(spark, monkeypatch):
    """Down to one row of a class after the test part, and a class with a single row."""
    for classes in (900, 3000):
        df = rows(spark, 3000, classes)
        want = Counter(map(tuple, split.exact_split(df, 0.2, 0.1, "k", "kind").collect()))
        with monkeypatch.context() as m:
            m.setattr(split, "MAX_STRATA", 3)
            assert Counter(map(tuple, split.exact_split(df, 0.2, 0.1, "k", "kind").collect())) == want


def test_repeated_key_fails(spark, monkeypatch):
    monkeypatch.setattr(split, "MAX_STRATA", 3)
    df = rows(spark, 400, 5).withColumn("k", F.lit(1))
    with pytest.raises(ValueError, match="unique key"):
        split.exact_split(df, 0.2, 0.1, "k", "kind")


def test_150_000_classes(spark):
    sizes = F.lit(2) + F.pmod(F.xxhash64("id"), F.lit(3))
    df = spark.range(150_000).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(1), sizes)).alias("i"))
    df = cut_lineage(df.withColumn("k", F.concat_ws("-", "c", "i")))
    counts = {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    n = sum(counts.values())
    order = sorted(counts)
    n_test, _ = split.split_sizes(n, 0.2, 0.0)
    keep = dict(zip(order, split.allocate([counts[c] for c in order], n - n_test)))
    got = split.exact_split(df, 0.2, 0.0, "k", "c").groupBy("c").agg(F.count(F.when(F.col("split") == "train", 1)).alias("n")).collect()
    assert len(got) == 150_000 and all(r["n"] == keep[r["c"]] for r in got)
