from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import clean, features, prep, split
from tablewright.operators.assemble import join_dimensions
from tablewright.operators.features import FeatureSpec, derive_features
from tablewright.operators.lookup import attach_share


def test_drop_columns_and_rows(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True), (2, None, "b", False), (3, 12345678.0, None, None)], "i int, x double, s string, b boolean")
    assert clean.drop_columns(df, "x, nope").columns == ["i", "s", "b"]
    keep = lambda rules: sorted(r["i"] for r in clean.drop_rows(df, rules).collect())
    assert keep([{"column": "s", "value": "a"}]) == [2, 3]
    assert keep([{"column": "s", "value": "nan"}]) == [1, 2]
    assert keep([{"column": "x", "value": "nan"}]) == [1, 3]
    assert keep([{"column": "x", "value": 12345678}]) == [1, 2]
    assert keep([{"column": "i", "value": "2"}, {"column": "b", "value": "True"}]) == [3]
    assert keep([{"column": "i", "value": "it's"}, {"column": "nope", "value": 1}]) == [1, 2, 3]


def test_fills_and_clip(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (None, 2.0), (9, 40.0), (4, 3.0), (5, 4.0)], "i bigint, x double")
    med = clean.fill_median(df).agg(F.sum("i"), F.sum("x")).first()
    assert med == (25.0, 53.0)
    mean = clean.fill_mean(df).filter("x = 10").count()
    assert mean == 1 and clean.fill_mean(df).schema["i"].dataType.typeName() == "double"
    clipped = clean.clip_iqr(df, ["x"])
    assert clipped.agg(F.max("x")).first()[0] == pytest.approx(4 + 1.5 * 2)
    assert clipped.filter("x IS NULL").count() == 1
    twice = clean.clip_iqr(clipped, ["x"])
    assert twice.agg(F.sum("x")).first() == clipped.agg(F.sum("x")).first()
    flat = spark.createDataFrame([(1.0,), (1.0,), (50.0,), (1.0,), (1.0,)], "x double")
    assert clean.clip_iqr(flat).agg(F.max("x")).first()[0] == 50.0


def test_mode_and_constant(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None), (None, None)], "s string, e string")
    out = clean.fill_mode(df, ["s", "e"])
    assert Counter(r["s"] for r in out.collect()) == {"a": 3, "b": 1}
    assert out.filter("e IS NULL").count() == 4
    assert clean.fill_constant(df, ["s"], "none").filter("s = 'none'").count() == 2


def test_chain(spark):
    rows = [("u", 1.0, "k", "d")] * 3 + [("v", None, None, "d"), ("w", 3.0, "k", "d"), (None, 9.0, "k", "d"), ("bad", 2.0, "k", "d")]
    df = spark.createDataFrame(rows, "t string, x double, c string, drop_me string")
    config = clean.CleanConfig(drop_columns=["drop_me"], drop_rows=[{"column": "t", "value": "bad"}], reason="r")
    found = clean.clean(df, config, target="t")
    assert sorted((r["t"], r["x"]) for r in found.data.collect()) == [("u", 1.0), ("v", 2.0), ("w", 3.0)]
    assert found.report.first() == (7, 3, "r")
    with pytest.raises(ValueError):
        clean.CleanConfig(numeric_fill="max")


def test_feature_kinds(spark):
    df = spark.createDataFrame(
        [(4.0, 2.0, "a  b", "2024-01-01", None), (1.0, 0.0, None, "bad", "x")], "a double, b double, s string, d string, m string"
    )
    specs = [
        FeatureSpec("r", "ratio", ["a", "b"]),
        FeatureSpec("l", "text_length", ["s"]),
        FeatureSpec("w", "text_word_count", ["s"]),
        FeatureSpec("dow", "date_part", ["d"], "dayofweek"),
        FeatureSpec("m1", "is_missing", ["m"]),
        FeatureSpec("f", "category_frequency", ["m"]),
    ]
    out, names = derive_features(df, specs)
    rows = {r["a"]: r for r in out.collect()}
    assert names == ["r", "l", "w", "dow", "m1", "f"]
    assert rows[4.0]["r"] == 4.0 / (2.0 + 1e-6) and rows[1.0]["r"] is None
    assert (rows[4.0]["l"], rows[4.0]["w"], rows[4.0]["dow"], rows[4.0]["m1"], rows[4.0]["f"]) == (4, 2, 0, 1, 0.5)
    assert (rows[1.0]["l"], rows[1.0]["w"], rows[1.0]["dow"], rows[1.0]["m1"]) == (0, 0, None, 0)
    guard = [FeatureSpec("z", "ratio", ["a", "b"], denominator_guard=-2.0)]
    assert {r["a"]: r["z"] for r in derive_features(df, guard)[0].collect()}[4.0] is None


def test_feature_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0, "s")], "a double, b double, s string")
    specs = [
        FeatureSpec("late", "sum", ["c", "a"]),
        FeatureSpec("a", "sum", ["b", "b"]),
        FeatureSpec("t", "sum", ["a", "y"]),
        FeatureSpec("c", "product", ["a", "b"]),
        FeatureSpec("e", "sum", ["c", "a"]),
    ]
    levels = features.plan_levels(df.columns + ["y"], specs, "y")
    assert [[s.name for s in level] for level in levels] == [["c"], ["e"]]
    with pytest.raises(ValueError):
        derive_features(df, [FeatureSpec("x", "sum", ["nope", "a"])])
    with pytest.raises(ValueError):
        derive_features(df, [FeatureSpec("x", "sum", ["s", "a"])])


def test_frequency_beyond_the_broadcast_limit(spark):
    rows = [("hot", i) for i in range(200)] + [(f"k{i % 40}", i) for i in range(80)] + [(None, i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i int")
    few = attach_share(df, "k", "f")
    many = attach_share(df, "k", "f", limit=5)
    want = Counter((r["k"], r["f"]) for r in few.collect())
    assert Counter((r["k"], r["f"]) for r in many.collect()) == want
    assert want[("hot", 200 / 300)] == 200 and want[(None, 20 / 300)] == 20


def test_split_sizes_and_membership(spark):
    df = spark.range(101).withColumn("x", F.col("id") % 3)
    out = split.exact_split(df, key="id")
    assert {r["split"]: r["rows"] for r in split.split_manifest(out).collect()} == {"test": 21, "val": 10, "train": 70}
    assert out.select("id").distinct().count() == 101
    assert out.exceptAll(split.exact_split(df, key="id")).count() == 0
    assert out.exceptAll(split.exact_split(df, key="id", seed=7)).count() > 0
    assert split.parts(out, "train", "val").count() == 80


def test_split_of_equal_rows(spark):
    rows = [("same",)] * 70 + [(f"r{i}",) for i in range(30)]
    out = split.exact_split(spark.createDataFrame(rows, "s string"), 0.25, 0.15)
    assert {r["split"]: r["rows"] for r in split.split_manifest(out).collect()} == {"test": 25, "val": 15, "train": 60}
    assert out.filter("s = 'same'").count() == 70 and out.select("s").distinct().count() == 31
    all_same = split.exact_split(spark.createDataFrame([("same",)] * 10, "s string"), 0.2, 0.1)
    assert {r["split"]: r["rows"] for r in split.split_manifest(all_same).collect()} == {"test": 2, "val": 1, "train": 7}
    with pytest.raises(ValueError):
        split.exact_split(spark.createDataFrame([("same", i) for i in range(10)], "s string, i int"), key="s")


def test_split_leaves_columns_alone(spark):
    df = spark.createDataFrame([(i, i, i, i, i) for i in range(20)], "s int, h int, label int, n int, prefix int")
    out = split.exact_split(df, key="s")
    assert out.columns == [*df.columns, "split"] and out.drop("split").exceptAll(df).count() == 0


def test_stratified_split(spark):
    rows = [(i, "a" if i < 60 else "b" if i < 90 else "c") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, c string")
    out = split.exact_split(df, key="id", stratify="c")
    got = Counter((r["c"], r["split"]) for r in out.collect())
    assert (got["a", "test"], got["b", "test"], got["c", "test"]) == (12, 6, 2)
    assert (got["a", "val"], got["b", "val"], got["c", "val"]) == (6, 3, 1)
    lonely = spark.createDataFrame([(i, "a" if i else "b") for i in range(50)], "id int, c string")
    assert split.split_manifest(split.exact_split(lonely, key="id", stratify="c")).count() == 3
    # A class of two keeps one row for training: validation is then drawn without strata.
    pair = spark.createDataFrame([(i, "b" if i < 2 else "a") for i in range(20)], "id int, c string")
    sizes = {r["split"]: r["rows"] for r in split.split_manifest(split.exact_split(pair, 0.5, 0.25, "id", "c")).collect()}
    assert sizes == {"test": 10, "val": 5, "train": 5}
    with pytest.raises(ValueError):
        split.split_sizes(2, 0.5, 0.4)
    # Sizes are rounded up from the plain float product, 70 * (0.2 / 0.7) included.
    assert split.split_sizes(100, 0.3, 0.2) == (30, 21)


def test_split_needs_no_global_order(spark):
    out = split.exact_split(spark.range(100), key="id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan and "Exchange" not in plan


def test_preprocessing(spark):
    train = spark.createDataFrame([(1.0, "b", True), (3.0, "a", False), (None, None, True), (5.0, "a", True)], "x double, c string, f boolean")
    roles = {"x": "numeric", "c": "categorical", "f": "categorical"}
    fitted = prep.fit_preprocessor(train, roles=roles)
    assert (fitted.numeric, fitted.categorical) == (["x", "f"], ["c"])
    other = spark.createDataFrame([(3.0, "new", None), (3.0, "b", False)], train.schema)
    rows = [r["v"] for r in fitted.model.transform(other).select(vector_to_array("features").alias("v")).collect()]
    assert len(rows[0]) == 4 and rows[0][0] == 0.0 and rows[0][2:] == [0.0, 0.0] and rows[1][2:] == [0.0, 1.0]
    scaled = prep.standardize(train, ["x"]).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert scaled[0] == pytest.approx(0) and scaled[1] == pytest.approx(1)
    with pytest.raises(ValueError):
        prep.fit_preprocessor(train.select(F.lit(None).cast("string").alias("e")), roles={"e": "categorical"})


def test_only_levels_and_possible_identifiers_are_counted(spark, monkeypatch):
    """Numbers, booleans and times have their role by type: a fit does not count their values."""
    rows = [(i, i, i * 0.5, float(i % 7), i % 2 == 0, "ab"[i % 2], "c", i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "order_id int, number_x int, price double, y double, f boolean, c string, `d.e` string, size int")
    df = df.withColumns({"day": F.lit("2024-01-01").cast("date"), "none": F.lit(None)})
    seen = []
    monkeypatch.setattr(prep, "value_counts", lambda t, f=prep.value_counts: seen.append(t.columns) or f(t))
    fitted = prep.fit_preprocessor(df, "y")
    assert (fitted.numeric, fitted.categorical) == (["price", "f", "size"], ["c", "d.e"])
    assert seen == [["order_id", "number_x", "c", "d.e", "none"]]
    numbers = prep.fit_preprocessor(df.select("price", "size", "y"), "y")
    assert (numbers.numeric, numbers.categorical, len(seen)) == (["price", "size"], [], 1)


def test_label_codes_follow_numeric_order(spark):
    df = spark.createDataFrame([(10,), (2,), (2,)], "y int")
    classes = prep.label_classes(df, "y")
    assert classes == [2, 10]
    assert sorted(r["label"] for r in prep.encode_labels(df, "y", classes).collect()) == [0.0, 0.0, 1.0]
    with pytest.raises(Exception, match="unseen label"):
        prep.encode_labels(spark.createDataFrame([(3,)], "y int"), "y", classes).collect()


def test_join_dimensions(spark):
    fact = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    assert sorted(join_dimensions(fact, [(dim, "k", "id")]).collect()) == [(1, "x", "one"), (2, "y", "two")]


def test_many_classes_are_numbered(spark):
    from pyspark.sql import functions as F

    from tablewright.operators.prep import class_codes, encode_labels

    df = spark.range(150_000).select(((F.col("id") * 7919) % 150_000 * 3).alias("k"))
    codes = class_codes(df, "k")
    coded = encode_labels(df, "k", codes, "code")
    assert coded.filter("code * 3 <> k").count() == 0 and coded.count() == 150_000


def test_quantiles_of_few_heavy_values(spark):
    from tablewright.operators.quantiles import quantiles

    df = spark.range(6_000).selectExpr("cast(id % 2 as double) v", "cast(id as double) w")
    assert quantiles(df, ["v", "w"], [0.5]) == {"v": [0.5], "w": [2999.5]}
