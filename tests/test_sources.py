import pytest

from tablewright.plans import registry
from tablewright.session import scratch_path, shared_dir
from tablewright.sources.artifacts import read_artifact, write_artifact
from tablewright.sources.csv import header_names, quoted_records, read_csv, sniff_delimiter
from tablewright.sources.tables import read_split, write_splits, write_stage


def csv_file(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimiter_needs_a_majority():
    assert sniff_delimiter("a;b;c,d") == ";"
    assert sniff_delimiter("a;b,c") == ","
    assert sniff_delimiter("a") == ","


def test_header_names_are_unique():
    assert header_names('a,a,,"x,y"', ",") == ["a", "a.1", "Unnamed: 2", "x,y"]


def test_types(spark, tmp_path):
    text = "i;f;b;s;g;e;big;mix\n1;1.5;True;x;1;;99999999999999999999;1\nNA;2;false;NA;;;1;True\n-3;1e3;;y;3;;2;x\n"
    df = read_csv(spark, csv_file(tmp_path, text))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    assert types == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "g": "bigint", "e": "double", "big": "double",
        "mix": "string",
    }
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, None, -3]
    assert [r["s"] for r in rows] == ["x", None, "y"]
    assert rows[2]["f"] == 1000.0 and rows[2]["b"] is None


def test_quotes_and_doubled_quotes(spark, tmp_path):
    df = read_csv(spark, csv_file(tmp_path, 'a,b\n"x,1","say ""hi"""\n'))
    assert df.collect()[0] == ("x,1", 'say "hi"')


def test_empty_and_header_only(spark, tmp_path):
    assert read_csv(spark, csv_file(tmp_path, "\n1,2\n")).columns == []
    assert read_csv(spark, csv_file(tmp_path, "")).columns == []
    df = read_csv(spark, csv_file(tmp_path, "a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0


def test_stage_split_and_artifact(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "a int, split string")
    assert write_stage(df, f"{tmp_path}/stage").count() == 3
    assert write_stage(df, f"{tmp_path}/stage_csv", "csv").orderBy("a").first()["a"] == 1
    assert write_splits(df, f"{tmp_path}/splits").count() == 3
    assert sorted(r[0] for r in read_split(spark, f"{tmp_path}/splits", "val", "test").collect()) == [2, 3]
    odd = spark.createDataFrame([("x", float("nan"), None)], "k string, v double, w string")
    write_artifact(odd, f"{tmp_path}/art")
    assert read_artifact(spark, f"{tmp_path}/art", odd.schema).collect() == [("x", None, None)]
    assert read_artifact(spark, f"{tmp_path}/none", "a int", default=df).count() == 3
    with pytest.raises(FileNotFoundError):
        read_artifact(spark, f"{tmp_path}/none", "a int")


def test_shared_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_dir(spark)
    assert folder and (named is None or folder == named)
    assert scratch_path(spark, "x").startswith(folder)


def test_registry(spark, tmp_path):
    path = f"{tmp_path}/registry"
    empty = registry.read_registry(spark, path)
    asked = spark.createDataFrame([("regression", "y")], "task_type string, target string")
    assert registry.status(empty, asked).first()["status"] == "empty"
    from datetime import datetime

    base = {"task_type": "regression", "target": "y", "model_name": "m", "model_path": "p"}
    for i, score in enumerate([-3.0, -1.0, -1.0, -2.0]):
        registry.append_run(spark, path, {**base, "run_id": f"r{i}", "created_at": datetime(2024, 1, 1 + i), "rank_score": score})
    registry.append_run(spark, path, {**base, "run_id": "c", "created_at": datetime(2024, 1, 1), "task_type": "clustering", "target": None, "rank_score": 0.5})
    runs = registry.read_registry(spark, path)
    best = {(r["task_type"], r["target"]): r["run_id"] for r in registry.best_runs(runs).collect()}
    assert best == {("regression", "y"): "r1", ("clustering", None): "c"}
    assert registry.status(runs, asked).first()["status"] == "loaded"
    other = spark.createDataFrame([("regression", "z")], "task_type string, target string")
    assert registry.status(runs, other).first()["status"] == "incompatible"
    tries = spark.createDataFrame(
        [("regression", "y", -1.0), ("regression", "y", -0.5), ("clustering", None, 0.4), ("regression", "z", -9.0)],
        "task_type string, target string, rank_score double",
    )
    better = {(r["task_type"], r["target"], r["rank_score"]): r["is_better"] for r in registry.improvements(runs, tries).collect()}
    assert list(better.values()).count(True) == 2
    assert better["regression", "y", -0.5] and better["regression", "z", -9.0]


def test_quoted_line_breaks_are_found(spark, tmp_path):
    df = read_csv(spark, csv_file(tmp_path, 'id,t\n1,"line one\nline two, ""quoted"""\n2,plain\n'))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'line one\nline two, "quoted"'), (2, "plain")]
    assert df.schema["id"].dataType.simpleString() == "bigint"


def test_ragged_rows(spark, tmp_path):
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv(spark, csv_file(tmp_path, "a,b\n1,2\n1,2,EXTRA\n"), infer=False).count()
    assert read_csv(spark, csv_file(tmp_path, "a,b\n1\n")).first()["b"] is None


def test_csv_stage_keeps_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a\n"b", c '), (2, "plain")], "i int, t string")
    assert write_stage(df, f"{tmp_path}/s", "csv").orderBy("i").collect() == df.collect()


def test_record_run(spark, tmp_path):
    run = {"run_id": "a", "created_at": None, "task_type": "regression", "target": "y", "model_name": "m", "rank_score": 1.0}
    path = f"{tmp_path}/runs"
    assert registry.record_run(spark, path, run) == ("empty", True)
    assert registry.record_run(spark, path, {**run, "run_id": "b", "rank_score": 0.5}) == ("loaded", False)
    assert registry.record_run(spark, path, {**run, "run_id": "c", "target": "z"}) == ("incompatible", True)
    assert registry.read_registry(spark, path).count() == 3


def odd_csv(tmp_path, n):
    import csv
    import random

    r = random.Random(n)
    rows = [(i, "".join(r.choice(["a", '"', ",", "\n", "\r\n", " ", "é"]) for _ in range(r.randrange(30)))) for i in range(n)]
    with open(tmp_path / "odd.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["id", "te\nxt"])
        out.writerows(rows)
    return str(tmp_path / "odd.csv"), rows


@pytest.mark.parametrize("size", [97, 1_500, 1 << 20])
def test_quoted_breaks_in_any_byte_range(spark, tmp_path, size):
    """One file read in many byte ranges, most of which begin within quotes or within a record."""
    path, rows = odd_csv(tmp_path, 60 if size < 100 else 700)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        df = read_csv(spark, path)
        assert df.columns == ["id", "te\nxt"] and df.schema["id"].dataType.simpleString() == "bigint"
        assert sorted(map(tuple, df.collect())) == [(i, t if t.strip() or t else None) for i, t in rows]
        ranges = quoted_records(spark, path).count()
        assert ranges == len(rows) + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quoted_breaks_in_several_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text(f'a,"b\nc"\n{k},"x\ny{k}"\n{k + 10},z\n\n', encoding="utf-8")
    df = read_csv(spark, str(folder))
    assert df.columns == ["a", "b\nc"]
    assert sorted(map(tuple, df.collect())) == [(0, "x\ny0"), (1, "x\ny1"), (2, "x\ny2"), (10, "z"), (11, "z"), (12, "z")]
    with pytest.raises(Exception, match="more than 1 fields"):
        read_csv(spark, csv_file(tmp_path, 'a\n"x\ny",1\n'), infer=False).count()
