"""The URL filter over many ranges: every range must start with what is open there."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.llm import queries, url_filter

HOSTS = ["a.b.example.org", "example.org", "shop.example.org", "org", "x.com", "deep.x.com", "com", "y.net", "notexample.org", "news.co"]
PATHS = ["/", "/es/1", "/es", "/en/12", "/en/2", "/fr/a", "/fr/", "/de/b", "/de", "/zz", "", "/fr/b/c"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """120,000 URLs, a third of them of one host."""
    i = F.col("id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))
    host = F.when(i % 3 == 0, "hot.example.org").otherwise(F.concat(F.lit("h"), F.pmod(F.hash("id"), F.lit(4000)), F.lit("."), pick(HOSTS, i * 7)))
    df = spark.range(120_000).select(
        i.alias("page_id"), F.concat(F.lit("https://"), host, pick(PATHS, i * 5 + 1), F.when(i % 11 == 0, "?q=1").otherwise("")).alias("url")
    )
    path = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    df.write.parquet(path)
    return path


@pytest.mark.parametrize("partitions", [8, 64, 200])
def test_ranges_agree_with_sql(spark, pages, partitions):
    rules = url_filter.rules_table(spark, queries.URL_RULES)
    got = url_filter.judge_urls(spark.read.parquet(pages), rules, partitions=partitions)
    plan = got._jdf.queryExecution().toString()
    assert "rangepartitioning(key" not in plan  # the ranges are fixed in the written table
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{pages}/*.parquet'")
    want = db.sql(queries.ORACLE["op2_url_filter"]).fetchall()
    same = lambda rows: sorted(tuple("" if x is None else x for x in r) for r in rows)
    assert same(map(tuple, got.collect())) == same(want)


def test_host_with_many_labels(spark):
    host = ".".join(["l"] * 130) + ".org"
    urls = spark.createDataFrame([(1, f"x://a.{host}/p"), (2, "x://org/p")], "page_id bigint, url string")
    rules = url_filter.rules_table(spark, [("block", host, "/"), ("allow", "org", "/")])
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(urls, rules).collect()}
    assert got == {1: "block", 2: "allow"}
