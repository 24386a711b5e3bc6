"""The pipeline against a plain version of every stage, and the registered queries against their SQL."""

import collections
import math


import duckdb
import pytest
from test_operators import alnum, blank, check_pieces, components, shingles, without_repeats

import corpus_pipeline
from tablewright.llm import quality, queries


def histograms(text):
    chars = collections.Counter()
    for c in text or "":
        b = c.encode()[0]
        if quality.CLASSES[b]:
            chars[int(quality.CLASSES[b])] += 1
    known = {w for words in quality.COMMON_WORDS.values() for w in words.split()}
    return chars, collections.Counter(w if w in known else None for w in alnum(text))


def distance(p, q):
    a, b = sum(p.values()), sum(q.values())
    if not a:
        return 1.0
    total = 0.0
    for k in p.keys() | q.keys():
        x, y = p[k] / a, q[k] / b
        total += 0.5 * sum(v * math.log2(v / ((x + y) / 2)) for v in (x, y) if v)
    return math.sqrt(max(total, 0))


def brute_quality(docs):
    refs = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    for _, t, lang in docs:
        if lang in quality.COMMON_WORDS:
            for have, new in zip(refs[lang], histograms(t)):
                have.update(new)
    out = []
    for i, t, lang in docs:
        w = blank(t)
        count = collections.Counter(zip(w, w[1:], w[2:]))
        repeat = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
        if len(w) < 50 or 100 * len(repeat) > 50 * len(w):
            continue
        chars, words = histograms(t)
        c, d = min(((distance(chars, a), distance(words, b)) for a, b in refs.values()), key=sum)
        if c <= quality.MOST_CHAR_DISTANCE and d <= quality.MOST_WORD_DISTANCE + 1 / math.sqrt(len(w)):
            out.append((i, t))
    return out


def test_pipeline_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    plain = brute_quality([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()])
    stages = dict(corpus_pipeline.STAGES)
    same = lambda df, rows: collections.Counter((r["doc_id"], r["text"]) for r in df.collect()) == collections.Counter(rows)

    docs = stages["quality_rules"](spark, docs, small)
    assert docs.columns == columns and same(docs, plain)
    plain = without_repeats(plain)
    docs = stages["line_dedup"](spark, docs, small)
    assert docs.columns == columns and same(docs, plain)
    assert docs.filter("n_chars <> length(text)").count() == 0
    groups = components([shingles(t) for _, t in plain])
    best = {}
    for (i, t), g in zip(plain, groups):
        best[g] = min(best.get(g, (i, t)), (i, t))
    plain = list(best.values())
    docs = stages["near_dedup"](spark, docs, small)
    assert docs.columns == columns and same(docs, plain)
    bench = [alnum(t) for (t,) in duckdb.execute(f"SELECT text FROM '{small}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[k : k + 10]) for w in bench for k in range(max(len(w) - 9, min(len(w), 1)))}
    sizes = {len(w) for w in windows}
    leaks = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    plain = [(i, t) for i, t in plain if not leaks(alnum(t))]
    docs = stages["decontamination"](spark, docs, small)
    assert docs.columns == columns and same(docs, plain)
    check_pieces(stages["packing"](spark, docs, small).collect(), plain)

    ran = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in ran.collect()} == {i for i, _ in plain}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    result = con.execute(queries.ORACLE[name])
    names = [c[0] for c in result.description]
    want = collections.Counter(map(tuple, result.fetchall()))
    assert collections.Counter(map(tuple, queries.QUERIES[name](spark, small).select(*names).collect())) == want


def test_contract_columns(spark, small):
    """Every query gives one row for each row of its table, and what its digest columns promise."""
    texts = dict(duckdb.execute(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())
    for name in ("op1_minhash", "op3_quality_rules", "op4_decontaminate", "op5_secret_scan", "op8_toxicity", "op9_line_dedup", "op10_license_scan"):
        got = queries.QUERIES[name](spark, small).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:  # the license scan
        w = alnum(texts[r["doc_id"]])
        places = [k for p in ("mit license", "apache license", "general public license") for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(places, default=None), max(places, default=None))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
