"""Periodic runs, the Merkle manifest and token counts: brute force, recomputed trees, cache hits, and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablewright.llm import manifest, periodic_runs, queries, token_counts
from tablewright.session import scratch_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ", row string, part int, key int, place int, rank int, digest string, m int, content int, hot int, runs int, leaf string"
BLANK = r"[^\x20\x09-\x0D]+"


def table(spark, data):
    return spark.createDataFrame([(*r, "r", 1, 2, 3, 4, "d", 5, 6, 7, 8, "l") for r in data], DOCS + CLASH)


def texts():
    words = [random.Random(4).choice("abcdefg") for _ in range(300)]
    out = ["", None, " \n\t ", "one", "a a a a a a", "a a a a a", "x " * 9, "a b " * 4 + "a", "a b c " * 3, "a b c " * 4 + "a b", " ".join(words)]
    out += ["q w e r t y " * 5 + "é " * 7 + "tail", "la\x1cla la\x85la 　 " * 8, "z " * 3 + "aab " * 200 + "aab aac " * 50, "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|>"]
    out += [" ".join(random.Random(k).choice("abc") for _ in range(60 + k)) for k in range(12)] + ["long " + "word" * 40_000, "ab ba " * 30_000]
    return out


def rows():
    found = [(i * 7 if i != 5 else None, t, ["en", None, "de"][i % 3], ["s", None, "é", "a"][i % 4], None if i == 2 else i) for i, t in enumerate(texts() * 2)]
    return [*found, found[7], found[7]]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, rows()).repartition(5)


def brute_runs(w, least=6, exponent=4):
    found, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_groups_brute_force():
    r = random.Random(9)
    for _ in range(1500):
        s = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randrange(30))]
        lengths, groups = periodic_runs.lyndon_groups(s)
        for i in range(len(s)):
            j = i + 1
            while j < len(s) and s[j:] > s[i:]:
                j += 1
            assert lengths[i] == j - i
        words = [tuple(s[i : i + k]) for i, k in enumerate(lengths)]
        assert all((groups[i] == groups[j]) == (words[i] == words[j]) for i in range(len(s)) for j in range(i))


@pytest.mark.parametrize("least,exponent", [(6, 4), (1, 3), (9, 5), (6, 3)])
def test_runs_brute_force(least, exponent):
    r = random.Random(least * 10 + exponent)
    for _ in range(1500):
        s = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(45))]
        if s and r.random() < 0.5:
            a, p = r.randrange(len(s)), r.randrange(1, len(s) // 2 + 2)
            s = [s[i] if i < a else s[min(a + (i - a) % p, len(s) - 1)] for i in range(len(s))]
        assert periodic_runs.find_runs(np.array(s, np.int32), least, exponent) == brute_runs(s, least, exponent)


def test_long_run_is_quick():
    words = np.r_[np.arange(500), np.tile(np.arange(3), 60_000), np.tile(np.arange(9_000), 6)].astype(np.int32)
    got = periodic_runs.find_runs(words)
    assert (500, 180_003, 3) in [(a, n, q) for a, n, q in got] or any(q == 3 and n >= 180_000 for _, n, q in got)
    assert any(q == 9_000 and n >= 54_000 for _, n, q in got)


def test_periodic_runs_of_texts(docs):
    got = periodic_runs.periodic_runs(docs).collect()
    want = collections.Counter()
    for i, t, *_ in rows():
        w = re.findall(BLANK, t or "")
        found = brute_runs(w) if len(w) < 1000 else [(0, len(w), 2)] if w[0] == "ab" else None
        if found is None:
            continue
        dropped = {k for a, n, q in found for k in range(a + q, a + n)}
        want[i, len(w), tuple(found), " ".join(x for k, x in enumerate(w) if k not in dropped)] += 1
    seen = collections.Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in got)
    assert sum(seen.values()) == len(rows()) and all(seen[k] == n for k, n in want.items())
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, least_exponent=2)


def test_periodic_runs_query(spark, small):
    """The whole query, its rewritten texts included, on all documents with at most 400 words."""
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, small).collect()}
    data = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(data)
    for i, t in data:
        w = re.findall(BLANK, t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        if n > 400:
            continue
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        dropped = {k for a, m, q in found for k in range(a + q, a + m)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[i]) == (
            i, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{a},{m},{q}\n" for a, m, q in found)),
            sha(" ".join(x for k, x in enumerate(w) if k not in dropped)),
        )


def tree(nodes):
    """The root of a list of digests, and the siblings (left, right) of every node on every level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, proof in enumerate(proofs):
            run = at[i] // 16 * 16
            proof.append(("".join(nodes[run : at[i]]), "".join(nodes[at[i] + 1 : run + 16])))
        nodes = [hashlib.sha256("".join(nodes[k : k + 16]).encode()).hexdigest() for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], proofs


def plain_manifest(data):
    leaf = lambda r: hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r).encode()).hexdigest()
    parts = collections.defaultdict(list)
    for i, t, lang, source, n in data:
        parts[source].append((i is not None, i or 0, leaf((i, source, lang, n, t)), i))
    parts = {s: sorted(v) for s, v in parts.items()}
    order = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in v]) for s, v in parts.items()}
    root, above = tree([trees[s][0] for s in order])
    return collections.Counter(
        (x[3], s, x[2], trees[s][0], root, tuple(trees[s][1][k] + above[order.index(s)])) for s, v in parts.items() for k, x in enumerate(v)
    )


def many():
    """Sources of 1, 15, 16, 17, 256, 257, 4097 and 300 other sources with one row."""
    data = [(f"n{n}", n) for n in (1, 2, 15, 16, 17, 255, 256, 257, 4097)] + [(f"x{k:03d}", 1) for k in range(300)]
    return [(i * 3 - 5, f"t{i}", None, s, n) for s, n in data for i in range(n)]


@pytest.mark.parametrize("data", [rows(), many()], ids=["odd", "many"])
def test_manifest_recomputed(spark, data):
    got = manifest.manifest(table(spark, data).repartition(5), queries.FIELDS).withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof"))).collect()
    proof = lambda p: tuple((bytes(s["left"]).decode(), bytes(s["right"]).decode()) for s in p)
    seen = collections.Counter((r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], proof(r["proof"])) for r in got)
    assert seen == plain_manifest(data)
    assert all(r["folded"] == r["root"] for r in got)


def test_manifest_empty_and_carry(spark, docs):
    assert manifest.manifest(docs.limit(0), queries.FIELDS).count() == 0
    got = manifest.manifest(docs, ["text"], group="lang", order="doc_id", carry=["place", "m"])
    assert got.columns == ["doc_id", "lang", "place", "m", "leaf", "subroot", "root", "proof"] and got.count() == len(rows())
    assert {(r["place"], r["m"]) for r in got.collect()} == {(3, 5)}


def test_manifest_crc_in_sql():
    sql = f"SELECT doc_id, {queries._CRC} FROM (SELECT unnest([0, 7, 123456789, -45]) AS doc_id), (SELECT {queries._CRC_TABLE} AS crc_table)"
    assert all(crc == zlib.crc32(str(i).encode()) for i, crc in duckdb.sql(sql).fetchall())


ODD = [*"abAB 'sS.,09éİΣσßK中 　\t\n\r\x0b\x0c\x1c\x1d\x85̇‍😀<|>-", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'ll", "ﬁ", "  "]


def library(name):
    if name.endswith(".model"):
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        return lambda t: len(found.encode(t))
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: len(found.encode(t, add_special_tokens=False).ids)


def test_word_counts_equal_whole_texts():
    count, r = library("word_bpe_49k.json"), random.Random(3)
    made = ["".join(r.choice(ODD) for _ in range(r.randrange(40))) for _ in range(4000)]
    fast = token_counts.Tokenizer(public_tokenizers.path("word_bpe_49k.json"), True)
    want = [count(t) for t in made]
    assert fast.counts(made) == want and fast.counts(made) == want
    # Normalised content has the same count.
    assert [count(re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ")) for t in made] == want


def test_blocks_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 10)
    raw = b"aa bb\tcc" * 9 + b"x" * 50 + b"\n yy  "
    parts = list(token_counts.blocks(raw))
    assert b"".join(parts) == raw and len(parts) > 3
    assert [w for p in parts for w in p.split()] == raw.split()


@pytest.mark.parametrize("name,apart", [("word_bpe_49k.json", True), ("word_bpe_49k.json", False), ("byte_bpe_50k.json", False), ("piece_bpe_32k.model", False)])
def test_token_counts(docs, name, apart):
    data = [r for r in rows() if len(r[1] or "") < 10_000]
    count = library(name)
    got = token_counts.count_tokens(docs.filter("text is null or length(text) < 10000"), public_tokenizers.path(name), blank_apart=apart).collect()
    want = collections.Counter((i, len((t or "").encode()), count(t or "")) for i, t, *_ in data)
    assert collections.Counter(map(tuple, got)) == want


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_cache_encodes_only_misses(spark, docs, monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    cache, path = scratch_path(spark, "cache"), lambda: public_tokenizers.path("word_bpe_49k.json")
    some = docs.filter("doc_id < 100")
    different = lambda df: len({" ".join(re.findall(BLANK, r["text"] or "")) for r in df.collect()})
    first = token_counts.fill_cache(some, cache, path, blank_apart=True)
    assert first == different(some)
    assert token_counts.fill_cache(some, cache, path, blank_apart=True) == 0
    whole = token_counts.count_tokens(docs, path, cache=cache, blank_apart=True).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == different(docs) > first
    plain = token_counts.count_tokens(docs, path, blank_apart=True).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, plain))
    # A stored count is used, not made anew; another tokenizer version does not see it.
    version = token_counts.tokenizer(path(), True).digest
    fake = scratch_path(spark, "cache")
    stored.select("content", F.lit(-1).cast("bigint").alias("n_tokens"), F.lit(version).alias("tokenizer")).write.partitionBy("tokenizer").parquet(fake)
    assert {r["n_tokens"] for r in token_counts.count_tokens(docs, path, cache=fake, blank_apart=True).collect()} == {-1}
    other = token_counts.count_tokens(some, public_tokenizers.path("byte_bpe_50k.json"), cache=fake)
    assert other.filter("n_tokens < 0").count() == 0


def test_token_counts_empty_table(docs):
    got = token_counts.count_tokens(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), blank_apart=True)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"] and got.count() == 0
