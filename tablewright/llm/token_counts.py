"""Token counts behind a digest cache.

A text is looked up by two digests: that of its normalised content and that of the tokenizer's version. Only
different contents that the cache does not hold are encoded, once each, and appended to it; every row then takes its
count from the cache by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from ._words import pieces

CACHE_SCHEMA = "content binary, n_tokens bigint, tokenizer string"
#: Different words whose counts a worker remembers, and the longest word, in bytes, that it does.
REMEMBERED, LONGEST = 1 << 20, 64
#: Bytes of text that are cut into words at once.
BLOCK = 1 << 20
#: Contents with more than this share of all rows are hot; there are fewer than its inverse.
HOT_SHARE = 0.001
#: Missing contents that are few enough to be broadcast as a filter (40 bytes each).
FEW = 200_000


class Tokenizer:
    """Counts ids as the library of a vocabulary file gives them: ``tokenizers`` for .json, ``sentencepiece`` for .model.

    No begin, end or other added ids, no truncation or padding; special strings inside a text are handled as the
    library does by default. With ``blank_apart`` the tokenizer must drop ASCII white space and never join text across it:
    then the words between are counted one by one, and each different word is encoded once and remembered.
    """

    def __init__(self, path: str, blank_apart: bool) -> None:
        self.blank_apart, self.memory = blank_apart, {}
        with open(path, "rb") as f:
            vocabulary = hashlib.sha256(f.read()).hexdigest()
        if path.endswith(".model"):
            import sentencepiece

            library, found = "sentencepiece", sentencepiece.SentencePieceProcessor(model_file=path)
            self._sizes = lambda texts: [len(ids) for ids in found.encode(texts, num_threads=1)]
        else:
            import tokenizers

            library, found = "tokenizers", tokenizers.Tokenizer.from_file(path)
            found.no_truncation()
            found.no_padding()
            self._sizes = lambda texts: [len(e.ids) for e in found.encode_batch_fast(texts, add_special_tokens=False)]
        self.digest = hashlib.sha256(f"{library} {version(library)} {vocabulary} {blank_apart}".encode()).hexdigest()

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text; the memory also holds all different words of ``texts`` meanwhile."""
        if not self.blank_apart:
            return self._sizes(texts)
        memory, raws = self.memory, [t.encode() for t in texts]
        if len(memory) > REMEMBERED:
            memory.clear()
        new: set[bytes] = set()
        for raw in raws:
            for block in blocks(raw):
                new.update(filterfalse(memory.__contains__, block.split()))
        words = list(new)
        memory.update(zip(words, self._sizes([w.decode() for w in words])))
        sizes = [sum(sum(map(memory.__getitem__, block.split())) for block in blocks(raw)) for raw in raws]
        for w in words:
            if len(w) > LONGEST:
                del memory[w]
        return sizes


def blocks(raw: bytes) -> Iterator[bytes]:
    """``raw`` in parts of about ``BLOCK`` bytes, cut in front of ASCII white space."""
    start = 0
    while len(raw) - start > BLOCK:
        ends = [i for i in (raw.find(b, start + BLOCK) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0]
        if not ends:
            break
        yield raw[start : min(ends)]
        start = min(ends)
    yield raw[start:]


_TOKENIZERS: dict[tuple[str, bool], Tokenizer] = {}


def tokenizer(path: str, blank_apart: bool) -> Tokenizer:
    """This worker's tokenizer, so that tasks that follow in one worker share its memory."""
    if (path, blank_apart) not in _TOKENIZERS:
        _TOKENIZERS[path, blank_apart] = Tokenizer(path, blank_apart)
    return _TOKENIZERS[path, blank_apart]


def content_digest(text: Column, blank_apart: bool) -> Column:
    """SHA-256 of the normalised content.

    Normalising must not change a count: runs of ASCII white space become one blank where the tokenizer drops them
    anyway, and nothing changes otherwise. Null is the empty text.
    """
    whole = F.coalesce(text, F.lit(""))
    normal = F.trim(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", " ")) if blank_apart else whole
    return F.unhex(F.sha2(normal, 256))


def read_cache(spark: SparkSession, folder: str, version_digest: str) -> DataFrame:
    """``(content, n_tokens)`` of one tokenizer version; empty when there is no cache yet.

    Two runs that append at once may both store a content, with the same count; it is given once.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).drop("tokenizer")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(folder).filter(F.col("tokenizer") == version_digest)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(
    texts: DataFrame, cache: str, tokenizer_path: str | Callable[[], str], *, blank_apart: bool, digests: DataFrame | None = None
) -> int:
    """Encode the contents of ``texts`` (column ``text``) that the cache lacks, append their counts, return how many those are.

    ``digests`` (``content``), if given, are the digests of the same texts. Copies merge within each task before
    anything is shuffled, so a content with a third of the rows is one row of each task. Few missing contents are broadcast
    as a filter, after they are counted; otherwise the merged texts go by digest to the missing ones.
    """
    spark = texts.sparkSession
    find = tokenizer_path if callable(tokenizer_path) else (lambda: tokenizer_path)
    want = tokenizer(find(), blank_apart).digest
    texts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("content", content_digest(F.col("text"), blank_apart))
    known = read_cache(spark, cache, want)
    missing = cut_lineage((texts if digests is None else digests).select("content").distinct().join(known, "content", "left_anti"), "missing")
    n = missing.count()
    if n == 0:
        return 0
    if n <= FEW:
        texts = texts.join(F.broadcast(missing), "content", "left_semi")
    different = texts.groupBy("content").agg(F.first("text").alias("text"))
    if n > FEW:
        different = different.join(missing, "content", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = tokenizer(find(), blank_apart)
        if here.digest != want:
            raise ValueError("an executor has another version of the tokenizer than the driver")
        for batch in batches:
            for part in pieces(batch, "text"):
                sizes = pa.array(here.counts(part.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("content"), sizes], ["content", "n_tokens"])

    counted = different.select("content", "text").mapInArrow(encode, "content binary, n_tokens bigint")
    counted.withColumn("tokenizer", F.lit(want)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return n


def count_tokens(
    docs: DataFrame, tokenizer_path: str | Callable[[], str], *, row: str = "doc_id", text: str = "text",
    cache: str | None = None, blank_apart: bool = False,
) -> DataFrame:
    """``(<row>, n_bytes, n_tokens)`` for every row of ``docs``.

    ``cache`` is a folder that all executors reach and that later calls may share, for any number of tokenizers; without
    one a new folder below the shared one serves this call. ``tokenizer_path`` is the file, or a function that finds
    it on the executor. A killed call leaves the cache as it was: an append counts when it is committed.

    Null and empty texts have no bytes and no tokens (or what the library gives for an empty text). Repeated rows each give a
    row; null row ids stay null; other columns are not read. An empty table gives no row.

    Texts are read twice and shuffled once, copies merged; rows travel with 32 bytes of digest only. In the last join the
    contents with more than a thousandth of all rows are broadcast, fewer than a thousand, and the others joined by digest.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token_counts")
    find = tokenizer_path if callable(tokenizer_path) else (lambda: tokenizer_path)
    source = docs.select(F.col(row).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = cut_lineage(
        source.select("row", F.octet_length("text").cast("bigint").alias("n_bytes"), content_digest(F.col("text"), blank_apart).alias("content")),
        "content_digests",
    )
    fill_cache(source, cache, find, blank_apart=blank_apart, digests=keyed)
    counts = read_cache(spark, cache, tokenizer(find(), blank_apart).digest)
    copies = keyed.groupBy("content").agg(F.count(F.lit(1)).alias("copies"))
    most = F.lit(HOT_SHARE * keyed.count())
    hot = copies.filter(F.col("copies") > most).select("content").join(counts, "content").withColumnRenamed("n_tokens", "hot")
    marked = keyed.join(F.broadcast(hot), "content", "left")
    served = marked.filter("hot is not null").select("row", "n_bytes", F.col("hot").alias("n_tokens"))
    others = marked.filter("hot is null").drop("hot").join(counts, "content").select("row", "n_bytes", "n_tokens")
    return served.unionByName(others).withColumnRenamed("row", row)
