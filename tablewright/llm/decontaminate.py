"""Benchmark decontamination with suffix arrays of the training texts.

The training texts are cut in shards, each with a suffix array over its words. Every suffix of every
benchmark item is searched in every shard, all at once, by binary searches that narrow the interval
of equal suffixes word by word; where the interval empties ends the longest verbatim match, and
the interval before it holds the places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ._words import ALNUM_WORDS, hashes, owners, pieces, runs, texts_of

#: Words in a row that count as a leak; a shorter item counts whole.
WINDOW = 10
#: Bytes of training text in a shard; a longer text is a shard of its own.
SHARD = 4 << 20
#: Bytes of benchmark text that are searched, and sent to the executors, at once; a longer item goes alone.
BLOCK = 8 << 20


def suffix_array(words: np.ndarray, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The word positions sorted by their first ``depth`` words or more, and the rank of each word.

    ``text`` names the text of each word; a suffix ends with its text. Sorted by prefix doubling: in
    each round only suffixes that are still tied are sorted again, by the rank of what follows.
    """
    n = len(words)
    names, rank = np.unique(words, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    # A rank is the first place of its group of ties.
    place = np.zeros(n, np.int64)
    heads = np.flatnonzero(np.r_[True, rank[order[1:]] != rank[order[:-1]]])
    place[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    end = last[np.searchsorted(last, np.arange(n))] if n else last
    tied = np.repeat(np.diff(np.r_[heads, n]) > 1, np.diff(np.r_[heads, n])).nonzero()[0]
    h = 1
    while h < depth and len(tied):
        at = order[tied]
        after = at + h
        following = np.where(after <= end[at], place[np.minimum(after, n - 1)] + 1, 0)
        key = place[at] * np.int64(n + 2) + following
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[tied] = at
        head = np.r_[True, key[1:] != key[:-1]]
        first = tied[head]
        size = np.diff(np.r_[np.flatnonzero(head), len(tied)])
        place[at] = np.repeat(first, size)
        tied = tied[np.repeat(size > 1, size)]
        h *= 2
    return order, names


def search(order: np.ndarray, words: np.ndarray, end: np.ndarray, items: np.ndarray, item_end: np.ndarray, deep: int):
    """For every suffix of the items: the longest match, its interval of ``order``, and the interval of its window.

    ``words`` and ``items`` hold word ranks (-1 for a word that no text has); ``end`` and ``item_end`` are the
    last position of each word's text and item. A window is ``deep`` words, or all of a shorter item.
    """
    n, m = len(order), len(items)
    low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
    length = np.zeros(m, np.int64)
    window_low, window_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    alive = np.arange(m) if n else np.zeros(0, np.int64)
    depth = 0
    while len(alive):
        target = items[alive + depth]
        # Within an interval of equal suffixes the next word ascends; a suffix that has ended sorts first.
        a = _bound(order, words, end, low[alive], high[alive], depth, target, False)
        b = _bound(order, words, end, a, high[alive], depth, target, True)
        found = a < b
        alive, a, b = alive[found], a[found], b[found]
        depth += 1
        low[alive], high[alive], length[alive] = a, b, depth
        if depth == deep:
            window_low[alive], window_high[alive] = a, b
        alive = alive[alive + depth <= item_end[alive]]
    return length, low, high, window_low, window_high


def _bound(order, words, end, low, high, depth, target, right: bool) -> np.ndarray:
    """Binary search in many intervals at once for the first place whose word at ``depth`` is not below ``target`` (or is above it)."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        at = order[middle]
        word = np.where(at + depth <= end[at], words[np.minimum(at + depth, len(words) - 1)], -2)
        before = word <= target[open_] if right else word < target[open_]
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]
        open_ = open_[low[open_] < high[open_]]
    return low


class Block:
    """Benchmark items as word hashes, one after the other."""

    def __init__(self, rows: list) -> None:
        texts = texts_of(pa.array([r["text"] for r in rows], pa.string()), lower=True)
        starts, ends = runs(texts, ALNUM_WORDS)
        self.words = hashes(texts.data, starts, ends)
        self.item = owners(texts.offsets, starts)
        self.ids = [r["item"] for r in rows]
        count = np.bincount(self.item, minlength=len(rows))
        self.first = np.cumsum(count) - count
        self.count = count


def leaks(texts, block: Block, window: int = WINDOW):
    """Hit words and matches of a shard: ``(text of each word, hit, matches)``.

    ``matches`` are arrays ``(text, item, item word, text word, length)``: the longest verbatim matches that hold a whole window.
    """
    starts, ends = runs(texts, ALNUM_WORDS)
    words = hashes(texts.data, starts, ends)
    text = owners(texts.offsets, starts)
    n = len(words)
    hit = np.zeros(n + 1, np.int64)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not n or not len(block.words):
        return text, hit[:n] > 0, none
    order, names = suffix_array(words, text, int(block.count.max()))
    rank = np.searchsorted(names, words)
    at = np.minimum(np.searchsorted(names, block.words), len(names) - 1)
    item_rank = np.where(names[at] == block.words, at, -1)
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    end = last[np.searchsorted(last, np.arange(n))]
    item_end = (block.first + block.count - 1)[block.item]
    length, low, high, window_low, window_high = search(order, rank, end, item_rank, item_end, window)
    # Items of fewer words are one window: their whole first suffix.
    size = np.minimum(block.count[block.item], window)
    place = np.arange(len(block.words)) - block.first[block.item]
    short = (block.count[block.item] < window) & (place == 0) & (length == size)
    window_low[short], window_high[short] = low[short], high[short]
    found = np.flatnonzero(window_high > window_low)
    if not len(found):
        return text, hit[:n] > 0, none
    many = (window_high - window_low)[found]
    suffix = np.repeat(found, many)
    skip = np.cumsum(many) - many
    spot = order[np.arange(many.sum()) - np.repeat(skip, many) + np.repeat(window_low[found], many)]
    np.add.at(hit, spot, 1)
    np.add.at(hit, spot + size[suffix], -1)
    # Windows that follow each other in both the item and the text are one longer match.
    item, shift = block.item[suffix], spot - suffix
    sort = np.lexsort((spot, shift, item))
    item, shift, spot, suffix = item[sort], shift[sort], spot[sort], suffix[sort]
    new = np.r_[True, (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (spot[1:] != spot[:-1] + 1) | (text[spot[1:]] != text[spot[:-1]])]
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(spot)] - 1
    first_word = np.searchsorted(text, text[spot[heads]], "left")
    matches = (
        text[spot[heads]], item[heads], place[suffix[heads]], spot[heads] - first_word,
        spot[tails] + size[suffix[tails]] - spot[heads],
    )
    return text, np.cumsum(hit)[:n] > 0, matches


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block: int) -> Iterator[list]:
    """The items in blocks of about ``block`` bytes, each small enough for the driver and an executor.

    Items are dealt to blocks by hash; one job reads each block.
    """
    items = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).filter("text <> ''")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / block))
    for i in range(n):
        yield items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()


_MATCH = "struct<item:{kind},item_word:bigint,doc_word:bigint,length:bigint>"


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, *, row: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """``(<row>, n_words, hits, matches)`` for every row of ``docs``.

    ``hits``: spans ``(start, end)`` of words that lie in an occurrence of a window of any item, merged. ``matches``: the
    longest verbatim matches ``(item, item_word, doc_word, length)`` that hold a whole window. A null or empty text has
    no words; null, empty and wordless items are in nothing; repeated items and items without an id hit like
    others (their match has a null item). Rows with equal values each give a row; null row ids stay null; other columns are not read.

    No shuffle: each task builds the suffix arrays of its own shards. The benchmark is searched in blocks of bounded size, one pass
    over the texts for each; hits of several blocks are merged row by row in the pass of the next block.
    """
    kind = benchmark.select(F.col(item)).schema[0].dataType.simpleString()
    row_kind = docs.select(F.col(row)).schema[0].dataType.simpleString()
    match = _MATCH.format(kind=kind)
    schema = (
        f"row {row_kind}, text string, n_words bigint, hits array<struct<start:bigint,end:bigint>>, matches array<{match}>"
    )
    found = docs.select(
        F.col(row).alias("row"), F.col(text).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("hits"),
        F.expr(f"cast(array() as array<{match}>)").alias("matches"),
    )
    arrow = found.limit(0).toArrow().schema
    for i, rows in enumerate(benchmark_blocks(benchmark, item, item_text, block)):
        if i:
            found = cut_lineage(found, "leaks")
        found = found.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(Block(rows)), window, arrow), schema)
    return found.select(F.col("row").alias(row), "n_words", "hits", "matches")


def _pass(block, window: int, schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", SHARD):
                columns = dict(zip(part.schema.names, part.columns))
                texts = texts_of(part.column("text"), lower=True)
                text, hit, matches = leaks(texts, block.value, window)
                columns["n_words"] = pa.array(np.bincount(text, minlength=len(part)), pa.int64())
                if hit.any():
                    columns["hits"] = _spans(part.column("hits"), text, hit, schema.field("hits").type)
                    columns["matches"] = _matches(part.column("matches"), matches, block.value.ids, schema.field("matches").type)
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return scan


def _spans(old: pa.Array, text: np.ndarray, hit: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Merged hit spans of each text, those of earlier blocks included."""
    out = old.to_pylist()
    for t in np.unique(text[hit]):
        first, last = np.searchsorted(text, [t, t + 1])
        own = hit[first:last].copy()
        for span in out[t]:
            own[span["start"] : span["end"]] = True
        edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
        out[t] = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
    return pa.array(out, kind)


def _matches(old: pa.Array, new: tuple, ids: list, kind: pa.DataType) -> pa.Array:
    out = old.to_pylist()
    for t, i, item_word, doc_word, length in zip(*(x.tolist() for x in new)):
        out[t] = [*out[t], {"item": ids[i], "item_word": item_word, "doc_word": doc_word, "length": length}]
    return pa.array(out, kind)


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns; one pass for each block."""
    for rows in benchmark_blocks(benchmark, item, item_text, block):
        docs = docs.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(Block(rows)), window, text), docs.schema)
    return docs


def _drop(block, window: int, text: str):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, SHARD):
                of, hit, _ = leaks(texts_of(part.column(text), lower=True), block.value, window)
                keep = np.ones(len(part), bool)
                keep[of[hit]] = False
                yield part.filter(pa.array(keep))

    return clean
