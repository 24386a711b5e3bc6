"""Packing of token sequences: where to cut is found by dynamic programming, the order stays.

The documents of a task form one stream of tokens. Windows of at most ``length`` tokens are cut from
it at document or sentence boundaries, or anywhere at a higher price, so that padding plus the price of the cuts
is least. With boundaries in ascending order the best start of a window is a minimum over a
sliding range, which a monotone queue keeps at hand.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import BLANK_WORDS, hashes, owners, pieces, runs, texts_of

LENGTH = 4096
#: Prices, in tokens of padding, of a cut within a document at the end of a sentence, or within a sentence.
SENTENCE_CUT, ANY_CUT = 8, 64
#: Tokens for which cuts are chosen at once; the last window moves on to the next round.
STREAM = 1 << 18
#: Different words whose tokens a worker remembers.
REMEMBERED = 1 << 20
#: What stands between words that are encoded together, a character of one token; and how many words these are.
MARK, TOGETHER = "\x7f", 256
#: Sequence numbers of one task.
PER_TASK = 1 << 40


class WordTokens:
    """Token ids of texts by a tokenizer that never joins text across ASCII white space.

    So every word between white space is encoded once and remembered; ids are those of the whole text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.which = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and where those of each text begin (and the last end)."""
        texts = texts_of(column)
        starts, ends = runs(texts, BLANK_WORDS)
        words = hashes(texts.data, starts, ends)
        different, first, inverse = np.unique(words, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        self._learn(texts, starts, ends, different, first)
        number = self.which[np.searchsorted(self.known, different)][inverse]
        size = (self.first[1:] - self.first[:-1])[number]
        total = np.cumsum(size)
        out = np.repeat(self.first[number] - (total - size), size) + np.arange(int(size.sum()))
        counts = np.bincount(owners(texts.offsets, starts), size.astype(float), len(texts)).astype(np.int64)
        return self.ids[out], np.r_[0, np.cumsum(counts)]

    def _learn(self, texts, starts, ends, different, first) -> None:
        at = np.searchsorted(self.known, different)
        new = np.ones(len(different), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != different[inside]
        if not new.any():
            return
        raw = texts.data.tobytes()
        spell = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        ids, sizes = self._encode_words(spell)
        number = len(self.first) - 1 + np.arange(len(spell))
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(sizes)]
        self.ids = np.r_[self.ids, ids]
        # Both are in order already.
        self.known, self.which = np.insert(self.known, at[new], different[new]), np.insert(self.which, at[new], number)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has.

        Many words at a time are one text, with ``MARK`` between them, whose token is in no other word. A text in which that token is
        not found exactly once between two words, as when a word holds the mark itself, is encoded word by word.
        """
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        joined = [f" {MARK} ".join(g) for g in groups] if self.mark is not None else []
        texts = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) if joined else [None] * len(groups)
        found, sizes = [], []
        for group, text in zip(groups, texts):
            if text is not None and not any(MARK in w for w in group):
                ids = np.array(text.ids, np.uint32)
                marks = ids == self.mark
                ends = np.flatnonzero(np.r_[marks, True])
                if len(ends) == len(group):
                    found.append(ids[~marks])
                    sizes.append(np.diff(np.r_[-1, ends]) - 1)
                    continue
            apart = [e.ids for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
            n = np.fromiter(map(len, apart), np.int64, len(apart))
            found.append(np.fromiter(chain.from_iterable(apart), np.uint32, int(n.sum())))
            sizes.append(n)
        return np.concatenate(found), np.concatenate(sizes)


_ENCODERS: dict[str, WordTokens] = {}


def encoder(path: str) -> WordTokens:
    """This worker's encoder, so that tasks that follow in one worker share its memory."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordTokens(path)
    return _ENCODERS[path]


def sentence_ids(tokenizer) -> np.ndarray:
    """Ids of tokens that end a sentence: marks alone, with a full stop, question or exclamation mark among them."""
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    strip = lambda t: t.removesuffix("</w>")
    return np.array(sorted(i for t, i in vocab.items() if set(strip(t)) & set(".!?") and not any(c.isalnum() for c in strip(t))))


def choose_cuts(places: np.ndarray, prices: np.ndarray, length: int, powers: list[int]) -> list[int]:
    """The cheapest cuts among ``places`` (ascending, none further than ``length`` from the one before, first 0, last the end).

    Cost: a window is padded to ``length``, one whose length is among ``powers`` is not padded, and each cut has its price.
    Returns the indices of the chosen places, 0 and the last included.
    """
    n = len(places)
    at, price = places.tolist(), prices.tolist()
    index = {p: i for i, p in enumerate(at)} if powers else {}
    best, came = [0.0] * n, [0] * n
    # Minimum of best[i] + at[i] over the starts in reach, in ascending order of value.
    queue: deque[tuple[float, int]] = deque()
    for j in range(1, n):
        value = best[j - 1] + at[j - 1]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j - 1))
        here = at[j]
        while at[queue[0][1]] < here - length:
            queue.popleft()
        cost, source = queue[0][0] + length - here, queue[0][1]
        for p in powers:
            i = index.get(here - p)
            if i is not None and best[i] < cost:
                cost, source = best[i], i
        best[j], came[j] = cost + price[j], source
    path = [n - 1]
    while path[-1]:
        path.append(came[path[-1]])
    return path[::-1]


class Stream:
    """Tokens of one task in order, and the pieces cut from them."""

    def __init__(self, length: int, ends_sentence: np.ndarray, first_sequence: int) -> None:
        self.length, self.ends_sentence, self.sequence = length, ends_sentence, first_sequence
        self.docs: list[tuple] = []  # (row id, ids, how many are cut off already)
        self.size = 0

    def add(self, row, ids: np.ndarray) -> None:
        self.docs.append((row, ids, 0))
        self.size += len(ids)

    def cut(self, final: bool) -> Iterator[tuple]:
        """Pieces of all windows but the last (of that too when ``final``)."""
        if not self.size:
            return
        ids = np.concatenate([d[1][d[2] :] for d in self.docs])
        ends = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        price = np.full(self.size + 1, -1.0)
        price[np.flatnonzero(np.isin(ids, self.ends_sentence)) + 1] = SENTENCE_CUT
        price[ends] = 0
        price[0] = 0
        # Cuts within a sentence: only where powers of two need them, and so that no gap is longer than a window.
        known = np.flatnonzero(price >= 0)
        free = [np.arange(a + self.length, b, self.length) for a, b in zip(known[:-1], known[1:]) if b - a > self.length]
        tail, rest, extra = self.size, self.size % self.length, []
        if final:
            for k in range(self.length.bit_length()):
                if rest >> k & 1:
                    tail -= 1 << k
                    extra.append(tail)
        more = np.array([x for x in [*np.concatenate([np.zeros(0, np.int64), *free]).tolist(), *extra] if x > 0], np.int64)
        price[more] = np.where(price[more] < 0, ANY_CUT, price[more])
        places = np.flatnonzero(price >= 0)
        # Short windows only pay at the end; before it, a window is all but full anyway.
        powers = [1 << k for k in range(self.length.bit_length())] if final else []
        path = places[choose_cuts(places, price[places], self.length, powers)]
        if not final:
            path = path[:-1]
        if len(path) < 2:
            return
        yield from self._emit(path)

    def _emit(self, path: np.ndarray) -> Iterator[tuple]:
        done, queue = 0, deque(self.docs)
        for a, b in zip(path[:-1].tolist(), path[1:].tolist()):
            offset = 0
            while done < b:
                row, ids, start = queue.popleft()
                n = min(len(ids) - start, b - done)
                piece = np.ascontiguousarray(ids[start : start + n], "<u4")
                yield row, start, n, zlib.crc32(piece), len(ids), self.sequence, offset
                done, offset = done + n, offset + n
                if start + n < len(ids):
                    queue.appendleft((row, ids, start + n))
            self.sequence += 1
        self.docs = list(queue)
        self.size -= done


PIECE_FIELDS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(
    docs: DataFrame, tokenizer_path: str | Callable[[], str], end_id: int, *, row: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """One row for each piece: ``(<row>, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    A document is the ids of its text and ``end_id``; null and empty texts are that id alone. Documents keep the order in which
    a task reads them, and each id lies in exactly one piece. Sequences hold at most ``length`` ids; sequence numbers are unique and
    ascend within a task but have gaps between tasks. Rows with equal values are packed each; null row ids stay null; other columns are
    not read. An empty table gives no piece. ``tokenizer_path`` is the file, or a function that finds it on the executor.

    No shuffle and no driver: each task packs the texts of its partition, a bounded number of tokens at a time, and only its
    last window can be short; the binary digits of what is left may end it without padding. A run repeats exactly, as
    the numbers come from the partition.
    """
    kind = docs.select(F.col(row)).schema[0].dataType.simpleString()
    find = tokenizer_path if callable(tokenizer_path) else (lambda: tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(find())
        stream = Stream(length, sentence_ids(encode.tokenizer), TaskContext.get().partitionId() * PER_TASK)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                ids, first = encode.encode(part.column("text"))
                for i, name in enumerate(part.column("row").to_pylist()):
                    stream.add(name, np.r_[ids[first[i] : first[i + 1]], np.uint32(end_id)].astype(np.uint32))
                    if stream.size >= STREAM:
                        yield table(stream.cut(False))
        yield table(stream.cut(True))

    arrow = docs.limit(0).select(F.col(row).alias("row")).toArrow().schema.field(0).type

    def table(found) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:])],
            ["row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    source = docs.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"row {kind}, {PIECE_FIELDS}").withColumnRenamed("row", row)
