"""Periodic runs of words, from Lyndon roots found by Baier's grouping of suffixes.

The first phase of Baier's suffix sorting deals suffixes into groups of equal context and, from the highest group down,
lengthens the contexts of the positions that precede a group. Where it ends, the context of a position is the longest
Lyndon word that starts there: the Lyndon array comes directly, without the suffix array. Every run has roots that are
longest Lyndon words under one of the two orders of its words, so the grouping is done under both. Positions of one group have equal
contexts, so a root's repetitions are positions of one group a context apart; common extensions on both ends give the run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import pieces
from .token_counts import blocks

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words of a window that must recur in a run, see ``candidates``.
WINDOW = 3


def lyndon_groups(ranks: list[int]) -> tuple[list[int], list[int]]:
    """Baier's first phase over a sequence of ranks: ``(lengths, groups)``.

    ``lengths[i]`` is the length of the longest Lyndon word that starts at i (by the order of the ranks, an end is smaller than any
    word); ``groups[i] == groups[j]`` if and only if these words are equal. Groups are taken from the highest down. The
    positions of the taken group point to the nearest position before them that lies in a lower group, whose context
    the taken group's context continues, as often as positions point to it. So continued positions leave their group
    for a new one right above it, the more often continued ones higher.
    """
    n = len(ranks)
    order = sorted(set(ranks))
    number = {r: k for k, r in enumerate(order)}
    group = [number[r] for r in ranks]
    members: list[list[int] | None] = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    lower = list(range(-1, len(order) - 1))
    upper = [*range(1, len(order)), -1]
    lengths = [1] * n
    # back[i + 1] - 1 is a position before or at i that is not taken yet, or leads to one.
    back = list(range(n + 1))
    g = len(order) - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        members[g] = None
        if here:
            for i in here:
                back[i + 1] = i
            times: dict[int, int] = defaultdict(int)
            for i in here:
                while back[i] != i:
                    back[i] = back[back[i]]
                    i = back[i]
                if i:
                    times[i - 1] += 1
            size = lengths[here[0]]
            moved: dict[tuple[int, int], list[int]] = defaultdict(list)
            for i, k in times.items():
                moved[k, group[i]].append(i)
            for k, old in sorted(moved, reverse=True):
                new, above = len(members), upper[old]
                found = moved[k, old]
                members.append(found)
                lower.append(old)
                upper.append(above)
                upper[old] = new
                if above >= 0:
                    lower[above] = new
                for i in found:
                    group[i] = new
                    lengths[i] += k * size
        g = lower[g]
    return lengths, group


def extension(words: np.ndarray, a: int, b: int, step: int) -> int:
    """The length of the longest common extension of positions ``a < b``, forwards (``step`` 1) or backwards (-1).

    Blocks of doubling size are compared, so the work is in proportion to what is found.
    """
    room = len(words) - b if step > 0 else a + 1
    found, size = 0, 8
    while found < room:
        size = min(size, room - found)
        x, y = a + step * found, b + step * found
        if step > 0:
            differ = words[x : x + size] != words[y : y + size]
        else:
            differ = (words[x - size + 1 : x + 1] != words[y - size + 1 : y + 1])[::-1]
        if differ.any():
            return found + int(differ.argmax())
        found, size = found + size, size * 2
    return found


def runs_of(words: np.ndarray, least_length: int, least_exponent: int) -> set[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of word numbers with at least this length and exponent (3 or more)."""
    found: set[tuple[int, int, int]] = set()
    n = len(words)
    for ranks in (words.tolist(), (-words).tolist()):
        lengths, groups = lyndon_groups(ranks)
        sizes, group = np.asarray(lengths, np.int64), np.asarray(groups, np.int64)
        here = np.arange(n)
        after = here + sizes
        # The next root of the same run: the same Lyndon word, one period on.
        again = np.zeros(n, bool)
        inside = after < n
        again[inside] = group[after[inside]] == group[inside]
        first = again.copy()
        first[after[again]] = False
        for i in np.flatnonzero(first).tolist():
            period = lengths[i]
            roots, j = 2, i + period
            while again[j]:
                roots, j = roots + 1, j + period
            # A run holds at least as many whole roots as its exponent, less one for the partial ones at its ends.
            if roots < least_exponent - 1:
                continue
            left = extension(words, i - 1, i + period - 1, -1) if i else 0
            right = extension(words, j, j + period, 1) if j + period < n else 0
            start, length = i - left, j + period + right - i + left
            if length >= max(least_length, least_exponent * period):
                found.add((start, length, period))
    return found


def candidates(words: np.ndarray, least_length: int, least_exponent: int) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) that hold all runs, and with each run a neighbour that ends it where there is one.

    In a run of length L and period q every window of three words that starts at least q before the last such start recurs one period on, so each of
    the L - 2 windows has at least (L - 2) // q equal ones in the run. With L >= max(least_length, least_exponent * q) that is at least
    ``times`` below. Positions that no window with so many equals covers are in no run.
    """
    n = len(words)
    times = min(least_exponent - 1, max(least_length, least_exponent) - WINDOW + 1)
    if n < max(least_length, least_exponent, WINDOW):
        return
    m = np.uint64(len(words) + 1)
    w = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        windows = (w[:-2] * m + w[1:-1]) * m + w[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    often = np.r_[False, count[which] >= times, False].astype(np.int8)
    edges = np.diff(often)
    for start, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        if end - start + WINDOW - 1 >= least_length:
            yield max(start - 1, 0), min(end + WINDOW, n)


def find_runs(words: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a text's word numbers, by start, then period."""
    found = set()
    for start, end in candidates(words, least_length, least_exponent):
        _, part = np.unique(words[start:end], return_inverse=True)
        found |= {(start + a, length, period) for a, length, period in runs_of(part.astype(np.int64), least_length, least_exponent)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that stay: of every run its first period, unless another run drops some of that."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return words[np.cumsum(change[:-1]) == 0]


def _numbered(text: str) -> tuple[np.ndarray, list[bytes]]:
    """A text's words as numbers, equal for equal words, and the spelling of each number."""
    number: dict[bytes, int] = {}
    parts = [np.fromiter((number.setdefault(w, len(number)) for w in block.split()), np.int32) for block in blocks(text.encode())]
    return np.concatenate(parts), list(number)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(
    docs: DataFrame, *, row: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
) -> DataFrame:
    """``(<row>, n_words, runs, collapsed)`` for every row of ``docs``.

    Words are separated by ASCII white space. ``runs``: every longest stretch of words with smallest period q and at least
    ``least_length`` and ``least_exponent * q`` words (exponent 3 or more), by start, then period. ``collapsed``: the words that no run
    holds after its first q, joined by one blank.

    Null and empty texts have no words, no runs and an empty collapsed text. Texts may be of any length; repeated rows each give a
    row; null row ids stay null; other columns are not read. An empty table gives no row. Nothing is shuffled.
    """
    if least_exponent < 3 or least_length < 1:
        raise ValueError("runs are found from exponent 3 and length 1 on")
    arrow = docs.limit(0).select(F.col(row).alias("row")).toArrow().schema.field(0).type
    kind = docs.select(F.col(row)).schema[0].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                sizes, found, texts = [], [], []
                for value in part.column("text"):
                    words, spelling = _numbered(value.as_py())
                    runs = find_runs(words, least_length, least_exponent)
                    sizes.append(len(words))
                    found.append([{"start": a, "length": b, "period": q} for a, b, q in runs])
                    texts.append(b" ".join([spelling[i] for i in collapsed(words, runs).tolist()]).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").cast(arrow), pa.array(sizes, pa.int64()), pa.array(found, run_type), pa.array(texts, pa.string())],
                    ["row", "n_words", "runs", "collapsed"],
                )

    source = docs.select(F.col(row).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(scan, f"row {kind}, n_words bigint, runs {RUNS}, collapsed string").withColumnRenamed("row", row)
