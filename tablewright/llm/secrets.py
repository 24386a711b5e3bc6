"""Secret scans with grammars inferred from labelled credentials.

Values that plain patterns find are the labelled credentials. Their strings, as symbols for kinds of characters,
make one frequency prefix tree for each kind of secret. States whose outgoing frequencies do not differ
more than chance allows are merged, which gives a probabilistic automaton; it then says how well the format
of any other string fits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import pieces

KINDS = ("assign", "access", "hex")
#: What the automata add.
FORMAT = "format"
# The patterns of the base spans and their least lengths.
_NAMES = "password|passwd|secret|token|api_?key"
_ASSIGN = re.compile(rf"""(?ai:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# The longest runs of at least 24: the leftmost runs of any length, the shorter ones left out.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

#: Labelled values a kind is fitted on, at most: one for each hash bucket, of at most so many characters.
LABELLED, LONGEST = 300, 128
#: Candidates: runs of these characters, of at least so many.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Chance, in a merge test, of telling apart two states that are equal.
ALPHA = 0.05
#: Share of the labelled values whose likelihood counts as usual, and as much at either side.
USUAL = 0.98
_SYMBOLS = {**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "f"), **dict.fromkeys("ABCDEF", "F")}
_SYMBOLS |= {chr(c): "z" for c in range(ord("g"), ord("z") + 1)} | {chr(c): "Z" for c in range(ord("G"), ord("Z") + 1)}
_SHAPE = {ord(a): b for a, b in _SYMBOLS.items()}


def base_spans(text: str) -> dict[str, list[re.Match]]:
    """Matches of the plain patterns, leftmost and apart for each kind; too short ones are dropped."""
    return {
        "assign": [m for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGNED],
        "access": [m for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS],
        "hex": list(_HEX.finditer(text)),
    }


def shape(value: str) -> str:
    """The value in symbols: digits, letters by case and by half (a-f or not), marks as they are."""
    return value.translate(_SHAPE)


class Automaton:
    """A probabilistic automaton: for each state its end count, visits, and counted moves."""

    def __init__(self, strings: list[str], alpha: float = ALPHA) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.flow: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.visits: list[int] = [0]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                if c not in self.moves[at]:
                    self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    self.flow.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.flow[at][c] = self.flow[at].get(c, 0) + 1
                at = self.moves[at][c]
                self.visits[at] += 1
            self.ends[at] += 1
        self._merge(alpha)
        scores = sorted(self.likelihood(s) for s in strings)
        out = int((1 - USUAL) / 2 * len(scores))
        self.usual = scores[out], scores[-1 - out]
        self.lengths = min(map(len, strings)), max(map(len, strings))

    def _merge(self, alpha: float) -> None:
        """Settled states grow from the root; each state next to them is merged with the first that is compatible, or settles."""
        settled, at_edge = [0], [(0, c) for c in sorted(self.moves[0])]
        while at_edge:
            source, symbol = at_edge.pop(0)
            state = self.moves[source][symbol]
            if state in settled:
                continue
            same = next((r for r in settled if self._compatible(r, state, alpha)), None)
            if same is None:
                settled.append(state)
            else:
                self.moves[source][symbol] = same
                self._fold(same, state)
            at_edge = [(s, c) for s in settled for c in sorted(self.moves[s]) if self.moves[s][c] not in settled]

    @staticmethod
    def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        """Whether two frequencies differ more than Hoeffding's bound allows."""
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        """``b`` is the root of a tree, so the comparison ends."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], n, self.ends[b], m, alpha):
                return False
            for c in self.moves[a].keys() | self.moves[b].keys():
                if self._differ(self.flow[a].get(c, 0), n, self.flow[b].get(c, 0), m, alpha):
                    return False
            todo += [(self.moves[a][c], self.moves[b][c]) for c in self.moves[b] if c in self.moves[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            for c, t in self.moves[b].items():
                self.flow[a][c] = self.flow[a].get(c, 0) + self.flow[b][c]
                if c in self.moves[a]:
                    todo.append((self.moves[a][c], t))
                else:
                    self.moves[a][c] = t

    def fits(self, s: str) -> bool:
        """Whether length and likelihood are as usual; a string of the commonest symbols alone is too likely."""
        return self.lengths[0] <= len(s) <= self.lengths[1] and self.usual[0] <= self.likelihood(s) <= self.usual[1]

    def likelihood(self, s: str) -> float:
        """Mean log probability of the symbols; minus infinity for a move never seen."""
        at, total = 0, 0.0
        for c in s:
            n = self.flow[at].get(c)
            if not n:
                return -math.inf
            total += math.log(n / self.visits[at])
            at = self.moves[at][c]
        return total / max(len(s), 1)


def labelled_values(docs: DataFrame, text: str) -> dict[str, list[str]]:
    """A bounded sample of the different values that the plain patterns find in all documents.

    Of each kind and each of ``LABELLED`` hash buckets, the value with the smallest hash; values beyond ``LONGEST`` characters are not fitted on.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = [], []
            for t in batch.column("text").to_pylist():
                for kind, found in base_spans(t or "").items():
                    kinds += [kind] * len(found)
                    values += [m[1] if kind == "assign" else m[0] for m in found]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(find, "kind string, value string")
    rows = (
        found.filter(F.length("value") <= LONGEST)
        .groupBy("kind", F.pmod(F.xxhash64("value"), F.lit(LABELLED)).alias("bucket"))
        .agg(F.min(F.struct(F.xxhash64(F.lit(1), "value").alias("hash"), "value")).alias("first"))
        .select("kind", "first.value")
        .collect()
    )
    return {k: sorted(r["value"] for r in rows if r["kind"] == k) for k in KINDS}


_SPAN = "struct<start:bigint,end:bigint,kind:string,score:double>"


def scan_secrets(docs: DataFrame, *, row: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<row>, spans)`` for every row of ``docs``; ``spans`` are ``(start, end, kind, score)`` in code points, sorted.

    Base spans (``assign``, ``access``, ``hex``) have the score of their value's format where a grammar fits, else null. ``format`` spans are
    candidates apart from all base spans whose length and likelihood are usual under the grammar of some kind. A null or empty text has no span. Without any labelled value there is no grammar and no ``format`` span. Rows with equal
    values each give a row; null row ids stay null; other columns are not read.

    The documents are scanned twice, for the labelled values and for the spans; only the bounded sample is shuffled.
    """
    grammars = {k: Automaton([shape(v) for v in values]) for k, values in labelled_values(docs, text).items() if values}
    kind = docs.select(F.col(row)).schema[0].dataType.simpleString()
    order = {k: i for i, k in enumerate((*KINDS, FORMAT))}
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def value_score(kind: str, value: str) -> float | None:
        score = grammars[kind].likelihood(shape(value)) if kind in grammars else -math.inf
        return score if score > -math.inf else None

    def spans(t: str) -> list[dict]:
        found = base_spans(t)
        out = [(m.start(), m.end(), k, value_score(k, m[1] if k == "assign" else m[0])) for k, ms in found.items() for m in ms]
        taken = [(a, b) for a, b, _, _ in out]
        for m in _CANDIDATE.finditer(t):
            symbols = shape(m[0])
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            best = max((g.likelihood(symbols) for g in grammars.values() if g.fits(symbols)), default=-math.inf)
            if best > -math.inf:
                out.append((m.start(), m.end(), FORMAT, best))
        return [dict(zip(("start", "end", "kind", "score"), s)) for s in sorted(out, key=lambda s: (s[0], order[s[2]]))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = pa.array([spans(t or "") for t in part.column("text").to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([part.column("row"), found], ["row", "spans"])

    source = docs.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(scan, f"row {kind}, spans array<{_SPAN}>").withColumnRenamed("row", row)
