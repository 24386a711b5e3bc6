"""Toxicity by a weighted lexicon, found with an Aho-Corasick automaton over folded text.

Folding undoes look-alike letters and digits put for letters. The lexicon holds whole words and word
beginnings that labelled toxic documents use far more than others; exception phrases are pairs of adjacent words in which
such a word is harmless, as learned from the same documents: with it, an entry is in far more other documents than without. What a text matches is summed up, related to its length, and turned into a score by a
logistic curve fitted on the same labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import pieces

#: Labelled documents that the lexicon and the curve are fitted on, at most; those with the smallest id hashes.
LABELLED = 20_000
#: Entries of the lexicon, at most.
ENTRIES = 2_000
#: Lengths of word beginnings that are tried.
BEGINNINGS = (4, 5, 6)
#: Least likelihood-ratio statistic of an entry, and least factor between its odds in toxic and other documents.
LEAST_EVIDENCE, LEAST_ODDS = 24.0, 4.0

# Look-alikes of Latin letters in Cyrillic and Greek, full-width forms apart (these follow by rule), digits and signs
# used for letters, and characters without width.
_FROM = "аеорсухіјѕһԁӏкмтвнαοερτυνκιωµ0134578@$!|"
_TO = "aeopcyxijshdlkmtbhaoeptuvkiwuoieastbasil"
_FOLD = {ord(a): b for a, b in zip(_FROM, _TO)}
_FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_APART = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Lower-case words with one space before and after each, look-alikes and digits undone."""
    return " " + _APART.sub(" ", (text or "").lower().translate(_FOLD)).strip() + " "


def held_out(row: Column) -> Column:
    """Rows that fitting never sees."""
    return F.crc32(F.encode(row.cast("string"), "UTF-8")) % 3 == 1


def entries_of(words: list[str]) -> set[str]:
    """Possible lexicon entries of a text: its words (`` word ``) and word beginnings (`` begin``)."""
    different = set(words)
    found = {f" {w} " for w in different if len(w) > 2}
    for n in BEGINNINGS:
        found |= {f" {w[:n]}" for w in different if len(w) >= n}
    return found


def _evidence(a, b, toxic: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood-ratio statistic and log odds of entries in ``a`` of ``toxic`` and ``b`` of ``other`` documents."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    share = max(toxic, 1) / max(toxic + other, 1)
    n = a + b
    log = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(y, 1e-9)), 0)
    g = 2 * (log(a, n * share) + log(b, n * (1 - share)))
    odds = np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (other - b + 0.5))
    return g, odds


def training_rows(docs: DataFrame, labels: DataFrame, row: str, text: str, label: str, most: int) -> DataFrame:
    """``(text, label)`` of at most ``most`` labelled rows outside the held-out fold."""
    chosen = (
        labels.select(F.col(row).alias("key"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key")))
        .groupBy("key")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(most)
    )
    # At most `most` rows of two numbers.
    return docs.select(F.col(row).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key").select("text", "label")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each possible entry, by label."""
    counts: list[Counter] = [Counter(), Counter()]

    def out() -> pa.RecordBatch:
        names = list(counts[0] | counts[1])
        both = [pa.array([c[n] for n in names], pa.int64()) for c in counts]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *both], ["entry", "other", "toxic"])

    for batch in batches:
        for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[y].update(entries_of(fold(t).split()))
            counts[y][""] += 1  # all documents
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield out()
            counts = [Counter(), Counter()]
    yield out()


def fit_lexicon(train: DataFrame) -> dict[str, float]:
    """Entries and weights: those with strong evidence, less those that a shorter entry already covers as well."""
    counts = train.mapInArrow(_count, "entry string, other bigint, toxic bigint").groupBy("entry").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic")
    )
    total = counts.filter("entry = ''").first()
    if total is None or not total["toxic"] or not total["other"]:
        return {}
    share = total["toxic"] / (total["toxic"] + total["other"])
    likely = counts.filter(F.col("entry") != "").filter(F.col("toxic") > 2 * share * (F.col("toxic") + F.col("other")))
    best = likely.orderBy(F.desc(F.col("toxic") - F.col("other")), "entry").limit(4 * ENTRIES).collect()
    if not best:
        return {}
    g, odds = _evidence([r["toxic"] for r in best], [r["other"] for r in best], total["toxic"], total["other"])
    ranked = sorted((len(r["entry"]), r["entry"], o) for r, e, o in zip(best, g, odds) if e >= LEAST_EVIDENCE and o >= np.log(LEAST_ODDS))
    chosen: dict[str, float] = {}
    for _, entry, weight in ranked:
        begins = [entry[:n] for n in range(2, len(entry)) if entry[:n] in chosen]
        if not begins or weight > max(chosen[b] for b in begins) + 1:
            chosen[entry] = float(weight)
    return dict(sorted(chosen.items(), key=lambda x: -x[1])[:ENTRIES])


def _entry(word: str, lexicon: dict[str, float]) -> str | None:
    """The entry that a word matches, the heaviest."""
    found = [e for e in (f" {word} ", *(f" {word[:n]}" for n in BEGINNINGS)) if e in lexicon]
    return max(found, key=lexicon.get, default=None)


def _count_pairs(lexicon: dict[str, float]):
    """Documents with each entry (an empty pair) and with each pair of adjacent words that holds one, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]

        def out() -> pa.RecordBatch:
            names = list(counts[0] | counts[1])
            both = [pa.array([c[n] for n in names], pa.int64()) for c in counts]
            keys = [pa.array([n[k] for n in names], pa.string()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*keys, *both], ["entry", "pair", "other", "toxic"])

        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = fold(t).split()
                entry = {w: _entry(w, lexicon) for w in set(words)}
                found = {(e, "") for e in entry.values() if e}
                for pair in set(zip(words, words[1:])):
                    found |= {(entry[w], " ".join(pair)) for w in pair if entry[w]}
                counts[y].update(found)
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield out()
                counts = [Counter(), Counter()]
        yield out()

    return run


def fit_exceptions(train: DataFrame, lexicon: dict[str, float]) -> tuple[str, ...]:
    """Word pairs with strong evidence for the other documents among those with the same entry, for each entry in the pair.

    A pair that is as such in toxic documents more than twice as often as chance has it is none.
    """
    counts = train.mapInArrow(_count_pairs(lexicon), "entry string, pair string, other bigint, toxic bigint").groupBy("entry", "pair").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic")
    )
    base = train.agg(F.avg("label")).first()[0]
    # At most one row for each entry of the lexicon.
    whole = F.broadcast(counts.filter("pair = ''").select("entry", F.col("other").alias("all_other"), F.col("toxic").alias("all_toxic")))
    pairs = counts.filter("pair <> ''").join(whole, "entry")
    # A pair in the other documents that gives no such evidence at its best gives none at all.
    share = F.col("all_other") / (F.col("all_other") + F.col("all_toxic"))
    possible = (F.col("other") > 0) & (-2 * F.col("other") * F.log(F.greatest(share, F.lit(1e-9))) >= LEAST_EVIDENCE)
    possible &= F.col("toxic") <= 2 * base * (F.col("other") + F.col("toxic"))
    passed: dict[str, set[str]] = {}
    for r in pairs.filter(possible).collect():
        g, odds = _evidence(r["other"], r["toxic"], r["all_other"], r["all_toxic"])
        if g >= LEAST_EVIDENCE and odds >= np.log(LEAST_ODDS):
            passed.setdefault(r["pair"], set()).add(r["entry"])
    return tuple(sorted(p for p, entries in passed.items() if {e for w in p.split() if (e := _entry(w, lexicon))} <= entries))


class Matcher:
    """The automaton over lexicon and exception phrases, built once in each worker."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        weights = {e: (len(e), w) for e, w in lexicon.items()}
        # A phrase takes back what is matched within it.
        weights |= {fold(p): (len(fold(p)), None) for p in exceptions}
        for entry, value in weights.items():
            self.automaton.add_word(entry, value)
        if weights:
            self.automaton.make_automaton()
        self.empty = not weights

    def features(self, text: str | None) -> tuple[float, float]:
        """Sum of the weights, and the sum for each hundred words."""
        folded = fold(text)
        if self.empty:
            return 0.0, 0.0
        spans, harmless = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            (harmless if weight is None else spans).append((end + 1 - size, end + 1, weight))
        total, last, passed, reach = 0.0, -1, 0, -1
        harmless.sort(key=lambda s: s[0])
        for start, end, weight in sorted(spans, key=lambda s: (s[0], -s[2])):
            while passed < len(harmless) and harmless[passed][0] <= start:
                reach = max(reach, harmless[passed][1])
                passed += 1
            if start == last or end <= reach:
                continue  # one match for each word, the heaviest
            last = start
            total += weight
        return total, 100 * total / max(folded.count(" ") - 1, 1)


def _design(features: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), features[:, 0] > 0, np.log1p(features)])


def fit_curve(features: np.ndarray, labels: np.ndarray, rounds: int = 30, ridge: float = 0.1) -> np.ndarray:
    """Coefficients of a ridge-penalised logistic regression on whether, how much and how densely a text matches."""
    x, y = _design(features), labels.astype(float)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
    return beta


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, row: str = "doc_id", text: str = "text", label: str = "toxic",
    labelled: int = LABELLED, exceptions: tuple[str, ...] = (),
) -> DataFrame:
    """``(<row>, held_out, score, matched)`` for every row of ``docs``.

    ``score`` is between 0 and 1, higher for texts that are likelier toxic; ``matched`` is the sum of the weights. Only labels of
    rows outside the held-out fold are used, at most ``labelled`` of them; a null label or id is none, of repeated
    labels the highest counts. Null and empty texts match nothing and get the score of no match, the lowest. ``exceptions`` are
    phrases to be taken as harmless besides those that are learned. Without labels of both kinds
    every score is 0. Rows with equal values each give a row; null row ids stay null and are not held out. Other columns are not read.

    The labels and two numbers of each fitted document are all that passes the driver; scoring is a scan without shuffle.
    """
    train = training_rows(docs, labels, row, text, label, labelled)
    lexicon = fit_lexicon(train)
    beta = None
    if lexicon:
        exceptions = (*exceptions, *fit_exceptions(train, lexicon))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(lexicon, exceptions)
            for batch in batches:
                found = np.array([matcher.features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), batch.column("label")], ["a", "b", "label"])

        rows = train.mapInArrow(measure, "a double, b double, label int").groupBy("a", "b", "label").count().collect()
        weight = np.array([r["count"] for r in rows])
        features = np.repeat(np.array([(r["a"], r["b"]) for r in rows]), weight, 0)
        beta = fit_curve(features, np.repeat(np.array([r["label"] for r in rows]), weight))

    kind = docs.select(F.col(row)).schema[0].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for batch in batches:
            for part in pieces(batch, "text"):
                found = np.array([matcher.features(t) for t in part.column("text").to_pylist()], float).reshape(-1, 2)
                value = np.zeros(len(found)) if beta is None else 1 / (1 + np.exp(-np.clip(_design(found) @ beta, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(value), pa.array(found[:, 0])], ["row", "score", "matched"])

    source = docs.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"))
    scored = source.mapInArrow(score, f"row {kind}, score double, matched double")
    return scored.select(F.col("row").alias(row), F.coalesce(held_out(F.col("row")), F.lit(False)).alias("held_out"), "score", "matched")
