"""Quality rules: divergence of a document's histograms from language references.

Two histograms of each document, of character classes and of common words, are compared with
those of every reference language by the Jensen-Shannon distance. The references are counted over
all documents that name the language. Counts of words, symbols, repeated lines and
repeated word windows give plain rules beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import ALNUM_WORDS, BLANK_WORDS, LOWER, Texts, hashes, mix, owners, pieces, runs, texts_of

#: Common words of the reference languages, the twenty most used of each.
COMMON_WORDS = {
    "en": "the of and to in is that it was for on are as with be by an at this from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur",
    "es": "de la que el en y los del se las por un para con no una su al lo como",
}
#: Below so many words a histogram says too little; the divergence then gives no verdict.
LEAST_WORDS = 50
#: Largest distances (0 to 1) from the nearest reference. A histogram of few words is off by chance, by about one over
#: the root of their number; the word distance may be that much larger.
MOST_CHAR_DISTANCE = 0.27
MOST_WORD_DISTANCE = 0.26
#: Rules on the plain counts.
BASE_LEAST_WORDS, BASE_MOST_REPEATED = 50, 50
#: Bytes of text handled at once; small enough for a processor's cache.
PIECE = 1 << 18

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _classes() -> np.ndarray:
    """Class of each byte; continuation bytes (class 0) are not characters."""
    c = np.full(256, 7)  # other ASCII
    c[[ord(x) for x in "#*$%&|<>{}[]\\^_~@+=/"]] = 6  # symbols
    c[[ord(x) for x in ".,;:!?'\"()-"]] = 5
    c[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 4
    c[ord("0") : ord("9") + 1] = 3
    c[ord("A") : ord("Z") + 1] = 2
    c[ord("a") : ord("z") + 1] = 1
    c[0x80:0xC0] = 0
    c[0xC0:0xE0] = 8  # two bytes: letters of European and near eastern scripts
    c[0xE0:] = 9
    return c


CLASSES = _classes()
N_CLASSES = 10


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """Plain counts of each text; an empty text has zeros."""
    n = len(texts)
    starts, ends = runs(texts, BLANK_WORDS)
    doc = owners(texts.offsets, starts)
    lead = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=lead[1:])
    symbols = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(_SYMBOLS[texts.data], out=symbols[1:])
    words = hashes(texts.data, starts, ends)
    # Windows of three words within one document, keyed by document.
    repeated = np.zeros(len(words), bool)
    if len(words) > 2:
        with np.errstate(over="ignore"):
            key = mix(words[:-2] * np.uint64(3) + mix(words[1:-1]) * np.uint64(5) + mix(words[2:] + np.uint64(1)))
            key = mix(key + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        twice = whole[_twice(key[whole])]
        for j in range(3):
            repeated[twice + j] = True
    # Lines with a word.
    line = np.ones(256, bool)
    line[0x0A] = False
    a, b = runs(texts, line)
    filled = np.searchsorted(starts, b, "left") > np.searchsorted(starts, a, "left")
    a, b = a[filled], b[filled]
    of = owners(texts.offsets, a)
    with np.errstate(over="ignore"):
        line_key = mix(hashes(texts.data, a, b) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(line_key, return_index=True)[1]
    count = lambda at: np.bincount(at, minlength=n).astype(np.int64)
    return {
        "n_words": count(doc),
        "word_chars": np.bincount(doc, (lead[ends] - lead[starts]).astype(float), n).astype(np.int64),
        "n_symbols": symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]],
        "n_dup_lines": count(of) - count(of[first]),
        "n_repeat_words": count(doc[repeated]),
    }


def _twice(keys: np.ndarray) -> np.ndarray:
    """Places of the keys found at least twice."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return np.flatnonzero(hit)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < BASE_LEAST_WORDS) | (100 * counts["n_repeat_words"] > BASE_MOST_REPEATED * n)


def vocabulary(common: dict[str, str]) -> np.ndarray:
    """Sorted hashes of all common words."""
    words = sorted({w.encode() for text in common.values() for w in text.split()})
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.unique(hashes(data, ends - [len(w) for w in words], ends))


def histograms(texts: Texts, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes, and of common words with all other words in the last column."""
    n = len(texts)
    whose = np.repeat(np.arange(n), np.diff(texts.offsets))
    chars = np.bincount(whose * N_CLASSES + CLASSES[texts.data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)[:, 1:]
    low = Texts(LOWER[texts.data], texts.offsets)
    starts, ends = runs(low, ALNUM_WORDS)
    words = hashes(low.data, starts, ends)
    at = np.searchsorted(common, words)
    at[at == len(common)] = 0
    at = np.where(common[at] == words, at, len(common))
    width = len(common) + 1
    doc = owners(low.offsets, starts)
    return chars, np.bincount(doc * width + at, minlength=n * width).reshape(n, width)


def distances(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (0 to 1) of each row from each reference; 1 for a row without counts."""

    def shares(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(x.sum(-1, keepdims=True), 1)

    def entropy(x: np.ndarray) -> np.ndarray:
        return -np.sum(x * np.log2(np.where(x > 0, x, 1)), -1)

    p, q = shares(counts.astype(float))[:, None, :], shares(references.astype(float))[None]
    divergence = entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2
    out = np.sqrt(np.clip(divergence, 0, 1))
    out[counts.sum(-1) == 0] = 1.0
    return out


def language_references(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", common: dict[str, str] | None = None
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Both histograms of each reference language, summed over all documents that name it.

    One row for each batch, language and column is summed by Spark; the driver gets
    languages x columns numbers. A language without documents has no reference.
    """
    common = common or COMMON_WORDS
    vocab, names = vocabulary(common), sorted(common)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), N_CLASSES - 1 + len(vocab) + 1), np.int64)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                chars, words = histograms(texts_of(part.column("text")), vocab)
                both = np.hstack([chars, words])
                tags = np.asarray(part.column("lang").to_pylist(), object)
                for i, name in enumerate(names):
                    total[i] += both[tags == name].sum(0)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], ["lang", "place", "n"]
        )

    named = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(F.col("lang").isin(names))
    rows = named.mapInArrow(count, "lang int, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((len(names), N_CLASSES - 1 + len(vocab) + 1), np.int64)
    for r in rows:
        total[r["lang"], r["place"]] = r["n"]
    return {n: (total[i, : N_CLASSES - 1], total[i, N_CLASSES - 1 :]) for i, n in enumerate(names) if total[i].any()}


def _judge(texts: Texts, vocab: np.ndarray, char_refs: np.ndarray, word_refs: np.ndarray) -> dict[str, np.ndarray]:
    counts = base_counts(texts)
    failed = base_failed(counts)
    chars, words = histograms(texts, vocab)
    # Each distance is that from the language which is nearest by both together.
    by_char, by_word = distances(chars, char_refs), distances(words, word_refs)
    near = np.argmin(by_char + by_word, 1)[:, None] if len(char_refs) else None
    far = lambda d: np.zeros(len(texts)) if near is None else np.take_along_axis(d, near, 1)[:, 0]
    char_distance, word_distance = far(by_char), far(by_word)
    chance = 1 / np.sqrt(np.maximum(counts["n_words"], 1))
    usual = (char_distance <= MOST_CHAR_DISTANCE) & (word_distance <= MOST_WORD_DISTANCE + chance)
    usual |= counts["n_words"] < LEAST_WORDS
    return counts | {"base_failed": failed, "char_distance": char_distance, "word_distance": word_distance, "kept": ~failed & usual}


def _setting(docs: DataFrame, text: str, lang: str):
    refs = language_references(docs, text=text, lang=lang)
    vocab = vocabulary(COMMON_WORDS)
    stack = lambda k, width: np.array([refs[n][k] for n in sorted(refs)]).reshape(len(refs), width)
    return vocab, stack(0, N_CLASSES - 1), stack(1, len(vocab) + 1)


def quality_report(docs: DataFrame, *, row: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, distances and verdict for every row of ``docs``.

    A null or empty text has no words and fails; a text with fewer than ``LEAST_WORDS`` words is judged by the
    plain rules alone. Without any document in a reference language only the plain rules count. Rows with equal
    values each give a row; null row ids stay null. Other columns are not read. No shuffle but that of the references' sums.
    """
    vocab, char_refs, word_refs = _setting(docs, text, lang)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                found = _judge(texts_of(part.column("text")), vocab, char_refs, word_refs)
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, found.values())], ["row", *found])

    source = docs.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"))
    kind = docs.select(F.col(row)).schema[0].dataType.simpleString()
    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    out = source.mapInArrow(judge, f"row {kind}, {counts}, base_failed boolean, char_distance double, word_distance double, kept boolean")
    return out.withColumnRenamed("row", row)


def keep_quality(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality_report`` keeps, with all their columns."""
    vocab, char_refs, word_refs = _setting(docs, text, lang)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, PIECE):
                yield part.filter(pa.array(_judge(texts_of(part.column(text)), vocab, char_refs, word_refs)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
