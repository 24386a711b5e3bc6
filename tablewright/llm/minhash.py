"""Near-duplicates by b-bit MinHash.

Each text's set of word shingles gets ``PERMUTATIONS`` minima. Whole minima are only used for the keys of
bands; what is kept is their lowest two bits, packed. For two texts that share a band, the packed bits give
an estimate of their similarity that is corrected for bits which agree by chance. Pairs that are not
clearly too far apart are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage
from ._rows import PLACE, steady
from ._words import BLANK_WORDS, hashes, mix, owners, pieces, randoms, runs, texts_of, windows

SHINGLE = 5
SIMILAR = (3, 4)
#: 42 bands of 6 minima: two texts with a similarity of 0.75 share a band with probability 0.9997.
BANDS, ROWS = 42, 6
PERMUTATIONS, BITS = 256, 2
WORDS64 = PERMUTATIONS // 64
#: Standard errors by which an estimate may fall short of the threshold.
MARGIN = 5.0
#: Members of a bucket compared at once.
TILE = 256

_A = (randoms(PERMUTATIONS, 11) >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
_B = (randoms(PERMUTATIONS, 13) >> np.uint64(24)).astype(np.uint32)


def shingle_sets(texts, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``k`` words; all words as one run when there are fewer."""
    starts, ends = runs(texts, BLANK_WORDS)
    words = hashes(texts.data, starts, ends)
    edges = np.searchsorted(owners(texts.offsets, starts), np.arange(len(texts) + 1))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = words[a:b]
        # Words are hashed with their number below k, so a short text never equals a run of a longer one.
        out.append(np.unique(windows(own, k)) if b - a >= k else windows(own, b - a, 7 + b - a) if b > a else own)
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each permutation of a set's 32-bit values."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(small), 512):
        np.minimum(low, (small[i : i + 512] * _A[:, None] + _B[:, None]).min(1), out=low)
    return low


def packed_bits(low: np.ndarray) -> np.ndarray:
    """The lowest two bits of each minimum in two bit planes, as signed 64-bit words: plane 0, then plane 1."""
    planes = [np.packbits((low >> np.uint32(p)) & np.uint32(1), bitorder="little").view("<i8") for p in range(BITS)]
    return np.concatenate(planes)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        return mix((rows * randoms(ROWS, 17)).sum(1, dtype=np.uint64) + randoms(BANDS, 19)).astype(np.int64)


def least_agreeing(similar: tuple[int, int] = SIMILAR) -> int:
    """Minima whose kept bits must agree for a pair to be confirmed on its sets.

    Bits agree with probability s + (1 - s) / 2**b at a similarity s; the bound lies ``MARGIN`` standard errors below that of the threshold.
    """
    s = similar[0] / similar[1]
    p = s + (1 - s) / 2**BITS
    return math.floor(PERMUTATIONS * p - MARGIN * math.sqrt(PERMUTATIONS * p * (1 - p)))


def agreeing(a: str, b: str) -> Column:
    """How many minima agree in their kept bits, from two packed signatures."""
    differ = [
        F.bit_count(F.expr(f"({a}[{i}] ^ {b}[{i}]) | ({a}[{i + WORDS64}] ^ {b}[{i + WORDS64}])")) for i in range(WORDS64)
    ]
    return F.lit(PERMUTATIONS) - sum(differ[1:], differ[0])


def estimate(agree: Column) -> Column:
    """Similarity estimated from agreeing minima, corrected for agreement by chance."""
    chance = 1 / 2**BITS
    return (agree / F.lit(PERMUTATIONS) - chance) / (1 - chance)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            sets = shingle_sets(texts_of(part.column("text"), lower=True))
            n = np.array([len(s) for s in sets], np.int64)
            with np.errstate(over="ignore"):
                h1 = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                h2 = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            low = [minima(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("place"), part.column("id"), pa.array(n), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                    pa.array([packed_bits(x) for x in low], pa.list_(pa.int64())), pa.array([band_keys(x) for x in low], pa.list_(pa.int64())),
                ],
                ["place", "id", "n", "h1", "h2", "bits", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            sets = shingle_sets(texts_of(part.column("text"), lower=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"]
            )


def _across(least: int, similar: tuple[int, int]):
    """Confirmed links of a tile between different components, no more than join them.

    Pairs whose kept bits agree often enough are confirmed on their sets, unless links found before have joined their components.
    """
    low, of = similar

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        # Unsigned: bits of a negative number would be counted in its absolute value.
        a, b = (np.array(x["bits"].tolist(), np.int64).reshape(-1, BITS * WORDS64).view(np.uint64) for x in (left, right))
        names, roots = np.unique(rows["root"], return_inverse=True)
        component = np.arange(len(names))
        mine, theirs = roots[rows["side"] == 0], roots[rows["side"] == 1]
        sets, nodes, out = right["shingles"].to_list(), right["node"].to_numpy(), []
        for i, (node, own) in enumerate(zip(left["node"], left["shingles"])):
            differ = np.bitwise_count((a[i, :WORDS64] ^ b[:, :WORDS64]) | (a[i, WORDS64:] ^ b[:, WORDS64:])).sum(1)
            for k in np.flatnonzero((PERMUTATIONS - differ >= least) & (component[theirs] != component[mine[i]])):
                x, y = component[mine[i]], component[theirs[k]]
                if x == y:
                    continue
                common = len(np.intersect1d(own, sets[k], assume_unique=True))
                if common * of >= low * (len(own) + len(sets[k]) - common):
                    component[component == y] = x
                    out.append((min(node, nodes[k]), max(node, nodes[k])))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return compare


def _confirm(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    least, of = similar
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("common", common)
        .filter(F.col("common") * of >= least * (F.size("sa") + F.size("sb") - F.col("common")))
        .select("a", "b")
    )


def _by_node(mixed: DataFrame) -> DataFrame:
    """Places in open buckets as one row a node, which has at most one for each band: bits and sets meet a node once, not once a bucket."""
    places = F.collect_list(F.struct("key", "out", "outside", "all")).alias("places")
    return mixed.groupBy("node").agg(F.first("root").alias("root"), places)


def near_duplicates(
    docs: DataFrame, *, row: str = "doc_id", text: str = "text", similar: tuple[int, int] = SIMILAR, tile: int = TILE
) -> DataFrame:
    """``(place, <row>, n_shingles, component_id, keeper)`` for every row of ``docs``.

    Rows whose shingle sets have a Jaccard similarity of at least ``similar`` are linked; ``component_id`` is the smallest
    row id that can be reached over links. ``keeper`` marks one row of each component, that with the smallest id and, of equal
    ids, the first. Null and empty texts have an empty set and are linked with nothing. A null id counts as the largest. Repeated rows are
    copies like others. An empty table gives no row. Other columns are not read. ``place`` is the stored
    number of the row (``_rows.steady``), which ``docs`` may bring along.

    Texts with equal sets are one node. Each node is compared with the first node of every band bucket; only buckets in which that
    leaves several components are compared further, in tiles, and only across components; a tile returns fewer links than it has
    components. So neither copies nor a large group of near copies is paired out. Sets are fetched for nodes that share a bucket only.
    """
    docs = steady(docs, row, text)
    kind = docs.select(F.col(row)).schema[0].dataType.simpleString()
    source = docs.select(F.col(PLACE).alias("place"), F.col(row).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"place bigint, id {kind}, n bigint, h1 bigint, h2 bigint, bits array<bigint>, bands array<bigint>"
    signed = cut_lineage(source.mapInArrow(_sign, schema), "signatures")
    nodes = cut_lineage(
        signed.filter("n > 0")
        .groupBy("h1", "h2", "n")
        .agg(
            F.min("place").alias("node"),
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first"),
            F.first("bits").alias("bits"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = cut_lineage(members.join(buckets, "key"), "buckets")

    bits = nodes.select("node", "bits")
    starred = shared.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    least = least_agreeing(similar)
    near = (
        starred.join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bb")), "b")
        .join(bits.select(F.col("node").alias("a"), F.col("bits").alias("ba")), "a")
        .filter(agreeing("ba", "bb") >= least)
        .select("a", "b")
    )
    wanted = shared.select(F.col("node").alias("place")).distinct()
    texts = source.select("place", "text").join(wanted, "place").select(F.col("place").alias("node"), "text")
    sets = cut_lineage(texts.mapInArrow(_sets, "node bigint, shingles array<bigint>"), "sets")
    links = cut_lineage(_confirm(near, sets, similar), "links")
    roots = cut_lineage(connected_components(links), "roots")

    # Buckets of several components: every member outside the leader's component against all others. Roots meet nodes, not the
    # places of nodes in buckets, of which a large group of near copies has many.
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("bands").alias("key"))
    open_ = (
        rooted.groupBy("key")
        .agg(
            F.min(F.struct("node", "root"))["root"].alias("leading"),
            F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("all"),
        )
        .filter("low < high AND all > 2")
    )
    open_ = cut_lineage(open_.drop("low", "high"), "open")
    mixed = rooted.join(open_, "key").withColumn("out", F.col("root") != F.col("leading"))
    outside = mixed.filter("out").groupBy("key").agg(F.count(F.lit(1)).alias("outside"))
    mixed = _by_node(mixed.join(outside, "key")).join(bits, "node").join(sets, "node").select("*", F.inline("places")).drop("places")
    parts = lambda n: F.ceil(F.col(n) / tile).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), parts(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    columns = ["node", "root", "bits", "shingles"]
    left = mixed.filter("out").select("key", own("outside").alias("i"), every("all").alias("j"), F.lit(0).alias("side"), *columns)
    right = mixed.select("key", every("outside").alias("i"), own("all").alias("j"), F.lit(1).alias("side"), *columns)
    crossing = left.unionByName(right).groupBy("key", "i", "j").applyInPandas(_across(least, similar), "a bigint, b bigint")
    links = links.unionByName(crossing.distinct())
    roots = connected_components(links)

    labelled = nodes.select("h1", "h2", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    leaders = labelled.groupBy("root").agg(F.min("first").alias("lead"))
    named = labelled.join(leaders, "root").select("h1", "h2", "lead")
    some = signed.filter("n > 0").select("place", "id", "n", "h1", "h2").join(named, ["h1", "h2"])
    alone = signed.filter("n = 0").select("place", "id", "n", F.struct(F.col("id").isNull().alias("none"), "id", "place").alias("lead"))
    found = some.select("place", "id", "n", "lead").unionByName(alone)
    return found.select(
        "place", F.col("id").alias(row), F.col("n").alias("n_shingles"), F.col("lead.id").alias("component_id"),
        (F.col("place") == F.col("lead.place")).alias("keeper"),
    )


def drop_near_duplicates(docs: DataFrame, *, row: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``keeper`` rows of ``docs``, with all their columns."""
    rows = steady(docs)
    keep = near_duplicates(rows, row=row, text=text).filter("keeper").select(F.col("place").alias(PLACE))
    return rows.join(keep, PLACE, "left_semi").select(*docs.columns)
