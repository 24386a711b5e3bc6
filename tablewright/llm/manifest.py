"""A Merkle manifest of a dataset (DataFrame functions only), over concatenated level strings.

Leaves are ranked within their group. Each aligned block of ``ARITY ** LEVELS`` following nodes keeps a level of the tree as
one string of hexadecimal digests; fixed-width substrings of it hash to the parents, which are the next level's
string. The tops of the blocks are the nodes of the next round, until every group has one node left, its subroot. The
subroots, in order of their group, are the leaves of one more tree. Going down again, what stands left and right of a
node in its run are its sibling segments, and a block hands those of its top to all its nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Children of a node.
ARITY = 16
#: Levels that are hashed within a block before its top moves on: 256 nodes, 16 KiB of digests.
LEVELS = 2
BLOCK = ARITY**LEVELS
#: Hexadecimal digits of a digest.
WIDTH = 64
SEGMENTS = "array<struct<left:binary,right:binary>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """The leaf of a row with these field values."""
    return F.sha2(F.encode(F.concat(*map(field_text, fields)), "UTF-8"), 256)


def _ranked(leaves: DataFrame) -> DataFrame:
    """``rank`` from 0 and ``total`` within ``part`` by ``key``, ``digest``, whatever the size of a part.

    Rows go to ranges of (part, key, digest, row number), are sorted there and written with their places, so that a part with a
    third of all rows covers as many ranges as its share. What a range adds to the rank of a row is the number of rows
    of its part in earlier ranges: one row for each range and part in it.
    """
    order = ["part", "key", "digest"]
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = leaves.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(n, *order, "at").sortWithinPartitions(*order, "at")
    placed = cut_lineage(
        placed.drop("at").withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "manifest_ranks"
    )
    ranges = placed.groupBy("part", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("part").alias("part_"),
        F.col("range").alias("range_"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("part")).alias("total"),
    )
    found = placed.join(ranges, (F.col("range") == F.col("range_")) & F.col("part").eqNullSafe(F.col("part_")))
    return found.select("part", "total", (F.col("place") + F.col("shift")).alias("rank"), "digest", "m")


def _pieces(level: Column, width: int) -> Column:
    """The ``width`` byte substrings of a level string, the last one shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(level), F.lit(1)), F.lit(width))
    return F.transform(starts, lambda i: F.substring(level, i, F.lit(width)))


def _level(digests: Column) -> Column:
    """A level string: its bytes, so that substrings are taken without counting characters."""
    return F.encode(F.array_join(digests, ""), "US-ASCII")


def _levels(level: Column, whole: Column) -> Column:
    """All level strings of a block from the nodes up to its top; ``whole``: the block is all that its part has."""
    found = F.array(level)
    for _ in range(LEVELS):
        top = F.element_at(found, -1)
        parents = _level(F.transform(_pieces(top, ARITY * WIDTH), lambda run: F.sha2(run, 256)))
        found = F.when(whole & (F.octet_length(top) <= WIDTH), found).otherwise(F.concat(found, F.array(parents)))
    return found


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row for each aligned block of ``nodes`` (part, total, rank, digest, and in the first round m)."""
    members = F.array_sort(F.collect_list(F.struct("rank", "digest", *(["m"] if "m" in nodes.columns else []))))
    found = (
        nodes.groupBy("part", "total", F.floor(F.col("rank") / BLOCK).cast("bigint").alias("block"))
        .agg(members.alias("members"))
        .withColumn("levels", _levels(_level(F.col("members.digest")), F.col("total") <= BLOCK))
        .withColumn("top", F.decode(F.element_at("levels", -1), "US-ASCII"))
    )
    return found.withColumn("members", F.col("members.m")) if "m" in nodes.columns else found.drop("members")


def _siblings(levels: Column, place: Column) -> Column:
    """The segments left and right of a block's node in its run, on each level below the block's top."""

    def at(level: Column, k: Column) -> Column:
        step = F.lit(ARITY).cast("double")
        own = F.floor(place / F.pow(step, k)).cast("int")  # the node's ancestor on this level
        first = own - own % ARITY
        left = F.substring(level, first * WIDTH + 1, (own - first) * WIDTH)
        right = F.substring(level, (own + 1) * WIDTH + 1, (first + ARITY - 1 - own) * WIDTH)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), at)


def _tree(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The subroot (part, digest) of every part of ``leaves`` (part, key, digest, m), and the blocks of all rounds, each a written table."""
    nodes, rounds = _ranked(leaves), []
    while True:
        rounds.append(cut_lineage(_blocks(nodes), "manifest_blocks"))
        # A part whose block is all it has is done; the others send the tops of their blocks on.
        more = rounds[-1].filter(F.col("total") > BLOCK)
        if more.isEmpty():
            break
        nodes = more.select("part", F.ceil(F.col("total") / BLOCK).cast("bigint").alias("total"), F.col("block").alias("rank"), F.col("top").alias("digest"))
    tops = [b.filter(F.col("total") <= BLOCK).select("part", F.col("top").alias("digest")) for b in rounds]
    return reduce(DataFrame.unionByName, tops), rounds


def _descend(rounds: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the first round with ``upper``, the sibling segments above their tops.

    ``above``: (part, upper, and more columns that are handed down) for the subroots, one row for each part. On every round
    one row for each block is joined.
    """
    more = [c for c in above.columns if c not in ("part", "upper")]
    above = above.withColumnsRenamed({"part": "part_"})
    handed: DataFrame | None = None
    for k in range(len(rounds) - 1, -1, -1):
        blocks = rounds[k]
        ends = blocks.filter(F.col("total") <= BLOCK).join(above, F.col("part").eqNullSafe(F.col("part_"))).drop("part_")
        if handed is not None:
            inner = blocks.filter(F.col("total") > BLOCK).join(handed, F.col("part").eqNullSafe(F.col("part_")) & (F.col("block") == F.col("block_")))
            ends = ends.unionByName(inner.drop("part_", "block_"))
        if k == 0:
            return ends
        places = F.sequence(F.lit(0), (F.octet_length(F.col("levels")[0]) / WIDTH).cast("int") - 1)
        each = ends.select("part", "block", "levels", "upper", *more, F.explode(places).alias("place"))
        handed = each.select(
            *more,
            F.col("part").alias("part_"),
            (F.col("block") * BLOCK + F.col("place")).alias("block_"),
            F.concat(_siblings(F.col("levels"), F.col("place")), F.col("upper")).alias("upper"),
        )
    raise ValueError("a tree has at least one round")


def manifest(
    docs: DataFrame, fields: Sequence[str], *, group: str = "source", order: str = "doc_id", carry: Sequence[str] = ()
) -> DataFrame:
    """``(<order>, <group>, <carry...>, leaf, subroot, root, proof)`` for every row of ``docs``.

    ``leaf`` is the digest of ``fields``; the leaves of a ``group`` ascend by ``order``, then leaf, nulls first. While a group has more
    than one node, every ``ARITY`` following ones become their digest, the last run being shorter, even of one. What remains, of a
    group with one row the leaf itself, is its ``subroot``; subroots ordered by group (null first, then by UTF-8 bytes) give
    ``root`` likewise. ``proof`` holds the segments left and right of the node's place in its run for each level up to the
    root; ``fold`` gives the root back from it. All digests are lower-case hexadecimal, in ``proof`` as bytes.

    Null fields count as null, empty and long texts as they are. Equal rows have equal leaves and one place each. An empty
    table gives no row. Only digests, ``order``, ``group`` and the narrow columns ``carry`` are shuffled; other columns are not read.
    Groups of any size are dealt in ranges, then in blocks of ``BLOCK`` rows; proofs are made where they are returned.
    """
    # Written before it is dealt, so that texts are hashed once and not again to find the ranges.
    leaf = F.unhex(leaf_digest(*map(F.col, fields)))
    m = F.struct(F.col(order).alias("key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    leaves = cut_lineage(docs.select(F.col(group).cast("string").alias("part"), leaf.alias("digest"), m.alias("m")), "manifest_leaves")
    subroots, rounds = _tree(leaves.select("part", F.col("m.key").alias("key"), F.lower(F.hex("digest")).alias("digest"), "m"))

    # The subroots are one part, ordered by their group.
    groups = subroots.select(F.lit("").alias("part"), F.col("part").alias("key"), "digest", F.col("part").alias("m"))
    roots, upper_rounds = _tree(groups)
    root = roots.first()  # of the one part, or none of an empty table
    blocks = _descend(upper_rounds, roots.select("part", F.array().cast(SEGMENTS).alias("upper")))
    above = _members(blocks).select(
        F.col("m").alias("part"), F.col("proof").alias("upper"), F.col("leaf").alias("subroot"), F.lit(root and root["digest"]).cast("string").alias("root")
    )
    found = _members(_descend(rounds, cut_lineage(above, "manifest_proofs")), "part", "subroot", "root")
    carried = [F.col(f"m.c{i}").alias(c) for i, c in enumerate(carry)]
    return found.select(F.col("m.key").alias(order), F.col("part").alias(group), *carried, "leaf", "subroot", "root", "proof")


def _members(blocks: DataFrame, *keep: str) -> DataFrame:
    """One row for each node of first-round blocks with ``upper``: ``m``, leaf and proof."""
    leaf = F.decode(F.substring(F.col("levels")[0], F.col("place") * WIDTH + 1, F.lit(WIDTH)), "US-ASCII")
    proof = F.concat(_siblings(F.col("levels"), F.col("place")), F.col("upper"))
    each = blocks.select(*keep, "levels", "upper", F.posexplode("members").alias("place", "m"))
    return each.select(*keep, "m", leaf.alias("leaf"), proof.alias("proof"))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof from the leaf up, left to right."""
    return F.aggregate(proof, F.lit(b""), lambda text, s: F.concat(text, s["left"], s["right"]))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the sibling segments of its proof."""
    node = F.aggregate(
        proof, F.encode(leaf, "US-ASCII"), lambda node, s: F.encode(F.sha2(F.concat(s["left"], node, s["right"]), 256), "US-ASCII")
    )
    return F.decode(node, "US-ASCII")
