"""Exact, reproducible train / validation / test splits, plain or stratified.

Rows are ranked by ``md5(seed:key)`` and the first ones of each stratum go to test,
the next to validation. No row is sorted or shuffled for it: hash prefixes are
counted, the prefix that holds a cut is looked at more closely, and a split is then a
comparison of each row's hash with the cut of its stratum.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import as_text, row_digest
from ..functions.types import clean_value
from ..session import cut_lineage
from .lookup import HOT_PARTS, SALTS

PREFIX = 4  # hex digits: 65,536 counts per stratum
MAX_STRATA = 100_000  # up to so many the cuts are broadcast, beyond they are a table like any other
REFINED = 8  # hex digits of the second look, where strata are a table
COPIES_PER_TASK = 100_000
# Names of working columns, which must not meet a column of the table.
LABEL, STRATUM, HASH = "__label", "__stratum", "__hash"


def hash_key(df: DataFrame, key: str | None, seed: int) -> Column:
    """``md5(seed:key)``; without a key column the whole row is the key."""
    value = as_text(df.schema[key]) if key else F.concat_ws(":", *[d.cast("string") for d in row_digest(df)])
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value, F.lit(""))))


def split_sizes(n: int, test_size: float, val_size: float) -> tuple[int, int]:
    """Rows of test and validation: both rounded up, the second from what is left."""
    if not (0 < test_size < 1 and 0 <= val_size and test_size + val_size < 1):
        raise ValueError("test_size and val_size must leave rows for training")
    n_test = ceil(n * test_size)
    n_val = ceil((n - n_test) * (val_size / (1 - test_size))) if val_size else 0
    if n - n_test - n_val < 1:
        raise ValueError(f"{n} rows leave nothing for training")
    return n_test, n_val


def allocate(counts: Sequence[int], draws: int) -> list[int]:
    """Share ``draws`` over classes by largest remainder, ties by class order."""
    total = sum(counts)
    exact = [c / total * draws for c in counts]
    out = [floor(e) for e in exact]
    order = sorted(range(len(counts)), key=lambda i: (-(exact[i] - out[i]), i))
    for i in order[: draws - sum(out)]:
        out[i] += 1
    return out


def _find_cuts(base: DataFrame, wanted: Sequence[tuple[int, int, int]], strata: DataFrame) -> dict:
    """For each ``(stratum number, cut, k)`` the hash of the k-th row of the stratum.

    Returns ``(number, cut) -> (hash, copies at or below, copies in all)``.
    """
    spark = base.sparkSession
    counts = strata
    targets = spark.createDataFrame(list(wanted), f"{STRATUM} int, cut int, k bigint")
    upto = F.sum("n").over(W.partitionBy(STRATUM).orderBy("prefix").rowsBetween(W.unboundedPreceding, 0))
    spots = (
        counts.withColumn("upto", upto)
        .join(F.broadcast(targets), STRATUM)
        .filter((F.col("upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("upto")))
        .select(STRATUM, "cut", "prefix", (F.col("k") - F.col("upto") + F.col("n")).alias("k"))
        .collect()
    )
    if not spots:
        return {}
    spots = spark.createDataFrame(spots, f"{STRATUM} int, cut int, prefix string, k bigint")
    inside = (
        base.join(F.broadcast(spots), [STRATUM, "prefix"]).groupBy(STRATUM, "cut", "k", HASH).agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(W.partitionBy(STRATUM, "cut").orderBy(HASH).rowsBetween(W.unboundedPreceding, 0))
    hits = (
        inside.withColumn("upto", upto)
        .filter((F.col("upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("upto")))
        .select(STRATUM, "cut", HASH, (F.col("k") - F.col("upto") + F.col("n")).alias("take"), "n")
        .collect()
    )
    return {(r[STRATUM], r["cut"]): (r[HASH], r["take"], r["n"]) for r in hits}


def exact_split(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.1,
    key: str | None = None,
    stratify: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` = train, val or test.

    ``key`` is a unique column; without it whole rows are ranked, and which of several
    equal rows goes where makes no difference. ``stratify`` is honoured when every
    class has two rows, and for validation when every class still has two.
    """
    spark = df.sparkSession
    hashed = hash_key(df, key, seed)
    label = clean_value(df.schema[stratify]) if stratify else F.lit(0)
    base = df.select(label.alias(LABEL), hashed.alias(HASH)).withColumn("prefix", F.substring(HASH, 1, PREFIX))
    prefixes = base.groupBy(LABEL, "prefix").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        totals = prefixes.groupBy(F.col(LABEL).alias("label")).agg(F.sum("n").alias("n")).limit(MAX_STRATA + 1).collect()
        if not totals:
            return df.withColumn("split", F.lit("train"))
        if len(totals) > MAX_STRATA:
            return _split_many(df, base, prefixes, label, hashed, test_size, val_size, key, seed)
        totals = sorted(totals, key=lambda r: (r["label"] is not None, r["label"]))
        smallest = min((r["n"] for r in totals if r["label"] is not None), default=0)
        stratified = bool(stratify) and smallest >= 2
        if not stratified:
            totals = [{"label": None, "n": sum(r["n"] for r in totals)}]
        sizes = [r["n"] for r in totals]
        n = sum(sizes)
        n_test, n_val = split_sizes(n, test_size, val_size)
        keep = allocate(sizes, n - n_test)
        test = [c - k for c, k in zip(sizes, keep)]
        joint = not stratified or min(keep) >= 2
        val = [c - k for c, k in zip(keep, allocate(keep, n - n_test - n_val))] if joint else [0] * len(keep)

        if stratified:
            numbers = spark.createDataFrame(
                [(r["label"], i) for i, r in enumerate(totals)],
                f"__class {df.schema[stratify].dataType.simpleString()}, {STRATUM} int",
            )
            number = lambda t: t.join(F.broadcast(numbers), F.col(LABEL).eqNullSafe(F.col("__class"))).drop("__class")
        else:
            number = lambda t: t.withColumn(STRATUM, F.lit(0))
        counts = number(prefixes).groupBy(STRATUM, "prefix").agg(F.sum("n").alias("n"))
        wanted = []
        for i in range(len(sizes)):
            wanted += [(i, 0, test[i])] if test[i] else []
            wanted += [(i, 1, test[i] + val[i])] if val[i] else []
        cuts = _find_cuts(number(base), wanted, counts)
        marked = number(df.withColumns({LABEL: label, HASH: hashed}))
        out = _label(marked, cuts, test, val, by_key=key is not None)
    finally:
        prefixes.unpersist()
    out = out.drop(LABEL, STRATUM, HASH)
    if joint or not n_val:
        return out
    return _without_strata(out, n, n_test, n_val, key, seed)


def _label(marked: DataFrame, cuts: dict, test: Sequence[int], val: Sequence[int], by_key: bool) -> DataFrame:
    spark = marked.sparkSession
    rows, mixed = [], []
    for s in range(len(test)):
        last_test, taken_test, all_test = cuts.get((s, 0), ("", 0, 0))
        last_val, taken_val, all_val = cuts.get((s, 1), ("", 0, 0))
        if taken_test < all_test or taken_val < all_val:
            for h in {last_test, last_val} - {""}:
                at_test = taken_test if h == last_test else 0
                upto_val = taken_val if h == last_val else at_test
                copies = all_test if h == last_test else all_val
                if h == last_test and last_val > h:
                    upto_val = copies
                if at_test < copies and (at_test or upto_val < copies):
                    mixed.append((s, h, at_test, upto_val - at_test, copies - upto_val))
        rows.append((s, last_test, last_val))
    if mixed and by_key:
        raise ValueError("the key repeats where a split must be cut: use a unique key, or none")
    ends = {"__last_test": 1, "__last_val": 2}
    if len(rows) == 1:
        bounded = marked.withColumns({name: F.lit(rows[0][i]) for name, i in ends.items()})
    else:
        table = spark.createDataFrame(rows, f"{STRATUM} int, __last_test string, __last_val string")
        bounded = marked.join(F.broadcast(table), STRATUM)
    part = F.when(F.col(HASH) <= F.col("__last_test"), "test").when(F.col(HASH) <= F.col("__last_val"), "val")
    placed = bounded.withColumn("split", part.otherwise("train")).drop(*ends)
    if not mixed:
        return placed
    shares = [(s, h, [(p, n) for p, n in zip(("test", "val", "train"), sizes) if n]) for s, h, *sizes in mixed]
    groups = spark.createDataFrame(shares, f"{STRATUM} int, {HASH} string, __parts array<struct<split:string,n:bigint>>")
    return _spread(placed, F.broadcast(groups), STRATUM)


def _spread(placed: DataFrame, groups: DataFrame, stratum: str) -> DataFrame:
    """Equal rows on both sides of a cut: keep one of them and repeat it as often as each part needs, in bounded pieces."""
    groups = groups.select(F.col(stratum).alias("__g"), F.col(HASH).alias("__gh"), "__parts")
    same = F.col(stratum).eqNullSafe(F.col("__g")) & (F.col(HASH) == F.col("__gh"))
    alone = placed.join(groups, same, "left_anti")
    step = F.lit(COPIES_PER_TASK).cast("bigint")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    pieces = (
        placed.drop("split")
        .join(groups, same)
        .drop("__g", "__gh")
        .dropDuplicates([stratum, HASH])
        .withColumn("__part", F.explode("__parts"))
        .withColumn("__from", F.explode(F.sequence(zero, F.col("__part.n") - 1, step)))
        .repartition(stratum, HASH, "__part", "__from")
        .withColumn("__i", F.explode(F.sequence(one, F.least(F.col("__part.n") - F.col("__from"), step))))
        .withColumn("split", F.col("__part.split"))
        .drop("__parts", "__part", "__from", "__i")
    )
    return alone.unionByName(pieces)


def allocate_table(strata: DataFrame, size: str, draws: int, out: str) -> DataFrame:
    """``allocate`` over a table: adds ``out``, the share of ``draws`` of each row's ``size`` by largest remainder, ties by label.

    The remainders are ranked by ranges: rows are dealt to ranges of (remainder, label), sorted there and written with their places,
    and only the sizes of the ranges are summed up in one place.
    """
    total = strata.agg(F.sum(size).alias("n")).first()["n"]
    exact = F.col(size).cast("double") / F.lit(float(total)) * F.lit(float(draws))
    shared = strata.withColumn(out, F.floor(exact).cast("bigint")).withColumn("__rest", exact - F.floor(exact))
    order = [F.desc("__rest"), F.asc_nulls_first(LABEL)]
    ranges = int(strata.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = shared.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.withColumn("__range", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()), "shares")
    sums = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("first"), F.sum(out).alias("given"))
    left = draws - sum(r["given"] for r in sums.collect())  # one row for each range
    earlier = F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sums.select("__range", (earlier - F.col("first")).alias("__shift"))
    ranked = placed.join(F.broadcast(shifts), "__range")
    more = (F.col("__place") + F.col("__shift") < left).cast("bigint")
    return ranked.withColumn(out, F.col(out) + more).drop("__rest", "__range", "__place", "__shift")


def _split_many(
    df: DataFrame, base: DataFrame, prefixes: DataFrame, label: Column, hashed: Column, test_size: float, val_size: float, key: str | None, seed: int
) -> DataFrame:
    """``exact_split`` where strata are too many to be listed: shares, cuts and rows meet by joins on the label.

    The k-th hash of a stratum is looked for prefix by prefix, so that no task sees more than the counts of 65,536
    buckets of one stratum, and at the end the rows of one bucket of ``REFINED`` digits. Labels with many rows are broadcast in the last join.
    """
    strata = cut_lineage(prefixes.groupBy(LABEL).agg(F.sum("n").alias("n")), "strata")
    facts = strata.agg(F.sum("n").alias("n"), F.min(F.when(F.col(LABEL).isNotNull(), F.col("n"))).alias("least")).first()
    n = facts["n"]
    if facts["least"] < 2:
        return exact_split(df, test_size, val_size, key, None, seed)
    n_test, n_val = split_sizes(n, test_size, val_size)
    shares = allocate_table(strata, "n", n - n_test, "keep")
    joint = shares.agg(F.min("keep").alias("k")).first()["k"] >= 2
    if joint and n_val:
        shares = allocate_table(shares, "keep", n - n_test - n_val, "train")
    else:
        shares = shares.withColumn("train", F.col("keep"))
    shares = cut_lineage(shares.select(LABEL, "n", (F.col("n") - F.col("keep")).alias("test"), (F.col("keep") - F.col("train")).alias("val")), "shares")

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    wanted = F.array(
        F.struct(F.lit(0).alias("cut"), F.when(F.col("test") > 0, F.col("test")).alias("k")),
        F.struct(F.lit(1).alias("cut"), F.when(F.col("val") > 0, F.col("test") + F.col("val")).alias("k")),
    )
    spots = shares.select(F.col(LABEL).alias("__l"), F.inline(wanted)).filter("k is not null").withColumn("bucket", F.lit(""))
    counts = prefixes.withColumnRenamed("prefix", "next").join(spots, same(LABEL, "__l")).drop("__l", "bucket")
    for digits in (PREFIX, REFINED, 32):
        if digits > PREFIX:
            bucket = F.substring(HASH, 1, found_digits)
            rows = base.select(LABEL, F.substring(HASH, 1, digits).alias("next"), bucket.alias("__b"))
            counts = rows.join(spots, same(LABEL, "__l") & (F.col("__b") == F.col("bucket"))).groupBy(LABEL, "cut", "k", "next").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.partitionBy(LABEL, "cut").orderBy("next").rowsBetween(W.unboundedPreceding, 0))
        hits = counts.withColumn("upto", upto).filter((F.col("upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("upto")))
        take = F.col("k") - F.col("upto") + F.col("n")
        spots = cut_lineage(hits.select(F.col(LABEL).alias("__l"), "cut", F.col("next").alias("bucket"), take.alias("k"), "n"), "cuts")
        found_digits, spots = digits, spots if digits == 32 else spots.drop("n")
    pick = lambda cut, c: F.max(F.when(F.col("cut") == cut, F.col(c)))
    cuts = spots.groupBy("__l").agg(
        *[F.coalesce(pick(c, "bucket"), F.lit("")).alias(f"last_{p}") for c, p in enumerate(("test", "val"))],
        *[F.coalesce(pick(c, x), F.lit(0)).alias(f"{y}_{p}") for c, p in enumerate(("test", "val")) for x, y in (("k", "taken"), ("n", "all"))],
    )
    ends = cut_lineage(shares.join(cuts, same(LABEL, "__l"), "left").drop("__l").na.fill("", ["last_test", "last_val"]).na.fill(0), "ends")

    # Hot labels are broadcast, of the others one row meets the rows of each; rows already served are dealt out at random.
    hot = F.col("n") > F.lit(n / HOT_PARTS)
    at = lambda name: [F.col(LABEL).alias(f"__{name}"), F.struct("last_test", "last_val").alias(f"__{name}_ends")]
    marked = df.withColumns({LABEL: label, HASH: hashed}).join(F.broadcast(ends.filter(hot).select(*at("hot"))), same(LABEL, "__hot"), "left")
    served = F.col("__hot_ends").isNotNull()
    salt = F.when(served, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)) + 1).otherwise(0)
    marked = marked.withColumns({"__key": F.when(~served, F.col(LABEL)), "__salt": salt})
    cold = ends.filter(~hot).select(*at("cold"), F.lit(0).cast("bigint").alias("__none"))
    marked = marked.join(cold, same("__key", "__cold") & (F.col("__salt") == F.col("__none")), "left")
    last = F.coalesce("__hot_ends", "__cold_ends")
    part = F.when(F.col(HASH) <= last["last_test"], "test").when(F.col(HASH) <= last["last_val"], "val").otherwise("train")
    placed = marked.withColumn("split", part).drop("__hot", "__hot_ends", "__key", "__salt", "__cold", "__cold_ends", "__none")

    h, test_here, val_here = F.col(HASH), F.col(HASH) == F.col("last_test"), F.col(HASH) == F.col("last_val")
    in_test = F.when(test_here, F.col("taken_test")).otherwise(F.lit(0))
    copies = F.when(test_here, F.col("all_test")).otherwise(F.col("all_val"))
    upto_val = F.when(test_here & (F.col("last_val") > h), copies).when(val_here, F.col("taken_val")).otherwise(in_test)
    shared = ends.withColumn(HASH, F.explode(F.filter(F.array_distinct(F.array("last_test", "last_val")), lambda x: x != "")))
    shared = shared.filter((in_test < copies) & ((in_test > 0) | (upto_val < copies)))
    sizes = [("test", in_test), ("val", upto_val - in_test), ("train", copies - upto_val)]
    parts_of = F.filter(F.array(*[F.struct(F.lit(p).alias("split"), c.cast("bigint").alias("n")) for p, c in sizes]), lambda x: x["n"] > 0)
    groups = cut_lineage(shared.select(LABEL, HASH, parts_of.alias("__parts")), "shared_rows")
    if not groups.isEmpty():
        if key is not None:
            raise ValueError("the key repeats where a split must be cut: use a unique key, or none")
        placed = _spread(placed, groups, LABEL)
    out = placed.drop(LABEL, HASH)
    return out if joint or not n_val else _without_strata(out, n, n_test, n_val, key, seed)


def _without_strata(out: DataFrame, n: int, n_test: int, n_val: int, key: str | None, seed: int) -> DataFrame:
    """Some class is down to one row: validation is drawn from the rest without strata."""
    rest = out.filter(F.col("split") != "test").drop("split")
    rest = exact_split(rest, n_val / (n - n_test), 0.0, key, None, seed)
    rest = rest.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return out.filter(F.col("split") == "test").unionByName(rest)


def split_manifest(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def parts(split: DataFrame, *names: str) -> DataFrame:
    """The rows of the named parts together."""
    return split.filter(F.col("split").isin(*names)).drop("split")
