"""Turning prepared tables into feature vectors and coded labels.

Fitted constants travel inside ``SQLTransformer`` stages, so a saved
``PipelineModel`` holds the whole path from raw columns to predictions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.types import as_double, clean_value, is_bool, is_datetime, is_number, quoted
from ..session import cut_lineage
from .distributions import modes
from .lookup import BROADCAST_ROWS, local_copy
from .profile import IDENTIFIER_HINTS, infer_roles
from .quantiles import quantiles
from .value_counts import value_counts

UNUSED_ROLES = ("identifier", "text", "datetime", "datetime_candidate")


def model_columns(
    df: DataFrame, target: str | None = None, roles: Mapping[str, str] | None = None, counts: DataFrame | None = None
) -> list[str]:
    """Columns that enter a model: all but identifiers, texts and dates; target kept."""
    roles = roles or infer_roles(df, target, counts=counts)
    return [c for c in df.columns if c == target or roles[c] not in UNUSED_ROLES]


def counted_columns(df: DataFrame, target: str | None, roles: Mapping[str, str] | None) -> list[str]:
    """Columns whose values have to be counted before a fit: those with modes and levels, and numbers that may be identifiers by their name.

    All other numbers, booleans and times have their role by type, and nothing else is read off their counts.
    """
    hinted = lambda f: roles is None and is_number(f.dataType) and any(h in f.name.lower() for h in IDENTIFIER_HINTS)
    typed = lambda f: is_number(f.dataType) or is_bool(f.dataType) or is_datetime(f.dataType)
    return [f.name for f in df.schema if f.name != target and (hinted(f) or not typed(f))]


def numeric_stats(
    df: DataFrame, columns: Sequence[str], method: str = "exact"
) -> dict[str, tuple[float, float, float]]:
    """Median, and mean and population deviation after filling with it.

    A column without values is left out; one without spread gets deviation 1.
    """
    medians = {c: q[0] for c, q in quantiles(df, list(columns), [0.5], method).items() if q[0] is not None}
    if not medians:
        return {}
    aggs = []
    for i, (name, median) in enumerate(medians.items()):
        value = F.coalesce(as_double(df, name), F.lit(float(median)))
        aggs += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {name: (float(m), row[f"m{i}"], row[f"s{i}"] or 1.0) for i, (name, m) in enumerate(medians.items())}


def standardize(df: DataFrame, columns: Sequence[str], method: str = "exact") -> DataFrame:
    """Fill with the median, then scale to mean 0 and population deviation 1."""
    stats = numeric_stats(df, columns, method)
    return df.withColumns(
        {
            c: (F.coalesce(as_double(df, c), F.lit(median)) - F.lit(mean)) / F.lit(deviation)
            for c, (median, mean, deviation) in stats.items()
        }
    )


@dataclass
class Preprocessor:
    """Fitted preprocessing: ``stages`` produce a ``features`` vector."""

    numeric: list[str]
    categorical: list[str]
    stages: list[Transformer] = field(default_factory=list)

    @property
    def model(self) -> PipelineModel:
        return PipelineModel(stages=self.stages)


def _double_sql(name: str, dtype) -> str:
    if is_bool(dtype):
        return f"CAST(CAST({quoted(name)} AS INT) AS DOUBLE)"
    return f"NULLIF(CAST({quoted(name)} AS DOUBLE), CAST('NaN' AS DOUBLE))"


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _indexer(
    df: DataFrame, counted: list[str], strings: list[str], counts: DataFrame, levels: list[str], prepare: Transformer
) -> list[Transformer]:
    """Numbers for the levels of each string column in alphabetical order, the unseen last. ``counts`` are of the columns ``counted``."""
    outputs = [f"{c}i" for c in levels]
    places = [counted.index(c) for c in strings]
    held = counts.filter(F.col("position").isin(places) & F.col("text").isNotNull())
    plain = all(isinstance(df.schema[c].dataType, T.StringType) for c in strings)
    if not plain or not held.filter("digest is not null").isEmpty():
        # Long levels are counted by digest only.
        indexer = StringIndexer(inputCols=levels, outputCols=outputs, handleInvalid="keep", stringOrderType="alphabetAsc")
        return [indexer.fit(prepare.transform(df))]
    found = {r["position"]: r["texts"] for r in held.groupBy("position").agg(F.sort_array(F.collect_list("text")).alias("texts")).collect()}
    return [
        StringIndexerModel.from_labels(found[p], inputCol=i, outputCol=o, handleInvalid="keep") for p, i, o in zip(places, levels, outputs)
    ]


def fit_preprocessor(
    df: DataFrame, target: str | None = None, roles: Mapping[str, str] | None = None, method: str = "exact"
) -> Preprocessor:
    """Learn imputers, scales and one-hot levels from ``df``.

    Numbers (and booleans as 0/1): median, then standard scale. Other columns: most
    frequent value, then one-hot over all levels; an unseen level is all zeros. Roles, modes and
    levels come from the same counted values.
    """
    if "features" in df.columns:
        raise ValueError("a column named features is in the way of the feature vector: rename it")
    listed = counted_columns(df, target, roles or None)
    held = df.select(*[F.col(quoted(c)) for c in listed])
    counts = cut_lineage(value_counts(held), "value_counts") if listed else None
    if not roles:
        by_type = {f.name: "datetime" if is_datetime(f.dataType) else "categorical" if is_bool(f.dataType) else "numeric" for f in df.schema}
        roles = by_type | (infer_roles(held, counts=counts) if listed else {})
    used = [c for c in model_columns(df, target, roles) if c != target]
    types = {c: df.schema[c].dataType for c in used}
    numeric = [c for c in used if is_number(types[c]) or is_bool(types[c])]
    strings = [c for c in used if c not in numeric and not is_datetime(types[c])]
    stats = numeric_stats(df, numeric, method)
    fills = modes(held, strings, counts)
    numeric = [c for c in numeric if c in stats]
    strings = [c for c in strings if c in fills]
    if not numeric and not strings:
        raise ValueError("no usable columns for modelling")

    exprs = []
    for i, c in enumerate(numeric):
        median, mean, deviation = stats[c]
        filled = f"COALESCE({_double_sql(c, types[c])}, {_number(median)})"
        exprs.append(f"({filled} - {_number(mean)}) / {_number(deviation)} AS _z{i}")
    for i, c in enumerate(strings):
        exprs.append(f"COALESCE(CAST({quoted(c)} AS STRING), {_string(fills[c])}) AS _c{i}")
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")
    stages: list[Transformer] = [prepare]
    inputs = [f"_z{i}" for i in range(len(numeric))]
    if strings:
        levels = [f"_c{i}" for i in range(len(strings))]
        indexers = _indexer(df, held.columns, strings, counts, levels, prepare)
        # "keep" adds a last level for the unseen, which dropLast then leaves out.
        encoder = OneHotEncoder(
            inputCols=[f"{c}i" for c in levels], outputCols=[f"{c}v" for c in levels], dropLast=True
        ).fit(PipelineModel(stages=[prepare, *indexers]).transform(df))
        stages += [*indexers, encoder]
        inputs += [f"{c}v" for c in levels]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    return Preprocessor(numeric, strings, stages)


def label_classes(df: DataFrame, target: str) -> list:
    """Distinct labels in their own order, for a model, which holds numbers for each class: numbers by size, strings by text.

    To encode a column of any number of labels, use ``class_codes``.
    """
    distinct = df.select(clean_value(df.schema[target]).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return sorted(r["label"] for r in distinct.collect())


def class_codes(df: DataFrame, target: str) -> DataFrame:
    """``(__class, __code)``: the distinct labels numbered in their own order, however many there are.

    Labels are dealt out in ranges; a label's number is its place in the range after those of the ranges before. Only the
    sizes of the ranges pass the driver.
    """
    spark = df.sparkSession
    distinct = df.select(clean_value(df.schema[target]).alias("__class")).filter(F.col("__class").isNotNull()).distinct()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(distinct.repartitionByRange(ranges, "__class").withColumn("__range", F.spark_partition_id()), "classes")
    sizes = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}
    starts = [(r, sum(n for q, n in sizes.items() if q < r)) for r in sizes] or [(0, 0)]
    offsets = F.broadcast(spark.createDataFrame(starts, "__range int, __start bigint"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__class"))
    code = (F.col("__start") + place - 1).cast("double")
    return placed.join(offsets, "__range").select("__class", code.alias("__code"))


def encode_labels(df: DataFrame, target: str, classes: Sequence | DataFrame, out: str = "label") -> DataFrame:
    """Add the position of the target among ``classes`` as double; an unseen label fails.

    ``classes`` is a list, or a table as ``class_codes`` gives it, which is broadcast when counted to be small.
    """
    spark = df.sparkSession
    if isinstance(classes, DataFrame):
        small = local_copy(classes, BROADCAST_ROWS)
        table = classes if small is None else F.broadcast(small)
    else:
        kind = df.schema[target].dataType.simpleString()
        table = spark.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], f"__class {kind}, __code double")
        table = F.broadcast(table) if len(classes) <= BROADCAST_ROWS else table
    value = clean_value(df.schema[target])
    joined = df.join(table, value == F.col("__class"), "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(value.cast("string"), F.lit("missing"))))
    return joined.withColumn(out, F.coalesce("__code", unseen.cast("double"))).drop("__class", "__code")
