"""Small expressions over values: scores, checks, flattening and canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.conditions import condition
from corpusflow.functions.formats import FORMATS


def scored(value: Column, score: Column | float) -> Column:
    """value and score as one struct; a null score is 0."""
    return F.struct(value.alias("value"), F.coalesce(score if isinstance(score, Column) else F.lit(float(score)), F.lit(0.0)).alias("score"))


def decision(value: Column, checks: dict[str, dict]) -> Column:
    """The value with a boolean for each named condition."""
    return F.struct(value.alias("value"), *(condition(spec).alias(name) for name, spec in checks.items()))


def sigmoid(logit: Column) -> Column:
    """1 / (1 + exp(-x)), to six places; null for null."""
    return F.round(1 / (1 + F.exp(-logit)), 6)


def flattened(lists: Column) -> Column:
    """An array of arrays one level flatter; null lists in it are left out."""
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))


def canonical_json(text: Column) -> Column:
    """JSON of one level with its keys in order, so that equal objects are equal texts; null for what isn't an object."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def merged_outputs(outputs: Column) -> Column:
    """Maps of an array of maps as one map; of equal keys the later value stands."""
    nothing = F.create_map().cast("map<string,string>")
    return F.aggregate(outputs, nothing, lambda all_, one: F.map_concat(F.map_filter(all_, lambda k, v: ~F.array_contains(F.map_keys(one), k)), one))


def supported_formats(spark: SparkSession) -> DataFrame:
    """(format, extensions): the known formats with their extensions in order."""
    rows = spark.createDataFrame([(k, v) for k, v in FORMATS.items()], "extension string, format string")
    return rows.groupBy("format").agg(F.sort_array(F.collect_set("extension")).alias("extensions"))
