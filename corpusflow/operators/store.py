"""Vector stores as tables keyed by store, namespace and id: upserts, deletes, statistics and advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["store_name", "namespace", "id"]


def normalized(vector: Column) -> Column:
    """Of length one; all zeros stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # As an array beside the vector, since in a lambda the norm would be summed up for each of its numbers.
    norms = F.array_repeat(F.when(norm > 0, norm).otherwise(F.lit(1.0)), F.size(vector))
    return F.zip_with(vector, norms, lambda x, n: x.cast("double") / n)


def last_write(records: DataFrame, sequence: str, *ties: str) -> DataFrame:
    """The latest row of each store, namespace and id; null namespaces are a namespace of their own."""
    order = [F.col(sequence).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ties)]
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` with the rows of ``incoming`` put in or in place of those of equal key; incoming keys must be unique."""
    keys = incoming.select(*(F.col(k).alias(f"_{k}") for k in KEY))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY))
    return existing.join(keys, same, "left_anti").unionByName(incoming)


def chunk_records(items: DataFrame, namespace: str, id_field: str = "chunk_id") -> DataFrame:
    """(id, namespace, vector, metadata) to be put in, of items (``id_field``, pos, vector, metadata as a map, and others).

    The metadata's entries come up a level: the items' own columns win over entries of the same name, and the text isn't
    kept. An item without an id is named by the namespace and its position.
    """
    own = [c for c in items.columns if c not in ("vector", "metadata", "pos", "text")]
    mine = F.map_filter(F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    theirs = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: (k != "text") & ~F.array_contains(F.map_keys(mine), k))
    named = F.coalesce(F.col(id_field).cast("string"), F.concat(F.lit(f"{namespace}:"), F.col("pos").cast("string")))
    return items.where(F.col("vector").isNotNull()).select(named.alias("id"), F.lit(namespace).alias("namespace"), normalized(F.col("vector")).alias("vector"), F.map_concat(theirs, mine).alias("metadata"))


def delete(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the ids of the given store and namespace."""
    return existing.join(ids.select(*KEY).distinct(), KEY, "left_anti")


def namespace_stats(records: DataFrame) -> DataFrame:
    """(store_name, namespace, n_vectors, dimension, index_type): counts, the most frequent dimension, and the index that fits."""
    sums = records.groupBy("store_name", "namespace").agg(F.count("*").alias("n_vectors"), F.max("dimension").alias("dimension"))
    return sums.withColumn("index_type", index_type(F.col("n_vectors")))


def index_type(n: Column) -> Column:
    """flat below ten thousand vectors, hnsw below a million, else ivf."""
    return F.when(n < 10_000, "flat").when(n < 1_000_000, "hnsw").otherwise("ivf")
