"""Merging ranked lists: concatenation, votes, fusion, ranking, de-duplication, narrative order and answers.

Rows are (query_id, branch, pos, id, score, ...), position counting from 1 within a branch; order between branches is
the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import broadcast_if_small, checkpointed

ORDER = ["branch", "pos"]


def concatenate(rows: DataFrame) -> DataFrame:
    """All rows with ``order`` from 1 within a query, branch after branch."""
    return rows.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy(*ORDER)))


def voting(rows: DataFrame, value: str = "id") -> DataFrame:
    """(query_id, value, votes, support): the most frequent value, the first met on ties, and its share of all."""
    counted = rows.groupBy("query_id", value).agg(F.count("*").alias("votes"), F.min(F.struct(*ORDER)).alias("first"))
    whole = Window.partitionBy("query_id")
    counted = counted.withColumn("support", F.col("votes") / F.sum("votes").over(whole))
    best = counted.withColumn("_n", F.row_number().over(whole.orderBy(F.col("votes").desc(), "first")))
    return best.where("_n = 1").select("query_id", value, "votes", "support")


def consensus(rows: DataFrame, value: str = "id", threshold: float = 0.5) -> DataFrame:
    """(query_id, agreed, value, support): whether the most frequent value's share reaches the threshold."""
    return voting(rows, value).select("query_id", (F.col("support") >= threshold).alias("agreed"), value, "support")


def rrf(rows: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the sum of 1 / (k + position) over branches; ties go to what was met first."""
    summed = rows.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("pos"))).alias("score"), F.min(F.struct(*ORDER)).alias("first"))
    out = summed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first", "id"))).drop("first")
    return out if top is None else out.where(F.col("rank") <= top)


def ranking(rows: DataFrame, top: int | None = None, ascending: bool = False) -> DataFrame:
    """All rows by score (null counts as 0), stable, with ``rank``."""
    score = F.coalesce("score", F.lit(0.0))
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score.asc() if ascending else score.desc(), *ORDER)))
    return out if top is None else out.where(F.col("rank") <= top)


def weighted(rows: DataFrame, weights: dict[str, float], top: int | None = None) -> DataFrame:
    """Scores times the weight of their branch (1 for branches without one), ranked."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("branch")), F.lit(1.0)) if weights else F.lit(1.0)
    return ranking(rows.withColumn("score", F.coalesce("score", F.lit(0.0)) * weight), top)


def deduplicate(rows: DataFrame, key: str | Column = "id") -> DataFrame:
    """The first row of each key within a query."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", key).orderBy(*ORDER))).where("_n = 1").drop("_n")


def narrative_order(chunks: DataFrame) -> DataFrame:
    """With ``order`` from 1 by chunk_index, position, sequence and heading, missing ones as 0 and empty; ties by id."""
    zero = lambda c: F.coalesce(c, F.lit(0)) if c in chunks.columns else F.lit(0)
    heading = F.coalesce("heading", F.lit("")) if "heading" in chunks.columns else F.lit("")
    return chunks.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy(zero("chunk_index"), zero("position"), zero("sequence"), heading, "id")))


def places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """With ``place`` from 1 within each group by ``order``, which must tell all rows of a group apart.

    Rows are sorted in ranges over all tasks, a large group over many; what a range adds is its number within its part of
    the group, and the counts of the parts before it, a handful of rows.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = checkpointed(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = broadcast_if_small(counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (before - F.col("_first") + 1).alias("_start")))
    joined = ranged.join(starts, ranged[group].eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("place", F.col("_at") + F.col("_start")).drop("_part", "_at", "_group", "_of", "_start")


def overlap(rows: DataFrame) -> DataFrame:
    """(query_id, id, branches): in which branches each id was found, sorted."""
    return rows.groupBy("query_id", "id").agg(F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("branches"))


def _norm(sentence: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(sentence, r"^\s+|\s+$", "")), r"[.!?]+$", "")


def answer_points(answers: DataFrame) -> DataFrame:
    """(query_id, branch, point) of the different sentences of more than five characters in each (query_id, branch, answer)."""
    said = F.filter(F.split("answer", r"[.!?]+"), lambda s: F.length(F.regexp_replace(s, r"^\s+|\s+$", "")) > 5)
    return answers.select("query_id", "branch", F.explode(said).alias("s")).select("query_id", "branch", _norm(F.col("s")).alias("point")).distinct()


def common_ground(answers: DataFrame) -> DataFrame:
    """(query_id, point) that every non-empty answer of a query makes; none for a query with a single answer."""
    given = answers.where(F.trim("answer") != "")
    sources = given.groupBy("query_id").agg(F.countDistinct("branch").alias("n_sources")).where("n_sources > 1")
    counted = answer_points(given).groupBy("query_id", "point").agg(F.count("*").alias("n"))
    return counted.join(sources, "query_id").where("n = n_sources").select("query_id", "point")


def differences(answers: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, branch, point): up to ``most`` points, in the alphabet's order, that only one answer makes."""
    alone = answer_points(answers).groupBy("query_id", "point").agg(F.count("*").alias("n"), F.min("branch").alias("branch")).where("n = 1")
    return alone.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "branch").orderBy("point"))).where(F.col("_n") <= most).select("query_id", "branch", "point")


def merged_answer(answers: DataFrame, most: int | None = 12) -> DataFrame:
    """(query_id, answer): different sentences in order, joined; sentences that differ only in case or end mark are one.

    An answer is a single text, and a query has a handful of them, so a group is bounded by the texts it was given.
    """
    cut = F.posexplode(F.split(F.regexp_replace("answer", r"^\s+|\s+$", ""), r"(?<=[.!?])\s+"))
    said = answers.select("query_id", *ORDER, cut.alias("i", "s")).where(F.trim("s") != "")
    first = said.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", _norm(F.col("s"))).orderBy(*ORDER, "i"))).where("_n = 1")
    if most is not None:
        first = first.withColumn("_m", F.row_number().over(Window.partitionBy("query_id").orderBy(*ORDER, "i"))).where(F.col("_m") <= most)
    listed = F.array_sort(F.collect_list(F.struct(*ORDER, "i", "s")))
    return first.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: F.regexp_replace(x["s"], r"^\s+|\s+$", "")), " ").alias("answer"))


def synthesized(answers: DataFrame) -> DataFrame:
    """(query_id, answer, source_count) of the answers that say something; a fixed sentence where none does."""
    unknown = F.lower("answer").rlike(r"don.t know|no information|not found|unavailable")
    told = answers.where((F.trim("answer") != "") & ~unknown)
    merged = merged_answer(told, None).join(told.groupBy("query_id").agg(F.count("*").alias("source_count")), "query_id")
    nothing = F.lit("I could not find enough information to answer this question.")
    return answers.select("query_id").distinct().join(merged, "query_id", "left").select("query_id", F.coalesce("answer", nothing).alias("answer"), F.coalesce("source_count", F.lit(0)).alias("source_count"))
