"""Reranking of hits (query_id, id, score, text, ...): every strategy is a column or a small join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import TOPICS, strings, tokens
from corpusflow.operators.search import hashed_terms, ranked


def age_days(time: Column, now: Column) -> Column:
    """Days from ``time`` to ``now``, at least 0; null for null."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(time)) / 86_400_000_000)


def cross_encoder(hits: DataFrame, queries: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Scores alpha * cosine of hashed vectors + (1 - alpha) * share of the query's words in the text, ranked again.

    ``queries`` is (query_id, query). Only the hits' texts are embedded, each once.
    """
    texts = hits.select("id", "text").dropDuplicates(["id"])
    d = hashed_terms(texts)
    q = hashed_terms(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text")))
    dots = hits.select("query_id", "id").join(q.select(F.col("id").alias("query_id"), "idx", F.col("value").alias("qv")), "query_id").join(d, ["id", "idx"]).groupBy("query_id", "id").agg(F.sum(F.col("qv") * F.col("value")).alias("semantic"))
    asked = F.array_distinct(tokens(F.col("query")))
    lexical = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tokens(F.col("text")))), F.size(asked)), F.lit(0.0))
    scored = hits.drop("score", "rank").join(dots, ["query_id", "id"], "left").join(queries.select("query_id", "query"), "query_id").withColumn("lexical", lexical)
    semantic = F.coalesce("semantic", F.lit(0.0))
    return ranked(scored.withColumn("semantic", semantic).withColumn("score", F.round(alpha * semantic + (1 - alpha) * F.col("lexical"), 6)).drop("query"))


def recency(hits: DataFrame, time: str, now: Column, half_life_days: float = 30.0) -> DataFrame:
    """Scores halved every half life; hits without a time keep theirs."""
    boost = F.coalesce(F.pow(F.lit(0.5), age_days(F.col(time), now) / half_life_days), F.lit(1.0))
    return ranked(hits.drop("rank").withColumn("recency_boost", boost).withColumn("score", F.round(F.col("score") * boost, 6)))


def authority(hits: DataFrame, source: str, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """Scores times the weight of their source."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(source)), F.lit(default))
    return ranked(hits.drop("rank").withColumn("authority_weight", weight).withColumn("score", F.round(F.col("score") * weight, 6)))


def multi_factor(hits: DataFrame, queries: DataFrame, time: str, now: Column, source: str, weights: dict[str, float], source_weights: dict[str, float]) -> DataFrame:
    """A blend of cross-encoder relevance, recency boost and authority weight."""
    relevant = cross_encoder(hits, queries).withColumnRenamed("score", "relevance").drop("rank")
    boost = F.coalesce(F.pow(F.lit(0.5), age_days(F.col(time), now) / 30.0), F.lit(1.0))
    trust = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in source_weights.items() for x in kv]), F.col(source)), F.lit(1.0))
    score = weights.get("relevance", 0.0) * F.col("relevance") + weights.get("recency", 0.0) * boost + weights.get("authority", 0.0) * trust
    return ranked(relevant.withColumn("score", F.round(score, 6)))


def mmr(hits: DataFrame, vectors: DataFrame, query_vectors: DataFrame, balance: float = 0.5) -> DataFrame:
    """(query_id, id, score, mmr_rank): hits picked one by one for likeness to the query and unlikeness to those picked.

    A group is one query's hits, bounded by the search's k; ties go to the earlier hit.
    """
    joined = hits.select("query_id", "id", "rank").join(vectors, "id").join(query_vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), "query_id")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "id"])
        rows = np.stack(group["vector"].to_numpy())
        near = rows @ np.asarray(group["query_vector"].iloc[0])
        alike = rows @ rows.T
        picked: list[int] = []
        left = list(range(len(group)))
        while left:
            value = [balance * near[i] - (1 - balance) * (alike[i, picked].max() if picked else 0.0) for i in left]
            picked.append(left.pop(int(np.argmax(np.round(value, 9)))))
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "id": group["id"].to_numpy()[picked], "score": near[picked], "mmr_rank": range(len(picked))})

    kinds = dict(joined.dtypes)
    return joined.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, mmr_rank int")


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, id, old_rank, new_rank, change, verdict): positions won (above 0) or lost, and that in words."""
    joined = before.select("query_id", "id", F.col("rank").alias("old_rank")).join(after.select("query_id", "id", F.col("rank").alias("new_rank")), ["query_id", "id"])
    change = F.col("old_rank") - F.col("new_rank")
    up, down = F.format_string("Moved UP %d positions — more relevant to query", change), F.format_string("Moved DOWN %d positions — less relevant", -change)
    return joined.withColumn("change", change).withColumn("verdict", F.when(change > 0, up).when(change < 0, down).otherwise("No change in rank"))


def agreement(lists: list[DataFrame]) -> DataFrame:
    """(query_id, agreement): the share of positions at which all lists have the same id."""
    first, *others = [x.select("query_id", F.col("rank").alias("pos"), F.col("id").alias(f"id_{i}")) for i, x in enumerate(lists)]
    for other in others:
        first = first.join(other, ["query_id", "pos"])
    same = F.lit(True)
    for i in range(1, len(lists)):
        same = same & (F.col("id_0") == F.col(f"id_{i}"))
    return first.groupBy("query_id").agg(F.round(F.avg(same.cast("double")), 6).alias("agreement"))


def personalize(hits: DataFrame, profiles: DataFrame, now: Column, recency_weight: float = 0.2) -> DataFrame:
    """Scores with boosts for interests (0.15 each), disinterests (-0.40), recency, authority (0.10) and format (0.08).

    ``hits`` has text, source, date_year and doc_type; ``profiles`` is (query_id, interests, disinterests,
    authority_sources, preferred_types). A year counts from its first day and fades over two years.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    table = F.create_map(*[x for k, v in TOPICS.items() for x in (F.lit(k), strings(v))])
    about = lambda topic: F.exists(F.coalesce(F.try_element_at(table, topic), F.array(F.lower(topic))), lambda p: F.contains(low, p))
    n = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), about))
    day = F.make_date(F.col("date_year"), F.lit(1), F.lit(1))
    fresh = F.coalesce(F.greatest(F.lit(0.0), 1 - F.datediff(F.to_date(now), day) / 730), F.lit(0.0))
    trusted = F.exists(F.coalesce("authority_sources", F.array().cast("array<string>")), lambda a: F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lower(a)))
    liked = F.array_contains(F.transform(F.coalesce("preferred_types", F.array().cast("array<string>")), lambda t: F.lower(t)), F.lower(F.coalesce("doc_type", F.lit(""))))
    boost = 0.15 * n("interests") - 0.40 * n("disinterests") + recency_weight * fresh + F.when(trusted, 0.10).otherwise(0.0) + F.when(liked, 0.08).otherwise(0.0)
    scored = hits.join(profiles, "query_id").withColumn("original_score", F.col("score")).withColumn("boost", F.round(boost, 6))
    return ranked(scored.drop("rank").withColumn("score", F.round(F.col("original_score") + boost, 6)))


def most_recent(rows: DataFrame, key: list[str], time: str, n: int, tie: str = "id") -> DataFrame:
    """The ``n`` latest rows of each key; ties go to the greater ``tie``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc()))).where(F.col("_n") <= n).drop("_n")
