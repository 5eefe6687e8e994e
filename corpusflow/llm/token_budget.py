"""Token budget per source, language and format: exact counts of texts, added up in cubes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.formats import canonical_format
from corpusflow.functions.keys import language_key, source_key, token_estimate, week_of
from corpusflow.session import checkpointed

DIMENSIONS = ["source", "lang", "format"]


def counted_chunks(chunks: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """(chunk_id, document_id, tokens, bpe_tokens): one row for each chunk id and document.

    ``tokens`` is the project's estimate and ``bpe_tokens`` the exact count of ``tokens(text)``. Texts are counted
    where they are read, and only the counts are shuffled. Of rows of one chunk that differ the larger counts stand;
    a null text counts 0, rows without a chunk or document id are left out.
    """
    known = chunks.where(F.col("chunk_id").isNotNull() & F.col("document_id").isNotNull())
    counted = known.select("chunk_id", "document_id", F.coalesce(token_estimate(F.col("text")), F.lit(0)).alias("tokens"), F.coalesce(tokens(F.col("text")), F.lit(0)).alias("bpe_tokens"))
    return counted.groupBy("chunk_id", "document_id").agg(F.max("tokens").alias("tokens"), F.max("bpe_tokens").alias("bpe_tokens"))


def token_budget(documents: DataFrame, chunks: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """Cubes over source, language and format within each week of ingestion.

    (ingest_week, source, lang, format, level, tokens, bpe_tokens, n_chunks): ``level`` has a bit set for each of
    source (4), lang (2) and format (1) that is summed over, where the column is null. Documents with null source or
    lang, and chunks of unknown documents, are in no slice; an empty input gives an empty result.
    """
    counts = counted_chunks(chunks, tokens)
    slices = documents.where(F.col("document_id").isNotNull() & F.col("source").isNotNull() & F.col("lang").isNotNull()).select(
        "document_id", week_of(F.col("ingested_at")).alias("ingest_week"), source_key(F.col("source")).alias("source"), language_key(F.col("lang")).alias("lang"), canonical_format(F.col("format")).alias("format")
    )
    # Kept with both counts, so that one who asks for slices by the estimate has them counted exactly too.
    per_document = checkpointed(counts.groupBy("document_id").agg(F.sum("tokens").alias("tokens"), F.sum("bpe_tokens").alias("bpe_tokens"), F.count("*").alias("n_chunks")))
    # The finest slices first, so that the cube's copies are made of a few rows and not of every document.
    finest = slices.join(per_document, "document_id").groupBy("ingest_week", *DIMENSIONS).agg(*[F.sum(c).alias(c) for c in ("tokens", "bpe_tokens", "n_chunks")])
    sets = [[d for i, d in enumerate(DIMENSIONS) if not level >> (2 - i) & 1] for level in range(8)]
    sums = finest.groupingSets([["ingest_week", *s] for s in sets], "ingest_week", *DIMENSIONS)
    return sums.agg(F.expr("cast(grouping_id() as int)").alias("level"), *[F.sum(c).alias(c) for c in ("tokens", "bpe_tokens", "n_chunks")]).select("ingest_week", *DIMENSIONS, "level", "tokens", "bpe_tokens", "n_chunks")
