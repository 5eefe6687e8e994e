"""The queries of the numbered problems and, where SQL can say it, the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.mixing import mix_sources, share_report, sized_records
from corpusflow.llm.packing import fill_report, limit_report, pack, sized_texts
from corpusflow.llm.pairs import answer_defect, broken_pairs
from corpusflow.llm.percentiles import ladder, percentiles_by_bisection, percentiles_of_ladders, usable_durations
from corpusflow.llm.bpe import token_counter
from corpusflow.llm.token_budget import token_budget
from corpusflow.llm.pii import free_texts, mentions, redacted
from corpusflow.llm.quality import COMMON, text_statistics
from corpusflow.llm.similar import exact_neighbours, latest_versions, most_similar, similar_pairs, similar_vectors, unit_vectors
from corpusflow.session import checkpointed, spread, table



def _wide(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table whose texts take long to work on, spread over all cores where the file is small."""
    return spread(table(spark, sf_dir, name).select(*columns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at a cosine of 0.8 or more of which one is among the other's five most similar."""
    return similar_pairs(table(spark, sf_dir, "vector_chunks"))


def p1_most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every usable vector, however far they are."""
    return most_similar(table(spark, sf_dir, "vector_chunks"))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours at 0.8 or more that brute force finds for about every fiftieth vector, and whether 95 % of them were found.

    Blocks are made an eighth of the largest namespace, so that namespaces are cut at every size of the input.
    """
    units = checkpointed(unit_vectors(latest_versions(table(spark, sf_dir, "vector_chunks"))))
    largest = units.groupBy("store_name", "namespace").count().agg(F.max("count")).first()[0] or 0
    found = similar_vectors(units, 5, 0.8, (0.3, 0.632), block_rows=max(2, min(8192, largest // 8)), route_similarity=0.8, route_recall=0.98)
    # The first byte of a hash, as SQL can say it too.
    asked = units.where(F.substring(F.md5(F.col("id").cast("binary")), 1, 2) < "05").select("id")
    wanted = exact_neighbours(units, asked, 5, 0.8)
    joined = wanted.join(found.select("id", "neighbour", F.lit(1).alias("met")), ["id", "neighbour"], "left")
    return joined.agg(F.count("*").alias("n_wanted"), (F.count("met") >= 0.95 * F.count("*")).alias("recall_reached"))


QUERIES |= {"p1_found": p1_found, "p1_most_similar": p1_most_similar, "p1_recall": p1_recall}

NEAREST = """
WITH newest AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS n FROM vector_chunks
), usable AS (
  SELECT id, store_name, namespace, embedding::DOUBLE[] AS v FROM newest
  WHERE n = 1 AND namespace IS NOT NULL AND len(embedding) = 256
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), ranked AS (
  SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s,
         row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS n
  FROM usable a JOIN usable b ON a.store_name = b.store_name AND a.namespace = b.namespace AND a.id <> b.id
)"""
ORACLES["p1_found"] = NEAREST + " SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM ranked WHERE n <= 5 AND s >= 0.8"
ORACLES["p1_recall"] = NEAREST + " SELECT count(*) AS n_wanted, true AS recall_reached FROM ranked WHERE n <= 5 AND s >= 0.8 AND md5(id)[1:2] < '05'"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers and days whose median or upper percentile of duration exceeds its limit."""
    limits = {50: 2500.0, 95: 9000.0, 99: 25000.0}
    exact = percentiles_by_bisection(usable_durations(table(spark, sf_dir, "query_logs")), ["provider", "log_day"], [50, 95, 99], {50: 30, 95: 30, 99: 300})
    limit = reduce(lambda c, x: c.when(F.col("pct") == x[0], x[1]), limits.items(), F.when(F.lit(False), 0.0))
    return exact.where(F.col("value") > limit).select("provider", "log_day", F.col("pct").cast("int").alias("pct"))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and upper percentiles of each provider and day, exactly."""
    exact = percentiles_by_bisection(usable_durations(table(spark, sf_dir, "query_logs")), ["provider", "log_day"], [50, 90, 95, 99])
    return exact.select("provider", "log_day", F.col("pct").cast("int").alias("pct"), "n_rows", F.col("value").alias("duration_ms"))


def p2_day_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles within half a percent of each provider's weeks and of all its days, from the days' ladders."""
    days = ladder(usable_durations(table(spark, sf_dir, "query_logs")), ["provider", "log_day"])
    week = F.date_format(F.date_trunc("week", F.to_date("log_day")), "yyyy-MM-dd")
    sets = days.withColumn("day_set", F.explode(F.array(F.lit("all"), F.concat(F.lit("week of "), week))))
    merged = percentiles_of_ladders(sets, ["provider", "day_set"], [50, 90, 95, 99])
    return merged.select("provider", "day_set", F.col("pct").cast("int").alias("pct"), "n_rows", F.col("value").alias("duration_ms"))


def p2_error_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the added ladders of all days give each provider's percentiles within half a percent of the exact ones."""
    values = usable_durations(table(spark, sf_dir, "query_logs"))
    near = percentiles_of_ladders(ladder(values, ["provider", "log_day"]), ["provider"], [50, 90, 95, 99]).select("provider", "pct", F.col("value").alias("near"))
    exact = percentiles_by_bisection(values, ["provider"], [50, 90, 95, 99])
    kept = F.abs(F.col("near") / F.col("value") - 1) <= 0.005 + 1e-9
    return exact.join(near, ["provider", "pct"]).select("provider", F.col("pct").cast("int").alias("pct"), "n_rows", F.col("value").alias("duration_ms"), kept.alias("error_kept"))


QUERIES |= {"p2_error_kept": p2_error_kept, "p2_found": p2_found, "p2_percentiles": p2_percentiles, "p2_day_sets": p2_day_sets}

DURATIONS = """
WITH kept AS (
  SELECT DISTINCT id, lower(trim(provider)) AS provider, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS log_day, duration_ms
  FROM query_logs
  WHERE id IS NOT NULL AND provider IS NOT NULL AND duration_ms > 0 AND NOT isnan(duration_ms) AND NOT isinf(duration_ms)
), ranked AS (
  SELECT provider, log_day, duration_ms,
         row_number() OVER (PARTITION BY provider, log_day ORDER BY duration_ms) AS n,
         count(*) OVER (PARTITION BY provider, log_day) AS n_rows
  FROM kept
), wanted AS (SELECT unnest([50, 90, 95, 99]) AS pct
), hit AS (
  SELECT provider, log_day, pct::INT AS pct, n_rows, duration_ms FROM ranked, wanted WHERE n = ceil(pct * n_rows / 100.0)
)"""
ORACLES["p2_percentiles"] = DURATIONS + " SELECT provider, log_day, pct, n_rows, duration_ms FROM hit"
ORACLES["p2_found"] = DURATIONS + """
SELECT provider, log_day, pct FROM hit
WHERE n_rows >= 30 AND (pct = 50 AND duration_ms > 2500 OR pct = 95 AND duration_ms > 9000 OR pct = 99 AND duration_ms > 25000 AND n_rows >= 300)
"""

ORACLES["p2_error_kept"] = DURATIONS.split(", wanted AS")[0].replace("PARTITION BY provider, log_day", "PARTITION BY provider") + """
SELECT provider, pct::INT AS pct, n_rows, duration_ms, true AS error_kept FROM ranked, (SELECT unnest([50, 90, 95, 99]) AS pct) WHERE n = ceil(pct * n_rows / 100.0)
"""

#: The vocabulary that sizes are counted in; any file of ranks of this kind will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p3_found(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Slices of 1000 tokens or more of the budget. Their definition asks for the project's estimate, which alone decides; the operator counts exactly as well."""
    budget = token_budget(table(spark, sf_dir, "documents"), _wide(spark, sf_dir, "chunks", "chunk_id", "document_id", "text"), token_counter(spark, vocabulary))
    return budget.where("level = 0 and tokens >= 1000").select("ingest_week", "source", "lang", "format")


def p3_token_budget(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Exact and estimated tokens of every slice and of all sums over source, language and format."""
    return token_budget(table(spark, sf_dir, "documents"), _wide(spark, sf_dir, "chunks", "chunk_id", "document_id", "text"), token_counter(spark, vocabulary))


QUERIES |= {"p3_found": p3_found, "p3_token_budget": p3_token_budget}

ORACLES["p3_found"] = """
WITH counted AS (
  SELECT chunk_id, document_id, max(greatest(1, length(text) // 4)) AS tokens FROM chunks GROUP BY ALL
), slices AS (
  SELECT document_id, strftime(date_trunc('week', ingested_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS ingest_week,
         regexp_replace(lower(trim(source)), '[ _]', '-', 'g') AS source, lower(left(trim(lang), 2)) AS lang,
         ltrim(lower(trim(format)), '.') AS f
  FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL
)
SELECT ingest_week, source, lang,
       CASE f WHEN 'md' THEN 'markdown' WHEN 'htm' THEN 'html' WHEN 'txt' THEN 'text' ELSE f END AS format
FROM slices JOIN counted USING (document_id)
GROUP BY ALL HAVING sum(tokens) >= 1000
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a defective answer, and the defect."""
    return broken_pairs(_wide(spark, sf_dir, "query_logs", "id", "question", "answer"))


def p5_defect_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each provider, how many entries there are and how many have each defect."""
    logs = _wide(spark, sf_dir, "query_logs", "id", "question", "answer", "provider").where(F.col("id").isNotNull()).select("id", F.lower(F.trim("provider")).alias("provider"), answer_defect(F.col("question"), F.col("answer")).alias("defect"))
    return logs.distinct().groupBy("provider", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n_entries"))


QUERIES |= {"p5_found": p5_found, "p5_defect_rates": p5_defect_rates}


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't prose, and what they are."""
    return text_statistics(_wide(spark, sf_dir, "documents", "doc_id", "text")).where("kind <> 'prose'").select("doc_id", "kind").distinct()


def p8_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and form of every document."""
    return text_statistics(_wide(spark, sf_dir, "documents", "doc_id", "text"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics alone, to four places, as SQL can count them too."""
    ratios = [F.round(c, 4).alias(c) for c in ("mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share")]
    return p8_text_statistics(spark, sf_dir).select("doc_id", "n_chars", "n_words", *ratios)


QUERIES |= {"p8_found": p8_found, "p8_text_statistics": p8_text_statistics, "p8_counts": p8_counts}

BLANK = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
ORACLES["p8_counts"] = rf"""
WITH t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*') AS ws, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '[{BLANK}]+$', '')), lambda l: l <> '') AS ls,
  length(regexp_replace(text, '[\p{{L}}\p{{N}}{BLANK}]', '', 'g')) AS n_symbols FROM t)
SELECT doc_id, length(text) AS n_chars, len(ws) AS n_words, round(coalesce(list_sum(list_transform(ws, lambda x: length(x))) / nullif(len(ws), 0)::DOUBLE, 0), 4) AS mean_word_length,
  round(coalesce(n_symbols / nullif(length(text), 0)::DOUBLE, 0), 4) AS symbol_ratio, round(coalesce(len(list_filter(ls, lambda l: contains('.!?…:;。！？"''”“’»)', right(l, 1)))) / nullif(len(ls), 0)::DOUBLE, 0), 4) AS punct_line_share,
  round(coalesce(len(list_filter(ws, lambda x: x IN ({", ".join(f"'{c}'" for c in sorted(COMMON))}))) / nullif(len(ws), 0)::DOUBLE, 0), 4) AS common_word_share FROM w"""


def _free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"query_logs": ("id", "question"), "feedback_records": ("id", "comment"), "documents": ("doc_id", "text")}
    return free_texts(*(_wide(spark, sf_dir, t, *c) for t, c in columns.items()))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of a person's data in questions, comments and documents."""
    return mentions(_free_texts(spark, sf_dir)).select("table_name", "row_id", "kind", "occurrence")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with typed placeholders for what was found."""
    texts = _free_texts(spark, sf_dir)
    return redacted(texts, mentions(texts))


QUERIES |= {"p4_found": p4_found, "p4_redacted": p4_redacted}


def _packed(spark: SparkSession, sf_dir: str, vocabulary: str) -> DataFrame:
    # Container sizes are a handful by their nature; a table of more than a thousand is refused.
    sizes = table(spark, sf_dir, "containers").distinct().orderBy("container_name").limit(1001).collect()
    if len(sizes) > 1000:
        raise ValueError("more than 1000 container sizes")
    items = sized_texts(_wide(spark, sf_dir, "documents", "doc_id", "text"), token_counter(spark, vocabulary))
    return pack(items, [(r["container_name"], r["capacity_tokens"]) for r in sizes])


def p6_packed(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The container of each text, or of each piece of a text above the capacity, for each container size."""
    return _packed(spark, sf_dir, vocabulary)


def p6_fill(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """How full the containers of each size are."""
    return fill_report(_packed(spark, sf_dir, vocabulary), table(spark, sf_dir, "containers"))


def p6_limits(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """That every text is placed whole and no limit is exceeded, and whether each limit binds somewhere."""
    report = limit_report(_packed(spark, sf_dir, vocabulary), table(spark, sf_dir, "containers"))
    return report.select("container_name", "n_texts", "n_over", "n_torn", *[(F.col(c) > 0).alias(f"{c.removeprefix('by_')}_bind") for c in ("by_tokens", "by_segments", "by_loss")])


def _mixed(spark: SparkSession, sf_dir: str, vocabulary: str, exact_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    records = sized_records(_wide(spark, sf_dir, "documents", "doc_id", "source", "text"), token_counter(spark, vocabulary))
    return mix_sources(records, table(spark, sf_dir, "mix_targets"), exact_shares=exact_shares)


def p7_mixed(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """How often each document is used in each mix; a mix is as large as its sources are, and a source short of that by its repeats stays short."""
    return _mixed(spark, sf_dir, vocabulary)[0]


def p7_shares(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Target and reached share of each source in each mix, and by how much its repeats keep it short."""
    return share_report(*_mixed(spark, sf_dir, vocabulary))


def p7_exact_shares(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The same for the largest mixes in which no source falls short."""
    return share_report(*_mixed(spark, sf_dir, vocabulary, exact_shares=True))


def p7_kept(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each mix its wanted sources, those that are off what they want by more than half a point of the mix and a mean document, and documents used too often."""
    selected, plans = _mixed(spark, sf_dir, vocabulary)
    selected = checkpointed(selected)
    often = selected.join(F.broadcast(plans.select("mix_id", "source_key", "max_repeats")), ["mix_id", "source_key"]).groupBy("mix_id").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("n_over"))
    reached = selected.groupBy("mix_id", "source_key").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.avg("tokens").alias("mean"))
    total = F.sum("want").over(Window.partitionBy("mix_id"))
    off = plans.join(reached, ["mix_id", "source_key"], "left").withColumn("off", F.abs(F.coalesce("tokens", F.lit(0)) - F.col("want")) > F.greatest(0.005 * total, F.coalesce("mean", F.lit(0.0))))
    return off.groupBy("mix_id").agg(F.count("*").alias("n_sources"), F.count_if("off").alias("n_off")).join(often, "mix_id", "left").select("mix_id", "n_sources", "n_off", F.coalesce("n_over", F.lit(0)).alias("n_over"))


QUERIES |= {"p6_packed": p6_packed, "p6_fill": p6_fill, "p6_limits": p6_limits, "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p7_exact_shares": p7_exact_shares, "p7_kept": p7_kept}

ORACLES["p6_limits"] = """SELECT container_name, count(DISTINCT doc_id) AS n_texts, 0 AS n_over, 0 AS n_torn, true AS tokens_bind, true AS segments_bind, true AS loss_bind
FROM documents, (SELECT DISTINCT container_name FROM containers) WHERE doc_id IS NOT NULL AND length(text) > 0 GROUP BY container_name"""
ORACLES["p7_kept"] = "SELECT mix_id, count(DISTINCT source_key) AS n_sources, 0 AS n_off, 0 AS n_over FROM mix_targets GROUP BY mix_id"
