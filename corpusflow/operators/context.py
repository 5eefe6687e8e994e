"""Context for answers: order, token budget, prompts and extractive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.keys import token_estimate
from corpusflow.functions.text import sentences, strip, tokens

# Instructions of the prompt templates.
SYSTEM = {
    "default": "You are a precise assistant for an enterprise knowledge base. Answer the user's question using ONLY the provided context. Cite supporting sources with their bracket markers, e.g. [1]. If the answer is not contained in the context, say you don't know.",
    "qa": "You are a concise question-answering assistant. Give a direct answer using only the provided context. Cite your sources with bracket markers.",
    "summarize": "You are a summarization assistant. Summarize the key points from the provided context clearly and concisely. Attribute claims to their sources.",
    "extract": "You are a structured data extraction assistant. Extract the requested information from the provided context and return it in a structured format.",
    "chain_of_thought": "You are a reasoning assistant. Think step-by-step through the provided context before giving your final answer. Show your reasoning clearly.",
}


def date_key(hits: DataFrame, time: str) -> Column:
    """Seconds since 1970 of a time, a number or a text that holds either; 0 where it holds none."""
    kind = dict(hits.dtypes)[time]
    if kind.startswith(("timestamp", "date")):
        return F.coalesce(F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000, F.lit(0.0))
    told = F.col(time).cast("string")
    return F.coalesce(F.try_to_number(told, F.lit("S99999999999.999999")).cast("double"), F.unix_micros(F.try_to_timestamp(told)) / 1_000_000, F.lit(0.0))


def organize(hits: DataFrame, strategy: str, source: str = "source", time: str = "date") -> DataFrame:
    """Hits with ``order`` from 0 by relevance, source (best first), chronological (latest first) or diversity (in turns)."""
    q = Window.partitionBy("query_id")
    best = F.max("score").over(Window.partitionBy("query_id", source))
    turn = F.row_number().over(Window.partitionBy("query_id", source).orderBy("rank"))
    first = F.min("rank").over(Window.partitionBy("query_id", source))
    keys = {
        "relevance": [F.col("score").desc(), F.col("rank")],
        "source": [F.col("_best").desc(), F.col("_first"), F.col("score").desc(), F.col("rank")],
        "chronological": [date_key(hits, time).desc(), F.col("rank")] if time in hits.columns else [F.col("rank")],
        "diversity": [F.col("_turn"), F.col("_first"), F.col("rank")],
    }[strategy]
    staged = hits.withColumn("_best", best).withColumn("_turn", turn).withColumn("_first", first)
    return staged.withColumn("order", F.row_number().over(q.orderBy(*keys)) - 1).drop("_best", "_turn", "_first")


def within_budget(hits: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """(query_id, id, rank, tokens, included, marker): hits that fit the budget, in order; one too long is skipped, not the end.

    Blank texts are left out, and the first hit always goes in. The fold runs over one query's hits, whose number the
    search's k bounds.
    """
    told = hits.where(strip(F.coalesce("text", F.lit(""))) != "").select("query_id", "id", "rank", token_estimate(strip(F.col("text"))).cast("int").alias("tokens"))
    listed = told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "tokens"))).alias("hits"))
    row = lambda x, ok, n: F.struct(x["rank"].alias("rank"), x["id"].alias("id"), x["tokens"].alias("tokens"), ok.alias("included"), n.alias("n"))
    kind = f"array<struct<rank:int,id:{dict(hits.dtypes)['id']},tokens:int,included:boolean,n:int>>"

    def step(a: Column, x: Column) -> Column:
        ok = (a["n"] == 0) | (a["total"] + x["tokens"] <= max_tokens)
        n = a["n"] + ok.cast("int")
        return F.struct((a["total"] + F.when(ok, x["tokens"]).otherwise(0)).alias("total"), n.alias("n"), F.concat(a["out"], F.array(row(x, ok, n))).alias("out"))

    folded = F.aggregate("hits", F.struct(F.lit(0).alias("total"), F.lit(0).alias("n"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])
    each = listed.select("query_id", F.explode(folded).alias("h"))
    return each.select("query_id", "h.id", "h.rank", "h.tokens", "h.included", F.when(F.col("h.included"), F.concat(F.lit("["), F.col("h.n"), F.lit("]"))).alias("marker"))


def build_context(hits: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """(query_id, context, token_estimate, n_included, n_dropped): marked texts of the hits within the budget."""
    chosen = within_budget(hits, max_tokens).join(hits.select("query_id", "id", "text", "source"), ["query_id", "id"])
    label = F.concat_ws(" ", "marker", F.when(F.col("source").isNotNull(), F.concat(F.lit("("), F.col("source"), F.lit(")"))))
    part = F.when(F.col("included"), F.struct("rank", F.concat(label, F.lit("\n"), strip(F.col("text"))).alias("part")))
    joined = F.array_join(F.transform(F.array_sort(F.array_compact(F.collect_list(part))), lambda p: p["part"]), "\n\n")
    return chosen.groupBy("query_id").agg(joined.alias("context"), F.sum(F.when(F.col("included"), F.col("tokens")).otherwise(0)).alias("token_estimate"), F.count_if("included").alias("n_included"), F.count_if(~F.col("included")).alias("n_dropped"))


# Fixed value: what a prompt that asks for reasoning ends with.
STEP_BY_STEP = "Think through the relevant context step by step before giving the final answer."


def build_prompt(question: Column, context: Column, template: str = "default", custom: str | None = None, reason: bool = False, answer_format: str | None = None) -> Column:
    """system and user text of a prompt.

    ``custom`` is a text with {context} and {question} in it; without it the context, the question, the wish for reasoning
    and the format of the answer follow each other in paragraphs.
    """
    shown = F.when(F.coalesce(context, F.lit("")) == "", "(no context retrieved)").otherwise(context)
    if custom is not None:
        user = F.replace(F.replace(F.lit(custom), F.lit("{context}"), F.coalesce(context, F.lit(""))), F.lit("{question}"), question)
    else:
        more = [F.lit(f"\n\n{STEP_BY_STEP}")] if reason or template == "chain_of_thought" else []
        more += [F.lit(f"\n\nAnswer format: {answer_format}")] if answer_format else []
        user = F.concat(F.lit("Context:\n"), shown, F.lit("\n\nQuestion: "), question, *more)
    return F.struct(F.lit(SYSTEM.get(template, SYSTEM["default"])).alias("system"), user.alias("user"))


def extractive_answers(hits: DataFrame, queries: DataFrame, n_sentences: int = 2) -> DataFrame:
    """(query_id, id, answer): the first sentences of the hit that shares most different words with the query.

    Ties go to the better rank; without any shared word the answer is that nothing is known, and id is null.
    """
    asked = F.array_distinct(tokens(F.col("query")))
    scored = hits.select("query_id", "id", "rank", "text").join(queries.select("query_id", "query"), "query_id").withColumn("shared", F.size(F.array_intersect(asked, tokens(F.col("text")))))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("shared").desc(), "rank"))).where("_n = 1 and shared > 0")
    said = best.select("query_id", "id", strip(F.array_join(F.slice(sentences(F.col("text")), 1, n_sentences), " ")).alias("answer"))
    unknown = F.lit("I don't know based on the provided context.")
    return queries.select("query_id").join(said, "query_id", "left").select("query_id", "id", F.coalesce("answer", unknown).alias("answer"))
