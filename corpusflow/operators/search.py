"""Search: hashed embeddings, blockwise cosine top-k, BM25, entity search and hybrid fusion.

Queries are tables (query_id, ...), so a batch of queries is one plan. Results are rows (query_id, id, score, rank).
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpusflow.functions.text import tokens
from corpusflow.session import broadcast_if_small, checkpointed

BLOCK = 1024
#: Texts and queries in a block of BM25, and the most different asked terms that every task may hold.
TEXTS, ASKED, TERMS = 16_384, 8_192, 1_000_000


def _byte(hex_digits: Column, n: int) -> Column:
    return F.conv(F.substring(hex_digits, 2 * n - 1, 2), 16, 10).cast("int")


def hashed_terms(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, idx, value): the sparse hashed vector of each text in 256 dimensions, of length one.

    A token counts one up or down, by the oddness of its MD5's fifth byte, in the dimension of its first byte. Texts
    without tokens have no rows.
    """
    counted = texts.select(key, F.explode(tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    digest = F.md5(F.col("term").cast("binary"))
    signed = counted.select(key, _byte(digest, 1).alias("idx"), F.when(_byte(digest, 5) % 2 == 1, F.col("n")).otherwise(-F.col("n")).alias("v"))
    summed = signed.groupBy(key, "idx").agg(F.sum("v").cast("double").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return summed.withColumn("norm", norm).where("norm > 0").select(key, "idx", (F.col("v") / F.col("norm")).alias("value"))


@F.pandas_udf(ArrayType(DoubleType()))
def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    places: dict[str, tuple[int, int]] = {}

    def vector(terms: np.ndarray | None) -> np.ndarray | None:
        out = np.zeros(256)
        for term in () if terms is None else terms:
            at = places.get(term)
            if at is None:
                if len(places) > 500_000:
                    places.clear()
                digest = hashlib.md5(term.encode()).digest()
                at = places[term] = (digest[0], 1 if digest[4] % 2 else -1)
            out[at[0]] += at[1]
        size = np.sqrt(out @ out)
        return out / size if size else None

    for batch in batches:
        yield batch.map(vector)


def hashed_vectors(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, vector): the same as arrays of 256 numbers, made row by row so that nothing is shuffled."""
    return texts.select(key, _hashed.asNondeterministic()(tokens(F.col("text"))).alias("vector")).where(F.col("vector").isNotNull())


def trigram_terms(texts: DataFrame, key: str = "id", dim: int = 384) -> DataFrame:
    """(key, idx, value): counts of character trigrams of lower-cased words, hashed by SHA-256, of length one.

    A word shorter than three characters is its own gram.
    """
    word = F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    worded = texts.select(key, word.alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    grams = F.when(F.length("w") < 3, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("w") - 2)), lambda i: F.substring("w", i, F.lit(3))))
    grammed = worded.select(key, F.explode(grams).alias("g"), "n").groupBy(key, "g").agg(F.sum("n").alias("n"))
    digest = F.sha2(F.col("g").cast("binary"), 256)
    place = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("long"), lambda a, i: (a * 16 + F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("long")) % dim)
    summed = grammed.select(key, place.cast("int").alias("idx"), "n").groupBy(key, "idx").agg(F.sum("n").cast("double").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return summed.withColumn("norm", norm).select(key, "idx", (F.col("v") / F.col("norm")).alias("value"))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays; 0 if either is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), F.when(norms > 0, norms)), F.lit(0.0))


def _packed(table: pa.Table, parts: list[str], name: str) -> pa.Table:
    rows = np.asarray(table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(table.num_rows, -1)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(size > 0, size, 1)
    packed = {p: table.column(p)[:1] for p in parts}
    return pa.table(packed | {f"{name}_ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.string())), f"{name}_matrix": pa.array([rows.tobytes()], pa.binary())})


def _blocks(vectors: DataFrame, parts: list[str], name: str) -> DataFrame:
    """(parts..., name_ids, name_matrix): rows packed into blocks of up to about ``BLOCK`` normalised vectors.

    Without parts, rows are packed where they are; else those of one part are dealt into its blocks by a hash.
    """
    schema = ", ".join([*(f"{p} string" for p in parts), f"{name}_ids array<string>", f"{name}_matrix binary"])
    keyed = vectors.select(*(F.col(p).cast("string").alias(p) for p in parts), F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))

    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield from pack_held(held)
                held = []
        yield from pack_held(held)

    def pack_held(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held) if held else None
        for at in range(0, rows.num_rows if rows is not None else 0, BLOCK):
            yield from _packed(rows.slice(at, BLOCK), [], name).to_batches()

    if not parts:
        return keyed.mapInArrow(pack_batches, schema)
    blocks = max(1, -(-vectors.select(*parts).count() // BLOCK))
    return keyed.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy(*parts, "_b").applyInArrow(lambda table: _packed(table, parts, name), schema)


def cosine_top_k(queries: DataFrame, items: DataFrame, k: int, parts: list[str] | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` items most similar to each query, both (id, vector), within equal ``parts``.

    Both sides are packed into blocks, and each pair of blocks is one matrix product, so nothing is collected, and
    queries are broadcast only where they are small. A task keeps the ``k`` best of each query over its blocks.
    Scores are rounded to six places; ties go to the smaller id, ids being compared as strings.
    """
    parts = parts or []
    left, right = _blocks(queries, parts, "q"), _blocks(items, parts, "d")
    # Blocks, a thousandth of the rows, are what is paired here. Small queries come to the items, which else are made anew for each part of the queries.
    pairs = left.join(right, parts) if parts else right.crossJoin(broadcast_if_small(left))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        last, d_ids, d = None, np.zeros(0), np.zeros(0)
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: E731, B023
                if (read := (get("d_ids"), get("d_matrix"))) != last:  # else the items of the row before meet other queries
                    last, d_ids = read, np.array(read[0], dtype=object)
                    # Columns in the order of ids, so that the first of equal scores is the smaller id.
                    order = np.argsort(d_ids, kind="stable")
                    d_ids, d = d_ids[order], np.frombuffer(read[1]).reshape(len(d_ids), -1)[order]
                asking = (*(get(p) for p in parts), get("q_matrix"), tuple(get("q_ids")))
                if asking not in kept:
                    if len(kept) == 64:
                        yield from told(kept)
                        kept = {}
                    # By query, falling score and id: query, score, id; and the least score that may still come in.
                    kept[asking] = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object), np.full(len(asking[-1]), -np.inf)
                had, had_score, had_id, least = kept[asking]
                scores = np.frombuffer(asking[-2]).reshape(len(least), -1) @ d.T
                floor = least
                if np.isneginf(least).any() and k < len(d_ids):
                    floor = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                # A little below, as scores are compared when they are rounded.
                query, other = np.nonzero(scores >= (floor - 2e-6)[:, None])
                score = np.round(scores[query, other], 6) + 0.0
                place = np.lexsort((other, -score, query))
                query, other, score = query[place], other[place], score[place]
                first = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
                if not first.any():
                    continue
                query, score, found = np.concatenate([had, query[first]]), np.concatenate([had_score, score[first]]), np.concatenate([had_id, d_ids[other[first]]])
                by_id = np.argsort(found, kind="stable")
                place = by_id[np.lexsort((-score[by_id], query[by_id]))]
                query, score, found = query[place], score[place], found[place]
                at = np.arange(len(query)) - np.searchsorted(query, query, "left")
                least = np.full(len(least), -np.inf)
                least[query[at == k - 1]] = score[at == k - 1]
                kept[asking] = query[at < k], score[at < k], found[at < k], least
        yield from told(kept)

    def told(kept: dict) -> Iterator[pa.RecordBatch]:
        for asking, (query, score, found, _) in kept.items():
            q_ids = np.array(asking[-1], dtype=object)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[query].tolist(), pa.string()), pa.array(found.tolist(), pa.string()), pa.array(score)], names=["query_id", "id", "score"])

    found = pairs.mapInArrow(best, "query_id string, id string, score double")
    return ranked(found, k)


def ranked(scored: DataFrame, k: int | None = None, tie: str = "id") -> DataFrame:
    """With ``rank`` from 1 within each query, by falling score and then ``tie``; only the first ``k``."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), tie)))
    return out if k is None else out.where(F.col("rank") <= k)


def postings(texts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, dl, df, n_docs, avgdl): everything that BM25 needs, counted over all texts, empty ones included.

    With ``asked`` (term), only the postings of those terms are made, before anything is shuffled.
    """
    lengths = texts.select("id", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).alias("dl"), tokens(F.col("text")).alias("terms"))
    # One row of sums, joined to every posting.
    totals = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    # Outer, as a plain explode has every text cut into tokens once more to see whether there are any.
    each = lengths.select("id", "dl", F.explode_outer("terms").alias("term")).where("term is not null")
    each = each if asked is None else each.join(asked, "term", "left_semi")
    # Kept, as both the postings and their counts of documents are made of it.
    tf = checkpointed(each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))
    frequencies = tf.groupBy("term").agg(F.count("*").alias("df"))
    # Asked terms are few, so their frequencies come to the postings and a frequent term is no hot key.
    return tf.join(frequencies if asked is None else broadcast_if_small(frequencies), "term").crossJoin(F.broadcast(totals))


def _held(*arrays: np.ndarray) -> bytes:
    return zlib.compress(pickle.dumps(arrays, 5), 1)


def _text_blocks(texts: DataFrame, known: pa.Array) -> DataFrame:
    """(ids, n_docs, n_tokens, postings): texts packed where they are, by up to ``TEXTS``, with their postings of the known terms.

    Ids are sorted within a block. Postings are the lengths of all texts, the terms met and how many texts each is in,
    and then, term by term, places of texts and counts.
    """
    known = texts.sparkSession.sparkContext.broadcast(known)
    rows = texts.select("id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("terms"))

    def block(held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        before = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
        lengths = np.concatenate([h[1] for h in held])
        met = np.concatenate([h[3].astype(np.int64) * TEXTS + place[h[2] + n] for h, n in zip(held, before)])
        met, counts = np.unique(met, return_counts=True)
        terms, sizes = np.unique(met // TEXTS, return_counts=True)
        body = _held(lengths[order].astype(np.int32), terms.astype(np.int32), sizes.astype(np.int32), (met % TEXTS).astype(np.uint16), counts.astype(np.int32))
        whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([whole, pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([body], pa.binary())], names=["ids", "n_docs", "n_tokens", "postings"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                if n + part.num_rows > TEXTS:
                    yield block(held)
                    held, n = [], 0
                lengths = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
                term = pc.index_in(part.column("terms").flatten(), value_set=known.value).fill_null(-1).to_numpy()
                text = np.repeat(np.arange(part.num_rows), lengths)
                held.append((part.column("id"), lengths, text[term >= 0], term[term >= 0]))
                n += part.num_rows
        if held:
            yield block(held)

    return rows.mapInArrow(pack, f"ids array<{dict(texts.dtypes)['id']}>, n_docs bigint, n_tokens bigint, postings binary")


def _met_in(blocks: DataFrame, n_terms: int) -> np.ndarray:
    """In how many texts of the blocks each term is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for body in batch.column("postings"):
                _, terms, sizes, _, _ = pickle.loads(zlib.decompress(body.as_py()))
                met[terms] += sizes
        terms = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(met[terms])], names=["term", "n"])

    summed = blocks.select("postings").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms, dtype=np.int64)
    out[summed.column("term").to_numpy()] = summed.column("n").to_numpy()
    return out


def _query_blocks(asked: DataFrame, known: pa.Array) -> DataFrame:
    """(block, query_ids, wanted): (query_id, term, qtf) packed by about ``ASKED`` queries; wanted is where each query's terms begin, the terms and their counts."""
    known = asked.sparkSession.sparkContext.broadcast(known)
    blocks = max(1, -(-asked.select("query_id").distinct().count() // ASKED))

    def pack(table: pa.Table) -> pa.Table:
        query = pc.dictionary_encode(table.column("query_id").combine_chunks(), null_encoding="encode")
        at = query.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        term = pc.index_in(table.column("term").combine_chunks(), value_set=known.value).to_numpy()[order]
        body = _held(np.searchsorted(at[order], np.arange(len(query.dictionary) + 1)), term, table.column("qtf").to_numpy()[order])
        whole = pa.ListArray.from_arrays(pa.array([0, len(query.dictionary)], pa.int32()), query.dictionary)
        return pa.table({"block": table.column("block")[:1], "query_ids": whole, "wanted": pa.array([body], pa.binary())})

    keyed = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    return keyed.groupBy("block").applyInArrow(pack, f"block bigint, query_ids array<{dict(asked.dtypes)['query_id']}>, wanted binary")


def search_texts(queries: DataFrame, texts: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``bm25`` of (query_id, terms) over (id, text) without a ready index; a text's id is its own.

    Texts stay where they are, packed with their postings of the asked terms, and meet the queries block by block. A task
    keeps the ``k`` best of each query, so what is shuffled is those and not every pair of a query and a text.
    """
    asked = checkpointed(queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
    found = _block_best(asked, texts, k, (k1, b))
    return bm25(queries, postings(texts, asked.select("term").distinct()), k, k1, b) if found is None else ranked(found, k)


def _block_best(asked: DataFrame, texts: DataFrame, k: int, okapi: tuple[float, float] | None) -> DataFrame | None:
    """(query_id, id, score): the ``k`` best texts of each query of each task, for (query_id, term, qtf) over (id, text).

    The score is BM25 with ``okapi``'s k1 and b, without it the sum of qtf over the terms that a text has. None if there
    are more terms than every task may hold.
    """
    terms = asked.select("term").distinct()
    n_terms, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n_terms > TERMS or size > 32 << 20:
        return None
    known = terms.toArrow().column("term").combine_chunks()
    known = pa.concat_arrays(known.chunks) if isinstance(known, pa.ChunkedArray) else known
    blocks = checkpointed(_text_blocks(texts, known))
    idf, mean, k1, b = np.ones(n_terms), 1.0, *(okapi or (0.0, 0.0))
    if okapi:
        n_docs, n_tokens = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        met = _met_in(blocks, n_terms)
        idf = np.log(1 + (n_docs - met + 0.5) / (met + 0.5))
        mean = n_tokens / n_docs if n_tokens else 1.0
    idf = asked.sparkSession.sparkContext.broadcast(idf)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking: dict[int, tuple[pa.Array, list[int], np.ndarray, np.ndarray, list[list[tuple]]]] = {}
        last, ids, sums = None, [], np.zeros(0)
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row]  # noqa: E731, B023
                if (block := get("block").as_py()) not in asking:
                    begins, term, qtf = pickle.loads(zlib.decompress(get("wanted").as_py()))
                    asking[block] = pa.array(get("query_ids").values), begins.tolist(), term, qtf * idf.value[term], [[] for _ in range(len(begins) - 1)]
                if (read := (get("ids").values.to_pylist(), get("postings").as_py())) != last:  # else the texts of the row before meet other queries
                    last, ids = read, read[0]
                    lengths, terms, sizes, places, tf = pickle.loads(zlib.decompress(read[1]))
                    ends = np.cumsum(sizes)
                    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[places] / mean)) if okapi else np.ones(len(tf))
                    sums, dense = np.zeros(len(ids)), {}
                _, begins, term, factor, kept = asking[block]
                if not len(terms):
                    continue
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                stop = np.where(terms[at] == term, ends[at], 0)
                start, stop, factor = np.where(stop > 0, stop - sizes[at], 0).tolist(), stop.tolist(), factor.tolist()
                for query, found in enumerate(kept):
                    sums[:] = 0
                    for i in range(begins[query], begins[query + 1]):
                        lo, hi = start[i], stop[i]
                        if 4 * (hi - lo) > len(ids):
                            if lo not in dense:
                                dense[lo] = np.zeros(len(ids))
                                dense[lo][places[lo:hi]] = weight[lo:hi]
                            sums += factor[i] * dense[lo]
                        elif hi > lo:
                            sums[places[lo:hi]] += factor[i] * weight[lo:hi]
                    full = len(found) == k
                    # What can't reach the last of the best so far once it is rounded is left out before sorting.
                    near = np.flatnonzero(sums > (found[-1][0] - 1e-6 if full else 0))
                    score = np.round(sums[near], 6)
                    if len(near) > k:  # of many equal ones only the first are sorted
                        least = np.partition(score, -k)[-k]
                        above = np.flatnonzero(score > least)
                        good = np.union1d(above, np.flatnonzero(score == least)[: k - len(above)])
                        near, score = near[good], score[good]
                    near, score = near[score > 0], score[score > 0]
                    first = np.argsort(-score, kind="stable")
                    if len(first):
                        found += [(s, ids[n]) for s, n in zip(score[first].tolist(), near[first].tolist())]
                        found.sort(key=lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0))
                        del found[k:]
        for query_ids, _, _, _, kept in asking.values():
            query = np.repeat(np.arange(len(kept)), [len(f) for f in kept])
            columns = [query_ids.take(pa.array(query)), pa.array([x[1] for f in kept for x in f], batch.column("ids").type.value_type), pa.array([x[0] for f in kept for x in f], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])

    pairs = blocks.select("ids", "postings").crossJoin(broadcast_if_small(_query_blocks(asked, known)))
    return pairs.mapInArrow(best, f"query_id {dict(asked.dtypes)['query_id']}, id {dict(texts.dtypes)['id']}, score double")


def bm25(queries: DataFrame, index: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best texts for each (query_id, terms); repeated terms count again.

    Scores are rounded to six places, those not above zero left out; ties go to the smaller id.
    """
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = index.join(broadcast_if_small(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("qtf") * idf * weight), 6).alias("score"))
    return ranked(scored.where("score > 0"), k)


def entity_search(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, matched, rank): the share of each query's ``entities`` that occur in a text, case aside.

    An entity named twice counts twice. ``queries`` is a handful of rows, joined to every text.
    """
    asked = broadcast_if_small(queries.select("query_id", "entities"))
    low = F.lower("text")
    hits = texts.select("id", "text").join(asked, F.exists("entities", lambda e: F.contains(low, F.lower(e))))
    matched = F.filter("entities", lambda e: F.contains(low, F.lower(e)))
    scored = hits.select("query_id", "id", F.round(F.size(matched) / F.size("entities"), 6).alias("score"), matched.alias("matched"))
    return ranked(scored, k)


def entity_word_search(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the share of each query's ``entities``, single words, that are words of a text, case aside.

    An entity named twice counts twice, and a query without any finds nothing. A word such as "The" is in most texts, so
    texts meet queries in blocks, and only a task's ``k`` best of each query are shuffled; pairs of a query and a text are
    only where there are more different words than every task may hold.
    """
    named = queries.select("query_id", F.explode("entities").alias("e")).select("query_id", F.lower("e").alias("term")).where("term is not null")
    asked = checkpointed(named.groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
    found = _block_best(asked, texts, k, None)
    if found is None:
        held = texts.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        found = held.join(broadcast_if_small(asked), "term").groupBy("query_id", "id").agg(F.sum("qtf").alias("score"))
    sizes = broadcast_if_small(queries.select("query_id", F.size("entities").alias("n")))
    return ranked(found.join(sizes, "query_id").select("query_id", "id", F.round(F.col("score") / F.col("n"), 6).alias("score")), k)


def embedded_once(texts: DataFrame) -> DataFrame:
    """(id, key, vector) of (id, text): each different text is embedded once, by the SHA-1 of it, and the vector joined back.

    Texts without copies keep theirs where they are; only vectors of texts that occur again are joined.
    """
    keyed = texts.where(F.col("text").isNotNull()).withColumn("key", F.sha1(F.col("text").cast("binary")))
    repeated = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1"))
    marked = keyed.join(broadcast_if_small(repeated.select("key", "first")), "key", "left")
    own = hashed_vectors(marked.where(F.col("first").isNull() | (F.col("first") == F.col("id"))).select("id", "text")).withColumnRenamed("id", "of")
    return marked.select("id", "key", F.coalesce("first", "id").alias("of")).join(own, "of").select("id", "key", "vector")


def semantic_cache_lookup(asked: DataFrame, cached: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(query_id, entry, score): for each asked (id, vector) the most similar entry of a cache (id, vector), if it is near enough.

    Ties go to the smaller id.
    """
    return cosine_top_k(asked, cached, 1).where(F.col("score") >= threshold).select("query_id", F.col("id").alias("entry"), "score")


def weighted_rrf(dense: DataFrame, sparse: DataFrame, weights: tuple[float, float] = (1.0, 1.0), k: int = 60, top: int = 10) -> DataFrame:
    """(query_id, id, score, found_by, rank): reciprocal rank fusion of two ranked lists, rounded to six places.

    ``found_by`` is both, semantic or keyword.
    """
    a = dense.select("query_id", "id", F.col("rank").alias("dense_rank"))
    b = sparse.select("query_id", "id", F.col("rank").alias("sparse_rank"))
    both = a.join(b, ["query_id", "id"], "full")
    part = lambda c, w: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    score = F.round(part("dense_rank", F.lit(weights[0])) + part("sparse_rank", F.lit(weights[1])), 6)
    by = F.when(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull(), "both").when(F.col("dense_rank").isNotNull(), "semantic").otherwise("keyword")
    return ranked(both.select("query_id", "id", score.alias("score"), by.alias("found_by")), top)
