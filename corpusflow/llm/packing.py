"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic.

An item has three sizes - tokens, one segment, and loss-bearing tokens - and a container limits all three. Items are
dealt into batches of bounded size by a hash, so no task sees more than a batch. In a batch one container at a time is
filled: the fitting item with the largest dot product of its sizes and the space left, each weighed by how scarce that
dimension is in the batch, goes in next. What lies in containers that stayed emptier than ``least_fill`` is dealt and
packed once more, in fewer batches. Only an item above the capacity is split, at the capacity.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.session import checkpointed

BATCH = 2048
PACKED = "container_name string, container_id string, doc_id long, piece_no int, start_token long, tokens long, loss_tokens long"


#: The default limits: segments of a container of the given capacity, and the share of its capacity that may bear loss.
LOSS_SHARE = 0.9


def segment_limit(capacity: int) -> int:
    return max(8, capacity // 64)


def sized_texts(documents: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, tokens, loss_tokens): tokens of the text, and how many more they are than those of its prompt.

    The prompt is what stands before the first blank line; the first line where there is none, and the first sentence of a
    text of one line. A text of one sentence bears loss throughout. A null text has no tokens. Rows without a doc_id are left out.
    """
    text = F.coalesce("text", F.lit(""))
    cut = lambda mark: F.substring_index(text, mark, 1)
    sentence = F.regexp_extract(text, r"^[^.!?]*[.!?]+(?=\s)", 0)
    prompt = F.when(text.contains("\n\n"), cut("\n\n")).when(text.contains("\n"), cut("\n")).otherwise(sentence)
    sized = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), tokens(text).alias("tokens"), tokens(prompt).alias("prompt"))
    return sized.select("doc_id", "tokens", F.greatest(F.lit(0), F.col("tokens") - F.col("prompt")).alias("loss_tokens"))


def fill(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The number of the container of each item, by the dot-product heuristic; every item must fit an empty container.

    ``sizes`` has a row for each item and a column for each limit. Ties go to the first item.
    """
    share = np.ascontiguousarray((sizes / limits).T)
    weight = share.mean(1) + 1e-9
    out = np.full(len(sizes), -1)
    left = np.argsort(-share.max(0), kind="stable")
    tokens, segments, loss = share[:, left]
    number = 0
    while len(left):
        inside = [0]
        space = 1 - np.array([tokens[0], segments[0], loss[0]])
        pool = 1 + np.nonzero(_fits(tokens[1:], segments[1:], loss[1:], space))[0]
        while len(pool):
            wish = weight * space
            t, s, b = tokens[pool], segments[pool], loss[pool]
            at = int((wish[0] * t + wish[1] * s + wish[2] * b).argmax())
            inside.append(pool[at])
            space = space - np.array([t[at], s[at], b[at]])
            keep = _fits(t, s, b, space)
            keep[at] = False
            pool = pool[keep]
        out[left[inside]] = number
        number += 1
        stay = np.ones(len(left), bool)
        stay[inside] = False
        left, tokens, segments, loss = left[stay], tokens[stay], segments[stay], loss[stay]
    return out


def _fits(tokens: np.ndarray, segments: np.ndarray, loss: np.ndarray, space: np.ndarray) -> np.ndarray:
    return (tokens <= space[0] + 1e-9) & (segments <= space[1] + 1e-9) & (loss <= space[2] + 1e-9)


def pack(items: DataFrame, containers: list[tuple[str, int]], max_segments: Callable[[int], int] = segment_limit, loss_share: float = LOSS_SHARE, batch: int = BATCH, least_fill: float = 0.97) -> DataFrame:
    """(container_name, container_id, doc_id, piece_no, start_token, tokens, loss_tokens) for each container size.

    ``items`` has doc_id, tokens and loss_tokens; ``containers`` the names and capacities, a handful. A container
    holds at most its capacity in tokens, ``max_segments(capacity)`` items and ``loss_share`` of the capacity in
    loss-bearing tokens, but an item that alone exceeds the latter is packed by itself. Items without tokens have
    nothing to place and come out with a null container. The loss-bearing tokens of an item are its last ones.
    """
    if not containers:
        return items.sparkSession.createDataFrame([], PACKED)
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("container_name"), F.lit(int(c)).cast("long").alias("capacity")) for n, c in containers]))
    each = items.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("size"), F.coalesce("loss_tokens", F.lit(0)).alias("loss"), sizes.alias("c")).select("doc_id", "size", "loss", "c.*")
    starts = F.posexplode(F.expr("sequence(0L, greatest(0L, size - 1), capacity)"))
    pieces = each.select("*", starts.alias("piece_no", "start_token")).withColumn("tokens", F.least("capacity", F.col("size") - F.col("start_token")))
    end = F.col("start_token") + F.col("tokens")
    pieces = pieces.withColumn("loss_tokens", F.greatest(F.lit(0), F.least("tokens", end - (F.col("size") - F.col("loss")))))
    pieces = checkpointed(pieces.select("container_name", "capacity", "doc_id", "piece_no", "start_token", "tokens", "loss_tokens"))
    whole = pieces.where((F.col("tokens") > 0) & (F.col("tokens") < F.col("capacity")))

    def packed(rows: DataFrame, turn: int) -> DataFrame:
        most = rows.groupBy("container_name").count().agg(F.max("count")).first()[0] or 0
        dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(turn)), F.lit(max(1, -(-most // batch)))))

        def one(key: tuple, group: pa.Table) -> pa.Table:
            capacity = group.column("capacity")[0].as_py()
            group = group.sort_by([("doc_id", "ascending"), ("piece_no", "ascending")])
            tokens, loss = group.column("tokens").to_numpy(), group.column("loss_tokens").to_numpy()
            limits = np.array([capacity, max_segments(capacity), max(1.0, loss_share * capacity)], float)
            vectors = np.stack([tokens, np.ones(len(tokens)), np.minimum(loss, limits[2])], axis=1).astype(float)
            number = fill(vectors, limits)
            used = np.bincount(number, tokens) / capacity
            names = [f"{key[0].as_py()}-{turn}-{key[1].as_py()}-{n}" for n in number]
            return group.drop_columns(["batch"]).append_column("container_id", pa.array(names)).append_column("used", pa.array(used[number]))

        schema = "container_name string, capacity long, doc_id long, piece_no int, start_token long, tokens long, loss_tokens long, container_id string, used double"
        return dealt.groupBy("container_name", "batch").applyInArrow(one, schema)

    first = checkpointed(packed(whole, 1))
    again = packed(first.where(F.col("used") < least_fill).drop("container_id", "used"), 2)
    full = pieces.where(F.col("tokens") == F.col("capacity")).withColumn("container_id", F.concat_ws("-", "container_name", F.lit("0"), "doc_id", "piece_no"))
    none = pieces.where("tokens <= 0").withColumn("container_id", F.lit(None).cast("string"))
    columns = [c.split()[0] for c in PACKED.split(", ")]
    parts = [p.select(*columns) for p in (first.where(F.col("used") >= least_fill), again, full, none)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_name, capacity_tokens, n_containers, n_items, tokens, fill): how full the containers of each size are."""
    used = packed.where(F.col("container_id").isNotNull()).groupBy("container_name", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_items"))
    sums = used.groupBy("container_name").agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("tokens").alias("tokens"))
    return containers.distinct().join(sums, "container_name").select("container_name", "capacity_tokens", "n_containers", "n_items", "tokens", F.try_divide("tokens", F.col("n_containers") * F.col("capacity_tokens")).alias("fill"))


def limit_report(packed: DataFrame, containers: DataFrame, max_segments: Callable[[int], int] = segment_limit, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(container_name, n_texts, n_over, n_torn, by_tokens, by_segments, by_loss) of rows of ``pack`` for each container size.

    ``n_texts`` are texts that are placed with all their tokens, ``n_over`` containers above a limit (one that holds a
    single item may exceed that on loss), ``n_torn`` texts in pieces that would have fitted whole. The others count the
    containers in which each limit is the one most used up.
    """
    sizes = containers.select("container_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    caps = {int(r["capacity"]) for r in sizes.select("capacity").distinct().orderBy("capacity").limit(1000).collect()}
    most = F.create_map(*[F.lit(x) for c in sorted(caps) for x in (c, max_segments(c))]) if caps else F.create_map(F.lit(0).cast("long"), F.lit(0))
    rows = packed.where(F.col("container_id").isNotNull()).join(F.broadcast(sizes), "container_name")
    used = rows.groupBy("container_name", "capacity", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l"))
    used = used.withColumns({"t": F.col("t") / F.col("capacity"), "l": F.col("l") / (loss_share * F.col("capacity")), "n": F.col("s"), "s": F.col("s") / F.try_element_at(most, F.col("capacity"))})
    top = F.greatest("t", "s", "l")
    over = (F.col("t") > 1) | (F.col("s") > 1) | (F.col("l") > 1) & (F.col("n") > 1)
    by_container = used.groupBy("container_name").agg(F.count_if(over).alias("n_over"), F.count_if(F.col("t") == top).alias("by_tokens"), F.count_if((F.col("s") == top) & (F.col("t") < top)).alias("by_segments"), F.count_if((F.col("l") == top) & (F.col("t") < top) & (F.col("s") < top)).alias("by_loss"))
    texts = rows.groupBy("container_name", "capacity", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max(F.col("start_token") + F.col("tokens")).alias("end"))
    by_text = texts.groupBy("container_name").agg(F.count_if(F.col("tokens") == F.col("end")).alias("n_texts"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("n_torn"))
    return by_text.join(by_container, "container_name").select("container_name", "n_texts", "n_over", "n_torn", "by_tokens", "by_segments", "by_loss")
