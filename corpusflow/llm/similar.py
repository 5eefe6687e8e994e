"""Most similar vectors for every vector, by collision-counting hashing.

Every vector is projected onto ``n_projections`` random directions, and the rows of a block are kept as one
sorted array per direction. A query's window in a sorted array is centred on its own projection; virtual rehashing
widens it from one radius to the next, reading only what is new, for the queries that haven't got ``k`` near rows
yet. Rows that lie in the windows of at least a ``share`` of the directions are verified by their cosine.

A block is a whole (store, namespace) up to ``block_rows`` rows. A larger namespace is cut by the signs of
further random projections, in as many tables as ``route_recall`` takes. A cell that is still too large, as one in
a dense cluster is, is dealt into parts, and every two parts are a group in which all pairs are compared by cosine:
further signs or a hash would part neighbours that the tables count as met. So no group grows with the data, and
the work grows by a power below two outside of dense cells, with their square in them. Exact copies are one class
with one representative.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import broadcast_if_small, checkpointed

SPACE = ("store_name", "namespace")
ROUTE_BITS = 40
#: Classes of more exact copies than this are joined without being shuffled by class; of n rows at most n / LARGE_CLASS are so large.
LARGE_CLASS = 10_000


def latest_versions(vectors: DataFrame) -> DataFrame:
    """Of the rows of one ``id`` the one with the latest ``created_at`` (null counts as earliest).

    Rows with a null id are dropped, since no result could name them. Rows that tie are told apart by their
    content's hash, so that the choice is the same in each run. Other columns are left out.
    """
    columns = [F.col(c) for c in ("id", *SPACE, "embedding", "created_at")]
    newest = Window.partitionBy("id").orderBy(F.col("created_at").desc_nulls_last(), F.xxhash64("store_name", "namespace", "embedding"))
    return vectors.select(*columns).where(F.col("id").isNotNull()).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "created_at")


def unit_vectors(vectors: DataFrame, dim: int = 256) -> DataFrame:
    """(id, store_name, namespace, unit, copy_key) of the usable rows.

    Usable: namespace not null and an embedding of ``dim`` finite numbers that aren't all zero. ``unit`` holds the
    normalised float32 values; ``copy_key`` is equal for vectors that are equal after normalising. A null store
    counts as the store with the empty name.
    """

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("embedding")
            values = lists.flatten()
            matrix = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)
            with np.errstate(all="ignore"):
                size = np.sqrt((matrix.astype(np.float64) ** 2).sum(1))
                good = np.isfinite(matrix).all(1) & (size > 0)
                unit = (matrix / np.where(good, size, 1.0)[:, None]).astype(np.float32) + np.float32(0)
            keep = batch.filter(pa.array(good))
            raw = [row.tobytes() for row in unit[good]]
            keys = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [keep.column("id"), keep.column("store_name"), keep.column("namespace"), pa.array(raw, pa.binary()), pa.array(keys, pa.binary())],
                names=["id", "store_name", "namespace", "unit", "copy_key"],
            )

    fit = vectors.where(F.col("namespace").isNotNull() & (F.size("embedding") == dim)).select(
        F.col("id").cast("string").alias("id"), F.coalesce(F.col("store_name"), F.lit("")).alias("store_name"), "namespace", F.col("embedding").cast("array<float>").alias("embedding")
    )
    return fit.mapInArrow(normalise, "id string, store_name string, namespace string, unit binary, copy_key binary")


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n)).astype(np.float32)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def count_collisions(units: np.ndarray, k: int, radii: tuple[float, ...], n_projections: int, share: float, floor: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, other row, cosine) of up to ``k`` others with a cosine of ``floor`` or more for each row of a block.

    There is one sorted array for each direction. A query walks each of them outwards from its own place: its window holds
    what is at most ``radius`` away, and virtual rehashing widens it to the next radius by reading only what is new on
    both sides. The ids met are counted; those met in ``share`` of the directions are verified, each once. A query is done
    when ``k`` of the verified lie within the radius. An infinite last radius stands for windows that have grown over
    whole arrays, where every row is verified. Ties go to the lower row number; fewer than ``k`` come out where fewer are met.
    """
    n = len(units)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    projected = np.ascontiguousarray((units @ _directions(units.shape[1], n_projections, seed)).T)
    order = np.argsort(projected, axis=1, kind="stable")
    arrays = np.take_along_axis(projected, order, 1)
    walked = [r for r in radii if np.isfinite(r)]
    # Where each query's window starts and ends in each array, for each radius.
    bounds = np.empty((n, len(walked), 2, n_projections), np.int32)
    for i, array in enumerate(arrays):
        for level, radius in enumerate(walked):
            bounds[:, level, 0, i] = np.searchsorted(array, projected[i] - radius, "left")
            bounds[:, level, 1, i] = np.searchsorted(array, projected[i] + radius, "right")
    threshold, out, open_rows = math.ceil(share * n_projections), [], []
    for query in range(n):
        counts, verified = np.zeros(n, np.int64), np.zeros(0, np.int64)
        cosines = np.zeros(0, np.float32)
        done = False
        for level, radius in enumerate(walked):
            low, high = bounds[query, level].tolist()
            if level:
                inner_low, inner_high = bounds[query, level - 1].tolist()
                met = [part for ids, a, b, c, d in zip(order, low, inner_low, inner_high, high) for part in (ids[a:b], ids[c:d])]
            else:
                met = [ids[a:d] for ids, a, d in zip(order, low, high)]
            before = counts >= threshold
            counts += np.bincount(np.concatenate(met), minlength=n)
            new = np.nonzero((counts >= threshold) & ~before)[0]
            new = new[new != query]
            if len(new):
                verified = np.concatenate([verified, new])
                cosines = np.concatenate([cosines, units[new] @ units[query]])
            done = np.count_nonzero(cosines >= 1 - radius * radius / 2) >= k
            if done:
                break
        if not done and len(walked) < len(radii):
            open_rows.append(query)
            continue
        good = cosines >= floor
        verified, cosines = verified[good], cosines[good]
        best = np.lexsort((verified, -cosines))[:k]
        out.append((np.full(len(best), query), verified[best], cosines[best].astype(np.float64)))
    if open_rows:
        rows = np.array(open_rows)
        out.append(compare_all(units, None, k, floor, rows))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # type: ignore[return-value]


def tables_needed(bits: Column, similarity: float, recall: float) -> Column:
    """Tables so that a pair of the given cosine shares a cell of ``bits`` signs in one of them with the wanted chance."""
    same = 1 - math.acos(similarity) / math.pi
    return F.when(bits == 0, 1).otherwise(F.ceil(math.log(1 - recall) / F.log(1 - F.pow(F.lit(same), bits)))).cast("int")


def compare_all(units: np.ndarray, others: np.ndarray | None, k: int, floor: float, queries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, other row, cosine) of the ``k`` best of ``others`` with a cosine of ``floor`` or more for each row, by all cosines.

    Without ``others`` the rows, or those of them in ``queries``, are compared with all. Both are taken from their mean first, as else the
    differences of rows that are all but equal would be lost in rounding. Ties go to the lower row number.
    """
    alone = others is None
    centre = units.mean(0, dtype=np.float64) if alone else (units.sum(0, dtype=np.float64) + others.sum(0, dtype=np.float64)) / (len(units) + len(others))
    a = (units - centre).astype(np.float32)
    b = a if alone else (others - centre).astype(np.float32)
    of_a, of_b = (a * a).sum(1), (b * b).sum(1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, (1 << 22) // max(1, len(b)))
    asked = np.arange(len(a)) if queries is None else queries
    for at in range(0, len(asked), step):
        rows = asked[at : at + step]
        apart = of_a[rows, None] + of_b - 2 * (a[rows] @ b.T)
        if alone:
            apart[np.arange(len(rows)), rows] = np.inf
        limit = np.partition(apart, k - 1, axis=1)[:, k - 1 : k] if len(b) > k else np.float32(np.inf)
        near, other = np.nonzero((apart <= limit) & np.isfinite(apart))
        cosine = np.minimum(1 - apart[near, other].astype(np.float64) / 2, 1)
        good = cosine >= floor
        near, other, cosine = near[good], other[good], cosine[good]
        order = np.lexsort((other, -cosine, near))
        near, other, cosine = near[order], other[order], cosine[order]
        take = np.arange(len(near)) - np.searchsorted(near, near, "left") < k
        out.append((rows[near[take]], other[take], cosine[take]))
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _routes(rows: DataFrame, dim: int, seed: int, with_unit: bool) -> DataFrame:
    """(id, store_name, namespace, unit, table, cell, first): a row for each table of a row of a namespace that is cut; ``first`` is its cell in table 0."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _matrix(batch.column("unit"), dim)
            bits, tables = batch.column("bits").to_numpy(), batch.column("tables").to_numpy()
            first = np.zeros(len(units), np.int64)
            for t in range(int(tables.max())):
                of = np.nonzero(tables > t)[0]
                signs = (units[of] @ _directions(dim, ROUTE_BITS, seed + 1000 + t)) > 0
                cells = (signs.astype(np.int64) @ (1 << np.arange(ROUTE_BITS - 1, -1, -1, dtype=np.int64))) >> (ROUTE_BITS - bits[of].astype(np.int64))
                if not t:
                    first[of] = cells
                keep = batch.take(pa.array(of))
                unit = keep.column("unit") if with_unit else pa.nulls(len(of), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keep.column("id"), keep.column("store_name"), keep.column("namespace"), unit, pa.array(np.full(len(of), t, np.int32)), pa.array(cells), pa.array(first[of])],
                    names=["id", "store_name", "namespace", "unit", "table", "cell", "first"],
                )

    return rows.mapInArrow(sign, "id string, store_name string, namespace string, unit binary, table int, cell long, first long")


def _blocks(cut: DataFrame, dim: int, seed: int, block_rows: int) -> DataFrame:
    """(id, store_name, namespace, unit, part, block) of the rows of namespaces that are cut, once for each table.

    A cell of more than twice ``block_rows`` rows is dealt into parts of about so many, and each two of its parts, and each
    part with itself, are a block; ``part`` is null in other cells. Rows that lie in one such cell of table 0 are compared
    there, so where they are many in such a cell of a later table they are parts of their own that aren't paired again.
    The sizes of cells are counted on narrow rows; only the lists of cells that are too large are joined.
    """
    cell, part_rows = [*SPACE, "table", "cell"], 2 * block_rows
    narrow, routes = (_routes(cut, dim, seed, with_unit=w) for w in (False, True))
    large = broadcast_if_small(narrow.groupBy(*cell).agg(F.count("*").alias("_rows")).where(F.col("_rows") > part_rows).drop("_rows"))
    if large.isEmpty():
        return routes.select("id", *SPACE, "unit", F.lit(None).cast("long").alias("part"), F.concat_ws(":", "table", "cell").alias("block"))
    met = large.where("table = 0").select(*SPACE, F.col("cell").alias("first"), F.lit(True).alias("_met"))
    sizes = narrow.join(large, cell).join(broadcast_if_small(met), [*SPACE, "first"], "left").withColumn("mass", F.when(F.col("_met") & (F.col("table") > 0), F.col("first")).otherwise(-1))
    sizes = sizes.groupBy(*cell, "mass").agg(F.count("*").alias("_rows"))
    sizes = sizes.withColumn("mass", F.when(F.col("_rows") >= part_rows, F.col("mass")).otherwise(-1)).groupBy(*cell, "mass").agg(F.sum("_rows").alias("_rows"))
    parts, of = F.ceil(F.col("_rows") / part_rows).cast("long"), Window.partitionBy(*cell)
    listed = sizes.withColumn("_parts", parts).withColumn("_all", F.sum("_parts").over(of)).withColumn("_at", F.sum("_parts").over(of.orderBy("mass")) - F.col("_parts"))
    listed = checkpointed(listed.drop("_rows"))
    # Rows that aren't of a mass have the first parts.
    cells = listed.groupBy(*cell).agg(F.max("_all").alias("_all"), F.max(F.when(F.col("mass") < 0, F.col("_parts"))).alias("_rest"))
    masses = listed.where("mass >= 0").select(*cell, F.col("mass").alias("first"), "_parts", "_at")
    dealt = routes.join(broadcast_if_small(cells), cell, "left").join(broadcast_if_small(masses), [*cell, "first"], "left")
    part = F.coalesce("_at", F.lit(0)) + F.pmod(F.xxhash64("id", "table"), F.coalesce("_parts", "_rest"))
    with_part = dealt.withColumn("part", F.when(F.col("_all").isNotNull(), part))
    new = lambda q: F.col("_at").isNull() | (q < F.col("_at")) | (q >= F.col("_at") + F.col("_parts"))
    partners = F.when(F.col("_all").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1), new))
    paired = with_part.withColumn("_with", F.explode(partners))
    return paired.select("id", *SPACE, "unit", "part", F.concat_ws(":", "table", "cell", F.least("part", "_with"), F.greatest("part", "_with")).alias("block"))


def similar_vectors(
    units: DataFrame, k: int = 5, min_similarity: float = -1.0, radii: tuple[float, ...] = (0.3, 0.632, math.inf), n_projections: int = 40, share: float = 0.5, block_rows: int = 8192,
    route_similarity: float = 0.5, route_recall: float = 0.95, dim: int = 256, seed: int = 7,
) -> DataFrame:
    """(id, neighbour, similarity) of up to ``k`` most similar rows of the same store and namespace for each row.

    ``units`` are rows of ``unit_vectors``. ``radii`` are the distances of unit vectors that the windows are made
    for, in rising order. A row alone in its namespace has no neighbours; an empty input gives an empty result.
    """
    sizes = units.groupBy(*SPACE).agg(F.count("*").alias("_rows")).where(F.col("_rows") > block_rows)
    bits = F.least(F.lit(ROUTE_BITS // 2), F.ceil(F.log2(F.col("_rows") / block_rows))).cast("int")
    sizes = broadcast_if_small(sizes.withColumn("bits", bits).withColumn("tables", tables_needed(F.col("bits"), route_similarity, route_recall)).drop("_rows"))
    small = units.join(sizes, list(SPACE), "left_anti").select("id", *SPACE, "unit")
    large = _blocks(units.join(sizes, list(SPACE)), dim, seed, block_rows)

    def block(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids = group.column("id")
        units = _matrix(group.column("unit"), dim)
        part = group.column("part").to_numpy() if "part" in group.column_names and not group.column("part").null_count else None
        if part is None:
            query, other, cosine = count_collisions(units, k, radii, n_projections, share, min_similarity, seed)
        elif (part == part[0]).all():
            query, other, cosine = compare_all(units, None, k, min_similarity)
        else:
            a, b = np.nonzero(part == part.min())[0], np.nonzero(part != part.min())[0]
            there, back = compare_all(units[a], units[b], k, min_similarity), compare_all(units[b], units[a], k, min_similarity)
            query, other, cosine = np.concatenate([a[there[0]], b[back[0]]]), np.concatenate([b[there[1]], a[back[1]]]), np.concatenate([there[2], back[2]])
        return pa.table({"id": ids.take(pa.array(query)), "neighbour": ids.take(pa.array(other)), "similarity": pa.array(cosine.astype(np.float64))})

    pairs = "id string, neighbour string, similarity double"
    alone = small.groupBy(*SPACE).applyInArrow(block, pairs)
    merged = large.groupBy(*SPACE, "block").applyInArrow(block, pairs).groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    merged = merged.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")
    return alone.unionByName(merged)


def exact_neighbours(units: DataFrame, asked: DataFrame, k: int, min_similarity: float, dim: int = 256, block_rows: int = 8192) -> DataFrame:
    """(id, neighbour, similarity): brute force, for measuring recall. The rows of ``asked`` (id) against all of their namespace.

    Asked rows are dealt into blocks and each block is compared with every block of rows of its namespace.
    """
    sizes = units.groupBy(*SPACE).agg(F.count("*").alias("_rows"))
    sizes = broadcast_if_small(sizes.select(*SPACE, F.ceil(F.col("_rows") / block_rows).cast("long").alias("_blocks")))
    dealt = units.select("id", *SPACE, "unit").join(sizes, list(SPACE)).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    # About one row in fifty is asked, so 25 blocks of rows make one of asked rows.
    asks = F.ceil(F.col("_blocks") / 25).cast("long")
    queries = dealt.join(asked.distinct(), "id", "left_semi").withColumns({"_block": upto(F.col("_blocks")), "_ask": F.pmod(F.xxhash64("unit"), asks), "asked": F.lit(True)})
    both = dealt.withColumns({"_ask": upto(asks), "asked": F.lit(False)}).unionByName(queries)

    def compare(group: pa.Table) -> pa.Table:
        of = group.filter(group.column("asked")).sort_by("id")
        rows = group.filter(pc.invert(group.column("asked"))).sort_by("id")
        if not of.num_rows or not rows.num_rows:
            query, other, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            # One more than asked for, as a row is its own nearest.
            query, other, cosine = compare_all(_matrix(of.column("unit"), dim), _matrix(rows.column("unit"), dim), k + 1, min_similarity)
        return pa.table({"id": of.column("id").take(pa.array(query)), "neighbour": rows.column("id").take(pa.array(other)), "similarity": pa.array(cosine)})

    found = both.groupBy(*SPACE, "_block", "_ask").applyInArrow(compare, "id string, neighbour string, similarity double").where("id <> neighbour")
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def with_classes(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives of the exact copies of one store and namespace, and (rep, id) of all rows.

    The smallest id represents its class. Only classes of two or more are joined back, and the count is combined
    before the shuffle, so a class that holds a third of all rows is as cheap as any other.
    """
    keys = [*SPACE, "copy_key"]
    classes = units.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    classes = broadcast_if_small(classes)
    joined = units.join(classes, keys, "left")
    reps = joined.where(F.col("rep").isNull() | (F.col("rep") == F.col("id"))).drop("rep")
    members = units.drop("unit").join(classes, keys, "left").select(F.coalesce("rep", "id").alias("rep"), "id")
    return reps, members


def spread_over_copies(neighbours: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, similarity): the ``k`` best of every member, copies included, from those of representatives.

    A copy has similarity 1. Of a class no more than ``k`` + 1 members (the smallest ids) can be among the best of
    another row, so only those are joined; nothing is lost by that, as ties go to the smaller id.
    """
    first = Window.partitionBy("rep").orderBy("id")
    heads = members.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    copied = heads.groupBy("rep").agg(F.count("*").alias("_n")).where("_n > 1")
    links = neighbours.select(F.col("id").alias("rep"), F.col("neighbour").alias("other"), "similarity")
    links = links.unionByName(copied.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity")))
    links = links.join(heads.select(F.col("rep").alias("other"), F.col("id").alias("neighbour")), "other").drop("other")
    # A large class is one key: its members stay where they are and its few links come to them.
    large = broadcast_if_small(members.groupBy("rep").agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE_CLASS).drop("_n"))
    few = checkpointed(links.join(large, "rep"))
    joined = members.join(broadcast_if_small(few), "rep").unionByName(members.join(large, "rep", "left_anti").join(links, "rep"))
    all_pairs = joined.where(F.col("id") != F.col("neighbour")).select("id", "neighbour", "similarity")
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    return all_pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def most_similar(vectors: DataFrame, k: int = 5, min_similarity: float = -1.0, dim: int = 256, **how: object) -> DataFrame:
    """(id, neighbour, similarity, rank) of the ``k`` most similar usable vectors for every usable vector.

    ``vectors`` has id, store_name, namespace, embedding and created_at; see ``latest_versions`` and
    ``unit_vectors`` for repeated, null and unusable rows, ``similar_vectors`` for the method's parameters.
    """
    units = checkpointed(unit_vectors(latest_versions(vectors), dim))
    reps, members = with_classes(units)
    found = checkpointed(similar_vectors(reps, k, min_similarity, dim=dim, **how))  # type: ignore[arg-type]
    return spread_over_copies(found, members, k)


def similar_pairs(vectors: DataFrame, k: int = 5, min_similarity: float = 0.8, dim: int = 256, **how: object) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which at least one is among the ``k`` most similar to the other."""
    near = most_similar(vectors, k, min_similarity, dim, **({"radii": (0.3, 0.632), "route_similarity": min_similarity, "route_recall": 0.98} | how))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
