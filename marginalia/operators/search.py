"""Queries, vector retrieval, grouping by source, rank fusion and evaluation. Full-text search is in :mod:`lexical`."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text as tx
from marginalia.functions import vectors as vx

#: Fixed values of the ranking functions.
K1, B, RRF_K, LEAST_IDF = 1.2, 0.75, 60, 1e-6
#: Chunks fetched, sources kept, distance ceiling and spread.
NOTES = {"fetch": 100, "sources": 5, "ceiling": 0.9, "spread": 1.15}
FILES = {"fetch": 60, "sources": 3, "ceiling": 0.9, "spread": 1.15}
ARTICLES = {"fetch": 40, "sources": None, "ceiling": 1.2, "spread": 1.30}
EXCERPT = 500


def parse_query(query: str) -> list[str]:
    """Pieces of a query: split at white space, without double quotes."""
    return [p for p in (piece.replace('"', "") for piece in query.split()) if p]


def match_expression(query: str) -> str:
    """The pieces as quoted prefix terms."""
    return " ".join(f'"{p}"*' for p in parse_query(query))


def phrases(query: str) -> list[list[str]]:
    """Tokens of each piece that has any; the last of a piece is a prefix."""
    import unicodedata

    def plain(s: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))

    return [found for p in parse_query(query) if (found := re.findall(r"[^\W_]+", plain(p)))]


def scanned(rows: DataFrame, predicate: Column, columns: list[str], each=None) -> DataFrame:
    """The columns of the rows that pass; ``each``, if given, is called with every Arrow batch where it is read."""
    found = rows.where(predicate).select(*columns)
    if each is None:
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each(batch)
            yield batch

    return found.mapInArrow(run, found.schema)


def knn(chunks: DataFrame, query: list[float] | Column, k: int, vector: str = "vector", tie: str = "chunk_id") -> DataFrame:
    """The ``k`` nearest chunks by squared distance, ties by ``tie``; one pass, partial top-k in each task."""
    target = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return chunks.withColumn("distance", vx.squared_l2(F.col(vector), target)).orderBy("distance", tie).limit(k)


def knn_join(chunks: DataFrame, queries: DataFrame, k: int, exclude_self: str | None = None, max_queries: int | None = None, block: int = 10_000) -> DataFrame:
    """Each query's ``k`` nearest chunks: ``query_id, distance, rank`` and the chunks' columns but the vector.

    ``queries(query_id, query_vector)`` are a stated set of any size, sent to all tasks in blocks of ``block``,
    each with a pass over the chunks; a caller may state how many there are at most, which is checked first. A
    task keeps the best ``k`` of each query from each batch, ties by ``chunk_id``, so what is shuffled does not
    grow with the pairs. Distances are exact, in double precision. A null vector, or one with a null component or
    one beyond numbers, finds nothing and is not found, nor are chunks of another dimension than the queries; queries of
    several dimensions are an error.
    """
    whole = F.forall("query_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = queries.where(F.col("query_vector").isNotNull() & whole).select("query_id", F.transform("query_vector", lambda x: x.cast("double")).alias("q"))
    if max_queries is not None and asked.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"over {max_queries} queries: search them in several calls")
    first = asked.limit(block + 1).collect()
    # one block at a time on the driver
    every = iter(first) if len(first) <= block else asked.toLocalIterator()
    near = [_near_block(chunks, queries, next_block, k, exclude_self) for next_block in iter(lambda: list(islice(every, block)), [])]
    found = reduce(DataFrame.unionByName, near or [_near_block(chunks, queries, [], k, exclude_self)])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Distances that a task holds at once.
CELLS = 1 << 22


def nearest_of(vectors: np.ndarray, order: np.ndarray, queries: np.ndarray, k: int, barred: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of their ``k`` nearest vectors, and the distances; ties by ``order``. ``barred`` are places of queries and of vectors that they do not find.

    Products of matrices find who may be among the nearest, within the rounding of their sums; only these distances
    are computed from the differences.
    """
    out, step = [], max(1, CELLS // max(1, len(vectors)))
    squares = np.square(vectors).sum(1)
    for s in range(0, len(queries), step):
        asked = queries[s : s + step]
        lengths = np.square(asked).sum(1)
        rough = lengths[:, None] + squares[None, :] - 2 * (asked @ vectors.T)
        if barred is not None:
            here = (barred[0] >= s) & (barred[0] < s + step)
            rough[barred[0][here] - s, barred[1][here]] = np.inf
        cut = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(vectors) > k else np.full(len(asked), np.inf)
        slack = 1e-12 * vectors.shape[1] * (lengths + (squares.max() if len(squares) else 0))
        a, b = np.nonzero((rough <= (cut + slack)[:, None]) & np.isfinite(rough))
        exact = np.square(vectors[b] - asked[a]).sum(1)
        best = np.lexsort((order[b], exact, a))
        a, b, exact = a[best], b[best], exact[best]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        out.append((a[place < k] + s, b[place < k], exact[place < k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def comparable(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """Rows whose vector has so many components, none of them null or beyond numbers: others are near to nothing."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == dims) & whole)


def _near_block(chunks: DataFrame, queries: DataFrame, asked: list, k: int, exclude_self: str | None) -> DataFrame:
    """Each batch's ``k`` nearest chunks to each of the rows ``asked(query_id, q)``."""
    rest = [c for c in chunks.columns if c != "vector"]
    kind = queries.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("distance", T.DoubleType()), *[chunks.schema[c] for c in rest]])
    dims = {len(r.q) for r in asked}
    if len(dims) > 1:
        raise ValueError(f"queries of {sorted(dims)} dimensions: search them in several calls")
    width = max(dims, default=0)
    shared = chunks.sparkSession.sparkContext.broadcast(([r.query_id for r in asked], np.array([r.q for r in asked], np.float64).reshape(len(asked), width)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        of_id: dict = {}
        for i, q in enumerate(ids):
            of_id.setdefault(q, []).append(i)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            rows = batch.select(rest)
            flat = np.asarray(batch.column("vector").flatten(), np.float64).reshape(batch.num_rows, width)
            _, order = np.unique(np.asarray(batch.column("chunk_id")), return_inverse=True)
            barred = None
            if exclude_self:
                own = [(i, place) for place, x in enumerate(batch.column(exclude_self).to_pylist()) for i in of_id.get(x, ())]
                barred = tuple(np.array(own, np.int64).reshape(-1, 2).T)
            a, b, distance = nearest_of(flat, order, vectors, k, barred)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in a]), pa.array(distance), *rows.take(pa.array(b)).columns], ["query_id", "distance", *rest])

    return comparable(chunks.select(*rest, "vector"), "vector", width).mapInArrow(look, schema)


def by_source(near: DataFrame, key: str, fetch: int, sources: int | None, ceiling: float, spread: float, query: str = "query_id") -> DataFrame:
    """Ranked chunks grouped by source: best distance, sources kept, ceiling and spread, excerpts in chunk order.

    ``near(query_id, key, title, chunk_index, content, distance, rank)``.
    """
    shown = tx.excerpt(F.col("content"), EXCERPT)
    grouped = near.where(F.col("rank") <= fetch).groupBy(query, key).agg(
        F.min("distance").alias("distance"), F.min_by("title", "distance").alias("title"),
        F.array_sort(F.collect_set(F.struct("chunk_index", shown.alias("excerpt")))).alias("parts"),
    )
    ranked = grouped.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("distance", key)))
    ranked = ranked.where(F.col("place") <= sources) if sources else ranked
    best = F.min("distance").over(W.partitionBy(query))
    kept = ranked.withColumn("best", best).where((F.col("best") <= ceiling) & (F.col("distance") <= F.col("best") * spread))
    return kept.select(query, key, "title", F.transform("parts", lambda p: p["excerpt"]).alias("excerpts"), "distance")


def best_by_source(near: DataFrame, keys: list[str]) -> DataFrame:
    """Each source's best distance."""
    return near.groupBy(*keys).agg(F.min("distance").alias("distance"))


def chunks_by_source(near: DataFrame, keys: list[str]) -> DataFrame:
    """The numbers of each source's chunks that were found, in order, once each."""
    return near.groupBy(*keys).agg(F.array_sort(F.collect_set("chunk_index")).alias("chunks"))


def top_sources(near: DataFrame, query: str, key: str, n: int = 5) -> DataFrame:
    """Each query's ``n`` sources of best distance."""
    place = F.row_number().over(W.partitionBy(query).orderBy("distance", key))
    return best_by_source(near, [query, key]).withColumn("place", place).where(F.col("place") <= n)


def ranked(rows: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """Rows with their place, from 1, within a query."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def rrf_sums(lists: DataFrame, key: str) -> DataFrame:
    """``key, score``: reciprocal ranks summed over the lists that hold an item."""
    return lists.groupBy(key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))


def merged_lists(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Items of either list, ``(key, rank)``, with ``rank_a``, ``rank_b`` and their fused score."""
    both = a.select(key, F.col("rank").alias("rank_a")).join(b.select(key, F.col("rank").alias("rank_b")), key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part("rank_a") + part("rank_b"))


def gold_in_top(near: DataFrame, gold: DataFrame, n: int = 3) -> DataFrame:
    """``query_id, found``: whether one of ``gold(query_id, chunk_id)`` is among each query's first ``n``."""
    hits = near.where(F.col("rank") <= n).join(gold, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("found", F.lit(True))
    return near.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("found", F.lit(False)).alias("found"))


def raw_search(near: DataFrame, k: int = 10) -> DataFrame:
    """The nearest chunks as they are, with excerpts of 200 characters."""
    return near.where(F.col("rank") <= k).select("query_id", "chunk_id", "title", tx.excerpt(F.col("content"), 200).alias("excerpt"), "distance")


def fused(lists: list[tuple[str, DataFrame]], key: str, limit: int, by: list[str] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists ``(name, df(key, rank))``: score and which lists matched, best first."""
    group = [*(by or []), key]
    every = reduce(DataFrame.unionByName, [df.select(*group, "rank", F.lit(name).alias("_list")) for name, df in lists])
    summed = every.groupBy(*group).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("_list")).alias("_lists"))
    matched = F.when(F.size("_lists") == len(lists), "both").otherwise(F.element_at("_lists", 1)).alias("matched_by")
    if by:
        place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), key))
        return summed.withColumn("_place", place).where(F.col("_place") <= limit).select(*group, "score", matched)
    return summed.select(*group, "score", matched).orderBy(F.desc("score"), key).limit(limit)


def hybrid_articles(lexical: DataFrame, semantic: DataFrame, limit: int = 5) -> DataFrame:
    """Articles of ``lexical(article_id, title, snippet, rank)`` and ``semantic(article_id, title, excerpts, distance, rank)``.

    The snippet comes first unless it is among the excerpts; distance 0 for what only words found.
    """
    a = lexical.select("article_id", F.col("title").alias("lt"), "snippet", F.col("rank").alias("lr"))
    b = semantic.select("article_id", F.col("title").alias("st"), "excerpts", "distance", F.col("rank").alias("sr"))
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    joined = a.join(b, "article_id", "full_outer").withColumn("score", part("lr") + part("sr"))
    known = F.coalesce("excerpts", F.array().cast("array<string>"))
    lead = F.when((F.coalesce("snippet", F.lit("")) != "") & ~F.array_contains(known, F.coalesce("snippet", F.lit(""))), F.array("snippet")).otherwise(F.array().cast("array<string>"))
    texts = F.concat(lead, known)
    texts = F.when(F.size(texts) == 0, F.array(F.lit(""))).otherwise(texts)
    return joined.select("article_id", F.coalesce("lt", "st").alias("title"), texts.alias("excerpts"), F.coalesce("distance", F.lit(0.0)).alias("distance"), "score").orderBy(F.desc("score"), "article_id").limit(limit)


def evaluation(ranked: DataFrame, cases: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Recall and reciprocal rank: a summary row, and a row per case.

    ``ranked(query_id, item, rank)``, ``cases(query_id, item)`` with one row for each expected item.
    """
    k = min(20, max(1, k))
    first = ranked.where(F.col("rank") <= k).join(cases, ["query_id", "item"]).groupBy("query_id").agg(F.min("rank").alias("rank"), F.min_by("item", "rank").alias("matched"))
    each = cases.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.col("rank").isNotNull().alias("hit"), F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"), "matched")
    summary = each.agg(F.count("*").alias("total_cases"), F.avg(F.col("hit").cast("double")).alias("recall_at_k"), F.avg("reciprocal_rank").alias("mrr_at_k"), F.count_if("hit").alias("hits_at_k"))
    return summary, each
