"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors are merged first, keeping the smallest ids that any result can name, so copies neither clog
the graphs nor gather in one shard. Distinct vectors are dealt to shards by hash, of each dimension on their own.
A shard's vectors are inserted in lots, the first ones linked from all pairs, the others by a search of the graph
as far as it is built; both link back. Links are chosen by the usual diversity rule. A graph is stored as flat neighbour
arrays. All queries search all shards of their dimension, in blocks, and the shards' results are merged.
Largest inner product becomes nearest neighbour by one more dimension that makes all vectors of a shard equally long.

Shards are few and large, as a query's work in one grows with the logarithm of its size only; there are never
fewer than eight for a dimension, so up to eight full shards the work grows in proportion to queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import persisted

#: Links of a node in upper layers and in the base layer, neighbours they are chosen from, and the search beam.
LINKS, BASE_LINKS, POOL, BEAM = 16, 32, 64, 128
#: Vectors of a shard, fewest shards, and queries of a block.
PER_SHARD, LEAST_SHARDS, PER_BLOCK = 1 << 14, 8, 512
#: Vectors that are linked from all pairs, in lots that double from so many on, and those of a batch that is inserted then.
FIRST, _START, BATCH = 8192, 64, 2048
#: Further places where a search begins, nodes it expands at once, beam of upper layers, and queries searched together.
_SEEDS, _WIDE, _UPPER, _TOGETHER = 8, 4, 24, 256


@dataclass
class Graph:
    """``nodes`` of each layer (base first, as numbers of vectors) and their neighbours in it (-1: none)."""

    nodes: list[np.ndarray]
    links: list[np.ndarray]


def _diverse(vectors: np.ndarray, best: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates (nearest first, -1: none) up to ``most``: those nearer to the row's own vector than to a chosen one, then the nearest others."""
    cloud = vectors[best]
    among = cloud @ cloud.transpose(0, 2, 1)
    kept = np.zeros(best.shape, bool)
    for t in range(best.shape[1]):
        shaded = (kept[:, :t] & (among[:, :t, t] >= score[:, t : t + 1])).any(1)
        kept[:, t] = ~shaded & (kept.sum(1) < most) & (best[:, t] >= 0)
    rank = np.argsort(~kept, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(best, rank, 1)


def _linked_back(vectors: np.ndarray, links: np.ndarray, half: int, source: np.ndarray, target: np.ndarray) -> None:
    """Puts links from targets to sources into the second part of the targets' rows, which keeps those that the diversity rule chooses."""
    most = links.shape[1] - half
    touched = np.unique(target)
    old = links[touched, half:]
    known = old >= 0
    source = np.concatenate([source, old[known]])
    target = np.concatenate([target, np.repeat(touched, known.sum(1))])
    score = np.einsum("id,id->i", vectors[source], vectors[target])
    order = np.lexsort((source, -score, target))
    source, target, score = source[order], target[order], score[order]
    row = np.searchsorted(touched, target)
    place = np.arange(len(target)) - np.searchsorted(target, target)
    room = place < 2 * most
    best = np.full((len(touched), 2 * most), -1, np.int64)
    near = np.full(best.shape, -np.inf, np.float32)
    best[row[room], place[room]], near[row[room], place[room]] = source[room], score[room]
    full = np.flatnonzero(best[:, most] >= 0)
    for at in range(0, len(full), 2048):
        some = full[at : at + 2048]
        best[some, :most] = _diverse(vectors, best[some], near[some], most)
    links[touched, half:] = best[:, :most]


def _layer(vectors: np.ndarray, most: int, first: int = FIRST) -> np.ndarray:
    """Neighbour numbers (n, most) of a layer's vectors: half of them chosen by each node, the others by those that chose it."""
    n = len(vectors)
    links = np.full((n, most), -1, np.int32)
    half = max(1, most // 2)
    def back(start: int, end: int) -> None:
        source, target = np.repeat(np.arange(start, end), half), links[start:end, :half].ravel()
        source, target = source[target >= 0], target[target >= 0]
        # a link that goes both ways needs no second place
        mutual = (links[target, :half] == source[:, None]).any(1)
        _linked_back(vectors, links, half, source[~mutual], target[~mutual].astype(np.int64))

    # each lot among all up to its end, so that the first ones reach far
    done, first = 0, min(first, n)
    while done < first:
        end = min(first, max(_START, 2 * done))
        pool = min(POOL, end - 1)
        for at in range(done, end if pool else 0, 256):
            own = vectors[at : min(end, at + 256)]
            near = own @ vectors[:end].T
            near[np.arange(len(own)), at + np.arange(len(own))] = -np.inf
            best = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
            score = np.take_along_axis(near, best, 1)
            order = np.argsort(-score, axis=1, kind="stable")
            chosen = _diverse(vectors, np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1), half)
            links[at : at + len(own), : chosen.shape[1]] = chosen
        back(done, end)
        done = end
    for at in range(first, n, BATCH):
        end = min(n, at + BATCH)
        own = vectors[at:end]
        found, score = search(Graph([np.arange(at, dtype=np.int32)], [links[:at]]), vectors[:at], own, POOL)
        # those of the same batch are not in the graph yet
        near = own @ own.T
        np.fill_diagonal(near, -np.inf)
        pool = min(POOL // 2, len(own) - 1)
        beside = np.argpartition(-near, pool - 1, axis=1)[:, :pool] if pool else np.zeros((len(own), 0), int)
        best = np.concatenate([found, beside + at], 1)
        score = np.concatenate([score, np.take_along_axis(near, beside, 1)], 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :POOL]
        chosen = _diverse(vectors, np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1), half)
        links[at:end, : chosen.shape[1]] = chosen
        back(at, end)
    return links


def build(vectors: np.ndarray, first: int = FIRST) -> Graph:
    """The graph of a shard's vectors, which are in random order: each layer is the beginning of the one below, thinner by the factor of links."""
    longest = np.square(vectors, dtype=np.float64).sum(1)
    level = np.sqrt(np.maximum(0, longest.max(initial=0) - longest))
    lifted = np.column_stack([vectors, level]).astype(np.float32)
    graph, n = Graph([], []), len(vectors)
    while not graph.nodes or n > 1:
        graph.nodes.append(np.arange(n, dtype=np.int32))
        graph.links.append(_layer(lifted[:n], LINKS if graph.nodes[1:] else BASE_LINKS, first))
        n //= LINKS
    return graph


def search(graph: Graph, vectors: np.ndarray, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and inner products (float32) of up to ``beam`` vectors found for each query, best first (-1: none)."""
    parts = [_search(graph, vectors, queries[at : at + _TOGETHER], beam) for at in range(0, len(queries), _TOGETHER)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _search(graph: Graph, vectors: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros((len(queries), 1), np.int64)
    # each layer is the beginning of the one below, so numbers hold in all of them
    for nodes, links in zip(graph.nodes[:0:-1], graph.links[:0:-1], strict=True):
        at = np.maximum(_beam(links, vectors[: len(nodes)], queries, at, _UPPER)[0], 0)
    return _beam(graph.links[0], vectors, queries, at, beam)


def _beam(links: np.ndarray, vectors: np.ndarray, queries: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of a layer from ``at`` (queries x places) and a few places more."""
    n, q = len(vectors), len(queries)
    beam = min(beam, n)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    ids = np.full((q, beam), n)
    scores = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    fresh = np.column_stack([at, np.tile(np.linspace(0, n - 1, _SEEDS).astype(np.int64), (q, 1))])
    active = np.arange(q)
    while len(active):
        rows = np.arange(len(active))[:, None]
        fresh = np.sort(np.where(seen[active[:, None], fresh], n, fresh), axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        seen[active[:, None], fresh] = True
        own = np.einsum("qd,qmd->qm", queries[active], vectors[np.minimum(fresh, n - 1)])
        own[fresh == n] = -np.inf
        every = np.concatenate([ids[active], fresh], 1)
        score = np.concatenate([scores[active], own], 1)
        state = np.concatenate([done[active], fresh == n], 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
        every, score, state = (np.take_along_axis(x, order, 1) for x in (every, score, state))
        # the best that are not expanded yet
        wait = np.argsort(state, axis=1, kind="stable")[:, :_WIDE]
        go = ~np.take_along_axis(state, wait, 1)
        state[rows, wait] = True
        ids[active], scores[active], done[active] = every, score, state
        near = links[np.where(go, np.minimum(np.take_along_axis(every, wait, 1), n - 1), 0)]
        near = np.where(go[:, :, None] & (near >= 0), near, n)
        more = go.any(1)
        active, fresh = active[more], near[more].reshape(int(more.sum()), near.shape[1] * near.shape[2])
    return np.where(np.isfinite(scores), ids, -1), scores


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    size = lambda x: F.abs(x.cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (size(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _packed(rows: DataFrame, dtype: str, k: int) -> DataFrame:
    """``v, ids``: of the rows of a batch that have equal vectors, the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            for key, v in zip(batch.column(0).to_pylist(), _bytes(batch.column(1), dtype), strict=True):
                ids.setdefault(v, []).append(key)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array([sorted(set(x))[:k] for x in ids.values()], pa.list_(pa.int64()))], ["v", "ids"])

    return rows.mapInArrow(run, "v binary, ids array<long>")


def _bytes(column: pa.ListArray, dtype: str) -> list[bytes]:
    data, size = np.asarray(column.flatten()).astype(dtype).tobytes(), np.dtype(dtype).itemsize
    ends = np.cumsum(np.asarray(column.value_lengths(), np.int64)) * size
    return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]  # noqa: B905


def index(distinct: DataFrame, dtype: str) -> DataFrame:
    """One row per ``width`` and ``shard`` of ``distinct(v, ids, width, shards)``: vectors, ids and flat neighbour arrays of the layers."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        # the order of the shard's vectors is random, but the same in every run
        frame = frame.sort_values("v").sample(frac=1, random_state=int(frame["shard"].iloc[0]))
        vectors = np.frombuffer(b"".join(frame["v"]), dtype).reshape(len(frame), -1)
        graph = build(vectors.astype(np.float32))
        lengths = np.array([len(x) for x in frame["ids"]], np.int32)
        layers = {c: [[x.astype(np.int32).tobytes() for x in part]] for c, part in (("nodes", graph.nodes), ("links", graph.links))}
        keys = {c: frame[c].iloc[:1].to_numpy() for c in ("width", "shard")}
        return pd.DataFrame({**keys, "n": [len(frame)], "vectors": [vectors.tobytes()], "id_counts": [lengths.tobytes()], "ids": [np.concatenate(frame["ids"].to_list()).astype(np.int64).tobytes()], **layers})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), "shards").cast("int"))
    return dealt.groupBy("width", "shard").applyInPandas(make, "width int, shard int, n int, vectors binary, id_counts binary, ids binary, nodes array<binary>, links array<binary>")


def nearest(rows: DataFrame, k: int = 20, every: int = 20, beam: int = BEAM, per_shard: int = PER_SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose ``vec_id`` is divisible by ``every`` the ``k`` rows
    found of largest inner product, ties to the smaller id.

    ``rows(vec_id, embedding)``. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without id; a vector's candidates are those of its own dimension. Rows that repeat an id with
    the same vector are one; a query's own id is never among its results. Scores are computed in double precision
    on the given components. Every usable row is indexed; other columns are ignored; no rows give none.
    """
    dtype = "<f8" if isinstance(rows.schema["embedding"].dataType.elementType, T.DoubleType) else "<f4"
    width = F.length("v").alias("width")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    smallest = lambda ids: F.slice(F.array_sort(F.array_distinct(F.flatten(ids))), 1, k + 1)
    distinct = persisted(_packed(good, dtype, k + 1).groupBy("v").agg(smallest(F.collect_list("ids")).alias("ids")), "vectors").select("v", "ids", width)
    plan = persisted(distinct.groupBy("width").agg(F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.count("*") / per_shard)).cast("int").alias("shards")), "plan")
    graphs = persisted(index(distinct.join(plan, "width"), dtype), "graphs")

    asked = persisted(_asked(good.where(F.col("vec_id") % every == 0), dtype), "queries")
    kinds = persisted(asked.select("v").distinct(), "kinds").select("v", width)
    blocks = kinds.groupBy("width").agg(F.ceil(F.count("*") / PER_BLOCK).alias("blocks"))
    packed = kinds.join(blocks, "width").groupBy("width", F.pmod(F.xxhash64("v", F.lit(7)), "blocks").alias("block")).agg(F.collect_list("v").alias("queries"))
    jobs = packed.join(plan, "width").select("width", "queries", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: column[row].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                yield _looked_up(one, dtype, k, beam)

    found = jobs.join(graphs, ["width", "shard"]).select("queries", "vectors", "id_counts", "ids", "nodes", "links").mapInArrow(look, "v binary, near array<struct<cost:double,id:long>>")
    merged = found.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    met = asked.join(merged, "v")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = met.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.cost")).alias("score"))


def _asked(rows: DataFrame, dtype: str) -> DataFrame:
    """``query_id, v`` of the rows, repeated ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_bytes(batch.column(1), dtype), pa.binary())], ["query_id", "v"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "query_id long, v binary").distinct()


def _looked_up(shard: dict, dtype: str, k: int, beam: int) -> pa.RecordBatch:
    """A block of queries searched in a shard: for each the best ``k + 1`` rows, exactly scored."""
    queries = np.frombuffer(b"".join(shard["queries"]), dtype).reshape(len(shard["queries"]), -1)
    vectors = np.frombuffer(shard["vectors"], dtype).reshape(-1, queries.shape[1])
    ids, ends = np.frombuffer(shard["ids"], np.int64), np.cumsum(np.frombuffer(shard["id_counts"], np.int32))
    nodes = [np.frombuffer(x, np.int32) for x in shard["nodes"]]
    graph = Graph(nodes, [np.frombuffer(x, np.int32).reshape(len(n), -1) for x, n in zip(shard["links"], nodes, strict=True)])
    got, _ = search(graph, vectors.astype(np.float32), queries.astype(np.float32), beam)
    out = []
    for query, hits in zip(queries.astype(np.float64), got, strict=True):
        hits = hits[hits >= 0]
        scores = (vectors[hits].astype(np.float64) * query).sum(1)
        # a vector's smallest id decides ties between vectors; k + 1 vectors have all rows that can count
        first = ids[np.where(hits > 0, ends[hits - 1], 0)]
        best = np.lexsort((first, -scores))
        rows, cut = [], None
        for i in best:
            if len(rows) > k and scores[i] != cut:
                break
            h = hits[i]
            rows += [(-scores[i], x) for x in ids[ends[h - 1] if h else 0 : ends[h]].tolist()]
            cut = scores[i]
        rows.sort()
        out.append([{"cost": c, "id": x} for c, x in rows[: k + 1]])
    kind = pa.list_(pa.struct([("cost", pa.float64()), ("id", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(shard["queries"], pa.binary()), pa.array(out, kind)], ["v", "near"])
