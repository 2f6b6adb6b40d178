"""Approximate nearest neighbours over robust-pruned directed graphs, one per shard.

Each shard builds its graph in batches: a greedy search of the graph so far proposes neighbours, relaxed distance pruning
(a candidate goes when a kept neighbour is ``ALPHA`` times nearer to it than the point is) keeps diverse edges, and reverse
edges are added and pruned alike. A beam search answers every query on every shard, all queries of a block in lockstep; the
shards' answers merge into one ranking by exact distance in double precision.

Graphs and beams run on copies that a power of two brings near one, in single precision where the vectors of a shard are of
comparable size and in double precision where they are not, so no square overflows. The ranking is by exact distances.

Equal vectors are one node of a graph: it remembers the smallest ids that hold it, as many as a ranking can show, so a
vector that a third of all rows share costs one node, and ties come out by smaller id.

Scale: shards hold about ``SHARD`` distinct vectors whatever the input, and each is built by one task. Queries are a stated
set (ids divisible by ``EVERY``); they travel in blocks to the shards by an equi-join on the shard.

Defined cases: null, empty or all-zero vectors and those with null or non-finite components take no part, as queries or as
candidates; rows that repeat an id and vector count once, of several vectors under one query id the least is asked for, a query
never finds its own id; vectors of another length are
never compared; fewer candidates than asked for are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHARD = 4096
DEGREE, BEAM, ALPHA = 32, 64, 1.2
K, EVERY = 10, 100
QUERY_BLOCK = 512
#: Bytes of distinct vectors that a worker remembers before it sends them on.
HELD_BYTES = 64 << 20


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", a - b, a - b)


def beam_search(vectors: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``width`` nodes and squared distances for each query; all queries take a step together. Edges of -1 lead nowhere."""
    q, n = len(queries), len(vectors)
    nodes = np.full((q, width), -1, np.int64)
    far = np.full((q, width), np.inf, vectors.dtype)
    nodes[:, 0], far[:, 0] = start, squared(queries, vectors[start])
    opened = np.zeros((q, width), bool)
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    live = np.arange(q)
    while len(live):
        waiting = np.where(opened[live] | (nodes[live] < 0), np.inf, far[live])
        best = waiting.argmin(1)
        going = np.isfinite(waiting[np.arange(len(live)), best])
        live, best = live[going], best[going]
        if not len(live):
            break
        opened[live, best] = True
        near = edges[nodes[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        rows = np.repeat(live, fresh.sum(1))
        to = near[fresh]
        seen[rows, to] = True
        gap = np.full(near.shape, np.inf, vectors.dtype)
        gap[fresh] = squared(queries[rows], vectors[to])
        all_far = np.concatenate([far[live], gap], 1)
        all_nodes = np.concatenate([nodes[live], np.where(fresh, near, -1)], 1)
        all_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], 1)
        order = np.argsort(all_far, 1, kind="stable")[:, :width]
        far[live] = np.take_along_axis(all_far, order, 1)
        nodes[live] = np.take_along_axis(all_nodes, order, 1)
        opened[live] = np.take_along_axis(all_open, order, 1)
    return nodes, far


def prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning for many points at once: keeps the nearest candidate, drops those it relaxes away, and so on. -1 fills."""
    m = len(points)
    own = np.where((candidates >= 0) & (candidates != points[:, None]), candidates, -1)
    ordered = np.sort(own, 1)
    again = np.zeros(own.shape, bool)
    again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    own = np.where(again, -1, ordered)
    gap = np.where(own >= 0, squared(vectors[own], vectors[points][:, None, :]), np.inf)
    out = np.full((m, degree), -1, np.int64)
    for k in range(degree):
        best = gap.argmin(1)
        ok = np.isfinite(gap[np.arange(m), best])
        if not ok.any():
            break
        pick = own[np.arange(m), best]
        out[ok, k] = pick[ok]
        between = squared(vectors[own], vectors[pick][:, None, :])
        gap = np.where((alpha * alpha * between <= gap) | (own == pick[:, None]), np.inf, gap)
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges and entry point. Points enter in a fixed shuffled order, in batches that grow with the graph."""
    n = len(vectors)
    start = int(squared(vectors, vectors.mean(0)).argmin())
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(11).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at : at + min(max(at, 1), 256)]
        found, _ = beam_search(vectors, edges, start, vectors[batch], beam)
        edges[batch] = prune(vectors, batch, np.concatenate([found, edges[batch]], 1), degree, alpha)
        source, target = np.repeat(batch, degree), edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        touched, first, counts = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(touched), int(counts.max(initial=0))), -1, np.int64)
        wide[np.repeat(np.arange(len(touched)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        joined = np.concatenate([edges[touched], wide], 1)
        room = (joined >= 0).sum(1) <= degree
        packed = np.take_along_axis(joined, np.argsort(joined < 0, 1, kind="stable"), 1)[:, :degree]
        edges[touched[room]] = packed[room]
        if (~room).any():
            edges[touched[~room]] = prune(vectors, touched[~room], joined[~room], degree, alpha)
        at += len(batch)
    return edges, start


def sound(vectors: pa.Array) -> list[np.ndarray | None]:
    """Each vector of a list column in double precision, or None if it takes no part. Components are read as one flat array."""
    out: list[np.ndarray | None] = [None] * len(vectors)
    flat = vectors.flatten()  # the components of rows that are not null, end to end
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
    at = 0
    for i, n in enumerate(pc.list_value_length(vectors).to_pylist()):
        if n:
            v = values[at : at + n]
            at += n
            if np.isfinite(v).all() and v.any():
                out[i] = v
    return out


def even(base: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies of both divided by a power of two above their largest component; single precision if no vector is lost by that."""
    size = np.abs(np.concatenate([base, queries]) if len(queries) else base).max(1)
    power = int(np.frexp(size.max())[1])
    a, b = np.ldexp(base, -power), np.ldexp(queries, -power)
    if size.min() < size.max() * 1e-6:
        return a, b
    return a.astype(np.float32), b.astype(np.float32)


def nodes_of(vectors: DataFrame, shard: int, k: int) -> DataFrame:
    """Written: (shard, dim, ids, vector): distinct vectors with their ``k`` + 1 smallest ids, dealt to shards of about ``shard``."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            held.clear()
            for a in range(0, len(rows), 1000):
                part = rows[a : a + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in part], pa.binary()), pa.array([i for _, i in part], pa.list_(pa.int64()))], names=["vector", "ids"])

        size = 0
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), sound(batch.column(1)), strict=True):
                if v is None or i is None:
                    continue
                key = v.tobytes()
                if key not in held:
                    size += len(key)
                    held[key] = []
                ids = held[key]
                if i not in ids:
                    ids.append(i)
                    if len(ids) > k + 1:
                        ids.remove(max(ids))
            if size > HELD_BYTES:
                yield from out()
                size = 0
        yield from out()

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    few = rows.mapInArrow(distinct, "vector binary, ids array<long>")
    # Each task sends at most k + 1 ids a vector, so the lists to merge are bounded by the tasks, not by the copies.
    merged = few.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    merged = common.materialise(merged, "vectors")
    shards = max(1, -(-merged.count() // shard))
    dim = (F.octet_length("vector") / 8).cast("int")
    return merged.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), dim.alias("dim"), "ids", "vector")


def graphs(nodes: DataFrame) -> DataFrame:
    """Written: one row per shard and vector length with its vectors, ids, edges and entry point."""

    def task(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("ids").to_pylist(), t.column("vector").to_pylist(), strict=True))
        vectors = np.array([np.frombuffer(v, np.float64) for _, v in rows])
        edges, start = build(even(vectors, vectors[:0])[0])
        ids = pa.array([[i for i, _ in rows]], pa.list_(pa.list_(pa.int64())))
        return pa.table([t.column("shard")[:1], t.column("dim")[:1], ids, pa.array([vectors.tobytes()], pa.binary()), pa.array([edges.astype(np.int32).tobytes()], pa.binary()), pa.array([start], pa.int32())], names=["shard", "dim", "ids", "vectors", "edges", "start"])

    built = nodes.groupBy("shard", "dim").applyInArrow(task, "shard int, dim int, ids array<array<long>>, vectors binary, edges binary, start int")
    return common.materialise(built, "graphs")


def search(vectors: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query."""
    index = graphs(nodes_of(vectors, shard, k))
    asked = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("query")).filter((F.col("query_id") % every == 0) & F.col("query").isNotNull())
    whole = F.forall("query", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("query", lambda x: x != 0)
    asked = asked.filter(whole).groupBy("query_id").agg(F.min("query").alias("query"))
    places = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # one number per shard
    asked = asked.withColumn("dim", F.size("query")).join(places, "dim").withColumn("shard", F.explode("shards"))
    sent = asked.groupBy("shard", "dim", F.floor(F.col("query_id") / (every * QUERY_BLOCK)).alias("part")).agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("query").alias("queries"))
    met = sent.join(index, ["shard", "dim"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(base), -1).astype(np.int64)
                queries = np.array(row["queries"], np.float64)
                near_base, near_queries = even(base, queries)
                found, _ = beam_search(near_base, edges, row["start"], near_queries, max(beam, k + 1))
                out: list[list] = [[], [], []]
                for i, v, near in zip(row["query_ids"], queries, found, strict=True):
                    near = near[near >= 0]
                    gaps = np.sqrt(squared(base[near], v))
                    best = sorted((float(g), x) for g, n in zip(gaps, near, strict=True) for x in row["ids"][n] if x != i)[:k]
                    out[0] += [i] * len(best)
                    out[1] += [x for _, x in best]
                    out[2] += [g for g, _ in best]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = met.select("dim", "query_ids", "queries", "ids", "vectors", "edges", "start").mapInArrow(task, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
