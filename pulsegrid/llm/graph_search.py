"""Approximate nearest neighbours by cosine: a neighbour graph built by NN-descent, searched greedily.

Neighbours of neighbours are likely neighbours: each round joins every node's list (and the lists it stands in) with
itself and keeps what improves. The first lists come from blocks of vectors with similar random sign codes. A query
starts at its own node, expands the best nodes it has not expanded, and stops when its pool no longer changes.
The graph works on vectors rounded to bytes; the final scores use the original ones in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage


@dataclass(frozen=True)
class GraphSettings:
    neighbours: int = 32  # list length of a node, and of the reverse list joined with it
    orders: int = 6  # random codes for the first lists
    block: int = 512  # vectors compared with each other in the first lists
    rounds: int = 10  # of NN-descent at most
    settled: float = 0.02  # stop when fewer entries than this share are new
    pool: int = 160  # nodes a search keeps
    expand: int = 40  # nodes a search expands at a time, at most the pool
    seed: int = 11


def _codes(count: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, count)).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of bytes as unit vectors."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(len(column), -1).astype(np.float32)
    return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)


def _lists(nodes, ids: list[np.ndarray], sims: list[np.ndarray], fresh: list[np.ndarray] | None = None) -> pa.RecordBatch:
    starts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
    flat = [np.concatenate(x) if len(x) else np.zeros(0) for x in (ids, sims)]
    columns = [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(starts, pa.array(flat[0].astype(np.int64))), pa.ListArray.from_arrays(starts, pa.array(flat[1].astype(np.float32)))]
    names = ["node", "ids", "sims"]
    if fresh is not None:
        columns.append(pa.ListArray.from_arrays(starts, pa.array(np.concatenate(fresh) if len(fresh) else np.zeros(0, dtype=bool))))
        names.append("fresh")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows, whole runs of one key at a time: each batch ends where a key ends. Runs are short by construction."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # keys ascend
        if cut or (held and held[-1].column(key)[0].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0] if held or cut else batch
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bounds(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)


def first_lists(nodes: DataFrame, dim: int, settings: GraphSettings) -> DataFrame:
    """node, ids, sims: the nearest of each node's block, once for each random code."""
    planes = _codes(20 * settings.orders, dim, settings.seed)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(20)[::-1]
        for batch in batches:
            if batch.num_rows:
                signs = (_matrix(batch.column("vec")) @ planes > 0).reshape(batch.num_rows, settings.orders, 20)
                codes = (signs * weights).sum(axis=2)
                for n in range(settings.orders):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes[:, n] + (n << 20), pa.int64())], names=["node", "vec", "code"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, settings.block):
                part = batch.slice(start, settings.block)
                own, vectors = part.column("node").to_numpy(), _matrix(part.column("vec"))
                sims = vectors @ vectors.T
                np.fill_diagonal(sims, -2)
                order = np.argsort(-sims, axis=1)[:, : min(settings.neighbours, len(own) - 1)]
                # Of two codes' blocks in one slice both may hold a node; it is no neighbour of itself.
                ids = [own[o[own[o] != own[n]]] for n, o in enumerate(order)]
                yield _lists(own, ids, [sims[n][o[own[o] != own[n]]] for n, o in enumerate(order)])

    coded = nodes.select("node", "vec").mapInArrow(code, "node long, vec binary, code long")
    ordered = coded.repartitionByRange("code", "node").sortWithinPartitions("code", "node")
    return ordered.mapInArrow(compare, "node long, ids array<long>, sims array<float>")


def merge_lists(known: DataFrame | None, found: DataFrame, settings: GraphSettings) -> DataFrame:
    """The best ``neighbours`` of each node out of its list and what was found; ``fresh`` marks new entries."""
    rows = found.select("node", "ids", "sims", F.lit(False).alias("old"))
    if known is not None:
        rows = rows.unionByName(known.select("node", "ids", "sims", F.lit(True).alias("old")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "node"):
            keys = batch.column("node").to_numpy()
            old = batch.column("old").to_numpy(zero_copy_only=False)
            id_lists, sim_lists = batch.column("ids"), batch.column("sims")
            nodes, ids, sims, fresh = [], [], [], []
            for start, end in _bounds(keys):
                part = id_lists.slice(start, end - start)
                all_ids = part.flatten().to_numpy()
                all_sims = sim_lists.slice(start, end - start).flatten().to_numpy()
                was = np.repeat(old[start:end], np.diff(part.offsets.to_numpy()))
                order = np.lexsort((~was, all_ids))  # an old entry stands before its copies
                all_ids, all_sims, was = all_ids[order], all_sims[order], was[order]
                once = np.ones(len(all_ids), dtype=bool)
                once[1:] = all_ids[1:] != all_ids[:-1]
                all_ids, all_sims, was = all_ids[once], all_sims[once], was[once]
                best = np.lexsort((all_ids, -all_sims))[: settings.neighbours]
                nodes.append(keys[start])
                ids.append(all_ids[best])
                sims.append(all_sims[best])
                fresh.append(~was[best])
            yield _lists(nodes, ids, sims, fresh)

    ordered = rows.repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(merge, "node long, ids array<long>, sims array<float>, fresh array<boolean>")


def join_neighbours(graph: DataFrame, nodes: DataFrame, settings: GraphSettings) -> DataFrame:
    """One round: candidates for every node from the lists it shares a pivot with, only those that beat its last entry.

    Each pivot's group is its list and the nearest ``neighbours`` nodes that list it, so no group grows with a hub.
    Pairs of two old entries were compared in an earlier round.
    """
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "sims", "fresh")).alias("e")).select(
        F.col("node").alias("pivot"), F.col("e.ids").alias("member"), F.col("e.sims").alias("sim"), F.col("e.fresh").alias("fresh")
    )
    listed = Window.partitionBy("member").orderBy(F.desc("sim"), "pivot")
    reverse = edges.withColumn("rank", F.row_number().over(listed)).where(F.col("rank") <= settings.neighbours)
    groups = edges.select("pivot", "member", "fresh").union(reverse.select("member", "pivot", "fresh"))
    groups = groups.groupBy("pivot", "member").agg(F.max("fresh").alias("fresh"))
    full = F.size("sims") >= settings.neighbours
    last = graph.select(F.col("node").alias("member"), F.when(full, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float").alias("last"))
    side = last.join(nodes.select(F.col("node").alias("member"), "vec"), "member")
    members = groups.join(side, "member").select("pivot", "member", "fresh", "last", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "pivot"):
            keys, own = batch.column("pivot").to_numpy(), batch.column("member").to_numpy()
            fresh = batch.column("fresh").to_numpy(zero_copy_only=False)
            last, vectors = batch.column("last").to_numpy(), _matrix(batch.column("vec"))
            nodes_out, ids, sims = [], [], []
            for start, end in _bounds(keys):
                part = slice(start, end)
                near = vectors[part] @ vectors[part].T
                better = (near > last[part][:, None]) & (fresh[part][:, None] | fresh[part][None, :])
                np.fill_diagonal(better, False)
                for n in np.flatnonzero(better.any(axis=1)):
                    which = np.flatnonzero(better[n])
                    nodes_out.append(own[start + n])
                    ids.append(own[part][which])
                    sims.append(near[n][which])
            yield _lists(nodes_out, ids, sims)

    ordered = members.repartition("pivot").sortWithinPartitions("pivot", "member")
    return ordered.mapInArrow(compare, "node long, ids array<long>, sims array<float>")


def neighbour_graph(nodes: DataFrame, dim: int, settings: GraphSettings = GraphSettings()) -> DataFrame:
    """node, ids, sims, fresh of every node, by NN-descent until few entries change. Each round is a stored table."""
    graph = stage(merge_lists(None, first_lists(nodes, dim, settings), settings), "graph")
    for _ in range(settings.rounds):
        found = join_neighbours(graph, nodes, settings)
        graph = stage(merge_lists(graph, found, settings), "graph")
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("new"), F.sum(F.size("ids")).alias("all")).first()
        if not changed["all"] or changed["new"] <= settings.settled * changed["all"]:
            break
    return graph


def greedy_search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, settings: GraphSettings = GraphSettings()) -> DataFrame:
    """query, ids: the pool of nodes each query (query, node, vec) ends with, its own node included.

    Every round expands the best nodes of each pool that were not expanded, for all queries in one join.
    """
    pool_type = "query long, vec binary, ids array<long>, sims array<float>, done array<boolean>"
    pools = stage(
        queries.select("query", "vec", F.array("node").alias("ids"), F.array(F.lit(1.0).cast("float")).alias("sims"), F.array(F.lit(False)).alias("done")), "pools"
    )
    lists = graph.select(F.col("node").alias("at"), F.col("ids").alias("next"))
    side = nodes.select(F.col("node").alias("candidate"), F.col("vec").alias("other"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by query: its pool's row (candidate null) and its candidates."""
        for batch in _runs(batches, "query"):
            rows = {"query": [], "vec": [], "ids": [], "sims": [], "done": []}
            columns = {name: batch.column(name) for name in batch.schema.names}
            keys = columns["query"].to_numpy()
            for start, end in _bounds(keys):
                candidates, others = columns["candidate"].slice(start, end - start).to_pylist(), columns["other"].slice(start, end - start).to_pylist()
                base = next(n for n, c in enumerate(candidates) if c is None)
                ids, sims, done = ([*columns[c][start + base].as_py()] for c in ("ids", "sims", "done"))
                for n in sorted((n for n in range(len(ids)) if not done[n]), key=lambda n: (-sims[n], ids[n]))[: settings.expand]:
                    done[n] = True
                new = {c: v for c, v in zip(candidates, others, strict=True) if c is not None and c not in set(ids)}
                vec = columns["vec"][start + base].as_py()
                if new:
                    vectors = _matrix(pa.array([vec, *new.values()], pa.binary()))
                    ids += new
                    sims += (vectors[1:] @ vectors[0]).tolist()
                    done += [False] * len(new)
                best = sorted(range(len(ids)), key=lambda n: (-sims[n], ids[n]))[: settings.pool]
                for name, value in (("query", int(keys[start])), ("vec", vec), ("ids", [ids[n] for n in best]), ("sims", [sims[n] for n in best]), ("done", [done[n] for n in best])):
                    rows[name].append(value)
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    while True:
        open_nodes = pools.select(
            "query", F.filter(F.arrays_zip("ids", "sims", "done"), lambda e: ~e["done"]).alias("open")
        ).where(F.size("open") > 0)
        if open_nodes.isEmpty():
            return pools.select("query", "ids")
        # The pool is kept in order, so the first open entries are the best.
        at = open_nodes.select("query", F.explode(F.slice("open", 1, settings.expand)).alias("e")).select("query", F.col("e.ids").alias("at"))
        candidates = at.join(lists, "at").select("query", F.explode("next").alias("candidate")).distinct().join(side, "candidate")
        rows = pools.select("*", F.lit(None).cast("long").alias("candidate"), F.lit(None).cast("binary").alias("other")).unionByName(
            candidates.select("query", "candidate", "other"), allowMissingColumns=True
        )
        pools = stage(rows.repartition("query").sortWithinPartitions("query").mapInArrow(grow, pool_type), "pools")


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row divided by a power of two near its largest component: same directions, and squares that cannot overflow."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, settings: GraphSettings = GraphSettings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, ``id_col``, score: the ``k`` nearest other rows found for each query row, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors of
    another than the commonest length (the shorter of equals). Repeated rows count once; of several vectors under one
    id the least counts. Equal vectors are one node of the graph, of which the ``k`` + 1 smallest ids come back.
    Fewer rows than ``k`` + 1 give all; an empty table gives none; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asked"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound)
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    rows = stage(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 0
    rows = rows.where(F.size("v") == dim)

    same = Window.partitionBy("v")
    firsts = rows.withColumn("n", F.row_number().over(same.orderBy("id"))).where(F.col("n") <= k + 1)
    firsts = stage(firsts.select("id", "v", F.min("id").over(same).alias("node")), "firsts")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                full = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                top = np.abs(full).max(axis=1, keepdims=True)
                small = np.rint(full / top * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in small], pa.binary())], names=["node", "vec"])

    nodes = stage(firsts.where(F.col("id") == F.col("node")).select("node", "v").mapInArrow(shrink, "node long, vec binary"), "nodes")
    graph = neighbour_graph(nodes, dim, settings)
    asked = rows.where("asked").select(F.col("id").alias("query"), "v")
    queries = stage(asked.join(firsts.where(F.col("id") == F.col("node")).select("node", "v"), "v").select("query", "node", "v"), "queries")
    pools = greedy_search(queries.join(nodes, "node").select("query", "node", "vec"), graph, nodes, settings)

    found = pools.select("query", F.explode("ids").alias("node")).join(firsts.select("node", "id", F.col("v").alias("w")), "node")
    found = found.where(F.col("id") != F.col("query")).join(queries.select("query", "v"), "query").select("query", "id", "v", "w")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_scaled(batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1)) for c in ("v", "w"))
                # Summed row by row, so equal vectors get equal scores.
                value = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(value)], names=["query", "id", "score"])

    scored = found.mapInArrow(score, "query long, id long, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
