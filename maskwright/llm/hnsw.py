"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one for each shard.

Vectors are dealt to shards by a hash.  The nodes of a shard are numbered by
level, the highest first, so that a layer of the graph holds the nodes below some
number, and its links are one flat array with a row of neighbours for each node.
A query is answered in every shard and the answers are merged.  Nodes are added,
and queries searched, many at a time in step.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Neighbours of a node on the upper layers; the lowest has twice as many.
LINKS = 16
#: Candidates kept while adding a node, and while searching.
EF_BUILD, EF_SEARCH = 96, 160
#: Vectors that are worth a shard of their own until there are ``SHARDS``, and vectors and bytes of a shard at most (a task
#: holds one shard).
SHARDS, FEW_ROWS, SHARD_ROWS, SHARD_BYTES = 8, 1000, 10_000, 64 << 20
#: A search keeps one candidate at least for so many vectors of the shard: recall falls with a shard's size otherwise.
WIDEN = 31
#: Vectors of a shard differ by a factor of at most ``2**BAND`` in length, so that the graph's single precision tells them apart.
BAND = 4
#: Nodes or queries that are handled in step, and candidates of each that are expanded in one step.
STEP, WIDTH = 256, 4


def _search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, ef: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries in step: up to ``ef`` nodes (-1: none) and similarities.

    ``links`` has the neighbours of the nodes of the layer (-1: none); ``entries`` the nodes to start from; only nodes
    with numbers under ``below`` are looked at.
    """
    m, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((m, below + 1), bool)  # the last column stands for no node
    nodes = np.where(entries < below, entries, -1)
    nodes[(nodes < 0).all(axis=1), 0] = 0
    seen[rows, nodes] = True
    sims = np.where(nodes >= 0, np.einsum("md,mkd->mk", q, x[nodes]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
    nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
    first = nodes.shape[1]
    nodes = np.pad(nodes, ((0, 0), (0, ef - first)), constant_values=-1)
    sims = np.pad(sims, ((0, 0), (0, ef - first)), constant_values=-np.inf)
    done = nodes < 0
    live = np.arange(m)
    while len(live):
        todo = ~done[live]
        live = live[todo.any(axis=1)]
        if not len(live):
            break
        todo = ~done[live]
        pick = np.argsort(~todo, axis=1, kind="stable")[:, :WIDTH]  # the best that are not expanded yet
        valid = np.take_along_axis(todo, pick, 1)
        at = live[:, None]
        done[at, pick] = True
        near = links[np.where(valid, nodes[at, pick], 0)]
        near = np.where(valid[:, :, None] & (near < below), near, -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[at, near]] = -1
        seen[at, near] = True
        near.sort(axis=1)
        near = near[:, (near >= 0).any(axis=0)]
        if not near.shape[1]:
            continue
        sim = np.where(near >= 0, np.matmul(x[near], q[live][:, :, None])[:, :, 0], -np.inf)
        all_n, all_s = np.hstack([nodes[live], near]), np.hstack([sims[live], sim])
        all_d = np.hstack([done[live], near < 0])
        best = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
        nodes[live] = np.take_along_axis(all_n, best, 1)
        sims[live] = np.take_along_axis(all_s, best, 1)
        done[live] = np.take_along_axis(all_d, best, 1)
    return nodes, sims


def _spread(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` of each row's candidates (sorted by similarity, -1 last): those nearer to the row's node than to
    any chosen one, then the nearest of the others."""
    m, c = nodes.shape
    vectors = x[nodes]
    between = np.matmul(vectors, vectors.transpose(0, 2, 1))
    chosen = np.zeros((m, c), bool)
    for j in range(c):
        blocked = (chosen[:, :j] & (between[:, j, :j] >= sims[:, j, None])).any(axis=1)
        chosen[:, j] = ~blocked & (nodes[:, j] >= 0) & (chosen[:, :j].sum(axis=1) < keep)
    order = np.argsort(np.where(nodes < 0, 2, ~chosen), axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(nodes, order, 1)


def _ranked(nodes: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add the reverse of the links ``new -> chosen``; a full row is chosen anew."""
    width = links.shape[1]
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(begin, count)
    fresh = np.full((len(nodes), int(count.max(initial=0))), -1, np.int64)
    fresh[np.repeat(np.arange(len(nodes)), count), place] = source
    for k in range(0, len(nodes), STEP):
        own, added = nodes[k : k + STEP], fresh[k : k + STEP]
        added = added[:, (added >= 0).any(axis=0)]
        both = np.hstack([links[own], added])
        sims = np.where(both >= 0, np.matmul(x[both], x[own][:, :, None])[:, :, 0], -np.inf)
        both, sims = _ranked(both, sims, 3 * width)
        links[own] = _spread(x, both, sims, width)


@dataclass
class Graph:
    """Vectors in the order of their nodes (scaled for the graph), and the links of each layer, the lowest first."""

    x: np.ndarray
    layers: list[np.ndarray]

    def entries(self, q: np.ndarray, above: int, ef: int = 8) -> np.ndarray:
        """Nodes to start from on layer ``above - 1``, found from the top down to layer ``above``."""
        found = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.layers) - 1, above - 1, -1):
            links = self.layers[layer]
            found, _ = _search(self.x, links, q, found, ef, len(links))
        return found

    def nearest(self, q: np.ndarray, ef: int) -> np.ndarray:
        return _search(self.x, self.layers[0], q, self.entries(q, 1), ef, len(self.layers[0]))[0]


def build_graph(vectors: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 0) -> tuple[Graph, np.ndarray]:
    """The graph, and which vector each of its nodes is.

    A coordinate is added that gives all vectors the same length, so that the largest inner products are the nearest.
    """
    n = len(vectors)
    x = np.asarray(vectors, np.float64)
    x = x / max(np.abs(x).max(initial=0), 1e-300)
    square = (x * x).sum(axis=1)
    x = np.hstack([x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]])
    x = (x / np.sqrt(max(square.max(initial=0), 1e-300))).astype(np.float32)
    levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
    order = np.argsort(-levels, kind="stable")
    x, levels = x[order], levels[order]
    counts = [int((levels >= level).sum()) for level in range(int(levels.max(initial=0)) + 1)]
    graph = Graph(x, [np.full((c, 2 * links if i == 0 else links), -1, np.int64) for i, c in enumerate(counts)])
    for layer in range(len(counts) - 1, -1, -1):
        table, count = graph.layers[layer], counts[layer]
        begun = 0
        while begun < count:
            end = min(count, begun + min(STEP, max(begun, STEP)))
            new = np.arange(begun, end)
            q = x[new]
            inside = np.matmul(q, q.T)
            np.fill_diagonal(inside, -np.inf)
            nodes, sims = np.broadcast_to(new, inside.shape), inside
            if begun:
                starts = graph.entries(q, layer + 1)
                far_n, far_s = _search(x, table, q, starts, ef, begun)
                nodes, sims = np.hstack([far_n, nodes]), np.hstack([far_s, sims])
            nodes, sims = _ranked(nodes, sims, ef)
            nodes = np.where(np.isfinite(sims), nodes, -1)
            picked = _spread(x, nodes, sims, table.shape[1] // 2 if layer == 0 else table.shape[1])
            table[new, : picked.shape[1]] = picked
            _link_back(x, table, new, picked)
            begun = end
    return graph, order


def _finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _band(v: Column) -> Column:
    """The binary logarithm of a vector's length in steps of ``BAND``."""
    most = F.array_max(F.transform(v, F.abs))
    squares = F.aggregate(v, F.lit(0.0), lambda total, c: total + (c / most) * (c / most))
    return F.floor((F.log2(most) + F.log2(squares) / 2) / BAND).cast("int")


def _clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part, as doubles and without repeats; zeros have no sign."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c + F.lit(0.0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & _finite(F.col("v"))
    )


def build_index(
    rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shards: int = SHARDS, shard_rows: int = SHARD_ROWS,
) -> tuple[DataFrame, int]:
    """A stored table with one row for each shard, and the number of shards.

    Every vector is indexed.  Equal vectors are one node with the ``k + 1`` smallest ids that have it: no other can be
    among the ``k`` nearest of anything.  Shards hold vectors of one dimension and of similar length; there are so many that
    a shard has about ``shard_rows`` vectors and ``SHARD_BYTES`` at most, which is what a task holds.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    ranked = _clean(rows, id_col, vector_col).distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    kind = F.concat_ws(":", F.size("v"), _band(F.col("v")))
    nodes = staged(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("kind", kind), "vectors")
    kinds = sorted((r["kind"], r["d"], r["n"]) for r in nodes.groupBy("kind").agg(F.first(F.size("v")).alias("d"), F.count("*").alias("n")).collect())
    first, total = {}, 0
    for name, d, n in kinds:
        most = max(min(shard_rows, SHARD_BYTES // (8 * d)), 1)
        count = max(min(shards, -(-n // FEW_ROWS)), -(-n // most))
        first[name] = (total, count)
        total += count
    if not total:
        first, total = {"": (0, 1)}, 1
    lookup = F.create_map(*[c for name, (f, n) in first.items() for c in (F.lit(name), F.struct(F.lit(f).alias("f"), F.lit(n).alias("n")))])
    at = lookup[F.col("kind")]
    dealt = nodes.withColumn("shard", (at["f"] + F.pmod(F.xxhash64("v"), at["n"])).cast("int")).select("shard", "v", "ids")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        for shard in sorted(set(table.column("shard").to_pylist())):
            part = table.filter(pc.equal(table.column("shard"), shard)).combine_chunks()
            d = len(part.column("v")[0])
            raw = part.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
            by = np.lexsort(raw.T)  # in an order of their own, whatever order they came in
            graph, order_ = build_graph(raw[by], seed=shard)
            place = by[order_]
            ids = part.column("ids").take(pa.array(place))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([d], pa.int32()),
                    pa.array([raw[place].tobytes()], pa.binary()), pa.array([graph.x.tobytes()], pa.binary()),
                    pa.array([json.dumps([layer.shape for layer in graph.layers])]),
                    pa.array([b"".join(layer.astype(np.int32).tobytes() for layer in graph.layers)], pa.binary()),
                    pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
                ],
                ["shard", "d", "vectors", "scaled", "shapes", "links", "ids"],
            )

    schema = "shard int, d int, vectors binary, scaled binary, shapes string, links binary, ids array<array<long>>"
    return staged(dealt.repartitionById(total, F.col("shard")).mapInArrow(build, schema), "graphs"), total


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", ef: int = EF_SEARCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, its own id left out.

    Scores are inner products of the original vectors in double precision; ties go to the smaller id.  Every shard
    reads its graph once and all queries after it, batch by batch.
    """
    asked = _clean(queries, id_col, vector_col).distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    stream = index.select("shard", F.lit(0).alias("kind"), *index.columns[1:]).unionByName(
        asked.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = raw = ids = shard = None
        for batch in batches:
            kinds, which = batch.column("kind").to_pylist(), batch.column("shard").to_pylist()
            begun = 0
            while begun < batch.num_rows:
                if kinds[begun] == 0:
                    row = batch.slice(begun, 1).to_pylist()[0]
                    shard, layers, pos = row["shard"], [], 0
                    flat = np.frombuffer(row["links"], np.int32).astype(np.int64)
                    for n, width in json.loads(row["shapes"]):
                        layers.append(flat[pos : pos + n * width].reshape(n, width))
                        pos += n * width
                    raw = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["d"])
                    graph = Graph(np.frombuffer(row["scaled"], np.float32).reshape(-1, row["d"] + 1), layers)
                    ids = row["ids"]
                    begun += 1
                    continue
                end = begun
                while end < batch.num_rows and kinds[end] and which[end] == which[begun] and end - begun < STEP:
                    end += 1
                part = batch.slice(begun, end - begun)
                if shard == which[begun]:
                    vectors, names = part.column("v").to_pylist(), part.column("vec_id").to_pylist()
                    fit = [i for i, v in enumerate(vectors) if len(v) == raw.shape[1]]
                    if fit:
                        yield from found(graph, raw, ids, [names[i] for i in fit], np.array([vectors[i] for i in fit]))
                begun = end

    def found(graph: Graph, raw: np.ndarray, ids: list[list[int]], names: list[int], q: np.ndarray) -> Iterator[pa.RecordBatch]:
        scale = np.maximum(np.abs(q).max(axis=1, keepdims=True), 1e-300)
        near = graph.nearest(np.hstack([q / scale, np.zeros((len(q), 1))]).astype(np.float32), max(ef, k + 1, len(graph.x) // WIDEN))
        out = []
        for name, vector, nodes in zip(names, q, near):
            nodes = nodes[nodes >= 0]
            scores = (raw[nodes] * vector).sum(axis=1)
            best = [(-float(s), i) for s, node in zip(scores, nodes) for i in ids[node] if i != name]
            out += [(name, i, -s) for s, i in sorted(best)[:k]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())],
            ["query_id", "vec_id", "score"],
        )

    dealt = stream.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "vec_id")
    hits = dealt.mapInArrow(answer, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows (largest inner product) of every query, as ``query_id, rank, vec_id, score``.

    Rows without id, and vectors that are null, empty, zero or hold null or non-finite components, take no part, as
    rows or as queries.  Repeated rows count once.  A query is compared with vectors of its own dimension.  If there are
    fewer than ``k``, all found are given; without rows or queries the result is empty.
    """
    index, shards = build_index(rows, k, id_col, vector_col)
    return search_index(index, shards, queries, k, id_col, vector_col)
