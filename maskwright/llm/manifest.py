"""Merkle manifest of a dataset by time-forward processing.

Every group of rows has a tree over its leaves, the roots of the groups have one
more.  A tree is worked off in sweeps over blocks of ``3**DEPTH`` neighbouring
leaves: the shuffle sorts the nodes by label (group, block, place), a task reads
them in this order, and a priority queue ordered by node label delivers the
digests of children to the parent that is due, so that it holds a few nodes of
each level.  Tops of blocks are the leaves of the next sweep, until every group
has one node.  Then the sweeps are reversed: a queue ordered by falling labels
delivers to every node what stands beside the path from its parent to the root,
and the node's own siblings are put in front.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT = 3
#: Levels of a block: at most 3**7 = 2,187 nodes come together in one group of a task.
DEPTH = 7
#: A way to the root: level by level the digests left and right of the path, each of 64 digits.
PATH = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(parts: Sequence[str]) -> str:
    """Lowercase hexadecimal SHA-256 of some strings behind each other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(values: Sequence[Column]) -> Column:
    """``-`` for null, else the UTF-8 bytes of a value, a colon and the value; one after the other."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def block_top(leaves: Sequence[str], depth: int = DEPTH, whole: bool = False) -> tuple[str, list[list[str]], int]:
    """Top of a block: its digest, the children of every inner node in the order of their labels, and its level.

    The label of a node is the last leaf below it, then its level: a parent is due right behind its last child.  The
    queue delivers a node's digest to its parent; messages of one parent follow each other.  ``whole`` says that the
    block is a whole tree, which ends where one node is left; other blocks have ``depth`` levels.
    """
    queue: list[tuple[int, int, int, str]] = []  # last leaf, level, place among the children, digest
    inner: list[list[str]] = []
    n, height = len(leaves), depth
    if whole:
        height = 0
        while FANOUT**height < n:
            height += 1
    top = leaves[0]

    def send(level: int, place: int, child: str) -> None:
        last = min((place // FANOUT + 1) * FANOUT ** (level + 1), n) - 1
        heapq.heappush(queue, (last, level + 1, place, child))

    for at, leaf in enumerate(leaves):
        if height:
            send(0, at, leaf)
        while queue and queue[0][0] == at:
            _, level, place, child = heapq.heappop(queue)
            children = [child]
            while queue and queue[0][0] == at and queue[0][1] == level:
                children.append(heapq.heappop(queue)[3])
            inner.append(children)
            top = digest(children)
            if level < height:
                send(level, place // FANOUT, top)
    return top, inner, height


def block_paths(leaves: Sequence[str], above: list, depth: int = DEPTH, whole: bool = False) -> list[list]:
    """For every leaf the digests left and right of its way to the root, given those of the block's top.

    The inner nodes are read backwards, parents before children; a queue ordered by falling labels holds what is still
    to be delivered.
    """
    _, inner, height = block_top(leaves, depth, whole)
    if not height:
        return [above]
    n = len(leaves)
    paths: list[list] = [above] * n
    queue: list[tuple[int, int, list]] = [(1 - n, -height, above)]  # label of the node, falling; its way to the root
    at = len(inner)
    while queue:
        last, level, way = heapq.heappop(queue)
        last, level, at = -last, -level, at - 1
        children = inner[at]
        place = last // FANOUT**level * FANOUT
        for k in range(len(children)):
            mine = [("".join(children[:k]), "".join(children[k + 1 :])), *way]
            if level == 1:
                paths[place + k] = mine
            else:
                end = min((place + k + 1) * FANOUT ** (level - 1), n) - 1
                heapq.heappush(queue, (-end, 1 - level, mine))
    return paths


def fold(leaf: str, path: list) -> str:
    """The root that a leaf and its way to the root give."""
    for left, right in path:
        leaf = digest((left, leaf, right))
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one ``tree`` and ``block`` after the other, from batches sorted by both."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = list(zip(table.column("tree").to_pylist(), table.column("block").to_pylist()))
        begin = 0
        for i in range(1, len(keys)):
            if keys[i] != keys[i - 1]:
                yield table.slice(begin, i - begin)
                begin = i
        rest = table.slice(begin)
    if rest is not None:
        yield rest


def _grouped(nodes: DataFrame, fanned: int) -> DataFrame:
    """Nodes with their block, in the order of their labels, blocks spread over the tasks."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = nodes.withColumn("block", F.floor(F.col("place") / fanned).cast("long"))
    return blocked.repartition(n, "tree", "block").sortWithinPartitions("tree", "block", "place")


def _forward(nodes: DataFrame, depth: int) -> DataFrame:
    """``tree, place, size, hash``: the tops of all blocks of ``nodes`` (the same columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            size = rows.column("size")[0].as_py()
            fits = size <= FANOUT**depth
            top, _, _ = block_top(rows.column("hash").to_pylist(), depth, fits)
            yield pa.RecordBatch.from_pylist(
                [{"tree": rows.column("tree")[0].as_py(), "place": rows.column("block")[0].as_py(), "size": 1 if fits else -(-size // FANOUT**depth), "hash": top}],
                pa.schema([("tree", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("hash", pa.string())]),
            )

    return _grouped(nodes.select("tree", "place", "size", "hash"), FANOUT**depth).mapInArrow(run, "tree string, place long, size long, hash string")


def _backward(nodes: DataFrame, above: DataFrame, depth: int, carried: Sequence[str] = ()) -> DataFrame:
    """``tree, place, path, root`` and the carried columns of ``nodes``.

    ``above`` (``tree, place, path, root``) is what the tops of their blocks know; it is delivered to a block as the row in
    front of its nodes, by the same shuffle.
    """
    names = ["tree", "place", *carried]
    held = [n for n in dict.fromkeys([*names, "size", "hash"]) if n not in ("tree", "place")]
    types = {f.name: f.dataType for f in nodes.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            way, root = rows.column("path")[0].as_py(), rows.column("root")[0].as_py()
            rows = rows.slice(1)
            fits = rows.column("size")[0].as_py() <= FANOUT**depth
            paths = block_paths(rows.column("hash").to_pylist(), [(p["left"], p["right"]) for p in way], depth, fits)
            for begin in range(0, len(paths), 1024):
                named = [[{"left": a, "right": b} for a, b in p] for p in paths[begin : begin + 1024]]
                part = rows.slice(begin, 1024)
                columns = [part.column(c).combine_chunks() for c in names]
                columns += [pa.array(named, _PATH), pa.array([root] * len(named), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "path", "root"])

    block = F.floor(F.col("place") / FANOUT**depth).cast("long").alias("block")
    below = nodes.select("tree", block, "place", *held, F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("root"))
    tops = above.select(
        "tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), *[F.lit(None).cast(types[c]).alias(c) for c in held], "path", "root"
    )
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = below.unionByName(tops).repartition(n, "tree", "block").sortWithinPartitions("tree", "block", "place")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*names).schema)
    return sorted_.mapInArrow(run, f"{kinds}, path {PATH}, root string")


def tree_paths(leaves: DataFrame, depth: int = DEPTH, carried: Sequence[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Roots of all trees (``tree, root``), and a function that gives ``tree, place, path, root`` and the carried columns of
    all leaves from the ways of the roots (``tree, path, root``).

    ``leaves`` is a stored frame of ``tree, place, size, hash``: places 0, 1, ... of the ``size`` leaves of each tree.
    """
    rounds = [leaves]
    while rounds[-1].where("size > 1").limit(1).count():
        rounds.append(staged(_forward(rounds[-1], depth), "tops"))

    def ways(of_roots: DataFrame) -> DataFrame:
        known = of_roots.select("tree", F.lit(0).cast("long").alias("place"), "path", "root")
        if len(rounds) == 1:
            return leaves.join(known, ["tree", "place"]).select("tree", "place", *carried, "path", "root")
        for i in range(len(rounds) - 2, -1, -1):
            known = _backward(rounds[i], known, depth, carried if i == 0 else ())
            if i:
                known = staged(known, "ways")
        return known

    return rounds[-1].select("tree", F.col("hash").alias("root")), ways


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` and ``size``: the number of each row in its ``tree`` by some columns, and its rows.

    Rows are sorted once by ranges of the tree and these columns, so that a large tree takes many ranges; counts by range and
    tree give the offsets.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "tree", *order).withColumn("range", F.spark_partition_id())
    ranged = staged(ranged.sortWithinPartitions("tree", *order), "ranges")
    by_tree = Window.partitionBy("tree").orderBy("range")
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "tree", "range", (F.sum("n").over(by_tree) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("tree")).alias("size")
    )
    inside = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order))
    return ranged.withColumn("number", inside).join(offsets, ["tree", "range"]).withColumn("place", F.col("offset") + F.col("number") - 1).drop("number", "offset", "range")


def merkle_manifest(
    docs: DataFrame, values: Sequence[str], group_col: str, order_col: str, check: Column | None = None, depth: int = DEPTH
) -> DataFrame:
    """One row per row of ``docs``: ``id`` (its ``order_col``), ``leaf``, ``subroot``, ``root``, ``path``, ``folded_root``, ``verified``.

    ``leaf`` is the SHA-256 of the columns ``values``, each ``-`` if null, else its UTF-8 byte count, a colon and the value.
    The leaves of each value of ``group_col`` ascend by ``order_col``; while more than one node remains, every three
    neighbours become the digest of their digests (a last run of one or two too).  What remains is the group's
    ``subroot``; these, by group (null first), give ``root`` in the same way.  ``path`` lists, from the leaf up to the root,
    the digests left and right of it.  ``check`` is the row as it is found later, encoded like the leaf (the default is the
    row itself): ``folded_root`` follows from it and the path, and ``verified`` tells whether it is ``root``.

    Null values are leaves like any other; null ids come first and equal ids are ordered by their leaf, so that
    repeated rows have neighbouring places and equal digests.  A group may hold any share of the rows: it is sorted by
    ranges and worked off in blocks.  Texts of any length are hashed on the JVM and never leave the scan.  An empty table
    gives an empty result.  Of the columns of ``docs`` only those named are taken.
    """
    leaf = encoded([F.col(v) for v in values])
    tree = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    found = check if check is not None else leaf
    rows = docs.select(
        tree.alias("tree"), F.col(order_col).alias("id"), F.sha2(leaf.cast("binary"), 256).alias("hash"), F.sha2(found.cast("binary"), 256).alias("found")
    )
    leaves = staged(placed(rows, ["id", "hash"]), "leaves")
    subroots, leaf_ways = tree_paths(leaves, depth, ("id", "hash", "found"))
    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("hash"))
    tops = staged(placed(groups, ["group"]), "groups")
    roots, group_ways = tree_paths(tops, depth, ("group", "hash"))
    root = next((r.root for r in roots.collect()), None)  # one row
    start = docs.sparkSession.createDataFrame([("", [], root)], f"tree string, path {PATH}, root string")
    above = group_ways(start).select(F.col("group").alias("tree"), "path", F.col("hash").alias("root"))
    ways = leaf_ways(staged(above, "ways"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, paths = batch.column("found").to_pylist(), batch.column("path").to_pylist()
            folded = [fold(f, [(p["left"], p["right"]) for p in path]) for f, path in zip(found, paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.string())], [*batch.schema.names, "folded_root"])

    kind = docs.schema[order_col].dataType.simpleString()
    done = ways.select("id", F.col("hash").alias("leaf"), "found", F.col("root").alias("subroot"), "path").mapInArrow(
        run, f"id {kind}, leaf string, found string, subroot string, path {PATH}, folded_root string"
    )
    return done.select(
        "id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "path", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified")
    )


def proof_digest(path: Column) -> Column:
    """SHA-256 of the digests of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)
