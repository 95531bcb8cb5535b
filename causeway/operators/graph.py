"""Connected components: of one graph by random-order contraction in rounds, of many small ones mostly in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.session import checkpointed, written

#: Edges that a task of :func:`components_within` holds at once, and of which one task makes an end in :func:`contract_components`.
CHUNK = 200_000
#: Types of nodes that Arrow sorts as Spark does.
FLAT = ("bigint", "int", "string", "binary")


def contract_components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = CHUNK) -> DataFrame:
    """(node, component) for every end of an edge; ``component`` is the least node of the component.

    Each round every vertex picks, among itself and its neighbours, the one that comes
    first in a hashed order, and the edges move to the picked vertices. In hashed order
    the vertex count falls by a constant factor a round whatever the shape of the
    graph, so chains and stars alike end after a few rounds. A round is a partial
    aggregate and two equi-joins against one row a vertex, which AQE can split where a
    hub is hot. Once at most ``few`` edges (counted both ways) are left, one task contracts
    them to the end, unless nodes are structs: rounds of next to nothing would only lengthen the plan. Loops and
    null ends are ignored. Nodes may be of any orderable type.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    alive = checkpointed(both)
    kind = alive.schema["u"].dataType.simpleString()
    parents = []
    while left := alive.count():
        if left <= few and kind in FLAT:  # names the least node of all, where no round went before
            once = alive.where("u < v").select(F.lit("").alias("grp"), "u", "v").coalesce(1)
            ended = once.mapInArrow(_in_chunks(few + 1), f"grp string, node {kind}, component {kind}, open boolean")
            parents.append(written(ended.select(F.col("node").alias("u"), F.col("component").alias("p"))))
            break
        first = F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("v"))).alias("best")
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        parent = checkpointed(alive.groupBy("u").agg(first).select("u", F.least("best", own)["v"].alias("p")))
        parents.append(parent)
        moved = (
            alive.join(parent, "u").select(F.col("p").alias("a"), F.col("v").alias("u"))
            .join(parent, "u").select(F.col("a").alias("u"), F.col("p").alias("v"))
        )
        alive = checkpointed(moved.where("u <> v").distinct())
    if not parents:
        return both.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = parents[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    if len(parents) == 1 and left:  # no round left anything to put together
        return found.withColumnRenamed("root", "component")
    for parent in parents[1:]:
        step = parent.select(F.col("u").alias("root"), "p")
        found = found.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")


def _stars(rows: pa.Table) -> pa.RecordBatch:
    """The edges of a chunk, sorted by group, as one row a node: its least neighbour in any number of steps within the chunk.

    ``open`` are the first and the last group, which may have edges in other chunks.
    """
    group = rows.column("grp").combine_chunks()
    ends = pa.chunked_array([*rows.column("u").chunks, *rows.column("v").chunks]).combine_chunks().dictionary_encode()
    groups = group.dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    names, n, rank = ends.dictionary.take(order), len(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(n)
    at = np.asarray(groups.indices, np.int64)
    keys, found = np.unique(np.tile(at, 2) * n + rank[np.asarray(ends.indices)], return_inverse=True)  # in order of group and node
    u, v = found.reshape(2, -1)
    label = np.arange(len(keys))
    while True:  # a part that is not the least of its neighbours joins a lesser one, so their number halves
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
    of = keys // n
    edge = (of == at[0]) | (of == at[-1])
    columns = [groups.dictionary.take(pa.array(of)), names.take(pa.array(keys % n)), names.take(pa.array(keys[label] % n)), pa.array(edge)]
    return pa.RecordBatch.from_arrays(columns, ["grp", "node", "component", "open"])


def _in_chunks(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                yield _stars(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield _stars(pa.Table.from_batches(held))

    return run


def components_within(edges: DataFrame, group: str, src: str = "src", dst: str = "dst", chunk: int = CHUNK, at_rest: bool = False) -> DataFrame:
    """(group, node, component) for every end of an edge between different nodes, all three strings; groups are graphs of their own.

    Edges are dealt by ranges of (group, source), so a large group falls to several tasks, and each
    task contracts them in chunks of bounded size. Groups that lie whole within a chunk are done then; of
    the first and last one of a chunk the edges that are left, one a node and chunk, go through
    :func:`contract_components`. The edges are written first, as they are sampled and then
    dealt, unless they are ``at_rest`` already.
    """
    rows = edges.select(F.col(group).alias("grp"), F.col(src).alias("u"), F.col(dst).alias("v")).where("grp is not null and u <> v")
    dealt = (rows if at_rest else written(rows)).repartitionByRange("grp", "u").sortWithinPartitions("grp")
    stars = written(dealt.mapInArrow(_in_chunks(chunk), "grp string, node string, component string, open boolean"))
    left = stars.where("open").select(F.struct("grp", "node").alias("src"), F.struct("grp", F.col("component").alias("node")).alias("dst"))
    rest = contract_components(left).select(F.col("node.grp").alias("grp"), F.col("node.node").alias("node"), F.col("component.node").alias("component"))
    return stars.where("not open").drop("open").unionByName(rest).withColumnRenamed("grp", group)
