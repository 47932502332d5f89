"""Connected components of a table of links, by rounds of stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docforge.llm.common import barrier, remove


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or not larger) neighbours are tied to the least of its neighbourhood.

    The least is an aggregate and comes back by a join, so no neighbourhood is gathered.
    """
    near = _both_ways(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    tied = near.join(least, "a")
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return tied.select(F.col("b").alias("a"), F.col("least").alias("b")).union(own)


#: Links that one task joins by itself.
CHUNK = 200_000


def _contract(links: DataFrame, count: int) -> DataFrame:
    """Within chunks of links, each node tied to the least node that it reaches there."""

    def join(batches):
        root: dict[int, int] = {}

        def find(node):
            top = node
            while (above := root.setdefault(top, top)) != top:
                top = above
            while root[node] != top:
                root[node], node = top, root[node]
            return top

        def out():
            nodes = [node for node in root if find(node) != node]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root[node] for node in nodes], pa.int64())], ["a", "b"])

        held = 0
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                one, two = find(a), find(b)
                if one != two:
                    root[max(one, two)] = min(one, two)
            held += batch.num_rows
            if held >= CHUNK:
                yield out()
                root.clear()
                held = 0
        yield out()

    return links.coalesce(-(-max(count, 1) // CHUNK)).mapInArrow(join, "a long, b long")


def _written(links: DataFrame, name: str) -> tuple[DataFrame, str, int, object]:
    """The links, written; their number, and a sum that tells one set of them from another."""
    seen = Observation()
    marked = links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    out, path = barrier(marked, name)
    return out, path, seen.get["n"], seen.get["sum"]


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``a, b`` links: the label is the least node of its component.

    Chunks of links are contracted in their tasks, then large and small stars tie the chunks together, until
    nothing changes; where there is but one chunk, nothing is left to tie. Each round is written to the shared folder. Links of a node with
    itself are dropped; no links give no rows.
    """
    spark = links.sparkSession
    current, path, count, _ = _written(links.where("a <> b").select("a", "b"), "links")
    previous = None
    while True:
        after, after_path, after_count, state = _written(_contract(current, count), "chunks")
        remove(spark, path)
        current, path = after, after_path
        if count <= CHUNK or previous == (after_count, state):
            break
        previous = after_count, state
        current, path, count, _ = _written(_star(_star(current, True), False).where("a <> b").distinct(), "stars")
        remove(spark, after_path)
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(current.select("b", "b").distinct())


def labelled(rows: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """Each row with its node's label; a node without links is its own."""
    named = labels.select(F.col("node").alias(node), F.col("label").alias(label))
    return rows.join(named, node, "left").withColumn(label, F.coalesce(label, node))


def join_more(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more ``a, b`` links between nodes."""
    between = labelled(labelled(links, labels, "a", "x"), labels, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    above, _ = barrier(components(between), "above")
    known = labels.select("node", "label").join(above.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    moved = known.select("node", F.coalesce("top", "label").alias("label"))
    fresh = above.join(labels.select("node"), "node", "left_anti")
    return barrier(moved.union(fresh.select("node", "label")), "labels")[0]
