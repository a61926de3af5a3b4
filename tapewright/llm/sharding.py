"""Sharding by a hierarchical weighted hash tree: region, rack and shard levels, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import cut, fresh, md5_long


@dataclass(frozen=True)
class Node:
    """A node of the tree: a leaf has a shard number, any other its children. A leaf's weight is its own."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def topology(shards: int, base: int = 16, per_rack: int = 4, racks_per_region: int = 2) -> Node:
    """The tree of ``shards`` equal shards: the first ``base`` in full regions, each further one in a region of its own.

    A shard in a region of its own changes no other subtree's weight, so one more shard takes rows only into itself.
    (In a region that it shares, rows drawn by the region's new weight would spread over the region.)
    """
    per_region = per_rack * racks_per_region
    regions = []
    for first in range(0, min(shards, base), per_region):
        last = min(first + per_region, shards, base)
        racks = [range(a, min(a + per_rack, last)) for a in range(first, last, per_rack)]
        regions.append(Node(f"region{first // per_region}", tuple(Node(f"rack{r[0] // per_rack}", tuple(Node(f"shard{s}", shard=s) for s in r)) for r in racks)))
    for s in range(base, shards):
        regions.append(Node(f"region+{s}", (Node(f"rack+{s}", (Node(f"shard{s}", shard=s),)),)))
    return Node("root", tuple(regions))


def _flat(tree: Node) -> tuple[list[Node], list[list[int]], int]:
    """The tree's nodes with the root first, the places of each one's children of some weight, and its depth.

    A leaf is its own only child, so that all paths are as long as the longest.
    """
    nodes, children, depth, level = [tree], [], 0, [tree]
    while level:
        below = [c for n in level for c in n.children if c.weight > 0]
        place = len(nodes)
        for n in level:
            own = [c for c in n.children if c.weight > 0]
            children.append(list(range(place, place + len(own))) or [len(children)])
            place += len(own)
        nodes += below
        level, depth = below, depth + bool(below)
    return nodes, children, depth


def assign_shards(docs: DataFrame, tree: Node, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row's key in column ``out``; rows of one key, also null, share a shard.

    At each level the chosen node's children draw for the key and the least draw wins. A draw is exponential in the
    child's weight and depends on the key, the child's name and its weight alone: each child wins in proportion to its
    weight, and if a subtree's weight changes, rows move only into or out of it. Draws tie in no practical case; then
    the first child wins. The tree's tables are literals: one row per node of the cluster's own layout.
    """
    nodes, children, depth = _flat(tree)
    names, weights = F.array(*[F.lit(n.name) for n in nodes]), F.array(*[F.lit(float(n.weight)) for n in nodes])
    below = F.array(*[F.array(*map(F.lit, c)) for c in children])

    def draw(child: Column) -> Column:
        uniform = (md5_long(F.col(f"`{key}`"), F.get(names, child)).cast("double") + 0.5) / float(1 << 60)
        return F.struct((-F.log(uniform) / F.get(weights, child)).alias("draw"), child.alias("child"))

    node = F.lit(0)
    for _ in range(depth):
        node = F.array_min(F.transform(F.get(below, node), draw))["child"]
    shards = F.array(*[F.lit(-1 if n.shard is None else n.shard) for n in nodes])
    return docs.withColumn(out, F.get(shards, node))


def number_slots(rows: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """``rows`` with a gapless number from 0 within their shard.

    The rows are first written with the number of the task that read them and their place in it, so that reruns see
    the same. Each (task, shard) then numbers its own rows, after those of the tasks before it; no group is larger
    than what one task has read, however rows are spread over shards and keys. An empty table stays empty.
    """
    kept = [c for c in rows.columns if c != out]
    task, place, n, own, of, start = (fresh([*kept, out], name) for name in ("task", "place", "n", "own_shard", "of_task", "start"))
    placed = cut(rows.withColumns({task: F.spark_partition_id(), place: F.monotonically_increasing_id()}))
    counts = placed.groupBy(F.col(f"`{shard}`").alias(own), F.col(task).alias(of)).agg(F.count("*").alias(n))
    before = Window.partitionBy(own).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(own, of, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(task, f"`{shard}`").orderBy(place)
    numbered = placed.withColumn(n, F.row_number().over(within) - 1)
    joined = numbered.join(starts, (F.col(task) == F.col(of)) & F.col(f"`{shard}`").eqNullSafe(F.col(own)))
    return joined.select(*[F.col(f"`{c}`") for c in kept], (F.col(n) + F.col(start)).cast("long").alias(out))
