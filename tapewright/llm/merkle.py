"""Merkle manifest of a dataset: a tree of hashes for each part, one tree over their roots, and a proof for each row.

Rows are put in order by a range partitioning and numbered from the counts of the partitions. A run of consecutive nodes
is hashed into its parent, level by level. Proofs come from pointer jumping: each node holds the siblings on its way to
an ancestor; a self-join with the ancestors' own segments doubles that way, until all reach the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import Scratch, fresh

#: The tree over the roots of the parts; parts are '' (null) or '=' and their name.
TOP = "top"
#: A node's segments are joined with at most so many copies of those of an ancestor.
MOST_COPIES = 64


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values one after another; each is '-' if null, else its UTF-8 bytes, ':', itself."""
    told = []
    for value in values:
        text = value.cast("string")
        told.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*told).cast("binary"), 256)


def _hex(binary: str) -> str:
    return f"lower(hex({binary}))"


def folded(leaf: str, segment: str) -> Column:
    """The hash that column ``leaf`` (hex) leads to by the steps of ``segment``."""
    before, after = "substring(s.others, 1, 32 * s.at)", "substring(s.others, 32 * s.at + 1, octet_length(s.others))"
    return F.expr(f"aggregate({segment}, {leaf}, (h, s) -> sha2(CAST(concat({_hex(before)}, h, {_hex(after)}) AS BINARY), 256))")


def _numbered(scratch: Scratch, rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (of tree) with place from 0 and n, the number of rows, in each tree, ordered by ``order``.

    No task sees more than a range of rows; ties get any order, but keep it, as the result is a written table.
    """
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    ranged = scratch.write("ranged", ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = ranged.groupBy("tree", part).agg(F.count("*").alias("rows"), F.min("at").alias("least"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part")) - F.col("rows")
    offsets = counts.select("tree", "part", (before - F.col("least")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    placed = ranged.withColumn("part", part).join(scratch.write("offsets", offsets), ["tree", "part"])
    return placed.withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _grown(scratch: Scratch, name: str, nodes: DataFrame, fan_out: int) -> tuple[DataFrame, DataFrame]:
    """(steps, roots) of the trees over ``nodes`` (tree, place, n, hash, id, height, row).

    A step is a node with the id of its parent and the hashes of the other children; roots are what remains of each tree.
    """
    top, steps, roots, level = name == TOP, [], [], 0
    while True:
        level += 1
        nodes = scratch.write(f"{name}-nodes-{level}", nodes)
        roots.append(nodes.where("n = 1"))
        if nodes.where("n > 1").isEmpty():
            break
        kids = F.array_sort(F.collect_list(F.struct("place", "hash", "id", "height", "row")))
        runs = nodes.where("n > 1").groupBy("tree", "n", F.expr(f"place DIV {fan_out}").alias("up")).agg(kids.alias("kids"))
        runs = runs.withColumn("parent", F.concat_ws("/", "tree", F.lit(level), "up"))
        runs = scratch.write(f"{name}-runs-{level}", runs.withColumn("hashes", F.expr("transform(kids, k -> k.hash)")))
        others = f"aggregate(filter(transform(hashes, (h, i) -> IF(i = at, X'', h)), h -> octet_length(h) > 0), X'', (x, h) -> concat(x, h)) AS others"
        steps.append(
            runs.select("parent", "hashes", F.posexplode("kids").alias("at", "kid"))
            .select("kid.id", "kid.height", "kid.row", "parent", F.struct(F.col("at").cast("byte").alias("at"), F.expr(others), F.lit(top).alias("top")).alias("step"))
        )
        joined = F.expr(f"unhex(sha2(CAST(aggregate(hashes, '', (x, h) -> concat(x, {_hex('h')})) AS BINARY), 256))")
        nodes = runs.select(
            "tree", F.col("up").alias("place"), F.expr(f"(n + {fan_out - 1}) DIV {fan_out}").alias("n"), joined.alias("hash"),
            F.col("parent").alias("id"), F.lit(1 << 30 if top else level).alias("height"), F.lit(None).cast(nodes.schema["row"].dataType).alias("row"),
        )
    return _union(steps), _union(roots)


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = frames[0] if frames else None
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@dataclass
class Manifest:
    """root: of the whole dataset, None for an empty one. proofs: a row for each row of the dataset, with its columns
    (as ``row``), leaf, n_steps and segment, its siblings on the way to the root (at: children before it; others: the
    digests of the other children; top: whether above the root of its part)."""

    root: str | None
    proofs: DataFrame


def build(rows: DataFrame, part: str, order: list[str], leaf: str, keep: list[str], fan_out: int = 8) -> Manifest:
    """Trees over the leaves (``leaf``: a hex digest) of each value of ``part``, and one over their roots.

    In a part rows are ordered by ``order`` (nulls first), then by leaf; parts by name, bytewise, the null one first.
    Columns ``keep`` (of types that can be ordered) stay with each row, whatever their names. Equal rows are leaves of
    their own; a part of one row is its own root; a dataset of one part has no steps above that part's root, and one of
    one row no steps at all. Groups longer than ``fan_out`` don't arise, so that no key is hot, whatever a part holds.
    """
    scratch = Scratch(rows.sparkSession)
    tree = F.when(F.col(f"`{part}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{part}`").cast("string")))
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    named = [F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(order)]
    leaves = scratch.write("leaves", rows.select(tree.alias("tree"), *named, F.unhex(F.col(f"`{leaf}`")).alias("hash"), row.alias("row")))
    by = [f"by{i}" for i in range(len(order))]
    placed = _numbered(scratch, leaves, [*by, "hash"]).drop(*by)
    known = F.concat_ws("/", "tree", F.lit(0), "place").alias("id")
    steps, roots = _grown(scratch, "part", placed.select("tree", "place", "n", "hash", known, F.lit(0).alias("height"), F.struct("hash", "row").alias("row")), fan_out)
    # the roots, in order of their parts, are the leaves of the tree above
    tops = _numbered(scratch, roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("by"), "hash", "id", "height", "row"), ["by"]).drop("by")
    above, last = _grown(scratch, TOP, tops.select("tree", "place", "n", "hash", "id", "height", "row"), fan_out)
    root = last.select("id", F.lower(F.hex("hash")).alias("hash")).first()
    empty = F.array().cast("array<struct<at: tinyint, others: binary, top: boolean>>")
    alone = last.select("id", "height", "row", F.lit(None).cast("string").alias("ancestor"), empty.alias("segment"))
    steps = _union([s for s in (steps, above) if s is not None])
    if steps is None:
        ways = alone  # at most one row in all
    else:
        # a root that is a leaf's height below is an inner node of the tree above: it stays whatever the distance
        reached = F.when(F.col("parent") != root["id"], F.col("parent")).alias("ancestor")
        ways = _jumped(scratch, steps.select("id", "height", "row", reached, F.array("step").alias("segment")), fan_out)
    proofs = ways.where("row IS NOT NULL")
    leaf_hex = F.lower(F.hex("row.hash")).alias("leaf")
    return Manifest(root["hash"] if root else None, proofs.select("row.row", leaf_hex, F.size("segment").alias("n_steps"), "segment"))


def _jumped(scratch: Scratch, ways: DataFrame, fan_out: int) -> DataFrame:
    """``ways`` (id, height, row, ancestor, segment) with segments up to the root: the distance doubles in each round.

    A node at distance d has at most fan_out ** d nodes below that ask for it, and there are as many fewer such nodes;
    these are copied, and each asking node picks a copy by its hash.
    """
    distance, ways = 1, scratch.write("ways-1", ways)
    while not (asking := ways.where("ancestor IS NOT NULL")).isEmpty():
        copies = min(fan_out ** (distance - 1), MOST_COPIES)
        found = ways.where(F.col("height") >= distance).select(
            F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("segment").alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
        )
        joined = asking.withColumn("copy", F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int")).join(found, ["ancestor", "copy"])
        joined = joined.select("id", "height", "row", F.col("next").alias("ancestor"), F.concat("segment", "rest").alias("segment"))
        reached = ways.where("ancestor IS NULL")
        distance *= 2
        ways = scratch.write(f"ways-{distance}", reached.unionByName(joined))
        scratch.free(f"ways-{distance // 2}")
    return ways


def manifest(rows: DataFrame, fields: list[str], part: str, order: list[str], offered: dict[str, Column] | None = None, keep: list[str] | None = None, fan_out: int = 8) -> DataFrame:
    """A row for each row of ``rows``: its leaf, the subroot of its part, the root, its proof, and what the proof shows.

    A leaf is the digest of ``fields``. ``offered`` gives other values for some fields, as a reader may have received
    them: folded_root is computed from the leaf of these and the original siblings, and verified says whether it equals
    the root. Columns ``keep`` (by default ``order``) come first, renamed where they clash. Nulls are values of their own
    in fields, ``part`` and ``order``; whole texts are hashed, whatever their length; an empty table gives no rows.
    """
    keep = order if keep is None else keep
    made = ["leaf", "subroot", "root", "proof", "folded_root", "verified"]
    values = [F.col(f"`{c}`") for c in fields]
    shown = [(offered or {}).get(c, F.col(f"`{c}`")) for c in fields]
    own, other, by = [fresh(rows.columns, name) for name in ("own_leaf", "offered_leaf", "own_part")]
    hashed = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *order])], F.col(f"`{part}`").alias(by), digest(*values).alias(own), F.unhex(digest(*shown)).alias(other))
    built = build(hashed, by, order, own, [*keep, other], fan_out)
    out = [F.col(f"row.`{c}`").alias(c + "_" * (c.lower() in made)) for c in keep]
    subroot = folded("leaf", "filter(segment, s -> NOT s.top)").alias("subroot")
    shown_root = folded(f"lower(hex(row.`{other}`))", "segment").alias("folded_root")
    proved = built.proofs.select(*out, "leaf", subroot, F.lit(built.root).cast("string").alias("root"), F.col("segment").alias("proof"), shown_root)
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: str = "proof") -> Column:
    """The digest of all siblings of a proof, as hex text, from the leaf up and from left to right."""
    return F.sha2(F.expr(f"array_join(transform({proof}, s -> {_hex('s.others')}), '')").cast("binary"), 256)
