"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

A source's documents fall into blocks by the first bits of a hash of their id. A source whose target is t times its
size gives floor(t) copies of all its blocks, and once more as many blocks as the rest of its target asks for. These
exact quotas of blocks are partitioned among the output shards by a tree of multivariate-hypergeometric draws. Shard
after shard then draws its blocks from what the shards before it have left of each source, in an order permuted for
that shard; what is drawn is what is taken. As blocks aren't equally large, the last blocks in the order of drawing are
left out, or further ones added, and one is cut, where the source's target is reached. Each shard is shuffled locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import cut, fresh, md5_long, word_count, words

WEIGHTS = (3, 1, 2)
#: Bits of the hash, of which there are 60, that number the blocks, and then those of each further step of the search
#: for a threshold: a step's sums are at most 2**bits for each source.
BITS, BLOCK_BITS, STEP_BITS = 60, 8, (12, 12)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """A row per source with its target. ``sources`` has source and source_size, one row each.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A target stops at
    ``most`` times its source's size; what is above is shared again by weight. Sources by the weight at which they
    stop: one stops if the common level of those not before it reaches that.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    by_rank = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("weight", by_rank.cast("double")).withColumn("stop", F.col("source_size") * F.lit(most))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("stop") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (F.sum("source_size").over(every) * F.lit(share) - sofar("stop")) / (F.sum("weight").over(every) - sofar("weight"))
    levelled = ranked.withColumn("level", level).withColumn("stops", F.col("level") >= F.col("stop") / F.col("weight"))
    common = F.min(F.when(~F.col("stops"), F.struct(F.col("stop") / F.col("weight"), "rank", "level"))).over(every)["level"]
    target = F.when(F.col("stops"), F.col("stop").cast("double")).otherwise(F.col("weight") * common)
    return levelled.select("source", "source_size", "rank", target.alias("target"))


def shares(targets: DataFrame) -> DataFrame:
    """``targets`` with full, how often each source is taken as a whole, rest, the words that it is taken for besides,
    and once, the blocks that these are expected to fill."""
    goal = F.least(F.round("target").cast("long"), F.col("source_size") * 2)
    found = targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    found = found.withColumn("rest", goal - F.col("full") * F.col("source_size"))
    return found.withColumn("once", F.when(F.col("rest") > 0, F.ceil(F.col("rest") * (1 << BLOCK_BITS) / F.col("source_size"))).otherwise(0).cast("long"))


def thresholds(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (source and rest among others) with the key up to which the source's documents are taken once more.

    ``keyed`` has source, size and key. Documents whose key is below ``at`` are taken once more as a whole; of the
    at_words words of those at it, at_rest. Found by descent: the sums of words by the key's first bits tell the range
    that the threshold is in, then the sums by its next bits, and at last those of single keys. Each step's sums are made
    by Spark, and their number is bounded for each source.
    """
    state = cut(found.select("source", "rest").withColumn("prefix", F.lit(0).cast("long")).withColumn("at_words", F.lit(None).cast("long")))
    left, steps = BITS, [BLOCK_BITS, *STEP_BITS]
    for bits in [*steps, BITS - sum(steps)]:
        left -= bits
        above = state.select(F.col("source").alias("of"), "prefix", "rest").where("rest > 0")
        here = keyed.join(above, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("key", left + bits) == F.col("prefix")))
        sums = here.groupBy("source", "rest", F.shiftright("key", left).alias("cell")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        one = cells.where("before < rest AND rest <= before + words")
        one = one.select(F.col("source").alias("of"), "cell", (F.col("rest") - F.col("before")).alias("inside"), "words")
        joined = state.join(one, F.col("source").eqNullSafe(F.col("of")), "left")
        state = cut(joined.select("source", F.coalesce("inside", F.lit(0)).alias("rest"), F.coalesce("cell", F.lit(0)).alias("prefix"), F.col("words").alias("at_words")))
    ends = state.select(F.col("source").alias("of"), F.col("rest").alias("at_rest"), F.col("prefix").alias("at"), "at_words")
    return found.join(ends, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _hypergeometric(total: str, marked: str, draws: str, uniform: str) -> str:
    """SQL: how many of ``draws`` out of ``total``, of which some are marked, are marked: by inversion at ``uniform``.

    Outcomes more than 12 standard deviations from the mean (less than one in 10**30) are left out; the others' weights
    follow from one another, and are summed once and then up to the share that ``uniform`` asks for.
    """
    spread = "12 + 12 * sqrt(greatest(0D, x.mean * (1 - x.k / greatest(x.n, 1)) * (x.n - x.d) / greatest(x.n - 1, 1)))"
    low = f"greatest(0L, x.d + x.k - x.n, CAST(floor(x.mean - ({spread})) AS BIGINT))"
    high = f"least(x.k, x.d, CAST(ceil(x.mean + {spread}) AS BIGINT))"
    ratio = "((x.k - j) * (x.d - j)) / ((j + 1) * (x.n - x.k - x.d + j + 1))"
    summed = f"aggregate(sequence(b.low, b.high), struct(1D AS p, 0D AS cum), (a, j) -> struct(a.p * {ratio} AS p, a.cum + a.p AS cum), a -> a.cum)"
    found = f"aggregate(sequence(b.low, b.high), struct(1D AS p, 0D AS cum, b.low AS k), (a, j) -> struct(a.p * {ratio} AS p, a.cum + a.p AS cum, IF(a.cum < s * x.u, j, a.k) AS k), a -> a.k)"
    bind = lambda value, name, then: f"element_at(transform(array({value}), {name} -> {then}), 1)"
    given = f"struct({total} AS n, {marked} AS k, {draws} AS d, {draws} * ({marked} / greatest({total}, 1)) AS mean, {uniform} AS u)"
    return bind(given, "x", bind(f"struct({low} AS low, {high} AS high)", "b", bind(summed, "s", found)))


def split_quotas(quotas: DataFrame, shards: int, seed: str = "mix") -> DataFrame:
    """(shard, rank, blocks): each source's blocks partitioned among ``shards`` shards of equal numbers of blocks.

    ``quotas`` has rank (from 1, gapless) and blocks. A node of the tree is a row with the blocks that its shards
    share, by source; it draws those of its left half source by source, each from a hypergeometric distribution given
    those before. Rows of the tree hold a number for each source, and there are as many as shards.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "blocks"))), lambda x: x["blocks"])
    nodes = quotas.agg(F.lit(0).alias("low"), F.lit(shards).alias("high"), listed.alias("quotas"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    while shards > 1:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        nodes = nodes.withColumn("middle", middle).withColumn("total", total("quotas"))
        part = F.col("middle") - F.col("low")
        nodes = nodes.withColumn("draws", F.floor(F.col("total") * part / F.greatest(F.col("high") - F.col("low"), F.lit(1))).cast("long"))
        nodes = nodes.withColumn("seed", md5_long(F.lit(seed), "low", "high"))
        uniform = "(conv(substring(md5(CAST(concat_ws('/', seed, q.i) AS BINARY)), 1, 13), 16, 10) + 0.5D) / 4503599627370496D"
        draw = _hypergeometric("a.total", "q.q", "a.draws", uniform)
        left = f"""
            aggregate(transform(quotas, (q, i) -> struct(i, q)), struct(total, draws, CAST(array() AS array<bigint>) AS out),
                (a, q) -> element_at(transform(array({draw}), k -> struct(a.total - q.q AS total, a.draws - k AS draws, concat(a.out, array(k)) AS out)), 1),
                a -> a.out)"""
        nodes = nodes.withColumn("left", F.expr(left))
        right = F.zip_with("quotas", "left", lambda q, k: q - k)
        halves = F.array(
            F.struct("low", F.col("middle").alias("high"), F.col("left").alias("quotas")),
            F.struct(F.col("middle").alias("low"), "high", right.alias("quotas")),
        )
        leaf = F.array(F.struct("low", "high", "quotas"))
        nodes = nodes.select(F.explode(F.when(F.col("high") - F.col("low") > 1, halves).otherwise(leaf)).alias("n")).select("n.low", "n.high", "n.quotas")
        shards = (shards + 1) // 2
    leaves = nodes.select(F.col("low").alias("shard"), F.posexplode("quotas").alias("i", "blocks"))
    return leaves.select("shard", (F.col("i") + 1).alias("rank"), "blocks")


def _drawn(shards: int) -> str:
    """SQL: a source's blocks as (place, shard, b), in the order of drawing, from its ``quotas`` by shard.

    Each shard draws its quota of those left, by a hash of source, shard and block; draws of all shards alternate in
    the order, so that the end of it takes from each alike. Blocks that no shard has drawn come last.
    """
    hashed = lambda kind, *parts: f"CAST(conv(substring(md5(CAST(concat_ws('/', '{kind}', coalesce(CAST(source AS STRING), 'null'), {', '.join(parts)}) AS BINARY)), 1, 15), 16, 10) AS BIGINT)"
    kind = "array<struct<place: double, shard: int, b: int>>"
    picks = f"slice(array_sort(transform(a.left, b -> struct({hashed('draw', 'i', 'b')} AS k, b))), 1, CAST(quotas[i] AS INT))"
    step = f"element_at(transform(array({picks}), p -> struct(array_except(a.left, transform(p, x -> x.b)) AS left, concat(a.out, transform(p, (x, j) -> struct((j + 0.5D) / quotas[i] AS place, i AS shard, x.b AS b))) AS out)), 1)"
    spare = f"transform(array_sort(transform(a.left, b -> struct({hashed('spare', 'b')} AS k, b))), (x, j) -> struct(2D + j AS place, CAST(j % {shards} AS INT) AS shard, x.b AS b))"
    return f"aggregate(sequence(0, {shards - 1}), struct(sequence(0, {(1 << BLOCK_BITS) - 1}) AS left, CAST(array() AS {kind}) AS out), (a, i) -> {step}, a -> concat(array_sort(a.out), {spare}))"


def draw(found: DataFrame, shards: int) -> DataFrame:
    """``found`` (as of :func:`shares`) with what the tree and the draws decide: full_shards, the shard of each block of
    each full turn, and for the blocks taken once more their positions in the order of drawing and once_shards, by block.

    All that is made here has a bounded number of rows or values per source.
    """
    per_turn = 1 << BLOCK_BITS
    both = found.select(F.explode(F.array(F.struct((2 * F.col("rank") - 1).alias("rank"), (F.col("full") * per_turn).alias("blocks")), F.struct((2 * F.col("rank")).alias("rank"), F.col("once").alias("blocks")))).alias("q")).select("q.*")
    dealt = split_quotas(both.select(F.col("rank").cast("int").alias("rank"), F.col("blocks").cast("long").alias("blocks")), shards)
    by_shard = F.transform(F.array_sort(F.collect_list(F.struct("shard", "blocks"))), lambda x: x["blocks"])
    listed = dealt.groupBy("rank").agg(by_shard.alias("quotas"))
    once = listed.where("rank % 2 = 0").select((F.col("rank") / 2).cast("int").alias("of"), "quotas")
    full = listed.where("rank % 2 = 1").select(((F.col("rank") + 1) / 2).cast("int").alias("of_full"), F.col("quotas").alias("full_quotas"))
    known = found.join(once, F.col("rank") == F.col("of")).join(full, F.col("rank") == F.col("of_full")).drop("of", "of_full")
    known = known.withColumn("order", F.expr(_drawn(shards)))
    blocks = F.sequence(F.lit(0), F.lit(per_turn - 1))
    known = known.withColumn("drawn", F.transform("order", lambda x: x["b"]))
    known = known.withColumn("positions", F.transform(blocks, lambda b: (F.array_position("drawn", b) - 1).cast("long")))
    known = known.withColumn("once_shards", F.transform(blocks, lambda b: F.get("order", F.get("positions", b).cast("int"))["shard"]))
    # of a source's permuted blocks, a shard draws as many as its quota, after those of the shards before it
    ends = F.transform("full_quotas", lambda q, i: F.aggregate(F.slice("full_quotas", F.lit(1), i + 1), F.lit(0).cast("long"), lambda x, y: x + y))
    number = F.sequence(F.lit(0).cast("long"), F.col("full") * per_turn - 1)
    permuted = F.array_sort(F.transform(number, lambda b: F.struct(md5_long(F.lit("deal"), F.col("source"), b).alias("order"), b.alias("b"))))
    known = known.withColumn("ends", ends)
    of_turns = F.transform(permuted, lambda x, i: F.struct(x["b"].alias("b"), F.size(F.filter("ends", lambda e: e <= i)).alias("shard")))
    known = known.withColumn("full_shards", F.when(F.col("full") > 0, F.transform(F.array_sort(of_turns), lambda x: x["shard"])))
    return known.drop("order", "drawn", "ends", "full_quotas")


def _key(hash_: Column, positions: Column) -> Column:
    """A document's place in the order in which its source is taken once more: that of its block, then its hash."""
    inside = BITS - BLOCK_BITS
    return F.shiftleft(F.get(positions, F.shiftright(hash_, inside).cast("int")), inside) + hash_.bitwiseAND(F.lit((1 << inside) - 1))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, shards: int = 16) -> DataFrame:
    """A row per source: its target, what :func:`draw` adds, and its threshold. ``sized`` has source, size and hash."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = cut(draw(shares(source_targets(sums, weights, share, most)), shards))
    some = found.where("rest > 0").select(F.col("source").alias("of"), "positions")
    keyed = sized.join(some, F.col("source").eqNullSafe(F.col("of"))).select("source", "size", _key(F.col("hash"), F.col("positions")).alias("key"))
    return thresholds(cut(keyed), found)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, shards: int = 16, only_ids: bool = False, whole: bool = False) -> DataFrame:
    """``docs`` with size, source_size, target, taken (words) and copies: an array of (turn, words, shard, order).

    Null texts have no words and null sources are one source. Rows of equal ids lie together in the permutation; those
    at the threshold share its rest, or with ``whole`` are taken whole or not at all, whichever is nearer to it. No row
    is taken for more than ``most`` times its words. The plan's sums are made from a written table of ids, sources and
    sizes; then each row needs only its source's row of the plan. Columns of the names added are replaced, others kept,
    whatever their names; ``only_ids`` keeps the id and source alone and reads the texts once. Very long texts count as
    any others. Reruns give the same. An empty table gives none.
    """
    added = ["size", "source_size", "target", "taken", "copies"]
    names = [doc_id, source] if only_ids else [c for c in docs.columns if c not in added]
    size, hash_, plan_, once_ = (fresh([*names, *added], n) for n in ("words", "hash", "plan", "once"))
    kept = [F.col(f"`{c}`") for c in names]
    hashed = docs.select(*kept, word_count(F.col(f"`{text}`")).alias(size), md5_long(F.col(f"`{doc_id}`"), F.lit("mix")).alias(hash_))
    sized = cut(hashed.select(F.col(f"`{doc_id}`"), F.col(f"`{source}`"), size, hash_))
    by_source = plan(sized.select(F.col(f"`{source}`").alias("source"), F.col(size).alias("size"), F.col(hash_).alias("hash")), weights, share, most, shards)
    by_source = by_source.select(F.struct("*").alias(plan_))
    hashed = sized if only_ids else hashed
    joined = hashed.join(by_source, F.col(f"`{source}`").eqNullSafe(F.col(plan_)["source"]))
    p, block = F.col(plan_), F.shiftright(hash_, BITS - BLOCK_BITS)
    key = _key(F.col(hash_), p["positions"])
    at = F.when(p["at_rest"] * 2 >= p["at_words"], F.col(size)).otherwise(0) if whole else F.floor(p["at_rest"] * F.col(size) / p["at_words"])
    once = F.when(p["at_rest"] <= 0, 0).when(key < p["at"], F.col(size)).when(key == p["at"], at).otherwise(0).cast("long")
    words = lambda turn: F.when(turn < p["full"], F.col(size)).otherwise(F.col(once_))
    shard = lambda turn: F.when(turn < p["full"], F.get(p["full_shards"], (turn * (1 << BLOCK_BITS) + block).cast("int"))).otherwise(F.get(p["once_shards"], block.cast("int")))
    order = lambda turn: md5_long(F.col(f"`{doc_id}`"), turn, F.lit("local"))
    turns = F.transform(F.sequence(F.lit(0).cast("long"), p["full"]), lambda t: F.struct(t.alias("turn"), words(t).alias("words"), shard(t).alias("shard"), order(t).alias("order")))
    # a copy is taken if a shard has drawn its block
    out = joined.withColumn(once_, once).withColumn("copies", F.filter(turns, lambda c: (c["words"] > 0) & c["shard"].isNotNull()))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda sofar, c: sofar + c["words"])
    return out.select(*kept, F.col(size).alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), taken.alias("taken"), "copies")


def expand(mixed: DataFrame, text: str = "text", blocks: int = 16) -> DataFrame:
    """The mixed corpus: a row per copy, with its shard, shuffled. A shard's copies lie in ``blocks`` partitions by the
    first digits of the order that they are drawn in, so that one after another these are the shard in that order.

    A copy of fewer words than its document has that many of its first words, joined by single blanks. Column shard is
    replaced, other columns are kept, whatever their names.
    """
    kept = [c for c in mixed.columns if c not in ("copies", "shard", text)]
    one, order, block = (fresh([*mixed.columns, "shard"], n) for n in ("copy", "order", "block"))
    copy = F.col(one)
    part = F.array_join(F.slice(words(F.col(f"`{text}`")), F.lit(1), copy["words"].cast("int")), " ")
    copies = mixed.select(*[F.col(f"`{c}`") for c in [*kept, text]], F.explode("copies").alias(one))
    cut_text = F.when(copy["words"] < F.col("size"), part).otherwise(F.col(f"`{text}`")).alias(text)
    rows = copies.select(*[F.col(f"`{c}`") for c in kept], cut_text, copy["shard"].alias("shard"), copy["order"].alias(order))
    rows = rows.withColumn(block, F.floor(F.col(order) / float(1 << 60) * blocks).cast("int"))
    return rows.repartition("shard", block).sortWithinPartitions("shard", order).drop(order, block)


__all__ = ["draw", "expand", "mix", "plan", "shares", "source_targets", "split_quotas", "thresholds"]
