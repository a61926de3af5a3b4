"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order, and posted with its place for each of them in that pivot's
inverted file. A query reads the files of its own nearest pivots, which add up the footrule distance of the two orders
for all that they hold, and compares the vectors of the best share by that distance themselves. Vectors lie together by
their nearest pivot, so that a query is sent only where pivots of its own better part are nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import md5_long, ship

QUERY_BATCH = 128


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: no null, zero or non-finite vectors, and ids that aren't null."""
    v = F.col(f"`{embedding}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0) & F.col(f"`{vec_id}`").isNotNull())
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


class PivotOrders:
    """Orders of pivots by nearness, for largest inner products.

    Vectors get one more component that makes them equally long, and queries a zero there, so that the vector of the
    largest product is the one at the smallest angle.
    """

    def __init__(self, pivots: np.ndarray, longest: float, depth: int):
        self.longest, self.depth = longest, min(depth, len(pivots))
        self.pivots = self.lift(pivots)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.longest
        return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))])

    def orders(self, lifted: np.ndarray) -> np.ndarray:
        return np.argsort(-(lifted @ self.pivots.T), axis=1, kind="stable").astype("i4")

    def of_vectors(self, vectors: np.ndarray) -> np.ndarray:
        return self.orders(self.lift(vectors))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        unit = queries / np.sqrt((queries**2).sum(1, keepdims=True))
        return self.orders(np.column_stack([unit, np.zeros(len(unit))]))

    def weights(self, orders: np.ndarray) -> np.ndarray:
        """depth - place of each pivot among the first ``depth``, else 0: the footrule distance of two orders is a
        constant less twice the sum of the smaller of their weights, the nearness that is used here."""
        out = np.zeros((len(orders), len(self.pivots)), dtype="i2")
        np.put_along_axis(out, orders[:, : self.depth], np.arange(self.depth, 0, -1, dtype="i2")[None, :], axis=1)
        return out


class Files:
    """The inverted files of some vectors: for each pivot, who has it among the first ``depth`` and with what weight."""

    def __init__(self, pivots: PivotOrders, vectors: np.ndarray):
        self.pivots, orders = pivots, pivots.of_vectors(vectors)
        self.first = orders[:, 0]
        posted = orders[:, : pivots.depth].reshape(-1)
        by_pivot = np.argsort(posted, kind="stable")
        self.who = by_pivot // pivots.depth
        self.weight = (pivots.depth - by_pivot % pivots.depth).astype("i2")
        self.starts = np.searchsorted(posted[by_pivot], np.arange(len(pivots.pivots) + 1))
        self.n = len(vectors)

    def nearness(self, weights: np.ndarray) -> np.ndarray:
        """By vector and query, of the queries' ``weights``: read from the files of the pivots that they have."""
        asked, out = np.ascontiguousarray(weights.T), np.zeros((self.n, len(weights)), dtype="i2")
        for pivot in np.flatnonzero(weights.any(axis=0)):
            own = slice(self.starts[pivot], self.starts[pivot + 1])
            out[self.who[own]] += np.minimum(self.weight[own, None], asked[pivot][None, :])
        return out


def _nearest(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, best first, ties to smaller ids."""
    order = np.lexsort((ids, -scores, rows))
    ranked = rows[order]
    starts = np.searchsorted(ranked, ranked)
    return order[np.arange(len(order)) - starts < k]


class Unit:
    """The index of one unit's vectors."""

    def __init__(self, pivots: PivotOrders, ids: np.ndarray, vectors: np.ndarray):
        self.pivots, self.ids, self.vectors, self.files = pivots, ids, vectors, Files(pivots, vectors)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, cells: int):
        """(query's place, id, score) of each query's nearest in this unit, and how many vectors were compared.

        Compared are those whose nearest pivot is among the query's first ``cells`` ones, and whose nearness is at least
        the query's ``least``.
        """
        orders = self.pivots.of_queries(queries)
        visited = np.zeros((len(self.pivots.pivots), len(queries)), dtype=bool)
        np.put_along_axis(visited, orders[:, :cells].T, True, axis=0)
        near = self.files.nearness(self.pivots.weights(orders))
        chosen = (near >= least[None, :]) & visited[self.files.first] & (self.ids[:, None] != query_ids[None, :])
        rows, places, compared = [], [], 0
        for i, query in enumerate(queries):
            own = np.flatnonzero(chosen[:, i])
            compared += len(own)
            if len(own) > k:
                scores = self.vectors[own] @ query
                kth = np.partition(scores, len(own) - k)[len(own) - k]
                # products of equal vectors may differ in their last bits; all near the k-th are multiplied again
                own = own[scores >= kth - 1e-9 * max(1, abs(kth))]
            rows.append(np.full(len(own), i))
            places.append(own)
        rows, places = np.concatenate(rows), np.concatenate(places)
        exact = (queries[rows] * self.vectors[places]).sum(axis=1)
        best = _nearest(rows, self.ids[places], exact, k)
        return rows[best], self.ids[places[best]], exact[best], compared


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = 256, depth: int = 64, cells: float = 0.75, share: float = 0.2, sample: int = 2048, group_rows: int = 16384, unit_rows: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest other rows by inner product.

    ``is_query`` is a condition on column vec_id. Every usable row is indexed. The index is fitted on the ``sample`` rows
    of smallest hash, of which the first ``pivots`` distinct ones are the pivots; these are all that is broadcast. A
    vector's cell is that of its nearest pivot. Cells lie together in groups of about ``group_rows`` rows, and groups of more than ``unit_rows``,
    as of a vector that very many rows have, in several units. A query visits the units of its nearest ``cells`` (a share of
    all), reads there the files of its first ``depth`` pivots, and compares what is as near by footrule as the best
    ``share`` of the sample are. Tables of so few rows that this could be less than ``k`` are compared whole. What is found
    depends on neither units nor partitions. Rows that share the query's id are its own. Vectors of another length than most have take no part.
    Fewer candidates than ``k`` give fewer rows, an empty table none; rows repeated as candidates are each found.
    ``cells`` = ``share`` = 1 compares every pair.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, vec_id, embedding)
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.mode(F.size("vector"), True).alias("length"), F.max(squares).alias("longest")).first()
    length = facts["length"] or 0
    rows = rows.where(F.size("vector") == length)
    drawn = rows.orderBy(md5_long("vec_id", F.xxhash64("vector")), "vec_id").select("vector").limit(sample).toArrow()
    sampled = _matrix(drawn.column(0).combine_chunks()) if drawn.num_rows else np.zeros((0, length))
    chosen = sampled[np.sort(np.unique(sampled, axis=0, return_index=True)[1])[:pivots]] if len(sampled) else sampled
    index = spark.sparkContext.broadcast((chosen, float(facts["longest"] or 1.0) ** 0.5, sampled))
    few = facts["n"] * share * cells < 2 * k  # else a query could find fewer rows than there are
    visits = max(1, int(np.ceil((1.0 if few else cells) * len(chosen))))
    groups = int(min(max(facts["n"] // group_rows, 1), max(len(chosen), 1)))
    part = 1.0 if few else share

    @F.arrow_udf("long")
    def group_of(vector: pa.Array) -> pa.Array:
        pivots_of = PivotOrders(index.value[0], index.value[1], depth)
        return pa.array(pivots_of.of_vectors(_matrix(vector))[:, 0].astype("i8") % groups)

    @F.arrow_udf("struct<least: long, groups: array<long>>")
    def visit(vector: pa.Array) -> pa.Array:
        pivots_of, queries = PivotOrders(index.value[0], index.value[1], depth), _matrix(vector)
        files, orders, found = Files(pivots_of, index.value[2]), pivots_of.of_queries(queries), []
        at = min(files.n - 1, int(np.ceil(part * files.n)))
        for a in range(0, len(queries), QUERY_BATCH):
            near = files.nearness(pivots_of.weights(orders[a : a + QUERY_BATCH]))
            found.append(np.zeros(near.shape[1]) if part >= 1 else np.sort(near, axis=0)[files.n - 1 - at])
        lists = [np.unique(o % groups) for o in orders[:, :visits].astype("i8")]
        ends = np.cumsum([0, *map(len, lists)])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(found).astype("i8")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))], names=["least", "groups"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = PivotOrders(index.value[0], index.value[1], depth)
        unit, held, built = None, [], None
        for batch in batches:
            numbers, kinds = batch.column("unit").to_numpy(), batch.column("query").to_numpy()
            # data rows have query -1, so that a unit's data comes before the queries that visit it
            edges = np.flatnonzero((np.diff(numbers) != 0) | ((kinds[1:] < 0) != (kinds[:-1] < 0))) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                one = batch.slice(a, b - a)
                if not one.num_rows:
                    continue
                ids, matrix = one.column("vec_id").to_numpy(), _matrix(one.column("vector"))
                if unit != numbers[a]:
                    unit, held, built = numbers[a], [], None
                if kinds[a] < 0:
                    held.append((ids, matrix))
                    continue
                if built is None:
                    if not held:
                        continue
                    built, held = Unit(orders, *(np.concatenate(x) for x in zip(*held, strict=True))), []
                keys, bounds = one.column("query").to_numpy(), one.column("least").to_numpy()
                for at in range(0, len(ids), QUERY_BATCH):
                    to = slice(at, at + QUERY_BATCH)
                    of, found, score, compared = built.search(ids[to], matrix[to], bounds[to], k, visits)
                    columns = [pa.array(keys[to][of]), pa.array(ids[to][of]), pa.array(found), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "vec_id", "score"])

    grouped = rows.select(group_of("vector").alias("group"), "vec_id", "vector")
    # numbers of rows by group: as many as pivots at most
    sizes = {r["group"]: r["count"] for r in grouped.groupBy("group").count().collect()} if groups > 1 else {0: facts["n"]}
    parts = [max(1, -(-sizes.get(g, 0) // unit_rows)) for g in range(groups)]
    of_group = F.array(*map(F.lit, parts))
    number = lambda group, i: group * F.lit(max(parts)) + i
    data = grouped.select(number(F.col("group"), F.pmod(F.xxhash64("vec_id", "vector"), F.get(of_group, F.col("group").cast("int")))).cast("long").alias("unit"), F.lit(-1).cast("long").alias("query"), F.lit(0).cast("long").alias("least"), "vec_id", "vector")
    asked = rows.where(is_query).select(F.monotonically_increasing_id().alias("query"), visit("vector").alias("v"), "vec_id", "vector")
    units = F.flatten(F.transform("v.groups", lambda g: F.transform(F.sequence(F.lit(0), F.get(of_group, g.cast("int")) - 1), lambda i: number(g, i).cast("long"))))
    visiting = asked.select(F.explode(units).alias("unit"), "query", F.col("v.least").alias("least"), "vec_id", "vector")
    dealt = data.unionByName(visiting).repartition(4 * sum(parts), "unit").sortWithinPartitions("unit", "query")
    found = dealt.mapInArrow(search, "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
