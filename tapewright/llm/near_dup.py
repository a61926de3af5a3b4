"""Near-duplicate documents by order min-hashing.

A document's five-word shingles are labelled with the number of times that they occurred before in it. A sketch keeps
the few labelled shingles of least hash in the order in which the text has them, so that two texts share a sketch if
they share these shingles in the same order. Texts that share a sketch are candidates, which a banded alignment of
their shingles verifies: matched shingles of the best alignment, divided by all, must be at least the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import Scratch, ship

SHINGLE = 5
WORD_BYTES = 3
SLICE_BYTES = 8 << 20
U64 = np.uint64
_ODD = np.random.default_rng(20240229).integers(1 << 62, size=256, dtype="u8") * U64(2) + U64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words of each text) of lower-cased texts."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded = split.flatten().dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), "u8", len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    filled = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype("i8")
    keep = filled[codes] if len(codes) else np.zeros(0, dtype=bool)
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(counts)])]
    return each[codes[keep]] if len(codes) else np.zeros(0, "u8"), np.diff(ends)


def _shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, number of shingles of each text); a text of fewer words is one shingle, of none none."""
    starts, n = np.cumsum(counts) - counts, np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    short = np.repeat(counts, n)
    out = np.zeros(len(first), "u8")
    for k in range(SHINGLE):
        there = short > k
        word = hashes[np.minimum(first + k, len(hashes) - 1)] if len(hashes) else hashes
        out = np.where(there, _mix(out * U64(0x9E3779B97F4A7C15) + word), out)
    return out, n


def _labelled(shingles: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Each shingle's hash with the number of its earlier occurrences in the same text."""
    key = shingles ^ _mix(of.astype("u8") + U64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, dtype=bool)
    place = np.arange(len(ranked))
    labels = np.empty(len(ranked), "u8")
    labels[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return _mix(shingles + labels * U64(0xD6E8FEB86659FD93))


def sketches(shingles: np.ndarray, n: np.ndarray, count: int, length: int) -> np.ndarray:
    """``count`` sketches of each text of at least one shingle: hashes of its ``length`` least ones in text order."""
    some = n[n > 0]
    starts, of = np.cumsum(some) - some, np.repeat(np.arange(len(some)), some)
    labelled = _labelled(shingles, of)
    out = np.empty((len(some), count), "u8")
    for j in range(count):
        ranks = labelled * _ODD[j]
        ranks ^= ranks >> U64(32)
        chosen = np.full((length, len(some)), -1, "i8")
        for i in range(min(length, int(some.max(initial=0)))):
            least = np.minimum.reduceat(ranks, starts)
            at = np.flatnonzero(ranks == np.repeat(least, some))
            at = at[np.concatenate([[True], of[at][1:] != of[at][:-1]])]
            at = at[some[of[at]] > i]
            chosen[i, of[at]] = at
            ranks[at] = U64(0xFFFFFFFFFFFFFFFF)
        chosen.sort(axis=0)
        key = np.full(len(some), j, "u8")
        for row in chosen:
            key = np.where(row >= 0, _mix(key * U64(0x9E3779B97F4A7C15) + labelled[np.maximum(row, 0)]), key)
        out[:, j] = key
    return out


def _sketch_udf(count: int, length: int):
    @F.arrow_udf("struct<fp: binary, n: long, seq: binary, keys: array<long>>")
    def sketch(texts: pa.Array) -> pa.Array:
        sizes, begin, out = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8")), 0, []
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE_BYTES)))
            hashes, counts = _word_hashes(texts[begin:end])
            shingles, n = _shingles(hashes, counts)
            keys = sketches(shingles, n, count, length)
            ends = np.cumsum(counts)
            words = [hashes[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
            has = np.cumsum(np.concatenate([[0], n > 0])) * count
            columns = [
                pa.array([xxhash.xxh3_128_digest(w) for w in words], pa.binary()),
                pa.array(n),
                pa.array([_packed(hashes[e - c : e]) for e, c in zip(ends, counts, strict=True)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(has, pa.int32()), pa.array(keys.reshape(-1).view("i8"))),
            ]
            out.append(pa.StructArray.from_arrays(columns, names=["fp", "n", "seq", "keys"]))
            begin = end
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("fp", pa.binary()), ("n", pa.int64()), ("seq", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    return sketch


def _packed(hashes: np.ndarray) -> bytes:
    """Three bytes of each word's hash: two different words are told apart but once in 16.7 million times."""
    return np.ascontiguousarray(hashes.astype("<u4").view("u1").reshape(-1, 4)[:, :WORD_BYTES]).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // WORD_BYTES, 4), "u1")
    out[:, :WORD_BYTES] = np.frombuffer(packed, "u1").reshape(-1, WORD_BYTES)
    return out.reshape(-1).view("<u4").astype("u8")


def _rolled(seq: bytes) -> np.ndarray:
    """Shingles of a text from its words' short hashes."""
    words = _unpacked(seq)
    return _shingles(words, np.array([len(words)]))[0]


def _banded(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of x and y that strays from the diagonal by ``band`` at most.

    A row of the alignment is a bit vector of the 2 * band + 1 places around the diagonal, as in Crochemore's and
    others' algorithm; a place that leaves the band has got its last value.
    """
    places: dict[int, list[int]] = {}
    for i, s in enumerate(x.tolist()):
        places.setdefault(s, []).append(i)
    often = {s: sum(1 << i for i in at) for s, at in places.items() if len(at) > 64}
    row, low, done, width = (1 << min(band + 1, len(x))) - 1, 0, 0, 0
    for j, s in enumerate(y.tolist()):
        if j > band and low < len(x):
            done += ~row & 1
            row, low = row >> 1, low + 1
        high = min(j + band + 1, len(x))
        width = max(high - low, 0)
        if j and j + band < len(x):
            row |= 1 << (width - 1)
        if (at := places.get(s)) is None:
            continue
        if s in often:
            hit = (often[s] >> low) & ((1 << width) - 1)
        else:
            hit = 0
            for i in at:
                if low <= i < high:
                    hit |= 1 << (i - low)
        kept = row & hit
        row = ((row + kept) | (row - kept)) & ((1 << width) - 1)
    return done + width - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Matched shingles of an alignment divided by all, or 0 if those of the best are less than ``least`` of all.

    The band doubles from a narrow one up to the widest that any alignment of such a similarity can stray in; the first
    that finds enough matches decides, so that near copies cost time in proportion to their length and differences.
    """
    whole = len(a) + len(b)
    needed = int(np.ceil(least * whole / (1 + least) - 1e-9))
    if min(len(a), len(b)) < max(needed, 1):
        return 0.0
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    unlike = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(unlike[0]) if len(unlike) else short - head
    same, x, y = head + tail, a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) and len(y):
        if same + _common(x, y) < needed:
            return 0.0
        widest = max(len(a), len(b)) - needed
        band, most = min(max(64, 2 * abs(len(x) - len(y))), widest), same
        while True:
            most = same + _banded(x, y, band)
            if most >= needed or band >= widest:
                break
            band = min(4 * band, widest)
        same = most
    return same / (whole - same) if same >= needed else 0.0


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that two texts share, repeated ones as often as both have them: no alignment matches more."""
    (u, m), (v, n) = (np.unique(z, return_counts=True) for z in (x, y))
    shared, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum()) if len(shared) else 0


def verified(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b and other columns) of nodes whose texts are alike. ``sequences`` has id and seq, an id once.

    Texts come to the pairs by two joins, of which Spark splits those on an id that very many pairs have.
    """

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        last, held, out = None, None, []
        for x, y in zip(a, b, strict=True):
            x, y = x.as_py(), y.as_py()
            if x != last:
                last, held = x, _rolled(x)
            out.append(similarity(held, _rolled(y), least) >= least)
        return pa.array(out, pa.bool_())

    of = lambda end: sequences.select(F.col("id").alias(end), F.col("seq").alias("seq_" + end))
    # merge joins at every size: texts are never broadcast, and neither are pairs, of which there is no bound
    return pairs.hint("merge").join(of("b"), "b").hint("merge").join(of("a"), "a").where(alike("seq_a", "seq_b")).select(pairs.columns)


#: Words of one slice of texts whose shingles are ordered at once.
SLICE_WORDS = 1 << 20
#: Texts of one shingle that are compared with each other in one group; more are dealt over several.
GROUP = 4096
CHUNK = 1 << 14


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, labelled shingles, number of each text's) of slices of a batch whose last column is seq."""
    seqs = batch.column(batch.num_columns - 1)
    sizes, begin = np.cumsum(pc.binary_length(seqs).to_numpy(zero_copy_only=False).astype("i8")) // WORD_BYTES, 0
    while begin < len(seqs):
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE_WORDS)))
        words = _unpacked(b"".join(seqs[begin:end].to_pylist()))
        shingles, n = _shingles(words, np.diff(sizes[begin:end], prepend=sizes[begin - 1] if begin else 0))
        yield begin, end, _labelled(shingles, np.repeat(np.arange(len(n)), n)), n
        begin = end


def _frequencies(texts: DataFrame, bits: int) -> np.ndarray:
    """How many texts have a labelled shingle of each value of the first ``bits`` bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, "i4")
        for batch in batches:
            for *_, labelled, _n in _slices(batch):
                np.add.at(seen, (labelled >> U64(64 - bits)).astype("i8"), 1)
        some = [i for i in range(0, len(seen), CHUNK) if seen[i : i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([seen[i : i + CHUNK].tobytes() for i in some], pa.binary())], names=["at", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(seen, "i4").astype("i8")
        most = [np.minimum(x, (1 << 31) - 1).astype("i4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(most, pa.binary())], names=["at", "seen"])

    schema, out = "at long, seen binary", np.zeros(1 << bits, "i4")
    for row in texts.select("seq").mapInArrow(count, schema).repartition("at").mapInArrow(add, schema).collect():
        part = np.frombuffer(row["seen"], "i4")
        out[row["at"] : row["at"] + len(part)] = part
    return out


def _matches(group: np.ndarray, n: np.ndarray, rest: np.ndarray, comp: np.ndarray, dealt: np.ndarray, cells: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of entries of the same group and of different classes whose lengths and rests allow alike texts.

    Entries of a group's largest class are only looked up by those of others, by length: no pair of one class that is
    large is looked at, nor any whose lengths rule it out.
    """
    order = np.lexsort((n, group))
    group, n, comp, dealt, cells = (x[order] for x in (group, n, comp, dealt, cells))
    most = np.floor(rest[order] * (1 + least) / least + 1e-6).astype("i8") - n  # length of the longest partner
    by = np.lexsort((comp, group))
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(group[by]) != 0) | (np.diff(comp[by]) != 0)]))
    sizes = np.diff(np.append(heads, len(by)))
    largest = np.zeros(len(n), bool)
    last = np.lexsort((sizes, group[by][heads]))
    last = last[np.concatenate([np.diff(group[by][heads][last]) != 0, [True]])]
    of = np.repeat(np.arange(len(heads)), sizes)
    largest[by] = np.isin(of, last)
    asking = np.flatnonzero(~largest)
    key = group * (1 << 32) + n
    low = np.searchsorted(key, group[asking] * (1 << 32) + np.ceil(n[asking] * least - 1e-6).astype("i8"), "left")
    high = np.searchsorted(key, group[asking] * (1 << 32) + np.maximum(most[asking], -1), "right")
    width = np.maximum(high - low, 0)
    ends, begin = np.cumsum(width), 0
    while begin < len(asking):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 20))))
        w = width[begin:end]
        i = np.repeat(asking[begin:end], w)
        j = np.repeat(low[begin:end] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        fit = (comp[i] != comp[j]) & (most[j] >= n[i]) & (largest[j] | (i < j))
        i, j = i[fit], j[fit]
        # texts dealt to several cells of a grid meet in only one
        once = cells[i] == (np.minimum(dealt[i], dealt[j]) << 16) + np.maximum(dealt[i], dealt[j])
        yield order[i[once]], order[j[once]]
        begin = end


def possible_pairs(texts: DataFrame, least: float, most: int = 1 << 30, one_in: int = 1) -> DataFrame:
    """(a, b, ca, cb): all pairs of ``texts`` (id, comp, seq) of different classes that can be alike, and the classes.

    Texts of n and m shingles that are alike share t = least * (n + m) / (1 + least) labelled ones at least. With all
    shingles in one order, the first that both have is followed in each text by t - 1 others or more. So texts meet by
    the shingles with which at least ``least`` of a text is left, and a pair is ruled out by what is left there. Rare
    shingles come first: a passage that thousands of texts have brings together only those that are alike by it. The
    order rests on counts of hashed shingles, whose collisions cost time only.

    Of two classes, which may be large, each slice of shingles gives ``most`` pairs at most; where it has more, a row with
    a = b = -1 says so, and the caller asks again for more when it has merged what is alike. With ``one_in`` above 1 texts
    meet by that share of the shingles only, the same ones in all texts: some pairs, for a first merge.
    """
    tokens = texts.agg(F.sum(F.length("seq"))).first()[0] or 0
    bits = min(max(int(tokens).bit_length(), 14), 20)
    shared = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for begin, end, labelled, n in _slices(batch):
                of = np.repeat(np.arange(len(n)), n)
                count = often[(labelled >> U64(64 - bits)).astype("i8")]
                order = np.lexsort((labelled, count, of))
                left = n[of] - (np.arange(len(of)) - (np.cumsum(n) - n)[of])
                chosen = (left >= least * n[of] - 1e-6) & (labelled[order] % U64(one_in) == 0)
                order, left, of = order[chosen], left[chosen], of[chosen]
                grid = np.minimum(-(-count[order].astype("i8") // GROUP), 1 << 15)
                own = (_mix(batch.column(0)[begin:end].to_numpy().astype("u8")) >> U64(1)).astype("i8")[of] % grid
                for a in range(0, len(of), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    at = np.repeat(np.arange(len(of[part])), grid[part])
                    other = np.arange(len(at)) - np.repeat(np.cumsum(grid[part]) - grid[part], grid[part])
                    mine = own[part][at]
                    columns = [labelled[order][part][at].view("i8"), (np.minimum(mine, other) << 16) + np.maximum(mine, other), mine.astype("i4"), n[of[part]][at].astype("i4"), left[part][at].astype("i4")]
                    names = ["token", "cell", "dealt", "n", "rest"]
                    rows = pa.array(begin + of[part][at])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0).take(rows), batch.column(1).take(rows)], names=[*names, "id", "comp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            token, cell, dealt, n, rest = (table.column(k).to_numpy().astype("i8") for k in range(5))
            group = np.cumsum(np.concatenate([[False], (np.diff(token) != 0) | (np.diff(cell) != 0)])).astype("i8")
            ids, comp = (table.column(k).to_numpy() for k in (5, 6))
            seen: dict[tuple[int, int], int] = {}
            more = False
            for i, j in _matches(group, n, rest, comp, dealt, cell, least):
                low = ids[i] < ids[j]
                x, y = np.where(low, i, j), np.where(low, j, i)
                once = np.lexsort((ids[y], ids[x]))
                x, y = x[once], y[once]
                new = np.concatenate([[True], (np.diff(ids[x]) != 0) | (np.diff(ids[y]) != 0)])[: len(x)]
                x, y = x[new], y[new]
                # so many of each two classes, those of this slice's earlier parts included
                cx, cy = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
                by = np.lexsort((cy, cx))
                heads = np.flatnonzero(np.concatenate([[True], (np.diff(cx[by]) != 0) | (np.diff(cy[by]) != 0)])[: len(by)])
                sizes = np.diff(np.append(heads, len(by)))
                before = np.array([seen.get(k, 0) for k in zip(cx[by[heads]].tolist(), cy[by[heads]].tolist(), strict=True)], "i8")
                place = np.arange(len(by)) - np.repeat(heads, sizes) + np.repeat(before, sizes)
                for k, had, size in zip(zip(cx[by[heads]].tolist(), cy[by[heads]].tolist(), strict=True), before.tolist(), sizes.tolist(), strict=True):
                    seen[k] = had + size
                kept = by[place < most]
                more |= len(kept) < len(by)
                x, y = x[kept], y[kept]
                for a in range(0, len(x), 1 << 16):
                    p, q = x[a : a + (1 << 16)], y[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[p], ids[q], comp[p], comp[q]))], names=["a", "b", "ca", "cb"])
            if more:
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64())] * 4, names=["a", "b", "ca", "cb"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 16:
                table = pa.Table.from_batches(held)
                token, cell = table.column(0).to_numpy(), table.column(1).to_numpy()
                new = np.flatnonzero((np.diff(token) != 0) | (np.diff(cell) != 0))
                if len(new):
                    yield from found(table.slice(0, int(new[-1]) + 1))
                    held = table.slice(int(new[-1]) + 1).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    entries = texts.select("id", "comp", "seq").mapInArrow(deal, "token long, cell long, dealt int, n int, rest int, id long, comp long")
    dealt = entries.repartition("token", "cell").sortWithinPartitions("token", "cell")
    return dealt.mapInArrow(meet, "a long, b long, ca long, cb long").distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with those of each partition replaced by a star around the least label of each component there."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x], x = top, up
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, q = root(u), root(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        found = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(list(map(root, found)), pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(contract, "u long, v long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, comp): the least label of each linked label's component, but for those least ones themselves.

    ``edges`` has labels u > v. Edges of each partition are contracted first; then large and small stars alternate
    until no label has two edges to lesser ones, or edges to both lesser and greater ones.
    """
    edges = scratch.write("edges", _contracted(edges).distinct())
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty():
            return edges.withColumnRenamed("v", "comp")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write("large", large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = scratch.write("edges", _contracted(small).distinct())
        scratch.free("large")


def _classed(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``rows`` (with id) with the label of each node's class: the least id that is known to be in it."""
    if comps is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.hint("merge").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, count: int = 12, length: int = 2, rounds: int = 2) -> DataFrame:
    """(doc_id, class_id, representative): a row per row of ``docs``; the class is its least doc_id.

    Texts of the same lower-cased words are copies and form one node; null and blank texts are copies of each other.
    Each sketch of a node puts it in a bucket, and two nodes of one bucket are candidates. A bucket is led by the node that
    shares most buckets with others. In the first round a node is compared with whoever leads most of its buckets, in the
    next ones with the leader of the smallest that still holds several classes: each round sends a text once, however
    large the buckets are. The rounds only save comparisons: of the nodes of all buckets that then still hold several classes, every pair of different classes is ruled out by
    :func:`possible_pairs` or verified, until none is left. Two texts of similarity 0.8 share at least one of 12 sketches
    of length 2 but once in some 200,000 times. Rows of null id take no part in naming a class. Very long texts are
    compared whole, in a band. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    sketch = _sketch_udf(count, length)(F.col(f"`{text}`"))
    sketched = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), sketch.alias("s")).select("doc_id", "s.*")
    table = scratch.write("table", sketched.withColumn("id", F.monotonically_increasing_id()))
    nodes = scratch.write("nodes", table.groupBy("fp").agg(F.min("id").alias("id"), F.min("doc_id").alias("first")))
    posted = table.select("id", "keys").hint("merge").join(nodes.select("id"), "id").select("id", F.explode("keys").alias("key"))
    posted = scratch.write("posted", posted)
    sizes = scratch.write("sizes", posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = scratch.write("shared", posted.hint("merge").join(sizes, "key"))
    # how much a node shares with others: the text that a group of copies was made from shares most
    weights = scratch.write("weights", rows.groupBy("id").agg(F.sum("n").alias("weight")))
    rows = scratch.write("rows", rows.hint("merge").join(weights, "id"))
    scratch.free("posted", "sizes", "shared", "weights")
    active = scratch.write("active", table.select("id", "seq").hint("merge").join(rows.select("id").distinct(), "id"))
    comps = None

    def merge(pairs: DataFrame) -> None:
        """Verifies pairs (a, b, ca, cb) of nodes and their classes, and merges the classes of those that are alike."""
        nonlocal comps
        found = scratch.write("found", verified(pairs, active, least))
        links = found.select(F.greatest("ca", "cb").alias("u"), F.least("ca", "cb").alias("v")).where("u != v")
        if links.isEmpty():
            return
        roots = components(links, scratch)
        added = roots.select(F.col("u").alias("id"), "comp")
        if comps is not None:
            moved = comps.withColumnRenamed("comp", "u").join(roots, "u", "left").select("id", F.coalesce("comp", "u").alias("comp"))
            added = moved.unionByName(added)
        comps = scratch.write("comps", added)
        scratch.free("edges", "found")

    rows = rows.withColumn("comp", F.col("id"))
    for turn in range(rounds):
        # buckets of one class need no more comparisons, now or later
        leads = rows.groupBy("key").agg(F.max_by("id", "weight").alias("lead"), F.min("comp").alias("c"), F.max("comp").alias("d")).where("c != d").select("key", "lead")
        led = _classed(leads.withColumnRenamed("lead", "id"), comps).withColumnsRenamed({"id": "lead", "comp": "lead_comp"})
        rows = scratch.write("rows", rows.hint("merge").join(scratch.write("led", led), "key"))
        others = rows.where("lead_comp != comp").groupBy("id")
        chosen = F.mode(F.struct("lead", "lead_comp")) if turn == 0 else F.min_by(F.struct("lead", "lead_comp"), "n")
        asked = others.agg(chosen.alias("a"), F.first("comp").alias("comp"))
        merge(asked.select("a.lead", F.col("id").alias("b"), F.col("a.lead_comp").alias("ca"), F.col("comp").alias("cb")).withColumnRenamed("lead", "a"))
        rows = scratch.write("rows", _classed(rows.select("id", "key", "n", "weight"), comps))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c != d").select("key")
    rows = scratch.write("rows", rows.hint("merge").join(scratch.write("mixed", mixed), "key"))
    scratch.free("led", "mixed")
    left = scratch.write("left", rows.select("id", "comp").distinct().hint("merge").join(active, "id").select("id", "comp", "seq"))
    scratch.free("rows")
    most, one_in, more = 4, 4, True
    while more:
        # few pairs first, by a share of the shingles and of two classes: what these merge need not be compared
        pairs = scratch.write("pairs", possible_pairs(left, least, most, one_in))
        more = one_in > 1 or not pairs.where("a < 0").isEmpty()
        merge(pairs.where("a >= 0"))
        if more:
            left = scratch.write("left", _classed(left.select("id", "seq"), comps).select("id", "comp", "seq"))
            most, one_in = most * 16, 1
    scratch.free("pairs", "left", "active")
    named = _classed(nodes, comps)
    if comps is not None:
        names = named.join(comps.select("comp").distinct(), "comp", "left_semi").groupBy("comp").agg(F.min("first").alias("class"))
        named = named.join(names, "comp", "left").withColumn("first", F.coalesce("class", "first"))
    by_node = scratch.write("by_node", named.select("fp", F.col("first").alias("class_id")))
    scratch.free("nodes", "comps", "found")
    out = table.select("doc_id", "fp").hint("merge").join(by_node, "fp")
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("representative"))
