"""Benchmark decontamination: each shard of the corpus gets an FM-index, in which all phrases of the benchmark are sought.

A phrase is a window of consecutive words of an item. A shard's text is a sequence of word numbers; words that no phrase
has end a stretch, and a stretch shorter than the shortest phrase can't hold one. Backward search narrows the rows of the
sorted suffixes by ranks in a wavelet matrix; suffix positions kept for every few places tell where the rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import Scratch, fresh, ship

#: What separates words, after A to Z became lower case: all of ASCII but digits and letters.
BLANK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes as they are read: a blank for what separates words, lower case for upper.
READ_AS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], dtype="u1")
#: A stretch is indexed in pieces that start every so many words and overlap by the longest phrase.
PIECE = 64
#: Words of one index.
SHARD = 1 << 20
#: Every so many places the suffix's position is kept.
KEPT = 8
#: Words of the phrases that are sent to all tasks at once, and that one backward search takes.
BLOCK_WORDS, SEARCH = 1 << 21, 1 << 16


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one bit vector a level with its running counts."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for level in range(bits - 1, -1, -1):
            high = (sequence >> level) & 1
            ones = np.zeros(len(sequence) + 1, dtype="i4")
            np.cumsum(high, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            high = high.astype(bool)
            sequence = np.concatenate([sequence[~high], sequence[high]])
        # where each symbol's places begin on the lowest level
        self.starts = self.down(np.arange(1 << bits), np.zeros(1 << bits, dtype="i8"))

    def down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where prefixes of these lengths end among the symbols' own places on the lowest level."""
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            before = ones[places]
            places = np.where((symbols >> (self.bits - 1 - level)) & 1, zeros + before, places - before)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self.down(symbols, places) - self.starts[symbols]

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and how often each occurs before."""
        symbols = np.zeros(len(places), dtype="i8")
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[places]
            high = ones[places + 1] > before
            symbols = 2 * symbols + high
            places = np.where(high, zeros + before, places - before)
        return symbols, places - self.starts[symbols]


def sorted_suffixes(text: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """Positions of all suffixes in order. ``ends`` are the places of the zeros; these differ, and ascend by place.

    The first ranks come from as many symbols as a number holds; then the known depth doubles among suffixes that tie.
    """
    n, depth = len(text), max(1, 62 // bits)
    end_of = np.repeat(ends, np.diff(ends, prepend=-1))  # of the piece that each place is in
    key, ahead = np.zeros(n, dtype="i8"), np.arange(n)
    for _ in range(depth):
        key = (key << bits) | text[np.minimum(ahead, end_of)]
        ahead += 1
    key[ends] = 0
    order = np.argsort(key, kind="stable")
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(key[order[1:]], key[order[:-1]], out=new[1:])
    new[: len(ends)] = True
    while True:
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first row
        rank = np.empty(n, dtype="i8")
        rank[order] = first
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            return order
        who = order[tied]
        second = rank[np.minimum(who + depth, end_of[who])]
        own = first[tied]
        by = np.lexsort((second, own))
        order[tied] = who[by]
        second = second[by]
        new[tied[1:]] = new[tied[1:]] | (second[1:] != second[:-1]) | (own[1:] != own[:-1])
        depth *= 2


class FMIndex:
    """An index of pieces of text, in which phrases are counted and located."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, symbols: int):
        bits = max(1, int(symbols).bit_length())
        order = sorted_suffixes(text, ends, bits)
        self.tree = WaveletMatrix(text[order - 1], bits)  # of the symbol before each suffix
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        starts = np.zeros(len(text), dtype=bool)
        starts[0] = True
        starts[ends[:-1] + 1] = True
        keep = (order % KEPT == 0) | starts[order]  # no way back leads over the start of a piece
        self.kept, self.before = order[keep], np.concatenate([[0], np.cumsum(keep)])
        self.size = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase: a row of ``phrases``, filled up at its end."""
        low, high = np.zeros(len(phrases), dtype="i8"), np.full(len(phrases), self.size, dtype="i8")
        alive = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            alive = alive[(lengths[alive] >= back) & (low[alive] < high[alive])]
            symbol = phrases[alive, lengths[alive] - back]
            low[alive], high[alive] = (self.first[symbol] + self.tree.rank(symbol, x[alive]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these rows."""
        out, steps, waiting = np.zeros(len(rows), dtype="i8"), np.zeros(len(rows), dtype="i8"), np.arange(len(rows))
        while len(waiting):
            known = self.before[rows + 1] > self.before[rows]
            done = waiting[known]
            out[done] = self.kept[self.before[rows[known]]] + steps[done]
            waiting, rows = waiting[~known], rows[~known]
            symbol, rank = self.tree.at(rows)
            rows = self.first[symbol] + rank
            steps[waiting] += 1
        return out


class Phrases:
    """Distinct phrases as rows of word numbers from 1; 0 fills up at the end, and stands for every other word."""

    def __init__(self, phrases: list[tuple[str, ...]]):
        self.lengths = np.fromiter(map(len, phrases), "i8", len(phrases))
        self.longest, self.shortest = int(self.lengths.max()), int(self.lengths.min())
        self.words = pa.array(sorted({w for p in phrases for w in p}))
        number = {w: i + 1 for i, w in enumerate(self.words.to_pylist())}
        self.rows = np.zeros((len(phrases), self.longest), dtype="i8")
        for i, p in enumerate(phrases):
            self.rows[i, : len(p)] = [number[w] for w in p]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts one after another, and where each text ends."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
        if not offsets[-1] - offsets[0]:
            return np.zeros(0, dtype="i8"), np.zeros(len(texts), dtype="i8")
        data = READ_AS[np.frombuffer(texts.buffers()[2], "u1")[offsets[0] : offsets[-1]]]
        clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))
        split = pc.ascii_split_whitespace(clean)
        flat = split.flatten()
        full = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)])
        codes = pc.fill_null(pc.add(pc.index_in(flat, value_set=self.words.cast(pa.large_string())), 1), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return codes[full[1:] > full[:-1]].astype("i8"), full[ends[1:]]

    def pieces(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the pieces of all stretches that can hold a phrase."""
        known = codes > 0
        edge = np.zeros(len(codes) + 1, dtype=bool)
        edge[[0, len(codes)]] = True
        edge[ends] = True
        edge[1:-1] |= known[1:] != known[:-1]
        at = np.flatnonzero(edge)
        begin, size = at[:-1], np.diff(at)
        good = known[begin] & (size >= self.shortest)
        begin, size = begin[good], size[good]
        count = np.maximum(1, -(-(size - self.shortest + 1) // PIECE))
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(begin, count) + PIECE * within
        return start, np.minimum(np.repeat(begin + size, count) - start, PIECE + self.longest - 1)

    def occurrences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each text ends among the words, place of each occurrence among them, its phrase)."""
        codes, ends = self.read(texts)
        start, size = self.pieces(codes, ends) if len(codes) else (np.zeros(0, dtype="i8"),) * 2
        upto, places, phrases = np.cumsum(size), [], []
        begin = 0
        while begin < len(start):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SHARD)))
            place, phrase = self.in_shard(codes, start[begin:end], size[begin:end])
            places.append(place)
            phrases.append(phrase)
            begin = end
        none = [np.zeros(0, dtype="i8")]
        return ends, np.concatenate(places or none), np.concatenate(phrases or none)

    def in_shard(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.cumsum(size + 1) - 1  # each piece is followed by a zero
        place = np.arange(last[-1] + 1) + np.repeat(start - (last - size), size + 1)
        text = codes[np.minimum(place, len(codes) - 1)]
        text[last] = 0
        index, places, phrases = FMIndex(text, last, len(self.words)), [], []
        for at in range(0, len(self.rows), SEARCH):
            low, high = index.search(self.rows[at : at + SEARCH], self.lengths[at : at + SEARCH])
            count = np.maximum(high - low, 0)
            rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            places.append(place[index.locate(rows)])
            phrases.append(np.repeat(np.arange(at, at + len(low)), count))
        return np.concatenate(places), np.concatenate(phrases)


def words(text: Column) -> Column:
    """The words of a text in lower case, as an array; none for null."""
    clean = F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), BLANK, " "))
    return F.when(F.length(clean) > 0, F.split(clean, " ")).otherwise(F.array().cast("array<string>"))


def phrase_table(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """(phrase, its words; items, the sorted ids that have it as text) of all windows of ``window`` words; of fewer, if an item has fewer.

    Items without a word, null ones included, have no phrase; repeated ids and windows count once; a null id is ''.
    """
    own = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("ws")).where("size(ws) > 0")
    each = own.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(ws) - {window - 1})), i -> slice(ws, i, {window}))")).alias("phrase"))
    return each.groupBy("phrase").agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))


def _blocks(table: DataFrame) -> Iterator[list]:
    """The rows of the phrase table in lists of bounded size: one after another comes to the driver, whatever their number."""
    block, size = [], 0
    for row in table.toLocalIterator():
        block.append((tuple(row.phrase), row.items))
        size += len(row.phrase) + len(row.items)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` with n_words, spans and items: which words of each text stand in an occurrence of a benchmark phrase.

    spans are merged ranges (start, end exclusive) of word numbers, items the sorted ids of items with occurring phrases.
    Whole texts are searched, the longest ones in several indexes of bounded size. A null or blank text has no words;
    repeated rows stay; existing columns of the three names are replaced, all others kept. Phrases go to the tasks in
    blocks of bounded size, and what is found for the blocks is merged: with one block nothing is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    table = scratch.write("phrases", phrase_table(items, item_id, item_text, window))
    found = [_found(spark, block)(F.col(f"`{text}`")) for block in _blocks(table)]
    name = fresh(kept, "found")
    if not found:
        nothing = F.struct(F.size(words(F.col(f"`{text}`"))).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start: long, end: long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
        found = [nothing]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    if len(found) == 1:
        docs = docs.withColumn(name, found[0])
    else:
        # one block after another, as all at once would keep all indexes of a batch's phrases in memory
        for i, block in enumerate(found):
            part = block if not i else F.struct(F.col(f"{name}.n_words"), F.concat(f"{name}.spans", block["spans"]).alias("spans"), F.concat(f"{name}.items", block["items"]).alias("items"))
            docs = scratch.write(f"{name}-{i % 2}", docs.withColumn(name, part))
    merged = F.expr(f"""aggregate(array_sort(coalesce({name}.spans, array())), CAST(array() AS array<struct<start: bigint, end: bigint>>), (m, s) ->
        IF(size(m) > 0 AND element_at(m, -1).end >= s.start,
           concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, 'end', greatest(element_at(m, -1).end, s.end)))),
           concat(m, array(s))))""") if len(found) > 1 else F.coalesce(f"{name}.spans", F.array())
    ids = F.expr(f"array_sort(array_distinct(coalesce({name}.items, CAST(array() AS array<string>))))")
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{name}.n_words").alias("n_words"), merged.alias("spans"), ids.alias("items"))


def _found(spark, block: list):
    phrases = spark.sparkContext.broadcast(block)  # of at most BLOCK_WORDS words and ids, but for one last row
    made: dict[str, Phrases] = {}

    @F.arrow_udf("struct<n_words: long, spans: array<struct<start: long, end: long>>, items: array<string>>")
    def found(texts: pa.Array) -> pa.Array:
        if "phrases" not in made:
            made["phrases"] = Phrases([p for p, _ in phrases.value])
        own, n = made["phrases"], len(texts)
        ends, places, which = own.occurrences(texts)
        doc = np.searchsorted(ends, places, side="right")
        total = int(ends[-1]) if n else 0
        # words in an occurrence, and where runs of them start and end; runs end with their text
        change = np.bincount(places, minlength=total + 1)[: total + 1] - np.bincount(places + own.lengths[which], minlength=total + 1)[: total + 1]
        hit = np.concatenate([[False], np.cumsum(change[:total]) > 0, [False]])
        cut = np.zeros(total + 2, dtype=bool)
        cut[ends + 1] = True
        start = np.flatnonzero(hit[1:-1] & (~hit[:-2] | cut[1:-1]))
        end = np.flatnonzero(hit[1:-1] & (~hit[2:] | cut[2:])) + 1
        begins = np.concatenate([[0], ends[:-1]])
        of = np.searchsorted(ends, start, side="right")
        spans = pa.StructArray.from_arrays([pa.array(start - begins[of], pa.int64()), pa.array(end - begins[of], pa.int64())], names=["start", "end"])
        items: list[set] = [set() for _ in range(n)]
        for both in np.unique(doc * len(own.rows) + which).tolist():
            items[both // len(own.rows)].update(phrases.value[both % len(own.rows)][1])
        n_words = pa.array(np.diff(ends, prepend=0), pa.int64())
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n)[:n])]), pa.int32()), spans)
        return pa.StructArray.from_arrays([n_words, spans, pa.array(map(sorted, items), pa.list_(pa.string()), size=n)], names=["n_words", "spans", "items"])

    return found


def remove(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (of :func:`find`) with its spans cut out of the texts, together with the signs that follow their words.

    Texts without a span, null ones included, stay as they are.
    """
    # signs before the first word, then each word with the signs after it
    word = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"
    lead = r"^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"
    own = f"`{text}`"
    stays = f"filter(regexp_extract_all({own}, '{word}', 0), (w, i) -> NOT exists(spans, s -> i >= s.start AND i < s.end))"
    return found.withColumn(text, F.expr(f"IF(size(spans) > 0, concat(regexp_extract({own}, '{lead}', 0), array_join({stays}, '')), {own})"))
