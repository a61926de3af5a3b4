"""Alignment of two tokenizers' ids over the same texts, and counts of the id pairs that they link.

The cumulative ends of both id lists are keys of two dictionaries from end to index; their sorted common keys cut both
lists into groups, in which tokens that overlap are linked. A text is aligned by its chunks, which start at a blank
after something that isn't one: neither tokenizer has a token across such a place, so that both lists end there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tapewright.llm.common import Scratch, ship

#: All that Unicode or an engine of regular expressions may take for a blank, so that chunks are rather too long.
SPACES = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
CHUNK = re.compile(f"(?<=[^{SPACES}]) ")
ODD = rf"^ |[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{180e}}\x{{2000}}-\x{{200b}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{2060}}\x{{3000}}\x{{feff}}] "
#: Bytes of text that a slice has about, which is joined with the counts of its pairs as one.
SLICE_BYTES = 3 << 20
#: Characters that are encoded at once.
TOGETHER = 20_000
ID_BITS = 24


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    return shown | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Aligned:
    """What is known of a list of chunks: counts (n_a, n_b, n_groups, n_links), whether the bytes of both id lists are
    the chunk's, the groups as text, and the id pairs of all links one after another."""

    def __init__(self, counts: np.ndarray, good: np.ndarray, texts: list[bytes], links: np.ndarray):
        self.counts, self.good, self.texts, self.links = counts, good, texts, links

    @classmethod
    def joined(cls, parts: list[Aligned]) -> Aligned:
        none = cls(np.zeros((0, 4), dtype="i8"), np.zeros(0, dtype=bool), [], np.zeros(0, dtype="i8"))
        parts = [none, *parts]
        return cls(np.concatenate([p.counts for p in parts]), np.concatenate([p.good for p in parts]), [t for p in parts for t in p.texts], np.concatenate([p.links for p in parts]))


class Aligner:
    """Ids, groups and links of chunks; a chunk is a blank and what follows, up to the next one."""

    def __init__(self, tokenizer_json: bytes, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(tokenizer_json)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        stands, own = byte_level(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(own.values()) + 1)
        for piece, i in own.items():
            self.a_bytes[i] = bytes(stands[c] for c in piece)
        byte = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)])
        self.b_bytes = [byte(i) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        self.b_bytes[sp.unk_id()] = b"\xff"  # its text isn't known
        # cutting at blanks is right only if no piece has one after another character
        if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())):
            raise ValueError("the vocabulary has pieces across blanks")
        self.sizes = [np.array([len(x) for x in told], dtype="i8") for told in (self.a_bytes, self.b_bytes)]
        # each id as it is written: before another of its side, or at the end of its side of a group
        ends = [(len(self.a_bytes), b","), (len(self.a_bytes), b"|"), (len(self.b_bytes), b","), (len(self.b_bytes), b";")]
        self.written = np.array([b"%d%s" % (i, end) for n, end in ends for i in range(n)], dtype=object)

    def alone(self, chunk: str) -> tuple[list[int], list[int]]:
        """Both id lists of a chunk. The second library puts a blank before each text but the empty one."""
        own = self.b.encode(chunk[1:], num_threads=1) if len(chunk) > 1 else [self.b.piece_to_id("▁")]
        return self.a.encode(chunk, add_special_tokens=False).ids, own

    def same(self, text: str, a: list[int], b: list[int]) -> bool:
        data = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b])

    def aligned(self, chunks: list[str], a_ids: list[int], b_ids: list[int]) -> Aligned | None:
        """Groups and links of consecutive chunks whose bytes both lists have; None if a list doesn't end with a chunk."""
        a, b = np.array(a_ids, dtype="i8"), np.array(b_ids, dtype="i8")
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        end_a, end_b = dict(zip(ends_a.tolist(), range(1, len(a) + 1), strict=True)), dict(zip(ends_b.tolist(), range(1, len(b) + 1), strict=True))
        common = sorted(end_a.keys() & end_b.keys())
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), "i8", len(chunks)))
        if not all(e in end_a and e in end_b for e in ends.tolist()):
            return None
        # the common ends slice both lists into groups
        upto_a, upto_b = np.array([end_a[e] for e in common]), np.array([end_b[e] for e in common])
        group_a, group_b = (np.repeat(np.arange(len(common)), np.diff(upto, prepend=0)) for upto in (upto_a, upto_b))
        # inside a slice each end of either list closes one overlap
        closes = np.sort(np.fromiter(end_a.keys() | end_b.keys(), "i8"))
        links = a[np.searchsorted(ends_a, closes)] << ID_BITS | b[np.searchsorted(ends_b, closes)]
        last_a, last_b = np.zeros(len(a), dtype="i8"), np.zeros(len(b), dtype="i8")
        last_a[upto_a - 1], last_b[upto_b - 1] = 1, 1
        code = np.concatenate([a + len(self.a_bytes) * last_a, 2 * len(self.a_bytes) + b + len(self.b_bytes) * last_b])
        written = self.written[code[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")]].tolist()
        n_a, n_b, n_groups, n_links = (np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (ends_a, ends_b, common, closes))
        cuts = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        texts = [b"".join(written[i:j])[:-1] for i, j in zip(cuts, cuts[1:], strict=False)]
        return Aligned(np.stack([n_a, n_b, n_groups, n_links], axis=1), np.ones(len(chunks), dtype=bool), texts, links)

    def one(self, chunk: str) -> Aligned:
        """The chunk alone: nothing, if its bytes aren't those of both lists.

        Tokens leave out or change what they don't know, but never add anything: no other chunk makes up for one.
        """
        a, b = self.alone(chunk)
        found = self.aligned([chunk], a, b) if self.same(chunk, a, b) else None
        return found or Aligned(np.zeros((1, 4), dtype="i8"), np.zeros(1, dtype=bool), [b""], np.zeros(0, dtype="i8"))

    def of(self, chunks: list[str]) -> Aligned:
        """What is known of the distinct ``chunks``, in their order. Many are encoded as one text, where that is safe."""
        parts, waiting, size = [], [], 0

        def flush() -> None:
            if waiting:
                text = "".join(waiting)
                a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1)
                found = self.aligned(waiting, a, b) if self.same(text, a, b) else None
                parts.extend([found] if found else map(self.one, waiting))
                waiting.clear()

        for c in chunks:
            if c[-1] in " \t\n\r\v\f" or c.startswith("  "):
                flush()
                parts.append(self.one(c))
                size = 0
                continue
            waiting.append(c)
            size += len(c)
            if size >= TOGETHER:
                flush()
                size = 0
        flush()
        return Aligned.joined(parts)


def chunked(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, their numbers in all texts one after another, where each text ends among them)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    counts = np.zeros(len(texts), dtype="i8")
    plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    coded = plain.flatten().dictionary_encode()
    chunks, codes = [" " + w for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False).astype("i8")
    counts[~odd] = pc.list_value_length(plain).to_numpy(zero_copy_only=False)
    parts, number = [], {c: i for i, c in enumerate(chunks)} if odd.any() else {}
    for i in np.flatnonzero(odd):
        own = [" " + w for w in CHUNK.split(" " + texts[int(i)].as_py())]
        own[0] = own[0][1:]
        counts[i] = len(own)
        parts.append(np.fromiter((number.setdefault(c, len(number)) for c in own), "i8", len(own)))
    if parts:
        chunks, ends = list(number), np.cumsum(counts[~odd])
        by_text = iter(np.split(codes, ends[:-1]) if len(ends) else [])
        others = iter(parts)
        codes = np.concatenate([next(others if x else by_text) for x in odd])
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # such a text has no chunk
        ends = np.cumsum(counts)
        codes = np.delete(codes, (ends - counts)[empty])
        counts[empty] = 0
    return chunks, codes, np.cumsum(counts)


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_aligners: dict[tuple[str, str], Aligner] = {}


def _slice(aligner: Aligner, texts: pa.Array, number: int) -> tuple[list[pa.Array], dict]:
    """(the columns of a slice's rows, its pairs and which chunk has them)."""
    chunks, codes, ends = chunked(texts)
    told = aligner.of(chunks)
    begins, sizes = np.concatenate([[0], ends[:-1]]), told.counts[:, 3]
    bad = np.concatenate([[0], np.cumsum(~told.good[codes])])
    wrong = bad[ends] > bad[begins]
    digests = []
    for begin, end, lost in zip(begins.tolist(), ends.tolist(), wrong.tolist(), strict=True):
        digests.append("" if lost or begin == end else hashlib.sha256(b";".join([told.texts[c] for c in codes[begin:end].tolist()])).hexdigest())
    total = np.concatenate([np.zeros((1, 4), dtype="i8"), np.cumsum(told.counts[codes], axis=0)])
    sums = np.where(wrong[:, None], 0, total[ends] - total[begins])
    counts = ends - begins
    codes, counts = codes[~np.repeat(wrong, counts)], np.where(wrong, 0, counts)
    times, flat = np.bincount(codes, minlength=len(chunks)), told.links
    pairs, which = np.unique(flat, return_inverse=True)
    weight = np.bincount(which, weights=np.repeat(times, sizes), minlength=len(pairs)).astype("i8")
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), pa.array(codes, pa.int32())).cast(pa.list_(pa.int32()))
    rows = [pa.array(np.full(len(ends), number), pa.int64()), *(pa.array(sums[:, k]) for k in range(4)), pa.array(digests, pa.string()), lists]
    return rows, {"pairs": pairs, "times": weight, "which": which.astype("i4"), "sizes": sizes.astype("i4")}


def _sliced(docs: DataFrame, kept: list[str], text: str, a_path: str, b_path: str) -> DataFrame:
    """Rows of all documents (``kept``, as doc) by slice, with their sums and chunks, and one row a slice of its pairs."""
    spark = docs.sparkSession
    ship(spark)
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:  # a vocabulary file: a few MB, read on the driver and broadcast
            files.append(f.read())
    vocabularies = spark.sparkContext.broadcast(files)
    own = [F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("nothing")]
    rows = docs.select(F.struct(*own).alias("doc"), F.col(f"`{text}`").alias("text"))
    added = "slice long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks array<int>, pairs array<long>, times array<long>, which array<int>, sizes array<int>"
    schema = StructType([StructField("doc", rows.schema["doc"].dataType), *StructType.fromDDL(added).fields])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _aligners:
            _aligners[a_path, b_path] = Aligner(*vocabularies.value)
        number, waiting, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting).combine_chunks()
            doc, texts = table.column("doc").combine_chunks(), table.column("text").combine_chunks()
            columns, pairs = _slice(_aligners[a_path, b_path], texts, number)
            none = [pa.nulls(len(doc), t) for t in (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            own = [pa.nulls(1, doc.type), pa.array([number], pa.int64()), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32()))]
            own += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in pairs.values()]
            names = ["doc", "slice", *NUMBERS, "groups_sha256", "chunks", *pairs]
            yield pa.RecordBatch.from_arrays([doc, *columns, *none], names=names)
            yield pa.RecordBatch.from_arrays(own, names=names)

        for batch in (b for b in batches if b.num_rows):
            upto, begin = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)), 0
            while begin < batch.num_rows:  # as many rows as the slice has room for, and one at least
                before = int(upto[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto, before + SLICE_BYTES - size, side="right")))
                waiting.append(batch.slice(begin, end - begin))
                size, begin = size + int(upto[end - 1]) - before, end
                if begin < batch.num_rows or size >= SLICE_BYTES:
                    yield from flush()
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield from flush()

    return rows.mapInArrow(aligned, schema)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): both tokenizers' alignment of each text, and how often each id pair is linked in all texts.

    rows has columns ``keep`` (all but the text, by default) of each document and n_a, n_b (ids), n_groups, n_links,
    n_best (links whose pair is linked most often of all pairs of its B id, ties included), count_sum (of the links'
    counts) and groups_sha256; columns of these names are replaced. pairs has a_id, b_id, count and best.
    A null or empty text, and one whose joined tokens aren't a blank and the text, has no tokens: zeros and ''. Whole
    texts are read; repeated rows stay, and their links count each time; an empty table gives no rows.

    Pairs are summed up in slices of bounded size before anything is shuffled, so that a pair which all texts have comes
    once a slice, and no key is hot; the counts go back to the slices, not to the links.
    """
    made = [*NUMBERS, "n_best", "count_sum", "groups_sha256"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in made and (keep is not None or c != text)]
    scratch = Scratch(docs.sparkSession)
    sliced = scratch.write("slices", _sliced(docs, kept, text, a_path, b_path))
    own = sliced.where("pairs IS NOT NULL").select("slice", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "pair"))
    own = own.select("slice", "at", "pair.pairs", "pair.times")
    counts = own.groupBy("pairs").agg(F.sum("times").alias("count")).where("count > 0")
    of_b = F.col("pairs").bitwiseAND((1 << ID_BITS) - 1)
    counts = scratch.write("counts", counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(of_b))))
    back = own.join(counts, "pairs").groupBy("slice").agg(F.collect_list(F.struct("at", "count", "best")).alias("counts"))
    back = back.select("slice", F.col("counts.at").alias("at"), F.col("counts.count").alias("count"), F.col("counts.best").alias("best"))
    back = scratch.write("back", back.join(sliced.where("pairs IS NOT NULL").select("slice", "which", "sizes"), "slice", "right"))
    docs_of = sliced.where("pairs IS NULL").select("slice", "doc", *NUMBERS, "groups_sha256", "chunks")
    schema = docs_of.select("doc", *NUMBERS, "groups_sha256").schema.add("n_best", "long").add("count_sum", "long")

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        at, count, best, which, sizes = (
            right.column(c).combine_chunks().flatten().cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("at", "count", "best", "which", "sizes")
        )
        by_pair = np.zeros((int(which.max(initial=0)) + 1, 2), dtype="i8")
        by_pair[at] = np.stack([count, best], axis=1)
        links = np.concatenate([np.zeros((1, 2), dtype="i8"), np.cumsum(by_pair[which], axis=0)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        by_chunk = links[ends[1:]] - links[ends[:-1]]
        chunks = left.column("chunks").combine_chunks()
        codes = chunks.flatten().to_numpy(zero_copy_only=False)
        upto = np.concatenate([np.zeros((1, 2), dtype="i8"), np.cumsum(by_chunk[codes], axis=0)])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False))])
        sums = upto[ends[1:]] - upto[ends[:-1]]
        out = left.drop_columns(["slice", "chunks"])
        return out.append_column("n_best", pa.array(sums[:, 1])).append_column("count_sum", pa.array(sums[:, 0]))

    rows = docs_of.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(counted, schema)
    rows = rows.select(*[F.col(f"doc.`{c}`") for c in kept], *NUMBERS, "n_best", "count_sum", "groups_sha256")
    mask = (1 << ID_BITS) - 1
    pairs = counts.select(F.shiftright("pairs", ID_BITS).cast("int").alias("a_id"), F.col("pairs").bitwiseAND(mask).cast("int").alias("b_id"), "count", "best")
    return rows, pairs
