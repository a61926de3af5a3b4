"""Packing of documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import fresh, ship

SLICE_BYTES = 2 << 20
#: Words up to this length are remembered with their ids, this many at most.
REMEMBER_LENGTH, REMEMBER = 48, 300_000
#: The letters, digits and signs into which the tokenizer splits a lower-cased word of ASCII signs and Latin letters;
#: such words are their own normal form.
LATIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
LATIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


class WordIds:
    """Token ids of texts by a tokenizer that drops blanks, so that words between blanks are encoded on their own.

    ``latin_parts`` says that the tokenizer lower-cases and splits as LATIN_PARTS does; parts are then remembered
    instead of whole words, of which there are more.
    """

    def __init__(self, tokenizer_json: bytes, latin_parts: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.latin_parts = latin_parts
        self.known: dict[str, bytes] = {}
        self.seen: dict[str, bytes] = {}
        if latin_parts:
            # the same merges for parts that are lower case and split already: blanks are all that is left to look for
            spec = json.loads(tokenizer_json)
            spec["normalizer"] = None
            spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
            self.parts = Tokenizer.from_str(json.dumps(spec))
            suffix = spec["model"]["end_of_word_suffix"]
            self.is_end = np.zeros(self.parts.get_vocab_size(), dtype=bool)
            self.is_end[[i for piece, i in self.parts.get_vocab().items() if piece.endswith(suffix)]] = True

    def encode(self, words: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in coded]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that are one word to the tokenizer: in a joined text each ends at a piece that ends a word."""
        ids = np.array(self.parts.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
        if len(ends) != len(parts):
            return self.encode(parts)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of each of the distinct ``words``, as little-endian unsigned 32-bit numbers.

        Words of earlier slices are found as they are written, before anything else is asked of them.
        """
        out = list(map(self.seen.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        if new:
            fresh_words = [words[i] for i in new]
            ids = self.found(fresh_words)
            for i, x in zip(new, ids, strict=True):
                out[i] = x
            if len(self.seen) + len(new) > REMEMBER:
                self.seen.clear()
            self.seen.update(x for x in zip(fresh_words, ids, strict=True) if len(x[0]) <= REMEMBER_LENGTH)
        return out

    def found(self, words: list[str]) -> list[bytes]:
        """The ids of words, by their parts where these are known."""
        known, keys, parts, whole = self.known, [], set(), []
        for w in words:
            if not self.latin_parts:
                keys.append(w)
                if w not in known:
                    whole.append(w)
            elif w.isalpha() and (w.isascii() or LATIN_WORD.fullmatch(w)):
                key = w.lower()
                keys.append(key)
                if key not in known:
                    parts.add(key)
            elif "<|" not in w and LATIN.fullmatch(w):
                split = LATIN_PARTS.findall(w.lower())
                keys.append(split)
                parts.update([p for p in split if p not in known])
            else:
                keys.append(w)
                if w not in known:
                    whole.append(w)
        if len(known) + len(parts) + len(whole) > REMEMBER:
            # what this slice needs is encoded anew, and the rest is forgotten
            parts.update(p for key in keys if type(key) is list for p in key)
            parts.update(key for key in keys if type(key) is str and self.latin_parts and LATIN_WORD.fullmatch(key))
            whole = [key for key in keys if type(key) is str and key not in parts]
            known.clear()
        listed = list(parts)
        known.update(zip(listed, self.encode_parts(listed), strict=True) if listed else ())
        known.update(zip(whole, self.encode(whole), strict=True) if whole else ())
        out = [known[key] if type(key) is str else b"".join([known[p] for p in key]) for key in keys]
        for key in [*listed, *whole]:
            if len(key) > REMEMBER_LENGTH:
                known.pop(key, None)
        return out

    def texts(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text, with ``end_id`` after them."""
        sizes, begin = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8")), 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE_BYTES)))
            split = pc.ascii_split_whitespace(pc.fill_null(texts[begin:end].cast(pa.large_string()), ""))
            coded = split.flatten().dictionary_encode()
            ids = self.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            each = np.fromiter((len(x) // 4 for x in ids), "i8", len(ids))
            flat = np.frombuffer(b"".join(ids), "<u4")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            starts, lengths = (np.cumsum(each) - each)[codes], each[codes]
            after = np.cumsum(lengths)
            tokens = flat[np.repeat(starts - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)]
            ends = np.concatenate([[0], after])[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
            last = 0
            for at in ends:
                yield np.append(tokens[last:at], np.uint32(end_id))
                last = at
            begin = end


_word_ids: dict[tuple[str, bool], WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, text: str = "text", latin_parts: bool = True) -> DataFrame:
    """One row per piece of a document: its ids cut into full windows and a rest.

    Adds start (ids of the document before the piece), length, ids (binary, little-endian unsigned 32-bit) and
    doc_tokens (ids of the document, with the one at its end). A null text is an empty one, of one id. Other columns
    are kept, whatever their names; columns named as the four are replaced.
    """
    ship(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:  # a vocabulary file: a few MB, read on the driver and broadcast
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("array<struct<start: long, length: long, ids: binary, doc_tokens: long>>")
    def pieces(texts: pa.Array) -> pa.Array:
        key = (tokenizer_path, latin_parts)
        if key not in _word_ids:
            _word_ids[key] = WordIds(model.value, latin_parts)
        counts, start, length, ids, total = [], [], [], [], []
        for tokens in _word_ids[key].texts(texts, end_id):
            n = len(tokens)
            for at in range(0, n, window):
                part = tokens[at : at + window]
                start.append(at)
                length.append(len(part))
                ids.append(part.tobytes())
                total.append(n)
            counts.append(-(-n // window))
        fields = pa.StructArray.from_arrays(
            [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
            names=["start", "length", "ids", "doc_tokens"],
        )
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), fields)

    kept = [c for c in docs.columns if c not in ("start", "length", "ids", "doc_tokens")]
    own = fresh(kept, "piece")
    exploded = docs.select(*[F.col(f"`{c}`") for c in kept], F.explode(pieces(F.col(f"`{text}`"))).alias(own))
    return exploded.select(*[F.col(f"`{c}`") for c in kept], f"{own}.start", f"{own}.length", f"{own}.ids", f"{own}.doc_tokens")


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree that finds the tightest one that still fits.

    Leaf c stands for the windows with c free places; a node holds the number of windows below it. Feeding pieces in
    decreasing length gives best-fit decreasing.
    """

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()  # capacities 0 to window
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def tightest(self, length: int) -> int:
        """The smallest capacity of at least ``length`` that an open window has, or -1."""
        tree, node = self.tree, length + self.leaves
        if tree[node]:
            return length
        while node > 1:  # the first subtree to the right that has a window
            if not node & 1 and tree[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.leaves:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self.leaves

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece."""
        capacity = self.tightest(length)
        if capacity < 0:
            capacity, at = self.window, self.made
            self.made += 1
        else:
            at = self.open[capacity].pop()
            self.change(capacity, -1)
        rest = capacity - length
        if rest:
            self.open[rest].append(at)
            self.change(rest, 1)
        return at, self.window - capacity


def assign_windows(pieces: DataFrame, window: int = 4096, salt: list[str] | None = None) -> DataFrame:
    """``pieces`` (with their length) with sequence_id and offset: best-fit decreasing in each shuffle partition.

    Pieces are dealt by a hash of ``salt`` (by default of all columns but binary ones), whatever their source, and
    sorted by Spark in each partition; a task streams through them and holds only the numbers of its open windows.
    Columns sequence_id and offset are replaced if they exist.
    """
    ship(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset")
    salt = salt or [c for c, kind in pieces.dtypes if kind != "binary" and not kind.startswith(("map", "variant"))]
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def best_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first = OpenWindows(window), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [windows.place(n) for n in batch.column("length").to_pylist()]
            at = np.array(placed, dtype="i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at[:, 0] + first), pa.array(at[:, 1])], names=[*batch.schema.names, "sequence_id", "offset"])

    keys = [F.col(f"`{c}`") for c in salt]
    dealt = pieces.repartition(F.xxhash64(*keys))
    return dealt.sortWithinPartitions(F.desc("length"), *keys).mapInArrow(best_fit, schema)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, text: str = "text", keep_ids: bool = True, drop_text: bool = False, latin_parts: bool = True) -> DataFrame:
    """Packs all documents: a row per piece with its place (sequence_id, offset) and ids_crc32, the CRC of its ids.

    Every id of every document is in exactly one piece, the pieces of a sequence lie one after another from offset 0,
    and what is left of a sequence up to ``window`` is padding. ``keep_ids`` keeps the ids themselves; ``drop_text``
    drops the text, so that it isn't shuffled. Other columns are kept. Empty tables
    give no rows; repeated rows are packed each for itself; ties in length are broken by the other columns. A very long
    text is read in slices and cut into full windows, all of which but its last piece fill a sequence alone.
    """
    pieces = token_pieces(docs, tokenizer_path, window, end_id, text, latin_parts).withColumn("ids_crc32", F.crc32("ids"))
    return assign_windows(pieces.drop(*[text] * drop_text, *["ids"] * (not keep_ids)), window)
