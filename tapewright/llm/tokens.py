"""Token counts by heap-and-linked-list byte-pair merging.

The count of a text is its number of initial symbols minus the number of merges; no identifier is ever made.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import ship

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts are split in slices of about so many bytes, so that a batch of long texts needs bounded memory.
SLICE_BYTES = 8 << 20
#: Counts of segments up to this length are remembered, this many at most.
REMEMBER_LENGTH, REMEMBER = 48, 1_000_000


class MergeCounter:
    """Counts the tokens of a byte-fallback BPE vocabulary that merges by score over whole texts.

    Merges never reach across two characters that are adjacent in no piece of the vocabulary. A text is cut there, and
    the count of a text is the sum of its cuts' counts. Blanks are written as U+2581 and one is put before the text.
    """

    def __init__(self, ranks: dict[str, float]):
        self.ranks = ranks
        self.adjacent = {piece[i : i + 2] for piece in ranks for i in range(len(piece) - 1)}
        # a mark after another character starts a new segment; that holds only if no piece says otherwise
        self.by_mark = not any(b == MARK != a for a, b in self.adjacent)
        self.known: dict[str, int] = {}

    @classmethod
    def from_sentencepiece(cls, model: bytes) -> MergeCounter:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in normal})

    def merged(self, symbols: str) -> int:
        """Tokens of one uncut run of characters."""
        ranks, n = self.ranks, len(symbols)
        # a character outside the vocabulary is as many initial symbols as it has UTF-8 bytes, and merges with nothing
        count = sum(1 if c in ranks else len(c.encode()) for c in symbols)
        if n < 2:
            return count
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        parts: list[str | None] = list(symbols)
        heap = [(-ranks[pair], i, pair) for i in range(n - 1) if (pair := symbols[i : i + 2]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j < 0 or len(parts[i]) + len(parts[j]) != len(piece) or parts[i] + parts[j] != piece:
                continue  # one of the two has merged with another meanwhile
            parts[i], parts[j] = piece, None
            count -= 1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (pair := piece + parts[k]) in ranks:
                    heapq.heappush(heap, (-ranks[pair], i, pair))
            if (h := left[i]) >= 0 and (pair := parts[h] + piece) in ranks:
                heapq.heappush(heap, (-ranks[pair], h, pair))
        return count

    def segment(self, segment: str) -> int:
        """Tokens of a segment, cut where no merge can reach across; short cuts are remembered."""
        count, start, known = 0, 0, self.known
        for end in range(1, len(segment) + 1):
            if end == len(segment) or segment[end - 1 : end + 1] not in self.adjacent:
                cut = segment[start:end]
                tokens = known.get(cut)
                if tokens is None:
                    tokens = self.merged(cut)
                    if len(cut) <= REMEMBER_LENGTH:
                        if len(known) >= REMEMBER:
                            known.clear()
                        known[cut] = tokens
                count, start = count + tokens, end
        return count

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; 0 for null and empty texts."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.segment, SEGMENT.findall(marked))) if self.by_mark else self.segment(marked)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Texts of plainly separated words are counted by their distinct words."""
        out, begin = np.zeros(len(texts), dtype="i8"), 0
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8"))
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE_BYTES)))
            part = pc.fill_null(texts[begin:end].cast(pa.large_string()), "")
            odd = pc.or_(pc.match_substring(part, "  "), pc.match_substring(part, MARK))
            odd = pc.or_(odd, pc.or_(pc.starts_with(part, " "), pc.ends_with(part, " "))).to_numpy(zero_copy_only=False)
            odd = odd | (pc.binary_length(part).to_numpy(zero_copy_only=False) == 0) | (not self.by_mark)
            for i in np.flatnonzero(odd):
                out[begin + i] = self.text(part[int(i)].as_py())
            plain = np.flatnonzero(~odd)
            if len(plain):
                split = pc.split_pattern(part.take(pa.array(plain)), " ")
                coded = split.flatten().dictionary_encode()
                each = np.fromiter((self.segment(MARK + w) for w in coded.dictionary.to_pylist()), "i8", len(coded.dictionary))
                sums = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])])
                ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
                out[begin + plain] = np.diff(sums[np.concatenate([[0], ends])])
            begin = end
        return out


_counters: dict[str, MergeCounter] = {}


def _token_udf(spark, model_path: str):
    ship(spark)
    with open(model_path, "rb") as f:  # a vocabulary file: a few MB, read on the driver and broadcast
        model = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        if model_path not in _counters:
            _counters[model_path] = MergeCounter.from_sentencepiece(model.value)
        return pa.array(_counters[model_path].texts(texts))

    return tokens


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text in column ``out`` (an existing one is replaced).

    Null and empty texts have 0 tokens; rows, also repeated ones, stay as they are, and any other column is kept.
    Nothing is shuffled: each task counts its own rows, in slices of bounded size.
    """
    return docs.withColumn(out, _token_udf(docs.sparkSession, model_path)(F.col(text)))


def over_limit(docs: DataFrame, limit: int, tokens: str = "n_tokens", out: str = "over_limit") -> DataFrame:
    """Flags the rows that have more than ``limit`` tokens."""
    return docs.withColumn(out, F.col(tokens) > limit)
