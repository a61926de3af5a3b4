"""Alignment of tokenizers against the libraries' ids of whole texts and all overlapping pairs."""

import collections
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tapewright.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "\n", "a\n b", "a \nb", "x  y 　z", "café naïve 中文 ​ x", "a▁b c", "<s> hi <|endoftext|> </s>", "\x00 a\x00", "don't we'll 123 4567,89",
    "unbelievably tokenization misalignments", "word " * 300, "x" * 5000, "👍🏽 emoji line", "﻿bom", "é é", "tab\t tab", "a\r\n\r\n b", "end ", "  a", "un​known", "ﬁne ﬂow",
]


def made_up(n):
    rng = random.Random(n)
    parts = [" ", " ", " ", "  ", "\n", "\t", "ab", "the", "Über", "1", "23", ".", ",", "'s", " ", "　", "中", "ing", "Q", "-", "_"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    stands = alignment.byte_level()
    told_a = {i: bytes(stands[c] for c in p) for p, i in a.get_vocab(with_added_tokens=False).items()}
    told_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        """Both lists of (id, start, end), or None."""
        if not text:
            return None
        out = []
        for ids, told in ((a.encode(" " + text, add_special_tokens=False).ids, told_a.get), (b.encode(text), told_b)):
            at, own, data = 0, [], b""
            for i in ids:
                own.append((i, at, at + len(told(i))))
                at += len(told(i))
                data += told(i)
            if data != (" " + text).encode():
                return None
            out.append(own)
        return out

    return tokens


def expected(texts, tokens):
    counts, links, heads = collections.Counter(), [], []
    for t in texts:
        both = tokens(t)
        if both is None:
            links.append([])
            heads.append((0, 0, 0, ""))
            continue
        a, b = both
        own = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = ["|".join(",".join(str(i) for i, _, e in side if low < e <= high) for side in both) for low, high in zip([0, *common], common)]
        links.append(own)
        counts.update(own)
        heads.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = [(h[0], h[1], h[2], len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), h[3]) for h, x in zip(heads, links, strict=True)]
    return rows, {(*p, n, n == most[p[1]]) for p, n in counts.items()}


@pytest.mark.parametrize("size", [alignment.SLICE_BYTES, 300])
def test_alignment_is_brute_forces(spark, libraries, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE_BYTES", size)
    monkeypatch.setattr(alignment, "TOGETHER", 25 if size < 1000 else alignment.TOGETHER)
    texts = TEXTS + made_up(150) + TEXTS[13:19]
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)] + [(None, None, None, None)], "doc_id long, text string, slice string, n_a long").repartition(3)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000" if size > 1000 else "7")
    found, pairs = alignment.align(docs, A, B)
    assert found.columns == ["doc_id", "slice", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted([tuple(r) for r in found.collect()], key=lambda r: (r[0] is None, r[0]))
    rows, counts = expected(texts, libraries)
    assert [r[2:] for r in got] == [*rows, (0, 0, 0, 0, 0, 0, "")]
    assert set(map(tuple, pairs.collect())) == counts
    docs.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_over_the_given_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 1500]
    found = {r.doc_id: r for r in queries.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    rows, _ = expected([r.text for r in short], libraries)
    assert len(found) == len(docs) and len(short) > 50
    for r, want in zip(short, rows, strict=True):
        f = found[r.doc_id]
        assert (f.n_a, f.n_b, f.n_groups, f.n_links, f.groups_sha256) == (*want[:4], want[6])


def test_empty_table_and_no_other_column(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)[0].count() == 0
    assert alignment.align(spark.createDataFrame([("a b",)], "text string"), A, B)[0].first().n_groups == 2


def test_chunks_make_up_the_texts():
    texts = TEXTS + made_up(300)
    chunks, codes, ends = alignment.chunked(pa.array(texts))
    assert len(set(chunks)) == len(chunks)
    for t, begin, end in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert "".join(chunks[c] for c in codes[begin:end]) == (" " + t if t else "")
