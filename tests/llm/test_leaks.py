"""The FM-index and decontamination against plain searches."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import leaks, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def windows(words, n=10):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_ranks_and_places(seed):
    rng = random.Random(seed)
    symbols = rng.choice([1, 2, 3, 40])
    pieces = [[rng.randint(1, symbols) for _ in range(rng.choice([1, 5, 60, 73]))] for _ in range(rng.randint(1, 40))]
    pieces += pieces[:10]
    text = np.array([x for p in pieces for x in [*p, 0]], dtype="i8")
    ends = np.flatnonzero(text == 0)
    bits = max(1, symbols.bit_length())
    order = leaks.sorted_suffixes(text, ends, bits)
    distinct = text + len(ends)
    distinct[ends] = np.arange(len(ends))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: distinct[i:].tolist())
    tree = leaks.WaveletMatrix(text, bits)
    places = np.arange(len(text))
    got, rank = tree.at(places)
    assert (got == text).all() and rank.tolist() == [int((text[:i] == text[i]).sum()) for i in places]
    assert tree.rank(np.ones(len(text), dtype="i8"), places).tolist() == [int((text[:i] == 1).sum()) for i in places]
    index = leaks.FMIndex(text, ends, symbols)
    sought = [p[i : i + rng.randint(1, 8)] for p in pieces for i in [rng.randrange(len(p))]] + [[1, 1, 1, 1, 1, 1, 1], [symbols]]
    rows = np.zeros((len(sought), 8), dtype="i8")
    for i, s in enumerate(sought):
        rows[i, : len(s)] = s
    low, high = index.search(rows, np.array([len(s) for s in sought]))
    for s, a, b in zip(sought, low, high, strict=True):
        want = [i for i in range(len(text)) if text[i : i + len(s)].tolist() == s]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "中文", "a1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 4, 9, 10, 11, 40]) if i else 30)) for i in range(25)]
    items += [(3, items[4][1]), (100, items[0][1]), (None, say(12)), (101, None), (102, " .,"), (103, "the " * 30)]
    passage = items[0][1].split(" ")
    texts = [None, "", " \n!?", "w1", say(500), say(20_000) + " " + items[5][1].upper(), "X" + items[0][1], "x," + items[0][1] + ".y", "the " * 25, "THE\x00the_" * 5]
    texts += [say(30) + " -- " + "! ".join(passage[a:b]) + " " + say(5) for a, b in ((0, 30), (0, 10), (5, 14), (7, 29))]
    texts += [items[0][1]] * 30 + [say(3) + " " + x for _, x in items if x] + [f"{items[0][1]} zzz {items[0][1]}"]
    return items, texts


def expected(items, text):
    ws, phrases = words_of(text), {}
    for item, x in items:
        for w in windows(words_of(x)):
            phrases.setdefault(w, set()).add("" if item is None else str(item))
    hit, found = set(), set()
    for size in {len(w) for w in phrases}:
        for i in range(len(ws) - size + 1):
            if (w := tuple(ws[i : i + size])) in phrases:
                hit.update(range(i, i + size))
                found |= phrases[w]
    return len(ws), hit, sorted(found)


@pytest.mark.parametrize("block", [leaks.BLOCK_WORDS, 60])
def test_decontamination_is_a_plain_search(spark, tables, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
    items, texts = tables
    docs = spark.createDataFrame([(i, t, "q", 5) for i, t in enumerate(texts)] + [(None, texts[6], "q", 5)] * 2, "doc_id long, text string, found string, spans int").repartition(3)
    found = leaks.find(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == ["doc_id", "text", "found", "n_words", "spans", "items"]
    rows = found.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        n, hit, ids = expected(items, r.text)
        covered = [i for s in r.spans for i in range(s.start, s.end)]
        assert (r.n_words, sorted(hit), ids) == (n, covered, r["items"])
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    for r in leaks.remove(found.where("size(spans) > 0")).join(found.select("doc_id", F.col("text").alias("was")), "doc_id").collect():
        _, hit, _ = expected(items, r.was)
        assert words_of(r.text) == [w for i, w in enumerate(words_of(r.was)) if i not in hit]


def test_query_and_empty_tables(spark, tables, tmp_path):
    items, texts = tables
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, table in (("none", []), ("all", items)):
        spark.createDataFrame(table, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.read.parquet(f"{tmp_path}/documents.parquet").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for r in queries.op12_decontamination(spark, f"{tmp_path}/{name}").collect():
            n, hit, ids = expected(table, texts[r.doc_id])
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(ids), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert leaks.find(nothing, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_long_texts_take_several_indexes(monkeypatch):
    monkeypatch.setattr(leaks, "SHARD", 200)
    rng = random.Random(5)
    phrase = tuple("abcdefghij")
    ws = [rng.choice("abcdefghij") for _ in range(3000)]
    for at in (0, 55, 60, 64, 700, 2990):
        ws[at : at + 10] = phrase
    own = leaks.Phrases([phrase, ("a", "b")])
    ends, places, which = own.occurrences(pa.array([" ".join(ws), None, "a b"]))
    assert ends.tolist() == [3000, 3000, 3002]
    want = {(i, 0) for i in range(3000) if tuple(ws[i : i + 10]) == phrase} | {(i, 1) for i in range(2999) if ws[i : i + 2] == ["a", "b"]} | {(3000, 1)}
    assert set(zip(places.tolist(), which.tolist(), strict=True)) == want
