"""Operators on whole tables against brute force: near-duplicates, shards, neighbours, mixing, archives, scores."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import ann, lm, mixing, near_dup, sharding, warc


def words_of(text):
    return re.findall(r"[^ \t-\r]+", text or "")


@pytest.fixture(scope="module")
def corpus():
    """Texts of which some are copies, near copies of near copies, or share a long passage."""
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(random.choice(vocabulary) for _ in range(random.randint(5, 300))) for _ in range(120)]
    passage = " ".join(random.choice(vocabulary) for _ in range(60))
    for i in range(0, 40):
        base = texts[i % 8].split(" ")
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(base))
            base[at : at + random.randint(0, 1)] = random.choice([["new"], [], ["two", "more"]])
        texts.append(" ".join(base))
    texts += [passage + " " + " ".join(random.choice(vocabulary) for _ in range(30)) for _ in range(30)]
    return [None, "", " \n", "one two", "One  two", *texts, texts[0].upper(), texts[3]]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_near_duplicates_are_brute_forces(spark, corpus):
    df = spark.createDataFrame([(i, t, b"f", "k", 1) for i, t in enumerate(corpus)], "doc_id long, text string, fp binary, key string, n int")
    found = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    shingles = []
    for t in corpus:
        w = words_of((t or "").lower())
        shingles.append([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])
    parent = list(range(len(corpus)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(corpus)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            alike = words_of((corpus[i] or "").lower()) == words_of((corpus[j] or "").lower())
            if not alike and set(a) & set(b) and len(set(a) & set(b)) * 3 > max(len(a), len(b)):
                m = lcs(a, b)
                alike = m / (len(a) + len(b) - m) >= 0.8
            if alike and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: r.class_id for i, r in found.items()} == {i: root(i) for i in range(len(corpus))}
    assert all(r.representative == (r.doc_id == r.class_id) for r in found.values())
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_near_copies_among_thousands_with_one_long_passage(spark):
    rng, passage = random.Random(17), [f"p{i}" for i in range(120)]
    own = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    texts = []
    for _ in range(1500):
        both = own(12)
        texts += [" ".join(passage + both + own(13)) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # each text is alike to its pair (128 of 154 shingles) and not to any other (116 of 166)
    assert all(r.class_id == r.doc_id // 2 * 2 for r in near_dup.near_duplicates(df).collect())


def test_band_follows_insertions_and_stays_exact():
    rng = np.random.default_rng(5)
    for size, changes in ((400, 10), (3000, 60), (3000, 400)):
        a = rng.integers(0, 1 << 30, size).astype("u8")
        b = a.tolist()
        for at in sorted(rng.integers(0, size, changes).tolist(), reverse=True):
            b[at : at + 1] = [int(rng.integers(1 << 31, 1 << 32))] * int(rng.integers(0, 3))
        m = lcs(a.tolist(), b)
        assert near_dup._banded(a, np.array(b, "u8"), len(a) + len(b)) == m
        assert near_dup._banded(a, np.array(b, "u8"), 3 * changes + 5) == m
        want = m / (len(a) + len(b) - m)
        assert (near_dup.similarity(a, np.array(b, "u8"), 0.8) >= 0.8) == (want >= 0.8)
    same = np.array([1] * 500 + [2] * 100, "u8")
    assert near_dup._banded(same, same[50:], 60) == 550


def test_columns_of_the_result(spark):
    df = spark.createDataFrame([(1, "one two", 3, 4)], "doc_id long, text string, id int, class_id int")
    assert near_dup.near_duplicates(df).columns == ["doc_id", "class_id", "representative"]


def test_possible_pairs_miss_none(spark):
    rng = random.Random(23)
    base = [rng.randrange(1 << 16) for _ in range(120)]
    texts = []
    for _ in range(300):
        words = base[: rng.randint(80, 120)] + [rng.randrange(1 << 16) for _ in range(rng.randint(0, 40))]
        words[rng.randrange(20) : rng.randrange(20)] = [7] * rng.randint(0, 3)
        texts.append(near_dup._packed(np.array(words, "u8")))
    rows = [(i, i % 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, comp long, seq binary")
    shingles = [near_dup._rolled(t) for t in texts]
    alike = {(rows[i][0], rows[j][0]) for j in range(300) for i in range(j) if i % 7 != j % 7 and near_dup.similarity(shingles[i], shingles[j], 0.8)}
    possible = near_dup.possible_pairs(df, 0.8).collect()
    assert 100 < len(alike) and alike <= {(r.a, r.b) for r in possible}
    assert all(r.ca != r.cb and r.ca == r.a % 7 and r.a < r.b for r in possible)
    i, j = np.triu_indices(300, 1)
    n, comp = np.array([len(s) for s in shingles]), np.arange(300) % 7
    dealt = np.arange(300) % 3
    for x, y in ((0, 0), (0, 1), (1, 2)):  # a cell of a grid compares only what is dealt to its two sides
        sides = np.isin(dealt, (x, y))
        got = {tuple(sorted(p)) for a, b in near_dup._matches(np.zeros(sides.sum(), "i8"), n[sides], n[sides], comp[sides], dealt[sides], np.full(sides.sum(), (x << 16) + y), 0.8) for p in zip(np.flatnonzero(sides)[a], np.flatnonzero(sides)[b])}
        want = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= 0.8 * np.maximum(n[i], n[j])) & (np.minimum(dealt[i], dealt[j]) == x) & (np.maximum(dealt[i], dealt[j]) == y)
        assert got == set(zip(i[want], j[want]))


def test_alignment_is_the_longest_common_subsequence():
    random.seed(0)
    for _ in range(1500):
        a = [random.randint(0, random.choice([3, 50])) for _ in range(random.randint(1, 40))]
        b = list(a)
        for _ in range(random.randint(0, 6)):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 2)] = [random.randint(0, 50)] * random.randint(0, 2)
        if b:
            m = lcs(a, b)
            want = m / (len(a) + len(b) - m)
            got = near_dup.similarity(np.array(a, "u8"), np.array(b, "u8"), 0.8)
            assert got == pytest.approx(want if want >= 0.8 else 0.0)


def test_repeated_ids_and_null_ids(spark):
    text = " ".join(f"x{i}" for i in range(80))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, "other words here"), (None, "alone")], "doc_id long, text string")
    rows = near_dup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in rows) == [("5", "5"), ("5", "5"), ("7", "7"), ("None", "5"), ("None", "None")]


def test_shards_move_rows_only_into_the_new_one(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("shard"), F.lit(1).alias("slot")).unionByName(spark.createDataFrame([(None, "a", 1), (1, "b", 2)], "doc_id long, shard string, slot int"))
    for n in (16, 17, 20):
        old, new = (sharding.assign_shards(df, sharding.topology(k)) for k in (n, n + 1))
        both = old.select("doc_id", "shard").distinct().join(new.select("doc_id", F.col("shard").alias("grown")).distinct(), "doc_id")
        assert both.where("shard <> grown AND grown <> %d" % n).count() == 0
        assert 0.4 / (n + 1) < both.where("shard <> grown").count() / 3000 < 2 / (n + 1)
    dealt = sharding.number_slots(sharding.assign_shards(df, sharding.topology(16)))
    slots = collections.defaultdict(list)
    for r in dealt.collect():
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert min(map(len, slots.values())) > 100 and sharding.number_slots(sharding.assign_shards(df.limit(0), sharding.topology(16))).count() == 0


def test_slots_of_columns_named_like_helpers(spark):
    df = spark.createDataFrame([(i, 7, 8, 9, 1, 2, 3) for i in range(20)], "doc_id long, __of int, __task int, __place int, n int, task int, own_shard int")
    out = sharding.number_slots(sharding.assign_shards(df, sharding.topology(4))).collect()
    assert len(out) == 20 and all(tuple(r)[1:7] == (7, 8, 9, 1, 2, 3) for r in out)


def test_weights_confine_movement(spark):
    N = sharding.Node
    tree = lambda w: N("root", tuple(N(f"r{r}", tuple(N(f"r{r}k{k}", tuple(N(f"s{r}{k}{i}", shard=100 * r + 10 * k + i, leaf_weight=w if (r, k, i) == (1, 0, 0) else 1.0) for i in range(2))) for k in range(2))) for r in range(2)))
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    both = sharding.assign_shards(df, tree(1.0)).withColumnRenamed("shard", "a").join(sharding.assign_shards(df, tree(3.0)), "doc_id")
    assert both.where("a DIV 100 = 0 AND shard DIV 100 = 0 AND a <> shard").count() == 0
    assert both.where("a DIV 100 = 1 AND shard DIV 100 = 0").count() == 0
    assert both.where("a = 100 AND shard <> 100").count() == 0 < both.where("a <> 100 AND shard = 100").count()


def brute_nearest(rows, k):
    rows = [(i, np.array(v, dtype=float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            out[q] = sorted(((-float(x @ y), i) for i, y in rows if i != q))[:k]
    return out


def test_neighbours_with_all_probes_are_exact(spark):
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) * (1 + i % 3) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(60)] + [(500, None), (520, [0.0] * 8), (540, [float("nan")] * 8), (560, [None] * 8), (580, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, pivots=16, depth=8, cells=1.0, share=1.0, unit_rows=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(s == pytest.approx(-w[0]) for q in got for (_, s), w in zip(got[q], want[q], strict=True))
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0, 20)
    assert few.count() == 4 and ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def recall(df, **settings):
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = collections.defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, **settings).collect():
        got[r.query_id].add(r.vec_id)
    return np.mean([len(got[q] & {i for _, i in v}) / len(v) for q, v in want.items()])


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 64))
    vectors = [(i, (centres[i % 10] * 0.3 + rng.normal(size=64)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").where("vec_id % 20 <> 0 OR vec_id < 1000")
    assert recall(df) >= 0.9
    assert recall(df, share=0.02) < 0.9  # the ranking leaves most vectors out


def test_most_vectors_are_ranked_out_and_layout_changes_nothing(spark):
    rng = np.random.default_rng(6)
    vectors, pivots = rng.normal(size=(3000, 64)), rng.normal(size=(256, 64))
    orders = ann.PivotOrders(pivots, 20.0, 64)
    unit, queries = ann.Unit(orders, np.arange(3000), vectors), vectors[:40]
    near = unit.files.nearness(orders.weights(orders.of_queries(queries)))
    by_hand = [[sum(min(64 - i, 64 - list(o[:64]).index(p)) for i, p in enumerate(v[:64]) if p in o[:64]) for o in orders.of_queries(queries)[:3]] for v in orders.of_vectors(vectors[:20])]
    assert near[:20, :3].tolist() == by_hand
    bound = np.sort(near, axis=0)[-600]
    _, _, _, compared = unit.search(np.arange(40), queries, bound, 20, 192)
    assert 0.1 < compared / (40 * 3000) < 0.22
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = lambda **s: sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 500 == 0, 5, **s).collect()))
    assert rows() == rows(unit_rows=50) and len(rows()) == 30


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_neighbours_recall_on_given_tables(spark, table):
    path = f"/root/testdata/{table}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table")
    assert recall(ann.usable(spark.read.parquet(path)).withColumnRenamed("vector", "embedding")) >= 0.9


def water_level(sizes, weights, share=1.5):
    stopped = set()
    while True:
        level = (share * sum(sizes) - sum(2 * sizes[i] for i in stopped)) / max(1e-9, sum(w for i, w in enumerate(weights) if i not in stopped))
        new = {i for i, w in enumerate(weights) if i not in stopped and level * w > 2 * sizes[i]}
        if not new:
            return [2.0 * s if i in stopped else level * w for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        stopped |= new


def test_mixing_meets_targets(spark):
    random.seed(9)
    rows = [(i, random.choice(["b", "a", None, "Z", "é"]), " ".join(["w"] * random.randint(0, 60)) if i % 17 else None) for i in range(700)] + [(1, "a", "x y z")] * 5
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, source string, text string, size string, hash int")
    mixed = mixing.mix(df)
    out = mixed.collect()
    assert len(out) == len(rows)
    names = sorted({r[1] for r in rows if r[1] is not None}) + [None]
    sizes = [sum(len(words_of(t)) for _, s, t in rows if s == n) for n in names]
    want = dict(zip(names, water_level(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    taken = collections.Counter()
    for r in out:
        assert r.size == len(words_of(r.text)) and 0 <= r.taken <= 2 * r.size and r.taken == sum(c.words for c in r.copies)
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[names.index(r.source)]
        taken[r.source] += r.taken
    assert all(abs(taken[n] - want[n]) <= 6 for n in names)
    again = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(df.repartition(7)).collect())
    assert again == sorted((str(r.doc_id), r.size, r.taken) for r in out)
    copies = mixing.expand(mixed).collect()
    assert sum(len(words_of(r.text)) for r in copies) == sum(r.taken for r in out) and {r["shard"] for r in copies} <= set(range(16))
    assert mixing.mix(df.limit(0)).count() == 0


def long_md5(*parts):
    return int(hashlib.md5("/".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def test_the_draws_of_the_tree_decide_what_is_taken(spark):
    """All rows' words and shards by a plain rebuilding from the tree's quotas."""
    random.seed(4)
    rows = [(i, random.choice(["a", "b", "b", None]), " ".join(["w"] * random.randint(0, 30))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r.doc_id: r for r in mixing.mix(df, shards=5).collect()}
    sizes = {n: sum(len(words_of(t)) for _, s, t in rows if s == n) for n in ("a", "b", None)}
    targets = spark.createDataFrame([(n, sizes[n], i + 1, out[next(r[0] for r in rows if r[1] == n)].target) for i, n in enumerate(sizes)], "source string, source_size long, rank int, target double")
    found = {r.source: r for r in mixing.draw(mixing.shares(targets), 5).collect()}
    quotas = spark.createDataFrame([q for r in found.values() for q in ((2 * r["rank"] - 1, 256 * r.full), (2 * r["rank"], r.once))], "rank int, blocks long")
    dealt = {(r["rank"], r.shard): r.blocks for r in mixing.split_quotas(quotas, 5).collect()}
    for name, size in sizes.items():
        rank, goal = found[name]["rank"], round(out[next(r[0] for r in rows if r[1] == name)].target)
        full, left, drawn = goal // size, list(range(256)), []
        for shard in range(5):
            mine = sorted(left, key=lambda b: long_md5("draw", name, shard, b))[: dealt[2 * rank, shard]]
            drawn += [((j + 0.5) / len(mine), shard, b) for j, b in enumerate(mine)]
            left = [b for b in left if b not in mine]
        order = sorted(drawn) + [(2 + j, j % 5, b) for j, b in enumerate(sorted(left, key=lambda b: long_md5("spare", name, b)))]
        place, shard_of = {b: i for i, (_, _, b) in enumerate(order)}, {b: s for _, s, b in order}
        turns = sorted(range(256 * full), key=lambda n: long_md5("deal", name, n))
        full_shard, ends = {}, np.cumsum([dealt[2 * rank - 1, s] for s in range(5)])
        for i, n in enumerate(turns):
            full_shard[n] = int(np.searchsorted(ends, i, side="right"))
        assert collections.Counter(full_shard.values()) == {s: dealt[2 * rank - 1, s] for s in range(5) if dealt[2 * rank - 1, s]}
        rest = goal - full * size
        hashes = {i: long_md5(i, "mix") for i, s, _ in rows if s == name}
        for i in sorted(hashes, key=lambda i: (place[hashes[i] >> 52], hashes[i])):
            n, block = out[i].size, hashes[i] >> 52
            once = min(n, max(0, rest))
            rest -= n
            want = [(t, n, full_shard[256 * t + block]) for t in range(full) if n] + [(full, once, shard_of[block])] * (once > 0)
            assert [(c.turn, c.words, c.shard) for c in out[i].copies] == want and out[i].taken == sum(w for _, w, _ in want)
    other = {r.doc_id: r.taken for r in mixing.mix(df, shards=1).collect()}
    assert other != {i: r.taken for i, r in out.items()}  # without the tree other documents are taken
    sizes = [r["count"] for r in mixing.expand(mixing.mix(df, shards=5, whole=True), blocks=3).groupBy("shard").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == mixing.expand(mixing.mix(df, shards=5, whole=True), blocks=1).count()
    texts = {i: t for i, _, t in rows}
    assert all(r.text == texts[r.doc_id] for r in mixing.expand(mixing.mix(df, whole=True)).collect())


def test_mixing_of_clashing_names_and_very_long_texts(spark):
    names = ["words", "hash", "plan", "once", "copy", "order", "copies", "__plan", "shard"]
    df = spark.createDataFrame([(i, "s", "w " * (200_000 if i == 3 else 5), *range(9)) for i in range(20)], "doc_id long, source string, text string, " + ", ".join(f"{n} int" for n in names))
    mixed = mixing.mix(df)
    assert {r.doc_id: r.size for r in mixed.collect()}[3] == 200_000 and [r["once"] for r in mixing.expand(mixed).collect()][0] == 3


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([(1, 700), (2, 0), (3, 33), (4, 1200)], "rank int, blocks long")
    split = mixing.split_quotas(quotas, 16).collect()
    by_rank, by_shard = collections.Counter(), collections.Counter()
    for r in split:
        assert r.blocks >= 0
        by_rank[r["rank"]] += r.blocks
        by_shard[r.shard] += r.blocks
    assert [by_rank[i] for i in (1, 2, 3, 4)] == [700, 0, 33, 1200]
    assert max(by_shard.values()) - min(by_shard.values()) <= 2 and len(by_shard) == 16
    own = [r.blocks for r in split if r["rank"] == 1]
    assert 20 < np.mean(own) < 80 and np.std(own) > 0


def test_archives_round_trip(spark, tmp_path):
    random.seed(6)
    html = [None, "", "<p>é中</p>\r\n\r\nx", *["".join(random.choice("abc\r\n") for _ in range(random.randint(0, 4000))) for _ in range(60)]]
    rows = [(i, f"http://e.x/{i}\r\nX: y", h, "z") for i, h in enumerate(html)] + [(100 + i, "u", html[i % 7], "z") for i in range(30)] + [(5, "again", html[5], "z"), (None, None, html[4], "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifest = warc.write(df, str(tmp_path / "a"), roll_bytes=20_000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read(spark, str(tmp_path / "a")).collect()
    assert len(back) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    payloads = {(i, warc.base32_sha1((h or "").encode())): (h or "").encode() for i, _, h, _ in rows}
    for r in back:
        payload = payloads[r.page_id, r.payload_digest]
        assert r.payload_bytes == len(payload) and (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert bytes(r.payload) == payload and r.refers_to is None and (r.page_id is None or r.page_id == first[payload.decode()])
        else:
            assert r.refers_to == first[payload.decode()]
    assert sum(r.record_type == "response" for r in back) == len(first) + 1
    warc.write(df, str(tmp_path / "b"), roll_bytes=20_000)
    names = [sorted((r.file, r.sha256) for r in spark.read.parquet(str(tmp_path / x / warc.MANIFEST)).collect()) for x in "ab"]
    assert names[0] == names[1]
    assert warc.write(df.limit(0), str(tmp_path / "c")).count() == 0 == warc.read(spark, str(tmp_path / "c")).count()


def test_scores_are_probabilities_and_beat_the_counts(spark):
    random.seed(8)
    follow = {i: [random.randrange(200) for _ in range(3)] for i in range(200)}

    def text():
        w, out = random.randrange(200), []
        for _ in range(random.randint(0, 120)):
            out.append(f"T{w}")
            w = random.choice(follow[w]) if random.random() < 0.9 else random.randrange(200)
        return " ".join(out)

    rows = [(i, text() if i % 50 else None, 1) for i in range(900)] + [(3, "unseenword Été été", 1), (None, "T1 t1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = lm.fit_and_score(df, settings=lm.Settings(known=50, branch=8, levels=2, least_count=2)).collect()
    lowered = lambda t: words_of((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [" "]
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    counts = collections.Counter(w for i, t, _ in rows if not fold(i) for w in lowered(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lowered(t)), 6), len(lowered(t)), sum(counts[w] > 0 for w in lowered(t)), fold(i)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), round(r.base_score, 6), r.n_tokens, r.n_known, r.held_out) for r in out) == want
    assert {r.train_tokens for r in out} == {n} and all(r.score < 0 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_sums_to_one_and_scores_as_written_out(spark):
    counts = spark.createDataFrame([(f"w{i}", 100 - i) for i in range(60)] + [(lm.END, 30)], "word string, c long")
    model = lm.start(counts, lm.Settings(branch=3, levels=3, least_rows=64, most_rows=64, least_count=60, known=30))
    assert model.levels == 3 and len(model.ids) == 27 and model.rows == 64
    rng = np.random.default_rng(1)
    model.root_weights[:] = rng.normal(size=model.root_weights.shape)
    model.weights[:] = rng.normal(size=model.weights.shape)
    words, codes, lengths = [lm.END, *[f"w{i}" for i in range(60)]], np.array([3, 1, 9, 55, 2, 0, 7, 0]), np.array([6, 2])
    ids, features = model.encode(words, codes, lengths)
    scores = model.score(ids, features)
    for t, rank in enumerate(ids.tolist()):  # each factor by hand
        every = []
        for other in [*range(27), -1]:
            top = model.bias[0][0] + sum(model.root_weights[r[0]] for r in model.root_rows(features[:, t : t + 1]))
            log = top[other // 9 if other >= 0 else 3] - math.log(sum(map(math.exp, top)))
            for level, node, child in ((1, other // 9, other // 3 % 3), (2, other // 3, other % 3)) if other >= 0 else ():
                at = model.node_rows(features[:, t : t + 1], np.array([node + 3**level]))
                inner = model.bias[level][node] + sum(model.weights[r[0]] for r in at)
                log += inner[child] - math.log(sum(map(math.exp, inner)))
            every.append(log)
        assert sum(map(math.exp, every)) == pytest.approx(1.0, abs=1e-4)
        assert scores[t] == pytest.approx(every[rank], abs=1e-4)
    known = {r.word: r.c for r in counts.collect()}
    assert model.rest == pytest.approx(sum(known[w] + 0.1 for w in known if w not in model.ids) + 0.1)
    with pytest.raises(ValueError):
        lm.Settings(most_rows=1 << 17)


def test_only_ascii_letters_are_lowered():
    import pyarrow as pa

    texts = ["ÀÉ Ab", "", "ЖZ 中Q", " "]
    found = [(words, codes, counts) for _, words, codes, counts in lm._tokens(pa.array(["x", *texts, None])[1:])]
    assert [w for words, codes, _ in found for w in [words[c] for c in codes]] == ["ÀÉ", "ab", lm.END, lm.END, "Жz", "中q", lm.END, lm.END, lm.END]


def test_an_update_is_the_one_written_out():
    rng = np.random.default_rng(5)
    branch, levels, rows = 2, 3, 8
    bias = [rng.normal(size=(branch**k, branch + (k == 0))).astype("f4") for k in range(levels)]
    tables = [rng.normal(size=(rows, k)).astype("f4") for k in (branch + 1, branch)]
    model = lm.Model(lm.Settings(branch=branch, levels=levels, least_rows=8, most_rows=8), levels, rows, {}, {}, 1.0, 0.1, bias, *(t.copy() for t in tables))
    ids, features = np.array([5, -1, 0, 7, 5, 2]), rng.integers(0, 1 << 32, size=(3, 6)).astype("u4")
    squares, seen = tuple(np.full(t.shape, 1.0, "f4") for t in tables), tuple(np.zeros(rows, "i8") for _ in range(2))
    expected, total, counts = [t.astype("f8") for t in tables], [np.ones(t.shape) for t in tables], [np.zeros(rows, int) for _ in range(2)]
    for level in range(levels):  # one choice of all tokens after another, as one batch
        slopes, found = [], []
        for t, rank in enumerate(ids.tolist()):
            if level and rank < 0:
                continue
            node = rank >> (levels - level) if level else 0
            at = model.root_rows(features[:, t]) if not level else model.node_rows(features[:, t], np.full(3, node + branch**level))
            score = bias[level][node] + sum(expected[bool(level)][r] for r in at)
            slope = np.exp(score) / np.exp(score).sum()
            slope[(rank >> (levels - level - 1)) % 2 if rank >= 0 else branch] -= 1
            slopes.append(slope)
            found.append(at)
        for f in range(3):  # features in turn, of rows that several tokens share the sum
            sums = {}
            for slope, at in zip(slopes, found, strict=True):
                sums[at[f]] = sums.get(at[f], 0) + slope
                counts[bool(level)][at[f]] += 1
            for r, g in sums.items():
                total[bool(level)][r] += g * g
                expected[bool(level)][r] -= model.settings.rate * g / np.sqrt(total[bool(level)][r])
    model.train(ids, features, squares, seen)
    assert np.allclose(model.root_weights, expected[0], atol=1e-4) and np.allclose(model.weights, expected[1], atol=1e-4)
    assert (seen[0] == counts[0]).all() and (seen[1] == counts[1]).all()


def test_scores_of_no_rows_very_long_texts_and_clashing_names(spark):
    assert lm.fit_and_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b " * 100_000, 1, 2, 3), (2, None, 1, 2, 3), (3, "b a", 1, 2, 3)], "doc_id long, text string, s int, row int, kept int")
    out = {r.doc_id: r for r in lm.fit_and_score(df, settings=lm.Settings(least_count=1)).collect()}
    assert out[1].n_tokens == 200_001 and out[2].n_tokens == 1 and (out[3].s, out[3].row, out[3].kept) == (1, 2, 3)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out.values())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    random.seed(3)
    stop = ["the", "of", "and", "to"]
    texts = [" ".join(random.choice(stop) if i % 4 == 0 else f"word{random.randrange(900)}" for i in range(120)) for _ in range(30)]
    texts[5] = "write to someone@mail.example.com " + texts[5]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(50, texts[2], "en", "s1", 5), (51, None, None, None, None), (52, "short", "en", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.keep_good(spark, docs, "")
    assert sorted(r.doc_id for r in good.collect()) == [*range(30), 50]
    one = corpus_pipeline.drop_near_duplicates(spark, good, "")
    assert sorted(r.doc_id for r in one.collect()) == list(range(30))
    clean = corpus_pipeline.redact_personal_data(spark, one, "")
    changed = {r.doc_id: r.text for r in clean.collect()}
    assert "<EMAIL>" in changed[5] and all(changed[i] == texts[i] for i in range(30) if i != 5)
    mixed = corpus_pipeline.mix_sources(spark, clean, "")
    assert mixed.columns == docs.columns and sum(len(words_of(r.text)) for r in mixed.collect()) == pytest.approx(1.5 * sum(len(words_of(t)) for t in changed.values()), abs=5)
    assert corpus_pipeline.pack_windows(spark, mixed, "").count() >= mixed.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "source mixing", "packing"]


def drawn_shard(key, node):
    """The shard of a key by descending the tree level after level, in plain Python."""
    while node.children:
        node = min(node.children, key=lambda c: -math.log((long_md5(key, c.name) + 0.5) / (1 << 60)) / c.weight)
    return node.shard


def test_sharding_query_is_rebuilt_in_plain_python(spark, tmp_path):
    from tapewright.llm import queries

    texts = [None, "", "é中", *[f"text {i}" for i in range(300)]]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, "again", 1), (None, "no id", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op6_sharding(spark, str(tmp_path)).collect()
    now, grown = sharding.topology(16), sharding.topology(17)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), drawn_shard(i, now), drawn_shard(i, grown)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.grown_shard) for r in out) == want
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    random.seed(12)
    stop = ["the", "of", "and", "to"]
    good = [" ".join(random.choice(stop) if i % 4 == 0 else f"word{random.randrange(900)}" for i in range(90)) for _ in range(12)]
    rows = [(None, good[0], "en", None, 1, 7), (None, good[0], "en", None, 1, 7), (3, good[1], None, "a", None, 7), (3, good[2], "en", "a", 1, 7), (4, None, None, None, None, 7), (5, "", "en", "b", 0, 7)]
    rows += [(10 + i, t, "en", "b", 1, 7) for i, t in enumerate(good[3:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), "").count() == 0
    texts = {r.text for r in docs.collect()}
    assert texts <= set(good) and docs.where("doc_id IS NULL").select("text").distinct().count() <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(packed) >= docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_words_beyond_the_broadcast_ones_are_counted_exactly(spark):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 9 + i % 5))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, all_ = ({r.doc_id: r for r in lm.fit_and_score(df, settings=lm.Settings(known=k, branch=2, levels=2, least_count=1)).collect()} for k in (3, 1000))
    assert all(few[i].n_known == all_[i].n_known and few[i].base_score == pytest.approx(all_[i].base_score, abs=1e-9) for i in all_)
    assert all(r.score < 0 for r in few.values())
