"""Operators on single texts against brute force: packing, personal data, quality rules, token counts."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tapewright.llm import packing, pii, quality, tokens

BLANK = re.compile(r"[^ \t-\r]+")
LONG = " ".join(f"word{i % 997}" for i in range(20_000))
TEXTS = [
    None, "", "  \n\t ", "one", "a\nb\na\n \n", "the cat sat on the mat. " * 40, LONG, "x" * 50_000, "<s> hi <|endoftext|> ▁ é 中文 \x00", "the cat sat on the mat. " * 40,
    "write to a.b+c@mail.example.com or a@b@c.d.e, call +1 (986) 555-4218 or (555) 123-4567", "1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 and 4111111111111112",
    "password=abc123def456 4465758382889437 4465758382889437", "1" * 5000 + "." + "a." * 5000 + "@", "+" * 3000 + "1 " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", i, i, "x") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", 3, 3, "x"), (None, "two words", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, length long, start long, spans string")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_packing_places_every_id_once(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    packed = packing.pack(docs, path).collect()
    by_doc, by_sequence = {}, {}
    for p in packed:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.length > 0
        by_doc.setdefault((p.doc_id, p.text), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for (doc_id, text), pieces in by_doc.items():
        copies = 2 if doc_id == 3 else 1
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want = b"".join(i.to_bytes(4, "little") for i in ids)
        for p in pieces:
            assert bytes(p.ids) == want[4 * p.start : 4 * (p.start + p.length)] and p.doc_tokens == len(ids)
        assert sum(p.length for p in pieces) == copies * len(ids)
    for pieces in by_sequence.values():
        end = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= 4096
    assert packed[0].lang == "en" and packing.pack(docs.limit(0), path).count() == 0


def test_best_fit_finds_the_tightest_window():
    random.seed(3)
    lengths = sorted((random.randint(1, 64) for _ in range(500)), reverse=True)
    windows, open_ = packing.OpenWindows(64), []
    for n in lengths:
        at, offset = windows.place(n)
        fitting = [(rest, i) for i, rest in enumerate(open_) if rest >= n]
        if fitting:
            assert open_[at] == min(fitting)[0]
            assert offset == 64 - open_[at]
            open_[at] -= n
        else:
            assert at == len(open_) and offset == 0
            open_.append(64 - n)


def test_token_counts_are_the_librarys(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counted = tokens.over_limit(tokens.count_tokens(docs, path), 4096)
    for r in counted.collect():
        assert r.n_tokens == len(library.encode(r.text or "")) and r.over_limit == (r.n_tokens > 4096)
    assert counted.count() == docs.count() and tokens.count_tokens(docs.limit(0), path).count() == 0


def test_token_counts_in_small_slices(monkeypatch):
    import pyarrow as pa
    import sentencepiece

    monkeypatch.setattr(tokens, "SLICE_BYTES", 100)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        counter = tokens.MergeCounter.from_sentencepiece(f.read())
    random.seed(5)
    texts = ["".join(random.choice(["a", "the ", " ", "\n", "é", "ing", "▁", "中", "123"]) for _ in range(random.randint(0, 40))) for _ in range(2000)]
    assert counter.texts(pa.array(texts)).tolist() == [len(x) for x in library.encode(texts)]


def brute_measures(text):
    words, lines = BLANK.findall(text or ""), [x for x in (text or "").split("\n") if BLANK.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in set(windows) if windows.count(w) > 1} if len(words) < 2000 else set()
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs):
    ruled = quality.apply_rules(docs)
    for r in ruled.collect():
        want = brute_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4]
        if r.n_words < 2000:
            assert r.n_repeat_words == want[4]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert ruled.count() == docs.count() and quality.apply_rules(docs.limit(0)).count() == 0
    assert quality.keep(ruled).count() == ruled.collect().__len__() - sum(not r.kept for r in ruled.collect())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def brute_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15
            if not bad:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_base_spans_and_redaction(docs):
    random.seed(7)
    parts = ["a.b@c.de", "@", "x@y", ".com", "1.2.3.4", "256.1.1.1", "4111111111111111", " ", "-", "+1 (986) 555-4218", "+", "12", ".", "é", "(", ")", "中"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(400)]
    texts += [t for t in TEXTS if not t or len(t) < 3000]
    df = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = pii.fit(df, sample=1000)
    for r in pii.find(df, model).collect():
        base = [tuple(s) for s in r.base_spans]
        assert base == brute_spans(r.text)
        assert set(base) <= {tuple(s) for s in r.spans}
    done = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert len(done) == len(texts) and done[texts.index(None)] is None
    assert "example.com" not in done[texts.index(TEXTS[10])] and "<EMAIL>" in done[texts.index(TEXTS[10])]


def test_long_runs_take_linear_time(docs):
    model = pii.Model(None, {})
    text = lambda n: "a" * n + " " + "1." * n + " " + "1" * n + "@" + "b." * n
    df = docs.sparkSession.createDataFrame([(1, text(1000)), (2, text(300_000))], "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.base_spans] for r in pii.find(df, model).collect()}
    assert spans[1] == brute_spans(text(1000))  # brute force would take hours for the long one
    assert spans[2]


def test_trees_compile_to_sql(spark):
    listing = "GBT (uid=x)\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     Predict: -1.0\n    Else (feature 0 > 0.5)\n     If (feature 1 <= 2.0)\n      Predict: 0.25\n     Else (feature 1 > 2.0)\n      Predict: 1.0\n"
    sql = pii.compile_trees(listing, [2.0])
    scores = [spark.sql(f"SELECT {sql} AS s FROM (SELECT array({a}D, {b}D) AS f)").first().s for a, b in ((0, 0), (1, 2), (1, 3))]
    assert scores == [-2.0, 0.5, 2.0]


def test_listing_hash(spark):
    df = spark.createDataFrame([("a@b.cd 1.2.3.4",)], "text string")
    shown = pii.find(df, pii.Model(None, {})).selectExpr(f"{pii.listing('base_spans')} AS l").first().l
    assert shown == "email:0:6,ip:7:14" and len(hashlib.sha256(shown.encode()).hexdigest()) == 64


def test_overlapping_spans_are_redacted_as_one(spark):
    texts = ["call +1.2.3.4.5678901 now", "a@b.de,c@d.fr", None, "", "é" * 5000 + " a@b.de " + "中" * 9000 + "+49 171 2345678", "none here"]
    df = spark.createDataFrame([(i, t, 1, 2, "m") for i, t in enumerate(texts)], "doc_id long, text string, __text int, spans int, m string")
    done = {r.doc_id: r for r in pii.redact(df, pii.Model(None, {})).collect()}
    assert done[0].text == "call <PHONE> now" and done[1].text == "<EMAIL>,<EMAIL>" and done[2].text is None and done[3].text == ""
    assert done[4].text == "é" * 5000 + " <EMAIL> " + "中" * 9000 + "<PHONE>" and done[5].text == texts[5]
    assert pii.redact(df, pii.Model(None, {})).columns == df.columns and (done[0]["__text"], done[0].spans, done[0].m) == (1, 2, "m")
    assert pii.find(df.limit(0), pii.Model(None, {})).count() == 0 == pii.redact(df.limit(0), pii.Model(None, {})).count()
    named = df.select("doc_id", df["text"].alias("c"), df["m"].alias("text"))
    assert pii.redact(named, pii.Model(None, {}), text="c").where("doc_id = 0").first().c == "call <PHONE> now"


def test_the_best_of_overlapping_proposals_stays(spark):
    model = pii.Model("f[5] * 0D + CASE WHEN f[2] = 1 THEN 2D ELSE 1D END", {"card": 0.5, "phone": 0.5, "secret": 0.5})
    df = spark.createDataFrame([(1, "x 0171 234 5678 4444 y password=abcdefgh1x2y3z4w z"), (2, "4111-1111-1111-1111")], "doc_id long, text string")
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df, model).collect()}
    assert spans[1] == [("card", 2, 20), ("secret", 23, 48)]  # the card's score is above the phone's
    assert spans[2] == [("card", 0, 19)]  # inside the base span nothing is added


def test_a_lost_proposal_gives_way_to_none_that_it_hid(spark):
    rows = [(0, 10, 1.0), (8, 20, 2.0), (18, 30, 3.0), (40, 50, 2.0), (45, 55, 2.0), (54, 60, 1.0), (70, 75, 1.0)]
    made = "array(" + ", ".join(f"CAST(struct({a}L, 1, {b}L, 0, {s}D) AS {pii.CANDIDATE})" for a, b, s in rows) + ")"
    stay = lambda sql: [(c.start, c.end) for c in spark.range(1).select(F.expr(sql).alias("c")).first().c]
    assert sorted(stay(pii._chosen(made))) == [(0, 10), (18, 30), (40, 50), (54, 60), (70, 75)]
    base = f"array_sort(concat({made}, array(CAST(struct(38L, 0, 56L, 0, 0D) AS {pii.CANDIDATE}))))"
    assert [x for x in stay(pii._outside(base)) if x[0] >= 38] == [(54, 60), (70, 75)]


def test_planted_loose_forms_are_found_and_others_left(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    forms = [lambda: f"{word()}@{word()}.com", lambda: f"+49 {number(3)}-{number(3)}-{number(4)}", lambda: f"{rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(256)}", lambda: f"password: {word()}{number(4)}"]
    rows = [f"{word()} {word()} contact {rng.choice(forms)()} {word()}" for _ in range(600)]
    planted = [f"call {number(3)}-{number(3)}-{number(4)} today {word()}" for _ in range(40)] + [f"the token = {word()}{number(6)} is {word()}" for _ in range(40)]
    clean = [f"{word()} chapter {rng.randrange(9)}.{rng.randrange(9)} of {number(4)}, {word()} {number(3)} {word()}" for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(rows + planted + clean)), "doc_id long, text string")
    model = pii.fit(df.where(f"doc_id < {len(rows)}"), sample=10_000)
    found = {r.doc_id: len(r.spans) for r in pii.find(df, model).collect()}
    n = len(rows)
    assert sum(found[n + i] > 0 for i in range(80)) >= 72 and sum(found[n + 80 + i] > 0 for i in range(80)) <= 4


def test_columns_named_like_helpers_are_kept(spark):
    names = ["piece", "words", "lines", "windows", "one", "n_tokens", "length"]
    df = spark.createDataFrame([(i, "the quick brown fox of the den and the day " * (20_000 if i == 1 else 9), *range(7)) for i in range(4)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    ruled = {r.doc_id: r for r in quality.apply_rules(df).collect()}
    assert ruled[1].n_words == 200_000 and (ruled[2].words, ruled[2].lines, ruled[2].windows, ruled[2].n_tokens) == (1, 2, 3, 5)
    assert quality.keep(quality.apply_rules(df)).count() == sum(r.kept for r in ruled.values())
    packed = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False, drop_text=True).collect()
    assert {(r.piece, r.words, r.n_tokens) for r in packed} == {(0, 1, 5)}
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())
    counted = tokens.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert all(r.n_tokens > 9 and r.words == 1 for r in counted)


def test_packing_leaves_little_padding(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(int(rng.paretovariate(1.1) * 60) % 9000))) for i in range(1500)] + [(None, "")] * 300, "doc_id long, text string")
    packed = packing.pack(df.repartition(3), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False, drop_text=True).collect()
    assert sum(r.length for r in packed) / (4096 * len({r.sequence_id for r in packed})) > 0.9


def test_the_fit_reads_all_texts(spark, monkeypatch):
    given, training = [], pii._training
    monkeypatch.setattr(pii, "_training", lambda texts, text: given.append(texts.count()) or training(texts, text))
    assert pii.fit(spark.range(40_000).select(F.concat(F.lit("word "), "id").alias("text"))).score is None
    assert given == [40_000]


def test_copies_weigh_as_many_as_there_are(spark):
    """Equal candidates are one row, with their number."""
    rows = [(t,) for i in range(40) for t in [f"write to user{i}@mail{i}.example.com now"] * 3]
    found = pii._training(spark.createDataFrame(rows, "text string"), "text")
    assert found.where("label = 1").groupBy().sum("n").first()[0] == 120 and found.where("label = 1").count() == 40


def test_words_met_again_are_remembered_as_written(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        ids = packing.WordIds(f.read(), True)
    first, asked = ids.of(["Some", "words,", "here"]), []
    found = ids.found
    monkeypatch.setattr(ids, "found", lambda words: asked.append(words) or found(words))
    assert ids.of(["here", "Some", "others"]) == [first[2], first[0], *ids.encode(["others"])]
    assert asked == [["others"]]
