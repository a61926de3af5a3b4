"""The Merkle manifest against a plain rebuilding of its trees."""

import hashlib
import string
import zlib

import pytest
from pyspark.sql import functions as F

from tapewright.llm import merkle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int, row string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, place):
    """(children before, children after) on the way up from a leaf."""
    steps = []
    for level in tree[:-1]:
        run = place // 8 * 8
        steps.append((level[run:place], level[place + 1 : run + 8]))
        place //= 8
    return steps


def rebuilt(rows):
    parts, out = {}, []
    for r in rows:
        leaf = sha(*map(told, r[:5]))
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, r))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {p: levels([x[2] for x in sorted(parts[p], key=lambda x: x[:3])]) for p in names}
    top = levels([trees[p][-1][0] for p in names])
    for at, p in enumerate(names):
        for place, (_, _, leaf, r) in enumerate(sorted(parts[p], key=lambda x: x[:3])):
            steps = way(trees[p], place) + way(top, at)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = sha(*map(told, (*r[:4], text)))
            for before, after in steps:
                h = sha(*before, h, *after)
            out.append((r[0], leaf, trees[p][-1][0], top[-1][0], sha(*[x for s in steps for x in [*s[0], *s[1]]]), h, h == top[-1][0]))
    return out


def rows_of(n):
    langs = ["en", "de", None, "", "é", "z"]
    rows = []
    for i in range(n):
        lang = langs[0] if i % 2 else langs[i % 6]
        rows.append((None if i % 71 == 70 else i, f"s{i % 3}" if i % 5 else None, lang, None if i % 7 == 0 else i, [None, "", f"Text Ä {i}", "Same"][i % 4], "x", 1, "y"))
    return rows + rows[:5]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 700])
def test_manifest_is_the_rebuilt_one(spark, tmp_path, n):
    rows = rows_of(n)[: n if n < 9 else None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, rebuilt(rows)))


def test_many_parts_of_a_row_each(spark):
    rows = [(i, "s", f"l{i:03}", i, f"T{i}", "x", 1, "y") for i in range(150)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), FIELDS, "lang", ["doc_id"], keep=["doc_id", "leaf", "row"])
    got = {r.doc_id: r for r in found.collect()}
    want = {r[0]: r for r in rebuilt(rows)}
    assert len(got) == 150 and all(got[i].leaf == want[i][1] == got[i].subroot and got[i].root == want[i][3] and got[i].verified and got[i].leaf_ == "x" for i in want)


def test_any_change_is_noticed(spark):
    rows = [(i, "s", "en", i, "text", "x", 1, "y") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    offered = {"n_chars": F.when(F.col("doc_id") == 7, F.lit(None)).otherwise(F.col("n_chars"))}
    found = merkle.manifest(docs, FIELDS, "lang", ["doc_id"], offered=offered, fan_out=3)
    assert sorted(r.doc_id for r in found.where("NOT verified").collect()) == [7]
