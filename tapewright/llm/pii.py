"""Personal data by candidate gradient boosting, with DataFrame and SQL functions only.

Base spans have an exact form and pass its check. Beside them, generators of high recall propose spans of looser form,
which may overlap; boosted trees score these by their format and context, a threshold for each kind, calibrated on
held-out candidates, selects, and of selected ones that overlap the best stays. The trees are fitted by Spark on the
candidates of all texts, counted by their features, and compiled into one SQL expression, so that a document's spans,
scores and redaction are made in projections of its own row: only candidates for the fit are exploded and shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import cut, fresh, md5_long

#: In the order of ties.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The base forms. Runs are possessive and begin where a run begins or the last match ended, which finds what plain
#: repetition would, without trying each character of a long run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, which overlap each other and the base forms. Runs are as long as they go.
LOOSE = {
    "email": r"(?:\G|(?<![^\s@<>()\[\],;:\"']))[^\s@<>()\[\],;:\"']++@[^\s@<>()\[\],;:\"']{3,}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3,5}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{2,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "secret": r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\x20{0,2}[=:]\x20{0,2}\"?[A-Za-z0-9+/_.-]{8,}+\"?|\bAKIA[0-9A-Z]{16}\b",
}
#: What a text must have for a form to be in it at all; cheap to look for.
NEEDS = {"email": "contains({t}, '@')", "ip": "{t} RLIKE '[0-9]'", "card": "{t} RLIKE '[0-9]'", "phone": "contains({t}, '+')", "secret": "(contains({t}, '=') OR contains({t}, ':') OR contains({t}, 'AKIA'))"}
LOOSE_NEEDS = NEEDS | {"phone": "{t} RLIKE '[0-9]'"}
KEYWORDS = r"(?i)mail|phone|tel|call|fax|card|visa|credit|ip\b|address|password|token|secret|key|contact"
BLOCK = 4096
CHUNK = 128

DIGITS = "regexp_replace({m}, '[^0-9]', '')"
DIGIT = "CAST(substring({d}, length({d}) - i + 1, 1) AS BIGINT)"
LUHN = (
    "CASE WHEN length({d}) BETWEEN 12 AND 19 THEN aggregate(sequence(1, length({d})), 0L, (a, i) -> a + CASE WHEN i % 2 = 1 "
    f"THEN {DIGIT} ELSE (2 * {DIGIT}) DIV 10 + (2 * {DIGIT}) % 10 END) % 10 = 0 ELSE false END"
)
OCTETS = r"({m} RLIKE '^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})){{3}}$')"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(value: str, name: str, then: str) -> str:
    """SQL: ``then`` with ``value`` under a name, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _luhn(m: str) -> str:
    return _bind(DIGITS.format(m=m), "d", LUHN.format(d="d"))


def _passes(kind: str, m: str) -> str:
    """SQL: whether a match of a base form passes its check."""
    if kind == "ip":
        return OCTETS.format(m=m)
    if kind == "card":
        return f"(length({m}) <= 40 AND length({DIGITS.format(m=m)}) BETWEEN 14 AND 19 AND {_luhn(m)})"
    if kind == "phone":
        return f"(length({DIGITS.format(m=m)}) BETWEEN 10 AND 15)"
    return "true"


def features(kind: str, m: str, before: str, after: str) -> list[str]:
    """SQL of a candidate's features of format and context, as doubles."""
    count = lambda what: f"CAST(length(regexp_replace({m}, {_quote(f'[^{what}]')}, '')) AS DOUBLE)"
    flag = lambda condition: f"CAST(coalesce({condition}, false) AS DOUBLE)"
    is_kind = [flag(f"{kind} = '{k}'") for k in KINDS]
    format_ = [f"CAST(length({m}) AS DOUBLE)", count("0-9"), count("A-Za-z"), count("."), count(r"\x20()\-"), flag(_luhn(m)), flag(OCTETS.format(m=m))]
    domain = flag(f"{m} RLIKE {_quote(r'@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}$')}")
    distinct = f"CAST(size(array_distinct(split({m}, ''))) AS DOUBLE) / greatest(1, length({m}))"
    context = [flag(f"{before} RLIKE '[A-Za-z0-9]$'"), flag(f"{after} RLIKE '^[A-Za-z0-9]'"), flag(f"{before} RLIKE {_quote(KEYWORDS)}")]
    return [*is_kind, *format_, domain, distinct, *context]


@dataclass(frozen=True)
class Model:
    """Boosted trees as SQL over an array ``f`` of features, and each kind's least score; none adds nothing."""

    score: str | None
    least: dict[str, float]

    def scored(self, kind: str, m: str, before: str, after: str) -> str:
        """SQL: a candidate's score, or null if that is below the kind's threshold."""
        if self.score is None or kind not in self.least:
            return "CAST(NULL AS DOUBLE)"
        score = _bind(f"array({', '.join(features(f"'{kind}'", m, before, after))})", "f", self.score)
        return _bind(score, "s", f"CASE WHEN s >= {self.least[kind]!r}D THEN s END")


def compile_trees(debug: str, weights: list[float]) -> str:
    """SQL of boosted trees from the listing that Spark gives of them."""
    trees: list[list[str]] = []
    for line in debug.splitlines()[1:]:
        trees.append([]) if line.strip().startswith("Tree ") else trees[-1].append(line.strip())

    def node(lines: list[str]) -> str:
        line = lines.pop(0)
        if m := re.fullmatch(r"Predict: (\S+)", line):
            return f"{float(m[1])!r}D"
        feature, bound = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node(lines)
        lines.pop(0)  # Else
        return f"CASE WHEN f[{feature}] <= {float(bound)!r}D THEN {low} ELSE {node(lines)} END"

    return "(" + " + ".join(f"{w!r}D * ({node(t)})" for w, t in zip(weights, trees, strict=True)) + ")"


def _matched(t: str, pattern: str, needs: str) -> tuple[str, str]:
    """SQL of the matches of a pattern in a text and the pieces between them, one more; none for most texts."""
    found = f"CASE WHEN {needs.format(t=t)} THEN regexp_extract_all({t}, {_quote(pattern)}, 0) ELSE CAST(array() AS array<string>) END"
    return found, f"split({t}, {_quote(pattern)}, -1)"


PLACES = "array<struct<start: bigint, end: bigint, m: string, before: string, after: string>>"
EMPTY = f"CAST(array() AS {PLACES})"


def _places(m: str, p: str) -> str:
    """SQL: (start, end, m, before, after) of each match, in code points. Lists grow in chunks, in linear time."""
    one = f"struct(c.pos + length({p}[i]) AS start, c.pos + length({p}[i]) + length({m}[i]) AS end, {m}[i] AS m, right({p}[i], 24) AS before, left({p}[i + 1], 1) AS after)"
    kind = PLACES
    chunk = f"""aggregate(sequence(b, least(b + {CHUNK - 1}, size({m}) - 1)), struct(a.pos AS pos, CAST(array() AS {kind}) AS out),
        (c, i) -> struct(c.pos + length({p}[i]) + length({m}[i]) AS pos, concat(c.out, array({one})) AS out))"""
    whole = f"""flatten(aggregate(sequence(0, size({m}) - 1, {CHUNK}), struct(0L AS pos, CAST(array() AS array<{kind}>) AS out),
        (a, b) -> {_bind(chunk, "r", "struct(r.pos AS pos, concat(a.out, array(r.out)) AS out)")}, a -> a.out))"""
    return f"CASE WHEN size({m}) = 0 THEN CAST(array() AS {kind}) ELSE {whole} END"


def _base(t: str, kind: str) -> str:
    """SQL: the base spans of a kind, with their places, of a text."""
    found, pieces = _matched(t, BASE[kind], NEEDS[kind])
    return _bind(found, "m", f"CASE WHEN size(m) > 0 THEN {_bind(pieces, 'p', f'filter({_places("m", "p")}, c -> {_passes(kind, "c.m")})')} ELSE {EMPTY} END")


def _loose(t: str, kind: str) -> str:
    """SQL: the candidates of a kind of looser form, with their places, of a text."""
    found, pieces = _matched(t, LOOSE[kind], LOOSE_NEEDS[kind])
    return _bind(found, "m", f"CASE WHEN size(m) > 0 THEN {_bind(pieces, 'p', _places('m', 'p'))} ELSE {EMPTY} END")


def _folded(items: str, state: str, step: str, last: str, kind: str) -> str:
    """SQL: what a fold over sorted ``items`` gives out, in linear time: lists grow in chunks.

    ``state`` is the SQL of the first state. ``step`` speaks of state a and item x and gives a state and a list of what is
    given out; ``last``, of state a, gives the list at the end.
    """
    one = f"element_at(transform(array({step}), r -> struct(r.state AS state, concat(c.out, r.out) AS out)), 1)"
    chunk = f"""aggregate(slice(v, b + 1, {CHUNK}), struct(w.state AS state, CAST(array() AS array<{kind}>) AS out),
        (c, x) -> {_bind("c.state", "a", one)})"""
    whole = f"""aggregate(sequence(0, size(v) - 1, {CHUNK}), struct({state} AS state, CAST(array() AS array<array<{kind}>>) AS out),
        (w, b) -> {_bind(chunk, "k", "struct(k.state AS state, concat(w.out, array(k.out)) AS out)")},
        w -> {_bind("w.state", "a", f"concat(flatten(w.out), {last})")})"""
    return _bind(items, "v", f"CASE WHEN size(v) = 0 THEN CAST(array() AS array<{kind}>) ELSE {whole} END")


SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string>"
CANDIDATE = "struct<start: bigint, base: int, end: bigint, rank: int, score: double>"


def _outside(candidates: str) -> str:
    """SQL: of ``candidates`` and base spans (base = 0), sorted by start, the candidates that no base span holds whole."""
    nothing = f"CAST(array() AS array<{CANDIDATE}>)"
    step = f"""CASE WHEN x.base = 0 THEN struct(greatest(a, x.end) AS state, {nothing} AS out)
        WHEN x.end <= a THEN struct(a AS state, {nothing} AS out) ELSE struct(a AS state, array(x) AS out) END"""
    return _folded(candidates, "-1L", step, nothing, CANDIDATE)


def _chosen(candidates: str) -> str:
    """SQL: of ``candidates``, sorted by start, those that stay: the best first, and all that overlap none that stays.

    Candidates that hang together by overlaps are taken up together; of equal scores the first one goes before.
    """
    nothing, chains = f"CAST(array() AS array<{CANDIDATE}>)", f"struct<reach: bigint, chain: array<{CANDIDATE}>>"
    ranked = "array_sort(transform(a.chain, c -> struct(-c.score AS by, c AS c)))"
    best = f"aggregate({ranked}, {nothing}, (o, r) -> IF(exists(o, k -> r.c.start < k.end AND k.start < r.c.end), o, concat(o, array(r.c))))"
    settled = f"CASE WHEN size(a.chain) < 2 THEN a.chain ELSE {best} END"
    step = f"""CASE WHEN x.start < a.reach THEN struct(CAST(struct(greatest(a.reach, x.end) AS reach, concat(a.chain, array(x)) AS chain) AS {chains}) AS state, {nothing} AS out)
        ELSE struct(CAST(struct(x.end AS reach, array(x) AS chain) AS {chains}) AS state, {settled} AS out) END"""
    return _folded(candidates, f"CAST(struct(-1L AS reach, {nothing} AS chain) AS {chains})", step, settled, CANDIDATE)


def _united(spans: str) -> str:
    """SQL: ``spans``, sorted by start, with those that overlap united under the kind of the first."""
    step = f"""CASE WHEN a IS NULL THEN struct(x AS state, CAST(array() AS array<{SPAN}>) AS out)
        WHEN x.start < a.end THEN struct(struct(a.start AS start, a.rank AS rank, greatest(a.end, x.end) AS end, a.kind AS kind) AS state, CAST(array() AS array<{SPAN}>) AS out)
        ELSE struct(x AS state, array(a) AS out) END"""
    return _folded(spans, f"CAST(NULL AS {SPAN})", step, f"IF(a IS NULL, CAST(array() AS array<{SPAN}>), array(a))", SPAN)


def _training(texts: DataFrame, text: str) -> DataFrame:
    """Labelled candidates (kind, m, before, after, n, label) by distant supervision; n texts' places have the same.

    Base spans are personal data, as are phone numbers without their prefix and assigned values that mix letters and
    digits. The same spans made invalid are not: cards of a wrong check digit, addresses with a number above 255 or no
    domain, phone numbers broken by letters, assigned plain words.
    """
    told = lambda kind, spans: f"transform({spans}, c -> struct('{kind}' AS kind, c.m AS m, c.before AS before, c.after AS after))"
    t = f"coalesce(`{text}`, '')"
    secrets = f"filter({_loose(t, 'secret')}, c -> c.m RLIKE '[0-9]' AND c.m RLIKE '[A-Za-z]')"
    spans = F.expr("concat(" + ", ".join([*(told(k, _base(t, k)) for k in BASE_KINDS), told("secret", secrets)]) + ")")
    good = cut(texts.select(F.explode(spans).alias("c")).select("c.*").groupBy("kind", "m", "before", "after").agg(F.count("*").alias("n")))
    short = good.where("kind = 'phone'").withColumn("m", F.regexp_replace("m", r"^\+[0-9]+[ ().-]*", ""))
    digits, shifted = "0123456789", "1234567890"
    broken = F.when(F.col("kind") == "card", F.translate("m", digits, shifted)).when(F.col("kind") == "ip", F.regexp_replace("m", r"^[0-9]+", "300"))
    broken = broken.when(F.col("kind") == "email", F.regexp_replace("m", r"[.]", "")).when(F.col("kind") == "phone", F.translate("m", "-5", "xq"))
    bad = good.withColumn("m", broken.otherwise(F.translate("m", digits, "abcdefghij")))
    bad = bad.where("NOT (kind = 'card' AND " + _luhn("m") + ")")
    return good.unionByName(short).withColumn("label", F.lit(1.0)).unionByName(bad.withColumn("label", F.lit(0.0)))


def fit(docs: DataFrame, text: str = "text", sample: int | None = None, precision: float = 0.95, trees: int = 10, depth: int = 3) -> Model:
    """Boosted trees fitted on the candidates of all texts; with ``sample``, of about so many distinct ones by their hash.

    Candidates of equal features are one row that weighs as many as there are, so that trees, each candidate's part in
    them and thresholds are those of the whole table, and what is fitted on grows with the distinct features only. Four
    fifths of the candidates fit the trees; on the others each kind's threshold is the least score above which at least
    ``precision`` of the candidates are personal data. Kinds, or tables, without both labels add nothing. Null texts are
    empty; very long ones are looked through whole.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    chosen = docs.select(F.col(f"`{text}`"))
    if sample is not None:
        chosen = docs.where(F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(max(docs.count(), 1))) < sample).select(F.col(f"`{text}`")).distinct()
    names = [f"f{i}" for i in range(len(features("kind", "m", "before", "after")))]
    row = F.expr(f"array({', '.join(features('kind', 'm', 'before', 'after'))})").alias("f")
    labelled = _training(chosen, text).select("kind", "label", F.pmod(md5_long("m", "before", "after"), F.lit(5)).alias("fold"), "n", row)
    labelled = labelled.select("kind", "label", "fold", "n", *[F.col("f")[i].alias(name) for i, name in enumerate(names)])
    labelled = cut(labelled.groupBy("kind", "label", "fold", *names).agg(F.sum("n").cast("double").alias("n")))
    counts = {r["label"]: r["count"] for r in labelled.where("fold > 0").groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(None, {})
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(labelled)
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=1, maxBins=32, weightCol="n").fit(ready.where("fold > 0"))
    score = compile_trees(fitted.toDebugString, list(fitted.treeWeights))
    scored = labelled.where("fold = 0").select("kind", "label", "n", F.expr(_bind(f"array({', '.join(names)})", "f", score)).alias("score"))
    levels = scored.groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each score
    passed = levels.withColumn("precision", F.sum("good").over(above) / F.sum("n").over(above)).where(F.col("precision") >= precision)
    return Model(score, {r["kind"]: r["least"] for r in passed.groupBy("kind").agg(F.min("score").alias("least")).collect()})


def find(docs: DataFrame, model: Model, text: str = "text", overlapping: bool = False) -> DataFrame:
    """``docs`` with base_spans and spans, arrays of (start, rank, end, kind) by start and kind, in code points.

    ``spans`` has the base spans and those that the model adds: of candidates that overlap the best stay, or, if
    ``overlapping`` is set, all. Null and empty texts have none, very long ones are looked through whole. Rows stay, also
    repeated ones, columns of the two names are replaced and others kept, whatever their names.
    """
    kept = [c for c in docs.columns if c not in ("base_spans", "spans")]
    own, t = (fresh([*kept, "base_spans", "spans"], n) for n in ("found", "whole_text"))
    span = lambda k: f"CAST(struct(c.start, {KINDS.index(k)}, c.end, '{k}') AS {SPAN})"
    listed = ", ".join(f"transform({_base(t, k)}, c -> {span(k)})" for k in BASE_KINDS)
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))
    df = df.withColumn("base_spans", F.expr(f"array_sort(concat({listed}))"))
    kinds = [k for k in LOOSE if model.score is not None and k in model.least]
    if not kinds:
        return df.withColumn("spans", F.col("base_spans")).drop(t)
    scored = [f"transform({_loose(t, k)}, c -> CAST(struct(c.start, 1, c.end, {KINDS.index(k)}, {model.scored(k, 'c.m', 'c.before', 'c.after')}) AS {CANDIDATE}))" for k in kinds]
    df = df.withColumn(own, F.expr(f"filter(concat({', '.join(scored)}), c -> c.score IS NOT NULL)"))
    base = f"transform(base_spans, c -> CAST(struct(c.start, 0, c.end, c.rank, 0D) AS {CANDIDATE}))"
    outside = _outside(f"array_sort(concat({own}, {base}))")
    df = df.withColumn(own, F.expr(f"CASE WHEN size({own}) = 0 THEN {own} ELSE {outside if overlapping else _chosen(outside)} END"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    added = f"transform({own}, c -> CAST(struct(c.start, c.rank, c.end, {names}[c.rank]) AS {SPAN}))"
    return df.withColumn("spans", F.expr(f"array_sort(concat(base_spans, {added}))")).drop(own, t)


def listing(spans: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with all that a base span or an accepted candidate covers replaced: those that overlap are one, named by the
    first's kind.

    Null texts stay null. Spans are those of the text as it was, so that no replacement hides or makes another.
    """
    kept = docs.columns
    spans, whole = fresh([*kept, "base_spans", "spans"], "all"), fresh([*kept, "base_spans", "spans"], "one")
    found = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(whole), F.col(f"`{text}`").alias("text")), model, overlapping=True)
    # pieces are cut out of short blocks, since places in a text are found by counting from its start
    piece = lambda a, b: f"substring(array_join(slice(k, CAST(({a}) DIV {BLOCK} AS INT) + 1, CAST(({b} - 1) DIV {BLOCK} - ({a}) DIV {BLOCK} AS INT) + 1), ''), CAST(({a}) % {BLOCK} AS INT) + 1, CAST({b} - ({a}) AS INT))"
    part = f"concat(IF(u[i].start > IF(i = 0, 0L, u[i - 1].end), {piece('IF(i = 0, 0L, u[i - 1].end)', 'u[i].start')}, ''), '<', upper(u[i].kind), '>')"
    rest = f"IF(element_at(u, -1).end < length(text), {piece('element_at(u, -1).end', 'length(text)')}, '')"
    joined = f"concat(array_join(transform(sequence(0, size(u) - 1), i -> {part}), ''), {rest})"
    blocks = _bind(f"regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0)", "k", joined)
    changed = F.expr(f"CASE WHEN size(spans) = 0 THEN text ELSE {_bind(_united('spans'), 'u', blocks)} END")
    out = found.select(whole, changed.alias(spans))
    return out.select(*[F.col(spans).alias(c) if c == text else F.col(whole)[c].alias(c) for c in kept])


__all__ = ["Model", "find", "fit", "listing", "redact"]
