"""DuckDB SQL that says the same as the registered queries, where SQL can."""

from __future__ import annotations

from tapewright.llm import quality

#: Every row of documents with a number of its own, as ids may repeat.
_ROWS = "SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents"
_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _rules(rules) -> str:
    return " AND ".join(f"({r.passed().replace('one', '1')})" for r in rules)


def _without(characters: str) -> str:
    """t without these characters."""
    return f"translate(t, '{characters.replace(chr(39), chr(39) * 2)}', '')"


def op3() -> str:
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    signs = quality.NO_LETTERS.replace("'", "''")
    return rf"""
WITH d AS ({_ROWS}),
w AS (SELECT row, doc_id, t, {_WORDS} AS ws,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
u AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT row, i, [word, lead(word, 1) OVER p, lead(word, 2) OVER p] AS three,
             lead(word, 2) OVER p IS NOT NULL AS whole FROM u WINDOW p AS (PARTITION BY row ORDER BY i)),
r AS (SELECT row, i, count(*) OVER (PARTITION BY row, three) AS c FROM g WHERE whole),
v AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY row),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             length(translate(t, {blanks}, '')) AS word_chars,
             length(t) - length({_without(quality.SYMBOLS)}) AS n_symbols,
             length(t) - length({_without('!')}) AS n_exclamations,
             length(translate(t, {blanks} || '{signs}', '')) AS n_letters,
             len([x FOR x IN ws IF x IN ({_quoted(quality.STOP_WORDS)})]) AS n_stop_words,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             len([x FOR x IN ls IF x LIKE '%...' OR x LIKE '%…']) AS n_ellipsis_lines,
             len([x FOR x IN ls IF x LIKE '- %' OR x LIKE '* %' OR x LIKE '• %']) AS n_bullet_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN v USING (row)),
b AS (SELECT *, NOT ({_rules(quality.BASE_RULES)}) AS base_failed FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {_rules(quality.RULES)} AS kept
FROM b"""


def op9() -> str:
    # base32 of the 20 bytes of a SHA-1: five bits at a time of its bit string
    return """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first, row_number() OVER (PARTITION BY h, n ORDER BY page_id) AS place FROM d),
x AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
          (CAST('0x' || substr(h, 1 + (g * 5) // 4, 2) || '' AS BIGINT) >> (8 - 5 - (g * 5) % 4)) & 31 AS INTEGER), 1), '' ORDER BY g) AS payload_digest
      FROM (SELECT DISTINCT h || '0' AS h FROM d), range(32) AS r(g) GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN place = 1 OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place = 1 OR page_id IS NULL THEN NULL ELSE first END AS refers_to
FROM f JOIN x ON x.h = f.h || '0'"""


def op11() -> str:
    told = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    record = lambda text: "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # the CRC of a decimal number, bit by bit
    bits = "list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce([4294967295] || [CAST(ascii(d) AS BIGINT) FOR d IN string_split(CAST(doc_id AS VARCHAR), '')], lambda c, b: {bits}))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def grown(name: str, leaves: str) -> str:
        """Levels of the trees over leaves (tree, place, h), and each node's list of its run."""
        return f"""{name} AS (
  SELECT tree, 0 AS level, place, h, count(*) OVER (PARTITION BY tree) AS n FROM ({leaves})
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 7) // 8)
  FROM {name} WHERE n > 1 GROUP BY tree, level, place // 8),
{name}_steps AS (
  SELECT a.tree, a.level, a.place, string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place) AS l,
         string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place) AS r
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.place // 8 = b.place // 8 WHERE a.n > 1 GROUP BY ALL)"""

    way = lambda who: f"SELECT {who}, s.level, coalesce(l, '') AS l, coalesce(r, '') AS r FROM"
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {record('text')} AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN {record(lower)} ELSE {record('text')} END AS offered FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
{grown('part', 'SELECT tree, place, leaf AS h FROM o')},
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place FROM part WHERE n = 1),
{grown('top', "SELECT 'top' AS tree, place, h FROM subroots")},
ways AS (
  {way('o.row, 0 AS above')} o JOIN part_steps s ON s.tree = o.tree AND s.place = o.place // CAST(8 ** s.level AS BIGINT)
  UNION ALL
  {way('o.row, 1 AS above')} o JOIN subroots u ON u.tree = o.tree JOIN top_steps s ON s.place = u.place // CAST(8 ** s.level AS BIGINT)),
way AS (SELECT row, list({{'l': l, 'r': r}} ORDER BY above, level) AS steps, string_agg(l || r, '' ORDER BY above, level) AS siblings FROM ways GROUP BY row),
f AS (
  SELECT doc_id, leaf, u.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
         coalesce(list_reduce([offered] || [s.l || '|' || s.r FOR s IN steps], lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))), offered) AS folded_root
  FROM o JOIN subroots u USING (tree) LEFT JOIN way USING (row))
SELECT *, folded_root = root AS verified FROM f"""


def op12() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ws = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {ws} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {ws} AS ws FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(ws)) AS size, array_to_string(ws[i:i + 9], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
o AS (SELECT row, size, i, array_to_string(ws[i:i + size - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM p))),
h AS (SELECT row, item, i, p.size FROM o JOIN p USING (size, phrase)),
n AS (SELECT row, count(DISTINCT i + k) AS n_hit FROM (SELECT row, i, unnest(range(size)) AS k FROM h) GROUP BY row),
x AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN x USING (row)"""


SQL = {"op3_quality_rules": op3(), "op9_warc": op9(), "op11_merkle_manifest": op11(), "op12_decontamination": op12()}
