"""Quality rules: a table of thresholds compiled into Spark projections, without user functions or shuffles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import BLANKS, fresh, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this at are an from or not but have had he they which you we his her"
    " der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " le la les de un une et est en du des dans que qui par pour sur pas au ce il plus avec ne se sont ou"
    " el los las del y por con una su para lo como más al sus no si o este son"
).split()
SYMBOLS = "#*$%&|<>"
#: ASCII characters that are no letters and no blanks.
NO_LETTERS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())


@dataclass(frozen=True)
class Rule:
    """``least``% <= 100 * ``part`` / ``whole`` <= ``most``%; both columns of :func:`measures`."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def passed(self) -> str:
        """The rule as SQL, in whole numbers so that every engine agrees."""
        bounds = [(">=", self.least), ("<=", self.most)]
        return " AND ".join(f"100 * {self.part} {op} {bound} * {self.whole}" for op, bound in bounds if bound is not None)


#: The rules of a base text: at least 50 words, of which repeated 3-word windows hold at most half.
BASE_RULES = (Rule("words", "n_words", "one", least=5000), Rule("repeated_windows", "n_repeat_words", "n_words", most=50))
#: The verdict's own rules.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=250, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("exclamations", "n_exclamations", "n_words", most=30),
    Rule("letters", "n_letters", "word_chars", least=60),
    Rule("stop_words", "n_stop_words", "n_words", least=4),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
)


def _repeat_words(windows: str, n: str) -> Column:
    """Words covered by 3-word windows that occur at least twice, from the windows' 64-bit hashes.

    Only if two windows are equal are the windows sorted, by hash and place; those with an equal neighbour are the
    repeated ones, and each in order of place covers the words that the one before it doesn't.
    """
    return F.expr(f"""
        CASE WHEN {n} < 4 OR size(array_distinct({windows})) = size({windows}) THEN 0L ELSE
        aggregate(
          array(sort_array(transform({windows}, (h, i) -> struct(h, i)))),
          0L,
          (none, s) -> aggregate(
            sort_array(transform(filter(sequence(0, size(s) - 1), j -> get(s, j).h <=> get(s, j - 1).h OR get(s, j).h <=> get(s, j + 1).h), j -> s[j].i)),
            struct(-3 AS last, 0L AS covered),
            (a, i) -> struct(i AS last, a.covered + least(3, i - a.last) AS covered),
            a -> a.covered))
        END""")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules are about, as longs.

    n_words, word_chars (code points in words), n_symbols, n_exclamations, n_letters (code points in words but ASCII
    digits and signs), n_stop_words, n_lines (with a word), n_dup_lines (equal to an earlier line), n_ellipsis_lines,
    n_bullet_lines and n_repeat_words (in 3-word windows that occur at least twice; windows are told apart by 64-bit
    hashes). Null and empty texts have 0 of each; very long ones are measured whole. Columns of these names are replaced, others kept; rows stay.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_exclamations", "n_letters", "n_stop_words", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines", "n_repeat_words"]
    names = [c for c in docs.columns if c not in own]
    kept, words_, lines_, windows_ = [F.col(f"`{c}`") for c in names], *(fresh([*names, *own], n) for n in ("words", "lines", "windows"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.select(
        *kept,
        words(whole).alias(words_),
        F.length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(whole) - F.length(F.translate(whole, "!", ""))).cast("long").alias("n_exclamations"),
        F.length(F.translate(whole, BLANKS + NO_LETTERS, "")).cast("long").alias("n_letters"),
        F.filter(F.split(whole, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0).alias(lines_),
    )
    n = f"size({words_})"
    counted = split.select(
        *[F.col(f"`{c}`") for c in split.columns if c not in (words_, lines_)],
        F.expr(f"CAST({n} AS LONG) AS n_words"),
        F.size(F.filter(words_, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(lines_).cast("long").alias("n_lines"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines_, lambda s: s.endswith("...") | s.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(lines_, lambda s: s.startswith("- ") | s.startswith("* ") | s.startswith("• "))).cast("long").alias("n_bullet_lines"),
        F.expr(f"CASE WHEN {n} < 4 THEN array() ELSE transform(sequence(0, {n} - 3), i -> xxhash64({words_}[i], {words_}[i + 1], {words_}[i + 2])) END AS {windows_}"),
    )
    return counted.withColumn("n_repeat_words", _repeat_words(windows_, "n_words")).drop(windows_)


def verdict(measured: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` with base_failed and kept: false if a base rule fails, else whether all rules pass."""
    passed = lambda some: "(" + ") AND (".join(r.passed().replace("one", "1") for r in some) + ")"
    out = measured.withColumn("base_failed", ~F.expr(passed(base)))
    return out.withColumn("kept", ~F.col("base_failed") & F.expr(passed(rules)))


def apply_rules(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with all measures and the verdict. See :func:`measures` for nulls, empty texts and clashing names."""
    return verdict(measures(docs, text), base, rules)


def keep(ruled: DataFrame) -> DataFrame:
    """The kept rows of ``ruled``. A condition on the verdict would have the optimizer write every rule's expressions
    into it, each as often as they are referred to; a generator of one or no row leaves them where they are."""
    own = fresh(ruled.columns, "one")
    return ruled.withColumn(own, F.explode(F.when(F.col("kept"), F.array(F.lit(1))))).drop(own)
