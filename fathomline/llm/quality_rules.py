"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression over the row's own text: no user functions, no shuffle. Word
lists are bound once per row (``_let``), so that no optimizer rule copies them into an inner loop.

Defined cases: a null or blank text has no words and fails; ratios over no words or no lines are 0;
very long texts are measured whole; repeated rows are judged alike; other columns pass through.
Windows of words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import SPACES

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is a for on are as at by from it this or an was which "
    "le la les de des du et un une que qui en est pour dans sur pas au par avec "
    "der die das und den von zu mit ist im ein eine nicht sich auf für dem des als auch "
    "el los las y en un una por con para no es se del al lo su"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if ``measure`` is under ``low`` or over ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Measures are SQL expressions over the counts that ``measures`` returns.
THRESHOLDS = (
    Rule("word_count", "n_words", low=20),
    Rule("word_length", "word_chars / n_words", low=2.5, high=10),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("stop_words", "n_stop_words / n_words", low=0.05),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.4),
    Rule("bullet_lines", "n_bullet_lines / n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", high=0.3),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column, size: int) -> Column:
    """Words in windows of ``size`` words that occur twice or more."""

    def repeated(hashes: Column) -> Column:
        in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]))
            return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

        def total(p: Column) -> Column:
            reach = F.transform(p, lambda at, j: F.coalesce(F.least(F.get(p, j + 1) - at, F.lit(size)), F.lit(size)))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(_let(in_order, positions), total)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) > size, _let(windows, repeated)).otherwise(F.lit(0).cast("long"))


def measures(text: Column, window: int = 8) -> Column:
    """A struct of the counts of one text."""
    has_word = r"[^\x20\x09-\x0D]"
    text = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣●]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z"))).cast("long").alias("n_ellipsis_lines"),
        )

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            _covered(words, window).alias("n_repeat_words"),
        )

    by_word = _let(F.array_remove(F.split(text, SPACES), ""), of_words)
    by_line = _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word)), of_lines)
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    return F.struct(by_word.alias("words"), by_line.alias("lines"), symbols.alias("n_symbols"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")


def _counts(m: Column) -> dict[str, Column]:
    inside = {"n_symbols": m["n_symbols"]}
    for name in ("n_words", "word_chars", "n_stop_words", "n_repeat_words"):
        inside[name] = m["words"][name]
    for name in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines"):
        inside[name] = m["lines"][name]
    return {name: inside[name] for name in COUNTS}


def compiled(rules: tuple[Rule, ...], counts: Callable[[str], Column]) -> Column:
    """The names of the failed rules, as one array expression."""

    def measure(expression: str) -> Column:
        over, _, under = expression.partition(" / ")
        return F.coalesce(counts(over) / F.when(counts(under) != 0, counts(under)), F.lit(0.0)) if under else counts(over)

    def failed(rule: Rule) -> Column:
        value = measure(rule.measure)
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value < F.lit(rule.low))
        if rule.high is not None:
            out = out | (value > F.lit(rule.high))
        return F.when(out, F.lit(rule.name))

    return F.array_compact(F.array(*[failed(r) for r in rules]))


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = THRESHOLDS, window: int = 8, out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out``: the counts, base_failed, failed (rule names) and kept."""
    columns = docs.columns
    if out.lower() in [c.lower() for c in columns]:  # names are compared as Spark does
        raise ValueError(f"{out} is a column already; name another")
    inside = [f"_{i}" for i in range(len(columns))]
    plain = docs.toDF(*inside)

    def verdict(m: Column) -> Column:
        base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        failed = compiled(rules, lambda n: m[n])
        return F.struct(*[m[n].alias(n) for n in COUNTS], base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))

    def counts(m: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in _counts(m).items()])

    # bound at each step: a filter on the verdict is pushed down as one evaluation, not one for each count
    text = F.col(inside[columns.index(text_col)])
    judged = _let(_let(measures(text, window), counts), verdict)
    return plain.select(*[F.col(a).alias(b) for a, b in zip(inside, columns, strict=True)], judged.alias(out))
