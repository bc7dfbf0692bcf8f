"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

`measures` gives counts of a text, `RULES` are rows of (name, numerator, denominator, least, most), and `verdict`
compiles them into one boolean. There is no user function anywhere, and no shuffle.

A null text has no words; like an empty one it fails the rule of fewest words. Repeated rows give repeated results, an
empty table an empty result; other columns aren't read.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages served: fixed values.
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "a", "that", "for", "it", "der", "die", "das", "und", "ist", "den", "ein", "eine", "nicht", "mit", "le", "la", "les", "de", "des", "et", "est", "un", "une", "que", "el", "los", "las", "en", "y", "del", "se", "con", "por", "no"]


@dataclass(frozen=True)
class Rule:
    """least * denominator <= numerator <= most * denominator, or the row is rejected; None: no bound."""

    name: str
    numerator: str
    denominator: str | None
    least: float | None = None
    most: float | None = None


#: The base rules come first. Those of the method have wide bounds, which text in sentences keeps to.
BASE = [Rule("words", "n_words", None, least=50), Rule("repeats", "n_repeat_words", "n_words", most=0.5)]
RULES = [
    Rule("word length", "word_chars", "n_words", least=2, most=12),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("duplicate lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("capitals", "n_upper", "word_chars", most=0.4),
    Rule("stop words", "n_stop", "n_words", least=0.02),
]


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that are found twice or more in the array.

    The windows' hashes are sorted with their places; equal neighbours are the repeated ones. Their places, sorted,
    each cover three words less what the next one covers too.
    """

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        windows = F.zip_with(F.zip_with(F.slice(hashes, 1, n - 2), F.slice(hashes, 2, n - 2), lambda a, b: F.xxhash64(a, b)), F.slice(hashes, 3, n - 2), lambda a, b: F.xxhash64(a, b))
        places = lambda w: F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            m = F.size(s)
            same = F.zip_with(F.slice(s, 1, m - 1), F.slice(s, 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

        def covered(p: Column) -> Column:
            k = F.size(p)
            gaps = F.zip_with(F.slice(p, 1, k - 1), F.slice(p, 2, k - 1), lambda a, b: F.least(b - a, F.lit(3)))
            return F.when(k > 0, F.aggregate(gaps, F.lit(3), lambda total, g: total + g)).otherwise(0)

        # most texts repeat no window; then nothing is sorted
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(places(w), lambda s: let(repeated(s), covered))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= 4, of(h)).otherwise(0))


def measures(text: Column) -> dict[str, Column]:
    """Expressions for the counts of a text; words and lines are arrays to be computed once."""
    bare = F.regexp_replace(text, SPACE, "")
    length = F.char_length(text)
    return {
        "word_chars": F.char_length(bare),
        "n_symbols": length - F.char_length(F.translate(text, SYMBOLS, "")),
        "n_upper": length - F.char_length(F.regexp_replace(text, r"\p{Lu}+", "")),
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Per row: the id, its counts, base_failed, and kept: neither a base rule nor one of the method rejects it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(
        F.size(w).alias("n_words"),
        repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop"),
    ))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    counts = docs.select(F.col(id_col), of_words.alias("w"), of_lines.alias("l"), *(c.alias(k) for k, c in measures(text).items()))
    flat = counts.select(id_col, *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "w.n_stop")))
    failed = functools.reduce(operator.or_, map(broken, BASE))
    rejected = functools.reduce(operator.or_, map(broken, RULES if rules is None else rules), F.lit(False))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~rejected)


def broken(rule: Rule) -> Column:
    value, of = F.col(rule.numerator), F.lit(1) if rule.denominator is None else F.col(rule.denominator)
    bounds = [value < rule.least * of] if rule.least is not None else []
    bounds += [value > rule.most * of] if rule.most is not None else []
    return functools.reduce(operator.or_, bounds)
