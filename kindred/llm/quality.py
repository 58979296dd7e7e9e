"""Quality rules, line first, in DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing
lines go, and a document that loses too much of its text is rejected. Document
statistics (repetition, symbols, length) are taken from the text as it came.

Defined results: null text counts as empty; an empty text has zero words, fails
the base rule and is rejected; repeated rows are judged alike; columns other
than the id and the text are never read by the rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, col, computed, id_text, let, table


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: A line with at least this many separators a word is navigation or a table.
    navigation_percent: int = 30
    #: A line of fewer words than this must have sentence punctuation.
    short_line_words: int = 3
    #: At least this share of a line's characters are letters, digits or common punctuation.
    max_odd_percent: int = 40
    #: The document goes if its kept lines have less than this share of its word characters.
    min_kept_percent: int = 50
    boilerplate: str = (
        r"(?i)(lorem ipsum|enable javascript|javascript (is )?(disabled|required)|cookie (policy|settings)|"
        r"accept (all )?cookies|privacy policy|terms of (use|service)|all rights reserved|"
        r"click here to|sign in to|log in to continue|subscribe to our newsletter|"
        r"politique de confidentialit|tous droits r.serv|conditions d.utilisation|accepter les cookies|"
        r"datenschutzerkl.rung|alle rechte vorbehalten|nutzungsbedingungen|cookies akzeptieren|"
        r"pol.tica de privacidad|todos los derechos reservados|t.rminos de uso|aceptar cookies)"
    )
    #: One of these is in the lower-cased text wherever the pattern above fits; most texts have none.
    boilerplate_parts: tuple[str, ...] = (
        "lorem ipsum", "enable javascript", "javascript is ", "javascript disabled", "javascript required", "cookie policy",
        "cookie settings", "accept cookies", "accept all cookies", "privacy policy", "terms of use", "terms of service",
        "all rights reserved", "click here to", "sign in to", "log in to continue", "subscribe to our newsletter",
        "politique de confidentialit", "tous droits r", "conditions d", "accepter les cookies", "datenschutzerkl", "alle rechte vorbehalten",
        "nutzungsbedingungen", "cookies akzeptieren", "tica de privacidad", "todos los derechos reservados", "rminos de uso", "aceptar cookies",
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != F.lit(""))


def _window_hashes(words: Column, k: int) -> Column:
    """A hash of each window's words, of which each is hashed once."""

    def combined(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - F.lit(k)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), combined)


def _covered(words: Column, k: int) -> Column:
    """Words inside windows found twice or more: exact, by sorting the windows."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - F.lit(k - 1)),
        lambda i: F.struct(F.array_join(F.slice(words, i, k), " ").alias("w"), i.alias("i")),
    )

    def repeated(pairs: Column) -> Column:
        same = lambda p, j: F.coalesce(F.get(pairs, j)["w"] == p["w"], F.lit(False))
        found = F.filter(pairs, lambda p, j: same(p, j - 1) | same(p, j + 1))
        return F.array_sort(F.transform(found, lambda p: p["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-k).cast("int").alias("last"))
    add = lambda a, p: F.struct((a["n"] + F.least(F.lit(k), p - a["last"])).alias("n"), p.alias("last"))
    return let(F.array_sort(windows), lambda pairs: F.aggregate(repeated(pairs), start, add, lambda a: a["n"]))


def repeat_words(words: Column, k: int) -> Column:
    """Words in k-word windows that the text has twice or more.

    Hashes tell in one pass whether any window can repeat at all; equal windows
    always have equal hashes, so only texts with a repeat go on to the exact,
    sorted comparison of the windows themselves.
    """
    exact = F.when(
        let(_window_hashes(words, k), lambda h: F.size(F.array_distinct(h)) < F.size(h)), _covered(words, k)
    ).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(words) >= k + 1, exact).otherwise(F.lit(0).cast("long"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def _may_have_boilerplate(text: Column, rules: QualityRules) -> Column:
    """False only if no line can match the boilerplate pattern."""
    return let(F.lower(text), lambda t: reduce(or_, (t.contains(F.lit(p)) for p in rules.boilerplate_parts)))


def line_passes(line: Column, rules: QualityRules, boilerplate: Column | None = None) -> Column:
    """Whether one line stays. Lines without a word always do: they carry no text.

    `boilerplate` may be false for lines that are known not to match that pattern.
    """
    n = _count(line, WORD)
    chars = F.char_length(_bare(line)).cast("long")
    navigation = (_count(line, r"[|»›•]") * 100 >= n * rules.navigation_percent) & (n >= 4)
    odd = _count(line, r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:!?'\"()\-]") * 100 > chars * rules.max_odd_percent
    unpunctuated = (n < rules.short_line_words) & ~line.rlike(r"[.,;:!?…'\")]")
    fits = line.rlike(rules.boilerplate)
    return (n == 0) | ~(navigation | odd | unpunctuated | (fits if boilerplate is None else boilerplate & fits))


def quality_columns(text: Column, rules: QualityRules = QualityRules()) -> dict[str, Column]:
    """The statistics of one document, from columns `_words` and `_lines` and its text."""
    words, lines = F.col("_words"), F.col("_lines")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(_bare(text)).cast("long"),
        "n_symbols": _count(text, r"[#*$%&|<>]"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(words, rules.window),
    }


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with `_clean` (kept lines), the statistics, base_failed and kept added.

    docs needs a column `text`; names that begin with an underscore are used.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = computed(
        docs,
        _words=_words(text),
        _all=F.split(text, "\n"),
        _maybe=_may_have_boilerplate(text, rules),
    )
    split = computed(split, _lines=F.filter("_all", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    clean = F.array_join(F.filter("_all", lambda x: line_passes(x, rules, F.col("_maybe"))), "\n")
    out = computed(split, **quality_columns(text, rules), _clean=clean).drop("_words", "_all", "_lines", "_maybe")
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    enough = F.char_length(_bare(F.col("_clean"))) * 100 >= F.col("word_chars") * rules.min_kept_percent
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: statistics, base verdict, verdict and the cleaned text."""
    out = judge(id_text(docs), rules)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*names, F.col("_clean").alias("clean_text"))


def clean_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs without rejected documents and without failing lines; the same columns.

    A column n_chars, if there, follows the cleaned text.
    """
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), F.col("text"))
    good = judge(packed, rules).where("kept")
    put = {"text": F.col("_clean"), "n_chars": F.char_length("_clean").cast("long")}
    return good.select(*[put.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("clean_text")
