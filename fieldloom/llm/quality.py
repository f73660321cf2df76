"""Operator 2: line-first cleaning, in DataFrame functions alone.

Every line is judged by itself (punctuation, navigation, boilerplate),
failing lines go, and a document that lost too much of its text, or kept
too few words, is rejected. No shuffle: each row is judged in place.

Defined results: a null or empty text has no words, so it fails the base
rules; repeated rows are judged alike, one by one; a null doc_id is
carried through; other columns are ignored by `quality` and kept by
`cleaned`; an empty table gives an empty result. Lines without a word are
neither judged nor dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: More of these than a tenth of a line's word characters: a line of marks.
MARKS = "#*$%&|<>!=~^_{}[]\\"
#: In English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "cookie", "privacy policy", "terms of use", "terms of service",
    "lorem ipsum", "enable javascript", "click here", "subscribe", "skip to content", "powered by",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerkl", "impressum",
    "tous droits réservés", "mentions légales", "conditions d'utilisation", "politique de confidentialité",
    "todos los derechos reservados", "aviso legal", "términos de uso", "política de privacidad",
)
#: What a line of fewer than three words must end with.
TERMINAL = ".!?:;,)\"'\u2026\u3002\u00bb\u201d"
SPACES = " \t\n\x0b\x0c\r"
LEAST_KEPT, LEAST_WORDS = 0.3, 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE, -1), "")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of `width` words that the text holds twice or more."""

    def spread(at: Column) -> Column:
        step = F.aggregate(
            F.sequence(F.lit(1), F.size(at) - 1),
            F.lit(width).cast("long"),
            lambda total, k: total + F.least(F.lit(width), F.get(at, k) - F.get(at, k - 1)),
        )
        return F.when(F.size(at) < 2, F.lit(0).cast("long")).otherwise(step)

    def twice(ranked: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ranked) - 1)
        same = lambda a, b: F.get(ranked, a)["h"].eqNullSafe(F.get(ranked, b)["h"])
        kept = F.filter(at, lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(kept, lambda k: F.get(ranked, k)["i"]))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def counted(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(ranked, twice), spread))

    return let(words, lambda w: F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(let(windows(w), counted)))


def _boilerplate(text: Column) -> Column:
    def any_of(low: Column) -> Column:
        out = F.contains(low, F.lit(BOILERPLATE[0]))
        for phrase in BOILERPLATE[1:]:
            out = out | F.contains(low, F.lit(phrase))
        return out

    return let(F.lower(text), any_of)


def line_fails(line: Column, marked: Column, piped: Column, boilerplate: Column) -> Column:
    """Whether a line that has a word breaks a rule; the flags say which rules any line of the text can break."""
    chars = _without(line, SPACES)
    marks = F.length(line) - _without(line, MARKS)
    pipes = F.length(line) - _without(line, "|")
    ended = F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1)).isin(*TERMINAL)
    return (marked & (marks * 10 > chars)) | (piped & (pipes >= 3)) | (~ended & (F.size(word_list(line)) < 3)) | (boilerplate & _boilerplate(line))


def judged(docs: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed, kept, kept_text, n_lines_failed and kept_chars."""
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = lambda x: F.length(F.ltrim(x, F.lit(SPACES))) > 0
    flagged = docs.withColumns(
        {"_words": word_list(text), "_lines": F.split(text, "\n", -1), "_marked": _without(text, MARKS) < F.length(text), "_piped": F.contains(text, F.lit("|")), "_boilerplate": _boilerplate(text)}
    )
    first = flagged.withColumn("_good", F.filter("_lines", lambda x: ~worded(x) | ~line_fails(x, F.col("_marked"), F.col("_piped"), F.col("_boilerplate"))))
    own = F.filter(F.col("_lines"), worded)
    second = first.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": _without(text, SPACES).cast("long"),
            "n_symbols": (F.length(text) - _without(text, SYMBOLS)).cast("long"),
            "n_dup_lines": let(own, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
            "kept_text": F.array_join("_good", "\n"),
            "n_lines_failed": (F.size("_lines") - F.size("_good")).cast("long"),
        }
    )
    third = second.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "kept_chars": F.when(F.col("n_lines_failed") == 0, F.col("word_chars")).otherwise(_without(F.col("kept_text"), SPACES).cast("long")),
        }
    )
    whole = F.col("n_lines_failed") == 0
    enough = (F.col("kept_chars") >= LEAST_KEPT * F.col("word_chars")) & (whole | (F.size(word_list(F.col("kept_text"))) >= LEAST_WORDS))
    return third.withColumn("kept", ~F.col("base_failed") & enough).drop("_words", "_lines", "_good", "_marked", "_piped", "_boilerplate")


def quality(docs: DataFrame) -> DataFrame:
    """The verdict on each document."""
    return judged(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_failed", "kept_chars", "base_failed", "kept"
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """Kept documents, their failing lines gone; same columns."""
    # the fence keeps the filter above the projection; pushed below, it would compute everything again, several times
    out = judged(docs.select(F.struct("*").alias("_row"), "text")).withColumn("_fence", F.monotonically_increasing_id()).filter("kept and _fence >= 0")
    new = {"text": F.when(F.col("n_lines_failed") > 0, F.col("kept_text")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
