"""Quality rules, lines first: bad lines are taken out, then documents that lost too much are refused.

Built-in column functions only: no row leaves the JVM and nothing is shuffled, so hot sources, copies and
very long texts need no care. Repeated 3-word windows are found by sorting a document's window hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of

MIN_WORDS = 50
#: Words in repeated 3-word windows, in hundredths of all words, above which a document fails.
MAX_REPEATED = 50
#: Share of its word characters that a document may lose with its bad lines.
MAX_LOST = 0.5

# The line rules.
SYMBOLS = r"[#*$%&|<>]"
#: A line fails if so many hundredths of its word characters are symbols.
MAX_SYMBOLS = 20
#: A word that ends in repeated or odd punctuation; a line fails if most of its words do.
SHOUTED = r"([!?]{2}|[#*$%&]{2})\z"
#: Bars, arrows and bullets: a line of short labels between two or more of them fails.
BARS = "[|»›•·>]"
LABEL = 40
#: Lines that are a menu entry and nothing else.
MENU = r"(?i)^\s*(home|menu|search|login|log in|sign in|sign up|register|contact( us)?|about( us)?|back to top|next|previous|read more|share|print|skip to (main )?content)\s*[.:!]?\s*$"
BOILERPLATE = (r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|(uses?|accept) (all )?cookies|"
               r"enable javascript|subscribe to (our|the) newsletter|click here to|lorem ipsum dolor|powered by wordpress)")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _navigation(line: Column) -> Column:
    """Labels of 1 to LABEL characters; white space before the first does not count, and the last may be empty.

    Parts are compared one by one: a regular expression that repeats a group would need a stack as deep as the line has labels.
    """

    def labels(parts: Column) -> Column:
        inner = F.forall(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.length(x).between(1, LABEL))
        first = F.get(parts, F.lit(0))
        return ((F.size(parts) >= 3) & (F.length(first) > 0) & (F.length(F.regexp_replace(first, f"^{SPACE}+", "")) <= LABEL)
                & (F.length(F.element_at(parts, -1)) <= LABEL) & inner)

    return F.exists(F.array(F.split(line, BARS)), labels)


def _line_failed(line: Column, words: Column, chars: Column) -> Column:
    shouted = F.size(F.filter(words, lambda x: x.rlike(SHOUTED)))
    return (
        (F.regexp_count(line, F.lit(SYMBOLS)) * 100 > chars * MAX_SYMBOLS)
        | ((F.size(words) >= 3) & (shouted * 2 > F.size(words)))
        | _navigation(line) | line.rlike(MENU.replace(r"\s*", r"\s*+")) | ((F.size(words) <= 30) & line.rlike(BOILERPLATE))
    )


def measure(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any others): counts, what the line rules removed, the cleaned text, the verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines (with a word),
    n_bad_lines, kept_chars (word characters of the good lines), clean_text (good lines), kept. A null or empty text has
    no words: it fails. Texts, lines and words may be of any length: each rule takes time in proportion to it. Equal rows get equal results, ids may be null or repeat, other columns are not read.
    """
    line_of = F.transform(F.col("w_lines"), lambda x: F.struct(x.alias("line"), words_of(x).alias("words")))
    measured = (
        docs.select("doc_id", text_of().alias("w_text"))
        .select("doc_id", "w_text", words_of(F.col("w_text")).alias("w"), F.split("w_text", "\n").alias("w_lines"))
        .select("doc_id", "w_text", "w", F.filter(line_of, lambda x: F.size(x["words"]) > 0).alias("w_lines"))
        .select("doc_id", "w_text", "w", F.size("w").alias("n"), F.transform("w_lines", lambda x: x["line"]).alias("w_plain"),
                F.transform("w_lines", lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"),
                                                          _total(F.transform(x["words"], F.length)).alias("chars"))).alias("w_lines"))
        .withColumn("w_grams", F.when(F.col("n") < 3, F.array().cast("array<struct<g:bigint,i:int>>")).otherwise(F.transform(
            F.slice("w", 1, F.greatest(F.col("n") - 2, F.lit(1))),
            lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.alias("i")))))
        .withColumn("w_sorted", F.sort_array("w_grams"))
        .withColumn("w_found", F.sort_array(F.transform(F.filter(
            "w_sorted", lambda x, i: F.coalesce(F.get("w_sorted", i + 1)["g"] == x["g"], F.lit(False))
            | F.coalesce(F.get("w_sorted", i - 1)["g"] == x["g"], F.lit(False))), lambda x: x["i"])))
        # A start covers three words, or as many as lie before the next start.
        .withColumn("n_repeat_words", _total(F.transform(
            "w_found", lambda x, i: F.least(F.coalesce(F.get("w_found", i + 1) - x, F.lit(3)), F.lit(3)))))
        .withColumn("w_lines", F.transform("w_lines", lambda x: F.struct(
            x["line"].alias("line"), x["chars"].alias("chars"), _line_failed(x["line"], x["words"], x["chars"]).alias("bad"))))
    )
    good = F.filter("w_lines", lambda x: ~x["bad"])
    counted = measured.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        _total(F.transform("w_lines", lambda x: x["chars"])).alias("word_chars"),
        F.regexp_count("w_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("w_plain") - F.size(F.array_distinct("w_plain"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("w_lines").cast("long").alias("n_lines"),
        F.size(F.filter("w_lines", lambda x: x["bad"])).cast("long").alias("n_bad_lines"),
        _total(F.transform(good, lambda x: x["chars"])).alias("kept_chars"),
        F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("kept_chars") >= F.col("word_chars") * (1 - max_lost)))
