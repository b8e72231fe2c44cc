"""Quality rules: one threshold table compiled into one Spark projection.

:func:`measures` turns a text into ratios with built-in functions only;
:data:`RULES` states, per measure, the least and the largest value a kept
document may have; :func:`verdict` compiles that table into one boolean
column. Nothing is shuffled and no user function runs.

Defined cases: a null or empty text, or one of white space alone, has no
words, so every count is 0 and the document fails the base rule (fewer than
10 words). Null ids stay null; repeated rows are judged one by one; an empty
table gives an empty result. Columns besides the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import SPACE, documents, id_and_text

#: Frequent function words of the languages covered.
STOP_WORDS = [
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in", "is", "it",
    "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
    "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist",
    "mit", "nicht", "sich", "und", "von", "zu",
    "au", "ce", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas",
    "pour", "que", "qui", "sur", "un", "une",
    "al", "con", "del", "el", "es", "las", "los", "no", "para", "por", "se", "su", "una", "y",
]

#: Measure, least value kept, largest value kept (None: open),
#: and the number of words from which the rule is applied (shares of a few
#: words or lines say little).
RULES: list[tuple[str, float | None, float | None, int]] = [
    ("n_words", 10, None, 0),
    ("mean_word_chars", 2.0, 15.0, 10),
    ("symbols_per_word", None, 0.10, 0),
    ("stop_word_share", 0.02, None, 50),
    ("dup_line_share", None, 0.40, 0),
    ("bullet_line_share", None, 0.90, 50),
    ("ellipsis_line_share", None, 0.30, 50),
]

WINDOW = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def measures(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns plus the base counts and the ratios of RULES."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(*(keep or []), text.alias("_text"))
    d = d.select("*", _words(F.col("_text")).alias("_words"),
                 F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    words, lines = F.col("_words"), F.col("_lines")
    stop = sorted(set(STOP_WORDS))
    d = d.select(
        "*",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).alias("_n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).alias("_n_stop"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))).alias("_n_bullet"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("_n_ellipsis"),
        _window_hashes(words).alias("_windows"))
    d = _repeat_words(d)
    n, m = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("_n_lines"), F.lit(1))
    return d.select(
        *[F.col(c) for c in d.columns if not c.startswith("_")],
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("_n_stop") / n).alias("stop_word_share"),
        (F.col("n_dup_lines") / m).alias("dup_line_share"),
        (F.col("_n_bullet") / m).alias("bullet_line_share"),
        (F.col("_n_ellipsis") / m).alias("ellipsis_line_share"))


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each run of WINDOW words, by its first word's place.
    The hash takes the words one after another, so their borders count."""
    last = F.size(words) - F.lit(WINDOW)
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<long>"))


def _repeat_words(d: DataFrame) -> DataFrame:
    """Words that lie in a window found twice or more in the text. Only texts
    with a repeated hash pay for the sort: equal hashes become neighbours,
    their places are put in order, and each adds the words up to the next."""
    win = F.col("_windows")
    d = d.withColumn("_sorted", F.when(
        F.size(F.array_distinct(win)) < F.size(win),
        F.sort_array(F.transform(win, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))))
    s = F.col("_sorted")
    near = lambda i: F.get(s, i)["v"]
    d = d.withColumn("_at", F.when(s.isNotNull(), F.sort_array(F.transform(
        F.filter(s, lambda x, i: F.coalesce(near(i - 1) == x["v"], F.lit(False))
                 | F.coalesce(near(i + 1) == x["v"], F.lit(False))),
        lambda x: x["i"]))))
    at = F.col("_at")
    gap = F.transform(at, lambda p, i: F.least(
        F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    # The optimizer would push a later filter on this column down to the scan
    # and spell out all the arrays above inside it, once per use. It leaves
    # filters above expressions that it can't repeat, such as this condition.
    once = F.spark_partition_id() >= 0
    return d.withColumn("n_repeat_words", F.when(once & s.isNotNull(), F.aggregate(
        gap, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0)).cast("long"))


def verdict(rules: list[tuple[str, float | None, float | None, int]] = RULES) -> Column:
    """The table as one expression: true if every measure is within bounds."""
    ok = F.lit(True)
    for name, least, most, from_words in rules:
        inside = F.lit(True)
        if least is not None:
            inside = inside & (F.col(name) >= F.lit(least))
        if most is not None:
            inside = inside & (F.col(name) <= F.lit(most))
        ok = ok & ((F.col("n_words") < F.lit(from_words)) | inside)
    return ok


def apply(docs: DataFrame, rules: list[tuple[str, float | None, float | None, int]] = RULES) -> DataFrame:
    """One row per document: id, counts, ratios, ``base_failed`` and ``kept``."""
    m = measures(docs.select(*id_and_text(docs)), keep=[F.col("doc_id")])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
