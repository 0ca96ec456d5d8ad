"""Quality rules: a table of thresholds over length, symbol, stop-word and line ratios, as one Spark projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_separated

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with in is on for as was it by are this from at an a or "
    "der die das und in zu den von mit ist im sich auf ein eine einer "
    "le la les de des et en un une du que est pour dans sur au par qui "
    "el los las y del se por con una para su al lo"
).split()
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Shorter documents have no stop-word ratio: too few words to tell.
ENOUGH_FOR_STOP_WORDS = 50

#: (rule, measure, comparison that a document has to fulfil, threshold). A null measure (no words, no lines) fulfils all but the first.
RULES = (
    ("enough_words", "n_words", ">=", 10),
    ("few_repeated_words", "repeat_ratio", "<=", 0.20),
    ("mean_word_length_low", "mean_word_length", ">=", 2.0),
    ("mean_word_length_high", "mean_word_length", "<=", 15.0),
    ("few_symbols", "symbol_ratio", "<=", 0.1),
    ("some_stop_words", "stop_word_ratio", ">=", 0.01),
    ("few_repeated_lines", "dup_line_ratio", "<=", 0.5),
)


def _windows(words: Column) -> Column:
    """One hash for each run of WINDOW words."""
    hashed = lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, WINDOW)])
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), hashed)


def _twice(sorted_pairs: Column) -> Column:
    """The places `i` of those (value, i) pairs, sorted by value, whose value a neighbour shares; in order."""
    same = lambda x, j: F.coalesce(x["v"] == F.get(sorted_pairs, j)["v"], F.lit(False))
    return F.sort_array(F.array_compact(F.transform(sorted_pairs, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))))


def _covered(at: Column) -> Column:
    """How many words stand in windows that begin at the sorted places `at`: each adds WINDOW words, or as many as it lies behind the one before."""
    steps = F.transform(at, lambda p, j: F.when(j == 0, WINDOW).otherwise(F.least(p - F.get(at, j - 1), F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x).cast("long")


def measured(docs: DataFrame, text: str = "text", into: str = "quality", rules=RULES) -> DataFrame:
    """docs with one struct column `into`: the measures, the rules that failed, base_failed and kept.

    Measures: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), mean_word_length,
    symbol_ratio, stop_word_ratio, dup_line_ratio, repeat_ratio (double, null without words). All are built-in
    functions in one map stage: no shuffle, no user function, whole texts. A null text counts as empty; a text without
    words has zero counts, fails and is not kept. All other columns pass through, whatever their names (but `into`
    itself and names that start with "__q_").
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.withColumn("__q_words", blank_separated(F.col(text)))
    a = a.withColumn("__q_windows", _windows(F.col("__q_words")))
    # Places of windows with equal hashes, if any; then those whose words are equal. A column of its own for each step: an expression used twice would be worked out twice.
    repeats = F.size(F.array_distinct("__q_windows")) < F.size("__q_windows")
    a = a.withColumn("__q_sorted", F.when(repeats, F.sort_array(F.transform("__q_windows", lambda h, i: F.struct(h.alias("v"), i.alias("i"))))).otherwise(F.array().cast("array<struct<v:long,i:int>>")))
    a = a.withColumn("__q_maybe", _twice(F.col("__q_sorted")))
    a = a.withColumn("__q_sorted", F.sort_array(F.transform("__q_maybe", lambda i: F.struct(F.array_join(F.slice("__q_words", i + 1, WINDOW), " ").alias("v"), i.alias("i")))))
    a = a.withColumn("__q_at", _twice(F.col("__q_sorted")))
    a = a.withColumn("__q_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    n, lines = F.size("__q_words").cast("long"), F.size("__q_lines").cast("long")
    a = a.withColumn("__q_m", F.struct(
        n.alias("n_words"),
        F.length(F.array_join("__q_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, "[^" + SYMBOLS + "]+", "")).cast("long").alias("n_symbols"),
        lines.alias("n_lines"),
        (lines - F.size(F.array_distinct("__q_lines"))).alias("n_dup_lines"),
        _covered(F.col("__q_at")).alias("n_repeat_words"),
        F.size(F.filter(blank_separated(F.lower(text)), lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    ))
    m = F.col("__q_m")
    per = lambda k, of: F.when(m[of] > 0, m[k] / m[of])
    a = a.withColumn("__q_m", F.struct(
        "__q_m.*", per("word_chars", "n_words").alias("mean_word_length"), per("n_symbols", "n_words").alias("symbol_ratio"), F.when(m["n_words"] >= ENOUGH_FOR_STOP_WORDS, m["n_stop_words"] / m["n_words"]).alias("stop_word_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"), per("n_repeat_words", "n_words").alias("repeat_ratio"),
        ((m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])).alias("base_failed"),
    ))
    a = a.withColumn("__q_failed", failed(F.col("__q_m"), rules))
    out = F.struct("__q_m.*", F.col("__q_failed").alias("failed_rules"), (~m["base_failed"] & (F.size("__q_failed") == 0)).alias("kept"))
    return a.withColumn("__q_out", out).select(*[docs[c] for c in docs.columns], F.col("__q_out").alias(into))


def failed(measures: Column, rules=RULES) -> Column:
    """The threshold table as one expression: names of the rules that the measures break."""
    ok = {">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, "<": lambda x, y: x < y}
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok[how](measures[k], F.lit(limit)), F.lit(True)), F.lit(name)) for name, k, how, limit in rules]))


def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that break no rule, with the columns they came with.

    The row number keeps the filter above the projection: pushed below it, the verdict would be written out again with
    all measures in it, each as often as it is used, and the plan would not fit into memory.
    """
    m = measured(docs, text, "__q_verdict", rules).withColumn("__q_row", F.monotonically_increasing_id())
    return m.where(F.col("__q_verdict.kept") & (F.col("__q_row") >= 0)).drop("__q_verdict", "__q_row")
