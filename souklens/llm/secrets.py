"""Secret scans: patterns for known kinds of secrets, and sliding-window entropy for unknown ones, in Spark functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds, in the order of their listing, and their patterns; group 2 of the first is the secret itself.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # the same as runs from AKIA of 16 characters or more
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE = 8

#: Candidates for entropy: unbroken runs of LEAST characters or more that hold a digit.
LEAST, WINDOW = 20, 20
RUN = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{RUN}])(?=[A-Za-z+/_-]*+[0-9])[{RUN}]{{{LEAST},}}+"
#: Runs that are no secrets: numbers, identifiers in 8-4-4-4-12 form, one lower-case word with a number, documented sample keys.
ALLOWED = r"^[0-9+/_-]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[a-z]+[0-9]*$|EXAMPLE|example"
#: Nor are paths and names: runs of letters of both cases or with signs of which words, numbers and signs leave one letter at most.
ONE_CASE, WORDS = "^([0-9a-z]+|[0-9A-Z]+)$", "[A-Z]?[a-z]{2,}|[0-9+/_-]+"
#: Character classes: name, form of the whole run, and the bits for each character that a window needs; the first form that fits counts.
#: Each class has its own limit, since a window of 20 out of 16, 32 or 36 characters can't reach what one out of 62 or 66 does.
CLASSES = (("hex", "^[0-9a-fA-F]+$", 2.9), ("one_case", ONE_CASE, 3.4), ("both_cases", "^[0-9A-Za-z]+$", 3.6), ("signs", "^", 3.9))
SCALE = 1_000_000_000


def weight(count: int) -> int:
    """count * log2(count) as a whole number of billionths, so that sums do not depend on their order."""
    return round(count * math.log2(count) * SCALE) if count > 1 else 0


def most_weight(bits: float) -> int:
    """A window has at least so many bits for each character if its weights sum to no more than this."""
    return round(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def allowed(value: Column) -> Column:
    return value.rlike(ALLOWED) | (~value.rlike(ONE_CASE) & (F.length(F.regexp_replace(value, WORDS, "")) <= 1))


def limit(value: Column) -> Column:
    """most_weight of the class of a run."""
    out = F.lit(most_weight(CLASSES[-1][2]))
    for _, form, bits in reversed(CLASSES[:-1]):
        out = F.when(value.rlike(form), most_weight(bits)).otherwise(out)
    return out


def _with_running(df: DataFrame, values: Column, step, into: str) -> DataFrame:
    """df with `into`: what step(total, value) has come to at each place of `values`, longs from 0; step has to be associative (a sum, a maximum).

    An array that grows within aggregate() is copied at every step, so blocks of about the square root of the length are
    run through on their own and then moved on by what stands before them. A column of its own for each step, as an
    expression used twice would be worked out twice.
    """
    blocks, before = f"{into}_blocks", f"{into}_before"
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    last = lambda xs: F.coalesce(F.try_element_at(xs, F.lit(-1)), zero)
    append = lambda out, x: F.concat(out, F.array(step(last(out), x)))
    a = df.withColumn(into, values).withColumn(before, F.greatest(F.ceil(F.sqrt(F.size(into))).cast("int"), F.lit(1)))
    a = a.withColumn(blocks, F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(into) - 1) / F.col(before)), F.lit(0)).cast("int")), lambda b: F.slice(into, b * F.col(before) + 1, F.col(before))))
    a = a.withColumn(blocks, F.transform(blocks, lambda xs: F.aggregate(xs, none, append)))
    a = a.withColumn(before, F.aggregate(blocks, F.array(zero), lambda out, xs: append(out, last(xs))))
    # zip_with hands the totals over; a column that is used once, within a lambda, would be worked out for each element.
    return a.withColumn(into, F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(before) - 1), lambda xs, b: F.transform(xs, lambda y: step(b, y)))))


def _found(text: Column, pattern: str, value_group: bool = False) -> Column:
    r"""Leftmost matches, one after the other, each with its value and `ends`: the lengths of the gap before it and of itself, in turn.

    \G makes each match take up what stands before it, so the lengths of gaps and matches add up to positions.
    """
    whole = F.lit(rf"\G((?s:.*?))({pattern})")
    take = lambda i: F.regexp_extract_all(text, whole, F.lit(i))
    zipped = F.arrays_zip(take(1).alias("gap"), take(2).alias("hit"), take(3 if value_group else 2).alias("value"))
    none = F.array().cast("array<struct<gap:string,hit:string,value:string>>")
    return F.when(text.rlike(pattern), zipped).otherwise(none)


def _with_spans(df: DataFrame, text: Column, pattern: str, kind: str, into: str, value_group: bool = False) -> DataFrame:
    """df with `into`: the matches as (start, ord, end, kind, value), in code points. A column of its own for each step, as an expression used twice would be worked out twice."""
    at = f"{into}_at"
    a = df.withColumn(into, _found(text, pattern, value_group))
    lengths = F.flatten(F.transform(into, lambda x: F.array(F.length(x["gap"]).cast("long"), F.length(x["hit"]).cast("long"))))
    a = _with_running(a, lengths, lambda total, x: total + x, at)
    one = lambda x, i: F.struct(F.get(at, 2 * i).alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.get(at, 2 * i + 1).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
    return a.withColumn(into, F.transform(into, one))


def _apart(df: DataFrame, runs: str, base: str, into: str) -> DataFrame:
    """df with `into`: the spans of `runs` that touch none of `base`; both are sorted, and no two runs touch.

    Ends of runs and starts of base spans in one order: a run is touched if the furthest end of the base spans that
    start before its end lies behind its start.
    """
    events, far = f"{into}_events", f"{into}_far"
    none = F.lit(None).cast("struct<start:bigint,ord:int,end:bigint,kind:string,value:string>")
    ends = F.transform(runs, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("base"), F.lit(0).cast("long").alias("until"), x.alias("run")))
    starts = F.transform(base, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("base"), x["end"].alias("until"), none.alias("run")))
    a = df.withColumn(events, F.sort_array(F.concat(ends, starts)))
    a = _with_running(a, F.transform(events, lambda e: e["until"]), F.greatest, far)
    open_ = F.filter(F.zip_with(events, far, lambda e, f: F.when((e["base"] == 0) & (f <= e["run"]["start"]), e["run"])), lambda x: x.isNotNull())
    return a.withColumn(into, open_)


def _least_window_weight(value: Column) -> Column:
    """The smallest sum of weights over all windows of a candidate, by counts that change by one character out and one in.

    The state is the last WINDOW characters, in which the counts of the one that goes and the one that comes are taken,
    so the work for each character does not depend on the run's length. Each step compares the sum of the step before,
    since an expression that is used twice in a lambda is worked out twice.
    """
    gains = F.array(*[F.lit(weight(i) - weight(i - 1)) for i in range(1, WINDOW + 1)])  # of the i-th equal character in a window
    times = lambda xs, c: F.size(F.filter(xs, lambda x: x == c))
    least = lambda acc: F.when(acc["n"] >= WINDOW, F.least(acc["least"], acc["sum"])).otherwise(acc["least"])
    begin = F.struct(F.array_repeat(F.lit(""), WINDOW).alias("last"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(2**62).cast("long").alias("least"))

    def step(acc: Column, c: Column) -> Column:
        out = F.when(acc["n"] >= WINDOW, F.element_at(gains, times(acc["last"], F.element_at(acc["last"], 1)))).otherwise(F.lit(0).cast("long"))
        into = F.element_at(gains, times(F.slice(acc["last"], 2, WINDOW - 1), c) + 1)
        return F.struct(F.concat(F.slice(acc["last"], 2, WINDOW - 1), F.array(c)).alias("last"), (acc["n"] + 1).alias("n"), (acc["sum"] - out + into).alias("sum"), least(acc).alias("least"))

    return F.aggregate(F.split(value, ""), begin, step, least)


def scanned(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """docs with one array column `into` of structs (start, ord, end, kind, value), sorted by start, then kind.

    Kinds: assign (a name such as password, a sign and a value of eight characters or more), access (AKIA...), hex (32
    digits or more), and entropy: runs of LEAST characters or more with a digit, in which some window of WINDOW has the
    bits for each character that the run's class needs (CLASSES: hexadecimal digits; digits with letters of one case;
    with letters of both; with other signs), unless they are on the allow list or touch a span of another kind. Runs of
    letters alone and shorter ones are not looked at. Positions count code points, ends are exclusive. A null or empty
    text has an empty array. Whole texts, no shuffle, no user function; the work grows with a text's length, however
    long a single run is, and with its spans to the power of 1.5. Repeated rows stay, an empty table gives an empty
    one. All other columns pass through (but `into` itself and names that start with "__s_").
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs
    for pattern, kind in ((ASSIGN, "assign"), (ACCESS, "access"), (HEX, "hex"), (CANDIDATE, "entropy")):
        a = _with_spans(a, t, pattern, kind, f"__s_{kind}", kind == "assign")
    a = a.withColumn("__s_assign", F.filter("__s_assign", lambda x: F.length(x["value"]) >= MIN_VALUE))
    a = a.withColumn("__s_base", F.sort_array(F.concat("__s_assign", "__s_access", "__s_hex")))
    a = a.withColumn("__s_entropy", F.filter("__s_entropy", lambda x: ~allowed(x["value"])))
    a = _apart(a, "__s_entropy", "__s_base", "__s_runs")
    a = a.withColumn("__s_runs", F.filter("__s_runs", lambda x: _least_window_weight(x["value"]) <= limit(x["value"])))
    a = a.withColumn("__s_all", F.sort_array(F.concat("__s_base", "__s_runs")))
    # Always true, but the planner can't know: a filter on `into` must not be pushed down with all these expressions written out in it again and again.
    held = F.when(F.monotonically_increasing_id() >= 0, F.col("__s_all"))
    return a.select(*[docs[c] for c in docs.columns], held.alias(into))


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mask; spans that overlap are replaced as one. Null, empty and clean texts stay as they are, as do repeated rows and all other columns (but names that start with "__s_")."""
    a = _with_running(scanned(docs, text, "__s_spans"), F.transform("__s_spans", lambda x: x["end"]), F.greatest, "__s_ends")  # how far all spans up to here reach
    piece = lambda x, i: F.when(
        (i == 0) | (x["start"] >= F.get("__s_ends", i - 1)),
        F.concat(F.substring(text, (F.coalesce(F.get("__s_ends", i - 1), F.lit(0)) + 1).cast("int"), (x["start"] - F.coalesce(F.get("__s_ends", i - 1), F.lit(0))).cast("int")), F.lit(mask)),
    ).otherwise("")
    rest = F.substring(text, (F.element_at("__s_ends", -1) + 1).cast("int"), F.lit(2**31 - 1))
    done = F.concat(F.array_join(F.transform("__s_spans", piece), ""), rest)
    return a.withColumn(text, F.when(F.size("__s_spans") > 0, done).otherwise(F.col(text))).select(*docs.columns)
