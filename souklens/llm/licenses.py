"""License scans: rolling word k-grams joined to template positions, votes by offset diagonal, merged and verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 2
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices, their labels, and the runs of words, separated by commas, without which a notice would be another one.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", "apache,2"),
    ("you may not use this file except in compliance with the license", "apache-2.0", "compliance,license"),
    ("released under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "permission,granted"),
    ("gnu general public license version 3", "gpl-3.0", "gnu general public,3"),
    ("gnu general public license version 2", "gpl-2.0", "gnu general public,2"),
    ("gnu lesser general public license", "lgpl", "lesser general public"),
    ("gnu affero general public license", "agpl", "affero general public"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution,permitted"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla public,2"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc by nc 4"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc by sa 4"),
    ("licensed under cc by 4 0", "cc-by-4.0", "cc by 4"),
    ("creative commons attribution", "cc-by", "creative commons attribution"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered,public domain"),
)
#: Diagonals up to this distance from one another merge; a notice may differ by one word, and by one more for each so many of its words.
NEAR, EACH = 2, 14
#: K-grams of templates that are sent to all executors instead of being shuffled.
MAX_BROADCAST = 100_000


def license_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters; A-Z in lower case. Null counts as empty."""
    small = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.regexp_replace(small, r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def _letters(words: list[str]) -> dict[str, str]:
    """A character for each distinct word of a template, from A on."""
    return {w: chr(65 + i) for i, w in enumerate(dict.fromkeys(words))}


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """template, label, base, form (a character for each word), needed (the runs that must be there unbroken, separated by commas), edits (words that may differ), words."""
    out = []
    for i, (text, label, base, needed) in enumerate([(*p, True, p[0]) for p in phrases] + [(t, label, False, needed) for t, label, needed in notices]):
        words = text.split()
        of = _letters(words)
        out.append((i, label, base, "".join(of[w] for w in words), ",".join("".join(of[w] for w in run.split()) for run in needed.split(",")), 0 if base else max(1, len(words) // EACH), words))
    return out


def template_grams(spark, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row for each k-gram of each template: its place and words, and what templates() says of the template. Broadcast up to MAX_BROADCAST rows."""
    word = lambda t, p: t[6][p] if 0 <= p < len(t[6]) else None
    rows = [(*t[:6], p, word(t, p), word(t, p + 1), word(t, p - 2), word(t, p + 3)) for t in templates(phrases, notices) for p in range(len(t[6]) - K + 1)]
    kind = "template int, label string, base boolean, form string, needed string, edits int, tpos int, a string, b string, ahead string, behind string"
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c)
    grams = spark.createDataFrame(rows, kind).select("*", _hash("a", "b").alias("h")).select(*[hashed(c) if c in ("ahead", "behind") else c for c in (*[x.split()[0] for x in kind.split(", ")], "h")])
    return F.broadcast(grams) if len(rows) <= MAX_BROADCAST else grams


def _hash(a, b) -> Column:
    return F.xxhash64(F.xxhash64(a), F.xxhash64(b))


def votes(docs: DataFrame, text: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """docs' columns without the text, `__row`, `__n_words`, and a row for each rolling k-gram that stands in a template, with its place there (tpos) and here (pos); and a row of nulls for each document.

    All k-grams' hashes are joined to the templates' positions; the words of those that meet are compared as well.
    ahead and behind: whether the word before its neighbour, and the word after its next one, are the template's, too
    (by their hashes), since a changed word leaves the first or last word of a template without a k-gram.
    Null and empty texts have no words and so their row of nulls alone; repeated rows are documents of their own.
    """
    a = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__words", license_words(F.col(text))).drop(text)
    a = a.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    n, keep = F.size("__words"), [c for c in docs.columns if c != text]
    pairs = lambda c: (F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(n - 1, F.lit(0))))
    (x, y), (v, w) = pairs("__hashes"), pairs("__words")
    size = F.greatest(n - 1, F.lit(0))
    ahead = F.slice(F.concat(F.array_repeat(F.lit(None).cast("long"), 2), "__hashes"), F.lit(1), size)
    a = a.withColumn("__rolling", F.arrays_zip(F.zip_with(x, y, lambda p, q: F.xxhash64(p, q)).alias("h"), v.alias("a"), w.alias("b"), ahead.alias("ahead"), F.slice("__hashes", F.lit(4), size).alias("behind")))
    none = F.lit(None).cast("struct<h:bigint,a:string,b:string,ahead:bigint,behind:bigint>")
    rolling = a.select(*keep, "__row", n.cast("long").alias("__n_words"), F.posexplode(F.concat("__rolling", F.array(none))).alias("pos", "g"))  # the document's own row comes last
    rolling = rolling.select(*keep, "__row", "__n_words", F.col("pos").cast("long").alias("pos"), "g.*")
    met = rolling.join(template_grams(docs.sparkSession, phrases, notices).withColumnsRenamed({c: f"__{c}" for c in ("a", "b", "ahead", "behind")}), "h", "left")
    met = met.where(F.col("h").isNull() | ((F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b"))))
    same = lambda c: F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))
    return met.withColumns({c: same(c) for c in ("ahead", "behind")}).drop("h", "a", "b", "__a", "__b", "__ahead", "__behind")


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row for each span: __row, doc_id, __n_words, template, label, base, start, n (words), cover; for each document also a row of nulls.

    The k-grams of a place where a whole template stands all vote for one diagonal. Words that a notice has lost or
    gained move it by as many, so the votes of a diagonal and those up to NEAR behind it are one place. It is verified
    by its words: as a text of one character for each, "?" for what no k-gram of the notice covers or has next but one, it may differ from
    the notice by `edits` insertions, losses and changes, and the needed runs of words have to be there. Base phrases stand on
    their diagonal word by word. cover is the share of words that do not differ. Of places that begin within NEAR
    diagonals of a verified one before them only that one is given.
    """
    hits = votes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", phrases, notices)
    by, form = ["__row", "doc_id", "__n_words", "template", "label", "base", "form", "needed", "edits"], F.col("form")
    diagonals = hits.groupBy(*by, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set(F.when(F.col("tpos").isNotNull(), F.struct("tpos", "ahead", "behind"))).alias("places"))
    along = W.partitionBy("__row", "template").orderBy("diagonal")
    merged = diagonals.withColumn("near", F.collect_list(F.struct("diagonal", "places")).over(along.rangeBetween(0, NEAR)))
    # Base phrases are those whose k-grams all vote for one diagonal; they are never merged.
    merged = merged.withColumn("near", F.when(F.col("base"), F.array(F.struct("diagonal", "places"))).otherwise(F.col("near")))
    letter = lambda d, t: F.struct((d + t).alias("at"), F.substring(form, t + 1, F.lit(1)).alias("c"))
    letters = lambda d, p: F.filter(F.array(letter(d, p["tpos"]), letter(d, p["tpos"] + 1), F.when(p["ahead"], letter(d, p["tpos"] - 2)), F.when(p["behind"], letter(d, p["tpos"] + 3))), lambda x: x.isNotNull())
    covered = F.flatten(F.transform("near", lambda x: F.flatten(F.transform(x["places"], lambda p: letters(x["diagonal"], p)))))
    merged = merged.withColumn("words", F.map_from_entries(F.array_distinct(covered)))
    merged = merged.withColumns({"start": F.array_min(F.map_keys("words")), "stop": F.array_max(F.map_keys("words"))})
    shown = F.array_join(F.transform(F.sequence("start", "stop"), lambda p: F.coalesce(F.try_element_at("words", p), F.lit("?"))), "")
    merged = merged.withColumn("shown", shown)
    differ = F.levenshtein("shown", form)
    there = F.forall(F.split("needed", ","), lambda run: F.contains("shown", run))
    ok = (differ <= F.col("edits")) & there
    verified = merged.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("cover", 1 - differ / F.length(form)).where(F.col("ok") | F.col("template").isNull())
    before = F.lag("diagonal").over(along)
    verified = verified.withColumn("again", ~F.col("base") & F.coalesce(F.col("diagonal") - before <= NEAR, F.lit(False))).where("template is null or not again")
    return verified.select("__row", "doc_id", "__n_words", "template", "label", "base", "start", (F.col("stop") - F.col("start") + 1).alias("n"), "cover")


def scanned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest start of these
    (null if none), labels are distinct, sorted and joined by commas ("" if none), score is the best cover (0.0 if
    none). A null or empty text has no words. A doc_id that occurs twice has two rows, a null doc_id one of its own;
    other columns are not read.
    """
    base = F.col("base")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return spans(docs, text, doc_id, phrases, notices).groupBy("__row", "doc_id", "__n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).withColumnRenamed("__n_words", "n_words").drop("__row")
