"""License scan by diagonal voting.  DataFrame and SQL functions only.

All rolling word bigrams of all texts are joined, as 64-bit hashes, to the bigrams'
positions in license templates.  A hit votes for its diagonal (text position minus
template position); votes are summed per text, template and diagonal, neighbouring
diagonals are merged into spans (words may have been put in or left out, within a
bound), and a span is verified by the longest chain of its words that rises in the
template and in the text.

Templates are this module's constants, so the side that is broadcast never grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adega.llm.common import ascii_lower, constant_rows, free_name, stored

#: units of a window frame over diagonals
_FRAME = 1 << 20

#: words of a license scan: ASCII letters and digits, and everything beyond ASCII
WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: the same words of a text whose A-Z aren't lower-cased yet; Java matches ranges many times faster than a complement of ranges
WORDS_ANY_CASE = "[0-9A-Za-z\\x80-\\x{10FFFF}]+"

#: fixed values: phrases whose exact places are counted, with their labels
PHRASES: tuple[tuple[str, str], ...] = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: longer public license wordings, found with gaps and changes; (words, label)
PASSAGES: tuple[tuple[str, str], ...] = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
     "files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons zero v1 0 universal", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def scan(docs: DataFrame, text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES,
         passages: Sequence[tuple[str, str]] = PASSAGES, coverage: float = 0.8, drift: int = 3, slack: float = 0.25) -> DataFrame:
    """One row per document, all columns kept, with

    ``n_words``; ``n_base`` (places of exact phrases); ``first_word`` and
    ``last_word`` (their smallest and largest start, else null); ``base_labels``
    and ``labels`` (distinct, sorted, comma-joined; ``labels`` adds the passages');
    ``score`` (1 with an exact phrase, else the best passage's verified share, 0
    without any); ``spans`` (array of label, start, end, share).

    A passage is found where at least ``coverage`` of its words, each beside a
    neighbour of the template, stand in the template's order, on diagonals that lie at most ``drift``, or
    ``slack`` of its length, apart altogether; passages under ten words must be whole.  A null text is empty: no words, no labels,
    score 0.  What is found depends on the text alone, so the result of a text is
    joined to all rows that hold it by a 128-bit hash; repeated rows and ids each
    keep their row.  If ``docs`` already has one of these columns the new one gets
    a trailing underscore.  An empty table stays empty."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    key = [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(7_046_029), body).alias("t2")]

    templates = [(p.split(" "), label, True) for p, label in phrases] + [(p.split(" "), label, False) for p, label in passages]
    grams = constant_rows(
        spark, [(k, label, exact, w, i) for k, (w, label, exact) in enumerate(templates) for i in range(len(w) - 1)],
        "template int, label string, exact boolean, wanted array<string>, at int",
    )
    # hashed as any letters' lower case, which is cheap; a word that is not ASCII can only be one of a template that isn't either
    lower = F.lower if all(p.isascii() for p, _ in (*phrases, *passages)) else ascii_lower
    gram = lambda a, b: F.xxhash64(lower(a), lower(b))
    grams = grams.withColumn("gram", gram(F.element_at("wanted", F.col("at") + 1), F.element_at("wanted", F.col("at") + 2)))

    # one row per word, with the hash of it and its successor; "outer" keeps the optimiser from
    # splitting each text once more to see whether it has words
    words = F.regexp_extract_all(body, F.lit(WORDS_ANY_CASE), F.lit(0))
    read = docs.select(*key, words.alias("words")).select("*", F.posexplode_outer("words").alias("pos", "word"))
    hits = read.withColumn("gram", gram(F.col("word"), F.get("words", F.col("pos") + 1))).join(F.broadcast(grams), "gram")
    # the hash is verified with the words themselves; these expressions stay inside generated
    # code, so a long text's word array is never copied to its hits
    same = [ascii_lower(F.get("words", F.col("pos") + k)) == F.element_at("wanted", F.col("at") + 1 + k) for k in (0, 1)]
    voted = (
        hits.where(same[0] & same[1])
        .select("t1", "t2", "template", "label", "exact", (F.col("pos") - F.col("at")).alias("diagonal"), "at", F.size("wanted").alias("length"))
        .groupBy("t1", "t2", "template", "label", "exact", "length", "diagonal")
        # copies of a text vote alike: the distinct template positions are the votes
        .agg(F.collect_set("at").alias("votes")))
    voted = voted.withColumn("same", F.array_distinct(F.concat("votes", F.transform("votes", lambda at: at + 1))))  # words verified
    # exact phrases and passages read the votes, a few rows a text: written once, the texts are read once
    found = _spans(stored(voted, "license-votes"), coverage, drift, slack)

    names = {n: free_name(docs, n) for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
    h1, h2 = free_name(docs, "license_t1"), free_name(docs, "license_t2")
    counted = docs.select("*", key[0].alias(h1), key[1].alias(h2), F.regexp_count(body, F.lit(WORDS_ANY_CASE)).cast("long").alias(names["n_words"]))
    out = counted.join(found.withColumnsRenamed({"t1": h1, "t2": h2}), [h1, h2], "left")
    none = F.array().cast("array<struct<label:string,start:int,end:int,share:double>>")
    return out.select(
        *docs.columns, names["n_words"], F.coalesce("f_base", F.lit(0)).cast("long").alias(names["n_base"]),
        F.col("f_first").cast("long").alias(names["first_word"]), F.col("f_last").cast("long").alias(names["last_word"]),
        F.coalesce("f_base_labels", F.lit("")).alias(names["base_labels"]), F.coalesce("f_labels", F.lit("")).alias(names["labels"]),
        F.coalesce("f_score", F.lit(0.0)).alias(names["score"]), F.coalesce("f_spans", none).alias(names["spans"]))


def _in_order(words: Column, sign: int) -> Column:
    """Ends of the chains of words that rise in the template and in the text: the k-th
    entry is the smallest text position at which a chain of k words can end (with
    ``sign`` -1 everything is seen from the end).  The array's length is that of the longest chain."""
    # equal template positions follow each other with falling text positions, so a chain takes one of them
    places = F.array_sort(F.transform(words, lambda w: F.struct((w["at"] * sign).alias("at"), (w["pos"] * -sign).alias("back"))))

    def put(ends: Column, word: Column) -> Column:
        pos = -word["back"]
        shorter = F.size(F.filter(ends, lambda e: e < pos))
        return F.concat(F.slice(ends, 1, shorter), F.array(pos), F.slice(ends, shorter + 2, F.greatest(F.size(ends) - shorter - 1, F.lit(0))))

    return F.aggregate(places, F.array().cast("array<int>"), put)


def _spans(voted: DataFrame, coverage: float, drift: int, slack: float) -> DataFrame:
    """Merges neighbouring diagonals, verifies, and gathers the result per text."""
    text = ["t1", "t2", "template", "label", "exact", "length"]
    whole = voted.where(F.col("exact") & (F.size("same") == F.col("length"))).select(
        *text, F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("end"), F.lit(1.0).alias("share"))

    # all diagonals from each one up to ``reach`` further: words that are put in or left out move a
    # passage by as much altogether.  Diagonals are stretched so that one frame fits all lengths.
    reach = F.greatest(F.lit(drift), F.floor(F.col("length") * F.lit(slack))).cast("int")
    stretched = F.col("diagonal") * F.floor(F.lit(_FRAME) / reach)
    frame = Window.partitionBy("t1", "t2", "template").orderBy(stretched).rangeBetween(0, _FRAME)
    least = F.when(F.col("length") < 10, F.col("length").cast("double")).otherwise(F.col("length") * F.lit(coverage))
    near = (voted.where(~F.col("exact")).withColumn("reach", reach).withColumn("hits", F.sum(F.size("same")).over(frame))
            .withColumn("merged", F.collect_list(F.struct("diagonal", "same")).over(frame)).where(F.col("hits") >= least))
    words = F.flatten(F.transform("merged", lambda d: F.transform(d["same"], lambda at: F.struct(at.alias("at"), (d["diagonal"] + at).alias("pos")))))
    # verified: the words that stand in the template's order in the text
    checked = (near.select(*text, "diagonal", "reach", words.alias("words")).withColumn("ends", _in_order(F.col("words"), 1))
               .withColumn("share", F.size("ends") / F.col("length")).where(F.size("ends") >= least))
    checked = checked.select(*text, "diagonal", "reach", "share", (-F.element_at(_in_order(F.col("words"), -1), -1)).alias("start"),
                             (F.element_at("ends", -1) + 1).alias("end"))
    # frames that overlap show the same passage: the best of them stands for it
    along = Window.partitionBy("t1", "t2", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("reach"), F.lit(True)).cast("int")
    grouped = checked.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    best = grouped.groupBy(*text, "span").agg(F.max(F.struct("share", (F.col("start") - F.col("end")).alias("short"), (-F.col("start")).alias("early"))).alias("b"))
    spans = whole.unionByName(best.select(
        *text, (-F.col("b.early")).alias("start"), (-F.col("b.early") - F.col("b.short")).alias("end"), F.col("b.share").alias("share")))
    base = F.when(F.col("exact"), F.col("start"))
    label = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("t1", "t2").agg(
        F.count(base).alias("f_base"), F.min(base).alias("f_first"), F.max(base).alias("f_last"),
        label(F.when(F.col("exact"), F.col("label"))).alias("f_base_labels"), label("label").alias("f_labels"),
        F.max("share").alias("f_score"),
        F.array_sort(F.collect_list(F.struct("label", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "share"))).alias("f_spans"))
