"""License texts and phrases in documents, by votes for diagonals.

Every run of ``PAIR`` and of ``RUN`` neighbouring words of a text is joined, by its hash and then by its words, with the places where phrases and
templates have it. A match votes for a diagonal: its place in the text less its place in the template. A phrase stands where all its runs
vote for one diagonal. Diagonals of a template that lie within ``GAP`` words are merged, so inserted and dropped words don't break a
match; the merged span is taken as the license where at least ``SHARE`` of the template's runs are found in it.

Runs are compared as words once their hashes agree, so nothing rests on a hash. Templates are a parameter of a few hundred words each: their places
are broadcast, texts are read once and never shuffled; matches are grouped by document. Only native expressions are used.

Cases. Null text counts as empty; a text without words or matches keeps its row, with no labels and score 0. Null ids stay, repeated rows are told each by itself, and rows of
one id with other texts stay apart (by a 64-bit hash of the text). A text that repeats a license has a place for each. Ties don't arise. Empty table: no rows. Extra columns are ignored.
A text's words and runs are arrays of one row, some eight times the text while its task works on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PAIR, RUN, GAP, SHARE, PHRASE_SCORE = 2, 4, 4, 0.6, 0.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # in lower case

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public license texts or the notices that stand for them, by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-2.0": "GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc-by-nc": "licensed under CC BY-NC 4.0",
    "cc-by-sa": "licensed under CC BY-SA 4.0",
}


def words(text: Column) -> Column:
    """Runs of letters and digits of ASCII, in lower case, and of all other characters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _next(parts: Column, step: int) -> Column:
    """Each entry joined with the one ``step`` places on."""
    n = F.greatest(F.size(parts) - step, F.lit(0))
    return F.zip_with(F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(1 + step), n), lambda a, b: F.concat(a, F.lit(" "), b))


def runs(df: DataFrame) -> DataFrame:
    """Adds ``pairs`` and ``fours`` to rows with ``words``: all runs of two and of four words."""
    return df.withColumn("pairs", _next(F.col("words"), 1)).withColumn("fours", _next(F.col("pairs"), 2))


def places(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """gram, hash, template (its number), label, phrase (whether it is one), at and grams: where phrases and templates have which runs.

    Phrases are looked up by pairs of words, templates by runs of four; a template must have four words, a phrase two."""
    named = [(i, label, i < len(phrases), text) for i, (text, label) in enumerate([*phrases.items(), *((t, k) for k, t in templates.items())])]
    cut = runs(spark.createDataFrame(named, "template int, label string, phrase boolean, text string").withColumn("words", words(F.col("text"))))
    own = F.when(F.col("phrase"), F.col("pairs")).otherwise(F.col("fours"))
    rows = cut.select("template", "label", "phrase", F.size(own).alias("grams"), F.posexplode(own).alias("at", "gram"))
    return rows.withColumn("hash", F.xxhash64("gram"))


def spans(docs: DataFrame, ident: str, text: str, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """ident, copies, n_words, label, phrase, first_word, last_word, found: a row for each place of a phrase or span of a template, whatever its share ``found`` of the template's runs;
    and one of nulls for each text. ``copies``: how many rows have this id and text. ``text_key`` tells texts of one id apart."""
    spark = docs.sparkSession
    held = docs.select(docs[ident].alias("id"), F.xxhash64(docs[text]).alias("text_key"), words(docs[text]).alias("words"))
    every = runs(held).select("id", "text_key", F.size("words").alias("n_words"), F.concat("pairs", "fours", F.array(F.lit(""))).alias("all"))
    # posexplode would have Spark infer a filter on the size, which works all runs out once more.
    each = every.select("id", "text_key", "n_words", F.posexplode_outer("all").alias("pos", "gram"))
    known = F.broadcast(places(spark, phrases if phrases is not None else PHRASES, templates if templates is not None else TEMPLATES).select("template", "label", "phrase", "grams", "at", "hash", F.col("gram").alias("known")))
    met = each.join(known, (F.xxhash64("gram") == known["hash"]) & (F.col("gram") == F.col("known")), "left").where("template is not null or gram = ''")
    pairs = F.greatest(F.col("n_words") - 1, F.lit(0))
    diagonal = F.when(F.col("template").isNotNull(), F.when(F.col("phrase"), F.col("pos")).otherwise(F.col("pos") - pairs) - F.col("at"))
    voted = met.select("id", "text_key", "n_words", "template", "label", "phrase", "grams", "at", diagonal.alias("diagonal")).repartition("id", "text_key")
    key = ["id", "text_key", "n_words", "template", "label", "phrase", "grams"]
    lines = voted.groupBy(*key, "diagonal").agg(F.count("*").alias("copies"), F.collect_set("at").alias("ats"))  # as many places as the template has
    per = Window.partitionBy("id", "text_key", "n_words", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(per) > GAP), F.lit(True))
    merged = lines.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("int")).over(per))
    first, last = F.col("diagonal") + F.array_min("ats"), F.col("diagonal") + F.array_max("ats")
    found = merged.groupBy(*key, "span").agg(F.max("copies").alias("copies"), F.min(first).alias("first_word"), F.max(last).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"))
    width = F.when(F.col("phrase"), F.lit(PAIR)).otherwise(F.lit(RUN))
    return found.select(
        F.col("id").alias(ident), "text_key", "copies", "n_words", "label", "phrase", F.col("first_word").cast("long").alias("first_word"), (F.col("last") + width - 1).cast("long").alias("last_word"),
        F.when(F.col("template").isNotNull(), F.col("n") / F.col("grams")).alias("found"),
    )


def labelled(docs: DataFrame, ident: str, text: str, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """ident, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    base: places of phrases. labels: also those of templates that are found. score: the largest share of a template's runs found in one span; a phrase counts ``PHRASE_SCORE``."""
    base = F.col("phrase") & (F.col("found") == 1)
    whole = base | (~F.col("phrase") & (F.col("found") >= SHARE))
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    score = F.when(base, PHRASE_SCORE).when(~F.col("phrase"), F.col("found"))
    rows = spans(docs, ident, text, phrases, templates).groupBy(ident, "text_key", "n_words").agg(
        F.max(F.when(F.col("label").isNull(), F.col("copies"))).alias("copies"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"), names(base).alias("base_labels"), names(whole).alias("labels"), F.coalesce(F.max(score), F.lit(0.0)).alias("score"),
    )
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(ident, F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(table(spark, sf_dir, "documents"), "doc_id", "text")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NAMED = ", ".join(f"({i}, {_quoted(label)}, {str(phrase).lower()}, {_quoted(text)})" for i, (text, label, phrase) in enumerate([*((t, k, True) for t, k in PHRASES.items()), *((t, k, False) for k, t in TEMPLATES.items())]))
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT no, label, phrase, {_WORDS} AS w FROM (VALUES {_NAMED}) v(no, label, phrase, text)),
tg AS (SELECT no, label, phrase, len(w) - k + 1 AS grams, place, array_to_string(w[place + 1 : place + k], ' ') AS gram FROM (SELECT *, CASE WHEN phrase THEN {PAIR} ELSE {RUN} END AS k, unnest(range(len(w) - k + 1)) AS place FROM t)),
dg AS (SELECT r, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS gram FROM (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS pos FROM d, (VALUES ({PAIR}), ({RUN})) v(k) WHERE len(w) >= k)),
m AS (SELECT DISTINCT r, no, label, phrase, grams, place, pos - place AS diagonal FROM dg JOIN tg USING (gram)),
l AS (SELECT r, no, diagonal, any_value(phrase) AS phrase FROM m GROUP BY ALL),
s AS (SELECT *, sum(CASE WHEN phrase OR diagonal - before <= {GAP} IS NOT TRUE THEN 1 ELSE 0 END) OVER (PARTITION BY r, no ORDER BY diagonal) AS span
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY r, no ORDER BY diagonal) AS before FROM l)),
f AS (SELECT m.r, label, m.phrase, min(m.diagonal + place) AS first_word, count(DISTINCT place) / any_value(grams) AS found FROM m JOIN s ON m.r = s.r AND m.no = s.no AND m.diagonal = s.diagonal GROUP BY m.r, m.no, label, m.phrase, span),
g AS (SELECT *, phrase AND found = 1 AS base, phrase AND found = 1 OR NOT phrase AND found >= {SHARE}::DOUBLE AS whole FROM f)
SELECT doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (base) AS n_base, (min(first_word) FILTER (base))::BIGINT AS first_word, (max(first_word) FILTER (base))::BIGINT AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole), '') AS labels,
coalesce(max(CASE WHEN base THEN {PHRASE_SCORE}::DOUBLE WHEN NOT phrase THEN found END), 0.0::DOUBLE) AS score FROM d LEFT JOIN g USING (r) GROUP BY d.r, doc_id, w
"""
