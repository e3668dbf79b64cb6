"""Operator 13: license scans by diagonal voting. Native: DataFrame and SQL functions only.

All rolling word k-grams of all texts, as hashes, meet the k-grams of the license templates in a join; the templates' table is
a parameter of some hundred rows and is broadcast. A hit is compared word by word at once, so a hash alone decides
nothing. Word i of the text and word j of the template vote for the diagonal i - j. Votes on neighbouring diagonals (words put in or
left out) are merged, and each merged span is verified: its share is the number of the template's k-grams that it
has, over those of the template or of the span, whichever are more.

Phrases are templates that must be there in full on one diagonal: these are the base places. Other templates give their label from
a least share on, which is 1 for statements that name a version. Texts are lower-cased in A-Z only, null texts are empty; words are runs of digits, letters a-z and non-ASCII
characters. Texts are known by SHA-256, so copies vote as one, and every row, repeated or not, gets its text's result. Other
columns stay, but for those named like the result's; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.common import fresh, masked, text_or_empty, unmasked, written

#: Words of the k-grams of phrases and of other templates.
SHORT, LONG = 2, 4
#: Diagonals so close belong to one span.
SHIFT = 4
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A license text, lower-cased, its words parted by single spaces; least: the share from which a span gives the label."""

    label: str
    text: str
    phrase: bool = False
    least: float = 0.6


#: Phrases that the query's contract names (fixed values).
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
#: Statements and openings of well-known licenses (fixed values: their wording is what is looked for).
STATEMENTS = [
    Template("gpl-3.0", "licensed under the gnu general public license version 3", least=1.0),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", least=1.0),
    Template("apache-2.0", "licensed under the apache license version 2 0", least=1.0),
    Template("mit", "released under the mit license", least=1.0),
    Template("cc-by-4.0", "licensed under cc by 4 0", least=1.0),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", least=1.0),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", least=1.0),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]
TEMPLATES = [*PHRASES, *STATEMENTS]


def license_words(text: str | Column) -> Column:
    """The words of a text. lower() knows more letters than A-Z; of those only the Kelvin sign becomes an ASCII one."""
    folded = F.lower(F.replace(text_or_empty(text), F.lit("K"), F.lit("Ω")))
    return F.array_remove(F.split(folded, SEPARATORS), "")


OF_TEMPLATE = ["template", "label", "phrase", "least", "grams"]


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(hash, template, label, phrase, least, grams, j, gram): each template's k-grams, k by its kind; a few hundred rows."""
    for t in templates:
        if len(t.text.split()) < (SHORT if t.phrase else LONG):
            raise ValueError(f"template of too few words: {t.text}")
    given = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.phrase).alias("phrase"), F.lit(1.0 if t.phrase else t.least).alias("least"), F.split(F.lit(t.text), " ").alias("w")) for i, t in enumerate(templates)])
    out = spark.range(1).select(F.explode(given).alias("t")).select("t.*").withColumn("k", F.when(F.col("phrase"), SHORT).otherwise(LONG))
    out = out.withColumn("grams", F.size("w") - F.col("k") + 1).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)))
    out = out.withColumn("gram", F.slice("w", F.col("j") + 1, F.col("k")))
    pair = lambda at: _pair(F.xxhash64(F.get("gram", F.lit(at))), F.xxhash64(F.get("gram", F.lit(at + 1))))
    return out.select(F.when(F.col("phrase"), pair(0)).otherwise(_pair(pair(0), pair(2))).alias("hash"), "template", "label", "phrase", "least", "grams", "j", "gram")


def votes(docs: DataFrame, text: str, templates: list[Template]) -> DataFrame:
    """(blob, template, label, phrase, least, grams, d, js): the template positions that vote for each diagonal of each text."""
    w, one, two, four = fresh(docs, "_w", "_1", "_2", "_4")
    own = docs.select(F.sha2(text_or_empty(text), 256).alias("blob"), license_words(text).alias(w))
    # Hashes of one, two and four words from each place on; the last ones lack words, and fail the comparison below.
    own = own.withColumn(one, F.transform(w, lambda x: F.xxhash64(x)))
    own = own.withColumn(two, F.transform(one, lambda x, i: _pair(x, F.get(one, i + 1))))
    own = own.withColumn(four, F.transform(two, lambda x, i: _pair(x, F.get(two, i + 2))))
    rolled = own.select("blob", w, F.posexplode(F.concat(two, four)).alias("pos", "hash"))
    hits = rolled.join(F.broadcast(template_grams(docs.sparkSession, templates)), "hash")
    hits = hits.withColumn("i", F.pmod("pos", F.size(w))).where(F.slice(w, F.col("i") + 1, F.size("gram")) == F.col("gram"))
    hits = hits.select("blob", *OF_TEMPLATE, "j", (F.col("i") - F.col("j")).alias("d"))
    return hits.groupBy("blob", *OF_TEMPLATE, "d").agg(F.collect_set("j").alias("js"))


def verified_spans(voted: DataFrame) -> DataFrame:
    """(blob, template, label, phrase, least, grams, start, end, share): merged neighbouring diagonals; end is exclusive, in words."""
    along = Window.partitionBy("blob", "template").orderBy("d")
    gap = F.col("d") - F.lag("d").over(along)
    apart = gap.isNull() | (gap > F.when(F.col("phrase"), 0).otherwise(SHIFT))
    runs = voted.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = runs.withColumn("j", F.explode("js")).withColumn("i", F.col("d") + F.col("j"))
    spans = placed.groupBy("blob", *OF_TEMPLATE, "run").agg(F.size(F.collect_set("j")).alias("found"), F.min("i").alias("start"), F.max("i").alias("last"))
    share = F.col("found") / F.greatest("grams", F.col("last") - F.col("start") + 1)
    end = F.col("last") + F.when(F.col("phrase"), SHORT).otherwise(LONG)
    return spans.select("blob", *OF_TEMPLATE, F.col("start").cast("long").alias("start"), end.cast("long").alias("end"), share.alias("share"))


FOUND = "array<struct<start:bigint,end:bigint,label:string,share:double,phrase:boolean>>"


def scan(docs: DataFrame, text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """docs with n_words, places (spans of whole phrases and of other templates with their least share, in order) and score, the largest share."""
    inner, of = masked(docs)
    own = of[text]
    spans = verified_spans(votes(inner, own, templates or TEMPLATES))
    taken = F.when(F.col("share") >= F.col("least"), F.struct("start", "end", "label", "share", "phrase"))
    # A table of the texts that have hits: the join with all rows is then free to split a text of which there are many copies.
    found = written(spans.groupBy("blob").agg(F.sort_array(F.collect_list(taken)).cast(FOUND).alias("places"), F.max("share").alias("score")), "licenses")
    out = inner.withColumns({"blob": F.sha2(text_or_empty(own), 256), "n_words": F.size(license_words(own)).cast("long")}).join(found, "blob", "left")
    out = out.withColumns({"places": F.coalesce("places", F.array().cast(FOUND)), "score": F.coalesce("score", F.lit(0.0))})
    return unmasked(out, of, "n_words", "places", "score")


def labels_of(places: Column) -> Column:
    """The distinct labels, sorted and comma-joined."""
    return F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")
