"""Licence scan: which paragraphs state a licence, and of which family. DataFrame functions only.

A multinomial logistic regression on word bigrams with an L1 penalty keeps few weights, so scoring a corpus is one lookup per bigram
in a small table. Paragraphs without any weighted bigram are unknown by the intercept alone. Predicted families are confirmed by the
templates' own wording.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railtempo.llm.settings import rows_of, sampled
from railtempo.session import checkpointed

# The usual notices of each family, one sentence or clause each.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "This software is released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
}
UNKNOWN = "unknown"


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Hashes of neighbouring words; a single word pairs with nothing."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))


def lines_of(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, paragraph, line): the lines of each whole text, numbered from 0."""
    return docs.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("paragraph", "line"))


def paragraphs(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, paragraph, lines, line): what is judged in each whole text. Every line that isn't blank, and every stretch of such lines joined to
    one, without the comment marks before and behind each. ``paragraph`` is the number of the first line, from 0; ``lines`` their count."""
    def numbered(line: Column, number: Column) -> Column:
        return F.when(line == "", "\x01").otherwise(F.concat(number.cast("string"), F.lit("\x02"), line))

    # control characters aren't part of words; here they mark blank lines and line numbers, so that one split finds the stretches
    bare = F.regexp_replace(F.translate(F.col(text), "\x01\x02", "  "), r"(?m)^[ \t\r\f/*#;%!<>|\-]++|(?<![ \t\r\f/*#<>|\-])[ \t\r\f/*#<>|\-]++$", "")
    clean = F.split(bare, "\n")
    stretches = F.split(F.array_join(F.transform(clean, numbered), "\n"), r"\n?\x01(?:\n\x01)*\n?")
    found = docs.select(*keys, F.explode(stretches).alias("_s")).filter("_s != ''").select(*keys, F.split("_s", "\n").alias("_s"))
    number, rest = "cast(substring_index({0}, '\x02', 1) as int)", "substring_index({0}, '\x02', -1)"
    single = f"transform(_s, l -> struct({number.format('l')} as paragraph, 1 as lines, {rest.format('l')} as line))"
    joined = (f"array(struct({number.format('_s[0]')} as paragraph, size(_s) as lines, "
              f"array_join(transform(_s, l -> {rest.format('l')}), ' ') as line))")
    return found.select(*keys, F.inline(F.expr(f"if(size(_s) > 1, concat({single}, {joined}), {single})")))


@dataclass
class LicenseModel:
    families: list[str]  # unknown comes first
    weights: dict[int, list[float]]  # of a bigram's hash, by family
    intercepts: list[float]
    sharpness: float  # what scores are multiplied by before they become probabilities


def template_rows(spark: SparkSession) -> DataFrame:
    rows = [{"family": f, "number": i, "line": t} for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    return rows_of(spark, rows, "family: string, number: int, line: string")


def train(docs: DataFrame, labelled: DataFrame | None = None, negatives: int = 4_000, vocabulary: int = 4_096, penalty: float = 2e-3,
          texts: int = 2_000) -> LicenseModel:
    """Fits the classifier. ``labelled`` has line and family; without it, the templates as they are, with words before and behind,
    and cut at either end stand for each family.

    At most ``negatives`` lines without a word of licensing, from a sample of about ``texts`` documents (hashes decide which), are the
    unknown class; these bounds are parameters of training only. Every fourth example is held out of the fit and sets the sharpness
    (a temperature) that makes the probabilities fit them best.
    """
    spark = docs.sparkSession
    some = sampled(docs.select(F.col("text").alias("t")), texts, "t").filter(F.length("t") <= 20_000)
    plain = lines_of(some, [], "t").filter(
        (F.length("line") >= 20) & ~F.col("line").rlike(r"(?i)licen[cs]|copyright|permission|redistribut|public domain"))
    lines = checkpointed(plain.select("line").distinct().orderBy(F.xxhash64("line", F.lit(3))).limit(negatives).withColumn("family", F.lit(UNKNOWN)))
    if labelled is None:
        templates = template_rows(spark).withColumn("w", F.split("line", " "))
        n = F.size("w")
        cuts = [F.col("w"), F.slice("w", 1, F.greatest(F.ceil(n * 0.8).cast("int"), F.lit(5))), F.slice("w", F.least(F.lit(2), n), n),
                F.concat(F.array(F.lit("Copyright"), F.lit("2020"), F.lit("the"), F.lit("authors.")), "w"),
                F.concat("w", F.array(F.lit("All"), F.lit("rights"), F.lit("reserved.")))]
        known = templates.select(F.explode(F.array(*(F.array_join(c, " ") for c in cuts))).alias("line"), "family")
        known = known.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(12)))).drop("_")  # a dozen of each, against thousands of unknown lines
    else:
        known = labelled.select("line", "family")
    examples = checkpointed(lines.union(known).withColumn("w", words_of("line")).withColumn(
        "grams", F.transform(_bigrams(F.col("w")), lambda h: h.cast("string"))).withColumn(
        "held", F.pmod(F.xxhash64("line", F.lit(9)), F.lit(4)) == 0))
    families = [UNKNOWN, *sorted(r[0] for r in known.select("family").distinct().collect())]
    at = F.map_from_arrays(F.array(*map(F.lit, families)), F.array(*(F.lit(float(i)) for i in range(len(families)))))
    counted = CountVectorizer(inputCol="grams", outputCol="x", vocabSize=vocabulary, minDF=2.0, binary=True).fit(examples)
    rows = counted.transform(examples.withColumn("label", at[F.col("family")])).select("label", "x", "held")
    # templates are few: all of them are fitted, and held-out lines only tune the sharpness
    fitted = LogisticRegression(labelCol="label", featuresCol="x", family="multinomial", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(
        rows.filter("not held or label > 0"))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    weights = {int(g): matrix[:, j].tolist() for j, g in enumerate(counted.vocabulary) if np.abs(matrix[:, j]).max() > 1e-6}
    held = rows.filter("held").limit(negatives).collect()
    scores = np.array([matrix @ r["x"].toArray() + intercepts for r in held]).reshape(len(held), len(families))
    truth = np.array([int(r["label"]) for r in held], dtype=int)

    def loss(s: float) -> float:
        z = scores * s
        top = z.max(1, keepdims=True)
        return float((np.log(np.exp(z - top).sum(1)) + top[:, 0] - z[np.arange(len(truth)), truth]).mean()) if len(truth) else 0.0

    return LicenseModel(families, weights, intercepts.tolist(), min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss))


def scan(
    docs: DataFrame, model: LicenseModel, keys: list[str], text: str = "text", threshold: float = 0.5, similarity: float = 0.8,
) -> DataFrame:
    """(keys, paragraph, lines, family, probability, similarity, confirmed) of every paragraph that the classifier doesn't call unknown.

    A paragraph is a line, or a stretch of ``lines`` lines without a blank one from line ``paragraph`` on: that is reported where it is
    confirmed and none of its lines is, as with wrapped notices, and then replaces its lines.

    ``similarity`` is the largest share of a template sentence's five-word shingles (its bigrams, if it has fewer than ten words) that
    the paragraph holds; ``confirmed`` where it reaches the parameter. A family below ``threshold`` is unknown. Null, empty
    and wordless texts have no such paragraph. Repeated rows give repeated findings if their keys differ, else one.
    Only the keys and the text are looked at.
    """
    spark = docs.sparkSession
    names = [f"_k{i}" for i in range(len(keys))]
    at = [*names, "paragraph", "lines", "_id"]  # the text itself does not travel with its bigrams; the few named ones fetch it again

    def as_judged(df: DataFrame) -> DataFrame:
        return paragraphs(df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(text).alias("_t")), names, "_t").withColumn(
            "_id", F.xxhash64("line"))

    judged = as_judged(docs)
    worded = judged.withColumn("_w", words_of("line")).filter("size(_w) > 1")
    table = rows_of(spark, [{"_gram": g, "_weights": w} for g, w in model.weights.items()], "_gram: bigint, _weights: array<double>")
    # one row per bigram; the weighted ones are bound by the vocabulary, so each task gets them all
    grams = worded.select(*at, F.explode(_bigrams(F.col("_w"))).alias("_h"))
    met = grams.join(F.broadcast(table), F.col("_h") == F.col("_gram")).select(*at, "_h", "_weights").dropDuplicates([*at, "_h"])
    size = len(model.families)
    sums = met.groupBy(*at).agg(*(F.sum(F.col("_weights")[i]).alias(f"_s{i}") for i in range(size)))
    scores = F.array(*((F.col(f"_s{i}") + model.intercepts[i]) * model.sharpness for i in range(size)))
    scored = sums.withColumn("_z", scores).withColumn("_top", F.array_max("_z"))
    best = scored.withColumn("_best", F.expr("array_position(_z, _top)")).withColumn(
        "probability", 1 / F.aggregate("_z", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("_top"))))
    family = F.element_at(F.array(*map(F.lit, model.families)), F.col("_best").cast("int"))
    named = best.withColumn("family", family).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= threshold))

    def shingles(n: int) -> Column:
        count = F.size("_w") - n + 1
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, n), " "), F.lit(n)))).otherwise(
            F.array().cast("array<bigint>"))

    # a template's distinct shingles (a few hundred, fixed above), and one that every paragraph has, which stands for none
    worded_templates = template_rows(spark).withColumn("_w", words_of("line")).select(
        F.col("family").alias("_family"), "number", F.array_distinct(F.when(F.size("_w") >= 10, shingles(5)).otherwise(shingles(2))).alias("_all"))
    pieces = worded_templates.select("_family", "number", F.size("_all").alias("_of"), F.explode("_all").alias("_piece"))
    pieces = pieces.union(pieces.select("_family", F.lit(-1), F.lit(0), F.lit(0).cast("bigint")).distinct())
    few = checkpointed(named.select(*(F.col(c).alias(f"_of{c}") for c in at), "family", "probability"))
    given = docs.select(*keys, text)
    mine = [given[k].eqNullSafe(F.col(f"_of{n}")) for k, n in zip(keys, names)]
    again = given.join(few.select(*(f"_of{n}" for n in names)).distinct(), mine, "left_semi")
    judged = as_judged(again)
    same = [judged[c].eqNullSafe(F.col(f"_of{c}")) for c in at]
    found = judged.join(few, same).withColumn("_w", words_of("line")).select(
        *at, "family", "probability", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), shingles(2), shingles(5))).alias("_h"))
    held = found.join(F.broadcast(pieces), (F.col("_h") == F.col("_piece")) & (F.col("family") == F.col("_family"))).groupBy(
        *at, "family", "probability", "number", "_of").agg(F.countDistinct("_h").alias("_n"))
    share = F.when(F.col("number") < 0, 0.0).otherwise(F.col("_n") / F.col("_of"))
    every = checkpointed(held.groupBy(*at, "family", "probability").agg(F.max(share).alias("similarity")).withColumn(
        "confirmed", F.col("similarity") >= similarity))
    # a confirmed stretch and its lines know each other by its number, on each line of it; only these few rows are exploded
    stretches = every.filter("lines > 1 and confirmed").select(
        *names, F.col("paragraph").alias("_stretch"), F.explode(F.sequence(F.col("paragraph"), F.col("paragraph") + F.col("lines") - 1)).alias("_line"))
    lines = every.filter("lines = 1")
    inside = [lines[n].eqNullSafe(stretches[n]) for n in names] + [lines["paragraph"] == stretches["_line"]]
    split = stretches.join(lines.filter("confirmed"), inside, "left_semi").select(*names, "_stretch").distinct()
    own = [stretches[n].eqNullSafe(split[n]) for n in names] + [stretches["_stretch"] == split["_stretch"]]
    whole = stretches.join(split, own, "left_anti")
    kept = lines.join(whole, [lines[n].eqNullSafe(whole[n]) for n in names] + [lines["paragraph"] == whole["_line"]], "left_anti")
    first = whole.filter("_line = _stretch")
    blocks = every.filter("lines > 1 and confirmed")
    blocks = blocks.join(first, [blocks[n].eqNullSafe(first[n]) for n in names] + [blocks["paragraph"] == first["_stretch"]], "left_semi")
    return kept.unionByName(blocks).select(
        *(F.col(n).alias(k) for n, k in zip(names, keys)), "paragraph", "lines", "family", "probability", "similarity", "confirmed")
