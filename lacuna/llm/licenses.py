"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Lines that speak of licences (ANCHOR, looked for in the whole text), and windows of WINDOWS words around each such word, over line ends too, are
compared with notice templates as sparse TF-IDF vectors: a notice inside a long line, or wrapped over lines, isn't diluted. Document
frequencies are counted over all these units of all files and over the templates. A file's own licence is the best template at or above MIN_COSINE. A
directory declares what most of its own files declare (in `named` mode only files named LICENSE, COPYING, NOTICE count). A file without
its own licence takes that of its directory, or else of the nearest ancestor directory that declares one.

Directories are exploded into their ancestors once per directory, not per file, and joined by path. The templates are fixed, so their terms are
broadcast; everything else is joined by key.

Defined results: null text has no licence of its own; a null path is the root directory; ties go to the higher cosine, then to the
licence that sorts first; repeated rows are scanned alike; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, stored, text_or_empty

ANCHOR = r"(?i)licen[sc]e|copyright|spdx|permission is hereby|public domain|redistribution"
ANCHOR_WORD = r"^(licen[sc]e[sd]?|copyright|spdx|permission|public|redistributions?)$"
#: Lengths of the windows around a word that speaks of licences: about those of the templates.
WINDOWS = (6, 12, 24)
LICENCE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
MIN_COSINE = 0.5
#: Notices of well-known licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0, Creative Commons Attribution 4.0 International."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under Creative Commons Attribution-NonCommercial 4.0 International."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0 International."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
)


def _terms(text) -> F.Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def licence_lines(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, terms) of lines with an anchor."""
    t = text_or_empty(text)
    lines = files.filter(t.rlike(ANCHOR)).select(F.col(key).alias("doc_id"), F.posexplode(F.split(t, "\n", -1)).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(ANCHOR)).select("doc_id", "line_no", _terms("line").alias("terms"))


def licence_windows(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no null, terms) of the windows around each anchor word: it stands at the start, in the middle and at the end of a window."""
    t, most = text_or_empty(text), max(WINDOWS)
    words = files.filter(t.rlike(ANCHOR)).select(F.col(key).alias("doc_id"), _terms(t).alias("w"))
    near = F.transform("w", lambda x, i: F.when(x.rlike(ANCHOR_WORD), i))
    places = words.select("doc_id", "w", F.explode(F.array_compact(near)).alias("at"))
    first = F.greatest(F.col("at") - most, F.lit(0))
    # of a long text only the surroundings go on
    about = places.select("doc_id", (F.col("at") - first).alias("at"), F.slice("w", first + 1, F.lit(2 * most)).alias("w"))
    cuts = F.array(*(F.struct(F.lit((n - 1) * q // 2).alias("before"), F.lit(n).alias("n")) for n in WINDOWS for q in range(3)))
    rows = about.select("doc_id", "at", "w", F.explode(cuts).alias("c")).select("doc_id", F.slice("w", F.greatest(F.col("at") - F.col("c.before"), F.lit(0)) + 1, F.col("c.n")).alias("terms"))
    return rows.select("doc_id", F.lit(None).cast("int").alias("line_no"), "terms").distinct()


def own_licences(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, licence, cosine, line_no): the best match of each file that has one."""
    spark = files.sparkSession
    # the same lines in different files are compared once
    lines = stored(licence_lines(files).unionByName(licence_windows(files)), "licence-lines")
    forms = lines.groupBy("terms").agg(F.count(F.lit(1)).alias("n")).withColumn("form", F.xxhash64("terms"))
    names = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES)], "template int, licence string, notice string").select("template", "licence", _terms("notice").alias("terms"))
    total = lines.agg(F.count(F.lit(1)).alias("n_lines")).select((F.col("n_lines") + len(TEMPLATES)).alias("n_lines"))
    df = forms.select("n", F.explode(F.array_distinct("terms")).alias("term")).unionByName(names.select(F.lit(1).cast("long").alias("n"), F.explode(F.array_distinct("terms")).alias("term")))
    # n_lines is one row
    idf = df.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total)).select("term", (F.log((F.col("n_lines") + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    def vectors(rows: DataFrame, by: str) -> DataFrame:
        tf = rows.select(by, F.explode("terms").alias("term")).groupBy(by, "term").agg(F.count(F.lit(1)).alias("tf")).join(idf, "term").select(by, "term", (F.col("tf") * F.col("idf")).alias("x"))
        norm = tf.groupBy(by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        return tf.join(norm, by).select(by, "term", (F.col("x") / F.col("norm")).alias("x"))

    wanted = vectors(names, "template").withColumnRenamed("x", "y")
    # TEMPLATES is fixed: a few hundred terms
    cosines = vectors(forms.select("form", "terms").dropDuplicates(["form"]), "form").join(F.broadcast(wanted), "term").groupBy("form", "template").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("cosine"))
    best = cosines.filter(F.col("cosine") >= min_cosine).join(F.broadcast(names.select("template", "licence")), "template")
    best = best.groupBy("form").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")).select("form", "b.c", "b.licence")
    found = lines.select("doc_id", "line_no", F.xxhash64("terms").alias("form")).join(best, "form")
    return found.groupBy("doc_id").agg(F.min(F.struct("c", "licence", "line_no")).alias("b")).select("doc_id", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), F.col("b.line_no").alias("line_no"))


def inherited(files: DataFrame, own: DataFrame, named: bool = False) -> DataFrame:
    """Every file (doc_id, path) with its own licence, the effective one and the directory that it comes from."""
    rows = files.select("doc_id", F.coalesce("path", F.lit("/")).alias("path")).withColumn("directory", F.regexp_replace("path", r"/[^/]*$", "")).join(own, "doc_id", "left")
    rows = stored(rows, "licence-files")
    says = rows.filter("licence is not null")
    says = says.filter(F.col("path").rlike(LICENCE_NAME)) if named else says
    declared = says.groupBy("directory", "licence").count().groupBy("directory").agg(F.min(F.struct((-F.col("count")).alias("n"), "licence")).alias("b")).select(F.col("directory").alias("ancestor"), F.col("b.licence").alias("inherited"))
    parts = F.split("directory", "/")
    dirs = rows.select("directory").distinct().select("directory", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    dirs = dirs.withColumn("ancestor", F.concat_ws("/", F.slice(parts, F.lit(1), F.col("depth"))))
    nearest = dirs.join(declared, "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "ancestor", "inherited")).alias("b")).select("directory", F.col("b.ancestor").alias("ancestor"), F.col("b.inherited").alias("inherited"))
    sizes = rows.groupBy("directory").agg(F.count(F.lit(1)).alias("n"))
    facts = sizes.join(nearest, "directory", "left").drop("n")
    out = spread_join(rows, facts, ["directory"], sizes, rows.count())
    from_own = F.col("licence").isNotNull()
    return out.select(
        "doc_id", "path", F.col("licence").alias("own_licence"), "cosine", F.coalesce("licence", "inherited").alias("effective_licence"),
        F.when(from_own, F.lit("own")).when(F.col("inherited").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
        F.when(~from_own, F.col("ancestor")).alias("inherited_from"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files in source/language/block directories. One whose first line speaks of a licence is its directory's LICENSE file, and only these
    declare a licence for others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.expr("doc_id div 1000").cast("string"), F.lit("-")), F.concat(F.when(F.substring_index(text_or_empty(), "\n", 1).rlike(ANCHOR), "LICENSE-").otherwise(""), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    return inherited(docs.select("doc_id", path.alias("path")), own_licences(docs), named=True)
