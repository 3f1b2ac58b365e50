"""Licence scans: notices found by TF-IDF cosine, and inherited from the nearest directory.

Only DataFrame functions. The units of a file are its lines and its paragraphs, both without comment
marks: a paragraph is what stands between blank lines, so a header wrapped over many lines of a comment is
one, and so is each part of a licence file. Every unit is compared with every template (short notices,
standard headers, the opening parts of full licence texts) by the cosine of sparse TF-IDF
vectors; a file's licence is that of its best unit at or above a threshold. Inverse document frequencies of the
templates' words are counted over all files; a word that no template holds weighs as much as the
rarest template word.

By the Cauchy-Schwarz inequality a unit that holds none of a template's heaviest words
cannot reach the threshold once the others' share of its length is below it, so only texts, and units,
with such a word are taken apart; no unit that could match is passed over.

A licence file (by its name) gives its licence to its directory. A file without a header
of its own takes the licence of its nearest ancestor directory that has one, found by
joining every directory with its ancestors.

Defined cases: a null text has no header; a file with a null path can have a header but
inherits nothing; rows that share a path are one file whose units are pooled, each row stays;
of several licence files in a directory, or several equally good templates, the best
score wins, then the first name. Clauses that follow a licence's opening are not weighed: the BSD
licences of two and three clauses are one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm.frames import bounded_rows
from stationlake.sources.shared import staged

# Short notices, standard headers and opening parts of public licences, marks of comments, and
# names of files that hold a licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                 "(at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                  "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
MARK_BEFORE = r"^[ \t\r]*(//+|/\*+|\*+/|\*+|#+|;+|<!--|-->|--+|%+)?[ \t\r]*"
MARK_AFTER = r"[ \t\r]*(\*+/|-->|\*+|#+)?[ \t\r]*\z"
LICENCE_FILES = r"(?i)^(licen[sc]e|copying|unlicense|notice)([-_.].*)?$"
APART = "[^a-z0-9]+"
THRESHOLD = 0.75


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), APART), lambda w: w != "")


def units_of(text: Column) -> Column:
    """The lines and paragraphs of a text, without comment marks."""
    bare = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.regexp_replace(F.regexp_replace(line, MARK_BEFORE, ""), MARK_AFTER, ""),
    )
    return F.array_union(bare, F.split(F.array_join(bare, "\n"), "\n\n+"))


def template_counts(templates: list[tuple[str, str]]) -> list[tuple[str, dict[str, int]]]:
    """(licence, term frequencies) of each template by name and text, by the same rule as units."""
    import re

    out = []
    for name, text in sorted(templates):
        counts: dict[str, int] = {}
        for w in re.split(APART, text.lower()):
            if w:
                counts[w] = counts.get(w, 0) + 1
        out.append((name, counts))
    return out


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Files, and files that hold each word of the templates. One counting pass."""
    held = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), APART),
                                     lambda w: w.isin(vocabulary)))
    # One row for each file and word, counted before anything moves; "" counts the files.
    counted = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in bounded_rows(counted, len(vocabulary) + 1)}
    return found.pop("", 0), found


def template_vectors(
    counts: list[dict[str, int]], n: int, df: dict[str, int]
) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Inverse document frequencies, and the templates as unit vectors."""
    words = sorted({w for c in counts for w in c})
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in words}
    vectors = []
    for c in counts:
        length = math.sqrt(sum((k * idf[w]) ** 2 for w, k in sorted(c.items())))
        vectors.append({w: k * idf[w] / length for w, k in c.items()})
    return idf, vectors


def anchors(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Words of which a unit must hold one to reach the threshold with any template."""
    out: set[str] = set()
    for vector in vectors:
        rest = 1.0
        for word, weight in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < (threshold - 1e-9) ** 2:
                break
            out.add(word)
            rest -= weight**2
    return sorted(out)


def headers(
    files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(path, own_license, own_score): the best unit of each file that reaches the threshold."""
    spark = files.sparkSession
    named = template_counts(templates)
    names, counts = [n for n, _ in named], [c for _, c in named]
    vocabulary = sorted({w for c in counts for w in c})
    idf, vectors = template_vectors(counts, *document_frequencies(files, vocabulary))
    heaviest, heavy = max(idf.values()), anchors(vectors, threshold)
    # Words are runs of a to z and digits, so a text has one of them where it stands between other characters.
    some = F.lower("text").rlike("(^|[^a-z0-9])(" + "|".join(heavy) + ")($|[^a-z0-9])")
    units = files.where(some).select("path", F.explode(units_of(F.col("text"))).alias("unit")).withColumn(
        "words", words_of(F.col("unit"))
    ).where(F.exists("words", lambda w: w.isin(heavy)))
    # Units of equal words give equal scores, so they are one row however often they stand.
    near = units.select("path", F.xxhash64("words").alias("unit"), "words").dropDuplicates(["path", "unit"])
    weights = spark.createDataFrame(
        [(w, idf[w], [v.get(w, 0.0) for v in vectors]) for w in vocabulary], "word string, idf double, weights array<double>"
    )
    terms = (
        near.select("path", "unit", F.explode("words").alias("word"))
        .groupBy("path", "unit", "word").agg(F.count("*").alias("tf"))
        .join(F.broadcast(weights), "word", "left")
        .withColumn("square", F.when(F.col("idf").isNotNull(), (F.col("tf") * F.col("idf")) ** 2)
                    .otherwise(F.col("tf") * F.lit(heaviest) ** 2))
    )
    # One pass over a unit's terms: its squared length, and its product with each template.
    products = [
        F.sum(F.col("tf") * F.col("idf") * F.col("weights")[k]).alias(f"p{k}") for k in range(len(vectors))
    ]
    scored = terms.groupBy("path", "unit").agg(F.sum("square").alias("square"), *products)
    best = reduce(
        lambda a, b: F.greatest(a, b),
        [
            F.struct(F.round(F.col(f"p{k}") / F.sqrt("square"), 9).alias("score"), F.lit(-k).alias("order"))
            for k in range(len(vectors))
        ],
    )
    top = scored.groupBy("path").agg(F.max(best).alias("best")).where(F.col("best.score") >= threshold)
    return top.select(
        "path", F.element_at(F.array(*[F.lit(n) for n in names]), 1 - F.col("best.order")).alias("own_license"),
        F.col("best.score").alias("own_score"),
    )


def directory_of(path: Column) -> Column:
    """The path without its last step; files at the top lie in ""."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """A directory and all directories above it, as (name, depth)."""
    steps = F.split(directory, "/")
    size = F.when(directory == "", 0).otherwise(F.size(steps))
    return F.transform(
        F.sequence(F.lit(0), size),
        lambda n: F.struct(F.array_join(F.slice(steps, F.lit(1), n), "/").alias("name"), n.alias("depth")),
    )


def inherited(files: DataFrame, found: DataFrame) -> DataFrame:
    """(directory, inherited_license, inherited_from): the nearest licence at or above."""
    licensed = (
        found.where(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILES))
        .groupBy(directory_of(F.col("path")).alias("name"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("back"), "own_license")).alias("best"))
        .select("name", F.col("best.own_license").alias("license"))
    )
    directories = files.where(F.col("path").isNotNull()).select(directory_of(F.col("path")).alias("directory")).distinct()
    above = directories.select("directory", F.explode(ancestors(F.col("directory"))).alias("above")).select(
        "directory", F.col("above.name").alias("name"), F.col("above.depth").alias("depth")
    )
    return above.join(licensed, "name").groupBy("directory").agg(
        F.max(F.struct("depth", "license", "name")).alias("nearest")
    ).select(
        "directory", F.col("nearest.license").alias("inherited_license"), F.col("nearest.name").alias("inherited_from")
    )


def scanned(
    files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``files`` without texts, with ``own_license``, ``own_score``, ``inherited_license``,
    ``inherited_from`` and ``license`` (the own one, else the inherited one)."""
    added = ["own_license", "own_score", "inherited_license", "inherited_from", "license"]
    files = files.drop(*added)
    found = staged(headers(files, templates, threshold), "license-headers")
    nearest = staged(inherited(files, found), "license-directories")
    kept = [c for c in files.columns if c != "text"]
    slim = files.select(*kept).withColumn("directory_", directory_of(F.col("path")))
    own = found.withColumnRenamed("path", "path_")
    return (
        slim.join(own, slim["path"].eqNullSafe(own["path_"]), "left")
        .join(nearest.withColumnRenamed("directory", "directory_"), "directory_", "left")
        .withColumn("license", F.coalesce("own_license", "inherited_license"))
        .select(*kept, *added)
    )


def oracle(path_sql: str, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan of ``documents`` as DuckDB SQL, without the filters on heavy words."""
    quoted = ", ".join(
        "({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(sorted(templates))
    )
    split = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    bare = (
        f"list_transform(string_split(coalesce(text, ''), chr(10)), "
        f"lambda l: regexp_replace(regexp_replace(l, '{MARK_BEFORE}', ''), '{MARK_AFTER}', ''))"
    )
    return f"""
WITH files AS (SELECT doc_id, {path_sql} AS path, text FROM documents),
templates(nr, name, notice) AS (VALUES {quoted}),
t AS (SELECT nr, name, word, count(*) AS tf FROM (SELECT nr, name, unnest({split.format('notice')}) AS word FROM templates) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT word FROM t),
held AS (SELECT word, count(*) AS df FROM (
  SELECT DISTINCT path, text, word FROM (SELECT path, text, unnest({split.format("coalesce(text, '')")}) AS word FROM files)
  SEMI JOIN vocabulary USING (word)) GROUP BY word),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(df, 0))) + 1 AS idf FROM vocabulary LEFT JOIN held USING (word)),
weights AS (SELECT nr, name, word, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY nr)) AS weight FROM t JOIN idf USING (word)),
bare AS (SELECT path, {bare} AS lines FROM files),
units AS (SELECT DISTINCT path, unnest(list_concat(lines, regexp_split_to_array(array_to_string(lines, chr(10)), '\\n\\n+'))) AS unit FROM bare),
terms AS (SELECT path, unit, word, count(*) AS tf FROM (SELECT path, unit, unnest({split.format('unit')}) AS word FROM units) GROUP BY ALL),
weighed AS (SELECT terms.*, idf.idf AS known, tf * coalesce(idf.idf, (SELECT max(idf) FROM idf)) AS w FROM terms LEFT JOIN idf USING (word)),
lengths AS (SELECT path, unit, sqrt(sum(CASE WHEN known IS NULL THEN w * w / tf ELSE w * w END)) AS length FROM weighed GROUP BY ALL),
scores AS (SELECT path, nr, name, round(sum(w * weight) / any_value(length), 9) AS score
  FROM weighed JOIN weights USING (word) JOIN lengths USING (path, unit) WHERE known IS NOT NULL GROUP BY path, unit, nr, name),
own AS (SELECT path, arg_min(name, (-score, nr)) AS own_license, max(score) AS own_score FROM scores GROUP BY path HAVING max(score) >= {threshold}),
licensed AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS name, arg_min(own_license, (-own_score, own_license)) AS license
  FROM own WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILES}') GROUP BY 1),
directories AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS directory FROM files WHERE path IS NOT NULL),
nearest AS (SELECT directory, arg_max(license, length(name)) AS inherited_license, arg_max(name, length(name)) AS inherited_from
  FROM directories JOIN licensed ON name = '' OR directory = name OR starts_with(directory, name || '/') GROUP BY directory)
SELECT doc_id, path, own_license, round(own_score, 6) AS own_score, inherited_license, inherited_from,
       coalesce(own_license, inherited_license) AS license
FROM files LEFT JOIN own USING (path) LEFT JOIN nearest ON directory = regexp_replace(path, '/?[^/]*$', '')
"""
