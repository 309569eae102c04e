"""Licence scan: TF-IDF cosine to licence templates, then inheritance along directories. DataFrame functions only.

Inverse document frequencies of all terms are counted over all documents. A template is compared with every window of the text that has as
many words as it (line breaks count as spaces; a shorter text is one window) and holds an anchor: a template's anchors are its
heaviest terms, as many as it takes for the rest to be unable to reach the threshold, so no window that reaches it is lost. Cosines are
sparse: windows' terms join the templates' postings. A document gives its licence to its directory if its file name says that it is a licence
file or, with ``by_content``, if a notice takes at least half of its words; a document without a licence of its own takes that of
its nearest ancestor directory (the first by name where a directory has several).

Null and empty texts have no licence of their own; a null path inherits nothing; null doc_ids and repeated rows are
scanned row by row; of equal scores the first licence by name counts; an empty table gives no rows; very long texts are scanned whole;
other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import columns, let, save

#: Notices by SPDX identifier (fixed values).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
TERM = r"[a-z0-9]+"
THRESHOLD = 0.75
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"


def templates() -> list[tuple[int, str, list[str]]]:
    """Number, licence and terms of every template."""
    return [(k, name, re.findall(TERM, t.lower())) for k, (name, t) in enumerate((name, t) for name, ts in TEMPLATES.items() for t in ts)]


def idf(n: int, total: int) -> float:
    return math.log((total + 1) / (n + 1)) + 1


def anchors(weights: dict[str, float], threshold: float) -> list[str]:
    """The heaviest terms of a template, without which a text can't reach ``threshold``."""
    norm = rest = sum(x * x for x in weights.values())
    out = []
    for t in sorted(weights, key=lambda t: (-weights[t], t)):
        if rest < threshold * threshold * norm * (1 - 1e-9):
            break
        out.append(t)
        rest -= weights[t] ** 2
    return out


def scan_licenses(docs: DataFrame, path_column: str | None = None, threshold: float = THRESHOLD, by_content: bool = False) -> DataFrame:
    """doc_id, own_license, score, n_segments (starts of windows that reach the threshold), inherited_from and license of every row."""
    spark = docs.sparkSession
    rows = columns(docs, doc_id="long", text="string", **({path_column: "string"} if path_column else {}))
    rows = rows.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), (F.col(path_column) if path_column else F.lit(None).cast("string")).alias("path"))
    terms = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    seen = save(rows.select(F.explode(F.array_distinct(terms)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")), "licence-df")
    total = rows.count()
    every = templates()
    vocabulary = sorted({t for _, _, ts in every for t in ts})
    df = {r["t"]: r["df"] for r in seen.filter(F.col("t").isin(vocabulary)).collect()}  # by the templates' terms
    weigh = {k: {t: n * idf(df.get(t, 0), total) for t, n in Counter(ts).items()} for k, _, ts in every}
    postings = [(k, t, x / math.sqrt(sum(y * y for y in w.values()))) for k, w in weigh.items() for t, x in w.items()]
    held = [(k, name, len(ts), t) for k, name, ts in every for t in anchors(weigh[k], threshold)]
    any_anchor, most = sorted({t for *_, t in held}), max(len(ts) for *_, ts in every)
    has_anchor = r"(?<![a-z0-9])(" + "|".join(any_anchor) + r")(?![a-z0-9])"

    def places(w: Column) -> Column:
        around = lambda i: F.slice(w, F.greatest(i - most + 1, F.lit(0)) + 1, F.lit(2 * most - 1))
        marked = F.transform(w, lambda t, i: F.when(t.isin(any_anchor), F.struct(i.alias("i"), t.alias("t"), around(i).alias("near"), F.size(w).alias("n"))))
        return F.filter(marked, lambda x: x.isNotNull())

    found = F.when(F.col("text").rlike(has_anchor), let(terms, places))
    scanned = save(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "path", found.alias("places")), "licence-places")
    by_anchor = F.broadcast(spark.createDataFrame(held, "tpl int, name string, len int, t string"))  # the templates' anchors
    hits = scanned.select("rid", F.explode("places").alias("p")).select("rid", "p.*").join(by_anchor, "t")
    begin = F.sequence(F.greatest(F.col("i") - F.col("len") + 1, F.lit(0)), F.least(F.col("i"), F.greatest(F.col("n") - F.col("len"), F.lit(0))))
    hits = hits.withColumn("at", F.explode(begin))
    window = F.slice("near", F.col("at") - F.greatest(F.col("i") - most + 1, F.lit(0)) + 1, F.col("len"))
    windows = hits.select("rid", "tpl", "name", "at", "n", window.alias("w")).dropDuplicates(["rid", "tpl", "at"])
    tf = windows.select("rid", "tpl", "name", "at", "n", F.size("w").alias("len"), F.explode("w").alias("t")).groupBy("rid", "tpl", "name", "at", "n", "len", "t").agg(F.count(F.lit(1)).alias("k"))
    tf = save(tf, "licence-terms")
    used = seen.join(tf.select("t").distinct(), "t", "left_semi").select("t", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    posts = F.broadcast(spark.createDataFrame(postings, "tpl int, t string, tw double"))  # the templates' terms
    weighed = tf.join(used, "t").withColumn("w", F.col("k") * F.col("idf")).join(posts, ["tpl", "t"], "left")
    cosine = F.sum(F.col("w") * F.coalesce("tw", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w")))
    close = weighed.groupBy("rid", "tpl", "name", "at", "n", "len").agg(F.round(cosine, 9).alias("score")).filter(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "name")).alias("m")
    own = close.groupBy("rid").agg(best, F.count_distinct("at").alias("n_segments"), F.max(2 * F.col("len") >= F.col("n")).alias("notice"))
    own = own.select("rid", F.col("m.name").alias("own_license"), (-F.col("m.minus")).alias("score"), "n_segments", "notice")
    out = save(scanned.select("rid", "doc_id", "path").join(own, "rid", "left"), "licence-own")
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    is_file = F.col("path").rlike(LICENCE_FILE) | (F.lit(by_content) & F.coalesce("notice", F.lit(False)))
    given = out.filter(is_file & F.col("own_license").isNotNull()).groupBy(folder.alias("dir")).agg(F.min("own_license").alias("given"))
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    wants = out.filter(F.col("own_license").isNull() & F.col("path").isNotNull()).select("rid", F.explode(F.array_distinct(above)).alias("dir"))
    taken = wants.join(given, "dir").groupBy("rid").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "given")).alias("g"))
    out = out.join(taken, "rid", "left")
    return out.select("doc_id", "own_license", "score", F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"), F.col("g.dir").alias("inherited_from"), F.coalesce("own_license", "g.given").alias("license"))
