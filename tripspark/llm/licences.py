"""Licence scans by an exact set-similarity join, in Spark expressions only.

Text blocks (paragraphs between blank lines) and licence templates are sets of words. A block matches a template
when it holds at least `CONTAINED` of the template's words. Words are ordered by the number of blocks that hold
them, over the whole corpus, rarest first. A matching pair shares a word in the prefixes of both sides; pairs meet
by an equality join on prefix words, pass the length and positional filters, and are verified by intersection.
Words that no template has cannot add to an overlap and are left out of the sets.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.llm.common import join_sized

CONTAINED = 0.8

#: Phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licence notices, label and text. The words of the public notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "This work is released under the MIT License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
)

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words before lower-casing
_BLANK = r"\n[\x20\x09\x0D]*\n"


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(_GAP, text.lower()) if w))


def _tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, _GAP), "")


def base_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __scan, a struct of n_words, n_base, first_word, last_word and the found base labels."""
    found = docs.withColumn("__w", _tokens(F.coalesce(F.col(text), F.lit(""))))
    # each word with a space on both sides; cut before each phrase, whose first word then opens a part
    line = F.concat(F.lit(" "), F.lower(F.array_join("__w", " ")), F.lit(" "))
    found = found.withColumn("__line", line)
    any_phrase = "|".join(PHRASES)
    found = found.withColumn("__parts", F.split("__line", f" (?=(?:{any_phrase}) )"))
    n = F.size("__w").cast("long")
    places = (F.size("__parts") - 1).cast("long")
    count = lambda c: F.size(F.array_remove(F.split(c, " "), "")).cast("long")
    labels = F.array(*[F.when(F.contains("__line", F.lit(f" {p} ")), F.lit(v)) for p, v in PHRASES.items()])
    scan = F.struct(
        n.alias("n_words"),
        places.alias("n_base"),
        F.when(places > 0, count(F.get("__parts", F.lit(0)))).alias("first_word"),
        F.when(places > 0, n - count(F.element_at("__parts", -1))).alias("last_word"),
        F.array_compact(labels).alias("labels"),
    )
    return found.withColumn("__scan", scan).drop("__w", "__line", "__parts")


def blocks(docs: DataFrame, id_col: str, text: str, vocabulary: list[str]) -> DataFrame:
    """(id, sig, b): the set of template words of every block; blocks without any are left out."""
    cut = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text)).alias("sig"),
        F.explode(F.split(F.coalesce(F.col(text), F.lit("")), _BLANK)).alias("block"),
    )
    known = F.array(*[F.lit(w) for w in vocabulary])
    sets = cut.select("id", "sig", F.array_intersect(_tokens(F.lower("block")), known).alias("b"))
    return sets.filter(F.size("b") > 0)


def _ordered(vocabulary: list[str], counts: dict[str, int]) -> dict[str, int]:
    """Rank of every template word, rarest first; ties by the word."""
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def matches(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(id, sig, label, overlap, size): every block and template at or above the containment threshold.

    The counts of template words (as many rows as the templates have words) are read on the driver to order them.
    """
    sets = [(label, template_words(t)) for label, t in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    held = blocks(docs, id_col, text, vocabulary)
    counts = held.select(F.explode("b").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rank = _ordered(vocabulary, {r.w: r.n for r in counts.collect()})

    postings, prefix_words = [], set()
    for label, s in sets:
        ranks = sorted(rank[w] for w in s)
        need = math.ceil(contained * len(ranks) - 1e-9)
        for at, r in enumerate(ranks[: len(ranks) - need + 1]):
            postings.append((r, at, label, ranks, len(ranks), need))
            prefix_words.add(r)
    by_rank = {r: w for w, r in rank.items()}
    posted = docs.sparkSession.createDataFrame(
        postings, "rank int, t_at int, label string, t array<int>, t_size int, need int"
    )  # one row for each prefix word of each template: bounded by the templates

    rare = F.array(*[F.lit(by_rank[r]) for r in sorted(prefix_words)])
    least = min(p[5] for p in postings)
    table = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.lit(rank[w]))])
    near = held.filter((F.size("b") >= least) & F.arrays_overlap("b", rare))
    ranked = near.select("id", "sig", F.array_sort(F.transform("b", lambda w: F.element_at(table, w))).alias("b"))
    opened = ranked.select("id", "sig", "b", F.size("b").alias("b_size"), F.posexplode("b").alias("b_at", "rank"))
    met = opened.join(F.broadcast(posted), "rank")
    met = met.filter("b_size >= need AND b_at <= b_size - need AND 1 + least(b_size - b_at - 1, t_size - t_at - 1) >= need")
    overlap = F.size(F.array_intersect("b", "t"))
    return met.withColumn("overlap", overlap).filter("overlap >= need").select("id", "sig", "label", "overlap", F.col("t_size").alias("size"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """``docs`` with __scan (see `base_scan`), __labels (base and template labels, sorted) and __score.

    __score is 1 where a base phrase stands, else the largest contained share of a matched template, else 0.
    Null text is empty and has no words; rows with equal id and text get equal results and stay separate rows; a
    null id is an id; an empty table gives an empty table; other columns pass through.
    """
    share = F.max(F.col("overlap") / F.col("size"))
    best = matches(docs, id_col, text, templates, contained).groupBy("id", "sig").agg(share.alias("__best"), F.collect_set("label").alias("__own"))
    best = best.select(F.col("id").alias("__id"), F.col("sig").alias("__sig"), "__best", "__own")
    based = base_scan(docs, text)
    same = based[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(based[text]) == F.col("__sig"))
    joined = join_sized(based, best, same, "left")
    labels = F.array_sort(F.array_distinct(F.concat("__scan.labels", F.coalesce("__own", F.array().cast("array<string>")))))
    score = F.when(F.col("__scan.n_base") > 0, 1.0).otherwise(F.coalesce(F.round("__best", 6), F.lit(0.0)))
    return joined.withColumns({"__labels": labels, "__score": score}).drop("__id", "__sig", "__best", "__own")


def op6_licences(docs: DataFrame) -> DataFrame:
    """Contract columns of the licence scan, one row per document."""
    got = scan(docs.select("doc_id", "text"))
    s = F.col("__scan")
    return got.select(
        "doc_id",
        s["n_words"].alias("n_words"),
        s["n_base"].alias("n_base"),
        s["first_word"].alias("first_word"),
        s["last_word"].alias("last_word"),
        F.array_join(F.array_sort(s["labels"]), ",").alias("base_labels"),
        F.array_join("__labels", ",").alias("labels"),
        F.col("__score").alias("score"),
    )


def oracle_sql() -> str:
    """The same by comparing every block with every template."""
    quoted = lambda s: s.replace("'", "''")
    rows = ", ".join(f"('{quoted(label)}', [{', '.join(repr(w) for w in template_words(t))}])" for label, t in TEMPLATES)
    phrases = ", ".join(f"('{p}', '{v}', {len(p.split())})" for p, v in PHRASES.items())
    gap = _GAP.replace("'", "''")
    return rf"""
WITH tpl(label, t) AS (VALUES {rows}),
phrase(p, label, k) AS (VALUES {phrases}),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(lower(text), '{gap}'), lambda x: x <> '') AS ws FROM d),
one AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
hit AS (SELECT rid, i - 1 AS place, label FROM one JOIN phrase ON ws[i] = string_split(p, ' ')[1]
        AND array_to_string(ws[i:i + k - 1], ' ') = p),
base AS (SELECT rid, count(*)::BIGINT AS n, min(place) AS first_word, max(place) AS last_word FROM hit GROUP BY rid),
blk AS (SELECT rid, unnest(string_split_regex(lower(text), '{_BLANK}')) AS block FROM d),
sets AS (SELECT rid, list_distinct(list_filter(string_split_regex(block, '{gap}'), lambda x: x <> '')) AS b FROM blk),
own AS (SELECT rid, label, max(len(list_intersect(b, t)) / len(t)::DOUBLE) AS share FROM sets, tpl
        WHERE len(list_intersect(b, t)) >= ceil({CONTAINED} * len(t) - 1e-9) GROUP BY rid, label),
best AS (SELECT rid, max(share) AS share FROM own GROUP BY rid),
lab AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM own UNION SELECT rid, label FROM hit) GROUP BY rid),
bl AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT rid, label FROM hit) GROUP BY rid)
SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base,
       base.first_word::BIGINT AS first_word, base.last_word::BIGINT AS last_word,
       coalesce(bl.labels, '') AS base_labels, coalesce(lab.labels, '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(round(best.share, 6), 0.0::DOUBLE) END AS score
FROM d JOIN w ON d.rid = w.rid LEFT JOIN base ON d.rid = base.rid LEFT JOIN best ON d.rid = best.rid
LEFT JOIN lab ON d.rid = lab.rid LEFT JOIN bl ON d.rid = bl.rid
"""
