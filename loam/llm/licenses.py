"""License scans by an exact set-similarity join (operator 5), DataFrame functions only.

The base labels come from phrases of consecutive words. The operator adds labels of its own: every text block
whose words hold at least a given share of a license template's distinct words, found by a prefix-filtered join. Blocks are
the lines, of any length, for templates of LINE_WORDS words at least, and every word window of a text, over line ends, that is
as long as the template. The
templates' tokens are ordered by their frequency in the whole corpus, rarest first; a block can only reach the
threshold if it holds one of a template's first |T| - ceil(t |T|) + 1 tokens. Candidates pass the length and the positional
filter and are then verified on the full sets, so the join misses nothing.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import ascii_lower, table, text_or_empty, written
from loam.llm.decontaminate import words

#: Phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences by which works state their license; the label is the operator's own.
TEMPLATES = [
    ("notice:apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("notice:gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("notice:gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("notice:mit", "Released under the MIT License"),
    ("notice:mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("notice:cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("notice:cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("notice:bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("notice:mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("notice:all-rights-reserved", "All rights reserved"),
]
THRESHOLD = "0.8"
#: A template of fewer distinct words is only compared with windows of its own length: in a long line its words stand by chance.
LINE_WORDS = 5
#: Distinct template tokens of one pass; more templates are scanned in parts, each with its own passes over the blocks.
MAX_TOKENS = 20_000


def phrase_places(w: Column, phrase: str) -> Column:
    """0-based starts of a phrase's words in the word array w."""
    parts = phrase.split()
    whole = F.exists(w, lambda x: x == max(parts, key=len))  # cheap test first: most texts hold no license word
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _all(F.get(w, i + k) == p for k, p in enumerate(parts)))
    return F.when(whole, starts).otherwise(F.array().cast("array<int>"))


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def base_labels(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with n_words, places (array of (start, label))."""
    w = rows.withColumn("w", words(F.col("text")))

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(phrase_places(F.col("w"), phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    places = F.concat(*[labelled(*p) for p in PHRASES.items()])
    return w.withColumn("n_words", F.size("w")).withColumn("places", places).drop("w")


def template_table(spark: SparkSession, templates=None) -> DataFrame:
    """(template, label, tokens, width): distinct words of each template and their number in all; templates without words are left out."""
    rows = [(k, label, text) for k, (label, text) in enumerate(TEMPLATES if templates is None else templates)]
    t = spark.createDataFrame(rows, "template int, label string, text string")
    t = t.select("template", "label", words(text_or_empty()).alias("w"))
    return t.select("template", "label", F.array_distinct("w").alias("tokens"), F.size("w").alias("width")).where(F.size("tokens") > 0)


def template_parts(known: DataFrame) -> list[DataFrame]:
    """The rows of a template table in parts of at most MAX_TOKENS distinct tokens; a template of more is a part of its own."""
    parts: list[list[int]] = []
    held: set[str] = set()
    for r in sorted(known.collect(), key=lambda r: r["template"]):
        if not parts or len(held | set(r["tokens"])) > MAX_TOKENS:
            parts.append([])
            held = set()
        parts[-1].append(r["template"])
        held |= set(r["tokens"])
    return [known.where(F.col("template").isin(p)) for p in parts]


def containment_join(blocks: DataFrame, templates: DataFrame, threshold: str = THRESHOLD) -> DataFrame:
    """(key columns of blocks, template, label, containment): all pairs with |B and T| >= threshold * |T|, exactly.

    blocks: key columns and tokens (distinct words, an array; null or empty: never matches). Equal blocks each get their
    rows. The token order and the prefix index have the size of the templates (see template_parts); blocks meet the
    index by token, after those that hold no token of a template's prefix are gone.
    """
    share = Fraction(threshold)
    keys = [c for c in blocks.columns if c != "tokens"]
    vocabulary = sorted(r[0] for r in templates.select(F.explode("tokens")).distinct().collect())
    if not vocabulary:
        return blocks.select(*keys, F.lit(0).alias("template"), F.lit("").alias("label"), F.lit(0.0).alias("containment")).where(F.lit(False))
    known = F.filter("tokens", lambda x: x.isin(vocabulary))
    # written, as it is read twice and only holds template tokens: the texts are split once
    near = written(blocks.select(*keys, F.size("tokens").alias("n"), known.alias("tokens")).where(F.size("tokens") > 0))
    counts = near.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    df = {r["token"]: r["df"] for r in counts.collect()}  # a row for each template token
    order = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (df.get(t, 0), t)))}
    index, sets = [], []
    for r in templates.collect():
        ranks = sorted(order[t] for t in r["tokens"])
        need = -(-len(ranks) * share.numerator // share.denominator)
        sets.append((r["template"], r["label"], ranks, need))
        index += [(x, r["template"], pos, len(ranks), need) for pos, x in enumerate(ranks[: len(ranks) - need + 1])]
    spark = blocks.sparkSession
    index = spark.createDataFrame(index, "rank int, template int, pos int, size int, need int")
    sets = spark.createDataFrame(sets, "template int, label string, ranks array<int>, need int")
    ranked = spark.createDataFrame(list(order.items()), "token string, rank int")
    prefix = [r["token"] for r in ranked.join(index, "rank").select("token").distinct().collect()]
    as_map = F.create_map(*[F.lit(x) for t in order.items() for x in t]) if len(order) <= 500 else None
    live = near.where(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in prefix]))).withColumn("block", F.monotonically_increasing_id())
    if as_map is not None:
        live = live.withColumn("ranks", F.array_sort(F.transform("tokens", lambda t: as_map[t])))
    else:
        live = live.select(*keys, "n", "block", F.explode("tokens").alias("token")).join(F.broadcast(ranked), "token").groupBy(*keys, "n", "block").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    probe = live.select(*keys, "block", "n", "ranks", F.posexplode("ranks").alias("at", "rank")).join(F.broadcast(index), "rank")
    length = F.col("n") >= F.col("need")
    position = 1 + F.least(F.col("size") - F.col("pos") - 1, F.size("ranks") - F.col("at") - 1) + F.least(F.col("pos"), F.col("at")) >= F.col("need")
    candidate = probe.where(length & position).dropDuplicates(["block", "template"]).select(*keys, "template", F.col("ranks").alias("mine"))
    common = F.size(F.array_intersect("mine", "ranks"))
    return candidate.join(F.broadcast(sets), "template").where(common >= F.col("need")).select(*keys, "template", "label", (common / F.size("ranks")).alias("containment"))


def window_join(texts: DataFrame, templates: DataFrame, threshold: str = THRESHOLD) -> DataFrame:
    """(key columns of texts, template, label, containment): the best window of each text for each template that a window of
    width consecutive words reaches, exactly. texts: key columns and w (words in order, an array).

    A window that reaches the threshold holds a token of the template's prefix, so only windows around such tokens are made,
    and only where all words that these windows can hold reach it together. Equal texts with equal keys give one row.
    """
    share = Fraction(threshold)
    keys = [c for c in texts.columns if c != "w"]
    rows = templates.collect()
    vocabulary = {t for r in rows for t in r["tokens"]}
    if not vocabulary:
        return texts.select(*keys, F.lit(0).alias("template"), F.lit("").alias("label"), F.lit(0.0).alias("containment")).where(F.lit(False))
    # any order of tokens will do; those in few templates, then the long ones, stand in for the rare ones
    times = {t: sum(t in r["tokens"] for r in rows) for t in vocabulary}
    index = []
    for r in rows:
        ordered = sorted(r["tokens"], key=lambda t: (times[t], -len(t), t))
        need = -(-len(ordered) * share.numerator // share.denominator)
        index += [(t, r["template"], r["label"], ordered, need, r["width"]) for t in ordered[: len(ordered) - need + 1]]
    prefix = sorted({t for t, *_ in index})
    index = texts.sparkSession.createDataFrame(index, "token string, template int, label string, tokens array<string>, need int, span int")
    reach = max(r["width"] for r in rows)
    live = texts.where(F.arrays_overlap("w", F.array(*[F.lit(t) for t in prefix])))
    around = F.filter(
        F.transform("w", lambda x, i: F.when(x.isin(prefix), F.struct(x.alias("token"), F.least(i, F.lit(reach - 1)).alias("before"), F.slice("w", F.greatest(F.lit(1), i - (reach - 2)), F.least(i, F.lit(reach - 1)) + reach).alias("near")))),
        lambda a: a.isNotNull(),
    )
    probe = live.select(*keys, F.inline(around)).join(F.broadcast(index), "token")
    first = F.greatest(F.lit(1), F.col("before") - F.col("span") + 2)
    near = F.slice("near", first, F.col("before") + 1 - first + F.col("span"))
    probe = probe.withColumn("last", F.col("before") + 2 - first).withColumn("near", near).where(F.size(F.array_intersect("near", "tokens")) >= F.col("need"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("last")), lambda i: F.size(F.array_intersect(F.slice("near", i, F.col("span")), F.col("tokens")))))
    found = probe.select(*keys, "template", "label", "need", F.size("tokens").alias("size"), best.alias("common")).where("common >= need")
    return found.groupBy(*keys, "template", "label").agg(F.max(F.col("common") / F.col("size")).alias("containment"))


def _may_hold_window(known: DataFrame, threshold: str) -> Column:
    """Texts whose windows can add to their lines' labels: those of several lines, and for the short templates, which lines are not
    compared with, texts that hold all their words as strings (all texts where a template needs fewer than all)."""
    share, text, out = Fraction(threshold), ascii_lower(F.col("text")), F.contains("text", F.lit("\n"))
    for r in known.where(F.size("tokens") < LINE_WORDS).collect():
        need = -(-len(r["tokens"]) * share.numerator // share.denominator)
        every = F.lit(True)
        for t in r["tokens"] if need == len(r["tokens"]) else []:
            every = every & F.contains(text, F.lit(t))
        out = out | every
    return out


def scan_licenses(docs: DataFrame, templates=None, threshold: str = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, places, notices (array of (label, containment)), score.

    Null texts count as empty and have no words and no labels. Blocks are the lines of a text, of any length (for templates of
    LINE_WORDS distinct words at least), and its word windows as long as the template, over line ends too. Repeated rows and rows with null or repeated ids give one row each; other columns are not read. score: 1 with a base label,
    else the best containment, else 0.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64("text").alias("print"))
    lines = rows.select("doc_id", "print", F.explode(F.split("text", "\n", -1)).alias("line"))
    blocks = lines.select("doc_id", "print", F.array_distinct(words(F.col("line"))).alias("tokens"))
    known = template_table(spark, templates)
    pairs = None
    for part in template_parts(known) or [known]:
        texts = rows.where(_may_hold_window(part, threshold)).select("doc_id", "print", words(F.col("text")).alias("w"))
        found = containment_join(blocks, part.where(F.size("tokens") >= LINE_WORDS).drop("width"), threshold).unionByName(window_join(texts, part, threshold))
        pairs = found if pairs is None else pairs.unionByName(found)
    notices = pairs.groupBy("doc_id", "print", "label").agg(F.max("containment").alias("containment")).groupBy(F.col("doc_id").alias("id"), F.col("print").alias("p"))
    notices = written(notices.agg(F.collect_list(F.struct("label", "containment")).alias("notices")))
    base = base_labels(rows).select("doc_id", "print", "n_words", "places")
    out = base.join(notices, base["doc_id"].eqNullSafe(notices["id"]) & base["print"].eqNullSafe(notices["p"]), "left")
    none = F.array().cast(notices.schema["notices"].dataType)
    out = out.select("doc_id", "n_words", "places", F.coalesce("notices", none).alias("notices"))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda n: n["containment"])), F.lit(0.0)))
    return out.withColumn("score", score)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda p: p["at"].cast("long"))
    base = F.transform("places", lambda p: p["label"])
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("notices", lambda n: n["label"]))).alias("labels"), "score",
    )
