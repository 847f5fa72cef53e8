"""Licence statements by a sparse n-gram classifier of paragraphs, confirmed by comparison with templates."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import stored
from tidegauge.llm.learning import calibrate, sigmoid

#: Customary statements of licences by family.
TEMPLATES = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
}
#: Identifiers of the SPDX list by family, stated in a line of their own.
IDENTIFIER = "SPDX-License-Identifier:"
IDENTIFIERS = {
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "apache": ("Apache-2.0",),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "cc-by": ("CC-BY-4.0",),
    "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc-by-sa": ("CC-BY-SA-4.0",),
    "cc0": ("CC0-1.0",),
    "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "mit": ("MIT",),
    "mpl": ("MPL-2.0",),
}
TEMPLATES = {f: (*ts, *(f"{IDENTIFIER} {i}" for i in IDENTIFIERS[f])) for f, ts in TEMPLATES.items()}
#: Statements that speak of some licence but of no family above.
OTHERS = (
    "Licensed under the terms of our own licence agreement.",
    "All rights reserved. No part of this publication may be reproduced without permission.",
    "This software is provided under a proprietary license.",
    "Released under a custom license, see the license file.",
    "Use is subject to the license terms of the vendor.",
    "Copyright of the author, distributed under a private licence.",
)
FAMILIES = tuple(TEMPLATES)
#: The last class: any licence statement, of a family or not.
CLASSES = (*FAMILIES, "any")
#: Documents of the corpus whose paragraphs are examples of no licence; code points of such a text; paragraphs of them.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_PARAGRAPHS = 200, 20_000, 1500
#: Altered copies of each statement to learn from, and copies beside another statement; share of the examples kept for
#: calibration.
COPIES, NEIGHBOURS, CALIBRATION = 16, 8, 0.3
#: Share of sampled paragraphs from which on a word is too common to be evidence; weight of the L1 penalty; steps.
COMMON, PENALTY, STEPS = 0.01, 0.0005, 300
#: Probability of a class, and share of a template's word pairs, from which on they count.
CUT, TEMPLATE_SHARE = 0.5, 0.8
#: Words of a window over the lines of a paragraph, and from one window to the next. No template has more than HOP words,
#: so each wrapped statement lies whole in some window.
WINDOW, HOP = 64, 32
#: Ends of lines, and what parts paragraphs: blank lines.
LINE_END, BLANK = "\\r\\n?|\\n", "(?:\\r\\n?+|\\n)\\s*[\\r\\n]"
#: A word: Latin (also with accents), Greek and Cyrillic letters and digits, with dots, plus signs and hyphens inside.
TOKEN = "[a-z0-9ß-ɏͰ-ӿ]+(?:[.+-][a-z0-9ß-ɏͰ-ӿ]+)*"
#: Words that speak of a licence by themselves; paragraphs made up of noise and a few other words of statements are
#: examples of none, so many of them.
TELLING, SCATTERED = "licen[cs]|copyright|spdx", 600


def tokens_of(paragraph: str) -> list[str]:
    return re.findall(TOKEN, paragraph.lower())


def grams_of(tokens: list[str]) -> set[str]:
    """Words and pairs of neighbouring words."""
    return {*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))}


@dataclass
class Model:
    """Calibrated logit of a class: bias + sum of the weights of the n-grams a paragraph has."""

    weights: dict[str, list[float]]
    bias: list[float]
    #: One word of each n-gram of positive weight, one that is rare elsewhere.
    evidence: list[str]

    def probabilities(self, paragraph: str) -> np.ndarray:
        rows = [self.weights[g] for g in grams_of(tokens_of(paragraph)) if g in self.weights]
        return sigmoid(np.sum(rows, axis=0) + self.bias if rows else np.array(self.bias))


def background(docs: DataFrame) -> list[str]:
    """Paragraphs of a bounded sample of documents, smallest hash of the id first.

    Ids are picked before texts are fetched, so each task sends few ids to the
    driver and not as many texts.
    """
    short = docs.where((F.length("text") <= SAMPLE_CHARS) & F.col("doc_id").isNotNull())
    ids = [r["doc_id"] for r in short.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    texts = short.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text"))
    picked = sorted(texts.collect(), key=lambda r: ids.index(r["doc_id"]))
    return [p for r in picked for p in r["text"].split("\n") if p.strip()][:SAMPLE_PARAGRAPHS]


def train(noise: list[str], seed: int = 1) -> Model:
    """One-against-rest logistic regressions with an L1 penalty over statements, altered copies of them and ``noise``.

    Paragraphs of ``noise`` that share three word pairs (or all) with a statement, or hold
    the SPDX tag, are left out, as they may be statements themselves. A part of the examples is kept from the fit and
    only calibrates: below CUT in every family and at least CUT in ``any`` is
    an unknown licence.
    """
    random = np.random.default_rng(seed)
    pairs = [{g for g in grams_of(tokens_of(t)) if " " in g} for t in (*OTHERS, *(t for ts in TEMPLATES.values() for t in ts))]
    stated = lambda g: any(len(t & g) >= min(3, len(t)) for t in pairs) or tokens_of(IDENTIFIER)[0] in g
    noise_grams = [g for g in (grams_of(tokens_of(p)) for p in noise) if not stated(g)]
    common: dict[str, int] = {}
    for g in noise_grams:
        for w in g:
            common[w] = common.get(w, 0) + 1
    ordinary = {w for w, n in common.items() if n > COMMON * len(noise_grams)}
    noise_tokens = [w for p in noise[:400] for w in tokens_of(p)] or ["text"]

    examples: list[tuple[set[str], list[int]]] = [(g, []) for g in noise_grams]
    statements = [(t, [i, len(FAMILIES)]) for i, f in enumerate(FAMILIES) for t in TEMPLATES[f]] + [(t, [len(FAMILIES)]) for t in OTHERS]
    for text, classes in statements:
        tokens = tokens_of(text)
        examples.append((grams_of(tokens), classes))
        for _ in range(COPIES):
            kept = [w for w in tokens if random.random() > 0.05]
            around = [[noise_tokens[k] for k in random.integers(0, len(noise_tokens), random.integers(0, 12))] for _ in range(2)]
            examples.append((grams_of(around[0] + kept + around[1]), classes))
        for _ in range(NEIGHBOURS):
            other, more = statements[int(random.integers(0, len(statements)))]
            examples.append((grams_of(tokens + tokens_of(other)), classes + more))

    own = {w for t, _ in statements for w in grams_of(tokens_of(t))}
    plain = sorted(w for w in own if " " not in w and not re.search(TELLING, w))
    for _ in range(SCATTERED):
        tokens = [noise_tokens[k] for k in random.integers(0, len(noise_tokens), random.integers(5, 60))]
        for k in random.integers(0, len(plain), random.integers(1, 6)):
            tokens.insert(int(random.integers(0, len(tokens) + 1)), plain[k])
        examples.append((grams_of(tokens), []))
    features = sorted(w for w in own if not all(p in ordinary for p in w.split(" ")))
    index = {w: i for i, w in enumerate(features)}
    x = np.zeros((len(examples), len(features)), np.float32)
    y = np.zeros((len(examples), len(CLASSES)), np.float32)
    for i, (g, classes) in enumerate(examples):
        x[i, [index[w] for w in g if w in index]] = 1
        y[i, classes] = 1
    held = random.random(len(examples)) < CALIBRATION
    w, b = np.zeros((len(features), len(CLASSES)), np.float32), np.full(len(CLASSES), -2.0, np.float32)
    fit_x, fit_y = x[~held], y[~held]
    rate = 4 * len(fit_x) / max(1.0, float(np.linalg.norm(fit_x.sum(0) @ fit_x.T) / np.sqrt(len(fit_x))))
    ahead, last, t = w.copy(), w.copy(), 1.0
    for _ in range(STEPS):  # accelerated proximal gradient
        error = (sigmoid(fit_x @ ahead + b) - fit_y) / len(fit_x)
        w = ahead - rate * (fit_x.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        b = np.minimum(b - rate * error.sum(0), -1.0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, last, t = w + (t - 1) / t_next * (w - last), w, t_next
    logits = x[held] @ w + b
    scale = [calibrate(logits[:, k].astype(np.float64), y[held][:, k]) for k in range(len(CLASSES))]
    a = np.array([s[0] for s in scale])
    shift = np.minimum(a * b + [s[1] for s in scale], -0.5)  # without evidence no class counts
    kept = np.flatnonzero(np.abs(w).max(1) > 1e-6)
    weights = {features[i]: [round(float(v), 6) for v in w[i] * a] for i in kept}
    evidence = {next(p for p in g.split(" ") if p not in ordinary) for g, ws in weights.items() if max(ws) > 0}
    return Model(weights, [round(float(v), 6) for v in shift], sorted(evidence))


def grams(tokens: Column) -> Column:
    """Distinct words and word pairs of an array of words."""
    rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), rest, lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(tokens, pairs))


def _values(spark, rows: list[str], names: str) -> DataFrame:
    """A small fixed table, of a size that Spark knows."""
    return spark.sql(f"select * from values {','.join(rows)} as t({names})")


def _units(text: Column, evidence: list[str]) -> Column:
    """What is scored of a text: (paragraph, joined, grams) of each line, and of each window over a paragraph of several
    lines, if it has a word of ``evidence``."""
    known = F.array(*map(F.lit, evidence or [""]))
    words = lambda line: F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})"), 1)
    unit = lambda n, joined, tokens: F.struct(n.alias("paragraph"), F.lit(joined).alias("joined"), grams(tokens).alias("grams"))
    spoken = lambda parts: F.filter(parts, lambda w: F.arrays_overlap(w, known))

    def of_paragraph(lines: Column, n: Column) -> Column:
        flat = F.flatten(lines)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(flat) - HOP - 1) / HOP).cast("int")))
        windows = F.transform(starts, lambda k: F.slice(flat, k * HOP + 1, F.lit(WINDOW)))
        alone = F.transform(spoken(lines), lambda w: unit(n, False, w))
        return F.when(F.size(lines) > 1, F.concat(alone, F.transform(spoken(windows), lambda w: unit(n, True, w)))).otherwise(alone)

    lines = F.transform(F.split(text, BLANK), lambda p: F.filter(F.transform(F.split(p, LINE_END), words), lambda w: F.size(w) > 0))
    telling = F.filter(
        F.transform(lines, lambda ls, n: F.struct(ls.alias("lines"), n.alias("n"))),
        lambda p: F.exists(p["lines"], lambda w: F.arrays_overlap(w, known)),
    )
    return F.flatten(F.transform(telling, lambda p: of_paragraph(p["lines"], p["n"])))


def paragraphs(docs: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """All rows as (row, doc_id), and of each unit with evidence (row, unit, paragraph, joined, family, probability,
    any_probability, template_share).

    Paragraphs are parted by blank lines. A unit is a line, or a window over the
    words of a paragraph of several lines (``joined``), which sees statements that
    are wrapped. Units without any n-gram of positive weight can't reach CUT in any
    class, so only those that hold the rare word of such an n-gram are scored.
    """
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            _units(F.col("text").cast("string"), model.evidence).alias("units"),
        ),
        "license-evidence",
    )
    found = rows.select("row", F.posexplode("units").alias("unit", "u"))
    key = ["row", "unit", "paragraph", "joined"]
    each = found.select("row", "unit", "u.paragraph", "u.joined", F.explode("u.grams").alias("gram"))

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    weight_rows = [f"({quoted(g)},{','.join(f'{v!r}D' for v in ws)})" for g, ws in model.weights.items()] or ["('',%s)" % ",".join(["0D"] * len(CLASSES))]
    weights = _values(spark, weight_rows, "gram," + ",".join(f"w{k}" for k in range(len(CLASSES))))
    scored = (
        each.join(F.broadcast(weights), "gram")
        .groupBy(*key)
        .agg(*[F.sum(F.col(f"w{k}").cast("decimal(20,6)")).cast("double").alias(f"w{k}") for k in range(len(CLASSES))])
    )
    p = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col(f"w{k}") + F.lit(model.bias[k])))) for k in range(len(CLASSES))]
    families = F.array(*[F.struct(p[k].alias("probability"), F.lit(f).alias("family")) for k, f in enumerate(FAMILIES)])
    likely = F.filter(families, lambda f: f["probability"] >= CUT)
    best = F.array(F.array_max(families))  # a line names one family, a window may lie on statements of several
    named = F.explode(F.when(F.col("joined") & (F.size(likely) > 1), likely).otherwise(best))
    scored = scored.select(*key, named.alias("best"), p[-1].alias("any_probability"))

    template_rows = []
    for f in FAMILIES:
        for i, t in enumerate(TEMPLATES[f]):
            pairs = sorted(g for g in grams_of(tokens_of(t)) if " " in g)
            template_rows += [f"({quoted(f)},{i},{len(pairs)},{quoted(g)})" for g in pairs]
    templates = _values(spark, template_rows, "family,template,size,gram")
    compared = (
        each.join(F.broadcast(templates), "gram")
        .groupBy("row", "unit", "family", "template", "size")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("row", "unit", "family")
        .agg(F.max(F.col("n") / F.col("size")).alias("template_share"))
    )
    named = scored.select(*key, "best.family", "best.probability", "any_probability")
    shared = named.join(compared, ["row", "unit", "family"], "left")
    return rows.select("row", "doc_id"), shared.withColumn("template_share", F.coalesce("template_share", F.lit(0.0)))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, license, probability, template_share, confirmed, n_statements, licenses.

    ``license`` is the family of the document's most probable statement, those
    confirmed by a template first; ``unknown`` if statements only speak of some
    licence; null without any. ``licenses`` are all families confirmed in it.
    A statement is a line, or several lines of a paragraph together where the
    lines alone say nothing or the template is only met by the lines together;
    ``n_statements`` counts lines, or one for a paragraph of such lines.
    Null and empty texts have none; rows that repeat each get a row; null ids
    are kept; an empty table gives no rows; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id"), F.col("text"))
    rows, spoken = paragraphs(docs, train(background(docs)))
    sure = F.col("probability") >= CUT
    spoken = spoken.where(sure | (F.col("any_probability") >= CUT)).select(
        "row",
        "paragraph",
        "joined",
        F.when(sure, F.col("family")).otherwise("unknown").alias("license"),
        F.when(sure, F.col("probability")).otherwise(F.col("any_probability")).alias("probability"),
        F.when(sure, F.col("template_share")).otherwise(0.0).alias("template_share"),
    )
    spoken = spoken.withColumn("confirmed", F.col("template_share") >= TEMPLATE_SHARE)
    order = F.struct("confirmed", F.col("license") != "unknown", "probability", "license")
    said = F.struct("license", "probability", "template_share", "confirmed")
    alone, together = ~F.col("joined"), F.col("joined")
    by_paragraph = spoken.groupBy("row", "paragraph").agg(
        F.count_if(alone).alias("n_lines"),
        F.max(F.when(alone, F.struct(order.alias("order"), said.alias("said")))).alias("line"),
        F.max(F.when(together, F.struct(order.alias("order"), said.alias("said")))).alias("lines"),
        F.collect_set(F.when(F.col("confirmed"), F.col("license"))).alias("families"),
    )
    counted = F.col("lines.said.confirmed") | F.col("line").isNull()
    by_paragraph = by_paragraph.withColumn("top", F.greatest("line", F.when(counted, F.col("lines"))))
    summary = by_paragraph.groupBy("row").agg(
        F.max("top")["said"].alias("best"),
        F.sum(F.greatest("n_lines", F.lit(1))).alias("n_statements"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("licenses"),
    )
    joined = rows.join(summary, "row", "left")
    return joined.select(
        "doc_id",
        "best.license",
        "best.probability",
        "best.template_share",
        F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"),
        F.coalesce("n_statements", F.lit(0)).alias("n_statements"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
    )
