"""Trained operators: held-out accuracy on small made-up tables, and gradients and spans against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tidegauge.llm import learning, licenses, packing, quality, toxicity

WORDS = "river stone window garden morning letter silver market winter yellow castle simple family answer listen travel".split()
BAD = ("grumblesnort", "GRUMBLEfitz", "xgrumble", "vilezap")


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def toxic_rows(n, seed=1):
    r, out = random.Random(seed), []
    for i in range(n):
        words = sentence(r, r.randint(1, 90)).split()
        if i % 4 == 0:
            for _ in range(2):
                words.insert(r.randint(0, len(words)), r.choice(BAD))
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def quality_rows(n, seed=2):
    r, out = random.Random(seed), []
    for i in range(n):
        text = "\n".join(sentence(r, r.randint(5, 60)).capitalize() + "." for _ in range(r.randint(1, 4)))
        if i % 3 == 0:
            text = " ".join(w + r.choice(["###", "$$$", "!!"]) for w in text.upper().split())
        out.append((i, text, int(i % 3 > 0)))
    return out


def tables(spark, rows, label):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "'y' as y", "0 as score")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {label} int")
    return docs, labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1), (1, None)], labels.schema))


ODD = [(9001, None), (9002, ""), (9003, " \n "), (None, "river stone"), (9004, "river " * 30_000), (9005, "a"), (9005, "a")]


def test_toxicity(spark):
    docs, labels = tables(spark, toxic_rows(400), "toxic")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'y' as y", "0 as score")
    got = toxicity.report(docs.union(odd), labels).collect()
    assert len(got) == 400 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 80 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert not any(r.predicted for r in got if r.doc_id is None or r.doc_id > 9000)
    assert toxicity.report(docs.where("false"), labels).collect() == []
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 300) < 12


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = tables(spark, toxic_rows(60), "toxic")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = (learning.labelled_sample(docs, x, "toxic", 3, 1) for x in (labels, turned))
    assert a.equals(b) and len(a) > 20


def test_windows_cover_the_whole_text():
    for n in (0, 1, 31, 32, 33, 48, 100, 1001):
        starts = toxicity.window_starts(n)
        covered = {w for s in starts for w in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and (np.diff(starts) <= toxicity.STRIDE).all()


def numeric(loss, array, at, eps=1e-3):
    old = array[at]
    array[at] = old + eps
    up = loss()
    array[at] = old - eps
    down = loss()
    array[at] = old
    return (up - down) / (2 * eps)


def test_gradients_of_the_recurrent_network():
    r = np.random.default_rng(1)
    words = [b"river", b"stone", b"winter", b"x"]
    net = toxicity.Network.fresh({b"river": 0, b"winter": 1})
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    windows = r.integers(0, 4, (toxicity.WINDOW, 3))
    mask = np.ones(windows.shape, bool)
    mask[5:, 1] = False
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = learning.sigmoid(net.logits(net.project(net.embed(words)[0])[windows], mask))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net.train_step(words, windows, mask, y)
    for k, g in grads.items():
        for at in [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g), axis=None)[:4]]:
            assert numeric(loss, net.params[k], at) == pytest.approx(g[at], rel=0.05, abs=2e-5), k


def test_gradients_of_the_attention_model():
    model = quality.AttentionModel.fresh()
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    bags = quality.Bags([quality.passages_of("river stone\nwinter X!"), quality.passages_of(""), quality.passages_of("a\nb\nriver")])
    y = np.array([1.0, 0.0, 1.0])
    words = sorted(set(bags.words))
    rows = np.array([words.index(w) for w in bags.words])

    def loss():
        p = learning.sigmoid(model.attend(model.embed(words)[0], rows, bags, bags.counts(rows))[0])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in model.train_step(bags, y).items():
        for at in [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g), axis=None)[:4]]:
            assert numeric(loss, model.params[k], at) == pytest.approx(g[at], rel=0.05, abs=2e-5), k


def test_quality(spark):
    docs, labels = tables(spark, quality_rows(300), "quality")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'y' as y", "0 as score")
    got = quality.quality(docs.union(odd), labels).collect()
    assert len(got) == 300 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30 and sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    assert quality.quality(docs.where("false"), labels).collect() == []
    nothing = labels.where("false")
    assert quality.quality(docs, nothing).count() == 300  # without labels every text has the same score


def test_batches_do_not_change_scores():
    net = toxicity.train(pd.DataFrame([(t, y) for _, t, y in toxic_rows(60)], columns=["text", "y"]))
    texts = [t for _, t, _ in toxic_rows(40, 5)] + [None, "", "river " * 500]
    one = np.concatenate([net.scores([t]) for t in texts])
    assert np.allclose(one, net.scores(texts), atol=1e-5)


def test_calibration_of_few_separable_rows_is_not_certain():
    a, b = learning.calibrate(np.array([-90.0, -80, 70, 100]), np.array([0.0, 0, 1, 1]))
    p = learning.sigmoid(a * np.array([-90.0, 100]) + b)
    assert a > 0 and 0 < p[0] < 0.3 and 0.7 < p[1] < 1


# --- licences


def plain_scan(text, model):
    """The same decision paragraph by paragraph, in Python."""
    found = []
    for p in (text or "").split("\n"):
        own = licenses.grams_of(licenses.tokens_of(p))
        if not any(max(model.weights.get(g, [0])) > 0 for g in own) and not own:
            continue
        prob = model.probabilities(p)
        k = max(range(len(licenses.FAMILIES)), key=lambda i: (prob[i], licenses.FAMILIES[i]))
        if prob[k] >= licenses.CUT:
            shares = [
                len(t & own) / len(t)
                for t in ({g for g in licenses.grams_of(licenses.tokens_of(x)) if " " in g} for x in licenses.TEMPLATES[licenses.FAMILIES[k]])
            ]
            found.append((max(shares) >= licenses.TEMPLATE_SHARE, True, prob[k], licenses.FAMILIES[k]))
        elif prob[-1] >= licenses.CUT:
            found.append((False, False, prob[-1], "unknown"))
    return max(found, default=(False, None, None, None)), len(found)


def test_license_scan(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(sentence(r, r.randint(3, 30)) for _ in range(r.randint(1, 4)))) for i in range(60)]
    want = {}
    for i, (family, templates) in enumerate(licenses.TEMPLATES.items()):
        rows.append((100 + i, sentence(r, 20) + "\n" + templates[0] + "\n" + sentence(r, 9)))
        want[100 + i] = family
    rows += [(200, "Copyright of the author. All rights reserved."), (201, None), (202, ""), (None, "Released under the MIT License."), (203, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as row", "1 as license")
    got = licenses.license_scan(df).collect()
    by_id = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    assert {k: (by_id[k].license, by_id[k].confirmed) for k in want} == {k: (v, True) for k, v in want.items()}
    assert by_id[200].license == "unknown" and not by_id[200].confirmed
    assert all(by_id[k].license is None for k in (*range(60), 201, 202, 203)) and by_id[None].license == "mit"
    model = licenses.train(licenses.background(df))
    for i, t in rows:
        (confirmed, _, prob, family), n = plain_scan(t, model)
        assert (by_id[i].license, by_id[i].confirmed, by_id[i].n_statements) == (family, confirmed, n)
        assert prob is None or by_id[i].probability == pytest.approx(prob)
    assert licenses.license_scan(df.where("false")).collect() == []


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")",
    "bsd": " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions\r\n * are met:\r\n",
    "gpl": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# any later version.",
    "apache": "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES",
    "mpl": "// SPDX-License-Identifier: MPL-2.0",
}


def plain_families(words, model):
    """All families that a window may name."""
    own, prob = licenses.grams_of(words), model.probabilities(" ".join(words))
    for k, f in enumerate(licenses.FAMILIES):
        pairs = [{g for g in licenses.grams_of(licenses.tokens_of(x)) if " " in g} for x in licenses.TEMPLATES[f]]
        if prob[k] >= licenses.CUT:
            yield max(len(t & own) / len(t) for t in pairs) >= licenses.TEMPLATE_SHARE, True, prob[k], f


def plain_paragraphs(text, model):
    """Lines, and windows over paragraphs of several lines, as license_scan takes them, in Python."""
    import re

    best, n, families = [], 0, set()
    for p in re.split(r"(?:\r\n|\r|\n)\s*[\r\n]", (text or "").replace("\r\n", "\n")):
        lines = [t for t in (licenses.tokens_of(x) for x in re.split(licenses.LINE_END, p)) if t]
        flat = [w for x in lines for w in x]
        if not any(w in model.evidence for w in flat):
            continue
        windows = [flat[k : k + licenses.WINDOW] for k in range(0, max(1, len(flat) - licenses.HOP), licenses.HOP)] if len(lines) > 1 else []
        alone, together = ([plain_scan(" ".join(u), model)[0] for u in units if set(u) & set(model.evidence)] for units in (lines, windows))
        together += [y for u in windows if set(u) & set(model.evidence) for y in plain_families(u, model)]
        alone, together = ([x for x in units if x[2] is not None] for units in (alone, together))
        families |= {x[3] for x in alone + together if x[0]}
        taken = alone + [x for x in together if x[0] or not alone]
        best += taken
        n += len(alone) or bool(taken)
    return max(best, default=(False, None, None, None)), n, sorted(families)


def test_license_statements_over_several_lines(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(sentence(r, r.randint(3, 30)) for _ in range(3))) for i in range(40)]
    for i, (family, text) in enumerate(WRAPPED.items()):
        before = "\n".join(sentence(r, 12) for _ in range(i * 4))  # statements lie anywhere in long paragraphs
        rows += [(100 + i, text), (200 + i, before + "\n" + text + "\n" + sentence(r, 9)), (300 + i, sentence(r, 9) + "\n\n" + text)]
        rows.append((400 + i, " \n".join(text.split())))  # one word per line
    rows += [(500, "Permission is hereby granted, free\n\nof charge, to any person obtaining a\n \ncopy of this software"), (501, "\n" * 3000), (502, "\r\n \r\n")]
    rows += [(503, WRAPPED["mit"] + "\n\n\n" + WRAPPED["bsd"]), (503, WRAPPED["gpl"] + "\n" + WRAPPED["apache"]), (504, "SPDX-License-Identifier: Own-1.0"), (None, None)]
    rows.append((505, "\n".join(["river stone"] * 20_000 + [WRAPPED["bsd"]] + ["window garden"] * 20_000)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as unit", "1 as paragraph", "0 as lines")
    got = licenses.license_scan(df).collect()
    assert len(got) == len(rows)
    for i, family in enumerate(WRAPPED):
        for x in (x for x in got if x.doc_id in (100 + i, 200 + i, 300 + i, 400 + i)):
            assert (x.license, x.confirmed, x.licenses) == (family, True, [family]), x
    assert all(x.license is None for x in got if x.doc_id is not None and (x.doc_id < 40 or x.doc_id in (501, 502)))
    assert [x.license for x in got if x.doc_id == 504] == ["unknown"] and not any(x.confirmed for x in got if x.doc_id == 500)
    assert sorted(x.licenses for x in got if x.doc_id == 503) == [["apache", "gpl"], ["bsd", "mit"]]
    model = licenses.train(licenses.background(df))
    want = sorted(((i, *plain_paragraphs(t, model)) for i, t in rows), key=str)
    have = {(x.doc_id, x.license, x.confirmed, x.n_statements, tuple(x.licenses)) for x in got}
    assert have == {(i, best[3], best[0], n, tuple(fs)) for i, best, n, fs in want}


def test_few_words_of_a_statement_are_none():
    r = random.Random(8)
    small = "the a of to and in is it for with that this has by or".split()  # ordinary words are known from the corpus
    model = licenses.train([" ".join(r.choice(WORDS + small) for _ in range(30)) for _ in range(300)])
    for text in ("The bridge gave way river stone free of charge", "a copy of the documentation", "the author has a following", "Underßbech im au"):
        assert model.probabilities(text).max() < licenses.CUT
    for family, templates in licenses.TEMPLATES.items():
        for text in templates:
            found = model.probabilities(text)
            assert licenses.FAMILIES[int(found[:-1].argmax())] == family and found[:-1].max() >= licenses.CUT


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(6)
    docs, labels = [], []
    for i, t, y in toxic_rows(240, 7):
        docs.append((i, t + " " + " ".join(f"u{i}n{k}" for k in range(8)), "en", "s", 5))
        labels.append((i, 1, y))
    item = " ".join(f"secret{k}" for k in range(20))
    clean = sentence(r, 40)
    docs += [(1000, clean, "en", "s", 1), (1001, clean, "en", "s", 1), (1002, sentence(r, 9) + " " + item, "en", "s", 1)]
    docs += [(1003, sentence(r, 30) + " mail bob@example.com now", "en", "s", 1), (None, None, "en", "s", 1), (1004, "", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        last, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x.doc_id: x for x in now.collect()}
        assert name == "packing" or now.columns == last.columns
    toxic = {i for i, _, y in toxic_rows(240, 7) if y}
    assert len(toxic & set(kept["toxicity"])) <= 3 and len(set(range(240)) - toxic - set(kept["toxicity"])) <= 3
    assert 1000 in kept["simhash"] and 1001 not in kept["simhash"] and 1001 in kept["toxicity"]
    assert 1002 in kept["simhash"] and 1002 not in kept["decontamination"]
    assert kept["pii"][1003].text.endswith("mail [EMAIL] now") and kept["pii"][1003].n_chars == len(kept["pii"][1003].text)
    assert set(kept["pii"]) == set(kept["decontamination"]) == set(kept["packing"])
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(total.columns) == sorted(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    assert total.count() == sum(1 for _ in packing.pack(spark.read.parquet(f"{tmp_path}/pii")).toLocalIterator())
