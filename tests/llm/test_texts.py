import re
from collections import Counter

import pytest

from causalframe.llm import license_scan, quality_classifier, quality_rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rule_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), base


@pytest.mark.parametrize("edge", [True, False])
def test_rules(spark, docs, texts, edge):
    df = docs if edge else spark.read.parquet(f"{SF}/documents.parquet")
    source = texts if edge else [(r.doc_id, r.text) for r in df.collect()]
    rows = quality_rules.quality_rules(df).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(i), *rule_counts(t)) for i, t in source)
    assert not any(r.kept and r.base_failed for r in rows)


def test_rules_on_labels(spark):
    judged = quality_rules.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = judged.join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in rows)
    assert quality_rules.quality_rules(judged.where("false")).count() == 0


@pytest.mark.parametrize("words", [[], ["a"] * 7, ["a"] * 8, ["a"] * 9, ["a"] * 30, list("abcdefgh") + ["x"] + list("abcdefgh")])
def test_repeats(spark, words):
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert quality_rules.quality_rules(df).first().n_repeat_words == rule_counts(" ".join(words))[4]


LICENSES = [
    (1, "Released under the MIT License."), (2, "MIT LICENSE mit-license xmit license"), (3, "permit license"), (4, None), (5, ""),
    (6, "Licensed under CC BY-NC 4.0."), (7, "Licensed under the Apache License,\nVersion 2.0"), (8, "the GNU General  Public\nLicense and general public license"),
    (9, "Some text.\n\nPermission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the Software),\nto deal in the Software without restriction, including without limitation\nthe rights to use, copy, modify, merge, publish, distribute, sublicense,\nand/or sell copies of the Software, and to permit persons to whom the\nSoftware is furnished to do so\n\nend"),
    (10, "licensed cc by 4 words nc 0 under"), (10, "mit license"), (None, "apache license"), (11, "été mit license é " * 300),
]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, phrase in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [p for p, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def near(text):
    """All pairs of block and template."""
    found = set()
    flat = (text or "").encode().translate(license_scan._TABLE)
    for block, several in license_scan.blocks(flat):
        held = [(label, s) for label, s in license_scan._sets(license_scan.TEMPLATES) if 10 * len(s & block) >= 9 * len(s) and (not several or len(s) >= license_scan.WRAPPED)]
        found |= {label for label, s in held if not any(s < other for _, other in held)}
    return found


@pytest.mark.parametrize("edge", [True, False])
def test_licenses(spark, edge):
    df = spark.createDataFrame([(i, t, "x") for i, t in LICENSES], "doc_id long, text string, labels string") if edge else spark.read.parquet(f"{SF}/documents.parquet")
    source = LICENSES if edge else [(r.doc_id, r.text) for r in df.collect()]
    rows = license_scan.scan_licenses(df).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels) for r in rows)
    want = []
    for i, t in source:
        n, places, first, last, labels = base(t)
        want.append((str(i), n, places, str(first), str(last), labels, ",".join(sorted({*filter(None, labels.split(","))} | near(t)))))
    assert got == sorted(want)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and len(r.spans) == r.n_base for r in rows)
    assert license_scan.scan_licenses(df.where("false")).count() == 0


WRAPPED_NOTICES = [
    ("Licensed under CC\nBY-NC 4.0", "cc-by-nc"), ("Text.\nLicensed\nunder CC BY-NC-SA\n4.0\nmore", "cc-by-nc-sa"), ("Licensed under the CC\nBY 4.0", "cc-by"),
    ("This is free and unencumbered software released\ninto the public domain", "unlicense"),
    ("Copyright 2024. All rights\nreserved. No part may be\nreproduced without permission.", "all-rights-reserved"),
    ("Licensed under CC\n\nBY-NC 4.0", ""), ("under licensed\nby cc 0 4", ""), ("Licensed under some long other words that go on and\non until CC BY at 4 or 0", ""),
    ("Licensed under CC BY-ND 4.0\nLicensed under CC BY-NC 4.0", "cc-by-nc,cc-by-nd"), ("Licensed under CC BY-NC 4.0\nLicensed under CC BY-ND 4.0", "cc-by-nc,cc-by-nd"),
]


def test_wrapped_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WRAPPED_NOTICES)], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert [rows[i].labels for i in range(len(rows))] == [labels for _, labels in WRAPPED_NOTICES]
    assert all((rows[i].score >= 0.9) == bool(labels) for i, (_, labels) in enumerate(WRAPPED_NOTICES))


def test_classifier(spark, docs):
    df, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_classifier.classify(df, labels, per_class=500).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert len(right) > 400 and sum(right) >= 0.98 * len(right)
    assert sum(r.predicted for r in got if r.quality == 1) >= 0.99 * sum(r.quality == 1 for r in got)
    rows = quality_classifier.classify(docs.withColumn("score", docs["ids"]), labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_classifier.classify(docs.where("false"), labels).count() == 0
    assert {r.score for r in quality_classifier.classify(docs, labels.where("false")).collect()} == {0.5}


def test_scores_do_not_depend_on_the_sample(spark):
    """Texts that tell nothing score the share of their class, whatever part of it is taken."""
    rows = [(i, f"some words {i % 5} of a text", int(i % 7 != 0)) for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "quality")
    for per_class in (2000, 300, 100):
        model = quality_classifier.train(docs, labels, per_class=per_class)
        scores = [model.score(quality_classifier.Features().of(f"some words {k} of a text".encode())) for k in range(5)]
        assert sum(scores) / 5 == pytest.approx(6 / 7, abs=0.06)


def test_descent_on_separable():
    import numpy as np

    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(200):
        y = i % 2
        rows.append(np.unique(np.concatenate([rng.integers(0, 1000, 20), [2000 + y]])).astype(np.int32))
        labels.append(y)
    m = quality_classifier.fit(rows, labels)
    assert all((m.score(f) >= 0.5) == bool(y) for f, y in zip(rows, labels))


def test_ratios_and_descent_by_hand():
    """Class log-count ratios by plain counting, and the dual's optimality conditions at the found solution."""
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(60)]
    labels = [int((f < 15).mean() + rng.normal(0, 0.15) > 0.4) for f in rows]
    ratios = quality_classifier._ratios(rows, labels)
    sums = {y: [1 + sum(k in f for f, z in zip(rows, labels) if z == y) for k in range(40)] for y in (0, 1)}
    rest = quality_classifier.BUCKETS - 40
    for k in range(40):
        want = math.log(sums[1][k] / (sum(sums[1]) + rest)) - math.log(sums[0][k] / (sum(sums[0]) + rest))
        assert ratios[k] == pytest.approx(want)
    weights, bias = quality_classifier._descend(rows, labels, ratios, 1.0, 2000, 7)
    scaled = np.zeros((60, 41))
    for i, f in enumerate(rows):
        scaled[i, f] = ratios[f] / len(f) ** 0.5
    scaled[:, 40] = 1
    sign = np.where(np.array(labels) == 1, 1.0, -1.0)

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - sign * (scaled @ w)).sum()

    found = np.append(np.divide(weights[:40], ratios[:40], out=np.zeros(40), where=ratios[:40] != 0), bias)
    plain = np.zeros(41)  # subgradient descent from elsewhere comes no lower
    for step in range(1, 20_001):
        wrong = sign * (scaled @ plain) < 1
        plain -= (plain - (sign[wrong, None] * scaled[wrong]).sum(0)) / step
    assert loss(found) <= loss(plain) + 1e-2 * loss(plain)


def test_clashing_names_and_ids(spark, docs):
    from pyspark.sql import functions as F

    odd = docs.withColumn("SCORE", F.lit("x")).withColumn("Kept", F.lit("y")).withColumn("n_Words", F.lit("z")).withColumn("Predicted", F.lit(1.5))
    judged = quality_rules.quality_rules(odd)
    assert {"kept", "n_words"} <= set(judged.columns) and not {"Kept", "n_Words"} & set(judged.columns) and judged.count() == docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = {str(r.doc_id): r.score for r in quality_classifier.classify(table, labels, per_class=60).collect()}
    text_ids = quality_classifier.classify(table.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("SCORE", F.lit("x")), labels.withColumn("doc_id", F.col("doc_id").cast("string")), per_class=60)
    assert set(text_ids.columns) >= {"score", "predicted"} and "SCORE" not in text_ids.columns
    small = quality_classifier.classify(table.withColumn("doc_id", F.col("doc_id").cast("int")), labels, per_class=60)
    assert {str(r.doc_id): r.score for r in small.collect()} == pytest.approx(want)
    many = table.union(table).union(table)  # repeated labelled ids give the driver one row each
    assert {str(r.doc_id): r.score for r in quality_classifier.classify(many, labels, per_class=60).collect()} == pytest.approx(want)
    assert text_ids.count() == len(want)
