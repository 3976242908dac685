"""Whitening, license scans and hard negatives against brute force on small tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.llm import hard_negatives, licenses, queries, whitening

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, kind="vec_id long, embedding array<float>, label int"):
    return spark.createDataFrame(rows, kind)


def plain_eigen(x):
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return values[::-1], axes[:, ::-1]


# whitening


def test_refined_clusters():
    """Well separated, clustered within 1e-9, equal and zero eigenvalues; the basis of a cluster is checked by what it diagonalises."""
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    values = np.array([9, 5, 5 - 1e-9, 5 - 2e-9, 3, 3, 3, 2, *np.linspace(1, 0.1, 13), 1e-7, 0, 0])
    v = (basis * values) @ basis.T
    v = (v + v.T) / 2
    got, x = whitening.refined(v)
    assert np.abs(got - values).max() < 1e-14 * 9
    assert np.abs(x.T @ x - np.eye(24)).max() < 1e-15 * 4
    inner = x.astype(np.longdouble).T @ v.astype(np.longdouble) @ x.astype(np.longdouble)
    assert np.abs(inner - np.diag(np.diag(inner))).max() < 1e-14
    for i in (0, 4 + 3, 10):  # single ones: the vector itself
        assert abs(abs(x[:, i] @ basis[:, i]) - 1) < 1e-14
    # the members of the near cluster are told apart as far as the matrix in doubles does
    assert np.abs(np.abs(x[:, 1:4].T @ basis[:, 1:4]) - np.eye(3)).max() < 1e-5
    assert whitening.refined(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_refined_beats_single_precision():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((64, 64))
    v = a @ a.T
    values, x = whitening.refined(v)
    want = np.linalg.eigvalsh(v)[::-1]
    assert np.abs(values - want).max() / want[0] < 1e-14
    assert np.linalg.norm(v @ x - x * values) / want[0] < 1e-13


def test_whiten_against_numpy(spark):
    rng = np.random.default_rng(3)
    data = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) / 4).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(data)]
    bad = [(1000, None, 1), (1001, [NAN] * 12, 1), (1002, [None] + [0.0] * 11, 1), (1003, [INF] + [0.0] * 11, 1), (1004, [], 1), (1005, [1.0], 1)]
    got = whitening.whiten(vectors(spark, rows + bad).repartition(7)).orderBy("id").collect()
    assert [r.id for r in got] == list(range(300))
    x = np.floor(1024 * data.astype(float)) + 100_000
    values, axes = plain_eigen(x)
    want = (x - x.mean(axis=0)) @ axes[:, :8] / np.sqrt(values[:8])
    out = np.array([r.whitened for r in got])
    assert np.abs(out * np.sign((out * want).sum(axis=0)) - want).max() < 1e-9
    assert np.allclose(got[0].explained, values[:8] / values.sum(), rtol=1e-12)
    whole = [[int(e) for e in row] for row in x]
    sums = [sum(c) for c in zip(*whole)]
    assert [int(r.deviation) for r in got] == [sum((300 * e - s) ** 2 for e, s in zip(row, sums)) for row in whole]
    assert {r.n for r in got} == {300} and got[0].identity_error < 1e-12
    # the moments are whole numbers: other partitions give the very same components
    again = whitening.whiten(vectors(spark, rows).repartition(3)).orderBy("id").collect()
    assert [r.explained for r in again] == [r.explained for r in got] and np.abs(np.array([r.whitened for r in again]) - out).max() < 1e-12


def test_whiten_large_entries(spark):
    """Entries of a million and more take two limbs, and deviations beyond a long stay exact."""
    rng = np.random.default_rng(4)
    data = rng.standard_normal((40, 3)) * [1e6, 10.0, 3e4]
    got = whitening.whiten(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(data)], "vec_id long, embedding array<double>, label int")).orderBy("id").collect()
    x = np.floor(1024 * data) + 100_000
    whole = [[int(e) for e in row] for row in x]
    sums = [sum(c) for c in zip(*whole)]
    assert [int(r.deviation) for r in got] == [sum((40 * e - s) ** 2 for e, s in zip(row, sums)) for row in whole]
    values, axes = plain_eigen(x)
    want = (x - x.mean(axis=0)) @ axes / np.sqrt(values)
    out = np.array([r.whitened for r in got])
    assert np.abs(out * np.sign((out * want).sum(axis=0)) - want).max() < 1e-6


def test_whiten_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None, 1)])).collect() == []
    # equal rows, a null id, repeated rows: no variance, whitened 0
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 1), (None, [1.0, 2.0], None), (1, [1.0, 2.0], 1)])).collect()
    assert sorted((r.id is None, tuple(r.whitened), int(r.deviation), r.identity_error) for r in got) == [(False, (0, 0), 0, None)] * 2 + [(True, (0, 0), 0, None)]
    # one direction of two, huge entries, clashing names
    rows = [(1, [0.0, 5.0], 9, 1), (2, [1e300, 5.0], 9, 1), (3, [-1e300, 5.0], 9, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, deviation int")).orderBy("id").collect()
    assert [round(r.whitened[0] / got[1].whitened[0]) for r in got] == [0, 1, -1] and all(r.whitened[1] == 0 for r in got)
    assert got[0].explained[0] == pytest.approx(1)


def test_op11_columns(spark, tmp_path):
    vectors(spark, [(i, [float(i % 3), float(i % 5), i / 7], i) for i in range(30)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 90 and dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"


# license scans


def words_of(text):
    lower = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower), lower


def plain_scan(text, rules):
    """Every rule tried on every text, suppression by all pairs."""
    words, lower = words_of(text)
    line = "".join(f" {w}" for w in words) + " "
    starts = {0: 0}
    for i, w in enumerate(words):
        starts[sum(len(x) + 1 for x in words[: i + 1])] = i + 1
    found = []
    for i, rule in enumerate(rules):
        at = 0
        rx = re.compile(f" ({rule.pattern})(?= )")
        while m := rx.search(line, at):
            found.append((starts[m.start()], starts[m.end()], i))
            at = m.end()
    base = sorted((a, z, rules[i].label) for a, z, i in found if i < len(licenses.BASE))
    kept = []
    for a, z, i in found:
        mine = rules[i].level
        lost = False
        for b, y, j in found:
            if (b, y, j) == (a, z, i):
                continue
            level = rules[j].level
            lost |= level < mine and b < z and a < y
            lost |= level <= mine and b <= a and z <= y and ((b, y) != (a, z) or (level, j) < (mine, i))
        if not lost:
            kept.append((a, z, rules[i].label, mine))
    score = max([licenses.WEIGHT[k[3]] for k in kept] + [licenses.BASE_WEIGHT] * bool(base), default=0.0)
    return len(words), base, sorted(kept), score


LICENSED = [
    "Released under the MIT License.", "mit\nlicense mit-license MIT LICENSE", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "This is licensed under the GNU General Public License, version 3 or later.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: Foo-1.0", "licensed under CC BY-NC-SA 4.0", "Licensed under CC BY 4.0 and CC-BY-SA 4.0",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "licensed under the Foo Bar license", "the apache license and the general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "mpl 2.0 or mozilla public licence version 1.1", "placed in the public domain. All rights reserved.",
    "mit lizenz, mit licenseé, xmit license", "general public license general public license", "GNU GPL v2", "gplv3 or later", "the 3-clause BSD license", "is distributed under the terms of the new BSD license",
]


def test_scan_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rules = licenses.standard_rules()
    assert len(rules) > 200
    pieces = [w for t in LICENSED for w in re.split(r"(?<= )", t)]
    mixed = ["".join(rng.choice(pieces, 60)) for _ in range(40)] + [" x ".join(rng.choice(LICENSED, 6)) for _ in range(40)]
    texts = [*LICENSED, *mixed, None, "", "   ", "ÄÖÜ mit license ÄÖÜ", "no words here but licens", "\x01mit\x02 license"]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(5)).collect()
    assert len(got) == len(texts)
    for r in got:
        mine = r.n_words, [tuple(x) for x in r.base], [tuple(x) for x in r.found], r.score
        assert mine == plain_scan(texts[r.id], rules), texts[r.id]


def test_keywords_stand_in_every_match(spark):
    """The keywords of a rule never keep it from a match: each planted text, each rule that matches it."""
    for text in LICENSED:
        words, lower = words_of(text)
        for rule in licenses.standard_rules():
            if re.search(f" ({rule.pattern})(?= )", "".join(f" {w}" for w in words) + " "):
                assert all(any(k in lower for k in group) for group in rule.keys), (text, rule)


def test_scan_odd_rows(spark):
    long = "mit license " * 30_000 + "x" * 300_000
    rows = [(None, "MIT license"), (1, "apache license"), (1, "apache license"), (2, long), (3, "\n".join(["word"] * 50_000))]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.id, []).append(r)
    assert len(got[1]) == 2 and got[None][0].base[0].label == "mit"
    assert len(got[2][0].base) == 30_000 and got[2][0].n_words == 60_001 and got[2][0].base[-1].start == 59_998
    assert got[3][0].n_words == 50_000 and got[3][0].score == 0
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op12_columns(spark, tmp_path):
    spark.createDataFrame([(1, "The MIT License, or the Apache License, Version 2.0."), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op12_licenses(spark, str(tmp_path)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (10, 2, 1, 5, "apache,mit", "apache,apache-2.0,mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels, got[2].labels, got[2].score) == (0, 0, None, None, "", "", 0)


def test_scan_stays_in_the_jvm(spark):
    plan = licenses.scan_licenses(spark.createDataFrame([(1, "MIT license")], "doc_id long, text string").select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# hard negatives


def plain_negatives(rows, anchor, positives=5, negatives=3):
    """rows of (id, label, vec); ids unique."""
    good = []
    for i, label, vec in rows:
        if label is not None and vec and len(vec) == len(rows[0][2]) and all(x is not None and np.isfinite(x) for x in vec):
            good.append((i, label, np.floor(256 * np.array(vec, np.float64)).astype(np.int64)))
    out = []
    for i, label, q in good:
        if i is None or not anchor(i):
            continue
        ranked = sorted(((int(q @ p), j is None, j, other) for j, other, p in good if j != i), key=lambda x: (-x[0], x[1], x[2] or 0))
        for s, _, j, _ in [x for x in ranked if x[3] == label][:positives]:
            fits = [x for x in ranked if x[3] != label and 50 * s <= 100 * x[0] <= 95 * s]
            out += [(i, j, k + 1, x[2], s, x[0]) for k, x in enumerate(fits[:negatives])]
    return sorted(out, key=str)


def mined(spark, rows, kind="vec_id long, label int, embedding array<float>", **extra):
    df = spark.createDataFrame(rows, kind)
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **extra).collect()), key=str)


def test_negatives_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, 20))
    data = (centres[rng.integers(0, 6, 400)] + 0.6 * rng.standard_normal((400, 20))).astype(np.float32)
    data[300:] = data[7]  # a quarter are copies: scores tie, ids settle them
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(data)]
    rows += [(500, None, rows[0][2]), (510, 1, None), (520, 1, [NAN] * 20), (530, 1, [None] * 20), (540, 2, []), (None, 2, rows[3][2])]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert mined(spark, rows) == want
    for name, size in (("ANCHORS", 7), ("SLICE", 60), ("STEP", 3)):
        monkeypatch.setattr(hard_negatives, name, size)
    assert mined(spark, rows) == want


def test_negatives_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, [1.0, 2.0])]) == []  # an anchor without positives
    assert mined(spark, [(10, 1, [1.0, 2.0]), (11, 1, [1.0, 2.0])]) == []  # positives without negatives
    # scores of 0 and below: a target of 0 takes scores of 0, a negative one has no candidates
    rows = [(10, 1, [1.0, 0.0]), (11, 1, [0.0, 1.0]), (12, 2, [0.0, -1.0]), (20, 3, [1.0, 0.0]), (21, 3, [-1.0, 0.0]), (22, 2, [-1.0, 0.0])]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)
    # repeated rows are rows of their own, huge entries are held, names may clash
    rows = [(10, 1, [1e30, 0.0]), (11, 1, [1.0, 0.0]), (11, 1, [1.0, 0.0]), (12, 2, [0.75, 0.0])]
    got = mined(spark, rows)
    assert [r[:4] for r in got] == [(10, 11, 1, 12)] * 2
    df = spark.createDataFrame([(10, 1, [1.0], 0, 0), (11, 1, [1.0], 0, 0), (12, 2, [0.75], 0, 0)], "vec_id long, label int, embedding array<double>, row int, score int")
    assert [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") == 10).collect()] == [(10, 11, 1, 12, 65536, 49152)]


def test_four_russians_scores():
    rng = np.random.default_rng(8)
    for low, high, d in ((-256, 256, 64), (-1, 1, 8), (-(1 << 27), 1 << 27, 16), (0, 1, 24)):
        a, c = rng.integers(low, high + 1, (9, d)), rng.integers(low, high + 1, (33, d))
        planes = int(max(np.abs(a).max(), np.abs(c).max())).bit_length() + 1
        packed = hard_negatives.bit_planes(c, planes)
        assert (hard_negatives.from_planes(packed) == c).all()
        assert (hard_negatives.scores(hard_negatives.subset_sums(a), packed) == c @ a.T).all()
