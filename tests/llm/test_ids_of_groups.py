"""Near vectors and SimHash groups where ids are null or repeated: links are between texts and vectors, not between ids."""

import numpy as np
from pyspark.sql import functions as F

from isohyet.llm import itq_dedup, simhash


def near(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links int, component int, node string")
    return sorted(((r.id, r.n_links, r.component) for r in itq_dedup.near_vectors(df).collect()), key=str)


def test_vectors_without_ids(spark):
    assert near(spark, [(5, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0])]) == sorted([(5, 1, 5), (None, 1, 5), (None, 0, None)], key=str)
    assert near(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (7, [1.0, 0.01])]) == sorted([(1, 1, 1), (1, 0, 1), (7, 1, 1)], key=str)
    assert near(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (None, [1.0, 0.0])]) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1)], key=str)
    assert near(spark, []) == []


def test_vectors_against_brute_force_with_odd_ids(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 16))
    data = np.concatenate([centres, np.repeat(centres[:12], 8, axis=0) + 0.1 * rng.standard_normal((96, 16))])
    data = np.concatenate([data, data[:20]])
    ids = [None if i % 5 == 0 else int(rng.integers(0, 60)) for i in range(len(data))]
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    label = simhash.settle(len(data), *np.nonzero(link), np.arange(len(data)))
    want = []
    for i in range(len(data)):
        known = [ids[j] for j in np.flatnonzero(label == label[i]) if ids[j] is not None]
        want.append((ids[i], int(link[i].sum()) - 1, min(known, default=None)))
    assert near(spark, list(zip(ids, data.tolist()))) == sorted(want, key=str)


def test_signature_keeps_near_pairs():
    """Pairs at the least cosine pass the bound on the signature, pairs at random don't."""
    rng = np.random.default_rng(10)
    sample = rng.standard_normal((4000, 64))
    mean, projection, threshold = signature = itq_dedup.learn_codes(sample, itq_dedup.SIGNATURE)
    bound = itq_dedup.code_bound(sample, signature, 0.9)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = rng.standard_normal(x.shape)
    step -= (step * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * step / np.linalg.norm(step, axis=1, keepdims=True)
    code = lambda v: (v - mean) @ projection >= threshold
    assert ((code(x) != code(y)).sum(axis=1) <= bound).mean() > 0.9995
    assert ((code(x) != code(x[::-1])).sum(axis=1) <= bound).mean() < 1e-3


def groups(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, lanes int, node int")
    return sorted(((r.id, r.component) for r in simhash.simhash_groups(df).collect()), key=str)


def test_texts_without_ids(spark):
    words = [f"word{i}" for i in range(400)]
    text, copy, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"other{i}" for i in range(400))
    apart = lambda a, b: (simhash.fingerprint(a)[0] ^ simhash.fingerprint(b)[0]).bit_count()
    assert apart(text, copy) <= 4 < apart(text, other)
    assert groups(spark, [(7, text), (None, copy), (None, other)]) == sorted([(7, 7), (None, 7), (None, None)], key=str)
    assert groups(spark, [(1, text), (1, other), (9, copy), (9, copy)]) == [(1, 1), (1, 1), (9, 1), (9, 1)]
    assert groups(spark, [(4, other), (4, text), (None, None), (3, ""), (2, copy)]) == sorted([(4, 4), (4, 2), (None, 3), (3, 3), (2, 2)], key=str)


def test_dedup_with_odd_ids(spark):
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(None, text), (None, text), (3, text), (8, text), (8, "short"), (9, None), (10, ""), (11, "short")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, root int")
    got = simhash.simhash_dedup(df)
    assert got.columns == df.columns
    # 8 is one document of two texts, so 3, 8 and 11 are one group; rows without an id stay
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, text), (None, text), (3, text), (9, None)], key=str)
    assert simhash.simhash_dedup(df.where("1 = 0")).count() == 0
    assert got.where(F.col("doc_id").isNull()).count() == 2
