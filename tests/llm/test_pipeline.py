"""The pipeline against its stages by brute force, on a small fixture written as the tables it reads."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from isohyet.llm import quality_qda
from tests.llm.test_operators import brute_groups, brute_leaks, brute_lines, text_of


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    good = [text_of(rng, 150) + "." for _ in range(60)]
    bad = [text_of(rng, 40).upper().replace(" ", "!! ") + " ### $$$" for _ in range(30)]
    item = text_of(rng, 30)
    rows = list(enumerate(good + bad))
    rows += [(200, good[0]), (201, good[1]), (202, f"{text_of(rng, 60)}\n{item}\n{text_of(rng, 60)}.")]
    shared = "One more line that stands in a lot of documents, the same each time"
    rows += [(300 + i, f"{text_of(rng, 90)}.\n{shared}\n{text_of(rng, 90)}.") for i in range(8)]
    table = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not set(got) & set(range(60, 90)), "rejected documents are back"
    assert 202 not in got and not {200, 201} & set(got) and {0, 1} <= set(got)
    assert set(range(300, 308)) <= set(got)
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = brute_lines([(i, t) for i, t in rows if not 60 <= i < 90])
    for i, r in got.items():
        ids = np.array(enc.encode_ordinary(texts[i][2]), "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and bytes(r.ids) == ids


def test_stages_return_the_columns_of_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "leaks", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).schema.names == docs.schema.names


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, n_lines string, ids string, node string, component string"


def brute_near(rows, words=5, similarity=0.8):
    """Ids that go: of documents joined by a Jaccard similarity of their shingle sets, all but the smallest."""

    def shingles(text):
        parts = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
        return frozenset(" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()

    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    link = lambda a, b: a[0] == b[0] or a[1] == b[1] or len(a[1] & b[1]) >= similarity * len(a[1] | b[1]) > 0
    top = brute_groups(rows, link)
    least = {}
    for (i, _), g in zip(rows, top):
        least[g] = min(i, least.get(g, i))
    return {i for (i, _), g in zip(rows, top) if i != least[g]}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, each stage against brute force."""
    rng = random.Random(17)
    item = text_of(rng, 20)
    shared = "A line of more than forty letters that stands in many of the documents"
    base = text_of(rng, 200)
    near = base.split()
    near[100] = "edited"
    texts = [(0, base + "."), (1, " ".join(near) + "."), (2, None), (3, ""), (4, " \n\t"), (5, text_of(rng, 30_000) + "."), (6, f"{text_of(rng, 40)}.\n{item}\n{text_of(rng, 40)}."), (None, f"{text_of(rng, 9)} {item}."), (None, base + "."), (7, "kara"), (8, "kara"), (9, "x" * 60_000)]
    texts += [(20 + i, f"{text_of(rng, 60)}.\n{shared}\n{text_of(rng, 60)}.") for i in range(6)] + [(40 + i, text_of(rng, 90) + ".") for i in range(40)] + [(90 + i, text_of(rng, 20).upper() + " ### $$$ !!") for i in range(20)]
    texts += [(5, texts[5][1]), (20, texts[12][1]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "keep", "me", "as", "I", "am") for i, t in texts], COLUMNS).repartition(3)
    docs = docs.cache()
    spark.createDataFrame([(i, int(i < 90), 0) for i, _ in texts if i is not None and i >= 20] + [(None, 1, 1), (0, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda frame: sorted((str(r.doc_id), r.text or "") for r in frame.collect())
    want = lambda kept: sorted((str(i), t or "") for i, t in kept)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        none = stage(spark, docs.where("1 = 0"), str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns
        if name != "tokens":
            assert out.schema.names == docs.schema.names
            assert {tuple(r) for r in out.select("quality_score", "n_lines", "ids", "node", "component").distinct().collect()} <= {("keep", "me", "as", "I", "am")}
    stats = quality_qda.with_statistics(docs.select("doc_id", "text"))
    model = quality_qda.train(stats.select("doc_id", "statistics"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = {t: model.score(np.array([quality_qda.statistics(t)]))[0] for _, t in texts}
    assert rows(stages["quality"](spark, docs, str(tmp_path))) == want((i, t) for i, t in texts if score[t] >= 0.3)
    cut = brute_lines(texts)
    assert rows(stages["lines"](spark, docs, str(tmp_path))) == want((i, t if i is None else cut[i][2]) for i, t in texts)
    gone = brute_near(texts)
    assert {1, 3, 4, 8} <= gone and rows(stages["near_copies"](spark, docs, str(tmp_path))) == want((i, t) for i, t in texts if i not in gone)
    found = {d for d, _ in brute_leaks([(n, t) for n, (_, t) in enumerate(texts)], [(1, item)])}
    assert len(found) == 2 and rows(stages["leaks"](spark, docs, str(tmp_path))) == want(r for n, r in enumerate(texts) if n not in found)
    coded = stages["tokens"](spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in coded) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
