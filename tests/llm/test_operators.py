"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; results against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from isohyet.llm import byte_bpe, components, decontam, itq_dedup, line_dedup, pii, quality_qda, repair_ids, simhash, suffix_dedup, warc

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "vo") for b in ("ra", "ne", "lit", "mo", "sk", "dur", "é")]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = text_of(rng, 120)
    shared = "This line stands in many documents, word for word, over and over."
    out = [None, "", " ", base, base, base.replace("kara", "volit", 1), "x" * 5000, "漢字" * 600, shared, text_of(rng, 6000)]
    out += [f"{text_of(rng, 30)}\n{shared if i % 2 else shared.upper()} \n{text_of(rng, 40)}" for i in range(8)]
    out += [f"{text_of(rng, 20)} mail me at jo.do{i}@site{i}.example.com or +1 (555) 010-{1000 + i}, card 4111 1111 1111 1111, host 10.0.{i}.255 and 10.0.{i}.256" for i in range(4)]
    return out + [text_of(rng, 60) for _ in range(10)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # extra columns whose names clash with those that operators add
    rows = [(i, t, "x", i, "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_lines int, lang string").repartition(3).cache()


def empty(docs):
    return docs.where("1 = 0")


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 700_000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    html = [None, "", "a" * 100, "a" * 100, "b" * 99, "b" * 99, "\r\n\r\n", "WARC/1.1\r\nx: y\r\n\r\n", "\r\n" * 90, "é" * 60, "é" * 60, big, big, "z\r\nWARC/1.1\r\n"]
    rows = [(None if i == 10 else i, f"http://a/\r\n{i}" if i else None, h) for i, h in enumerate(html)]
    rows.append((2, "twice", "a" * 100))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_round_trip(pages).collect()
    least = {}
    for p, _, h in rows:
        least.setdefault(h or "", []).append(p)
    for r in got:
        assert r.page_id is None or r.payload_digest == hashlib.sha256((rows[r.page_id][2] or "").encode()).hexdigest()
    assert len(got) == len(rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(3, "revisit", 2), (2, "response", None), (2, "revisit", 2), (4, "response", None), (5, "response", None), (12, "revisit", 11), (11, "response", None), (None, "revisit", 9), (0, "response", None), (1, "response", None)} <= kinds
    assert warc.archive_round_trip(pages.where("1 = 0")).count() == 0
    assert [r.payload_bytes for r in got if r.page_id == 11] == [len(big.encode())]


def test_warc_chunks_hold_running_digests(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab" * 50)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), chunk_chars=30)
    rows = sorted(warc.chunk_table(spark, str(tmp_path / "w")).collect(), key=lambda r: r.chunk)
    assert [r.chunk for r in rows] == [1, 2, 3, 4]
    seen = b""
    for r in rows:
        seen += bytes(r.data)
        assert r.running == hashlib.sha256(seen).hexdigest()


def test_warc_writes_in_batches(spark):
    rows = spark.createDataFrame([(i, i, "u", "d", 4000, False, None, None, "z" * 4000) for i in range(5)], "row long, page long, url__ string, digest string, size long, again boolean, refers long, refers_row long, body string").coalesce(1)
    texts = [r.value for r in warc.segment_rows(rows, "2024-01-01T00:00:00Z", 1000, batch_bytes=1500).collect()]
    assert len(texts) == 20 and sum(t.endswith("z" * 1000) for t in texts) == 20
    assert sum("WARC-Segment-Total-Length: 4000" in t for t in texts) == 5


def test_warc_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 200, "x", 9, "y"), (1, "u", "a" * 200, "x", 9, "y"), (2, "u", None, "x", 9, "y")], "page_id long, url string, html string, digest string, row int, body string")
    got = sorted((r.page_id, r.record_type, r.payload_bytes) for r in warc.archive_round_trip(pages).collect())
    assert got == [(1, "response", 200), (1, "revisit", 200), (2, "response", 0)]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    good = {"email": lambda m, d: True, "ip": lambda m, d: all(int(p) <= 255 for p in m.split(".")), "card": lambda m, d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 8 <= len(d) <= 15}
    return {k: [m.span() for m in re.finditer(r, text or "") if good[k](m[0], re.sub("[^0-9]", "", m[0]))] for k, r in PATTERNS.items()}


def test_personal_data_spans(spark, docs, texts):
    rng = random.Random(5)
    odd = ["".join(rng.choice("0123456789+-. ()@aé_") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    odd += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0000000000000000", "4" * 9000, "a" * 30_000 + "@", "+1" * 300, "1-" * 5000, "𝒳 x@y.zz 𝒳 1.2.3.4"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    want = {**{i: base_spans(t) for i, t in enumerate(texts)}, **{1000 + i: base_spans(t) for i, t in enumerate(odd)}}
    for r in pii.find_personal_data(every).collect():
        assert {k: [(s.s, s.e) for s in r.base[k]] for k in pii.BASE} == want[r.doc_id], r.doc_id
    assert pii.find_personal_data(empty(docs)).count() == 0


def test_redact_hides_spans(docs):
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert not any("@" in (t or "") for t in got.values())
    assert got[0] is None and len(got) == docs.count()


@pytest.fixture(scope="module")
def disguised(spark):
    """Documents with base forms to learn from, planted forms that the base patterns miss (ids from 5000), and decoys (from 9000)."""
    rng = random.Random(21)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n - 2)) + "x7"
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    say = lambda x: f"{text_of(rng, rng.randint(3, 20))} {x} {text_of(rng, rng.randint(3, 20))}."
    word = lambda: rng.choice(WORDS)
    base = [lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com".replace("é", "e"), lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", card, lambda: f'token = "{hexes(40)}"', lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))]
    rows = [(i, say(base[i % 5]())) for i in range(500)]
    missed = [lambda: f"{word()}.{digits(2)} [at] {word()} [dot] com".replace("é", "e"), lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: mixed(32), lambda: hexes(40), lambda: f"{word()} at {word()} dot org".replace("é", "e")]
    rows += [(5000 + i, say(missed[i % 5]())) for i in range(200)]
    decoys = [lambda: f"2024-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{digits(3)} {word()}", lambda: "-".join(word() for _ in range(5)).replace("é", "e") + "-2023", lambda: f"look at {word()}. Dot", lambda: "abc123" * 5]
    rows += [(9000 + i, say(decoys[i % 5]())) for i in range(200)]
    return rows


def test_trees_find_what_the_base_patterns_miss(spark, disguised):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in disguised], "doc_id long, text string, body string, base string")
    got = {r.doc_id: sum(len(v) for v in r.added) for r in pii.find_personal_data(docs).collect()}
    missed, clean = [got[i] for i, _ in disguised if 5000 <= i < 9000], [got[i] for i, _ in disguised if i >= 9000]
    assert sum(n > 0 for n in missed) / len(missed) >= 0.9
    assert sum(n > 0 for n in missed) / (sum(n > 0 for n in missed) + sum(n > 0 for n in clean)) >= 0.95
    # redaction carries the text: null and repeated ids are no matter
    twice = docs.unionByName(docs.where("doc_id >= 5000").withColumn("doc_id", F.lit(None).cast("long")))
    hidden = pii.redact(twice)
    assert hidden.columns == docs.columns and hidden.count() == twice.count()
    marks = hidden.where("doc_id is null and text like '%█%'").count()
    assert marks == sum(n > 0 for i, n in got.items() if i >= 5000)


def brute_repeats(raws, length):
    count = {}
    for raw in raws:
        for p in range(len(raw) - length + 1):
            count[raw[p : p + length]] = count.get(raw[p : p + length], 0) + 1
    out = []
    for raw in raws:
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if count[raw[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        runs = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        out.append((len(raw), sum(cover), runs, bytes(x for x, c in zip(raw, cover) if not c)))
    return out


@pytest.mark.parametrize("group", [4000, 1])
def test_repeated_strings(spark, docs, texts, group, monkeypatch):
    if group == 1:  # all groups take the window counts
        old = suffix_dedup.repeated_spans
        monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda *a, **k: old(*a, **k, group=0))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == dict(enumerate(brute_repeats([(t or "").encode() for t in texts], 200)))
    assert suffix_dedup.suffix_dedup(empty(docs)).count() == 0


def test_shard_merge_equals_one_sort():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(20, 60))) for _ in range(40)]
    strings += strings[:3]
    want = suffix_dedup.repeated_windows(strings, 12, shard_bytes=1 << 20)
    for size in (1, 100, 500):
        assert all((a == b).all() for a, b in zip(want, suffix_dedup.repeated_windows(strings, 12, shard_bytes=size)))


@pytest.mark.parametrize("length", [8, 12, 40])
def test_merged_transform_equals_one_built_whole(length):
    """Order, transform and common prefixes of three shards against suffixes sorted by brute force."""
    rng = random.Random(length)
    parts = [bytes(rng.choice(b"abc\0") for _ in range(n)) for n in (70, 1, 45)]
    parts[2] += parts[0][:50]
    shards = [suffix_dedup.Transform(p, length) for p in parts]
    source, common = suffix_dedup.interleave(shards, length)
    cut = lambda k, i: (parts[k] + bytes(length))[i : i + length]
    rows = sorted(((cut(k, i), k, i) for k, p in enumerate(parts) for i in range(len(p))))
    assert source.tolist() == [k for _, k, _ in rows]
    assert suffix_dedup.merged(shards, source).tolist() == [parts[k][i - 1] for _, k, i in rows]
    levels = [0, *suffix_dedup.depths(length)]
    agree = lambda a, b: next((j for j in range(length) if a[j] != b[j]), length)
    assert common.tolist() == [0, *[max(d for d in levels if d <= agree(a[0], b[0])) for a, b in zip(rows, rows[1:])]]


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, texts, tik):
    out = byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, leaf=64)
    for r in out.collect():
        t = texts[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == tik.encode_ordinary(t) and bytes(r.decoded) == t.encode() and r.n_lines == r.doc_id
    assert byte_bpe.byte_bpe(empty(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_joins_anywhere(tik):
    enc = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, leaf=5, window=2)
    rng = random.Random(2)
    for _ in range(400):
        t = "".join(rng.choice("ab  \n\t1'sre!é  \x1c漢") for _ in range(rng.randint(0, 80)))
        assert enc.encode(t).tolist() == tik.encode_ordinary(t)


def test_decontamination(spark):
    item = "A train leaves the old station at 40 km per hour and Alice waits for 3 hours before it comes back home again"
    changed = item.replace("40", "72").replace("Alice", "Ruth")
    mixed = item.replace("40 km", "72 km").replace("3 hours", "72 hours")
    rng = random.Random(9)
    rows = [(1, f"{text_of(rng, 50)} {item} {text_of(rng, 50)}"), (2, f"{text_of(rng, 50)}. {changed}"), (3, text_of(rng, 90)), (4, None), (5, ""), (6, " ".join(item.split()[:12])), (7, item.lower()), (None, item), (1, item), (8, mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, item), (12, None), (13, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert {d for d, _ in got} >= {1, 2, None} and not {3, 4, 5, 6} & {d for d, _ in got}
    assert {i for _, i in got} == {10, 11}
    assert got == {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, broadcast_rows=0).collect()}
    left = sorted((r.doc_id or 0, r.text) for r in decontam.decontaminate(docs, bench).collect() if r.text)
    assert {i for i, _ in left} == {3, 6, 8} - ({8} & {d for d, _ in got}), "the row without an id holds the item and goes"
    assert decontam.leaks(docs, bench.where("1 = 0")).count() == 0 == decontam.leaks(docs.where("1 = 0"), bench).count()


def test_decontamination_finds_edited_recased_and_short_items(spark):
    rng = random.Random(10)
    item = "A train leaves the old station at 40 km per hour and Alice waits for 3 hours before it comes back home again"
    twice = f"The tank in the yard holds 3 measures of rain {text_of(rng, 12)} while the barn behind it needs 3 measures of seed {text_of(rng, 12)} until the end of the season"
    edited = twice.replace("3 measures of seed", "4 measures of seed")
    rows = [(1, f"{text_of(rng, 40)} {item.lower()}"), (2, item.replace("and Alice", "and\nAlice")), (3, f"{text_of(rng, 30)} {edited} {text_of(rng, 30)}"), (4, f"{text_of(rng, 30)} zebra quagga okapi {text_of(rng, 30)}"), (5, f"{text_of(rng, 30)} 17 {text_of(rng, 30)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, twice), (12, "Zebra quagga okapi"), (13, "23")], "item_id long, text string")
    for rows in (2_000_000, 0):
        assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, broadcast_rows=rows).collect()} == {(1, 10), (2, 10), (3, 11), (4, 12)}


def brute_leaks(docs, items, width=5, similarity=0.8):
    """Every window of every document against every window of every item, in loops."""
    out = set()
    shown = lambda tokens, slots: [slots[i][1].lower() if i in slots else t for i, t in enumerate(tokens)]
    for item, text in items:
        tokens, slots = decontam.canonical(text)
        k = min(width, len(tokens))
        if not k:
            continue
        words = shown(tokens, slots)
        starts = range(len(tokens) - k + 1)
        all_windows = {tuple(tokens[i : i + k]) for i in starts}
        for doc, body in docs:
            theirs, own = decontam.canonical(body)
            spoken = shown(theirs, own)
            by_shift = {}
            for j in range(len(theirs) - k + 1):
                for i in starts:
                    pairs = None
                    if words[i : i + k] == spoken[j : j + k] and any(x in slots for x in range(i, i + k)) and any(x in own for x in range(j, j + k)):
                        by_shift.setdefault(j - i, []).append((tuple(tokens[i : i + k]), frozenset()))
                    if tokens[i : i + k] == theirs[j : j + k] and not all(x in slots for x in range(i, i + k)):
                        pairs = frozenset(((*own[j + x],), (*slots[i + x],)) for x in range(k) if i + x in slots)
                        by_shift.setdefault(j - i, []).append((tuple(tokens[i : i + k]), pairs))
                    elif words[i : i + k] == spoken[j : j + k] and pairs is None and (any(x in slots for x in range(i, i + k)) or any(x in own for x in range(j, j + k))):
                        by_shift.setdefault(j - i, []).append((tuple(tokens[i : i + k]), frozenset()))
            matched = set()
            for rows in by_shift.values():
                seen = {}
                for _, pairs in set(rows):
                    for p in pairs:
                        seen[p] = seen.get(p, 0) + 1
                there, back = {}, {}
                for a, b in sorted(seen, key=lambda p: (-seen[p], p[0] != p[1], ("".join(p[0]), "".join(p[1])))):
                    if a not in there and b not in back:
                        there[a], back[b] = b, a
                matched |= {w for w, pairs in rows if all(there.get(a) == b for a, b in pairs)}
            if len(matched) >= similarity * len(all_windows):
                out.add((doc, item))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(31)
    names, units = ["Alice", "Ruth", "Kofi"], ["km", "hours", "kg"]

    def sentence(n):
        parts = [rng.choice([*WORDS[:9], str(rng.randint(1, 9)), rng.choice(names), f"{rng.randint(1, 99)} {rng.choice(units)}"]) for _ in range(n)]
        return " ".join(parts)

    items = [(i, sentence(rng.randint(1, 24))) for i in range(24)] + [(100, "1 2 3 4 5 6 7"), (101, "kara kara kara kara kara kara"), (102, None), (103, "17")]
    docs = []
    for i in range(60):
        text = items[i % 28][1] or ""
        words = text.split()
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = rng.choice([str(rng.randint(1, 9)), "Ruth", "kara"])
        docs.append((i, f"{sentence(6)} {' '.join(words) if i % 3 else text.lower()} {sentence(6)}"))
    docs += [(60, None), (61, ""), (62, "1 2 3 4 5 6 7"), (63, "9 2 3 4 5 6 7 8"), (64, " ".join("kara" for _ in range(4000)))]
    table = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id long, text string, item string, hash string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 30
    for limit in (2_000_000, 0):
        assert {(r.doc_id, r.item_id) for r in decontam.leaks(table, bench, broadcast_rows=limit).collect()} == want


def test_id_files(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    at, want = 0, {}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for options in ({}, {"shard_bytes": 4000}, {"file_ids": 50}):
        got = repair_ids.id_file_round_trip(docs, path, **options).collect()
        assert {r.id: (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got} == want
    assert repair_ids.id_file_round_trip(empty(docs), path).count() == 0
    odd = spark.createDataFrame([(None, "one two"), (5, "three"), (5, "three")], "doc_id long, text string")
    assert sorted((r.id or 0, r.start) for r in repair_ids.id_file_round_trip(odd, path).collect()) == [(0, 0), (5, 3), (5, 5)]


def test_id_files_with_added_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    contents = [t.content for t in tok.get_added_tokens_decoder().values()]
    texts = [f"one {contents[-1]} two{contents[0]}", "plain words here", f"{contents[0].upper()}Up", f"a{contents[0]}b é\n{contents[-1].upper()}!", "< | > é", contents[0][:-1]]
    got = repair_ids.id_file_round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r.id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got} == {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.append(rng.integers(3, 9, n), 2) for n in rng.integers(0, 50, 400)]).astype("<u2")
    ends = np.flatnonzero(ids == 2) + 1
    for least in (4, 9, 40):
        data = repair_ids.pack(list(range(len(ends))), ids, ends, 20, 2, least=least)
        shard = repair_ids.Shard(data)
        assert len(shard.rules) > 0 and len(shard.seq) < len(ids)
        seq = shard.seq.tolist()
        left = [p for p in zip(seq, seq[1:]) if 2 not in p and p[0] != p[1]]
        assert max(map(left.count, set(left))) < least, "rounds go on until no pair is left that is frequent"
        assert shard.sizes(0, len(ends)).tolist() == np.diff(ends, prepend=0).tolist()
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            assert shard.decode(i).tolist() == ids[a:b].tolist()
        assert shard.decode(3, 9).tolist() == ids[ends[2] : ends[8]].tolist()
    runs = np.array([5] * 999 + [2], "<u2")
    assert repair_ids.Shard(repair_ids.pack([0], runs, np.array([1000]), 20, 2)).decode(0).tolist() == runs.tolist()


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, coder = Tokenizer.from_file(path), repair_ids.WordCoder(path, most=500)
    rng = random.Random(3)
    parts = [*"abcABCxyzéÉßÜüñÑİıΣσςſ'.,!?<|>_-()0129  \n\t\r \u0338\u0301\u0307漢字ｶﾞ\x0b\x1c\x00\xa0’“ﬁǅ\u212a", "'s", "'ll", " don't", "İ'", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " the ", " and."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(10_000)] + ["", " ", "\n", "x" * 5000]
    assert coder.by_words
    for lo in range(0, len(texts), 3000):
        some = texts[lo : lo + 3000]
        ids, ends = coder.encode(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]
    # a file of another kind is applied to whole texts
    other = repair_ids.WordCoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, ends = other.encode(pa.array(some, pa.string()))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_words and [x.tolist() for x in np.split(ids, ends[:-1])] == [e.ids for e in whole.encode_batch(some, add_special_tokens=False)]


def brute_lines(rows, least=40, docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= docs and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_line_dedup(docs, texts, limit):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(docs, broadcast_rows=limit).collect()}
    want = brute_lines(list(enumerate(texts)))
    assert got == want and sum(v[1] for v in want.values()) > 5
    assert line_dedup.line_dedup(empty(docs)).count() == 0


def test_filter_grows_with_the_input(spark):
    few, many = (spark.range(n).selectExpr("repeat('x', 4000) as text") for n in (1, 4000))
    assert line_dedup.filter_bits(few, 40) == line_dedup.LEAST_BITS
    assert line_dedup.filter_bits(many, 40) >= 8 * 4000 * 4000 // 41


def test_full_bloom_filters_change_nothing(docs, texts):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(docs, bits=1 << 20, min_docs=2).collect()}
    assert got == brute_lines(list(enumerate(texts)), docs=2)


def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, text_of(rng, 80) + "." if i % 3 else text_of(rng, 30).upper().replace(" ", "!! ") + " ### $$$") for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(250)] + [(None, 1, 0), (7777, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    stats = quality_qda.with_statistics(docs).cache()
    scored = {r.doc_id: r for r in quality_qda.score_statistics(stats, quality_qda.train(stats, labels)).collect()}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored.values())
    held = [r for r in scored.values() if r.held_out and r.doc_id < 1000]
    assert sum((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    kept = {r.doc_id for r in quality_qda.quality_filter(docs, labels).collect()}
    assert kept == {d for d, r in scored.items() if r.score >= 0.3}
    assert quality_qda.quality_filter(docs, labels.where("1 = 0")).count() == len(rows)
    assert quality_qda.quality_filter(docs.where("1 = 0"), labels).count() == 0


def test_quality_equals_plain_discriminant(spark):
    """Fit and scores against densities written out with numpy's own covariance, determinant and solve."""
    rng = random.Random(14)
    rows = [(i, text_of(rng, rng.randint(20, 90)) + "." if i % 3 else text_of(rng, rng.randint(5, 40)).upper() + " ### 42 !!") for i in range(200)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows] + [(500, None, "clash")], "doc_id long, text string, statistics string")
    labels = [(i, int(i % 3 > 0)) for i in range(150)] + [(3, 0), (5, 1), (5, 0), (7, 9), (None, 1)]  # 5 contradicts itself, 7 has no label that counts
    stats = quality_qda.with_statistics(docs)
    model = quality_qda.train(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality_qda.score_statistics(stats, model).collect()}
    learn = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5 and i not in (5, 7)]
    x = np.array([quality_qda.statistics(t) for _, t in rows] + [quality_qda.statistics(None)])
    y = np.array([int(i % 3 > 0) for i in learn])
    scale = np.sqrt(np.maximum(x[learn].var(axis=0), 1e-6))
    z = (x - x[learn].mean(axis=0)) / scale
    own = [np.cov(z[learn][y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).sum() * own[c] for c in (0, 1)) / len(y)
    logs = []
    for c in (0, 1):
        cov = 0.85 * own[c] + 0.15 * pooled
        cov = 0.95 * cov + 0.05 * np.trace(cov) / len(cov) * np.eye(len(cov))
        d = np.clip(z, -8, 8) - z[learn][y == c].mean(axis=0)
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d * np.linalg.solve(cov, d.T).T).sum(axis=1))
    want = 1 / (1 + np.exp(-np.clip(0.25 * (logs[1] - logs[0]), -60, 60)))
    assert np.allclose([got[i] for i in [*range(200), 500]], want, atol=1e-6)
    assert docs.columns == quality_qda.quality_filter(docs, spark.createDataFrame(labels, "doc_id long, quality int")).columns


def test_held_out_labels_are_not_learnt(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, text_of(rng, 40)) for i in range(60)], "doc_id long, text string")
    stats = quality_qda.with_statistics(docs).cache()
    a = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - i % 2 if quality_qda.held_out(i) else i % 2) for i in range(60)], "doc_id long, quality int")
    one, two = (sorted((r.doc_id, round(r.score, 9)) for r in quality_qda.score_statistics(stats, quality_qda.train(stats, x)).collect()) for x in (a, b))
    assert one == two


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_groups(codes, link):
    group = list(range(len(codes)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if link(codes[i], codes[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [top(i) for i in range(len(codes))]


def test_simhash_groups(docs, texts):
    codes = [brute_fingerprint(t) for t in texts]
    want = brute_groups(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r.id: (r.lanes[0] & (2**64 - 1), r.component) for r in simhash.simhash_groups(docs).collect()}
    assert got == {i: (c, g) for i, (c, g) in enumerate(zip(codes, want))}
    assert simhash.simhash_groups(empty(docs)).count() == 0


def test_trie_join_finds_every_link():
    rng = np.random.default_rng(5)
    for budget in (2, 4, 6):
        seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        near = [s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) for s in seeds for k in rng.integers(1, 9, 12)]
        code = np.unique(np.concatenate([seeds, np.array(near, np.uint64)]))
        n = len(code)
        zero = np.zeros(n, np.int64)
        link = lambda a, b: (a ^ b).bit_count() <= budget  # noqa: E731, B023
        want = brute_groups([int(c) for c in code], link)
        assert simhash.trie_links(code, zero, zero, budget, code[:, None], 64, leaf=4).tolist() == want
        pairs = {(i, j) for j in range(n) for i in range(j) if link(int(code[i]), int(code[j]))}
        a, b = simhash.trie_links(code, zero, zero, budget, code[:, None], 64, leaf=4, links="forest")
        assert set(zip(a.tolist(), b.tolist())) <= pairs and len(a) == n - len(set(want))
        assert simhash.settle(n, a, b, np.arange(n)).tolist() == want
        a, b = simhash.trie_links(code, zero, zero, budget, code[:, None], 64, leaf=4, links="pairs", known=np.arange(n) % 7)
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(p for p in pairs if p[0] % 7 != p[1] % 7)


def test_every_pair_meets_under_a_root(spark):
    """Roots of one, two and three blocks, and large roots dealt out in parts: the same components."""
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    near = [s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) for s in seeds for k in rng.integers(1, 7, 10)]
    code = np.unique(np.concatenate([seeds, np.array(near, np.uint64)]))
    want = brute_groups([int(c) for c in code], lambda a, b: (a ^ b).bit_count() <= 4)
    codes = spark.createDataFrame([(i, [int(c)]) for i, c in enumerate(code.view(np.int64))], "node long, lanes array<long>").cache()
    for n, split, k in ((10, 1 << 18, 1), (1 << 30, 1 << 40, 2), (1 << 38, 1 << 50, 3), (700, 3, 1)):
        assert len(simhash._roots(4, n)[0]) == k
        edges = simhash.hamming_links(codes, n, split=split).collect()
        assert simhash.settle(len(code), *np.array(edges, np.int64).T, np.arange(len(code))).tolist() == want


def test_simhash_dedup_keeps_one(spark):
    rng = random.Random(6)
    base = text_of(rng, 400)
    words = base.split()
    near = " ".join(words[:200] + ["edited"] + words[201:])
    rows = [(5, base), (3, near), (9, base), (1, text_of(rng, 400)), (2, text_of(rng, 400)), (None, base), (7, None)]
    got = {r.doc_id for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {1, 2, 3, 7, None} >= got and {1, 2} <= got and len(got & {3, 5, 9}) <= 1


def test_simhash_dedup_finds_pairs_at_the_limit(spark):
    """Four single edits of 200 words: 176 of 216 shingles (0.815); five: 171 of 221 (0.774)."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 200)]
        other = list(words)
        edits = 4 if i < 100 else 5
        for e in range(edits):
            other[10 + 40 * e - (5 if edits == 5 else 0)] = f"new{i}x{e}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(200)} <= kept
    assert sum(2 * i + 1 not in kept for i in range(100)) >= 97
    assert all(2 * i + 1 in kept for i in range(100, 200))


def test_components(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    loose = [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 3)]
    edges = [*chain, *hub, *loose]
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    place = {n: i for i, n in enumerate(nodes)}
    linked = {(place[a], place[b]) for a, b in real}
    want = brute_groups(list(range(len(nodes))), lambda a, b: (a, b) in linked or (b, a) in linked)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: nodes[w] for n, w in zip(nodes, want)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    near = np.repeat(centres[:20], 6, axis=0) + 0.12 * rng.standard_normal((120, 32))
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([centres, near, near[:5]])]
    vectors += [None, [0.0] * 32, [1.0] * 31, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] + [1.0] * 31]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    got = {r.id: (r.n_links, r.component) for r in itq_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block).collect()}
    x = np.array(vectors[:185], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i][0] for i in range(185))
    assert all(got[i] == (0, i) for i in range(185, len(vectors)))
    assert found >= 0.9 * link.sum() and all(got[i][0] <= link[i].sum() for i in range(185)) and link.sum() > 300
    assert len(got) == len(vectors)


def test_itq_plan_keeps_recall_off_centre():
    """Vectors with a large common mean, a third of them in one group of near copies: held against brute force."""
    rng = np.random.default_rng(4)
    n, d = 6000, 32
    mean = np.zeros(d)
    mean[0] = 1.3
    rows = mean + rng.standard_normal((n, d)) / np.sqrt(d)
    rows[: n // 3] = rows[0] + 0.5 * rng.standard_normal((n // 3, d)) / np.sqrt(d)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    width, tables, (centre, projection, threshold) = itq_dedup.measured_plan(n, rows, 0.9)
    bits = ((unit - centre) @ projection >= threshold).reshape(n, tables, width)
    keys = (bits * (1 << np.arange(width))).sum(axis=2)
    for part in (slice(0, n // 3), slice(n // 3, n)):
        x, k = unit[part], keys[part]
        i, j = np.nonzero(np.triu((x @ x.T >= 0.9) & (x @ x.T < 0.92), 1))
        pick = rng.choice(len(i), min(len(i), 20_000), replace=False)
        assert len(pick) >= 100 and (k[i[pick]] == k[j[pick]]).any(axis=1).mean() >= 0.95
