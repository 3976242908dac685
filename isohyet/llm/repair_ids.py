"""Token-id files compressed by a Re-Pair grammar per file, with random access by document."""

from __future__ import annotations

import functools
import io
import itertools
import json
import os
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm._common import cut, new_folder, small_batches

MAGIC = b"ISORPR02"
#: Printable Latin-1 bytes, which byte-level vocabularies write as themselves; the others are the letters from U+0100 on, in order.
PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - PLAIN))}
#: ASCII marks: at the end of a word, after a letter, the pre-tokenizer always has a boundary in front of them.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What the short cut by words relies on: a file of any other normalizer or pre-tokenizer is applied to whole texts.
NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _frequent(seq: np.ndarray, some: np.ndarray | None, end_id: int, least: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, number of the pair at each, pairs) of pairs that may stand ``least`` times, among all places or some.

    Pairs are counted by a hash, each slot of which stands for the first of its pairs; the hash differs from turn to turn.
    """
    slots = 1 << 20
    a, b = (seq[:-1], seq[1:]) if some is None else (seq[some], seq[some + 1])
    mark = ((a * np.int32(-1640531527 + 4 * turn) + b * np.int32(-2048144789 + 6 * turn)).view(np.uint32) >> np.uint32(12)).astype(np.intp)
    mark[(a == end_id) | (b == end_id)] = slots
    top = np.flatnonzero(np.bincount(mark, minlength=slots + 1)[:slots] >= least)
    slot = np.full(slots + 1, -1, np.int32)
    slot[top] = np.arange(len(top), dtype=np.int32)
    place = slot[mark]
    at = np.flatnonzero(place >= 0)
    place = place[at]
    key = a[at].astype(np.int64) << 32 | b[at]
    pair = np.zeros(len(top), np.int64)
    pair[place[::-1]] = key[::-1]
    exact = pair[place] == key
    at = at[exact]
    return at if some is None else some[at], place[exact], pair


def repair(ids: np.ndarray, first_free: int, end_id: int, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, rules of each round): rounds replace frequent pairs by new symbols until no pair stands ``least`` times.

    A round ranks the pairs by their counts over the whole file. Where
    occurrences overlap, the one of the better rank wins, so the order of
    replacement doesn't matter; a pair left with fewer than ``least`` of them
    waits for another round. The first round counts all pairs; later ones those
    beside new symbols and those that lost before, as the counts of all others
    only fall; where these are used up, all pairs are counted again, by three
    hashes before the end. The end of a document is never in a pair, so
    documents stay apart.
    """
    seq = ids.astype(np.int32)
    grammar, turns = [], []
    free, turn, vain = first_free, 0, 0
    waiting = None
    while len(seq) > least and vain < 3:
        at, place, pair = _frequent(seq, waiting, end_id, least, turn)
        turn += 1
        # of a run of one pair over itself every second place counts
        again = np.zeros(len(at), bool)
        again[1:] = (np.diff(at) == 1) & (place[1:] == place[:-1])
        if again.any():
            order = np.arange(len(at))
            whole = (order - np.maximum.accumulate(np.where(again, 0, order))) % 2 == 0
            at, place = at[whole], place[whole]
        n = np.bincount(place, minlength=len(pair))
        ok = n[place] >= least
        at, place = at[ok], place[ok]
        rank = np.empty(len(pair), np.int32)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(pair), dtype=np.int32)
        beside = np.diff(at) == 1
        better = rank[place[1:]] < rank[place[:-1]]
        keep = np.ones(len(at), bool)
        keep[1:] &= ~beside | better
        keep[:-1] &= ~(beside & better)
        used = np.bincount(place[keep], minlength=len(pair))
        keep &= used[place] >= least
        lost, at, place = at[~keep], at[keep], place[keep]
        if not len(at):
            vain += waiting is None
            waiting = None
            continue
        vain = 0
        held = np.flatnonzero(used >= least)
        number = np.full(len(pair), -1, np.int32)
        number[held] = np.arange(len(held), dtype=np.int32)
        seq[at] = free + number[place]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        touched = ~stay
        touched[at] = True
        where = np.cumsum(stay) - 1
        lost = lost[~touched[lost] & ~touched[lost + 1]]
        seq = seq[stay]
        fresh = where[at]
        new = np.zeros(len(seq) + 1, bool)
        new[fresh] = new[fresh - 1] = new[where[lost]] = True
        waiting = np.flatnonzero(new[: len(seq) - 1])
        grammar.append(np.stack([pair[held] >> 32, pair[held] & 0xFFFFFFFF], axis=1).astype(np.int32))
        turns.append(len(held))
        free += len(held)
    return seq, np.concatenate([np.empty((0, 2), np.int32), *grammar]), np.array(turns, np.int32)


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[i] .. start[i] + length[i] of all i, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - start, length)


def expansions(grammar: np.ndarray, turns: np.ndarray, first_free: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, start, length) of what each symbol stands for; plain ids stand for themselves. Rules of one round hold symbols of earlier ones only."""
    flat, length = np.arange(first_free, dtype=np.int32), np.ones(first_free, np.int64)
    start = np.arange(first_free, dtype=np.int64)
    at = 0
    for n in turns.tolist():
        both = grammar[at : at + n].ravel()
        flat_new = flat[gather(start[both], length[both])]
        own = length[both].reshape(-1, 2).sum(axis=1)
        start = np.concatenate([start, len(flat) + np.cumsum(own) - own])
        length = np.concatenate([length, own])
        flat = np.concatenate([flat, flat_new])
        at += n
    return flat, start, length


class Shard:
    """One file: rules with their rounds and expansion lengths, the offsets of documents in the sequence, the sequence."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of this format")
        self.first_free, n_rules, n_turns, n_docs, n_seq, width = struct.unpack_from("<6q", data, 8)
        at = 56

        def part(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = part("<i4", 2 * n_rules).reshape(-1, 2)
        self.lengths = part("<i4", n_rules)
        self.turns = part("<i4", n_turns)
        self.doc_ids = part("<i8", n_docs)
        self.known = part("u1", n_docs).astype(bool)
        self.offsets = part("<i8", n_docs + 1)
        self.seq = part(f"<u{width}", n_seq)
        self.flat, self.start, self.length = expansions(self.rules, self.turns, self.first_free)

    def decode(self, first: int, last: int | None = None) -> np.ndarray:
        """The ids of the document at a place, or of those up to another place, from their own part of the sequence alone."""
        s = self.seq[self.offsets[first] : self.offsets[first + 1 if last is None else last]]
        return self.flat[gather(self.start[s], self.length[s])]

    def sizes(self, first: int, last: int) -> np.ndarray:
        """How many ids the documents of some places have, by the expansion lengths alone."""
        at = self.offsets[first : last + 1]
        reach = np.concatenate([[0], np.cumsum(self.length[self.seq[at[0] : at[-1]]])])
        return np.diff(reach[at - at[0]])


def pack(doc_ids: list, ids: np.ndarray, ends: np.ndarray, first_free: int, end_id: int, **options) -> bytes:
    """The bytes of a file: ids of all documents one after the other, ends[i] past the last id of document i."""
    seq, grammar, turns = repair(ids, first_free, end_id, **options)
    _, _, length = expansions(grammar, turns, first_free)
    # a document ends with an end id, which no rule holds; so each document is a run of whole symbols
    reach = np.cumsum(length[seq])
    offsets = np.concatenate([[0], np.searchsorted(reach, ends) + 1])
    width = 2 if first_free + len(grammar) <= 1 << 16 else 4
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<6q", first_free, len(grammar), len(turns), len(doc_ids), len(seq), width))
    for x, kind in ((grammar, "<i4"), (length[first_free:], "<i4"), (turns, "<i4"), ([0 if d is None else d for d in doc_ids], "<i8"), ([d is not None for d in doc_ids], "u1"), (offsets, "<i8"), (seq, f"<u{width}")):
        out.write(np.asarray(x).astype(kind).tobytes())
    return out.getvalue()


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class WordCoder:
    """Ids of whole texts, each distinct word of a batch looked up once and each new one encoded once by a worker.

    Texts are split at white space. A word's core is the word without ASCII
    marks at its end, in lower case if all of it is ASCII; where the core is
    letters in normal form, the pre-tokenizer has a boundary between core and
    marks, and the core is one piece, whose merges come from the file's own
    model. Any other word goes whole through the file's tokenizer. A text in
    which an added token may stand isn't split at all. Ids are 32-bit unless
    the vocabulary fits 16 bits.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.most = most
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [c.lower() for c in contents]
        self.marks = sorted(set.intersection(*({c for c in x if not c.isalnum()} for x in contents))) if contents else []
        self.by_words = self._splits(held, contents)
        if self.by_words:
            vocab = self.tokenizer.get_vocab()
            self.closes = np.zeros(self.size, bool)
            self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
            self.pieces = Tokenizer(self.tokenizer.model)
            self.pieces.pre_tokenizer = CharDelimiterSplit(" ")
        self.clear()

    def _splits(self, held: dict, contents: list[str]) -> bool:
        """Whether the file is of the kind that the short cut by words is made for."""
        steps = [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in ((held.get("normalizer") or {}).get("normalizers") or [])]
        before = (held.get("pre_tokenizer") or {}).get("pretokenizers") or []
        kinds = [p["type"] for p in before]
        model = held.get("model") or {}
        return (
            steps == NORMAL and kinds == ["Split", "ByteLevel"] and (before[0].get("pattern") or {}).get("Regex") == PIECES and before[0].get("behavior") == "Removed" and before[0].get("invert") is True
            and not before[1].get("add_prefix_space") and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges")
            and all(any(not c.isalnum() for c in x) for x in contents) and (not contents or bool(self.marks))
        )

    def clear(self) -> None:
        """Forget all words but the empty one, which has no ids and stands at place 0."""
        self.place, self.held = {"": 0}, 1
        self.values, self.lengths = [np.empty(0, self.kind)], [np.zeros(1, np.int64)]

    def _learn(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(words, range(self.held, self.held + len(words))))
        self.held += len(words)
        self.values.append(ids.astype(self.kind))
        self.lengths.append(sizes.astype(np.int64))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, core: str) -> str | None:
        """The letters that the merges see for a core beyond ASCII, or None where a core isn't one piece of letters in normal form."""
        if core.isascii() or not (core.isalpha() and unicodedata.is_normalized("NFC", core)):
            return None
        low = "".join(map(str.lower, core))
        if len(low) != len(core) or not low.isalpha():
            return None
        return low.encode().decode("latin-1").translate(BYTE_LETTERS)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, end of each text) of a batch of texts without nulls."""
        odd = np.zeros(len(texts), bool)
        if not self.by_words:
            odd[:] = True
        elif self.added:
            near = np.logical_and.reduce([pc.match_substring(texts, m).to_numpy(zero_copy_only=False) for m in self.marks])
            for i in np.flatnonzero(near).tolist():
                text = texts[i].as_py()
                odd[i] = any(c in x.lower() for x in (text, self.tokenizer.normalizer.normalize_str(text)) for c in self.added)
        if not odd.any():
            return self._split(texts)
        whole = self._whole(texts.filter(pa.array(odd)).to_pylist())
        values, ends = self._split(texts.filter(pa.array(~odd))) if not odd.all() else (np.empty(0, self.kind), np.empty(0, np.int64))
        rest, both = iter(np.split(values, ends[:-1]) if len(ends) else []), iter(whole)
        parts = [next(both) if o else next(rest) for o in odd.tolist()]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        for mark in "\n\t\r":
            texts = pc.replace_substring(texts, mark, " ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if len(self.place) > self.most:
            self.clear()
        core, tail = self._places(words)
        values, length = np.concatenate(self.values), np.concatenate(self.lengths)
        self.values, self.lengths = [values], [length]
        start = np.cumsum(length) - length
        both = np.stack([core, tail], axis=1).ravel()
        offsets = np.concatenate([[0], np.cumsum(length[both].reshape(-1, 2).sum(axis=1))])
        table = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[gather(start[both], length[both])]))
        run = table.take(coded.indices)
        ends = lists.offsets.to_numpy().astype(np.int64)
        return run.flatten().to_numpy(zero_copy_only=False), run.offsets.to_numpy()[ends[1:] - ends[0]].astype(np.int64)

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word the places of the ids of its core and of the marks at its end, or of the whole word and of the empty one."""
        cores = pc.utf8_rtrim(words, characters=MARKS)
        cut = pc.binary_length(cores).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)].astype(np.int64)
        marks = raw[gather(begin + cut, size - cut)]
        stops = np.concatenate([[0], np.cumsum(size - cut)]).astype(np.int32)
        tails = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(marks.tobytes())]).dictionary_encode()
        cores = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(cores), cores).dictionary_encode()
        core = self._of_cores(_strings(cores.dictionary))[cores.indices.to_numpy()]
        tail = self._of_whole(_strings(tails.dictionary))[tails.indices.to_numpy()]
        odd = np.flatnonzero(core < 0)
        if len(odd):
            core[odd] = self._of_whole(_strings(words.take(pa.array(odd))))
            tail[odd] = 0
        return core, tail

    def _known(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, -2 for new ones, and where those are."""
        at = np.array(list(map(self.place.get, keys, itertools.repeat(-2))), np.int64)
        return at, np.flatnonzero(at == -2)

    def _of_cores(self, cores: list[str]) -> np.ndarray:
        """Places of cores; -1 for those that are not one piece of letters."""
        at, new = self._known(cores)
        names = [cores[i] for i in new.tolist()]
        pieces = [c if c.isascii() and c.isalpha() else self._piece(c) for c in names]
        good = np.array([x is not None for x in pieces], bool)
        self.place.update((c, -1) for c, x in zip(names, pieces) if x is None)
        at[new[~good]] = -1
        some, known = [x for x in pieces if x is not None], [c for c, x in zip(names, pieces) if x is not None]
        first = self.held
        for lo in range(0, len(some), 2000):
            part = some[lo : lo + 2000]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            stop = np.flatnonzero(self.closes[ids]) + 1
            if len(stop) != len(part):
                raise ValueError("a piece of letters has no ids in this vocabulary")
            self._learn(known[lo : lo + 2000], ids, np.diff(stop, prepend=0))
        at[new[good]] = np.arange(first, self.held)
        return at

    def _of_whole(self, words: list[str]) -> np.ndarray:
        """Places of words that go through the whole tokenizer."""
        keys = [f" {w}" if w else "" for w in words]  # no core holds a space
        at, new = self._known(keys)
        if len(new):
            ids = self._whole([words[i] for i in new.tolist()])
            first = self.held
            self._learn([keys[i] for i in new.tolist()], np.concatenate(ids), np.array([len(x) for x in ids]))
            at[new] = np.arange(first, self.held)
        return at


@functools.lru_cache(maxsize=1)
def _coder(path: str) -> WordCoder:
    """The coder of a worker, kept between its tasks."""
    return WordCoder(path)


def together(batches, size: int):
    """Batches of at least ``size`` bytes but the last, so that a word that several of them hold is looked up once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _files(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return fs, inner


def _shards(rows: DataFrame, shard_bytes: int, most: int = 20_000) -> np.ndarray:
    """Upper bounds of the id ranges that are shards: ranges of about shard_bytes of text, and at most ``most`` of them, as each is a number in every task."""
    total = rows.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    shards = min(most, -(-total // shard_bytes))
    if shards < 2:
        return np.empty(0, np.int64)
    bounds = rows.agg(F.percentile_approx("id", [i / shards for i in range(1, shards)], max(10_000, 10 * shards)).alias("b")).first().b
    return np.unique(np.array(bounds or [], np.int64))


def write_ids(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_bytes: int = 8 << 20, file_ids: int = 1 << 22) -> DataFrame:
    """Encode whole texts with the tokenizer file at ``path``, an end id after each document, and write id files in ascending id order.

    Returns the files: (shard, part, path, n_docs, n_ids). Documents go to
    shards by ranges of ids, a shard is sorted and written by one task, and a
    file ends after file_ids ids; so memory stays bounded for any document
    count, and for a range that many rows of one id make large. A file gets its
    name when it is whole; what a lost task left behind is in no list.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = _shards(rows, shard_bytes)
    first_free, kind = _coder(path).size, _coder(path).kind

    def encode(batches):
        coder = _coder(path)
        for batch in together(batches, 4 << 20):
            ids = batch.column(0)
            at = np.searchsorted(bounds, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False))
            values, ends = coder.encode(batch.column(1))
            values = np.insert(values, ends, end_id).astype(kind)
            offsets = np.concatenate([[0], (ends + np.arange(1, len(ends) + 1)) * kind.itemsize])
            coded = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), ids, coded], names=["shard", "id", "ids"])

    def write(batches):
        fs, inner = _files(folder)
        task = TaskContext.get().taskAttemptId()
        held, docs_held, n, part, shard = [], [], 0, 0, None

        def flush():
            nonlocal held, docs_held, n, part
            ids = np.frombuffer(b"".join(held), kind)
            ends = np.cumsum([len(x) // kind.itemsize for x in held])
            name = f"ids-{shard:08d}-{part:05d}.{task}"
            with fs.open_output_stream(f"{inner}/{name}.tmp") as out:
                out.write(pack(docs_held, ids, ends, first_free, end_id))
            fs.move(f"{inner}/{name}.tmp", f"{inner}/{name}.rpr")
            row = shard, part, f"{folder}/{name}.rpr", len(held), len(ids)
            held, docs_held, n, part = [], [], 0, part + 1
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["shard", "part", "path", "n_docs", "n_ids"])

        for batch in batches:
            for s, i, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "ids"))):
                if held and (s != shard or n >= file_ids):
                    yield flush()
                if s != shard:
                    shard, part = s, 0
                held.append(data)
                docs_held.append(i)
                n += len(data) // kind.itemsize
        if held:
            yield flush()

    fs, inner = _files(folder)
    fs.create_dir(inner, recursive=True)
    coded = rows.mapInArrow(encode, "shard int, id long, ids binary").repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("id"), "ids")
    return cut(coded.mapInArrow(write, "shard int, part int, path string, n_docs long, n_ids long"), "id-files")


def with_bases(files: DataFrame, group: int = 256) -> DataFrame:
    """files with base, the ids of all files before each: a running sum over groups of shards, then within each group, so that no task holds the list of files."""
    named = files.withColumn("group__", F.floor(F.col("shard") / group))
    sums = named.groupBy("group__").agg(F.sum("n_ids").alias("n"))
    # one row for each group of shards, of which there are at most 20,000 / group
    before = sums.withColumn("before__", F.sum("n").over(Window.orderBy("group__").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    within = F.sum("n_ids").over(Window.partitionBy("group__").orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    return named.withColumn("within__", within).join(before, "group__").withColumn("base", F.coalesce("before__", F.lit(0)) + F.coalesce("within__", F.lit(0))).drop("group__", "within__", "before__")


def read_ids(files: DataFrame, docs_at_once: int = 1000) -> DataFrame:
    """(id, start, n_tokens, ids binary) of each document in the files: start counts the ids of all documents before it."""
    todo = with_bases(files).select("path", "base")
    tasks = max(1, min(files.count(), 20_000))

    def run(batches):
        for batch in batches:
            for path, at in zip(*(batch.column(c).to_pylist() for c in ("path", "base"))):
                fs, inner = _files(path)
                with fs.open_input_stream(inner) as stream:
                    shard = Shard(stream.read())
                for lo in range(0, len(shard.doc_ids), docs_at_once):
                    hi = min(lo + docs_at_once, len(shard.doc_ids))
                    got = shard.decode(lo, hi).astype("<u4")
                    n = shard.sizes(lo, hi)
                    starts = at + np.cumsum(n) - n
                    at += int(n.sum())
                    offsets = pa.py_buffer((np.concatenate([[0], np.cumsum(n)]) * 4).astype(np.int32).tobytes())
                    ids = pa.array(shard.doc_ids[lo:hi], mask=~shard.known[lo:hi])
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(n), pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets, pa.py_buffer(got.tobytes())])], names=["id", "start", "n_tokens", "ids"])

    return todo.repartition(tasks).mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def id_file_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write docs as id files in the shared folder and read them back (see write_ids, read_ids).

    A null or empty text has the end id only; null ids come first; rows of one
    id keep an order by their ids; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    return read_ids(write_ids(docs, new_folder(spark, "id-files"), path, id_col, text_col, **options))


