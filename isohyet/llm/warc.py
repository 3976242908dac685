"""WARC archives through a chunked record table."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm._common import cut, new_folder, small_batches, spread

#: Between records, and the start of each record but the first of a file.
BREAK = "\r\n\r\nWARC/1.1\r\n"
#: Payloads are cut inside these, so that neither a segment nor a header's empty line and a segment make up a BREAK.
INNER = re.compile(r"WARC/1\.1\r\n")


def chunks_of(text: str, size: int):
    """Pieces of at most size characters of a payload, cut inside whatever could be taken for the start of a record. An empty payload is one empty piece."""
    cuts = {m.end() - 6 for m in INNER.finditer(text)} | set(range(size, len(text), size))
    at = 0
    for end in [*sorted(cuts), len(text)]:
        if end > at or not text:
            yield text[at:end]
            at = end


def record_types(pages: DataFrame, id_col: str, text_col: str, least_bytes: int) -> DataFrame:
    """pages with row, digest, size, refers: the id of the response that a revisit refers to.

    Of rows with equal payloads of at least least_bytes, the smallest id is the
    response, of rows of one id the first. Rows are numbered once and written, so
    that a task that runs again finds the same numbers. Only digests and ids meet
    to find the responses.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    numbered = pages.select(F.col(id_col).cast("long").alias("page"), "url__", body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = cut(numbered, "numbered-pages")
    order = F.struct(F.col("page").isNull().alias("n"), "page", "row")
    first = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "f")
    first = cut(first, "responses")
    joined = rows.join(spread(first), "digest", "left")
    again = F.col("f").isNotNull() & (F.col("f.row") != F.col("row"))
    return joined.select("row", "page", "url__", "digest", "size", again.alias("again"), F.when(again, F.col("f.page")).alias("refers"), F.when(again, F.col("f.row")).alias("refers_row"), F.when(~again, F.col("body")).alias("body"))


def _uri(page, row) -> str:
    return f"<urn:isohyet:page:{'null' if page is None else page}:{row}>"


def segment_rows(rows: DataFrame, date: str, size: int, batch_bytes: int = 4 << 20) -> DataFrame:
    """The archive's records as text: one row for each record or segment of an oversized one, with a running SHA-256 of the payload up to its end.

    Records are taken one after the other and pieces leave the task in batches of
    about batch_bytes, so what is held is one record and the pieces of one batch.
    """

    def records(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}

    def segments(r):
        own = _uri(r["page"], r["row"])
        head = [f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{r['digest']}", f"Isohyet-Payload-Length: {r['size']}"]
        if r["url__"] is not None:
            head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url__"]))
        if r["again"]:
            head = ["WARC-Type: revisit", *head, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(r['refers'], r['refers_row'])}", "Content-Length: 0"]
            yield "WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n"
            return
        running, done, number = hashlib.sha256(), 0, 0
        for piece in chunks_of(r["body"], size):
            raw = piece.encode("utf-8", "surrogatepass")
            running.update(raw)
            done += len(raw)
            number += 1
            last = done == r["size"]
            more = ["WARC-Type: response", *head, "Content-Type: text/html; charset=utf-8"] if number == 1 else ["WARC-Type: continuation", f"WARC-Record-ID: {own[:-1]}:{number}>", f"WARC-Date: {date}", f"WARC-Segment-Origin-ID: {own}"]
            if not (number == 1 and last):
                more += [f"WARC-Segment-Number: {number}", f"Isohyet-Running-Digest: sha256:{running.hexdigest()}"]
                more += [f"WARC-Segment-Total-Length: {r['size']}"] if last else []
            yield "WARC/1.1\r\n" + "\r\n".join([*more, f"Content-Length: {len(raw)}"]) + "\r\n\r\n" + piece

    def run(batches):
        out, held = [], 0
        for r in records(batches):
            for text in segments(r):
                out.append(text)
                held += len(text)
                if held >= batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", least_bytes: int = 100, chunk_chars: int = 1 << 18, date: str = "2024-01-01T00:00:00Z", per_file: int = 200_000) -> None:
    """Write one WARC record per row into gzipped archives under path, through Spark's own text writer.

    The payload is the text in UTF-8 (null: empty). Payloads of more than
    chunk_chars characters become segments (WARC/1.1 continuation records) with
    running digests. Repeated and null ids are kept apart by a row number in the
    record id. Control characters of a URL are percent-encoded; a null URL is left out.
    """
    small_batches(pages.sparkSession)
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = record_types(pages.withColumn("url__", url), id_col, text_col, least_bytes)
    segment_rows(rows, date, chunk_chars).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives under path: (record, chunk, kind, page, size, digest, refers, running, data).

    One row for each record or segment; ``running`` is the running digest that a
    segment states, ``size``, ``digest`` and ``refers`` stand on the first chunk.
    Records end by their Content-Length, so a payload may hold any text; a length
    that runs past the data is an error.
    """
    small_batches(spark)
    fields = re.compile(rb"^([A-Za-z-]+): ?(.*)$", re.M)

    def records(raw: bytes):
        at = 0
        while at < len(raw):
            if raw.startswith(b"WARC/1.1\r\n", at):
                at += 10
            end = raw.index(b"\r\n\r\n", at)
            head = {k.lower().decode(): v.strip().decode() for k, v in fields.findall(raw[at:end])}
            length = int(head["content-length"])
            data = raw[end + 4 : end + 4 + length]
            if len(data) != length:
                raise ValueError(f"record {head.get('warc-record-id')} is cut short")
            yield head, data
            at = end + 4 + length
            while raw.startswith(b"\r\n", at):
                at += 2

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                for head, data in records(text.encode("utf-8", "surrogatepass")):
                    if head["warc-type"] not in ("response", "revisit", "continuation", "resource"):
                        continue
                    own = head.get("warc-segment-origin-id", head["warc-record-id"])
                    page = own.split(":")[3]
                    refers = head.get("warc-refers-to")
                    out.append((own, int(head.get("warc-segment-number", 1)), head["warc-type"], None if page == "null" else int(page), int(head["isohyet-payload-length"]) if "isohyet-payload-length" in head else None, head.get("warc-payload-digest", "").removeprefix("sha256:") or None, None if refers is None or ":null:" in refers else int(refers.split(":")[3]), head.get("isohyet-running-digest", "").removeprefix("sha256:") or None, data))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, kinds)], names=["record", "chunk", "kind", "page", "size", "digest", "refers", "running", "data"])

    text = spark.read.schema("value string").option("lineSep", BREAK).text(path)
    return text.mapInArrow(run, "record string, chunk int, kind string, page long, size long, digest string, refers long, running string, data binary")


def record_digests(chunks: DataFrame) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to) for each record of a chunk table.

    A record of one chunk is digested where it is read. Segments of oversized
    records go to one task in order and are digested one after the other, so a
    whole payload is never in memory. A revisit takes length and digest from its
    header. A digest or length that differs from the stated one is an error.
    """
    alone = (F.col("chunk") == 1) & F.col("running").isNull()
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record"))).cast("string")
    single = chunks.where(alone).select(
        "page", F.col("size").alias("payload_bytes"),
        F.when(F.col("kind") == "revisit", F.col("digest")).when((F.sha2("data", 256) == F.col("digest")) & (F.octet_length("data") == F.col("size")), F.col("digest")).otherwise(wrong).alias("payload_digest"),
        F.when(F.col("kind") == "revisit", "revisit").otherwise("response").alias("record_type"), F.col("refers").alias("refers_to"),
    )

    def stitch(batches):
        def row(s):
            if s[1] != s[2] or s[3].hexdigest() != s[4]:
                raise ValueError(f"payload differs from its digest: {s[0]}")
            return s[5], s[1], s[4]

        state, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or state[0] != r["record"]:
                    if state is not None:
                        out.append(row(state))
                    state = [r["record"], 0, r["size"], hashlib.sha256(), r["digest"], r["page"], 0]
                state[1] += len(r["data"])
                state[3].update(r["data"])
                state[6] += 1
                if state[6] != r["chunk"] or state[3].hexdigest() != r["running"]:
                    raise ValueError(f"segment {r['chunk']} of {r['record']} is missing or damaged")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()))], names=["page", "payload_bytes", "payload_digest"])
            out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(state), (pa.int64(), pa.int64(), pa.string()))], names=["page", "payload_bytes", "payload_digest"])

    parts = chunks.where(~alone).select("record", "chunk", "page", "size", "digest", "running", "data")
    many = parts.repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(stitch, "page long, payload_bytes long, payload_digest string")
    return single.unionByName(many.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", **options) -> DataFrame:
    """Write pages as archives in the shared folder and read each record's digest back. An empty table gives an empty table."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path, id_col, text_col, url_col, **options)
    return record_digests(chunk_table(spark, path)).withColumnRenamed("page", id_col)
