"""WARC archives of pages, written and read back as tables of record chunks.

Writing: every page is one record. Of pages with equal payloads of ``REVISIT_BYTES`` or more, that with the smallest id is a response
and the others are revisits that refer to it. A payload longer than ``chunk`` bytes becomes WARC segments: a response record
with WARC-Segment-Number 1 and continuation records, one table row each, so no row holds more than a chunk. A generator cuts them off
the payload one by one; each carries the digest of all up to its end on to the next. Spark writes the rows as gzip-compressed text files,
one archive for each task.

Reading: archives are split at the record mark ``WARC/1.0``. That is safe because the writer never lets the mark stand inside a
segment: it ends a segment inside any payload's own mark. Each fragment is a chunk row of record id and segment number. Digests of
records of one segment are taken in place; of longer ones the chunks are dealt out by record and run, in order of number,
through an incremental SHA-256, chunk by chunk. A digest that differs from the header's stops the job.

Defined results: a null html is an empty payload; rows that share the smallest id of their payload are all responses; a null id
stays null, and pages of a payload that only null ids have are all responses; urls may be null (no WARC-Target-URI), and their
control characters are percent-encoded; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _stage

REVISIT_BYTES = 100
#: Bytes of a segment at most (a multiple-byte character is never cut), and of the records a task hands on at a time.
CHUNK = 1 << 16
BATCH = 1 << 20
MARK = "WARC/1.0"
_MARK_HEAD = len("WARC/")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _slices(payload: memoryview, chunk: int) -> Iterator[memoryview]:
    """The payload in slices of ``chunk`` bytes at most, none of which ends inside a character or lets the record mark stand inside it."""
    at, size = 0, len(payload)
    while at < size:
        end = min(size, at + chunk)
        while end < size and payload[end] & 0xC0 == 0x80:  # the next byte goes on with a character
            end -= 1
        # the mark is cut in two: its first part ends this slice
        cut = bytes(payload[at : end + len(MARK)]).find(MARK.encode())
        if 0 <= cut < end - at:
            end = at + cut + _MARK_HEAD
        yield payload[at:end]
        at = end


def digested(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest``: digests run over each payload slice by slice, on the batch's own buffer."""

    @F.arrow_udf("struct<size: long, digest: string>")
    def measure(payloads: pa.Array) -> pa.Array:
        sizes, digests = [], []
        for value in payloads.cast(pa.large_binary()):
            state, view = hashlib.sha256(), memoryview(value.as_buffer())
            for at in range(0, len(view), chunk):
                state.update(view[at : at + chunk])
            sizes.append(len(view))
            digests.append(state.hexdigest())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["size", "digest"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    return rows.withColumn("m", measure("payload")).select("page_id", "url", "payload", F.col("m.size").alias("payload_bytes"), F.col("m.digest").alias("payload_digest"))


def classified(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``digested`` with ``refers_to``, which is null for responses."""
    rows = digested(pages, chunk)
    copies = rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    # only digests that come twice; written, so that a digest of very many rows is a plain join side that can be split
    copies = _stage.written(copies.where("n > 1 and first_id is not null").select(F.col("payload_digest").alias("copied"), "first_id"), "copies")
    joined = rows.join(copies, F.col("payload_digest") == F.col("copied"), "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("copied", "first_id")


def _target(url: str) -> str:
    """The url without control characters and without the record mark."""
    for code in (0, 9, 10, 13):
        url = url.replace(chr(code), f"%{code:02X}")
    return url.replace(MARK, "WARC/1%2E0")


def _records(row: dict, rid: str, payload: memoryview, chunk: int) -> Iterator[bytes]:
    """The WARC records of one page, one after another: the head of a segment and its slice, up to its last line feed.

    Each segment says the digest of the payload up to its end, carried on from the one before.
    """
    state, done, nr = hashlib.sha256(), 0, 0
    parts = _slices(payload, chunk)
    body = next(parts, payload[:0])
    while body is not None:
        following, nr = next(parts, None), nr + 1
        state.update(body)
        done += len(body)
        first, last = nr == 1, following is None
        kind = "continuation" if not first else "response" if row["refers_to"] is None else "revisit"
        head = {
            "WARC-Type": kind,
            "WARC-Record-ID": f"<{rid}:{nr}>",
            "WARC-Date": "1970-01-01T00:00:00Z",
            "WARC-Target-URI": _target(row["url"]) if first and row["url"] is not None else None,
            "WARC-Payload-Digest": f"sha256:{row['payload_digest']}" if first else None,
            "WARC-Profile": _PROFILE if kind == "revisit" else None,
            "WARC-Refers-To": None if row["refers_to"] is None else f"<urn:page:{row['refers_to']}>",
            "WARC-Segment-Number": nr if not (first and last) else None,
            "WARC-Segment-Origin-ID": f"<{rid}:1>" if not first else None,
            "WARC-Segment-Total-Length": row["payload_bytes"] if last and not first else None,
            "X-Payload-Length": row["payload_bytes"] if first else None,
            "X-Running-Digest": f"sha256:{state.hexdigest()}" if not (first and last) else None,
            "Content-Type": "text/html; charset=utf-8",
            "Content-Length": len(body),
        }
        lines = "".join(f"{name}: {value}\r\n" for name, value in head.items() if value is not None)
        yield b"".join((f"{MARK}\r\n{lines}\r\n".encode(), body, b"\r\n"))
        body = following
    if kind != "revisit" and (done, state.hexdigest()) != (row["payload_bytes"], row["payload_digest"]):
        raise ValueError(f"{rid}: the segments do not make up the payload")


def segments(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the archive: ``record``, the text of one WARC record up to its last line feed.

    A generator cuts slices off the batch's buffer and hands on at most about BATCH bytes of records at a time, so neither a payload nor its chunks
    are ever copied as a whole.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["record"])

        for batch in batches:
            plain = {c: batch.column(c).to_pylist() for c in ("row", "page_id", "url", "payload_bytes", "payload_digest", "refers_to")}
            payloads = batch.column("payload").cast(pa.large_binary())
            for i in range(batch.num_rows):
                row = {c: v[i] for c, v in plain.items()}
                rid = f"urn:page:{'' if row['page_id'] is None else row['page_id']}:{row['row']}"
                payload = memoryview(payloads[i].as_buffer())
                for record in _records(row, rid, payload if row["refers_to"] is None else payload[:0], chunk):
                    out.append(record)
                    held += len(record)
                    if held > BATCH:
                        yield flush()
                        out, held = [], 0
        if out:
            yield flush()

    rows = classified(pages, chunk=chunk).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(cut, "record string")


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """The archives of ``pages`` under ``path``, wherever Spark can write."""
    segments(pages, chunk).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table: ``record_id, nr, kind, page_id, target, digest, refers_to, total, body``."""
    raw = spark.read.option("lineSep", MARK + "\r\n").text(path).where("value != ''")
    split_at = F.instr("value", "\r\n\r\n")
    cut = raw.select(F.substring("value", F.lit(1), split_at + 1).alias("head"), F.substring("value", split_at + 4, F.length("value") - split_at - 7).alias("body"))
    field = lambda name: F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r]*)\r", 1)
    opt = lambda c: F.when(c != "", c)
    own = F.regexp_extract(field("WARC-Record-ID"), r"^<(urn:page:[^:]*:[0-9]+):", 1)
    rows = cut.select(
        own.alias("record_id"),
        F.coalesce(opt(field("WARC-Segment-Number")).cast("int"), F.lit(1)).alias("nr"),
        field("WARC-Type").alias("kind"),
        opt(F.regexp_extract(own, r"^urn:page:([^:]*):", 1)).cast("long").alias("page_id"),
        opt(field("WARC-Target-URI")).alias("target"),
        opt(F.regexp_extract(field("WARC-Payload-Digest"), r"^sha256:([0-9a-f]+)$", 1)).alias("digest"),
        opt(F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?[0-9]+)>$", 1)).cast("long").alias("refers_to"),
        opt(field("X-Payload-Length")).cast("long").alias("total"),
        field("Content-Length").cast("long").alias("length"),
        "body",
    )
    whole = F.octet_length("body") == F.col("length")
    return rows.withColumn("body", F.when(whole, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("a record's length differs from its header: "), F.col("record_id"))))).drop("length")


def _running_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each record: its digest and length, from chunks that stream past in order of record and number."""
    now, state, size, expected = None, hashlib.sha256(), 0, 1
    out: list[tuple[str, int, str]] = []

    def flush() -> pa.RecordBatch:
        ids, sizes, digests = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_pydict({"record_id": pa.array(ids, pa.string()), "payload_bytes": pa.array(sizes, pa.int64()), "payload_digest": pa.array(digests, pa.string())})

    for batch in batches:
        for record, nr, body in zip(batch.column("record_id").to_pylist(), batch.column("nr").to_pylist(), batch.column("body"), strict=True):
            if record != now:
                if now is not None:
                    out.append((now, size, state.hexdigest()))
                now, state, size, expected = record, hashlib.sha256(), 0, 1
            if nr != expected:
                raise ValueError(f"{record}: segment {expected} is missing")
            view = body.as_buffer()
            state.update(view)
            size, expected = size + view.size, expected + 1
        yield flush()
        out.clear()
    if now is not None:
        out.append((now, size, state.hexdigest()))
    yield flush()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, target, payload_bytes, payload_digest, record_type, refers_to`` of every record in the archives."""
    chunks = read_chunks(spark, path)
    firsts = chunks.where("kind != 'continuation'")
    short = (F.col("kind") == "revisit") | (F.octet_length("body") == F.col("total"))
    checked = firsts.where(short).withColumn("found", F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(F.sha2(F.col("body").cast("binary"), 256)))
    one = checked.select("page_id", "target", F.col("total").alias("payload_bytes"), F.col("found").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "digest")
    # chunks of a record meet in one task, in order; a task holds one chunk and one running digest at a time
    parts = chunks.where("kind = 'continuation' or (kind = 'response' and octet_length(body) < total)")
    run = parts.select("record_id", "nr", F.col("body").cast("binary").alias("body")).repartition("record_id").sortWithinPartitions("record_id", "nr")
    digests = run.mapInArrow(_running_digests, "record_id string, payload_bytes long, payload_digest string")
    heads = firsts.where(~short).select("record_id", "page_id", "target", "refers_to", "digest", "total")
    many = heads.join(digests, "record_id").select("page_id", "target", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), "refers_to", "digest")
    same = F.col("payload_digest") == F.col("digest")
    every = one.unionByName(many)
    return every.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload's digest differs from its header")))).drop("digest")


def round_trip(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Write the pages' archives into the shared folder and read their records back."""
    path = f"{_stage.work_dir(pages.sparkSession)}/warc-{uuid4().hex}"
    write_archives(pages, path, chunk)
    return read_records(pages.sparkSession, path)
