"""Web pages from archives of WARC records, as a data source of Spark's: every archive is a split, and records stream out of it one by one.

``register(spark)`` makes ``spark.read.format("page_archive").load(folder)`` known. Where archives lie in a place that needs a way in of its own, a subclass of ``PageArchives``
says how files are listed and opened, and is registered in its place. ``fetched`` reads pages by address with any function, each address once.

Segments of a record follow each other by number and may lie in other archives; a record that refers to another (a revisit) has that one's text.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VERSION = "WARC/1.0"
CHUNKS = "archive string, record_id string, nr int, kind string, url string, origin string, refers_to string, body binary"


def _arrow_files(path: str):
    """The file system of a path and its place there; a path without a scheme is one of this machine."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class PageArchives(DataSource):
    """Records of all archives in the folder ``path``: see CHUNKS. Files whose names begin with an underscore or a dot are passed over."""

    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return CHUNKS

    def listed(self, path: str) -> list[str]:
        from pyarrow import fs

        system, at = _arrow_files(path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        return [f.path for f in found if f.is_file and not f.base_name.startswith(("_", "."))]

    def opened(self, folder: str, path: str):
        """A binary stream of an archive's bytes as they are stored."""
        return _arrow_files(folder)[0].open_input_stream(path, compression=None)

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self, self.options["path"])


class _ArchiveReader(DataSourceReader):
    def __init__(self, source: PageArchives, folder: str):
        self.source, self.folder = source, folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(self.source.listed(self.folder))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value == "":
            return
        with self.source.opened(self.folder, partition.value) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.value.endswith(".gz") else io.BufferedReader(raw)
            for head, body in records(stream):
                origin = head.get("warc-segment-origin-id", head["warc-record-id"])
                yield partition.value, head["warc-record-id"], int(head.get("warc-segment-number", 1)), head["warc-type"], head.get("warc-target-uri"), origin, head.get("warc-refers-to"), body


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record, in order; no more than a record is held. What does not begin as a record, or ends early, is an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        if line.strip().decode() != VERSION:
            raise ValueError(f"a record begins with {line[:20]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        size = int(head["content-length"])
        body = stream.read(size)
        if len(body) < size:
            raise ValueError(f"{head['warc-record-id']} ends after {len(body)} of {size} bytes")
        yield head, body


def register(spark: SparkSession, source: type[PageArchives] = PageArchives) -> None:
    spark.dataSource.register(source)


def _name(record: Column) -> Column:
    """What a record is called by those that refer to it: of a page's records the page's name."""
    plain = F.regexp_replace(record, "^<|>$", "")
    return F.coalesce(F.nullif(F.regexp_extract(plain, r"^(urn:page:[^:]*)", 1), F.lit("")), plain)


def pages(chunks: DataFrame) -> DataFrame:
    """``name, url, kind, html`` of every page in ``chunks`` (as the source gives them): segments joined in order, revisits with the text of what they refer to."""
    held = chunks.where("kind in ('response', 'continuation')")
    parts = held.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("nr", F.hex("body").alias("body")))).alias("parts"))
    # joined as hexadecimal digits, since a segment may end inside a character
    texts = parts.select("origin", F.decode(F.unhex(F.array_join(F.transform("parts", lambda x: x["body"]), "")), "UTF-8").alias("html"))
    own = chunks.where("kind = 'response'").join(texts, "origin").select(_name(F.col("record_id")).alias("name"), "url", "kind", "html")
    again = chunks.where("kind = 'revisit'").select(_name(F.col("record_id")).alias("name"), "url", "kind", _name(F.col("refers_to")).alias("of"))
    first = own.groupBy(F.col("name").alias("of")).agg(F.min("html").alias("html"))
    return own.unionByName(again.join(first, "of", "left").select("name", "url", "kind", "html"))


def write_archives(pages_of: DataFrame, path: str) -> None:
    """``pages_of`` (name, url, html) as archives under ``path``, one for each task, a record for each page; a null text is an empty one."""
    html, url = F.coalesce("html", F.lit("")), F.regexp_replace("url", r"[\r\n]", "")
    uri = F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")))
    head = F.concat(F.lit(f"{VERSION}\r\nWARC-Type: response\r\nWARC-Record-ID: <"), "name", F.lit(">\r\n"), uri, F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    pages_of.select(F.concat(head, html, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def fetched(urls: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """``url, html, problem`` of each distinct ``url``, read by ``fetch`` in the task that holds it; what it raises is the problem, and the page has no text."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    rows.append((url, fetch(url), None))
                except Exception as problem:  # noqa: BLE001  whatever a fetcher raises is told for its page
                    rows.append((url, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["url", "html", "problem"])

    return urls.select("url").where("url is not null").distinct().mapInPandas(read, "url string, html string, problem string")
