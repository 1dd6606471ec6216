"""Content-addressed WARC archive.

A page is one WARC record. Payload bytes are stored once per strong digest
(SHA-256): of the records with equal payloads of at least ``least`` bytes the one
with the smallest id is a ``response`` with the bytes, the others are
``revisit`` records that refer to it; smaller payloads are always stored.
Headers are kept exactly as written, apart from payloads; reading joins headers
to payloads by digest, checks every payload against its digest, and so rebuilds
each original record, also those whose payload another record holds.

Archives are plain WARC/1.1 streams, each compressed as one gzip file, written and
read through Spark's own sinks and sources, so any store that Spark reaches will
do. Records are written in runs of ``RUN`` bytes and a file takes ``RUNS`` of these,
so it holds 128 MB (or as many records as are larger than a run). A record is found
by its Content-Length, never by searching for a delimiter, as payloads may hold
anything.

A response has its payload; only revisits are joined, with the payloads of the
digests that they name, once each in a table of their own, so the revisits of a
frequent payload can be split. A revisit whose payload is missing is an error.

Defined cases: null html is the empty payload; null or odd URLs are written with
control characters and blanks as %20 (null: ``about:blank``); rows that
repeat an id with the same payload are all responses; a group whose ids are all
null has only responses; extra columns are ignored; an empty table writes an
empty archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import light_batches, materialize, new_path, text_slices

#: At most so many digests that repeat are broadcast (48 bytes each); more take a shuffled join.
BROADCAST_DIGESTS = 200_000
#: Bytes of a run of records, and runs of a file.
RUN, RUNS = 4 << 20, 32
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(record): the exact characters of each WARC record but for the last line feed, which the sink adds."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload")})
    again = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    again = materialize(again, "repeated")
    again = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    rows = rows.join(again, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("\r\n"))
    clean = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank"))
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", F.col("bytes").cast("string")), F.lit("\r\n"))
    rows = rows.withColumns({"revisit": revisit, "http": http})
    length = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    head = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID: ", _urn(F.col("id"))),
        line("WARC-Date: ", date),
        line("WARC-Target-URI: ", clean),
        line("WARC-Payload-Digest: sha256:", F.col("digest")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile: ", _PROFILE), line("WARC-Refers-To: ", _urn(F.col("first"))))).otherwise(""),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", length.cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, "http", F.when(F.col("revisit"), "").otherwise(F.col("payload")), F.lit("\r\n\r")).alias("record"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins records to runs of about RUN bytes; the sink ends each with the line feed that ends its last record."""
    held: list[str] = []
    size = 0
    for batch in batches:
        for _, _, texts in text_slices(batch.column("record"), RUN):
            held += texts
            size += sum(map(len, texts))
            if size >= RUN:
                yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)], pa.string())], names=["value"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)], pa.string())], names=["value"])


def write_archive(pages: DataFrame, path: str | None = None, **options) -> str:
    """Writes the archives and returns their folder."""
    light_batches(pages.sparkSession)
    path = path or new_path(pages.sparkSession, "warc")
    runs = records(pages, **options).mapInArrow(_runs, "value string")
    runs.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", RUNS).text(path)
    return path


class _Stream:
    """Bytes of one gzip file, inflated as they are asked for."""

    def __init__(self, data: bytes, step: int = 1 << 16):
        self.data, self.at, self.step, self.held = memoryview(data), 0, step, bytearray()
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        while self.at < len(self.data):
            got = self.inflate.decompress(self.data[self.at : self.at + self.step])
            self.at += self.step
            if self.inflate.eof and self.inflate.unused_data:  # a further member
                self.at -= len(self.inflate.unused_data)
                self.inflate = zlib.decompressobj(31)
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end."""
        seen = 0
        while (i := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("a WARC record is cut off")
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("a WARC record is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(exact header bytes with the HTTP header, WARC fields, payload bytes) of each record of an archive."""
    s = _Stream(data)
    while (head := s.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:] if x)
        block = s.take(int(fields["Content-Length"]))
        if s.take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record does not end where it says")
        at = block.index(b"\r\n\r\n") + 4
        yield head + block[:at], fields, block[at:]


def _page(urn: str | None) -> int | None:
    n = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(n) if n.lstrip("-").isdigit() else None


def _records(kind: str, head: bool, payload: bool):
    """Records of one type with header, payload or both; every payload is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "refers_to", "uri", "digest", "header", "payload"])

        for batch in batches:
            for data in (x.as_py() for x in batch.column("content")):
                rows, size = [], 0
                for exact, f, body in parse(data):
                    if f["WARC-Type"] != kind:
                        continue
                    said = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(body).hexdigest() != said:
                        raise ValueError(f"the payload of {f['WARC-Record-ID']} does not match its digest")
                    rows.append((_page(f["WARC-Record-ID"]), _page(f.get("WARC-Refers-To")), f.get("WARC-Target-URI"), said, exact if head else None, body if payload else None))
                    size += len(body) + len(exact)
                    if size > 8 << 20 or len(rows) >= 10_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return run


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, uri, digest, header, payload): every record with its full payload."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    form = "page_id long, refers_to long, uri string, digest string, header binary, payload binary"
    cols = ["page_id", "record_type", "refers_to", "uri", "digest", "header", "payload"]
    responses = files.mapInArrow(_records("response", True, True), form).withColumn("record_type", F.lit("response"))
    revisits = files.mapInArrow(_records("revisit", True, False), form).drop("payload").withColumn("record_type", F.lit("revisit"))
    wanted = materialize(revisits.select("digest").distinct(), "wanted")
    stored = files.mapInArrow(_records("response", False, True), form).select("digest", "payload").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("payload").alias("payload"))
    stored = materialize(stored, "payloads")
    missing = F.raise_error(F.concat(F.lit("no payload for the digest "), F.col("digest"))).cast("binary")
    rebuilt = revisits.join(stored, "digest", "left").withColumn("payload", F.coalesce("payload", missing))
    return responses.select(*cols).unionByName(rebuilt.select(*cols))


def original_record(header: Column, payload: Column, record_type: Column) -> Column:
    """The exact bytes of a record as it was written, from its parts."""
    return F.concat(header, F.when(record_type == "response", payload).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n"))
