"""WARC archives of captured pages, and the assembly of their transactions.

:func:`write` makes three records per page (request, response or revisit, metadata); request and metadata name the
response in ``WARC-Concurrent-To``.  Records are composed by Spark expressions and written by Spark's text writer, with
the blank lines that end a record as its line separator, so the files are WARC files and go through the usual committer.
:func:`read` streams through an archive by ``Content-Length`` and holds one record of it; :func:`transactions` joins the
records of a capture through their concurrent-to identifiers, in one shuffle, into one nested row.

Of captures whose payloads of at least ``LEAST_REVISIT`` bytes are equal, the one with the smallest page id is written in
full and the others revisit it.  Payloads are dealt by their digest, those of a digest that holds more than
1 / ``HOT_SHARE`` of all rows over as many salts as its share asks for (there are less than ``HOT_SHARE`` such digests, so their
list is broadcast), into as many archives as keep ``ARCHIVE_BYTES`` of payload each.

A record's id is made of what the capture is, and of its number among captures that are equal in page id, url and payload; so it
is the same whenever a task runs again.

Edge cases: null html is an empty payload; a null url is an empty target; repeated rows are captures of their own (of
equal rows one is the response); pages that share an id stay apart, the smaller url comes first; a page without id comes last; an
empty table gives an archive without records; line ends and control characters of a url are percent-encoded; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyport.llm import _session

NAME = "op9_warc"
LEAST_REVISIT = 100
#: Bytes of payload of an archive, on average; an archive is read by one task.
ARCHIVE_BYTES = 64 << 20
#: A digest with more than this part of all rows is salted.
HOT_SHARE = 1000

_END = "\\r\\n"
_URN = "concat('<urn:uuid:', substr({0}, 1, 8), '-', substr({0}, 9, 4), '-5', substr({0}, 14, 3), '-8', substr({0}, 18, 3), '-', substr({0}, 21, 12), '>')"

RECORD = "record_id string, kind string, concurrent_to string, refers_to string, target string, page_id long, refers_to_page long, payload_bytes long, payload_digest string, payload binary"


def _urn(kind: str, page: str = "page_id", target: str = "target", number: str = "number") -> str:
    """A record id made from the kind, the capture and its number."""
    return _URN.format(f"md5(concat_ws('|', '{kind}', coalesce(cast({page} as string), '-'), cast({number} as string), digest, {target}))")


def _record(kind: str, own: str, headers: list[tuple[str, str]], block: str) -> str:
    """SQL for one record; a header whose value is null is left out."""
    lines = "".join(f", coalesce(concat('{name}: ', {value}, '{_END}'), '')" for name, value in [("WARC-Record-ID", own), *headers])
    return f"concat('WARC/1.1{_END}WARC-Type: ', {kind}, '{_END}'{lines}, 'Content-Length: ', cast(octet_length({block}) as string), '{_END}{_END}', {block})"


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the archives of all pages to ``path``, as gzip files of whole records."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("target"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"),
    ).select("*", F.sha2(F.encode("payload", "UTF-8"), 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).collect()[0]
    first = F.min(F.struct(F.isnull("page_id").alias("unnamed"), "page_id", "target")).alias("first")
    firsts = rows.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = _session.materialize(firsts.withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("n") * HOT_SHARE / max(1, total["rows"]))).cast("int")), "firsts")
    copies = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hot = F.broadcast(firsts.filter("salts > 1").select("digest", "salts"))
    salt = F.pmod(F.xxhash64("page_id", "target"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = rows.join(hot, "digest", "left").withColumn("salt", salt).drop("salts").repartition(1 + total["bytes"] // archive_bytes, "digest", "salt")
    equal = Window.partitionBy("digest", "salt", "page_id", "target").orderBy("bytes")
    joined = dealt.withColumn("number", F.row_number().over(equal)).join(copies, ["digest", "salt"], "left")
    revisit = "(first is not null and not (first.page_id <=> page_id and first.target = target and number = 1))"
    out = joined.withColumn("revisit", F.expr(revisit)).withColumns(
        {
            "head": F.expr(f"concat('HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: ', cast(bytes as string), '{_END}{_END}')"),
            "ask": F.expr(f"concat('GET / HTTP/1.1{_END}User-Agent: tallyport{_END}{_END}')"),
            "about": F.expr(f"concat('page-id: ', coalesce(cast(page_id as string), ''), '{_END}', case when revisit then concat('refers-to-page-id: ', coalesce(cast(first.page_id as string), ''), '{_END}') else '' end)"),
        }
    )
    own = _urn("response")
    shared = [("WARC-Target-URI", "target"), ("WARC-Date", "'2024-01-01T00:00:00Z'")]
    digest = ("WARC-Payload-Digest", "concat('sha256:', digest)")
    out = out.withColumn("block", F.expr("case when revisit then head else concat(head, payload) end"))
    profile = ("WARC-Profile", "case when revisit then 'http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' end")
    refers = ("WARC-Refers-To", f"case when revisit then {_urn('response', 'first.page_id', 'first.target', '1')} end")
    refers_target = ("WARC-Refers-To-Target-URI", "case when revisit then first.target end")
    records = F.array(
        F.expr(_record("'request'", _urn("request"), [*shared, ("WARC-Concurrent-To", own), ("Content-Type", "'application/http; msgtype=request'")], "ask")),
        F.expr(_record("case when revisit then 'revisit' else 'response' end", own, [*shared, digest, profile, refers, refers_target, ("Content-Type", "'application/http; msgtype=response'")], "block")),
        F.expr(_record("'metadata'", _urn("metadata"), [*shared, ("WARC-Concurrent-To", own), ("Content-Type", "'application/warc-fields'")], "about")),
    )
    out.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    _session.discard(firsts)


class Inflated(io.RawIOBase):
    """An archive as a stream of its inflated bytes: of one gzip member or of many, or not compressed at all."""

    def __init__(self, data: memoryview) -> None:
        self.data, self.at, self.held, self.plain = data, 0, b"", bytes(data[:2]) != b"\x1f\x8b"
        self.member = zlib.decompressobj(wbits=31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:  # noqa: ANN001
        while not self.held and self.at < len(self.data):
            piece = bytes(self.data[self.at : self.at + (1 << 15)])  # at most a thousand times as much when inflated
            self.at += len(piece)
            if self.plain:
                self.held = piece
                continue
            if self.member.eof:
                self.member = zlib.decompressobj(wbits=31)
            self.held = self.member.decompress(piece)
            self.at -= len(self.member.unused_data)
        n = min(len(out), len(self.held))
        out[:n] = self.held[:n]
        self.held = self.held[n:]
        return n


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers (names in lower case) and block of each record of a stream; one record is held at a time."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record but {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers[b"content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {headers.get(b'warc-record-id')!r} is cut off")
        yield headers, block


def _rows(data: memoryview, with_payload: bool) -> Iterator[tuple]:
    for headers, block in parse(io.BufferedReader(Inflated(data), 1 << 16)):
        text = lambda name: headers[name].decode() if name in headers else None
        kind, page, of, size, digest, payload = text(b"warc-type"), None, None, None, None, None
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            if kind == "response":
                size, digest = len(body), hashlib.sha256(body).hexdigest()
                if f"sha256:{digest}" != text(b"warc-payload-digest"):
                    raise ValueError(f"payload of {text(b'warc-record-id')} does not match its digest")
                payload = body if with_payload else None
            else:
                digest = text(b"warc-payload-digest").removeprefix("sha256:")
                size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        elif kind == "metadata":
            fields = {n.strip(): v.strip() for n, _, v in (x.partition(b":") for x in block.split(b"\r\n"))}
            page, of = (int(fields[n]) if fields.get(n) else None for n in (b"page-id", b"refers-to-page-id"))
        yield text(b"warc-record-id"), kind, text(b"warc-concurrent-to"), text(b"warc-refers-to"), text(b"warc-target-uri"), page, of, size, digest, payload


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``; digests of responses are of what was read, and are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64()] * 3 + [pa.string(), pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                for row in _rows(memoryview(content.as_buffer()), with_payload):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 4096 or held > 1 << 23:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture`` (the response's record id) with the nested ``request``, ``response``, ``metadata``."""
    mine = records.withColumn("capture", F.coalesce("concurrent_to", "record_id"))
    of = lambda kinds, *columns: F.min_by(F.when(F.col("kind").isin(*kinds), F.struct(*columns)), F.when(F.col("kind").isin(*kinds), F.col("record_id")))
    return mine.groupBy("capture").agg(
        of(["request"], "record_id", "target").alias("request"),
        of(["response", "revisit"], "record_id", "kind", "target", "refers_to", "payload_bytes", "payload_digest", "payload").alias("response"),
        of(["metadata"], "record_id", "page_id", "refers_to_page").alias("metadata"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by the contract of op9."""
    path = _session.new_path(spark, "warc")
    write(_session.table(spark, sf_dir, "pages"), path)
    captures = transactions(read(spark, path, with_payload=False)).select(
        "metadata.page_id", "response.payload_bytes", "response.payload_digest", F.col("response.kind").alias("record_type"), F.col("metadata.refers_to_page").alias("refers_to")
    )
    captures = _session.materialize(captures, "op9")  # then the archives can go
    _session.drop_path(spark, path)
    return captures


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
