"""WARC archives: write records, read them back, and reassemble segmented records.

Writing: one response record a page, the html in a chunked HTTP message; a page whose payload equals that of a page with
a larger page_id becomes a revisit that names the other. A message longer than `segment_bytes` is cut into segments: the
first is the response with WARC-Segment-Number 1, the others are continuation records that name it in
WARC-Segment-Origin-ID; the last has WARC-Segment-Total-Length. Archives are gzipped text files that Spark's writer
makes, with the record separator CR LF CR LF as line separator, so they can be in any store that Spark reaches.

Reading: each archive is parsed by itself, inflated a piece at a time and handed on record by record, so a task holds the
archive as it is stored and its largest record. Only segmented records are shuffled: grouped by origin
identifier, ordered by segment number, and held against the total length; then the chunked framing is undone. A record
whose segments are missing, repeated, or of another length, whose framing is broken or whose payload hasn't the digest
it names is kept with `problem` set and a null payload. Revisits take their payload's length from the record they name.

Defined cases: null html is an empty payload, a null url leaves WARC-Target-URI out, a page with a null page_id is a
response that no revisit names, an empty table gives no archive and no record, further columns of pages are ignored. Each
of several rows with one page_id, or with none, is a record with an identifier of its own (page and place of writing); a
revisit names the page, and of the page's records that one is meant which has the revisit's digest.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path, stored, table

END = b"\r\n\r\n"
REVISIT_BYTES = 1000
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 4096
RECORDS_PER_FILE = 2000
#: Rows of the duplicate table that are broadcast at most (about 60 bytes each); with more, the join is shuffled.
BROADCAST_ROWS = 200_000
DATE = "2020-01-01T00:00:00Z"
_ID = "<urn:page:{}>"
#: The page of an identifier, with or without what tells rows with one page_id apart.
_PAGE = r"^<urn:page:(-?\d+)(?::r\d+-\d+)?>$"
_PART = "<urn:page:{}:{}>"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c := body[i : i + size]), c) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message; ValueError if the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(data[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has another length")
        out.append(data[at : at + size])
        at += size + 2


def _head(version: bytes, fields: list[tuple[str, str]]) -> bytes:
    return version + b"".join(f"\r\n{k}: {re.sub('[^ -~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), v)}".encode() for k, v in fields)


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES, row: str = "") -> Iterator[bytes]:
    """The records of one page, without the closing CR LF CR LF. `row` tells rows with one page_id apart."""
    name = f"{'none' if page_id is None else page_id}{row}"
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = [("WARC-Target-URI", url)] if url is not None else []
    common = [("WARC-Record-ID", _ID.format(name)), ("WARC-Date", DATE), *target, ("WARC-Payload-Digest", f"sha1:{sha}")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield _head(b"WARC/1.1", [("WARC-Type", "revisit"), *common, ("WARC-Refers-To", _ID.format(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]) + END + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    for k, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        segment = [("WARC-Segment-Number", str(k))] if len(cuts) > 1 else []
        if k > 1:
            kind = [("WARC-Type", "continuation"), ("WARC-Record-ID", _PART.format(name, k)), ("WARC-Date", DATE), *target, ("WARC-Segment-Origin-ID", _ID.format(name))]
            if k == len(cuts):
                segment.append(("WARC-Segment-Total-Length", str(len(block))))
        else:
            kind = [("WARC-Type", "response"), *common, ("Content-Type", "application/http;msgtype=response")]
        yield _head(b"WARC/1.1", [*kind, *segment, ("Content-Length", str(len(part)))]) + END + part


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an uncompressed archive that comes in pieces."""
    held, at, read = bytearray(), 0, 0
    source = iter(pieces)

    def until(n: int) -> bool:
        """Whether n bytes from `at` are there; reads on as far as needed."""
        nonlocal held, at, read
        while len(held) - at < n:
            piece = next(source, None)
            if piece is None:
                return False
            del held[:at]
            read, at = read + at, 0
            held += piece
        return True

    while until(1):
        if held[at : at + 2] == b"\r\n" or (until(2) and held[at : at + 2] == b"\r\n"):
            at += 2
            continue
        end = held.find(END, at)
        while end < 0 and until(len(held) - at + 1):
            end = held.find(END, at)
        if end < 0 or not held.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {read + at}")
        fields = {}
        for line in held[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size, head = int(fields["content-length"]), end + 4 - at
        if not until(head + size):
            raise ValueError(f"the record at byte {read + at} is cut off")
        yield fields, bytes(held[at + head : at + head + size])
        at += head + size


def unzipped(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """All members of a gzip file in pieces of about `size` bytes; other bytes as they are."""
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        at = 0
        while not z.eof and (at < len(data) or z.unconsumed_tail):
            rest = z.unconsumed_tail or data[at : at + size]
            at += 0 if z.unconsumed_tail else len(rest)
            yield z.decompress(rest, size)
        yield z.flush()
        data = z.unused_data + data[at:]
    yield data


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, row = TaskContext.get().partitionId(), 0
    for b in batches:
        out, size = [], 0
        for page_id, url, html, refers, repeated in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to", "repeated")), strict=True):
            row += 1
            for r in page_records(page_id, url, (html or "").encode(), refers, row=f":r{task}-{row}" if repeated or page_id is None else ""):
                out.append(r)
                size += len(r)
            if size > 4 << 20:
                yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
                out, size = [], 0
        yield pa.record_batch([pa.array(out, pa.binary())], ["record"])


def _body() -> Column:
    return F.coalesce("html", F.lit(""))


def _sha() -> Column:
    return F.sha1(_body().cast("binary"))


def duplicates(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, sha, refers_to) of the pages whose payload of at least `least` bytes a larger page_id has too."""
    d = pages.select("page_id", F.octet_length(_body()).alias("n"), _sha().alias("sha")).where(F.col("n") >= least)
    last = d.groupBy("sha", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("lowest")).where("lowest < refers_to")
    return d.join(last, ["sha", "n"]).where("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()


def write(pages: DataFrame, path: str) -> None:
    """Writes archives of all pages below path."""
    copies = duplicates(pages)
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    repeated = stored(pages.groupBy("page_id").agg(F.count("*").alias("k")).where("k > 1").select("page_id", F.lit(True).alias("repeated")), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    records = pages.select("page_id", "url", "html", _sha().alias("sha")).join(copies, ["page_id", "sha"], "left").join(repeated, "page_id", "left").mapInArrow(_write, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


_RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("record_id", T.StringType()), ("kind", T.StringType()), ("target", T.StringType()), ("digest", T.StringType()), ("refers_id", T.StringType()),
    ("origin", T.StringType()), ("segment", T.IntegerType()), ("total", T.LongType()), ("block", T.BinaryType()))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _RECORD.names
    types = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    batch = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)
    for b in batches:
        for content in b.column("content"):
            rows, size = [], 0
            for f, block in parsed(unzipped(content.as_py())):
                number = f.get("warc-segment-number")
                rows.append((
                    f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"),
                    (f.get("warc-segment-origin-id") or f.get("warc-record-id")) if number else None, int(number) if number else None,
                    int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block))
                size += len(block)
                if size > 4 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            yield batch(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_parse, _RECORD)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payloads, sizes, shas, problems = [], [], [], []
        for kind, digest, parts, problem in zip(*(b.column(n).to_pylist() for n in ("kind", "digest", "parts", "problem")), strict=True):
            payload = sha = None
            if kind == "revisit":
                sha = binascii.hexlify(base64.b32decode(digest.partition(":")[2])).decode()
            elif problem is None:
                try:
                    head, _, body = b"".join(parts).partition(END)
                    payload = unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body
                    raw = hashlib.sha1(payload)
                    sha = raw.hexdigest()
                    if digest and digest.partition(":")[2] != base64.b32encode(raw.digest()).decode():
                        payload, problem = None, "the payload has another digest"
                except ValueError as e:
                    payload, problem = None, str(e)
            payloads.append(payload)
            sizes.append(None if payload is None else len(payload))
            shas.append(sha)
            problems.append(problem)
        cols = {n: b.column(n) for n in ("record_id", "kind", "target", "refers_id")}
        yield pa.record_batch([*cols.values(), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(problems, pa.string())],
                              [*cols, "payload", "payload_bytes", "payload_digest", "problem"])


def reassembled(records: DataFrame) -> DataFrame:
    """record_id, kind, target, digest, refers_id, parts, problem of whole records: parts are a block's segments in order."""
    plain = records.where("segment is null").select("record_id", "kind", "target", "digest", "refers_id", F.array("block").alias("parts"), F.lit(None).cast("string").alias("problem"))
    first = F.expr("segment = 1")
    g = records.where("segment is not null").groupBy("origin").agg(
        *(F.max(F.when(first, F.col(n))).alias(n) for n in ("kind", "target", "digest", "refers_id")),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    numbers = F.transform("parts", lambda x: x["segment"])
    blocks = F.transform("parts", lambda x: x["block"])
    size = F.aggregate(blocks, F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x))
    g = g.select(F.col("origin").alias("record_id"), "kind", "target", "digest", "refers_id", "total", numbers.alias("numbers"), size.alias("size"), blocks.alias("parts"))
    problem = (
        F.when(F.col("numbers") != F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("numbers"))), "segments are missing or repeated")
        .when(F.col("total").isNull() | (F.col("total") != F.col("size")), "the segments have another total length"))
    return plain.unionByName(g.select("record_id", "kind", "target", "digest", "refers_id", "parts", problem.alias("problem")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Whole records with decoded payloads: record_id, kind, target, refers_id, payload, payload_bytes, payload_digest, problem."""
    return reassembled(read_records(spark, path)).mapInArrow(
        _payloads, "record_id string, kind string, target string, refers_id string, payload binary, payload_bytes bigint, payload_digest string, problem string")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.nullif(F.regexp_extract(c, _PAGE, 1), F.lit("")).cast("bigint")
    r = read(spark, path).select(page(F.col("record_id")).alias("page_id"), "kind", "payload_bytes", "payload_digest", "problem", F.when(F.col("refers_id").isNotNull(), page(F.col("refers_id"))).alias("refers_to"))
    r = stored(r, "records")  # archives are parsed once
    # what revisits name: one row for each payload that is named, whatever the number of its revisits and of its records
    again = r.where("kind = 'revisit'").drop("payload_bytes")
    named = again.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    lengths = r.where("kind = 'response'").join(named, ["page_id", "payload_digest"], "left_semi")
    lengths = lengths.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "problem"]
    return r.where("kind <> 'revisit'").select(columns).unionByName(again.join(lengths, ["refers_to", "payload_digest"], "left").select(columns))


#: Payloads are UTF-8 encodings of strings, so SQL has their digests.
OP2_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
g as (select d, n, max(page_id) as last from p where n >= 1000 group by d, n)
select page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
       case when last > page_id then 'revisit' else 'response' end as record_type,
       case when last > page_id then last end as refers_to,
       cast(null as varchar) as problem
from p left join g on p.d = g.d and p.n = g.n
"""
