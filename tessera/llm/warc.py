"""WARC archives: writing captures with revisits and segments, and reading them back by segment reassembly.

Writing. Pages with equal payloads are told by their SHA-256: the one with the
least id is written as a response, the others as revisits of it. A response's
body is in chunked transfer framing; a block longer than ``segment_bytes`` is
cut into a first record and continuation records, which name the first as
their origin and carry a segment number, the last one the total length.
Records are rows of Spark's text writer, whose line separator is the empty
line that ends a record, so archives go wherever Spark writes, gzipped.

Reading. Spark's text reader cuts archives at ``WARC/1.``; a piece that is
shorter than its Content-Length was cut inside and takes the next one on. A
gzipped file is read in order by one task, piece by piece; files that Spark
may split are first put in order by file and offset. Records without a segment
number are decoded where they are read. Continuation records are grouped by
their origin, ordered by number, and checked: every number once, blocks as long
together as the total that the last one states. Then the chunked framing is
taken off, and the payload must have the digest that its record states.

Defined results: a null payload is an empty one; a null id or address has no
header and is null when read; control characters in an address are
percent-encoded; rows that repeat an id and a payload are written and read as
often as they are there, as responses if the id is the least of the group;
where a group has a row with an id, rows without are revisits; an incomplete,
overlong or damaged capture is read with a null payload, a revisit of a record
that isn't there with null lengths; an empty table gives no record but the
archives' own; other columns than the three are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, freeing, modest_batches, read_table, table_path, written

MARK, END = b"WARC/1.", b"\r\n\r\n"
#: Bytes of a chunk, and bytes of a record's block beyond which it is segmented.
CHUNK, SEGMENT = 4096, 16_384
MIN_BYTES = 0
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORD = "record_id string, kind string, uri string, page_id string, payload_digest string, refers_to string, segment int, origin string, total long, block binary"
_CAPTURE = "record_id string, kind string, uri string, page_id string, payload_digest string, refers_to string, payload binary"


def payload_digest(payload: Column) -> Column:
    """Base32 of the SHA-1 of a binary column: 20 bits are five digits of base 16 and four of base 32."""
    five = lambda i: F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[five(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


# Records


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """``body`` in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes | None:
    """The body of chunked framing, with or without extensions and trailers; None if it is damaged."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        try:
            n = int(framed[at:end].split(b";")[0].strip(), 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if framed[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(framed[at : at + n])
        at += n + 2


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def record(fields: dict[str, str | int | None], block: bytes) -> bytes:
    """A record up to the empty line that ends it."""
    sha = base64.b32encode(hashlib.sha1(block).digest()).decode()
    named = {**fields, "WARC-Date": DATE, "WARC-Block-Digest": f"sha1:{sha}", "Content-Length": len(block)}
    head = "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None, revisit: bool, segment_bytes: int = SEGMENT) -> Iterator[bytes]:
    """The records of one capture."""
    uri = url and "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    same = {"WARC-Target-URI": uri, "Page-Id": page, "WARC-Payload-Digest": f"sha1:{digest}"}
    # A revisit's own id can't be that of a response, whose key is the id and the digest alone.
    own = record_id(f"revisit {page}" if revisit else page, digest)
    if revisit:
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": own, **same, "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first, digest), "Content-Type": "application/http;msgtype=response"}, HTTP)
        return
    block = HTTP + chunked(payload)
    parts = range(0, len(block), segment_bytes)
    for k, at in enumerate(parts, 1):
        fields = {"WARC-Type": "response", "WARC-Record-ID": own, **same, "Content-Type": "application/http;msgtype=response"}
        if k > 1:
            fields = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(f"{page} {k}", digest), "WARC-Target-URI": uri, "WARC-Segment-Origin-ID": own}
        if len(parts) > 1:
            fields |= {"WARC-Segment-Number": k, "WARC-Segment-Total-Length": len(block) if k == len(parts) else None}
        yield record(fields, block[at : at + segment_bytes])


# Writing


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest, ``first`` (the least id with the payload) and ``revisit``."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    d = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("same", F.unhex(F.sha2("payload", 256)))
    groups = d.where(F.length("payload") >= min_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written, so that its size is known when the pages are joined: only groups of several pages are in it.
    groups = written(groups.where("n > 1 AND first IS NOT NULL").drop("n"), "warc-groups")
    d = d.join(groups, "same", "left").withColumn("digest", payload_digest(F.col("payload")))
    return d.select("page_id", "url", "payload", "digest", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))


def archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT, min_bytes: int = MIN_BYTES, compression: str = "gzip", **names: str) -> str:
    """Write the pages as WARC files, one for each task, under ``path``."""
    text = lambda c: F.col(c).cast("string").alias(c)
    d = with_revisits(pages, min_bytes, **names).select(text("page_id"), "url", "payload", "digest", text("first"), "revisit")

    @freeing
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}
        out, size = [record(info, b"format: WARC File Format 1.1\r\n")], 0
        for b in batches:
            for row in b.to_pylist():
                for r in records(row["page_id"], row["url"], row["payload"], row["digest"], row["first"], row["revisit"], segment_bytes):
                    out.append(r)
                    size += len(r)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = modest_batches(d).mapInArrow(task, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", END.decode()).option("compression", compression).text(path)
    return path


# Reading


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file and value of the pieces between marks, in the order of each file within one task."""
    def read(glob: str, but: str = "") -> DataFrame:
        d = spark.read.option("lineSep", MARK.decode()).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
        return d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("value"))

    gzipped = read("*.gz")
    flat = read("{*.warc,*.txt}").repartition("file").sortWithinPartitions("file", "start", "n")
    return gzipped.select("file", "value"), flat.select("file", "value")


def parsed(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of each record; a block that its file doesn't hold to the end is None."""
    held, size, need, of = [], 0, 0, None  # pieces of one record, their bytes, and how many it needs at least
    for file, piece in pieces:
        if held and file != of:
            yield from _record(held, True)
            held = []
        more = [MARK, piece] if held else [piece]
        size, need, of = (size if held else 0) + sum(map(len, more)), need if held else 0, file
        held += more
        if size >= need:
            held = [b"".join(held)]
            need = _needed(held[0])
            if size >= need:
                yield from _record(held, False)
                held = []
    if held:
        yield from _record(held, True)


def _fields(raw: bytes) -> tuple[dict[str, str], int]:
    """The headers in what follows a mark, and where the block begins; -1 if they don't end."""
    end = raw.find(END)
    lines = [x.partition(b":") for x in raw[: max(end, 0)].split(b"\r\n")[1:]]
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in lines}, end + len(END) if end >= 0 else -1


def _needed(raw: bytes) -> int:
    """How many bytes the record has, as far as can be told from these; more than these if its headers go on."""
    fields, at = _fields(raw)
    if at < 0:
        return len(raw) + 1 if raw else 0  # nothing: what stands before a file's first mark
    return at + (_number(fields.get("content-length")) or 0)


def _record(held: list[bytes], cut: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    raw = b"".join(held)
    fields, at = _fields(raw)
    size = _number(fields.get("content-length"))
    if at >= 0 and size is not None:
        yield fields, None if cut else raw[at : at + size]


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and x.isdigit() else None


def _body(block: bytes | None, digest: str | None) -> bytes | None:
    """The payload of an HTTP response, if it is whole and has its digest."""
    head, mark, body = (block or b"").partition(END)
    if not mark:
        return None
    if any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n"))):
        body = dechunked(body)
    if body is None or digest and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        return None
    return body


def _read(segments: bool):
    """A task that gives the segments as they are, or the other captures decoded."""
    names = [x.split()[0] for x in (_RECORD if segments else _CAPTURE).split(", ")]
    last = pa.binary()
    kinds = [pa.int32() if n == "segment" else pa.int64() if n == "total" else last if n in ("block", "payload") else pa.string() for n in names]

    def row(f: dict[str, str], block: bytes | None) -> tuple | None:
        kind, number, origin = f.get("warc-type"), _number(f.get("warc-segment-number")), f.get("warc-segment-origin-id")
        if kind not in ("response", "revisit", "continuation") or segments != (number is not None or kind == "continuation"):
            return None
        digest = f.get("warc-payload-digest", "").partition(":")[2] or None
        own = (f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("page-id"), digest, f.get("warc-refers-to"))
        if segments:
            return *own, number, origin or own[0], _number(f.get("warc-segment-total-length")), block
        return *own, None if kind == "revisit" else _body(block, digest)

    @freeing
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        out, size = [], 0
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for f, block in parsed(pieces):
            if r := row(f, block):
                out.append(r)
                size += len(r[-1] or b"") + 200
                if size > 1 << 22:
                    yield make(out)
                    out, size = [], 0
        if out:
            yield make(out)

    return task


def _joined(key: tuple, rows: pa.Table) -> pa.Table:
    """The capture of one origin from its segments, as often as its first segment is there."""
    rows = rows.sort_by("segment").to_pylist()
    heads = [r for r in rows if r["kind"] != "continuation"]
    parts = {r["segment"]: r for r in rows}
    whole = list(parts) == list(range(1, len(parts) + 1)) and all(r["block"] is not None for r in parts.values())
    block = b"".join(r["block"] for r in parts.values()) if whole and parts[len(parts)]["total"] is not None else None
    if block is not None and len(block) != parts[len(parts)]["total"]:
        block = None
    names = [x.split()[0] for x in _CAPTURE.split(", ")]
    out = [{**{n: h[n] for n in names[:-1]}, "payload": _body(block, h["payload_digest"])} for h in heads]
    return pa.Table.from_pylist(out, pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in names]))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """record_id, kind, uri, page_id, payload_digest, refers_to and payload of every capture under ``path``."""
    read = lambda segments, schema: (lambda a, b: a.union(b))(*[modest_batches(p).mapInArrow(_read(segments), schema) for p in _pieces(spark, path)])
    joined = read(True, _RECORD).groupBy("origin").applyInArrow(_joined, _CAPTURE)
    return read(False, _CAPTURE).union(joined)


def resolved(found: DataFrame) -> DataFrame:
    """Captures with ``payload_bytes`` and the page that a revisit refers to; a revisit's length is that of the response."""
    narrow = found.withColumn("payload_bytes", F.length("payload").cast("long")).drop("payload")
    narrow = written(narrow, "warc-captures")
    # Partial maxima first: a response that is there twice is one.
    target = narrow.where("kind = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("of_bytes"), F.max("page_id").alias("of_page"), F.max("payload_digest").alias("of_digest"))
    again = narrow.where("kind = 'revisit'").join(target, "refers_to", "left")
    same = F.col("payload_digest") == F.col("of_digest")
    again = again.withColumns({"payload_bytes": F.when(same, F.col("of_bytes")), "of_page": F.when(same, F.col("of_page"))})
    columns = ["page_id", "uri", "kind", "payload_bytes", "payload_digest", "of_page"]
    return narrow.where("kind = 'response'").withColumn("of_page", F.lit(None).cast("string")).select(*columns).unionByName(again.select(*columns))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), table_path(spark, "warc"))
    out = resolved(captures(spark, path))
    dropped(spark.read.text(path))  # what is left to read is the table of captures
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("of_page").cast("long").alias("refers_to"))


ORACLE_SQL = {
    "op11_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, t, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: '{BASE32}'[1 + ((('0x' || x[5 * (i // 4) + 1:5 * (i // 4) + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER]), '') AS payload_digest,
       CASE WHEN payload_bytes < {MIN_BYTES} OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id <> first THEN first END AS refers_to FROM h
"""
}
QUERIES = {"op11_warc": op11_warc}
