"""WARC archives of captures: writing, reading, and assembly of transactions.

A capture is a request, a response (or, for a payload that another capture holds, a revisit) and a
metadata record, tied by WARC-Concurrent-To. Every record is a gzip member of its own. Spark's text
writer puts the members down byte by byte in any store that Spark writes to, with an empty member as
the line separator, so the files are ordinary .warc.gz archives. The same separator cuts an archive of any size into
splits again, so reading takes a capture's members at a time. Records are walked by their Content-Length and joined
through their identifiers into one nested row a capture.

Which payloads are revisits is decided on digests alone. Up to FEW_REVISITS of them are named in a broadcast, so that
no payload is moved for it; more meet theirs by a shuffle.

Cases: null html is an empty payload, a null url an empty target; null page ids are written as such and rank after all
others when a response is chosen; rows equal in page_id, url and html are one capture; pages of any length are one
record; no rows give archives without records; other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import attach, batch_of, new_path, settled, ship, staged

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits that are broadcast, at some 200 bytes each.
FEW_REVISITS = 200_000
#: A gzip member of nothing; every byte of it is one ISO-8859-1 character.
_EMPTY = bytes.fromhex("1f8b08000000000000030300") + bytes(8)
_RECORD = "type string, record_id string, concurrent_to string, refers_to string, target string, payload_digest string, payload_bytes long, page_id long, payload binary"


def payload_digest(data: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = b"\r\n".join(f"{k}: {v}".encode() for k, v in [*head, ("Content-Length", str(len(block)))])
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(VERSION + b"\r\n" + lines + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def _capture(page: int | None, url: str, html: bytes, keep: int | None, kept_key: str) -> bytes:
    """The members of one capture."""
    digest = payload_digest(html)
    key = f"urn:capture:{'' if page is None else page}:{digest}:{hashlib.sha1(url.encode(), usedforsecurity=False).hexdigest()[:16]}"
    uri = url.replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    own = [("WARC-Record-ID", f"<{key}:response>"), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    tied = [("WARC-Concurrent-To", f"<{key}:response>"), ("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    if keep is None and kept_key == "":
        main = _member([("WARC-Type", "response"), *own], http + html)
    else:
        main = _member([("WARC-Type", "revisit"), *own, ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{kept_key}>")], http)
    request = _member([("WARC-Type", "request"), ("WARC-Record-ID", f"<{key}:request>"), *tied, ("Content-Type", "application/http;msgtype=request")], f"GET {uri} HTTP/1.1\r\n\r\n".encode())
    meta = _member([("WARC-Type", "metadata"), ("WARC-Record-ID", f"<{key}:metadata>"), *tied, ("Content-Type", "application/warc-fields")], f"page-id: {'' if page is None else page}\r\n".encode())
    return request + main + meta


def write_archives(pages: DataFrame, path: str, min_shared: int = 0, few: int = FEW_REVISITS) -> None:
    """Write a capture for every row of pages(page_id, url, html).

    Of payloads that are equal and at least min_shared bytes long, the one with the largest page_id is
    the response and the others revisit it.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    keys = staged(rows.select("sha", "page_id", "url", F.octet_length("html").alias("size")), "keys")
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "url")).alias("best")
    grouped = keys.where(F.col("size") >= min_shared).groupBy("sha").agg(best, F.count("*").alias("n")).where("n > 1")
    twin = staged(grouped.select("sha", F.col("best.page_id").alias("keep_id"), F.col("best.url").alias("keep_url"), "n"), "shared")
    # Payloads that only one row has are absent, so most find nothing here and stay where they are.
    met = attach(keys, twin, "sha", "n").where("not (page_id <=> keep_id and url = keep_url)")
    told = met.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("sha").alias("s"), "keep_id", "keep_url", F.lit(True).alias("revisit")).distinct()
    told = staged(told, "revisits")
    named = F.broadcast(told) if told.count() <= few else told.hint("merge")
    same = rows["page_id"].eqNullSafe(told["p"]) & (rows["url"] == told["u"]) & (rows["sha"] == told["s"])
    held = rows.join(named, same, "left").select("page_id", "url", "html", "keep_id", "keep_url", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, url, html, keep, keep_url, revisit in zip(*(b.column(c) for c in ("page_id", "url", "html", "keep_id", "keep_url", "revisit")), strict=True):
                data, kept = html.as_py().encode(), ""
                if revisit.as_py():
                    kept = f"urn:capture:{'' if keep.as_py() is None else keep.as_py()}:{payload_digest(data)}:{hashlib.sha1(keep_url.as_py().encode(), usedforsecurity=False).hexdigest()[:16]}:response"
                out.append(_capture(page.as_py(), url.as_py(), data, keep.as_py(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = held.mapInArrow(settled(run), "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def parse_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records in inflated chunks, by Content-Length."""
    held = bytearray()
    more = iter(stream)

    def fill(n: int) -> bool:
        while len(held) < n:
            chunk = next(more, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while fill(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(held) + 1):
                raise ValueError("an archive ends inside a record's head")
            end = held.find(b"\r\n\r\n")
        lines = bytes(held[:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record begins with {lines[0][:20]!r}")
        head = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(head["content-length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("an archive ends inside a record")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def inflate(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """Chunks of all members of a gzip file."""
    view = memoryview(data)
    while view:
        unzip, at = zlib.decompressobj(31), 0
        while not unzip.eof and at < len(view):
            out = unzip.decompress(view[at : at + step])
            at += step
            if out:
                yield out
        if not unzip.eof:
            raise ValueError("an archive ends inside a member")
        at = min(at, len(view)) - len(unzip.unused_data)
        view = view[at:]


def _record(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, size, digest, page, body = head["warc-type"], None, None, None, None
    if kind in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        digest = head["warc-payload-digest"].partition(":")[2]
        size = int(said[b"content-length"])
        if kind == "response" and (len(body) != size or payload_digest(body) != digest):
            raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
    elif kind == "metadata":
        page = int(v) if (v := block.partition(b":")[2].strip()) else None
    tied, refers = (head.get(name, "").strip("<>") or None for name in ("warc-concurrent-to", "warc-refers-to"))
    payload = body if payloads and kind == "response" else None
    return (kind, head["warc-record-id"].strip("<>"), tied, refers, head.get("warc-target-uri"), digest, size, page, payload)


def read_records(spark: SparkSession, path: str, payloads: bool = True, own: bool = True) -> DataFrame:
    """One row for each record of the archives under path.

    Archives written here (`own`) are read capture by capture, whatever their size. Those of other writers lack the
    separator and are read whole, each of up to 2 GB.
    """
    ship(spark)
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in _RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for content in b.column("content"):
                for head, block in parse_records(inflate(content.as_py())):
                    rows.append(_record(head, block, payloads))
                    held += len(block) if payloads else 200
                    if held > 4 << 20:
                        yield batch_of(rows, schema)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows, schema)

    if own:
        # The text reader hands on bytes as they are.
        lines = spark.read.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
        content = lines.select(F.col("value").cast("binary").alias("content"))
    else:
        content = spark.read.format("binaryFile").load(path).select("content")
    return content.mapInArrow(settled(run), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: request, response or revisit, and metadata, joined through WARC-Concurrent-To."""
    fields = ("record_id", "type", "refers_to", "target", "payload_digest", "payload_bytes", "payload")
    main = records.where("type in ('response', 'revisit')").select(F.col("record_id").alias("key"), F.struct(*fields).alias("response"))
    tied = records.where("type in ('request', 'metadata')").groupBy(F.col("concurrent_to").alias("key")).agg(
        F.first(F.expr("if(type = 'request', struct(record_id, target), null)"), ignorenulls=True).alias("request"),
        F.first(F.expr("if(type = 'metadata', struct(record_id, page_id), null)"), ignorenulls=True).alias("metadata"),
    )
    return main.dropDuplicates(["key"]).join(tied, "key", "left").select("response", "request", "metadata")


def captures(pages: DataFrame, payloads: bool = False, few: int = FEW_REVISITS) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every capture, from archives written and read again."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, few=few)
    nested = assemble(read_records(spark, path, payloads))
    refers = F.nullif(F.split_part("response.refers_to", F.lit(":"), F.lit(3)), F.lit(""))
    more = [F.col("response.payload").alias("payload")] if payloads else []
    told = ["response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), refers.cast("long").alias("refers_to")]
    return nested.select(F.col("metadata.page_id").alias("page_id"), *told, F.col("request.target").alias("url"), *more)
