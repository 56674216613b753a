"""A content-addressed WARC archive.

Payloads with equal bytes (by SHA-256 and length) are stored once, in the
response record of the smallest page_id; the others become revisit records
that name it. Each task writes one gzip member a record into its own archive
file in the shared folder. The exact header of every record is also kept apart
in a Parquet index. Reading parses the archives, checks every stored payload
against its digest, and gives revisits their payload through a join.

Payloads are never moved by their digest, so a payload that a third of all
pages share makes no hot partition: what is grouped and joined by digest are
rows of a few bytes, and pages meet their verdict by page_id.

Edge cases: null html is an empty payload. Payloads below ``min_bytes`` are
always stored. Rows that repeat both page_id and payload: the first is the
response, the others revisit it under the same page_id. Rows without page_id
are stored in full. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm import words as W
from waypost.llm.shared import beside, file_system, parts, put_file, scratch, stored

_DATE = "2000-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_INDEX = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
        ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("header", pa.binary())
    ]
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _record_id(page_id: int | None, extra: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{extra}')}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = ((k, str(v).replace("\r", "%0D").replace("\n", "%0A")) for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in clean) + b"\r\n"


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        rows: list[tuple] = []

        def members() -> Iterator[bytes]:
            at, last, again = 0, None, 0
            for batch in batches:
                for page_id, url, html, first_id in zip(
                    *(W.column(batch, c).to_pylist() for c in ("page_id", "url", "html", "first_id")), strict=True
                ):
                    payload = html.encode() if isinstance(html, str) else html or b""
                    own = (page_id, hashlib.sha256(payload).digest())
                    again = again + 1 if own == last else 0
                    last = own
                    revisit = first_id is not None and (first_id != page_id or again > 0)
                    block = _HTTP if revisit else _HTTP + payload
                    digest = base32(hashlib.sha1(payload).digest())
                    name = _record_id(page_id, f"{own[1].hex()}:{again}" if page_id is not None else f"{path}:{at}")
                    fields = [
                        ("WARC-Type", "revisit" if revisit else "response"),
                        ("WARC-Record-ID", name),
                        ("WARC-Date", _DATE),
                        ("WARC-Target-URI", url),
                        ("X-Page-ID", page_id),
                        ("WARC-Payload-Digest", f"sha1:{digest}"),
                        ("X-Payload-SHA256", own[1].hex()),
                        ("WARC-Refers-To", _record_id(first_id, f"{own[1].hex()}:0") if revisit else None),
                        ("X-Refers-To-Page-ID", first_id if revisit else None),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
                        ("Content-Type", "application/http; msgtype=response"),
                        ("Content-Length", len(block)),
                    ]
                    head = _header(fields)
                    member = gzip.compress(head + block + b"\r\n\r\n", 3, mtime=0)
                    rows.append(
                        (path, at, len(member), name, "revisit" if revisit else "response", page_id, digest, head)
                    )
                    at += len(member)
                    yield member

        started = members()
        first = next(started, None)
        if first is None:
            return

        def every() -> Iterator[bytes]:
            yield first
            yield from started

        put_file(path, every())
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows[at : at + 4096], strict=True), _INDEX.types, strict=True)],
                schema=_INDEX
            )

    return run


def write_archive(pages: DataFrame, root: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``root``; returns the index of exact headers, stored there too."""
    given, root = root, root or scratch(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    digest = F.concat_ws(":", F.sha2("html", 256), F.octet_length("html"))
    marked = rows.filter("page_id is not null").filter(
        F.octet_length("html") >= min_bytes
    ).select("page_id", digest.alias("digest"))
    repeated = stored(
        marked.groupBy("digest").agg(
            F.min("page_id").alias("first_id"), F.count("*").alias("n")
        ).filter("n > 1").drop("n"),
        "repeated"
    )
    verdicts = marked.join(repeated, "digest").distinct().withColumn("url", F.lit(None).cast("string"))
    # one key and one exchange: equal records meet in a task, and the join finds its pages where they are
    key = F.concat_ws(
        ":", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none"), F.xxhash64("url").cast("string"))),
        "digest"
    )
    told = rows.withColumn("digest", digest).withColumn("key", key).repartition(parts(pages.sparkSession), "key")
    told = told.join(
        verdicts.select(key.alias("key"), "first_id"), "key", "left"
    ).sortWithinPartitions("page_id", "digest", "url")
    written = told.select("page_id", "url", "html", "first_id").mapInArrow(
        _write(root),
        "path string, offset long, length long, record_id string, record_type string, page_id long, payload_digest string, header binary"
    )
    return beside(written, given, "index")


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, exact header, block) of each record of an open gzip archive, one member at a time."""
    rest = b""
    while True:
        one, text = zlib.decompressobj(31), []
        while not one.eof:
            chunk = rest or stream.read(1 << 20)
            rest = b""
            if not chunk:
                if text:
                    raise ValueError("the archive ends within a record")
                return
            text.append(one.decompress(chunk))
        rest = one.unused_data
        raw = b"".join(text)
        head, _, tail = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = tail[: int(fields["Content-Length"])]
        if tail[len(block) :] != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong length")
        yield fields, head + b"\r\n\r\n", block


_READ = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_record string, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows):
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _READ.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
        )

    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for path in W.column(batch, "path").to_pylist():
            files, inner = file_system(path)
            rows, size = [], 0
            with files.open_input_stream(inner, compression=None) as stream:
                for fields, _, block in records(stream):
                    kind, payload = fields["WARC-Type"], None
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != fields["X-Payload-SHA256"] or base32(
                            hashlib.sha1(payload).digest()
                        ) != digest:
                            raise ValueError(f"record {fields['WARC-Record-ID']} doesn't have its digest")
                    rows.append(
                        (
                            fields["WARC-Record-ID"], kind, number(fields.get("X-Page-ID")),
                            fields.get("WARC-Target-URI"), digest, fields.get("WARC-Refers-To"),
                            number(fields.get("X-Refers-To-Page-ID")), payload
                        )
                    )
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_archive(index: DataFrame) -> DataFrame:
    """The records of the archives that ``index`` names; a revisit's payload is null."""
    paths = index.select("path").distinct()
    return paths.repartitionByRange(parts(index.sparkSession), "path").mapInArrow(_read, _READ)


def summaries(index: DataFrame) -> DataFrame:
    """Per record, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's length is that of the payload it refers to, found by record.
    """
    found = stored(
        read_archive(index).select(
            "record_id", "record_type", "page_id", "payload_digest", "refers_to_record", "refers_to",
            F.octet_length("payload").cast("long").alias("n")
        ),
        "records"
    )
    kept = found.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("n").alias("m"), F.col("payload_digest").alias("d")
    )
    full = found.filter("record_type = 'response'").select(
        "page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
    again = found.filter("record_type = 'revisit'").join(kept, "refers_to_record", "left")
    return full.unionByName(
        again.select(
            "page_id", F.col("m").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to"
        )
    )


def reconstructed(index: DataFrame) -> DataFrame:
    """page_id, url and payload of every record, revisits filled through a join."""
    found = read_archive(index)
    kept = found.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("payload").alias("p")
    )
    full = found.filter("record_type = 'response'").select("page_id", "url", "payload")
    again = found.filter("record_type = 'revisit'").join(kept, "refers_to_record", "left")
    return full.unionByName(again.select("page_id", "url", F.col("p").alias("payload")))
