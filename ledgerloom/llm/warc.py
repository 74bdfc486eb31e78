"""Web archives whose records are compressed one by one with a dictionary made from them.

Every task turns its rows into WARC records and writes an archive whenever it has enough of them: a Zstandard dictionary
is trained on pieces spread evenly over the records of that archive and put before them in a skippable frame, then each
record is a frame of its own.  So an archive can be read alone, from its start or at any record, and a
record costs little more than in one long stream.  Beside the archives stands an index of the records and their places.

Of records with equal payloads (by SHA-256) of ``LEAST_SHARED`` bytes or more, that of the smallest key is a response
and the others are revisits: they carry the digest, the length and the name of the response, but no payload.

An archive's name is new with every attempt of a task, and only archives of attempts that Spark counts are in
the index; what a lost executor leaves behind is never read.

Defined cases: a null payload is the empty one; a null or empty address becomes ``urn:page:`` and the key; rows repeated
under the smallest key are all responses, those without a key refer to a key if there is one; an empty table gives
an empty index.  Keys are kept in their type, other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO, NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.lookups import lookup

LEAST_SHARED = 100  # bytes of a payload that a revisit may stand for

ARCHIVE_BYTES = 32 << 20  # records of an archive, before they are compressed
DICTIONARY_BYTES = 64 << 10  # and a twentieth of the records at most
SAMPLES = 100  # dictionaries' worth of pieces that one is trained on
PIECE_BYTES = 4 << 10
READ_BYTES = 64 << 10
LEVEL = 6

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE, BLANK = b"\r\n", b"\r\n\r\n"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


class Page(NamedTuple):
    key: str | None
    url: str | None
    payload: bytes | None
    n_bytes: int
    digest: str
    refers_to: str | None


def _no_address(key: str | None) -> str:
    return f"urn:page:{quote(key or '', safe='')}"


def _address(page: Page) -> list[tuple[str, str]]:
    """The address as a record may carry it and, where that is another text, as it was."""
    if page.url is None:
        return [("WARC-Target-URI", _no_address(page.key))]
    plain = quote(page.url, safe="!#$%&'()*+,/:;=?@[]~") or _no_address(page.key)
    same = plain == page.url and plain != _no_address(page.key)
    return [("WARC-Target-URI", plain), *([] if same else [("X-Page-URL", quote(page.url, safe=""))])]


def record_id(key: str, digest: str) -> str:
    """The name of a response: the same for the same key and payload."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{quote(key)}:{digest}').urn}>"


def to_record(page: Page, date: str) -> bytes:
    """One response or revisit record."""
    named = page.refers_to is None and page.key is not None
    fields = [
        ("WARC-Type", "response" if page.refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page.key, page.digest) if named else f"<{uuid.uuid4().urn}>"),
        ("WARC-Date", date),
        *_address(page),
        ("WARC-Payload-Digest", f"sha256:{page.digest}"),
    ]
    if page.key is not None:
        fields.append(("X-Page-Key", quote(page.key, safe="")))
    if page.refers_to is not None:
        fields += [
            ("WARC-Profile", SAME_PAYLOAD),
            ("WARC-Refers-To", record_id(page.refers_to, page.digest)),
            ("X-Refers-To-Page-Key", quote(page.refers_to, safe="")),
        ]
    # A revisit keeps the head of its answer, and so the length of the payload.
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page.n_bytes}\r\n\r\n".encode()
    block = head + (page.payload or b"") if page.refers_to is None else head
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"".join([VERSION, LINE, *(f"{k}: {v}\r\n".encode() for k, v in fields), LINE, block, BLANK])


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def of_record(record: bytes) -> Page | None:
    """The page of a record, None if it is neither response nor revisit.  A payload that is not that of its digest is an error."""
    if not record.startswith(VERSION + LINE):
        raise ValueError("not a record")
    end = record.index(BLANK)
    fields = _fields(record[:end])
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    begin, n = end + len(BLANK), int(fields["content-length"])
    block = record[begin : begin + n]
    if len(block) < n or record[begin + n :] != BLANK:
        raise ValueError("a record is cut short")
    head_end = block.index(BLANK)
    n_bytes = int(_fields(block[:head_end])["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    payload = None
    if fields["warc-type"] == "response":
        payload = block[head_end + len(BLANK) :]
        if len(payload) != n_bytes or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} is not the one written")
    names = (fields.get("x-page-key"), fields.get("x-refers-to-page-key"))
    key, refers_to = (None if k is None else unquote(k) for k in names)
    url = unquote(fields["x-page-url"]) if "x-page-url" in fields else fields["warc-target-uri"]
    if "x-page-url" not in fields and url == _no_address(key):
        url = None
    return Page(key, url, payload, n_bytes, digest, refers_to)


def train(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from pieces of all records, evenly spread; None where there is too little to learn from."""
    total = sum(map(len, records))
    size = min(size, total // 20)
    every = max(1, -(-total // (SAMPLES * max(1, size))))
    pieces = [r[i : i + PIECE_BYTES] for r in records for i in range(0, len(r), PIECE_BYTES)][::every]
    try:
        return zstandard.train_dictionary(size, pieces, k=512, d=8, f=20, accel=1, level=LEVEL)
    except zstandard.ZstdError:
        return None


def write_archive(out: BinaryIO, records: list[bytes]) -> list[tuple[int, int]]:
    """Write an archive and return where each record's frame starts and how long it is."""
    dictionary = train(records)
    at, places = 0, []
    if dictionary is not None:
        raw = dictionary.as_bytes()
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        at += 8 + len(raw)
        dictionary.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    for record in records:
        frame = compressor.compress(record)
        out.write(frame)
        places.append((at, len(frame)))
        at += len(frame)
    return places


def _dictionary(stream: BinaryIO) -> tuple[zstandard.ZstdCompressionDict | None, bytes]:
    """The leading dictionary of an archive, and what was read beyond it."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICTIONARY_FRAME:
        return None, head
    raw = stream.read(struct.unpack("<II", head)[1])
    if raw.startswith(zstandard.FRAME_HEADER):  # others may compress it
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), b""


def read_archive(stream: BinaryIO) -> Iterator[bytes]:
    """The records of an archive one by one."""
    dictionary, left = _dictionary(stream)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while left := left or stream.read(READ_BYTES):
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(left))
            if frame.eof:
                left = frame.unused_data
                break
            if not (left := stream.read(READ_BYTES)):
                raise ValueError("an archive ends inside a record")
        yield b"".join(parts)


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``key, url, payload, n_bytes, digest, refers_to`` of every row; the payload of a revisit is left out."""
    body = F.coalesce(F.col(payload), F.lit(""))
    read = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("digest")
    )
    # Only payloads that occur twice; a payload of many rows is summed up before the shuffle.
    shared = read.where(F.col("n_bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("key").alias("_first"), F.count(F.lit(1)).alias("_n"))
    joined = lookup(read, shared.where("_n > 1 and _first is not null").select("digest", "_first"), ["digest"])
    refers_to = F.when(F.col("key").isNull() | (F.col("key") > F.col("_first")), F.col("_first"))
    return joined.withColumn("refers_to", refers_to).select(
        "key", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "n_bytes", "digest", "refers_to"
    )


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES, date: str | None = None
) -> None:
    """Write ``path/archives/*.warc.zst`` and ``path/index``: ``key, record_type, archive, offset, length`` of every record.

    ``path`` is a folder that all executors reach.  ``date`` stands in every record, by default the time of this call.
    """
    moment = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = f"{path}/archives"

    def archived(pages: list[Page], records: list[bytes]) -> pa.RecordBatch:
        store, place = _store(folder)
        store.create_dir(place, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        with store.open_output_stream(f"{place}/{name}", compression=None) as out:
            places = write_archive(out, records)
        rows = [
            {"key": p.key, "record_type": "response" if p.refers_to is None else "revisit", "archive": name, "offset": at, "length": n}
            for p, (at, n) in zip(pages, places, strict=True)
        ]
        kinds = [("key", pa.string()), ("record_type", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, records, size = [], [], 0
        for batch in batches:
            columns = [batch.column(c) for c in Page._fields]
            for i in range(batch.num_rows):
                k, u, body, n, digest, refers_to = (c[i] for c in columns)
                raw = body.as_buffer().to_pybytes() if body.is_valid else None
                page = Page(k.as_py(), u.as_py(), raw, n.as_py(), digest.as_py(), refers_to.as_py())
                records.append(to_record(page, moment))
                held.append(page._replace(payload=None))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield archived(held, records)
                    held, records, size = [], [], 0
        if records:
            yield archived(held, records)

    rows = with_revisits(pages, key, url, payload)
    as_text = rows.withColumns({c: F.col(c).cast("string") for c in ("key", "refers_to")})
    index = as_text.mapInArrow(write, "key string, record_type string, archive string, offset long, length long")
    index.withColumn("key", F.col("key").cast(rows.schema["key"].dataType)).write.parquet(f"{path}/index")


RECORDS = "key string, url string, record_type string, refers_to string, n_bytes long, digest string, payload binary"


def _record_batch(pages: list[Page], payloads: bool) -> pa.RecordBatch:
    bodies = [p.payload if payloads else None for p in pages]
    kinds = ["response" if p.refers_to is None else "revisit" for p in pages]
    strings = {"key": [p.key for p in pages], "url": [p.url for p in pages], "record_type": kinds, "refers_to": [p.refers_to for p in pages]}
    columns = {c: pa.array(v, pa.string()) for c, v in strings.items()}
    columns |= {"n_bytes": pa.array([p.n_bytes for p in pages], pa.int64()), "digest": pa.array([p.digest for p in pages], pa.string())}
    return pa.RecordBatch.from_pydict(columns | {"payload": pa.array(bodies, pa.binary())})


def _typed(records: DataFrame, index: DataFrame) -> DataFrame:
    kind = index.schema["key"].dataType
    return records.withColumns({c: F.col(c).cast(kind) for c in ("key", "refers_to")})


BATCH_BYTES = 4 << 20


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records as the archives hold them, each archive read by one task: ``key, url, record_type, refers_to, n_bytes,
    digest, payload``.  Payloads are checked against their digests, and null in revisits or if they are not asked for."""
    index = spark.read.parquet(f"{path}/index")
    archives = index.select("archive").distinct()
    folder = f"{path}/archives"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{place}/{name}", compression=None) as stream:
                    pages, size = [], 0
                    for record in read_archive(stream):
                        page = of_record(record)
                        if page is not None:
                            pages.append(page if payloads else page._replace(payload=None))
                            size += len(record) if payloads else 1 << 10
                        if size >= BATCH_BYTES:
                            yield _record_batch(pages, payloads)
                            pages, size = [], 0
                    yield _record_batch(pages, payloads)

    dealt = archives.repartition(max(1, archives.count()))
    return _typed(dealt.mapInArrow(read, RECORDS), index)


def fetch(keys: DataFrame, path: str, key: str = "page_id") -> DataFrame:
    """The records of the asked-for keys, as ``read_records`` has them; of an archive only its dictionary and the asked-for frames are read."""
    spark = keys.sparkSession
    index = spark.read.parquet(f"{path}/index")
    folder = f"{path}/archives"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(folder)
        opened, stream, decompressor = None, None, None
        for batch in batches:
            for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if name != opened:
                    stream = store.open_input_file(f"{place}/{name}")
                    opened, decompressor = name, zstandard.ZstdDecompressor(dict_data=_dictionary(stream)[0])
                stream.seek(at)
                yield _record_batch([of_record(decompressor.decompress(stream.read(n)))], True)

    asked = lookup(index, keys.select(F.col(key).alias("key")).distinct(), ["key"], "left_semi")
    dealt = asked.select("archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset")
    return _typed(dealt.mapInArrow(read, RECORDS), index)


def restored(spark: SparkSession, path: str) -> DataFrame:
    """``key, url, payload`` of every row that was written, revisits with the payload of what they refer to."""
    records = read_records(spark, path)
    responses = records.where("record_type = 'response'")
    bodies = responses.where(F.col("n_bytes") >= LEAST_SHARED).select(F.col("key").alias("refers_to"), "digest", "payload")
    revisits = records.where("record_type = 'revisit'").drop("payload")
    again = lookup(revisits, bodies.dropDuplicates(["refers_to", "digest"]), ["refers_to", "digest"], "inner")
    return responses.unionByName(again).select("key", "url", F.decode("payload", "UTF-8").alias("payload"))
