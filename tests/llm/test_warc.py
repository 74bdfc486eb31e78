from __future__ import annotations

import hashlib
import io
import random
import struct
import uuid

import pytest
import zstandard

from ledgerloom.llm import warc
from ledgerloom.session import checkpoint_dir

from .conftest import prose

SCHEMA = "page_id long, url string, html string, key string, digest string, refers_to long, archive string"


def rows() -> list[tuple]:
    rng = random.Random(8)
    page = "<html><head><title>" + prose(rng, 20) + "</title></head><body>" + prose(rng, 60) + "</body></html>"
    bodies = [None, "", "short", "short", page, page, page, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 50, "é" * 50, "\r\n\r\nWARC/1.1\r\n" * 9]
    bodies += ["<html><head><title>" + prose(rng, 5) + "</title></head><body>" + prose(rng, 70) + "</body></html>" for _ in range(120)]
    bodies += [prose(rng, 200_000), "z" * 3_000_000]
    urls = ["http://a.example/x?y=%20&z=1", None, "", "http://b.example/ä ö\r\nWARC-Type: revisit", "urn:page:19"]
    out = [(i, urls[i % len(urls)], b, "?", "?", 0, "?") for i, b in enumerate(bodies)]
    out += [(300 - i, *r[1:]) for i, r in enumerate(out) if i % 9 == 0]  # copies under other keys
    out += [out[4], out[50], (None, *out[5][1:]), (None, None, "alone " * 30, *out[5][3:])]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def written(spark, pages):
    path = f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archives(pages, path, archive_bytes=100_000)
    return path


def expected(pages: list[tuple]) -> list[tuple]:
    least: dict[str, int] = {}
    for key, _, html, *_ in pages:
        if key is not None:
            least[html or ""] = min(key, least.get(html or "", key))
    out = []
    for key, url, html, *_ in pages:
        body = (html or "").encode()
        first = least.get(html or "") if len(body) >= 100 else None
        revisit = first is not None and (key is None or key > first)
        out.append((key, url, "revisit" if revisit else "response", first if revisit else None, len(body), hashlib.sha256(body).hexdigest(), None if revisit else body))
    return out


def plain(found) -> list[str]:
    return sorted(str((*r[:6], None if r[6] is None else bytes(r[6]))) for r in map(tuple, found))


def test_records_are_as_written(spark, written):
    assert plain(warc.read_records(spark, written).collect()) == plain(expected(rows()))


def test_revisits_get_their_payload_back(spark, written):
    found = [tuple(r) for r in warc.restored(spark, written).collect()]
    assert sorted(map(str, found)) == sorted(str((k, u, h or "")) for k, u, h, *_ in rows())


def test_single_records_by_key(spark, written):
    wanted = [0, 5, 40, 299, 12_345]
    found = warc.fetch(spark.createDataFrame([(k,) for k in wanted], "page_id long"), written)
    assert plain(found.collect()) == plain(r for r in expected(rows()) if r[0] in wanted)


def test_archives_start_with_their_dictionary(spark, written):
    index = spark.read.parquet(f"{written}/index").cache()
    assert index.count() == len(rows())
    store, folder = warc._store(f"{written}/archives")
    names = {r.archive for r in index.collect()}
    assert len(names) >= 3
    for name in names:
        raw = store.open_input_file(f"{folder}/{name}").read()
        magic, n = struct.unpack("<II", raw[:8])
        if magic != 0x184D2A5D:  # too few records to learn from
            assert sum(r.archive == name for r in index.collect()) < 8
            continue
        dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + n])
        assert dictionary.dict_id()
        ends = 8 + n
        for r in sorted((r for r in index.collect() if r.archive == name), key=lambda r: r.offset):
            frame = raw[r.offset : r.offset + r.length]
            assert r.offset == ends and zstandard.get_frame_parameters(frame).dict_id == dictionary.dict_id()
            assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frame).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
            ends += r.length
        assert ends == len(raw)


def test_the_dictionary_saves_space():
    rng = random.Random(9)
    records = [warc.to_record(warc.Page(str(i), f"http://example.org/{i}", prose(rng, 80).encode(), 0, "d", None), "2000-01-01T00:00:00Z") for i in range(600)]
    out = io.BytesIO()
    warc.write_archive(out, records)
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert len(out.getvalue()) < 0.85 * alone
    out.seek(0)
    assert list(warc.read_archive(out)) == records


def test_damage_is_an_error():
    page = warc.Page("1", "http://example.org", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), None)
    record = warc.to_record(page, "2000-01-01T00:00:00Z")
    assert warc.of_record(record) == page
    with pytest.raises(ValueError, match="not the one written"):
        warc.of_record(record.replace(b"payload\r\n", b"paxload\r\n"))
    with pytest.raises(ValueError, match="cut short"):
        warc.of_record(record[:-6])
    out = io.BytesIO()
    warc.write_archive(out, [record] * 3)
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.read_archive(io.BytesIO(out.getvalue()[:-5])))


def test_text_keys_and_empty_tables(spark, pages):
    path = f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    named = [("b\r\nc: d", None, "t" * 200), ("ä", "u", "t" * 200), (None, "v", "t" * 200)]
    warc.write_archives(spark.createDataFrame(named, "page_id string, url string, html string"), path)
    found = {r.url: r for r in warc.read_records(spark, path, payloads=False).collect()}
    assert found[None].key == "b\r\nc: d" and found["u"].refers_to == found["v"].refers_to == "b\r\nc: d" and found[None].payload is None
    empty = f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_records(spark, empty).collect() == [] and warc.restored(spark, empty).count() == 0
