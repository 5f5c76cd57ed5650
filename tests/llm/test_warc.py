import gzip
import hashlib
import io

import pytest

from specaudit.llm import warc as W
from specaudit.session import new_folder

LONG = "x" * 3_500_000 + "é"
PAGES = [
    (3, "u", "a" * 150), (1, "u", "a" * 150), (1, "u", "a" * 150), (2, None, "short"), (7, "v", "short"), (4, "u", None), (None, "u", "a" * 150),
    (5, "b", LONG), (6, "e\r\nf", ""), (None, None, None), (8, "w", "b" * 99), (9, "w", "b" * 99), (10, "w", "c" * 100), (11, "w", "c" * 100),
]


def pages(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit("x").alias("row_key"), F.lit(1).alias("digest"), F.lit(1).alias("chunk"))


def expected(rows):
    out, groups = [], {}
    for page, _, html in rows:
        payload = (html or "").encode()
        groups.setdefault(payload, []).append(page)
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, x or 0))
        for k, page in enumerate(ids):
            again = len(payload) >= 100 and k > 0
            out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None, True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [W.FILE_BYTES, 200])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(W, "FILE_BYTES", size)
    files = W.write_archives(pages(spark, PAGES), new_folder(spark, "warc"))
    facts = W.payload_facts(W.read_chunks(files)).drop("n_chunks").collect()
    assert sorted((tuple(r) for r in facts), key=repr) == expected(PAGES)
    assert sum(r.records for r in files.collect()) == len(PAGES)
    assert (files.count() > 1) == (size == 200)


def test_long_payloads_come_in_chunks_with_running_digests(spark):
    files = W.write_archives(pages(spark, PAGES), new_folder(spark, "warc"))
    rows = W.read_chunks(files, chunk=1 << 20).where("page_id = 5").orderBy("chunk").collect()
    assert [r.n_bytes for r in rows] == [1 << 20] * 3 + [len(LONG.encode()) - 3 * (1 << 20)]
    digest, data = hashlib.sha256(), b""
    for r in rows:
        data += bytes(r.payload)
        digest.update(bytes(r.payload))
        assert r.digest == digest.hexdigest()
    assert data == LONG.encode()


def test_damaged_payloads_are_not_verified(spark):
    writer = W._Writer(new_folder(spark, "warc").removeprefix("file:"))
    headers = {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "WARC-Page-ID": "1", "WARC-Target-URI": "", "WARC-Payload-Length": "4"}
    writer.write(headers | {"WARC-Payload-Digest": f"sha256:{hashlib.sha256(b'good').hexdigest()}"}, b"evil")
    files = spark.createDataFrame([(writer.close(),)], "file string")
    assert [r.verified for r in W.payload_facts(W.read_chunks(files)).collect()] == [False]


def test_no_pages(spark):
    files = W.write_archives(pages(spark, []), new_folder(spark, "warc"))
    assert files.collect() == [] and W.payload_facts(W.read_chunks(files)).collect() == []


def test_reader_follows_records_across_pieces():
    raw = b"".join(gzip.compress(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n".encode() + b"z" * n + b"\r\n\r\n") for n in (0, 1, 70_000, 5))
    got = [(h["Content-Length"], sum(len(d) for d, _ in body)) for h, body in W._records(io.BytesIO(raw), 1000)]
    assert got == [("0", 0), ("1", 1), ("70000", 70_000), ("5", 5)]
