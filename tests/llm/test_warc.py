"""Web archives: written, normalised and read back, held against plain Python and Python's own gzip module."""

import base64
import gzip
import hashlib
import io
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hyperclause.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(rows, least=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        ids = [x for x in groups[body] if x is not None]
        to = max(ids) if ids and len(body) >= least else i
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, *(("response", None) if i == to else ("revisit", to))))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def pages():
    r = random.Random(2)
    bodies = ["", None, "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>", "x" * 3_000_000, "\x00\x01", *[f"<p>{k}</p>" for k in range(30)]]
    return [(k, f"http://a/{k}\r\nWARC-Type: request", r.choice(bodies)) for k in range(200)] + [(7, None, "twice"), (7, None, "twice"), (None, "u", "twice"), (None, "u", "alone")]


@pytest.mark.parametrize("least", [0, 10])
def test_archives_give_the_pages_back(spark, tmp_path, least):
    rows = pages()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", value int, Size int").repartition(5)  # extra columns with clashing names
    assert got(warc.archived(df, f"{tmp_path}/a", least)) == plain(rows, least)


def test_every_record_is_a_member_at_its_offset(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    warc.write(df, f"file:{tmp_path}/streams")
    streams = [f for f in os.listdir(f"{tmp_path}/streams") if f.endswith(".gz")]
    for f in streams:  # one member from end to end
        engine = zlib.decompressobj(31)
        assert engine.decompress(open(f"{tmp_path}/streams/{f}", "rb").read()).startswith(b"WARC/1.1\r\n") and engine.eof and not engine.unused_data
    assert warc.normalise(spark, f"file:{tmp_path}/streams", f"file:{tmp_path}/archives") == len(rows)
    once = {f: open(f"{tmp_path}/archives/{f}", "rb").read() for f in os.listdir(f"{tmp_path}/archives")}
    assert sorted(f[:-4] for f in once if f.endswith(".cdx")) == sorted(f for f in once if f.endswith(".gz")) and len(once) == 2 * len(streams)
    assert sorted(b"".join(gzip.decompress(b) for f, b in once.items() if f.endswith(".gz"))) == sorted(b"".join(gzip.decompress(open(f"{tmp_path}/streams/{f}", "rb").read()) for f in streams))
    places = warc.index(spark, str(tmp_path / "archives")).collect()
    assert len(places) == len(rows)
    for p in places:
        member = gzip.decompress(once[p.archive][p.offset : p.offset + p.length]).decode()
        assert member.startswith("WARC/1.1\r\n") and member.endswith("\r\n\r\n") and f"WARC-Record-ID: {p.record_id}\r\n" in member
    warc.normalise(spark, str(tmp_path / "streams"), str(tmp_path / "archives"))  # again: the same files
    assert {f: open(f"{tmp_path}/archives/{f}", "rb").read() for f in os.listdir(f"{tmp_path}/archives")} == once
    texts = warc.read(spark, str(tmp_path / "archives"), payloads=True).where("record_type = 'response'")
    whole = {(i, digest) for i, _, digest, kind, _ in plain(rows) if kind == "response"}
    found = texts.select(warc.page(F.col("record_id"), "long"), "payload").collect()
    assert {(i, base64.b32encode(hashlib.sha1(bytes(body)).digest()).decode()) for i, body in found} == whole


def test_streams_that_are_cut_off_or_no_archives(tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for name, data, problem in [("cut", gzip.compress(record * 50)[:-12], EOFError), ("short", gzip.compress(record[:-8]), EOFError), ("other", gzip.compress(b"hello\r\n\r\n"), ValueError), ("endless", gzip.compress(b"WARC/1.1\r\n" + b"a" * 3_000_000), ValueError)]:
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
        with pytest.raises(problem):
            warc.rewrite(str(tmp_path / f"{name}.warc.gz"), str(tmp_path))
    assert not (tmp_path / "x.warc.gz").exists()
    several = gzip.compress(record) + gzip.compress(record * 2) + b"\0" * 9  # many members, and padding
    (tmp_path / "several.gz").write_bytes(several)
    (tmp_path / "out").mkdir()
    assert warc.rewrite(str(tmp_path / "several.gz"), str(tmp_path / "out"))[1] == 3
    assert b"".join(warc.inflated(io.BytesIO(gzip.compress(b"a" * 9_000_000)))) == b"a" * 9_000_000


def test_empty_table(spark, tmp_path):
    assert got(warc.archived(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e")) == []
