"""Web archives: pages written as WARC records, whole-file gzip streams made into archives of one gzip member a record with an index
of offsets beside them, and records read back by these offsets.

`write` leaves what many crawlers leave: a file is one gzip stream from its first record to its last, so no record can be had
without inflating all before it. `normalise` inflates each file once, as a stream, and writes every record as a gzip member of its
own; beside the archive it writes an index with the offset and length of every member. A file is one task's work, in memory bounded
by a chunk and a header. `read` deals the index out by blocks of an archive and reads each member from its place.

Tasks write under a name of their own and rename the file when it is whole, so a task that is lost and run again leaves the same
archive. Files are opened through Arrow's file systems, so folders may be in remote stores."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read, inflated or written at once.
CHUNK = 1 << 20
#: A header longer than this is an error.
HEADER = 1 << 20
#: Members are read back in blocks of about this many bytes of an archive.
BLOCK = 8 << 20
#: A task reads about so many bytes of archives where there are enough for all cores.
TASK = 64 << 20
#: Records of an archive that Spark writes, at most.
RECORDS = 50_000
END = "\r\n\r\n"
# The profile of records that revisit an equal payload.
REVISITED = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The index: archive, offset and length of the member, type, id, digest of the payload and target, separated by tabs.
INDEX = "archive string, offset long, length long, type string, record_id string, digest string, target string"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if local := re.match(r"(?:file:)?/+(.*)", path):
        return fs.LocalFileSystem(), "/" + local.group(1)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def digest32(payload: Column) -> Column:
    """The SHA-1 of a payload as 32 letters of base32: five hexadecimal digits are four of them."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, page_id: str, url: str, html: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column with a WARC record for every page, without the four bytes that end it.

    Of pages with equal payloads of at least `least` bytes, that with the largest id is a response and the others revisit it;
    smaller payloads are all responses. Payloads are equal if their lengths and SHA-256 are. Null payloads are empty, null targets
    the empty address. A null id is smaller than any other. Rows that share the largest id are all responses."""
    at = lambda c: F.col("`" + c.replace("`", "``") + "`")
    payload = F.coalesce(at(html).cast("string"), F.lit(""))
    rows = pages.select(at(page_id).alias("id"), F.coalesce(at(url).cast("string"), F.lit("about:blank")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha2"))
    groups = rows.where(F.col("size") >= least).groupBy(F.col("size").alias("s"), F.col("sha2").alias("d")).agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("pages")).where("pages > 1").drop("pages")
    found = rows.join(groups, (F.col("size") == F.col("s")) & (F.col("sha2") == F.col("d")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(c.cast("string")), F.lit("")), F.lit(">"))
    again = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    body = F.when(again, http).otherwise(F.concat(http, "payload"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest32(F.col("payload")),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("largest")), F.lit(f"\r\nWARC-Profile: {REVISITED}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"),
    )
    return found.select(F.concat(header, F.lit(END), body).alias("value"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Archives of a new folder, each one gzip stream, by Spark's own writer: what ends a record is what it puts behind lines."""
    records(pages, page_id, url, html, least).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


def inflated(raw) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in chunks; EOFError if it is cut off."""
    engine, begun = zlib.decompressobj(31), False
    while data := raw.read(CHUNK):
        while data:
            out = engine.decompress(data, CHUNK)
            data, begun = engine.unconsumed_tail, True
            if out:
                yield out
            if engine.eof:  # what follows is another member, or padding
                data = engine.unused_data.lstrip(b"\0")
                engine, begun = zlib.decompressobj(31), False
    if begun:
        while out := engine.decompress(b"", CHUNK):
            yield out
        if not engine.eof:
            raise EOFError("a gzip member is cut off")


class Records:
    """The records of a stream of chunks, one after another: the header, and the block in chunks."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        self.held += chunk or b""
        return chunk is not None

    def header(self) -> bytes | None:
        """The next header without the empty line behind it; nothing at the end of the stream."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):  # what ends a record
                del self.held[:1]
            if self.held or not self._more():
                break
        if not self.held:
            return None
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if seen > HEADER or not self._more():
                raise ValueError("a WARC header without an end")
        out = bytes(self.held[:end])
        del self.held[: end + 4]
        if not out.startswith(b"WARC/"):
            raise ValueError(f"no WARC header: {out[:40]!r}")
        return out

    def block(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.held and not self._more():
                raise EOFError("a WARC block is cut off")
            part = bytes(self.held[:length])
            del self.held[: len(part)]
            length -= len(part)
            if part:
                yield part


def fields(header: bytes) -> dict[str, str]:
    """Names in lower case, and values; lines that begin with a blank go on the line before."""
    out, name = {}, None
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def rewrite(source: str, folder: str) -> tuple[str, int, int]:
    """The archive `source` with a gzip member for each record, in `folder`, and its index beside it; name, records and bytes."""
    name = re.sub(r"(\.txt|\.warc)?\.gz$", "", posixpath.basename(source)) + ".warc.gz"
    (from_, path), (to, home) = store(source), store(folder)
    own = f"{home}/_{uuid.uuid4().hex}"  # names that begin with _ are not read
    count = offset = 0
    with from_.open_input_stream(path, compression=None) as raw, to.open_output_stream(f"{own}.gz", compression=None) as out, to.open_output_stream(f"{own}.cdx") as index:
        found = Records(inflated(raw))
        while (header := found.header()) is not None:
            f, engine, length = fields(header), zlib.compressobj(6, zlib.DEFLATED, 31), 0
            for part in chain([header, END.encode()], found.block(int(f["content-length"])), [END.encode()]):
                packed = engine.compress(part)
                length += len(packed)
                out.write(packed)
            packed = engine.flush()
            length += len(packed)
            out.write(packed)
            told = (name, offset, length, f.get("warc-type", ""), f.get("warc-record-id", ""), f.get("warc-payload-digest", ""), f.get("warc-target-uri", ""))
            index.write(("\t".join(quote(str(v), safe=":/<>.?=&-_~") for v in told) + "\n").encode())
            offset, count = offset + length, count + 1
    to.move(f"{own}.cdx", f"{home}/{name}.cdx")
    to.move(f"{own}.gz", f"{home}/{name}")
    return name, count, offset


def normalise(spark: SparkSession, source: str, folder: str) -> int:
    """Rewrites every archive (*.gz) of `source` into `folder`; the number of records. An archive is a task's work."""
    home, path = store(folder)
    home.create_dir(path, recursive=True)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    n = archives.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([rewrite(unquote(p), folder) for p in pdf["path"]], columns=["archive", "records", "bytes"])

    made = archives.repartition(max(1, n)).mapInPandas(run, "archive string, records long, bytes long")
    return made.agg(F.sum("records")).first()[0] or 0


def index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every record of the folder's archives, from the indexes beside them."""
    rows = spark.read.schema(INDEX).option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.cdx").csv(folder)
    return rows.select(*[F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))).alias(c) if c in ("archive", "record_id", "digest", "target") else F.col(c) for c in rows.columns])


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """archive, offset, record_id, record_type, target, payload_bytes, payload_digest and refers_to of every record, each read from
    its place in an archive; payloads: also the payload (null for revisits, whose payload is that of the record they refer to).

    The length and digest are of the full payload: a revisit has them from its headers, other records are counted and hashed, and
    a digest that differs from the one recorded is an error."""
    entries = index(spark, folder).select("archive", "offset", "length")
    size = entries.agg(F.sum("length")).first()[0] or 0
    blocks = entries.groupBy("archive", F.floor(F.col("offset") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members"))
    # By bytes of archives: the index itself is too small for Spark to deal it out by.
    tasks = max(1, min(-(-size // BLOCK), max(-(-size // TASK), spark.sparkContext.defaultParallelism)))
    blocks = blocks.repartition(tasks, "archive", "block")
    schema = "archive string, offset long, record_id string, record_type string, target string, payload_bytes long, payload_digest string, refers_to string, payload binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, home = store(folder)
        for pdf in batches:
            for archive, members in zip(pdf["archive"], pdf["members"]):
                out, size = [], 0
                with where.open_input_file(f"{home}/{archive}") as f:
                    for m in members:
                        f.seek(m["offset"])
                        out.append((archive, m["offset"], *_record(f, m["length"], payloads)))
                        size += len(out[-1][-1] or b"")
                        if size > CHUNK:
                            yield pd.DataFrame(out, columns=names)
                            out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    found = blocks.select("archive", "members").mapInPandas(run, schema)
    return found if payloads else found.drop("payload")


class _Member:
    """The next `length` bytes of a file."""

    def __init__(self, file, length: int) -> None:
        self.file, self.left = file, length

    def read(self, n: int) -> bytes:
        data = self.file.read(min(n, self.left))
        self.left -= len(data)
        return data


def _record(file, length: int, payloads: bool) -> tuple:
    found = Records(inflated(_Member(file, length)))
    f = fields(found.header())
    http, size, sha, kept = bytearray(), 0, hashlib.sha1(), []
    inside = False
    for part in found.block(int(f["content-length"])):
        if not inside:
            http += part
            if (end := http.find(b"\r\n\r\n")) < 0:
                continue
            part, inside = bytes(http[end + 4 :]), True
            del http[end:]
        size += len(part)
        sha.update(part)
        if payloads:
            kept.append(part)
    recorded, again = f.get("warc-payload-digest", "").removeprefix("sha1:"), f.get("warc-type") == "revisit"
    if again:
        size, digest = int(fields(bytes(http)).get("content-length", 0)), recorded
    else:
        digest = base64.b32encode(sha.digest()).decode()
        if recorded and recorded != digest:
            raise ValueError(f"{f.get('warc-record-id')}: the payload's digest is {digest}, not {recorded}")
    return f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), size, digest, f.get("warc-refers-to"), b"".join(kept) if payloads and not again else None


def page(record: Column, kind: str) -> Column:
    """The page's id within a record's id; null for a page without one."""
    return F.url_decode(F.nullif(F.regexp_extract(record, "^<urn:page:(.*)>$", 1), F.lit(""))).cast(kind)


def archived(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from archives that are written into the
    new folder, normalised, and read back. The first form of the archives goes when the second is whole; this stays.

    pages: page_id, url, html; other columns are passed over. A row of pages gives a row, repeated rows too; an empty table gives
    none, with an archive that holds nothing or no archive."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    write(pages, f"{folder}/streams", least=least)
    normalise(spark, f"{folder}/streams", f"{folder}/archives")
    where, path = store(f"{folder}/streams")
    where.delete_dir(path)
    rows = read(spark, f"{folder}/archives")
    return rows.select(page(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to"), kind).alias("refers_to"))
