"""WARC archives: written record by record, one gzip member each, and read back in one pass.

Writing. Rows of equal payload (its SHA-1, at least `least` bytes) are one response, that of the smallest key, and
revisits of it, which hold no payload but its digest and its record's id. Each task fills archives of about
`archive_bytes` and Spark writes each to a file of its own in the shared folder: the text writer takes an archive as one
value and its line separator is an empty gzip member, which a reader of members passes over. Nothing of a task that was
lost stays, as with any table that Spark writes.

Reading. A file is taken in pieces of CHUNK bytes. Each goes through zlib's decompressor of the member at hand, and what
comes out through a machine that first looks for the end of the header, then counts the block by its content length and
hashes it on the way. A new member begins where one ends. Digests of blocks and payloads are compared with those of the
header; what doesn't fit is told in `error`, never raised, and a broken member ends its file.

Keys that many rows share in a join: the digests of 1/1000 of all rows or more (1,000 at most) are broadcast, others are
joined by a shuffle, so that no task gets the copies of one payload.

Edge cases: null payloads are empty ones; a null url leaves out its header and is read as null; control characters in
urls are percent-encoded; rows that share the smallest key of a payload are all responses; a null key comes after all
others, is read as null and can't be referred to: copies that have no key are all responses; other columns are left
out; an empty table gives an empty archive. Payloads of any length are read whole; one is held at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketgraph.llm.common import lookup, materialize, new_path

CHUNK, ARCHIVE_BYTES = 1 << 14, 32 << 20
#: The date of records, the profile of revisits, names of records by key.
DATE, PROFILE, NAME = "1970-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "urn:row:"
FIELDS = "key string, record_id string, record_type string, target_uri string, date string, payload binary, payload_bytes long, payload_digest string, refers_to string, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: An empty gzip member, which ends each archive.
END = member(b"")


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, name: str | None = None) -> bytes:
    """A response record, or a revisit if it refers to another key. name: the record's id, where there is no key."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name if key is None else NAME + key}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Broken(ValueError):
    """What is wrong with a record or a member."""


class Record:
    """Takes the bytes of one member as they come: header lines, then as many bytes as the header says, then two line ends."""

    def __init__(self):
        self.head, self.fields, self.block, self.left, self.tail = bytearray(), None, bytearray(), 0, b""
        self.digest = hashlib.sha1()

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            began = max(0, len(self.head) - 3)
            self.head += data
            end = self.head.find(b"\r\n\r\n", began)
            if end < 0:
                return
            data = bytes(self.head[end + 4 :])
            self._header(bytes(self.head[:end]))
        own = data[: self.left]
        self.block += own
        self.digest.update(own)
        self.left -= len(own)
        self.tail += data[len(own) :]
        if len(self.tail) > 4:
            raise Broken("more than its content length")

    def _header(self, raw: bytes) -> None:
        version, *lines = raw.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise Broken("no WARC record")
        self.fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        size = self.fields.get("content-length", "")
        if not size.isdigit():
            raise Broken("no content length")
        self.left = int(size)

    def row(self) -> tuple | None:
        """FIELDS at the end of the member; None if the member was empty."""
        if self.fields is None:
            if not self.head:
                return None
            raise Broken("no end of header")
        if self.left or self.tail != b"\r\n\r\n":
            raise Broken("shorter than its content length")
        f, errors = self.fields, []
        name = f.get("warc-record-id", "").strip("<>")
        kind, refers_to = f.get("warc-type"), f.get("warc-refers-to", "").strip("<>")
        if "warc-block-digest" in f and f["warc-block-digest"] != "sha1:" + base64.b32encode(self.digest.digest()).decode():
            errors.append("block digest")
        payload, size = bytes(self.block), None
        if f.get("content-type", "").startswith("application/http"):
            head, _, payload = payload.partition(b"\r\n\r\n")
            said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
            size = int(said[1]) if said else None
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "revisit":
            payload = None
        else:
            if size not in (None, len(payload)):
                errors.append("payload length")
            size = len(payload)
            if digest not in ("", base32_sha1(payload)):
                errors.append("payload digest")
        key = name.removeprefix(NAME) if name.startswith(NAME) else None
        return key, name, kind, f.get("warc-target-uri"), f.get("warc-date"), payload, size, digest or None, refers_to.removeprefix(NAME) or None, ", ".join(errors) or None


def read_archive(chunks):
    """FIELDS of the records of an archive, from its bytes in pieces of any size, in one pass."""
    z, now = zlib.decompressobj(31), Record()
    fed = False  # whether the member at hand has bytes
    try:
        for data in chunks:
            while data:
                fed = True
                now.feed(z.decompress(data))  # deflate gives at most some 1,000 bytes for one
                data = b""
                if z.eof:
                    data = z.unused_data
                    row = now.row()
                    if row is not None:
                        yield row
                    z, now, fed = zlib.decompressobj(31), Record(), False
        if fed:
            raise Broken("member cut off")
    except (Broken, zlib.error) as e:
        yield (*[None] * 9, str(e))


def write(rows: DataFrame, path: str, key: str, payload: str, url: str | None = None, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row to archives under path."""
    text = F.col(payload).cast("string") if rows.schema[payload].dataType.simpleString() != "binary" else F.col(payload)
    rows = rows.select(F.col(key).alias("key"), (F.lit(None) if url is None else F.col(url)).cast("string").alias("url"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.sha1("payload"))
    of = rows.select("key", digest.alias("digest")).filter("digest IS NOT NULL").groupBy("digest")
    firsts = materialize(of.agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("first")).filter("rows > 1"), "payloads")
    decided = lookup(rows.withColumn("digest", digest), firsts, ["digest"], "rows")
    refers_to = F.when(F.col("key").isNull() | (F.col("key") > F.col("first")), F.col("first")).cast("string")
    decided = decided.select(F.col("key").cast("string").alias("key"), "url", "payload", refers_to.alias("refers_to"))

    def fill(batches):
        own, size, nth = [], 0, 0
        unique = uuid.uuid4()
        for batch in batches:
            slices = (batch.slice(at, 64) for at in range(0, batch.num_rows, 64))
            for one in (x for s in slices for x in zip(*[s.column(c).to_pylist() for c in ("key", "url", "payload", "refers_to")])):
                nth += 1
                own.append(member(record(*one, name=f"urn:uuid:{uuid.uuid5(unique, str(nth))}")))
                size += len(own[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], ["archive"])
                    own, size = [], 0
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], ["archive"])

    archives = decided.mapInArrow(fill, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.options(maxRecordsPerFile=1, lineSep=END.decode("latin-1"), encoding="ISO-8859-1").text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """FIELDS of all records of the archives under path. A revisit's payload is null, its length that of its HTTP header.

    An archive goes to one task, in memory of its compressed size (2 GB at most); payloads=False leaves them null, after
    they were verified.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                view = memoryview(content.as_buffer())
                rows, size = [], 0
                for row in read_archive(bytes(view[s : s + CHUNK]) for s in range(0, len(view), CHUNK)):
                    rows.append(row if payloads else (*row[:5], None, *row[6:]))
                    size += 200 + len(rows[-1][5] or b"")
                    if size >= 1 << 22:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FIELDS)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)


def resolved(records: DataFrame, copies: int = 1000) -> DataFrame:
    """Records with the payload of the response in each revisit; `error` says where there is none of that digest.

    A payload goes out once for every `copies` revisits of it, each time to a share of them.
    """
    revisits, of = records.filter("record_type = 'revisit'"), ["refers_to", "payload_digest"]
    counts = materialize(revisits.groupBy(*of).agg(F.count(F.lit(1)).alias("rows")).withColumn("shares", F.ceil(F.col("rows") / copies)), "revisits")
    shared = lookup(revisits, counts, of, "rows").withColumn("share", F.pmod(F.xxhash64("record_id"), "shares"))
    given = records.filter("record_type = 'response'").select(F.col("key").alias("refers_to"), "payload_digest", F.col("payload").alias("found")).dropDuplicates(of)
    given = given.join(counts.drop("rows"), of).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares").withColumn("there", F.lit(True))
    out = shared.join(given, [*of, "share"], "left")
    told = F.when(F.col("there"), F.col("error")).otherwise(F.concat_ws(", ", "error", F.lit("no response")))
    out = out.select(*[F.col("found").alias(c) if c == "payload" else told.alias(c) if c == "error" else c for c in records.columns])
    return records.filter("record_type <> 'revisit' OR record_type IS NULL").unionByName(out)


def round_trip(rows: DataFrame, key: str, payload: str, url: str | None = None, least: int = 0) -> DataFrame:
    """Writes archives to the shared folder and reads them: FIELDS without payloads."""
    spark = rows.sparkSession
    path = new_path(spark, "warc")
    write(rows, path, key, payload, url, least)
    return read(spark, path, payloads=False)
