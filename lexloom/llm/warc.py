"""WARC archives: pages are written as one gzip member a record, and read back by byte ranges.

Writing: each task writes archives of its own in a folder all executors share and gives back their
paths and lengths. Only what tasks that succeeded gave back is the list of archives, so a task that
was lost and ran again leaves no record twice. Of equal payloads of LEAST_REVISIT bytes and more, the page
with the largest id is a response; the others are revisits that refer to it and hold no payload.

Reading: archives are cut in ranges of any size, dealt to tasks. A task looks for gzip's magic in its
range and takes a place as a member if a WARC header is decoded there, the content has the header's
length, the checksum holds, and the archive ends there or another member follows. It owns the records
that start in its range, reads the last of them beyond it, and goes from member to member: the search
is only for a range's first member, or after damage. Payloads that hold archives themselves can't be taken
for members: the writer breaks up every magic inside a record. In archives of others, a record that holds
several members uncompressed may give them as records, too; without_nested() takes those out by their places.

Damage: members that can't be read are one row with an error and the place, given by the task whose
record they follow (the archive's first range if there is none); sound() makes it an error of the job.

Results for odd inputs: a null html is an empty payload; null ids are written as such, and among equal
payloads rank below all others; rows that share the largest id are all responses; control characters and
blanks of a URL are percent-encoded and a null URL is left out; payloads may have any length that fits
a row; an empty table gives no archives and no records. Further columns of the input aren't written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.shared import scratch, small_batches, written

#: Payloads below this are written again for each page.
LEAST_REVISIT = 1000
#: The first bytes of a gzip member, and the profile of revisits by equal payloads.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task begins another archive after so many bytes; a reader's range; what is read at a time.
ROLL, RANGE, READ = 1 << 30, 8 << 20, 1 << 18
#: Groups of equal payloads up to this number are sent to all tasks (about 100 bytes each); more are joined by a shuffle, in SALTS parts.
FEW_GROUPS, SALTS = 100_000, 16
_ID = "urn:page:"


# --- Records --------------------------------------------------------------------------------------


class Record(NamedTuple):
    """What a member holds; its payload is null for revisits."""

    record_type: str
    page_id: int | None
    url: str | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None


def rendered(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The text of a record. digest: hexadecimal SHA-1 of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _named(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _named(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member of its own. Where the record has the magic, the stream is flushed within it, so it can't stand in the member as it is."""
    pack, parts, done = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
    while (at := record.find(MAGIC, done)) >= 0:
        parts += [pack.compress(record[done : at + 1]), pack.flush(zlib.Z_SYNC_FLUSH)]
        done = at + 1
    return b"".join([*parts, pack.compress(record[done:]), pack.flush()])


def _named(page_id: int | None) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix(_ID)
    return int(number) if number else None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parsed(record: bytes) -> Record | None:
    """A record's text read, None if it isn't one of its own stated length."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    length = fields.get("content-length", "")
    if not head.startswith(b"WARC/1.") or not length.isdigit() or len(rest) != int(length) + 4:
        return None
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "")
    told = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest.startswith("sha1:") else None
    kind, page, url = fields.get("warc-type", ""), _page(fields.get("warc-record-id", "")), fields.get("warc-target-uri")
    if kind == "revisit":
        size = int(_fields(http).get("content-length", "0"))
        return Record(kind, page, url, size, told, _page(fields.get("warc-refers-to", "")), None)
    actual = hashlib.sha1(payload).hexdigest()
    return Record(kind, page, url, len(payload), actual, None, payload) if told in (None, actual) else None


# --- Writing --------------------------------------------------------------------------------------


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, revisit, refers_to) of pages: which are revisits, and of which page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("content", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    groups = written(long.groupBy("content").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    if groups.count() <= FEW_GROUPS:
        met = rows.join(F.broadcast(groups), "content", "left")
    else:  # a payload that very many pages have is in many parts
        parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(parts, ["content", "part"], "left")
    revisit = F.col("largest").isNotNull() & F.coalesce(F.col("page_id") < F.col("largest"), F.lit(True))
    return met.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), revisit.alias("revisit"), F.when(revisit, F.col("largest")).alias("refers_to"))


def archived(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in folder; gives (path, length, records) of each."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, where = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(where, recursive=True)
        done, out, name, length, n = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, digest, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and length >= ROLL:
                    out.close()
                    done.append((f"{folder}/{name}", length, n))
                    out = None
                if out is None:
                    name, length, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{where}/{name}", compression=None)
                packed = member(rendered(page_id, url, payload, digest, refers_to, revisit, date), level)
                out.write(packed)
                length, n = length + len(packed), n + 1
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", length, n))
        if done:
            paths, lengths, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(lengths, pa.int64()), pa.array(counts, pa.int64())], ["path", "length", "records"])

    return written(decided(pages).mapInArrow(run, "path string, length long, records long"), "archives")


# --- Reading --------------------------------------------------------------------------------------


class _Window:
    """Bytes of a file from a moving place on; what lies before it is forgotten."""

    def __init__(self, file: pa.NativeFile, size: int, start: int) -> None:
        self.file, self.size, self.start, self.data = file, size, start, b""

    def upto(self, end: int) -> bytes:
        """The bytes from start to end at least, or to the file's end."""
        have = self.start + len(self.data)
        if have < min(end, self.size):
            self.file.seek(have)
            self.data += self.file.read(max(end - have, READ))
        return self.data

    def move(self, start: int) -> None:
        self.data = self.data[start - self.start :]
        self.start = start


def member_at(window: _Window, place: int) -> tuple[bytes, int] | None:
    """The text of the WARC member that starts at a place, and where it ends; None if none does."""
    window.move(place)
    if not window.upto(place + 3).startswith(MAGIC):
        return None
    unpack, parts, fed = zlib.decompressobj(31), [], place
    try:
        while not unpack.eof:
            piece = window.upto(fed + READ)[fed - place : fed - place + READ]
            if not piece:
                return None
            parts.append(unpack.decompress(piece))
            fed += len(piece)
            if sum(map(len, parts[:9])) >= 7 and not b"".join(parts[:9]).startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    end = fed - len(unpack.unused_data)
    following = window.upto(end + 3)[end - place : end - place + 3]
    return (b"".join(parts), end) if not following or following == MAGIC else None


def owned(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, int, Record | None]]:
    """(place, end, record) of the members that start in a range; a record of None is damage at that place."""
    window = _Window(file, size, start)
    place, chained = start, start == 0
    while place < min(end, size) or (chained and place < size):
        found = member_at(window, place)
        record = parsed(found[0]) if found else None
        if record is not None:
            if place >= end:
                return
            yield place, found[1], record
            place, chained = found[1], True
            continue
        if chained:
            yield place, place, None
        chained = False
        place = _next_magic(window, place + 1, min(end, size))


def _next_magic(window: _Window, place: int, end: int) -> int:
    """The first place from here on, before end, that magic is at; end if none."""
    while place < end:
        window.move(place)
        at = window.upto(min(place + READ, end) + 2).find(MAGIC)
        if 0 <= at < end - place:
            return place + at
        if at >= 0:
            return end
        place = max(place + 1, window.start + len(window.data) - 2)
    return end


def records(archives: DataFrame, payloads: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """The records of archives (path, length): path, place, end, what Record has (payload only where asked for) and error."""
    parts = archives.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start")).where("length > 0")
    n = archives.agg(F.sum(F.ceil(F.col("length") / range_bytes)).alias("n")).first().n or 1
    fields = "path string, place long, end long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, error string" + (", payload binary" if payloads else "")
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, where = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(where) as file:
                    for place, stop, record in owned(file, size, start, start + range_bytes):
                        row = {"path": path, "place": place, "end": stop, "error": None if record else f"damaged member in {path} at {place}", **(record._asdict() if record else {})}
                        held += len(row.get("payload") or b"") if payloads else 0
                        rows.append({k: row.get(k) for k in schema.names})
                        if len(rows) >= 1024 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return parts.repartition(min(int(n), 1 << 16), "path", "start").mapInArrow(run, fields)


def without_nested(found: DataFrame) -> DataFrame:
    """records() without those that lie within another one of their archive: only needed for archives that other writers made."""
    before = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_end", F.max("end").over(before)).where(F.coalesce(F.col("place") >= F.col("_end"), F.lit(True))).drop("_end")


def sound(found: DataFrame) -> DataFrame:
    """records() without error; damage is an error of the job that reads them."""
    return found.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(True)).drop("error")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages written to archives in the shared folder and read back: the records without payloads."""
    return sound(records(archived(pages, scratch(spark, "warc")), payloads=False))
