"""WARC archives: written a gzip member a record, read back by a reader that salvages what damage leaves.

The reader goes from record to record. At each place it expects a gzip member or a version line, and
checks what stands there: the member's own checksum and length, the version line, the header fields a
record must have, the length of its block, the two line ends after it, and the digests of block and
payload. When a check fails it searches for the next place where a member or a version line begins a
record that passes them all, goes on from there, and logs the bytes between as a quarantined gap with
the reason. Records and gaps together are the whole archive, byte for byte.

Executors write archives to the shared folder, each under a name of its own attempt; the list of archives
is a Parquet table, so what a lost or repeated task has left is in no list. One archive is read by one
task, a window of bytes at a time, so only single records have to fit its memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, shared_dir, table

#: Bytes of an archive after which the next one begins, and payloads from which on copies become revisits.
SIZE, LEAST = 32 << 20, 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
FIELDS = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Bytes read at once; a header is no longer.
WINDOW, HEADER = 1 << 20, 1 << 16


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def line_of(value: str) -> str:
    """A header value without line ends and other controls, which are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_of(record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response, or a revisit without its payload: the length and the digest of the payload stand in either."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{line_of(record_id)}>"), ("WARC-Date", line_of(date))]
    if uri is not None:
        fields.append(("WARC-Target-URI", line_of(uri)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{line_of(refers_to)}>")]
    else:
        block += payload
    fields += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, path: str, size: int = SIZE, compressed: bool = True) -> DataFrame:
    """Write records (record_id, uri, date, payload, refers_to) to archives under ``path``; (file, n_records, bytes) of each.

    A record with refers_to is a revisit and stands without its payload. Each is a gzip member, or plain where
    ``compressed`` is false; an archive ends with the record that takes it to ``size`` bytes. A null record_id is
    left out as an error of the caller's; a null uri has no field; a null date is 1970-01-01T00:00:00Z; a null payload
    is empty; repeated rows are records of their own; other columns aren't written; no rows make no archives.
    ``path`` is a folder that all executors reach: a URI, or a path on a shared file system.
    """
    rows = records.select(F.coalesce("record_id", F.raise_error(F.lit("a record has no id"))).alias("id"), "uri", F.coalesce("date", F.lit("1970-01-01T00:00:00Z")).alias("date"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"), "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        out, name, n = None, "", 0
        done: list[tuple[str, int, int]] = []

        def closed() -> None:
            done.append((f"{path.rstrip('/')}/{name}", n, out.tell()))
            out.close()

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                data = record_of(*values)
                if compressed:
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc" + ".gz" * compressed, 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(data)
                n += 1
                if out.tell() >= size:
                    closed()
                    out = None
        if out is not None:
            closed()
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["file", "n_records", "bytes"])

    return settled(rows.mapInArrow(write, "file string, n_records long, bytes long"), "archives")


class Failed(Exception):
    """A check that a place in an archive fails; end: where what stands there ends, if that is known all the same."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


class Bytes:
    """Part of a file, or of a member's content, read through a window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def at(self, start: int, n: int) -> bytes:
        """n bytes from start on, fewer at the end."""
        n = min(n, self.size - start)
        if n <= 0:
            return b""
        if not (self.start <= start and start + n <= self.start + len(self.held)):
            self.file.seek(start)
            self.start, self.held = start, self.file.read(max(n, min(WINDOW, self.size - start)))
        i = start - self.start
        return self.held[i : i + n]


class Held:
    """Bytes in memory, as a file."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def at(self, start: int, n: int) -> bytes:
        return self.data[start : start + n]


def member(source, start: int) -> tuple[bytes, int]:
    """The content of the gzip member at start, and its end."""
    unpacker, out, at, step = zlib.decompressobj(31), [], start, 1 << 14
    while not unpacker.eof:
        data = source.at(at, step)
        if not data:
            raise Failed("gzip member is cut off")
        try:
            out.append(unpacker.decompress(data))
        except zlib.error as e:
            raise Failed(f"gzip member: {re.sub('^Error -?[0-9]+ while decompressing data: ', '', str(e))}") from None
        at, step = at + len(data), min(WINDOW, step * 4)
    return b"".join(out), at - len(unpacker.unused_data)


def record(source, start: int) -> tuple[dict, int]:
    """The record at start, all checks passed, and its end."""
    head = source.at(start, HEADER)
    if not re.match(rb"WARC/1\.[01]\r\n", head):
        raise Failed("no version line")
    stop = head.find(b"\r\n\r\n")
    if stop < 0:
        raise Failed("header doesn't end")
    fields: dict[str, str] = {}
    for line in head[head.index(b"\r\n") + 2 : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Failed("header field is malformed")
        fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    if missing := [f for f in FIELDS if f not in fields]:
        raise Failed(f"header has no {missing[0]}")
    if not re.fullmatch(r"[0-9]{1,18}", fields["content-length"]):
        raise Failed("content-length is no number")
    first = start + stop + 4
    end = first + int(fields["content-length"])
    if source.at(end, 4) != b"\r\n\r\n":
        raise Failed("block has another length")
    block = source.at(first, end - first)
    check(fields.get("warc-block-digest"), block, "block", end + 4)
    payload, length = block, len(block)
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http)
        length = int(said[1]) if said else len(payload)
    revisit = fields["warc-type"].lower() == "revisit"
    if not revisit:
        check(fields.get("warc-payload-digest"), payload, "payload", end + 4)
        length = len(payload)
    return {"fields": fields, "payload": None if revisit else payload, "payload_bytes": length}, end + 4


def check(said: str | None, data: bytes, what: str, end: int) -> None:
    """A SHA-1 in base 32 or 16 has to be that of data; digests of other kinds aren't held against it."""
    if said and said.lower().startswith("sha1:") and hex_of(said) != hashlib.sha1(data).hexdigest():
        raise Failed(f"{what} has another digest", end)


def hex_of(said: str | None) -> str | None:
    """The digest that a field gives, in lower-case base 16."""
    value = (said or "").partition(":")[2]
    if re.fullmatch(r"[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return value.lower() or None


def candidates(source, start: int, marks: tuple[bytes, ...]) -> Iterator[int]:
    """Places from start on where a mark stands, in order."""
    mark, keep = re.compile(b"|".join(map(re.escape, marks))), max(map(len, marks)) - 1
    while start < source.size:
        data = source.at(start, WINDOW)
        for m in mark.finditer(data):
            yield start + m.start()
        start += len(data) - keep if len(data) > keep and start + len(data) < source.size else len(data)


def salvaged(source, nested: bool = False) -> Iterator[tuple[int, int, int, int, dict | str]]:
    """(start, end, inner start, inner end, record or the reason of a gap) of all of source, without a break between.

    Inner places are those in a member's content. What a member holds beside its first record or gap has an empty place at its end.
    """
    marks = (VERSION,) if nested else (GZIP, VERSION)
    gap, reason, places = 0, "", None
    at: int | None = 0
    while at is not None and at < source.size:
        try:
            if not nested and source.at(at, 3) == GZIP:
                data, end = member(source, at)
                inner = list(salvaged(Held(data), True)) or [(0, 0, 0, 0, "gzip member is empty")]
                if not any(isinstance(x[-1], dict) for x in inner):
                    raise Failed(inner[0][-1], end)
                found = [(end if i else at, end, s, e, x) for i, (s, e, _, _, x) in enumerate(inner)]
            else:
                x, end = record(source, at)
                found = [(at, end, 0, end - at, x)]
        except Failed as e:
            reason = reason or str(e)
            if e.end is not None and (e.end == source.size or any(source.at(e.end, len(m)) == m for m in marks)):
                at, places = e.end, None
                if not nested and at < source.size:  # a gap for each such record, as its end is known
                    yield gap, at, 0, at - gap, reason
                    gap, reason = at, ""
                continue
            if places is None:
                places = candidates(source, at + 1, marks)
            at = next(places, None)
            continue
        if at > gap:
            yield gap, at, 0, at - gap, reason
        yield from found
        gap = at = end
        reason, places = "", None
    if gap < source.size:
        yield gap, source.size, 0, source.size - gap, reason


ROW = "file string, start long, length long, inner_start long, inner_length long, type string, record_id string, uri string, refers_to string, date string, payload_digest string, payload_bytes long, payload binary, gap string"
TYPES = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]


def bare(value: str | None) -> str | None:
    """A record id without its angle brackets."""
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def row_of(file: str, start: int, end: int, inner: int, inner_end: int, x: dict | str, payloads: bool) -> tuple:
    place = file, start, end - start, inner, inner_end - inner
    if isinstance(x, str):
        return *place, *[None] * 8, x
    f = x["fields"]
    said = hex_of(f.get("warc-payload-digest"))
    return *place, f["warc-type"].lower(), bare(f["warc-record-id"]), f.get("warc-target-uri"), bare(f.get("warc-refers-to")), f["warc-date"], said, x["payload_bytes"], x["payload"] if payloads else None, None


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives in column ``file``: file, start, length, inner_start, inner_length, type, record_id, uri,
    refers_to, date, payload_digest (lower-case base 16), payload_bytes, payload and gap.

    gap is null for a record, and for a gap the first check that failed there; its other fields are null. Bytes start to
    start + length of an archive are the record's or the gap's, and all rows of an archive together are the archive. inner places
    are those in the content of a gzip member. payload_bytes is the full payload's, of a revisit as its HTTP header has it; a
    revisit's payload is null, and so are all where ``payloads`` is false. Archives are gzip (a member a record, or
    several in a member, which has to fit memory) or plain, by what they hold and not by their name; an empty one has no rows.
    A null file has none either; one listed twice is read twice; other columns are left out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(TYPES), TYPES)], [x.split()[0] for x in ROW.split(", ")])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name))
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for place in salvaged(Bytes(file, file.size())):
                        rows.append(row_of(name, *place, payloads))
                        held += len(rows[-1][-2] or b"")
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    yield batch_of(rows)

    listed = settled(files.where("file is not null").select("file"), "listed")
    return listed.repartition(max(1, listed.count())).mapInArrow(read, ROW)


def salvage(files: DataFrame, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of archives: both from one reading, whose rows are written to the shared folder; gaps are its log of
    quarantined bytes (file, start, length, inner_start, inner_length, gap)."""
    found = settled(read_archives(files, payloads), "salvaged")
    return found.where("gap is null").drop("gap"), found.where("gap is not null").select("file", "start", "length", "inner_start", "inner_length", "gap")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the archives that Spark finds under a path; their contents aren't read here."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))


def with_revisits(records: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """records with ``refers_to``: of those with equal ``payload`` (binary) of ``least`` bytes or more the largest ``key`` (long), null for itself.

    Only digests with several payloads are joined to, and shorter payloads meet none of them, so a payload that
    is very frequent is one that Spark's skew join splits. A null payload counts as empty; a row without a key refers to the
    largest there is, and if none has a key nothing does; rows that repeat the largest key are no revisits. Other
    columns stay; refers_to is replaced.
    """
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    own = F.when(size >= least, F.concat_ws("-", F.sha2("payload", 256), size)).otherwise(F.concat(F.lit("-"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    keyed = records.drop("refers_to").withColumn("_same", own)
    copies = records.where(size >= least).select(own.alias("_same"), F.col(key).alias("_key")).groupBy("_same").agg(F.count("*").alias("_n"), F.max("_key").alias("_last"))
    joined = keyed.join(copies.where("_n > 1 and _last is not null").drop("_n"), "_same", "left")
    return joined.withColumn("refers_to", F.when(~F.col("_last").eqNullSafe(F.col(key)), F.col("_last"))).drop("_same", "_last")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))

    def urn(c: str):
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))

    named = with_revisits(pages, "page_id").select(urn("page_id").alias("record_id"), "uri", F.lit(None).cast("string").alias("date"), "payload", F.when(F.col("refers_to").isNotNull(), urn("refers_to")).alias("refers_to"))
    records, _ = salvage(write_archives(named, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"), payloads=False)

    def number(c: str):
        return F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")

    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS payload FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM k
"""
