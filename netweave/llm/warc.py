"""WARC archives: a writer with payload deduplication and a splittable reader.

One record is one gzip member. The writer hands Spark's text sink the member without its last byte and names that
byte, zero, as the line separator: the trailer of a member ends with the high byte of its length, which is zero
below 16 MiB; larger records get an empty member appended, which ends in zero as well. The files are thereby plain
``.warc.gz`` content, written to any Hadoop file system under Spark's commit protocol, so a lost executor leaves
neither half a record nor a second copy.

The reader deals out byte ranges of the files. A task looks for the gzip magic from the start of its range on,
takes a candidate for a member only if it decodes to a WARC header and its length and checksum hold, and owns the
records that start inside its range, also where they end beyond it.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from netweave.operators.skew import join_counted
from netweave.llm.words import tidied
from netweave.plans.session import materialise

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
#: Payloads of at least so many bytes are stored once; smaller ones aren't worth a reference.
MIN_SHARED_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _safe(uri: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def _record_id(page_id, url, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}|{copy}')}>"


def encode_record(row: dict, date: str) -> bytes:
    """The gzip member of one record."""
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _record_id(row["page_id"], row["url"], row["payload_digest"], row["copy"]))]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", _safe(row["url"])))
    head += [("WARC-Date", date), ("WARC-Payload-Digest", "sha256:" + row["payload_digest"])]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(row["refers_to"], row["refers_url"], row["payload_digest"], 0))]
        if row["refers_to"] is not None:
            head.append(("X-Refers-To-Page", str(row["refers_to"])))
        block = http
    else:
        block = http + (row["payload"] or b"")
    if row["page_id"] is not None:
        head.append(("X-Page", str(row["page_id"])))
    head += [("X-Payload-Bytes", str(row["payload_bytes"])), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    member = gzip.compress(raw, 6, mtime=0)
    return member if member[-1] == 0 else member + _EMPTY_MEMBER


def plan_records(pages: DataFrame, min_shared: int = MIN_SHARED_BYTES) -> DataFrame:
    """The records that stand for ``pages`` (``page_id, url, html``; other columns are ignored).

    Payload: the html in UTF-8, null is empty. Among rows with the same payload of at least ``min_shared`` bytes
    the one with the smallest ``page_id`` (null last, then smallest ``url``) is the response and the others are
    revisits of it; of rows that agree in everything one counts as the smallest. The html of a response alone is
    shuffled, by a key of its own page, so the copies of one payload don't meet in a task, nor do the rows that stand
    for them. Null ids, urls and html are values like others; an empty table gives an empty result.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns(
        {"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    row_key = F.md5(F.concat_ws("|", "payload_digest", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("u"), "url"), F.lit("-"))))
    large = p.where(F.col("payload_bytes") >= min_shared).withColumn("row_key", row_key)
    rows = large.groupBy("row_key", "payload_digest", "payload_bytes", "page_id", "url").agg(F.count("*").alias("n"))
    rows = materialise(rows, "pages")
    first = rows.groupBy("payload_digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", "row_key")).alias("r"), F.count("*").alias("holders")
    )
    total = rows.count()
    rows = join_counted(rows, first, "payload_digest", "holders", total, narrow=F.coalesce(F.octet_length("r.url"), F.lit(0)) < 2048)
    rows = rows.withColumn("is_first", F.col("row_key") == F.col("r.row_key"))
    none = F.lit(None)
    base = ["page_id", "url", "payload_digest", "payload_bytes"]
    response = (
        large.join(rows.where("is_first").select("row_key"), "row_key").dropDuplicates(["row_key"])
        .select(*base, "payload", F.lit("response").alias("record_type"), none.cast("long").alias("refers_to"), none.cast("string").alias("refers_url"), F.lit(0).alias("copy"))
    )
    again = F.col("n") - F.col("is_first").cast("int")
    revisit = rows.where(again > 0).select(
        *base, none.cast("binary").alias("payload"), F.lit("revisit").alias("record_type"), F.col("r.page_id").alias("refers_to"),
        F.col("r.url").alias("refers_url"), F.explode(F.sequence(F.lit(1), again.cast("int"))).alias("copy"),
    )
    small = p.where(F.col("payload_bytes") < min_shared).select(
        *base, "payload", F.lit("response").alias("record_type"), none.cast("long").alias("refers_to"), none.cast("string").alias("refers_url"), F.lit(0).alias("copy")
    )
    return response.unionByName(revisit).unionByName(small)


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write the rows of ``plan_records`` as archives below ``path``; returns ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                members = [encode_record(row, date)[:-1] for row in batch.slice(at, 256).to_pylist()]
                yield pa.record_batch([pa.array(members, pa.binary())], ["member"])

    members = records.mapInArrow(tidied(encode), "member binary").select(F.col("member").cast("string").alias("member"))
    members.write.option("lineSep", "\0").option("compression", "none").text(path)
    return path


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class _Window:
    """Random access to a file through one buffered block."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, pos: int, n: int = BLOCK) -> bytes:
        """Up to ``n`` bytes from ``pos`` on."""
        if not self.at <= pos < self.at + len(self.data) or self.at + len(self.data) < min(pos + n, self.size):
            self.at, self.data = pos, self.file.read_at(max(0, min(max(n, BLOCK), self.size - pos)), pos)
        return self.data[pos - self.at : pos - self.at + n]


def parse_header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields, and where the block begins; None if ``raw`` doesn't begin with a complete WARC header."""
    end = raw.find(b"\r\n\r\n") if raw.startswith(b"WARC/") else -1
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and its end, if it is one that holds a WARC record."""
    head = window.read(at, 4)
    if len(head) < 4 or head[:3] != MAGIC or head[3] & 0xE0:
        return None
    decoder, out, pos, looked = zlib.decompressobj(31), [], at, False
    while not decoder.eof:
        chunk = window.read(pos, 1 << 16)
        if not chunk:
            return None
        try:
            out.append(decoder.decompress(chunk))
        except zlib.error:
            return None
        pos += len(chunk)
        if not looked and sum(map(len, out)) >= 5:
            looked = True
            if not b"".join(out).startswith(b"WARC/"):
                return None
    return b"".join(out), pos - len(decoder.unused_data)


def _begins(window: _Window, at: int) -> bool:
    """Whether a record's member, or an empty one, begins at ``at``, or the file ends there."""
    chunk = window.read(at, 1 << 16)
    if not chunk:
        return True
    if chunk[:3] != MAGIC:
        return False
    decoder = zlib.decompressobj(31)
    try:
        out = decoder.decompress(chunk, 16)
    except zlib.error:
        return False
    return out.startswith(b"WARC/") or decoder.eof and not out


def read_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header and block of the records that start in ``[start, end)``."""
    window, pos, chained = _Window(file, size), start, start == 0
    while pos < min(end, size):
        if window.read(pos, 3) != MAGIC:
            chained = False
            block = window.read(pos, BLOCK)
            found = block.find(MAGIC)
            if found < 0:
                pos += max(1, len(block) - 2)
                continue
            pos += found
            if pos >= end:
                return
        got = _member(window, pos)
        head = parse_header(got[0]) if got else None
        if head:
            raw, stop = got
            fields, body = head
            length = int(fields["content-length"])
            # what scanning came upon may be part of a payload; then no member follows it
            if len(raw) == body + length + 4 and (chained or _begins(window, stop)):
                yield pos, stop - pos, fields, raw[body : body + length]
                pos, chained = stop, True
                continue
        pos += 1
        chained = False


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP header, if it has one."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_warc(spark: SparkSession, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    """Records of all gzipped WARC files below ``path``: ``path, offset, length, headers, payload``.

    Header names are in lower case. Members that don't decode to a record with a sound checksum and length are
    passed over. A folder without files gives an empty result. Files are cut into ranges by the tasks; the driver
    holds what its file listing holds. Headers and payloads may be of any length; a task holds one record at a time and
    some 8 MB of those it gives.
    """
    files = _archives(spark, path)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.where("size > 0").withColumn("start", starts).withColumn("end", F.least(F.col("start") + split_bytes, "size"))
    n = files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, inner = _filesystem(row["path"])
                with files.open_input_file(inner) as file:
                    rows, held = [], 0
                    for offset, length, fields, block in read_range(file, row["size"], row["start"], row["end"]):
                        payload = payload_of(fields, block)
                        rows.append((row["path"], offset, length, list(fields.items()), payload))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 2048:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    # by place and not in turn, so a rerun deals the ranges out as before
    return ranges.repartition(max(1, min(n, 100_000)), "path", "start").mapInArrow(tidied(read), RECORD_SCHEMA)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, size`` of all files below ``path``, found by Spark's own listing; their content isn't read."""
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], "path string, size long")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select("path", F.col("length").alias("size"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], RECORD_SCHEMA.names)
