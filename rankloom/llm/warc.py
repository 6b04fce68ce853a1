"""WARC archives: written with segments and chunked framing, read back and reassembled.

An archive is a folder of files, each a run of records: `WARC/1.1`, header fields, an empty line, a
block of Content-Length bytes, two line ends.  The payload of a response lies in chunked transfer
framing behind an HTTP header.  A block longer than a segment is cut: the first part stays in the
response (segment 1), the others follow as continuation records that name it as their origin; the
last one tells the total length.  Of equal payloads of at least REVISIT_BYTES only one is written;
the others are revisit records that name its digest, its page and its length.

Records are text rows to Spark, which writes them with the empty lines between and reads them by the
line that begins a record, so a file is split over tasks.  The writer ends a chunk inside any such
line of a payload.  Other archives may hold one: the record is then torn, which its length shows,
and its whole file is read again in one piece (`foreign=True`), as far as one value of Spark can hold it.

Continuations are sorted by origin and number, and each record's parts stream through one task: parts
are checked for gaps and against the total length, unframed, and hashed as they come.

A null payload is the empty one and a null url the empty one.  A row with a null page id is written
without one; it can revisit, but nothing revisits it.  Rows that repeat the smallest id of a payload
are all responses.  Records that can't be read have a `fault` and a null payload; they are never
dropped.  An empty table gives an empty archive.  Other columns are not read."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom import runtime
from rankloom.llm.common import group_count
from rankloom.llm.registry import query, table

REVISIT_BYTES = 100
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
# A payload with more rows is joined by broadcast, or split by Spark where there are too many.
HOT_ROWS = 100_000
DATE = "1970-01-01T00:00:00Z"
# Begins every record but the first of a file.
MARK = b"\nWARC/1."
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FIELDS = "page_id long, uri string, kind string, digest string, refers_to long, length long"
_OUT = f"{_FIELDS}, payload_bytes long, payload binary, fault string"


# --- writing


def decisions(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, uri, payload, digest, refers_to) of every row; refers_to is the page whose payload a revisit repeats."""
    body = F.col(payload) if dict(pages.dtypes)[payload] == "binary" else F.encode(F.col(payload), "UTF-8")
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.coalesce(F.col(uri), F.lit("")).alias("uri"),
                        F.coalesce(body, F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = (rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    hot = first.where(F.col("n") > HOT_ROWS).select("digest", F.col("first").alias("hot"))
    top = hot.limit(runtime.BROADCAST_KEYS + 1).collect()
    none = F.lit(None).cast("bigint")
    if 0 < len(top) <= runtime.BROADCAST_KEYS:  # counted
        rows = rows.join(F.broadcast(pages.sparkSession.createDataFrame(top, hot.schema)), "digest", "left")
        first = first.where(F.col("n") <= HOT_ROWS)
    else:
        rows = rows.withColumn("hot", none)
    # rows whose payload is settled are dealt out by their page
    spot = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce("page_id", F.xxhash64("uri")).cast("string")))
    met = rows.withColumn("spot", spot).join(first.select(F.col("digest").alias("spot"), "first"), "spot", "left")
    known = F.coalesce("hot", "first")
    later = F.when(known.isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > known)), known)
    return met.select("page_id", "uri", F.when(later.isNull(), F.col("payload")).alias("payload"), "digest",
                      F.length("payload").cast("bigint").alias("length"), later.alias("refers_to"))


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked framing.  No chunk is longer than `size`, and none holds the mark of a record."""
    cuts = set(range(size, len(payload), size)) | {m.start() + 3 for m in re.finditer(re.escape(MARK), payload)}
    out, start = [], 0
    for cut in [*sorted(cuts), len(payload)]:
        if cut > start:
            out.append(b"%x\r\n%b\r\n" % (cut - start, payload[start:cut]))
            start = cut
    return b"".join(out) + b"0\r\n\r\n"


def segments(block: bytes, size: int = SEGMENT_BYTES) -> list[bytes]:
    """The block in parts of at most `size` bytes; none but the first begins like a record."""
    out, start = [], 0
    while len(block) - start > size:
        cut = start + size
        if block.startswith(MARK[1:], cut):
            cut -= 1
        out.append(block[start:cut])
        start = cut
    return [*out, block[start:]]


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return VERSION + "".join(lines).encode("utf-8") + b"\r\n" + block


def _line(text: str) -> str:
    """A header value on one line, reversibly: control characters, percent signs before hex digits and spaces at the ends."""
    return re.sub(r"[\x00-\x1f\x7f\x85  ]|%(?=[0-9A-Fa-f]{2}~)|^ | $", lambda m: "".join(f"%{b:02X}~" for b in m[0].encode("utf-8")), text)


def _text(line: str) -> str:
    if "~" not in line:
        return line
    return re.sub(r"(?:%[0-9A-Fa-f]{2}~)+", lambda m: bytes.fromhex(re.sub("[%~]", "", m[0])).decode("utf-8", "replace"), line)


def records(page_id: int | None, uri: str, payload: bytes | None, digest: str, length: int, refers_to: int | None,
            segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The records of one page, without the empty lines behind them."""
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Target-URI", _line(uri)), ("WARC-Date", DATE)]
    own = [*common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page_id), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *own, ("WARC-Profile", PROFILE), ("X-Refers-To-Page", refers_to)], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = segments(block, segment)
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *own, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for number, part in enumerate(parts[1:], 2):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common, ("WARC-Segment-Origin-ID", origin),
                       ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None)], part)


def write(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html",
          segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, compression: str = "gzip") -> None:
    """Write an archive of all rows to `folder`; Spark commits its files, so a failed task leaves none.
    A compressed file is read by one task, one written with compression="none" by several."""

    def run(batches):
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "uri", "payload", "digest", "length", "refers_to"))):
                for record in records(*row, segment, chunk):
                    out.append(record)
                    size += len(record)
                if size > 4 * 1024 * 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = decisions(pages, key, uri, payload).mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).text(folder, compression=compression)


# --- reading


def parsed(raw: bytes) -> dict:
    """Header fields (lower-case names) and block of a record that may miss its `WARC/1.` and last line ends."""
    head, gap, rest = raw.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in lines[1:])}
    length = fields.get("content-length", "")
    if not gap or not length.isdecimal() or len(rest) < int(length) or rest[int(length):].strip(b"\r\n"):
        return {"fields": fields, "block": None}
    return {"fields": fields, "block": rest[:int(length)]}


class Body:
    """The payload of an HTTP message that comes in parts: its header, then its body, unframed where it is chunked."""

    def __init__(self, take):
        self.take, self.held, self.state, self.left = take, b"", "head", 0

    def feed(self, part: bytes) -> None:
        """Raises ValueError where the framing is broken."""
        data = self.held + part
        at = 0
        while self.state != "plain":
            if self.state == "data":
                piece = data[at:at + self.left]
                self.take(piece)
                at += len(piece)
                self.left -= len(piece)
                if self.left:
                    break
                self.state = "gap"
            stop = data.find(b"\r\n\r\n" if self.state == "head" else b"\r\n", at)
            if stop < 0:
                break
            line, at = data[at:stop], stop + (4 if self.state == "head" else 2)
            if self.state == "head":
                framed = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked[ \t]*\r?$", line)
                self.state = "size" if framed else "plain"
            elif self.state == "gap":
                if line:
                    raise ValueError("chunk is longer than its size")
                self.state = "size"
            elif self.state == "size":
                digits = line.partition(b";")[0].strip()
                if not re.fullmatch(rb"[0-9A-Fa-f]+", digits):
                    raise ValueError("no chunk size")
                self.left = int(digits, 16)
                self.state = "data" if self.left else "trailer"
            elif self.state == "trailer" and not line:
                self.state = "done"
            elif self.state == "done":
                raise ValueError("bytes behind the last chunk")
        if self.state == "plain":
            self.take(data[at:])
            at = len(data)
        self.held = data[at:]

    def close(self) -> None:
        if self.state not in ("plain", "done") or self.held:
            raise ValueError("block ends early")


class Record:
    """A record being put together from its parts, in order."""

    def __init__(self, fields: dict | None, keep: bool):
        self.fields, self.keep, self.sha = fields or {}, keep, hashlib.sha256()
        self.kept: list[bytes] = []
        self.size = self.blocks = self.parts = 0
        self.body = Body(self._take)
        self.fault = None if fields else "first segment missing"

    def _take(self, piece: bytes) -> None:
        self.sha.update(piece)
        self.size += len(piece)
        if self.keep:
            self.kept.append(piece)

    def add(self, block: bytes | None) -> None:
        self.parts += 1
        if block is None:
            self.fault = self.fault or "record is torn"
        elif not self.fault:
            self.blocks += len(block)
            try:
                self.body.feed(block)
            except ValueError as e:
                self.fault = str(e)

    def row(self) -> dict:
        f = self.fields
        kind = f.get("warc-type")
        number = lambda k: int(f[k]) if f.get(k, "").lstrip("-").isdecimal() else None
        digest = f.get("warc-payload-digest", "").removeprefix("sha256:").lower()
        out = {"page_id": number("x-page-id"), "uri": _text(f.get("warc-target-uri", "")), "kind": kind, "refers_to": number("x-refers-to-page"),
               "length": self.blocks, "payload": None, "payload_bytes": None, "digest": digest or None}
        if kind == "revisit":
            return out | {"payload_bytes": number("content-length-of-page"), "fault": self.fault}
        if not self.fault:
            try:
                self.body.close()
            except ValueError as e:
                self.fault = str(e)
        if not self.fault and digest and self.sha.hexdigest() != digest:
            self.fault = "digest differs"
        if not self.fault:
            out |= {"payload": b"".join(self.kept) if self.keep else None, "payload_bytes": self.size, "digest": self.sha.hexdigest()}
        return out | {"fault": self.fault}


def _revisit_length(fields: dict, block: bytes | None) -> None:
    """A revisit's block is the header of the page's response, which tells the length."""
    m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", block or b"")
    if m:
        fields["content-length-of-page"] = m[1].decode()


_SCHEMA = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()),
                     ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fault", pa.string())])


def _batched(rows: Iterator[dict], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 200 + size_of(row)
        if size > 4 * 1024 * 1024:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """(raw, head, file): the bytes and header of every record, by splits of the files."""
    lines = spark.read.option("lineSep", MARK.decode()).text(folder)
    raw = lines.select(F.col("value").cast("binary").alias("raw"), F.lower(F.substring_index("value", END.decode(), 1)).alias("head"),
                       F.col("_metadata.file_path").alias("file"))
    return raw.where(F.length("raw") > 0)


def torn_files(spark: SparkSession, folder: str) -> list[str]:
    """Files with a record whose length isn't what its header says.  Spark's own list of the files is longer."""
    raw = raw_records(spark, folder)
    told = F.regexp_extract("head", r"\r\ncontent-length:[ \t]*([0-9]+)", 1).cast("bigint")
    behind = F.length("raw") - F.octet_length("head") - 4 - told
    return [r[0] for r in raw.where(told.isNull() | ~behind.between(3, 4)).select("file").distinct().collect()]


def _whole_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """The records of some files, each read in one piece and cut by the lengths alone."""

    def run(batches):
        def cut(data: bytes):
            at = 0
            while at < len(data):
                stop = data.find(END, at)
                m = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", data[at:stop + 2]) if stop >= 0 else None
                end = stop + 4 + int(m[1]) if m else len(data)
                yield {"raw": data[at:end], "head": data[at:max(stop, at)].decode("utf-8", "replace").lower(), "file": ""}
                at = end
                while data[at:at + 1] in (b"\r", b"\n"):
                    at += 1

        for batch in batches:
            for content in batch.column("content").to_pylist():
                content = gzip.decompress(content) if content.startswith(b"\x1f\x8b") else content
                yield from _batched(cut(content), pa.schema([("raw", pa.binary()), ("head", pa.string()), ("file", pa.string())]), lambda r: len(r["raw"]))

    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, "raw binary, head string, file string")


def read(spark: SparkSession, folder: str, payloads: bool = True, foreign: bool = False) -> DataFrame:
    """(page_id, uri, kind, digest, refers_to, length, payload_bytes, payload, fault), a row per record of
    the archive, continuations joined to their origin.  `length` is that of the block; the payload and
    its digest are those of the bytes read (of revisits, what they say), and the payload is null
    unless `payloads` is set.  A continuation without its first segment is a row with a fault."""
    raw = raw_records(spark, folder)
    if foreign:
        torn = torn_files(spark, folder)
        if torn:
            raw = raw.where(~F.col("file").isin(torn)).unionByName(_whole_files(spark, torn))
    cut = F.col("head").contains("\r\nwarc-segment-number:") | F.col("head").contains("\r\nwarc-segment-origin-id:")
    weight = lambda row: len(row["payload"] or b"")

    def alone(batches):
        def rows():
            for batch in batches:
                for raw_bytes in batch.column("raw").to_pylist():
                    got = parsed(raw_bytes)
                    record = Record(got["fields"], payloads)
                    _revisit_length(record.fields, got["block"])
                    record.add(got["block"])
                    yield record.row()
        yield from _batched(rows(), _SCHEMA, weight)

    pieces = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("raw", pa.binary())])

    def numbered(batches):
        def rows():
            for batch in batches:
                for raw_bytes in batch.column("raw").to_pylist():
                    f = parsed(raw_bytes)["fields"]
                    number, total = f.get("warc-segment-number", ""), f.get("warc-segment-total-length", "")
                    yield {"origin": f.get("warc-segment-origin-id") or f.get("warc-record-id", ""), "number": int(number) if number.isdecimal() else None,
                           "total": int(total) if total.isdecimal() else None, "raw": raw_bytes}
        yield from _batched(rows(), pieces, lambda r: len(r["raw"]))

    def joined(batches):
        def rows():
            record, origin, total, last = None, None, None, None

            def done():
                if not record.fault and total is None:
                    record.fault = "last segment missing"
                if not record.fault and total != record.blocks:
                    record.fault = "total length differs"
                return record.row()

            for batch in batches:
                for key, number, end, raw_bytes in zip(*(batch.column(c).to_pylist() for c in pieces.names)):
                    got = parsed(raw_bytes)
                    if record is None or key != origin:
                        if record is not None:
                            yield done()
                        record, origin, total, last = Record(got["fields"] if number == 1 else None, payloads), key, None, 0
                    if number is None or number != last + 1:
                        record.fault = record.fault or ("segment repeated" if number == last else "segment missing")
                    elif total is not None:
                        record.fault = record.fault or "segment behind the last"
                    last = number if number is not None else last
                    total = end if end is not None else total
                    record.add(got["block"])
            if record is not None:
                yield done()

        yield from _batched(rows(), _SCHEMA, weight)

    parts = raw.where(cut).select("raw").mapInArrow(numbered, "origin string, number long, total long, raw binary")
    ordered = parts.repartition(group_count(raw, 1), "origin").sortWithinPartitions("origin", "number")
    return raw.where(~cut).select("raw").mapInArrow(alone, _OUT).unionByName(ordered.mapInArrow(joined, _OUT))


_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f"""


@query("op12_segment_reassembly", _SQL)
def op12_segment_reassembly(spark, sf_dir):
    folder = runtime.scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
