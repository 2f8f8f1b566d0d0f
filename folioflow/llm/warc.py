"""WARC: writing pages as archives, and a salvage reader.

Writing is one text write: each row is a record, the record separator is the line separator. Equal payloads
of at least `min_bytes` are stored once: the page with the largest id is the response, the others
revisit it.

The reader walks an archive (plain, or gzip members) record by record. A record counts only if all its
checks hold: version line, header lines (folded ones too), length, terminator, block and payload digests (sha1, md5, sha256 or sha512, in hex,
base32 or base64; the payload digests of revisits and of truncated records are those of other bytes, and digests of other kinds aren't checked). After a failure it
searches on for the next place where a whole valid member or record starts, takes up there, and
logs the bytes between as a gap. A file is read by one task, so the writer rolls archives at `archive_bytes`; foreign archives of gigabytes
take a task of that memory each, and files beyond 2 GB can't be read (binaryFile's limit).

Defined results: a null html is an empty payload; a null id is written as such and read back as null, and yields
to any other id; rows with equal id and payload are alike (both response or both revisit); pages with equal
payloads and no id are all responses; a null url writes no target; an empty table gives archives without
records; columns other than the three named ones are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import cut, tidy

#: Rows of the table of repeated payloads up to which it is broadcast (about 60 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
#: What a task may hold: bytes that a gzip member may unpack to, and of a record's head. What is larger is no record but a logged gap, so that it can be read otherwise.
MEMBER_BYTES, HEAD_BYTES = 1 << 30, 1 << 20

_HEAD_END = b"\r\n\r\n"
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Digests that are checked, with their bytes.
_DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
_FIELD = re.compile(rb"([!#-'*+\-.0-9A-Z^-z|~]+):[ \t]*([^\r\n]*)\Z")


# ---------------------------------------------------------------- writing


def with_records(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", keep: list[str] | None = None) -> DataFrame:
    """(id, record, and columns of pages to keep): the WARC record of every page, without the final separator."""
    rows = pages.select(*(keep or []), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    repeated = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = cut(repeated.where("n > 1 and first_id is not null").select(F.col("digest").alias("_digest"), "first_id"))
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, (rows["digest"] == repeated["_digest"]) & (rows["size"] >= min_bytes), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    crlf, urn = "\r\n", lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("size").cast("string"), F.lit(crlf + crlf))
    url = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    block_size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{crlf}WARC-Record-ID: "), urn(F.col("id")), F.lit(f"{crlf}WARC-Date: {date}"),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), url)),
        F.when(revisit, F.concat(F.lit(f"{crlf}WARC-Refers-To: "), urn(F.col("first_id")), F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{crlf}Content-Type: application/http;msgtype=response{crlf}Content-Length: "), block_size.cast("string"), F.lit(crlf + crlf), http,
    )
    return rows.select(*(keep or []), "id", F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))).alias("record"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 16 << 20, html_col: str = "html", **options) -> None:
    """Write the pages as plain WARC files of at most about archive_bytes each, or one record.

    Spark rolls files by rows, so pages are written by classes of size, four times as large each, and a file of a class has as many rows as its largest
    would fill. Classes without pages cost nothing.
    """
    size = F.coalesce(F.octet_length(html_col), F.lit(0)) + 1_000
    level = F.greatest(F.lit(0), F.ceil(F.log2(size / 4096.0) / 2)).cast("int")
    present = sorted(r[0] for r in pages.select(level.alias("l")).distinct().collect())  # a dozen classes at most
    records = with_records(pages.withColumn("_level", level), html_col=html_col, keep=["_level"], **options)
    for k in present or [0]:
        some = records.where(F.col("_level") == k).select("record") if len(present) > 1 else records.select("record")
        some.write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, archive_bytes >> (12 + 2 * k))).text(path)


# ---------------------------------------------------------------- reading


def _digest(said: str) -> tuple[str, bytes | None]:
    """(algorithm, bytes) of a digest as headers say it, algorithm:value; None for a value in none of the three encodings."""
    name, _, value = said.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in _DIGESTS:
        return name, None
    size, bare = _DIGESTS[name], value.rstrip("=")
    try:
        if len(bare) == 2 * size:
            return name, bytes.fromhex(bare)
        if len(bare) == -(-size * 8 // 5):
            return name, base64.b32decode(bare.upper() + "=" * (-len(bare) % 8))
        if len(bare) == -(-size * 8 // 6):
            return name, base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except ValueError:
        pass
    return name, None


def _refuted(said: str | None, data: bytes) -> bool:
    """Whether a digest header doesn't hold for the data; one of an unknown algorithm refutes nothing."""
    if not said:
        return False
    name, value = _digest(said)
    return name in _DIGESTS and hashlib.new(name, data).digest() != value


def _record_at(data: bytes, at: int) -> tuple[int, dict] | None:
    """(end, fields) of the record that starts here, or None if a check fails."""
    v = _VERSION.match(data, at)
    end = data.find(_HEAD_END, at, at + HEAD_BYTES) if v else -1
    if end < 0:
        return None
    fields = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", data[v.end() : end]).split(b"\r\n"):
        m = _FIELD.match(line)
        if not m:
            return None
        fields[m[1].lower().decode()] = m[2].strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit() or not {"warc-type", "warc-record-id"} <= fields.keys():
        return None
    start = end + 4
    stop = start + int(size)
    if stop > len(data) or data[stop : stop + 4] != _HEAD_END:
        return None
    block = data[start:stop]
    fields["payload"] = payload = block.partition(_HEAD_END)[2] if fields.get("content-type", "").startswith("application/http") else block
    fields["http"] = block[: len(block) - len(payload)]
    if _refuted(fields.get("warc-block-digest"), block):
        return None
    if fields["warc-type"] != "revisit" and "warc-truncated" not in fields and _refuted(fields.get("warc-payload-digest"), payload):
        return None
    return stop + 4, fields


def _member_at(data: bytes, at: int) -> tuple[int, bytes] | None:
    """(end, content) of the gzip member that starts here, or None."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(memoryview(data)[at:], MEMBER_BYTES)
    except zlib.error:
        return None
    return (len(data) - len(d.unused_data), out) if d.eof else None


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None]]:
    """(offset, end, fields) of every record; fields is None for a quarantined gap. Nothing is left out: gaps and records cover the file."""
    at = bad = 0  # bytes from bad to at are not accounted for
    while at < len(data):
        m = _START.match(data, at)
        found = None
        if m and data[at] == 0x1F:
            member = _member_at(data, at)
            if member:
                inner = list(salvage(member[1]))
                if any(f for _, _, f in inner):
                    found = member[0], [(at, member[0], f) for _, _, f in inner]
        elif m:
            record = _record_at(data, at)
            if record:
                found = record[0], [(at, record[0], record[1])]
        if found:
            if bad < at:
                yield bad, at, None
            yield from found[1]
            at = bad = found[0]
        else:
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
    if bad < len(data):
        yield bad, len(data), None


_SCHEMA = "path string, offset long, length long, kind string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record (kind `record`) and per quarantined run of bytes (kind `gap`) of all files under path.

    payload_digest and payload_bytes are those of the full payload: computed where the payload is
    there, said by the header and the stored HTTP head of a revisit.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def one(name: str, offset: int, end: int, f: dict | None) -> tuple:
        if f is None:
            return name, offset, end - offset, "gap", None, None, None, None, None, None, None
        kind, (name_of, value) = f["warc-type"], _digest(f.get("warc-payload-digest", ""))
        said = value.hex() if value and name_of == "sha1" else None
        size = len(f["payload"])
        if kind == "revisit":
            m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", f["http"])
            digest, size = said, int(m[1]) if m else None
        else:
            digest = said if said and "warc-truncated" not in f else hashlib.sha1(f["payload"]).hexdigest()
        return name, offset, end - offset, "record", kind, f["warc-record-id"], f.get("warc-target-uri"), f.get("warc-refers-to"), digest, size, f["payload"] if with_payload else None

    names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for x in salvage(bytes(data)):
                    rows.append(one(name, *x))
                    size += rows[-1][2]
                    if size > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(tidy(work), _SCHEMA)


def page_number(urn_col: str):
    """Column: the id inside <urn:page:id>, null if there is none."""
    return F.nullif(F.regexp_extract(urn_col, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
