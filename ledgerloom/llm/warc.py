"""WARC archives compressed with Zstandard: one frame for each record, and a dictionary in a leading skippable frame.

The writer packs records into archives of about ``ARCHIVE`` bytes each. It trains a dictionary on
the archive's own payloads, puts it (compressed) into a skippable frame at the start, and
compresses each record, a ``warcinfo`` record first, as a frame of its own with that dictionary.
Of equal payloads one record is the response and the others are revisits: they keep the HTTP header,
the payload's digest and a reference, and no payload.

The reader loads the dictionary from the leading skippable frame, finds each frame's end by its block
headers, decodes it, and validates version, header lines, mandatory fields, content length,
and block and payload digests. What fails is told in ``error`` and never stops the other
records, but for a frame whose end can't be found, which ends its archive. Archives are rows
(name, content), as Spark's ``binaryFile`` source gives for files; the writer's archives are a table of such
rows, which Spark commits, so a lost executor leaves no half-written ones. ``export`` copies them into files.

A null or empty html is an empty payload; a null url leaves out the target URI. Control characters and spaces in a url
are percent-encoded, as they would end a header. A null page_id counts as smaller than any other; if
repeated rows share the response's page_id, all of them are responses. A payload of any length is a record; one longer than
``ARCHIVE`` has an archive of its own. Empty tables give no archives. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, table

#: Bytes of records in an archive, of a dictionary, of payloads that it is trained on; compression level; longest record that the reader decodes.
ARCHIVE, DICTIONARY, TRAINING, LEVEL, LONGEST = 8 << 20, 16 << 10, 1 << 20, 3, 1 << 30
#: Fixed values of the formats: magic numbers of frames and dictionaries, versions, revisit profile, record types that a reader knows.
SKIPPABLE, FRAME, TRAINED = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION, VERSIONS = "WARC/1.1", ("WARC/1.0", "WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
URN = "urn:ledgerloom:page:"
DATE = "1970-01-01T00:00:00Z"
ARCHIVES = "name string, content binary"
RECORDS = "archive string, offset bigint, record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes bigint, payload binary, error string"
EMPTY = base64.b32encode(hashlib.sha1(b"").digest()).decode()


class Damaged(ValueError):
    """What is wrong with a frame or record."""


# --- writing


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7F-\xA0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def urn(page_id: int | None) -> str:
    return f"<{URN}{'' if page_id is None else page_id}>"


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record: version, fields in order (null ones left out), block."""
    lines = [VERSION, *[f"{k}: {v}" for k, v in fields if v is not None], f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, response: bool, refers_to: int | None, date: str) -> bytes:
    """A page as response, or as revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url and escaped(url))]
    fields.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if not response:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    return record([*fields, ("Content-Type", "application/http; msgtype=response")], http + payload if response else http)


def dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary trained on the first ``TRAINING`` bytes of payloads; where they are too few to train on, a plain record's text."""
    samples, size = [], 0
    for p in payloads:
        if size >= TRAINING:
            break
        if p:
            samples.append(p[: TRAINING - size])
            size += len(samples[-1])
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return page_record(0, "http://example.org/", b"<!DOCTYPE html><html><head><title></title></head><body></body></html>", True, None, DATE)


def archive(records: list[bytes], trained: bytes) -> bytes:
    """An archive of records: the dictionary in a skippable frame, then one frame with checksum for each record."""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
    frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
    return b"".join([SKIPPABLE.to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed, *map(frames.compress, records)])


def written(rows: DataFrame, date: str = DATE) -> DataFrame:
    """(name, content): archives of ``rows`` (page_id, url, html, response, refers_to). Names come from the contents, so a repeated task makes the same ones."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, payloads, size = [], [], 0

        def flush() -> pa.RecordBatch:
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:sha1:{digest(b''.join(r[-40:] for r in held))}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: ledgerloom\r\nformat: WARC file version 1.1\r\n")
            content = archive([info, *held], dictionary(payloads))
            return pa.record_batch([pa.array([f"{hashlib.sha256(content).hexdigest()}.warc.zst"]), pa.array([content], pa.binary())], names=["name", "content"])

        for batch in slices(batches, "html", ARCHIVE):
            for r in batch.to_pylist():
                payload = (r["html"] or "").encode()
                held.append(page_record(r["page_id"], r["url"], payload, r["response"], r["refers_to"], date))
                payloads.append(payload if r["response"] else b"")
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield flush()
                    held, payloads, size = [], [], 0
        if held:
            yield flush()

    return rows.select("page_id", "url", "html", "response", "refers_to").mapInArrow(pack, ARCHIVES)


def linked(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, response, refers_to): of pages with equal payloads the one with the largest page_id is the response, the others refer to it."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("key", F.sha2("html", 256))
    groups = own.groupBy("key").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "kept", F.lit(True).alias("many"))
    met = own.join(table(groups, "payloads"), "key", "left")  # payloads that occur once aren't in the table; it is small beside the texts
    response = F.col("many").isNull() | F.col("page_id").eqNullSafe(F.col("kept"))
    return met.select("page_id", "url", "html", response.alias("response"), F.when(~response, F.col("kept")).alias("refers_to"))


def write(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Archives (name, content) of ``pages`` as a table in the shared folder, one record for each row."""
    return table(written(linked(pages), date), "archives")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Copy archives into files below ``folder`` (any URI that pyarrow opens), in tasks: (name, bytes). A file appears whole, by a rename; names come
    from contents, so a repeated task replaces a file by its equal."""
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{base}/{name}")
                yield pa.record_batch([pa.array([name]), pa.array([len(content)], pa.int64())], names=["name", "bytes"])

    return archives.select("name", "content").mapInArrow(copy, "name string, bytes bigint")


# --- reading


def number(data: memoryview, at: int, size: int) -> int:
    if at + size > len(data):
        raise Damaged("the archive ends within a frame")
    return int.from_bytes(data[at : at + size], "little")


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by its header and block headers."""
    magic = number(data, at, 4)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + number(data, at + 4, 4)
    elif magic == FRAME:
        flags = number(data, at + 4, 1)
        single, content = flags >> 5 & 1, flags >> 6
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single if content == 0 else 1 << content)
        last = False
        while not last:
            head = number(data, end, 3)
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise Damaged("a block of unknown kind")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    else:
        raise Damaged("no frame where one should start")
    if end > len(data):
        raise Damaged("the archive ends within a frame")
    return end


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame (compressed or plain) and where the records start; none if there is no such frame."""
    if len(data) < 8 or number(data, 0, 4) != SKIPPABLE:
        return None, 0
    end = frame_end(data, 0)
    held = bytes(data[8:end])
    if held[:4] == FRAME.to_bytes(4, "little"):
        held = decoded(zstandard.ZstdDecompressor(), held, "dictionary")
    if not held:
        return None, end
    return zstandard.ZstdCompressionDict(held), end


def decoded(decoder: zstandard.ZstdDecompressor, frame: bytes, what: str) -> bytes:
    """The whole content of one frame, up to ``LONGEST`` bytes."""
    try:
        if zstandard.frame_content_size(frame) > LONGEST:
            raise Damaged(f"{what} is longer than {LONGEST} bytes")
        stream = decoder.stream_reader(frame)
        data = stream.read(LONGEST + 1)
    except zstandard.ZstdError as e:
        raise Damaged(f"{what} can't be decoded: {e}") from e
    if len(data) > LONGEST:
        raise Damaged(f"{what} is longer than {LONGEST} bytes")
    return data


def headers_of(head: bytes, what: str) -> tuple[str, dict[str, str]]:
    """The first line and the named fields (lower-case names; the first of repeated ones) of a header; folded lines are joined."""
    try:
        first, *lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise Damaged(f"{what} header isn't UTF-8") from e
    fields: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t"):
            if name:
                fields[name] = f"{fields[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Damaged(f"{what} header line without a name")
        if name in fields:
            name = None  # a repeated field: the first counts
        else:
            fields[name] = value.strip()
    return first, fields


def length_of(fields: dict[str, str], what: str) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", value):
        raise Damaged(f"{what} without a content length")
    return int(value)


def checked(value: str | None, data: bytes, what: str) -> str | None:
    """The bare digest of a field, after it is held against ``data``."""
    if value is None:
        return None
    kind, _, text = value.partition(":")
    if kind.lower() != "sha1":
        return text or None  # another algorithm: kept, not checked
    if digest(data) != text.upper():
        raise Damaged(f"{what} digest differs")
    return text.upper()


def bare(value: str | None) -> str | None:
    return value if value is None else value.strip("<>")


def parsed(data: bytes) -> dict:
    """A record's fields and payload, validated."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    if not cut:
        raise Damaged("a record without an end of its header")
    version, fields = headers_of(head, "record")
    if version not in VERSIONS:
        raise Damaged("a record of unknown version")
    for name in MANDATORY:
        if not fields.get(name):
            raise Damaged(f"a record without {name}")
    kind = fields["warc-type"].lower()
    if kind not in TYPES:
        raise Damaged("a record of unknown type")
    size = length_of(fields, "record")
    block, end = rest[:size], rest[size:]
    if len(block) < size or end != b"\r\n\r\n":
        raise Damaged("the block isn't as long as its header says")
    checked(fields.get("warc-block-digest"), block, "block")
    payload, n, known = block, size, fields.get("warc-payload-digest")
    if fields.get("content-type", "").startswith("application/http"):
        head, cut, payload = block.partition(b"\r\n\r\n")
        if not cut:
            raise Damaged("an HTTP header without an end")
        _, http = headers_of(head, "HTTP")
        n = length_of(http, "HTTP") if "content-length" in http or kind == "revisit" else len(payload)
        if kind != "revisit" and n != len(payload):
            raise Damaged("the payload isn't as long as its HTTP header says")
    revisit = kind == "revisit"
    return {
        "record_type": kind, "record_id": bare(fields["warc-record-id"]), "target_uri": bare(fields.get("warc-target-uri")), "date": fields["warc-date"],
        "payload_digest": known.partition(":")[2].upper() if revisit and known else checked(known, payload, "payload"), "refers_to": bare(fields.get("warc-refers-to")),
        "payload_bytes": n, "payload": None if revisit else payload, "error": None,
    }


def records_in(name: str | None, content: bytes | None, payload: bool) -> Iterator[dict]:
    """All records of one archive with the offsets of their frames; what can't be read has an error instead of fields."""
    data, at = memoryview(content or b""), 0
    blank = dict.fromkeys(("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "payload_bytes", "payload", "error")) | {"archive": name}
    try:
        held, at = load_dictionary(data)
        decoder = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()
        while at < len(data):
            end = frame_end(data, at)
            if number(data, at, 4) == FRAME:
                try:
                    found = parsed(decoded(decoder, bytes(data[at:end]), "record"))
                except Damaged as e:
                    found = {"error": str(e)}
                if not payload:
                    found["payload"] = None
                yield blank | {"offset": at} | found
            at = end
    except (Damaged, zstandard.ZstdError) as e:
        yield blank | {"offset": at, "error": str(e)}


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of ``archives`` (name, content), with their payloads or, with ``payload=False``, only what was checked of them."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                rows, size = [], 0
                for r in records_in(name.as_py(), content.as_py(), payload):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if len(rows) >= 4096 or size >= ARCHIVE:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("name", "content").mapInArrow(run, RECORDS)


def from_files(spark, pattern: str) -> DataFrame:
    """Archives (name, content) of files, through Spark's reader; a file is one row of at most 2 GB."""
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("name"), "content")


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits with their payloads: a revisit gets that of the record it refers to (null, if that record isn't there)."""
    pages = records.where(F.col("record_type").isin("response", "revisit"))
    bodies = pages.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload").alias("_body")).dropDuplicates(["_id"])
    wanted = F.when(F.col("record_type") == "revisit", F.col("refers_to"))  # a response's null key meets nothing
    return pages.withColumn("_id", wanted).join(bodies, "_id", "left").withColumn("payload", F.coalesce("payload", "_body")).drop("_id", "_body")


def archived(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error) of every page, from its record as read back."""
    page = lambda c: F.when(F.col(c).startswith(URN), F.expr(f"try_cast(substring({c}, {len(URN) + 1}) AS bigint)"))
    kept = write(pages)
    found = read(kept, payload=False).where(~F.col("record_type").eqNullSafe("warcinfo"))
    found = table(found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "error"), "records")
    release(kept)
    return found


#: DuckDB SQL for ``archived`` over ``pages``; a digest's 160 bits make 32 letters of 5 bits.
ORACLE_SQL = """
WITH own AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages),
told AS (SELECT *, sha1(h) AS hex, page_id IS NOT DISTINCT FROM kept AS response FROM own)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, i // 4 * 5 + 1, 5))::BIGINT >> (15 - i % 4 * 5)) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT response THEN kept END AS refers_to, NULL::VARCHAR AS error
FROM told
"""
