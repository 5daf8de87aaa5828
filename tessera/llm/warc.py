"""WARC archives: one gzip member a record, written by tasks and read back sequentially.

Edge cases.  A null payload is empty; a null id is written as ``null`` and read back as null.  Among rows
of one payload that tie for the largest id (repeated rows) all are responses; the rest revisit that id, and
where every id is null all are responses.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import exact, filesystem, salted_left_join, shared_dir, utf8

#: Profile of a revisit that repeats a payload (WARC 1.1); a fixed value.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "record_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan_records(df: DataFrame, id_col: str, uri_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Which row of each payload of ``min_bytes`` or more is stored whole, and whom the others point to."""
    rows = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(uri_col).cast("string").alias("uri"), utf8(payload_col).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_bytes)
    repeated = large.groupBy("sha1").agg(F.max("record_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    planned = salted_left_join(rows, repeated, ["sha1"], F.struct("record_id", "uri"))
    revisits = F.col("keeper").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("keeper")) & (F.octet_length("payload") >= min_bytes)
    return planned.select("record_id", "uri", "payload", F.when(revisits, F.col("keeper")).alias("refers_to"))


def _urn(record_id: int | None) -> str:
    return f"<urn:record:{'null' if record_id is None else record_id}>"


def encode_record(record_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, level: int = 4) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP head, with the payload's length, and no payload."""
    digest = sha1_base32(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(record_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]+", "%20", uri or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        *([] if refers_to is None else [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, folder: str, target_bytes: int = 256 << 20) -> DataFrame:
    """Write planned records as ``.warc.gz`` files below ``folder``; returns the manifest, one row a file.

    Tasks choose fresh names, and only files of tasks that ended well enter the written manifest, so a task
    that ran twice leaves an unlisted file and no record twice.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = filesystem(folder)
        files.create_dir(f"{root}/archives", recursive=True)
        out = None
        for batch in batches:
            for record_id, uri, payload, refers_to in zip(batch["record_id"], batch["uri"], batch["payload"], batch["refers_to"], strict=True):
                if out is None:
                    path, n, size = f"{root}/archives/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path)
                whole = [None if pd.isna(x) else int(x) for x in (record_id, refers_to)]
                data = encode_record(whole[0], uri, bytes(payload), whole[1])
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= target_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "n_records": [n], "n_bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "n_records": [n], "n_bytes": [size]})

    rows = records.withColumns({c: exact(c) for c in ("record_id", "refers_to")})
    rows.mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return records.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, each inflated piece by piece; a cut member is an error."""
    unpack, piece, parts = zlib.decompressobj(31), b"", []
    while True:
        piece = piece or stream.read(chunk)
        if not piece:
            break
        parts.append(unpack.decompress(piece))
        piece = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if any(parts) or unpack.unconsumed_tail:
        raise ValueError("the archive ends inside a member")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record; the block is what Content-Length frames, and its digest must hold."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])}
    size = int(fields["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: content length {size} does not frame the block")
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"{fields.get('warc-record-id')}: block digest mismatch")
    return fields, block


def _id(urn: str | None) -> int | None:
    value = urn and urn.removeprefix("<urn:record:").removesuffix(">")
    return None if value in (None, "null") else int(value)


def read_archive(stream) -> Iterator[tuple]:
    """The records of one archive in order, as RECORDS; digests are verified."""
    for data in members(stream):
        fields, block = parse_record(data)
        head, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        kind = fields["warc-type"]
        if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
            raise ValueError(f"{fields['warc-record-id']}: payload length or digest mismatch")
        yield _id(fields["warc-record-id"]), fields["warc-target-uri"], kind, _id(fields.get("warc-refers-to")), size, digest, payload if kind == "response" else None


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the listed archives, a task a file; ``payloads=False`` drops the bytes after the checks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for path, expected in zip(batch["path"], batch["n_records"], strict=True):
                files, inner = filesystem(path) if "://" in path else (here, path)
                rows, seen, held = [], 0, 0
                with files.open_input_stream(inner) as stream:
                    for record in read_archive(stream):
                        rows.append(record if payloads else (*record[:-1], None))
                        seen, held = seen + 1, held + (len(record[-1] or b"") if payloads else 64)
                        if held > 16 << 20:
                            yield frame(rows, names)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{path}: {seen} records of {expected}")
                if rows:
                    yield frame(rows, names)

    def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"record_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    here = filesystem(manifest.inputFiles()[0])[0] if manifest.inputFiles() else None
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInPandas(read, RECORDS)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page as a record below a new shared folder and read the archives back."""
    folder = shared_dir(pages.sparkSession, "warc")
    manifest = write_archives(plan_records(pages, "page_id", "url", "html", min_bytes), folder)
    back = read_archives(manifest, payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
