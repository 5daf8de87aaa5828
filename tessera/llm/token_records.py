"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record file is a run of frames: payload length (8 bytes), masked CRC-32 of those bytes (4), payload, masked
CRC-32 of the payload (4); all little-endian.  A payload is a null flag (1 byte), the document id (8) and the ids,
2 bytes each where the vocabulary allows it, else 4.  The index beside it has 24 bytes a record: the frame's offset,
its payload's length and the number of ids.  Files follow each other in ascending document id.

Edge cases.  A null text is empty: only the end id; null ids come first; rows of one id are ordered by a hash of
their text, equal rows follow each other; an empty table gives no files and an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import filesystem, per_worker, shared_dir, text_slices

MANIFEST = "part long, path string, n_docs long, n_ids long"
SEQUENCES = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Added to a rotated CRC so that checksums stored within checksummed data stay apart; a fixed value of the record format.
MASK_DELTA = 0xA282EAD8
#: Words that a task keeps encoded at most, before it begins anew.
KEPT_WORDS = 700_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def read_frames(stream) -> Iterator[bytes]:
    """Payloads in order; a bad checksum or a cut frame is an error."""
    while head := stream.read(12):
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("damaged record length")
        n = struct.unpack("<Q", head[:8])[0]
        body = stream.read(n + 4)
        if len(body) != n + 4 or masked_crc(body[:n]) != struct.unpack("<I", body[n:])[0]:
            raise ValueError("damaged record")
        yield body[:n]


class _Places(dict):
    """Places of pieces in order of their first sight; ``new`` has those not yet encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = out = len(self)
        self.new.append(piece)
        return out


class WordEncoder:
    """Encodes whole texts by way of their pieces, each of which the tokenizer sees once.

    The tokenizer normalises and splits without regard to what lies beyond white space, and drops it, so a text's
    ids are its white-space separated pieces' ids in a row.  Where a text has only characters of ``PLAIN``, which
    normalisation just lowers, its pieces are the tokenizer's own, cut by the tokenizer's pattern.
    """

    PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.place = _Places()
        self.starts, self.lengths, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.n = self.n_ids = 0

    def _pieces(self, text: str) -> list[str]:
        if self.PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.PIECE.findall(text.lower())
        return [p.decode() for p in text.encode().split()]

    def _learn(self) -> None:
        new, self.place.new = self.place.new, []
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter((i for e in encoded for i in e), np.uint32, int(counts.sum()))
        while len(self.starts) < self.n + len(new):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while len(self.ids) < self.n_ids + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[self.n : self.n + len(new)] = self.n_ids + np.cumsum(counts) - counts
        self.lengths[self.n : self.n + len(new)] = counts
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + len(new), self.n_ids + len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if self.n > KEPT_WORDS:
            self.clear()
        pieces = [self._pieces(t) for t in texts]
        edges = np.cumsum([0, *map(len, pieces)])
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(pieces)), np.int64, int(edges[-1]))
        if self.place.new:
            self._learn()
        n = self.lengths[at]
        ends = np.cumsum(n)
        out = self.ids[np.repeat(self.starts[at] - (ends - n), n) + np.arange(int(n.sum()))]
        before = np.concatenate([[0], ends])
        return out, before[edges[1:]] - before[edges[:-1]]


def write_records(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encode all texts, write record and index files below ``folder`` in order of doc_id; returns the manifest.

    Only texts are shuffled, by ranges of id.  A task that runs twice writes files of another name; the manifest
    lists those of the task that ended well.
    """
    tokenizer_json = Path(tokenizer_path).read_text(encoding="utf-8")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"words {hash(tokenizer_json)}", lambda: WordEncoder(tokenizer_json))
        out = None
        width = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        files, root = filesystem(folder)
        files.create_dir(f"{root}/records", recursive=True)
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                ids, counts = encoder.encode(part.column("text").to_pylist())
                ids = ids.astype(width)
                frames, index, at = [], [], 0
                if out is None:
                    number, path, offset, n_docs, n_ids = part.column("part")[0].as_py(), f"{root}/records/{uuid.uuid4().hex}", 0, 0, 0
                    out, idx = files.open_output_stream(f"{path}.rec"), files.open_output_stream(f"{path}.idx")
                for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    key = struct.pack("<bq", 1, 0) if doc_id is None else struct.pack("<bq", 0, doc_id)
                    payload = key + ids[at : at + n].tobytes() + np.array([end_id], width).tobytes()
                    frames.append(frame(payload))
                    index.append(struct.pack("<QQQ", offset, len(payload), n + 1))
                    offset, at, n_docs, n_ids = offset + len(payload) + 16, at + n, n_docs + 1, n_ids + n + 1
                out.write(b"".join(frames))
                idx.write(b"".join(index))
        if out is not None:
            out.close()
            idx.close()
            yield pa.RecordBatch.from_pydict({"part": [number], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return documents.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_records(manifest: DataFrame, end_id: int) -> DataFrame:
    """The sequences of all listed files, a task a file, checked against frames and index."""
    inputs = manifest.inputFiles()
    files = filesystem(inputs[0])[0] if inputs else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, n_docs, n_ids in zip(batch["path"], batch["start"], batch["n_docs"], batch["n_ids"], strict=True):
                with files.open_input_stream(f"{path}.idx") as stream:
                    index = np.frombuffer(stream.read(), "<u8").reshape(-1, 3)
                rows, at, offset = [], int(start), 0
                with files.open_input_stream(f"{path}.rec") as stream:
                    for payload, (place, size, n) in zip(read_frames(stream), index, strict=True):
                        width = (len(payload) - 9) // int(n)
                        ids = np.frombuffer(payload, f"<u{width}", offset=9)
                        if (place, size, n) != (offset, len(payload), len(ids)) or ids[-1] != end_id:
                            raise ValueError(f"{path}: index and records differ at {offset}")
                        null, doc_id = struct.unpack_from("<bq", payload)
                        rows.append((None if null else doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at, offset = at + len(ids), offset + len(payload) + 16
                if (len(rows), at) != (n_docs, start + n_ids):
                    raise ValueError(f"{path}: the manifest has {n_docs} records of {n_ids} ids")
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    begun = manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))
    return begun.repartition(max(1, manifest.count())).mapInPandas(read, SEQUENCES)


def read_sequence(path: str, number: int) -> np.ndarray:
    """Ids of one record by way of the index: what a shuffled reader does."""
    files, inner = filesystem(path)
    with files.open_input_file(f"{inner}.idx") as stream:
        offset, size, n = struct.unpack("<QQQ", stream.read_at(24, 24 * number))
    with files.open_input_file(f"{inner}.rec") as stream:
        payload = next(read_frames(_Piece(stream.read_at(size + 16, offset))))
    return np.frombuffer(payload, f"<u{(len(payload) - 9) // n}", offset=9)


class _Piece:
    def __init__(self, data: bytes):
        self.data = data

    def read(self, n: int) -> bytes:
        out, self.data = self.data[:n], self.data[n:]
        return out


def token_output(documents: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all documents as records below a new shared folder and read the files back."""
    folder = shared_dir(documents.sparkSession, "tokens")
    return read_records(write_records(documents, folder, tokenizer_path, end_id), end_id)
