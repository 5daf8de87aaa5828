"""Removal of every byte that a repeated ``LENGTH``-byte string covers, by column-wise suffix sorting.

Each window of ``LENGTH`` bytes owns an anchor: the ``SEED`` bytes within it whose hash is least, leftmost on ties.
Equal windows own equal anchors at equal offsets.  So windows are dealt out by anchor, and within an anchor's
collection only suffixes that begin in the same column, counted from the anchor, can share ``LENGTH`` bytes.

A collection is the runs of windows of all documents around some anchors.  It is built column by column, from right
to left: each round inserts one symbol of each run in front of its suffix, in the place that the last round's
Burrows-Wheeler transform gives it (a stable sort of the transform's symbols within the anchor), and updates the common
prefixes of neighbours by range minima.  A round reads one column and the last round's state, in sequence, and nothing
else.  From the column on in which windows can begin, each round is appended to the collection's file in the shared
folder: suffix order, transform and common prefixes.  A second job reads these files in sequence; where a neighbour
shares ``LENGTH`` symbols, the window that begins in this column is repeated.  All that is removed is found there, but
for texts that stand twice as a whole.

Equal texts are one text, and equal runs of an anchor one run that stands twice in its collection, so that its
neighbour shares it.  The runs of an anchor with over ``HOT`` different ones are cut at fixed columns into runs of at
most ``WIDTHS`` windows, which are dealt by the bytes that all windows of a cut share; at one window these are the
window itself.  So no anchor's runs all meet in one task, and none is left out.

Edge cases.  A null text is empty; texts shorter than ``LENGTH`` bytes lose nothing; rows that repeat a text, with
equal or null ids too, repeat each other; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import exact, filesystem, scratch, scratch_dir, written

LENGTH, SEED = 400, 64
SPAN = LENGTH - SEED + 1  # places of an anchor within a window
COLUMNS = SPAN - 1 + LENGTH
#: Different runs of an anchor up to which they are one group; windows of a cut of larger ones, in turn.
HOT, WIDTHS = 500, (48, 1)
#: Places up to which those of one run may meet in one task; above, the run's range goes to the tasks that hold them.
COMMON = 2_000
#: Bytes that a task hashes at a time, and runs that it sorts at a time.
PIECE, ROWS = 1 << 20, 8192
END = 255  # a byte that UTF-8 never has
_BASE = 0x9E3779B97F4A7C15 | 1
RUNS = "key binary, start int, n int, left int, anchor long, run binary"
KINDS = "anchor long, run binary, left int, data binary, twice boolean"
MARKS = "anchor long, run binary, low int, high int"
#: A round of a collection: the suffix order, the transform's symbols and the prefix shared with the neighbour before.
ROUND = pa.schema([("order", pa.uint32()), ("bwt", pa.uint8()), ("shared", pa.uint16())])


class Anchors:
    """Finds the runs of windows that own one anchor."""

    def __init__(self) -> None:
        size = 2 * PIECE + LENGTH
        with np.errstate(over="ignore"):
            self.power, self.inverse = (np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))

    def runs(self, parts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, bytes]]:
        """(part, start, windows, anchor's offset, anchor, bytes) of all runs; the parts hold 2 * PIECE bytes at most."""
        whole = b"".join(parts)
        if len(whole) < LENGTH:
            return
        data = np.frombuffer(whole, np.uint8)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)])
            h = (sums[SEED:] - sums[:-SEED]) * self.inverse[: len(data) - SEED + 1]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        low = np.uint64(0xFFFFFFFF)
        ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        n = -(-len(ranked) // SPAN)
        grid = np.full(n * SPAN, np.iinfo(np.uint64).max, np.uint64)
        grid[: len(ranked)] = ranked
        grid = grid.reshape(n, SPAN)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(data) - LENGTH + 1
        at = (np.minimum(behind[:m], ahead[SPAN - 1 : SPAN - 1 + m]) & low).astype(np.int64)
        begin = np.cumsum([0, *map(len, parts)])
        fits = np.zeros(m + 1, bool)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            fits[a : max(a, b - LENGTH + 1)] = True
        other = np.concatenate([[True], at[1:] != at[:-1], [True]])
        first = np.flatnonzero(fits[:-1] & (other[:-1] | ~np.concatenate([[False], fits[:-2]])))
        last = np.flatnonzero(fits[:-1] & (other[1:] | ~fits[1:]))
        part = np.searchsorted(begin, first, side="right") - 1
        hashes = h.view(np.int64)[at[first]]
        for p, s, e, a, x in zip(part.tolist(), first.tolist(), last.tolist(), at[first].tolist(), hashes.tolist(), strict=True):
            yield p, s - int(begin[p]), e - s + 1, a - s, x, whole[s : e + LENGTH]


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(exact("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def found_runs(documents: DataFrame) -> DataFrame:
    """The runs of all documents; a long text is cut into pieces that share LENGTH - 1 bytes, so no window is lost."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Anchors()

        def rows(group: list[tuple[str, int, bytes]]) -> pd.DataFrame:
            out = [(group[p][0], group[p][1] + s, n, left, a, hashlib.blake2b(run, digest_size=16).digest()) for p, s, n, left, a, run in finder.runs([g[2] for g in group])]
            return pd.DataFrame(out, columns=[x.split()[0] for x in RUNS.split(", ")])

        group, size = [], 0
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                data = text.encode()
                for s in range(0, max(0, len(data) - LENGTH + 1), PIECE):
                    piece = data[s : s + PIECE + LENGTH - 1]
                    if group and size + len(piece) > PIECE + LENGTH:
                        yield rows(group)
                        group, size = [], 0
                    group.append((key, s, piece))
                    size += len(piece)
        if group:
            yield rows(group)

    return _keyed(documents).where(F.octet_length("text") >= LENGTH).select("key", "text").mapInPandas(make, RUNS)


def built(sink: pa.NativeFile, anchors: np.ndarray, left: np.ndarray, runs: list[bytes]) -> None:
    """Builds a collection and appends its rounds to ``sink``, a batch a column; equal anchors are adjacent."""
    rows = len(runs)
    table = np.full((rows, COLUMNS), END, np.uint8)
    for i, (a, run) in enumerate(zip(left.tolist(), runs, strict=True)):
        table[i, SPAN - 1 - a : SPAN - 1 - a + len(run)] = np.frombuffer(run, np.uint8)
    table = np.ascontiguousarray(table.T)
    begins = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    block = np.cumsum(begins).astype(np.int64) << 8
    order, shared = np.arange(rows), np.zeros(rows + 1, np.int32)  # shared[i]: of rows order[i - 1] and order[i]
    bwt = table[COLUMNS - 1]  # what stands before the suffixes, in their order
    with pa.ipc.new_stream(sink, ROUND, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
        for column in range(COLUMNS - 1, -1, -1):
            key = block + bwt
            moved = (key[1:] < key[:-1]).any()
            if moved:
                step = np.argsort(key, kind="stable")
                key, order = key[step], order[step]
            same = np.concatenate([[False], (key[1:] == key[:-1]) & (key[1:] & 255 != END)])
            least = shared[:-1]
            if moved:
                least = least.copy()
                pair = np.flatnonzero(same)
                p, q = step[pair - 1], step[pair]
                near = q - p == 1
                least[pair[near]] = shared[q[near]]
                far = ~near
                if far.any():
                    ends = np.stack([p[far] + 1, q[far] + 1], axis=1).ravel()
                    least[pair[far]] = np.minimum.reduceat(shared, ends)[::2]
            shared[:-1] = np.where(same, least + 1, 0)
            bwt = table[column - 1][order] if column else np.full(rows, END, np.uint8)
            if column < SPAN:
                arrays = [pa.array(order.astype(np.uint32)), pa.array(bwt), pa.array(shared[:-1].astype(np.uint16))]
                file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=ROUND))


def repeated(source: pa.NativeFile, rows: int) -> np.ndarray:
    """(rows, SPAN) marks of columns whose window a neighbour in the suffix order shares, from a collection's file."""
    out = np.zeros((SPAN, rows), bool)
    with pa.ipc.open_stream(source) as file:
        for column, batch in zip(range(SPAN - 1, -1, -1), file, strict=True):
            order, shared = batch.column("order").to_numpy(), batch.column("shared").to_numpy()
            long = np.append(shared >= LENGTH, False)
            if long.any():
                out[column, order] = long[:-1] | long[1:]
    return out.T


def marked(runs: DataFrame) -> DataFrame:
    """Ranges of repeated windows [from, to) of each run of (anchor, run, left, data, twice).

    Tasks build collections of whole anchors, about ``ROWS`` runs each, and write their files; others read them.
    """
    folder = scratch_dir(runs.sparkSession, "collections")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def collection(rows: list) -> pd.DataFrame:
            path = f"{folder}/{uuid.uuid4().hex}"
            each = [k for k, r in enumerate(rows) for _ in range(1 + r.twice)]
            fs, at = filesystem(path)
            fs.create_dir(at.rpartition("/")[0])
            with fs.open_output_stream(at) as sink:
                built(sink, np.array([rows[k].anchor for k in each]), np.array([rows[k].left for k in each]), [rows[k].data for k in each])
            once = np.concatenate([[0], np.cumsum([1 + r.twice for r in rows])[:-1]])
            return pd.DataFrame({"path": [path], "n": [len(each)], "rows": [[{"anchor": r.anchor, "run": r.run, "left": r.left, "at": a} for r, a in zip(rows, once.tolist(), strict=True)]]})

        held: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if len(held) >= ROWS and row.anchor != held[-1].anchor:
                    yield collection(held)
                    held = []
                held.append(row)
        if held:
            yield collection(held)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, n, rows in zip(batch["path"], batch["n"], batch["rows"], strict=True):
                fs, at = filesystem(path)
                with fs.open_input_stream(at) as source:
                    marks = repeated(source, n)[[r["at"] for r in rows]]
                change = np.diff(marks.astype(np.int8), axis=1, prepend=0, append=0)
                (i, a), (_, b) = np.nonzero(change == 1), np.nonzero(change == -1)
                begin = np.array([SPAN - 1 - r["left"] for r in rows], np.int64)[i]
                yield pd.DataFrame({"anchor": [rows[k]["anchor"] for k in i], "run": [rows[k]["run"] for k in i], "low": (a - begin).astype(np.int32), "high": (b - begin).astype(np.int32)})

    dealt = runs.repartition("anchor").sortWithinPartitions("anchor", "run")
    files = written(dealt.mapInPandas(build, "path string, n int, rows array<struct<anchor:long,run:binary,left:int,at:int>>"), "collections")  # those of tasks that ended
    return files.repartition("path").mapInPandas(read, MARKS)


def _bytes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, run, left, data, twice) of runs that are wanted from a text: wanted has key, start, n, left, anchor, run, twice."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, runs in zip(batch["text"], batch["runs"], strict=True):
                data = text.encode()
                out = [(r["anchor"], r["run"], r["left"], data[r["start"] : r["start"] + r["n"] - 1 + LENGTH], r["twice"]) for r in runs]
                yield pd.DataFrame(out, columns=["anchor", "run", "left", "data", "twice"])

    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "n", "left", "anchor", "run", "twice")).alias("runs"))  # of one text
    return texts.join(lists, "key").select("text", "runs").mapInPandas(make, KINDS)


def _cut(runs: DataFrame, width: int) -> DataFrame:
    """The runs cut at multiples of ``width`` columns, dealt by the bytes of a cut's common part; ``of`` and ``offset`` lead back."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = lambda x, n: hashlib.blake2b(x, digest_size=n, salt=width.to_bytes(4, "little")).digest()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                first, n = SPAN - 1 - r.left, len(r.data) - LENGTH + 1
                for k in range(first // width, (first + n - 1) // width + 1):
                    low, high = max(first, k * width), min(first + n, (k + 1) * width)
                    core = r.data[(k + 1) * width - 1 - first : k * width + LENGTH - first]
                    data = r.data[low - first : high - 1 + LENGTH - first]
                    key = int.from_bytes(digest(r.anchor.to_bytes(8, "little", signed=True) + k.to_bytes(4, "little") + core, 8), "little", signed=True)
                    rows.append((key, digest(low.to_bytes(4, "little") + data, 16), SPAN - 1 - low, data, r.twice, r.anchor, r.run, low - first))
            yield pd.DataFrame(rows, columns=["anchor", "run", "left", "data", "twice", "of_anchor", "of_run", "offset"])

    return runs.select("anchor", "run", "left", "data", "twice").mapInPandas(make, f"{KINDS}, of_anchor long, of_run binary, offset int")


def found_marks(kinds: DataFrame, width: int = 0) -> DataFrame:
    """Ranges of repeated windows of different runs (anchor, run, left, data, twice); ``width`` counts the cuts so far."""
    counts = written(kinds.groupBy("anchor").agg(F.count("*").alias("n_runs")).where(F.col("n_runs") > HOT).select("anchor"), "hot")
    if width == len(WIDTHS) or not counts.head(1):
        return marked(kinds)
    parts = written(_cut(kinds.join(counts, "anchor"), WIDTHS[width]), "cuts")
    first = parts.groupBy("anchor", "run").agg(F.first("left").alias("left"), F.first("data").alias("data"), (F.max("twice").cast("boolean") | (F.count("*") > 1)).alias("twice"))
    marks = written(found_marks(written(first.select(*kinds.columns), "kinds"), width + 1), "marks")
    back = parts.select("anchor", "run", "of_anchor", "of_run", "offset").join(marks, ["anchor", "run"])
    return marked(kinds.join(counts, "anchor", "left_anti")).unionByName(back.select(F.col("of_anchor").alias("anchor"), F.col("of_run").alias("run"), (F.col("low") + F.col("offset")).alias("low"), (F.col("high") + F.col("offset")).alias("high")))


def _spans(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, low, high) bytes that repeated windows cover, at most one range a run.

    Any two windows of a run begin less than ``LENGTH`` bytes apart, as both hold its anchor: what they cover overlaps.
    """
    at = F.min(F.struct("key", "start", "n", "left")).alias("at")
    with scratch(texts.sparkSession):
        kinds = shared.groupBy("anchor", "run").agg(F.count("*").alias("c"), at)
        kinds = written(kinds.select("anchor", "run", "at.*", (F.col("c") > 1).alias("twice"), (F.col("c") > COMMON).alias("common")), "wanted")
        marks = found_marks(written(_bytes(texts, kinds), "kinds"))
        common = kinds.where("common").select("anchor", "run", "common")  # one in COMMON rows of shared at most
        ranges = marks.groupBy("anchor", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        ranges = written(ranges.join(F.broadcast(common), ["anchor", "run"], "left"), "ranges")
    # All windows of a common run are repeated, so it has a range.
    often = F.broadcast(ranges.where("common").drop("common"))
    others = shared.join(often, ["anchor", "run"], "left_anti").join(ranges.where("common IS NULL").drop("common"), ["anchor", "run"])
    spans = shared.join(often, ["anchor", "run"]).unionByName(others)
    return spans.select("key", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") - 1 + LENGTH).alias("high"))


def _cuts(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """What each text loses that loses anything: key, n_removed, n_spans, SHA-256 of what is left."""
    keyed = _keyed(documents)
    # Equal texts are one text; what stands twice as a whole goes as a whole.
    with scratch(documents.sparkSession):
        runs = written(found_runs(documents).distinct(), "runs")
        # A table, so that the join has no aggregate below it and Spark can deal the runs of a frequent anchor over several tasks.
        anchors = written(runs.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
        shared = written(runs.join(anchors, "anchor"), "shared")
    one = docs.groupBy("key").agg(F.min("doc_id").alias("_id"), F.count("*").alias("m"), F.first("n_bytes").alias("size"))
    whole = one.where(f"m > 1 AND size >= {LENGTH}").select("key", F.lit(0).alias("low"), F.col("size").cast("int").alias("high"))
    used = shared.select("key").unionByName(whole.select("key")).distinct().join(one, "key").select(F.col("key").alias("_key"), "_id")
    texts = keyed.join(used, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text")
    texts = written(texts, "used")
    spans = _spans(texts, shared).unionByName(whole)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, own in zip(batch["key"], batch["text"], batch["spans"], strict=True):
                data, kept, gone, count, end = text.encode(), hashlib.sha256(), 0, 0, -1
                for low, high in sorted((s["low"], s["high"]) for s in own):
                    if low > end:
                        kept.update(data[max(end, 0) : low])
                        count += 1
                        gone, end = gone + high - low, high
                    elif high > end:
                        gone, end = gone + high - end, high
                kept.update(data[max(end, 0) :])
                rows.append((key, gone, count, kept.hexdigest()))
            yield pd.DataFrame(rows, columns=["key", "n_removed", "n_spans", "left"])

    of_text = spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))  # of one text
    return texts.join(of_text, "key").select("key", "text", "spans").mapInPandas(cut, "key binary, n_removed long, n_spans long, left string").dropDuplicates(["key"])


def removed(documents: DataFrame) -> DataFrame:
    """One row a document: what is removed, and the SHA-256 of what is left."""
    keyed = _keyed(documents)
    docs = written(keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")), "texts")
    with scratch(documents.sparkSession):
        cuts = written(_cuts(docs, documents), "cuts")
    out = docs.join(cuts, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("left", "whole").alias("kept_sha256"))
