"""Token-id files of independent zstandard frames with a seek table.

Layout of a file, readable by any zstandard decoder:

* data frames: the ids of consecutive documents, little-endian, 2 bytes each
  when the vocabulary has at most 65,536 ids and 4 otherwise; each frame is
  compressed on its own and carries a checksum of its content;
* an index in a skippable frame: a zstandard frame of the id width, the
  documents' ids, null flags, frames, places in the frame and lengths;
* the seek table of the seekable format in a last skippable frame: sizes and
  the low 32 bits of XXH64 of every frame above, then the number of frames, a
  flag byte and a magic number.

A reader takes the table from the end of the file, then the index, and
decompresses only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import fs_of, saved, slices, text_column
from .tokens import SLICE, tokenizer

#: Fixed by the zstandard formats: magic numbers of skippable frames (index,
#: seek table) and of the end of a seek table; flag: entries have checksums.
INDEX_MAGIC, TABLE_MAGIC, END_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Ids in a frame before it ends with the next document; compression level.
FRAME_IDS, LEVEL = 1 << 16, 3

_MANIFEST = "part int, path string, documents long, tokens long, bytes long"


class FrameWriter:
    """Writes documents to one file object."""

    def __init__(self, out, width: int, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        import zstandard
        self.out, self.kind, self.frame_ids = out, f"<u{width}", frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.open: list[np.ndarray] = []
        self.held = self.tokens = self.bytes = 0
        self.docs: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(self.table), self.held, len(ids)))
        self.open.append(ids.astype(self.kind, copy=False))
        self.held += len(ids)
        self.tokens += len(ids)
        if self.held >= self.frame_ids:
            self._end_frame()

    def _write(self, frame: bytes, raw: bytes) -> None:
        from xxhash import xxh64_intdigest
        self.out.write(frame)
        self.bytes += len(frame)
        self.table.append((len(frame), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _end_frame(self) -> None:
        if self.open:
            raw = np.concatenate(self.open).tobytes()
            self._write(self.zstd.compress(raw), raw)
            self.open, self.held = [], 0

    def close(self) -> None:
        self._end_frame()
        cols = list(zip(*self.docs)) or [()] * 5
        raw = struct.pack("<BQ", int(self.kind[-1]), len(self.docs)) + b"".join(
            np.array(c, t).tobytes() for c, t in zip(cols, ("<i8", "<u1", "<u4", "<u4", "<u4")))
        body = self.zstd.compress(raw)
        self._write(struct.pack("<II", INDEX_MAGIC, len(body)) + body, b"")
        rows = b"".join(struct.pack("<III", *t) for t in self.table)
        end = rows + struct.pack("<IBI", len(self.table), CHECKSUMS, END_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(end)) + end)
        self.bytes += 8 + len(end)


class FrameReader:
    """Reads documents from one seekable file object."""

    def __init__(self, f, size: int):
        import zstandard
        self.f, self.zstd = f, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != END_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw_sizes, self.sums = table.T
        self.starts = np.cumsum(self.sizes) - self.sizes
        raw = self.zstd.decompress(self._at(int(self.starts[-1]) + 8, int(self.sizes[-1]) - 8))
        width, docs = struct.unpack("<BQ", raw[:9])
        self.kind, at, cols = f"<u{width}", 9, []
        for t in ("<i8", "<u1", "<u4", "<u4", "<u4"):
            cols.append(np.frombuffer(raw, t, docs, at))
            at += cols[-1].nbytes
        self.ids, self.null, self.frame, self.place, self.length = cols

    def _at(self, start: int, n: int) -> bytes:
        self.f.seek(start)
        return self.f.read(n)

    def frame_ids(self, k: int) -> np.ndarray:
        from xxhash import xxh64_intdigest
        raw = self.zstd.decompress(self._at(int(self.starts[k]), int(self.sizes[k])))
        if len(raw) != self.raw_sizes[k] or xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, self.kind)

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row in the file, ids) of the given rows, in order; None: of all."""
        last, ids = -1, np.zeros(0, "<u4")
        frame, place, end = self.frame.tolist(), self.place.tolist(), (self.place + self.length).tolist()
        for r in range(len(frame)) if rows is None else rows:
            if frame[r] != last:
                last = frame[r]
                ids = self.frame_ids(last).astype("<u4")
            yield r, ids[place[r]:end[r]]


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending id
    order, one file for each range of ids, under ``path`` (by default the
    shared checkpoint folder). Returns the manifest: part, path, documents,
    tokens, bytes.

    Null text counts as empty; null ids come first; rows with one id keep
    their order. An empty table gives no file. A file is written under a name
    of its own for each attempt and then renamed, so a repeated task replaces
    it whole. Other columns are not read.
    """
    root = path or scratch_path(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        ctx = TaskContext.get()
        fs, folder = fs_of(root)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{ctx.partitionId():06d}.ids.zst"
        own = f"{name}.{ctx.taskAttemptId()}.tmp"
        tok = tokenizer(vocabulary)
        width = 2 if max(tok.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        writer = None
        with fs.open_output_stream(own) as out:
            writer = FrameWriter(out, width)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), text_column(b, 1)
                for i, j in slices(texts, SLICE):
                    flat, off = tok.encode(texts.slice(i, j - i), end_id)
                    flat = flat.astype(writer.kind)
                    for k in range(j - i):
                        writer.add(ids[i + k], flat[off[k]:off[k + 1]])
            writer.close()
        if not writer.docs:
            fs.delete_file(own)
            return
        fs.move(own, name)
        yield pa.RecordBatch.from_pylist(
            [{"part": ctx.partitionId(), "path": name, "documents": len(writer.docs),
              "tokens": writer.tokens, "bytes": writer.bytes}],
            pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()),
                       ("tokens", pa.int64()), ("bytes", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    manifest = saved(ordered.select("doc_id", "text").mapInArrow(run, _MANIFEST), "token-manifest")
    # The folder's scheme is that of the path given, for readers.
    prefix = root[:len(root) - len(fs_of(root)[1])]
    return manifest.withColumn("path", F.concat(F.lit(prefix), "path"))


def read_token_files(manifest: DataFrame, only: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (binary,
    little-endian unsigned 32-bit) of all documents, or of those whose id is
    in ``only``; then no other frames are decompressed."""
    before = F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    wanted = None if only is None else np.array(sorted(only), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = fs_of(path)
                with fs.open_input_file(name) as f:
                    r = FrameReader(f, f.size())
                    start = base + np.cumsum(r.length.astype(np.int64)) - r.length
                    rows = None if wanted is None else np.flatnonzero(np.isin(r.ids, wanted) & (r.null == 0))
                    held, size = [], 0
                    for row, ids in r.documents(rows):
                        held.append((row, ids.tobytes()))
                        size += len(held[-1][1])
                        if size > 8 << 20:
                            yield _rows(r, start, held)
                            held, size = [], 0
                    yield _rows(r, start, held)

    # Without coalescing: a file is read by a task of its own.
    dealt = files.repartition(F.col("path"))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(r: FrameReader, start: np.ndarray, held: list) -> pa.RecordBatch:
    at = np.array([h[0] for h in held], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(r.ids[at], pa.int64(), mask=r.null[at].astype(bool)), pa.array(start[at], pa.int64()),
         pa.array(r.length[at].astype(np.int64)), pa.array([h[1] for h in held], pa.binary())],
        ["doc_id", "start", "n_tokens", "ids"])
