"""A3 from packed stills: many still images in one archive, as a camera's
recording is one file with many frames.

An archive is a tar file; a member ``<camera>/<frame>[.ext]`` is one still, its
modification time the frame time. Archives are read whole by Spark's binary
file source, so offsets, restarts and any file system are Spark's: an archive
is the unit of reading, and should be some tens of megabytes.
"""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from .streams import BINARY_FILE_SCHEMA

#: Bytes of stills in an archive.
ARCHIVE_BYTES = 16 << 20

_MEMBER = re.compile(r"^(?:\./)?(.+)/([^/]+?)(?:\.[^./]*)?$")
_NUMBER = re.compile(r"-?\d{1,18}\Z")
_STILLS = "camera_id string, frame_id long, ts_us long, content binary, reason string"


def unpack(archives: DataFrame) -> DataFrame:
    """The stills of archives (``path``, ``content``): camera_id, frame_id (NULL
    when the name is no number), ts_us, content, reason. A member without a
    camera folder, and an archive that ends early or is none, give a row that
    says so; the stills before the damage are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                yield _members(path.as_py(), data.as_buffer() if data.is_valid else pa.py_buffer(b""))

    return archives.select("path", "content").mapInArrow(run, _STILLS)


def _members(path: str, data: pa.Buffer) -> pa.RecordBatch:
    bad, found = None, _plain_members(data)
    if found is None:
        found, bad = _any_members(path, data)
    names, times, images = map(list, found)
    cameras, frames, reasons = [], [], []
    for name in names:
        m = _MEMBER.match(name)
        camera, stem = m.groups() if m else (None, None)
        cameras.append(camera)
        frames.append(int(stem) if stem and _NUMBER.match(stem) else None)
        reasons.append(None if m else f"no camera: {name}")
    columns = [cameras, frames, times, images, reasons]
    if bad:
        columns = [c + [v] for c, v in zip(columns, (None, None, None, None, bad))]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()))],
        ["camera_id", "frame_id", "ts_us", "content", "reason"])


def _any_members(path: str, data: pa.Buffer) -> tuple[tuple, str | None]:
    """Names, times (microseconds) and contents of the files of any archive,
    up to its damage, and what is wrong with it."""
    out: list[tuple] = []
    bad = None
    try:
        with tarfile.open(fileobj=pa.BufferReader(data), mode="r:") as tar:
            for m in tar:
                if not m.isfile():
                    continue
                image = tar.extractfile(m).read()
                if len(image) < m.size:
                    raise tarfile.ReadError("unexpected end of data")
                out.append((m.name, round(float(m.mtime) * 1_000_000), image))
    except tarfile.TarError as e:
        bad = f"bad archive: {path}: {e}"
    return tuple(zip(*out)) or ((), (), ()), bad


def _plain_members(data: pa.Buffer) -> tuple | None:
    """``_any_members`` of an undamaged archive that has nothing but files with
    short ASCII names, each with its time in the header or in an extended
    header of its own, as ``write_archives`` packs them: headers are checked
    and read as columns. None for any other archive."""
    view, blocks = memoryview(data), np.frombuffer(data, np.uint8)[:data.size // 512 * 512].reshape(-1, 512)
    at, heads = 0, []
    try:
        while at < len(blocks) and view[at * 512]:
            heads.append(at)
            size = int(view[at * 512 + 124:at * 512 + 135].tobytes(), 8)
            if size < 0:
                return None
            at += 1 + (size + 511 >> 9)
    except ValueError:
        return None
    if not heads or at >= len(blocks) or blocks[at].any():
        return None
    heads = np.array(heads)
    h = blocks[heads]
    numbers = [h[:, i:j].astype(np.int64) - 48 for i, j in ((124, 135), (136, 147), (148, 154))]
    if any(((d < 0) | (d > 7)).any() for d in numbers):
        return None
    sizes, mtimes, sums = (d @ 8 ** np.arange(d.shape[1] - 1, -1, -1) for d in numbers)
    extended, names = h[:, 156] == ord("x"), h[:, :100]
    if not (np.isin(h[:, 156], [ord("0"), ord("x")]).all() and np.isin(h[:, [135, 147, 154]], [0, 32]).all()
            and (h[:, 257:262] == np.frombuffer(b"ustar", np.uint8)).all() and not h[:, 345].any()
            and (h.sum(axis=1, dtype=np.int64) - h[:, 148:156].sum(axis=1, dtype=np.int64) + 8 * 32 == sums).all()
            and (names < 128).all() and not ((names[:, 1:] != 0) & (names[:, :-1] == 0)).any()
            and not extended[-1] and not (extended[1:] & extended[:-1]).any()):
        return None
    seconds = mtimes.astype(float)
    if extended.any():  # each "<length> mtime=<seconds>\n"
        n, record, col = sizes[extended][:, None], blocks[heads[extended] + 1][:, :40], np.arange(40)
        text = np.where((col >= 9) & (col < n - 1), record, 0)
        if not (((n > 10) & (n <= 40)).all() and ((record == ord("\n")) & (col < n) == (col == n - 1)).all()
                and (record[:, :2] @ np.array([10, 1]) - 11 * 48 == n[:, 0]).all()
                and (record[:, 2:9] == np.frombuffer(b" mtime=", np.uint8)).all()
                and np.isin(text, list(b"\0.0123456789")).all()):
            return None
        try:
            seconds[np.flatnonzero(extended) + 1] = text[:, 9:].copy().view("S31")[:, 0].astype(float)
        except ValueError:
            return None
    still = ~extended
    if seconds.max() > 1e11:
        return None
    return ([x.decode() for x in names[still].copy().view("S100")[:, 0].tolist()],
            np.rint(seconds[still] * 1_000_000).astype(np.int64).tolist(),
            [view[i:j].tobytes() for i, j in zip(((heads[still] + 1) * 512).tolist(),
                                                 ((heads[still] + 1) * 512 + sizes[still]).tolist())])


def packed_stills(spark: SparkSession, folder: str, streaming: bool = True,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Frame records of the archives in a folder: camera_id, frame_id, value
    (the producer's JSON, NULL where ``reason`` says what is wrong)."""
    r = (spark.readStream.schema(BINARY_FILE_SCHEMA) if streaming else spark.read).format("binaryFile")
    if streaming and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    stills = unpack(r.option("pathGlobFilter", "*.tar").load(folder))
    ts = codec.iso_timestamp(F.timestamp_micros("ts_us"))
    value = F.when(F.col("reason").isNull(), codec.frame_message(codec.encode_image("content"), ts, F.col("camera_id")))
    return stills.select("camera_id", "frame_id", value.alias("value"), "reason")


def _digits(x: np.ndarray, base: int, n: int) -> np.ndarray:
    return (x[:, None] // base ** np.arange(n - 1, -1, -1) % base + 48).astype(np.uint8)


def _member_info(name: str, us: int, size: int) -> tarfile.TarInfo:
    member = tarfile.TarInfo(name)
    member.size, member.mtime = size, us / 1_000_000
    return member


def _plain_headers(names: pa.Array, us: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The three blocks before each still: extended header (the time with its
    fraction of one to six digits), its text, header."""
    forms = np.stack([np.frombuffer(_member_info("", int("1" * 10 + "1" * k + "0" * (6 - k)), 0).tobuf(), np.uint8)
                      for k in range(1, 7)])
    time = _digits(us, 10, 16)
    last = np.where(time[:, 11:] != 48, np.arange(1, 6), 0).max(axis=1, initial=0)
    h = forms[last]
    h[:, 521:531] = time[:, :10]
    h[:, 532:538] = np.where(np.arange(6) <= last[:, None], time[:, 10:], h[:, 532:538])
    header = h[:, 1024:]
    header[:, :100] = np.array(names.cast(pa.binary()).to_pylist(), "S100").view(np.uint8).reshape(-1, 100)
    header[:, 124:135] = _digits(sizes, 8, 11)
    header[:, 136:147] = _digits(np.rint(us / 1_000_000).astype(np.int64), 8, 11)
    header[:, 148:156] = 32
    header[:, 148:154] = _digits(header.sum(axis=1, dtype=np.int64), 8, 6)
    header[:, 154] = 0
    return h.reshape(-1, 3, 512)


def _tar_blocks(names: pa.Array, us: np.ndarray, images: pa.Array) -> np.ndarray:
    """The members of an archive, the bytes that ``tarfile`` would write. Headers
    of short ASCII names and times from 2001 to 2223 are made as columns, the
    others one by one by ``tarfile``."""
    images = [i or b"" for i in images.to_pylist()]
    sizes = np.array([len(i) for i in images], np.int64)
    plain = pc.and_(pc.string_is_ascii(names), pc.less_equal(pc.binary_length(names), 100)).to_numpy(zero_copy_only=False) \
        & (us >= 10 ** 15) & (us < 8 * 10 ** 15)
    others = {i: np.frombuffer(_member_info(names[i].as_py(), int(us[i]), int(sizes[i])).tobuf(), np.uint8).reshape(-1, 512)
              for i in np.flatnonzero(~plain).tolist()}
    n_head = np.full(len(images), 3)
    n_head[list(others)] = [len(h) for h in others.values()]
    n_blocks = n_head + (sizes + 511) // 512
    start = np.cumsum(n_blocks) - n_blocks
    out = np.zeros((n_blocks.sum(), 512), np.uint8)
    out[start[plain][:, None] + np.arange(3)] = _plain_headers(names.filter(pa.array(plain)), us[plain], sizes[plain])
    for i, h in others.items():
        out[start[i]:start[i] + len(h)] = h
    flat = memoryview(out.reshape(-1))
    for at, image in zip(((start + n_head) * 512).tolist(), images):
        flat[at:at + len(image)] = image
    return out


def write_archives(stills: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Pack stills (camera_id, frame_id, ts, content) into archives of about
    ``archive_bytes`` under a shared folder; returns the number of stills.
    Each task writes its own files, under a name of the attempt first, so a
    repeated task replaces them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext
        ctx, n = TaskContext.get(), 0
        system, root = (fs.LocalFileSystem(), urlparse(folder).path) if urlparse(folder).scheme in ("", "file") \
            else fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        done, held, size = 0, [], 0

        def close() -> None:
            nonlocal done, held, size
            if held:
                name = f"{root}/part-{ctx.partitionId():05d}-{done:04d}.tar"
                own = f"{name}.{ctx.taskAttemptId()}.tmp"
                with system.open_output_stream(own) as out:
                    for blocks in held:
                        out.write(blocks)
                    end = 2 * tarfile.BLOCKSIZE
                    out.write(bytes(end + -(sum(x.nbytes for x in held) + end) % tarfile.RECORDSIZE))
                system.move(own, name)
            done, held, size = done + 1, [], 0

        for b in batches:
            names, us, images = b.columns
            if us.null_count:
                raise TypeError("a still has no time")
            us, ends = us.to_numpy(), np.cumsum(pc.fill_null(pc.binary_length(images), 0).to_numpy().astype(np.int64) + 1024)
            a = 0
            while a < b.num_rows:  # up to the still that fills the archive
                before = int(ends[a - 1]) if a else 0
                z = min(int(np.searchsorted(ends, before + archive_bytes - size)) + 1, b.num_rows)
                held.append(_tar_blocks(names[a:z], us[a:z], images[a:z]))
                size, n, a = size + int(ends[z - 1]) - before, n + z - a, z
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    camera, frame = (F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("camera_id", "frame_id"))
    rows = stills.select(F.concat(camera, F.lit("/"), frame), F.unix_micros(F.col("ts").cast("timestamp")), "content")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
