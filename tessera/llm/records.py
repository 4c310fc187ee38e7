"""Token ids as length-delimited binary records with an offset index.

A data file is a row of frames, as TFRecord has them:

    u64 length | u32 masked CRC-32C of the length's 8 bytes | payload | u32 masked CRC-32C of the payload

all little-endian. The payload is one serialized sequence: u8 flags (1: the
key is null), u8 bytes per id (2 or 4), i64 key, then the ids. Beside each
``NAME.rec`` stands ``NAME.idx``: the magic ``TSIX0001``, u64 count n, n u64
frame offsets, n u64 numbers of ids before the frame's (in its file), and a
u32 masked CRC-32C of all before it. A shuffled reader needs the index alone
to seek any record of any file.
"""

from __future__ import annotations

import os
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_partitions, small_batches, whole_text
from .crc32c import crc32c, masked
from .tokens import encoder

_HEAD = struct.Struct("<BBq")
_MAGIC = b"TSIX0001"
#: Bytes of frames that a reader takes at once.
READ_BYTES = 8 << 20
#: Bytes of input, as Spark estimates them, for each file beyond those of the session's shuffle partitions.
FILE_BYTES = 256 << 20
#: Records that a shuffled reader deals out at once.
DEAL = 4096


class CorruptRecord(ValueError):
    """A checksum or a length does not hold."""


def filesystem(path: str):
    """The file system of a URI or a local path, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def frames(keys: list, payload_ids: list[bytes], width: int) -> tuple[bytes, np.ndarray]:
    """The frames of some records in one buffer, and each frame's length."""
    payloads = [_HEAD.pack(k is None, width, 0 if k is None else k) + ids for k, ids in zip(keys, payload_ids, strict=True)]
    sizes = np.array([len(p) for p in payloads], "<u8")
    joined = b"".join(payloads)
    ends = np.cumsum(sizes).astype(np.int64)
    body = masked(crc32c(joined, ends - sizes.astype(np.int64), sizes.astype(np.int64))).astype("<u4")
    head = masked(crc32c(sizes.tobytes(), np.arange(len(sizes)) * 8, np.full(len(sizes), 8))).astype("<u4")
    parts = []
    for p, n, h, b in zip(payloads, sizes, head, body, strict=True):
        parts += (n.tobytes(), h.tobytes(), p, b.tobytes())
    return b"".join(parts), sizes.astype(np.int64) + 16


def index_bytes(offsets: np.ndarray, before: np.ndarray) -> bytes:
    body = _MAGIC + struct.pack("<Q", len(offsets)) + offsets.astype("<u8").tobytes() + before.astype("<u8").tobytes()
    crc = masked(crc32c(body, np.array([0]), np.array([len(body)])))
    return body + crc.astype("<u4").tobytes()


def read_index(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Frame offsets and numbers of ids before each frame, from an index file."""
    system, at = filesystem(path)
    with system.open_input_stream(at) as f:
        data = f.read()
    if data[:8] != _MAGIC or len(data) < 20:
        raise CorruptRecord(f"{path}: no index")
    n = struct.unpack_from("<Q", data, 8)[0]
    if len(data) != 20 + 16 * n or masked(crc32c(data, np.array([0]), np.array([len(data) - 4])))[0] != struct.unpack("<I", data[-4:])[0]:
        raise CorruptRecord(f"{path}: the index is damaged")
    return np.frombuffer(data, "<u8", n, 16).astype(np.int64), np.frombuffer(data, "<u8", n, 16 + 8 * n).astype(np.int64)


def parse(buffer: bytes, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """The (key, ids) of frames in a buffer, after all their checksums hold."""
    if not len(offsets):
        return
    sizes = np.array([struct.unpack_from("<Q", buffer, o)[0] for o in offsets.tolist()], np.int64)
    if (sizes != lengths - 16).any():
        raise CorruptRecord("a frame's length differs from the index")
    head = np.array([struct.unpack_from("<I", buffer, o + 8)[0] for o in offsets.tolist()], np.uint32)
    body = np.array([struct.unpack_from("<I", buffer, o + n - 4)[0] for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True)], np.uint32)
    if (masked(crc32c(buffer, offsets, np.full(len(offsets), 8))) != head).any() or (masked(crc32c(buffer, offsets + 12, sizes)) != body).any():
        raise CorruptRecord("a checksum does not hold")
    for o, n in zip(offsets.tolist(), sizes.tolist(), strict=True):
        null, width, key = _HEAD.unpack_from(buffer, o + 12)
        yield None if null else key, np.frombuffer(buffer, "<u2" if width == 2 else "<u4", (n - _HEAD.size) // width, o + 12 + _HEAD.size)


def read_file(path: str, order: np.ndarray | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(key, ids before it in the file, ids) of every record, or of those at ``order``, e.g. shuffled."""
    offsets, before = read_index(path[: -len(".rec")] + ".idx")
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        ends = np.append(offsets[1:], f.size())
        if order is not None:
            for i in order.tolist():
                f.seek(int(offsets[i]))
                n = int(ends[i] - offsets[i])
                for key, ids in parse(f.read(n), np.array([0]), np.array([n])):
                    yield key, int(before[i]), ids
            return
        i = 0
        while i < len(offsets):
            j = max(i + 1, int(np.searchsorted(ends, offsets[i] + READ_BYTES, "right")))
            f.seek(int(offsets[i]))
            got = parse(f.read(int(ends[j - 1] - offsets[i])), offsets[i:j] - offsets[i], ends[i:j] - offsets[i:j])
            for k, (key, ids) in enumerate(got, i):
                yield key, int(before[k]), ids
            i = j


def _replace(system, source: str, target: str) -> None:
    """Moves a whole file over another; some file systems refuse to move onto what an earlier attempt has left."""
    try:
        system.move(source, target)
    except OSError:
        system.delete_file(target)
        system.move(source, target)


def _writer(folder: str, tokenizer_path: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        enc = encoder(tokenizer_path)
        end = b"" if end_id is None else end_id.to_bytes(enc.width, "little")
        name = f"part-{context.partitionId():06d}"
        trial = f"{folder}/_trial-{name}-{context.taskAttemptId()}"
        system = at = out = None
        lengths, counts, first = [], [], None
        try:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                if not keys:
                    continue
                if out is None:
                    system, at = filesystem(trial)
                    system.create_dir(posixpath.dirname(at), recursive=True)
                    out, first = system.open_output_stream(at), keys[0]
                texts = batch.column(1).to_pylist()
                for a in range(0, len(texts), 256):
                    ids = [x + end for x in enc.encode(texts[a : a + 256])]
                    data, sizes = frames(keys[a : a + 256], ids, enc.width)
                    out.write(data)
                    lengths.append(sizes)
                    counts.append(np.array([len(x) // enc.width for x in ids], np.int64))
        finally:
            if out is not None:
                out.close()
        if out is None:
            return
        # A task that runs again writes the same bytes; the move replaces a whole file by a whole file.
        sizes, n = np.concatenate(lengths), np.concatenate(counts)
        final = posixpath.join(posixpath.dirname(at), name)
        with system.open_output_stream(at + ".idx") as f:
            f.write(index_bytes(np.cumsum(sizes) - sizes, np.cumsum(n) - n))
        _replace(system, at, final + ".rec")
        _replace(system, at + ".idx", final + ".idx")
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{name}.rec"]), pa.array([first], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())],
            names=["file", "first_key", "records", "ids"],
        )

    return write


def _estimated_bytes(docs: DataFrame) -> int:
    """Spark's estimate of a table's size, 0 where it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write_records(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text",
    end_id: int | None = 0, files: int | None = None,
) -> list[dict]:
    """Encodes every text and writes it, in ascending key order over all files; returns the files in that order.

    ``folder`` is on storage that all executors share (by default under
    spark.checkpoint.dir). Null texts are empty; null keys come first; rows
    with equal keys are ordered by text. Each file's dict has file, first_key,
    records, ids and start, the number of ids in all files before it. Only
    this list, a row for each file, comes to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch_path(spark, "records")
    n = files or max(shuffle_partitions(spark), _estimated_bytes(docs) // FILE_BYTES)
    rows = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"))
    rows = rows.repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    done = rows.mapInArrow(_writer(folder, tokenizer_path, end_id), "file string, first_key bigint, records bigint, ids bigint").collect()
    manifest, start = [], 0
    for r in sorted(done, key=lambda r: r.file):  # partitions of a range are in order
        manifest.append(r.asDict() | {"start": start})
        start += r.ids
    return manifest


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out: list[tuple] = []
            for key, before, ids in read_file(file):
                out.append((key, start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(out) == 10_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, read back from the files; a task reads some whole files."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not manifest:
        return spark.createDataFrame([], schema)
    tasks = min(len(manifest), 4 * spark.sparkContext.defaultParallelism)
    files = spark.sparkContext.parallelize([(m["file"], m["start"]) for m in manifest], tasks)
    return spark.createDataFrame(files, "file string, start bigint").mapInArrow(_digest, schema)


def shuffled(manifest: list[dict], seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records in a random order, files interleaved, by their indexes; for a training loop on one machine.

    Some records at a time are dealt out over the files by how many each has left, so memory grows with the files alone.
    """
    rng = np.random.default_rng(seed)
    left = np.array([m["records"] for m in manifest], np.int64)
    readers = [_in_random_order(m, rng) for m in manifest]
    while total := int(left.sum()):
        drawn = np.minimum(rng.multinomial(min(DEAL, total), left / total), left)
        left -= drawn
        for i in rng.permutation(np.repeat(np.arange(len(left)), drawn)).tolist():
            key, _, ids = next(readers[i])
            yield key, ids


def _in_random_order(file: dict, rng: np.random.Generator) -> Iterator[tuple[int | None, int, np.ndarray]]:
    yield from read_file(file["file"], rng.permutation(file["records"]))


def default_tokenizer() -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json"))
