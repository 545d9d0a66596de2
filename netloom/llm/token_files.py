"""Operator 4, token ids in files: frequency ranks in byte-aligned codes with separate control bytes.

A file holds consecutive documents in ascending id order. Its ids are replaced
by their rank in the file's own frequency table, so that the most frequent 256
take one byte. Layout, little-endian:

    4s   magic "NLF1"
    u32  documents, u64 ids, u32 ranks, u64 control bytes, u64 data bytes
    u32  part, u64 ids of the part's earlier files
    i64  document id of each document
    u8   1 where that id is null
    u64  number of ids of each document
    u32  id of each rank
    u8   control bytes: four 2-bit fields (bytes of a code, less one), lowest first
    u8   data bytes: each rank in 1 to 4 bytes

The control byte of four codes is the row number of a 256-row table of their
lengths, so decoding is table lookups and running sums over whole files.

Texts are dealt by range of the id and sorted, each task encodes its range and
closes a file whenever it holds enough ids; it writes under a temporary name
and renames, so an attempt that is run again leaves the same files. Files go to
the shared folder through pyarrow's file systems and are read by Spark's
binaryFile source. The manifest is a table, one row a file. A file knows the
ids before it in its part, so that a reader needs only where each part starts:
one row a task that wrote, added up by Spark, never by the driver.

Defined results: null text counts as empty (only the end id); ids of rows may
repeat, such rows are ordered by a hash of the text, then the text, and may lie
in several parts; a null id comes first; an empty table gives no files and an
empty result; other columns are not read.
"""

from __future__ import annotations

import contextlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import durable, shared_path, slices, small_batches, trim

HEAD = struct.Struct("<4sIQIQQIQ")
FILE_IDS = 1 << 21
#: Lengths of the four codes of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, part: int = 0, before: int = 0) -> bytes:
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    present = np.flatnonzero(counts)
    by_rank = present[np.argsort(-counts[present], kind="stable")]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    r = rank_of[ids]
    size = 1 + (r >= 1 << 8) + (r >= 1 << 16) + (r >= 1 << 24)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    data[at] = r & 255
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        data[at[more] + k] = r[more] >> 8 * k & 255
    fields = np.zeros(-len(r) % 4 + len(r), np.uint8)
    fields[: len(r)] = size - 1
    f = fields.reshape(-1, 4)
    control = f[:, 0] | f[:, 1] << 2 | f[:, 2] << 4 | f[:, 3] << 6
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    head = HEAD.pack(b"NLF1", len(doc_ids), len(r), len(by_rank), len(control), len(data), part, before)
    return b"".join((head, keys.tobytes(), nulls.tobytes(), lengths.astype("<u8").tobytes(), by_rank.astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()))


def decode_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids as unsigned 32-bit integers)."""
    magic, n_docs, n, n_ranks, n_control, n_data, _, _ = HEAD.unpack_from(content)
    if magic != b"NLF1":
        raise ValueError("not a token file")
    at, parts = HEAD.size, []
    for kind, count in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u4", n_ranks), ("u1", n_control), ("u1", n_data)):
        parts.append(np.frombuffer(content, kind, count, at))
        at += parts[-1].nbytes
    keys, nulls, lengths, by_rank, control, data = parts
    size = LENGTHS[control].reshape(-1)[:n]
    begin = np.cumsum(size) - size
    r = data[begin].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        r[more] |= data[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else k for k, z in zip(keys.tolist(), nulls.tolist(), strict=True)], lengths.astype(np.int64), by_rank[r]


def place(content: bytes) -> tuple[int, int]:
    """(part, ids of the part's earlier files)."""
    return HEAD.unpack_from(content)[-2:]


MANIFEST = "part int, name string, n_docs long, n_ids long, n_bytes long"
#: Parts whose starts one task adds up.
BLOCK = 4096


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files under ``path`` (a URI that pyarrow's file systems know); the manifest, one row a file. Parts and the names within them follow the order of ids."""
    data, whole = bpe.vocabulary(tokenizer)

    def run(batches):
        coder = bpe.coder(bpe.WordCoder, data, whole)
        context = TaskContext.get()
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        part, files, before = context.partitionId(), 0, 0
        keys, lengths, flats, held = [], [], [], 0

        def close():
            nonlocal keys, lengths, flats, held, files, before
            body = encode_file(keys, np.concatenate(lengths), np.concatenate(flats), part, before)
            name = f"{part:08d}-{files:08d}.nlf"
            temporary = f"{folder}/_{name}.{context.taskAttemptId()}"
            try:
                with fs.open_output_stream(temporary) as out:
                    out.write(body)
                fs.move(temporary, f"{folder}/{name}")
            except BaseException:
                with contextlib.suppress(OSError):
                    fs.delete_file(temporary)
                raise
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(keys)]), pa.array([held]), pa.array([len(body)])], names=["part", "name", "n_docs", "n_ids", "n_bytes"])
            keys, lengths, flats, held, files, before = [], [], [], 0, files + 1, before + held
            return row

        fs.create_dir(folder, recursive=True)
        for batch in batches:
            for s in slices(batch, 2):
                flat, n = coder.encode(s.column(2).to_pylist(), end_id)
                keys += s.column(0).to_pylist()
                lengths.append(n)
                flats.append(flat)
                held += len(flat)
                if held >= file_ids:
                    yield close()
        if keys:
            yield close()
        trim()

    small_batches(docs.sparkSession)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{text_col}`").alias("h"), F.col(f"`{text_col}`").alias("text"))
    ordered = named.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    return durable(ordered.mapInArrow(run, MANIFEST), "manifest")


def part_starts(manifest: DataFrame) -> DataFrame:
    """part, first: the ids before each part. Running sums within blocks of parts, and over the blocks."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy("block")).alias("base"))  # a row for BLOCK tasks
    own = parts.select("part", "block", before(Window.partitionBy("block").orderBy("part")).alias("own"))
    return own.join(blocks, "block").select("part", (F.col("own") + F.col("base")).alias("first"))


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of every document in the files."""
    starts = part_starts(manifest)

    def run(batches):
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = content.as_buffer().to_pybytes()
                keys, lengths, ids = decode_file(body)
                ends = np.cumsum(lengths) + first + place(body)[1]
                raw = ids.astype("<u4").tobytes()
                stops = np.cumsum(lengths).tolist()
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(stops, lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(own, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.nlf").load(path)
    named = found.select(F.split(F.element_at(F.split("path", "/"), -1), "-")[0].cast("int").alias("part"), "content")
    # one short row a task that wrote: its size is that of the writing job, not of the table
    return named.join(F.broadcast(starts), "part").select("first", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2) -> DataFrame:
    """Write all documents, read the files back and digest what they hold: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    manifest = write_token_files(docs, tokenizer, path, id_col, text_col, end_id=end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
