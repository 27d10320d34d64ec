"""Token ids in files: frequency-ranked, byte-aligned, with separate control bytes.

Layout of a file (little-endian): ``FSV1``, then four u32 (documents, ids,
ranks, bytes of data), then per document a null flag (u8), an id (i64) and a
count (u32), then the rank table (u32: the id of rank 0, 1, ...; most frequent
first), then control bytes (2 bits per id: its bytes less one, four ids to a
byte) and the data bytes of the ranks. Frequent ids so take one byte.
A file holds whole documents; files are in ascending (doc_id) order of their
names, ``<partition>-<block>.fsv``. Executors write them into the shared folder,
each under a name of its own first, so a task that is run again replaces its
files whole; a table of the files says which belong to the result. Spark reads
them as binary files, and any program can by this description.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ordered_offsets, shared_path, stored, table
from .tokens import encoder, tokenizer_path

MAGIC = b"FSV1"
#: Ids below this are counted in a table; both ways give the same file.
COUNTED_IDS = 1 << 20
#: A file is closed once it holds this many ids.
FILE_IDS = 2_000_000
FILES = "part long, block int, n_ids long, name string"
SCHEMA = "part long, block int, doc_id long, at long, n_tokens long, ids_crc32 long"

#: For each control byte the bytes of its four ids.
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


#: Names that Hadoop gives to stores, and Arrow's for the same ones.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def arrow_address(path: str) -> str:
    """The address under which Arrow opens a path of the shared folder; its keys come from the task's environment."""
    scheme, mark, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else path


def encode_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file of whole documents; ids are unsigned 32-bit integers."""
    counts = np.array([len(x) for x in ids], "<u4")
    flat = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.uint32)
    if len(flat) and int(flat.max()) < COUNTED_IDS:  # a vocabulary's ids: counted and looked up in tables
        freq = np.bincount(flat)
        values = np.flatnonzero(freq)
        order = np.lexsort((values, -freq[values]))
        rank_of = np.empty(len(freq), np.uint32)
        rank_of[values[order]] = np.arange(len(values), dtype=np.uint32)
        ranks = rank_of[flat]
    else:
        values, inverse, freq = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((values, -freq))
        rank_of = np.empty(len(values), np.uint32)
        rank_of[order] = np.arange(len(values), dtype=np.uint32)
        ranks = rank_of[inverse] if len(flat) else np.empty(0, np.uint32)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    head = MAGIC + struct.pack("<4I", len(ids), len(flat), len(values), len(data))
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, nulls.tobytes(), keys.tobytes(), counts.tobytes(), values[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()])


def decode_file(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids per document, and all ids, by table lookup over the control bytes."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, n, ranks, size = struct.unpack_from("<4I", blob, 4)
    at = 20
    parts = []
    for kind, k in (("u1", docs), ("<i8", docs), ("<u4", docs), ("<u4", ranks), ("u1", -(-n // 4)), ("u1", size)):
        parts.append(np.frombuffer(blob, kind, k, at))
        at += parts[-1].nbytes
    nulls, keys, counts, by_rank, control, data = parts
    lengths = _LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    out = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            out[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else int(k) for z, k in zip(nulls, keys, strict=True)], counts.astype(np.int64), by_rank[out]


def write_token_files(df: DataFrame, path: str, end_id: int, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files in ascending id order in the shared folder, and the table of them: part, block, n_ids, name.

    Texts are range-partitioned by (id, hash of the text), so repeated ids can
    be split; ids and ties are in this order in the files. Null ids come first,
    null texts are empty and hold ``end_id`` only. A document is one file's
    however long; other columns are left out; an empty table has no files.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    docs = df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").withColumn("tie", F.xxhash64("text"))
    docs = docs.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text")

    folder = shared_path(spark, "token-files")

    def put(name: str, blob: bytes) -> None:
        files, root = pyarrow.fs.FileSystem.from_uri(arrow_address(folder))
        files.create_dir(root, recursive=True)
        own = f"{root}/.{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(own) as out:
            out.write(blob)
        files.move(own, f"{root}/{name}")

    def run(batches):
        ids_of = encoder(path).batch
        end = np.array([end_id], "<u4")
        block, keys, ids, n, part = 0, [], [], 0, 0

        def row():
            name = f"{part:09d}-{block:06d}.fsv"
            put(name, encode_file(keys, ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([name])], names=["part", "block", "n_ids", "name"])

        for b in batches:
            for part, key, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ids_of(b.column(2)), strict=True):
                x = np.concatenate([own, end])
                keys.append(key)
                ids.append(x)
                n += len(x)
                if n >= file_ids:
                    yield row()
                    block, keys, ids, n = block + 1, [], [], 0
        if keys:
            yield row()

    files = stored(docs.mapInArrow(run, FILES), "token-file-names")
    files.folder = folder
    return files


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files of ``write_token_files``: doc_id, start, n_tokens, ids_crc32.

    ``start`` is a sum of file totals (one small row per file, then per
    partition) and of the counts inside the file.
    """

    def run(batches):
        for b in batches:
            for part, block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                keys, counts, ids = decode_file(blob.as_py())
                starts = np.cumsum(counts) - counts
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * (s + c)]) for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([block] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    from pyspark.sql import Window

    sizes = files.select("part", "block", "n_ids")
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).drop("n_ids")
    before = ordered_offsets(sizes.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n", "before").drop("n")
    offsets = inside.join(before, "part")
    if files.isEmpty():
        return files.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    blobs = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.fsv").load(files.folder)
    name = F.element_at(F.split("path", "/"), -1)
    place = [F.split(name, r"[-.]")[k].cast(t).alias(c) for k, (c, t) in enumerate((("part", "long"), ("block", "int")))]
    docs = blobs.select(*place, F.col("content").alias("file")).mapInArrow(run, SCHEMA)
    return docs.join(offsets, ["part", "block"]).select("doc_id", (F.col("before") + F.col("inside") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_token_files(files)
